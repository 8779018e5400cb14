"""Fill-in-middle: cuts at unit boundaries found by rank queries on a wavelet matrix over character classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode.llm.common import small_batches

OTHER, SPACE, STOP, NEWLINE = range(4)
#: The classes that end a unit; a text's last unit needs no end.
UNITS = {"character": (OTHER, SPACE, STOP, NEWLINE), "word": (SPACE, NEWLINE), "sentence": (STOP, NEWLINE), "line": (NEWLINE,)}
SENTINELS = ("<P>", "<S>", "<M>")


class WaveletMatrix:
    """Counts of each class before any place: one row of bits per bit of the class, the zeros of a level going first into the next."""

    def __init__(self, classes: np.ndarray, bits: int = 2):
        self.size, self.levels = len(classes), []
        for b in reversed(range(bits)):
            ones = (classes >> b & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            blocks = np.zeros(self.size // 64 + 1, "<u8")
            blocks.view(np.uint8)[:len(packed)] = packed
            counts = np.bitwise_count(blocks)
            before = np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])
            self.levels.append((b, blocks, before, self.size - int(counts.sum())))
            classes = np.concatenate([classes[~ones], classes[ones]])

    @staticmethod
    def _ones(blocks: np.ndarray, before: np.ndarray, places: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return before[places >> 6] + np.bitwise_count(blocks[places >> 6] & low)

    def rank(self, kind: int, places: np.ndarray) -> np.ndarray:
        """How many of the first ``place`` characters are of the class, for each place."""
        low, high = np.zeros(1, np.int64), np.asarray(places, np.int64)
        for b, blocks, before, zeros in self.levels:
            ones_low, ones_high = self._ones(blocks, before, low), self._ones(blocks, before, high)
            low, high = (zeros + ones_low, zeros + ones_high) if kind >> b & 1 else (low - ones_low, high - ones_high)
        return high - low

    def boundaries(self, kinds: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """How many of the first ``place`` characters end a unit."""
        return sum(self.rank(k, places) for k in kinds)

    def select(self, kinds: tuple[int, ...], numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest place between ``low`` and ``high`` with ``number`` boundaries before it; ``high`` if there is none. By bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.boundaries(kinds, middle) >= numbers
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def classes_of(points: np.ndarray) -> np.ndarray:
    """The class of each code point: line feed, other white space of ASCII, full stop and its like, or anything else."""
    kind = np.zeros(len(points), np.uint8)
    kind[(points == 32) | (points >= 9) & (points <= 13)] = SPACE
    kind[np.isin(points, [ord(c) for c in ".!?。！？"])] = STOP
    kind[points == 10] = NEWLINE
    return kind


def cut_places(texts: list[str], one: np.ndarray, two: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, first cut, second cut) of each text, all texts in one matrix; a cut lies behind ``number % (units + 1)`` units."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, ends = classes_of(points), UNITS[unit]
    matrix = WaveletMatrix(kinds)
    sizes = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(sizes)
    start = stop - sizes
    before = matrix.boundaries(ends, start)
    units = matrix.boundaries(ends, stop) - before
    last = np.concatenate([kinds, [OTHER]])[stop - 1]
    units += (sizes > 0) & ~np.isin(last, ends)
    cuts = np.sort(np.stack([one % (units + 1), two % (units + 1)]), axis=0)
    first, second = (matrix.select(ends, before + c, start, stop) - start for c in cuts)
    return units, first, second


def _distinct_marks(marks: tuple[str, str, str]) -> None:
    """No mark may overlap with another: else a mark and its neighbours could show a mark at an earlier place."""
    clash = [(a, b) for i, a in enumerate(marks) for j, b in enumerate(marks) for k in range(1, min(len(a), len(b)) + (i != j)) if a.endswith(b[:k])]
    if clash or not all(marks) or any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
        raise ValueError(f"marks must be distinct and must not overlap: {marks}")


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, suffix_first: int = 50, seed: int = 7,
                   marks: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` of every whole text.

    The text is cut behind two numbers of its ``n`` units (``UNITS``), drawn by the SHA-256 of ``seed:doc_id`` (a null id counts as
    empty text), and written as ``form`` says, P, S and M being ``marks``: ``psm`` is P prefix S suffix M middle, ``spm`` is
    S suffix P prefix M middle (``suffix_first`` per cent), ``plain`` the text itself. Plain are texts that are empty or
    hold a mark, and all but ``rate`` per cent of the others; their two lengths (code points) are null. A null text counts as empty.
    Repeated rows are rows of their own; other columns are ignored; rows stay where they are.
    """
    _distinct_marks(marks)
    ends = UNITS[unit] and unit
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")

    @F.pandas_udf("n long, first long, second long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in batches:
            found = cut_places(list(texts), one.to_numpy(np.int64), two.to_numpy(np.int64), ends)
            yield pd.DataFrame(dict(zip(("n", "first", "second"), found, strict=True)))

    text = F.col("text")
    holds = (text == "") | F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2]))
    form = F.when(holds | (number(2) % 100 >= rate), "plain").when(number(3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", form.alias("form"), cut(text, number(0), number(1)).alias("cut"))
    first, second = F.col("cut.first"), F.col("cut.second")
    prefix = F.substring(text, F.lit(1), first.cast("int"))
    middle = F.substring(text, (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring(text, (second + 1).cast("int"), F.length(text))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(
        F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    moved = F.col("form") != "plain"
    return rows.select("doc_id", "text", F.col("cut.n").alias("n"), "form", F.when(moved, first).alias("prefix_chars"),
                       F.when(moved, second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of, from it and its form alone."""
    p, s, m = marks
    after = lambda text, *parts: F.substring(text, sum((F.length(x) for x in parts), F.lit(1)), F.length(text))
    head = lambda text, mark: F.substring_index(text, mark, 1)

    def back(opening: str, second: str) -> tuple[Column, Column, Column]:
        body = after(output, F.lit(opening))
        one = head(body, second)
        rest = after(body, one, F.lit(second))
        two = head(rest, m)
        return one, two, after(rest, two, F.lit(m))

    prefix, suffix, middle = back(p, s)
    late, early, between = back(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, between, late)).otherwise(output)
