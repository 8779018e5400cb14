"""Periodic runs of words by an online sparse diagonal scheme, and texts with the repeats taken out."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode.functions import let
from devicelode.llm.common import small_batches

WORD = re.compile(r"[^ \t-\r]+")
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RESULT = f"doc_id long, n_words long, runs {RUNS}, collapsed string"


def named(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, names, lags) of the codes that occur more than once, in order of place.

    Equal codes share a name; a lag is the distance to the nearest earlier place of the same name, 0 at the first.
    """
    if not len(codes):
        return places, codes, places
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    again = np.concatenate([[False], same])
    repeated = again | np.concatenate([same, [False]])
    lags = np.zeros(len(codes), np.int64)
    at = places[order]
    lags[order[again]] = (at[1:] - at[:-1])[same]
    names = np.empty(len(codes), np.int64)
    names[order] = np.cumsum(~again) - 1
    kept = np.zeros(len(codes), bool)
    kept[order[repeated]] = True
    return places[kept], names[kept], lags[kept]


def diagonals(places: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, lag) of each diagonal: neighbouring places whose earlier occurrence lies at one lag."""
    if not len(places):
        return places, places, lags
    ends = np.concatenate([(places[1:] != places[:-1] + 1) | (lags[1:] != lags[:-1]), [True]])
    starts = np.concatenate([[True], ends[:-1]])
    return places[starts], places[ends], lags[starts]


def runs_of(words: np.ndarray, texts: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs in ``words``, numbers in one row; ``texts`` numbers the text of each, in order.

    A run has a smallest period q, at least ``max(least, times * q)`` words, and no neighbour that keeps the period.

    The diagonals are those of the lags at which a word meets an earlier occurrence. All earlier occurrences of a common
    word are quadratic in number, so they are thinned, without loss, to one per scale: scale k = 1, 2, 4, … looks at
    blocks of k words and follows only lags q with k / 2 < q <= k, and of a block only its nearest earlier occurrence. Inside a run of
    smallest period q a block of k >= q words can't recur nearer than q (two periods of a stretch as long as their sum
    would have a common divisor as period), so in each run of three periods the lag q is the nearest of every block behind
    the first period, and its diagonal is unbroken from end to end. A diagonal that stops is a run if it is long enough;
    nothing of it is looked at again. Blocks that occur once in their text leave all further scales. Time and memory are
    those of sorting the words once a scale, whatever the words.
    """
    found = []
    length = len(words)
    sizes = np.bincount(texts) if length else np.zeros(1, np.int64)
    deepest = int(sizes.max()) // times
    top = int(words.max()) + 1 if length else 1
    places, names, lags = named(texts.astype(np.int64) * top + words, np.arange(length))
    k = 1
    while len(places):
        first, last, lag = diagonals(places, lags)
        whole = last - first + k + lag
        good = (2 * lag > k) & (lag <= k) & (whole >= np.maximum(least, times * lag))
        found.append(np.stack([first - lag, whole, lag], axis=1)[good])
        if k >= deepest:
            break
        across = np.full(length + k, -1, np.int64)
        across[places] = names
        behind = across[places + k]
        both = behind >= 0
        places, names, lags = named(names[both] * (int(names.max()) + 1) + behind[both], places[both])
        k *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _collapsed(words: list[str], runs: np.ndarray) -> str:
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text (words: what stands between ASCII white space).

    ``runs``: (start, length, period) by start, then period, of all runs of at least ``max(least, times * period)`` words;
    see ``runs_of``. ``collapsed``: the words that no run holds after its first period, joined by one space.
    ``times`` is at least 3. Null and empty texts have no words, no runs and an empty ``collapsed``; repeated rows and null ids are rows of
    their own; other columns are ignored; an empty table gives an empty one. Rows stay where they are: no shuffle.
    """
    if times < 3:
        raise ValueError("times must be 3 or more: fewer periods don't show their lag at every scale")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            number = defaultdict(count().__next__)
            plain, ids = [], []
            for text in frame["text"]:
                words = WORD.findall(text) if text else []
                ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                plain.append(" ".join(words))
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = np.cumsum(sizes) - sizes
            rows = runs_of(np.concatenate(ids), np.repeat(np.arange(len(ids)), sizes), least, times) if len(ids) else np.zeros((0, 3), np.int64)
            owner = np.searchsorted(starts + sizes, rows[:, 0], side="right")
            bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
            out = []
            for i, (doc_id, text, size) in enumerate(zip(frame["doc_id"], plain, sizes, strict=True)):
                own = rows[bounds[i]:bounds[i + 1]] - np.array([starts[i], 0, 0])
                out.append((doc_id, int(size), [dict(zip(("start", "length", "period"), map(int, r), strict=True)) for r in own],
                            _collapsed(text.split(" "), own) if len(own) else text))
            done = pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "collapsed"])
            yield done.astype({"doc_id": "Int64", "n_words": "int64"})

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(scan, RESULT)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly (ties: smallest start, then period); null if there is none.

    ``runs`` must be in the order of ``periodic_runs``.
    """
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_tandems(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with repeats put into the texts of ids whose crc32 ends in 0, so that runs can be looked for.

    With h the checksum of the decimal id, g = floor(h / 10) and n words, the words from a = g % n on become copies of the
    1 + floor((n - a) / (3 + g % 8)) words there. A null id and a text without words stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.when(n > 0, let(F.struct(w.alias("w"), F.pmod(g, n).alias("a"), (1 + F.floor((n - F.pmod(g, n)) / (3 + g % 8))).alias("p")), lambda s: F.concat_ws(
            " ", F.transform(s["w"], lambda x, i: F.when(i < s["a"], x).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))))))

    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(let(words, repeated), F.col("text"))).otherwise(F.col("text")).alias("text"))
