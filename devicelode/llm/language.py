"""Language identification: averaged hashed subword embeddings, a linear softmax on top, calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from devicelode.llm.common import saved, small_batches

NO_LETTERS = re.compile(r"[\W\d_]+")
ORDERS = (2, 3, 4)
BITS = 16
WORDS = 30  # words of a training piece
LONGEST = 1200  # characters of a piece


def subwords(text: str) -> np.ndarray:
    """Buckets of the character 2-, 3- and 4-grams of the whole text, its words set off by single spaces."""
    letters = NO_LETTERS.sub(" ", f" {text.lower()} ")
    codes = np.frombuffer(letters.encode("utf-32-le", "replace"), np.uint32)
    out, rolled = [], codes
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1:]
        if n in ORDERS and len(rolled):
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - BITS))
        if not len(rolled):
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """``table``: each bucket's embedding times the output weights; ``scale``: inverse temperature; ``least``: score to accept."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    scale: float
    least: float

    def scores(self, text: str) -> np.ndarray:
        found = subwords(text)
        logits = self.bias + (self.table[found].mean(axis=0) if len(found) else 0)
        odds = np.exp(self.scale * (logits - logits.max()))
        return odds / odds.sum()


def sample(docs: DataFrame, per_language: int, per_document: int) -> pd.DataFrame:
    """``lang, piece, check``: a bounded sample of labelled pieces.

    At most ``per_language`` documents of each language, those of the smallest hash of their id, and of each at most
    ``per_document`` pieces of ``WORDS`` words spread evenly over the whole text; words so long that a piece passes ``LONGEST``
    characters are cut into several. A fifth of the documents is for calibration.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    order = Window.partitionBy("lang").orderBy(at, "doc_id")
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    # Four times as many as needed come to a language's task, however many partitions and documents there are.
    share = F.broadcast(labelled.groupBy("lang").agg((4.0 * per_language / F.count(F.lit(1))).alias("_share")))
    drawn = labelled.select("doc_id", "lang").join(share, "lang").filter(at < F.col("_share") * float(1 << 40)).drop("_share")
    chosen = saved(drawn.withColumn("_at", F.row_number().over(order))
                   .filter(F.col("_at") <= per_language).select("doc_id").distinct(), "sample")

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for lang, text, check in zip(frame["lang"], frame["text"], frame["check"], strict=True):
                words = text.split()
                cuts = [part[i:i + LONGEST] for a in range(0, len(words), WORDS) for part in [" ".join(words[a:a + WORDS])] for i in range(0, len(part), LONGEST)]
                step = max(1, -(-len(cuts) // per_document))
                out += [(lang, piece, check) for piece in cuts[::step]]
            yield pd.DataFrame(out, columns=["lang", "piece", "check"])

    texts = small_batches(labelled).join(F.broadcast(chosen), "doc_id", "left_semi")
    return texts.select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(5)) == 0).alias("check")).mapInPandas(
        pieces, "lang string, piece string, check boolean").toPandas()


def fit(pieces: pd.DataFrame, dims: int = 16, epochs: int = 6, rate: float = 40.0, seed: int = 7, refused: float = 0.001) -> Model | None:
    """Stochastic gradient descent in numpy; temperature and rejection bound from the calibration pieces.

    ``refused``: share of rightly named calibration pieces that may fall under the bound. None if nothing is labelled.
    """
    pieces = pieces.loc[np.array([has_letter(p) for p in pieces["piece"]], bool)].sort_values(["lang", "piece"], kind="stable")
    langs = sorted(set(pieces["lang"]))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    label = {x: i for i, x in enumerate(langs)}
    rows = [(np.unique(subwords(p), return_counts=True), label[x]) for p, x in zip(pieces["piece"], pieces["lang"], strict=True)]
    rows = [(b, (c / c.sum()).astype(np.float32), y) for (b, c), y in rows]
    check = pieces["check"].to_numpy(bool)
    train = [r for r, held in zip(rows, check, strict=True) if not held] or rows
    held = [r for r, held in zip(rows, check, strict=True) if held] or rows
    embed = rng.normal(0, 0.1, (1 << BITS, dims)).astype(np.float32)
    out, bias = np.zeros((dims, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            buckets, weights, y = train[i]
            pace, done = 1 - done / steps, done + 1
            mean = weights @ embed[buckets]
            logits = mean @ out + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[y] -= 1
            back = out @ error
            out -= 0.5 * pace * np.outer(mean, error)
            bias -= 0.01 * pace * error
            embed[buckets] -= rate * pace * np.outer(weights, back)
    table = embed @ out
    logits = np.array([bias + w @ table[b] for b, w, _ in held])
    truth = np.array([y for *_, y in held])

    def confidence(scale: float) -> np.ndarray:
        odds = np.exp(scale * (logits - logits.max(axis=1, keepdims=True)))
        return odds / odds.sum(axis=1, keepdims=True)

    loss = lambda s: -np.log(confidence(s)[np.arange(len(truth)), truth] + 1e-12).mean()
    scale = min((2.0 ** (e / 4) for e in range(-12, 13)), key=loss)
    odds = confidence(scale)
    right = odds.max(axis=1)[odds.argmax(axis=1) == truth]
    return Model(langs, table, bias, scale, float(np.quantile(right, refused)) if len(right) else 0.0)


def trained(docs: DataFrame, per_language: int = 400, per_document: int = 20, **options) -> Model | None:
    """A model learnt from ``text`` and non-null ``lang`` of ``docs``; see ``sample`` for its bound."""
    return fit(sample(docs, per_language, per_document), **options)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` (clashing ones replaced) and ``lang_pred``, ``score`` and ``accepted``, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0 and not accepted; so is every text if there is no model.
    Any other gets the likeliest language, accepted if its calibrated score reaches the model's bound.
    """
    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def name(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for text in batch:
                if model is None or not has_letter(text):
                    out.append(("und", 0.0, False))
                    continue
                odds = model.scores(text)
                top = int(odds.argmax())
                out.append((model.langs[top], float(odds[top]), bool(odds[top] >= model.least)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])

    rest = small_batches(docs).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "accepted")], name(F.col("text")).alias("_named"))
    return rest.select(*[F.col(f"`{c}`") for c in rest.columns if c != "_named"], "_named.lang_pred", "_named.score", "_named.accepted")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
