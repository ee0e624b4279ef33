"""Toxicity: a factorization machine over hashed terms.

A text's terms are its different words and their beginnings of four to six letters, hashed into 2^18 buckets.  Learning
takes at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of their id:

1. Spark counts in how many toxic and other documents each bucket occurs; the ``TERMS`` buckets with the largest
   z-score of that difference are kept as far as it is at least ``LEAST_Z``, but no fewer than ``FEWEST``: with few
   labels hardly any difference is that certain.
2. The documents, reduced to those few buckets, train the machine: a bias, a weight for each term and ``FACTORS``
   factors for their pairwise interactions, by Adam on the logistic loss with balanced classes.

The model is a few hundred kilobytes whatever the corpus; scoring is one pass over whole texts.

Defined results: null and empty texts score as texts without any term; with no labels of both kinds everything scores
0.  Labels that are null are not learned from; a document with several labels is learned once for each.  Repeated rows
are returned as often as they occur.  A few dozen labels give a model of few terms that says little about other words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, cut_lineage, fresh

HASH_BITS = 18
TERMS = 4096
LEAST_Z = 5.0
FEWEST = 64
FACTORS = 8
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_MASK = (1 << HASH_BITS) - 1


def _hashed(word: str) -> tuple[int, ...]:
    own = zlib.crc32(word.encode("utf-8", "surrogatepass")) & _MASK
    return (own, *(zlib.crc32(f"{word[:k]}*".encode("utf-8", "surrogatepass")) & _MASK for k in (4, 5, 6) if len(word) >= k))


class Terms:
    """The hashed terms of texts, or the columns of those that a model keeps; remembers a bounded number of words."""

    def __init__(self, column: dict[int, int] | None = None, most: int = 200_000):
        self._column, self._most = column, most
        self._known: set[str] = set()
        self._found: dict[str, tuple[int, ...]] = {}  # of the known words that have any

    def _of(self, word: str) -> tuple[int, ...]:
        own = _hashed(word)
        return own if self._column is None else tuple(self._column[t] for t in own if t in self._column)

    def of(self, text: str | None) -> set[int]:
        words = set(_WORD.findall((text or "").lower()))
        new = words - self._known
        if len(self._known) + len(new) > self._most:
            self._known, self._found, new = set(), {}, words
        for word in new:
            if found := self._of(word):
                self._found[word] = found
        self._known |= new
        return set().union(*map(self._found.__getitem__, words & self._found.keys()))


class Machine:
    """A factorization machine over the kept buckets: ``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` of the terms present."""

    def __init__(self, buckets: np.ndarray):
        self.column = {int(b): i for i, b in enumerate(buckets)}
        rng = np.random.default_rng(7)
        self.w0 = np.zeros(1)
        self.w = np.zeros(len(buckets))
        self.v = rng.normal(0, 0.02, (len(buckets), FACTORS))

    def _raw(self, rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(rows, self.w[cols], n)
        v = self.v[cols]
        sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(rows, (v * v).sum(axis=1), n)
        return self.w0[0] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def fit(self, rows: np.ndarray, cols: np.ndarray, label: np.ndarray, steps: int = 200, rates: tuple[float, ...] = (0.05, 0.05, 0.005), decay: float = 2e-5) -> Machine:
        n = len(label)
        weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
        params = [self.w0, self.w, self.v]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            raw, sums = self._raw(rows, cols, n)
            slope = weight * (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - label)
            own = slope[rows]
            grad_v = np.stack([np.bincount(cols, own * (sums[rows, f] - self.v[cols, f]), len(self.w)) for f in range(FACTORS)], axis=1)
            grads = [np.array([slope.sum()]), np.bincount(cols, own, len(self.w)) + decay * self.w, grad_v + decay * self.v]
            for p, g, m, s, rate in zip(params, grads, first, second, rates, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        return self

    def score(self, columns: list[set[int]]) -> np.ndarray:
        """Of texts with these columns."""
        rows = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
        cols = np.array([c for x in columns for c in sorted(x)], dtype=np.int64)
        raw, _ = self._raw(rows, cols, len(columns))
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, use: Column, bound: int = TRAIN_ROWS, least_z: float = LEAST_Z, fewest: int = FEWEST) -> Machine | None:
    """Learns from the labelled documents in use; None without both kinds."""
    known = labels.filter(use & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = bounded_sample(known, "doc_id", bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts of the sample only, kept in the shared folder as both steps below read them.
    sample = cut_lineage(texts.join(F.broadcast(known), "doc_id").select("toxic", "text"))

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, terms = np.zeros((2, _MASK + 2), dtype=np.int64), Terms()
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                seen[toxic, np.fromiter(terms.of(text), dtype=np.int64)] += 1
                seen[toxic, -1] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pd.DataFrame({"bucket": at, "toxic": seen[1, at], "other": seen[0, at]})

    counts = sample.mapInPandas(count, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = cut_lineage(counts)
    total = counts.filter(F.col("bucket") == _MASK + 1).first()
    if total is None or not total["toxic"] or not total["other"]:
        return None
    n1, n0 = float(total["toxic"]), float(total["other"])
    share = (F.col("toxic") + F.col("other")) / (n1 + n0)
    gap = (F.col("toxic") / n1 - F.col("other") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    ranked = counts.filter((F.col("bucket") <= _MASK) & (share < 1)).select("bucket", F.abs(gap).alias("z"))
    kept = ranked.orderBy(F.desc("z"), "bucket").limit(TERMS).collect()
    buckets = np.array(sorted(r["bucket"] for i, r in enumerate(kept) if r["z"] >= least_z or i < fewest), dtype=np.int64)
    wanted = set(buckets.tolist())

    def reduced(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "terms": [sorted(terms.of(t) & wanted) for t in batch["text"]]})

    rows = sample.mapInPandas(reduced, "toxic int, terms array<long>").toPandas()  # bounded: `bound` rows of kept terms
    order = sorted(range(len(rows)), key=lambda i: (rows["toxic"].iloc[i], *rows["terms"].iloc[i]))  # sums in one order
    rows = rows.iloc[order]
    machine = Machine(buckets)
    lengths = rows["terms"].map(len).to_numpy()
    flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in rows["terms"]]) if lengths.sum() else np.zeros(0, dtype=np.int64)
    return machine.fit(np.repeat(np.arange(len(rows)), lengths), np.searchsorted(buckets, flat), rows["toxic"].to_numpy(dtype=float))


def scored(docs: DataFrame, machine: Machine | None, name: str) -> DataFrame:
    """The documents with their score in a column of that name; their own columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        terms = Terms(own.column if own else {})
        for texts in batches:
            parts = [texts.iloc[at : at + 256] for at in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate([own.score([terms.of(t) for t in p]) if own else np.zeros(len(p)) for p in parts] or [np.zeros(0)]))

    return docs.withColumn(name, of(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """``doc_id, score, predicted`` of every document."""
    found = scored(docs.select("doc_id", "text"), train(docs, labels, use), "score")
    return found.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """The documents that score below the threshold."""
    name = fresh(docs, "_toxicity")
    return scored(docs, train(docs, labels, use), name).filter(F.col(name) < THRESHOLD).drop(name)
