"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of letters per language in Spark (partial sums per task, then one row per language
and bucket), from at most ``TRAIN_ROWS`` labelled documents chosen by a hash of their id.  The matrix of log
probabilities, languages x 65,536 buckets, is broadcast: its size depends on the languages only.  Scoring looks up all
n-grams of many texts at once in numpy.

Defined results: ``und`` with score 0 for a null text, a text without any letter, and if nothing could be learned.
Only the text is scored.  Repeated rows are returned as often as they occur; ties go to the language that sorts first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, fresh

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
TRAIN_ROWS = 20_000
_SLICE = 1 << 19
_PRIMES = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)  # odd multipliers of the rolling hash


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (position's text, bucket) of all n-grams; what holds no letter has bucket ``BUCKETS``."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    reach = len(_PRIMES)
    for at in range(0, len(points), _SLICE):
        part = np.append(points[at : at + _SLICE + reach - 1], np.zeros(reach - 1, dtype=np.uint32))
        n = min(_SLICE, len(points) - at)
        letter = _letters()[part]
        code = np.where(letter, part, np.where(part == 0, 0, 32)).astype(np.uint32)  # all that is no letter is a gap
        for order in ORDERS:
            h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            some, whole = np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
            for k in range(order):
                h = (h ^ code[k : k + n]) * _PRIMES[k]
                h ^= h >> np.uint32(15)
                some |= letter[k : k + n]
                whole &= code[k : k + n] != 0
            yield owner[at : at + n], np.where(some & whole, h & np.uint32(BUCKETS - 1), BUCKETS).astype(np.int64)


def _grouped(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about that many code points in all, with the first one's position."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


class Model:
    """Languages in order, and the matrix of log probabilities with a last row of zeros."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.table = np.vstack([np.log(smooth / smooth.sum(axis=0)), np.zeros((1, len(languages)))])
        self.prior = np.log(documents / documents.sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        totals, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for start, part in _grouped([t or "" for t in texts]):
            for owner, bucket in ngrams(part):
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                who = start + owner[first]
                totals[who] += np.add.reduceat(self.table[bucket], first, axis=0)
                seen[who] += np.add.reduceat((bucket < BUCKETS).astype(np.int64), first)
        totals += self.prior
        best = totals.argmax(axis=1)
        score = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        none = seen == 0
        names = [("und" if none[i] else self.languages[b]) for i, b in enumerate(best)]
        return names, np.where(none, 0.0, score)


def train(docs: DataFrame, use: Column, bound: int = TRAIN_ROWS) -> Model:
    """Learns from text and lang of the rows in use, at most about ``bound`` of them."""
    known = docs.filter(use & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                own = sums.setdefault(lang, np.zeros(BUCKETS + 2, dtype=np.int64))
                own[-1] += len(texts)
                for _, part in _grouped([t or "" for t in texts]):
                    for _, bucket in ngrams(part):
                        own[: BUCKETS + 1] += np.bincount(bucket, minlength=BUCKETS + 1)
        for lang, own in sums.items():
            own[BUCKETS] = 0
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    sums = bounded_sample(known, "doc_id", bound).mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # at most languages x buckets
    languages = sorted(found["lang"].unique())
    table = np.zeros((BUCKETS + 2, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    table[found["bucket"].to_numpy(), found["lang"].map(column).to_numpy(dtype=int)] = found["n"].to_numpy()
    return Model(languages, table[:BUCKETS], table[BUCKETS + 1])


def predict(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """The documents with a struct of that name, ``lang_pred string`` and ``score double``; their own columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(text: pd.Series) -> pd.DataFrame:
        names, score = shared.value.predict(list(text))
        return pd.DataFrame({"lang_pred": names, "score": score})

    return docs.withColumn(name, scored(F.col("text").cast("string")))


def identify(docs: DataFrame, use: Column) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, learned from the rows in use."""
    return predict(docs.select("doc_id", "text"), train(docs, use), "found").select("doc_id", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, use: Column, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least that score; ``und`` goes."""
    name = fresh(docs, "_lang")
    found = predict(docs, train(docs, use), name)
    return found.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).drop(name)
