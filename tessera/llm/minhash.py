"""Document fingerprints: MinHash over five-word shingles.

``PERMS`` universal hash functions ``a * x + b`` modulo 2^64 on 64-bit shingle hashes give one 64-bit minimum each.  A
fingerprint keeps the low 32 bits of every minimum, in hex: two minima that differ agree there once in 2^32, however long
the texts are.  The likeness of two fingerprints is the share of equal minima, which estimates the Jaccard similarity
of the two shingle sets.  All of it is numpy over blocks of shingles.

Near-duplicates (:func:`near_duplicates`) join signature bands in Spark and verify the exact Jaccard similarity.

Defined results: a null text is an empty text; a text of fewer than five words has one shingle of all its words, and
one without words has a fingerprint of zeros; equal texts have equal fingerprints.  Documents without a doc_id come
last in order; of repeated ids the text that sorts first comes first.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.batches import map_batches
from tessera.llm.common import bucket_of, byte_cuts, connected_components, cut_lineage, join_hubs, write_shared

PERMS = 128
SHINGLE = 5
BANDS, ROWS = 25, 5
JACCARD = 0.8
CHUNK_BYTES = 1 << 19
PAIRS = 16_384
AT_ONCE = 256  # texts or pairs of sets that are Python objects in a task
_BLOCK = 1024

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)[:, None]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the different word shingles of a whole text, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - size]] if len(words) >= size else [0]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[s : e - 1]) for s, e in zip(starts, ends[size - 1 :] or ends[-1:], strict=True)], dtype=np.uint64))


def signature(text: str | None) -> np.ndarray:
    """The minima's low 32 bits."""
    return minima(shingles(text))


def minima(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(PERMS, dtype=np.uint32)
    least = np.full(PERMS, np.iinfo(np.uint64).max, dtype=np.uint64)
    room = np.empty((PERMS, min(_BLOCK, len(hashes))), dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        mixed = np.multiply(_A, part, out=room[:, : len(part)])
        mixed += _B
        np.minimum(least, mixed.min(axis=1), out=least)
    return least.astype(np.uint32)  # the low bits


def to_hex(sign: np.ndarray) -> str:
    return sign.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """The documents in buckets of falling doc_id, each bucket followed by a copy of the document after its last one.

    Columns ``bucket, guest, doc_id, text``, one task for each bucket, sorted.  Buckets have about equal bytes and the
    text is shuffled once.  Cut points and the first id of each bucket are a few numbers per bucket; a bucket's guests
    are its neighbour's first rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = cut_lineage(rows.select(F.col("doc_id").alias("id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size")))
    cuts = byte_cuts(sized)
    bucket = bucket_of(F.col("doc_id"), cuts)
    tops = sized.groupBy(bucket_of(F.col("id"), cuts).alias("bucket")).agg(F.max("id").alias("top")).orderBy(F.desc("bucket")).collect()
    # The first document of a bucket is also needed by the bucket before it; the first of all by the last bucket.
    visits = [(tops[i]["top"], tops[i - 1]["bucket"]) for i in range(len(tops))]
    visits = spark.createDataFrame(visits, "top long, other int")
    guests = rows.join(F.broadcast(visits), F.col("doc_id").eqNullSafe(F.col("top")))
    both = rows.select(bucket.alias("bucket"), F.lit(0).alias("guest"), "doc_id", "text").unionByName(
        guests.select(F.col("other").alias("bucket"), F.lit(1).alias("guest"), "doc_id", "text")
    )
    order = ["bucket", "guest", F.col("doc_id").desc_nulls_last(), "text"]
    return both.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions(*order)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; the next document is the one with the next
    smaller doc_id, after the last one the first."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: tuple | None = None  # the row that waits for the one after it
        for batch in batches:
            out: list[tuple] = []
            for bucket, guest, doc_id, text in zip(batch["bucket"], batch["guest"], batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                own = signature(text)
                if before is not None and before[0] == bucket:
                    _, doc, old, print_ = before
                    new = edited(old, text)
                    other = signature(new)
                    out.append((doc, len(old), hashlib.sha256(new.encode()).hexdigest(), to_hex(print_), to_hex(other), likeness(print_, other), likeness(print_, own)))
                before = None if guest else (bucket, doc_id, text, own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return map_batches(
        in_order(docs), work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def near_duplicates(docs: DataFrame, threshold: float = JACCARD, chunk_bytes: int = CHUNK_BYTES, pairs_at_once: int = PAIRS) -> DataFrame:
    """``doc_id, component_id``: documents connected by pairs of a Jaccard similarity of at least the threshold.

    Pairs are found by their bands: at the threshold a pair shares one of 25 bands of 5 minima with a probability above
    0.9999, and every found pair is verified on its whole shingle sets.  Equal shingle sets are one node.

    1. Bands are joined on ids only: every node of a bucket is paired with the bucket's smallest node, and these pairs
       are verified.  A bucket of copies of any number gives as many pairs as it has nodes.
    2. In buckets whose nodes are not all connected by then, the nodes of different components are compared, in blocks
       of two chunks of about ``chunk_bytes`` of shingle sets, so a bucket is whole but never meets in one task, and a set
       is copied once for every chunk of its bucket.  A block gives links to one root per component, not pairs.
    """

    def sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "whole": [_whole(s) for s in sets], "size": [8 * len(s) for s in sets], "bands": [_bands(minima(s)) for s in sets],
            })

    def hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            own = [_whole(s) == w for s, w in zip(sets, batch["whole"], strict=True)]  # not another text with that id
            yield pd.DataFrame({"doc_id": batch["doc_id"][own], "hashes": [s.tobytes() for s, keep in zip(sets, own, strict=True) if keep]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut_lineage(map_batches(texts, sign, "doc_id long, whole string, size long, bands array<long>", AT_ONCE))
    nodes = cut_lineage(signed.groupBy("whole").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")))
    total = signed.count()

    slots = nodes.filter("node is not null").select("node", "size", F.explode("bands").alias("slot"))
    leads = slots.groupBy("slot").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    pairs = cut_lineage(join_hubs(slots.drop("size"), leads, "slot", 25 * total).filter("node <> b").select(F.col("node").alias("a"), "b").distinct())
    # The whole sets of the nodes in some pair, from their texts.
    some = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    reps = nodes.join(some, "node", "left_semi").select(F.col("node").alias("doc_id"), "whole")
    found = texts.join(reps, "doc_id").withColumn("tie", F.xxhash64("text")).dropDuplicates(["doc_id", "tie"])
    sets = write_shared(map_batches(found.select("doc_id", "text", "whole"), hashed, "doc_id long, hashes binary", AT_ONCE), "minhash-sets")
    # A node with very many pairs: its set comes once for every so many of them.
    copies = pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", "n", F.ceil(F.col("n") / pairs_at_once).cast("int").alias("of"))
    dealt = join_hubs(pairs, copies, "b", total).select("a", "b", F.pmod(F.xxhash64("a"), F.col("of")).cast("int").alias("salt"))
    second = sets.join(copies, F.col("doc_id") == F.col("b")).select("b", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("salt"), F.col("hashes").alias("other"))
    both = dealt.join(second, ["b", "salt"]).join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "b", "hashes", "other")

    def near(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), threshold) for x, y in zip(batch["hashes"], batch["other"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    edges = cut_lineage(map_batches(both, near, "a long, b long", AT_ONCE))
    parts = cut_lineage(connected_components(edges))

    placed = slots.join(parts, "node", "left").select("slot", "node", "size", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("slot").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("size")).filter("lo < hi")
    mixed = mixed.select("slot", "n", F.ceil(F.col("size") / chunk_bytes).cast("int").alias("of"))
    left = join_hubs(placed.drop("size"), mixed, "slot", 25 * total).withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    blocks = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select(
        "slot", "node", "component", "own", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q")
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, component = rows["own"].to_numpy(), rows["component"].to_numpy()
        held = [np.frombuffer(h, dtype=np.uint64) for h in rows["hashes"]]
        sizes = np.array([len(h) for h in held])
        first, second = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        names, at = np.unique(component, return_inverse=True)
        root = np.arange(len(names))  # of components, by position

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        starts = np.concatenate([[0], np.cumsum(sizes[second])])
        flat = np.concatenate([held[j] for j in second]) if len(second) else np.zeros(0, dtype=np.uint64)
        for i in first:
            roots = np.array([top(x) for x in at[second]])
            open_ = (roots != top(at[i])) & (np.minimum(sizes[i], sizes[second]) >= threshold * np.maximum(sizes[i], sizes[second])) & (sizes[i] > 0) & (sizes[second] > 0)
            if not open_.any():
                continue
            # How many of each set's hashes are among this one's: one search for all of them.
            found = np.searchsorted(held[i], flat)
            found[found == sizes[i]] = 0
            both = np.diff(np.concatenate([[0], np.cumsum(held[i][found] == flat)])[starts])
            for j in np.flatnonzero(open_ & (both >= threshold * (sizes[i] + sizes[second] - both))):
                a, b = sorted((top(at[i]), top(at[second[j]])))
                root[b] = a
        out = [(int(names[x]), int(names[top(x)])) for x in range(len(names)) if top(x) != x]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    more = blocks.join(sets.withColumnRenamed("doc_id", "node"), "node").groupBy("slot", "p", "q").applyInPandas(compare, "a long, b long")
    joins = connected_components(cut_lineage(more)).select(F.col("node").alias("component"), F.col("component").alias("whole_component"))
    parts = parts.join(joins, "component", "left").select("node", F.coalesce("whole_component", "component").alias("component"))
    lone = joins.join(parts.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole_component").alias("component"))
    of = nodes.join(parts.unionByName(lone), "node", "left").select("whole", F.coalesce("component", "node").alias("component_id"), "n")
    return join_hubs(signed.select("doc_id", "whole"), of, "whole", total).select("doc_id", "component_id")


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    short, long = sorted((len(a), len(b)))
    if not short or short < threshold * long:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (short + long - both)


def _whole(hashes: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.tobytes())


def _bands(sign: np.ndarray) -> np.ndarray:
    """A key for each band, different for bands in different places."""
    return np.array([xxhash.xxh3_64_intdigest(sign[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)], dtype=np.uint64).view(np.int64)
