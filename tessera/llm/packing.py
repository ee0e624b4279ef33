"""Packing: documents into fixed-size training sequences, shortest pack first over the length histogram.

How it runs
-----------
1. One Spark pass tokenizes every document and cuts it into pieces (:func:`pieces`): whole sequences, then the
   remainder by :func:`cut`.  Ids never leave that task; a piece carries its start, length and CRC.
2. The histogram of piece lengths (at most ``size`` rows, whatever the corpus) goes to the driver, where
   :func:`plan_packs` places lengths longest first into the pack with the most room, all packs of one pattern at a
   time.  Its output is a list of placements: *pieces of length L with ranks [lo, lo + n) go to these sequences*.
3. Pieces get a rank within their length and are joined with the placements.  A length may hold a third of all
   pieces, so ranks are made in two levels: a row number within (length, salt), plus the running count of the salts.

Defined results: a null text is an empty text, and an empty text still has the end-of-document id, so it is one piece
of one token.  Repeated rows are packed as often as they occur.  A null doc_id is kept as null.  An empty table gives
an empty result.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.batches import map_batches
from tessera.llm.bpe import JsonTokenizer
from tessera.llm.common import cut_lineage, shuffle_partitions

SIZE = 2048
END_ID = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(tokens: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of a document: whole sequences, half a sequence if the rest is longer, and the rest.

    Pieces of at most half a sequence are what keeps padding small for any histogram: a lone length just over half a
    sequence would otherwise leave the other half empty.

    >>> cut(5000)
    [2048, 2048, 904]
    >>> cut(1500)
    [1024, 476]
    """
    whole, rest = divmod(tokens, size)
    out = [size] * whole
    if rest > size // 2:
        out.append(size // 2)
        rest -= size // 2
    if rest:
        out.append(rest)
    return out


def plan_packs(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, ...]], int]:
    """Shortest-pack-first over a length histogram.

    Returns placements ``(length, rank_lo, count, sequence_lo, per_pack, offset)`` and the number of sequences: the
    piece of that length with rank ``r`` in ``[rank_lo, rank_lo + count)`` lies in sequence
    ``sequence_lo + (r - rank_lo) // per_pack`` at ``offset + (r - rank_lo) % per_pack * length``.

    A group is a run of sequences with the same pattern, so the work follows the number of lengths, not of pieces.
    """
    placements: list[tuple[int, ...]] = []
    open_packs: list[tuple[int, int, int]] = []  # (-room, first sequence, packs)
    sequences = 0

    def leave(room: int, first: int, packs: int) -> None:
        if room > 0 and packs > 0:
            heapq.heappush(open_packs, (-room, first, packs))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, first, packs = heapq.heappop(open_packs)
                room = -room
                if left < packs:
                    per, packs_used = 1, left
                    leave(room, first + left, packs - left)
                else:
                    per, packs_used = min(room // length, left // packs), packs
                    if open_packs:  # not more than makes this pack as full as the next shortest
                        per = min(per, max(1, (room + open_packs[0][0]) // length))
                at, lo = size - room, first
                leave(room - per * length, first, packs_used)
            else:
                per = min(size // length, left)
                packs_used, at, lo = left // per, 0, sequences
                sequences += packs_used
                leave(size - per * length, lo, packs_used)
            placements.append((length, rank, per * packs_used, lo, per, at))
            rank += per * packs_used
            left -= per * packs_used
    return placements, sequences


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document: ``doc_id, start, length, ids_crc32, doc_tokens``."""

    def tokenize(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = JsonTokenizer.load(tokenizer).encode_batch
        for batch in batches:
            # A few texts at a time: what is held follows the longest text, not the batch.
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows: list[tuple] = []
                for doc_id, ids in zip(part["doc_id"], encode([t or "" for t in part["text"]]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                    start = 0
                    for length in cut(len(ids), size):
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        rows.append((doc_id, start, length, crc, len(ids)))
                        start += length
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), tokenize, PIECE)


def ranked(df: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each key, without ever having one key's rows in one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    within = salted.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)))
    before = (
        salted.groupBy(key, "_salt")
        .count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy(key).orderBy("_salt")) - F.col("count"))
        .drop("count")
    )
    return within.join(before, [key, "_salt"]).withColumn("rank", F.col("_row") - 1 + F.col("_before")).drop("_salt", "_row", "_before")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Packs documents ``(doc_id, text)``: one row per piece with the sequence and offset that it lies at.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    spark: SparkSession = docs.sparkSession
    found = cut_lineage(pieces(docs, tokenizer, size, end_id))
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `size` rows
    placements, _ = plan_packs(histogram, size)
    plan = spark.createDataFrame(
        placements or [(0,) * 6], "length long, rank_lo long, n long, sequence_lo long, per_pack long, at long"
    )
    ranks = ranked(found, "length", ["doc_id", "start", "ids_crc32"], salts=max(64, shuffle_partitions(spark)))
    k = F.col("rank") - F.col("rank_lo")
    # The plan is a few thousand rows: bounded by the number of lengths, not by the corpus.
    return (
        ranks.join(F.broadcast(plan), (ranks["length"] == plan["length"]) & k.between(0, F.col("n") - 1))
        .drop(plan["length"])
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("sequence_lo") + F.floor(k / F.col("per_pack"))).cast("long").alias("sequence_id"),
            (F.col("at") + (k % F.col("per_pack")) * F.col("length")).cast("long").alias("offset"),
        )
    )
