"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact verification.

The embedding maps a 64-bit fingerprint to the bit counts of its 32 two-bit segments.  Two counts differ by at most the
bits that the segments differ by, so the Manhattan distance of two count vectors is a lower bound of the Hamming
distance.  A count 0, 1 or 2 is kept in unary as 00, 01 or 11 (the segment with its bits sorted), hence the Manhattan
distance is the number of differing bits of two such words, and a cell of the grid is such a word under a mask.

The segments form six blocks.  If the distance is at most 3, at most three blocks have any distance, so three others
agree: every linked pair shares at least one of the 20 cells of three blocks, and no link is lost.  Within a cell the
lower bound comes first and the exact distance second.  A cell only yields a spanning forest of its links, never all
pairs.  A cell of more than ``CELL_LIMIT`` different fingerprints is not compared pair by pair: its members meet
through the words that differ from them by at most one bit on one side and two on the other, which is exact and
linear in their number.

Equal fingerprints are grouped before anything is compared, by a partial aggregate, so a group of copies of any size
costs one row.  Fingerprints, not ids, are what links connect: an id that two different texts have links nothing.

Defined results: a null text is an empty text; texts without a word have fingerprint zero and link like any other; rows
without a doc_id get their fingerprint, link nothing, and take the component that their fingerprint has (null if only
such rows have it).  Repeated rows are returned as often as they occur.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.batches import map_batches
from tessera.llm.common import connected_components, cut_lineage, fresh, join_hubs

DISTANCE = 3
SHINGLE = 3
SEED = 42
BLOCKS = 6
CELL_LIMIT = 16_384
_LOW = 0x5555555555555555
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text, as an unsigned integer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]] if len(words) >= shingle else [0]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :] or ends[-1:], strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):  # bounded memory for very long texts
        part = np.array(hashes[at : at + _SLICE], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, tie`` of every document; fp holds the 64 bits as a signed long, tie is a hash of the text."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp, "tie": batch["tie"]})

    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _tie(text).alias("tie")), work, "doc_id long, fp long, tie long")


def _tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks() -> list[int]:
    """For every three of the six blocks, the mask of their segments."""
    bounds = [round(i * 32 / BLOCKS) for i in range(BLOCKS + 1)]
    block = [sum(3 << 2 * s for s in range(a, b)) for a, b in itertools.pairwise(bounds)]
    return [x | y | z for x, y, z in itertools.combinations(block, BLOCKS - DISTANCE)]


def embedded(fp: Column) -> Column:
    """Every two-bit segment's bit count, in unary."""
    low, down = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(down).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseOR(down).bitwiseAND(low))


def _embedded(x: np.ndarray) -> np.ndarray:
    low, down = np.uint64(_LOW), x >> np.uint64(1)
    return ((x & down & low) << np.uint64(1)) | ((x | down) & low)


def _forest(cells: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Positions (member, root) of a spanning forest of the links within each cell; equal cells are adjacent."""
    counts = _embedded(fps)
    parent = np.arange(len(fps))
    at, lag = np.flatnonzero(cells[:-1] == cells[1:]), 1
    while len(at):
        near = at[np.bitwise_count(counts[at] ^ counts[at + lag]) <= DISTANCE]  # Manhattan distance of the counts
        near = near[np.bitwise_count(fps[near] ^ fps[near + lag]) <= DISTANCE]
        fresh = near[parent[near] != parent[near + lag]]
        for i in fresh:
            a, b = int(i), int(i) + lag
            while parent[a] != a:
                a = int(parent[a])
            while parent[b] != b:
                b = int(parent[b])
            parent[max(a, b)] = min(a, b)
        if len(fresh):
            while not np.array_equal(up := parent[parent], parent):
                parent = up
        lag += 1
        at = at[at + lag < len(cells)]
        at = at[cells[at] == cells[at + lag]]
    return [(int(i), int(parent[i])) for i in np.flatnonzero(parent != np.arange(len(fps)))]


def _cell_links(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (cell, fp, node) sorted by cell to links (a, b); members of a too large cell give (node, null, fp)."""
    limit = CELL_LIMIT

    def links(part: pd.DataFrame) -> pd.DataFrame:
        node, fp = part["node"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
        found = np.array(_forest(part["cell"].to_numpy(), fp), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[found[:, 0]], "b": pd.array(node[found[:, 1]], dtype="Int64"), "fp": part["fp"].to_numpy()[found[:, 0]]})

    def apart(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": part["node"], "b": pd.array([pd.NA] * len(part), dtype="Int64"), "fp": part["fp"]})

    held, large = None, None  # the rows of the last cell, which may go on in the next batch; a cell found too large
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        cells = batch["cell"].to_numpy()
        if large is not None:
            more = cells == large
            if more.any():
                yield apart(batch[more])
                batch = batch[~more].reset_index(drop=True)
                cells = batch["cell"].to_numpy()
        if not len(batch):
            held = None
            continue
        tail = cells == cells[-1]
        if tail.sum() > limit:
            large, held = cells[-1], None
            yield apart(batch[tail])
        else:
            held = batch[tail]
        done = batch[~tail].reset_index(drop=True)
        if len(done):
            size = done.groupby("cell")["fp"].transform("size")
            if (size > limit).any():
                yield apart(done[size > limit])
                done = done[size <= limit].reset_index(drop=True)
            if len(done):
                yield links(done)
    if held is not None and len(held):
        yield links(held.reset_index(drop=True))


def _variants(fp: Column, flips: int) -> Column:
    """All words at up to that many differing bits."""
    masks = [_signed(sum(1 << b for b in bits)) for k in range(flips + 1) for bits in itertools.combinations(range(64), k)]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: fp.bitwiseXOR(m))


def _through_words(crowded: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all links between the rows (node, fp) would."""
    one = crowded.select("node", F.explode(_variants(F.col("fp"), 1)).alias("word"), F.lit(1).alias("near"))
    two = crowded.select("node", F.explode(_variants(F.col("fp"), 2)).alias("word"), F.lit(0).alias("near"))
    centre = one.groupBy("word").agg(F.min("node").alias("b"))  # all at one bit from a word link to all at two bits
    return two.unionByName(one).join(centre, "word").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between rows ``(node, fp)`` with different fingerprints that span all links of 3 bits or fewer."""
    word = embedded(F.col("fp"))
    cells = F.array(*(F.xxhash64(F.lit(t), word.bitwiseAND(F.lit(_signed(m)).cast("long"))) for t, m in enumerate(block_masks())))
    found = cut_lineage(
        nodes.select("node", "fp", F.explode(cells).alias("cell"))
        .repartition("cell")
        .sortWithinPartitions("cell", "fp")
        .mapInPandas(_cell_links, "a long, b long, fp long")
        .distinct()
    )
    light = found.filter("b is not null").select("a", "b")
    crowded = found.filter("b is null").select(F.col("a").alias("node"), "fp").distinct()
    return light if crowded.isEmpty() else light.unionByName(_through_words(crowded))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Fingerprints of the documents; ``fp, n, component, component_id, component_n`` of each; and their number."""
    prints = cut_lineage(fingerprints(docs))
    total = prints.count()
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(links(nodes.filter("least is not null").select(F.col("fp").alias("node"), "fp")))
    of = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.col("n").alias("copies"), F.coalesce("component", "fp").alias("component"))
    of = cut_lineage(of)
    names = of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return prints, join_hubs(of, names, "component", total).withColumnRenamed("copies", "n").select("fp", "n", "component", "component_id"), total


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every document ``(doc_id, text)``."""
    prints, of, total = _grouped(docs)
    return join_hubs(prints, of, "fp", total).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest doc_id stays.

    Of rows in a group with the same doc_id the text with the smallest hash stays, and of equal texts the row that sorts
    first.  Rows without a doc_id stay, as nothing tells them apart.
    """
    prints, of, total = _grouped(docs.filter("doc_id is not null"))
    kept = join_hubs(prints, of, "fp", total).groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    own, tie = fresh(docs, "_own"), fresh(docs, "_tie")
    kept = kept.select(F.col("first.doc_id").alias(own), F.col("first.tie").alias(tie))
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    sortable = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    one = (
        docs.withColumn(own, F.col("doc_id").cast("long"))
        .withColumn(tie, _tie(F.col("text").cast("string")))
        .join(kept, [own, tie], "left_semi")
        .groupBy(own, tie)
        .agg(F.min_by(F.struct(*columns), F.struct(*sortable)).alias("row"))
        .select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
    )
    return one.unionByName(docs.filter("doc_id is null"))
