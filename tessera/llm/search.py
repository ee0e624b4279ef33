"""Ranked lexical search: documents in the order of recursive graph bisection, searched by clusters with exact stopping.

Index (:func:`build`)
    1. Every text becomes a bag of 64-bit term hashes with their occurrences, in the task that reads it.
    2. The upper levels of the bisection are a tree that is fitted to a bounded sample (``SAMPLE_DOCS`` documents of at most
       ``SKETCH`` terms each); every document goes down the tree by its own terms.  Leaves are salted by their share, so a
       leaf with a third of the corpus goes to as many tasks as its rows are worth.
    3. Each task cuts its documents, sorted by leaf, into slabs of bounded size, and bisects a slab down to shards of at
       most ``SHARD_DOCS`` neighbours (:func:`bisect`).  A shard is one row: its documents, a dictionary of terms with the
       largest occurrence and the shortest document of each, and its postings.

Search (:func:`top`)
    4. The corpus statistics are sums over the shards' dictionaries.  With them a shard's dictionary bounds the score that an
       item can have there.
    5. The ``SEEDS`` shards with the largest bounds are scored first; their 20th score is where an item's threshold starts.
    6. Every task visits its shards from the largest bound down, for each item, and stops at the first bound below the
       threshold, which rises with what it finds.  A bound that equals the threshold is still visited, as a smaller doc_id
       may be there.  So no document that belongs to the result is missed, and a task returns at most 20 for an item.

Items are searched by their different texts, in blocks of about ``BLOCK_BYTES``, so what goes to the tasks has a bound
whatever the number of items.  Terms are told apart by 64 bits: of 10^10 different terms one has the hash of one of 3,000
query terms with a probability of 2 in a million.

Defined results: a null or empty text has no term; such documents are in the index, and count and score nothing, and such
items have no result.  Rows with the same doc_id are documents of their own and may both be ranked.  A row without a
doc_id comes after all others of the same score.  Repeated items get their result as often as they occur.  Other columns
are not looked at.  Empty tables give an empty result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, write_shared

TOP = 20
SAMPLE_DOCS = 4096
SKETCH = 512
VOCABULARY = 32_768
TREE_LEVELS = 6
SLAB_DOCS = 4096
SLAB_TERMS = 1 << 19
SHARD_DOCS = 128
SEEDS = 4
BLOCK_BYTES = 1 << 20
_PIECE = 1 << 20
_SEPARATE = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(0x80)) + bytes(range(0x80, 0x100))

INDEX = "shard long, n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms binary, starts binary, max_tf binary, min_n binary, docs binary, tfs binary"


# -- terms -------------------------------------------------------------------------------------------------------------


def count_terms(text: bytes | None) -> Counter[bytes]:
    """The terms of a whole text in UTF-8: runs of ASCII letters, digits and signs beyond ASCII, A-Z in lower case."""
    found: Counter[bytes] = Counter()
    data = (text or b"").translate(_SEPARATE)
    at = 0
    while at < len(data):  # bounded memory for very long texts
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def bag(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different terms, rising, and their occurrences."""
    found = count_terms(text)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    order = np.argsort(hashes)
    return hashes[order], np.fromiter(found.values(), dtype=np.uint32, count=len(found))[order]


# -- recursive graph bisection -----------------------------------------------------------------------------------------


def bisect(doc: np.ndarray, term: np.ndarray, n: int, levels: int, rounds: int = 8) -> list[np.ndarray]:
    """Orders of ``n`` documents after each level, from edges (doc, term); the first is the order that is given.

    After level ``l`` the order has ``2^l`` blocks of equal length (:func:`bounds`).  Each is parted in two halves, and
    pairs of documents are exchanged as long as that lowers the sum over terms of ``d log2(m / (d + 1))``, the bits of the
    gaps of a term with d documents in a half of m (Dhulipala et al., "Compressing Graphs and Indexes with Recursive
    Graph Bisection").  All blocks of a level are treated at once.
    """
    orders = [np.arange(n)]
    log2 = np.log2(np.arange(1, n + 3, dtype=np.float64))  # log2[d] is of d + 1
    of_terms = int(term.max()) + 1 if len(term) else 1
    for level in range(levels):
        order, edge = orders[-1], bounds(n, level)
        sizes = np.diff(edge)
        block = np.empty(n, dtype=np.int64)
        block[order] = np.repeat(np.arange(len(sizes)), sizes)
        middle = bounds(n, level + 1)[1::2]
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        side = place >= middle[block]
        left_n, right_n = middle - edge[:-1], edge[1:] - middle
        _, key, count = np.unique(block[doc] * of_terms + term, return_inverse=True, return_counts=True)
        use = count[key] > 1  # a term of one document of a block has no say
        known = np.flatnonzero(count > 1)
        number = np.zeros(len(count), dtype=np.int64)
        number[known] = np.arange(len(known))
        e_doc, e_key, degree = doc[use], number[key[use]], count[known].astype(np.int64)
        where = np.zeros(len(known), dtype=np.int64)
        where[e_key] = block[e_doc]
        log_l, log_r = np.log2(np.maximum(left_n, 1))[where], np.log2(np.maximum(right_n, 1))[where]

        def cost(d: np.ndarray, log_n: np.ndarray) -> np.ndarray:
            return d * (log_n - log2[np.maximum(d, 0)])

        pairs = np.minimum(left_n, right_n)
        start = np.concatenate([[0], np.cumsum(pairs)])[:-1]
        within = np.arange(pairs.sum()) - np.repeat(start, pairs)
        first, second = np.repeat(edge[:-1], pairs) + within, np.repeat(middle, pairs) + within
        for _ in range(rounds if len(known) else 0):
            right = np.bincount(e_key, weights=side[e_doc], minlength=len(known)).astype(np.int64)
            left = degree - right
            now = cost(left, log_l) + cost(right, log_r)
            to_right = now - cost(left - 1, log_l) - cost(right + 1, log_r)
            to_left = now - cost(left + 1, log_l) - cost(right - 1, log_r)
            gain = np.bincount(e_doc, weights=np.where(side[e_doc], to_left[e_key], to_right[e_key]), minlength=n)
            ranked = np.lexsort((-gain, side, block))  # in each block the left half, then the right, best first
            a, b = ranked[first], ranked[second]
            swap = gain[a] + gain[b] > 1e-9
            side[a[swap]], side[b[swap]] = True, False
            if swap.sum() * 200 < n:
                break
        orders.append(np.lexsort((place, side, block)))
    return orders


def bounds(n: int, level: int) -> np.ndarray:
    """Where the blocks of a level begin, and the end."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def _levels(n: int, most: int) -> int:
    """Halvings until no block has more documents than that."""
    return max(0, math.ceil(math.log2(n / most))) if n else 0


# -- index -------------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """The upper levels: of every node, what each term of the vocabulary says for its left half."""

    levels: int
    vocabulary: np.ndarray
    says: np.ndarray  # terms x nodes, in the order of a heap from 0
    share: np.ndarray  # of the sample, by leaf

    def leaf(self, hashes: np.ndarray) -> int:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        score = self.says[at[self.vocabulary[at] == hashes]].sum(axis=0)
        node = 0
        for _ in range(self.levels):
            node = 2 * node + (1 if score[node] >= 0 else 2)
        return node - ((1 << self.levels) - 1)


def fit_tree(sample: list[np.ndarray], levels: int) -> Tree:
    """The tree from sketches (rising hashes) of the sampled documents."""
    n = len(sample)
    sample = sorted(sample, key=lambda s: (s[:1].tolist(), len(s)))
    doc = np.repeat(np.arange(n), [len(s) for s in sample])
    vocabulary, term, count = np.unique(np.concatenate([*sample, np.zeros(0, dtype=np.uint64)]), return_inverse=True, return_counts=True)
    keep = np.sort(np.argsort(-count, kind="stable")[:VOCABULARY])
    number = np.full(len(vocabulary), -1)
    number[keep] = np.arange(len(keep))
    doc, term, vocabulary = doc[number[term] >= 0], number[term][number[term] >= 0], vocabulary[keep]
    says = np.zeros((max(1, len(vocabulary)), (1 << levels) - 1), dtype=np.float32)
    for level, order in enumerate(bisect(doc, term, n, levels)[1:]):
        half = np.empty(n, dtype=np.int64)
        half[order] = np.repeat(np.arange(2 << level), np.diff(bounds(n, level + 1)))
        degrees = np.bincount(half[doc] * len(vocabulary) + term, minlength=(2 << level) * len(vocabulary)).reshape(2 << level, -1)
        rates = np.log2((degrees + 1) / (np.diff(bounds(n, level + 1))[:, None] + 2))
        says[: len(vocabulary), (1 << level) - 1 : (2 << level) - 1] = (rates[::2] - rates[1::2]).T
    if not len(vocabulary):
        vocabulary = np.zeros(1, dtype=np.uint64)
    tree = Tree(levels, vocabulary, says, np.zeros(1 << levels))
    tree.share = np.bincount([tree.leaf(s) for s in sample], minlength=1 << levels) / max(1, n)
    return tree


def _sketches(rows: DataFrame) -> DataFrame:
    """``doc_id, sketch`` of rows ``(doc_id, text binary)``: the ``SKETCH`` smallest hashes of terms."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bag(t.as_py())[0][:SKETCH].tobytes() for t in batch.column("text")], pa.binary())], ["doc_id", "sketch"])

    return rows.mapInArrow(work, "doc_id long, sketch binary")


def _tree(rows: DataFrame, slab_docs: int) -> Tree:
    total = rows.count()
    levels = min(TREE_LEVELS, _levels(total, slab_docs))
    if not levels:
        return fit_tree([], 0)
    few = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= math.ceil(min(1.0, 2 * SAMPLE_DOCS / total) * (1 << 30)))
    few = _sketches(few).orderBy(F.xxhash64("doc_id", "sketch")).limit(SAMPLE_DOCS)
    return fit_tree([np.frombuffer(r["sketch"], dtype=np.uint64) for r in few.collect()], levels)


def build(docs: DataFrame, slab_docs: int = SLAB_DOCS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of documents ``(doc_id, text)``, written to the shared folder: one row per shard, see ``INDEX``.

    A shard has at most ``shard_docs`` documents, 256 at most; a task holds ``slab_docs`` at once, or ``SLAB_TERMS`` terms.
    """
    if not 1 <= shard_docs <= 256:
        raise ValueError(f"shards of {shard_docs} documents")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    model = _tree(rows, slab_docs)
    shared, n = spark.sparkContext.broadcast(model), shuffle_partitions(spark)
    # About eight keys for each task; a leaf that the sample did not show has its share of them too.
    salts = np.ceil(8 * n * np.maximum(model.share, 1 / len(model.share))).astype(int).tolist()

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            found = [bag(t.as_py()) for t in batch.column("text")]
            leaves = [tree.leaf(h) if tree.levels else 0 for h, _ in found]
            columns = [pa.array(leaves, pa.int32()), pa.array([salts[x] for x in leaves], pa.int32()), batch.column("doc_id"), pa.array([int(t.sum(dtype=np.int64)) for _, t in found], pa.int64())]
            columns += [pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([t.tobytes() for _, t in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["leaf", "salts", "doc_id", "n", "hashes", "tfs"])

    at_leaf = rows.mapInArrow(placed, "leaf int, salts int, doc_id long, n long, hashes binary, tfs binary")
    salted = at_leaf.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n", F.substring("hashes", 1, 8)), F.col("salts")).cast("int"))
    dealt = salted.repartition(n, "leaf", "salt").sortWithinPartitions("leaf", "salt").select("doc_id", "n", "hashes", "tfs")
    return write_shared(dealt.mapInArrow(lambda batches: _slabs(batches, slab_docs, shard_docs), INDEX), "search-index")


def _slabs(batches: Iterable[pa.RecordBatch], slab_docs: int, shard_docs: int) -> Iterator[pa.RecordBatch]:
    """Documents as they come, in slabs of bounded size, to shards."""
    task, made = TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for doc_id, n, h, t in zip(*(batch.column(c) for c in ("doc_id", "n", "hashes", "tfs")), strict=True):
            held.append((doc_id.as_py(), n.as_py(), np.frombuffer(h.as_py(), dtype=np.uint64), np.frombuffer(t.as_py(), dtype=np.uint32)))
            size += len(held[-1][2])
            if len(held) >= slab_docs or size >= SLAB_TERMS:
                for shard in shards(held, shard_docs):
                    yield _row((task << 32) + made, shard)
                    made += 1
                held, size = [], 0
    for shard in shards(held, shard_docs):
        yield _row((task << 32) + made, shard)
        made += 1


def shards(held: list[tuple[int | None, int, np.ndarray, np.ndarray]], shard_docs: int = SHARD_DOCS) -> Iterator[dict]:
    """The shards of a slab, in the order of its bisection."""
    if not held:
        return
    held = sorted(held, key=lambda d: (d[2][:1].tolist(), d[1], d[0] is None, d[0] or 0))
    n = len(held)
    lengths = np.array([d[1] for d in held], dtype=np.int64)
    doc = np.repeat(np.arange(n), [len(d[2]) for d in held])
    hashes, term = np.unique(np.concatenate([d[2] for d in held]), return_inverse=True)
    tf = np.concatenate([d[3] for d in held])
    levels = _levels(n, shard_docs)
    order, edge = bisect(doc, term, n, levels)[-1], bounds(n, levels)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    shard = np.searchsorted(edge, place, side="right") - 1
    by = np.lexsort((place[doc], term, shard[doc]))
    doc, term, tf = doc[by], term[by], tf[by]
    cut = np.searchsorted(shard[doc], np.arange(len(edge)))
    for s in range(len(edge) - 1):
        at = slice(cut[s], cut[s + 1])
        d, own, f = doc[at], term[at], tf[at]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
        here = order[edge[s] : edge[s + 1]]
        yield {
            "n_docs": int((lengths[here] > 0).sum()), "n_terms": int(lengths[here].sum()), "doc_ids": [held[i][0] for i in here], "lengths": lengths[here].tobytes(),
            "terms": hashes[own[starts]].tobytes(), "starts": np.append(starts, len(own)).astype(np.uint32).tobytes(),
            "max_tf": (np.maximum.reduceat(f, starts) if len(own) else f).tobytes(), "min_n": (np.minimum.reduceat(lengths[d], starts) if len(own) else lengths[:0]).tobytes(),
            "docs": (place[d] - edge[s]).astype(np.uint8).tobytes(), "tfs": f.tobytes(),
        }


def _row(number: int, shard: dict) -> pa.RecordBatch:
    kinds = {"doc_ids": pa.list_(pa.int64()), "n_docs": pa.int64(), "n_terms": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([v], kinds.get(k, pa.binary())) for k, v in shard.items())], ["shard", *shard])


# -- search ------------------------------------------------------------------------------------------------------------


@dataclass
class Items:
    """A block of items: the terms of all of them, and of each item its terms' places and repeats."""

    texts: list[str]
    terms: np.ndarray
    at: np.ndarray
    repeats: np.ndarray
    first: np.ndarray
    weights: np.ndarray
    n_docs: int = 0
    n_terms: int = 0

    def slots(self, item: int) -> slice:
        return slice(self.first[item], self.first[item + 1] if item + 1 < len(self.first) else len(self.at))

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 75 + 25 * n * self.n_docs // self.n_terms
        tf = tf.astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def places(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms a shard has, and where they are in its dictionary."""
        own = np.frombuffer(row["terms"], dtype=np.uint64)
        if not len(own):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.searchsorted(own, self.terms)
        at[at == len(own)] = 0
        there = np.flatnonzero(own[at] == self.terms)
        return there, at[there]

    def bounds(self, row: dict) -> np.ndarray:
        """What each item can score in a shard at most."""
        there, at = self.places(row)
        most = np.zeros(len(self.terms), dtype=np.int64)
        most[there] = self.weights[there] * self.impact(np.frombuffer(row["max_tf"], dtype=np.uint32)[at], np.frombuffer(row["min_n"], dtype=np.int64)[at])
        return np.add.reduceat(most[self.at] * self.repeats, self.first)


def items_of(texts: list[str]) -> Items:
    """A block of the texts that have a term."""
    bags = [(t, count_terms(t.encode("utf-8", "surrogatepass"))) for t in texts]
    bags = [(t, b) for t, b in bags if b]
    hashes = [np.fromiter(map(xxhash.xxh3_64_intdigest, b), dtype=np.uint64, count=len(b)) for _, b in bags]
    terms, at = np.unique(np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
    repeats = np.array([r for _, b in bags for r in b.values()], dtype=np.int64)
    first = np.cumsum([0, *(len(h) for h in hashes)])[:-1]
    return Items([t for t, _ in bags], terms, at, repeats, first, np.zeros(len(terms), dtype=np.int64))


class Postings:
    """A shard's postings of the items' terms, each with what it adds to a score."""

    def __init__(self, items: Items, row: dict):
        there, at = items.places(row)
        starts = np.frombuffer(row["starts"], dtype=np.uint32).astype(np.int64)
        docs, tfs = np.frombuffer(row["docs"], dtype=np.uint8), np.frombuffer(row["tfs"], dtype=np.uint32)
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        counts = starts[at + 1] - starts[at]
        pick = _ranges(starts[at], counts)
        self.docs = docs[pick].astype(np.int64)
        self.adds = np.repeat(items.weights[there], counts) * items.impact(tfs[pick], self.lengths[self.docs])
        self.start, self.count = np.zeros(len(items.terms), dtype=np.int64), np.zeros(len(items.terms), dtype=np.int64)
        self.start[there], self.count[there] = np.cumsum(counts) - counts, counts

    def scores(self, items: Items, item: int) -> np.ndarray:
        at = items.slots(item)
        terms, repeats = items.at[at], items.repeats[at]
        counts = self.count[terms]
        pick = _ranges(self.start[terms], counts)
        out = np.zeros(len(self.lengths), dtype=np.int64)
        np.add.at(out, self.docs[pick], self.adds[pick] * np.repeat(repeats, counts))
        return out


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


class Best:
    """The best documents of each item so far, and the score that a document needs to be one of them."""

    def __init__(self, need: np.ndarray, k: int):
        self.need, self.k = need.copy(), k
        self.found: list[list[tuple[int, bool, int, int | None]]] = [[] for _ in need]

    def visit(self, items: Items, item: int, postings: Postings, doc_ids: list) -> None:
        scores = postings.scores(items, item)
        good = np.flatnonzero(scores >= self.need[item])
        if not len(good):
            return
        own = self.found[item]
        own += [(-int(scores[i]), doc_ids[i] is None, doc_ids[i] or 0, doc_ids[i]) for i in good]
        if len(own) >= self.k:
            own.sort(key=lambda x: x[:3])
            del own[self.k :]
            self.need[item] = max(self.need[item], -own[-1][0])

    def rows(self) -> pa.RecordBatch:
        flat = [(i, x[3], -x[0]) for i, own in enumerate(self.found) for x in own]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])


def _dicts(batch: pa.RecordBatch) -> list[dict]:
    return [{c: batch.column(c)[i] for c in batch.schema.names} for i in range(batch.num_rows)]


def _opened(row: dict, *columns: str) -> dict:
    """The row's columns as Python values; binary ones without a copy."""
    return {c: row[c].as_buffer() if pa.types.is_binary(row[c].type) else row[c].as_py() for c in columns or row}


def top(index: DataFrame, items: DataFrame, k: int = TOP, seeds: int = SEEDS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item ``(item_id, text)``."""
    spark = index.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    texts = asked.select("text").distinct().withColumn("size", F.octet_length("text"))
    blocks = -(-(texts.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks if n_terms else 0):
        block = items_of(sorted(r["text"] for r in texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()))
        if not block.texts:
            continue
        block.n_docs, block.n_terms = n_docs, n_terms
        found = _search(index, block, k, seeds)
        names = F.broadcast(spark.createDataFrame(list(enumerate(block.texts)), "item long, text string"))
        of = asked.join(names, "text").select("item_id", "item")
        out = out.unionByName(found.join(of, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def _search(index: DataFrame, block: Items, k: int, seeds: int) -> DataFrame:
    """``item, rank, doc_id, score`` of a block of items."""
    spark = index.sparkSession

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block.terms), dtype=np.int64)
        for batch in batches:
            for row in map(_opened, _dicts(batch)):
                there, at = block.places(row)
                df[there] += np.diff(np.frombuffer(row["starts"], dtype=np.uint32).astype(np.int64))[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    df = np.zeros(len(block.terms), dtype=np.int64)
    for r in index.select("terms", "starts").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    block.weights = np.array([math.floor(1000 * math.log((2 * block.n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    shared = spark.sparkContext.broadcast(block)

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        most, where = np.zeros((seeds, len(own.texts)), dtype=np.int64), np.zeros((seeds, len(own.texts)), dtype=np.int64)
        for batch in batches:
            rows = [_opened(r) for r in _dicts(batch)]
            if not rows:
                continue
            most = np.vstack([most, *(own.bounds(r) for r in rows)])
            where = np.vstack([where, *(np.full(len(own.texts), r["shard"]) for r in rows)])
            best = np.argsort(-most, axis=0, kind="stable")[:seeds]
            most, where = np.take_along_axis(most, best, axis=0), np.take_along_axis(where, best, axis=0)
        _, item = np.nonzero(most > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(where[most > 0]), pa.array(most[most > 0])], ["item", "shard", "bound"])

    best_first = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    likely = index.select("shard", "terms", "max_tf", "min_n").mapInArrow(bounded, "item long, shard long, bound long")
    visits: dict[int, list[int]] = {}
    for r in likely.withColumn("r", F.row_number().over(best_first)).filter(F.col("r") <= seeds).collect():
        visits.setdefault(r["shard"], []).append(r["item"])

    def seeded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(np.ones(len(own.texts), dtype=np.int64), k)
        for batch in batches:
            for row in map(_opened, _dicts(batch)):
                postings = Postings(own, row)
                for item in visits[row["shard"]]:
                    best.visit(own, item, postings, row["doc_ids"])
        yield best.rows()

    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = index.filter(F.col("shard").isin(list(visits))).mapInArrow(seeded, "item long, doc_id long, score long")
    need = np.ones(len(block.texts), dtype=np.int64)
    for r in first.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).collect():
        need[r["item"]] = r["score"]

    def visited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(need, k)
        for batch in batches:
            rows = _dicts(batch)
            if not rows:
                continue
            most = np.vstack([own.bounds(_opened(r, "terms", "max_tf", "min_n")) for r in rows])
            opened = functools.cache(lambda i, rows=rows: (Postings(own, row := _opened(rows[i])), row["doc_ids"]))
            for item, order in enumerate(np.argsort(-most, axis=0, kind="stable").T):
                for i in order:
                    if most[i, item] < best.need[item]:
                        break  # nor can any other shard have a document that belongs to the result
                    best.visit(own, item, *opened(int(i)))
        yield best.rows()

    found = index.mapInArrow(visited, "item long, doc_id long, score long")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")
