"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one kept per group.

Equal vectors of a label are one node with a count before anything is compared, so a group of copies of any size costs one
row, and rows without an id connect what they are linked to.

Cells.  Spherical k-means has two levels.  For every label with more than ``CELL_ROWS`` nodes a coarse model is fitted to a
bounded sample, and then one fine model for each coarse cell, all of them in parallel; a smaller label is one cell.  There
are at most ``MAX_CELLS`` centroids of ``CENTROID_BYTES`` in all, so their table has a fixed bound and is broadcast.  Cells
have about ``CELL_ROWS`` nodes up to 33 million vectors of 64 components; from there they grow, and with them the copies of a
row, one for each chunk.

No link is lost between cells.  A vector's home is the cell of its most similar centroid.  If x and y are linked they
are at most ``r = sqrt(2 - 2 * threshold)`` apart, and if their homes differ the plane midway between the two
centroids separates them, so one of them is within r/2 of that plane.  Every vector within r/2 of the plane to
another cell is a guest there too: each linked pair then shares a cell in which one is at home and the other at home
or a guest.  A guest farther from the centroid than the farthest vector at home there plus r has no link there and is
left out.  A pair that meets in both homes counts in the smaller cell only.

Blocks.  A cell of many vectors is dealt out in chunks of about ``CHUNK`` rows, and every pair of chunks is a block of
its own, so no task holds a whole cell.  A block returns, per vector, how many vectors it is linked to and the smallest
node it is connected to there: never the pairs.

Defined results: a vector links with nothing if it is null, zero or has a null or non-finite component, or if its
label is null; vectors of different lengths do not link.  Every row is a vector of its own: one with a repeated vec_id is
one more vector, and both have their own links.  Rows without a vec_id count as links of others and connect them; they take
the smallest id of their component (null if it has none) and are not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut_lineage, join_hubs

THRESHOLD = 0.98
CELL_ROWS = 512
MAX_CELLS = 65_536
CENTROID_BYTES = 32 << 20
SAMPLE_ROWS = 65_536
CHUNK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; starts from evenly spaced rows of the given order."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        step = max(64, min(4096, (1 << 24) // k))
        home = np.concatenate([(x[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(x), step)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, x) of every row: its unit vector as the bytes of its doubles, null if it cannot link."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, label = (batch.column(c) for c in ("vec_id", "embedding", "label"))
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are nan
            starts = np.concatenate([[0], np.cumsum(np.where(there, np.diff(lists.offsets.to_numpy()), 0))])
            dims = np.where(label.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
            out: list[bytes | None] = [None] * len(dims)
            for dim in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == dim)
                x = flat[starts[at][:, None] + np.arange(dim)]
                with np.errstate(invalid="ignore"):
                    largest = np.abs(x).max(axis=1)
                good = np.isfinite(x).all(axis=1) & (largest > 0)
                x = x[good] / largest[good][:, None]  # so that squares neither overflow nor vanish
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                for i, row in zip(at[good], x, strict=True):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "x"])

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return rows.mapInArrow(work, "vec_id long, label long, dim int, x binary")


def _rows(x: pd.Series | list) -> np.ndarray:
    """Vectors of one length, one in each row."""
    return np.frombuffer(b"".join(x), dtype=np.float64).reshape(len(x), -1)


Group = tuple[int, int]  # a label and a length


def fit_cells(nodes: DataFrame, cell_rows: int = CELL_ROWS) -> list[tuple[int, int, np.ndarray]]:
    """(label, dim, centroids) of the labels that are split."""
    sizes = {(r["label"], r["dim"]): r["count"] for r in nodes.groupBy("label", "dim").count().filter(F.col("count") > cell_rows).orderBy(F.desc("count"), "label", "dim").limit(MAX_CELLS // 2).collect()}
    most = min(MAX_CELLS, CENTROID_BYTES // (8 * max((dim for _, dim in sizes), default=1)))
    sizes = dict(list(sizes.items())[: most // 2])  # largest first
    if not sizes:
        return []
    total = sum(sizes.values())
    cells = {g: max(2, min(math.ceil(n / cell_rows), most * n // total)) for g, n in sizes.items()}
    coarse = {g: math.isqrt(k) for g, k in cells.items()}
    spark = nodes.sparkSession
    spread = F.pmod(F.xxhash64("label", "x"), F.lit(1 << 30))

    def sample(rows: int) -> DataFrame:
        """The labels' nodes with the numbers of their cells, about as many as that, by a hash of the vector."""
        want = spark.createDataFrame([(*g, coarse[g], cells[g]) for g in sizes], "label long, dim int, coarse int, fine int")
        return nodes.join(F.broadcast(want), ["label", "dim"]).filter(spread <= min(1.0, rows / total) * (1 << 30)).select("label", "dim", "coarse", "fine", "x")

    def fit_coarse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _rows(sorted(rows["x"]))
        return pd.DataFrame({"label": key[0], "dim": key[1], "c": list(kmeans(x, min(int(key[2]), len(x))))})

    def fit_fine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _rows(sorted(rows["x"]))
        k = math.ceil(key[2] * len(x) / rows["of"].iloc[0])  # its share of the label's cells
        return pd.DataFrame({"label": key[0], "dim": key[1], "c": list(kmeans(x, min(k, len(x))))})

    split = max(SAMPLE_ROWS, 64 * sum(coarse.values()))
    first = _by_group(sample(split).groupBy("label", "dim", "coarse").applyInPandas(fit_coarse, "label long, dim int, c array<double>").collect())
    shared = spark.sparkContext.broadcast(first)

    def placed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), dtype=np.int32)
            for g, at in batch.groupby(["label", "dim"]).indices.items():
                if g in shared.value:
                    cell[at] = (_rows(batch["x"].to_numpy()[at]) @ shared.value[g].T).argmax(axis=1)
            yield batch.assign(cell=cell)[["label", "dim", "fine", "cell", "x"]]

    # The fine models of all coarse cells at once; a coarse cell has a bounded part of the sample.
    dealt = cut_lineage(sample(max(SAMPLE_ROWS, 4 * sum(cells.values()))).mapInPandas(placed, "label long, dim int, fine int, cell int, x binary"))
    whole = dealt.groupBy("label", "dim").agg(F.count("*").alias("of"))
    fine = dealt.join(F.broadcast(whole), ["label", "dim"]).groupBy("label", "dim", "fine", "cell").applyInPandas(fit_fine, "label long, dim int, c array<double>")
    return [(label, dim, c[:most]) for (label, dim), c in sorted(_by_group(fine.collect()).items())]


def _by_group(rows: list) -> dict[Group, np.ndarray]:
    out: dict[Group, list] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["dim"], r["c"])):
        out.setdefault((r["label"], r["dim"]), []).append(r["c"])
    return {g: np.array(c) for g, c in out.items()}


def _placed(nodes: DataFrame, centroids: list[tuple[int, int, np.ndarray]], reach: float) -> DataFrame:
    """(node, n, label, dim, x, cells, apart): the cells of each vector, home first, and how far their centroids are."""
    shared = nodes.sparkSession.sparkContext.broadcast({(label, dim): c for label, dim, c in centroids})

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        planes = {g: np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) for g, c in own.items() if len(c) <= 512}
        for batch in batches:
            cells: list[list[int]] = [[0]] * len(batch)
            far: list[list[float]] = [[0.0]] * len(batch)
            for g, at in batch.groupby(["label", "dim"]).indices.items():
                if g not in own:
                    continue
                c = own[g]
                for part in np.array_split(at, max(1, len(at) * len(c) >> 22)):
                    sims = _rows(batch["x"].to_numpy()[part]) @ c.T
                    home = sims.argmax(axis=1)
                    apart = planes[g][home] if g in planes else np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 0))
                    # The distance to the plane midway between home and the other centroid.
                    near = sims[np.arange(len(part)), home][:, None] - sims <= (reach / 2 + 1e-9) * apart + 1e-9  # centroids may coincide up to rounding
                    near[np.arange(len(part)), home] = False
                    for i, h, row, s in zip(part, home, near, sims, strict=True):
                        cells[i] = [int(h), *np.flatnonzero(row).tolist()]
                        far[i] = np.sqrt(np.maximum(2 - 2 * s[cells[i]], 0)).tolist()
            yield batch.assign(cells=cells, far=far)

    return nodes.mapInPandas(place, "node long, n long, label long, dim int, x binary, cells array<int>, far array<double>")


def _at_cells(nodes: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """(node, n, label, dim, x, cells, cell): every node at its home and where it is a guest that may have a link."""
    reach = math.sqrt(2 - 2 * threshold)
    centroids = fit_cells(nodes, cell_rows)
    placed = _placed(nodes, centroids, reach)
    if not centroids:
        return placed.drop("far").withColumn("cell", F.lit(0))
    placed = cut_lineage(placed)
    # At most as many radii as there are centroids and unsplit labels' single cells, which have no guests.
    split = F.broadcast(nodes.sparkSession.createDataFrame([(label, dim) for label, dim, _ in centroids], "label long, dim int"))
    radii = placed.join(split, ["label", "dim"], "left_semi").groupBy("label", "dim", F.col("cells")[0].alias("cell")).agg(F.max(F.col("far")[0]).alias("radius"))
    each = placed.select(*nodes.columns, "cells", F.posexplode(F.arrays_zip("cells", "far")).alias("i", "at")).select(*nodes.columns, "cells", "i", F.col("at.cells").alias("cell"), F.col("at.far").alias("far"))
    near = each.join(F.broadcast(radii), ["label", "dim", "cell"], "left").filter((F.col("i") == 0) | (F.col("far") <= F.col("radius") + reach + 1e-6))
    return near.select(*nodes.columns, "cells", "cell")


def near_links(nodes: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``(node, n_links)`` of the nodes ``(node, n, label, dim, x)`` with links to others, counted with their n, and links
    ``(a, b)`` that connect what all links connect."""
    at_cells = _at_cells(nodes, threshold, cell_rows)
    chunks = at_cells.groupBy("label", "dim", "cell").count().select("label", "dim", "cell", F.ceil(F.col("count") / chunk).cast("int").alias("of"))
    dealt = at_cells.join(chunks, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("node", "cell"), F.col("of")).cast("int"))
    others = F.sequence(F.lit(0), F.col("of") - 1)
    blocks = dealt.withColumn("other", F.explode(others)).select(
        "node", "n", "label", "dim", "x", "cells", "cell", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, p, q = key[2], key[3], key[4]
        x, own, node, n = _rows(rows["x"]), rows["own"].to_numpy(), rows["node"].to_numpy(), rows["n"].to_numpy()
        home = np.array([c[0] for c in rows["cells"]])
        width = max(len(c) for c in rows["cells"])
        cells = np.full((len(rows), width), -1)
        for i, c in enumerate(rows["cells"]):
            cells[i, : len(c)] = c
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        linked, parent = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for at in range(0, len(left), 512):
            i, j = np.nonzero(x[left[at : at + 512]] @ x[right].T >= threshold)
            i, j = left[at + i], right[j]
            if p == q:
                i, j = i[i < j], j[i < j]
            both = (home[i] == cell) & (home[j] == cell)
            # One at home here and the other a guest: leave it to the other's home if they meet there and it is smaller.
            host, guest = np.where(home[i] == cell, i, j), np.where(home[i] == cell, j, i)
            mixed = (home[host] == cell) & (home[guest] != cell)
            meets = (cells[host] == home[guest][:, None]).any(axis=1)
            use = both | (mixed & (~meets | (cell < home[guest])))
            i, j = i[use], j[use]
            np.add.at(linked, i, n[j])
            np.add.at(linked, j, n[i])
            while len(i):  # hooks the larger root of each link on the smaller until all links are within a tree
                a, b = parent[i], parent[j]
                apart = a != b
                if not apart.any():
                    break
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
        some = np.flatnonzero(linked)
        return pd.DataFrame({"node": node[some], "n_links": linked[some], "root": node[parent[some]]})

    found = cut_lineage(blocks.groupBy("label", "dim", "cell", "p", "q").applyInPandas(compare, "node long, n_links long, root long"))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return counts, found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``(vec_id, embedding, label)``."""
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    key = F.struct(F.xxhash64("label", "x").alias("h1"), F.xxhash64(F.lit("vector"), "x", "label").alias("h2"))  # 128 bits tell the vectors apart
    rows = cut_lineage(_usable(typed).withColumn("key", F.when(F.col("x").isNotNull(), key)))
    nodes = rows.filter("x is not null").groupBy("label", "dim", "x").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.any_value("key").alias("key"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay
    counts, edges = near_links(nodes.select("node", "n", "label", "dim", "x"), threshold, cell_rows, chunk)
    linked = nodes.select("node", "n", "least", "key").join(counts, "node", "left").join(connected_components(edges), "node", "left")
    linked = cut_lineage(linked.select("key", "least", F.col("n").alias("copies"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    total = rows.count()
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = join_hubs(linked, names, "component", total).select("key", "n_links", "component_id", F.col("copies").alias("n"))
    found = join_hubs(rows.filter("x is not null").select("vec_id", "key"), of, "key", total).select("vec_id", "n_links", "component_id")
    alone = rows.filter("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    whole = found.unionByName(alone)
    return whole.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
