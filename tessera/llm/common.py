"""What the corpus operators share: written tables, hash folds, samples, range buckets and connected components."""

from __future__ import annotations

import itertools
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage, shared_dir


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet under a new name in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it new to the frame (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most about ``bound`` rows, chosen by a hash of the key: the same ones however the table is partitioned."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < F.lit(math.floor(bound / n * (1 << 30))))


def byte_cuts(sized: DataFrame, least: int = 16 << 20, usual: int = 256 << 20, most: int = 16_384) -> list[int]:
    """Increasing cut points of the ids of rows ``(id long, size long)`` that give ranges of about equal bytes.

    A range has ``least`` bytes; from 256 ranges on they grow, up to ``usual`` bytes, and from ``most`` ranges on again.
    The cuts depend on ids and sizes only, not on the partitions that hold them.  Bytes are summed per window of ids,
    whose width is a power of two; windows that are too full are split again, so the driver gets a few numbers for each
    range.  Rows of one id are never parted.
    """
    found = sized.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("size").alias("bytes")).first()
    if found["lo"] is None:
        return []
    target = max(least, min(usual, (found["bytes"] or 0) // 256), (found["bytes"] or 0) // most)
    ranges = (found["bytes"] or 0) // target + 1
    shift = max(0, (found["hi"] - found["lo"]).bit_length() - max(8, (8 * ranges).bit_length()))
    windows: list[tuple[int, int]] = []  # (largest id, bytes)
    rows = sized.filter("id is not null")
    while True:
        width = 1 << shift
        window = F.expr(f"id div {width}L")
        sums = [(r["w"], r["bytes"]) for r in rows.groupBy(window.alias("w")).agg(F.sum("size").alias("bytes")).collect()]
        full = [w for w, n in sums if n > target // 2 and shift]
        windows += [((w + 1) * width - 1 if w >= 0 else w * width, n) for w, n in sums if n <= target // 2 or not shift]
        if not full:
            break
        split = sized.sparkSession.createDataFrame([(w,) for w in full], "w long")
        rows = rows.withColumn("w", window).join(F.broadcast(split), "w").select("id", "size")
        # Each full window in as many parts as it needs, all of them in as many as the fullest.
        most_bytes = max(n for w, n in sums if n > target // 2)
        shift = max(0, shift - min(8, (4 * most_bytes // target).bit_length()))
    cuts, held = [], 0
    for before, (_, n) in itertools.pairwise([(found["lo"], 0), *sorted(windows)]):
        if held and held + n > target:
            cuts.append(before[0])
            held = 0
        held += n
    return cuts


def bucket_of(column: Column, cuts: list[int]) -> Column:
    """The number of cut points below the value, from 0; null counts as the smallest value.

    Two levels of at most the square root of the cut points each, so that many buckets stay cheap.
    """
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    inner = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def longs(values: list[int]) -> str:
        return f"cast(array({','.join(f'{v}L' for v in values)}) as array<bigint>)"

    outer = F.expr(longs([x[-1] for x in inner]))
    full = F.size(F.filter(outer, lambda c: c < column))
    rest = F.expr(f"array({','.join(longs(x) for x in [*inner, []])})")
    within = F.size(F.filter(F.element_at(rest, full + 1), lambda c: c < column))
    return F.when(column.isNull(), F.lit(0)).otherwise(F.least(full * F.lit(step), F.lit(len(cuts))) + within).cast("int")


HUB = 100_000


def join_hubs(rows: DataFrame, facts: DataFrame, key: str, total: int, hub: int | None = None) -> DataFrame:
    """Inner join of many rows with one fact for each key; the facts say in ``n`` how many rows have the key.

    The rows of a key with very many of them stay where they are and meet its fact by broadcast.  There are at most
    50,000 such facts, as each key takes a share of the ``total`` rows; all other rows are joined by a shuffle.
    """
    limit = max(HUB if hub is None else hub, total // 50_000)
    if total <= limit:
        return rows.join(facts.drop("n"), key)
    hubs = F.broadcast(facts.filter(F.col("n") > limit).drop("n"))
    rest = rows.join(hubs.select(key), key, "left_anti").join(facts.filter(F.col("n") <= limit).drop("n"), key)
    return rows.join(hubs, key).unionByName(rest)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of the edges ``(a, b)`` of longs; the component is its smallest node.

    Large-star and small-star steps alternate (Kiveris et al., "Connected Components in MapReduce and Beyond") until
    the edges are stars.  Every step is a grouped minimum and a join in which nodes with very many edges are met by
    broadcast, so neither a component nor the edges of a node ever meet in one task; each round is written to the
    shared folder.
    """

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 30))).first())

    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = summary(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hubs(both, least, "a", 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = (
            join_hubs(large, smallest, "a", 2 * before[0])
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        now = cut_lineage(small)
        after = summary(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
