"""Line dedup: of lines that several documents share, only those of the first document stay.

All of it is DataFrame functions.  Text never goes through the comparison: a line is two 64-bit hashes of its key (the line
without white space at its ends, A-Z in lower case), its document and its position.

1. Lines whose keys are long enough become rows ``h1, h2, doc_id, tie, pos``, written once to the shared folder.
2. A key that very many documents hold is hot.  Hot keys show in a fixed share of the documents, chosen by hash: those
   with at least ``HOT_ROWS`` rows there and a ``1 / HOT_KEYS`` share of its rows, so there are never more than ``HOT_KEYS``.
   Their first documents are minima that every task forms before anything is shuffled, and they come back by broadcast.
   What the sample shows only decides how a key is handled: all of its rows count either way.
3. All other lines are dealt out in ranges of hashes and sorted by hash, document and position within each range.  Streaming
   over a key's rows, the first document is the one that keeps its lines.
4. What is dropped returns as words of 64 lines: :func:`keep_bitmaps` has one row per document that loses a line.
   Words in which every line is kept are all ones, and those after the last dropped line are left out.

The text meets its bitmap once, by a join on (doc_id, hash of the text); :func:`dedup` drops the lines there.

Defined results: a null text is an empty text, and an empty text is one empty line.  A row without a doc_id comes after all
others; such rows are one document in the comparison, as are rows with the same doc_id: they do not drop each other's
lines.  Repeated rows come back as often as they occur.  Other columns are not looked at.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, shuffle_partitions, write_shared

LEAST = 10
HOT_KEYS = 20_000
HOT_ROWS = 64
HOT_SHARE = 16
WORD = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    """The text's lines; one empty line if it is null."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and nothing else."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def tie_of(text: Column) -> Column:
    """Tells apart the texts of one doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``h1, h2, doc_id, tie, pos`` of every line whose key has at least that many code points."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie_of(text).alias("tie"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keyed = rows.filter(F.octet_length("line") >= least).withColumn("key", key_of(F.col("line"))).filter(F.length("key") >= least)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "tie", "pos")


def _hot_keys(rows: DataFrame) -> DataFrame:
    """``h1, h2`` of the keys with a large share of all rows: at most ``HOT_KEYS``."""
    seen = rows.filter(F.pmod(F.xxhash64("doc_id", "tie", F.lit("hot")), F.lit(HOT_SHARE)) == 0)
    least = max(HOT_ROWS, math.ceil(seen.count() / HOT_KEYS))
    return seen.groupBy("h1", "h2").count().filter(F.col("count") >= least).select("h1", "h2")


def dropped_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, tie, pos`` of the lines whose key a smaller doc_id has."""
    rows = write_shared(line_rows(docs, least), "lines")
    hot = write_shared(_hot_keys(rows), "lines-hot")
    later = ~F.col("doc_id").eqNullSafe(F.col("first"))  # ids before it have no such line
    firsts = rows.join(F.broadcast(hot), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    of_hot = rows.join(F.broadcast(firsts), ["h1", "h2"]).filter(later)
    rest = rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange(shuffle_partitions(docs.sparkSession), "h1", "h2")
    in_order = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    of_rest = rest.withColumn("first", F.first("doc_id").over(in_order)).filter(later)
    return of_hot.unionByName(of_rest).select("doc_id", "tie", "pos")


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, tie, keep, n_dropped`` of every document that loses a line.

    ``keep`` is an array of longs; bit ``pos % 64`` of the long ``pos div 64`` says whether that line stays.  Lines beyond
    the array stay.
    """
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = dropped_lines(docs, least).groupBy("doc_id", "tie", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    per = words.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_list(F.struct("word", "gone"))).alias("w"), F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"))
    whole = F.lit(-1).cast("long")

    def filled(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("w"), i - 1)["word"])
        return F.concat(F.array_repeat(whole, x["word"] - before - 1), F.array(F.bitwise_not(x["gone"])))

    return per.select("doc_id", "tie", F.flatten(F.transform("w", filled)).alias("keep"), "n_dropped")


def _stays(keep: Column, pos: Column) -> Column:
    """Whether a line stays, by the bitmap of its document."""
    word = F.get(keep, F.shiftright(pos, 6))
    return word.isNull() | (F.getbit(word, pos.bitwiseAND(F.lit(WORD - 1))) == 1)


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with their ``text`` rid of dropped lines, and with the columns ``n_lines`` (before) and ``n_dropped``.

    Columns of these names must not be in the table.
    """
    own, tie, keep = fresh(docs, "_own"), fresh(docs, "_tie"), fresh(docs, "_keep")
    text = F.col("text").cast("string")
    maps = keep_bitmaps(docs, least).select(F.col("doc_id").alias(own), F.col("tie").alias(tie), F.col("keep").alias(keep), "n_dropped")
    met = docs.withColumn(tie, tie_of(text)).alias("d").join(maps.alias("m").hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(f"d.{tie}") == F.col(f"m.{tie}")), "left")
    kept = F.array_join(F.filter(lines_of(text), lambda x, i: _stays(F.col(keep), i)), "\n")
    whole = F.coalesce(text, F.lit(""))
    columns = [F.when(F.col(keep).isNull(), whole).otherwise(kept).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return met.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
