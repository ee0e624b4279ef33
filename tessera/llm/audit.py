"""Filter interaction audit: what five quality filters remove, alone and after each other, in every order.

A mask histogram answers it all.  Native expressions build a mask of five bits for every document, one bit for each filter
that it fails; a grouping of the texts, by their SHA-256, supplies the smallest doc_id of each text for the filter of
exact copies.  What is left of the corpus is at most 32 cells for each part (a value of ``source``), and all 120 orders are
enumerated from the cells: the state before a step is the set of filters applied so far, so an order is a path
through 80 pairs of such a set and the next filter.

=  ==================================================================
A  fewer than 200 words (maximal runs of other signs than white space)
B  fewer than half of the words are different
C  more than 2 % of the code points are A to Z
D  the text holds one of ``#$%&*|``
E  some document with a smaller doc_id has the same text
=  ==================================================================

Shuffles carry thin rows (a digest, ids, a part and a mask), which are written once; no text is shuffled.  Copies are
counted before they are shuffled, and the first document of a text is met on (text, doc_id), so neither a part nor a
group of copies with a third of all rows meets in one task.

Defined results: a null text is an empty text, a null source the empty string.  A row without a doc_id has no smaller id,
so it passes E, and its text makes no other document fail.  Rows with the same doc_id and text do not make each other fail;
every row counts.  A document is good or toxic if any label with its doc_id says so.  An empty table gives no part and
so no row.  Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import write_shared

FILTERS = "ABCDE"
WORDS, VARIED, CAPITALS = 200, 50, 2  # words; per cent of different words; per cent of capitals
_SPACE = " \t\n\x0b\f\r"


def text_mask(words: Column, text: Column) -> Column:
    """Bits 0 to 3: whether a text fails A to D; ``words`` are those of the text, at least one string."""
    n = F.when(words[0] == "", F.lit(0)).otherwise(F.size(words)).cast("long")
    different = F.when(words[0] == "", F.lit(0)).otherwise(F.size(F.array_distinct(words))).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    failed = [n < WORDS, 100 * different < VARIED * n, 100 * capitals > CAPITALS * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every document: the text is read once and left behind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = rows.withColumn("words", F.split(F.btrim("text", F.lit(_SPACE)), f"[{_SPACE}]+"))
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("words"), F.col("text")).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: the histogram of the masks of documents ``(doc_id, text, source)``."""
    thin = write_shared(masks(docs), "audit")
    firsts = thin.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    met = thin.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    whole = met.select("part", (F.col("mask") + F.when(copy, F.lit(16)).otherwise(0)).alias("mask"), "good", "toxic")
    return whole.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def _steps() -> list[tuple[int, str, int, int, int, int, int, int]]:
    """``mask, letter, before, kept, removed, redundant, unique, orders`` of every mask at every step that some order takes.

    ``orders`` is how many of all orders remove a document of this mask by this filter: it is the first of those that fail.
    """
    every = math.factorial(len(FILTERS))
    out = []
    for i, letter in enumerate(FILTERS):
        own = 1 << i
        for before in range(1 << len(FILTERS)):
            if not before & own:
                for mask in range(1 << len(FILTERS)):
                    fails, gone = bool(mask & own), bool(mask & before)
                    out.append((mask, letter, before, int(not (fails or gone)), int(fails and not gone), int(fails and gone), int(mask == own), every // mask.bit_count() if fails else 0))
    return out


def _orders() -> list[tuple[str, int, str, int]]:
    """``filter_order, step, letter, before``: the steps of all orders."""
    return [
        ("".join(order), k + 1, letter, sum(1 << FILTERS.index(x) for x in order[:k]))
        for order in itertools.permutations(FILTERS)
        for k, letter in enumerate(order)
    ]


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per ``part, filter_order, step``: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    spark = docs.sparkSession
    steps = spark.createDataFrame(_steps(), "mask int, letter string, before int, kept int, gone int, again int, only_this int, orders int")
    orders = spark.createDataFrame(_orders(), "filter_order string, step int, letter string, before int")
    sums = {"kept": ("n", "kept"), "removed": ("n", "gone"), "redundant": ("n", "again"), "unique_fails": ("n", "only_this"), "good_lost": ("good", "gone"), "toxic_lost": ("toxic", "gone"), "shapley": ("n", "orders")}
    met = cells(docs, labels).join(F.broadcast(steps), "mask")  # 80 fixed rows for each of 32 masks
    pairs = met.groupBy("part", "letter", "before").agg(*(F.sum(F.col(x) * F.col(flag)).cast("long").alias(name) for name, (x, flag) in sums.items()))
    return pairs.join(F.broadcast(orders), ["letter", "before"]).select("part", "filter_order", "step", *sums)
