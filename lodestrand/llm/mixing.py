"""Mixing sources to target weights by systematic sampling.

A source's target in words fixes its rate (expected copies of each of its documents). The documents of
a source lie one after the other on a line, each as long as its expected copies; one random offset is
added, and a document is emitted once for every integer boundary that its piece of the line crosses.
Documents are laid out by size class, so every stretch of the line holds like sizes and the words taken
come near the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = "mix"
#: Rows that a bucket of a source's size class has about, whose places are counted in one task.
BUCKET_ROWS = 2_000


def mix(
    docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = SEED, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row.

    Null texts have size 0, null sources form a source of their own, the last. Repeated rows count each
    for itself; a null id is an id like another; an empty table gives an empty result; other columns
    are not read; texts of any length are read whole. The same rows give the same mix at every run.

    One scan counts words and hashes id and text; that goes to a checkpoint (about a hundred bytes a row).
    A source's line is in the order of size class and hash. Rows of one id and text are counted first; a
    size class of a source is cut into buckets by the hash's leading digits, as many as its rows need, and
    the place on the line is the count of all buckets before plus the place in the bucket. So a source with
    a third of all rows, or that many rows of one size, is spread over as many tasks as it needs, and the
    order doesn't depend on how.
    """
    sizes = common.cut(_sized(docs, seed, id_col, text_col, source_col))
    counted = sizes.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    each = _placed(sizes, counted, weights, cap, seed, bucket_rows).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = _copies(F.col("before") + F.col("i") - 1, F.col("before") + F.col("i"), cap)
    return each.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def emit(
    docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = SEED, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS, number: str = "copy_number",
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, all columns as they are, with ``number`` from 1.

    If ``docs`` has a column of that name, the new one gets an underscore more. Rows that are alike in all
    columns have their copies numbered together. Nulls, empty and long texts and empty tables are as in
    ``mix``. Whole rows are shuffled once, by a hash of the row; places are counted on narrow ones.
    """
    while number.lower() in (c.lower() for c in docs.columns):
        number += "_"
    key = common.row_key(docs, id_col, text_col)
    sizes = common.cut(_sized(docs, seed, id_col, text_col, source_col, *key))
    counted = sizes.groupBy("source", "size", "h", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    placed = _placed(sizes, counted, weights, cap, seed, bucket_rows, "k1", "k2")
    each = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(0).cast("long"), lambda x, i: x + _copies(F.col("before") + i - 1, F.col("before") + i, cap))
    taken = placed.select("k1", "k2", each.alias("copies")).where("copies > 0")
    held = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = held.join(taken.hint("shuffle_hash"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("i")).select("row.*", F.col("i").alias(number))


def _sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(common.WORD)).cast("long")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), h.alias("h"), *more)


def plan(sizes: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """sid, name, source_size, target, rate, shift of every source, by code point, null last.

    Targets share all words by weight; none is above ``cap`` times its source's size, and what is cut off goes
    to the others by weight: sources are filled in the order of cap / weight, in exact integers up to the
    last division. The shift is the line's random offset, a multiple of 2 to the power -20 in [0, 1). The
    table of sources, a row each, is sorted in one task; any number of them will do.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    big = "decimal(38,0)"
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("sid", rank).withColumn("w", weight)
    order = Window.orderBy((F.col("source_size") * cap).cast("double") / F.col("w"), "sid")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = weighed.select(
        "*", F.sum("source_size").over(whole).alias("all_words"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap).alias("left_words"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_weight"),
    )
    capped = filled.withColumn("full", F.col("w").cast(big) * F.col("left_words").cast(big) > (F.col("source_size") * cap).cast(big) * F.col("left_weight").cast(big))
    words = F.max("all_words").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(whole), F.lit(0)) * cap
    level = words.cast("double") / F.sum(F.when(~F.col("full"), F.col("w"))).over(whole).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("w") * F.col("level"))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:offset:"), F.col("sid").cast("string"))), 1, 5), 16, 10).cast("double") / 2**20
    return (
        capped.withColumn("level", level)
        .select("sid", F.col("source").alias("name"), "source_size", target.alias("target"), shift.alias("shift"))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    )


def _placed(sizes: DataFrame, counted: DataFrame, weights, cap: int, seed: str, bucket_rows: int, *keys: str) -> DataFrame:
    """``counted`` (n alike rows in one) with their source's plan and ``before``, the places on the line in front of them."""
    known = common.cut(plan(sizes, weights, cap, seed))
    bits = F.bin("size")
    cls = F.length(bits) * 4 + F.substring(F.rpad(bits, 3, "0"), 2, 2).cast("int")
    rows = counted.withColumn("cls", cls).join(known, F.col("source").eqNullSafe(F.col("name")))
    totals = sizes.withColumn("cls", cls).groupBy("source", "cls").agg(F.count(F.lit(1)).alias("rows"))
    digits = F.greatest(F.lit(0), F.least(F.lit(32), F.ceil(F.log2(F.col("rows") / bucket_rows) / 4))).cast("int")
    wide = common.cut(totals.select(F.col("source").alias("of"), F.col("cls").alias("of_cls"), digits.alias("digits")))
    rows = rows.join(wide, F.col("source").eqNullSafe(F.col("of")) & (F.col("cls") == F.col("of_cls"))).withColumn("bucket", F.substr("h", F.lit(1), F.col("digits")))
    by = ["sid", "cls", "bucket"]
    ahead = Window.partitionBy("sid").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by).agg(F.sum("n").alias("in_bucket")).select(*by, F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("start"))
    so_far = Window.partitionBy(*by).orderBy("h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("in_front", F.coalesce(F.sum("n").over(so_far), F.lit(0))).join(starts, by).withColumn("before", F.col("start") + F.col("in_front"))


def _copies(begin, end, cap: int):
    """Integer boundaries between two places on the line."""
    crossed = F.floor(F.col("shift") + end.cast("double") * F.col("rate")) - F.floor(F.col("shift") + begin.cast("double") * F.col("rate"))
    return F.least(crossed, F.lit(cap)).cast("long")
