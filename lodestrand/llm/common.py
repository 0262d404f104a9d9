"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, and on one machine only, where it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="lodestrand-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later reads survive lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give back what the driver no longer uses: plans of steps that have run, their shuffles and broadcasts.

    The JVM collects garbage only when its heap is full, and by then has taken all of it from the machine.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, the UTF-8 bytes of the text as ``body`` (null: empty) and ``more``; nothing else is read."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), *more)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """Apply, in each task, the function that ``make`` returns to every Arrow batch.

    ``make`` runs once a task, so what it builds (tables, memos) is shared by the task's batches and
    bounded by what one task holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if batch.num_rows and (out := apply(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def typed(df: DataFrame, *columns: str) -> str:
    """The columns' part of a schema string, with the types that they have in ``df``."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def row_key(docs: DataFrame, id_col: str, text_col: str) -> list:
    """Two 64-bit hashes, ``k1`` and ``k2``, of all of a row (but columns of maps): what a row is known by.

    Rows that agree in both are taken for repeats of one row.
    """
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    parts = [F.col(id_col), F.lit(0), F.col(text_col), *(F.struct(c, F.lit(0)) for c in rest)]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *reversed(parts)).alias("k2")]


def block_pairs(rows: DataFrame, member: str) -> DataFrame:
    """``rows`` with ``low`` and ``high``, once for each two of the ``blocks`` of a group that hold the member's own.

    Each two members of a group meet under some (low, high), which has about two blocks' worth of rows
    however large the group is; ``own`` is the member's block.
    """
    own = F.pmod(F.xxhash64(member), F.col("blocks"))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks")


def ascii_lower(column):
    """A-Z to a-z, all else untouched (``lower`` would also change other scripts)."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, fold: int, fold_is, max_rows: int, max_bytes: int, *, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """At most ``max_rows`` labelled rows (doc_id, body, label) of the training folds, with ``max_bytes`` of text at most.

    The ids are those with the smallest hashes, so the sample is the same at every run. They are bounded by
    the parameter and therefore broadcast; no text is shuffled but that of the sample. An id that has several
    labels gets the largest, one that has several texts the smallest. The result is materialised.
    """
    ids = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .where(fold_is(F.crc32(F.col(id_col).cast("string")) % fold))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    bodies = text_bytes(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    rows = cut(bodies.groupBy("doc_id").agg(F.min("body").alias("body"), F.max("label").alias("label")))
    left, last = max_bytes, None
    for h, doc_id, size in rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("body")).orderBy("h", "doc_id").collect():  # max_rows at most
        left -= size
        if left < 0:
            break
        last = h
    if left >= 0:
        return rows
    return rows.where(F.xxhash64("doc_id") <= F.lit(last)) if last is not None else rows.limit(0)
