"""From raw documents to a training mix: quality, near-duplicates, benchmark overlaps, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; between stages the
rows are written as Parquet to the shared folder and read again, so no stage is worked out twice and lost
executors cost one stage at most. All stages but the last return the columns of ``documents``.

In every stage ids may be null, repeated and of any type, texts null, empty or of any length, and ``docs``
may have more columns, of whatever names, which go along; an empty table gives an empty result. Rows that
are alike in all columns are one row after the near-duplicate stage.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm import decontamination, mixing, near_texts, quality, secrets
from lodestrand.llm.common import release, shared_folder, table

#: No SQL: two stages are learned models.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """``stage``, begun and ended with a driver that has let go of the steps before."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        out = stage(spark, docs, sf_dir)
        release(spark)
        return out

    return run


@lean
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, fitted on the labelled rows among these, scores 0.7 or more.

    Null and empty texts are scored like a text without tokens. Without labelled rows all scores are 0.5, and none stays.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@lean
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The one with the smallest id stays, null last; texts without words (null and empty ones too) are one group.
    """
    return near_texts.keep_one_similar(docs)


@lean
def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item; null and empty texts overlap none."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@lean
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in place of each secret; null and empty texts stay as they are."""
    return secrets.redact_rows(docs, secrets.train(docs))


@lean
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, with ``copy_number``; null sources are one source, null texts have size 0."""
    return mixing.emit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_overlaps),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
