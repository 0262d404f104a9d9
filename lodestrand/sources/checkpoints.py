"""Materialising a relation that several plans share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, and on one machine only, where it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="lodestrand-")


#: Spark's setting by which a plan's shuffle files go when it has run, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet and read from there by all that follows.

    Plans stay short however many steps lead to it, and a lost executor costs no more than reading again.
    Repeated names and ids take little room there (a checkpoint's rows are not compressed). The shuffles that
    led to it are removed: nothing reads them again. The files stay as long as the folder.
    """
    spark = df.sparkSession
    context, before = spark.sparkContext, spark.conf.get(_CLEANUP, None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a plan of its own, made under the setting
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
