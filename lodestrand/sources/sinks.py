"""Writes: partitioned results, keyed upserts, gap filling, back-filled columns, resumed runs, CSV aggregates."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import point_id
from .checkpoints import keep
from .readers import embedding_cache, exists
from .schemas import PAIR_SCORES

#: Fixed value: dates before 2001, in milliseconds; after a back-fill few should be.
OLD_DATE_MS = 978_307_200_000


def write_results(rows: DataFrame, path: str, keys=("system", "ranking", "k")) -> None:
    """One folder a configuration; only those that ``rows`` has are replaced, so a run can be resumed."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_named(rows: DataFrame, folder: str, name: str) -> None:
    """Rows as lines of one file of a given name (a list a query: as large as a result file is)."""
    spark, part = rows.sparkSession, f"{folder}/_{name}"
    rows.coalesce(1).write.mode("overwrite").json(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    written = system.globStatus(path(f"{part}/part-*"))
    target = path(f"{folder}/{name}")
    system.delete(target, False)
    if len(written):
        system.rename(written[0].getPath(), target)
    system.delete(path(part), True)


def write_arrow(rows: DataFrame, folder: str) -> None:
    """Rows as Arrow files, one a batch: made on the executors, named by their content's hash and written by Spark's file system."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["content"])

    files = rows.select(*names).mapInArrow(run, "content binary").withColumn("name", F.concat(F.sha2("content", 256), F.lit(".arrow")))
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in files.toLocalIterator():  # a file at a time
        out = system.create(path(f"{folder}/{row.name}"), True)
        out.write(bytearray(row.content))
        out.close()


def write_csv(rows: DataFrame, path: str) -> None:
    """An aggregate (a few rows a configuration) as one CSV with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def with_point_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("point_id", point_id(F.col("chunk_id"), F.col("decision_id"), F.col("chunk_index")))


def upsert(new: DataFrame, old: DataFrame | None, key: str = "point_id") -> DataFrame:
    """The store after an upsert: one row a key, the new one where there are both.

    Of several new rows of a key the one with the largest hash stays, whatever the order they come in.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.xxhash64(F.to_json(F.struct(*sorted(new.columns)))))))
    once = new.withColumn("_n", place).where("_n = 1").drop("_n")
    return once if old is None else old.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def missing(wanted: DataFrame, there: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``wanted`` whose key isn't in ``there``: gap filling, resumption, embedding caches."""
    return wanted.join(there.select(*keys).distinct(), list(keys), "left_anti")


def gap_fill(chunks: DataFrame, points: DataFrame, missing_ids: DataFrame | None = None) -> DataFrame:
    """Chunks to embed: of the ids that the store misses, pairs (decision_id, chunk_index) that it hasn't got."""
    rows = chunks.join(missing_ids.select("decision_id").distinct(), "decision_id", "left_semi") if missing_ids is not None else chunks
    return missing(rows, points, "decision_id", "chunk_index")


def embed(rows: DataFrame, embedder: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with a vector, dead letters): vectors come back by key, never by position, so a failed one shifts none."""
    done = embedder(rows)
    return done.where("vector IS NOT NULL"), done.where("vector IS NULL").drop("vector")


class BatchEmbedder:
    """Texts to vectors in batches through a callable, tried again, with another to fall back on.

    ``call`` and ``fallback`` take a list of texts and give as many lists of numbers. A batch that both refuse
    is tried text by text, and what still fails has no vector. Runs on the executors, a partition's batches
    one after the other.
    """

    def __init__(self, call, fallback=None, *, size: int = 4, attempts: int = 3, wait: float = 0.5):
        self.call, self.fallback, self.size, self.attempts, self.wait = call, fallback, size, attempts, wait

    def _vectors(self, texts: list[str]) -> list:
        for call in (self.call, self.fallback):
            for i in range(self.attempts if call is not None else 0):
                try:
                    got = call(texts)
                    if len(got) == len(texts):
                        return [[float(x) for x in v] for v in got]
                except Exception:  # whatever the service says, another try or the next way follows
                    time.sleep(self.wait * 2**i)
        return [None] if len(texts) == 1 else [self._vectors([t])[0] for t in texts]

    def __call__(self, rows: DataFrame) -> DataFrame:
        names, text = rows.columns, rows.columns.index("text")

        def run(batches):
            for batch in batches:
                texts, vectors = batch.column(text).to_pylist(), []
                for at in range(0, len(texts), self.size):
                    part = texts[at : at + self.size]
                    known = iter(self._vectors([t for t in part if t]) if any(part) else [])
                    vectors += [next(known) if t else None for t in part]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, "vector"])

        kinds = dict(rows.drop("vector").dtypes)
        return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", vector array<float>")


def embed_shards(rows: DataFrame, embedder: Callable[[DataFrame], DataFrame], path: str, *, key: str = "chunk_id") -> tuple[int, int]:
    """(rows written, rows that failed): vectors of the rows that no shard below ``path`` has are written as new shards.

    A run that broke off is resumed by keys, not by counting rows; failures are listed in ``path``/failed.
    """
    spark, shards = rows.sparkSession, f"{path}/shards"
    todo = missing(rows, spark.read.parquet(shards), key) if exists(spark, shards) else rows
    done = keep(embedder(todo))
    done.where("vector IS NOT NULL").write.mode("append").parquet(shards)
    done.where("vector IS NULL").select(key).write.mode("overwrite").json(f"{path}/failed")
    counted = done.agg(F.count("vector").alias("good"), F.count_if(F.col("vector").isNull()).alias("bad")).first()
    return counted.good, counted.bad


def backfill_dates(points: DataFrame, dates: DataFrame) -> DataFrame:
    """Points with date_ms from ``dates`` (decision_id, date_ms); dates of 0 or less aren't written."""
    good = dates.where("date_ms > 0").groupBy("decision_id").agg(F.min("date_ms").alias("new_ms"))
    joined = points.join(good, "decision_id", "left")
    old = F.col("date_ms") if "date_ms" in points.columns else F.lit(None).cast("long")
    return joined.withColumn("date_ms", F.coalesce("new_ms", old)).drop("new_ms")


def backfill_check(points: DataFrame) -> DataFrame:
    """One row: points, dated points, those dated before 2001."""
    return points.agg(
        F.count(F.lit(1)).alias("n"), F.count("date_ms").alias("dated"), F.count_if(F.col("date_ms") < OLD_DATE_MS).alias("before_2001")
    )


def backfill_samples(points: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` points by id and chunk that have a date, to look at after a back-fill."""
    return points.where("date_ms IS NOT NULL").orderBy("decision_id", "chunk_index").limit(n)


def cached(wanted: DataFrame, path: str, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, embedding of ``wanted`` (query_id, text): those that the cache below ``path`` lacks are embedded and appended to it first."""
    spark = wanted.sparkSession
    todo = missing(wanted, embedding_cache(spark, path), "query_id") if exists(spark, path) else wanted
    done = keep(embedder(todo).where("vector IS NOT NULL").select("query_id", F.col("vector").alias("embedding")))
    done.write.mode("append").json(path)
    return embedding_cache(spark, path).join(wanted.select("query_id"), "query_id", "left_semi")


def write_ids(ids: DataFrame, folder: str) -> None:
    """Ids, sorted, a line each: what later steps take as the valid ones."""
    ids.select("id").distinct().orderBy("id").write.mode("overwrite").text(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select(F.col("value").alias("id"))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def completed(outputs: dict[str, DataFrame]) -> DataFrame:
    """query_id of the queries that every output has."""
    rows = None
    for name, df in outputs.items():
        one = df.select("query_id", F.lit(name).alias("output"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id").agg(F.count_distinct("output").alias("n")).where(F.col("n") == len(outputs)).select("query_id")


def resume(queries: DataFrame, outputs: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(queries still to run, outputs without the rows of queries that are incomplete)."""
    done = completed(outputs)
    return missing(queries, done, "query_id"), {k: v.join(done, "query_id", "left_semi") for k, v in outputs.items()}


def write_scores(rows: DataFrame, path: str) -> None:
    """Pair scores (query_id, id, pair_score) as lines of query_id and a map from id to score."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "pair_score"))))
    write_lines(rows.groupBy("query_id").agg(pairs.alias("scores")), path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """query_id, id, pair_score from such lines; malformed ones are dropped."""
    raw = spark.read.schema(PAIR_SCORES).option("mode", "DROPMALFORMED").json(path)
    return raw.select("query_id", F.explode("scores").alias("id", "pair_score"))


def snapshot(spark: SparkSession, table: DataFrame, path: str, tag: str) -> None:
    """A table under a tag, and a line in the manifest: tag, rows and a checksum that doesn't depend on order."""
    table.write.mode("overwrite").parquet(f"{path}/{tag}")
    at = spark.sql("SELECT unix_micros(current_timestamp()) AS at")
    _checksum(spark.read.parquet(f"{path}/{tag}")).crossJoin(at).withColumn("tag", F.lit(tag)).write.mode("append").json(f"{path}/manifest")


def restore(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """The table of a tag, or of the manifest's last line, if its rows and checksum are those in the manifest."""
    if not exists(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"no manifest in {path}")
    lines = spark.read.schema("at long, tag string, n long, checksum string").json(f"{path}/manifest")
    line = (lines.where(F.col("tag") == tag) if tag else lines).orderBy(F.desc("at")).first()
    if line is None:
        raise KeyError(f"no snapshot {tag}")
    table = spark.read.parquet(f"{path}/{line.tag}")
    got = _checksum(table).first()
    if (got.n, got.checksum) != (line.n, line.checksum):
        raise ValueError(f"snapshot {line.tag} isn't what the manifest says")
    return table


def _checksum(table: DataFrame) -> DataFrame:
    row = F.xxhash64(F.to_json(F.struct(*sorted(table.columns))))
    return table.agg(F.count(F.lit(1)).alias("n"), F.hex(F.coalesce(F.bit_xor(row), F.lit(0))).alias("checksum"))
