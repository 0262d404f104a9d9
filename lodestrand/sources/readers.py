"""Scans: a catalogue of named datasets, tolerant line files, result files named by configuration, artefacts."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import token_count
from . import schemas

#: Fixed value: how result files are named.
RESULT_NAME = r"^(.+)_(cosine|indegree|cross_encoder)_(\d+)$"


class Catalogue:
    """Names to tables: paths of one or more splits, read on demand; an unknown name is an error.

    With ``store``, a dataset is written there once as Parquet and read from there from then on.
    """

    def __init__(self, spark: SparkSession, paths: Mapping[str, str | list[str]], store: str | None = None):
        self.spark, self.paths, self.store = spark, dict(paths), store

    def load(self, name: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
        if name not in self.paths:
            raise KeyError(f"no such dataset: {name}; there are {sorted(self.paths)}")
        splits = self.paths[name]
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        got = reader.format(fmt).load([splits] if isinstance(splits, str) else list(splits))
        if not self.store:
            return got
        got.write.mode("ignore").parquet(f"{self.store}/{name}")
        return self.spark.read.parquet(f"{self.store}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has something there (a glob may match it)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ordered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``line_at`` (file, start of the block read, number in it), which orders them as they stand; malformed ones are dropped."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"))
    parsed = spark.read.text(path).select(at.alias("line_at"), F.from_json("value", schema).alias("r"))
    return parsed.where(F.col("r").isNotNull()).select("r.*", "line_at")


def last_by_key(rows: DataFrame, key: str = "query_id", order: str = "line_at") -> DataFrame:
    """One record a key, the last; rows without a key are dropped."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.where(F.col(key).isNotNull()).withColumn("_n", place).where(F.col("_n") == 1).drop("_n")


def arrow_table(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """The Arrow files of a folder, in the file or the stream form, read on the executors a file at a time.

    ``columns`` is the schema of what is read; other columns are left out, missing ones are null.
    """
    wanted = spark.createDataFrame([], columns).schema
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder).select("path", "content")

    def run(batches):
        target = to_arrow_schema(wanted)
        for batch in batches:
            for content in batch.column("content"):
                buffer = pa.BufferReader(content.as_buffer())
                try:
                    parts = pa.ipc.open_file(buffer).read_all().to_batches()
                except pa.ArrowInvalid:
                    buffer.seek(0)
                    parts = pa.ipc.open_stream(buffer).read_all().to_batches()
                for part in parts:
                    there = {n: part.column(n) for n in part.schema.names}
                    yield pa.RecordBatch.from_arrays([there[f.name].cast(f.type) if f.name in there else pa.nulls(part.num_rows, f.type) for f in target], schema=target)

    return files.mapInArrow(run, wanted)


def newest_revision(spark: SparkSession, root: str, explicit: str | None = None) -> str:
    """A dataset's folder: the explicit one, or the last by name of the revisions below ``root``."""
    if explicit:
        return explicit
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in system.listStatus(folder) if x.isDirectory()] if system.exists(folder) else []
    if not found:
        raise FileNotFoundError(f"no revision of a dataset in {root}")
    return max((x.getName(), x.toString()) for x in found)[1]


def inside(root: str, relative: str) -> str:
    """The path of a file below ``root``; one that leads out of it is refused."""
    path = posixpath.normpath(f"{root}/{relative}")
    if relative.startswith("/") or "\\" in relative or not path.startswith(posixpath.normpath(root) + "/"):
        raise PermissionError(f"{relative} isn't below the folder")
    return path


def sample_texts(docs: DataFrame, *, court: str, max_tokens: int, limit: int, only: DataFrame | None = None) -> DataFrame:
    """decision_id, file_number, date, language, court, text of a court's decisions of fewer than ``max_tokens`` tokens.

    ``only`` (decision_id) restricts them; of those that fit, the first ``limit`` by id.
    """
    rows = docs.where((F.col("court") == court) & (F.coalesce("full_text", F.lit("")) != "") & (token_count(F.col("full_text")) < max_tokens))
    rows = rows.join(only.select("decision_id").distinct(), "decision_id", "left_semi") if only is not None else rows
    named = rows.select("decision_id", "file_number", "date", "language", "court", F.col("full_text").alias("text"))
    return named.orderBy("decision_id").limit(limit)


def queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Query records whose text isn't blank; with ``limit``, the first in the order of files and lines."""
    got = ordered_lines(spark, path, schemas.QUERIES).where(F.trim(F.coalesce("query_text", F.lit(""))) != "")
    return (got.orderBy("line_at").limit(limit) if limit is not None else got).drop("line_at")


def facts(spark: SparkSession, path: str, languages=("de", "fr", "it")) -> DataFrame:
    """decision_id, language, facts in the given languages, one an id: the least in file order."""
    rows = ordered_lines(spark, path, schemas.FACTS).withColumn("language", F.lower("language")).where(F.col("language").isin(*languages))
    place = F.row_number().over(Window.partitionBy("decision_id").orderBy("line_at"))
    return rows.withColumn("_n", place).where("_n = 1").select("decision_id", "language", F.coalesce("facts", F.lit("")).alias("facts"))


def aggregate(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by column names: those it lacks are null; a file that isn't there is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


def config_of(stem: Column) -> tuple[Column, Column, Column]:
    """(system, ranking, k) of a result file's stem; empty where it isn't one."""
    part = lambda i: F.regexp_extract(stem, RESULT_NAME, i)
    return part(1), part(2), part(3).try_cast("int")


def results(spark: SparkSession, path: str) -> DataFrame:
    """system, ranking, k, query_id, id, rank of all result files of a folder; other files are skipped."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    raw = spark.read.schema(schemas.RESULTS).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(path)
    system, ranking, k = config_of(F.col("stem"))
    named = raw.select("query_id", "retrieved", stem.alias("stem")).select(system.alias("system"), ranking.alias("ranking"), k.alias("k"), "query_id", "retrieved")
    return named.where("ranking <> ''").select("system", "ranking", "k", "query_id", F.posexplode("retrieved").alias("pos", "id")).select(
        "system", "ranking", "k", "query_id", "id", (F.col("pos") + 1).alias("rank")
    )


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, schemas.EMBEDDINGS).dropna()


def artefacts(spark: SparkSession, *folders: str, suffixes=("csv", "jsonl", "json")) -> DataFrame:
    """path, name, length, modificationTime of the files with these suffixes; contents aren't read."""
    glob = "*.{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(list(folders))
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "modificationTime")


def chunk_points(points: DataFrame, sources=None, columns=None) -> DataFrame:
    """A filtered scan of the vector store, without the vectors unless asked for."""
    rows = points.where(F.col("source").isin(*sources)) if sources else points
    return rows.select(*(columns or [c for c in points.columns if c != "vector"]))


def first_chunk_metadata(points: DataFrame, characters: int = 600) -> DataFrame:
    """id, excerpt and payload of each decision's first chunk; of several, the least chunk_id."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("chunk_id"))
    rows = points.where("chunk_index = 0").withColumn("_n", place).where("_n = 1").drop("_n")
    return rows.withColumn("excerpt", F.substring(F.coalesce("text", F.lit("")), 1, characters)).drop("text", "vector")


def metadata_for(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of the ids asked for; ids without any are absent."""
    return metadata.join(ids.select("id").distinct(), "id", "left_semi")


def checked_graph(nodes: DataFrame, sample: int = 20) -> DataFrame:
    """The nodes, after a look at some: ids of rulings have the shape of UUIDs, else the graph is refused."""
    odd = nodes.where("source = 'ruling'").select("id").limit(sample).where(~(F.length("id") == 36) | ~F.col("id").rlike(r"^[^-]*(-[^-]*){4}$"))
    if not odd.isEmpty():
        raise ValueError("ids of the graph don't look like UUIDs; it was built from other data")
    return nodes
