"""A whole evaluation: retrieve, score, aggregate, with events, cancellation, resumption and a history of runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, metrics, retrieval, views
from ..sources import schemas, sinks
from ..sources.checkpoints import keep
from ..sources.readers import exists

#: States of a run that is over.
OVER = ("done", "failed", "aborted", "interrupted")


STAGES = ("retrieval", "metrics", "aggregates")
#: Fixed value: queries by which metrics may differ from the results and still be used again.
TOLERANCE = 5


class Cancelled(Exception):
    """The run was asked to stop; what earlier stages wrote stays."""


def _outputs(results: DataFrame) -> DataFrame:
    return results.select("query_id", F.concat_ws("/", "system", "ranking", "k").alias("output")).distinct()


def evaluate(
    corpus: retrieval.Corpus, queries: DataFrame, truth: DataFrame, folder: str, settings: retrieval.Settings, *,
    rankings=("cosine", "indegree"), model=None, resume: bool = False, stages=STAGES, on_event: Callable[[dict], None] = lambda e: None,
    cancelled: Callable[[], bool] = lambda: False,
) -> dict[str, DataFrame]:
    """Write results, pools, layers, per_query and the aggregates below ``folder`` and return them as read back.

    ``queries`` has query_id, query_text, language, year, date_ms, vector; ``truth`` is (query_id, id). With
    ``resume``, queries that have rows in every configuration are left as they are and the others run anew;
    rows of incomplete queries are dropped; metrics are left as they are if they have all columns, the same
    configurations and, but for TOLERANCE at most, the same queries as the results. ``stages`` says which to
    run; those left out must have been run before. Stages are job groups, so they can be cancelled from
    outside too.
    """
    if unknown := set(stages) - set(STAGES):
        raise ValueError(f"no such stage: {sorted(unknown)}")
    spark = queries.sparkSession

    def stage(name: str, make: Callable[[], None]) -> None:
        if cancelled():
            on_event({"type": "aborted", "stage": name})
            raise Cancelled(name)
        spark.sparkContext.setJobGroup(f"evaluate-{name}", name, True)
        on_event({"type": "stage_started", "stage": name})
        start = time.time()
        try:
            make()
        except Exception as error:
            on_event({"type": "error", "stage": name, "message": str(error)[:300]})
            raise
        on_event({"type": "stage_done", "stage": name, "seconds": time.time() - start})

    def at(name: str) -> str:
        return f"{folder}/{name}"

    def read(name: str) -> DataFrame:
        return spark.read.parquet(at(name))

    def merged(name: str, new: DataFrame, keys) -> None:
        """New rows with those of finished queries; the old are read to the end before they are replaced."""
        if done is not None and exists(spark, at(name)):
            new = new.unionByName(keep(read(name).join(done, "query_id", "left_semi").select(*new.columns)))
        sinks.write_results(new, at(name), keys)

    done, todo = None, queries
    if resume and exists(spark, at("results")):
        expected = len(settings.systems) * len(rankings) * len(settings.ks)
        done = keep(_outputs(read("results")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == expected).select("query_id"))
        todo = sinks.missing(queries, done, "query_id")
    found = retrieval.Retrieval(corpus, keep(todo), settings)

    def retrieve() -> None:
        scores = keep(retrieval.pair_scores(found.pools(), todo, corpus.texts, model)) if "cross_encoder" in rankings else None
        rows = None
        for ranking in rankings:
            one = retrieval.cut_off(retrieval.rank(found.pools(), ranking, corpus.degree, scores), settings.ks)
            rows = one if rows is None else rows.unionByName(one)
        merged("results", rows, metrics.CONFIG)
        if scores is not None:
            merged("scores", scores.withColumn("model", F.lit("pair")), ["model"])
        merged("pools", found.pools(), ["system"])
        merged("layers", found.layers(truth), ["system"])

    def scored(results: DataFrame) -> bool:
        """Whether the metrics there are those of these results."""
        if not exists(spark, at("per_query")):
            return False
        rows = read("per_query")
        wanted = {f.name for f in spark.createDataFrame([], schemas.PER_QUERY).schema.fields}
        if not wanted <= set(rows.columns):  # written by an older version
            return False
        new, old = (views.configurations(x) for x in (results, rows))
        if new.exceptAll(old).unionByName(old.exceptAll(new)).limit(1).count():
            return False
        return metrics.id_difference(results.select("query_id"), rows.select("query_id")).first().differing <= TOLERANCE

    def score() -> None:
        results = read("results")
        if resume and scored(results):
            on_event({"type": "skipped", "stage": "metrics"})
            return
        pairs = keep(metrics.wanted_distances(results, truth))
        out, any_ = (graph.distances_between(corpus.edges, pairs, directed=x) for x in (True, False))
        sinks.write_results(metrics.per_query(results, truth, queries, out, any_), at("per_query"), metrics.CONFIG)

    def aggregate() -> None:
        rows = read("per_query")
        for name, made in (
            ("summary", metrics.summary(rows)), ("summary_by_language", metrics.summary_by_language(rows)),
            ("recall_ceiling", metrics.recall_ceiling(metrics.pool_metrics(read("pools"), truth))),
            ("recall_ceiling_layers", metrics.layer_ceilings(read("layers"), truth)),
        ):
            sinks.write_csv(made, at(name + ".csv"))
            made.write.mode("overwrite").parquet(at(name))

    for name, make in zip(STAGES, (retrieve, score, aggregate), strict=True):
        if name in stages:
            stage(name, make)
        else:
            on_event({"type": "skipped", "stage": name})
    names = ("results", "pools", "layers", "per_query", "summary", "summary_by_language", "recall_ceiling", "recall_ceiling_layers")
    return {name: read(name) for name in names}


def seconds_each(events: list[dict], n_queries: int) -> list[dict]:
    """stage, seconds, seconds_each of the stages that a run's events say are done."""
    return [{"stage": e["stage"], "seconds": e["seconds"], "seconds_each": e["seconds"] / max(1, n_queries)} for e in events if e["type"] == "stage_done"]


# History of runs: states are appended, the table of runs is a view.


def log_run(spark, path: str, run_id: int, status: str, **values) -> None:
    """Append a state of a run; columns that aren't given keep what earlier states said."""
    row = spark.createDataFrame([], schemas.RUNS).schema
    line = {f.name: values.get(f.name) for f in row.fields} | {"run_id": run_id, "status": status}
    stamped = spark.createDataFrame([tuple(line[f.name] for f in row.fields)], row).withColumn("at", F.expr("unix_micros(current_timestamp())"))
    stamped.write.mode("append").parquet(path)


def runs(spark, path: str) -> DataFrame:
    """A row a run: of each column the last value that was given."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.RUNS)
    log = spark.read.parquet(path)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in log.columns if c not in ("run_id", "at")]
    return log.groupBy("run_id").agg(*latest)


def latest_active(runs_: DataFrame) -> DataFrame:
    """The newest run that isn't over, if any."""
    return runs_.where(~F.col("status").isin(*OVER)).orderBy(F.desc("run_id")).limit(1)


def close_orphans(spark, path: str) -> int:
    """Mark runs that no process works on any more as failed; their number."""
    orphans = [r.run_id for r in runs(spark, path).where(~F.col("status").isin(*OVER)).select("run_id").collect()]  # a few
    for run_id in orphans:
        log_run(spark, path, run_id, "failed", error_message="the process ended before the run did")
    return len(orphans)
