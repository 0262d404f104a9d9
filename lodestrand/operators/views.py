"""Views over results and metrics: matrix, heat map, series, drill-downs, inspector and log states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shade
from .metrics import CONFIG
from .retrieval import RANKINGS, STAGES, SYSTEMS

#: Short names of rankings in stage labels, metrics of drill-downs, the recall that is shaded full.
SHORT = {"cosine": "cos", "indegree": "ind", "cross_encoder": "CE"}
DRILL = ("precision", "recall", "f1", "mrr", "ndcg", "nearness_score")
FULL_RECALL = 0.60


def stage_name(ranking: Column, k: Column) -> Column:
    short = reduce(lambda c, x: c.when(ranking == x, SHORT[x]), RANKINGS[1:], F.when(ranking == RANKINGS[0], SHORT[RANKINGS[0]]))
    return F.concat(short, F.lit("@"), k.cast("string"))


def matrix_rows(ceilings: DataFrame, summary: DataFrame) -> DataFrame:
    """Long pipeline matrix: system, system_order, stage, block, value (recall), precision, f1, pool_size, mrr, ndcg, hit_rate, n_queries, shades."""
    none = F.lit(None).cast("double")
    pools = ceilings.select(
        "system", "stage", F.lit("pool").alias("block"), F.col("mean_recall_ceiling").alias("value"), F.col("mean_precision_ceiling").alias("precision"),
        F.col("mean_f1_ceiling").alias("f1"), F.col("mean_pool_size").alias("pool_size"), none.alias("mrr"), none.alias("ndcg"), none.alias("hit_rate"), "n_queries",
    )
    ranked = summary.select(
        "system", stage_name(F.col("ranking"), F.col("k")).alias("stage"), F.lit("rank").alias("block"), F.col("mean_recall").alias("value"),
        F.col("mean_precision").alias("precision"), F.col("mean_f1").alias("f1"), F.col("k").cast("double").alias("pool_size"), F.col("mean_mrr").alias("mrr"),
        F.col("mean_ndcg").alias("ndcg"), "hit_rate", "n_queries",
    )
    top = F.max("precision").over(Window.partitionBy("block"))
    order = F.array_position(F.array(*map(F.lit, SYSTEMS)), F.col("system"))
    both = pools.unionByName(ranked).withColumn("system_order", F.when(order > 0, order).otherwise(F.lit(len(SYSTEMS) + 1)).cast("int"))
    return both.withColumn("recall_shade", shade(F.col("value"), F.lit(FULL_RECALL))).withColumn("precision_shade", shade(F.col("precision"), top))


def matrix(rows: DataFrame, ks) -> DataFrame:
    """A row a system, a column of recall for each stage, in the order of the pipeline."""
    stages = [*STAGES, *(f"{SHORT[r]}@{k}" for r in RANKINGS for k in sorted(ks))]
    return rows.groupBy("system_order", "system").pivot("stage", stages).agg(F.first("value"))


def heat_map(both: DataFrame, metric: str) -> DataFrame:
    """system, ranking, k and a metric's mean for each language that there is and over all; ``both`` is both_summaries."""
    return both.groupBy(*CONFIG).pivot("language").agg(F.first(f"mean_{metric}"))


def long_heat_map(both: DataFrame, metrics) -> DataFrame:
    """system, ranking, k, language, metric, value, shade by the metric's largest value."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"mean_{m}").alias("value")) for m in metrics))
    rows = both.select(*CONFIG, "language", F.inline(pairs))
    return rows.withColumn("shade", shade(F.col("value"), F.max("value").over(Window.partitionBy("metric"))))


def nearness_series(summary: DataFrame, ranking: str, ks, *, directed: bool = True) -> DataFrame:
    """A row a system, a column of mean nearness for each k."""
    value = "mean_nearness_score" if directed else "mean_nearness_score_undirected"
    return summary.where(F.col("ranking") == ranking).groupBy("system").pivot("k", sorted(ks)).agg(F.first(value))


def drill_ranked(per_query: DataFrame, ranking: str, k: int, systems, queries: DataFrame | None = None, language: str = "all") -> DataFrame:
    """query_id, language, year, n_ground_truth and, for each system, a struct of its metrics at (ranking, k)."""
    if ranking not in RANKINGS:
        raise ValueError(f"no such ranking: {ranking}")
    if int(k) < 1:
        raise ValueError(f"no such cut-off: {k}")
    rows = per_query.where((F.col("ranking") == ranking) & (F.col("k") == k))
    rows = rows.where(F.col("language") == language) if language != "all" else rows
    rows = rows.join(queries.select("query_id"), "query_id", "left_semi") if queries is not None else rows
    values = F.first(F.struct(*(c for c in DRILL if c in rows.columns)))
    return rows.groupBy("query_id", "language", "year", "n_ground_truth").pivot("system", list(systems)).agg(values)


def drill_pool(pool_metrics: DataFrame, systems) -> DataFrame:
    """query_id and, for each system, a struct of its pool's recall and precision."""
    return pool_metrics.groupBy("query_id").pivot("system", list(systems)).agg(F.first(F.struct("recall", "precision")))


def with_delta(drill: DataFrame, metric: str, plus: str = "graph_1hop", minus: str = "emb_1hop") -> DataFrame:
    """The drill-down with the difference of two systems, null if either is missing."""
    if metric not in DRILL:
        raise ValueError(f"no such metric: {metric}")
    if unknown := {plus, minus} - set(drill.columns):
        raise ValueError(f"no such system: {sorted(unknown)}")
    return drill.withColumn("delta", F.col(f"{plus}.{metric}") - F.col(f"{minus}.{metric}"))


def sorted_by(rows: DataFrame, column: str, descending: bool = True, *ties: str) -> DataFrame:
    """Table order: a null counts as the least."""
    one = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()
    return rows.orderBy(one, *ties)


def page(rows: DataFrame, start: int, n: int) -> DataFrame:
    return rows.offset(start).limit(n)


def containing(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows of which one of the columns, as text and lower-cased, contains the needle."""
    tests = (F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower())) for c in columns)
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests)))


def configurations(results: DataFrame) -> DataFrame:
    return results.select(*CONFIG).distinct()


def for_query(rows: DataFrame, query_id: str) -> DataFrame:
    return rows.where(F.col("query_id") == query_id)


def lists(results: DataFrame) -> DataFrame:
    """system, ranking, k, query_id, retrieved (array in rank order)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return results.groupBy(*CONFIG, "query_id").agg(F.transform(ordered, lambda x: x["id"]).alias("retrieved"))


def pool_of(pools: DataFrame, system: str) -> DataFrame:
    """query_id, pool, n_seeds: a system's candidates for each query, seeds first in their order, then the others by id."""
    order = F.array_sort(F.collect_list(F.struct((~F.col("is_seed")).alias("grown"), "seed_rank", "id")))
    return pools.where(F.col("system") == system).groupBy("query_id").agg(F.transform(order, lambda x: x["id"]).alias("pool"), F.count_if("is_seed").alias("n_seeds"))


def comparison(summary: DataFrame, k: int | None = None) -> DataFrame:
    """Rows of a comparison table: by recall, best first; of one cut-off by system and ranking."""
    rows = summary.where(F.col("k") == k) if k is not None else summary
    order = [F.asc("system"), F.asc("ranking")]
    return rows.orderBy(*(order if k is not None else [F.desc("mean_recall"), *order, F.asc("k")]))


def truth_ranks(truth: DataFrame, results: DataFrame, known: DataFrame) -> DataFrame:
    """query_id, id, indexed (metadata there), system, ranking, k, rank: where each list has each cited case.

    A list that hasn't got it gives no row; a case in no list has one row without a configuration.
    """
    there = results.select(*CONFIG, "query_id", "id", "rank")
    return truth.join(there, ["query_id", "id"], "left").join(known.select("id", F.lit(True).alias("indexed")), "id", "left").select(
        "query_id", "id", F.coalesce("indexed", F.lit(False)).alias("indexed"), *CONFIG, "rank"
    )


def inspector_nodes(truth: DataFrame, shown: DataFrame, view: str, cap: int = 300) -> DataFrame:
    """query_id, id, kind: what a query's picture shows, and as what.

    ``shown`` is (query_id, id): the ranked list or the pool. ranked: query, hit, miss, missing_gt. pool:
    query, hit, missing_gt, pool_other; of the others the smallest ids fill up to ``cap``.
    """
    if view not in ("ranked", "pool"):
        raise ValueError(f"no such view: {view}")
    queries = truth.select("query_id").unionByName(shown.select("query_id")).distinct()
    own = queries.select("query_id", F.col("query_id").alias("id"), F.lit(True).alias("q"), F.lit(False).alias("s"), F.lit(False).alias("t"))
    flags = shown.select("query_id", "id", F.lit(False).alias("q"), F.lit(True).alias("s"), F.lit(False).alias("t"))
    flags = flags.unionByName(truth.select("query_id", "id", F.lit(False).alias("q"), F.lit(False).alias("s"), F.lit(True).alias("t"))).unionByName(own)
    merged = flags.groupBy("query_id", "id").agg(F.bool_or("q").alias("q"), F.bool_or("s").alias("s"), F.bool_or("t").alias("t"))
    kind = F.when(F.col("q"), "query").when(F.col("s") & F.col("t"), "hit").when(F.col("t"), "missing_gt").otherwise("miss" if view == "ranked" else "pool_other")
    marked = merged.select("query_id", "id", kind.alias("kind"))
    if view == "ranked":
        return marked
    first = F.when(F.col("kind") == "pool_other", 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(first, "id"))
    return marked.withColumn("n", place).where((F.col("n") <= cap) | (F.col("kind") != "pool_other")).drop("n")


def inspector_counts(pools: DataFrame, truth: DataFrame, system: str, seeds: DataFrame, cap: int = 300) -> DataFrame:
    """query_id, n_pool, n_gt, n_seeds, n_pool_hits, n_gt_via_seed, n_gt_via_expansion_only, pool_truncated."""
    pool = pools.where(F.col("system") == system).select("query_id", "id", F.lit(1).alias("p"))
    rows = pool.join(seeds.select("query_id", "id", F.lit(1).alias("s")), ["query_id", "id"], "full")
    rows = rows.join(truth.select("query_id", "id", F.lit(1).alias("t")), ["query_id", "id"], "full")
    has = lambda *c: reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in c))
    other = F.count_if(has("p") & F.col("t").isNull())
    return rows.groupBy("query_id").agg(
        F.count("p").alias("n_pool"), F.count("t").alias("n_gt"), F.count("s").alias("n_seeds"), F.count_if(has("p", "t")).alias("n_pool_hits"),
        F.count_if(has("s", "t")).alias("n_gt_via_seed"), F.count_if(has("p", "t") & F.col("s").isNull()).alias("n_gt_via_expansion_only"),
        (other > F.greatest(F.lit(0), F.lit(cap - 1) - F.count("t"))).alias("pool_truncated"),
    )


def run_header(per_query: DataFrame, system: str, ranking: str, k: int) -> DataFrame:
    """language, n_queries, n_ground_truth from one configuration."""
    one = per_query.where((F.col("system") == system) & (F.col("ranking") == ranking) & (F.col("k") == k))
    return one.groupBy("language").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n_ground_truth").alias("n_ground_truth"))


def enriched(nodes: DataFrame, degrees_in: DataFrame, degrees_out: DataFrame, meta: DataFrame) -> DataFrame:
    """Nodes with in_degree, out_degree (0 if absent) and their metadata."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = nodes.join(degrees_in, "id", "left").join(degrees_out, "id", "left").join(meta, "id", "left")
    return joined.select(*nodes.columns, zero("in_degree"), zero("out_degree"), *(c for c in meta.columns if c != "id"))


#: The stages of a run and the markers that its log has for them.
RUN_STAGES = ("sample", "retrieval", "metrics")
MARKER = r"=== (?:(SKIP)\s+(\w+)|(\w+)\s+(started|finished|FAILED))"


def log_events(lines: DataFrame) -> DataFrame:
    """run_id, line_no, stage, state of the lines (run_id, line_no, line) that hold a marker."""
    part = [F.regexp_extract("line", MARKER, i) for i in range(5)]
    stage = F.lower(F.when(part[1] == "SKIP", part[2]).otherwise(part[3]))
    state = F.when(part[1] == "SKIP", "skipped").when(part[4] == "started", "running").when(part[4] == "finished", "done").when(part[4] == "FAILED", "failed")
    return lines.select("run_id", "line_no", stage.alias("stage"), state.alias("state")).where(F.col("state").isNotNull() & F.col("stage").isin(*RUN_STAGES))


def stage_states(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """run_id, stage, state of every stage of every run (run_id, status, skip_sample, skip_retrieval, skip_metrics).

    The last marker counts; without one a stage is skipped or pending. A run that is over leaves none pending
    or, if it failed, running.
    """
    last = log_events(lines).groupBy("run_id", "stage").agg(F.max_by("state", "line_no").alias("logged"))
    all_ = runs.select("run_id", "status", F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"skip_{s}").alias("skip")) for s in RUN_STAGES))))
    state = F.coalesce("logged", F.when(F.col("skip"), "skipped").otherwise("pending"))
    failed = F.col("status").isin("failed", "aborted", "interrupted")
    final = (
        F.when((F.col("status") == "done") & (state == "pending"), "done")
        .when(failed & state.isin("pending", "running"), "failed")
        .otherwise(state)
    )
    return all_.join(last, ["run_id", "stage"], "left").select("run_id", "stage", final.alias("state"))


def tail(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The last ``n`` rows, in their order; no more than ``n`` rows meet anywhere."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def recent(runs: DataFrame, n: int, key: str = "run_id") -> DataFrame:
    return runs.orderBy(F.desc(key)).limit(n)
