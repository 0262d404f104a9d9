"""Retrieval metrics: per query, macro averages, ceilings and the layer waterfall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIG = ("system", "ranking", "k")
MEANS = ("precision", "recall", "f1", "mrr", "ndcg", "nearness_score", "nearness_score_undirected")


def _per(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def f1(precision: Column, recall: Column) -> Column:
    return _per(2 * precision * recall, precision + recall)


def ideal_dcg(k: Column, n_truth: Column) -> Column:
    n = F.least(k, n_truth).cast("int")
    gains = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    return F.when(n > 0, gains).otherwise(0.0)


def _marked(results: DataFrame, marks: DataFrame) -> DataFrame:
    """Lists with the columns of ``marks`` (query_id, id without repeats), null where it hasn't got the pair.

    Both are dealt by query, so that counts by list need no further shuffle: a join would deal them by query
    and id, and nearly every row of a list would be counted in another task.
    """
    names = [c for c in marks.columns if c not in ("query_id", "id")]
    lists = results.select(*CONFIG, "query_id", "id", "rank", F.lit(True).alias("listed"))
    known = marks.where("query_id IS NOT NULL AND id IS NOT NULL").withColumn("listed", F.lit(False))
    rows = lists.unionByName(known, allowMissingColumns=True).repartition("query_id")
    pair = Window.partitionBy("query_id", "id")
    return rows.withColumns({c: F.max(c).over(pair) for c in names}).where("listed").drop("listed")


def accuracy(results: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """system, ranking, k, query_id, language, year, n_ground_truth, precision, recall, f1, mrr, dcg, ndcg, n_hits.

    ``results`` has system, ranking, k, query_id, id, rank; ``truth`` (query_id, id) without repeats;
    ``queries`` (query_id, language, year). Results of unknown queries are left out. Precision divides by
    k whatever the list's length; recall and NDCG are 0 without truth.
    """
    marked = _marked(results, truth.select("query_id", "id", F.lit(True).alias("hit")))
    hit = F.coalesce("hit", F.lit(False))
    counted = marked.groupBy(*CONFIG, "query_id").agg(
        F.count_if(hit).alias("n_hits"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(hit, F.lit(1.0) / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    return _scored(counted, truth, queries)


def _scored(counted: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Metrics from counts (n_hits, first, dcg) by list; other columns go along."""
    size = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_ground_truth"))
    more = [c for c in counted.columns if c not in (*CONFIG, "query_id", "n_hits", "first", "dcg")]
    known = counted.join(queries.select("query_id", "language", "year"), "query_id").join(size, "query_id", "left")
    known = known.withColumn("n_ground_truth", F.coalesce("n_ground_truth", F.lit(0)))
    known = known.withColumn("precision", _per(F.col("n_hits"), F.col("k"))).withColumn("recall", _per(F.col("n_hits"), F.col("n_ground_truth")))
    return known.select(
        *CONFIG, "query_id", "language", "year", "n_ground_truth", "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"), "dcg",
        _per(F.col("dcg"), ideal_dcg(F.col("k"), F.col("n_ground_truth"))).alias("ndcg"), "n_hits", *more,
    )


def wanted_distances(results: DataFrame, truth: DataFrame) -> DataFrame:
    """id, target: the pairs whose distance nearness asks for, once each."""
    asked = results.select("query_id", "id").distinct()
    return asked.join(truth.select("query_id", F.col("id").alias("target")), "query_id").select("id", "target").distinct()


def nearness(results: DataFrame, truth: DataFrame, directed: DataFrame, undirected: DataFrame | None = None) -> DataFrame:
    """Per list: nearness_score and its buckets, directed and, where such distances are given, undirected.

    ``directed`` and ``undirected`` (target, id, d) are distances to truth. A member of the truth is at 0
    even where the graph doesn't have it; beyond two hops counts 0. The mean is over the list's length.
    """
    own = truth.select("query_id", "id", F.lit(0).alias("own"))
    wanted = results.select("query_id", "id").distinct().join(truth.select("query_id", F.col("id").alias("target")), "query_id")
    least = None
    for name, table in (("far_out", directed), ("far_any", undirected)):
        if table is None:
            continue
        one = wanted.join(table, ["target", "id"]).groupBy("query_id", "id").agg(F.min("d").alias(name))
        least = one if least is None else least.join(one, ["query_id", "id"], "full")
    joined = _marked(results, own.join(least, ["query_id", "id"], "full"))
    out = F.coalesce("own", "far_out")
    gain = lambda d: F.avg(F.coalesce(F.lit(1.0) / (d + 1), F.lit(0.0)))
    columns = [
        gain(out).alias("nearness_score"), F.count_if(out == 0).alias("n_exact"), F.count_if(out == 1).alias("n_near_1"),
        F.count_if(out == 2).alias("n_near_2"), F.count_if(out.isNull()).alias("n_far"),
    ]
    if undirected is not None:
        any_ = F.coalesce("own", "far_any")
        columns += [
            gain(any_).alias("nearness_score_undirected"), F.count_if(any_ == 1).alias("n_near_1_undirected"),
            F.count_if(any_ == 2).alias("n_near_2_undirected"), F.count_if(any_.isNull()).alias("n_far_undirected"),
        ]
    return joined.groupBy(*CONFIG, "query_id").agg(*columns)


def per_query(results: DataFrame, truth: DataFrame, queries: DataFrame, directed: DataFrame, undirected: DataFrame, hold=lambda df: df) -> DataFrame:
    """Columns of ``accuracy`` and ``nearness``, in one pass over the lists.

    What depends on a query and an id alone, whether it is truth and how far from it, is worked out once for
    each such pair, however many systems, rankings and cut-offs list it. ``hold`` is applied to these pairs.
    """
    pairs = hold(results.select("query_id", "id").distinct())
    wanted = pairs.join(truth.select("query_id", F.col("id").alias("target")), "query_id")
    marks = pairs.join(truth.select("query_id", "id", F.lit(0).alias("own")), ["query_id", "id"], "left")
    for name, table in (("far_out", directed), ("far_any", undirected)):
        marks = marks.join(wanted.join(table, ["target", "id"]).groupBy("query_id", "id").agg(F.min("d").alias(name)), ["query_id", "id"], "left")
    marks = hold(marks.withColumns({"far_out": F.coalesce("own", "far_out"), "far_any": F.coalesce("own", "far_any")}))
    hit, out, any_ = F.col("own").isNotNull(), F.col("far_out"), F.col("far_any")
    gain = lambda d: F.avg(F.coalesce(F.lit(1.0) / (d + 1), F.lit(0.0)))
    counted = _marked(results, marks).where("query_id IS NOT NULL AND id IS NOT NULL").groupBy(*CONFIG, "query_id").agg(
        F.count_if(hit).alias("n_hits"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(hit, F.lit(1.0) / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        gain(out).alias("nearness_score"), F.count_if(out == 0).alias("n_exact"), F.count_if(out == 1).alias("n_near_1"),
        F.count_if(out == 2).alias("n_near_2"), F.count_if(out.isNull()).alias("n_far"), gain(any_).alias("nearness_score_undirected"),
        F.count_if(any_ == 1).alias("n_near_1_undirected"), F.count_if(any_ == 2).alias("n_near_2_undirected"),
        F.count_if(any_.isNull()).alias("n_far_undirected"),
    )
    return _scored(counted, truth, queries)


def _means(rows: DataFrame) -> list[Column]:
    there = [c for c in MEANS if c in rows.columns]
    return [
        *(F.avg(c).alias(f"mean_{c}") for c in there), F.count(F.lit(1)).alias("n_queries"),
        F.avg((F.col("precision") > 0).cast("double")).alias("hit_rate"),
    ]


def summary(per_query: DataFrame) -> DataFrame:
    """Macro averages by configuration; a metric that rows lack (null) is averaged over the others."""
    return per_query.groupBy(*CONFIG).agg(*_means(per_query))


def summary_by_language(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy(*CONFIG, "language").agg(*_means(per_query))


def both_summaries(per_query: DataFrame) -> DataFrame:
    """Both in one pass by grouping sets; the rows over all languages have language 'all'."""
    sets = [[F.col(c) for c in CONFIG], [F.col(c) for c in (*CONFIG, "language")]]
    keys = [F.col(c) for c in (*CONFIG, "language")]
    got = per_query.groupingSets(sets, *keys).agg(F.grouping("language").alias("_all"), *_means(per_query))
    return got.withColumn("language", F.when(F.col("_all") == 1, "all").otherwise(F.col("language"))).drop("_all")


def pool_metrics(pools: DataFrame, truth: DataFrame) -> DataFrame:
    """system, query_id, pool_size, hits, gt_size, recall, precision, f1 of every pool; 0 without truth."""
    size = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("gt_size"))
    marked = pools.join(truth.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    counted = marked.groupBy("system", "query_id").agg(F.count(F.lit(1)).alias("pool_size"), F.count("hit").alias("hits"))
    return _ratios(counted.join(size, "query_id", "left").withColumn("gt_size", F.coalesce("gt_size", F.lit(0))))


def _ratios(counted: DataFrame) -> DataFrame:
    got = counted.withColumn("recall", _per(F.col("hits"), F.col("gt_size"))).withColumn("precision", _per(F.col("hits"), F.col("pool_size")))
    return got.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def recall_ceiling(pool_metrics_: DataFrame) -> DataFrame:
    """By system, over queries with truth."""
    return pool_metrics_.where("gt_size > 0").groupBy("system").agg(
        F.avg("recall").alias("recall_ceiling"), F.avg("precision").alias("precision_ceiling"), F.avg("f1").alias("f1_ceiling"),
        F.avg("pool_size").alias("mean_pool_size"), F.count(F.lit(1)).alias("n_queries"),
    )


def layer_ceilings(layers: DataFrame, truth: DataFrame) -> DataFrame:
    size = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("gt_size"))
    return _ratios(layers.join(size, "query_id")).groupBy("system", "stage").agg(
        F.min("stage_order").alias("stage_order"), F.avg("recall").alias("mean_recall_ceiling"),
        F.avg("precision").alias("mean_precision_ceiling"), F.avg("f1").alias("mean_f1_ceiling"),
        F.avg("pool_size").alias("mean_pool_size"), F.count(F.lit(1)).alias("n_queries"),
    )


def waterfall(ceilings: DataFrame) -> DataFrame:
    """Layer ceilings with the change of recall and size since the stage before."""
    order = Window.partitionBy("system").orderBy("stage_order")
    change = lambda c: (F.col(c) - F.lag(c).over(order))
    return ceilings.select("*", change("mean_recall_ceiling").alias("recall_delta"), change("mean_pool_size").alias("size_delta"))


def id_difference(ours: DataFrame, theirs: DataFrame, tolerance: int = 5) -> DataFrame:
    """One row: extra, missing, differing and whether they are within the tolerance; inputs are (query_id)."""
    a = ours.select("query_id", F.lit(1).alias("a")).distinct()
    b = theirs.select("query_id", F.lit(1).alias("b")).distinct()
    n = lambda c: F.count_if(F.col(c).isNull())
    return a.join(b, "query_id", "full").agg(n("b").alias("extra"), n("a").alias("missing")).select(
        "extra", "missing", (F.col("extra") + F.col("missing")).alias("differing"), (F.col("extra") + F.col("missing") <= tolerance).alias("reusable")
    )
