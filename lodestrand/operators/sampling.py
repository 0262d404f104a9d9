"""Query sampling: valid ids, candidates with reasons, stratified samples, ground truth and its losses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import CASE

#: The strata, queries for each, and the seed.
LANGUAGES, PER_LANGUAGE, SEED = ("de", "fr", "it"), 4226, 42
#: Why a candidate is left out, in the order in which the tests are made.
REASONS = ("metadata", "language", "date", "graph", "facts", "ground_truth", "kept")


def shuffled(key: Column, seed: int | str) -> Column:
    """A random order that is the same everywhere: digests of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key))


def valid_ids(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """id: in the vector store and a ruling of the graph."""
    return points.select("id").distinct().join(nodes.where(F.col("source") == "ruling").select("id"), "id", "left_semi")


def valid_ids_difference(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: in_both, only_store, only_graph."""
    a = points.select("id", F.lit(1).alias("a")).distinct()
    b = nodes.where(F.col("source") == "ruling").select("id", F.lit(1).alias("b")).distinct()
    return a.join(b, "id", "full").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"),
        F.count_if(F.col("b").isNull()).alias("only_store"), F.count_if(F.col("a").isNull()).alias("only_graph"),
    )


def metadata(points: DataFrame) -> DataFrame:
    """id, date_ms (0: unknown), language (lower case, ? if unknown), court from first chunks."""
    return points.where(F.col("chunk_index") == 0).groupBy("id").agg(
        F.min(F.coalesce("date_ms", F.lit(0))).cast("long").alias("date_ms"),
        F.min(F.coalesce(F.lower("language"), F.lit("?"))).alias("language"), F.min(F.coalesce("court", F.lit(""))).alias("court"),
    )


def ground_truth(edges: DataFrame, valid: DataFrame, meta: DataFrame, kind: str = CASE) -> DataFrame:
    """query_id, id: rulings cited that are valid, dated, and earlier than the dated ruling that cites them."""
    dated = meta.where(F.col("date_ms") > 0).select("id", "date_ms").join(valid, "id", "left_semi")
    own = dated.select(F.col("id").alias("src"), F.col("date_ms").alias("at"))
    cited = dated.select(F.col("id").alias("dst"), "date_ms")
    cases = edges.where(F.col("type") == kind)
    return cases.join(own, "src").join(cited, "dst").where("date_ms < at").select(F.col("src").alias("query_id"), F.col("dst").alias("id"))


def candidates(valid: DataFrame, meta: DataFrame, nodes: DataFrame, facts: DataFrame | None, truth: DataFrame, languages=LANGUAGES) -> DataFrame:
    """id, language, date_ms, reason: the first test that a valid id fails, or kept. ``facts`` None: no such test."""
    facts = valid.select("id", F.lit("any").alias("facts")) if facts is None else facts
    joined = (
        valid.join(meta.select("id", "language", "date_ms", F.lit(1).alias("m")), "id", "left")
        .join(nodes.select("id", F.lit(1).alias("g")), "id", "left")
        .join(facts.where(F.trim(F.coalesce("facts", F.lit(""))) != "").select("id", F.lit(1).alias("f")).distinct(), "id", "left")
        .join(truth.select(F.col("query_id").alias("id"), F.lit(1).alias("t")).distinct(), "id", "left")
    )
    reason = (
        F.when(F.col("m").isNull(), "metadata")
        .when(~F.col("language").isin(*languages), "language")
        .when(F.coalesce("date_ms", F.lit(0)) <= 0, "date")
        .when(F.col("g").isNull(), "graph")
        .when(F.col("f").isNull(), "facts")
        .when(F.col("t").isNull(), "ground_truth")
        .otherwise("kept")
    )
    return joined.select("id", "language", "date_ms", reason.alias("reason"))


def reason_counts(candidates_: DataFrame) -> DataFrame:
    return candidates_.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def pool_sizes(candidates_: DataFrame) -> DataFrame:
    """Candidates that are kept, by language (the run form asks for no facts: candidates with ``facts`` None)."""
    return candidates_.where("reason = 'kept'").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def stratified(kept: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> DataFrame:
    """id, language, date_ms, pos: up to ``per_language`` of each language, all in one shuffled order.

    Strata and the whole are ordered by digests, so a sample doesn't depend on partitioning; a stratum is
    cut by a window limit in each task before its rows meet.
    """
    place = F.row_number().over(Window.partitionBy("language").orderBy(shuffled(F.col("id"), seed), "id"))
    taken = kept.withColumn("n", place).where(F.col("n") <= per_language).drop("n")
    return taken.withColumn("pos", F.row_number().over(Window.orderBy(shuffled(F.col("id"), f"{seed}:all"), "id")))  # the sample only


def records(sample: DataFrame, truth: DataFrame, laws: DataFrame, facts: DataFrame, year: Column, text: Column) -> DataFrame:
    """Query records: query_id, query_text, ground_truth_cases, ground_truth_laws, language, year, date_ms."""
    cases = truth.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("ground_truth_cases"))
    cited = laws.groupBy(F.col("src").alias("query_id")).agg(F.array_sort(F.collect_set("dst")).alias("ground_truth_laws"))
    named = sample.withColumnRenamed("id", "query_id")
    return (
        named.join(cases, "query_id")
        .join(cited, "query_id", "left")
        .join(facts.withColumnRenamed("id", "query_id"), "query_id", "left")
        .select(
            "query_id", text.alias("query_text"), "ground_truth_cases",
            F.coalesce("ground_truth_laws", F.array().cast("array<string>")).alias("ground_truth_laws"), "language", year.alias("year"), "date_ms",
        )
    )


def language_slice(queries: DataFrame, total: int, order: str = "pos", languages=LANGUAGES) -> DataFrame:
    """The first ``total // languages`` of each language."""
    place = F.row_number().over(Window.partitionBy("language").orderBy(order))
    each = total // len(languages)
    return queries.where(F.col("language").isin(*languages)).withColumn("_n", place).where(F.col("_n") <= each).drop("_n")


def query_stats(queries: DataFrame, truth: DataFrame, valid: DataFrame, languages=LANGUAGES, laws: DataFrame | None = None) -> DataFrame:
    """language, n, share, mean_cases, mean_laws, year_min, year_max (unknown years aside), n_verified: all truth valid, and some there.

    ``laws`` is (query_id, id) of cited laws; without it their mean is 0.
    """
    bad = truth.join(valid, "id", "left_anti").select("query_id").distinct().withColumn("bad", F.lit(1))
    count = lambda rows, name: rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    rows = queries.join(count(truth, "n_gt"), "query_id", "left").join(bad, "query_id", "left")
    rows = rows.join(count(laws, "n_laws"), "query_id", "left") if laws is not None else rows.withColumn("n_laws", F.lit(0))
    year = F.when(F.col("year") > 0, F.col("year"))
    by = rows.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("n_gt", F.lit(0))).alias("mean_cases"), F.avg(F.coalesce("n_laws", F.lit(0))).alias("mean_laws"),
        F.min(year).alias("year_min"), F.max(year).alias("year_max"),
        F.count_if((F.coalesce("n_gt", F.lit(0)) > 0) & F.col("bad").isNull()).alias("n_verified"),
    )
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def largest_stratified(counts: dict[str, int], languages=LANGUAGES) -> int:
    return min((counts.get(x, 0) for x in languages), default=0) * len(languages)


@dataclass(frozen=True)
class RunPlan:
    """What a run asks for: queries in all, queries to sample in each language, and whether those at hand will do."""

    queries: int
    sample_each: int
    reuse: bool


def run_plan(wanted: int, *, available: dict[str, int], at_hand: dict[str, int], may_reuse: bool, languages=LANGUAGES) -> RunPlan:
    """A run's size: the same number of queries in every language, as many as wanted but no more than are available in each.

    Queries at hand are used again if that is allowed and every language has enough of them; else all are sampled anew.
    """
    each = min([max(0, int(wanted or 0)) // len(languages), *(available.get(x, 0) for x in languages)])
    reuse = may_reuse and all(at_hand.get(x, 0) >= each for x in languages)
    return RunPlan(each * len(languages), 0 if reuse else each, reuse)


def truth_breakdown(sample: DataFrame, cases: DataFrame, valid: DataFrame, meta: DataFrame) -> DataFrame:
    """query_id, id, reason of every cited case of sampled queries: kept, not_in_VG, date_missing, temporal_fail, other.

    ``cases`` is (query_id, id). kept comes first, the others in the order given.
    """
    own = sample.select(F.col("id").alias("query_id"), F.col("date_ms").alias("at"))
    rows = (
        cases.join(own, "query_id")
        .join(valid.select("id", F.lit(1).alias("v")), "id", "left")
        .join(meta.select("id", F.when(F.col("date_ms") > 0, F.col("date_ms")).alias("date_ms")), "id", "left")
    )
    reason = (
        F.when(F.col("v").isNotNull() & (F.col("date_ms") < F.col("at")), "kept")
        .when(F.col("v").isNull(), "not_in_VG")
        .when(F.col("date_ms").isNull(), "date_missing")
        .when(F.col("date_ms") >= F.col("at"), "temporal_fail")
        .otherwise("other")
    )
    return rows.select("query_id", "id", reason.alias("reason"))


def breakdown_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def breakdown_means(rows: DataFrame) -> DataFrame:
    """One row: mean cited cases a query, before and after the filter."""
    by = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("reason") == "kept").alias("after"))
    return by.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"))


def cosine_delta(vectors: DataFrame, truth: DataFrame, *, n_queries: int = 200, n_random: int = 20, pool: int = 400, seed: int = SEED, similarity=None) -> tuple[DataFrame, DataFrame]:
    """(per query: query_id, mean_cited, mean_random, delta; one row: n, mean, median, stdev, min, max of delta).

    Random partners come from one global random pool of ``pool`` ids, ``n_random`` for each query, without
    itself and what it cites. ``vectors`` is (id, vector); ``similarity`` makes a column from two.
    """
    asked = truth.select("query_id").distinct().orderBy(shuffled(F.col("query_id"), seed), "query_id").limit(n_queries)
    drawn = vectors.select("id").distinct().orderBy(shuffled(F.col("id"), seed + 1), "id").limit(pool)
    cited = truth.join(asked, "query_id", "left_semi").select("query_id", "id", F.lit("cited").alias("kind"))
    # both sides are bounded by the parameters
    pairs = asked.crossJoin(drawn).where("query_id <> id").join(cited, ["query_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(shuffled(F.concat_ws(":", "query_id", "id"), seed), "id"))
    drawn_pairs = pairs.withColumn("n", place).where(F.col("n") <= n_random).select("query_id", "id", F.lit("random").alias("kind"))
    own = vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("a"))
    scored = cited.unionByName(drawn_pairs).join(own, "query_id").join(vectors.withColumnRenamed("vector", "b"), "id")
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("s")))
    by = scored.select("query_id", "kind", similarity(F.col("a"), F.col("b")).alias("s")).groupBy("query_id").agg(mean("cited").alias("mean_cited"), mean("random").alias("mean_random"))
    by = by.where("mean_cited IS NOT NULL AND mean_random IS NOT NULL").withColumn("delta", F.col("mean_cited") - F.col("mean_random"))
    whole = by.agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), F.median("delta").alias("median"),
        F.stddev_samp("delta").alias("stdev"), F.min("delta").alias("min"), F.max("delta").alias("max"),
    )
    return by, whole
