"""All queries by name: how the engine answers each, and the SQL that it is held against.

An entry's ``columns`` says what both sides return: ``name`` as it is, ``name:i`` as BIGINT, ``name:f`` as
a double rounded to six places, ``name:g`` as a double that is rounded already.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, metrics, retrieval, sampling, vectors, views
from ..sources import readers, sinks
from ..sources.checkpoints import shared_folder
from ..streaming import progress
from .oracles import with_relations
from .world import STRATA, World


#: Added before rounding down. A little over a half: means of few values often lie at a half, and engines that
#: add in another order then fall on either side of it.
HALF = 0.5001


@dataclass(frozen=True)
class Entry:
    columns: str
    make: Callable[[World], DataFrame]
    sql: str | None  # what follows FROM

    def query(self, world: World) -> DataFrame:
        got = self.make(world)
        return got.select(*(self._column(c) for c in self.columns.split()))

    def _column(self, spec: str):
        name, _, kind = spec.partition(":")
        one = F.col(f"`{name}`")
        return {"": one, "i": one.cast("long"), "f": F.floor(one.cast("double") * F.lit(1e6) + F.lit(HALF)) / F.lit(1e6), "g": one.cast("double")}[kind].alias(name)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        parts = []
        for spec in self.columns.split():
            name, _, kind = spec.partition(":")
            parts.append({"": f'"{name}"', "i": f'"{name}"::BIGINT AS "{name}"', "f": f'floor("{name}"::DOUBLE * 1e6::DOUBLE + {HALF}::DOUBLE) / 1e6::DOUBLE AS "{name}"', "g": f'"{name}"::DOUBLE AS "{name}"'}[kind])
        return with_relations(f"SELECT {', '.join(parts)} FROM {self.sql}")


ENTRIES: dict[str, Entry] = {}


def entry(name: str, columns: str, sql: str | None = None):
    def add(make: Callable[[World], DataFrame]):
        ENTRIES[name] = Entry(columns, make, sql)
        return make

    return add


def expect(name: str, columns: str, make: Callable[[World], DataFrame], sql: str | None = None) -> None:
    ENTRIES[name] = Entry(columns, make, sql)


# Graph ----------------------------------------------------------------------------------------------
expect("graph_nodes", "id source", lambda w: w.nodes, "nodes")
expect("graph_edges_dedup", "src dst type", lambda w: w.edges, "edges")
expect("graph_build_counts", "rows:i case_edges:i law_edges:i skipped:i rejected:i", lambda w: graph.build_counts(w.source_rows, w.cited),
    "(SELECT (SELECT count(DISTINCT l_orderkey) FROM lines) AS rows, count_if(src <> dst AND dst <> '' AND type = 'case_to_case') AS case_edges, count_if(src <> dst AND dst <> '' AND type = 'case_to_law') AS law_edges, count_if(src = dst OR dst = '') AS skipped, 0 AS rejected FROM cited)")
expect("graph_source_counts", "source n:i", lambda w: graph.source_counts(w.nodes), "(SELECT source, count(*) AS n FROM nodes GROUP BY source)")
expect("in_degree", "id in_degree:i", lambda w: w.degree, "degree")
expect("out_degree", "id out_degree:i", lambda w: graph.out_degree(w.edges), "(SELECT src AS id, count(*) AS out_degree FROM edges GROUP BY src)")
expect("graph_stats", "n_nodes:i n_edges:i mean_in_degree:f mean_out_degree:f", lambda w: graph.stats(w.nodes, w.edges),
    "(SELECT n AS n_nodes, e AS n_edges, e / n AS mean_in_degree, e / n AS mean_out_degree FROM (SELECT count(*)::DOUBLE AS n FROM nodes), (SELECT count(*)::DOUBLE AS e FROM edges))")
expect("typed_successors", "src dst", lambda w: graph.successors(w.edges, graph.LAW), "(SELECT src, dst FROM edges WHERE type = 'case_to_law')")
for _hop, _c in (("graph_1hop", "g1"), ("graph_2hop", "g2")):
    expect(f"{_hop}_raw", "query_id id", lambda w, h=_hop: w.found.stages(h)["raw"], f"{_c}_raw")
    expect(f"{_hop}_timely", "query_id id", lambda w, h=_hop: w.found.stages(h)["post_temporal"], f"{_c}_timely")
    expect(f"{_hop}_pool", "query_id id", lambda w, h=_hop: w.found.stages(h)["post_cap"], f"{_c}_cap")
expect("induced_edges", "src dst type", lambda w: graph.induced(w.edges, w.truth.select(F.col("id"))), "(SELECT * FROM edges WHERE src IN (SELECT id FROM truth) AND dst IN (SELECT id FROM truth))")
for _name, _directed, _hops in (("bfs_directed_2", True, "hops_out"), ("bfs_undirected_2", False, "hops_any")):
    expect(_name, "target id d:i", lambda w, x=_directed: graph.distances_between(w.edges, w.seed_targets, directed=x),
        f"(SELECT * FROM {_hops} WHERE (id, target) IN (SELECT (s.id, t.id) FROM seeds s JOIN truth t USING (query_id)))")
expect("top_cited_nodes", "id place:i", lambda w: graph.top_cited(w.edges, 30, 5, 60)[0], "top_nodes")
expect("top_cited_subgraph", "src dst type", lambda w: graph.top_cited(w.edges, 30, 5, 60)[1],
    """(SELECT DISTINCT src, dst, type FROM (SELECT src, dst, type FROM top_citers UNION ALL SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM top_seeds) AND dst IN (SELECT id FROM top_seeds))
       WHERE src IN (SELECT id FROM top_nodes) AND dst IN (SELECT id FROM top_nodes))""")  # fmt: skip
expect("focus_subgraph", "id place:i", lambda w: graph.around_node(w.edges, "33", 12)[0],
    """(SELECT '33' AS id, 1 AS place UNION ALL SELECT id, 1 + row_number() OVER (ORDER BY part, id) AS place FROM (SELECT id, part FROM (
       SELECT CASE WHEN dst = '33' THEN src ELSE dst END AS id, min(CASE WHEN dst = '33' THEN 1 ELSE 2 END) AS part FROM edges WHERE src = '33' OR dst = '33' GROUP BY 1) ORDER BY part, id LIMIT 11))""")  # fmt: skip
expect("focus_subgraph_edges", "src dst type", lambda w: graph.around_node(w.edges, "33", 12)[1],
    """(WITH shown AS (SELECT '33' AS id UNION ALL SELECT id FROM (SELECT CASE WHEN dst = '33' THEN src ELSE dst END AS id, min(CASE WHEN dst = '33' THEN 1 ELSE 2 END) AS part
       FROM edges WHERE src = '33' OR dst = '33' GROUP BY 1 ORDER BY part, id LIMIT 11)) SELECT src, dst, type FROM edges WHERE (src = '33' OR dst = '33') AND src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown))""")  # fmt: skip
expect("enriched_nodes", "id source in_degree:i out_degree:i language", lambda w: views.enriched(w.nodes, w.degree, graph.out_degree(w.edges), w.meta),
    """(SELECT n.id, n.source, coalesce(d.in_degree, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, m.language FROM nodes n LEFT JOIN degree d ON d.id = n.id
       LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = n.id LEFT JOIN meta m ON m.id = n.id)""")  # fmt: skip

# Vectors --------------------------------------------------------------------------------------------
expect("seed_topk_cosine", "query_id id score:g seed_rank:i", lambda w: w.found.seeds, "seeds")
expect("seed_topk_smart", "query_id id score:g seed_rank:i", lambda w: w.found.smart, "smart")


@entry("knn_docs", "query_id id score:g", "(SELECT node AS query_id, id, max(score) AS score FROM knn WHERE rank <= 10 GROUP BY node, id)")
def _knn(w: World) -> DataFrame:
    asked = w.rulings.where("chunk_index = 0").select(F.col("id").alias("query_id"), F.col("id").alias("node"), F.lit(10).alias("depth"))
    return vectors.neighbours_of(asked, w.rulings)


@entry("cosine_pairs", "query_id id score:f", "(SELECT t.query_id, t.id, list_cosine_similarity(a.vector, b.vector) AS score FROM truth t JOIN corpus a ON a.id = t.query_id JOIN corpus b ON b.id = t.id)")
def _pairs(w: World) -> DataFrame:
    a = w.corpus.select(F.col("id").alias("query_id"), F.col("vector").alias("a"))
    b = w.corpus.select("id", F.col("vector").alias("b"))
    return w.truth.join(a, "query_id").join(b, "id").select("query_id", "id", vectors.cosine(F.col("a"), F.col("b")).alias("score"))


for _hop, _c in (("emb_1hop", "e1"), ("emb_2hop", "e2")):
    expect(f"{_hop}_raw", "query_id id score:g", lambda w, h=_hop: w.found.stages(h)["raw"], f"{_c}_raw")
    expect(f"{_hop}_timely", "query_id id score:g", lambda w, h=_hop: w.found.stages(h)["post_temporal"], f"{_c}_timely")
    expect(f"{_hop}_pool", "query_id id score:g", lambda w, h=_hop: w.found.stages(h)["post_cap"], f"{_c}_cap")
expect("emb_2hop_timely", "query_id id score:g", lambda w: w.found.emb_2hop_whole(), "e2_whole_timely")  # all of both hops: pools alone are capped
expect("vectors_of_first_chunks", "id n:i", lambda w: w.rulings.where("chunk_index = 0").join(w.truth.select("id").distinct(), "id", "left_semi").select("id", F.size("vector").alias("n")),
    "(SELECT id, len(vector) AS n FROM rulings WHERE chunk_index = 0 AND id IN (SELECT id FROM truth))")

# Sampling -------------------------------------------------------------------------------------------
expect("valid_ids", "id", lambda w: w.valid, "valid")
expect("valid_ids_diff", "in_both:i only_store:i only_graph:i", lambda w: sampling.valid_ids_difference(w.rulings, w.nodes),
    """(SELECT count_if(a IS NOT NULL AND b IS NOT NULL) AS in_both, count_if(b IS NULL) AS only_store, count_if(a IS NULL) AS only_graph
       FROM (SELECT DISTINCT id AS a FROM rulings) FULL JOIN (SELECT id AS b FROM nodes WHERE source = 'ruling') ON a = b)""")  # fmt: skip
expect("decision_metadata", "id date_ms:i language court", lambda w: w.meta, "meta")
expect("ground_truth", "query_id id", lambda w: w.truth, "truth")
expect("candidate_pool", "id language date_ms:i reason", lambda w: w.candidates, "candidates")
expect("skip_reasons", "reason n:i", lambda w: sampling.reason_counts(w.candidates), "(SELECT reason, count(*) AS n FROM candidates GROUP BY reason)")
expect("candidate_pool_sizes", "language n:i", lambda w: sampling.pool_sizes(sampling.candidates(w.valid, w.meta, w.nodes, None, w.truth, STRATA)),
    "(SELECT language, count(*) AS n FROM candidates WHERE reason IN ('kept', 'facts') AND id IN (SELECT query_id FROM truth) GROUP BY language)")
expect("stratified_sample", "id language date_ms:i pos:i", lambda w: w.sample, "sample")


@entry("query_records", "query_id query_text cases laws language year:i date_ms:i",
    """(SELECT s.id AS query_id, array_to_string(list_filter(regexp_split_to_array(f.facts, '\\s+'), lambda x: x <> '')[1:40], ' ') AS query_text,
       (SELECT string_agg(t.id, ',' ORDER BY t.id) FROM truth t WHERE t.query_id = s.id) AS cases, coalesce((SELECT string_agg(e.dst, ',' ORDER BY e.dst) FROM edges e WHERE e.src = s.id AND e.type = 'case_to_law'), '') AS laws,
       s.language, year(make_timestamp(s.date_ms * 1000)) AS year, s.date_ms FROM sample s JOIN facts f ON f.id = s.id)""")  # fmt: skip
def _records(w: World) -> DataFrame:
    made = sampling.records(w.sample, w.truth, graph.successors(w.edges, graph.LAW), w.facts, text.year_of_ms(F.col("date_ms")), text.truncate_tokens(F.col("facts"), 40))
    return made.withColumns({"cases": F.array_join("ground_truth_cases", ","), "laws": F.array_join("ground_truth_laws", ",")})


expect("language_slice", "id language pos:i", lambda w: sampling.language_slice(w.sample, 20, languages=STRATA),
    "(SELECT id, language, pos FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY pos) AS n FROM sample) WHERE n <= 6)")
_laws = lambda w: graph.successors(w.edges, graph.LAW).select(F.col("src").alias("query_id"), F.col("dst").alias("id"))
expect("query_stats", "language n:i share:f mean_cases:f mean_laws:f year_min:i year_max:i n_verified:i", lambda w: sampling.query_stats(w.queries, w.truth, w.valid, STRATA, _laws(w)),
    """(SELECT language, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, avg(gt_size) AS mean_cases, avg(coalesce(laws, 0)) AS mean_laws, min(year) AS year_min, max(year) AS year_max, count(*) AS n_verified
       FROM queries JOIN tsize USING (query_id) LEFT JOIN (SELECT src, count(*) AS laws FROM edges WHERE type = 'case_to_law' GROUP BY src) ON src = query_id GROUP BY language)""")  # fmt: skip
_cases = lambda w: graph.successors(w.edges, graph.CASE).select(F.col("src").alias("query_id"), F.col("dst").alias("id"))
expect("gt_breakdown_rows", "query_id id reason", lambda w: sampling.truth_breakdown(w.sample, _cases(w), w.valid, w.meta), "breakdown")
expect("gt_breakdown", "reason n:i share:f", lambda w: sampling.breakdown_counts(sampling.truth_breakdown(w.sample, _cases(w), w.valid, w.meta)),
    "(SELECT reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM breakdown GROUP BY reason)")
expect("gt_breakdown_means", "n_queries:i mean_before:f mean_after:f", lambda w: sampling.breakdown_means(sampling.truth_breakdown(w.sample, _cases(w), w.valid, w.meta)),
    "(SELECT count(*) AS n_queries, avg(b) AS mean_before, avg(a) AS mean_after FROM (SELECT query_id, count(*) AS b, count_if(reason = 'kept') AS a FROM breakdown GROUP BY query_id))")
_delta = lambda w: sampling.cosine_delta(w.corpus.select("id", "vector"), w.truth, similarity=vectors.cosine)
expect("cosine_delta_queries", "query_id mean_cited:f mean_random:f delta:f", lambda w: _delta(w)[0], "deltas")
expect("cosine_delta", "n:i mean:f median:f stdev:f min:f max:f", lambda w: _delta(w)[1],
    "(SELECT count(*) AS n, avg(delta) AS mean, median(delta) AS median, stddev_samp(delta) AS stdev, min(delta) AS min, max(delta) AS max FROM deltas)")

# Rankings and pools ---------------------------------------------------------------------------------
for _r in retrieval.RANKINGS:
    expect(f"rank_{_r}", "system query_id id value:g rank:i", lambda w, r=_r: w.ranked(r), f"(SELECT * FROM ranked WHERE ranking = '{_r}')")
expect("candidate_pools", "system query_id id score:g is_seed seed_rank:i", lambda w: w.found.pools(), "pools")
expect("pair_scores", "query_id id pair_score:f", lambda w: w.scores, "scores")
expect("topk_prefix", "system ranking k:i query_id id rank:i", lambda w: w.results, "results")
expect("derived_smaller_k", "system ranking k:i query_id id rank:i", lambda w: retrieval.derive_smaller(w.results.drop("value").where("k IN (10, 20)"), w.settings.ks), "results")
expect("pool_union_dedup", "query_id id system score:g", lambda w: retrieval.first_of_union(w.found.pools()),
    """(SELECT query_id, id, arg_min(system, o) AS system, arg_min(score, o) AS score FROM (SELECT *, list_position(['rag', 'rag_smart', 'emb_1hop', 'emb_2hop', 'graph_1hop', 'graph_2hop'], system) AS o FROM pools)
       GROUP BY query_id, id)""")  # fmt: skip

# Metrics --------------------------------------------------------------------------------------------
_list = "system ranking k:i query_id"
for _name, _m in (("precision_at_k", "precision"), ("recall_at_k", "recall"), ("f1_at_k", "f1"), ("mrr", "mrr"), ("dcg_at_k", "dcg"), ("ndcg_at_k", "ndcg")):
    expect(_name, f"{_list} language year:i n_ground_truth:i {_m}:f", lambda w: w.accuracy, "accuracy")
expect("hit_rate", "system ranking k:i hit_rate:f", lambda w: metrics.summary(w.accuracy), "(SELECT system, ranking, k, avg((n_hits > 0)::INT) AS hit_rate FROM accuracy GROUP BY ALL)")
expect("graph_nearness_directed", f"{_list} nearness_score:f", lambda w: w.nearness_directed, "nearness")
expect("graph_nearness_undirected", f"{_list} nearness_score_undirected:f", lambda w: w.nearness, "nearness")
expect("nearness_buckets", f"{_list} n_exact:i n_near_1:i n_near_2:i n_far:i n_near_1_undirected:i n_near_2_undirected:i n_far_undirected:i", lambda w: w.nearness, "nearness")
_means = "mean_precision:f mean_recall:f mean_f1:f mean_mrr:f mean_ndcg:f mean_nearness_score:f mean_nearness_score_undirected:f n_queries:i hit_rate:f"
expect("summary", f"system ranking k:i {_means}", lambda w: metrics.summary(w.per_query), "summary")
expect("summary_by_language", f"system ranking k:i language {_means}", lambda w: metrics.both_summaries(w.per_query), "by_language")
expect("pool_metrics_per_query", "system query_id pool_size:i hits:i gt_size:i recall:f precision:f f1:f", lambda w: w.pool_metrics, "pool_metrics")
expect("recall_ceiling", "system recall_ceiling:f precision_ceiling:f f1_ceiling:f mean_pool_size:f n_queries:i", lambda w: metrics.recall_ceiling(w.pool_metrics),
    "(SELECT system, avg(recall) AS recall_ceiling, avg(precision) AS precision_ceiling, avg(f1) AS f1_ceiling, avg(pool_size) AS mean_pool_size, count(*) AS n_queries FROM pool_metrics WHERE gt_size > 0 GROUP BY system)")
expect("layer_traces", "system query_id stage stage_order:i pool_size:i hits:i", lambda w: w.layers, "layers")
_layer = "system stage stage_order:i mean_recall_ceiling:f mean_precision_ceiling:f mean_f1_ceiling:f mean_pool_size:f n_queries:i"
expect("layers_waterfall", _layer, lambda w: metrics.layer_ceilings(w.layers, w.truth), "layer_ceilings")
expect("waterfall_delta", "system stage recall_delta:f size_delta:f", lambda w: metrics.waterfall(metrics.layer_ceilings(w.layers, w.truth)),
    """(SELECT system, stage, mean_recall_ceiling - lag(mean_recall_ceiling) OVER o AS recall_delta, mean_pool_size - lag(mean_pool_size) OVER o AS size_delta
       FROM layer_ceilings WINDOW o AS (PARTITION BY system ORDER BY stage_order))""")  # fmt: skip
expect("qid_set_diff", "extra:i missing:i differing:i reusable", lambda w: metrics.id_difference(w.truth.select("query_id"), w.sample.select(F.col("id").alias("query_id"))),
    """(SELECT *, extra + missing AS differing, extra + missing <= 5 AS reusable FROM (SELECT count_if(b IS NULL) AS extra, count_if(a IS NULL) AS missing
       FROM (SELECT DISTINCT query_id AS a FROM truth) FULL JOIN (SELECT id AS b FROM sample) ON a = b))""")  # fmt: skip

# Views ----------------------------------------------------------------------------------------------
_short = "CASE ranking WHEN 'cosine' THEN 'cos' WHEN 'indegree' THEN 'ind' ELSE 'CE' END || '@' || k"
_rows = """(SELECT *, list_position(['rag', 'rag_smart', 'emb_1hop', 'emb_2hop', 'graph_1hop', 'graph_2hop'], system) AS system_order, least(1, value / 0.6) AS recall_shade,
    CASE WHEN max(precision) OVER (PARTITION BY block) > 0 THEN least(1, precision / max(precision) OVER (PARTITION BY block)) ELSE 0 END AS precision_shade FROM (
    SELECT system, stage, 'pool' AS block, mean_recall_ceiling AS value, mean_precision_ceiling AS precision, mean_f1_ceiling AS f1, mean_pool_size AS pool_size, NULL::DOUBLE AS mrr, NULL::DOUBLE AS ndcg, NULL::DOUBLE AS hit_rate, n_queries FROM layer_ceilings
    UNION ALL SELECT system, """ + _short + ", 'rank', mean_recall, mean_precision, mean_f1, k, mean_mrr, mean_ndcg, hit_rate, n_queries FROM summary))"
_matrix_rows = lambda w: views.matrix_rows(metrics.layer_ceilings(w.layers, w.truth), metrics.summary(w.per_query))
expect("pipeline_matrix_rows", "system system_order:i stage block value:f precision:f f1:f pool_size:f mrr:f ndcg:f hit_rate:f n_queries:i recall_shade:f precision_shade:f", _matrix_rows, _rows)
expect("pipeline_matrix", "system system_order:i seeds:f raw:f post_temporal:f post_cap:f cos@5:f cos@10:f cos@15:f cos@20:f ind@5:f ind@10:f ind@15:f ind@20:f CE@5:f CE@10:f CE@15:f CE@20:f", lambda w: views.matrix(_matrix_rows(w), w.settings.ks),
    "(PIVOT " + _rows + " ON stage IN ('seeds', 'raw', 'post_temporal', 'post_cap', 'cos@5', 'cos@10', 'cos@15', 'cos@20', 'ind@5', 'ind@10', 'ind@15', 'ind@20', 'CE@5', 'CE@10', 'CE@15', 'CE@20') USING any_value(value) GROUP BY system_order, system)")
expect("heatmap_all_languages", "system ranking k:i all:f de:f en:f es:f fr:f", lambda w: views.heat_map(metrics.both_summaries(w.accuracy), "recall"),
    "(PIVOT by_language ON language IN ('all', 'de', 'en', 'es', 'fr') USING any_value(mean_recall) GROUP BY system, ranking, k)")
expect("heatmap_shades", "system ranking k:i language metric value:f shade:f", lambda w: views.long_heat_map(metrics.both_summaries(w.per_query), metrics.MEANS),
    """(SELECT *, CASE WHEN max(value) OVER (PARTITION BY metric) > 0 THEN least(1, value / max(value) OVER (PARTITION BY metric)) ELSE 0 END AS shade FROM (
       SELECT system, ranking, k, language, replace(metric, 'mean_', '') AS metric, value FROM (UNPIVOT by_language ON mean_precision, mean_recall, mean_f1, mean_mrr, mean_ndcg, mean_nearness_score, mean_nearness_score_undirected INTO NAME metric VALUE value)))""")  # fmt: skip
expect("nearness_series", "system 5:f 10:f 15:f 20:f", lambda w: views.nearness_series(metrics.summary(w.per_query), "indegree", w.settings.ks),
    "(PIVOT (SELECT system, k, mean_nearness_score FROM summary WHERE ranking = 'indegree') ON k IN (5, 10, 15, 20) USING any_value(mean_nearness_score) GROUP BY system)")
expect("nearness_series_undirected", "system 5:f 10:f 15:f 20:f", lambda w: views.nearness_series(metrics.summary(w.per_query), "indegree", w.settings.ks, directed=False),
    "(PIVOT (SELECT system, k, mean_nearness_score_undirected FROM summary WHERE ranking = 'indegree') ON k IN (5, 10, 15, 20) USING any_value(mean_nearness_score_undirected) GROUP BY system)")
expect("comparison_table", f"system ranking k:i {_means}", lambda w: views.comparison(metrics.summary(w.per_query)), "summary")
_drill = lambda w: views.drill_ranked(w.accuracy_at("cross_encoder", 10), "cross_encoder", 10, w.settings.systems, w.queries)
_shown = ("rag", "graph_1hop")
_drill_sql = """(SELECT query_id, language, year, n_ground_truth, max(recall) FILTER (system = 'rag') AS rag_recall, max(ndcg) FILTER (system = 'graph_1hop') AS graph_1hop_ndcg,
    max(recall) FILTER (system = 'graph_1hop') - max(recall) FILTER (system = 'emb_1hop') AS delta FROM per_query WHERE ranking = 'cross_encoder' AND k = 10 GROUP BY ALL)"""
expect("drilldown_ranked", "query_id language year:i n_ground_truth:i rag_recall:f graph_1hop_ndcg:f",
    # every system starts from the same seeds or the same search, so the two that are shown have all queries
    lambda w: views.drill_ranked(w.accuracy_at("cross_encoder", 10, _shown), "cross_encoder", 10, _shown, w.queries).withColumns({"rag_recall": F.col("rag.recall"), "graph_1hop_ndcg": F.col("graph_1hop.ndcg")}), _drill_sql)
expect("drilldown_language", "query_id language rag_recall:f",
    lambda w: views.drill_ranked(w.accuracy_at("indegree", 5), "indegree", 5, w.settings.systems, language="de").withColumn("rag_recall", F.col("rag.recall")),
    "(SELECT query_id, language, recall AS rag_recall FROM per_query WHERE system = 'rag' AND ranking = 'indegree' AND k = 5 AND language = 'de')")
expect("drilldown_delta_sorted", "query_id delta:f", lambda w: views.sorted_by(views.with_delta(_drill(w), "recall"), "delta", True, "query_id"), _drill_sql)
expect("drilldown_page", "query_id delta:f", lambda w: views.page(views.sorted_by(views.with_delta(_drill(w), "recall"), "delta", True, "query_id"), 20, 15),
    f"(SELECT * FROM {_drill_sql} ORDER BY round(delta, 12) DESC NULLS LAST, query_id LIMIT 15 OFFSET 20)")
expect("drilldown_pool", "query_id rag:f graph_2hop:f", lambda w: views.drill_pool(w.pool_metrics, w.settings.systems).select("query_id", F.col("rag.recall").alias("rag"), F.col("graph_2hop.precision").alias("graph_2hop")),
    "(SELECT query_id, max(recall) FILTER (system = 'rag') AS rag, max(precision) FILTER (system = 'graph_2hop') AS graph_2hop FROM pool_metrics GROUP BY query_id)")
expect("drilldown_filtered", "query_id language year:i", lambda w: views.containing(_drill(w), "D", "language", "year"), "(SELECT DISTINCT query_id, language, year FROM per_query WHERE ranking = 'cross_encoder' AND k = 10 AND language LIKE '%d%')")
expect("gt_rank_table", "query_id id indexed system ranking k:i rank:i", lambda w: views.truth_ranks(w.truth, w.results, w.meta),
    "(SELECT t.query_id, t.id, t.id IN (SELECT id FROM meta) AS indexed, system, ranking, k, rank FROM truth t LEFT JOIN results r ON r.query_id = t.query_id AND r.id = t.id)")
_one = "SELECT query_id, id FROM results WHERE system = 'graph_1hop' AND ranking = 'indegree' AND k = 10"
expect("inspector_nodes", "query_id id kind", lambda w: views.inspector_nodes(w.truth, w.results.where("system = 'graph_1hop' AND ranking = 'indegree' AND k = 10"), "ranked"),
    f"""(SELECT query_id, id, CASE WHEN bool_or(kind = 0) THEN 'query' WHEN bool_or(kind = 1) AND bool_or(kind = 2) THEN 'hit' WHEN bool_or(kind = 1) THEN 'miss' ELSE 'missing_gt' END AS kind
       FROM (SELECT query_id, query_id AS id, 0 AS kind FROM truth UNION ALL SELECT query_id, id, 1 FROM ({_one}) UNION ALL SELECT query_id, id, 2 FROM truth) GROUP BY query_id, id)""")  # fmt: skip
expect("inspector_pool_nodes", "query_id id kind", lambda w: views.inspector_nodes(w.truth, w.found.pool("graph_1hop"), "pool", 40),
    """(SELECT query_id, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (kind = 'pool_other')::INT, id) AS n FROM (
       SELECT query_id, id, CASE WHEN bool_or(kind = 0) THEN 'query' WHEN bool_or(kind = 1) AND bool_or(kind = 2) THEN 'hit' WHEN bool_or(kind = 1) THEN 'pool_other' ELSE 'missing_gt' END AS kind
       FROM (SELECT query_id, query_id AS id, 0 AS kind FROM truth UNION ALL SELECT query_id, id, 1 FROM pools WHERE system = 'graph_1hop' UNION ALL SELECT query_id, id, 2 FROM truth) GROUP BY query_id, id)) WHERE n <= 40 OR kind <> 'pool_other')""")  # fmt: skip
expect("inspector_counts", "query_id n_pool:i n_gt:i n_seeds:i n_pool_hits:i n_gt_via_seed:i n_gt_via_expansion_only:i pool_truncated", lambda w: views.inspector_counts(w.found.pools(), w.truth, "graph_1hop", w.found.seeds, 40),
    """(SELECT query_id, count(*) FILTER (p) AS n_pool, count(*) FILTER (t) AS n_gt, count(*) FILTER (s) AS n_seeds, count(*) FILTER (p AND t) AS n_pool_hits, count(*) FILTER (s AND t) AS n_gt_via_seed,
       count(*) FILTER (p AND t AND NOT s) AS n_gt_via_expansion_only, count(*) FILTER (p AND NOT t) > greatest(0, 39 - count(*) FILTER (t)) AS pool_truncated FROM (
       SELECT query_id, id, bool_or(k = 1) AS p, bool_or(k = 2) AS s, bool_or(k = 3) AS t FROM (SELECT query_id, id, 1 AS k FROM pools WHERE system = 'graph_1hop' UNION ALL SELECT query_id, id, 2 FROM seeds UNION ALL SELECT query_id, id, 3 FROM truth) GROUP BY query_id, id) GROUP BY query_id)""")  # fmt: skip
expect("run_header", "language n_queries:i n_ground_truth:i", lambda w: views.run_header(w.accuracy, "rag", "cosine", 20),
    "(SELECT language, count(*) AS n_queries, sum(n_ground_truth) AS n_ground_truth FROM accuracy WHERE system = 'rag' AND ranking = 'cosine' AND k = 20 GROUP BY language)")
expect("retrieved_lists", "system ranking k:i query_id retrieved", lambda w: views.lists(w.results).withColumn("retrieved", F.array_join("retrieved", ",")),
    "(SELECT system, ranking, k, query_id, string_agg(id, ',' ORDER BY rank) AS retrieved FROM results GROUP BY ALL)")
expect("configurations", "system ranking k:i", lambda w: views.configurations(w.results), "(SELECT DISTINCT system, ranking, k FROM results)")
expect("one_query_metrics", "system ranking k:i recall:f mrr:f", lambda w: views.for_query(w.accuracy, w.first_query), "(SELECT * FROM accuracy WHERE query_id = (SELECT min(query_id::BIGINT)::VARCHAR FROM queries))")
expect("query_pools", "query_id pool n_seeds:i", lambda w: views.pool_of(w.found.pools(), "graph_1hop").withColumn("pool", F.array_join("pool", ",")),
    "(SELECT query_id, string_agg(id, ',' ORDER BY is_seed DESC, seed_rank NULLS FIRST, id) AS pool, count(*) FILTER (is_seed) AS n_seeds FROM pools WHERE system = 'graph_1hop' GROUP BY query_id)")
expect("query_scores", "query_id id pair_score:f", lambda w: views.for_query(w.scores, w.first_query), "(SELECT * FROM scores WHERE query_id = (SELECT min(query_id::BIGINT)::VARCHAR FROM queries))")


@entry("custom_query", "system query_id id rank:i excerpt", "custom")
def _custom(w: World) -> DataFrame:
    """One free query: no date rule, no self-exclusion, lists of all default systems side by side with the texts' beginnings."""
    asked = w.corpus.where("id = '33'").select(F.lit("custom").alias("query_id"), "vector", F.lit(None).cast("long").alias("date_ms"))
    found = retrieval.Retrieval(w.engine, asked, w.settings.but(systems=retrieval.DEFAULT_SYSTEMS), exclude_self=False, use_dates=False)
    best = retrieval.rank(found.pools(), "indegree", w.degree).where("rank <= 10")
    return best.join(w.corpus.select("id", text.excerpt(F.col("text"), 80).alias("excerpt")), "id", "left")


# Texts ----------------------------------------------------------------------------------------------
_words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\p{Z}\\x85]+'), lambda x: x <> '')"
_docs = lambda w: w.table("documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source", "lang")
expect("chunk_text", "id chunk_id chunk_index:i num_chunks:i text", lambda w: text.chunks(_docs(w), "id", "text", size=100, overlap=20),
    f"""(SELECT id, id || '_c' || i AS chunk_id, i AS chunk_index, n AS num_chunks, CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[i * 80 + 1:i * 80 + 100], ' ') END AS text
       FROM (SELECT doc_id::VARCHAR AS id, text, {_words} AS w, CASE WHEN len(w) <= 100 THEN 1 ELSE ceil((len(w) - 100) / 80.0)::INT + 1 END AS n FROM documents WHERE coalesce(text, '') <> ''), unnest(range(n)) AS t(i))""")  # fmt: skip
expect("truncate_tokens", "id text", lambda w: _docs(w).withColumn("text", text.truncate_tokens(F.col("text"), 50)), f"(SELECT doc_id::VARCHAR AS id, array_to_string({_words}[1:50], ' ') AS text FROM documents)")
expect("token_counts", "id n:i", lambda w: _docs(w).withColumn("n", text.token_count(F.col("text"))), f"(SELECT doc_id::VARCHAR AS id, len({_words}) AS n FROM documents)")
expect("year_from_ms", "id year:i", lambda w: w.corpus.join(w.dates, "id", "left").withColumn("year", text.year_of_ms(F.col("date_ms"))), "(SELECT c.id, coalesce(year(make_timestamp(d.date_ms * 1000)), 0) AS year FROM corpus c LEFT JOIN dates d ON d.id = c.id)")


@entry("uuid5_ids", "chunk_id u5 valid", "(SELECT doc_id || '_c0' AS chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u5, true AS valid FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || '_c0')) AS h FROM documents))")
def _uuid(w: World) -> DataFrame:
    ids = _docs(w).select(F.concat("id", F.lit("_c0")).alias("chunk_id"), "id")
    made = ids.select("chunk_id", text.point_id(F.col("chunk_id"), F.col("id"), F.lit(0)).alias("u5"))
    return made.withColumn("valid", F.col("u5").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))


def _guess_sql() -> str:
    count = lambda ws: " + ".join(f"(len(t) - len(replace(t, ' {x} ', ''))) // {len(x) + 2}" for x in ws)
    de, fr, it = (count(text.STOP_WORDS[k]) for k in ("de", "fr", "it"))
    return f"(SELECT id, CASE WHEN de >= fr AND de >= it THEN 'de' WHEN fr >= it THEN 'fr' ELSE 'it' END AS guess FROM (SELECT id, {de} AS de, {fr} AS fr, {it} AS it FROM (SELECT doc_id::VARCHAR AS id, ' ' || lower(text) || ' ' AS t FROM documents)))"


expect("language_guess", "id guess", lambda w: _docs(w).withColumn("guess", text.language_guess(F.col("text"))), _guess_sql())


@entry("source_links", "id link",
    """(SELECT id, CASE WHEN court = 'CH_BGer' THEN 'https://www.bger.ch/ext/eurospider/live/' || l || '/php/aza/http/index.php?lang=' || l || '&type=show_document&highlight_docid=aza%3A%2F%2F' || strftime(dt, '%d-%m-%Y') || '-4D_' || id || '-'
         || CASE WHEN year(dt) // 100 * 100 + id::INT % 100 > year(dt) THEN year(dt) // 100 * 100 + id::INT % 100 - 100 ELSE year(dt) // 100 * 100 + id::INT % 100 END
       WHEN court = 'CH_BGE' THEN 'https://www.bger.ch/ext/eurospider/live/' || l || '/php/clir/http/index.php?lang=' || l || '&type=show_document&highlight_docid=atf%3A%2F%2F' || id || '-IV-12%3A' || l
       WHEN court = 'law' THEN 'https://www.fedlex.admin.ch/' || l || '/search?text=SR%20' || id || '.110' WHEN court = 'none' THEN NULL ELSE 'https://entscheidsuche.ch/?text=A/' || id || '%20b' END AS link
       FROM (SELECT d.id, make_timestamp(date_ms * 1000) AS dt, CASE WHEN language IN ('de', 'fr', 'it') THEN language ELSE 'de' END AS l,
         CASE d.id::INT % 5 WHEN 0 THEN 'CH_BGer' WHEN 1 THEN 'CH_BGE' WHEN 2 THEN 'law' WHEN 3 THEN 'none' ELSE 'canton' END AS court FROM dates d JOIN corpus c ON c.id = d.id))""")  # fmt: skip
def _links(w: World) -> DataFrame:
    n, id_ = F.col("id").cast("int") % 5, F.col("id")
    court = F.when(n == 0, "CH_BGer").when(n == 1, "CH_BGE").when(n == 2, "law").when(n == 3, "none").otherwise("canton")
    two = F.lpad((id_.cast("int") % 100).cast("string"), 2, "0")
    number = (
        F.when(n == 0, F.concat(F.lit("4D_"), id_, F.lit("/"), two)).when(n == 1, F.concat(F.lit("BGE_"), id_, F.lit("_IV_12")))
        .when(n == 2, F.concat(F.lit("SR "), id_, F.lit(".110"))).when(n == 4, F.concat(F.lit("A/"), id_, F.lit(" b")))
    )
    source = F.when(n == 2, "swiss_legislation_chunked").otherwise("swiss_rulings_chunked")
    return w.corpus.join(w.dates, "id").select("id", text.source_link(number, F.col("date_ms"), court, source, F.col("language")).alias("link"))


expect("parse_list_field", "decision_id n_cases:i n_laws:i first", lambda w: w.source_rows.select("decision_id", F.size(text.parse_list(F.col("cited_rulings"))).alias("n_cases"), F.size(text.parse_list(F.col("laws"))).alias("n_laws"), F.get(text.parse_list(F.col("cited_rulings")), 0).alias("first")),
    "(SELECT l_orderkey::VARCHAR AS decision_id, count(*) AS n_cases, count(*) AS n_laws, arg_min(ruling, i) AS first FROM lines GROUP BY l_orderkey)")
expect("text_excerpts", "id excerpt label", lambda w: _docs(w).select("id", text.excerpt(F.col("text"), 200).alias("excerpt"), text.label(F.lit(None).cast("string"), F.concat(F.lit("decision-"), F.col("id"))).alias("label")),
    "(SELECT doc_id::VARCHAR AS id, substr(coalesce(text, ''), 1, 200) AS excerpt, 'decision' AS label FROM documents)")
expect("dataset_links", "id link", lambda w: w.corpus.select("id", text.dataset_link("own/corpus", F.col("id"), ("train", "test")).alias("link")),
    "(SELECT id, 'https://huggingface.co/datasets/own/corpus/viewer/default/train?sql_console=true&sql=SELECT%20%27train%27%20AS%20split%2C%20%2A%20FROM%20train%20WHERE%20decision_id%20%3D%20%27' || id || '%27%20UNION%20ALL%20SELECT%20%27test%27%20AS%20split%2C%20%2A%20FROM%20test%20WHERE%20decision_id%20%3D%20%27' || id || '%27' AS link FROM corpus)")
expect("run_estimates", "language hours:f each:i", lambda w: w.queries.groupBy("language").agg(F.count(F.lit(1)).alias("n")).select("language", text.run_estimate(F.col("n"))[0].alias("hours"), text.run_estimate(F.col("n"))[1].alias("each")),
    "(SELECT language, count(*) * 18 / 3600.0 AS hours, count(*) // 3 AS each FROM queries GROUP BY language)")

# Sources, sinks, logs -------------------------------------------------------------------------------
expect("last_record_by_key", "role turn:i text", lambda w: readers.last_by_key(w.table("conversations").withColumn("at", F.col("conv_id") * 1000 + F.col("turn")), "role", "at"),
    "(SELECT role, arg_max(turn, conv_id * 1000 + turn) AS turn, arg_max(text, conv_id * 1000 + turn) AS text FROM conversations WHERE role IS NOT NULL GROUP BY role)")


def _scratch(w: World) -> str:
    return f"{shared_folder(w.spark)}/sources-{uuid.uuid4().hex}"


_talk = lambda w: w.table("conversations").select(F.col("conv_id").cast("string").alias("query_id"), F.col("text").alias("query_text"), F.col("turn").cast("int").alias("year"), F.col("role").alias("language"))


@entry("lines_round_trip", "conv:i turn:i text", "(SELECT conv_id AS conv, turn, text FROM conversations)")
def _lines(w: World) -> DataFrame:
    sinks.write_lines(w.table("conversations").select(F.col("conv_id").alias("conv"), "turn", "text"), path := _scratch(w))
    return readers.lines(w.spark, path, "conv long, turn long, text string")


@entry("last_line_by_key", "role n:i", "(SELECT role, max(conv_id * 1000 + turn) AS n FROM conversations GROUP BY role)")
def _last_line(w: World) -> DataFrame:
    rows = w.table("conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("n"))
    sinks.write_lines(rows.coalesce(1).sortWithinPartitions("n"), path := _scratch(w))  # in order, in one file
    return readers.last_by_key(readers.ordered_lines(w.spark, path, "role string, n long"), "role")


@entry("query_lines", "query_id query_text", "(SELECT conv_id::VARCHAR AS query_id, text AS query_text FROM conversations WHERE trim(coalesce(text, '')) <> '')")
def _query_lines(w: World) -> DataFrame:
    sinks.write_lines(_talk(w), path := _scratch(w))
    return readers.queries(w.spark, path)


@entry("facts_lines", "decision_id language", "(SELECT conv_id::VARCHAR AS decision_id, arg_min(lower(role), turn) AS language FROM conversations WHERE lower(role) IN ('user', 'assistant') GROUP BY conv_id)")
def _facts_lines(w: World) -> DataFrame:
    rows = w.table("conversations").select(F.col("conv_id").cast("string").alias("decision_id"), F.col("role").alias("language"), F.col("text").alias("facts"), "conv_id", "turn")
    sinks.write_lines(rows.coalesce(1).sortWithinPartitions("conv_id", "turn").drop("conv_id", "turn"), path := _scratch(w))
    return readers.facts(w.spark, path, ("user", "assistant"))


@entry("result_files", "system ranking k:i query_id id rank:i", "(SELECT * FROM results WHERE system = 'rag' AND ranking = 'cosine')")
def _result_files(w: World) -> DataFrame:
    """Lists written as lines, one folder of files a configuration as named there, and read back by their names."""
    base = _scratch(w)
    for k in w.settings.ks:
        rows = views.lists(w.results.where(f"system = 'rag' AND ranking = 'cosine' AND k = {k}")).select("query_id", "retrieved")
        sinks.write_named(rows, base, f"rag_cosine_{k}.jsonl")
    return readers.results(w.spark, base)


@entry("csv_round_trip", "system ranking k:i mean_recall:f n_queries:i", "(SELECT system, ranking, k, avg(recall) AS mean_recall, count(*) AS n_queries FROM accuracy GROUP BY ALL)")
def _csv(w: World) -> DataFrame:
    made = w.accuracy.groupBy(*metrics.CONFIG).agg(F.avg("recall").alias("mean_recall"), F.count(F.lit(1)).alias("n_queries"))
    sinks.write_csv(made, path := _scratch(w))
    return readers.aggregate(w.spark, path, "system string, ranking string, k int, mean_recall double, n_queries long")


@entry("scores_round_trip", "query_id id pair_score:f", "scores")
def _scores_lines(w: World) -> DataFrame:
    sinks.write_scores(w.scores, path := _scratch(w))
    return sinks.read_scores(w.spark, path)


@entry("partitioned_results", "system ranking k:i query_id id rank:i", "results")
def _partitioned(w: World) -> DataFrame:
    path = _scratch(w)
    for system in w.settings.systems:  # a run at a time: others stay
        sinks.write_results(w.results.where(F.col("system") == system).drop("value"), path)
    return w.spark.read.parquet(path)


@entry("upsert_points", "point_id text", "(SELECT doc_id::VARCHAR AS point_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS text FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)")
def _upsert(w: World) -> DataFrame:
    ids = w.table("documents").select(F.col("doc_id").cast("string").alias("point_id"), "doc_id")
    old = ids.where("doc_id % 2 = 0").select("point_id", F.lit("old").alias("text"))
    new = ids.where("doc_id % 3 = 0").select("point_id", F.lit("new").alias("text"))
    return sinks.upsert(new, old, "point_id")


@entry("snapshot_restore", "c_custkey:i c_name", "(SELECT c_custkey, c_name FROM customer)")
def _snapshot(w: World) -> DataFrame:
    sinks.snapshot(w.spark, w.table("customer").select("c_custkey", "c_name"), path := _scratch(w), "one")
    return sinks.restore(w.spark, path)


@entry("embedding_cache", "query_id n:i", "(SELECT vec_id::VARCHAR AS query_id, len(embedding) AS n FROM embeddings)")
def _cache(w: World) -> DataFrame:
    rows = w.table("embeddings").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    sinks.write_lines(rows, path := _scratch(w))
    return readers.embedding_cache(w.spark, path).select("query_id", F.size("embedding").alias("n"))


@entry("embedding_shards", "chunk_id n:i", "(SELECT doc_id::VARCHAR AS chunk_id, len(text) AS n FROM documents WHERE coalesce(text, '') <> '')")
def _shards(w: World) -> DataFrame:
    """Vectors in shards, in two runs of which the second takes what the first left; a text's vector is its length here."""
    rows = w.table("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    embedder = sinks.BatchEmbedder(lambda texts: [[float(len(t))] for t in texts])
    path = _scratch(w)
    sinks.embed_shards(rows.where("int(chunk_id) % 2 = 0"), embedder, path)
    sinks.embed_shards(rows, embedder, path)
    return w.spark.read.parquet(f"{path}/shards").select("chunk_id", F.get("vector", 0).alias("n"))


@entry("arrow_files", "n_nationkey:i n_name", "(SELECT n_nationkey, n_name FROM nation)")
def _arrow(w: World) -> DataFrame:
    """A table written as Arrow files by the executors' file system and read back."""
    path = _scratch(w)
    sinks.write_arrow(w.table("nation").select("n_nationkey", "n_name"), path)
    return readers.arrow_table(w.spark, path, "n_nationkey int, n_name string")


expect("chunk_points", "id chunk_index:i source", lambda w: readers.chunk_points(w.points, ("src1", "src2")), "(SELECT id, chunk_index, source FROM points WHERE source IN ('src1', 'src2'))")
expect("sample_texts", "decision_id n:i", lambda w: readers.sample_texts(
        w.table("documents").select(F.col("doc_id").cast("string").alias("decision_id"), F.lit("").alias("file_number"), F.lit("").alias("date"), F.col("lang").alias("language"), F.col("source").alias("court"), F.col("text").alias("full_text")),
        court="src3", max_tokens=300, limit=20).withColumn("n", text.token_count(F.col("text"))),
    f"(SELECT * FROM (SELECT doc_id::VARCHAR AS decision_id, len({_words}) AS n FROM documents WHERE source = 'src3' AND coalesce(text, '') <> '') WHERE n < 300 ORDER BY decision_id LIMIT 20)")


@entry("valid_ids_file", "id", "valid")
def _ids_file(w: World) -> DataFrame:
    sinks.write_ids(w.valid, path := _scratch(w))
    return sinks.read_ids(w.spark, path)


@entry("graph_files", "src dst type source", "(SELECT e.*, n.source FROM edges e JOIN nodes n ON n.id = e.dst)")
def _graph_files(w: World) -> DataFrame:
    sinks.write_graph(w.nodes, w.edges, path := _scratch(w))
    nodes, edges = sinks.read_graph(w.spark, path)
    return edges.join(nodes.withColumnRenamed("id", "dst"), "dst")


@entry("cached_embeddings", "query_id n:i", "(SELECT doc_id::VARCHAR AS query_id, len(text) AS n FROM documents WHERE doc_id < 60 AND coalesce(text, '') <> '')")
def _cached(w: World) -> DataFrame:
    rows = w.table("documents").where("doc_id < 60").select(F.col("doc_id").cast("string").alias("query_id"), "text")
    embedder = sinks.BatchEmbedder(lambda texts: [[float(len(t))] for t in texts])
    path = _scratch(w)
    sinks.cached(rows.where("int(query_id) % 3 = 0"), path, embedder)
    return sinks.cached(rows, path, embedder).select("query_id", F.get("embedding", 0).alias("n"))


expect("chunk_counts", "n_docs:i n_empty:i n_chunks:i n_split:i", lambda w: text.chunk_counts(_docs(w), text.chunks(_docs(w), "id", "text", size=100, overlap=20), "text"),
    f"""(SELECT count(*) AS n_docs, count_if(n = 0) AS n_empty, sum(CASE WHEN n = 0 THEN 0 WHEN len(w) <= 100 THEN 1 ELSE ceil((len(w) - 100) / 80.0)::INT + 1 END) AS n_chunks, count_if(n > 0 AND len(w) > 100) AS n_split
       FROM (SELECT coalesce(len(text), 0) AS n, {_words} AS w FROM documents))""")  # fmt: skip
expect("payloads", "decision_id chunk_id chunk_index:i num_chunks:i date_ms:i language", lambda w: text.payload(w.table("documents").select(
        F.col("doc_id").alias("decision_id"), F.lit(None).cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("x").alias("chunk_index"),
        F.lit("").alias("num_chunks"), F.when(F.col("doc_id") % 3 == 0, "2001").otherwise("no").alias("date"), "text", F.lit("").alias("file_number"), F.col("lang").alias("language"), F.lit("").alias("court"))),
    "(SELECT doc_id::VARCHAR AS decision_id, '' AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS chunk_index, 1 AS num_chunks, CASE WHEN doc_id % 3 = 0 THEN 2001 END AS date_ms, coalesce(lang, '') AS language FROM documents)")
expect("backfill_samples", "decision_id chunk_index:i date_ms:i", lambda w: sinks.backfill_samples(w.points.withColumnRenamed("id", "decision_id")),
    "(SELECT id AS decision_id, chunk_index, date_ms FROM points WHERE date_ms IS NOT NULL ORDER BY id, chunk_index LIMIT 3)")


@entry("pair_scores_by_call", "query_id id pair_score:f",
    """(SELECT u.query_id, u.id, (len(c.text[1:4000]) % 97)::DOUBLE AS pair_score FROM (SELECT DISTINCT query_id, id FROM pools WHERE system = 'rag') u JOIN corpus c ON c.id = u.id
       WHERE trim(coalesce(c.text, '')) <> '')""")  # fmt: skip
def _by_call(w: World) -> DataFrame:
    pools = w.found.pools().where("system = 'rag'")
    return retrieval.pair_scores_by_call(pools, w.query_texts, w.engine.texts, lambda rows: [len(b) % 97 for _, b in rows])[0]


@entry("resume_remaining", "query_id", "(SELECT DISTINCT query_id FROM truth WHERE NOT (query_id::INT % 3 <> 0 AND query_id::INT % 5 <> 0))")
def _resume(w: World) -> DataFrame:
    asked = w.truth.select("query_id").distinct()
    n = F.col("query_id").cast("int")
    return sinks.resume(asked, {"a": asked.where(n % 3 != 0), "b": asked.where(n % 5 != 0)})[0]


@entry("gap_fill", "decision_id chunk_index:i", "(SELECT id AS decision_id, chunk_index FROM points WHERE NOT (chunk_index = 0 AND id::INT % 4 <> 0))")
def _gap(w: World) -> DataFrame:
    chunks = w.points.select(F.col("id").alias("decision_id"), "chunk_index")
    return sinks.gap_fill(chunks, chunks.where("chunk_index = 0 AND int(decision_id) % 4 <> 0"))


@entry("date_backfill_check", "n:i dated:i before_2001:i", "(SELECT count(*) AS n, count(date_ms) AS dated, count_if(date_ms < 978307200000) AS before_2001 FROM points)")
def _backfill(w: World) -> DataFrame:
    bare = w.points.drop("date_ms").withColumnRenamed("id", "decision_id")
    return sinks.backfill_check(sinks.backfill_dates(bare, w.dates.withColumnRenamed("id", "decision_id")))


expect("first_chunk_metadata", "id language source", lambda w: readers.first_chunk_metadata(w.points.withColumns({"chunk_id": F.concat_ws("_c", "id", "chunk_index"), "text": F.lit("t")})), "(SELECT id, language, source FROM points WHERE chunk_index = 0)")
expect("metadata_for_ids", "id date_ms:i language", lambda w: readers.metadata_for(w.sample, w.meta), "(SELECT * FROM meta WHERE id IN (SELECT id FROM sample))")


def _log(w: World) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, views.RUN_STAGES)), (F.col("event_id") % 3 + 1).cast("int"))
    kind = F.col("event_type")
    line = (
        F.when(kind == "error", F.concat(F.lit("12:00 === "), F.upper(stage), F.lit(" FAILED ===")))
        .when(kind == "signup", F.concat(F.lit("=== SKIP "), stage, F.lit(" ===")))
        .when(kind == "purchase", F.concat(F.lit("=== "), F.upper(stage), F.lit(" finished in 3 s ===")))
        .when(kind == "view", F.concat(F.lit("=== "), F.upper(stage), F.lit(" started ===")))
        .otherwise(F.concat(F.lit("progress "), F.col("event_id").cast("string")))
    )
    return w.table("events").select((F.col("event_id") % 7).alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def _runs(w: World) -> DataFrame:
    n = F.col("id")
    status = F.when(n == 0, "done").when(n == 1, "failed").when(n == 2, "aborted").otherwise("running")
    return w.spark.range(9).select(n.alias("run_id"), status.alias("status"), (n == 3).alias("skip_sample"), (n == 4).alias("skip_retrieval"), F.lit(False).alias("skip_metrics"))


expect("log_stage_states", "run_id:i stage state", lambda w: views.stage_states(_runs(w), _log(w)),
    """(SELECT run_id, stage, CASE WHEN status = 'done' AND s = 'pending' THEN 'done' WHEN status IN ('failed', 'aborted') AND s IN ('pending', 'running') THEN 'failed' ELSE s END AS state FROM (
       SELECT r.run_id, r.status, g.stage, coalesce(l.state, CASE WHEN (g.stage = 'sample' AND skip_sample) OR (g.stage = 'retrieval' AND skip_retrieval) THEN 'skipped' ELSE 'pending' END) AS s
       FROM runs r CROSS JOIN (VALUES ('sample'), ('retrieval'), ('metrics')) g(stage)
       LEFT JOIN (SELECT run_id, stage, arg_max(state, line_no) AS state FROM states GROUP BY run_id, stage) l ON l.run_id = r.run_id AND l.stage = g.stage))""")  # fmt: skip
expect("log_tail", "line_no:i line", lambda w: views.tail(_log(w), 500), "(SELECT line_no, line FROM log ORDER BY line_no DESC LIMIT 500)")
expect("recent_runs", "run_id:i status", lambda w: views.recent(_runs(w), 5), "(SELECT run_id, status FROM runs ORDER BY run_id DESC LIMIT 5)")
expect("progress_by_day", "start_ms:i event_type n:i total:f", lambda w: progress.progress(w.table("events").withColumn("ts", F.col("ts").cast("timestamp"))),
    "(SELECT epoch_ms(date_trunc('day', ts)) AS start_ms, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)")


@entry("flagship_recall", "language n:i mean_recall:f",
    "(SELECT language, count(*) AS n, avg(recall) AS mean_recall FROM accuracy WHERE system = 'graph_1hop' AND ranking = 'indegree' AND k = 20 GROUP BY language)")
def flagship(w: World) -> DataFrame:
    """Mean recall at 20 by language: seeds by cosine, one hop through citations, ranked by in-degree."""
    found = retrieval.Retrieval(w.engine, w.queries, w.settings.but(systems=("graph_1hop",)))
    ranked = retrieval.rank(found.pool("graph_1hop").withColumn("system", F.lit("graph_1hop")), "indegree", w.degree)
    per_query = metrics.accuracy(retrieval.cut_off(ranked, [20]), w.truth, w.queries)
    return per_query.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("mean_recall"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name; those of one call share what they have in common, for each application and folder."""
    worlds: dict[tuple[str, str], World] = {}

    def bound(e: Entry) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir)
            return e.query(worlds.setdefault(key, World(spark, sf_dir)))

        return run

    return {name: bound(e) for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, e in ENTRIES.items() if (sql := e.oracle()) is not None}
