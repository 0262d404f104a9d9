"""SQL (DuckDB) for the queries of the catalogue, over named relations that say what each operator computes."""

from __future__ import annotations

import re

from ..operators.retrieval import SYSTEMS

#: The world's relations by name. Those that a query needs are put in front of it.
RELATIONS: dict[str, str] = {
    "size": "SELECT count(*) AS d FROM documents JOIN embeddings ON doc_id = vec_id",
    "corpus": "SELECT doc_id AS num, doc_id::VARCHAR AS id, lang AS language, source, text, embedding::DOUBLE[] AS vector FROM documents JOIN embeddings ON doc_id = vec_id",
    "dates": "SELECT o_orderkey::VARCHAR AS id, epoch_ms(o_orderdate) AS date_ms FROM orders WHERE o_orderkey % 17 <> 0",
    "points": """SELECT c.id, p.chunk_index, e.embedding::DOUBLE[] AS vector, c.source, c.language, d.date_ms
        FROM corpus c CROSS JOIN (VALUES (0), (1)) p(chunk_index) JOIN embeddings e ON e.vec_id = c.num + p.chunk_index LEFT JOIN dates d ON d.id = c.id""",
    "rulings": "SELECT * FROM points WHERE source NOT IN ('src18', 'src19')",
    "lines": "SELECT l_orderkey, l_linenumber, (l_partkey % d)::VARCHAR AS ruling, 'L' || l_suppkey AS law, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem, size WHERE l_orderkey < d",
    "cited": """SELECT l_orderkey::VARCHAR AS src, ruling AS dst, 'case_to_case' AS type, l_orderkey * 1000 + i AS ord FROM lines
        UNION ALL SELECT l_orderkey::VARCHAR, law, 'case_to_law', l_orderkey * 1000 + 500 + i FROM lines""",
    "edges": "SELECT src, dst, arg_max(type, ord) AS type FROM cited WHERE src <> dst AND dst <> '' GROUP BY src, dst",
    "nodes": """SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN 'ruling' ELSE n.source END AS source
        FROM (SELECT dst AS id, arg_min(CASE WHEN type = 'case_to_case' THEN 'ruling' ELSE 'law' END, ord) AS source FROM cited WHERE src <> dst AND dst <> '' GROUP BY dst) n
        FULL JOIN (SELECT DISTINCT l_orderkey::VARCHAR AS id FROM lines) o ON o.id = n.id""",
    "degree": "SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY dst",
    "both_ways": "SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges",
    "around": "SELECT a, b FROM both_ways WHERE b IN (SELECT id FROM nodes WHERE source = 'ruling')",
    "valid": "SELECT DISTINCT id FROM rulings WHERE id IN (SELECT id FROM nodes WHERE source = 'ruling')",
    "meta": "SELECT id, min(coalesce(date_ms, 0))::BIGINT AS date_ms, min(coalesce(lower(language), '?')) AS language, 'CH' AS court FROM rulings WHERE chunk_index = 0 GROUP BY id",
    "truth": """SELECT e.src AS query_id, e.dst AS id FROM edges e JOIN meta q ON q.id = e.src JOIN meta t ON t.id = e.dst
        WHERE e.type = 'case_to_case' AND e.src IN (SELECT id FROM valid) AND e.dst IN (SELECT id FROM valid) AND q.date_ms > 0 AND t.date_ms > 0 AND t.date_ms < q.date_ms""",
    "tsize": "SELECT query_id, count(*) AS gt_size FROM truth GROUP BY query_id",
    "queries": """SELECT c.id AS query_id, array_to_string(list_filter(regexp_split_to_array(c.text, '\\s+'), lambda x: x <> '')[1:4096], ' ') AS query_text,
        c.language, year(make_timestamp(d.date_ms * 1000)) AS year, d.date_ms, c.vector FROM corpus c JOIN dates d ON d.id = c.id WHERE c.id IN (SELECT query_id FROM truth)""",
    "near": """SELECT q.query_id, p.id, p.chunk_index, round(list_cosine_similarity(q.vector, p.vector), 9) AS score
        FROM queries q JOIN rulings p ON p.id <> q.query_id AND p.date_ms < q.date_ms""",
    "seeds": """SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS seed_rank
        FROM (SELECT query_id, id, max(score) AS score FROM near GROUP BY query_id, id)) WHERE seed_rank <= 20""",
    "smart": """SELECT * FROM (SELECT s.query_id, s.id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY coalesce(d.in_degree, 0) DESC, s.score DESC, s.id) AS seed_rank
        FROM (SELECT query_id, id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, chunk_index) AS n FROM near) WHERE n <= 480 GROUP BY query_id, id) s
        LEFT JOIN degree d ON d.id = s.id) WHERE seed_rank <= 20""",
    "g1_raw": "SELECT DISTINCT s.query_id, a.b AS id FROM seeds s JOIN around a ON a.a = s.id WHERE (s.query_id, a.b) NOT IN (SELECT (query_id, id) FROM seeds)",
    "g1_timely": "SELECT r.query_id, r.id FROM g1_raw r JOIN queries q USING (query_id) LEFT JOIN dates d ON d.id = r.id WHERE d.date_ms IS NULL OR d.date_ms < q.date_ms",
    "g1_order": "SELECT t.query_id, t.id, row_number() OVER (PARTITION BY t.query_id ORDER BY coalesce(d.in_degree, 0) DESC, t.id) AS n FROM g1_timely t LEFT JOIN degree d ON d.id = t.id",
    "g1_cap": "SELECT query_id, id FROM g1_order WHERE n <= 64",
    "g2_first": "SELECT query_id, id FROM g1_order WHERE n <= 256",
    "g2_raw": """SELECT query_id, id FROM (SELECT query_id, id FROM g2_first UNION SELECT f.query_id, a.b FROM g2_first f JOIN around a ON a.a = f.id)
        WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM seeds)""",
    "g2_timely": "SELECT r.query_id, r.id FROM g2_raw r JOIN queries q USING (query_id) LEFT JOIN dates d ON d.id = r.id WHERE d.date_ms IS NULL OR d.date_ms < q.date_ms",
    "g2_cap": """SELECT query_id, id FROM (SELECT t.query_id, t.id, row_number() OVER (PARTITION BY t.query_id ORDER BY coalesce(d.in_degree, 0) DESC, t.id) AS n
        FROM g2_timely t LEFT JOIN degree d ON d.id = t.id) WHERE n <= 128""",
    "knn": """SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, id, chunk_index) AS rank FROM (
        SELECT c.id AS node, p.id, p.chunk_index, round(list_cosine_similarity(c.vector, p.vector), 9) AS score
        FROM (SELECT id, vector FROM rulings WHERE chunk_index = 0) c CROSS JOIN rulings p)""",
    "e1_raw": """SELECT s.query_id, k.id, max(k.score) AS score
        FROM (SELECT query_id, id, 3 * greatest(10, 64 // count(*) OVER (PARTITION BY query_id)) AS depth FROM seeds) s JOIN knn k ON k.node = s.id AND k.rank <= s.depth
        WHERE k.id <> s.query_id AND (s.query_id, k.id) NOT IN (SELECT (query_id, id) FROM seeds) GROUP BY s.query_id, k.id""",
    "e1_timely": "SELECT r.* FROM e1_raw r JOIN queries q USING (query_id) LEFT JOIN dates d ON d.id = r.id WHERE d.date_ms IS NULL OR d.date_ms < q.date_ms",
    "e1_cap": "SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM e1_timely) WHERE n <= 64",
    "e2_front": "SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM e1_cap) WHERE n <= 10",
    "e2_raw": """SELECT query_id, id, max(score) AS score FROM (
        SELECT f.query_id, k.id, k.score FROM (SELECT query_id, id, 3 * greatest(10, 128 // count(*) OVER (PARTITION BY query_id)) AS depth FROM e2_front) f
        JOIN knn k ON k.node = f.id AND k.rank <= f.depth WHERE k.id <> f.query_id AND (f.query_id, k.id) NOT IN (SELECT (query_id, id) FROM seeds)
        UNION ALL SELECT query_id, id, 1.0 FROM e1_cap) GROUP BY query_id, id""",
    "e2_timely": "SELECT r.* FROM e2_raw r JOIN queries q USING (query_id) LEFT JOIN dates d ON d.id = r.id WHERE d.date_ms IS NULL OR d.date_ms < q.date_ms",
    "e2_whole_raw": """SELECT query_id, id, max(score) AS score FROM (
        SELECT f.query_id, k.id, k.score FROM (SELECT query_id, id, 3 * greatest(10, 128 // count(*) OVER (PARTITION BY query_id)) AS depth FROM e1_timely) f
        JOIN knn k ON k.node = f.id AND k.rank <= f.depth WHERE k.id <> f.query_id AND (f.query_id, k.id) NOT IN (SELECT (query_id, id) FROM seeds)
        UNION ALL SELECT query_id, id, 1.0 FROM e1_timely) GROUP BY query_id, id""",
    "e2_whole_timely": "SELECT r.* FROM e2_whole_raw r JOIN queries q USING (query_id) LEFT JOIN dates d ON d.id = r.id WHERE d.date_ms IS NULL OR d.date_ms < q.date_ms",
    "e2_cap": "SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM e2_timely) WHERE n <= 128",
    "pools": " UNION ALL ".join(
        [f"SELECT '{s}' AS system, query_id, id, score, true AS is_seed, seed_rank FROM {'smart' if s == 'rag_smart' else 'seeds'}" for s in SYSTEMS]
        + [f"SELECT '{s}', query_id, id, 0.0, false, NULL FROM {c}_cap" for s, c in (("emb_1hop", "e1"), ("emb_2hop", "e2"), ("graph_1hop", "g1"), ("graph_2hop", "g2"))]
    ),
    "bags": "SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(substr(text, 1, 4000)), '\\s+'), lambda x: x <> '')) AS bag FROM corpus WHERE trim(coalesce(text, '')) <> ''",
    "asked_bags": "SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(substr(query_text, 1, 4000)), '\\s+'), lambda x: x <> '')) AS bag FROM queries",
    "scores": """SELECT query_id, id, CASE WHEN la + lb - both_ > 0 THEN both_ / (la + lb - both_)::DOUBLE ELSE 0 END AS pair_score FROM (
        SELECT u.query_id, u.id, len(q.bag) AS la, len(b.bag) AS lb, len(list_intersect(q.bag, b.bag)) AS both_
        FROM (SELECT DISTINCT query_id, id FROM pools) u JOIN bags b USING (id) JOIN asked_bags q USING (query_id))""",
    "valued": """SELECT system, 'cosine' AS ranking, query_id, id, round(score, 9) AS value, is_seed, seed_rank FROM pools
        UNION ALL SELECT p.system, 'indegree', p.query_id, p.id, round(ln(1 + coalesce(d.in_degree, 0)), 9), p.is_seed, p.seed_rank FROM pools p LEFT JOIN degree d USING (id)
        UNION ALL SELECT p.system, 'cross_encoder', p.query_id, p.id, round(coalesce(s.pair_score, -1e9), 9), p.is_seed, p.seed_rank FROM pools p LEFT JOIN scores s USING (query_id, id)
        WHERE p.query_id::BIGINT % 29 <> 0""",
    "ranked": """SELECT system, ranking, query_id, id, value, row_number() OVER (PARTITION BY system, ranking, query_id ORDER BY value DESC, is_seed DESC, seed_rank NULLS LAST, id) AS rank FROM valued""",
    "results": "SELECT r.*, k FROM ranked r JOIN (VALUES (5), (10), (15), (20)) c(k) ON r.rank <= k",
    "accuracy": """SELECT system, ranking, k, query_id, q.language, q.year, coalesce(gt_size, 0) AS n_ground_truth, n_hits, n_hits / k::DOUBLE AS precision,
        CASE WHEN gt_size > 0 THEN n_hits / gt_size::DOUBLE ELSE 0 END AS recall, CASE WHEN n_hits > 0 THEN 2.0 * n_hits / (k + gt_size) ELSE 0 END AS f1,
        coalesce(1.0 / first_hit, 0) AS mrr, dcg, CASE WHEN gt_size > 0 THEN dcg / list_sum([1 / log2(i + 1) for i in range(1, least(k, gt_size) + 1)]) ELSE 0 END AS ndcg
        FROM (SELECT r.system, r.ranking, r.k, r.query_id, count(t.id) AS n_hits, min(CASE WHEN t.id IS NOT NULL THEN r.rank END) AS first_hit,
              coalesce(sum(CASE WHEN t.id IS NOT NULL THEN 1 / log2(r.rank + 1) END), 0) AS dcg
              FROM results r LEFT JOIN truth t ON t.query_id = r.query_id AND t.id = r.id GROUP BY ALL)
        JOIN queries q USING (query_id) LEFT JOIN tsize USING (query_id)""",
    "hops_out": """SELECT target, id, min(d) AS d FROM (
        SELECT DISTINCT id AS target, id, 0 AS d FROM truth UNION ALL SELECT t.id, e.src, 1 FROM (SELECT DISTINCT id FROM truth) t JOIN edges e ON e.dst = t.id
        UNION ALL SELECT t.id, f.src, 2 FROM (SELECT DISTINCT id FROM truth) t JOIN edges e ON e.dst = t.id JOIN edges f ON f.dst = e.src) GROUP BY target, id""",
    "hops_any": """SELECT target, id, min(d) AS d FROM (
        SELECT DISTINCT id AS target, id, 0 AS d FROM truth UNION ALL SELECT t.id, e.b, 1 FROM (SELECT DISTINCT id FROM truth) t JOIN both_ways e ON e.a = t.id
        UNION ALL SELECT t.id, f.b, 2 FROM (SELECT DISTINCT id FROM truth) t JOIN both_ways e ON e.a = t.id JOIN both_ways f ON f.a = e.b) GROUP BY target, id""",
    "far": """SELECT r.query_id, r.id, min(CASE WHEN r.id = t.id THEN 0 ELSE o.d END) AS out_d, min(CASE WHEN r.id = t.id THEN 0 ELSE a.d END) AS any_d
        FROM (SELECT DISTINCT query_id, id FROM results) r JOIN truth t USING (query_id)
        LEFT JOIN hops_out o ON o.target = t.id AND o.id = r.id LEFT JOIN hops_any a ON a.target = t.id AND a.id = r.id GROUP BY r.query_id, r.id""",
    "nearness": """SELECT r.system, r.ranking, r.k, r.query_id, avg(coalesce(1.0 / (out_d + 1), 0)) AS nearness_score, count(*) FILTER (out_d = 0) AS n_exact, count(*) FILTER (out_d = 1) AS n_near_1,
        count(*) FILTER (out_d = 2) AS n_near_2, count(*) FILTER (out_d IS NULL) AS n_far, avg(coalesce(1.0 / (any_d + 1), 0)) AS nearness_score_undirected,
        count(*) FILTER (any_d = 1) AS n_near_1_undirected, count(*) FILTER (any_d = 2) AS n_near_2_undirected, count(*) FILTER (any_d IS NULL) AS n_far_undirected
        FROM results r LEFT JOIN far f ON f.query_id = r.query_id AND f.id = r.id GROUP BY ALL""",
    "per_query": "SELECT * FROM accuracy JOIN nearness USING (system, ranking, k, query_id)",
    "pool_metrics": """SELECT *, CASE WHEN gt_size > 0 THEN hits / gt_size::DOUBLE ELSE 0 END AS recall, hits / pool_size::DOUBLE AS precision,
        CASE WHEN hits > 0 THEN 2.0 * hits / (pool_size + gt_size) ELSE 0 END AS f1 FROM (
        SELECT p.system, p.query_id, count(*) AS pool_size, count(t.id) AS hits, coalesce(any_value(s.gt_size), 0) AS gt_size
        FROM pools p LEFT JOIN truth t ON t.query_id = p.query_id AND t.id = p.id LEFT JOIN tsize s ON s.query_id = p.query_id GROUP BY p.system, p.query_id)""",
    "layer_sets": " UNION ALL ".join(
        [f"SELECT '{s}' AS system, 'seeds' AS stage, 0 AS stage_order, query_id, id FROM {'smart' if s == 'rag_smart' else 'seeds'}" for s in SYSTEMS]
        + [
            f"SELECT '{s}', '{stage}', {n}, query_id, id FROM (SELECT query_id, id FROM {c}_{short} UNION SELECT query_id, id FROM seeds)"
            for s, c in (("emb_1hop", "e1"), ("emb_2hop", "e2"), ("graph_1hop", "g1"), ("graph_2hop", "g2"))
            for n, stage, short in ((1, "raw", "raw"), (2, "post_temporal", "timely"), (3, "post_cap", "cap"))
        ]
    ),
    "layers": """SELECT l.system, l.query_id, l.stage, l.stage_order, count(*) AS pool_size, count(t.id) AS hits
        FROM layer_sets l LEFT JOIN truth t ON t.query_id = l.query_id AND t.id = l.id WHERE l.query_id IN (SELECT query_id FROM truth) GROUP BY ALL""",
    "layer_ceilings": """SELECT system, stage, min(stage_order) AS stage_order, avg(hits / gt_size::DOUBLE) AS mean_recall_ceiling, avg(hits / pool_size::DOUBLE) AS mean_precision_ceiling,
        avg(CASE WHEN hits > 0 THEN 2.0 * hits / (pool_size + gt_size) ELSE 0 END) AS mean_f1_ceiling, avg(pool_size) AS mean_pool_size, count(*) AS n_queries
        FROM layers JOIN tsize USING (query_id) GROUP BY system, stage""",
    "summary": """SELECT system, ranking, k, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1, avg(mrr) AS mean_mrr, avg(ndcg) AS mean_ndcg,
        avg(nearness_score) AS mean_nearness_score, avg(nearness_score_undirected) AS mean_nearness_score_undirected, count(*) AS n_queries, avg((precision > 0)::INT) AS hit_rate
        FROM per_query GROUP BY system, ranking, k""",
    "by_language": """SELECT system, ranking, k, coalesce(language, 'all') AS language, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1, avg(mrr) AS mean_mrr,
        avg(ndcg) AS mean_ndcg, avg(nearness_score) AS mean_nearness_score, avg(nearness_score_undirected) AS mean_nearness_score_undirected, count(*) AS n_queries, avg((precision > 0)::INT) AS hit_rate
        FROM per_query GROUP BY GROUPING SETS ((system, ranking, k), (system, ranking, k, language))""",
    "facts": "SELECT id, CASE WHEN num % 13 <> 0 THEN text END AS facts FROM corpus",
    "candidates": """SELECT v.id, m.language, m.date_ms, CASE WHEN m.id IS NULL THEN 'metadata' WHEN m.language NOT IN ('de', 'fr', 'es') THEN 'language' WHEN m.date_ms <= 0 THEN 'date'
        WHEN v.id NOT IN (SELECT id FROM nodes) THEN 'graph' WHEN v.id NOT IN (SELECT id FROM facts WHERE trim(coalesce(facts, '')) <> '') THEN 'facts'
        WHEN v.id NOT IN (SELECT query_id FROM truth) THEN 'ground_truth' ELSE 'kept' END AS reason FROM valid v LEFT JOIN meta m ON m.id = v.id""",
    "sample": """SELECT id, language, date_ms, row_number() OVER (ORDER BY md5('42:all:' || id), id) AS pos FROM (
        SELECT id, language, date_ms, row_number() OVER (PARTITION BY language ORDER BY md5('42:' || id), id) AS n FROM candidates WHERE reason = 'kept') WHERE n <= 12""",
    "breakdown": """SELECT e.src AS query_id, e.dst AS id, CASE WHEN e.dst IN (SELECT id FROM valid) AND m.date_ms > 0 AND m.date_ms < s.date_ms THEN 'kept' WHEN e.dst NOT IN (SELECT id FROM valid) THEN 'not_in_VG'
        WHEN coalesce(m.date_ms, 0) <= 0 THEN 'date_missing' WHEN m.date_ms >= s.date_ms THEN 'temporal_fail' ELSE 'other' END AS reason
        FROM edges e JOIN sample s ON s.id = e.src LEFT JOIN meta m ON m.id = e.dst WHERE e.type = 'case_to_case'""",
    "asked": "SELECT query_id FROM (SELECT DISTINCT query_id FROM truth) ORDER BY md5('42:' || query_id), query_id LIMIT 200",
    "drawn": "SELECT id FROM corpus ORDER BY md5('43:' || id), id LIMIT 400",
    "pairs": """SELECT query_id, id, 'cited' AS kind FROM truth WHERE query_id IN (SELECT query_id FROM asked) UNION ALL
        SELECT query_id, id, 'random' FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY md5('42:' || query_id || ':' || id), id) AS n
        FROM asked CROSS JOIN drawn WHERE query_id <> id AND (query_id, id) NOT IN (SELECT (query_id, id) FROM truth)) WHERE n <= 20""",
    "deltas": """SELECT query_id, mean_cited, mean_random, mean_cited - mean_random AS delta FROM (
        SELECT query_id, avg(list_cosine_similarity(a.vector, b.vector)) FILTER (kind = 'cited') AS mean_cited, avg(list_cosine_similarity(a.vector, b.vector)) FILTER (kind = 'random') AS mean_random
        FROM pairs p JOIN corpus a ON a.id = p.query_id JOIN corpus b ON b.id = p.id GROUP BY query_id) WHERE mean_cited IS NOT NULL AND mean_random IS NOT NULL""",
    "ends": "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id",
    "top_seeds": "SELECT id, row_number() OVER (ORDER BY in_degree DESC, id) AS rank FROM degree ORDER BY in_degree DESC, id LIMIT 30",
    "top_citers": """SELECT * FROM (SELECT e.src, e.dst, e.type, s.rank, row_number() OVER (PARTITION BY e.dst ORDER BY n.degree DESC, e.src) AS nth
        FROM edges e JOIN top_seeds s ON s.id = e.dst JOIN ends n ON n.id = e.src) WHERE nth <= 5""",
    "top_nodes": """SELECT * FROM (SELECT id, row_number() OVER (ORDER BY a, b, c) AS place FROM (
        SELECT id, min((a, b, c)) AS m, (m)[1] AS a, (m)[2] AS b, (m)[3] AS c FROM (SELECT id, 0 AS a, rank AS b, 0 AS c FROM top_seeds UNION ALL SELECT src, 1, rank, nth FROM top_citers) GROUP BY id)) WHERE place <= 60""",
    "c_near": "SELECT p.id, p.chunk_index, round(list_cosine_similarity(c.vector, p.vector), 9) AS score FROM (SELECT vector FROM corpus WHERE id = '33') c CROSS JOIN rulings p",
    "c_seeds": "SELECT * FROM (SELECT id, max(score) AS score, row_number() OVER (ORDER BY max(score) DESC, id) AS seed_rank FROM c_near GROUP BY id) WHERE seed_rank <= 20",
    "c_g1": """SELECT id, row_number() OVER (ORDER BY coalesce(in_degree, 0) DESC, id) AS n FROM (SELECT DISTINCT a.b AS id FROM c_seeds s JOIN around a ON a.a = s.id) LEFT JOIN degree USING (id)
        WHERE id NOT IN (SELECT id FROM c_seeds)""",
    "c_g2": """SELECT id, row_number() OVER (ORDER BY coalesce(in_degree, 0) DESC, id) AS n FROM (SELECT id FROM c_g1 WHERE n <= 256 UNION SELECT a.b FROM c_g1 f JOIN around a ON a.a = f.id WHERE n <= 256)
        LEFT JOIN degree USING (id) WHERE id NOT IN (SELECT id FROM c_seeds)""",
    "c_e1": """SELECT id, row_number() OVER (ORDER BY score DESC, id) AS n FROM (SELECT k.id, max(k.score) AS score FROM c_seeds s JOIN knn k ON k.node = s.id
        AND k.rank <= 3 * greatest(10, 64 // (SELECT count(*) FROM c_seeds)) GROUP BY k.id) WHERE id NOT IN (SELECT id FROM c_seeds)""",
    "c_front": "SELECT id FROM c_e1 WHERE n <= 64 ORDER BY id LIMIT 10",
    "c_e2": """SELECT id, row_number() OVER (ORDER BY score DESC, id) AS n FROM (SELECT id, max(score) AS score FROM (SELECT k.id, k.score FROM c_front f JOIN knn k ON k.node = f.id
        AND k.rank <= 3 * greatest(10, 128 // (SELECT count(*) FROM c_front)) UNION ALL SELECT id, 1.0 FROM c_e1 WHERE n <= 64) GROUP BY id) WHERE id NOT IN (SELECT id FROM c_seeds)""",
    "c_pools": "SELECT s.system, id, true AS is_seed, seed_rank FROM c_seeds CROSS JOIN (VALUES ('rag'), ('emb_1hop'), ('emb_2hop'), ('graph_1hop'), ('graph_2hop')) s(system)"
    + "".join(f" UNION ALL SELECT '{s}', id, false, NULL FROM {c} WHERE n <= {cap}" for s, c, cap in (("emb_1hop", "c_e1", 64), ("emb_2hop", "c_e2", 128), ("graph_1hop", "c_g1", 64), ("graph_2hop", "c_g2", 128))),
    "custom": """SELECT p.system, 'custom' AS query_id, p.id, p.rank, substr(coalesce(c.text, ''), 1, 80) AS excerpt FROM (
        SELECT system, id, row_number() OVER (PARTITION BY system ORDER BY round(ln(1 + coalesce(in_degree, 0)), 9) DESC, is_seed DESC, seed_rank NULLS LAST, id) AS rank FROM c_pools LEFT JOIN degree USING (id)) p
        LEFT JOIN corpus c ON c.id = p.id WHERE p.rank <= 10""",
    "log": """SELECT (event_id % 7)::BIGINT AS run_id, event_id AS line_no, CASE WHEN event_type = 'error' THEN '12:00 === ' || upper(s) || ' FAILED ===' WHEN event_type = 'signup' THEN '=== SKIP ' || s || ' ==='
        WHEN event_type = 'purchase' THEN '=== ' || upper(s) || ' finished in 3 s ===' WHEN event_type = 'view' THEN '=== ' || upper(s) || ' started ===' ELSE 'progress ' || event_id END AS line
        FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'sample' WHEN 1 THEN 'retrieval' ELSE 'metrics' END AS s FROM events)""",
    "runs": "SELECT run_id, CASE run_id WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'aborted' ELSE 'running' END AS status, run_id = 3 AS skip_sample, run_id = 4 AS skip_retrieval, false AS skip_metrics FROM (SELECT unnest(range(9))::BIGINT AS run_id)",
    "states": """SELECT run_id, line_no, lower(CASE WHEN skip_ <> '' THEN skip_ ELSE stage_ END) AS stage, CASE WHEN skip_ <> '' THEN 'skipped' WHEN action = 'started' THEN 'running' WHEN action = 'finished' THEN 'done' ELSE 'failed' END AS state
        FROM (SELECT run_id, line_no, regexp_extract(line, '=== SKIP (\\w+)', 1) AS skip_, regexp_extract(line, '=== (\\w+) (started|finished|FAILED)', 1) AS stage_, regexp_extract(line, '=== (\\w+) (started|finished|FAILED)', 2) AS action FROM log)
        WHERE skip_ <> '' OR action <> ''""",
}

_WORD = re.compile(r"\b[a-z_0-9]+\b")


def with_relations(sql: str) -> str:
    """``sql`` behind the relations that it uses, in their order."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(_WORD.findall(todo.pop())) & RELATIONS.keys() - wanted:
            wanted.add(name)
            todo.append(RELATIONS[name])
    parts = [f"{n} AS MATERIALIZED ({body})" for n, body in RELATIONS.items() if n in wanted]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
