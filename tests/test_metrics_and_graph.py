"""Micro-fixtures with results worked out by hand."""

import math
import random

import numpy as np
import pytest

from lodestrand.operators import graph, metrics, retrieval, sampling, vectors


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def results(spark, ids, k):
    return table(spark, [("s", "cosine", k, "q", x, i + 1) for i, x in enumerate(ids)], "system string, ranking string, k int, query_id string, id string, rank int")


def scored(spark, ids, truth, k):
    queries = table(spark, [("q", "de", 2000)], "query_id string, language string, year int")
    gt = table(spark, [("q", x) for x in truth], "query_id string, id string")
    return metrics.accuracy(results(spark, ids, k), gt, queries).first()


def test_accuracy(spark):
    r = scored(spark, ["a", "x", "b", "y", "z"], ["a", "b", "c"], 5)
    assert (r.precision, r.f1, r.mrr) == (0.4, 0.5, 1.0)
    assert r.recall == pytest.approx(2 / 3) and r.dcg == pytest.approx(1.5) and r.ndcg == pytest.approx(0.703918, abs=1e-6)
    assert scored(spark, ["a", "x"], ["a"], 5).precision == 0.2
    none = scored(spark, ["x"], ["a"], 5)
    assert (none.mrr, none.f1, none.ndcg) == (0, 0, 0)
    empty = scored(spark, ["x"], [], 5)
    assert (empty.recall, empty.ndcg, empty.n_ground_truth) == (0, 0, 0)


def slow_distances(edges, pairs, directed):
    """{(target, id): hops up to 2} by breadth-first search from every id."""
    ahead = {}
    for a, b, _ in edges:
        ahead.setdefault(a, set()).add(b)
        if not directed:
            ahead.setdefault(b, set()).add(a)
    out = {}
    for id_, target in pairs:
        near, reached = {id_}, {id_}
        for d in range(3):
            if target in near:
                out[target, id_] = d
                break
            near = set().union(*(ahead.get(x, set()) for x in near)) - reached
            reached |= near
    return out


def test_nearness(spark):
    edges = table(spark, [("x", "a", "case_to_case"), ("y", "x", "case_to_case"), ("a", "w", "case_to_case")], "src string, dst string, type string")
    truth = table(spark, [("q", "a")], "query_id string, id string")
    pairs = table(spark, [(x, "a") for x in "axywz"], "id string, target string")
    r = metrics.nearness(results(spark, ["a", "x", "y", "w"], 4), truth, graph.distances_between(edges, pairs), graph.distances_between(edges, pairs, directed=False)).first()
    assert r.nearness_score == pytest.approx(0.458333, abs=1e-6) and (r.n_exact, r.n_near_1, r.n_near_2, r.n_far) == (1, 1, 1, 1)
    assert r.nearness_score_undirected == pytest.approx(0.583333, abs=1e-6)
    assert (r.n_near_1_undirected, r.n_near_2_undirected, r.n_far_undirected) == (2, 1, 0)
    gone = table(spark, [("q", "missing")], "query_id string, id string")
    nothing = graph.distances_between(edges.limit(0), table(spark, [("missing", "missing"), ("x", "missing")], "id string, target string"))
    r = metrics.nearness(results(spark, ["missing", "x"], 2), gone, nothing, nothing).first()
    assert (r.n_exact, r.n_far, r.nearness_score) == (1, 1, 0.5)


@pytest.mark.parametrize("directed", [True, False])
def test_distances_against_a_search(spark, directed):
    """A hub on either side, loops, repeated edges and pairs of ids that have none."""
    r = random.Random(4)
    ids = [str(i) for i in range(25)]
    made = [("0", x, "t") for x in ids[1:20]] + [(x, "1", "t") for x in ids[2:22]] + [(r.choice(ids), r.choice(ids), "t") for _ in range(25)] + [("3", "3", "t")]
    asked = [(a, b) for a in [*ids, "gone"] for b in [*ids[:12], "none"]]
    edges, pairs = table(spark, made + made[:5], "src string, dst string, type string"), table(spark, asked, "id string, target string")
    got = {(x.target, x.id): x.d for x in graph.distances_between(edges, pairs, directed=directed).collect()}
    assert got == slow_distances(made, asked, directed)


def test_graph_build(spark):
    rows = table(spark, [("r1", "['r2','r2','r1','']", "['L1']", 0), ("r2", None, "['r2','L1']", 1), ("r3", "nope", "['r9']", 2), ("r4", "['r9']", "", 3)],
                 "decision_id string, cited_rulings string, laws string, pos long")
    cited = graph.citations(rows)
    assert {tuple(r) for r in graph.edges(cited).collect()} == {
        ("r1", "r2", "case_to_case"), ("r1", "L1", "case_to_law"), ("r2", "L1", "case_to_law"), ("r3", "r9", "case_to_law"), ("r4", "r9", "case_to_case"),
    }
    assert dict(graph.nodes(rows, cited).collect()) == {"r1": "ruling", "r2": "ruling", "r3": "ruling", "r4": "ruling", "L1": "law", "r9": "law"}
    r = graph.build_counts(rows, cited).first()
    assert (r.rows, r.case_edges, r.law_edges, r.skipped) == (4, 3, 3, 3)
    again = graph.citations(table(spark, [("a", "['b']", "['b']", 0)], "decision_id string, cited_rulings string, laws string, pos long"))
    assert graph.edges(again).first().type == "case_to_law"


def expansion(spark, dates=()):
    edges = table(spark, [("q", "a", "c"), ("b", "s", "c"), ("s", "c", "c"), ("c", "d", "c"), ("s", "L1", "l")], "src string, dst string, type string")
    nodes = table(spark, [(x, "ruling") for x in "qabscd"] + [("L1", "law")], "id string, source string")
    known = table(spark, list(dates), "id string, date_ms long")
    seeds = table(spark, [("q", "s")], "query_id string, id string")
    when = table(spark, [("q", 100)], "query_id string, query_date long")
    return graph.Expansion(edges, nodes, known, graph.in_degree(edges)), seeds, when


def ids(df):
    return {r.id for r in df.collect()}


def test_expansion(spark):
    e, seeds, when = expansion(spark)
    assert ids(e.one_hop(seeds, when, 10)["raw"]) == {"b", "c"}
    assert ids(e.two_hop(seeds, when, 10)["raw"]) == {"b", "c", "d"}
    e, seeds, when = expansion(spark, [("c", 100), ("d", 5)])
    assert ids(e.one_hop(seeds, when, 10)["post_temporal"]) == {"b"}
    two = e.two_hop(seeds, when, 10)
    assert ids(two["raw"]) == ids(two["post_cap"]) == {"b"}


def test_cap_breaks_ties_by_id(spark):
    e, *_ = expansion(spark)
    e.degree = table(spark, [("a", 3), ("b", 1), ("c", 1)], "id string, in_degree long")
    for order in ("dcba", "abcd", "cdab"):
        assert ids(e.capped(table(spark, [("q", x) for x in order], "query_id string, id string"), 2)) == {"a", "b"}


def pool(spark):
    rows = [("s", "q", "s1", 0.9, True, 1), ("s", "q", "s2", 0.2, True, 2), ("s", "q", "s3", -0.1, True, 3), ("s", "q", "e2", 0.0, False, None), ("s", "q", "e1", 0.0, False, None)]
    return table(spark, rows, "system string, query_id string, id string, score double, is_seed boolean, seed_rank int")


def order(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_rankings(spark):
    degree = table(spark, [("e1", 5), ("s2", 5), ("s3", 1)], "id string, in_degree long")
    assert order(retrieval.rank(pool(spark), "cosine", degree)) == ["s1", "s2", "e1", "e2", "s3"]
    assert order(retrieval.rank(pool(spark), "indegree", degree)) == ["s2", "e1", "s3", "s1", "e2"]
    scores = table(spark, [("q", "e2", 0.5), ("q", "s3", 0.1)], "query_id string, id string, pair_score double")
    assert order(retrieval.rank(pool(spark), "cross_encoder", degree, scores)) == ["e2", "s3", "s1", "s2", "e1"]
    assert retrieval.rank(pool(spark), "cross_encoder", degree).count() == 0
    failed = table(spark, [("q",)], "query_id string")
    assert retrieval.rank(pool(spark), "cross_encoder", degree, scores, failed).count() == 0
    with pytest.raises(ValueError, match="no such ranking"):
        retrieval.rank(pool(spark), "other", degree)
    with pytest.raises(ValueError, match="no such system"):
        retrieval.Settings(systems=("other",))


def test_cut_offs_are_prefixes_and_can_be_derived(spark):
    degree = table(spark, [], "id string, in_degree long")
    ranked = retrieval.rank(pool(spark), "cosine", degree)
    cut = retrieval.cut_off(ranked, (2, 4)).drop("value")
    lists = {k: [r.id for r in cut.where(f"k = {k}").orderBy("rank").collect()] for k in (2, 4)}
    assert lists[4][:2] == lists[2] and len(lists[4]) == 4
    derived = retrieval.derive_smaller(cut.where("k = 4"), (2, 3, 4, 9))
    assert sorted({r.k for r in derived.collect()}) == [2, 3, 4]


def test_summaries(spark):
    rows = [("s", "cosine", 5, "q1", "de", 0.2, 1.0), ("s", "cosine", 5, "q2", "fr", 0.0, 0.0)]
    df = table(spark, rows, "system string, ranking string, k int, query_id string, language string, precision double, recall double")
    both = {r.language: r for r in metrics.both_summaries(df).collect()}
    assert both["all"].n_queries == 2 and both["all"].hit_rate == 0.5 and both["all"].mean_recall == 0.5
    assert both["de"].hit_rate == 1.0 and both["fr"].mean_precision == 0.0
    assert math.isclose(metrics.summary(df).first().mean_precision, 0.1)
    diff = metrics.id_difference(df.select("query_id"), table(spark, [("q1",), ("q9",)], "query_id string")).first()
    assert tuple(diff) == (1, 1, 2, True)


def test_run_plan():
    plan = lambda n, **k: sampling.run_plan(n, **({"available": {"de": 50, "fr": 40, "it": 60}, "at_hand": {"de": 10, "fr": 10, "it": 9}, "may_reuse": True} | k))
    assert plan(29) == sampling.RunPlan(27, 0, True)
    assert plan(30) == sampling.RunPlan(30, 10, False)
    assert plan(10_000) == sampling.RunPlan(120, 40, False)
    assert plan(9, may_reuse=False) == sampling.RunPlan(9, 3, False)
    assert plan(0) == plan(-5) == sampling.RunPlan(0, 0, True) == plan(None)


def searched(spark, seed=3, n=300, dims=8):
    """Points around a few centres, some without a vector or a date, and queries, as tables and as rows."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    points = [(f"p{i % 150}", i // 150, None if i % 41 == 0 else (centres[i % 6] + 0.3 * r.normal(size=dims)).astype(np.float32).tolist(), None if i % 11 == 0 else i) for i in range(n)]
    queries = [(f"q{i}", None if i == 7 else (centres[i % 6] + 0.3 * r.normal(size=dims)).astype(np.float32).tolist(), 5 + i % 3, None if i % 4 == 0 else 200, "p3" if i % 2 else None) for i in range(40)]
    as_table = (spark.createDataFrame(points, "id string, chunk_index int, vector array<float>, date_ms long"), spark.createDataFrame(queries, "query_id string, vector array<float>, depth int, before long, skip string"))
    return points, queries, *as_table


def slow_nearest(points, queries):
    out = set()
    for q, v, depth, before, skip in queries:
        if v is None:
            continue
        found = []
        for id_, chunk, vector, date in points:
            if vector is None or id_ == skip or (before is not None and (date is None or date >= before)):
                continue
            a, b = np.array(v, float), np.array(vector, float)
            found.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9), id_, chunk))
        out |= {(q, i, c) for _, i, c in sorted(found)[:depth]}
    return out


def test_exact_search(spark):
    """Broadcast or in blocks, null vectors or not: the neighbours by brute force."""
    points, queries, p, q = searched(spark)
    want = slow_nearest(points, queries)
    for block in (4096, 7):
        assert {(r.query_id, r.id, r.chunk_index) for r in vectors.nearest(q, p.repartition(3), block=block).collect()} == want
    assert vectors.nearest(q, p.limit(0)).count() == vectors.nearest(q.limit(0), p).count() == 0


def test_cells(spark, monkeypatch):
    """All cells: exact. Some: at least nine in ten neighbours."""
    monkeypatch.setattr(vectors, "POINTS", 40)
    points, queries, p, q = searched(spark)
    index = vectors.CellIndex(p, 12, sample=200)
    got = {(r.query_id, r.id, r.chunk_index) for r in index.nearest(q, 12).collect()}
    assert got == slow_nearest(points, queries)
    few = index.recall(q, 4).first()
    assert few.n_queries == 39 and few.recall >= 0.9


def test_smart_seeds_look_further_for_dated_queries(spark):
    points = spark.createDataFrame([(f"p{i}", 0, [1.0, i / 100], i) for i in range(60)], "id string, chunk_index int, vector array<float>, date_ms long")
    degree = spark.createDataFrame([("p30", 9), ("p12", 5)], "id string, in_degree long")
    asked = spark.createDataFrame([("dated", [1.0, 0.0], 1000, None), ("undated", [1.0, 0.0], None, None)], "query_id string, vector array<float>, before long, skip string")
    got = vectors.smart_seeds(asked, points, degree, 2, overfetch=24, undated=8).where("seed_rank = 1").collect()
    assert {r.query_id: r.id for r in got} == {"dated": "p30", "undated": "p12"}


def test_distances_in_parts_are_those_in_one(spark):
    edges = spark.createDataFrame([(str(a), str((a * a + k) % 40), "t") for a in range(40) for k in range(3)], "src string, dst string, type string")
    pairs = spark.range(40).selectExpr("cast(id as string) AS id").crossJoin(spark.range(42).selectExpr("cast(id as string) AS target"))
    for directed in (True, False):
        held = []
        got = graph.distances_between(edges, pairs, directed=directed, hold=lambda df: held.append(1) or df, middle_rows=500)
        assert sorted(got.collect()) == sorted(graph.distances_between(edges, pairs, directed=directed).collect())
        assert len(held) > 4
