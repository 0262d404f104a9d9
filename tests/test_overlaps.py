"""Sets that meet in blocks against plain intersections, and what the queries on lists leave out because it isn't asked for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import graph, metrics, overlaps, vectors
from lodestrand.plans import catalogue
from lodestrand.plans.world import World

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("kind", "blocks"), [("long", (7, 5)), ("string", (7, 5)), ("long", (512, 16_384))])
def test_shared_members_by_blocks(spark, monkeypatch, kind, blocks):
    monkeypatch.setattr(overlaps, "BESIDE", 3)
    r, cast = random.Random(5), int if kind == "long" else str
    left = {f"l{i}": [cast(x) for x in r.sample(range(30), r.randrange(12))] for i in range(20)}
    right = {f"r{i}": [cast(x) for x in r.sample(range(30), r.randrange(12))] for i in range(20)}
    pairs = [(a, b) for a in [*left, "gone"] for b in [*right, "none"] if r.random() < 0.6]
    got = overlaps.shared(
        spark.createDataFrame(pairs, "l string, r string"), spark.createDataFrame(list(left.items()), f"l string, a array<{kind}>"),
        spark.createDataFrame(list(right.items()), f"r string, b array<{kind}>"), left_block=blocks[0], right_block=blocks[1],
    )
    want = [(a, b, len(left[a]), len(right[b]), len(set(left[a]) & set(right[b]))) for a, b in pairs if a in left and b in right]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("most", [0, 4, 1024])
def test_distances_by_sets(spark, directed, most):
    """With hubs on either side, loops and ids that have no edges; of large sets none, some and all."""
    r = random.Random(4)
    ids = [str(i) for i in range(25)]
    made = [("0", x, "t") for x in ids[1:20]] + [(x, "1", "t") for x in ids[2:22]] + [(r.choice(ids), r.choice(ids), "t") for _ in range(25)] + [("3", "3", "t")]
    pairs = spark.createDataFrame([(a, b) for a in [*ids, "gone"] for b in [*ids[:12], "none"]], "id string, target string")
    edges = spark.createDataFrame(made + made[:5], "src string, dst string, type string")
    got = graph.distances_by_sets(edges, pairs, lambda df: df, directed=directed, most=most)
    assert sorted(got.collect()) == sorted(graph.distances_between(edges, pairs, directed=directed).collect())


@pytest.mark.parametrize("name", ["drilldown_language", "drilldown_ranked", "drilldown_filtered", "drilldown_page", "drilldown_delta_sorted", "heatmap_all_languages", "graph_nearness_directed"])
def test_queries_ask_for_no_distances_that_they_do_not_return(spark, monkeypatch, name):
    asked = []

    def noted(edges, pairs, hold, *, directed=True, real=graph.distances_by_sets):
        asked.append(directed)
        return real(edges, pairs, hold, directed=directed)

    monkeypatch.setattr(graph, "distances_by_sets", noted)
    monkeypatch.setattr(metrics, "per_query", None)
    if name == "drilldown_language":
        monkeypatch.setattr(World, "scores", None)
    assert catalogue.queries()[name](spark, SF).count()
    assert asked == ([True] if name == "graph_nearness_directed" else [])


def test_accuracy_of_one_cut_off_is_that_of_all(spark):
    one, all_ = World(spark, SF), World(spark, SF)
    got = one.accuracy_at("indegree", 5)
    assert "results" not in one.__dict__ and "scores" not in one.__dict__
    want = all_.accuracy.where("ranking = 'indegree' AND k = 5")
    assert sorted(got.collect()) == sorted(want.collect()) == sorted(all_.accuracy_at("indegree", 5).collect()) and want.where(F.col("n_hits") > 0).count()


@pytest.mark.parametrize("block", [1024, 30])
def test_second_hop_of_pools_by_blocks_is_that_of_all_stages(spark, block):
    w = World(spark, SF)
    want, first = w.found.stages("graph_2hop")["post_cap"], w.found._graph
    got = first.two_hop_capped(w.found.seeds, w.found.dates, w.settings.cap_2hop, block=block)
    assert sorted(got.collect()) == sorted(want.select("query_id", "id").collect()) and want.count()
    few = first.two_hop(w.found.seeds, w.found.dates, 3)["post_cap"].select("query_id", "id")
    assert sorted(first.two_hop_capped(w.found.seeds, w.found.dates, 3, block=block).collect()) == sorted(few.collect())


def test_pools_make_no_raw_second_hops(spark, monkeypatch):
    monkeypatch.setattr(graph.Expansion, "two_hop", None)
    w = World(spark, SF)
    assert w.found.pools().where("system = 'graph_2hop'").count()


def test_right_sets_are_shipped_once_a_large_block_of_left_ones(spark, monkeypatch):
    """18,000 left sets are 24 blocks, not one for each 512."""
    seen, real = [], overlaps.F.sequence
    monkeypatch.setattr(overlaps.F, "sequence", lambda *ends: seen.append(str(ends[1])) or real(*ends))
    left = spark.range(18000).selectExpr("CAST(id AS string) AS l", "array(id, id + 1) AS a")
    right = spark.range(9000).selectExpr("CAST(id AS string) AS r", "array(id) AS b")
    pairs = spark.range(8990).selectExpr("CAST(id AS string) AS l", "CAST(id + id % 3 AS string) AS r")
    got = overlaps.shared(pairs, left, right)
    assert seen == ["Column<'23'>"]
    assert got.where("met = CASE WHEN CAST(r AS int) - CAST(l AS int) < 2 THEN 1 ELSE 0 END").count() == 8990


@pytest.mark.parametrize("depth", [1, 7, 400])
def test_search_in_single_precision_loses_nothing(depth):
    """Against all scores in double precision, with repeated vectors (ties), dates, ids that are left out and vectors without length."""
    r = np.random.default_rng(depth)
    points = r.normal(size=(4000, 16)) + 40  # near each other: single precision can't tell them apart
    points[2000:2400], points[5] = points[:400], 0
    ids = [str(x) for x in r.integers(0, 2000, 4000)]
    known, asked = r.random(4000) < 0.9, points[::40]
    when = np.where(known, r.integers(0, 30, 4000), 0)
    before, skip = [None if i % 4 == 0 else i % 31 for i in range(100)], [None if i % 5 == 0 else ids[40 * i] for i in range(100)]
    q, p, s = vectors._Asked([str(i) for i in range(100)], asked, [depth] * 100, before, skip).best(ids, known, when, points)
    unit = vectors._unit(points)
    for i in range(100):
        seen = [j for j in range(4000) if ids[j] != skip[i] and (before[i] is None or known[j] and when[j] < before[i])]
        score = np.round(unit[seen] @ vectors._unit(asked)[i], 9)
        least = sorted(score)[-depth:][0] if len(seen) else 2
        assert sorted(zip(p[q == i].tolist(), s[q == i].tolist())) == [(j, x) for j, x in zip(seen, score.tolist()) if x >= least]


def test_a_drill_down_makes_the_systems_that_it_shows(spark, monkeypatch):
    want = sorted(map(str, catalogue.ENTRIES["drilldown_ranked"].query(World(spark, SF)).collect()))
    for owner, name in ((vectors, "smart_seeds"), (vectors, "Expansion"), (graph.Expansion, "two_hop"), (graph.Expansion, "two_hop_capped")):
        monkeypatch.setattr(owner, name, None)
    assert sorted(map(str, catalogue.ENTRIES["drilldown_ranked"].query(World(spark, SF)).collect())) == want and want


def test_accuracy_of_some_systems_is_that_of_all(spark):
    one, all_ = World(spark, SF), World(spark, SF)
    got = one.accuracy_at("cross_encoder", 10, ("rag", "graph_1hop")).collect()
    want = all_.accuracy.where("ranking = 'cross_encoder' AND k = 10 AND system IN ('rag', 'graph_1hop')").collect()
    assert sorted(got) == sorted(want) == sorted(all_.accuracy_at("cross_encoder", 10, ("rag", "graph_1hop")).collect()) and want
