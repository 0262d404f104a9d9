"""The catalogue against its SQL at the smallest scale, invariants of results, and the driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrand.operators import retrieval, vectors
from lodestrand.plans import catalogue
from lodestrand.plans.world import World

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return str(value) if value is not None else None


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.fixture(scope="module")
def registry():
    return catalogue.queries()


@pytest.mark.parametrize("name", list(catalogue.ENTRIES))
def test_against_sql(spark, database, registry, name):
    df = registry[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(F.col(f"`{c}`") for c in columns)).collect()), key=str)
    rel = database.sql(catalogue.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


#: Queries whose vector search has more than a block of nodes at 0.1 GB.
BY_BLOCKS = [
    "candidate_pools",
    "comparison_table",
    "configurations",
    "csv_round_trip",
    "dcg_at_k",
    "drilldown_delta_sorted",
    "derived_smaller_k",
    "drilldown_language",
    "drilldown_filtered",
    "drilldown_page",
    "emb_1hop_pool",
    "drilldown_pool",
    "drilldown_ranked",
    "emb_1hop_raw",
    "emb_1hop_timely",
    "emb_2hop_pool",
    "emb_2hop_timely",
    "emb_2hop_raw",
    "f1_at_k",
    "graph_nearness_directed",
    "heatmap_all_languages",
    "gt_rank_table",
    "heatmap_shades",
    "hit_rate",
]


@pytest.fixture(scope="module")
def registry_by_blocks():
    """Queries whose searches all join blocks of queries with blocks of points, as they do over many queries."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setitem(vectors.nearest.__kwdefaults__, "block", 50)
        yield catalogue.queries()


@pytest.mark.parametrize("name", BY_BLOCKS)
def test_against_sql_by_blocks(spark, database, registry_by_blocks, name):
    test_against_sql(spark, database, registry_by_blocks, name)


@pytest.fixture(scope="module")
def world(spark):
    return World(spark, SF)


def test_cosine_lists_of_grown_systems_are_those_of_the_seeds(world):
    """As long as there are enough seeds with positive scores."""
    enough = world.found.seeds.where("score > 0").groupBy("query_id").count().where("count >= 10").select("query_id")
    one = world.results.where("ranking = 'cosine' AND k = 10 AND system <> 'rag_smart'").join(enough, "query_id")
    assert one.groupBy("query_id", "rank").agg(F.count_distinct("id").alias("n")).where("n > 1").count() == 0


def test_monotone_in_k(world):
    by = world.accuracy.groupBy("system", "ranking", "query_id").agg(F.array_sort(F.collect_list(F.struct("k", "n_hits", "recall", "mrr"))).alias("x")).collect()
    for r in by:
        for a, b in zip(r.x[:-1], r.x[1:]):
            assert a.n_hits <= b.n_hits and a.recall <= b.recall and a.mrr <= b.mrr


def test_layers_shrink_and_dates_lose_no_truth(world):
    for r in world.layers.groupBy("system", "query_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct("pool_size", "hits")))).alias("s")).collect():
        s = r.s
        if "raw" in s:
            assert s["raw"].hits == s["post_temporal"].hits >= s["post_cap"].hits >= s["seeds"].hits
            assert s["raw"].pool_size >= s["post_temporal"].pool_size >= s["post_cap"].pool_size


def test_recall_is_below_its_ceiling_and_buckets_add_up(world):
    top = world.pool_metrics.select("system", "query_id", F.col("recall").alias("most"))
    assert world.accuracy.join(top, ["system", "query_id"]).where("recall > most + 1e-9").count() == 0
    lengths = world.results.groupBy("system", "ranking", "k", "query_id").agg(F.count(F.lit(1)).alias("n"))
    near = world.nearness.join(lengths, ["system", "ranking", "k", "query_id"])
    assert near.where("n_exact + n_near_1 + n_near_2 + n_far <> n OR nearness_score > nearness_score_undirected + 1e-9").count() == 0


def test_pools_have_no_query_of_known_date(world):
    assert world.found.pools().where("query_id = id").count() == 0


def test_custom_query(spark, registry):
    rows = registry["custom_query"](spark, SF).collect()
    assert {r.system for r in rows} == {"rag", "emb_1hop", "emb_2hop", "graph_1hop", "graph_2hop"}
    assert all(r.rank <= 10 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_parts():
    code = "import sys; sys.modules['lodestrand.llm'] = None\nimport lodestrand.plans.catalogue, lodestrand.streaming.progress, lodestrand.sources.sinks, lodestrand.operators.views\nassert not any(m.startswith('lodestrand.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_without_the_optional_parts(tmp_path):
    """A copy without the training-data operators, with and without the pipeline's file, still registers and runs the rest."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and set(e.oracle_sql()) <= names and 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names)"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)


def test_pair_scores_in_parts_are_those_in_one(world):
    pools, texts = world.found.pools().where("system = 'rag'"), world.engine.texts
    one, parts = (retrieval.pair_scores(pools, world.query_texts, texts, at_once=n) for n in (10**9, 1000))
    assert len(parts.inputFiles()) > len(one.inputFiles())
    assert sorted(parts.collect()) == sorted(one.collect()) and one.count()


def test_pair_scores_meet_once_a_pair_by_blocks_of_queries(spark, world, monkeypatch):
    """What two texts share is worked out once a pair, not once for each place of a score that names it."""
    counted = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def shared(a, b):
        counted.add(1)
        return len(set(a) & set(b))

    class Counting(vectors.Overlap):
        def meet(self, a, b):
            return shared(a, b)

    pools, texts = world.found.pools().where("system = 'rag'"), world.engine.texts
    one = retrieval.pair_scores(pools, world.query_texts, texts)
    monkeypatch.setattr(vectors, "BLOCK", 50)
    many = retrieval.pair_scores(pools, world.query_texts, texts, Counting())
    assert counted.value == many.count() and len(many.inputFiles()) > len(one.inputFiles())
    assert sorted(many.collect()) == sorted(one.collect())


@pytest.mark.parametrize("block", [1024, 40])
def test_second_hop_leaves_nothing_of_the_first_out(world, block):
    """Each timely id of the first hop is in the second and starts from there, beyond the frontier and the cap of pools too."""
    found, s = world.found, world.settings
    first, seeds, dates = {}, {}, {r.id: r.date_ms for r in world.dates.collect()}
    for rows, into in ((found.stages("emb_1hop")["post_temporal"], first), (found.seeds, seeds)):
        for r in rows.collect():
            into.setdefault(r.query_id, []).append(r.id)
    assert max(map(len, first.values())) > s.cap_1hop > s.frontier
    near = {}
    for r in vectors.nearest(world.rulings.where("chunk_index = 0").selectExpr("id AS query_id", "vector", "400 AS depth", "CAST(NULL AS long) AS before", "CAST(NULL AS string) AS skip"), world.rulings).collect():
        near.setdefault(r.query_id, []).append((-r.score, r.id, r.chunk_index))
    near = {node: sorted(rows) for node, rows in near.items()}
    want = {}
    for q, hop in first.items():
        for node in hop:
            want[q, node] = 1.0
            for minus, id_, _ in near[node][: 3 * max(10, s.cap_2hop // len(hop))]:
                if id_ != q and id_ not in seeds[q] and (dates.get(id_) is None or dates.get(q) is None or dates[id_] < dates[q]):
                    want[q, id_] = max(want.get((q, id_), -2.0), -minus)
    got = vectors.Expansion(world.rulings, world.dates).two_hop_whole(found.seeds, found.stages("emb_1hop")["post_temporal"], found.dates, s.cap_2hop, block=block).collect()
    assert {(r.query_id, r.id): r.score for r in got} == want and len(got) == len(want)
    capped = {(r.query_id, r.id) for r in found.stages("emb_2hop")["post_temporal"].collect()}
    assert capped < want.keys()
