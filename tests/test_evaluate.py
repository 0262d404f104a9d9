import pytest
from pyspark.sql import functions as F

from lodestrand.__main__ import main
from lodestrand.plans import evaluate as ev
from lodestrand.plans.world import World

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    return World(spark, SF)


def test_run_cancel_and_resume(spark, world, tmp_path):
    settings = world.settings.but(systems=("rag", "graph_1hop"), ks=(5, 10))
    few = world.queries.where("int(query_id) < 60")
    folder, events = str(tmp_path / "run"), []
    with pytest.raises(ev.Cancelled):
        ev.evaluate(world.engine, few, world.truth, folder, settings, on_event=events.append, cancelled=lambda: len(events) > 2)
    assert [e["type"] for e in events] == ["stage_started", "stage_done", "stage_started", "stage_done", "aborted"] or events[-1]["type"] == "aborted"
    half = few.where("int(query_id) % 2 = 0")
    whole = ev.evaluate(world.engine, few, world.truth, str(tmp_path / "whole"), settings)
    ev.evaluate(world.engine, half, world.truth, folder, settings)
    resumed = ev.evaluate(world.engine, few, world.truth, folder, settings, resume=True)
    for name in ("results", "pools", "layers", "summary", "recall_ceiling"):
        columns = [c for c, t in whole[name].dtypes if t != "double"]
        a, b = (sorted(map(str, x[name].select(*columns).collect())) for x in (whole, resumed))
        assert a == b, name
    want = world.accuracy.where("system IN ('rag', 'graph_1hop') AND ranking <> 'cross_encoder' AND k IN (5, 10) AND int(query_id) < 60")
    got = whole["per_query"].join(want.select("system", "ranking", "k", "query_id", F.col("recall").alias("r")), ["system", "ranking", "k", "query_id"])
    assert got.count() == want.count() == whole["per_query"].count() and got.where("abs(recall - r) > 1e-9").count() == 0
    each = ev.seconds_each(events, 10)
    assert each[0]["stage"] == "retrieval" and len(each) < len(ev.STAGES) and each[0]["seconds_each"] == pytest.approx(each[0]["seconds"] / 10)
    header = spark.read.option("header", True).csv(f"{folder}/summary.csv")
    assert header.count() == 8 and "mean_recall" in header.columns


def test_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert ev.runs(spark, path).count() == 0
    ev.log_run(spark, path, 1, "running", systems="rag", skip_sample=True)
    ev.log_run(spark, path, 1, "done", exit_code=0)
    ev.log_run(spark, path, 2, "running", systems="emb_1hop")
    rows = {r.run_id: r for r in ev.runs(spark, path).collect()}
    assert (rows[1].status, rows[1].systems, rows[1].skip_sample, rows[1].exit_code) == ("done", "rag", True, 0)
    assert ev.latest_active(ev.runs(spark, path)).first().run_id == 2
    assert ev.close_orphans(spark, path) == 1
    assert ev.runs(spark, path).where("run_id = 2").first().status == "failed"
    assert ev.latest_active(ev.runs(spark, path)).count() == 0


def test_metrics_are_used_again(spark, world, tmp_path):
    """Only where columns, configurations and, nearly, queries are those of the results."""
    settings, folder = world.settings.but(systems=("rag",), ks=(5,)), str(tmp_path / "run")
    few = world.queries.where("int(query_id) < 40")

    def skipped(queries, **more):
        events = []
        ev.evaluate(world.engine, queries, world.truth, folder, settings, resume=True, on_event=events.append, **more)
        return [e["stage"] for e in events if e["type"] == "skipped"]

    assert skipped(few.where("int(query_id) < 20")) == []
    assert skipped(few.where("int(query_id) < 20")) == ["metrics"]
    assert skipped(few) == [] and few.count() > 5
    assert skipped(few, stages=("aggregates",)) == ["retrieval", "metrics"]
    old = spark.read.parquet(f"{folder}/per_query").drop("nearness_score_undirected")
    ev.sinks.write_results(ev.keep(old), f"{folder}/per_query")
    for part in (tmp_path / "run" / "per_query").rglob("*.parquet"):
        assert part.exists()
    assert skipped(few) == []
    with pytest.raises(ValueError, match="stage"):
        skipped(few, stages=("nothing",))


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: main(["--tables", SF, *a], spark)
    out = str(tmp_path / "out")
    assert run("evaluate", "--out", out, "--n", "9", "--systems", "rag", "--k", "5", "--dry-run") == 0
    assert '"queries": 9' in capsys.readouterr().out and not (tmp_path / "out").exists()
    assert run("evaluate", "--out", out, "--n", "9", "--systems", "rag", "--k", "5", "--rankings", "cosine", "cross_encoder") == 0
    assert spark.read.parquet(f"{out}/results").select("query_id").distinct().count() == 9
    assert spark.read.parquet(f"{out}/scores").count() > 0
    assert run("show", "--out", out) == 0 and "recall_ceiling" in capsys.readouterr().out
    assert run("sample", "--out", str(tmp_path / "s"), "--n", "6", "--dry-run") == 0 and not (tmp_path / "s").exists()
    assert run("sample", "--out", str(tmp_path / "s"), "--n", "6") == 0 and 0 < spark.read.json(str(tmp_path / "s")).count() <= 6
    assert run("query", "graph_stats") == 0 and "n_nodes" in capsys.readouterr().out
