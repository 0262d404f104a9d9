import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import retrieval, views
from lodestrand.sources import readers, schemas, sinks
from lodestrand.streaming import progress


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_tolerant_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [{"query_id": "1", "retrieved": ["a"]}, '{"query_id": "2", "retr', {"query_id": "1", "retrieved": ["b"]}, {"query_id": "3", "retrieved": []}])
    assert readers.lines(spark, path, schemas.RESULTS).count() == 3
    last = readers.last_by_key(readers.ordered_lines(spark, path, schemas.RESULTS))
    assert {r.query_id: r.retrieved for r in last.collect()} == {"1": ["b"], "3": []}


def test_last_line_over_several_files_and_blocks(spark, tmp_path):
    """The last of the last file by name, wherever a file is split."""
    for name, n in (("a", 3000), ("b", 4000)):
        write(tmp_path / f"{name}.jsonl", [{"query_id": str(i % 7), "retrieved": [f"{name}{i}", "x" * 50]} for i in range(n)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        last = readers.last_by_key(readers.ordered_lines(spark, str(tmp_path), schemas.RESULTS)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.query_id: r.retrieved[0] for r in last} == {str(i % 7): f"b{i}" for i in range(3993, 4000)}


def test_first_queries(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"query_id": str(i), "query_text": "x"} for i in range(50)])
    write(tmp_path / "b.jsonl", [{"query_id": str(i), "query_text": "x"} for i in range(50, 60)])
    assert {r.query_id for r in readers.queries(spark, str(tmp_path), 53).collect()} == {str(i) for i in range(53)}


def test_arrow_files(spark, tmp_path):
    """File and stream form, columns that are missing or not asked for."""
    one, two = pa.table({"a": [1, 2], "b": ["x", None], "c": [1.0, 2.0]}), pa.table({"a": pa.array([3], pa.int32())})
    with pa.ipc.new_file(str(tmp_path / "1.arrow"), one.schema) as w:
        w.write_table(one)
    with pa.ipc.new_stream(str(tmp_path / "2.arrow"), two.schema) as w:
        w.write_table(two)
    got = readers.arrow_table(spark, str(tmp_path), "a long, b string").collect()
    assert {tuple(r) for r in got} == {(1, "x"), (2, None), (3, None)}


def test_folders(spark, tmp_path):
    for name in ("r1", "r3", "r2"):
        (tmp_path / "root" / name).mkdir(parents=True)
    assert readers.newest_revision(spark, str(tmp_path / "root")).endswith("/r3")
    assert readers.newest_revision(spark, "anything", "own") == "own"
    with pytest.raises(FileNotFoundError):
        readers.newest_revision(spark, str(tmp_path / "none"))
    assert readers.inside("/data", "a/b.csv") == "/data/a/b.csv"
    for bad in ("../x", "a/../../x", "/etc/x", "..", "a\\..\\x", ""):
        with pytest.raises(PermissionError):
            readers.inside("/data", bad)


def test_sample_texts(spark):
    rows = [("b", "n", "d", "de", "C", "one two"), ("a", "n", "d", "de", "C", "one"), ("c", "n", "d", "de", "X", "one"), ("d", "n", "d", "de", "C", " ".join("x" * 9)), ("e", "n", "d", "de", "C", "")]
    docs = spark.createDataFrame(rows, schemas.RULINGS.replace("full_text string, ", "").replace("decision_id string, ", "decision_id string, ") + ", full_text string")
    get = lambda **k: [r.decision_id for r in readers.sample_texts(docs, court="C", max_tokens=5, **k).collect()]
    assert get(limit=9) == ["a", "b"] and get(limit=1) == ["a"]
    assert get(limit=9, only=spark.createDataFrame([("b",), ("c",)], "decision_id string")) == ["b"]


def test_batches_of_texts(spark, tmp_path):
    """A service that refuses some batches, one to fall back on, texts that both refuse, and a second run that takes what is left."""

    def call(texts):
        if any("!" in t for t in texts):
            raise ConnectionError
        return [[float(len(t)), 1.0] for t in texts]

    def fallback(texts):
        if any("?" in t for t in texts):
            raise ValueError
        return [[float(len(t)), 2.0] for t in texts]

    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a", "bb", "c!", "d!?", "", None, "eeee"])], "chunk_id string, text string").coalesce(1)
    embedder = sinks.BatchEmbedder(call, fallback, size=3, attempts=2, wait=0.0)
    good, failed = sinks.embed(rows, embedder)
    assert {r.chunk_id: r.vector[0] for r in good.collect()} == {"0": 1.0, "1": 2.0, "2": 2.0, "6": 4.0}
    assert {r.chunk_id for r in failed.collect()} == {"3", "4", "5"}
    path = str(tmp_path / "v")
    assert sinks.embed_shards(rows.where("chunk_id < '2'"), embedder, path) == (2, 0)
    assert sinks.embed_shards(rows, embedder, path) == (2, 3)
    assert spark.read.parquet(f"{path}/shards").count() == 4


def test_pair_scores_by_call(spark):
    """A batch that is refused every time costs its queries their scores."""
    pools = spark.createDataFrame([("s", q, i) for q in ("p", "q", "bad") for i in ("a", "b", "none")], "system string, query_id string, id string")
    asked = spark.createDataFrame([("p", "pp"), ("q", "qqq"), ("bad", "!")], "query_id string, query_text string")
    texts = spark.createDataFrame([("a", "x"), ("b", "yy"), ("none", " ")], "id string, text string")

    def call(rows):
        if any(a == "!" for a, _ in rows):
            raise ConnectionError
        return [len(a) + len(b) for a, b in rows]

    good, failed = retrieval.pair_scores_by_call(pools, asked, texts, call, size=1, attempts=2)
    assert {tuple(r) for r in good.collect()} == {("p", "a", 3.0), ("p", "b", 4.0), ("q", "a", 4.0), ("q", "b", 5.0)}
    assert [r.query_id for r in failed.collect()] == ["bad"]


def test_upsert_is_stable(spark):
    new = spark.createDataFrame([("a", i) for i in range(20)], "point_id string, n int")
    assert len({sinks.upsert(new.repartition(k), None).first().n for k in (1, 2, 5)}) == 1


def test_scores(spark, tmp_path):
    rows = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.25), ("r", "a", 1.0)], "query_id string, id string, pair_score double")
    sinks.write_scores(rows, str(tmp_path / "s"))
    assert {tuple(r) for r in sinks.read_scores(spark, str(tmp_path / "s")).collect()} == {tuple(r) for r in rows.collect()}


def test_shared_folder_on_a_cluster():
    from lodestrand.sources import checkpoints

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        checkpoints.shared_folder(Session)


def test_queries_and_facts(spark, tmp_path):
    path = write(tmp_path / "q.jsonl", [{"query_id": "1", "query_text": "x"}, {"query_id": "2", "query_text": "  "}, {"query_id": "3"}])
    assert [r.query_id for r in readers.queries(spark, path).collect()] == ["1"]
    path = write(tmp_path / "f.jsonl", [{"decision_id": "a", "language": "DE", "facts": "1"}, {"decision_id": "a", "language": "de", "facts": "2"}, {"decision_id": "b", "language": "en", "facts": "3"}, {"decision_id": "c", "language": "it"}])
    assert {tuple(r) for r in readers.facts(spark, path).collect()} == {("a", "de", "1"), ("c", "it", "")}


def test_result_files_are_named_by_configuration(spark, tmp_path):
    row = [{"query_id": "q", "retrieved": ["a", "b"]}]
    for name in ("graph_1hop_cross_encoder_10", "rag_cosine_5", "cross_encoder_scores", "rag_pool"):
        write(tmp_path / f"{name}.jsonl", row)
    got = {tuple(r) for r in readers.results(spark, str(tmp_path)).collect()}
    assert got == {(s, r, k, "q", x, i) for s, r, k in (("graph_1hop", "cross_encoder", 10), ("rag", "cosine", 5)) for i, x in ((1, "a"), (2, "b"))}
    assert readers.artefacts(spark, str(tmp_path)).count() == 4


def test_csv_by_name(spark, tmp_path):
    write(tmp_path / "s.csv", ["k,system,extra,mean_recall", "5,rag,1,0.5"])
    r = readers.aggregate(spark, str(tmp_path / "s.csv"), schemas.SUMMARY).first()
    assert (r.system, r.k, r.mean_recall, r.hit_rate) == ("rag", 5, 0.5, None)
    assert readers.aggregate(spark, str(tmp_path / "none.csv"), schemas.SUMMARY).count() == 0


def test_catalogue(spark, tmp_path):
    for i in range(2):
        spark.range(i, i + 1).write.parquet(str(tmp_path / f"split{i}"))
    cat = readers.Catalogue(spark, {"two": [str(tmp_path / "split0"), str(tmp_path / "split1")]}, str(tmp_path / "store"))
    assert cat.load("two").count() == 2
    spark.range(5, 9).write.mode("overwrite").parquet(str(tmp_path / "split0"))
    assert cat.load("two").count() == 2
    with pytest.raises(KeyError, match="no such dataset"):
        cat.load("three")


def test_graph_is_checked(spark):
    good = spark.createDataFrame([("0f8fad5b-d9cb-469f-a165-70867728950e", "ruling"), ("L1", "law")], "id string, source string")
    assert readers.checked_graph(good).count() == 2
    with pytest.raises(ValueError, match="UUID"):
        readers.checked_graph(good.withColumn("source", F.lit("ruling")))


def test_upsert_gap_fill_and_backfill(spark):
    chunks = spark.createDataFrame([("a", "a_c0", 0), ("a", "a_c1", 1), ("b", "", 0)], "decision_id string, chunk_id string, chunk_index int")
    points = sinks.with_point_ids(chunks)
    assert points.select("point_id").distinct().count() == 3
    once = sinks.upsert(points.unionAll(points), None)
    new = points.where("chunk_index = 1").withColumn("text", F.lit("new"))
    merged = sinks.upsert(new, once)
    assert merged.count() == 3 and merged.where("text = 'new'").count() == 1
    assert sinks.gap_fill(chunks, chunks.limit(0)).count() == 3
    left = sinks.gap_fill(chunks, chunks.where("chunk_index = 0"), chunks.where("decision_id = 'a'"))
    assert [tuple(r) for r in left.collect()] == [("a", "a_c1", 1)] or left.select("decision_id", "chunk_index").collect() == [("a", 1)]
    dates = spark.createDataFrame([("a", 5), ("b", 0)], "decision_id string, date_ms long")
    assert tuple(sinks.backfill_check(sinks.backfill_dates(chunks, dates)).first()) == (3, 2, 2)
    done, dead = sinks.embed(chunks, lambda df: df.withColumn("vector", F.when(F.col("chunk_index") == 0, F.array(F.lit(1.0)))))
    assert done.count() == 2 and dead.count() == 1


def test_resume(spark):
    q = lambda *ids: spark.createDataFrame([(i,) for i in ids], "query_id int")
    todo, kept = sinks.resume(q(1, 2, 3), {"a": q(1, 2), "b": q(1, 3)})
    assert sorted(r[0] for r in todo.collect()) == [2, 3]
    assert {k: [r[0] for r in v.collect()] for k, v in kept.items()} == {"a": [1], "b": [1]}


def test_partitioned_results_are_replaced_by_configuration(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = lambda *x: spark.createDataFrame(x, "system string, ranking string, k int, query_id string")
    sinks.write_results(rows(("s", "cosine", 5, "old"), ("s", "cosine", 10, "old")), path)
    sinks.write_results(rows(("s", "cosine", 5, "new")), path)
    assert {(r.k, r.query_id) for r in spark.read.parquet(path).collect()} == {(5, "new"), (10, "old")}
    sinks.write_csv(rows(("s", "cosine", 5, "x")), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().k == "5"


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        sinks.restore(spark, path)
    sinks.snapshot(spark, spark.range(5), path, "one")
    sinks.snapshot(spark, spark.range(9), path, "two")
    assert sinks.restore(spark, path).count() == 9 and sinks.restore(spark, path, "one").count() == 5
    spark.range(7).write.mode("overwrite").parquet(f"{path}/one")
    with pytest.raises(ValueError, match="manifest"):
        sinks.restore(spark, path, "one")


class FakeStream:
    """Takes what a stream's writer would call."""

    def __init__(self, writes):
        self.writes, self.writeStream = writes, self

    def foreachBatch(self, write):
        self.writes.append(write)
        return self

    def option(self, *_):
        return self


def test_streams(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = progress.progress(spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp")))
    query = progress.progress(progress.read_events(spark, source), late="0 seconds").writeStream.outputMode("complete").format("memory").queryName("p").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {tuple(r)[:3] for r in spark.table("p").collect()}
    assert got == {tuple(r)[:3] for r in batch.collect()}
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for name in ("one", "two"):  # a new checkpoint reads everything again
        stream = progress.read_events(spark, source).select("event_id")
        progress.append_new(stream, out, f"{check}/{name}", "event_id", "event_id long").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.parquet(out).count() == spark.read.parquet(source).count()
    writes = []
    write = progress.append_new(FakeStream(writes), out, f"{check}/one", "event_id", "event_id long")
    assert write is not None
    rows = spark.range(10**9, 10**9 + 5).selectExpr("id AS event_id")
    for _ in range(2):  # the same batch again, as after a failure
        writes[0](rows, 77)
    writes[0](rows, 78)
    assert spark.read.parquet(out).where("event_id >= 1000000000").count() == 5


def test_stage_changes(spark, tmp_path):
    lines = [(1, 1, "=== SAMPLE started ==="), (1, 2, "10 of 20"), (1, 3, "=== SAMPLE finished in 3 s ==="), (1, 4, "=== SKIP metrics ===")]
    spark.createDataFrame(lines, schemas.LOG).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schemas.LOG).parquet(str(tmp_path / "log"))
    query = progress.stage_changes(stream).writeStream.outputMode("append").format("memory").queryName("s").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("s").collect()} == {(1, "sample", "done", 3), (1, "metrics", "skipped", 4)}


def test_event_log_and_retry():
    log, seen, late = progress.EventLog(history=2), [], []
    log.subscribe(seen.append)
    for i in range(3):
        log.publish({"n": i})
    log.subscribe(late.append)
    log.close()
    log.publish({"n": 9})
    assert [e and e["n"] for e in seen] == [0, 1, 2, None] and [e and e["n"] for e in late] == [1, 2, None]
    waits, calls = [], iter([ConnectionError(), TimeoutError(), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert progress.with_retry(call, sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(ValueError, match="no"):
        progress.with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)


def test_names_are_checked(spark):
    drill = spark.createDataFrame([(1, (0.5,), (0.25,))], "query_id int, graph_1hop struct<recall: double>, emb_1hop struct<recall: double>")
    assert views.with_delta(drill, "recall").first().delta == 0.25
    for bad in ({"metric": "no"}, {"metric": "recall", "plus": "no"}):
        with pytest.raises(ValueError, match="no such"):
            views.with_delta(drill, **bad)
    with pytest.raises(ValueError, match="cut-off"):
        views.drill_ranked(drill, "cosine", 0, ("rag",))


def test_keeping_removes_the_shuffles_that_led_to_it(spark):
    from lodestrand.sources.checkpoints import keep

    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {int(x.split("_")[1]) for x in blocks.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before, df = shuffles(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    kept = keep(df)
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert sorted(kept.collect()) == sorted(df.collect())  # what led to it can still be read, by working it out again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
