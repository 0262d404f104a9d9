import math
import re
from collections import Counter, defaultdict
from datetime import date

import plain
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_decontamination import brute as overlaps
from test_near_texts import slow_similar

import corpus_pipeline
from lodestrand.llm import quality, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    """sf0.001 with nulls, repeated rows and a column more in documents."""
    path = tmp_path_factory.mktemp("sf")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs += [{**docs[5]}, {**docs[6], "doc_id": None}, {**docs[0], "doc_id": 10_001, "text": None}, {**docs[0], "doc_id": 10_002, "text": "", "source": None}]
    for i, row in enumerate(docs):
        row |= {"row_key": i, "Copy_Number": "x", "day": date(2020, 1, 1 + i % 9)}
    pq.write_table(pa.Table.from_pylist(docs), path / "documents.parquet")
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet"), path / f"{name}.parquet")
    return str(path), docs


def test_stages_against_brute_force(spark, world):
    path, docs = world
    read = spark.read.parquet(f"{path}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{path}/labels.parquet"), pq.read_table(f"{path}/benchmark.parquet").to_pylist()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]

    model, features = quality.train(read, labels), quality.Featuriser()
    kept = [d for d in docs if model.score(*features(d["text"] or "")) >= 0.7]
    good = corpus_pipeline.keep_quality(spark, read, path)
    assert good.columns == read.columns
    assert sorted(r.row_key for r in good.collect()) == [d["row_key"] for d in kept]
    assert 0.6 * len(docs) < len(kept) < len(docs)

    fake = {i: d for i, d in enumerate(kept)}
    group = dict(enumerate(slow_similar([d["text"] for d in kept])))
    first = {}
    for i, g in group.items():
        d = fake[i]
        order = (d["doc_id"] is None, d["doc_id"] or 0)
        first[g] = min(first.get(g, (order, d["doc_id"])), (order, d["doc_id"]), key=lambda x: x[0])
    one = corpus_pipeline.drop_near_duplicates(spark, good, path)
    rows = [r.asDict() for r in one.collect()]
    assert one.columns == read.columns and len(rows) == len(first)
    assert Counter(r["doc_id"] for r in rows) == Counter(x for _, x in first.values())

    clean = corpus_pipeline.drop_benchmark_overlaps(spark, one, path)
    hit = {d for d, *_ in overlaps([(r["row_key"], r["text"]) for r in rows], [(b["item_id"], b["text"]) for b in benchmark])}
    left = sorted(r["row_key"] for r in rows if r["row_key"] not in hit)
    assert clean.columns == read.columns and sorted(r.row_key for r in clean.collect()) == left and hit

    network = secrets.train(clean)
    safe = corpus_pipeline.redact_secrets(spark, clean, path)
    before = {r.row_key: r for r in clean.collect()}
    changed = 0
    for r in safe.collect():
        old = before[r.row_key].text
        assert r.text == (None if old is None else secrets.redact(old, network))
        assert r.n_chars == (before[r.row_key].n_chars if r.text == old else len(r.text))
        changed += r.text != old
        assert not secrets.base_spans(r.text or "")
    assert changed and safe.columns == read.columns

    mixed = corpus_pipeline.mix_sources(spark, safe, path)
    assert mixed.columns == [*read.columns, "copy_number_"]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    size = {r.row_key: (r.source, len(word.findall(r.text or ""))) for r in safe.collect()}
    totals = defaultdict(int)
    for source, n in size.values():
        totals[source] += n
    target = {s: t for s, _, t in plain.target_words(list(totals.items()))}
    copies = defaultdict(list)
    for r in mixed.collect():
        copies[r.row_key].append(r.copy_number_)
    for key, got in copies.items():
        assert sorted(got) == list(range(1, len(got) + 1)) and len(got) <= 3
        source, _ = size[key]
        assert abs(len(got) - target[source] / totals[source]) < 1
    for source in totals:
        taken = sum(len(copies[k]) * n for k, (s, n) in size.items() if s == source)
        assert abs(taken - target[source]) <= max(n for s, n in size.values() if s == source) * 1.5 + 1
    assert math.isclose(sum(target.values()), sum(totals.values()))


def test_run_agrees_with_itself(spark, world):
    path, _ = world
    got = [sorted((r.row_key, r.copy_number_) for r in corpus_pipeline.run(spark, path).collect()) for _ in range(2)]
    assert got[0] == got[1] and got[0]


def test_empty_and_long_texts(spark, world, tmp_path):
    """No rows; and rows that are null, empty, very long or repeated, with ids that are strings and columns that clash."""
    path, docs = world
    read = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, read.limit(0), path)
        assert none.count() == 0 and set(read.columns) <= set(none.columns), name
    long = " ".join(d["text"] for d in docs if d["text"])
    rows = [("a", long, "en", "s", 1), ("b", long + " end", "en", "s", 2), ("c", None, None, None, None), ("d", "", "en", None, 0), (None, long[:400], "en", "s", 3), (None, long[:400], "en", "s", 3)]
    odd = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id string, text string, lang string, source string, n_chars long, k1 string, row string")
    one = corpus_pipeline.drop_near_duplicates(spark, odd, path).collect()
    assert sorted(str(r.doc_id) for r in one) == ["None", "a", "c"]
    clean = corpus_pipeline.drop_benchmark_overlaps(spark, odd, path).collect()
    assert {r.doc_id for r in clean} >= {"c", "d"} and all(r.k1 == "x" for r in clean)
    safe = corpus_pipeline.redact_secrets(spark, odd, path)
    assert safe.columns == odd.columns and safe.count() == 6 and safe.where("text IS NULL").count() == 1
    mixed = corpus_pipeline.mix_sources(spark, odd, path)
    assert mixed.columns == [*odd.columns, "copy_number"] and mixed.count() > 0


def test_stages_let_go_of_what_the_driver_held_before(spark):
    """A stage begins and ends by collecting the JVM's garbage: before a full heap, which is all that it would wait for."""
    held = spark.sparkContext._jvm.java.lang.ref.WeakReference(spark.sparkContext._jvm.java.lang.Object())
    docs = spark.createDataFrame([(1, "en", "a", "some words", 10)], "doc_id long, lang string, source string, text string, n_chars int")
    assert dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").count() == 1
    assert held.get() is None
