"""The near-duplicate stage's operator against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from lodestrand.llm import near_texts as nt


def slow_set(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def slow_similar(texts):
    """Index of each text's group, by brute force over all pairs with five-word Jaccard similarity of 0.8 or more."""
    found = [slow_set(t) for t in texts]
    group = list(range(len(texts)))
    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if group[i] != group[j] and 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def edited_texts():
    """Unlike texts with a passage that all share, copies of them with words changed, a crowd around one text, odd ones."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = [word() for _ in range(12)]
    texts = [None, "", " \n", "one", "One", "a b c d e", "a b c d e f", "x " * 50]
    for i in range(60):
        words = [word() for _ in range(r.randint(5, 300))]
        words[2:2] = passage
        for _ in range(40 if i == 0 else 3):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 35))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [4096, 4])
def test_similar_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nt, "BLOCK", block)
    texts = edited_texts()
    group = slow_similar(texts)
    df = spark.createDataFrame([(1000 - i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at int").repartition(3)
    got = nt.keep_one_similar(df)
    assert got.columns == df.columns
    last = {g: i for i, g in enumerate(group)}  # ids fall as places rise
    assert sorted(x.at for x in got.collect()) == sorted(last.values())
    assert nt.keep_one_similar(df.limit(0)).count() == 0


def test_the_stage_links_edited_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    least = {}
    for r, g in zip(rows, slow_similar([r.text for r in rows])):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.01")
    assert sorted(x.doc_id for x in got.collect()) == sorted(least.values())


def test_the_exact_passes_find_all_links_by_themselves(spark, monkeypatch):
    """Without any proposal, what the lists of rarest shingles make is still all of it."""
    monkeypatch.setattr(nt, "PROPOSED", 0)
    monkeypatch.setattr(nt.simhash, "links", lambda nodes: nodes.selectExpr("fp AS a", "fp AS b").limit(0))
    texts = edited_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    first = {}
    for i, g in enumerate(slow_similar(texts)):
        first.setdefault(g, i)
    assert sorted(x.doc_id for x in nt.keep_one_similar(df).collect()) == sorted(first.values())


def test_rows_that_stay(spark):
    """Smallest id, null ids last, repeated rows once, ids of any type, clashing columns."""
    same, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(None, same, "r"), ("b", same.upper(), "r"), ("a", same, "x"), ("a", same, "x"), ("c", other, "x"), (None, other, "y"), (None, None, "z"), (None, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id string, text string, node string")
    got = [sorted(map(str, nt.keep_one_similar(df.repartition(n)).collect())) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 3
    assert sorted(str(r.doc_id) for r in nt.keep_one_similar(df).collect()) == ["None", "a", "c"]
