import random

import numpy as np
import pytest
import xxhash

from lodestrand.llm import simhash as sh


def slow_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return fp - 2**64 if fp >= 2**63 else fp


def slow_components(pairs, bits=3):
    """doc_id -> smallest id, by brute force over all fingerprints."""
    fps = np.array([f for _, f in pairs], np.int64).view(np.uint64)
    group = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits).tolist():
            a, b = group[i], group[j]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (doc, _), g in zip(pairs, group):
        least[g] = min(least.get(g, doc), doc)
    return {doc: least[g] for (doc, _), g in zip(pairs, group)}


TEXTS = [None, "", " \t\n", "One", "one", "one two", "a b c", "A B C", "a b c a b c a b c", "é à ü ñ", "x " * 5000, "x y z " * 40000, "a\x0bb\x0cc d"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert sh.fingerprint((text or "").encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("block", [4096, 4])
def test_components_against_brute_force(spark, block):
    r = random.Random(11)
    fps = [r.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains and dense clusters
        base = r.choice(fps[-60:])
        fps.append(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    fps += fps[:20] + [0, 0, 1, 2**63]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    pairs = [(1000 - i, f) for i, f in enumerate(signed)]
    df = spark.createDataFrame(pairs, "doc_id long, fp long").repartition(3)
    got = {x.doc_id: x.component_id for x in df.join(sh.component_of(df, block=block), "fp").collect()}
    assert got == slow_components(pairs)


@pytest.mark.parametrize("compared", [4096, 1e-6, 1e-11])
def test_finer_grids_lose_no_link(spark, compared, monkeypatch):
    """The grid that more fingerprints would have finds the same links."""
    groups = sh.groups_for(400, compared=compared)
    monkeypatch.setattr(sh, "groups_for", lambda *_: groups)
    assert (groups > 6) == (compared < 1)
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(100)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for f in fps for _ in range(3)]
    pairs = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(pairs, "doc_id long, fp long")
    assert {x.doc_id: x.component_id for x in df.join(sh.component_of(df), "fp").collect()} == slow_components(pairs)


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), (None, "other")], "doc_id string, text string")
    assert sorted((x.doc_id or "", x.component_id) for x in sh.near_duplicates(df).collect()) == [("", None), ("a", "a"), ("b", "a")]


def test_rows(spark):
    rows = [(5, "the same words here", 1), (3, "The same  words here", 2), (None, "the same words here", 3), (9, None, 4), (8, "", 5), (5, "the same words here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((x.doc_id or 0, x.component_id) for x in sh.near_duplicates(df).collect())
    assert got == [(0, 3), (3, 3), (5, 3), (5, 3), (8, 8), (9, 8)]
    assert sh.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("local", [sh.LOCAL, 50, 1])
def test_a_long_chain_is_one_component(spark, local):
    r = random.Random(local)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 999)]
    r.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {x.node: x.root for x in sh.components(edges, local=local).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 999: 999, 1000: 999}
