import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestrand.llm import suffix_dedup as sd


def brute(bodies, length=200):
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                hit[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        kept = bytes(np.frombuffer(b, np.uint8)[~hit[1 : len(b) + 1]])
        out.append((len(b), int(hit.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    passages = [prose(n) for n in (35, 40, 60, 120, 300)]
    docs = [prose(r.randint(1, 150)) for _ in range(40)]
    for _ in range(40):
        docs.append(prose(r.randint(0, 60)) + r.choice(passages)[r.randint(0, 30) :] + prose(r.randint(0, 60)))
    for d in docs[40:60]:
        w = d.split(" ")
        w[r.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
    docs += [docs[3], docs[3], "a" * 700, "ab" * 150, "x y " * 90 + "tail", "", None, "é" * 99, "é" * 100, "é" * 101, prose(4000) + docs[50]]
    return docs


@pytest.mark.parametrize("limit", [8, 13, 30, 200])
def test_sort_is_the_order_of_prefixes(limit):
    r = np.random.default_rng(limit)
    body = bytes(r.integers(97, 99, 3000, dtype=np.uint8)) + b"a" * 300 + bytes(r.integers(97, 123, 500, dtype=np.uint8)) * 2
    starts = r.permutation(len(body) - limit)
    order, equal = sd.deep_shallow_sort(body, starts, limit, 8)
    got = [body[s : s + limit] for s in starts[order]]
    assert got == sorted(got)
    assert equal.tolist() == [False] + [a == b for a, b in zip(got[:-1], got[1:])]


@pytest.mark.parametrize(("max_group", "combine"), [(sd.MAX_GROUP, sd.COMBINE), (1, sd.COMBINE), (3, 7)])
def test_against_brute_force(spark, max_group, combine, monkeypatch):
    monkeypatch.setattr(sd, "COMBINE", combine)
    docs = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tid string").repartition(3)
    got = sd.remove_repeats(df, max_group=max_group).collect()
    want = brute([(t or "").encode() for t in docs])
    for row in got:
        removed = sum(s.end - s.start for s in row.spans)
        assert (row.n_bytes, removed, len(row.spans), row.kept_sha256) == want[row.doc_id], row.doc_id
    assert len(got) == len(docs)


def test_a_crowd_around_one_passage(spark, monkeypatch):
    """Many texts with one passage and other words about it: its anchors are split, nothing is lost."""
    r = random.Random(9)
    prose = lambda n: "".join(r.choices("abcdefgh  ", k=n))
    passage = prose(330)
    docs = [prose(r.randint(0, 90)) + passage[r.randint(0, 3) :] + prose(r.randint(0, 90)) for _ in range(150)]
    docs += docs[:1] * 30
    want = brute([d.encode() for d in docs])
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(docs)], "doc_id string, text string").repartition(4)
    monkeypatch.setattr(sd, "COPIES", 5)
    for max_group, sought in ((1000, 10), (20, 10), (20, 10_000)):
        monkeypatch.setattr(sd, "SOUGHT", sought)
        for row in sd.remove_repeats(df, max_group=max_group).collect():
            assert (row.n_bytes, sum(s.end - s.start for s in row.spans), len(row.spans), row.kept_sha256) == want[int(row.doc_id)]


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(empty).count() == 0
    long = "word " * 100
    df = spark.createDataFrame([(None, long), (None, long), (7, long[:199])], "doc_id long, text string")
    got = sorted((r.doc_id or -1, len(r.kept)) for r in sd.remove_repeats(df).collect())
    assert got == [(-1, 0), (-1, 0), (7, 199)]


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    r = random.Random(2)
    a = "".join(r.choices("abcdefgh ", k=5000))
    bodies = [a.encode(), ("z" + a[100:4000]).encode()]
    pieces = {}
    monkeypatch.setattr(sd, "PIECE", 700)
    for buffer, first, last, owner, shift in sd._pieces(bodies, 200):
        start, n, _, _ = sd.stretches(buffer, first, last, 200)
        text = np.searchsorted(first, start, side="right") - 1
        for s, k, i in zip(start, n, text):
            for w in range(s, s + k):
                at = (int(owner[i]), int(w + shift[i]))
                assert at not in pieces and buffer[w : w + 200] == bodies[at[0]][at[1] : at[1] + 200]
                pieces[at] = True
    assert len(pieces) == sum(len(b) - 199 for b in bodies)
