import random
from itertools import combinations

import pytest
import regex

from lodestrand.llm import decontamination as dc


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (text or "").lower()) if w]


def brute(docs, items, overlap=13, need=11):
    """{(doc, item, best, first)} by laying every pair side by side at every shift."""
    out = {}
    for doc, text in docs:
        d = words(text)
        for item, passage in items:
            b = words(passage)
            if not b or not d:
                continue
            wide = min(overlap, len(b))
            least = len(b) if len(b) < overlap else need
            shared = set(d) & set(b)
            if len(shared) < min(3, len(set(b))):
                continue
            for shift in range(-len(b), len(d)):
                same = [0 <= i + shift < len(d) and d[i + shift] == b[i] for i in range(len(b))]
                if sum(same) < least:
                    continue
                for s in range(max(0, -shift), min(len(b), len(d) - shift) - wide + 1):
                    n = sum(same[s : s + wide])
                    if n >= least:
                        best, first = out.get((doc, item), (0, 10**9))
                        out[doc, item] = max(best, n), min(first, s + shift)
    return {(*k, *v) for k, v in out.items()}


def test_masks_see_every_overlap():
    for changed in combinations(range(13), 2):
        same = set(range(13)) - set(changed)
        assert any(all(at + o in same for o in m) for m in dc.MASKS for at in range(13 - max(m)))


def test_masks_that_miss_an_overlap_are_refused(spark):
    assert dc.covers(dc.MASKS, 13, 11) and not dc.covers(dc.MASKS, 13, 10) and not dc.covers(dc.MASKS[:1], 13, 11)
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    with pytest.raises(ValueError):
        dc.contaminated(df, bench, similarity=0.7)
    one = dc.contaminated(df, bench, overlap=4, similarity=0.75, masks=((0, 1), (0, 2), (0, 3))).collect()
    assert [tuple(r) for r in one] == [(1, 1, 2, 0)]


def made_up(seed=3):
    r = random.Random(seed)
    vocabulary = ["the", "of", "a", *("".join(r.choices("abcdefgé", k=4)) for _ in range(200))]
    prose = lambda n: r.choices(vocabulary, k=n)
    items = [(i, prose(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 12, 13, 14, 20, 40, 60, 60])]
    items[0] = (0, ["zebra"])
    items.append((13, items[12][1]))
    docs = [(i, " ".join(prose(r.randint(0, 80)))) for i in range(30)]
    for i in range(30, 120):
        _, passage = r.choice(items)
        cut = list(passage)
        for _ in range(r.randint(0, 6)):
            cut[r.randrange(len(cut))] = r.choice(vocabulary)
        a = r.randint(0, len(cut) // 2)
        text = " ".join([*prose(r.randint(0, 20)), *cut[a:], *prose(r.randint(0, 20))])
        docs.append((i, text.upper().replace(" ", ", ") if i % 5 == 0 else text))
    docs += [(199, " ".join([*prose(20_000), *items[8][1], *prose(20_000)])), (200, None), (201, ""), (202, " ,. "), (203, "the " * 300)]
    return docs, [(i, " ".join(w)) for i, w in items] + [(20, None), (21, "")]


def test_against_brute_force(spark):
    docs, items = made_up()
    df = spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, w string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, seed int")
    want = brute(docs, items)
    assert len(want) > 40
    for limit in (dc.MAX_BYTES, 60_000):
        got = {tuple(r) for r in dc.contaminated(df, bench, max_bytes=limit).collect()}
        assert got == want
    clean = {r.doc_id for r in dc.keep_clean(df, bench).collect()}
    assert clean == {i for i, _ in docs} - {d for d, *_ in want}


def test_empty_tables_and_repeated_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (7, text), (None, text)], "item_id long, text string")
    got = sorted(tuple(r) for r in dc.contaminated(df, bench).select("doc_id", "item_id", "equal_words").fillna(-1).collect())
    assert got == [(-1, -1, 7), (-1, 7, 7), (1, -1, 7), (1, 7, 7)]
    assert dc.contaminated(df.limit(0), bench).count() == 0
    assert dc.contaminated(df, bench.limit(0)).count() == 0
