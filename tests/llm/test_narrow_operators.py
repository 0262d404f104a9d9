"""Token counts, URL filters, secrets, media, classifiers and mixing, against plain versions of themselves."""

import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest

from lodestrand.llm import media, mixing, quality, queries, token_counts, toxicity, url_filters

TEXTS = [None, "", " \t\n\x0b\x0c\r", "a", "Hello world", "é" * 300, "x" * 100_000, "tab\tnew\nline\x0bvt", "a" * 575, "a" * 576, "a" * 577, "naïve 東京 😀 text", "word " * 30_000]


def frame(spark, texts, extra="x"):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, extra, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, body string, size int").repartition(3)


# Token counts


def greedy(pieces, word):
    """Longest piece first, by looking; None if none fits."""
    n = at = 0
    longest = max(map(len, pieces))
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        n, at = n + 1, end
    return n


def test_automaton_is_greedy():
    r = random.Random(4)
    for _ in range(60):
        letters = b"abc"
        pieces = {bytes(r.choices(letters, k=r.randint(1, 5))) for _ in range(r.randint(1, 25))}
        pieces |= {bytes([x]) for x in letters} if r.random() < 0.6 else set()
        auto = token_counts.Automaton(pieces, b"")
        for _ in range(60):
            word = bytes(r.choices(letters, k=r.randint(0, 14)))
            want = greedy(pieces, word)
            assert auto.count(word) == (1 if want is None else want)


def test_token_counts_of_odd_rows(spark):
    df = spark.createDataFrame([("a", "x y", 1), ("a", "x y", 1), (None, "x", 2), ("b", None, 3)], "doc_id string, text string, n_words int")
    got = token_counts.token_counts(df, [b" x", b" y"]).collect()
    assert sorted(map(str, map(tuple, got))) == ["('a', 3, 2, 2)", "('a', 3, 2, 2)", "('b', 0, 0, 0)", "(None, 1, 1, 1)"]


def test_token_counts_of_the_real_vocabulary(spark):
    pieces = token_counts.read_ranks(queries.VOCABULARY)
    known = set(pieces)
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, TEXTS), pieces).collect()}
    for i, text in enumerate(TEXTS):
        body = (text or "").encode()
        words = body.split()
        assert (got[i].n_bytes, got[i].n_words) == (len(body), len(words))
        assert got[i].n_tokens == sum(n * greedy(known, b" " + w) for w, n in Counter(words).items())
    assert token_counts.token_counts(frame(spark, TEXTS).limit(0), pieces).count() == 0


# Mixing


@pytest.mark.parametrize("sizes", [{}, {"a": 0}, {"a": 10, "b": 0, None: 5}, {"a": 1, "b": 1000, "c": 1}, {f"s{i}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    rows = sorted(mixing.plan(df, (1, 2, 3), 3, mixing.SEED).collect())
    got = [(r.name, r.source_size, r.target) for r in rows]
    assert got == [(s, n, pytest.approx(t, rel=1e-12)) for s, n, t in plain.target_words(list(sizes.items()))]
    weights = [i % 3 + 1 for i in range(len(got))]
    total = sum(sizes.values())
    assert [s for s, *_ in got] == sorted(sizes, key=lambda x: (x is None, x or ""))
    assert sum(t for *_, t in got) == pytest.approx(total)
    free = [t / w for (_, n, t), w in zip(got, weights) if t < 3 * n]
    for (_, n, t), w in zip(got, weights):
        assert t <= 3 * n
        assert t == 3 * n or t / w == pytest.approx(max(free))
    assert all(x == pytest.approx(free[0]) for x in free)


def test_mix_and_emit(spark):
    r = random.Random(1)
    texts = [None, "", *(" ".join(["w"] * min(4000, int(r.paretovariate(0.9) * 20))) for _ in range(900))]
    rows = [(i, t, r.choice(["a"] * 6 + ["b", "c", "d", None]), i) for i, t in enumerate(texts)] + [(5, texts[5], "a", 5)] * 3 + [(None, "x y", "b", 0), (None, "x y", "b", 0), (None, "y", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = mixing.mix(df.repartition(5)).collect()
    for other in (mixing.mix(df.repartition(2)), mixing.mix(df, bucket_rows=3)):  # finer buckets, the same mix
        assert sorted(map(str, got)) == sorted(map(str, other.collect()))
    sized = [(i, t, s, len((t or "").split())) for i, t, s, _ in rows]
    want = plain.copies(sized)
    assert sorted((str(i), str(s), n, c) for (i, _, s, n), c in zip(sized, want)) == sorted((str(x.doc_id), str(x.source), x.size, x.copies) for x in got)
    by = defaultdict(list)
    for x in got:
        by[x.source].append(x)
    for members in by.values():
        size, target = members[0].source_size, members[0].target
        assert size == sum(x.size for x in members)
        assert all(0 <= x.copies <= 3 and abs(x.copies - target / size) < 1 for x in members)
        assert abs(sum(x.taken for x in members) - target) <= max(x.size for x in members) + 0.03 * target
    out = mixing.emit(df)
    assert out.columns == ["doc_id", "text", "source", "copies", "copy_number"]
    emitted = out.collect()
    assert len(emitted) == sum(x.copies for x in got)
    numbers = defaultdict(list)
    for x in emitted:
        numbers[x[:4]].append(x.copy_number)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())
    assert sorted(map(str, emitted)) == sorted(map(str, mixing.emit(df.repartition(3), bucket_rows=2).collect()))
    assert mixing.mix(df.limit(0)).count() == mixing.emit(df.limit(0)).count() == 0


def test_more_sources_than_a_driver_would_hold(spark):
    """Many sources of one row each: nothing is refused."""
    df = spark.range(3000).selectExpr("id AS doc_id", "'a b c' AS text", "cast(id AS string) AS source")
    got = mixing.mix(df).collect()
    assert len(got) == 3000 and abs(sum(x.target for x in got) - 9000) < 1e-6


# URL filters


def slow_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = []
    for verdict, text in rules:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fit.append((len(text) - 0, len(h), h, slash + p, verdict))
    best = max(fit, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else "allow"


def test_url_filter(spark):
    r = random.Random(8)
    labels = ["a", "b", "com", "net", "www", "Ex", "é"]
    hosts = [".".join(r.choices(labels, k=r.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/e", "?q=/en/", "#/en/", "/en/?a#b", "/en/../fr/"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http://", "http:///en/", "x://com/://b/", "http://com/en/"] + ["http://a.com/en/"] * 200
    made = sorted({(h.lower(), p) for h in r.sample(hosts, 30) for p in r.sample(["/", "/en/", "/e", "/en/x", "/fr/"], 2)})
    for rules in (queries.RULES, [(r.choice(["allow", "block"]), h + p) for h, p in made]):
        pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(4)
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filters.url_filter(pages, url_filters.rule_table(spark, rules)).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            assert got[i] == slow_rule(u, rules), u
    # one host with thousands of paths, nested ones among them, and hosts above and below it
    deep = [("block" if i % 3 else "allow", f"a.com/{'/'.join(str(i))}") for i in range(1500)] + [("block", "com/1/"), ("allow", "x.a.com/1/2")]
    urls = [f"http://{h}/{'/'.join(str(r.randint(0, 20000)))}" for h in ("a.com", "x.a.com", "y.x.a.com", "b.com") for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filters.url_filter(pages, url_filters.rule_table(spark, deep)).collect()}
    assert got == {i: slow_rule(u, deep) for i, u in enumerate(urls)}
    none = url_filters.rule_table(spark, queries.RULES).limit(0)
    assert {x.verdict for x in url_filters.url_filter(pages, none).collect()} == {"allow"}
    assert url_filters.url_filter(pages.limit(0), none).count() == 0


# Media


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.media_columns(frame(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        body, r = (text or "").encode(), got[i]
        payload = body + b"\xff" * (max(576, -(-len(body) // 576) * 576) - len(body))
        with wave.open(io.BytesIO(bytes(r.media))) as f:
            assert f.readframes(f.getnframes()) == payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(body), len(payload), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        times = [c >> 20 for c in r.fingerprints]
        assert times == sorted(times)
    assert got[0].feature == got[1].feature != got[4].feature
    assert media.media_columns(frame(spark, TEXTS).limit(0)).count() == 0


def slow_fingerprints(payload):
    """Peaks and pairs frame by frame, place by place."""
    edges, taper = [1, 24, 72, 144, 289], np.hanning(576)
    peaks = []
    for start in range(0, len(payload) - 576 + 1, 288):
        x = np.frombuffer(payload[start : start + 576], np.uint8).astype(float)
        spectrum = np.fft.rfft((x - x.mean()) * taper)
        power = [float(np.rint(c.real**2 + c.imag**2)) for c in spectrum]
        found = []
        for a, b in zip(edges, edges[1:]):
            best = max(range(a, b), key=lambda i: (power[i], -i))
            found.append((power[best], best if power[best] > 0 else 0))
        top = max(range(4), key=lambda i: (found[i][0], -i))
        peaks.append((found[top][1], [bin_ for _, bin_ in found]))
    codes = []
    for at, (first, bands) in enumerate(peaks):
        others = [(band, 0) for band in bands] + [(peaks[at + n][0], n) for n in (1, 2, 3) if at + n < len(peaks)]
        codes += [at << 20 | first << 11 | second << 2 | n for second, n in others if first and second and (n or first != second)]
    return sorted(codes)


def test_fingerprints_against_a_plain_version(spark):
    got = {r.doc_id: r for r in media.media_columns(frame(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i].fingerprints == slow_fingerprints(media.pad((text or "").encode()))
    x = np.frombuffer(b"The quick brown fox " * 29, np.uint8)[:576].astype(float)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576)
    assert np.allclose(turn @ x, np.fft.rfft(x))
    df = spark.createDataFrame([("a", "x y"), (None, "x y"), ("a", "x y")], "doc_id string, text string")
    rows = media.media_columns(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["None", "a", "a"] and len({r.feature for r in rows}) == 1


def test_peaks_find_a_tone():
    t = np.arange(576 * 4)
    tone = np.rint(128 + 100 * np.sin(2 * np.pi * t * 36 / 576)).astype(np.uint8).tobytes()
    assert set(media.peaks(tone)[0]) == {36}
    assert not media.peaks(b"\xff" * 576)[0].any()


# Classifiers

BIG = 2**64


def slow_quality(text, model):
    """The score of a text, token by token."""
    codes = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text)]
    bins = Counter()
    for c in codes:
        bins[c * 0x9E3779B97F4A7C15 % BIG >> 44] += 1
    for a, b in zip(codes, codes[1:]):
        bins[(a * 0xC2B2AE3D27D4EB4F + b) * 0x9E3779B97F4A7C15 % BIG >> 44] += 1
        bins[0] += a == b
    z = model.bias + sum(float(model.weight[i]) * (n / len(codes)) ** 0.5 for i, n in bins.items())
    return 1 / (1 + np.exp(-z))


def slow_grams(text):
    """Bins of the distinct n-grams of a text."""
    text, out = " " + " ".join(text.lower().split()) + " ", set()
    for n in toxicity.SIZES:
        for at in range(len(text) - n + 1):
            h = 0
            for c in text[at : at + n]:
                h = (h * 0xD6E8FEB86659FD93 + ord(c)) % BIG
            out.add(((h ^ h >> 32 ^ n << 56) * 0x9E3779B97F4A7C15 % BIG) >> (64 - toxicity.BITS))
    return out


def slow_toxicity(text, model):
    return 1 / (1 + np.exp(-(model.bias + sum(float(model.weight[i]) for i in slow_grams(text)))))


def test_n_grams_are_of_characters():
    features = toxicity.Featuriser()
    for text in ["", " ", "ab", "Straße ÄÖ", "東京東京東京 ", "Привет, Мир", "a" * 50, "İ\u0301x"]:
        assert set(features(text.encode()).tolist()) == slow_grams(text)
    a, b = (set(features(x.encode()).tolist()) for x in ("東京都", "東京府"))
    assert len(a & b) >= 1 and a - b and b - a


def test_long_texts_are_cut_into_pieces(monkeypatch):
    text = "".join(random.Random(3).choices("abcdé 東", k=3000))
    whole = set(toxicity.Featuriser()(text.encode()).tolist())
    monkeypatch.setattr(toxicity, "PIECE", 64)
    got = toxicity.Featuriser()(text.encode()).tolist()
    assert set(got) == whole == slow_grams(text) and len(got) == len(whole)


def test_log_ratios_and_counts(spark):
    texts = {1: "an idiot here", 3: "idiot", 4: "a nice day", 6: "nice", 8: "day by day"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4), 1) for i in texts], "doc_id long, toxic int, quality int")
    rows = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 0]
    yes, no = (Counter(b for i in rows if (i < 4) == toxic for b in slow_grams(texts[i])) for toxic in (True, False))
    n_yes = sum(i < 4 for i in rows)
    seen = {}
    original = toxicity.fit_scaled
    toxicity.fit_scaled = lambda bins, y, ratio: seen.update(ratio=ratio, bins=bins, y=y) or original(bins, y, ratio)
    try:
        toxicity.train(docs, labels)
    finally:
        toxicity.fit_scaled = original
    for b in set(yes) | set(no):
        want = np.log((yes[b] + 0.5) / (n_yes + 1)) - np.log((no[b] + 0.5) / (len(rows) - n_yes + 1))
        assert seen["ratio"][b] == pytest.approx(want)
    assert np.count_nonzero(seen["ratio"]) <= len(set(yes) | set(no))
    assert [set(b.tolist()) for b in seen["bins"]] == [slow_grams(texts[i]) for i in sorted(rows)]


def test_the_fit_is_that_of_the_regression(monkeypatch):
    """Dual ascent against gradient descent on the penalised loss."""
    r = np.random.default_rng(5)
    monkeypatch.setattr(toxicity, "BITS", 5)
    bins = [np.unique(r.integers(0, 32, 9)) for _ in range(40)]
    labels, ratio = np.array([int(3 in b or r.random() < 0.2) for b in bins]), r.normal(size=32)
    model = toxicity.fit_scaled(bins, labels, ratio, passes=400, penalty=0.05)
    square = np.mean([np.square(ratio[b]).sum() for b in bins])
    x = np.zeros((40, 33))
    for i, b in enumerate(bins):
        x[i, b] = ratio[b] / square**0.5
    x[:, 32] = 1
    sign, share = np.where(labels > 0, 1, -1), np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    w = np.zeros(33)
    for _ in range(20_000):
        w -= 0.2 * (0.05 * w - x.T @ (sign * share / (1 + np.exp(sign * (x @ w)))))
    assert model.weight == pytest.approx(w[:32] * ratio / square**0.5, abs=2e-3)


def test_ftrl_against_a_plain_version():
    r = random.Random(8)
    rows = [(np.array(sorted(r.sample(range(20), 5))), np.array([r.random() for _ in range(5)]), r.randint(0, 1)) for _ in range(50)]
    model = quality.fit(rows, passes=3, alpha=0.4, beta=0.9, l1=0.05, l2=0.1)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, l1, l2):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((0.9 + n[i] ** 0.5) / 0.4 + l2)

    for _ in range(3):
        for bins, values, label in rows:
            now = {i: weight(i, 0.05, 0.1) for i in bins.tolist()} | {"bias": weight("bias", 0, 0)}
            share = dict(zip(bins.tolist(), values.tolist())) | {"bias": 1.0}
            error = 1 / (1 + np.exp(-sum(now[i] * share[i] for i in now))) - label
            for i, w in now.items():
                g = error * share[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.4 * w
                n[i] += g * g
    assert model.bias == pytest.approx(weight("bias", 0, 0))
    assert model.weight[:20] == pytest.approx([weight(i, 0.05, 0.1) for i in range(20)], abs=1e-5)
    assert not model.weight[20:].any()


@pytest.mark.parametrize(("model", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_of_odd_rows(spark, model, label):
    """Ids of any type, null ids, repeated rows, long texts, several labels; the sample is bounded in bytes too."""
    rows = [(f"d{i}", ("bad " if i % 2 else "good ") * 5 + str(i), "x") for i in range(60)] + [(None, "bad", "x"), ("d1", "bad bad", "x"), ("long", "good " * 50_000, "x"), ("d2", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, score string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)] + [("d1", 0), (None, 1), ("gone", 1)], f"doc_id string, {label} int")
    fitted = model.train(docs, labels)
    got = model.score(docs, fitted).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    both = [r.score for r in got if r.doc_id == "d7"] + [r.score for r in got if r.doc_id == "d8"]
    assert both[0] > both[1]
    few = model.train(docs, labels, max_bytes=200)
    assert not np.array_equal(few.weight, fitted.weight)
    none = model.train(docs, labels, max_bytes=0)
    assert model.score(docs.limit(1), none).first().score == pytest.approx(0.5)


def held_out(spark, model, label, fold, held, sf):
    """(accuracy, recall, share of the others flagged, rows) on the labels of the held-out fold."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = model.train(docs, labels)
    got = {r.doc_id: r for r in model.score(docs, fitted).collect()}
    right = n = hit = positive = wrong = 0
    for r in labels.collect():
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == held)
        if x.held_out:
            n += 1
            right += x.predicted == r[label]
            positive += r[label]
            hit += x.predicted == r[label] == 1
            wrong += x.predicted > r[label]
    return right / n, hit / positive, wrong / (n - positive), n


@pytest.mark.parametrize(
    ("model", "label", "fold", "held", "sf"), [(quality, "quality", 4, 2, "sf0.1"), (toxicity, "toxic", 5, 0, "sf0.1"), (toxicity, "toxic", 5, 0, "check_s")]
)
def test_classifiers_on_held_out_rows(spark, model, label, fold, held, sf):
    accuracy, recall, wrong, n = held_out(spark, model, label, fold, held, sf)
    print(f"{label} on {sf}: accuracy {accuracy:.4f}, recall {recall:.4f}, others flagged {wrong:.4f}, rows {n}")
    assert n > 500 and accuracy > 0.97 and recall > 0.9


@pytest.mark.parametrize(("model", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_texts(spark, model, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = model.train(docs, labels)
    odd = model.score(frame(spark, TEXTS), fitted).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    same = {r.doc_id: r.score for r in odd}
    assert same[0] == same[1] == same[2]
    assert model.score(frame(spark, TEXTS).limit(0), fitted).count() == 0
    nothing = model.train(docs, labels.limit(0))
    assert model.score(frame(spark, ["some text"]), nothing).first().score == pytest.approx(0.5)


def test_purely_toxic_n_grams_weigh():
    ratio = toxicity.log_ratios(np.array([5.0, 1, 0]), np.array([0.0, 0, 0]), 10, 58)
    assert ratio[0] > ratio[1] > 0 == ratio[2]
    nothing = toxicity.fit_scaled([np.zeros(0, np.int32)] * 4, np.array([1, 0, 0, 0]), np.zeros(1 << toxicity.BITS))
    assert nothing.score(np.zeros(0, np.int32)) == pytest.approx(1.5 / 5)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxicity_learns_from_few_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, fitted).collect()}
    assert np.count_nonzero(fitted.weight) > 10_000 and len({r.predicted for r in got.values()}) == 2
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.75
