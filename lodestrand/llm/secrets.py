"""Secret scans: patterns find base spans, a character convolutional network judges further candidates.

Candidates are runs of characters that keys are made of. The network sees every candidate, or each piece
of a long one, with the characters around it. It is trained on all findings of all texts, labelled by the
base patterns, but a fifth; on these its scores are calibrated, and the threshold is the highest that keeps a
given recall there.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

#: Characters before, in and after a candidate's piece that the network sees.
BEFORE, INSIDE, AFTER = 20, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Findings that a network starts from, at most, half of them of each label, and those, about, that a part of all
#: findings has: each part trains the network further, and the parts' networks are averaged.
START_FINDINGS, PART = 3000, 32_768
#: One finding in so many calibrates.
HELD = 5
RECALL = 0.98
#: Pieces whose codes are made at once.
CHUNK = 1 << 14

_CODES = np.zeros(256, np.uint8)  # 0: outside the text
_CODES[1:] = 1
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789+/_.=-:\"' \n", 3):
    _CODES[ord(_c)] = _i
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1] + 50
_CODES[128:] = 2
N_CODES = 110
#: What a network learns.
WEIGHTS = ("table", "conv", "conv_bias", "dense", "dense_bias", "out", "out_bias")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, leftmost and non-overlapping for each kind, by start, then kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def touched(spans: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> np.ndarray:
    """Whether each of ``spans`` has a part of a base span: one sweep over the union of these, which are sorted by start."""
    if not base or not spans:
        return np.zeros(len(spans), bool)
    start, end = (np.array(x, np.int64) for x in zip(*((a, b) for a, b, _ in base), strict=True))
    end = np.maximum.accumulate(end)
    own_start, own_end = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    first = np.searchsorted(end, own_start, side="right")  # the first that ends behind the candidate's start
    return (first < len(start)) & (start[np.minimum(first, len(start) - 1)] < own_end)


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of every piece with its surroundings, index of the span it is from)."""
    rows, owner = [], []
    for i, (start, end) in enumerate(spans):
        for at in range(start, end, INSIDE):
            piece = text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0") + text[at : at + INSIDE].ljust(INSIDE, "\0")
            if end - at < INSIDE:  # what follows the candidate stands behind it, not in it
                piece = piece[: BEFORE + end - at].ljust(BEFORE + INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
            else:
                piece += text[at + INSIDE : at + INSIDE + AFTER].ljust(AFTER, "\0")
            rows.append(piece.encode("latin-1", "replace") if piece.isascii() else bytes(min(ord(c), 255) for c in piece))
            owner.append(i)
    codes = _CODES[np.frombuffer(b"".join(rows), np.uint8)].reshape(-1, WIDTH)
    return codes, np.array(owner, np.int64)


@dataclass
class Network:
    """Embedding, one convolution over characters, maximum over places, two dense layers."""

    table: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    TAPS = 5

    @classmethod
    def fresh(cls, seed: int = 7, dims: int = 8, filters: int = 24, hidden: int = 16) -> Network:
        r = np.random.default_rng(seed)
        wide = dims * cls.TAPS
        return cls(
            r.normal(0, 0.5, (N_CODES, dims)), r.normal(0, (2 / wide) ** 0.5, (wide, filters)), np.zeros(filters),
            r.normal(0, (2 / (3 * filters)) ** 0.5, (3 * filters, hidden)), np.zeros(hidden), r.normal(0, 0.3, (hidden,)), np.zeros(1),
        )

    def round(self) -> None:
        """To single precision, in which all scores are worked out."""
        for name in WEIGHTS:
            setattr(self, name, getattr(self, name).astype(np.float32))

    def _forward(self, codes: np.ndarray):
        lines = self.table[codes]
        taps = np.lib.stride_tricks.sliding_window_view(lines, self.TAPS, axis=1).transpose(0, 1, 3, 2)
        taps = taps.reshape(*taps.shape[:2], -1)
        heat = np.maximum(taps @ self.conv + self.conv_bias, 0)
        edges = (0, BEFORE - 2, BEFORE + INSIDE - 2, heat.shape[1])
        best = [a + heat[:, a:b].argmax(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        pooled = np.concatenate([np.take_along_axis(heat, x[:, None], 1)[:, 0] for x in best], axis=1)
        inner = np.maximum(pooled @ self.dense + self.dense_bias, 0)
        return taps, best, pooled, inner, inner @ self.out + self.out_bias[0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 1024])[-1] for i in range(0, len(codes), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.shift, -40, 40)))

    def fit(self, codes: np.ndarray, labels: np.ndarray, *, passes: int = 20, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> None:
        names = WEIGHTS
        if not len(codes):
            return
        first, second, step, r = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0, np.random.default_rng(seed)
        share = min(max(labels.mean(), 0.05), 0.95)
        for _ in range(passes):
            order = r.permutation(len(codes))
            for i in range(0, len(order), batch):
                x, y = codes[order[i : i + batch]], labels[order[i : i + batch]]
                taps, best, pooled, inner, z = self._forward(x)
                error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
                d_inner = error[:, None] * self.out * (inner > 0)
                d_pooled = d_inner @ self.dense.T * (pooled > 0)
                grads = {"out": inner.T @ error, "out_bias": error.sum(keepdims=True), "dense": pooled.T @ d_inner, "dense_bias": d_inner.sum(0)}
                d_heat = np.zeros((*taps.shape[:2], self.conv.shape[1]))
                for x_best, d in zip(best, np.split(d_pooled, 3, axis=1), strict=True):
                    np.put_along_axis(d_heat, x_best[:, None], d[:, None], 1)
                grads["conv"] = np.tensordot(taps, d_heat, ((0, 1), (0, 1)))
                grads["conv_bias"] = d_heat.sum((0, 1))
                d_taps = (d_heat @ self.conv.T).reshape(*d_heat.shape[:2], self.TAPS, -1)
                d_lines = np.zeros((*x.shape, self.table.shape[1]))
                for t in range(self.TAPS):
                    d_lines[:, t : t + d_taps.shape[1]] += d_taps[:, :, t]
                flat = d_lines.reshape(-1, self.table.shape[1])
                grads["table"] = np.stack([np.bincount(x.ravel(), flat[:, j], N_CODES) for j in range(flat.shape[1])], axis=1)
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, getattr(self, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))

    def calibrate(self, z: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by damped Newton steps on ``counts`` logits each, then the highest threshold that keeps ``recall`` of the positives."""
        n, n_yes = counts.sum(), counts[labels > 0].sum()
        aim = np.where(labels > 0, (n_yes + 1) / (n_yes + 2), 1 / (n - n_yes + 2))
        centre = (counts * z).sum() / n
        width = ((counts * (z - centre) ** 2).sum() / n) ** 0.5 + 1e-9
        x, theta = np.stack([(z - centre) / width, np.ones(len(z))], axis=1), np.zeros(2)

        def loss(t: np.ndarray) -> float:
            return float((counts * (np.logaddexp(0, x @ t) - aim * (x @ t))).sum() + 0.01 * t @ t)

        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
            gradient = x.T @ (counts * (p - aim)) + 0.02 * theta
            move = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2), gradient)
            pace = 1.0
            while pace > 1e-6 and loss(theta - pace * move) > loss(theta):
                pace /= 2
            theta = theta - pace * move
        self.slope, self.shift = float(theta[0] / width), float(theta[1] - theta[0] * centre / width)
        self.threshold = 1.1
        if n_yes:
            order = np.argsort(z[labels > 0], kind="stable")
            up_to = np.cumsum(counts[labels > 0][order])
            least = z[labels > 0][order][np.searchsorted(up_to, int(n_yes * (1 - recall)), side="right")]
            self.threshold = float(1 / (1 + np.exp(-np.clip(self.slope * least + self.shift, -40, 40))))


def labelled_findings(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, labels) of a text's candidates: 1 where a base span has a part of it."""
    spans = candidates(text)
    if not spans:
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0)
    codes, owner = windows(text, spans)
    return codes, touched(spans, base_spans(text))[owner].astype(float)


def varied(codes: np.ndarray, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The findings and copies of them whose labels are known: what a key is made of and what is around it may be otherwise.

    A positive finding is there once more with its letters and digits exchanged at random, and once more so
    within the surroundings of another finding; one that isn't is there once more in capitals.
    """
    r = np.random.default_rng(seed)
    yes, no = codes[labels > 0], codes[labels == 0]
    inside = slice(BEFORE, BEFORE + INSIDE)
    signs = np.unique(_CODES[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)])
    other = yes.copy()
    for row in other:
        exchange = np.arange(N_CODES, dtype=np.uint8)
        exchange[signs] = r.permutation(signs)
        row[inside] = exchange[row[inside]]
    elsewhere = codes[r.integers(0, len(codes), len(other))].copy()
    # what follows a short piece stands in its own row: surroundings are those in front and, at the end, behind
    elsewhere[:, inside] = other[:, inside]
    small = _CODES[ord("a")] <= no
    capitals = np.where(small & (no <= _CODES[ord("z")]), no + (_CODES[ord("A")] - _CODES[ord("a")]), no)
    both = np.concatenate([codes, other, elsewhere, capitals.astype(np.uint8)])
    return both, np.concatenate([labels, np.ones(2 * len(yes)), np.zeros(len(no))])


def all_findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """rank, code, label, held: the distinct findings of all texts; rank is a hash of the code, held a fifth of them."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [labelled_findings(t) for t in batch.column("text").to_pylist()]
            codes = [row.tobytes() for some, _ in found for row in some]
            if codes:
                columns = [[xxhash.xxh3_64_intdigest(c) >> 2 for c in codes], codes, np.concatenate([x for _, x in found]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32()), strict=True)], ["rank", "code", "label"])

    found = rows.mapInArrow(run, "rank long, code binary, label int").groupBy("rank", "code", "label").agg(F.lit(1).alias("n")).drop("n")
    return common.cut(found.withColumn("held", F.col("rank") % HELD == 0))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(codes, labels) in the order of rank and label, so that they are the same at every run."""
    table = table.sort_by([("rank", "ascending"), ("label", "ascending")])
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, WIDTH)
    return codes, table.column("label").to_numpy().astype(float)


def _start(found: DataFrame, half: int) -> Network | None:
    """A network fitted on ``half`` findings of each label, those with the smallest ranks; None without both labels."""
    # how many have 63, 62, ... leading bits of zero: a few rows, from which the bound for the half is read
    level = F.ceil(F.log2(F.col("rank") + 1)).cast("int").alias("level")
    bound, so_far = {0: 0, 1: 0}, {0: 0, 1: 0}
    for label, at, n in sorted(map(tuple, found.groupBy("label", level).count().collect())):
        if so_far[label] < half:
            bound[label], so_far[label] = at, so_far[label] + n
    if not all(so_far.values()):
        return None
    codes, labels = _arrays(found.where(level <= F.when(F.col("label") == 1, bound[1]).otherwise(bound[0])).toArrow())
    chosen = np.sort(np.concatenate([np.flatnonzero(labels == label)[:half] for label in (0, 1)]))
    network = Network.fresh()
    network.fit(*varied(codes[chosen], labels[chosen]))
    return network


def _further(found: DataFrame, network: Network, part: int) -> None:
    """Train ``network`` once on all of ``found``: in parts of about ``part`` by hash, whose networks are averaged by their sizes."""
    shared = found.sparkSession.sparkContext.broadcast(network)
    parts = max(1, -(-found.count() // part))

    def run(table: pa.Table) -> pa.Table:
        codes, labels = _arrays(table)
        own = copy.deepcopy(shared.value)
        own.fit(*varied(codes, labels), passes=1, rate=1e-3)
        weights = np.concatenate([getattr(own, k).ravel() for k in WEIGHTS]).astype(np.float32)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "n": pa.array([len(codes)], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})

    dealt = found.select(F.pmod(F.xxhash64("rank"), F.lit(parts)).cast("long").alias("part"), "rank", "code", "label")
    total, n = 0.0, 0
    for _, size, raw in sorted(map(tuple, dealt.groupBy("part").applyInArrow(run, "part long, n long, weights binary").collect())):  # some 12 KB a part
        total, n = total + size * np.frombuffer(raw, np.float32).astype(np.float64), n + size
    at = 0
    for k in WEIGHTS:
        old = getattr(network, k)
        setattr(network, k, (total[at : at + old.size] / n).reshape(old.shape))
        at += old.size


def _logits(found: DataFrame, network: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, label, count) of all of ``found``; logits are rounded down to thousandths, which bounds the rows."""
    shared = found.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, WIDTH)
            z = np.floor(np.clip(shared.value.logits(codes).astype(np.float64), -60, 60) * 1000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column("label")], ["z", "label"])

    rows = sorted(map(tuple, found.select("code", "label").mapInArrow(run, "z long, label int").groupBy("z", "label").count().collect()))
    z, labels, counts = (np.array(x, np.float64) for x in zip(*rows, strict=True))
    return z / 1000, labels, counts


def train(docs: DataFrame, *, start_findings: int = START_FINDINGS, part: int = PART, recall: float = RECALL, text_col: str = "text") -> Network:
    """Fit on all labelled findings of all texts but a fifth, which calibrates and from which the threshold is read.

    A network that is fitted on ``start_findings`` of them (those with the smallest hashes, half positive
    where there are as many) is trained further on all: parts of about ``part`` findings, dealt by hash,
    each in a task, give a network each, and these are averaged. Findings are distinct, and what they are dealt
    and ordered by are hashes of themselves, so the result depends neither on files nor on repeated texts.
    Without findings of both labels (an empty table, null texts) the network adds none; where the
    fifth has no positive one, all calibrate.
    """
    found = all_findings(docs, text_col)
    fitted, held = found.where(~F.col("held")), found.where("held")
    network = _start(fitted, start_findings // 2)
    if network is None:
        network = Network.fresh()
        network.threshold = 1.1
        return network
    _further(fitted, network, part)
    network.round()
    network.calibrate(*_logits(held if held.where("label = 1").limit(1).count() else found, network), recall)
    return network


def probabilities(text: str, spans: list[tuple[int, int]], network: Network) -> np.ndarray:
    """The network's calibrated probability for each span, of a long one the highest of its pieces."""
    best, at = np.zeros(len(spans)), 0
    while at < len(spans):
        end, pieces = at, 0
        while end < len(spans) and (pieces < CHUNK or end == at):
            pieces += -(-(spans[end][1] - spans[end][0]) // INSIDE)
            end += 1
        codes, owner = windows(text, spans[at:end])
        np.maximum.at(best, owner + at, network.probability(codes))
        at = end
    return best


def find(text: str, network: Network) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score): base spans, and of kind ``net`` the flagged candidates that no base span touches.

    Every candidate is scored. A base span's score is the highest of the candidates it touches (it stays
    whatever that is; 0 if it touches none). Time and memory are in proportion to the text.
    """
    base, spans = base_spans(text), candidates(text)
    if not spans:
        return [(a, b, k, 0.0) for a, b, k in base]
    score, known = probabilities(text, spans, network), touched(spans, base)
    start, end = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    out = []
    for a, b, kind in base:  # candidates don't overlap: those in a base span lie side by side
        low, high = np.searchsorted(end, a, side="right"), np.searchsorted(start, b)
        out.append((a, b, kind, float(score[low:high].max()) if low < high else 0.0))
    out += [(*spans[i], "net", float(score[i])) for i in np.flatnonzero(~known & (score >= network.threshold)).tolist()]
    order = {k: i for i, k in enumerate((*KINDS, "net"))}
    return sorted(out, key=lambda x: (x[0], order[x[2]]))


def scan(docs: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its findings, array<struct<start, end, kind, score>> in code points, by start, then kind.

    Kinds are assign, access, hex (the base patterns) and net (added by the network); score is the network's
    calibrated probability. A null text is empty and has none; a text of any length is searched whole; equal
    texts have equal findings; repeated rows and null ids are kept; an empty table gives an empty result;
    other columns are not read. The network (a few thousand numbers) is broadcast. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"start": a, "end": b, "kind": k, "score": p} for a, b, k, p in find(t.as_py() or "", own)] for t in batch.column("text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "findings"])

        return apply

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(rows, make, f"{common.typed(rows, 'doc_id')}, findings array<struct<start int, end int, kind string, score double>>")


def redact(text: str, network: Network, mark: str = "[secret]") -> str:
    """``text`` with ``mark`` in place of every finding; findings that overlap share one mark."""
    out, at = [], 0
    for start, end, *_ in find(text, network):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_rows(docs: DataFrame, network: Network, *, text_col: str = "text", size_col: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with their findings redacted; ``size_col``, if there, follows a text that changes.

    All columns and all rows stay, repeated ones too; null and empty texts stay as they are; a text of any
    length is redacted whole; an empty table gives an empty result. Narrow: no shuffle.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(network), docs.columns
    at = names.index(text_col)
    size = names.index(size_col) if size_col in names else None

    def make():
        own = shared.value

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            done = [t if t is None else redact(t, own, mark) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(done, columns[at].type)
            if size is not None:
                sizes = [n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), texts, done, strict=True)]
                columns[size] = pa.array(sizes, columns[size].type)
            return pa.RecordBatch.from_arrays(columns, names)

        return apply

    return common.map_batches(docs, make, docs.schema)
