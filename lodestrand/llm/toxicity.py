"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features say whether a text has an n-gram (n 3 to 6 code points of the lower-cased text, white space as
one space), hashed to a fixed number of bins. Each is scaled by the log ratio of its smoothed shares in
toxic and other training texts; a logistic regression is fitted on the scaled features, and its
intercept set where the balanced training error is least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS, SIZES = 20, (3, 4, 5, 6)
#: Labelled rows that a model is fitted on, and bytes of their texts, at most.
MAX_ROWS, MAX_BYTES = 4000, 16 << 20
#: Code points hashed at once, so that a long text needs bounded memory; pieces overlap by the longest n-gram less one.
PIECE = 1 << 22


def _bins(text: np.ndarray) -> np.ndarray:
    """Bins of all n-grams of an array of code points."""
    wide, found = text.astype(np.uint64), []
    rolled = wide
    for n in range(2, max(SIZES) + 1):
        if len(wide) < n:
            break
        rolled = rolled[:-1] * np.uint64(0xD6E8FEB86659FD93) + wide[n - 1 :]
        if n in SIZES:
            mixed = (rolled ^ rolled >> np.uint64(32) ^ np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


class Featuriser:
    """Distinct bins of a text; a scratch table replaces sorting."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, np.int32)

    def _distinct(self, bins: np.ndarray) -> np.ndarray:
        order = np.arange(len(bins), dtype=np.int32)
        self.seen[bins] = order
        return bins[self.seen[bins] == order]

    def __call__(self, body: bytes) -> np.ndarray:
        plain = " ".join(body.decode("utf-8", "replace").lower().split())
        text = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32)
        step, parts = PIECE - max(SIZES) + 1, []
        for start in range(0, max(1, len(text) - max(SIZES) + 1), step):
            parts.append(self._distinct(_bins(text[start : start + PIECE])))
        return parts[0] if len(parts) == 1 else self._distinct(np.concatenate(parts))


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, bins: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[bins].sum() + self.bias, -40, 40))))


def log_ratios(yes: np.ndarray, no: np.ndarray, n_yes: float, n_no: float, *, smooth: float = 0.5) -> np.ndarray:
    """Smoothed log-count ratio of each bin, from the numbers of toxic and other texts that have it; 0 where none has."""
    ratio = np.log((yes + smooth) / (n_yes + 2 * smooth)) - np.log((no + smooth) / (n_no + 2 * smooth))
    return np.where(yes + no > 0, ratio, 0.0)


def fit_scaled(bins: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, *, passes: int = 8, penalty: float = 1e-5, seed: int = 7) -> Model:
    """Logistic regression, classes weighing the same, on bins scaled by their ratios: dual coordinate ascent.

    A text at a time, so that next to the bins only a weight a bin is held. One class only, or no bin that
    tells anything: the base rate.
    """
    labels, size = np.asarray(labels, np.float64), 1 << BITS
    if not len(labels) or labels.min() == labels.max() or not any(ratio[b].any() for b in bins):
        base = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(size, np.float32), float(np.log(base / (1 - base))))
    square = np.array([np.square(ratio[b]).sum() for b in bins])
    scaled = (ratio / np.sqrt(square.mean() + 1e-9)).astype(np.float32)
    curve = (square / (square.mean() + 1e-9) + 1) / penalty
    sign = np.where(labels > 0, 1.0, -1.0)
    most = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    w, bias, dual, r = np.zeros(size), 0.0, np.zeros(len(bins)), np.random.default_rng(seed)
    for _ in range(passes):
        for i in r.permutation(len(bins)):
            value = scaled[bins[i]]
            margin = sign[i] * (value @ w[bins[i]] + bias)
            low, high = 0.0, most[i]
            for _ in range(25):  # halve towards the best dual value between 0 and the text's weight
                x = (low + high) / 2
                up = np.log((most[i] - x) / x) - margin - curve[i] * (x - dual[i]) > 0 if 0 < x < most[i] else x <= 0
                low, high = (x, high) if up else (low, x)
            move = ((low + high) / 2 - dual[i]) * sign[i] / penalty
            dual[i] = (low + high) / 2
            w[bins[i]] += move * value
            bias += move
    z = np.array([scaled[b] @ w[b] for b in bins])
    order = np.argsort(z, kind="stable")
    ranked = labels[order]
    missed, wrong = np.cumsum(ranked) / labels.sum(), 1 - np.cumsum(1 - ranked) / (1 - labels).sum()
    at = int((missed[:-1] + wrong[:-1]).argmin())  # 0.5 lies in the gap with the least balanced error
    return Model((w * scaled).astype(np.float32), float(-(z[order[at]] + z[order[at + 1]]) / 2))


def train(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, fold: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Fit on at most ``max_rows`` rows and ``max_bytes`` of text of ``labels.toxic`` whose fold isn't the held-out one.

    The executors count texts by bin (a row a bin comes to the driver), then send the bins of each text:
    both bounded by the parameters. Rows without a label, null ids and labels without a text are left out;
    no rows at all: the base rate.
    """
    rows = common.labelled_rows(docs, labels, "toxic", fold, lambda x: x != held, max_rows, max_bytes, id_col=id_col, text_col=text_col)
    size = 1 << BITS

    def count():
        features = Featuriser()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = np.zeros((2, size), np.int64)
            for body, label in zip(batch.column("body"), batch.column("label").to_pylist(), strict=True):
                both[int(label > 0), features(body.as_py())] += 1
            some = np.flatnonzero(both.any(axis=0))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(both[1, some]), pa.array(both[0, some])], ["bin", "yes", "no"])

        return apply

    counted = common.map_batches(rows, count, "bin int, yes long, no long").groupBy("bin").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toArrow()
    yes, no = np.zeros(size), np.zeros(size)
    yes[counted.column("bin").to_numpy()], no[counted.column("bin").to_numpy()] = counted.column("yes").to_numpy(), counted.column("no").to_numpy()
    n_yes, n = rows.agg(F.count_if(F.col("label") > 0), F.count(F.lit(1))).first()
    ratio = log_ratios(yes, no, n_yes, n - n_yes)

    def send():
        features = Featuriser()
        return lambda batch: pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([features(x.as_py()) for x in batch.column("body")], pa.list_(pa.int32()))],
            ["doc_id", "label", "bins"],
        )

    got = common.map_batches(rows, send, f"{common.typed(rows, 'doc_id')}, label int, bins array<int>").toArrow().sort_by("doc_id")
    found = [bins.values.to_numpy() for bins in got.column("bins")]
    return fit_scaled(found, got.column("label").to_numpy() > 0, ratio)


def score(docs: DataFrame, model: Model, *, fold: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    The text alone decides the score. Null and empty texts get the score of a text without n-grams; a text
    of any length is read whole, PIECE code points at a time; equal texts get equal scores; repeated rows are kept; a null id counts as an empty one for held_out; an empty table gives an empty
    result; other columns are not read. The model (fixed size) is broadcast. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features, own = Featuriser(), shared.value
        return lambda batch: pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([own.score(features(b.as_py())) for b in batch.column("body")], pa.float64())],
            ["doc_id", "score"],
        )

    rows = common.text_bytes(docs, id_col, text_col)
    scored = common.map_batches(rows, make, f"{common.typed(rows, 'doc_id')}, score double")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold
    return scored.select("doc_id", (part == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
