"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other signs; one- and two-token sequences are hashed
to a fixed number of bins, and all pairs of equal tokens share one more. A document's score is a sparse dot product of its length-scaled counts with
the weights, of which the fit leaves most at exactly zero.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
#: Labelled rows that a model is fitted on, and bytes of their texts, at most.
MAX_ROWS, MAX_BYTES = 4000, 16 << 20
#: Tokens kept in a task's memo, and tokens hashed at once.
MEMO_TOKENS, PIECE = 400_000, 1 << 20

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Featuriser:
    """(bins, values) of a text: share of each one- and two-token bin, scaled to a length of about 1."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def _codes(self, text: str) -> np.ndarray:
        memo, out, parts = self.memo, [], []
        for match in _TOKEN.finditer(text):
            token = match.group()
            code = memo.get(token)
            if code is None:
                code = zlib.crc32(token.encode())
                if len(token) <= 40:
                    if len(memo) >= MEMO_TOKENS:
                        memo.clear()
                    memo[token] = code
            out.append(code)
            if len(out) >= PIECE:
                parts.append(np.array(out, np.uint64))
                out = []
        return np.concatenate([*parts, np.array(out, np.uint64)])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = self._codes(text)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0)
        odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
        one = (codes * odd) >> shift
        two = ((codes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[1:]) * odd) >> shift
        same = np.zeros(np.count_nonzero(codes[:-1] == codes[1:]), np.uint64)  # bin 0: any token twice in a row
        bins, counts = np.unique(np.concatenate([one, two, same]), return_counts=True)
        return bins.astype(np.int64), np.sqrt(counts / len(codes))


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, bins: np.ndarray, values: np.ndarray) -> float:
        z = float(self.weight[bins] @ values) + self.bias
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def fit(rows, *, passes: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> Model:
    """FTRL-proximal over (bins, values, label), in the given order, ``passes`` times. No rows: score 0.5."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    bias = 0.0
    for _ in range(passes):
        for bins, values, label in rows:
            zi, ni = z[bins], n[bins]
            w = -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(ni)) / alpha + l2)
            bias = -zb / ((beta + nb**0.5) / alpha)
            margin = max(-40.0, min(40.0, float(w @ values) + bias))
            error = 1 / (1 + np.exp(-margin)) - label
            g = error * values
            z[bins] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[bins] = ni + g * g
            zb += error - ((nb + error * error) ** 0.5 - nb**0.5) / alpha * bias
            nb += error * error
    weight = -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)
    return Model(weight.astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha)))


def train(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, fold: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Fit on at most ``max_rows`` rows and ``max_bytes`` of text of ``labels.quality`` whose fold isn't the held-out one.

    Features are made on the executors; the driver gets the sample's bins (two for each token at most),
    bounded by the parameters, and runs the updates in the order of doc_id. Rows without a label, null ids
    and labels without a text are left out.
    """
    rows = common.labelled_rows(docs, labels, "quality", fold, lambda x: x != held, max_rows, max_bytes, id_col=id_col, text_col=text_col)

    def make():
        features = Featuriser()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [features(b.as_py().decode()) for b in batch.column("body")]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([b.astype(np.int32) for b, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))],
                ["doc_id", "label", "bins", "shares"],
            )

        return apply

    got = common.map_batches(rows, make, f"{common.typed(rows, 'doc_id')}, label int, bins array<int>, shares array<float>").toArrow().sort_by("doc_id")
    bins, shares = got.column("bins").combine_chunks(), got.column("shares").combine_chunks()
    ends, flat, share = bins.offsets.to_numpy(), bins.values.to_numpy(), shares.values.to_numpy().astype(np.float64)
    return fit([(flat[a:b], share[a:b], y) for a, b, y in zip(ends[:-1], ends[1:], got.column("label").to_pylist(), strict=True)])


def score(docs: DataFrame, model: Model, *, fold: int = 4, held: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    The text alone decides the score. Null and empty texts get the score of a text without tokens; a text of
    any length is read whole; equal texts get equal scores; repeated rows are kept; a null id counts as an empty one for held_out; an empty table gives an empty
    result; other columns are not read. The model (fixed size) is broadcast. Narrow: no shuffle.
    """
    scored = _with_score(text_rows := common.text_bytes(docs, id_col, text_col), model, text_rows.columns[:1])
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold
    return scored.select("doc_id", (part == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _with_score(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        features, own = Featuriser(), shared.value
        return lambda batch: pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array([own.score(*features(b.as_py().decode())) for b in batch.column("body")], pa.float64())],
            [*keep, "score"],
        )

    return common.map_batches(rows, make, f"{common.typed(rows, *keep)}, score double")


def keep_good(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is ``threshold`` or more.

    Null and empty texts have the score of a text without tokens; repeated rows stay or go together; ids are
    not read; an empty table gives an empty result; a text of any length is scored whole. Narrow: no shuffle.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index(text_col)

    def make():
        features, own = Featuriser(), shared.value
        return lambda batch: batch.filter(
            pa.array([own.score(*features(t.as_py() or "")) >= threshold for t in batch.column(at)], pa.bool_())
        )

    return common.map_batches(docs, make, docs.schema)
