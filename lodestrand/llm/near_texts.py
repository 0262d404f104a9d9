"""Near-duplicates by similarity of shingle sets: fingerprints and min-hashes propose links, whole sets decide.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Every
link is decided on the whole sets. What is compared comes from lists of texts:

1. The SimHash operator links fingerprints of the shingle sets. Such texts, and neighbours in the lists of
   texts that agree in a band of min-hashes, are compared if their sketches allow it; then each text with
   the one of each other group in its lists that has the nearest sketch. This joins large groups at a cost
   in proportion to their members.
2. All pairs of different groups that share a list, and whose sketches allow it, are compared. Whoever has
   the same group already needs no comparison, so little is left here; no list and no group is cut off.

A fingerprint alone can't do: texts with a similarity of 0.8 differ in 10 of its 64 bits on average, and no
grid of cells finds 16 differing bits without comparing nearly all with all. Of pairs that are just alike,
all BANDS bands miss 0.672 ** 40, one in eight million, and fewer of those that are more alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

#: Words a shingle; least Jaccard similarity, as a fraction.
WORDS, ALIKE = 5, (4, 5)
#: Bands of min-hashes, and min-hashes of a band.
BANDS, ROWS_OF_BAND = 40, 5
#: Bits of a set's sketch: two sets differ in at least as many shingles as their sketches in bits.
SKETCH = 512
#: Texts compared with a text in the first pass, at most; members of a list that make one block in the second.
PROPOSED, BLOCK = 2, 4096
#: Rows of a partition that are paired at once; shingles of texts that a task keeps at hand; shingles hashed at once.
ROWS, AT_HAND, SET_AT_ONCE = 1 << 18, 1 << 20, 1 << 12
#: Of the numbers that min-hashes multiply with and add.
SEED_OF_BANDS = 5


def shingle_set(body: bytes, shingle: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, sorted, of the shingles of lower-cased words; a shorter text is one shingle."""
    return np.unique(simhash.shingle_hashes(body, shingle))


_R = np.random.default_rng(SEED_OF_BANDS)
_TIMES, _PLUS = (_R.integers(0, 1 << 64, BANDS * ROWS_OF_BAND, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_FOLD = _R.integers(0, 1 << 64, ROWS_OF_BAND, np.uint64) | np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of the min-hashes of each band; the empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_TIMES), ~np.uint64(0))
    for at in range(0, len(found), SET_AT_ONCE):
        mixed = found[at : at + SET_AT_ONCE, None] * _TIMES + _PLUS
        np.minimum(least, mixed.min(axis=0), out=least)
    key = ((least ^ least >> np.uint64(31)).reshape(BANDS, ROWS_OF_BAND) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLUS[0]
    return (key ^ key >> np.uint64(29)).view(np.int64)


def sketch(found: np.ndarray) -> bytes:
    """Parity of the number of a set's shingles in each of SKETCH classes."""
    return np.packbits(np.bincount(found.view(np.int64) & (SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (token, n, node), sorted: members of tokens of two or more, each with the next two there.

    Next ones of too different a size are null. A partition's first and last token are passed on whatever
    their members, as others may be elsewhere.
    """
    held, first = None, None

    def out(columns, low, high, end):
        token, n, node = columns
        same = np.r_[False, token[1:] == token[:-1], False]
        keep = (same[:-1] | same[1:]) | (token == first) | (end & (token == token[-1]))
        keep[:low] = keep[high:] = False
        at, following = np.flatnonzero(keep), []
        for lag in (1, 2):
            to = np.minimum(at + lag, len(token) - 1)
            fit = (to == at + lag) & (token[to] == token[at]) & (n[at] * ALIKE[1] >= n[to] * ALIKE[0])
            following.append(pa.array(node[to], mask=~fit))
        return pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns), *following], ["token", "n", "node", "next1", "next2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now, low = [batch.column(c).to_numpy() for c in ("token", "n", "node")], 0
        if held is None:
            first = now[0][0]
        else:
            now, low = [np.concatenate(x) for x in zip(held[0], now, strict=True)], held[1]
        high = max(low, len(now[0]) - 2)  # the last two wait for those behind them
        yield out(now, low, high, False)
        back = max(0, high - 1)
        held = [c[back:] for c in now], high - back
    if held is not None:
        yield out(held[0], held[1], len(held[0][0]), True)


def _apart(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits in which sketches differ, whether such sets may be alike): alike, (a + b) / 9 shingles or fewer are in one set only."""
    bits = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return bits, bits * sum(ALIKE) <= (n_a + n_b) * (ALIKE[1] - ALIKE[0])


def _lines(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _may_be_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (a, b, n_a, n_b, sketch_a, sketch_b): the pairs whose sketches allow that they are alike."""
    for batch in batches:
        if batch.num_rows:
            _, fit = _apart(*(_lines(batch.column(c)) for c in ("sketch_a", "sketch_b")), *(batch.column(c).to_numpy() for c in ("n_a", "n_b")))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fit))


def _unlike_groups(nearest: bool):
    """Task function over (token, low, high, own, n, node, root, sketch), sorted: pairs of different groups that may be alike.

    Under low <> high only pairs across the two blocks are made, the others are made elsewhere. Sizes and
    sketches must allow that a pair is alike. ``nearest``: of the pairs of a text (that of the higher root)
    with the members of one other group only that with the nearest sketches.
    """
    names = ("token", "low", "high", "own", "n", "node", "root")

    def paired(parts):
        token, low, high, own, n, node, root, lines = parts
        new = np.r_[True, (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(token)])
        start, of = np.repeat(first, size), np.repeat(size, size)
        left, lag = np.arange(len(token)), 1
        place = left - start
        while len(left := left[place[left] + lag < of[left]]):
            # sizes grow within a list: who is too small for this partner is for all later ones
            left = left[n[left] * ALIKE[1] >= n[left + lag] * ALIKE[0]]
            i, j = left, left + lag
            fit = (root[i] != root[j]) & ((low[i] == high[i]) | (own[i] != own[j]))
            i, j = i[fit], j[fit]
            bits, near = _apart(lines[i], lines[j], n[i], n[j])
            i, j = i[near], j[near]
            turn = root[i] < root[j]
            yield np.stack([np.where(turn, node[j], node[i]), np.where(turn, root[i], root[j]), bits[near], np.where(turn, node[i], node[j])])
            lag += 1

    def best(found):
        found = np.concatenate(found, axis=1)
        found = found[:, np.lexsort(found[::-1])]
        return found[:, np.r_[True, (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])][: found.shape[1]]]

    def batch_of(found):
        a, b = np.minimum(found[0], found[3]), np.maximum(found[0], found[3])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def out(parts):
        found, n_found = [], 0
        for some in paired(parts):
            if not nearest:
                yield batch_of(some)
                continue
            found.append(some)
            n_found += some.shape[1]
            if n_found >= ROWS:
                found = [best(found)]
                n_found = 0
        if found:
            yield batch_of(best(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        joined = lambda: [np.concatenate([h[k] for h in held]) for k in range(len(names) + 1)]
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([*(batch.column(c).to_numpy() for c in names), _lines(batch.column("sketch"))])
            rows += batch.num_rows
            if rows >= ROWS:
                parts = joined()
                last = np.flatnonzero((parts[0] != parts[0][-1]) | (parts[1] != parts[1][-1]) | (parts[2] != parts[2][-1]))
                if len(last):
                    end = int(last[-1]) + 1
                    yield from out([p[:end] for p in parts])
                    parts = [p[end:] for p in parts]
                held, rows = [parts], len(parts[0])
        if rows:
            yield from out(joined())

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (a, b, texts of both): the pairs whose Jaccard similarity is high enough."""
    known: dict[int, np.ndarray] = {}
    room = AT_HAND

    def set_of(node: int, text) -> np.ndarray:
        nonlocal room
        found = known.get(node)
        if found is None:
            found = known[node] = shingle_set(text.as_py())
            room -= len(found) + 16
        return found

    for batch in batches:
        keep = []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
            x, y = set_of(a, x), set_of(b, y)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(both * ALIKE[1] >= (len(x) + len(y) - both) * ALIKE[0])
            if room < 0:
                known.clear()
                room = AT_HAND
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a row: doc_id, k1 and k2 (what the row is known by), and of its set s1 and s2 (a 128-bit hash), fp, n, bands, sketch."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(b.as_py()) for b in batch.column("body")]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(f.tobytes()) for f in found), np.int64).reshape(-1, 2)
            columns = {
                **{c: batch.column(c) for c in ("doc_id", "k1", "k2")}, "s1": pa.array(digest[:, 0]), "s2": pa.array(digest[:, 1]),
                "fp": pa.array([simhash.majority(f) for f in found], pa.int64()), "n": pa.array([len(f) for f in found], pa.int64()),
                "bands": pa.array([bands(f) for f in found], pa.list_(pa.int64())), "sketch": pa.array([sketch(f) for f in found], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return apply

    rows = common.text_bytes(docs, id_col, text_col, *common.row_key(docs, id_col, text_col))
    return common.map_batches(rows, make, f"{common.typed(rows, 'doc_id')}, k1 long, k2 long, s1 long, s2 long, fp long, n long, bands array<long>, sketch binary")


def _beside(members: DataFrame) -> DataFrame:
    """a, b: pairs that stand side by side in lists, those with the most lists first, PROPOSED for each node."""
    beside = members.select(F.col("node").alias("a"), F.explode(F.array("next1", "next2")).alias("b")).where("b IS NOT NULL")
    met = beside.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    best = Window.partitionBy("b").orderBy(F.desc("met"), "a")  # bounded by twice the bands of a node
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROPOSED).select("a", "b")


def _near_fingerprints(nodes: DataFrame) -> DataFrame:
    """a, b: nodes of equal fingerprints, each with the first of them, and the first ones of linked fingerprints."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("a"))
    equal = nodes.select("fp", F.col("node").alias("b")).join(first, "fp").where("a <> b").select("a", "b")
    head = lambda x: first.select(F.col("fp").alias(x), F.col("a").alias(f"head_{x}"))
    near = simhash.links(first.select("fp")).join(head("a"), "a").join(head("b"), "b")
    return equal.unionByName(near.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """nodes (node, first: no_id, doc_id, k1, k2 of the first row of each distinct set) and roots (node, root) of those that have links."""
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k1", "k2")).alias("first")
    one = lambda *columns: [F.first(c).alias(c) for c in columns]  # noqa: E731  (equal in all rows of a set)
    sets = shingled(docs, id_col, text_col).groupBy("s1", "s2").agg(first, *one("fp", "n", "bands", "sketch"))
    nodes = common.cut(sets.drop("s1", "s2")).withColumn("node", F.monotonically_increasing_id())  # stable: read from the checkpoint
    tokens = nodes.select(F.explode("bands").alias("token"), "n", "node").repartitionByRange("token", "n", "node").sortWithinPartitions("token", "n", "node")
    # a long list lies in several partitions here: neighbours need no more
    members = common.cut(tokens.mapInArrow(_neighbours, "token long, n long, node long, next1 long, next2 long"))
    proposed = common.cut(_beside(members).unionByName(_near_fingerprints(nodes)).distinct())
    ends = proposed.select(F.col("a").alias("node")).unionByName(proposed.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    rows = common.text_bytes(docs, id_col, text_col, *common.row_key(docs, id_col, text_col)).drop("doc_id")
    wanted = nodes.join(ends, "node").select("node", "first.k1", "first.k2")
    texts = common.cut(rows.join(wanted, ["k1", "k2"]).select("node", "body").dropDuplicates(["node"]))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are alike."""
        side = lambda x: texts.select(F.col("node").alias(x), F.col("body").alias(f"text_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        return common.cut(both.mapInArrow(_alike, "a long, b long"))

    def allowed(pairs: DataFrame) -> DataFrame:
        """The pairs that their sketches allow."""
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_may_be_alike, "a long, b long")

    def across(roots: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of different groups that share a list and may be alike."""
        rooted = members.select("token", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = rooted.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
        rest = rooted.join(split.select("token", F.ceil(F.col("rows") / BLOCK).alias("blocks")), "token").join(nodes.select("node", "sketch"), "node")
        dealt = common.block_pairs(rest, "node").select("token", "low", "high", "own", "n", "node", "root", "sketch")
        return dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "node").mapInArrow(_unlike_groups(nearest), "a long, b long").distinct()

    common.release(docs.sparkSession)  # of some twenty steps, each with a plan of its own
    tested = common.cut(allowed(proposed))
    roots = common.cut(simhash.components(linked(tested)))
    for nearest in (True, False):
        common.release(docs.sparkSession)
        pairs = common.cut(across(roots, nearest).join(tested, ["a", "b"], "left_anti"))
        roots = common.cut(simhash.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked(pairs))))
        tested = tested.unionByName(pairs)
    return nodes, roots


def keep_one_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts linked by a Jaccard similarity of 0.8 or more, all columns as they are.

    The similarity is that of the sets of five-word shingles, worked out on the whole sets. The row with the smallest id stays (null last), at a tie the one with the smallest hash of the row; of rows that
    are alike in all columns one stays. Texts without words (null, empty, white space) are one group. Texts
    of any length are read whole; an empty table gives an empty result. Whole texts are shuffled to be
    compared, if they are, and once at the end, by a hash of the row.
    """
    nodes, roots = groups(docs, id_col=id_col, text_col=text_col)
    grouped = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    key = common.row_key(docs, id_col, text_col)
    held = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    winners = grouped.select("first.k1", "first.k2").hint("shuffle_hash")
    return held.join(winners, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
