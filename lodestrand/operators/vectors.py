"""Vector search, exact or by cells, and the expansions built on it.

``points`` has id, chunk_index, vector and date_ms (may be null). A search keeps the best rows of each
batch of points by one matrix product and merges them by a window, so what is shuffled is ``depth`` rows a
query and batch, not the product of queries and points. Up to BLOCK queries are broadcast to one pass over
the points; more are joined with them in blocks of both, which bounds what a task holds. A CellIndex
looks at the points of the nearest cells only. Scores are rounded to nine places before they are compared,
and ids break ties, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import overlaps
from .graph import ranked_first, undated_or_before

#: Queries that are broadcast, or joined with a block of points, at once, points of such a block, and the blocks of
#: queries that there are at least where there are enough of them (512 a block).
BLOCK, POINTS, TASKS = 4096, 65_536, 16
#: Queries whose second hops are worked out in one task.
FRONTS = 1024
#: Points that the centres of cells are fitted on, at most.
SAMPLE = 20_000


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where one has no length."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = overlaps.whole(column) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(queries: DataFrame, points: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """query_id, id, chunk_index, score: each query's best ``depth`` points by cosine, exactly.

    ``queries`` has query_id, vector, depth, before (null: no date rule; else points need a smaller, known
    date) and skip (an id that is left out, or null). A point without a vector is never found, a query
    without one finds nothing.
    """
    asked = queries.where("vector IS NOT NULL").select("query_id", "vector", "depth", "before", "skip")
    rows = _plain(points)
    if (n := asked.count()) <= block:
        found = _broadcast_search(asked.toArrow(), rows)
    else:
        found = _joined_search(asked.withColumn("cell", F.lit(0)), rows.withColumn("cell", F.lit(0)), min(block, max(512, -(-n // TASKS))))
    return ranked_first(found, F.col("depth"), F.desc("score"), F.asc("id"), F.asc("chunk_index")).drop("depth")


def _plain(points: DataFrame) -> DataFrame:
    return points.where("vector IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.col("chunk_index").cast("int").alias("chunk_index"), "vector", "date_ms")


FOUND = "query_id string, id string, chunk_index int, score double, depth int"


class _Asked:
    """A block of queries as arrays."""

    def __init__(self, names, vectors: np.ndarray, depth, before, skip):
        self.names, self.vectors, self.skip = np.array(names, object), _unit(vectors), list(skip)
        self.depth, self.dated = np.array(depth, np.int64), np.array([x is not None for x in before], bool)
        self.before = np.array([2**62 if x is None else int(x) for x in before], np.int64)

    def best(self, ids: list, known: np.ndarray, when: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, point, score) of the best ``depth`` of these points for each query, ties included.

        Single precision proposes: what is within its error of the last of the best is scored in double precision.
        Points are in the order of dates, those without one last, so a query with a date sees a first part of them.
        """
        order = np.argsort(np.where(known, when, np.iinfo(np.int64).max), kind="stable")
        order = np.concatenate([order[known[order]], order[~known[order]]])
        dates, mine = when[order][: int(known.sum())], _unit(vectors[order])
        sees = np.where(self.dated, np.searchsorted(dates, self.before), len(order))
        place: dict = {}
        for i, j in enumerate(order.tolist()):
            place.setdefault(ids[j], []).append(i)
        rough, theirs = mine.astype(np.float32), self.vectors.astype(np.float32)
        slack = np.float32((mine.shape[1] + 8) * 2.0**-22)  # twice the error of a product of unit vectors, and more
        none, out = np.zeros(0, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        by_part, step = np.argsort(sees, kind="stable"), max(1, min(256, (1 << 23) // max(1, len(order))))
        for at in range(0, len(by_part), step):
            some = by_part[at : at + step]
            most = int(sees[some[-1]])
            for q, row in zip(some.tolist(), theirs[some] @ rough[:most].T if most else [none] * len(some), strict=True):
                row = row[: sees[q]]
                for j in place.get(self.skip[q], ()) if self.skip[q] is not None else ():
                    row[j : j + 1] = -np.inf
                keep = min(int(self.depth[q]), len(row))
                if keep < 1:
                    continue
                found = np.flatnonzero((row >= _at_most(row, keep) - slack) & (row > -np.inf))
                score = np.round(mine[found] @ self.vectors[q], 9)
                if len(found) > keep:
                    found, score = (x[score >= np.partition(score, len(score) - keep)[len(score) - keep]] for x in (found, score))
                out.append((np.full(len(found), q), order[found], score))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _at_most(row: np.ndarray, n: int) -> np.ndarray:
    """A number that at least ``n`` members reach: the n-th largest or, of long rows, that of the largest of groups."""
    groups = len(row) // (8 * n)
    if groups >= 4:
        groups = min(groups, 64)
        row = row[: len(row) // groups * groups].reshape(groups, -1).max(axis=0)
    return np.partition(row, len(row) - n)[len(row) - n]


def _broadcast_search(block: pa.Table, points: DataFrame) -> DataFrame:
    columns = [block.column(c).to_pylist() for c in ("query_id", "depth", "before", "skip")]
    asked = _Asked(columns[0], _matrix(block.column("vector")), *columns[1:]) if block.num_rows else None
    shared = points.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches if asked is not None else ():
            if not batch.num_rows:
                continue
            dates = batch.column("date_ms")
            q, p, s = asked.best(batch.column("id").to_pylist(), np.array(dates.is_valid(), bool), dates.fill_null(0).to_numpy(zero_copy_only=False), _matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked.names[q].tolist(), pa.string()), batch.column("id").take(pa.array(p)), batch.column("chunk_index").take(pa.array(p)), pa.array(s), pa.array(asked.depth[q].astype(np.int32))],
                ["query_id", "id", "chunk_index", "score", "depth"],
            )

    return points.mapInArrow(run, FOUND)


def _joined_search(queries: DataFrame, points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Search of both sides by ``cell``: the blocks of a cell's queries meet the blocks of its points, each two in one task."""
    blocks = lambda df, size, n: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias(n))
    sizes = blocks(queries, block, "q").join(blocks(points, POINTS, "p"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = queries.join(sizes, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q"))).withColumn("pb", every("p"))
    theirs = points.join(sizes, "cell").withColumn("pb", F.pmod(F.xxhash64("id", "chunk_index"), F.col("p"))).withColumn("qb", every("q"))
    keys = ["cell", "qb", "pb"]

    def search(q: pa.Table, p: pa.Table) -> pa.Table:
        names = ["query_id", "id", "chunk_index", "score", "depth"]
        if not q.num_rows or not p.num_rows:
            return pa.table([[], [], [], [], []], pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32()), strict=True))))
        asked = _Asked(q.column("query_id").to_pylist(), _matrix(q.column("vector")), *(q.column(c).to_pylist() for c in ("depth", "before", "skip")))
        dates = overlaps.whole(p.column("date_ms"))
        i, j, s = asked.best(p.column("id").to_pylist(), np.array(dates.is_valid(), bool), dates.fill_null(0).to_numpy(zero_copy_only=False), _matrix(p.column("vector")))
        at = pa.array(j)
        return pa.table([overlaps.whole(q.column("query_id")).take(pa.array(i)), overlaps.whole(p.column("id")).take(at), overlaps.whole(p.column("chunk_index")).take(at), pa.array(s), pa.array(asked.depth[i].astype(np.int32))], names)

    left = mine.select(*keys, "query_id", "vector", F.col("depth").cast("int").alias("depth"), F.col("before").cast("long").alias("before"), F.col("skip").cast("string").alias("skip"))
    # the vector under an alias: queries may have theirs from the points, and a column of both sides would be ambiguous
    right = theirs.select(*keys, "id", "chunk_index", F.col("vector").alias("vector"), F.col("date_ms").cast("long").alias("date_ms"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)


class CellIndex:
    """Cells around centres: a search looks at the points of the ``probes`` cells nearest to a query.

    The centres are fitted on a bounded sample of the points (by a hash of their ids), all points are dealt
    to them. With as many probes as cells the search is exact; with fewer, some neighbours may be missed, and
    ``recall`` measures how many.
    """

    def __init__(self, points: DataFrame, cells: int, *, sample: int = SAMPLE, rounds: int = 10, seed: int = 7):
        self.points, rows = _plain(points), _plain(points)
        share = min(1.0, sample / max(1, rows.count()))
        some = rows.where(F.pmod(F.xxhash64("id", "chunk_index"), F.lit(1_000_000)) < int(share * 1_000_000)).select("id", "chunk_index", "vector").orderBy("id", "chunk_index").limit(sample)
        vectors = _unit(_matrix(some.toArrow().column("vector")))
        r = np.random.default_rng(seed)
        centres = vectors[r.choice(len(vectors), min(cells, len(vectors)), replace=False)] if len(vectors) else np.zeros((0, 1))
        for _ in range(rounds):
            own = (vectors @ centres.T).argmax(axis=1) if len(centres) else np.zeros(0, int)
            centres = _unit(np.stack([vectors[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])) if len(centres) else centres
        self.centres = centres

    def _dealt(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` once for each of the ``probes`` cells nearest to their vector."""
        shared = rows.sparkSession.sparkContext.broadcast(self.centres)
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(shared.value):
                    near = np.argsort(-(_unit(_matrix(batch.column("vector"))) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], [*names, "cell"])

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", cell int")

    def nearest(self, queries: DataFrame, probes: int) -> DataFrame:
        """As ``nearest``, among the points of each query's ``probes`` nearest cells."""
        asked = queries.where("vector IS NOT NULL").select("query_id", "vector", "depth", "before", "skip")
        found = _joined_search(self._dealt(asked, probes), self._dealt(self.points, 1))
        return ranked_first(found, F.col("depth"), F.desc("score"), F.asc("id"), F.asc("chunk_index")).drop("depth")

    def recall(self, queries: DataFrame, probes: int) -> DataFrame:
        """One row: n_queries and the mean share of each query's exact neighbours that ``probes`` cells show."""
        exact, keys = nearest(queries, self.points), ["query_id", "id", "chunk_index"]
        hit = exact.select(*keys).join(self.nearest(queries, probes).select(*keys, F.lit(1).alias("hit")), keys, "left")
        each = hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
        return each.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("share").alias("recall"))


def best_chunk(found: DataFrame) -> DataFrame:
    """query_id, id, score: chunks to decisions, by their best score."""
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def seeds(queries: DataFrame, points: DataFrame, n: int, *, chunks_each: int) -> DataFrame:
    """query_id, id, score, seed_rank: each query's ``n`` nearest decisions; ``chunks_each`` is the most chunks a decision has.

    n decisions have n * chunks_each chunks at most, so that depth can't miss any: the search is exact.
    """
    asked = queries.withColumn("depth", F.lit(n * chunks_each))
    found = best_chunk(nearest(asked, points))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("seed_rank", place).where(F.col("seed_rank") <= n)


def smart_seeds(queries: DataFrame, points: DataFrame, degree: DataFrame, n: int, *, overfetch: int, undated: int = 8) -> DataFrame:
    """Like seeds, but of the nearest chunks those decisions that are cited most; the score stays the cosine.

    Looked at are n * overfetch chunks, for queries without a date n * undated.
    """
    depth = F.when(F.col("before").isNull(), n * undated).otherwise(n * overfetch)
    found = best_chunk(nearest(queries.withColumn("depth", depth), points)).join(degree, "id", "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("in_degree", F.lit(0)).desc(), F.desc("score"), "id"))
    return found.select("query_id", "id", "score", place.alias("seed_rank")).where(F.col("seed_rank") <= n)


def neighbours_of(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """query_id, id, score of the chunks nearest to given decisions' first chunks, the best score for each id.

    ``pairs`` has query_id, node and depth (chunks to fetch). Each distinct node is searched once, as deep
    as its deepest use. A node without a first chunk contributes nothing.
    """
    found = _around(pairs.groupBy("node").agg(F.max("depth").alias("depth")), points)
    return best_chunk(pairs.join(found, "node").where(F.col("rank") <= F.col("depth")))


def _around(asked: DataFrame, points: DataFrame) -> DataFrame:
    """node, id, score, rank: the ``depth`` chunks nearest to the first chunk of each node (node, depth)."""
    first = points.where(F.col("chunk_index") == 0).select(F.col("id").alias("node"), "vector")
    none = F.lit(None)
    queries = asked.join(first, "node").select(
        F.col("node").alias("query_id"), "vector", "depth", none.cast("long").alias("before"), none.cast("string").alias("skip")
    )
    found = nearest(queries, points)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "chunk_index"))
    return found.select(F.col("query_id").alias("node"), "id", "score", place.alias("rank"))


class Expansion:
    """Expansion through vectors; ``dates`` (id, date_ms) may miss ids. Methods return query_id, id, score.

    ``hold`` is applied to the raw set of a hop, which all later stages read.
    """

    def __init__(self, points: DataFrame, dates: DataFrame, hold=lambda df: df):
        self.points, self.dates, self.hold = points, dates, hold

    def _outside(self, rows: DataFrame, seeds_: DataFrame) -> DataFrame:
        return rows.where(F.col("id") != F.col("query_id")).join(seeds_.select("query_id", "id"), ["query_id", "id"], "left_anti")

    def _stages(self, raw: DataFrame, query_dates: DataFrame, cap: int) -> dict[str, DataFrame]:
        raw = self.hold(raw)
        dated = raw.join(self.dates, "id", "left").join(query_dates, "query_id", "left")
        timely = dated.where(undated_or_before(F.col("date_ms"), F.col("query_date"))).select("query_id", "id", "score")
        return {"raw": raw, "post_temporal": timely, "post_cap": ranked_first(timely, cap, F.desc("score"), F.asc("id"))}

    def one_hop(self, seeds_: DataFrame, query_dates: DataFrame, cap: int) -> dict[str, DataFrame]:
        """Each seed fetches three times its share of the cap (ten at least) in chunks."""
        each = F.floor(F.lit(cap) / F.count(F.lit(1)).over(Window.partitionBy("query_id")))
        pairs = seeds_.select("query_id", F.col("id").alias("node"), (3 * F.greatest(F.lit(10), each)).cast("int").alias("depth"))
        return self._stages(self._outside(neighbours_of(pairs, self.points), seeds_), query_dates, cap)

    def two_hop(self, seeds_: DataFrame, first: DataFrame, query_dates: DataFrame, cap: int, frontier: int) -> dict[str, DataFrame]:
        """From the first ``frontier`` ids of the first hop, whose own members count with a score of 1."""
        front = ranked_first(first.select("query_id", "id"), frontier, F.asc("id"))
        each = F.floor(F.lit(cap) / F.count(F.lit(1)).over(Window.partitionBy("query_id")))
        pairs = front.select("query_id", F.col("id").alias("node"), (3 * F.greatest(F.lit(10), each)).cast("int").alias("depth"))
        found = self._outside(neighbours_of(pairs, self.points), seeds_)
        merged = found.unionByName(first.select("query_id", "id", F.lit(1.0).alias("score")))
        return self._stages(best_chunk(merged), query_dates, cap)

    def two_hop_whole(self, seeds_: DataFrame, first: DataFrame, query_dates: DataFrame, share: int, *, block: int = FRONTS) -> DataFrame:
        """What ``two_hop`` has after dates where neither a frontier nor a cap leaves out any of ``first``, which is timely itself.

        A node fetches three times its part of ``share`` (ten at least) in chunks. Queries go in blocks, each with
        the lists of the nodes that it starts from, so that what is found isn't shuffled for every query anew.
        """
        lists = lambda df, name: df.groupBy("query_id").agg(F.collect_list("id").alias(name))
        asked = lists(first, "nodes").join(lists(seeds_, "seeds"), "query_id", "left").join(query_dates, "query_id", "left")
        each = F.greatest(F.lit(10), F.floor(F.lit(share) / F.size("nodes")))
        asked = self.hold(asked.select("query_id", F.col("query_date").cast("long").alias("query_date"), "nodes", "seeds", (3 * each).cast("int").alias("depth")))
        blocks = max(1, -(-asked.count() // block))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        uses = self.hold(asked.select("qb", "depth", F.explode("nodes").alias("node")).groupBy("qb", "node").agg(F.max("depth").alias("depth")))
        found = _around(uses.groupBy("node").agg(F.max("depth").alias("depth")), self.points).join(self.dates, "id", "left")
        found = found.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", F.col("date_ms").cast("long").alias("date_ms")))).alias("near"))
        near = uses.select(F.col("qb").alias("qb"), "node").join(found.select("node", F.col("near.id").alias("ids"), F.col("near.score").alias("scores"), F.col("near.date_ms").alias("dates")), "node")
        schema = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])

        def run(one: pa.Table, two: pa.Table) -> pa.Table:
            (ids, begin), (nodes, n), (own, s) = overlaps.flat(two.column("ids")), overlaps.flat(one.column("nodes")), overlaps.flat(one.column("seeds"))
            scores, dates = (overlaps.flat(two.column(c))[0] for c in ("scores", "dates"))
            scores, known, when = scores.to_numpy(zero_copy_only=False), np.array(dates.is_valid(), bool), dates.fill_null(0).to_numpy(zero_copy_only=False)
            coded = pa.concat_arrays([ids, nodes, own, overlaps.whole(one.column("query_id"))]).dictionary_encode()
            ids, nodes_, own, self_ = np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum([len(ids), len(nodes), len(own)]))
            place = pc.fill_null(pc.index_in(nodes, value_set=overlaps.whole(two.column("node"))), -1).to_numpy(zero_copy_only=False)
            length, best, out = np.diff(begin), np.full(len(coded.dictionary), -np.inf), []
            for i, (date, depth) in enumerate(zip(one.column("query_date").to_pylist(), one.column("depth").to_pylist(), strict=True)):
                mine = place[n[i] : n[i + 1]]
                mine = mine[mine >= 0]
                at = overlaps.places(begin[mine], np.minimum(length[mine], depth))
                at = at if date is None else at[~known[at] | (when[at] < date)]
                hop = nodes_[n[i] : n[i + 1]]
                np.maximum.at(best, ids[at], scores[at])
                best[self_[i]] = best[own[s[i] : s[i + 1]]] = -np.inf
                best[hop] = np.maximum(best[hop], 1.0)
                met = np.unique(np.concatenate([ids[at], hop]))
                met = met[best[met] > -np.inf]
                out.append((np.full(len(met), i), met, best[met]))
                best[met] = -np.inf
            if not out:
                return schema.empty_table()
            q, met, score = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.Table.from_arrays([overlaps.whole(one.column("query_id")).take(pa.array(q)), coded.dictionary.take(pa.array(met)), pa.array(score)], schema=schema)

        return asked.groupBy("qb").cogroup(near.groupBy("qb")).applyInArrow(run, "query_id string, id string, score double")


class Overlap:
    """Stand-in for a pair model: shared share of distinct lower-cased words of two texts.

    A pair model has ``prepare`` (a text to what is kept of it, once a text) and ``score`` (two of those to
    a number, once a pair). It may have ``meet``, whose result ``score`` takes as a third argument: a column
    that a score names several times is worked out each time, one that is handed over isn't. Here a text
    becomes the 64-bit hashes of its distinct words.
    """

    def prepare(self, text: Column) -> Column:
        words = F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))
        return F.transform(words, lambda w: F.xxhash64(w))

    def meet(self, a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a, b))

    def score(self, a: Column, b: Column, met: Column | None = None) -> Column:
        both = self.meet(a, b) if met is None else met
        all_ = F.size(a) + F.size(b) - both
        return F.when(all_ > 0, both / all_).otherwise(0.0)


class SetOverlap(Overlap):
    """The same scores, from the sizes of what is kept of two texts and of what they share: so texts meet in blocks."""

    def sized(self, a: Column, b: Column, met: Column) -> Column:
        all_ = a + b - met
        return F.when(all_ > 0, met / all_).otherwise(0.0)
