"""Citation graph: build, degrees, bounded traversal, distances and subgraphs over ``edges`` (src, dst, type).

Traversals are unrolled joins over a relation of (query, node) pairs, all queries at once. The cap after
each expansion bounds what the next join reads; ties are broken by id, so results don't depend on order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_list, parse_list
from . import overlaps

CASE, LAW = "case_to_case", "case_to_law"


def citations(rows: DataFrame) -> DataFrame:
    """src, dst, type, ord of every citation as it stands in the source rows (decision_id, cited_rulings, laws, pos).

    ``pos`` gives the rows' order, which decides which type and role are first and last.
    """
    def one(column: str, kind: str, rank: int) -> DataFrame:
        return rows.select(
            F.col("decision_id").alias("src"), F.lit(kind).alias("type"), F.col("pos"), F.posexplode(parse_list(F.col(column))).alias("i", "dst")
        ).select("src", "dst", "type", F.struct("pos", F.lit(rank).alias("part"), "i").alias("ord"))

    return one("cited_rulings", CASE, 0).unionByName(one("laws", LAW, 1))


def usable(cited: DataFrame) -> DataFrame:
    return cited.where((F.col("dst") != F.col("src")) & (F.col("dst") != ""))


def edges(cited: DataFrame) -> DataFrame:
    """src, dst, type: one edge a pair, of the type written last."""
    return usable(cited).groupBy("src", "dst").agg(F.max_by("type", "ord").alias("type"))


def nodes(rows: DataFrame, cited: DataFrame) -> DataFrame:
    """id, source: ids of source rows are rulings; others have the role in which they were first cited."""
    role = F.when(F.col("type") == CASE, "ruling").otherwise("law")
    named = usable(cited).groupBy(F.col("dst").alias("id")).agg(F.min_by(role, "ord").alias("source"))
    own = rows.select(F.col("decision_id").alias("id"), F.lit("ruling").alias("own")).distinct()
    return named.join(own, "id", "full").select("id", F.coalesce("own", "source").alias("source"))


def build_counts(rows: DataFrame, cited: DataFrame) -> DataFrame:
    """rows, case and law citations that count (before repeated pairs are merged), those skipped, and list fields that are none."""
    ok = F.coalesce((F.col("dst") != F.col("src")) & (F.col("dst") != ""), F.lit(False))
    odd = lambda c: F.count_if((F.coalesce(c, F.lit("")) != "") & ~is_list(F.col(c)))
    return cited.agg(
        F.count_if(ok & (F.col("type") == CASE)).alias("case_edges"),
        F.count_if(ok & (F.col("type") == LAW)).alias("law_edges"),
        F.count_if(~ok).alias("skipped"),
    ).crossJoin(rows.agg(F.count(F.lit(1)).alias("rows"), (odd("cited_rulings") + odd("laws")).alias("rejected")))


def source_counts(nodes_: DataFrame) -> DataFrame:
    """source, n: nodes of each role."""
    return nodes_.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def in_degree(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degree(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def stats(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, mean_in_degree, mean_out_degree (both edges over nodes)."""
    mean = F.when(F.col("n_nodes") > 0, F.col("n_edges") / F.col("n_nodes")).otherwise(0.0)
    both = nodes_.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges_.agg(F.count(F.lit(1)).alias("n_edges")))
    return both.select("n_nodes", "n_edges", mean.alias("mean_in_degree"), mean.alias("mean_out_degree"))


def both_ways(edges_: DataFrame) -> DataFrame:
    """a, b: every edge in both directions, once."""
    there = edges_.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return there.unionByName(edges_.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def successors(edges_: DataFrame, kind: str) -> DataFrame:
    return edges_.where(F.col("type") == kind).select("src", "dst")


def undated_or_before(date: Column, query_date: Column) -> Column:
    """Expansion's rule: unknown dates stay, and nothing is dropped for a query without a date."""
    return query_date.isNull() | date.isNull() | (date < query_date)


def ranked_first(rows: DataFrame, n: int | Column, *order: Column, by=("query_id",)) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must end in something unique."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


#: Queries whose second hops are worked out in one task.
FRONTS = 1024


class Expansion:
    """Graph expansion of seeds (query_id, id, query_date) over one graph.

    ``around`` is both_ways of the edges to rulings; ``dates`` (id, date_ms) and ``degree`` (id, in_degree)
    may miss ids. Each method returns query_id, id. ``hold`` is applied to what a second hop starts from and
    to its raw set, which all later stages read.
    """

    def __init__(self, edges_: DataFrame, nodes_: DataFrame, dates: DataFrame, degree: DataFrame, hold=lambda df: df):
        self.hold = hold
        rulings = nodes_.where(F.col("source") == "ruling").select(F.col("id").alias("b"))
        self.around, self.dates, self.degree = both_ways(edges_).join(rulings, "b", "left_semi"), dates, degree

    def neighbours(self, of: DataFrame) -> DataFrame:
        return of.select("query_id", F.col("id").alias("a")).join(self.around, "a").select("query_id", F.col("b").alias("id"))

    def timely(self, rows: DataFrame, query_dates: DataFrame) -> DataFrame:
        dated = rows.join(self.dates, "id", "left").join(query_dates, "query_id", "left")
        return dated.where(undated_or_before(F.col("date_ms"), F.col("query_date"))).select("query_id", "id")

    def capped(self, rows: DataFrame, cap: int) -> DataFrame:
        scored = rows.join(self.degree, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
        return ranked_first(scored, cap, F.desc("in_degree"), F.asc("id")).select("query_id", "id")

    def one_hop(self, seeds: DataFrame, query_dates: DataFrame, cap: int) -> dict[str, DataFrame]:
        raw = self.neighbours(seeds).distinct().join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
        timely = self.timely(raw, query_dates)
        return {"raw": raw, "post_temporal": timely, "post_cap": self.capped(timely, cap)}

    def two_hop(self, seeds: DataFrame, query_dates: DataFrame, cap: int) -> dict[str, DataFrame]:
        """The first hop is filtered by date and capped at twice ``cap`` before the second starts from it."""
        first = self.hold(self.one_hop(seeds, query_dates, 2 * cap)["post_cap"])
        raw = self.hold(first.unionByName(self.neighbours(first)).distinct().join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti"))
        timely = self.timely(raw, query_dates)
        return {"raw": raw, "post_temporal": timely, "post_cap": self.capped(timely, cap)}

    def two_hop_capped(self, seeds: DataFrame, query_dates: DataFrame, cap: int, *, block: int = FRONTS) -> DataFrame:
        """``post_cap`` of ``two_hop`` without its other stages: what the second hop reaches isn't shuffled for every query.

        Queries go in blocks, each with the lists of neighbours of the ids that it starts from.
        """
        lists = lambda df, name: df.groupBy("query_id").agg(F.collect_list("id").alias(name))
        first = self.one_hop(seeds, query_dates, 2 * cap)["post_cap"]
        asked = lists(first, "nodes").join(lists(seeds, "seeds"), "query_id", "left").join(query_dates, "query_id", "left")
        asked = self.hold(asked.select("query_id", F.col("query_date").cast("long").alias("query_date"), "nodes", "seeds"))
        blocks = max(1, -(-asked.count() // block))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        uses = self.hold(asked.select("qb", F.explode("nodes").alias("a")).distinct())
        degree = self.degree.select("id", F.col("in_degree").cast("long").alias("n"))
        reached = self.around.join(uses.select("a").distinct(), "a", "left_semi").select("a", F.col("b").alias("id"))
        reached = reached.join(self.dates, "id", "left").join(degree, "id", "left")
        reached = reached.groupBy("a").agg(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0)).alias("n"), F.col("date_ms").cast("long").alias("date_ms"))).alias("near"))
        near = uses.select(F.col("qb").alias("qb"), F.col("a").alias("a")).join(reached, "a", "left").join(degree.select(F.col("id").alias("a"), "n"), "a", "left")
        near = near.select("qb", F.col("a").alias("node"), F.coalesce("n", F.lit(0)).alias("n"), F.col("near.id").alias("ids"), F.col("near.n").alias("ns"), F.col("near.date_ms").alias("dates"))
        schema = pa.schema([("query_id", pa.string()), ("id", pa.string())])

        def run(one: pa.Table, two: pa.Table) -> pa.Table:
            (ids, begin), (nodes, n), (own, s) = overlaps.flat(two.column("ids")), overlaps.flat(one.column("nodes")), overlaps.flat(one.column("seeds"))
            counts, dates = (overlaps.flat(two.column(c))[0] for c in ("ns", "dates"))
            known, when = np.array(dates.is_valid(), bool), dates.fill_null(0).to_numpy(zero_copy_only=False)
            coded = pa.concat_arrays([ids, nodes, own]).dictionary_encode()
            ids, nodes_, own = np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum([len(ids), len(nodes)]))
            place = pc.index_in(nodes, value_set=overlaps.whole(two.column("node"))).to_numpy(zero_copy_only=False).astype(np.int64)
            degree = np.zeros(len(coded.dictionary), np.int64)
            degree[ids], degree[nodes_] = counts.to_numpy(zero_copy_only=False), two.column("n").to_numpy()[place]
            by_name = np.argsort(pc.array_sort_indices(coded.dictionary).to_numpy())  # of bytes, as the engine orders strings
            order = np.empty(len(degree), np.int64)
            order[np.lexsort((by_name, -degree))] = np.arange(len(degree))
            length, gone, out = np.diff(begin), np.zeros(len(degree), bool), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, date in enumerate(one.column("query_date").to_pylist()):
                mine, seeds_ = place[n[i] : n[i + 1]], own[s[i] : s[i + 1]]
                at = overlaps.places(begin[mine], length[mine])
                at = at if date is None else at[~known[at] | (when[at] < date)]
                gone[seeds_] = True
                met = np.unique(np.concatenate([ids[at], nodes_[n[i] : n[i + 1]]]))
                met = met[~gone[met]]
                gone[seeds_] = False
                met = met[np.argsort(order[met])[:cap]]
                out.append((np.full(len(met), i), met))
            q, met = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.Table.from_arrays([overlaps.whole(one.column("query_id")).take(pa.array(q)), coded.dictionary.take(pa.array(met))], schema=schema)

        return asked.groupBy("qb").cogroup(near.groupBy("qb")).applyInArrow(run, "query_id string, id string")


#: Rows of pairs times the lesser degree that are shuffled at once.
MIDDLE = 8_000_000


def distances_between(edges_: DataFrame, pairs: DataFrame, *, directed: bool = True, hold=None, middle_rows: int = MIDDLE) -> DataFrame:
    """target, id, d: hops (0, 1 or 2) from ``id`` to ``target`` for the given pairs only; farther ones are absent.

    Pairs that one hop settles don't take the second. The others meet in the middle, and each starts from
    the end that has fewer neighbours: rows are those of the pairs times the lesser degree, so a much cited
    target, or an id that cites very much, isn't expanded but where both ends are such. With ``hold`` these
    rows are counted first, and pairs go in as many parts as make about ``middle_rows`` each, held one by one.
    """
    step = edges_.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct() if directed else both_ways(edges_)
    back = step.select(F.col("b").alias("a"), F.col("a").alias("b"))
    asked = pairs.select("id", "target").distinct()
    own = asked.where("id = target").select("target", "id", F.lit(0).alias("d"))
    other = asked.where("id <> target").join(step.select(F.col("a").alias("id"), F.col("b").alias("target"), F.lit(1).alias("d")), ["id", "target"], "left")
    count = lambda df, end, n: df.groupBy(F.col("a").alias(end)).agg(F.count(F.lit(1)).alias(n))
    far = other.where("d IS NULL").select("id", "target").join(count(step, "id", "ahead"), "id").join(count(back, "target", "behind"), "target")
    near = own.unionByName(other.where("d = 1").select("target", "id", "d"))
    if hold is None:
        return near.unionByName(_two_apart(far, step, back))
    near, far = hold(near), hold(far)
    parts = -(-(far.agg(F.sum(F.least("ahead", "behind"))).first()[0] or 0) // middle_rows)
    for i in range(parts):
        near = near.unionByName(hold(_two_apart(far.where(F.pmod(F.xxhash64("id", "target"), F.lit(parts)) == i), step, back)))
    return near


def _two_apart(far: DataFrame, step: DataFrame, back: DataFrame) -> DataFrame:
    """target, id, d of those pairs (id, target, ahead, behind) that two steps join."""
    near = None
    for from_, to, way, rule in (("id", "target", step, "ahead <= behind"), ("target", "id", back, "ahead > behind")):
        middle = far.where(rule).select(F.col(from_).alias("a"), F.col(to).alias("end")).join(way, "a").select(F.col("a").alias("start"), "end", F.col("b").alias("m"))
        two = middle.join(way.select(F.col("a").alias("m"), F.col("b").alias("end")), ["m", "end"], "left_semi").select("start", "end").distinct()
        one = two.select(F.col("end" if from_ == "id" else "start").alias("target"), F.col("start" if from_ == "id" else "end").alias("id"), F.lit(2).alias("d"))
        near = one if near is None else near.unionByName(one)
    return near


#: Neighbours of an end of a pair up to which pairs are answered by sets.
SET = 1024


def distances_by_sets(edges_: DataFrame, pairs: DataFrame, hold, *, directed: bool = True, most: int = SET) -> DataFrame:
    """The rows of ``distances_between``, for pairs without repeats; quicker where few ids have very many neighbours.

    The neighbours of both ends are laid side by side as sets, in blocks of ids and of targets. Pairs with an
    end of over ``most`` neighbours go through ``distances_between``, so that no set is large.
    """
    step = hold(edges_.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct() if directed else both_ways(edges_))
    sets = lambda end, other: hold(step.groupBy(F.col(end).alias("end")).agg(F.collect_set(other).alias("set")))
    small = lambda df: df.where(F.size("set") <= most)
    ahead = sets("a", "b")
    behind = sets("b", "a") if directed else ahead
    own = pairs.where("id = target").select("target", "id", F.lit(0).alias("d"))
    one = pairs.join(step.select(F.col("a").alias("id"), F.col("b").alias("target")), ["id", "target"]).select("target", "id", F.lit(1).alias("d"))
    met = overlaps.shared(
        pairs.select(F.col("id").alias("l"), F.col("target").alias("r")),
        small(ahead).select(F.col("end").alias("l"), F.col("set").alias("a")), small(behind).select(F.col("end").alias("r"), F.col("set").alias("b")),
    )
    near = own.unionByName(one).unionByName(met.where("met > 0").select(F.col("r").alias("target"), F.col("l").alias("id"), F.lit(2).alias("d")))
    large = [df.where(F.size("set") > most).select(F.col("end").alias(name)) for df, name in ((ahead, "id"), (behind, "target"))]
    if any(not df.isEmpty() for df in large):
        rest = pairs.join(large[0], "id", "left_semi").unionByName(pairs.join(large[1], "target", "left_semi"))
        near = near.unionByName(distances_between(edges_, hold(rest.distinct()), directed=directed, hold=hold))
    return hold(near.groupBy("target", "id").agg(F.min("d").alias("d")))


def induced(edges_: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends in ``ids`` (id)."""
    own = ids.select("id").distinct()
    return edges_.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")


def _total_degree(edges_: DataFrame) -> DataFrame:
    ends = edges_.select(F.col("src").alias("id")).unionAll(edges_.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_cited(edges_: DataFrame, top_n: int = 30, citers: int = 5, max_nodes: int = 250) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, place; edges: src, dst, type) around the most cited nodes.

    Seeds come first, then seed by seed their citers with the largest degree, up to ``max_nodes`` distinct
    nodes in that order; edges from citers that were reached, and those among seeds.
    """
    top_n, citers = max(1, min(top_n, 100)), max(0, min(citers, 20))
    seeds = in_degree(edges_).orderBy(F.desc("in_degree"), "id").limit(top_n)
    seeds = seeds.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("in_degree"), "id")))  # top_n rows
    cited = edges_.join(seeds.select(F.col("id").alias("dst"), "rank"), "dst")
    cited = cited.join(_total_degree(edges_).select(F.col("id").alias("src"), "degree"), "src")
    cited = cited.withColumn("nth", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("degree"), "src"))).where(F.col("nth") <= citers)
    named = seeds.select("id", F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"), F.lit(0).alias("c")).alias("at"))
    named = named.unionByName(cited.select(F.col("src").alias("id"), F.struct(F.lit(1).alias("a"), F.col("rank").alias("b"), F.col("nth").alias("c")).alias("at")))
    placed = named.groupBy("id").agg(F.min("at").alias("at"))  # top_n * (citers + 1) rows at most
    placed = placed.withColumn("place", F.row_number().over(Window.orderBy("at"))).where(F.col("place") <= max_nodes).select("id", "place")
    among = induced(edges_, seeds)
    shown = induced(cited.select("src", "dst", "type").unionByName(among.select("src", "dst", "type")).distinct(), placed)
    return placed, shown


def around_node(edges_: DataFrame, node: str, max_nodes: int = 250) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, place; edges) of a node: itself, those that cite it, those it cites, up to ``max_nodes``."""
    own = edges_.where((F.col("src") == node) | (F.col("dst") == node))
    other = F.when(F.col("dst") == node, F.col("src")).otherwise(F.col("dst"))
    named = own.select(other.alias("id"), F.when(F.col("dst") == node, 1).otherwise(2).alias("part")).groupBy("id").agg(F.min("part").alias("part"))
    near = named.orderBy("part", "id").limit(max_nodes - 1)  # so the numbering below sees max_nodes rows
    placed = near.select("id", (F.row_number().over(Window.orderBy("part", "id")) + 1).alias("place"))
    first = edges_.sparkSession.range(1).select(F.lit(node).alias("id"), F.lit(1).alias("place"))
    placed = first.unionByName(placed)
    return placed, own.join(placed.select(F.col("id").alias("src")), "src", "left_semi").join(placed.select(F.col("id").alias("dst")), "dst", "left_semi")
