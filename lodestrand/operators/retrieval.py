"""Candidate pools of the retrieval systems, their layers, rankings and cut-offs.

One candidate relation holds all systems: (system, query_id, id, score, is_seed, seed_rank). Rankings are
window orders over it and end in the id, which makes Python-style stable sorts explicit.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import keep
from . import graph, overlaps, vectors

#: Systems in their order of display, and the rankings.
SYSTEMS = ("rag", "rag_smart", "emb_1hop", "emb_2hop", "graph_1hop", "graph_2hop")
DEFAULT_SYSTEMS = tuple(s for s in SYSTEMS if s != "rag_smart")
RANKINGS = ("cosine", "indegree", "cross_encoder")
STAGES = ("seeds", "raw", "post_temporal", "post_cap")
#: Pairs of two ids that are shuffled at once to be scored; texts aren't shuffled with them, and all pairs are scored.
PAIRS = 4_000_000
#: Score of a candidate that the pair model hasn't seen; it sorts behind all others.
UNSCORED = -1e9


@dataclass(frozen=True)
class Settings:
    seeds: int = 60
    ks: tuple[int, ...] = (5, 10, 15, 20)
    cap_1hop: int = 400
    cap_2hop: int = 800
    frontier: int = 40
    overfetch: int = 24
    overfetch_undated: int = 8
    chunks_each: int = 64
    systems: tuple[str, ...] = DEFAULT_SYSTEMS

    def __post_init__(self):
        if unknown := set(self.systems) - set(SYSTEMS):
            raise ValueError(f"no such system: {sorted(unknown)}")
        if not self.ks or min(self.ks) < 1:
            raise ValueError("cut-offs are positive")

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


@dataclass(frozen=True)
class Corpus:
    """points(id, chunk_index, vector, date_ms), edges, nodes, dates(id, date_ms), degree(id, in_degree), texts(id, text)."""

    points: DataFrame
    edges: DataFrame
    nodes: DataFrame
    dates: DataFrame
    degree: DataFrame
    texts: DataFrame


def asked(queries: DataFrame, *, exclude_self: bool = True, use_dates: bool = True) -> DataFrame:
    """The search's view of queries (query_id, vector, date_ms): a custom query has neither rule."""
    return queries.select(
        "query_id", "vector",
        (F.col("date_ms") if use_dates else F.lit(None).cast("long")).alias("before"),
        (F.col("query_id") if exclude_self else F.lit(None).cast("string")).alias("skip"),
    )


class Retrieval:
    """Seeds, expansions and pools for a set of queries (query_id, vector, date_ms), worked out once each."""

    def __init__(self, corpus: Corpus, queries: DataFrame, settings: Settings, *, exclude_self: bool = True, use_dates: bool = True):
        self.corpus, self.settings = corpus, settings
        self.asked = asked(queries, exclude_self=exclude_self, use_dates=use_dates)
        self.dates = self.asked.select("query_id", F.col("before").alias("query_date"))
        self._made: dict[str, object] = {}

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def seeds(self) -> DataFrame:
        c, s = self.corpus, self.settings
        return self._once("seeds", lambda: keep(vectors.seeds(self.asked, c.points, s.seeds, chunks_each=s.chunks_each)))

    @property
    def smart(self) -> DataFrame:
        c, s = self.corpus, self.settings
        return self._once("smart", lambda: keep(vectors.smart_seeds(self.asked, c.points, c.degree, s.seeds, overfetch=s.overfetch, undated=s.overfetch_undated)))

    def _lazy_stages(self, system: str) -> dict[str, DataFrame]:
        c, s = self.corpus, self.settings

        def make():
            if system.startswith("graph"):
                e = self._graph
                return (e.one_hop if system == "graph_1hop" else e.two_hop)(self.seeds, self.dates, s.cap_1hop if system == "graph_1hop" else s.cap_2hop)
            e = self._emb
            if system == "emb_1hop":
                return e.one_hop(self.seeds, self.dates, s.cap_1hop)
            return e.two_hop(self.seeds, self.stages("emb_1hop")["post_cap"], self.dates, s.cap_2hop, s.frontier)

        return self._once(f"lazy stages {system}", make)

    @property
    def _graph(self) -> graph.Expansion:
        c = self.corpus
        return self._once("graph", lambda: graph.Expansion(c.edges, c.nodes, c.dates, c.degree, keep))

    @property
    def _emb(self) -> vectors.Expansion:
        return self._once("emb", lambda: vectors.Expansion(self.corpus.points, self.corpus.dates, keep))

    def stages(self, system: str) -> dict[str, DataFrame]:
        """raw, post_temporal, post_cap of an expanding system, each (query_id, id); the last is kept, as pools and second hops read it."""

        def capped():
            made = self._lazy_stages(system)
            return made | {"post_cap": keep(made["post_cap"])}

        return self._once(f"stages {system}", capped)

    def emb_2hop_whole(self) -> DataFrame:
        """query_id, id, score: emb_2hop after dates, from all timely members of the first hop, without the caps that pools have."""
        first = lambda: keep(self._lazy_stages("emb_1hop")["post_temporal"])
        return self._once("emb_2hop whole", lambda: self._emb.two_hop_whole(self.seeds, first(), self.dates, self.settings.cap_2hop))

    def capped(self, system: str) -> DataFrame:
        """query_id, id of a system's last stage; of graph_2hop the others aren't made for it."""
        if system != "graph_2hop" or "stages graph_2hop" in self._made:
            return self.stages(system)["post_cap"]
        return self._once("graph_2hop capped", lambda: keep(self._graph.two_hop_capped(self.seeds, self.dates, self.settings.cap_2hop)))

    def own_seeds(self, system: str) -> DataFrame:
        return self.smart if system == "rag_smart" else self.seeds

    def pool(self, system: str) -> DataFrame:
        """query_id, id, score, is_seed, seed_rank: seeds with their cosine, the expansion with 0."""
        seeds = self.own_seeds(system).select("query_id", "id", "score", F.lit(True).alias("is_seed"), "seed_rank")
        if system in ("rag", "rag_smart"):
            return seeds
        grown = self.capped(system).select("query_id", "id", F.lit(0.0).alias("score"), F.lit(False).alias("is_seed"), F.lit(None).cast("int").alias("seed_rank"))
        return seeds.unionByName(grown)

    def pools_of(self, systems) -> DataFrame:
        """system, query_id, id, score, is_seed, seed_rank of some systems; of others nothing is made."""
        out = None
        for system in systems:
            one = self.pool(system).select(F.lit(system).alias("system"), "query_id", "id", "score", "is_seed", "seed_rank")
            out = one if out is None else out.unionByName(one)
        return out

    def pools(self) -> DataFrame:
        return self._once("pools", lambda: keep(self.pools_of(self.settings.systems)))

    def layers(self, truth: DataFrame) -> DataFrame:
        """system, query_id, stage, stage_order, pool_size, hits: seeds joined with each stage's set.

        ``truth`` is (query_id, id); queries without truth have no layers.
        """
        out = None
        for system in self.settings.systems:
            seeds = self.own_seeds(system).select("query_id", "id")
            sets = {"seeds": seeds}
            if system not in ("rag", "rag_smart"):
                sets |= {name: rows.select("query_id", "id").unionByName(seeds).distinct() for name, rows in self.stages(system).items()}
            for order, (name, rows) in enumerate(sets.items()):
                one = rows.select(F.lit(system).alias("system"), "query_id", F.lit(name).alias("stage"), F.lit(order).alias("stage_order"), "id")
                out = one if out is None else out.unionByName(one)
        known = truth.select("query_id").distinct()
        marked = out.join(truth.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
        counted = marked.groupBy("system", "query_id", "stage", "stage_order").agg(F.count(F.lit(1)).alias("pool_size"), F.count("hit").alias("hits"))
        return counted.join(known, "query_id", "left_semi")


def union_of_pools(pools: DataFrame) -> DataFrame:
    """query_id, id: each candidate once, whatever systems have it; what a pair model scores."""
    return pools.select("query_id", "id").distinct()


def first_of_union(pools: DataFrame) -> DataFrame:
    """query_id, id, score, system: each candidate with the score of the first system that has it."""
    order = F.array_position(F.array(*map(F.lit, SYSTEMS)), F.col("system"))
    return pools.groupBy("query_id", "id").agg(F.min_by("score", order).alias("score"), F.min_by("system", order).alias("system"))


def pair_scores(pools: DataFrame, query_texts: DataFrame, texts: DataFrame, model=None, limit: int = 4000, at_once: int = PAIRS) -> DataFrame:
    """query_id, id, pair_score of the union of pools, for candidates whose text isn't blank.

    ``model`` prepares each text, cut to ``limit`` characters, once and scores pairs of prepared texts. Pairs
    go by query in as many parts as make about ``at_once`` pairs and ``vectors.BLOCK`` queries each, whose scores are kept one
    after the other: a part's queries are broadcast, so that no text is shuffled with a pair. Of a model with
    ``sized``, whose scores need only the sizes of two sets and of what they share, sets meet in blocks of both.
    """
    model = model or vectors.SetOverlap()
    there = texts.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("id", model.prepare(F.substring("text", 1, limit)).alias("b"))
    asked = query_texts.select("query_id", model.prepare(F.substring("query_text", 1, limit)).alias("a"))
    pairs, there, asked, out = keep(union_of_pools(pools)), keep(there), keep(asked), None
    a, b, in_blocks = F.col("a"), F.col("b"), hasattr(model, "sized")
    parts = max(1, -(-pairs.count() // at_once), 0 if in_blocks else -(-asked.count() // vectors.BLOCK))
    for i in range(parts):
        mine = lambda df: df.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)  # noqa: B023, E731
        if in_blocks:
            whole = lambda c: F.coalesce(c, F.array().cast("array<long>"))
            met = overlaps.shared(
                mine(pairs).select(F.col("query_id").alias("l"), F.col("id").alias("r")),
                mine(asked).select(F.col("query_id").alias("l"), whole(a).alias("a")), there.select(F.col("id").alias("r"), whole(b).alias("b")),
            )
            one = keep(met.select(F.col("l").alias("query_id"), F.col("r").alias("id"), model.sized(F.col("n_l"), F.col("n_r"), F.col("met")).alias("pair_score")))
            out = one if out is None else out.unionByName(one)
            continue
        both = mine(pairs).hint("merge").join(there, "id").join(F.broadcast(mine(asked)), "query_id")
        if hasattr(model, "meet"):
            met = both.select("query_id", "id", "a", "b", model.meet(a, b).alias("met"))
            scored = met.select("query_id", "id", model.score(a, b, F.col("met")).alias("pair_score"))
        else:
            scored = both.select("query_id", "id", model.score(a, b).alias("pair_score"))
        one = keep(scored)
        out = one if out is None else out.unionByName(one)
    return out


def pair_scores_by_call(pools: DataFrame, query_texts: DataFrame, texts: DataFrame, call, *, size: int = 32, attempts: int = 3, limit: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, pair_score; query_id of the queries that failed) from a model that scores lists of pairs.

    ``call`` takes a list of (query text, text) and gives as many numbers; every task is a replica and has its
    pairs scored ``size`` at a time. Where a batch is refused ``attempts`` times, its queries have failed.
    """
    there = texts.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("id", F.substring("text", 1, limit).alias("b"))
    asked = query_texts.select("query_id", F.substring(F.coalesce("query_text", F.lit("")), 1, limit).alias("a"))
    pairs = union_of_pools(pools).join(there, "id").join(asked, "query_id").select("query_id", "id", "a", "b")

    def scored(rows: list[tuple]) -> list:
        for _ in range(attempts):
            try:
                got = [float(x) for x in call(rows)]
                if len(got) == len(rows):
                    return got
            except Exception:  # whatever the service says, it is asked again
                continue
        return [None] * len(rows)

    def run(batches):
        for batch in batches:
            rows, out = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)), []
            for at in range(0, len(rows), size):
                out += scored(rows[at : at + size])
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(out, pa.float64())], ["query_id", "id", "pair_score"])

    done = keep(pairs.mapInArrow(run, "query_id string, id string, pair_score double"))
    failed = done.where("pair_score IS NULL").select("query_id").distinct()
    return done.join(failed, "query_id", "left_anti"), failed


def rank(pools: DataFrame, ranking: str, degree: DataFrame, scores: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """system, ranking, query_id, id, value, rank for one ranking, over whole pools.

    ``failed`` (query_id) are queries whose pair scores could not be had: they have no cross_encoder rows.
    """
    if ranking not in RANKINGS:
        raise ValueError(f"no such ranking: {ranking}")
    rows = pools
    if ranking == "cosine":
        value = F.col("score")
    elif ranking == "indegree":
        rows = rows.join(degree, "id", "left")
        value = F.log1p(F.coalesce("in_degree", F.lit(0)).cast("double"))
    else:
        if scores is None:
            return rows.limit(0).select("system", F.lit(ranking).alias("ranking"), "query_id", "id", F.lit(0.0).alias("value"), F.lit(0).alias("rank"))
        rows = rows.join(scores, ["query_id", "id"], "left")
        rows = rows.join(failed, "query_id", "left_anti") if failed is not None else rows
        value = F.coalesce("pair_score", F.lit(UNSCORED))
    valued = rows.withColumn("value", F.round(value, 9))
    order = (F.desc("value"), F.desc("is_seed"), F.asc_nulls_last("seed_rank"), F.asc("id"))
    place = F.row_number().over(Window.partitionBy("system", "query_id").orderBy(*order))
    return valued.select("system", F.lit(ranking).alias("ranking"), "query_id", "id", "value", place.alias("rank"))


def cut_off(ranked: DataFrame, ks) -> DataFrame:
    """A row for each k whose list the candidate is in; a smaller k's list is a prefix of a larger one's."""
    k = F.explode(F.filter(F.array(*map(F.lit, sorted(set(ks)))), lambda x: F.col("rank") <= x))
    return ranked.where(F.col("rank") <= max(ks)).select("*", k.alias("k"))


def derive_smaller(results: DataFrame, ks) -> DataFrame:
    """Results for missing smaller cut-offs, from the largest there is; it can't be extended."""
    most = results.groupBy("system", "ranking").agg(F.max("k").alias("k"))
    longest = results.join(most, ["system", "ranking", "k"]).drop("k")
    have = results.select("system", "ranking", "k").distinct()
    wanted = cut_off(longest, ks).join(most.select("system", "ranking", F.col("k").alias("most")), ["system", "ranking"])
    missing = wanted.where(F.col("k") < F.col("most")).drop("most").join(have, ["system", "ranking", "k"], "left_anti")
    return results.unionByName(missing.select(*results.columns))
