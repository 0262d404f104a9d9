"""The supplied tables as the engine's relations, with the parameters that suit their size.

Corpus: documents that have an embedding; a decision's chunk 0 has its own vector, chunk 1 that of the
next id. Dates are those of the order with the id, unknown for every seventeenth. Citations are the line
items of the orders whose key is an id, as literals, so the graph is built as from source rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate_tokens, year_of_ms
from ..operators import graph, metrics, retrieval, sampling
from ..sources.checkpoints import keep

SETTINGS = retrieval.Settings(
    seeds=20, cap_1hop=64, cap_2hop=128, frontier=10, overfetch=24, chunks_each=2, systems=retrieval.SYSTEMS
)
STRATA = ("de", "fr", "es")
#: Sources whose points are searched.
RULING_SOURCES = tuple(f"src{i}" for i in range(18))


class World:
    """Relations over one folder of tables; what several queries share is made once and kept."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: retrieval.Settings = SETTINGS):
        self.spark, self.sf_dir, self.settings = spark, sf_dir, settings

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def corpus(self) -> DataFrame:
        """id, language, source, text, vector."""
        vectors = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        docs = self.table("documents").select("doc_id", "lang", "source", "text")
        return docs.join(vectors, "doc_id").select(F.col("doc_id").alias("num"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"), "source", "text", "vector")

    @cached_property
    def dates(self) -> DataFrame:
        """id, date_ms of dated ids."""
        at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
        return self.table("orders").where("o_orderkey % 17 <> 0").select(F.col("o_orderkey").cast("string").alias("id"), at.alias("date_ms"))

    @cached_property
    def points(self) -> DataFrame:
        """id, chunk_index, vector, source, language, court, date_ms."""
        ids = self.corpus.select("num", "id", "source", "language")
        vectors = self.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
        parts = ids.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
        rows = parts.join(vectors, F.col("vec_id") == F.col("num") + F.col("chunk_index")).join(self.dates, "id", "left")
        return rows.select("id", "chunk_index", "vector", "source", "language", F.lit("CH").alias("court"), "date_ms")

    @cached_property
    def rulings(self) -> DataFrame:
        """The points of the two ruling sources."""
        return keep(self.points.where(F.col("source").isin(*RULING_SOURCES)))

    @cached_property
    def source_rows(self) -> DataFrame:
        """decision_id, cited_rulings, laws (list literals), pos."""
        n = self.corpus.agg(F.count(F.lit(1)).alias("d"))
        lines = self.table("lineitem").crossJoin(F.broadcast(n)).where("l_orderkey < d")  # n is one row
        literal = lambda c: F.concat(F.lit("['"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", c.alias("v")))), lambda x: x["v"]), "','"), F.lit("']"))
        return lines.groupBy(F.col("l_orderkey").alias("pos")).agg(
            literal((F.col("l_partkey") % F.col("d")).cast("string")).alias("cited_rulings"), literal(F.concat(F.lit("L"), F.col("l_suppkey"))).alias("laws")
        ).select(F.col("pos").cast("string").alias("decision_id"), "cited_rulings", "laws", "pos")

    @cached_property
    def cited(self) -> DataFrame:
        return graph.citations(self.source_rows)

    @cached_property
    def edges(self) -> DataFrame:
        return keep(graph.edges(self.cited))

    @cached_property
    def nodes(self) -> DataFrame:
        return keep(graph.nodes(self.source_rows, self.cited))

    @cached_property
    def degree(self) -> DataFrame:
        return graph.in_degree(self.edges)

    @cached_property
    def valid(self) -> DataFrame:
        return sampling.valid_ids(self.rulings, self.nodes)

    @cached_property
    def meta(self) -> DataFrame:
        return sampling.metadata(self.rulings)

    @cached_property
    def facts(self) -> DataFrame:
        """id, facts: texts, of which every thirteenth is missing."""
        return self.corpus.select("id", F.when(F.col("num") % 13 != 0, F.col("text")).alias("facts"))

    @cached_property
    def truth(self) -> DataFrame:
        return keep(sampling.ground_truth(self.edges, self.valid, self.meta))

    @cached_property
    def queries(self) -> DataFrame:
        """query_id, language, year, date_ms, vector of all ids with ground truth."""
        asked = self.truth.select(F.col("query_id").alias("id")).distinct()
        rows = self.corpus.join(asked, "id", "left_semi").join(self.dates, "id", "left")
        return keep(rows.select(
            F.col("id").alias("query_id"), "language", year_of_ms(F.col("date_ms")).alias("year"), "date_ms", "vector"
        ))

    @cached_property
    def query_texts(self) -> DataFrame:
        """query_id, query_text: only pair scores read texts."""
        texts = self.corpus.select(F.col("id").alias("query_id"), truncate_tokens(F.col("text")).alias("query_text"))
        return texts.join(self.queries.select("query_id"), "query_id", "left_semi")

    @cached_property
    def engine(self) -> retrieval.Corpus:
        texts = self.corpus.select("id", "text")
        return retrieval.Corpus(self.rulings, self.edges, self.nodes, self.dates, self.degree, texts)

    @cached_property
    def found(self) -> retrieval.Retrieval:
        return retrieval.Retrieval(self.engine, self.queries, self.settings)

    @cached_property
    def scores(self) -> DataFrame:
        return keep(retrieval.pair_scores(self.found.pools(), self.query_texts, self.engine.texts))

    @cached_property
    def failed(self) -> DataFrame:
        """Queries whose pair scores could not be had: a stand-in for failed batches."""
        return self.queries.where(F.col("query_id").cast("long") % 29 == 0).select("query_id")

    @cached_property
    def first_query(self) -> str:
        """The query with the least number."""
        return str(self.queries.agg(F.min(F.col("query_id").cast("long"))).first()[0])

    def ranked(self, ranking: str) -> DataFrame:
        scores = self.scores if ranking == "cross_encoder" else None
        return retrieval.rank(self.found.pools(), ranking, self.degree, scores, self.failed if scores is not None else None)

    @cached_property
    def results(self) -> DataFrame:
        """system, ranking, query_id, id, value, rank, k for every configuration."""
        out = None
        for ranking in retrieval.RANKINGS:
            one = retrieval.cut_off(self.ranked(ranking), self.settings.ks)
            out = one if out is None else out.unionByName(one)
        return keep(out)

    def accuracy_at(self, ranking: str, k: int, systems: tuple[str, ...] | None = None) -> DataFrame:
        """The rows of ``accuracy`` of one ranking and cut-off, of some systems if they are named; where the results aren't there yet, no others are made."""
        some = F.lit(True) if systems is None else F.col("system").isin(*systems)
        if "results" in self.__dict__:
            return self.accuracy.where((F.col("ranking") == ranking) & (F.col("k") == k) & some)
        if systems is None:
            ranked = self.ranked(ranking)
        else:
            pools = keep(self.found.pools_of(systems))
            scores = retrieval.pair_scores(pools, self.query_texts, self.engine.texts) if ranking == "cross_encoder" else None
            ranked = retrieval.rank(pools, ranking, self.degree, scores, self.failed if scores is not None else None)
        return metrics.accuracy(retrieval.cut_off(ranked, [k]), self.truth, self.queries)

    @cached_property
    def seed_targets(self) -> DataFrame:
        """id, target: each query's seeds with each case that it cites."""
        return keep(self.found.seeds.select("query_id", "id").join(self.truth.select("query_id", F.col("id").alias("target")), "query_id").select("id", "target").distinct())

    @cached_property
    def accuracy(self) -> DataFrame:
        return metrics.accuracy(self.results, self.truth, self.queries)

    @cached_property
    def nearness(self) -> DataFrame:
        return metrics.nearness(self.results, self.truth, *self.distances)

    @cached_property
    def nearness_directed(self) -> DataFrame:
        """The directed columns of ``nearness``; they need no distances against the direction of citations."""
        return metrics.nearness(self.results, self.truth, self.distances_directed)

    @cached_property
    def wanted(self) -> DataFrame:
        """id, target: what lists and truth ask the distance of."""
        return keep(metrics.wanted_distances(self.results, self.truth))

    @cached_property
    def distances_directed(self) -> DataFrame:
        return graph.distances_by_sets(self.edges, self.wanted, keep)

    @cached_property
    def distances(self) -> tuple[DataFrame, DataFrame]:
        """Distances, directed and not, of what lists and truth ask for."""
        return self.distances_directed, graph.distances_by_sets(self.edges, self.wanted, keep, directed=False)

    @cached_property
    def per_query(self) -> DataFrame:
        return keep(metrics.per_query(self.results, self.truth, self.queries, *self.distances, keep))

    @cached_property
    def pool_metrics(self) -> DataFrame:
        return metrics.pool_metrics(self.found.pools(), self.truth)

    @cached_property
    def layers(self) -> DataFrame:
        return self.found.layers(self.truth)

    @cached_property
    def candidates(self) -> DataFrame:
        return sampling.candidates(self.valid, self.meta, self.nodes, self.facts, self.truth, STRATA)

    @cached_property
    def sample(self) -> DataFrame:
        return sampling.stratified(self.candidates.where("reason = 'kept'").drop("reason"), 12)


