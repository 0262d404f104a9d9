"""Command line: sample queries, run an evaluation over a folder of tables, show its tables, run a registered query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import retrieval, sampling, views
from .plans import catalogue, evaluate
from .plans.world import STRATA, World
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrand", description=__doc__)
    top.add_argument("--tables", required=True, help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)
    sample = commands.add_parser("sample", help="draw queries by language and write them as lines")
    sample.add_argument("--out", required=True)
    sample.add_argument("--n", type=int, default=len(STRATA) * sampling.PER_LANGUAGE, help="queries in all")
    sample.add_argument("--dry-run", action="store_true", help="say how many there would be and write nothing")
    run = commands.add_parser("evaluate", help="retrieve, score and aggregate")
    run.add_argument("--out", required=True)
    run.add_argument("--n", type=int, help="queries, the first by id; all if left out")
    run.add_argument("--systems", nargs="+", choices=retrieval.SYSTEMS, default=list(retrieval.DEFAULT_SYSTEMS))
    run.add_argument("--rankings", nargs="+", choices=retrieval.RANKINGS, default=["cosine", "indegree"])
    run.add_argument("--k", nargs="+", type=int, default=[5, 10, 15, 20])
    run.add_argument("--resume", action="store_true")
    run.add_argument("--dry-run", action="store_true", help="say what would run and run nothing")
    for stage in evaluate.STAGES:
        run.add_argument(f"--skip-{stage}", action="store_true")
    show = commands.add_parser("show", help="the comparison tables of an evaluation")
    show.add_argument("--out", required=True)
    show.add_argument("--k", type=int)
    query = commands.add_parser("query", help="a registered query")
    query.add_argument("name", choices=sorted(catalogue.ENTRIES))
    query.add_argument("--rows", type=int, default=20)
    return top


def say(**values) -> None:
    print(json.dumps(values), flush=True)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lodestrand").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    world = World(spark, a.tables)
    if a.command == "query":
        catalogue.queries()[a.name](spark, a.tables).show(a.rows, truncate=False)
    elif a.command == "show":
        views.comparison(spark.read.parquet(f"{a.out}/summary"), a.k).show(1000, truncate=False)
        spark.read.parquet(f"{a.out}/recall_ceiling").orderBy("system").show(1000, truncate=False)
    elif a.command == "sample":
        kept = world.candidates.where("reason = 'kept'").drop("reason")
        pool = {r.language: r.n for r in sampling.pool_sizes(kept.withColumn("reason", F.lit("kept"))).collect()}  # a row a language
        plan = sampling.run_plan(a.n, available=pool, at_hand={}, may_reuse=False, languages=STRATA)
        say(pool=pool, queries=plan.queries, each=plan.sample_each)
        if not a.dry_run:
            sinks.write_lines(sampling.stratified(kept, plan.sample_each), a.out)
    else:
        settings = world.settings.but(systems=tuple(a.systems), ks=tuple(sorted(a.k)))
        asked = world.queries.join(world.query_texts, "query_id", "left")
        asked = asked.orderBy(F.col("query_id").cast("long")).limit(a.n) if a.n is not None else asked
        stages = [s for s in evaluate.STAGES if not getattr(a, f"skip_{s}")]
        say(queries=asked.count(), systems=a.systems, rankings=a.rankings, k=list(settings.ks), stages=stages)
        if not a.dry_run:
            evaluate.evaluate(world.engine, asked, world.truth, a.out, settings, rankings=a.rankings, resume=a.resume, stages=stages, on_event=lambda e: say(**e))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
