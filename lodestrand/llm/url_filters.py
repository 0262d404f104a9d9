"""URL filters by sort-merge range joins, in DataFrame operations only.

A host's labels, reversed and each closed by a low character, make a key under which all subdomains of
a host lie in one interval, as all paths under a path do. Rules open their intervals at their keys, with
the stack of the nested ones that are active from there on; URLs and these events are sorted together, and
sweeping over them, the last event has the stack for each URL. The first sweep finds the hosts that have
rules above a URL's host, the second, for each of these, the paths that have rules above the URL's path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Closes a label.
CLOSE = "\x01"


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return common.ascii_lower(raw), path


def reversed_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), CLOSE), F.lit(CLOSE))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """verdict, host, path from pairs such as ``("block", "example.com/en/")``."""
    rows = [(verdict, *text.partition("/")) for verdict, text in rules]
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quoted(v)}, {quoted(host.lower())}, {quoted(slash + path)})" for v, host, slash, path in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)")


def _host_events(rules: DataFrame) -> DataFrame:
    """key, stack: from a host's key on, the hosts with rules that it lies under, itself included."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    held = hosts.select("host", F.explode(above).alias("holder")).join(hosts.select(F.col("host").alias("holder")), "holder")
    return held.groupBy("host").agg(F.collect_set("holder").alias("stack")).select(reversed_key(F.col("host")).alias("key"), "stack")


def _path_events(rules: DataFrame) -> DataFrame:
    """holder, key, stack: from a path on, the rules (holder, path, verdict) of its host that it lies under, its own included."""
    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substr("path", F.lit(1), i))
    above = own.select(F.col("host").alias("holder"), F.col("path").alias("key"), F.explode(prefixes).alias("path"))
    held = above.join(own.select(F.col("host").alias("holder"), "path", "verdict"), ["holder", "path"])
    return held.groupBy("holder", "key").agg(F.collect_set(F.struct("holder", "path", "verdict")).alias("stack"))


def _swept(rows: DataFrame, events: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``active``, the stack of the last event at or before their keys, and a number, ``uid``.

    Rows and events are dealt by ranges of (keys, salt), so a key with a third of all rows is split over
    tasks; the stack that is active at the start of a range is carried over from the ranges before it. That
    needs the last event of each range, a row a range.
    """
    order = [*keys, "kind", "salt"]
    mixed = rows.withColumn("kind", F.lit(1)).unionByName(
        events.withColumns({"kind": F.lit(0), "salt": F.lit(-(2**63)).cast("long")}), allowMissingColumns=True
    )
    swept = common.cut(mixed.repartitionByRange(*order).withColumn("part", F.spark_partition_id())).withColumn("uid", F.monotonically_increasing_id())
    event = F.col("kind") == 0
    last = swept.groupBy("part").agg(F.max(F.when(event, F.struct(*keys, "stack"))).alias("last"))
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last("last", ignorenulls=True).over(ranges)["stack"].alias("carried"))
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    active = swept.withColumn("seen", F.last("stack", ignorenulls=True).over(sweep)).where(~event).join(carried, "part", "left")
    return active.withColumn("active", F.coalesce("seen", "carried")).drop("kind", "salt", "part", "stack", "seen", "carried")


def url_filter(
    pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    ``rules`` has verdict, host, path. A rule fits its host and all subdomains where the URL's path starts
    with the rule's; the longest (host plus path; at a tie the longer host, then the host and path that
    sort last; of one host and path the verdict that does) wins. No rule fits: rule null, verdict
    ``default``. Null URLs and those without ``://`` have an empty host and path; URLs of any length are
    read whole. Repeated rows and null ids are kept; empty pages give an empty result, empty rules leave the
    default; other columns are not read.

    A URL carries the few hosts above its own that have rules, then, once for each of these, the few rules
    whose paths are nested around its path, however many rules a host has. Both tables may be large;
    nothing is broadcast by hint or collected.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = rows.withColumns({"key": reversed_key(F.col("host")), "salt": F.xxhash64("page_id", "path")})
    under = F.filter("active", lambda h: (F.col("host") == h) | F.endswith(F.col("host"), F.concat(F.lit("."), h)))
    named = _swept(urls, _host_events(rules), "key").select("uid", "page_id", "host", "path", F.explode_outer(under).alias("holder"))
    each = named.withColumns({"key": F.col("path"), "salt": F.xxhash64("uid"), "row": F.col("uid")}).drop("uid")
    found = _swept(each, _path_events(rules), "holder", "key")
    fits = F.filter("active", lambda r: (r["holder"] == F.col("holder")) & F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["path"].alias("path"), r["verdict"].alias("verdict"))))
    size = (F.length("holder") + longest["n"]).alias("size")
    rule = F.struct(size, F.length("holder").alias("of_host"), F.col("holder").alias("host"), longest["path"].alias("path"), longest["verdict"].alias("verdict"))
    same = lambda c: F.first(c).alias(c)  # noqa: E731  (equal in all rows of a URL)
    judged = found.select("row", "page_id", "host", "path", F.when(longest.isNotNull(), rule).alias("one"))
    best = judged.groupBy("row").agg(same("page_id"), same("host"), same("path"), F.max("one").alias("best"))
    return best.select(
        "page_id", "host", "path",
        F.concat(F.col("best.host"), F.col("best.path")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
