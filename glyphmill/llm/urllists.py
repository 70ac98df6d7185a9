"""URL filters with dated lists: every capture is judged by the entries active when it was fetched.

Dated additions and removals become validity intervals.  A capture's host
suffixes, and each with the first path segment, are its keys; an equi-join on
(key, time slice) with the interval as condition finds the active entries.

* Entries take effect at whole seconds; of several for one (list, pattern) in
  the same second the latest counts, and of one instant an addition.
* An interval holds from its start to just before the next entry.
* A capture is blocked if a block list matches and no allow list does.
* A null or unparsable url, a host over 253 characters or a null fetch time
  matches nothing.  Entries with a null in any column are ignored.
* Repeated captures stay; no entries leave every capture unblocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import boxed, unboxed

SLICE_DAYS = 7
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    found = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when((F.length(found) > 0) & (F.length(found) <= 253), found)


def keys(url: Column) -> Column:
    """All patterns that would match the url."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    segment = F.regexp_extract(url, SEGMENT, 1)
    deep = F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), segment))
    return F.when(host(url).isNull(), F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.when(segment == "", suffixes).otherwise(F.concat(suffixes, deep)))
    )


def intervals(entries: DataFrame) -> DataFrame:
    """``list_name, kind, pattern, start, stop`` (seconds; a null stop never ends) of every addition.

    The next entry is sought first within its day (at most 86,400 rows a
    pattern, since a second holds one entry), then among the pattern's days.
    """
    named = entries.select("list_name", "kind", F.lower("pattern").alias("pattern"), "action", "at").dropna()
    second = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 1_000_000).cast("bigint")
    group = ["list_name", "kind", "pattern"]
    last = F.max_by(F.col("action") == "add", F.struct("at", F.col("action") == "add"))
    points = (
        named.withColumn("start", second)
        .groupBy(*group, "start")
        .agg(last.alias("active"))
        .withColumn("day", F.floor(F.col("start") / 86_400))
    )
    days = points.groupBy(*group, "day").agg(F.min("start").alias("first"))
    days = days.withColumn("next_day", F.lead("first").over(W.partitionBy(*group).orderBy("day"))).drop("first")
    within = F.lead("start").over(W.partitionBy(*group, "day").orderBy("start"))
    return (
        points.withColumn("next", within)
        .join(days, [*group, "day"])
        .filter("active")
        .select(*group, "start", F.coalesce("next", "next_day").alias("stop"))
    )


def judge(
    captures: DataFrame,
    entries: DataFrame,
    url_column: str = "url",
    time_column: str = "fetch_time",
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """``captures`` with ``host``, ``n_matches``, ``lists``, ``entry`` (the longest pattern that matched) and ``blocked``."""
    width = slice_days * 86_400
    moments = captures.select(
        F.col(url_column).alias("url"),
        F.floor(F.unix_micros(F.col(time_column).cast("timestamp")) / 1_000_000).cast("bigint").alias("second"),
    ).dropna()
    # Keys are laid out where the captures are read, by as many tasks, and repeated ones dropped after.
    asked = moments.select("url", "second", F.explode(keys(F.col("url"))).alias("pattern")).distinct()
    asked = asked.withColumn("slice", F.floor(F.col("second") / width))
    # An open interval ends with the last capture; only slices that captures reach are laid out.
    span = moments.agg(F.min("second").alias("first"), F.max("second").alias("last")).first()
    if span["first"] is None:
        span = {"first": 0, "last": -1}
    first, last = F.lit(span["first"]), F.lit(span["last"])
    active = intervals(entries)
    active = active.filter((F.col("start") <= last) & F.coalesce(F.col("stop") > first, F.lit(True)))
    low = F.floor(F.greatest("start", first) / width)
    high = F.floor(F.least(F.coalesce(F.col("stop") - 1, last), last) / width)
    sliced = active.withColumn("slice", F.explode(F.sequence(low, high)))
    hits = asked.join(sliced, ["pattern", "slice"]).filter(
        (F.col("start") <= F.col("second")) & F.coalesce(F.col("second") < F.col("stop"), F.lit(True))
    )
    found = hits.groupBy("url", "second").agg(
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("names"),
        F.max(F.struct(F.length("pattern").alias("size"), F.col("pattern").alias("text"))).alias("longest"),
        (F.max(F.col("kind") == "block") & ~F.max(F.col("kind") == "allow")).alias("stop_it"),
    )
    rows = boxed(captures).select(
        "row",
        F.col(f"row.`{url_column}`").alias("row_url"),
        F.floor(F.unix_micros(F.col(f"row.`{time_column}`").cast("timestamp")) / 1_000_000)
        .cast("bigint")
        .alias("row_second"),
    )
    joined = rows.join(found, (F.col("row_url") == F.col("url")) & (F.col("row_second") == F.col("second")), "left")
    return unboxed(
        joined,
        captures.columns,
        host=host(F.col("row_url")),
        n_matches=F.coalesce("n", F.lit(0)).cast("bigint"),
        lists=F.coalesce("names", F.lit("")),
        entry=F.col("longest.text"),
        blocked=F.coalesce("stop_it", F.lit(False)),
    )
