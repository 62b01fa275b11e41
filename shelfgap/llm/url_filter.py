"""URL filter: a sorted sweep of reversed-host keys over the intervals of nested rules.

A rule (host, path) covers every key of its host that begins with its path:
one interval in the order of (host key, path).  A url is tested under its own
host and under each parent domain, so subdomains need no intervals of their
own.  Rules and keys are sorted together; the sweep carries the innermost open
rule, and at a rule's end goes back to the rule that encloses it.  All work is
in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, shuffle_partitions

RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """Text after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Text after the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.concat_ws(".", F.reverse(labels))


def rule_events(rules: DataFrame) -> DataFrame:
    """Rule intervals as sorted boundary events (host_key, at, top).

    ``at`` is a boundary of the interval of paths and ``top`` the rule that is
    on top of the stack from there on (null: none).  The intervals of one host
    nest or are apart, so a stack folded over its sorted boundaries suffices: a
    start pushes, an end pops.  Folding is per host; a host's rules must fit a row.
    Repeated rules count once, "block" before "allow".  Rules with a null host,
    path or verdict are ignored.
    """
    r = (rules.select("host", "path", "verdict").where(
            F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
         .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    rule = F.struct(F.concat("host", "path").alias("rule"), "verdict",
                    F.length("host").alias("host_len"), F.length("path").alias("path_len"))
    # an end sorts after all paths that begin with the rule's: U+10FFFF follows every character
    start = F.struct(F.col("path").alias("at"), F.lit(1).alias("kind"), F.length("path").alias("deep"),
                     rule.alias("r"))
    end = F.struct(F.concat("path", F.lit("\U0010FFFF")).alias("at"), F.lit(0).alias("kind"),
                   (-F.length("path")).alias("deep"), rule.alias("r"))
    per_host = (r.select(_reversed(F.split("host", r"\.")).alias("host_key"),
                         F.explode(F.array(start, end)).alias("e"))
                .groupBy("host_key").agg(F.array_sort(F.collect_list("e")).alias("events")))
    kind = "struct<rule:string,verdict:string,host_len:int,path_len:int>"
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def step(state: Column, e: Column) -> Column:
        size = F.size(state["stack"])
        stack = F.when(e["kind"] == 1, F.concat(state["stack"], F.array(e["r"]))).otherwise(
            F.slice(state["stack"], 1, F.greatest(size - 1, F.lit(0))))
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(
            F.struct(e["at"].alias("at"), F.try_element_at(stack, F.lit(-1)).alias("top")))).alias("out"))

    zero = F.struct(empty.alias("stack"),
                    F.expr(f"cast(array() as array<struct<at:string,top:{kind}>>)").alias("out"))
    swept = per_host.select("host_key", F.explode(F.aggregate("events", zero, step)["out"]).alias("x"))
    return swept.select("host_key", F.col("x.at").alias("at"), F.col("x.top").alias("top"),
                        F.lit(True).alias("is_rule"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id",
                url: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's
    path.  The longest fitting rule (host and path together; then the longer
    host) decides; with none, rule is null and verdict ``default``.

    Null or malformed urls have empty host and path and fit no rule.  Repeated
    pages each get a row.  Empty pages or rules are fine.  Only the id and url
    columns are read, so other columns may have any name.

    Distinct (host key, path) keys are sorted by range over all partitions, so
    neither a hot host nor a common url lands in one task; each partition takes
    the top rule of the partitions before it from one row per partition.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"),
                     url_path(F.col(url)).alias("path"))
    events = rule_events(rules)
    labels = F.split("host", r"\.")
    # a host is looked up under no more of its parents than the longest rule's host has labels
    most = rules.select(F.max(F.size(labels))).scalar()
    deep = F.greatest(F.lit(1), F.least(F.size(labels), F.coalesce(most, F.lit(1))))
    keys = (p.select("host", "path").where(F.col("host") != "").distinct()
            .select("host", "path", F.explode(F.sequence(F.lit(1), deep)).alias("n"))
            .select("host", "path", _reversed(F.slice(labels, -F.col("n"), F.col("n"))).alias("host_key"))
            .join(events.select("host_key").distinct(), "host_key", "left_semi"))
    probes = keys.select("host_key", F.col("path").alias("at"), F.lit(None).cast(
        events.schema["top"].dataType).alias("top"), F.lit(False).alias("is_rule")).distinct()
    swept = (events.unionByName(probes)
             .repartitionByRange(shuffle_partitions(spark), "host_key", "at")
             .withColumn("pid", F.spark_partition_id()))
    swept = land(swept, "url-sweep")  # fixes which range each key is in
    order = [F.col("host_key"), F.col("at"), F.col("is_rule").desc()]  # a boundary comes before its keys
    mark = F.when(F.col("is_rule"), F.struct("host_key", "top"))
    carried = swept.where("is_rule").groupBy("pid").agg(
        F.max_by(F.struct("host_key", "top"), F.struct("host_key", "at")).alias("m"))
    pids = swept.select("pid").distinct().join(carried, "pid", "left")  # a row per partition
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.broadcast(pids.select("pid", F.last("m", True).over(earlier).alias("carry")))
    so_far = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hits = (swept.withColumn("m", F.last(mark, True).over(so_far)).where(~F.col("is_rule"))
            .join(carry, "pid").withColumn("m", F.coalesce("m", "carry"))
            .where((F.col("m.host_key") == F.col("host_key")) & F.col("m.top").isNotNull())
            .select("host_key", F.col("at").alias("path"), F.col("m.top").alias("top")))
    length = F.col("top.host_len") + F.col("top.path_len")
    best = (keys.join(hits, ["host_key", "path"]).groupBy("host", "path")
            .agg(F.max_by("top", F.struct(length, "top.host_len")).alias("top")))
    return (p.join(best, ["host", "path"], "left")
            .select(F.col("page_id").alias(page_id), "host", "path", F.col("top.rule").alias("rule"),
                    F.coalesce("top.verdict", F.lit(default)).alias("verdict")))
