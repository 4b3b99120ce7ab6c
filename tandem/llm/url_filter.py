"""URL filters: a sort-merge range join of urls with nested prefix rules.

Host and path of a url or rule become one canonical key, the host's labels reversed: `www.example.com` and `/en/7` give
`com.example.www#/en/7`. The rules that fit a key are those whose key is a prefix of it, so that a rule is an interval of
keys and two rules are nested or disjoint. A url stands for one probe per host suffix. Rules and probes are swept in the
order of their keys; each rule brings the stack of the rules around it, and a probe pops those that have ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("#"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule: key and stack, the rules around it and itself from the shortest to the longest.

    Of equal rules with different verdicts, block wins.
    """
    keyed = (
        rules.filter(F.col("host").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(_key(F.split("host", r"\."), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    )
    around = keyed.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("key", F.expr("left(key, n)").alias("outer"))
    outer = keyed.select(F.col("key").alias("outer"), "rule", "verdict")
    return (
        around.join(outer, "outer")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("outer").alias("n"), F.col("outer").alias("key"), "rule", "verdict"))).alias("stack"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; rules: host, path, verdict (block or allow).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest one decides, of equally
    long ones that with the longest host. Where none fits, rule is null and the verdict is the default. Repeated pages give
    repeated rows, null urls an empty host and path; other columns of pages are not carried. Only the host suffixes no
    deeper than the deepest rule are probed. Each top label is dealt over `salts` sweeps, to which its rules are copied.
    """
    spark = pages.sparkSession
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stacks = rule_stacks(rules)
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    distinct = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    host, path = host_and_path(F.col("url"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))),
        lambda n: _key(F.slice(labels, F.size(labels) - n + 1, n), F.col("path")),
    )
    probes = (
        distinct.select("page_id", "url", "copies", host.alias("host"), path.alias("path"))
        .select("page_id", "url", "copies", F.explode(suffixes).alias("key"))
        .withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    )
    top = F.regexp_extract("key", r"^([^.#]*)", 1)
    events = probes.withColumn("stack", F.lit(None).cast(stacks.schema["stack"].dataType)).withColumn("probe", F.lit(1)).unionByName(
        stacks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("probe", F.lit(0)), allowMissingColumns=True
    )
    sweep = Window.partitionBy("top", "salt").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, 0)
    active = F.filter(F.col("open"), lambda r: F.startswith(F.col("key"), r["key"]))
    found = (
        events.withColumn("top", top)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .filter("probe = 1")
        .select("page_id", "url", "copies", F.try_element_at(active, F.lit(-1)).alias("hit"))
    )
    best = F.max(F.when(F.col("hit").isNotNull(), F.struct(F.length("hit.rule").alias("n"), F.instr(F.col("hit.key"), "#").alias("h"), F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))))
    return (
        found.groupBy("page_id", "url")
        .agg(best.alias("best"), F.max("copies").cast("int").alias("copies"))
        .select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
        .drop("copy")
    )
