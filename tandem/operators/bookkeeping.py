"""Manifests, reviews, categories and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verify_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """path and state of every file that is missing, untracked or mismatched (size or hash); others are left out."""
    a = listed.select("path", F.col("size").alias("a_size"), F.col("hash").alias("a_hash"), F.lit(True).alias("listed"))
    b = found.select("path", F.col("size").alias("b_size"), F.col("hash").alias("b_hash"), F.lit(True).alias("found"))
    same = F.col("a_size").eqNullSafe(F.col("b_size")) & F.col("a_hash").eqNullSafe(F.col("b_hash"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "untracked").when(~same, "mismatched")
    return a.join(b, "path", "full").select("path", state.alias("state")).filter("state IS NOT NULL")


def breakdown(files: DataFrame, category: str) -> DataFrame:
    return files.groupBy(category).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def categorize(df: DataFrame, value: str, rules: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """category: that of the first pattern that the value matches."""
    if not rules:
        return df.withColumn("category", F.lit(other))
    case = F
    for pattern, name in rules:
        case = case.when(F.col(value).rlike(pattern), name)
    return df.withColumn("category", case.otherwise(other))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key: later ones replace earlier ones."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def review_summary(verdicts: DataFrame) -> DataFrame:
    """ok, wrong, unsure and accuracy by item, by stream, by both, and over all (nulls for what is summed over)."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "wrong", "unsure")]
    sets = [["item", "stream"], ["item"], ["stream"], []]
    out = verdicts.groupingSets([[F.col(c) for c in s] for s in sets], F.col("item"), F.col("stream")).agg(*counts)
    return out.withColumn("accuracy", F.try_divide("ok", F.col("ok") + F.col("wrong")))


def bind_ids(rows: DataFrame, source: DataFrame, on: list[str], check: list[str]) -> DataFrame:
    """Rows with the id of the one source row that agrees on `on`; bound is ok, none, several, or conflict where `check`
    differs."""
    own = source.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id"), *(F.first(c).alias(f"s_{c}") for c in check))
    agree = F.lit(True)
    for c in check:
        agree = agree & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "several").when(~agree, "conflict").otherwise("ok")
    out = rows.join(own, on, "left").withColumn("bound", state)
    return out.select(*rows.columns, F.when(F.col("bound") == "ok", F.col("id")).alias("source_id"), "bound")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti").select(key)


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def select_required(files: DataFrame, required: DataFrame) -> DataFrame:
    """Every required path with whether it is listed, and its size."""
    return required.join(files.select("path", "size"), "path", "left").withColumn("present", F.col("size").isNotNull())


def merge_side_columns(base: DataFrame, keys: list[str], sides: dict[str, DataFrame]) -> DataFrame:
    """The base with every stage's columns as <stage>_<name>; rows that a stage lacks have nulls."""
    for stage, df in sides.items():
        base = base.join(df.select(*keys, *(F.col(c).alias(f"{stage}_{c}") for c in df.columns if c not in keys)), keys, "left")
    return base


def slots_to_columns(long: DataFrame, by: list[str], slot: str, value: str, slots: list) -> DataFrame:
    """One column per declared slot; null where the slot is absent, the largest value where it is there several times. All slots
    are found in one aggregation, so that a task keeps one row a key, not one a slot."""
    return long.groupBy(*by).agg(*(F.max(F.when(F.col(slot) == s, F.col(value))).alias(str(s)) for s in slots))
