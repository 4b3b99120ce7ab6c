"""Evaluation of event predictors on tables: y (0 or 1), score, and the columns of a fold or group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import prob_hysteresis
from .graph import settled
from .intervals import match_events


def running_sums(counts: DataFrame, by: list[str], value: str, cols: list[str], bins: int = 1024) -> DataFrame:
    """counts with below_<col>: the column's sum over a group's smaller values. counts: one row for each value of a group.

    Values are added up within bins of the group's range, and the bins among themselves, so that a group of any size, such as
    the whole table, is spread over the bins' tasks.
    """
    ends = counts.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    meet = lambda a, b, on: a.join(b, on) if by else a.join(F.broadcast(b), on) if on else a.join(F.broadcast(b))  # noqa: E731  one row, or one for each bin
    share = F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))
    rows = meet(counts, ends, by).withColumn("_bin", F.greatest(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")).drop("_low", "_high")
    sums = rows.groupBy(*by, "_bin").agg(*(F.sum(c).alias(c) for c in cols))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # of `bins` rows at most
    sums = sums.select(*by, "_bin", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_upto_{c}") for c in cols))
    w = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = meet(rows, sums, [*by, "_bin"])
    return out.select(*counts.columns, *((F.col(f"_upto_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"below_{c}") for c in cols))


def auroc(df: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve by average ranks, ties counting half; null where only one class is there."""
    counts = df.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, by, "score", ["n"]).withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n"), F.sum(F.col("p") * F.col("rank")).alias("r")).filter("n > 0")
    pos, neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    return out.select(*by, "n", "n_pos", F.when((pos > 0) & (neg > 0), (F.col("r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auroc"))


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean precision at each positive, equal scores taken together; with the prevalence."""
    counts = df.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    rows = running_sums(counts, by, "score", ["p", "n"])
    total = counts.groupBy(*by).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    rows = rows.join(total, by) if by else rows.join(F.broadcast(total))  # one row
    precision = (F.col("_p") - F.col("below_p")) / (F.col("_n") - F.col("below_n"))  # of the scores from this one up
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * precision), F.sum("p")).alias("ap"), (F.sum("p") / F.sum("n")).alias("prevalence"))


def mae_vs_median(df: DataFrame, by: list[str], most: float) -> DataFrame:
    """Mean absolute error of pred against y, both clipped at `most`, and of the constant median of y."""
    y, pred = F.least("y", F.lit(most)), F.greatest(F.least("pred", F.lit(most)), F.lit(0.0))
    middle = df.groupBy(*by).agg(F.percentile(y, F.lit(0.5)).alias("median"))
    return df.join(middle, by).groupBy(*by).agg(F.avg(F.abs(pred - y)).alias("mae"), F.avg(F.abs(F.col("median") - y)).alias("mae_median"), F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, by: list[str], most: float) -> DataFrame:
    """Prevalence and weight of the positive class (negatives per positive), at most `most`."""
    out = df.groupBy(*by).agg(F.avg("y").alias("prevalence"))
    return out.withColumn("weight", F.least(F.coalesce(F.try_divide(1 - F.col("prevalence"), F.col("prevalence")), F.lit(most)), F.lit(most)))


def normalizer(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population deviation of each column, a deviation near 0 being 1: one row per column."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"mean_{c}").alias("mean"), F.when(F.col(f"std_{c}") > 1e-6, F.col(f"std_{c}")).otherwise(1.0).alias("std")) for c in cols)))
    return stats.select(rows.alias("r")).select("r.*")


def assign_folds(ids: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Every id's fold: round robin in the order of a hash of seed and id, so that folds are even. The order is that of 4 096
    ranges of the hash, each counted by itself."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = ids.select(key).distinct().withColumn("_mixed", mixed).withColumn("_range", F.substring("_mixed", 1, 3))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("_range", F.coalesce(F.sum("m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_upto"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_mixed", key)) - 1 + F.col("_upto")
    return rows.join(F.broadcast(before), "_range").select(key, (place % k).cast("int").alias("fold"))


def late_fusion(a: DataFrame, b: DataFrame, key: list[str], fold: str) -> DataFrame:
    """Mean of two predictors' scores, and of their ranks within the fold."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(fold).orderBy("score")
        ties = F.count(F.lit(1)).over(Window.partitionBy(fold, "score"))
        return df.select(*key, fold, F.col("score").alias(f"s_{name}"), (F.rank().over(w) + (ties - 1) / 2).alias(f"r_{name}"))

    both = ranked(a, "a").join(ranked(b, "b"), [*key, fold])
    return both.select(*key, fold, ((F.col("s_a") + F.col("s_b")) / 2).alias("mean_score"), ((F.col("r_a") + F.col("r_b")) / 2).alias("mean_rank"))


def summarise_runs(folds: DataFrame, run: list[str], metric: str) -> DataFrame:
    """Mean and population deviation over folds."""
    return folds.groupBy(*run).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.count(metric).alias("n_folds"))


def paired_bootstrap(diffs: DataFrame, value: str, replicates: int, seed: int) -> DataFrame:
    """Mean of the differences, its 95 % interval and the share of replicates over 0, units drawn with replacement.

    Each replicate counts a unit as often as a Poisson variable of mean 1 says, hashed from seed, replicate and unit: a
    bootstrap that needs no positions and adds up in one aggregation.
    """
    rows = diffs.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", "unit"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # inverse of the Poisson distribution function
    cut, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        cut.append(total)
        p /= k + 1
    weight = sum(((u > c).cast("int") for c in cut[1:]), (u > cut[0]).cast("int"))
    means = rows.withColumn("w", weight).groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    point = diffs.agg(F.avg(value).alias("mean"))
    spread = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_positive"))
    return point.join(spread)


def threshold_for_precision(df: DataFrame, precision: float, bins: int = 1024) -> DataFrame:
    """The threshold of the highest recall among those that reach the precision; null if none does.

    Scores are summed from the highest down within bins of their range, and bins among themselves, so that no task takes all.
    """
    counts = df.groupBy("score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("p").alias("total"))  # one row
    share = F.try_divide(F.col("score") - F.col("low"), F.col("high") - F.col("low"))
    counts = counts.join(F.broadcast(ends)).withColumn("bin", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    sums = sums.select("bin", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("bn"))
    w = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(F.broadcast(sums), "bin").withColumns({"p": F.sum("p").over(w) + F.col("bp"), "n": F.sum("n").over(w) + F.col("bn")})
    rows = rows.select("score", (F.col("p") / F.col("n")).alias("precision"), F.try_divide("p", "total").alias("recall"))
    return rows.agg(F.max(F.when(F.col("precision") >= precision, F.struct("recall", "score"))).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.recall").alias("recall"))


#: Quantiles of the scores that are tried as thresholds where no threshold reaches the precision.
QUANTILES = (0.80, 0.85, 0.90, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995)


def quantiles(df: DataFrame, col: str, shares: tuple[float, ...], bins: int = 1024) -> DataFrame:
    """share and value: exact quantiles, linear between neighbours, of a whole column without one task that takes all of it.

    Distinct values are counted, the counts added up by bins of the values' range, and only bins that hold a wanted rank are
    looked into. No rows give no quantiles.
    """
    counts = settled(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    ends = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total")).filter("total > 0")  # one row
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    binned = counts.join(F.broadcast(ends)).withColumn("bin", place)
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # of `bins` rows
    sums = binned.groupBy("bin").agg(F.sum("n").alias("m")).withColumn("upto", F.coalesce(F.sum("m").over(before), F.lit(0)))
    wanted = ends.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "total").withColumn("rank", F.col("share") * (F.col("total") - 1))
    wanted = wanted.select("share", "rank", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("k")).distinct()
    held = sums.join(F.broadcast(wanted), (F.col("k") >= F.col("upto")) & (F.col("k") < F.col("upto") + F.col("m")))
    inside = binned.join(F.broadcast(held.select("bin", "upto").distinct()), "bin")
    w = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.withColumn("from", F.col("upto") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    found = ranked.join(F.broadcast(wanted), (F.col("k") >= F.col("from")) & (F.col("k") < F.col("from") + F.col("n")))
    two = found.groupBy("share", "rank").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return two.select("share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("value"))


def event_f1(scores: DataFrame, truth: DataFrame, grid: DataFrame, by: list[str], on: int, off: int, slack: int) -> DataFrame:
    """For every pair of thresholds (grid: share, high, low; few rows, broadcast) the events that hysteresis finds in the scores
    (by, frame, p), against true ones (by, id, start, end): n_proposals, n_truth, precision, recall and f1 over all series."""
    tried = scores.select(*by, "frame", "p").join(F.broadcast(grid.select("share", "high", "low")))
    found = prob_hysteresis(tried, [*by, "share", "high", "low"], F.col("high"), F.col("low"), on, off).select(*by, "share", F.col("start").alias("id"), "start", "end")
    every = truth.join(F.broadcast(grid.select("share")))
    sums = match_events(found, every, [*by, "share"], slack).groupBy("share").agg(*(F.sum(c).alias(c) for c in ("n_proposals", "proposals_hit", "n_truth", "truth_hit")))
    precision, recall = (F.coalesce(F.try_divide(f"{c}_hit", f"n_{c}"), F.lit(0.0)) for c in ("proposals", "truth"))
    out = grid.join(sums, "share", "left").na.fill(0, ["n_proposals", "proposals_hit", "n_truth", "truth_hit"]).withColumns({"precision": precision, "recall": recall})
    return out.select("share", "high", "low", "n_proposals", "n_truth", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"))


def choose_thresholds(scores: DataFrame, truth: DataFrame, by: list[str], precision: float, on: int, off: int, slack: int, lower: float = 0.6) -> DataFrame:
    """One row: high, low (`lower` times it), rule, and what the rule reached.

    scores: by, frame, p, y. rule is precision where a threshold reaches it on single frames, the one of the highest recall;
    else event_f1: of QUANTILES of the scores the one whose events have the best F1, the first of equal ones.
    """
    best = settled(threshold_for_precision(scores.select(F.col("p").alias("score"), "y"), precision))  # one row
    if best.first()["threshold"] is not None:
        return best.select(F.col("threshold").alias("high"), (F.col("threshold") * lower).alias("low"), F.lit("precision").alias("rule"), "recall", F.lit(None).cast("double").alias("f1"))
    grid = settled(quantiles(scores, "p", QUANTILES).select("share", F.col("value").alias("high"), (F.col("value") * lower).alias("low")))
    tried = event_f1(scores, truth, grid, by, on, off, slack)
    top = tried.agg(F.max(F.struct(F.round("f1", 12).alias("r"), (-F.col("share")).alias("s"), "high", "low", "recall", "f1")).alias("b"))
    return top.select("b.high", "b.low", F.lit("event_f1").alias("rule"), "b.recall", "b.f1")
