"""Words on a timeline, utterances and their speakers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import scalar as s

from .folds import folded
from .intervals import dealt


#: Words that ask for something (fixed values).
REQUESTS = ("pass", "hand", "give", "take", "grab", "need", "can", "could", "please", "here", "want", "get", "bring")


def speech_block(words: DataFrame, grid: DataFrame, by: list[str], unit: int, window: int, most: int, bins: int = 32) -> DataFrame:
    """Speech per frame of a grid (by, frame), from words (start, end in integer time, token), `unit` of time to a frame.

    speaking (from the frame a word begins in to the one after its end), since (time since the last word's end by `most`, at
    most 1, and 1 before the first), n_words, request and bag, of words that ended in the last `window` frames, this one
    included and frame 0 never: their number, whether one asks for something, and the share of each of `bins` hashed bins.
    """
    words = dealt(words.dropna(subset=by), by)
    at = F.ceil(F.col("end") / unit).cast("long")
    bin_ = s.hash_bin(F.col("token"), bins)
    counted = at > 0
    ended = words.groupBy(*by, at.alias("frame")).agg(
        F.count_if(counted).alias("n"), F.count_if(counted & F.col("token").isin(*REQUESTS)).alias("asks"), *(F.count_if(counted & (bin_ == b)).alias(f"b{b}") for b in range(bins)), F.max("end").alias("last")
    )
    spoken = words.select(*by, F.explode(F.sequence(F.greatest(F.floor(F.col("start") / unit), F.lit(0)), at)).alias("frame")).distinct().withColumn("speaking", F.lit(True))
    # all meet in groups where they are dealt by series; joins by frame would shuffle the grid
    frames = grid.select(*by, F.col("frame").cast("long").alias("frame"), F.lit(True).alias("_asked"))
    rows = frames.unionByName(ended, allowMissingColumns=True).unionByName(spoken, allowMissingColumns=True)
    rows = rows.groupBy(*by, "frame").agg(*(F.max(c).alias(c) for c in ("_asked", "n", "asks", *(f"b{b}" for b in range(bins)), "last", "speaking"))).filter("_asked")
    w = Window.partitionBy(*by).orderBy("frame")
    rows = rows.withColumn("last", F.last("last", ignorenulls=True).over(w))
    back = w.rangeBetween(-(window - 1), 0)
    total = lambda c: F.coalesce(F.sum(c).over(back), F.lit(0))
    rows = rows.withColumns({"n_words": total("n"), "request": total("asks") > 0, "counts": F.array(*(total(f"b{b}") for b in range(bins)))})
    since = F.least(F.coalesce((F.col("frame") * unit - F.col("last")) / most, F.lit(1.0)), F.lit(1.0))
    bag = F.transform("counts", lambda c: c / F.greatest(F.col("n_words"), F.lit(1)))
    return rows.select(*by, "frame", F.coalesce("speaking", F.lit(False)).alias("speaking"), since.alias("since"), "n_words", "request", bag.alias("bag"))


def speech_columns(words: DataFrame, ticks: DataFrame, by: list[str], back: int, step: int) -> DataFrame:
    """For every tick the words that ended in (t - back, t], and whether one is being spoken. Ticks are multiples of `step`:
    a word is dealt to those that it reaches, so that the join is by equality."""
    first, last = F.ceil(F.least("start", "end") / step) * step, F.floor((F.col("end") + back - 1) / step) * step
    reach = words.filter(first <= last).select(*by, "start", "end", F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))).alias("t"))
    ended = (F.col("end") <= F.col("t")) & (F.col("end") > F.col("t") - back)
    spoken = (F.col("start") <= F.col("t")) & (F.col("end") > F.col("t"))
    counts = reach.groupBy(*by, "t").agg(F.count_if(ended).alias("n_words"), F.bool_or(spoken).alias("speaking"))
    return ticks.join(counts, [*by, "t"], "left").na.fill({"n_words": 0, "speaking": False})


def _pairs_of_utterances(segments: DataFrame, by: list[str], width: int, own: list[str]) -> DataFrame:
    """Pairs of `duplicate_utterances` with `own` columns of both as a_* and b_*. Texts are cut into words once, not for each
    pair; a pair counts in the first bucket that both are in, and its words are compared last."""
    said = segments.select(*by, "start", "end", "speaker", *own, s.numbered_words(F.col("text")).alias("words"))
    dealt = said.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    side = lambda n: dealt.select(*by, "bucket", *(F.col(c).alias(f"{n}_{c}") for c in ("start", "end", "speaker", "words", *own)))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    shorter = F.greatest(F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")), F.lit(1))
    same = (F.col("a_speaker") == F.col("b_speaker")) & (shared / shorter >= 0.8)
    alike = (shared / shorter >= 0.5) & (s.text_similarity(F.col("a_words"), F.col("b_words")) >= 0.6)
    near = (F.col("a_id") < F.col("b_id")) & (F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / width)) & (shared > 0)
    return side("a").join(side("b"), [*by, "bucket"]).filter(near & (same | alike)).select(*by, *(F.col(f"{n}_{c}") for n in "ab" for c in own))


def duplicate_utterances(segments: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs (a, b) of utterances that may be one: half of the shorter one's time and 60 % of its words shared, or the same
    speaker with 80 % of the time. segments: id, start, end, text, speaker. Found through time buckets of `width`."""
    return _pairs_of_utterances(segments, by, width, ["id"]).select(*by, F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def dedup_utterances(segments: DataFrame, by: list[str], width: int, schema: str) -> DataFrame:
    """The utterances that stay: the best (largest prob, then longest, then least id) first, those that pair with one that
    stays go. The fold runs over a group's pairs, which bring their ranks, not over its words. `schema`: the by columns' and id's
    types."""
    ranked = segments.withColumns({"rank1": -F.col("prob"), "rank2": -(F.col("end") - F.col("start"))})
    pairs = _pairs_of_utterances(ranked, by, width, ["id", "rank1", "rank2"])
    rank = {n: F.struct(*(F.col(f"{n}_{c}").alias(c) for c in ("rank1", "rank2", "id"))) for n in "ab"}
    plain = pairs.select(*by, F.least(*rank.values()).alias("r"), F.greatest(*rank.values()).alias("q"))
    plain = plain.select(*by, *(F.col(f"{n}.{c}").alias(f"{n}{k}") for n in "rq" for k, c in enumerate(("rank1", "rank2", "id"))))

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        foes: dict = {}
        for good1, good2, good, bad1, bad2, bad in rows:
            foes.setdefault((bad1, bad2, bad), set()).add((good1, good2, good))
        gone: set = set()
        for x in sorted(foes):  # all that are better come before
            if not foes[x] <= gone:
                gone.add(x)
        return ((x,) for x in sorted({x[-1] for x in gone}))

    return segments.join(folded(plain, by, [], fold, schema), [*by, "id"], "left_anti")


def attribute_speaker(segments: DataFrame, energy: DataFrame, by: list[str], margin: float) -> DataFrame:
    """The person whose microphone is loudest against its own median during the segment; null if the next one is within
    `margin`, to nine digits of the difference. energy: person, bin, energy; segments: id, start_bin, end_bin."""
    level = energy.groupBy(*by, "person").agg(F.greatest(F.percentile("energy", F.lit(0.5)), F.lit(1e-9)).alias("level"))
    inside = segments.withColumn("bin", F.explode(F.sequence("start_bin", "end_bin")))
    loud = inside.join(energy, [*by, "bin"]).groupBy(*by, "id", "person").agg(F.avg("energy").alias("e")).join(level, [*by, "person"]).withColumn("loud", F.col("e") / F.col("level"))
    top = loud.groupBy(*by, "id").agg(F.sort_array(F.collect_list(F.struct((-F.round("loud", 9)).alias("l"), "person", "loud"))).alias("t"))
    first, second = F.col("t")[0]["loud"], F.try_element_at("t", F.lit(2))["loud"]
    return segments.join(top, [*by, "id"], "left").select(*segments.columns, F.when(second.isNull() | (F.round(first - second * margin, 9) >= 0), F.col("t")[0]["person"]).alias("speaker"))

