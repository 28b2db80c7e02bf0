"""Mixing sources to target weights under a time-varying curriculum.

Each source has a weight schedule over training time t from 0 to 1, ``share * (1 + slope * (2t - 1))``; the schedules sum
to one at every t. Integrated, the schedule says how many tokens of the source have been demanded by t. A source's
documents form a stream in an order given by a hash, pass after pass up to the cap; the place of a document in the
stream, in tokens, is inverted through the integral to the time at which it is due, and all uses are range-sorted by it.

Running token counts are built from bounded buckets of the hash order, so a source with a third of all documents is
never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvasir.operators.joins import skew_left_join

BUCKET_ROWS = 20_000
ORDER_BITS = 40


def mix(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 17, steepness: float = 0.8) -> DataFrame:
    """``position, doc_id, source, repeat, tokens``, sorted by position: the uses of documents that make up the mix.

    ``docs`` has ``doc_id, source, tokens``; ``targets`` has ``source, target_share, max_repeats``. The total is
    ``total_tokens`` or, if None, the most that the caps allow; a larger demand is cut to that. A use belongs to the mix
    if its middle lies within the source's demand, so each share is met to half a document. ``repeat`` counts a
    document's uses from 1. Documents without a source or tokens, or of a source without a target, are left out, repeated
    ``doc_id``s count once, and a target whose source has no tokens, or an empty table, leaves nothing to mix. Scarcer
    sources gain weight over time, by up to ``steepness``; ties in position are ordered by source, id and repeat.
    """
    docs = docs.select("doc_id", "source", "tokens").where("source is not null and tokens > 0").dropDuplicates(["doc_id"])
    plan = schedule(docs, targets, total_tokens, steepness)
    uses = skew_left_join(docs, plan, "source").where("passes > 0")
    uses = uses.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "repeat", F.lit(seed)), 64 - ORDER_BITS)
    uses = uses.withColumn("place", place).withColumn("bucket", F.shiftright(F.col("place") * F.col("buckets"), ORDER_BITS))
    key = ["source", "repeat", "bucket"]
    sums = uses.groupBy(key).agg(F.sum("tokens").alias("own"))
    past = Window.partitionBy("source", "repeat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("own").over(past), F.lit(0)).alias("past"))
    within = Window.partitionBy(*key).orderBy("place", "doc_id")
    uses = uses.withColumn("run", F.sum("tokens").over(within)).join(sums, key)
    middle = (F.col("repeat") - 1) * F.col("size") + F.col("past") + F.col("run") - F.col("tokens") / 2
    uses = uses.withColumn("y", middle / F.col("demand")).where("y <= 1")
    a = F.col("slope")
    position = 2 * F.col("y") / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * F.col("y")))
    return uses.select(position.alias("position"), "doc_id", "source", "repeat", "tokens").orderBy("position", "source", "doc_id", "repeat")


def schedule(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, steepness: float = 0.8) -> DataFrame:
    """``source, size, buckets, demand, passes, slope``: one row per target with a share; ``passes`` is how often its stream is run through."""
    have = docs.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n"))
    want = targets.where("source is not null and target_share > 0 and max_repeats > 0")
    want = want.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    both = want.join(have, "source", "left").fillna({"size": 0, "n": 0})
    most, shares = both.agg(F.min(F.col("size") * F.col("cap") / F.col("share")), F.sum("share")).first()
    total = float(most or 0)
    if total_tokens is not None:
        total = min(total, float(total_tokens))
    demand = F.col("share") * total
    rounds = demand / F.greatest(F.col("size"), F.lit(1))
    mean, spread = both.agg(F.sum(F.col("share") * rounds) / F.sum("share"), F.max(rounds)).first()
    widest = max(float(mean or 0), float(spread or 0) - float(mean or 0)) or 1.0
    slope = (rounds - float(mean or 0)) / widest * steepness
    passes = F.least(F.ceil(rounds), F.col("cap")).cast("int")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    return both.select("source", "size", buckets.alias("buckets"), demand.alias("demand"), passes.alias("passes"), slope.alias("slope"))


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, most_repeats``: what a mix comes to, one row per target."""
    got = mixed.groupBy("source").agg(
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(F.col("repeat") == 1, 1).otherwise(0)).alias("documents"),
        F.max("repeat").cast("bigint").alias("most_repeats"),
    )
    total = Window.partitionBy(F.lit(1))  # one row per source
    rows = targets.select("source", "target_share").join(got, "source", "left").fillna({"tokens": 0, "documents": 0, "most_repeats": 0})
    share = F.round(F.coalesce(F.col("tokens") / F.sum("tokens").over(total), F.lit(0.0)), 6)
    return rows.select("source", "target_share", share.alias("actual_share"), "tokens", "documents", "most_repeats")
