"""Rebuilding conversations from rows of exchanges.

Rows are sessionised by their channel, the session id, in any spelling. Within a session they are ordered by time; a gap
of inactivity longer than a limit calibrated on all sessions begins a new segment of the conversation. Each row gives a
user's message and the assistant's reply, and sessions that are broken, empty or lack a reply are dropped whole.

A session may hold a third of all rows, so no step gathers a session in one task: rows are partitioned by session and
hour, positions within an hour are added to the session's running count of earlier hours (at most one row an hour and
session), and the few rows near the end of an hour are also handed to the next one, where a resend may follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.functions.blank import is_blank

HOUR = 3600
RESEND_SECONDS = 10
YEARS = (2020, 2030)
UNTIMED = 1024  # parts of a session's rows without a time
LEAST_GAP, MOST_GAP = 60, 30 * 24 * HOUR  # seconds between which the calibrated limit lies


def session_key(session: Column) -> Column:
    """The session id without surrounding white space and in lower case; null if it is blank."""
    trimmed = F.regexp_replace(session, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")
    return F.when(~is_blank(session), F.lower(trimmed))


def exchanges(df: DataFrame, slice_seconds: int = HOUR) -> DataFrame:
    """The narrow rows that conversations are built from, partitioned by session and hour, each record once.

    Texts are replaced by their digests. ``us``, microseconds, is null for a time that is absent or outside the years
    2020 to 2030. ``echo`` rows repeat the end of the hour before for the test for resends and are no exchanges.
    """
    time = F.col("createdAt").cast("timestamp_ntz")
    sound = F.year(time).between(*YEARS)
    text_bad = is_blank(F.col("query")) | is_blank(F.col("response"))
    at = F.when(sound, time)
    rows = df.select(
        session_key(F.col("sessionId")).alias("session"),
        F.col("id").cast("bigint").alias("id"),
        F.col("userId").cast("bigint").alias("user"),
        (text_bad | at.isNull()).alias("bad"),
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at).alias("us"),
        F.md5(F.concat_ws("\u0001", F.length("query").cast("string"), "query", "response")).alias("text"),
    ).where(F.col("session").isNotNull())
    # Rows without a sound time, which condemn their session, are dealt out by their id.
    spread = -1 - F.pmod(F.xxhash64("id"), F.lit(UNTIMED))
    slice_of = F.coalesce(F.floor(F.col("us") / (slice_seconds * 1_000_000)).cast("bigint"), spread)
    late = F.col("us").isNotNull() & (F.col("us") >= (slice_of + 1) * slice_seconds * 1_000_000 - RESEND_SECONDS * 1_000_000)
    rows = rows.withColumn("slice", F.explode(F.when(late, F.array(slice_of, slice_of + 1)).otherwise(F.array(slice_of))))
    rows = rows.withColumn("echo", F.coalesce(F.col("slice") > slice_of, F.lit(False)))
    return rows.repartition("session", "slice").dropDuplicates(["session", "slice", "id"])


def calibrated_gap(rows: DataFrame) -> float:
    """The inactivity in seconds that ends a segment, from the gaps of all sessions.

    Gaps are counted by half powers of two; the limit is the emptiest place between the two largest heaps of the
    histogram, the gap within a talk and the gap between talks, or ten times the longest common gap if there is one heap.
    """
    rows = rows.where("us is not null and not echo")
    w = Window.partitionBy("session", "slice").orderBy("us", "id")
    within = rows.select(((F.col("us") - F.lag("us").over(w)) / 1e6).alias("gap"))
    hours = rows.groupBy("session", "slice").agg(F.min("us").alias("begin"), F.max("us").alias("end"))
    before = F.lag("end").over(Window.partitionBy("session").orderBy("slice"))
    gaps = within.unionByName(hours.select(((F.col("begin") - before) / 1e6).alias("gap")))
    steps = F.floor(F.log2(F.greatest(F.col("gap"), F.lit(1.0))) * 2).cast("int")
    heap = {r[0]: r[1] for r in gaps.where("gap is not null").groupBy(steps.alias("step")).count().collect()}
    if not heap:
        return float(HOUR)
    counts = [heap.get(i, 0) for i in range(max(heap) + 1)]
    first = max(range(len(counts)), key=lambda i: counts[i])
    after = [i for i in range(first + 2, len(counts)) if counts[i] > 0]
    second = max(after, key=lambda i: (counts[i], i), default=None)
    if second is None:
        return float(min(MOST_GAP, max(LEAST_GAP, 10 * 2 ** ((first + 1) / 2))))
    valley = min(range(first + 1, second + 1), key=lambda i: (counts[i], -i))
    return float(min(MOST_GAP, max(LEAST_GAP, 2 ** ((valley + 1) / 2))))


def conversations(df: DataFrame, *, gap_seconds: float | None = None, slice_seconds: int = HOUR) -> DataFrame:
    """``session, segment, pos, role, id``: one row per message of each conversation that is kept.

    Session ids that differ in letter case or surrounding white space are one session; rows with a blank one belong to
    none. A conversation is dropped whole if one of its rows has a blank query or response, or no time within 2020 to
    2030, or if its rows name two users. An exchange with the texts of one of its session at most ten seconds earlier is
    a resend and left out. Order is time, then id. ``pos`` counts messages from 1 over the session, ``segment`` counts
    from 1 the stretches without a longer pause than ``gap_seconds`` (calibrated on all rows if None). Records
    delivered twice count once. Columns of other names are not read; an empty table gives no rows.
    """
    rows = exchanges(df, slice_seconds)
    limit = calibrated_gap(rows) if gap_seconds is None else gap_seconds
    same = Window.partitionBy("session", "slice", "text").orderBy("us", "id")
    before = F.col("us") - F.lag("us").over(same)
    rows = rows.withColumn("resend", F.coalesce(before <= RESEND_SECONDS * 1_000_000, F.lit(False)))
    order = Window.partitionBy("session", "slice").orderBy("us", "id")
    own = rows.where("not echo and not resend")
    own = own.withColumns({"n": F.row_number().over(order), "pause": (F.col("us") - F.lag("us").over(order)) / 1e6})
    own = own.withColumn("part", F.sum(F.when(F.col("pause") > limit, 1).otherwise(0)).over(order))

    # One row per session and hour: what the hours before it, and the whole session, come to.
    hours = rows.where("not echo").groupBy("session", "slice").agg(
        F.sum(F.when(F.col("resend"), 0).otherwise(1)).alias("n"),
        F.max("bad").alias("bad"),
        F.min("user").alias("low"),
        F.max("user").alias("high"),
    )
    inner = own.groupBy("session", "slice").agg(F.min("us").alias("begin"), F.max("us").alias("end"), F.max("part").alias("breaks"))
    hours = hours.join(inner, ["session", "slice"], "left")
    whole, past = Window.partitionBy("session"), Window.partitionBy("session").orderBy("slice")
    earlier = past.rowsBetween(Window.unboundedPreceding, -1)
    new_part = F.when((F.col("begin") - F.last("end", True).over(earlier)) / 1e6 > limit, 1).otherwise(0)
    hours = hours.withColumn("new_part", new_part).select(
        "session",
        "slice",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("past_n"),
        (F.coalesce(F.sum("breaks").over(earlier), F.lit(0)) + F.sum("new_part").over(past)).alias("past_parts"),
        (F.max("bad").over(whole) | (F.min("low").over(whole) < F.max("high").over(whole))).alias("drop"),
    )
    hours = hours.where(~F.coalesce(F.col("drop"), F.lit(False)))
    kept = own.join(hours.drop("drop"), ["session", "slice"])
    roles = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant")))))
    kept = kept.withColumn("m", roles)
    pos = 2 * (F.col("past_n") + F.col("n") - 1) + F.col("m.i") + 1
    segment = F.col("past_parts") + F.col("part") + 1
    return kept.select("session", segment.cast("bigint").alias("segment"), pos.cast("bigint").alias("pos"), F.col("m.role").alias("role"), "id")
