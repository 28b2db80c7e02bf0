"""Queries of time-driven state and of event-time windows, and further relational operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.sources.tables import table
from kvasir.streaming import state as S


def _events(spark, d):
    return table(spark, d, "events")


def rate_limit_fixed(spark, d):
    return S.fixed_window_limit(_events(spark, d), "user_id", "ts", most=3, seconds=86_400).select("event_id", "window_no", "n", "allowed")


def login_lock(spark, d):
    return S.lockouts(_events(spark, d).where("event_type = 'error'"), "user_id", "ts", most=3, minutes=60 * 24 * 7)


def ext_tumbling(spark, d):
    return S.tumbling(_events(spark, d), "ts", "1 day", "event_type").withColumn("total", F.round("total", 4))


def ext_sliding(spark, d):
    return S.sliding(_events(spark, d), "ts", "2 hours", "1 hour")


def ext_session(spark, d):
    return S.sessions(_events(spark, d), "user_id", "ts", 6 * 3600)


def ext_rollup(spark, d):
    rows = _events(spark, d).rollup(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows


def ext_setops(spark, d):
    customers, buyers = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    both = customers.intersect(buyers).select(F.lit("both").alias("kind"), "c_custkey")
    return both.unionAll(customers.exceptAll(customers.intersect(buyers)).select(F.lit("idle").alias("kind"), "c_custkey"))


def ext_approx_distinct(spark, d):
    """Whether the estimated number of users of each type is within a tenth of the exact one."""
    rows = _events(spark, d).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("guess"), F.countDistinct("user_id").alias("users"))
    return rows.select("event_type", "users", (F.abs(F.col("guess") - F.col("users")) <= F.col("users") / 10).alias("close"))


def ext_json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _events(spark, d).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


QUERIES = {f.__name__: f for f in (rate_limit_fixed, login_lock, ext_tumbling, ext_sliding, ext_session, ext_rollup, ext_setops, ext_approx_distinct, ext_json_props)}
ORACLES = {
    "login_lock": """with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts) k from events where event_type = 'error' and user_id is not null and ts is not null),
        f as (select user_id, 0::bigint k, []::timestamp[] recent, null::timestamp until_, null::timestamp locked_at from (select distinct user_id from e)
          union all select user_id, k, case when skip then old when len(r) >= 3 then [] else r end, case when not skip and len(r) >= 3 then ts + interval 7 days else until_ end, case when not skip and len(r) >= 3 then ts end
            from (select e.user_id, e.k, e.ts, f.recent old, f.until_, coalesce(e.ts < f.until_, false) skip, list_append(list_filter(f.recent, lambda x: e.ts - x < interval 7 days), e.ts) r from f join e on e.user_id = f.user_id and e.k = f.k + 1))
        select user_id, locked_at from f where locked_at is not null""",
    "ext_approx_distinct": "select event_type, count(distinct user_id) users, true \"close\" from events group by 1",
    "rate_limit_fixed": """with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) k from events where user_id is not null and ts is not null),
        f as (select event_id, user_id, ts begin_, k, 1::bigint window_no, 1::bigint n from e where k = 1
          union all select e.event_id, e.user_id, case when e.ts - f.begin_ >= interval 86400 seconds then e.ts else f.begin_ end, e.k,
            case when e.ts - f.begin_ >= interval 86400 seconds then window_no + 1 else window_no end, case when e.ts - f.begin_ >= interval 86400 seconds then 1 else n + 1 end
          from f join e on e.user_id = f.user_id and e.k = f.k + 1)
        select event_id, window_no, n, n <= 3 allowed from f""",
    "ext_tumbling": "select date_trunc('day', ts) \"begin\", event_type, count(*) n, round(sum(\"value\"), 4) total from events group by all",
    "ext_sliding": """with w as (select date_trunc('hour', ts) h from events), b as (select unnest([h, h - interval 1 hour]) "begin" from w) select "begin", count(*) n from b group by all""",
    "ext_session": """with e as (select user_id, ts, event_id, case when date_diff('microsecond', lag(ts) over w, ts) >= 21600000000 then 1 else 0 end f from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(f) over (partition by user_id order by ts, event_id) run from e) select user_id, min(ts) "begin", count(*) n from s group by user_id, run""",
    "ext_rollup": "select ts::date \"day\", event_type, count(*) n from events group by rollup (ts::date, event_type)",
    "ext_setops": """select case when c_custkey in (select o_custkey from orders) then 'both' else 'idle' end kind, c_custkey from customer""",
    "ext_json_props": "select (props->>'$.k')::bigint k, count(*) n, round(avg(\"value\"), 4) mean from events group by 1",
}
