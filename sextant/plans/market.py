"""Queries over time series: as-of state, rolling and expanding features, splits and first days, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, prices, windows
from .texts import table


def asof_prior_state(spark, sf_dir):
    """The last purchase value strictly before each click of any user."""
    e = table(spark, sf_dir, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().limit(100).collect())
    left = e.where(F.col("event_type") == kinds[0]).select("event_id", "ts")
    right = e.where(F.col("event_type") == kinds[1]).select(F.col("ts").alias("of"), F.col("value").alias("state"))
    out = joins.asof_before(left, right, "ts", "of", ["state"])
    return out.select("event_id", F.date_format("matched_at", "yyyy-MM-dd HH:mm:ss").alias("matched_at"), F.round("state", 6).alias("state"))


ASOF = """with k as (select distinct event_type as t from events), a as (select event_id, ts from events where event_type = (select min(t) from k)),
b as (select ts as d, value from events where event_type = (select t from k order by t limit 1 offset 1))
select event_id, strftime(b.d, '%Y-%m-%d %H:%M:%S') as matched_at, round(b.value, 6) as state from a asof left join b on a.ts > b.d"""


def asof_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_id % 3 = 0").select("event_id", "user_id", "ts")
    right = e.where("event_id % 3 <> 0").select("user_id", F.col("ts").alias("of"), F.col("event_id").alias("state"))
    return joins.asof_before(left, right, "ts", "of", ["state"], by=["user_id"]).select("event_id", "user_id", F.coalesce("state", F.lit(-1)).alias("state"))


ASOF_USER = """with a as (select event_id, user_id, ts from events where event_id % 3 = 0), b as (select user_id, ts as d, event_id as state from events where event_id % 3 <> 0)
select a.event_id, a.user_id, coalesce(b.state, -1) as state from a asof left join b on a.user_id = b.user_id and a.ts > b.d"""


def market_rolling(spark, sf_dir):
    """Log returns of each user's values with a full ten-row window: sum and annualised deviation."""
    e = table(spark, sf_dir, "events").where("value > 0")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = e.withColumn("r", F.ln(F.col("value") / F.lag("value").over(w)))
    total, dev = windows.rolling_full(r, "r", 10, ["ts", "event_id"], ["user_id"])
    return r.select("event_id", F.round(total, 6).alias("ret"), F.round(dev * F.sqrt(F.lit(252.0)), 6).alias("vol"))


ROLLING = """with r as (select *, ln(value / lag(value) over (partition by user_id order by ts, event_id)) as r from events where value > 0),
w as (select event_id, count(r) over w as c, sum(r) over w as s, stddev_samp(r) over w as d from r window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row))
select event_id, round(case when c = 10 then s end, 6) as ret, round(case when c = 10 then d end * sqrt(252), 6) as vol from w"""


def hot_market(spark, sf_dir):
    """Orders in the 90 days up to each as seen, and whether that reaches the 2/3 quantile of all earlier ones."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    o = windows.trailing_count(o, "day", "o_orderkey", 90, "cnt")
    out = windows.expanding_quantile_flag(o, "day", "o_orderkey", "cnt", 2 / 3, 100, "hot", "threshold")
    return out.select("o_orderkey", F.col("cnt").cast("long").alias("cnt"), F.round("threshold", 4).alias("threshold"), "hot")


HOT = """with o as (select o_orderkey, o_orderdate::date as day from orders), c as (select *, row_number() over (order by day, o_orderkey) as rn,
  row_number() over (order by day, o_orderkey) - count(*) over (order by day range between unbounded preceding and interval 91 days preceding) as cnt from o),
q as (select *, quantile_cont(cnt, 2.0 / 3.0) over (order by rn rows between unbounded preceding and 1 preceding) as thr from c)
select o_orderkey, cnt, round(case when rn > 100 then thr end, 4) as threshold, case when rn > 100 then (cnt >= thr)::int::double end as hot from q"""


def _paths(spark, sf_dir):
    """Daily closes per user, and a split for each third user in the middle of the month."""
    e = table(spark, sf_dir, "events").where("value > 0").select("user_id", F.to_date("ts").alias("day"), "ts", "value")
    day = e.groupBy("user_id", "day").agg(F.min_by("value", "ts").alias("open"), F.max_by("value", "ts").alias("close"))
    users = e.select("user_id").distinct()
    splits = users.where("user_id % 3 = 0").select("user_id", F.lit("2024-01-15").cast("date").alias("day"), F.when(F.col("user_id") % 2 == 0, 2.0).otherwise(0.25).alias("ratio"))
    return day, users, splits


_DAYS = """d as (select user_id, ts::date as day, min_by(value, ts) as o, max_by(value, ts) as c from events where value > 0 group by all), u as (select distinct user_id from events where value > 0),
s as (select user_id, date '2024-01-15' as day, (case when user_id % 2 = 0 then 2.0 else 0.25 end)::double as ratio from u where user_id % 3 = 0),
nb as (select user_id, c, row_number() over (partition by user_id order by day desc) as k from d where day < date '2024-01-15'), na as (select user_id, c, row_number() over (partition by user_id order by day) as k from d where day >= date '2024-01-15'),
lv as (select user_id, ratio, (select median(c) from nb where nb.user_id = s.user_id and k <= 5) as b, (select median(c) from na where na.user_id = s.user_id and k <= 5) as a from s),
ap as (select user_id, ratio, case when a is null or b is null or a <= 0 or b <= 0 then true else abs(ln(a / b)) <= abs(ln(a / b) + ln(ratio)) end as applied from lv)"""


def split_factor(spark, sf_dir):
    day, users, splits = _paths(spark, sf_dir)
    applied = prices.applied_splits(day, splits, "user_id", "day", "close", "ratio")
    at = users.withColumn("at", F.lit("2024-01-10").cast("date"))
    return prices.split_factor(at, applied, "user_id", "at", "day", "ratio").select("user_id", "split_factor")


SPLIT = f"with {_DAYS} select u.user_id, coalesce(case when applied then ratio end, 1.0)::double as split_factor from u left join ap on ap.user_id = u.user_id"


def first_day_record(spark, sf_dir):
    day, users, splits = _paths(spark, sf_dir)
    start = day.groupBy("user_id").agg(F.min("day").alias("first"))
    at = start.select("user_id", F.date_add("first", (F.col("user_id") % 12 - 4).cast("int")).alias("at"), F.when(F.col("user_id") % 5 != 0, 50.0 + F.col("user_id") % 40).alias("offer"))
    out = prices.first_day(at, day, "user_id", "at", "offer", "day", "open", "close")
    return out.select("user_id", "status", F.coalesce("lag_days", F.lit(-1)).cast("long").alias("lag_days"), *[F.round(c, 6).alias(c) for c in ("first_open", "first_close", "first_return", "week_return", "month_return")])


FIRST_DAY = f"""with {_DAYS}, f as (select user_id, min(day) as h from d group by 1), e as (select user_id, h, h + (user_id % 12 - 4)::int as dt, case when user_id % 5 <> 0 then 50.0 + user_id % 40 end as offer from f),
t as (select e.*, (select min(day) from d where d.user_id = e.user_id and day >= dt) as ft from e),
p as (select t.*, (select min_by(o, day) from d where d.user_id = t.user_id and day >= ft) as o, (select min_by(c, day) from d where d.user_id = t.user_id and day >= ft) as c, (select min_by(c, day) from d where d.user_id = t.user_id and day >= ft + 7) as c7, (select min_by(c, day) from d where d.user_id = t.user_id and day >= ft + 30) as c30 from t),
st as (select *, ft - dt as lag, case when h is null then 'no_data' when dt - h > 5 then 'pre_event_history_' || (dt - h) || 'd' when c is null then 'no_close' when ft - dt > 7 then 'first_trade_' || (ft - dt) || 'd_after' when offer is null or offer <= 0 then 'no_offer_price' else 'ok' end as status from p),
k as (select *, status in ('ok', 'no_offer_price') as ok from st)
select user_id, status, case when ok then lag else -1 end as lag_days, round(case when ok then o end, 6) as first_open, round(case when ok then c end, 6) as first_close, round(case when ok and offer > 0 then (c - offer) / offer end, 6) as first_return,
  round(case when ok and c > 0 then (c7 - c) / c end, 6) as week_return, round(case when ok and c > 0 then (c30 - c) / c end, 6) as month_return from k"""

QUERIES = {
    "asof_prior_state": (asof_prior_state, ASOF), "asof_by_user": (asof_by_user, ASOF_USER), "market_rolling": (market_rolling, ROLLING), "hot_market": (hot_market, HOT),
    "split_factor": (split_factor, SPLIT), "first_day_record": (first_day_record, FIRST_DAY),
}
