"""Splits, first trading day and returns from long tables of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio

NEAR, MAX_LAG, MAX_HISTORY = 5, 7, 5


def applied_splits(prices: DataFrame, splits: DataFrame, by: str, day: str, close: str, ratio_col: str, near: int = NEAR) -> DataFrame:
    """splits with column applied: whether the prices are already corrected for it.

    The median of the near closes before the day is set against that of the near closes from it on. Without either
    side, or with a level that is not positive, the split counts as applied; a ratio that is null, not positive or about one does not.
    """
    s = splits.select(by, F.col(day).alias("__at"), finite(F.col(ratio_col)).alias("__r"))
    p = prices.where(finite(F.col(close)).isNotNull()).select(by, F.col(day).alias("__d"), F.col(close).cast("double").alias("__c"))
    both = s.join(p, by, "left").withColumn("__after", F.col("__d") >= F.col("__at"))
    dist = F.when(F.col("__after"), F.col("__d").cast("double")).otherwise(-F.col("__d").cast("double")) if dict(p.dtypes)["__d"] != "date" else F.when(F.col("__after"), F.datediff("__d", "__at")).otherwise(F.datediff("__at", "__d"))
    w = Window.partitionBy(by, "__at", "__r", "__after").orderBy(dist)
    held = both.withColumn("__k", F.row_number().over(w)).where(F.col("__d").isNull() | (F.col("__k") <= near))
    level = lambda c: F.percentile(F.when(c, F.col("__c")), F.lit(0.5))
    out = held.groupBy(by, "__at", "__r").agg(level(~F.col("__after")).alias("before"), level(F.col("__after")).alias("after"))
    step = F.ln(F.col("after") / F.col("before"))
    bad = F.col("before").isNull() | F.col("after").isNull() | (F.col("before") <= 0) | (F.col("after") <= 0)
    applied = F.when(F.col("__r").isNull() | (F.col("__r") <= 0) | (F.abs(F.col("__r") - 1) < 1e-9), False).when(bad, True).otherwise(F.abs(step) <= F.abs(step + F.ln("__r")))
    return out.select(by, F.col("__at").alias(day), F.col("__r").alias(ratio_col), applied.alias("applied"))


def split_factor(events: DataFrame, applied: DataFrame, by: str, at: str, day: str, ratio_col: str, out: str = "split_factor") -> DataFrame:
    """events with the product of the applied ratios strictly after their day, 1.0 without any."""
    s = applied.where(F.col("applied") & (F.col(ratio_col) > 0)).select(F.col(by).alias("__by"), F.col(day).alias("__at"), F.col(ratio_col).alias("__r"))
    kept = events.columns
    joined = events.join(s, (F.col(by) == F.col("__by")) & (F.col("__at") > F.col(at)), "left")
    return joined.groupBy(*kept).agg(F.coalesce(F.product("__r"), F.lit(1.0)).alias(out))


def first_day(events: DataFrame, prices: DataFrame, by: str, at: str, offer: str, day: str, open_: str, close: str, factor: str | None = None, problem: str | None = None) -> DataFrame:
    """(by, at, status, first_day, lag, open, close, return, week and month returns) of each event; one aggregation.

    problem names a column with what went wrong while an event's prices were fetched (null: nothing).
    Statuses in order: fetch_error: .., no_data, pre_event_history, no_close, late_first_trade, no_offer_price, ok.
    """
    f = F.col(factor) if factor else F.lit(1.0)
    extra = [c for c in (factor, problem) if c]
    e = events.select(by, at, offer, *extra)
    # the first trading day on or after the event
    start = e.join(prices.select(by, F.col(day).alias("__d")), by).groupBy(by, at).agg(F.min("__d").alias("history_start"), F.min(F.when(F.col("__d") >= F.col(at), F.col("__d"))).alias("first_trade_date"))
    p = prices.select(by, F.col(day).alias("__d"), F.col(open_).alias("__o"), F.col(close).alias("__c"))
    on = lambda n, c: F.min_by(c, F.when(F.col("__d") >= F.date_add("first_trade_date", n), F.col("__d")))
    got = e.join(start, [by, at], "left").join(p, by, "left").groupBy(by, at, offer, *extra, "history_start", "first_trade_date").agg(on(0, F.col("__o")).alias("o"), on(0, F.col("__c")).alias("c"), on(7, F.col("__c")).alias("c7"), on(30, F.col("__c")).alias("c30"))
    lag = F.datediff("first_trade_date", at)
    past = F.datediff(at, "history_start")
    failed = F.col(problem).isNotNull() if problem else F.lit(False)
    status = (
        F.when(failed, F.concat(F.lit("fetch_error: "), F.col(problem) if problem else F.lit(""))).when(F.col("history_start").isNull(), "no_data").when(past > MAX_HISTORY, F.concat(F.lit("pre_event_history_"), past, F.lit("d")))
        .when(F.col("c").isNull(), "no_close").when(lag > MAX_LAG, F.concat(F.lit("first_trade_"), lag, F.lit("d_after")))
        .when(F.col(offer).isNull() | (F.col(offer) <= 0), "no_offer_price").otherwise("ok")
    )
    ok = F.col("status").isin("ok", "no_offer_price")
    out = got.withColumn("status", status).withColumn("first_open", F.when(ok, F.col("o") * f)).withColumn("first_close", F.when(ok, F.col("c") * f))
    return out.select(
        by, at, "status", "history_start", "first_trade_date", F.when(ok, lag).alias("lag_days"), "first_open", "first_close",
        ratio(F.col("first_close") - F.col(offer), F.col(offer)).alias("first_return"),
        F.when(ok, ratio(F.col("c7") - F.col("c"), F.col("c"))).alias("week_return"), F.when(ok, ratio(F.col("c30") - F.col("c"), F.col("c"))).alias("month_return"),
    )


def latest_before(events: DataFrame, filings: DataFrame, by: str, at: str, day: str, keep: list[str], fallback: DataFrame | None = None) -> DataFrame:
    """events with the last filing strictly before them; fallback is asked only where filings have none."""
    def best(table):
        f = table.select(F.col(by).alias("__by"), F.col(day).alias("__d"), *keep)
        return events.select(by, at).distinct().join(f, (F.col(by) == F.col("__by")) & (F.col("__d") < F.col(at))).groupBy(by, at).agg(F.max(F.struct("__d", *keep)).alias("f"))

    out = events.join(best(filings), [by, at], "left")
    if fallback is not None:
        out = out.join(best(fallback).withColumnRenamed("f", "g"), [by, at], "left").withColumn("f", F.coalesce("f", "g"))
    return out.select(*events.columns, F.col("f.__d").alias(day), *[F.col(f"f.{c}").alias(c) for c in keep])
