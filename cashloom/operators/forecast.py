"""Weekly cash position from matched and open invoices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import add_business_days, week_bucket
from ..functions.money import round_half_up, truncated

WEEKS = 13
FALLBACK_LAG_DAYS = 2
BAND_PCT = 30


def band(open_total: Column, week: Column) -> Column:
    """Half width of the band: it grows by the week to BAND_PCT of what is open."""
    return F.when(open_total > 0, truncated(truncated(open_total * week * BAND_PCT, F.lit(WEEKS - 1)), F.lit(100))).otherwise(F.lit(0)).cast("bigint")


def collection_lag(ledger: DataFrame, settlements: DataFrame, matches: DataFrame) -> DataFrame:
    """lag_days (median over all matched payments, in calendar days, or the fallback) and samples."""
    legs = matches.select("ledger_id", F.explode("payment_ids").alias("payment_id"))
    legs = legs.join(ledger.select(F.col("id").alias("ledger_id"), F.col("date").alias("_i")), "ledger_id")
    legs = legs.join(settlements.select(F.col("id").alias("payment_id"), F.col("date").alias("_p")), "payment_id")
    lag = F.datediff("_p", "_i")
    return legs.agg(F.coalesce(F.median(lag).cast("double"), F.lit(float(FALLBACK_LAG_DAYS))).alias("lag_days"), F.count(lag).alias("samples"))


def cash_forecast(ledger: DataFrame, settlements: DataFrame, matches: DataFrame, exceptions: DataFrame, holidays: Sequence[dt.date]) -> DataFrame:
    """Thirteen weeks: week_index, week_start, confirmed, projected, cumulative, band_low, band_high, with
    as_of, lag_days, samples and the totals. Amounts are taken as they are, without conversion."""
    lag = collection_lag(ledger, settlements, matches)
    as_of = ledger.agg(F.max("date").alias("as_of"))
    confirmed = ledger.join(matches.select(F.col("ledger_id").alias("id")), "id", "left_semi").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("confirmed_total"))
    open_l = ledger.join(exceptions.where("ledger_id IS NOT NULL").select(F.col("ledger_id").alias("id")), "id", "left_semi")
    facts = lag.crossJoin(as_of).crossJoin(confirmed).crossJoin(open_l.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("open_total")))
    landing = add_business_days(F.col("date"), round_half_up(F.col("lag_days")).cast("int"), holidays)
    # facts is one row by construction
    landed = open_l.crossJoin(F.broadcast(lag.crossJoin(as_of))).select("amount", week_bucket(F.col("as_of"), landing, WEEKS).alias("week_index"))
    weekly = landed.groupBy("week_index").agg(F.sum("amount").alias("projected"))
    weeks = ledger.sparkSession.range(WEEKS).select(F.col("id").cast("int").alias("week_index")).join(weekly, "week_index", "left").crossJoin(F.broadcast(facts))
    here = F.when(F.col("week_index") == 0, F.col("confirmed_total")).otherwise(F.lit(0))
    rows = weeks.select("*", here.alias("confirmed"), F.coalesce("projected", F.lit(0)).alias("_projected")).drop("projected").withColumnRenamed("_projected", "projected")
    running = F.sum(F.col("confirmed") + F.col("projected")).over(W.orderBy("week_index").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("cumulative", running).withColumn("_w", band(F.col("open_total"), F.col("week_index").cast("bigint")))
    return rows.select(
        "week_index", F.date_add("as_of", F.col("week_index") * 7).alias("week_start"), "confirmed", "projected", "cumulative",
        (F.col("cumulative") - F.col("_w")).alias("band_low"), (F.col("cumulative") + F.col("_w")).alias("band_high"),
        "as_of", "lag_days", "samples", "confirmed_total", "open_total",
    )
