"""Scoring against truth. The engine never imports this package."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import CLASSES, THRESHOLDS
from ..operators.shared import saved

Comparator = Callable[[Column, Column], Column]
PRECISION_TARGET = 0.995


def same_payments(claimed: Column, true: Column) -> Column:
    """Equal as multisets."""
    return F.array_sort(claimed) == F.array_sort(true)


def judged(matches: DataFrame, exceptions: DataFrame, truth: DataFrame, compare: Comparator = same_payments) -> DataFrame:
    """Every invoice of ``truth`` (ledger_id, payment_ids, class), and claims beyond it, with its claim's
    confidence, whether the claim is right, and whether an exception declines it."""
    claim = matches.select("ledger_id", F.col("payment_ids").alias("_claimed"), "confidence")
    declined = exceptions.where("ledger_id IS NOT NULL").select("ledger_id").distinct().withColumn("declined", F.lit(True))
    rows = truth.withColumn("known", F.lit(True)).join(claim, "ledger_id", "full").join(declined, "ledger_id", "left")
    matchable = F.coalesce(F.size("payment_ids") > 0, F.lit(False))
    right = matchable & F.coalesce(compare(F.col("_claimed"), F.col("payment_ids")), F.lit(False))
    return rows.select(
        "ledger_id", "class", F.coalesce("known", F.lit(False)).alias("known"), matchable.alias("matchable"), "confidence",
        right.alias("right"), F.coalesce("declined", F.lit(False)).alias("declined"),
    )


def curve(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One row for each threshold, all from one pass over :func:`judged` rows."""
    # The thresholds are a short fixed list: each row is repeated once for every one of them.
    wide = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    claimed = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    refused = ~claimed & F.col("known") & (F.col("declined") | F.col("confidence").isNotNull())

    def total(test: Column, name: str) -> Column:
        return F.sum(F.when(test, 1).otherwise(0)).cast("bigint").alias(name)

    sums = wide.groupBy("threshold").agg(
        total(claimed, "claimed"), total(claimed & F.col("right"), "correct"), total(F.col("matchable"), "_matchable"), total(F.col("known"), "_ledger"),
        total(refused & F.col("matchable"), "false_exceptions"), total(refused & ~F.col("matchable"), "correctly_declined"),
    )
    precision = F.when(F.col("claimed") == 0, 1.0).otherwise(F.col("correct") / F.col("claimed"))
    recall = F.when(F.col("_matchable") == 0, 0.0).otherwise(F.col("correct") / F.col("_matchable"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    rate = F.when(F.col("_ledger") == 0, 0.0).otherwise(F.col("claimed") / F.col("_ledger"))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    return out.select(
        "threshold", "claimed", "correct", (F.col("claimed") - F.col("correct")).alias("wrong"), "precision", "recall", f1.alias("f1"),
        rate.alias("auto_clear"), "false_exceptions", "correctly_declined",
    )


def operating_point(points: DataFrame, target: float = PRECISION_TARGET) -> DataFrame:
    """The row of :func:`curve` with the highest auto-clear rate that meets the target, the lowest threshold of
    equal ones; if none does, the most precise one, with target_missed."""
    good = (F.col("precision") >= target) & (F.col("claimed") > 0)
    key = F.when(good, F.struct(F.lit(1).alias("g"), F.col("auto_clear").alias("v"), (-F.col("threshold")).alias("t"))).otherwise(
        F.struct(F.lit(0).alias("g"), F.col("precision").alias("v"), (-F.col("threshold")).alias("t"))
    )
    best = points.select(key.alias("k"), F.struct(*points.columns).alias("p")).agg(F.max_by("p", "k").alias("p"), F.max("k.g").alias("g"))
    return best.select("p.*", (F.col("g") == 0).alias("target_missed"))


def by_class(rows: DataFrame, threshold: float) -> DataFrame:
    """class, total, correct, accuracy in the order of CLASSES, without empty ones. For an invoice that
    nothing matches, declining is right."""
    claimed = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    right = F.when(F.col("matchable"), claimed & F.col("right")).otherwise(~claimed & F.col("declined"))
    out = rows.where("known").groupBy("class").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(right, 1).otherwise(0)).cast("bigint").alias("correct"))
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("class"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total")).orderBy(place)


def ceiling(truth: DataFrame) -> DataFrame:
    """Share of invoices that have a match at all."""
    return truth.agg(F.coalesce(F.avg((F.size("payment_ids") > 0).cast("double")), F.lit(0.0)).alias("ceiling"))


def class_counts(truth: DataFrame) -> DataFrame:
    """class, n for every class, also absent ones."""
    spine = truth.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    return spine.join(truth.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def score_orders(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Standing orders: one row of counts, precision and recall over trans_id."""
    rows = results.alias("r").join(truth.alias("t"), "trans_id")
    claimed, real = F.col("r.order_id").isNotNull(), F.col("t.order_id").isNotNull()
    right = claimed & real & (F.col("r.order_id") == F.col("t.order_id"))

    def n(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0)).cast("bigint")

    sums = rows.agg(
        F.count(F.lit(1)).alias("scored"), n(right).alias("correct"), n(claimed & ~F.coalesce(right, F.lit(False))).alias("wrong"),
        n(~claimed & real).alias("missed"), n(~claimed & ~real).alias("correctly_declined"),
    )
    made, there = F.col("correct") + F.col("wrong"), F.col("correct") + F.col("missed") + F.col("wrong")
    return sums.select("*", F.when(made == 0, 1.0).otherwise(F.col("correct") / made).alias("precision"), F.when(there == 0, 0.0).otherwise(F.col("correct") / there).alias("recall"))


def score_allocations(results: DataFrame, true_keys: DataFrame, own_keys: DataFrame) -> DataFrame:
    """Two-way results (b_id, a_id) by allocation key: ``true_keys`` (b_id, key), ``own_keys`` (a_id, key). A row
    can be matched only if its key is present among ``own_keys``."""
    present = own_keys.where("key IS NOT NULL").select(F.col("key").alias("true_key")).distinct().withColumn("_p", F.lit(True))
    rows = results.join(true_keys.select("b_id", F.col("key").alias("true_key")), "b_id", "left").join(own_keys.select("a_id", F.col("key").alias("own_key")), "a_id", "left")
    rows = rows.join(present, "true_key", "left")
    made, can = F.col("a_id").isNotNull(), F.col("_p").isNotNull()
    right = F.coalesce(made & (F.col("own_key") == F.col("true_key")), F.lit(False))

    def n(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")

    sums = rows.agg(
        F.count(F.lit(1)).alias("scored"), n(right).alias("correct"), n(made & ~right).alias("wrong"), n(~made & can).alias("missed"),
        n(~made & ~can).alias("correctly_declined"), n(can).alias("_can"), n(made).alias("_made"),
    )
    return sums.select(
        "scored", "correct", "wrong", "missed", "correctly_declined", F.when(F.col("_made") == 0, 1.0).otherwise(F.col("correct") / F.col("_made")).alias("precision"),
        F.when(F.col("_can") == 0, 0.0).otherwise(F.col("correct") / F.col("_can")).alias("recall"),
        F.when(F.col("scored") == 0, 0.0).otherwise(F.col("_can") / F.col("scored")).alias("ceiling"),
    )


def threshold_for(points: DataFrame, targets: Sequence[float]) -> DataFrame:
    """For each precision target the lowest threshold of ``points`` that meets it and claims anything."""
    wide = points.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    return wide.groupBy("target").agg(F.min(F.when((F.col("precision") >= F.col("target")) & (F.col("claimed") > 0), F.col("threshold"))).alias("threshold"))


def ablation_stats(runs: DataFrame) -> DataFrame:
    """``runs`` (seed, rung, label, recall, precision) to one row a rung: mean, population deviation, least and
    most recall, mean gain over the rung before within a seed, and whether that is inside the noise."""
    before = F.lag("recall").over(W.partitionBy("seed").orderBy("rung"))
    rows = runs.withColumn("gain", F.coalesce(F.col("recall") - before, F.lit(0.0)))
    out = rows.groupBy("rung", "label").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("recall").alias("recall_mean"), F.stddev_pop("recall").alias("recall_sd"), F.min("recall").alias("recall_min"),
        F.max("recall").alias("recall_max"), F.avg("precision").alias("precision_mean"), F.avg("gain").alias("gain_mean"),
    )
    return out.withColumn("gain_within_noise", (F.col("rung") > 0) & (F.abs("gain_mean") < F.col("recall_sd")))


#: Values of a group that are ranked in one array; larger groups are narrowed first.
RANKED = 100_000
_BUCKETS = 4_096


def percentiles(rows: DataFrame, group: str, value: str, percents: Sequence[float], ranked: int = RANKED) -> DataFrame:
    """``group`` and p<percent>: the values of nearest rank, rounded down, of each group (nulls apart).

    Groups of at most ``ranked`` values are sorted as arrays. For each rank of a larger one the range that
    holds it is cut into buckets of equal width, whose counts tell in which it lies; that bucket's least and
    greatest value are the next range. So no task ever holds such a group, and each pass reads its rows once.
    """
    rows = rows.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sizes = saved(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")), "sizes")
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.least(F.col("n") - 1, F.floor(F.lit(p) / 100 * F.col("n"))).alias("rank")) for p in percents])
    few_of = sizes.where(F.col("n") <= ranked).select(F.col("_g").alias("_own"))
    small = rows.join(few_of, F.col("_g").eqNullSafe(F.col("_own")), "left_semi").groupBy("_g").agg(F.collect_list("_v").alias("_a"))
    found = small.select("_g", *[percentile_floor(F.col("_a"), p).alias(f"p{p}") for p in percents])
    live = saved(sizes.where(F.col("n") > ranked).select("_g", "n", "low", "high", F.inline(ranks)), "ranks")
    if live.isEmpty():
        return found.select(F.col("_g").alias(group), *[F.col(f"`p{p}`") for p in percents])
    done = live.limit(0).select("_g", "p", F.col("low").alias("v"))
    while not live.isEmpty():
        # Each of these groups has more than ``ranked`` rows, so their table is as much smaller than the input.
        here = rows.withColumnRenamed("_g", "_own").join(F.broadcast(live), F.col("_own").eqNullSafe(F.col("_g")) & F.col("_v").between(F.col("low"), F.col("high"))).drop("_own")
        share = F.when(F.col("high") > F.col("low"), (F.col("_v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
        bucket = F.least(F.lit(_BUCKETS - 1), F.floor(share * _BUCKETS))
        counts = here.groupBy("_g", "p", "rank", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("_g", "p").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        now = counts.withColumn("_before", before).where("rank >= _before AND rank < _before + n")
        now = saved(now.select("_g", "n", "low", "high", "p", (F.col("rank") - F.col("_before")).alias("rank")), "ranks")
        ready = (F.col("low") == F.col("high")) | (F.col("n") <= ranked)
        few = rows.withColumnRenamed("_g", "_own").join(F.broadcast(now.where(ready & (F.col("low") < F.col("high")))), F.col("_own").eqNullSafe(F.col("_g")) & F.col("_v").between(F.col("low"), F.col("high")))
        few = few.groupBy("_g", "p", "rank").agg(F.array_sort(F.collect_list("_v")).alias("_a")).select("_g", "p", F.get("_a", F.col("rank").cast("int")).alias("v"))
        done = saved(done.unionByName(few).unionByName(now.where("low = high").select("_g", "p", F.col("low").alias("v"))), "found")
        live = saved(now.where(~ready), "ranks")
    large = done.groupBy("_g").agg(*[F.max(F.when(F.col("p") == float(p), F.col("v"))).alias(f"p{p}") for p in percents])
    return found.unionByName(large).select(F.col("_g").alias(group), *[F.col(f"`p{p}`") for p in percents])


def percentile_floor(values: Column, p: float) -> Column:
    """Nearest rank, rounded down, of an aggregated array; 0 for none."""
    ranked = F.array_sort(values)
    at = F.least(F.size(ranked) - 1, F.floor(F.lit(p) / 100 * F.size(ranked)).cast("int"))
    return F.coalesce(F.get(ranked, at), F.lit(0)).cast("double")
