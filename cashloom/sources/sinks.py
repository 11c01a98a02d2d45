"""What a run hands on: payload tables, files, progress lines, a report."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import format_minor
from ..operators.reconcile import Reconciliation


def tier_counts(matches: DataFrame, exceptions: DataFrame) -> DataFrame:
    """tier, n of the matches, and unresolved: all exceptions."""
    return matches.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).unionByName(exceptions.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unresolved").alias("tier"), "n"))


def reason_counts(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def _shown(records: DataFrame, prefix: str) -> DataFrame:
    return records.select(
        F.col("id").alias(f"{prefix}_id"),
        F.struct("id", "date", format_minor(F.col("amount"), F.col("currency")).alias("amount"), "currency", "counterparty", "memo").alias(prefix),
    )


def match_payload(run: Reconciliation, threshold: float) -> DataFrame:
    """Matches with their records as a dashboard shows them, and whether the threshold clears them."""
    payments = run.matches.select("ledger_id", F.explode("payment_ids").alias("payment_id")).join(_shown(run.payments, "payment"), "payment_id")
    listed = payments.groupBy("ledger_id").agg(F.array_sort(F.collect_list("payment")).alias("payments"))
    rows = run.matches.join(_shown(run.ledger, "ledger"), "ledger_id", "left").join(listed, "ledger_id", "left")
    return rows.withColumn("auto_cleared", F.col("confidence") >= threshold)


def exception_page(exceptions: DataFrame, reason: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, dict]:
    """A page of exceptions in their order, and total, has_more, next_offset."""
    limit, offset = max(1, min(200, limit)), max(0, offset)
    found = exceptions if reason is None else exceptions.where(F.col("reason") == reason)
    total = found.count()
    more = offset + limit < total
    return found.orderBy("part", "seq").offset(offset).limit(limit), {"total": total, "has_more": more, "next_offset": offset + limit if more else None}


def write_run(run: Reconciliation, path: str, threshold: float, fmt: str = "parquet") -> None:
    for name, df in {"matches": match_payload(run, threshold), "exceptions": run.exceptions, "ties": run.ties, "decisions": run.decisions}.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def ndjson(write: Callable[[str], None]) -> Callable[[str, str], None]:
    """A progress callback that writes one JSON line for each event."""
    return lambda tier, label: write(json.dumps({"kind": "tier", "tier": tier, "label": label}) + "\n")


def dashboard(stats: DataFrame, tiers: DataFrame, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Cost for 1,000 records, each tier's share of the invoices, and each class's band."""
    cost = stats.select(F.when(F.col("records") > 0, F.col("cost_usd") / F.col("records") * 1000).otherwise(0.0).alias("cost_per_1000"))
    shares = tiers.crossJoin(F.broadcast(stats.select("ledger_rows"))).select("tier", (F.col("n") / F.greatest(F.lit(1), F.col("ledger_rows"))).alias("share"))
    bands = classes and classes.withColumn("band", F.when(F.col("accuracy") >= 0.9, "good").when(F.col("accuracy") >= 0.6, "fair").otherwise("poor"))
    return cost, shares, bands


def band_width(forecast: DataFrame) -> DataFrame:
    """A forecast with how wide its band is in each week."""
    return forecast.withColumn("band_width", F.col("band_high") - F.col("band_low"))


def last_decisions(decisions: DataFrame, seq: str) -> DataFrame:
    """One decision for each subject: the last by ``seq``."""
    last = decisions.groupBy("subject_id").agg(F.max_by(F.struct(*decisions.columns), seq).alias("_d"))
    return last.select("_d.*")


def report(run: Reconciliation) -> str:
    """Counts by tier and reason as plain text."""
    lines = [f"run {run.dataset_id}: {run.seconds:.1f} s, agent {run.agent.status}"]
    lines += [f"  {r.tier}: {r.n}" for r in tier_counts(run.matches, run.exceptions).orderBy("tier").collect()]
    lines += [f"  open, {r.reason}: {r.n}" for r in reason_counts(run.exceptions).collect()]
    return "\n".join(lines)
