"""The engine as a handful of functions: what a service or a notebook calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MatchConfig
from .evaluation.scores import by_class, ceiling, curve, judged, operating_point
from .operators import qa
from .operators.adjudicate import Client
from .operators.reconcile import Reconciliation, reconcile
from .operators.tools import Registry, default_registry
from .sources.csv_batch import parse_text
from .sources.generator import generate
from .sources.sinks import exception_page

MOST_INVOICES = 2_000


def reconcile_generated(spark: SparkSession, seed: int = 42, invoices: int = 180, cfg: MatchConfig | None = None, client: Client | None = None) -> dict:
    """A run over a generated batch, scored: run, curve, operating point, classes and ceiling."""
    batch, truth = generate(spark, seed, max(1, min(MOST_INVOICES, invoices)))
    run = reconcile(batch, cfg, client)
    rows = judged(run.matches, run.exceptions, truth)
    points = curve(rows)
    best = operating_point(points)
    return {"run": run, "curve": points, "operating": best, "classes": by_class(rows, best.first()["threshold"]), "ceiling": ceiling(truth)}


def upload_and_reconcile(spark: SparkSession, text: str, cfg: MatchConfig | None = None, client: Client | None = None) -> dict:
    """A run over an uploaded CSV, or the error that it has. There is no truth, so nothing is scored."""
    parsed = parse_text(spark, text)
    return {"error": parsed.error} if not parsed.ok else {"error": None, "run": reconcile(parsed.batch, cfg, client)}


def list_exceptions(run: Reconciliation, reason: str | None = None, limit: int = 50, offset: int = 0) -> dict:
    page, info = exception_page(run.exceptions, reason, limit, offset)
    return info | {"items": [r.asDict() for r in page.collect()]}


def ask(run: Reconciliation, question: str) -> dict:
    return qa.answer(run, question)


def tool_statuses(registry: Registry | None = None) -> dict[str, str]:
    return (registry or default_registry()).statuses()


def headline(points: DataFrame, target: float = 0.995) -> DataFrame:
    """The operating point in percent with the band of its auto-clear rate and the tone of the headline."""
    pct = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("auto_clear") * 100))
    band = F.when(pct < 50, "low").when(pct < 75, "middle").otherwise("high")
    good = (F.col("auto_clear") > 0.7) & (F.col("precision") >= target)
    return operating_point(points, target).select(
        "threshold", F.round(pct, 1).alias("auto_clear_pct"), F.round(F.col("precision") * 100, 1).alias("precision_pct"),
        band.alias("band"), F.when(good, "good").otherwise("watch").alias("tone"),
    )


def nearest_point(points: DataFrame, threshold: float) -> DataFrame:
    """The row of a curve whose threshold is nearest, the lower of two as near."""
    return points.orderBy(F.abs(F.col("threshold") - threshold), "threshold").limit(1)
