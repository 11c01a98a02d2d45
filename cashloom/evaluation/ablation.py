"""The ablation ladder over generated batches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..config import ablation_ladder
from ..operators.reconcile import reconcile
from ..sources.generator import generate
from .scores import ablation_stats, curve, judged, operating_point


def ablation(spark: SparkSession, seeds: Iterable[int], invoices: int = 180, rungs: int | None = None) -> DataFrame:
    """Statistics over ``seeds`` of each rung's run at its operating point. Runs follow each other."""
    rows = []
    for seed in seeds:
        batch, truth = generate(spark, seed, invoices)
        for rung, (label, cfg) in enumerate(ablation_ladder()[:rungs]):
            run = reconcile(batch, cfg)
            point = operating_point(curve(judged(run.matches, run.exceptions, truth))).first()
            rows.append((seed, rung, label, point["recall"], point["precision"]))
    return ablation_stats(spark.createDataFrame(rows, "seed int, rung int, label string, recall double, precision double"))
