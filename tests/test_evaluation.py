from __future__ import annotations

import ast
from pathlib import Path

import pytest

from cashloom.evaluation import scores
from cashloom.evaluation.ablation import ablation

ROOT = Path(__file__).resolve().parents[1] / "cashloom"


@pytest.fixture(scope="module")
def fixture(spark):
    truth = spark.createDataFrame([("L1", ["P1"], "clean"), ("L2", ["P2"], "clean"), ("L3", ["P3"], "timing_drift"), ("L4", [], "true_orphan")], "ledger_id string, payment_ids array<string>, class string")
    claims = spark.createDataFrame([("L1", ["P1"], 0.99), ("L2", ["P9"], 0.9), ("L3", ["P3"], 0.6)], "ledger_id string, payment_ids array<string>, confidence double")
    return scores.judged(claims, spark.createDataFrame([("L4",)], "ledger_id string"), truth)


def test_curve(fixture):
    got = {r.threshold: r for r in scores.curve(fixture, [0.5, 0.95]).collect()}
    low, high = got[0.5], got[0.95]
    assert (low.claimed, low.correct, low.wrong, low.correctly_declined, low.auto_clear) == (3, 2, 1, 1, 0.75)
    assert low.precision == low.recall == pytest.approx(2 / 3)
    assert (high.claimed, high.precision, high.false_exceptions) == (1, 1.0, 2)


def test_operating_point(fixture):
    assert scores.operating_point(scores.curve(fixture)).first().threshold == 0.92
    missed = scores.operating_point(scores.curve(fixture, [0.5])).first()
    assert missed.target_missed and missed.threshold == 0.5


def test_by_class(fixture):
    got = {r["class"]: (r.total, r.correct) for r in scores.by_class(fixture, 0.5).collect()}
    assert got == {"clean": (2, 1), "timing_drift": (1, 1), "true_orphan": (1, 1)}


def test_ablation(spark):
    got = ablation(spark, [3], 30, rungs=2).collect()
    assert {r.rung for r in got} == {0, 1} and all(r.runs == 1 and r.recall_sd == 0 for r in got)


def test_engine_never_imports_truth_or_llm():
    for path in ROOT.rglob("*.py"):
        part = path.relative_to(ROOT).parts[0]
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            for name in names:
                assert part == "llm" or "llm" not in name.split("."), path
                assert part in ("evaluation", "plans", "api.py", "llm") or "evaluation" not in name.split("."), path
