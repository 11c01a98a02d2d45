"""Queries over tables whose keys have more digits than the small tables' ones, against their SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from oracle import TABLES, compare

from cashloom.plans import registry

KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


@pytest.fixture(scope="module")
def shifted(data, tmp_path_factory) -> str:
    """The small tables with orders from 997,000 on: their invoices have six digits and seven."""
    out = tmp_path_factory.mktemp("shifted")
    for t in TABLES:
        source, target = Path(data) / f"{t}.parquet", out / f"{t}.parquet"
        if t in KEYS:
            duckdb.connect().execute(f"copy (select * replace ({KEYS[t]} + 997000 as {KEYS[t]}) from '{source}') to '{target}' (format parquet)")
        else:
            target.symlink_to(source)
    return str(out)


@pytest.mark.parametrize("name", ["set3_shared_ids", "str1_utrs", "str1_residual"])
def test_identifiers_of_long_numbers(spark, shifted, name):
    compare(spark, shifted, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", ["mat5_exact", "mat8_splits"])
def test_matches_by_references_of_long_numbers(spark, shifted, name):
    compare(spark, shifted, registry.QUERIES[name], registry.ORACLES[name])


def test_pieces_of_questions_are_not_broadcast(spark, data):
    """A table's size is guessed before its rows are cut into pieces, which may be hundreds of times as many."""
    found = registry.QUERIES["str12_find_id"](spark, data)
    found.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    pieces = [x for x in plan.splitlines() if "Join" in x and "_gram" in x]
    assert len(pieces) == 2 and all("strategy=merge" in x for x in pieces), plan
