from __future__ import annotations

from test_sources import GOOD

from cashloom import api


def test_generated_run_is_scored(spark):
    out = api.reconcile_generated(spark, 3, 40)
    head = api.headline(out["curve"]).first()
    assert head.band in ("low", "middle", "high") and head.tone in ("good", "watch")
    assert api.nearest_point(out["curve"], 0.61).first().threshold == 0.6
    assert 0 < out["ceiling"].first()[0] <= 1 and out["classes"].count() > 1
    page = api.list_exceptions(out["run"], limit=2)
    assert len(page["items"]) <= 2 <= page["total"]
    assert api.ask(out["run"], "nothing")["id"] is None


def test_upload_is_not_scored(spark):
    out = api.upload_and_reconcile(spark, GOOD)
    assert out["error"] is None and set(out) == {"error", "run"} and out["run"].decisions.count() == 1
    assert "empty" in api.upload_and_reconcile(spark, "")["error"]
    assert api.tool_statuses()["fx.convert"] == "fixture"
