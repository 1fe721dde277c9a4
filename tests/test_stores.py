"""Runs that stop and go on, blocking of mixed standards, status steps, representative records and small rules."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions import clean, columns
from tallymark.operators import audit, integrity, universe
from tallymark.sources import readers
from tallymark.sources.runs import Runs

D = dt.date


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


class Stopped(Exception):
    pass


def stop():
    raise Stopped


def test_runs_stopped_before_the_log_are_done_again(spark):
    """Rows of an attempt without a log aren't read, and the rerun writes over them."""
    runs = Runs(spark, folder(), "k")
    targets = spark.createDataFrame([(i,) for i in range(6)], "k int")
    asked = []

    def work(factor):
        def make(todo):
            asked.append(sorted(r.k for r in todo.select("k").collect()))
            return todo.select("k", (F.col("k") * factor).alias("v")).withColumn("_error", F.when(F.col("k") == 5, "BAD")).where("k <> 4").withColumn("_seconds", F.lit(0.5))

        return make

    assert runs.rows() is None and runs.log().count() == 0
    with pytest.raises(Stopped):
        runs.run(targets.where("k < 2"), work(100), before_log=stop)
    assert runs.last_attempt() == 0 and runs.rows() is None
    counts = runs.run(targets.where("k < 2"), work(1))
    assert (counts["target_count"], counts["existing_count"], counts["current_success"]) == (2, 0, 2) and counts["elapsed_seconds"] > 0
    with pytest.raises(Stopped):
        runs.run(targets, work(100), before_log=stop)
    counts = runs.run(targets, work(10))
    assert {k: v for k, v in counts.items() if k != "elapsed_seconds"} == {"target_count": 6, "existing_count": 2, "remaining_count": 4, "current_success": 2, "current_failure": 2, "final_success_count": 4, "final_error_count": 2}
    assert sorted((r.k, r.v) for r in runs.rows().collect()) == [(0, 0), (1, 1), (2, 20), (3, 30)]
    log = {(r.attempt, r.key): (r.status, r.n_rows, r.error) for r in runs.log().collect()}
    assert log[2, "0"] == ("skipped", 0, None) and log[2, "4"] == ("failed", 0, "NO_ROWS") and log[2, "5"] == ("failed", 0, "BAD") and log[2, "2"] == ("success", 1, None) and len(log) == 8
    assert {r.elapsed_seconds for r in runs.log().where("key = '2'").collect()} == {0.5}
    counts = runs.run(targets, work(1), retry_failed=False)
    assert counts["remaining_count"] == 0 and counts["existing_count"] == 6 and asked == [[0, 1], [0, 1], [2, 3, 4, 5], [2, 3, 4, 5], []]
    assert runs.run(targets, work(1))["current_failure"] == 2 and asked[-1] == [4, 5]


def test_a_half_written_log_does_not_count(spark):
    runs = Runs(spark, folder(), "k")
    targets = spark.createDataFrame([("a",), (None,)], "k string")
    runs.run(targets, lambda t: t.withColumn("v", F.lit(1)))
    os.remove(f"{runs.folder.removeprefix('file://')}/log/attempt=1/_SUCCESS")
    assert runs.last_attempt() == 0 and runs.log().count() == 0
    assert runs.run(targets.where("k = 'a'"), lambda t: t.withColumn("v", F.lit(2)))["final_success_count"] == 1
    assert [(r.k, r.v) for r in runs.rows().collect()] == [("a", 2)]


def test_mixed_standards_are_blocked_or_made_anew(spark):
    """A crossing row with and without restated bases, a row with mixed ratios, and one that is both."""
    names = ["revenue", "operating_income", "net_income", "assets", "liabilities"]
    us, ifrs = ["us-gaap"] * 5, ["ifrs-full"] * 5
    rows = [
        # key, standards, crossed, restated revenue, operating income, net income, assets
        ("plain", us, False, None, None, None, None),
        ("restated", ifrs, True, 50.0, 0.0, 4.0, 100.0),
        ("blocked", ifrs, True, None, None, None, None),
        ("mixed", ["us-gaap", "ifrs-full", "ifrs-full", "us-gaap", "ifrs-full"], False, None, None, None, None),
        ("both", ["ifrs-full", "ifrs-full", "us-gaap", "ifrs-full", None], True, 50.0, 5.0, 5.0, 100.0),
    ]
    values = {"revenue": 100.0, "operating_income": 20.0, "net_income": 10.0, "assets": 200.0, "liabilities": 80.0, "revenue_growth": 9.0, "operating_income_growth": 9.0, "net_income_growth": 9.0, "asset_growth": 9.0, "operating_margin": 0.2, "debt_ratio": 0.4, "roa": 0.05}
    spec = "k string, " + ", ".join(f"{m}_standard string" for m in names) + ", crossed boolean, restated_revenue double, restated_operating_income double, restated_net_income double, restated_assets double"
    df = spark.createDataFrame([(k, *s, c, *r) for k, s, c, *r in rows], spec).withColumns({n: F.lit(v) for n, v in values.items()})
    out = audit.block_mixed(df)
    got = {r.k: r for r in out.collect()}
    assert got["plain"].revenue_growth == 9 and got["plain"].roa == 0.05 and not got["plain"].decisions
    r = got["restated"]
    assert (r.revenue_growth, r.operating_income_growth, r.asset_growth) == (1.0, None, 1.0) and np.isclose(r.roa, 10 / 150) and np.isclose(r.net_income_growth, 1.5)
    assert all(got["blocked"][c] is None for c in ("revenue_growth", "net_income_growth", "asset_growth", "roa")) and got["blocked"].debt_ratio == 0.4
    assert (got["mixed"].operating_margin, got["mixed"].debt_ratio, got["mixed"].roa, got["mixed"].revenue_growth) == (None, None, None, 9.0)
    assert got["both"].roa is None and got["both"].debt_ratio == 0.4 and got["both"].revenue_growth == 1.0
    log = [tuple(x) for x in audit.decision_log(out, "k").collect()]
    assert ("restated", "roa", "RECOMPUTED_RESTATED", "RESTATED_MEAN_ASSETS") in log and ("restated", "operating_income_growth", "BLOCKED_NULLED", "NO_RESTATED_BASE") in log
    assert ("both", "roa", "BLOCKED_NULLED", "STANDARDS_DIFFER_WITHIN_ROW") in log and not any(k == "both" and f == "roa" and "MEAN" in w for k, f, _, w in log)
    assert len([1 for k, *_ in log if k == "blocked"]) == 5 and len(log) == 5 + 5 + 3 + 5


def test_one_status_step(spark):
    rows = [("ACTIVE", "KEYWORD_DECLINE", D(2026, 6, 1), D(2026, 6, 30)), ("ACTIVE", "OFFICIAL_EXIT", D(2026, 6, 10), D(2026, 6, 30)), ("ACTIVE", "OFFICIAL_EXIT", D(2026, 7, 15), D(2026, 6, 30)), ("DISCONTINUED", "OFFICIAL_EXIT", D(2026, 7, 15), D(2026, 6, 30)), ("REDUCED", "NO_NEW_INFO", None, None), ("REDUCED", "rumour", D(2026, 1, 1), D(2026, 2, 1)), (None, None, None, D(2026, 2, 1))]
    out = integrity.status_step(spark.createDataFrame(rows, "p string, k string, e date, r date"), "p", "k", "e", "r").collect()
    assert [(r.new_status, r.status_changed, r.exclusion_candidate, r.pit_ok) for r in out] == [("UNCERTAIN", True, False, True), ("DISCONTINUED", True, True, True), ("ACTIVE", False, False, False), ("DISCONTINUED", False, True, False), ("REDUCED", False, False, True), ("REDUCED", False, False, True), (None, False, False, True)]


def test_representative_modes(spark):
    spec = "k string, period_type string, pit_valid boolean, period_end date, filed date, factor_available_count int, source_fact_count int, accession string"
    rows = [
        ("a", "annual", False, D(2020, 12, 31), D(2021, 2, 1), 5, 9, "a1"), ("a", "annual", True, D(2019, 12, 31), D(2020, 2, 1), 5, 9, "a2"), ("a", "quarterly", True, D(2021, 3, 31), D(2021, 5, 1), 5, 9, "a3"),
        ("b", "quarterly", None, D(2021, 3, 31), None, 5, 9, "b1"), ("b", "quarterly", None, D(2021, 3, 31), None, 5, 10, "b0"), ("b", "quarterly", False, None, D(2022, 1, 1), 9, 9, "b2"),
    ]
    df = spark.createDataFrame(rows, spec)
    got = {m: {r.k: (r.accession, r.selection_reason) for r in universe.representative(df, "k", m).collect()} for m in ("annual_only", "annual_preferred", "latest_any")}
    assert got == {
        "annual_only": {"a": ("a2", "latest_annual_pit_valid")}, "annual_preferred": {"a": ("a2", "latest_annual_pit_valid"), "b": ("b0", "annual_missing_latest_any")},
        "latest_any": {"a": ("a3", "latest_any_pit_valid"), "b": ("b0", "latest_any")},
    }
    with pytest.raises(ValueError):
        universe.representative(df, "k", "any")


def test_first_text_observed_status_and_columns(spark):
    rows = [("a", 1, None), ("a", 2, " nan "), ("a", 3, " x "), ("a", 4, "y"), ("b", 1, "")]
    df = spark.createDataFrame(rows, "k string, n int, t string")
    assert {r.k: r.t for r in df.groupBy("k").agg(clean.first_text("t", "n").alias("t")).collect()} == {"a": "x", "b": ""}
    seen = [("OK", D(2026, 1, 2), D(2025, 3, 4)), ("OK", None, None), ("DELISTED_OR_DATA_END", D(2026, 1, 2), None), ("NO_DATA", None, D(2025, 3, 4)), (None, None, None)]
    out = spark.createDataFrame(seen, "status string, last_valid date, latest_filed date").select(audit.observed_status().alias("s")).collect()
    assert [r.s for r in out] == ["LISTED_TRADING(~2026-01-02); ACTIVE_FILER(2025-03-04)", "UNVERIFIED", "CHECK(DELISTED_OR_DATA_END)", "ACTIVE_FILER(2025-03-04)", "UNVERIFIED"]
    with pytest.raises(ValueError, match="ticker, z"):
        columns.require_columns(df, ("k", "ticker", "z"))
    assert columns.require_columns(df, ("k",)) is df


def test_candidates_and_gates(spark):
    path = f"{folder()}/a"
    rows = [(" a ", "X", "s", "120", "yes", None), ("a", "Y", "s", "90", "yes", "n"), ("b", " X", "", "bad", "1", ""), ("", "X", "s", "5", "y", ""), ("c", "Z", "s", "5", "no", "")]
    df = spark.createDataFrame(rows, "ticker string, theme string, sub_theme string, candidate_score string, include string, note string")
    df.write.option("header", True).csv(path)
    got = {r.ticker: (r.theme, r.candidate_score, r.note) for r in readers.candidates_csv(spark, path, ("X", "Y")).collect()}
    assert got == {"A": ("X", 100.0, ""), "B": ("X", 0.0, "")}
    with pytest.raises(Exception, match="unknown theme: Y"):
        readers.candidates_csv(spark, path, ("X",)).collect()
    bare = f"{folder()}/b"
    df.select("ticker", "theme").write.option("header", True).csv(bare)
    with pytest.raises(ValueError, match="candidate_score, sub_theme"):
        readers.candidates_csv(spark, bare, ("X",))
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "k string, d int")
    bad = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("a", 2, True)], "k string, d int, eligible boolean")
    assert sorted((r.k or "", r.d) for r in universe.gate(rows, bad, "k", "d").collect()) == [("", 1), ("a", 2), ("b", 1)]
    assert sorted(r.d for r in universe.shared_keys(rows, bad, "k", "d").collect()) == [1, 2]


def test_buckets_follow_the_rows(spark, monkeypatch):
    from sqlcheck import SMALL

    from tallymark.plans import snapshots, stores
    from tallymark.sources import stages

    monkeypatch.setattr(stages, "BUCKET_ROWS", 200)
    asked, bucketed = [], stages.Stages.bucketed
    monkeypatch.setattr(stages.Stages, "bucketed", lambda self, df, n, *keys: asked.append(n) or bucketed(self, df, n, *keys))
    rows = snapshots.read(spark, SMALL, "lineitem").count()
    snapshots.bucketed_fact_choice(spark, SMALL)
    assert asked == [-(-rows // 200)] * 2
    assert len(stores.fact_store_scan(spark, SMALL).inputFiles()) > 20


def test_theme_gate_moves_no_grid(spark):
    from sqlcheck import SMALL

    from tallymark.plans import reports

    plan = reports.theme_gate(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "Exchange" not in plan.split("BroadcastNestedLoopJoin")[0]


def test_panels_read_facts_written_once(spark):
    from sqlcheck import SMALL

    from tallymark.plans import filings

    assert not [f for f in filings.factor_panel(spark, SMALL).inputFiles() if "lineitem" in f]
