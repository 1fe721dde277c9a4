"""Levels, holdings, returns, diagnostics, verdicts and scenarios on hand-made frames."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import asof, audit, backtest, integrity
from tallymark.sources.stages import Stages

D = dt.date
DAY = lambda i: D(2019, 11, 1) + dt.timedelta(i)


def test_levels_from_the_base_day(spark):
    """100 and flat up to the first return's day, which isn't applied; a benchmark day without a return counts 0."""
    rets = spark.createDataFrame([(D(2020, 1, 3), 0.1), (D(2020, 1, 4), -0.5), (D(2020, 1, 6), 1.0)], "date date, ret double")
    closes = [(D(2019, 12, 30), 40.0), (D(2019, 12, 31), 50.0), (D(2020, 1, 2), 55.0), (D(2020, 1, 3), 60.0), (D(2020, 1, 4), 66.0), (D(2020, 1, 5), 66.0), (D(2020, 1, 6), 70.0), (D(2020, 1, 7), 99.0)]
    bench = spark.createDataFrame(closes, "date date, close double")
    lv = backtest.levels(rets, bench, "2019-12-31")
    rows = lv.orderBy("date").collect()
    assert [r.date.day for r in rows] == [31, 2, 3, 4, 5, 6] and {r.start for r in rows} == {D(2020, 1, 3)}
    assert np.allclose([r.level for r in rows], [100, 100, 100, 50, 50, 100])
    assert np.allclose([r.bench_level for r in rows], [100, 110, 120, 132, 132, 140])
    t = backtest.tracking(backtest.evaluated(lv)).first()
    assert (t.start, t.end, t.n_days) == (D(2020, 1, 4), D(2020, 1, 6), 3)
    ir, br = np.array([-0.5, 0, 1.0]), np.array([0.1, 0, 70 / 66 - 1])
    assert np.isclose(t.correlation, np.corrcoef(ir, br)[0, 1]) and np.isclose(t.beta, np.cov(ir, br)[0, 1] / np.var(br, ddof=1)) and np.isclose(t.tracking_error, np.std(ir - br, ddof=1) * 252**0.5)
    p = {r.side: r for r in backtest.performance(lv).collect()}
    assert np.isclose(p["index"].cumulative_return, 0) and np.isclose(p["index"].max_drawdown, -0.5) and np.isclose(p["benchmark"].cumulative_return, 70 / 60 - 1)
    assert np.isclose(p["index"].sharpe_ratio, ir.mean() * 252 / (ir.std(ddof=1) * 252**0.5))
    y = {r.year: r for r in backtest.yearly(lv).collect()}
    assert np.isclose(y[2020]["benchmark"], 140 / 110 - 1) and np.isclose(y[2019]["index"], 0)
    assert backtest.levels(rets.where("ret > 5"), bench).count() == 0


def test_levels_stay_at_nothing_after_a_total_loss(spark):
    rets = spark.createDataFrame([(D(2020, 1, k), r) for k, r in ((1, 0.0), (2, -1.0), (3, 0.5))], "date date, ret double")
    bench = spark.createDataFrame([(D(2020, 1, k), 1.0) for k in (1, 2, 3)], "date date, close double")
    assert [r.level for r in backtest.levels(rets, bench).orderBy("date").collect()] == [100.0, 0.0, 0.0]


def panel(seed):
    """Closes with gaps, late listings and early ends, weights of two series at dates of which two share an entry day."""
    rng = random.Random(seed)
    days = [DAY(i) for i in range(120) if i % 7 not in (0, 1) and not 60 <= i < 66]
    closes = []
    for k in range(9):
        first, last = (rng.randint(0, 50), rng.randint(60, 119)) if k > 2 else (0, 119)
        closes += [(d, f"T{k}", round(rng.uniform(5, 50), 2)) for d in days if DAY(first) <= d <= DAY(last) and rng.random() < 0.8]
    weights = [(s, DAY(at), f"T{k}", rng.uniform(0.1, 1)) for s in ("A", "B") for at in (5, 40, 61, 63, 90, 500) for k in range(9) if rng.random() < 0.7 or k == 0]
    return closes, weights


def by_hand(closes, weights):
    days = sorted({d for d, *_ in closes})
    real = {(d, t): c for d, t, c in closes}
    fill = {}
    for t in {t for _, t, _ in closes}:
        last = None
        for d in days:
            last = real.get((d, t), last)
            fill[d, t] = last
    snaps = sorted({d for d, *_ in weights})
    entry = {s: next((d for d in days if d >= s), None) for s in snaps}
    rets, diag = {}, {}
    dated = [s for s in snaps if entry[s]]
    for i, s in enumerate(dated):
        e, nxt = entry[s], entry[dated[i + 1]] if i + 1 < len(dated) else None
        if e == nxt:
            continue
        names = {t: w for d, t, w in weights if d == s}
        priced = {t: w for t, w in names.items() if fill.get((e, t))}
        total = sum(priced.values())
        if not priced:
            continue
        inside = [d for d in days if d >= e and (nxt is None or d <= nxt)]
        value = [sum(w / total / fill[e, t] * fill[d, t] for t, w in priced.items()) for d in inside]
        rets |= {d: (e, b / a - 1) for d, a, b in zip(inside[1:], value, value[1:], strict=False)}
        ends = [max((d for d in inside if (d, t) in real), default=None) for t in priced]
        n = sum(1 for x in ends if x and nxt and x < max(d for d in inside if d < nxt))
        diag[s] = (e, len(names), len(priced), len(names) - len(priced), n, round(total / sum(names.values()), 6), ",".join(sorted(set(names) - set(priced))))
    return rets, diag, {d: np.mean([fill[d, t] for t in {t for _, t, _ in closes} if fill[d, t]]) for d in days}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_returns_and_diagnostics_as_by_hand(spark, seed):
    closes, weights = panel(seed)
    c = spark.createDataFrame(closes, "date date, ticker string, close double")
    w = spark.createDataFrame(weights, "series string, snapshot_date date, ticker string, weight double")
    seen, days, by = backtest.observations(c), c.select("date").distinct(), ("series",)
    aimed = backtest.targets(w, asof.asof_forward(w.select("snapshot_date").distinct(), days), seen, by)
    held, spans = backtest.holdings(aimed, by), backtest.periods(aimed, days, by)
    got, diag = backtest.index_returns(held, spans, seen, days, by).collect(), backtest.holding_diagnostics(aimed, spans, seen, days, by).collect()
    for s in ("A", "B"):
        rets, want, mean = by_hand(closes, [x[1:] for x in weights if x[0] == s])
        mine = {r.date: (r.entry_date, r.ret) for r in got if r.series == s}
        assert mine.keys() == rets.keys() and all(mine[d][0] == rets[d][0] and np.isclose(mine[d][1], rets[d][1]) for d in rets)
        assert {r.rebalance_date: (r.entry_date, r.target_constituents, r.priced_constituents, r.pre_listing_excluded, r.delisted_to_cash_mid_period, r.investable_weight_coverage, r.excluded_tickers) for r in diag if r.series == s} == want
    level = {r.date: r.close for r in backtest.mean_level(backtest.daily_changes(seen)).collect()}
    assert level.keys() == mean.keys() and all(np.isclose(level[d], mean[d]) for d in mean)


def test_verdicts_by_date(spark):
    ev = spark.createDataFrame([("a", "low", D(2020, 3, 1)), ("a", "low", D(2020, 2, 1)), ("b", "discontinued", None), ("b", "low", D(2020, 1, 1)), ("z", "low", None)], "k string, kind string, evidence_date date")
    rows = spark.createDataFrame([(k, D(2020, m, 1), m) for k in ("a", "b", "c", None, "z") for m in (1, 2, 3)], "k string, day date, eligible_was int")
    pit = integrity.apply_verdicts(rows, integrity.theme_verdicts(ev, "k", "pit"), "k", "day")
    got = {(r.k, r.day.month): (r.eligible, r.eligible_reason) for r in pit.collect()}
    assert len(got) == 15 and got["a", 1] == (True, integrity.LATER) and got["a", 2] == got["a", 3] == (False, integrity.LOW)
    assert got["b", 1] == (False, integrity.DISCONTINUED) and got["c", 2] == got["z", 3] == got[None, 1] == (True, "")
    retro = integrity.apply_verdicts(rows, integrity.theme_verdicts(ev, "k", "retro"), "k", "day")
    assert {(r.k, r.day.month) for r in retro.where("NOT eligible").collect()} == {(k, m) for k in "ab" for m in (1, 2, 3)}
    with pytest.raises(ValueError):
        integrity.theme_verdicts(ev, "k", "later")


def test_scenarios_take_one_plan(spark):
    rows = spark.createDataFrame([("x", 1.0), ("y", -1.0), ("z", None)], "k string, v double")
    out = audit.scenario_rows(rows, {"A": F.lit(True), "B": F.col("v") > 0})
    assert sorted((r.scenario, r.k) for r in out.collect()) == [("A", "x"), ("A", "y"), ("A", "z"), ("B", "x")]
    w = spark.createDataFrame([("A", 1, "x", 0.6), ("A", 1, "y", 0.4), ("B", 1, "x", 1.0)], "scenario string, d int, k string, weight double")
    got = {r.scenario: (round(r.max_weight_diff, 9), r.membership_changes) for r in audit.scenario_weights(w, ("A", "B", "C"), "A", "d", "k").collect()}
    assert got == {"A": (0.0, 0), "B": (0.4, 1), "C": (0.6, 2)}


def test_scans_do_not_grow_with_scenarios(spark):
    """Steps after the gate are planned once, however many scenarios there are."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation")
    rows = spark.createDataFrame([("x", 1.0)], "k string, v double")
    assert plan(audit.scenario_rows(rows, {"A": F.lit(True)})) == plan(audit.scenario_rows(rows, {n: F.col("v") > i for i, n in enumerate("ABCDEF")}))


def test_stages_are_released(spark):
    with Stages(spark) as stages:
        table = stages.write(spark.range(5))
        kept = stages.result(table.where("id > 1"))
        at = stages.folder.removeprefix("file://")
        assert os.path.isdir(f"{at}/0") and table.count() == 5
    assert not os.path.isdir(f"{at}/0") and kept.count() == 3


def test_tracking_queries_read_each_table_once(spark):
    """What the backtest's queries return reads written tables only: a few scans, no join of prices."""
    from tallymark.plans import prices

    for name, most in (("perf_metrics", 6), ("tracking_table", 8), ("rolling_tracking", 6)):
        plan = prices.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") + plan.count("BatchScan") < 2 * most, plan.count("FileScan")


def grid_gaps(rows, days, long):
    """Missing runs over the full grid, by hand."""
    out = set()
    for t in {t for _, t, _ in rows}:
        real = {d for d, x, c in rows if x == t and c is not None}
        inside = [d for d in days if real and min(real) <= d <= max(real)]
        run = []
        for d in [*inside, None]:
            if d is not None and d not in real:
                run.append(d)
            elif run:
                out.add((t, run[0], run[-1], len(run), "suspected_suspension" if len(run) >= long else "short_gap"))
                run = []
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_as_over_the_grid(spark, seed):
    rng = random.Random(seed)
    days = [DAY(i) for i in range(60) if i % 7]
    rows = [(d, f"T{k}", None if rng.random() < 0.5 else 1.0) for k in range(6) for d in days if rng.random() < 0.7] + [(days[3], "none", None)]
    df, cal = spark.createDataFrame(rows, "date date, ticker string, close double"), spark.createDataFrame([(d,) for d in days], "date date")
    got = backtest.gaps(df, cal, 3)
    assert {tuple(r) for r in got.select("ticker", "gap_start", "gap_end", "days_missing", "classification").collect()} == grid_gaps(rows, days, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    audit_ = {r.ticker: r for r in backtest.suspension_audit(df, cal, 3).collect()}
    assert audit_["none"].status == "NO_DATA" and audit_["none"].n_days == 0 and len(audit_) == len({t for _, t, _ in rows})
    for t, r in audit_.items():
        real = sorted(d for d, x, c in rows if x == t and c is not None)
        if real:
            runs = [n for x, _, _, n, _ in grid_gaps(rows, days, 3) if x == t]
            assert (r.n_days, r.n_pre_listing, r.n_post_end_missing, r.n_interior_missing, r.max_gap, r.n_long_gaps) == (len(real), days.index(real[0]), len(days) - 1 - days.index(real[-1]), sum(runs), max(runs, default=0), sum(n >= 3 for n in runs))


def test_medians_by_narrowing_ranges(spark):
    """Few values are ordered at last: ranges are narrowed several times, over ties, extremes, NaN and missing values."""
    rng = random.Random(5)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(3001)], "even": [rng.gauss(5, 1e-9) for _ in range(2000)], "ties": [1.0] * 500 + [2.0] * 500, "one": [7.0], "two": [1.0, 4.0],
        "wide": [10.0**k * s for k in range(-300, 300, 2) for s in (1, -1)], "huge": [1.7e308, -1.7e308, 1.6e308, 5e-324, 0.0], "same": [3.0] * 400, "skew": [0.0] * 900 + [1e9 + i for i in range(901)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    out = integrity.medians(df, ["g"], "v", bins=64, most=20)
    got = {r.g: r["median"] for r in out.collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s = sorted(vs)
        assert got[g] == (s[(len(s) - 1) // 2] / 2 + s[len(s) // 2] / 2 if g != "huge" else 5e-324) or np.isclose(got[g], np.median(vs), rtol=1e-12), g
    assert integrity.medians(df.where("g = 'none'"), ["g"], "v").count() == 0
    assert {r.g: r["median"] for r in integrity.medians(df.where("g IN ('ties', 'two')"), ["g"], "v", small=0).collect()} == {"ties": 1.5, "two": 2.5}
    summary = integrity.numeric_summary(df.where("g = 'even'"), "v", bins=64, most=500).first()
    assert summary["median"] == np.median(groups["even"]) and summary["n"] == 2000


def test_fact_choice_without_a_shuffle(spark):
    """On stores bucketed by company and end the join and the window need no exchange; tags never move facts."""
    from tallymark.operators import facts
    from tallymark.plans.snapshots import _order_facts

    anchor, fact, tags = _order_facts(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Stages(spark) as stages:
            a, f = stages.bucketed(anchor, 4, "cik", "end"), stages.bucketed(fact, 4, "cik", "end")
            best = facts.best_facts(a, f, tags)
            plan = best._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "PushedFilters" in plan and "In(tag" in plan
            assert best.count() == facts.best_facts(anchor, fact, tags).count() > 0
        annual = facts.latest_annual(fact, tags)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(tag" not in annual and annual.count("Exchange") > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        facts.with_tags(fact, [("m", f"t{i}", 0, "flow") for i in range(facts.MOST_TAGS + 1)])
    assert facts.with_tags(fact, []).count() == 0


def test_tables_written_together(spark):
    """Tables written at the same time are those that one after another gives, in their order; all are deleted at the end,
    also where one of them fails."""
    from pyspark.errors import PySparkException

    frames = [spark.range(n).withColumn("n", F.lit(n)) for n in (3, 0, 1000)]
    with Stages(spark) as stages:
        tables = stages.write_together(*frames)
        assert [t.count() for t in tables] == [3, 0, 1000] and stages.write_together() == []
        kept = stages.results_together(*tables[::2])
        at = stages.folder.removeprefix("file://")
    assert [r.count() for r in kept] == [3, 1000] and not [d for d in os.listdir(at) if not d.startswith("result")]
    with pytest.raises(PySparkException), Stages(spark) as stages:
        at = stages.folder.removeprefix("file://")
        stages.write_together(spark.range(5), spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("x")))
    assert not os.path.isdir(at) or not [d for d in os.listdir(at) if os.path.exists(f"{at}/{d}/_SUCCESS")]


def test_filled_days_are_the_filled_grid(spark):
    """As the grid filled forward gives them, with missing closes and a price on a day without trade; the grid isn't made."""
    day = lambda k: D(2020, 1, k)
    prices = spark.createDataFrame([(day(2), "A", 1.0), (day(4), "A", None), (day(5), "A", 3.0), (day(3), "B", 4.0), (day(9), "B", 5.0), (day(6), "C", None)], "date date, ticker string, close double")
    calendar = spark.createDataFrame([(day(k),) for k in (1, 2, 3, 4, 5, 6, 7)], "date date")
    got = backtest.filled_days(prices, calendar)
    want = backtest.forward_fill(backtest.reindex(prices, calendar)).where("close IS NOT NULL")
    rows = lambda df: sorted((r.date, r.ticker, r.close) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 11
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Generate")[0].split("row_number")[0] and "Generate explode(sequence" in plan


def test_price_unpivot_gives_all_closes(spark):
    from sqlcheck import SMALL

    from tallymark.plans import prices

    rows = lambda df: sorted((r.date, r.ticker, r.close) for r in df.collect())
    assert rows(prices.price_unpivot(spark, SMALL)) == rows(prices.closes(spark, SMALL))
