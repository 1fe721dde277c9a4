"""Edge rows of the operators on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions import clean, columns
from tallymark.operators import asof, backtest, facts, integrity, score, universe
from tallymark.sources import readers

D = dt.date


def test_cleaning(spark):
    rows = [("123.0", " NaN ", "ab c-1", "Yes", "1,234%"), ("", None, None, None, None), ("x-7", "<NA>", "BRK.B", "0", "inf"), ("12345678901", " a ", "z", "t", "-5.5")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    got = df.select(clean.normalize_cik("a"), clean.clean_text("b"), clean.normalize_ticker("c"), clean.parse_bool("d"), clean.safe_numeric("e")).collect()
    assert [tuple(r) for r in got] == [("0000000123", "", "ABC-1", True, 1234.0), ("", "", "", False, None), ("0000000007", "", "BRK.B", False, None), ("12345678901", "a", "Z", True, -5.5)]


def test_division(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0), (3.0, -2.0)], "a double, b double")
    assert [tuple(r) for r in df.select(clean.safe_divide("a", "b"), clean.safe_growth("a", "b")).collect()] == [(0.5, -0.5), (None, None), (None, None), (-1.5, -2.5)]


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2)], "Symbol int, x int")
    out = columns.resolve_aliases(df, {"ticker": ("symbol", "tic")}, ("ticker",))
    assert out.columns == ["ticker", "x"]
    with pytest.raises(ValueError, match="filed"):
        columns.resolve_aliases(df, {"filed": ("filing_date",)}, ("filed",))
    assert columns.order_columns(columns.ensure_columns(df, {"y": "double"}), "y").columns == ["y", "Symbol", "x"]


def test_asof_on_the_day_and_before_any_row(spark):
    rows = spark.createDataFrame([("a", D(2020, 3, 31), 1, 5.0), ("a", D(2020, 3, 31), 2, None), ("a", D(2020, 5, 1), 3, 7.0), ("b", D(2021, 1, 1), 4, 1.0)], "k string, d date, id int, v double")
    dates = spark.createDataFrame([(D(2020, 3, 31),), (D(2020, 6, 30),)], "snapshot_date date")
    snap = {(r.snapshot_date.month, r.k): r.id for r in asof.asof_backward(rows, dates, "k", "d", ["id"]).collect()}
    assert snap == {(3, "a"): 2, (6, "a"): 3}
    col = {(r.snapshot_date.month, r.k): r.v for r in asof.asof_columns(rows, dates, "k", "d", ["v"], ["id"]).collect()}
    assert col == {(3, "a"): 5.0, (6, "a"): 7.0, (3, "b"): None, (6, "b"): None}


def capped(s: list[float], cap: float) -> list[float]:
    """Cap and share out again until nothing is above."""
    s = np.maximum(np.array(s, float), 0)
    if s.max() <= 0:
        s = np.ones(len(s))
    cap = max(cap, 1 / len(s))
    fixed = np.zeros(len(s), bool)
    while True:
        w = np.where(fixed, cap, 0.0)
        left, free = 1 - w.sum(), s[~fixed].sum()
        if (~fixed).any():
            w[~fixed] = left * s[~fixed] / free if free > 0 else left / (~fixed).sum()
        over = (w > cap + 1e-12) & ~fixed
        if not over.any():
            return list(w)
        fixed |= over


def test_capped_weights_against_iteration(spark):
    rng = np.random.default_rng(3)
    cases = [list(rng.pareto(1, int(rng.integers(1, 40)))) for _ in range(60)] + [[0, 0, 0], [5], [1, 0, 0, 0], [9, 8, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], [-1.0, 2.0, 2.0]]
    rows = [(c, i, float(v)) for c, s in enumerate(cases) for i, v in enumerate(s)]
    out = score.capped_weights(spark.createDataFrame(rows, "c int, i int, s double"), ["c"], "s", 0.1, "i").collect()
    got = {(r.c, r.i): r.weight for r in out}
    for c, s in enumerate(cases):
        want = capped(s, 0.1)
        assert np.allclose([got[c, i] for i in range(len(s))], want, atol=1e-12), c
        assert abs(sum(got[c, i] for i in range(len(s))) - 1) < 1e-12


def test_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 9.0, None)] + [("b", 4.0)], "g string, v double")
    out = df.select("g", "v", score.percentile("v", ["g"]).alias("p"), score.percentile("v", ["g"], False).alias("q")).collect()
    assert sorted((r.g, r.p) for r in out if r.v is not None) == [("a", 25.0), ("a", 62.5), ("a", 62.5), ("a", 100.0), ("b", 50.0)]
    assert [r.p for r in out if r.v is None] == [None]


def test_gaps(spark):
    days = [D(2020, 1, 1) + dt.timedelta(i) for i in range(30)]
    rows = [(d, "x", None if i in (0, 5, 6, 28, 29) else 10.0 + i) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "date date, ticker string, close double")
    g = backtest.gaps(df, df, 2).collect()
    assert [(r.gap_start, r.days_missing, r.classification) for r in g] == [(days[5], 2, "suspected_suspension")]


def test_factor_panel(spark):
    rows = []
    for fy, rev in ((2019, 100.0), (2020, 150.0)):
        for tag, v in (("Revenues", rev), ("Assets", 10 * rev), ("StockholdersEquity", 4 * rev)):
            rows.append(("1", "us-gaap", tag, "USD", D(fy, 1, 1), D(fy, 12, 31), v, D(fy + 1, 2, 1), "10-K", f"a{fy}", fy, "FY"))
    rows.append(("1", "us-gaap", "SalesRevenueNet", "USD", D(2020, 1, 1), D(2020, 12, 31), 7.0, D(2021, 2, 1), "10-K", "a2020", 2020, "FY"))
    rows.append(("1", "us-gaap", "Assets", "USD", None, D(2020, 12, 31), 1.0, D(2020, 1, 1), "10-K", "bad", 2020, "FY"))
    f = facts.standardize(spark.createDataFrame(rows, "cik string, taxonomy string, tag string, unit string, start date, end date, val double, filed date, form string, accn string, fy int, fp string"))
    f = facts.financial_only(f)
    tags = [("revenue", "Revenues", 0, "flow"), ("revenue", "SalesRevenueNet", 1, "flow"), ("assets", "Assets", 0, "stock"), ("equity", "StockholdersEquity", 0, "stock")]
    a = facts.anchors(f)
    out = {r.fy: r for r in facts.factor_panel(a, facts.best_facts(a, f, tags)).collect()}
    assert abs(out[2020].asset_growth - 0.5) < 1e-12 and out[2020].source_fact_count == 3
    assert len(out) == 2 and out[2020].revenue == 150.0 and abs(out[2020].revenue_growth - 0.5) < 1e-12
    assert out[2020].liabilities == 900.0 and abs(out[2020].debt_ratio - 0.6) < 1e-12 and out[2019].revenue_growth is None and out[2020].pit_valid


def test_screen_and_grace(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 400), (3, "a", 400), (4, "a", 400)], "d int, k string, age int")
    s = score.screen(df, {"age": (F.col("age") <= 365, "FRESH", "STALE"), "none": (None, "", "")})
    assert score.stale_grace(s, "k", "d", 0) is s
    got = {r.d: (r.eligible, r.stale_grace_applied) for r in score.stale_grace(s, "k", "d", 2).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (True, True), 4: (False, False)}


def test_grace_takes_one_reason_only(spark):
    df = spark.createDataFrame([(1, "a", 5, 1), (2, "a", 400, 1), (2, "b", 400, 1), (3, "a", 400, -1)], "d int, k string, age int, v int")
    s = score.screen(df, {"age": (F.col("age") <= 365, "FRESH", "STALE_AGE"), "old": (F.col("v") > 0, "OK", "STALE_VALUE")})
    got = {(r.d, r.k): (r.decision_reason, r.stale_grace_source_date) for r in score.stale_grace(s, "k", "d", 2).collect()}
    assert got == {(1, "a"): ("ELIGIBLE", None), (2, "a"): ("ELIGIBLE_VIA_STALE_GRACE", 1), (2, "b"): ("STALE_AGE", None), (3, "a"): ("STALE_AGE | STALE_VALUE", None)}


def test_quality_of_missing_sources(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, -3.0), (1.0, 4.5), (1.0, 90.0)], "a double, n double")
    got = [r[0] for r in df.select(universe.quality_score(["a"], ["a"], F.lit(True), F.col("n"))).collect()]
    assert got == [90.0, 90.0, 95.0, 100.0]


def test_annual_choice_holds_for_a_whole_tag(spark):
    """An end with only a quarter's row goes where the tag has FY rows at another end."""
    rows = [("1", "R", D(2020, 1, 1), D(2020, 12, 31), D(2021, 2, 1), "10-K", "a", 2020, "FY", 5.0), ("1", "R", D(2021, 10, 1), D(2021, 12, 31), D(2022, 2, 1), "10-K", "b", 2021, "Q4", 6.0)]
    df = spark.createDataFrame(rows, "cik string, tag string, start date, end date, filed date, form string, accn string, fy int, fp string, val double")
    tags = [("revenue", "R", 0, "flow")]
    assert [r.accn for r in facts.latest_annual(df, tags).collect()] == ["a"]


def test_cover_facts_stay_where_nothing_else_is_left(spark):
    rows = [("1", "us-gaap", "EntityPublicFloat"), ("1", "dei", "Revenues"), ("2", None, "EntityPublicFloat"), ("2", None, "Revenues"), ("3", "us-gaap", "Assets"), ("3", "dei", "Revenues")]
    got = sorted(tuple(r) for r in facts.financial_only(spark.createDataFrame(rows, "cik string, taxonomy string, tag string")).select("cik", "tag").collect())
    assert got == [("1", "EntityPublicFloat"), ("1", "Revenues"), ("2", "Revenues"), ("3", "Assets")]


def test_quotas_over_the_target_are_trimmed(spark):
    from tallymark.operators import pick

    df = spark.createDataFrame([(i, "x" if i % 2 else "y", float(i)) for i in range(12)], "k int, theme string, s double")
    quota = spark.createDataFrame([("x", 4), ("y", 4)], "theme string, quota int")
    assert sorted(r.k for r in pick.quota_selection(df, quota, "theme", 5, F.col("s").desc(), F.col("k")).collect()) == [7, 8, 9, 10, 11]


def test_ledger_balances(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a")], "d int, n string")
    got = sorted((r.d, r.n, r.action) for r in integrity.membership_changes(m, "d", "n").collect())
    assert got == [(1, "a", "NEW_ADD"), (1, "b", "NEW_ADD"), (2, "a", "DROP"), (2, "b", "MAINTAIN"), (2, "c", "NEW_ADD"), (3, "a", "NEW_ADD"), (3, "b", "DROP"), (3, "c", "DROP")]


def test_one_to_one_raises(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate k"):
        universe.join_one_to_one(a, b, "k").collect()


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"fields": ["cik", "name"], "data": [[1, "A"], [2, null]]}')
    assert [tuple(r) for r in readers.company_master_json(spark, str(tmp_path / "m.json")).collect()] == [("1", "A"), ("2", None)]
    (tmp_path / "m.csv").write_text("cik,ticker,exchange\n0000000012,A,NYSE\n")
    assert readers.master_csv(spark, str(tmp_path / "m.csv")).first().cik == "0000000012"
    with pytest.raises(ValueError, match="no facts"):
        readers.write_facts(spark.createDataFrame([], "cik string, tag string, end date, filed date"), str(tmp_path / "f"), 2)
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    store = spark.createDataFrame([("1", "x", "2020", "2021"), ("2", "y", "2020", "2021")], "cik string, tag string, end string, filed string")
    readers.write_facts(store, str(tmp_path / "store"), 2)
    one = readers.fact_store(spark, str(tmp_path / "store"), "2").collect()
    assert [r.tag for r in one] == ["y"] and "store" in one[0].source_file and readers.fact_store(spark, str(tmp_path / "store")).count() == 2
    readers.write_both(df, str(tmp_path / "t"))
    assert readers.load_table(spark, str(tmp_path / "t.csv")).first().b == readers.load_table(spark, str(tmp_path / "t.parquet")).first().b == "x"
