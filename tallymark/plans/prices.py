"""Queries on prices and backtests: a supplier's last price of a day as its close, the mean of all as benchmark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, backtest, pick
from ..sources import readers
from ..sources.stages import Stages
from .scores import _IDX, index_weights
from .snapshots import read


def closes(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    last = F.max_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))
    return li.groupBy(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker")).agg(last.alias("close"))


def calendar(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


def grid(spark, sf_dir) -> DataFrame:
    """Every ticker on all days."""
    return backtest.reindex(closes(spark, sf_dir), calendar(spark, sf_dir))


def filled(spark, sf_dir) -> DataFrame:
    """All tickers on all days, filled forward; holdings and the benchmark share it."""
    return backtest.forward_fill(grid(spark, sf_dir))


def calendar_reindex(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n_days"), F.count("close").alias("n_prices"), F.round(F.sum("close"), 2).alias("total"))


def price_long_ffill(spark, sf_dir):
    return backtest.filled_days(closes(spark, sf_dir), calendar(spark, sf_dir))


def price_unpivot(spark, sf_dir):
    """Wide matrices of 100 suppliers each (a row per day, a column per supplier), back in the long shape."""
    home = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.floor(F.col("s_suppkey") / 100).alias("block"), F.pmod("s_suppkey", F.lit(100)).alias("place")).distinct()
    wide = closes(spark, sf_dir).join(home, "ticker").groupBy("date", "block").pivot("place", list(range(100))).agg(F.first("close"))
    cells = readers.long_prices(wide, keep=("block",)).where("close IS NOT NULL")
    return cells.select("date", F.concat(F.lit("S"), (F.col("block") * 100 + F.col("ticker").cast("long")).cast("string")).alias("ticker"), "close")


def gap_islands(spark, sf_dir):
    return backtest.gaps(closes(spark, sf_dir), calendar(spark, sf_dir))


def flat_runs(spark, sf_dir):
    coarse = closes(spark, sf_dir).withColumn("close", F.floor(F.col("close") / 20000))
    return backtest.flat_runs(coarse)


def suspension_audit(spark, sf_dir):
    return backtest.suspension_audit(closes(spark, sf_dir), calendar(spark, sf_dir))


def price_coverage(spark, sf_dir):
    return backtest.price_coverage(closes(spark, sf_dir), calendar(spark, sf_dir))


#: Both sides of the published series are 100 on the first trading day from here on; the index is cash until its first entry.
BASE_DATE = "1995-02-15"


@dataclass
class Backtest:
    """Result tables of one backtest, written (rows per name and rebalance, or per trading day); None: wasn't asked for.
    by: names of its series."""

    by: tuple[str, ...]
    held: DataFrame | None = None
    diagnostics: DataFrame | None = None
    returns: DataFrame | None = None
    bench: DataFrame | None = None

    def levels(self) -> DataFrame:
        return backtest.levels(self.returns, self.bench, BASE_DATE, self.by)

    def moved(self) -> DataFrame:
        return backtest.changes(self.levels(), self.by)


def tickers(weights: DataFrame, *by: str) -> DataFrame:
    return weights.select(*by, F.col("quarter_end").alias("snapshot_date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), "weight")


def run_backtest(spark, sf_dir, weights: DataFrame | None = None, by: tuple[str, ...] = (), want: tuple[str, ...] = ("returns", "bench")) -> Backtest:
    """Prices, weights, entries and targets are written once; what the steps after them need is read from there."""
    with Stages(spark) as stages:
        w = tickers(index_weights(spark, sf_dir) if weights is None else weights, *by)
        seen, w = stages.write_together(backtest.observations(closes(spark, sf_dir)), w)
        daily = stages.write(backtest.daily_changes(seen))
        days = daily.select("date")
        entries = asof.asof_forward(w.select("snapshot_date").distinct(), days)
        aimed = stages.write(backtest.targets(w, entries, seen, by))
        spans = stages.write(backtest.periods(aimed, days, by))
        held = backtest.holdings(aimed, by)
        made = {
            "held": lambda: held, "diagnostics": lambda: backtest.holding_diagnostics(aimed, spans, seen, days, by), "returns": lambda: backtest.index_returns(held, spans, seen, days, by),
            "bench": lambda: backtest.mean_level(daily),
        }
        return Backtest(by, **dict(zip(want, stages.results_together(*[made[name]() for name in want]))))


def holdings(spark, sf_dir):
    h = run_backtest(spark, sf_dir, want=("held",)).held
    return h.select("entry_date", "ticker", F.round("weight", 8).alias("weight"), F.round("shares", 10).alias("shares"))


def holding_returns(spark, sf_dir):
    return run_backtest(spark, sf_dir, want=("returns",)).returns.select("date", "entry_date", F.round("ret", 8).alias("ret"))


def holding_diagnostics(spark, sf_dir):
    return run_backtest(spark, sf_dir, want=("diagnostics",)).diagnostics


def levels_drawdown(spark, sf_dir):
    lv = backtest.drawdown(run_backtest(spark, sf_dir).levels())
    return lv.select("date", F.round("level", 4).alias("level"), F.round("bench_level", 4).alias("bench_level"), F.round("drawdown", 6).alias("drawdown"), "start")


def perf_metrics(spark, sf_dir):
    p = backtest.performance(run_backtest(spark, sf_dir).levels()).where("side = 'index'")
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns if c != "side"])


def performance_block(spark, sf_dir):
    p = backtest.performance_table(run_backtest(spark, sf_dir).levels())
    return p.select("metric", F.round("index", 5).alias("index"), F.round("benchmark", 5).alias("benchmark"))


def tracking_table(spark, sf_dir):
    t = backtest.tracking(backtest.evaluated(run_backtest(spark, sf_dir).levels()).withColumnRenamed("start", "eval_start"), "eval_start")
    return t.select("eval_start", F.col("end").alias("eval_end"), "n_days", *[F.round(c, 5).alias(c) for c in ("correlation", "tracking_error", "tracking_difference", "beta")])


def yearly_returns(spark, sf_dir):
    y = backtest.yearly(run_backtest(spark, sf_dir).levels())
    return y.select("year", *[F.round(c, 6).alias(c) for c in ("index", "benchmark", "active_return")])


def subperiod_tracking(spark, sf_dir):
    moved = run_backtest(spark, sf_dir).moved()
    period = F.when(F.year("date") < 1997, "early").when(F.year("date") < 2000, "middle").otherwise("late")
    t = backtest.tracking(moved.withColumn("period", period), "period").where("n_days >= 5")
    return t.select("period", "start", "end", "n_days", *[F.round(c, 5).alias(c) for c in ("correlation", "tracking_error", "tracking_difference", "beta", "alpha", "index_cagr", "bench_cagr")])


def rolling_tracking(spark, sf_dir):
    r = backtest.rolling_tracking(run_backtest(spark, sf_dir).moved())
    return r.select("date", *[F.round(c, 4).alias(c) for c in ("correlation", "beta", "tracking_error", "mean_active")])


def active_summary(spark, sf_dir):
    a = backtest.active_summary(run_backtest(spark, sf_dir).moved())
    return a.select("n_days", *[F.round(c, 6).alias(c) for c in a.columns if c not in ("n_days", "correlation")])


def latest_prices(spark, sf_dir):
    return pick.keep_first(closes(spark, sf_dir), ["ticker"], F.col("date").desc())


_CLOSE = """closes AS (SELECT CAST(l_shipdate AS DATE) AS date, 'S' || l_suppkey AS ticker, l_extendedprice AS close FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1),
calendar AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"""
_GRID = f"""{_CLOSE}, few AS (SELECT * FROM closes),
grid AS (SELECT t.ticker, c.date, f.close FROM (SELECT DISTINCT ticker FROM few) t CROSS JOIN calendar c LEFT JOIN few f ON f.ticker = t.ticker AND f.date = c.date)"""
_GAPS = """span AS (SELECT *, min(date) FILTER (close IS NOT NULL) OVER (PARTITION BY ticker) AS f, max(date) FILTER (close IS NOT NULL) OVER (PARTITION BY ticker) AS l,
  row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM grid),
isle AS (SELECT ticker, date, i - row_number() OVER (PARTITION BY ticker ORDER BY date) AS g FROM span WHERE close IS NULL AND date > f AND date < l),
gaps AS (SELECT ticker, min(date) AS gap_start, max(date) AS gap_end, count(*) AS days_missing FROM isle GROUP BY ticker, g)"""
_FILL = "SELECT date, ticker, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM"


def _ret_sql(weights: str = "SELECT quarter_end AS snapshot_date, 'S' || l_suppkey AS ticker, weight FROM idx", k: str = "") -> str:
    """Holdings and daily returns over a filled grid, for each series named by the columns in k (each with a comma after it)."""
    return f"""w AS ({weights}),
entries AS (SELECT snapshot_date, min(date) AS entry_date FROM (SELECT DISTINCT snapshot_date FROM w) JOIN calendar ON date >= snapshot_date GROUP BY 1),
hgrid AS (SELECT t.ticker, c.date, h.close FROM (SELECT DISTINCT ticker FROM w) t CROSS JOIN calendar c LEFT JOIN closes h ON h.ticker = t.ticker AND h.date = c.date),
px AS ({_FILL} hgrid),
aimed AS (SELECT {k}snapshot_date, entry_date, w.ticker AS ticker, weight, px.close FROM w JOIN entries USING (snapshot_date) LEFT JOIN px ON px.ticker = w.ticker AND px.date = entry_date QUALIFY snapshot_date = max(snapshot_date) OVER (PARTITION BY {k}entry_date)),
h AS (SELECT {k}snapshot_date, entry_date, ticker, weight / sum(weight) OVER (PARTITION BY {k}entry_date) AS weight, weight / sum(weight) OVER (PARTITION BY {k}entry_date) / close AS shares FROM aimed WHERE close > 0),
per AS (SELECT {k}entry_date, lead(entry_date) OVER ({f"PARTITION BY {k[:-2]} " if k else ""}ORDER BY entry_date) AS exit_date FROM (SELECT DISTINCT {k}entry_date FROM aimed)),
val AS (SELECT {k}entry_date, date, sum(shares * close) AS value FROM h JOIN per USING ({k}entry_date) JOIN px USING (ticker) WHERE date >= entry_date AND (exit_date IS NULL OR date <= exit_date) GROUP BY ALL),
rets AS (SELECT * FROM (SELECT {k}date, entry_date, value / lag(value) OVER (PARTITION BY {k}entry_date ORDER BY date) - 1 AS ret FROM val) WHERE ret IS NOT NULL)"""


def _level_sql(k: str = "") -> str:
    """Levels from the base day on, their changes (moved) and those from the index's start on (ev)."""
    part = f"PARTITION BY {k[:-2]} " if k else ""
    on = " AND ".join(f"r.{c} = d.{c}" for c in k.replace(" ", "").split(",") if c)
    return f"""bgrid AS (SELECT t.ticker, c.date, h.close FROM (SELECT DISTINCT ticker FROM closes) t CROSS JOIN calendar c LEFT JOIN closes h ON h.ticker = t.ticker AND h.date = c.date),
bm AS (SELECT date, avg(close) AS close FROM ({_FILL} bgrid) GROUP BY date),
span AS (SELECT {k}min(date) AS start, max(date) AS stop FROM rets {f"GROUP BY {k[:-2]}" if k else ""}),
d AS (SELECT {k}date, close, start FROM bm JOIN span ON date <= stop AND date >= DATE '{BASE_DATE}'),
g AS (SELECT {", ".join(f"d.{c}" for c in ("date", "close", "start", *[c for c in k.replace(" ", "").split(",") if c]))}, CASE WHEN d.date <= start THEN 1 ELSE 1 + coalesce(ret, 0) END AS growth FROM d LEFT JOIN rets r ON r.date = d.date {"AND " + on if on else ""}),
lv AS (SELECT {k}date, start, 100 * product(growth) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS level, 100 * close / first_value(close) OVER ({part}ORDER BY date) AS bench_level FROM g),
moved AS (SELECT *, level / lag(level) OVER ({part}ORDER BY date) - 1 AS ret, bench_level / lag(bench_level) OVER ({part}ORDER BY date) - 1 AS bench FROM lv),
ev AS (SELECT * REPLACE (CASE WHEN date > start THEN ret END AS ret, CASE WHEN date > start THEN bench END AS bench) FROM moved WHERE date >= start)"""


_RET = f"{_IDX}, {_CLOSE}, {_ret_sql()}"
_LEVEL = f"{_RET}, {_level_sql()}"
_SIDES = """both_sides AS (SELECT date, 'index' AS side, level, ret AS r FROM ev UNION ALL SELECT date, 'benchmark', bench_level, bench FROM ev),
sides AS (SELECT *, max(level) OVER (PARTITION BY side ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM both_sides),
m AS (SELECT side, arg_max(level, date) / arg_min(level, date) - 1 AS cumulative_return, pow(arg_max(level, date) / arg_min(level, date), 365.25 / (max(date) - min(date))) - 1 AS cagr,
  stddev_samp(r) * sqrt(252) AS annualized_volatility, avg(r) * 252 / (stddev_samp(r) * sqrt(252)) AS sharpe_ratio, min(level / top - 1) AS max_drawdown FROM sides GROUP BY side)"""
_B = "covar_samp(ret, bench) / var_samp(bench)"
_CAGR = "pow(arg_max({c}, date) / arg_min({c}, date), 365.25 / (max(date) - min(date))) - 1"
_IC, _BC = _CAGR.format(c="level"), _CAGR.format(c="bench_level")
ORACLES = {
    "calendar_reindex": f"WITH {_GRID} SELECT ticker, count(*) AS n_days, count(close) AS n_prices, round(sum(close), 2) AS total FROM grid GROUP BY ticker",
    "price_long_ffill": f"WITH {_GRID} SELECT * FROM ({_FILL} grid) WHERE close IS NOT NULL",
    "price_unpivot": f"WITH {_CLOSE} SELECT date, ticker, close FROM closes WHERE ticker IN (SELECT 'S' || s_suppkey FROM supplier)",
    "gap_islands": f"WITH {_GRID}, {_GAPS} SELECT *, CASE WHEN days_missing >= 20 THEN 'suspected_suspension' ELSE 'short_gap' END AS classification FROM gaps",
    "flat_runs": f"""WITH {_CLOSE}, c AS (SELECT ticker, date, floor(close / 20000) AS close FROM closes), s AS (SELECT *, coalesce(CAST(lag(close) OVER (PARTITION BY ticker ORDER BY date) = close AS INTEGER), 0) AS same FROM c),
g AS (SELECT *, sum(1 - same) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT ticker, max(run) AS longest_flat FROM (SELECT ticker, g, CAST(sum(same) AS BIGINT) AS run FROM g GROUP BY ticker, g) GROUP BY ticker""",
    "suspension_audit": f"""WITH {_GRID}, {_GAPS}, t AS (SELECT ticker, min(date) FILTER (close IS NOT NULL) AS first_valid, max(date) FILTER (close IS NOT NULL) AS last_valid, max(date) AS e, count(close) AS n_days FROM grid GROUP BY ticker),
x AS (SELECT ticker, max(days_missing) AS max_gap, count(*) AS n_gaps, count(*) FILTER (days_missing >= 20) AS n_long_gaps FROM gaps GROUP BY ticker),
c AS (SELECT ticker, count(*) FILTER (date < f) AS n_pre_listing, count(*) FILTER (close IS NULL AND date BETWEEN f AND l) AS n_interior_missing, count(*) FILTER (date > l) AS n_post_end_missing FROM span GROUP BY ticker)
SELECT ticker, first_valid, last_valid, n_days, n_pre_listing, n_interior_missing, n_post_end_missing, coalesce(max_gap, 0) AS max_gap, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_long_gaps, 0) AS n_long_gaps,
  coalesce(max_gap, 0) >= 20 AS suspected_suspension, coalesce(last_valid < e, false) AS delisted_or_data_end,
  CASE WHEN n_days = 0 THEN 'NO_DATA' WHEN last_valid < e THEN 'DELISTED_OR_DATA_END' WHEN coalesce(max_gap, 0) >= 20 THEN 'SUSPECTED_SUSPENSION' ELSE 'OK' END AS status FROM t LEFT JOIN x USING (ticker) JOIN c USING (ticker)""",
    "price_coverage": f"""WITH {_CLOSE}, s AS (SELECT ticker, count(*) AS n_obs, min(date) AS first_date, max(date) AS last_date FROM closes GROUP BY ticker)
SELECT ticker, n_obs, first_date, last_date, count(*) - n_obs AS n_missing FROM s JOIN calendar c ON c.date BETWEEN first_date AND last_date GROUP BY ticker, n_obs, first_date, last_date""",
    "holdings": f"WITH {_RET} SELECT entry_date, ticker, round(weight, 8) AS weight, round(shares, 10) AS shares FROM h",
    "holding_returns": f"WITH {_RET} SELECT date, entry_date, round(ret, 8) AS ret FROM rets",
    "holding_diagnostics": f"""WITH {_RET}, inside AS (SELECT p.entry_date, c.ticker, max(c.date) AS seen FROM per p JOIN closes c ON c.date >= p.entry_date AND (p.exit_date IS NULL OR c.date <= p.exit_date) GROUP BY ALL),
edge AS (SELECT p.entry_date, max(date) AS edge FROM per p JOIN calendar c ON c.date >= p.entry_date AND c.date < p.exit_date GROUP BY ALL)
SELECT snapshot_date AS rebalance_date, a.entry_date, count(*) AS target_constituents, count(*) FILTER (close > 0) AS priced_constituents, count(*) FILTER (close IS NULL OR close <= 0) AS pre_listing_excluded,
  count(*) FILTER (close > 0 AND seen < edge) AS delisted_to_cash_mid_period, CAST(1 AS DOUBLE) AS renorm_weight_sum, round(sum(weight) FILTER (close > 0) / sum(weight), 6) AS investable_weight_coverage,
  coalesce(string_agg(ticker, ',' ORDER BY ticker) FILTER (close IS NULL OR close <= 0), '') AS excluded_tickers
FROM aimed a LEFT JOIN inside USING (entry_date, ticker) LEFT JOIN edge USING (entry_date) GROUP BY 1, 2 HAVING sum(weight) FILTER (close > 0) > 0""",
    "levels_drawdown": f"WITH {_LEVEL} SELECT date, round(level, 4) AS level, round(bench_level, 4) AS bench_level, round(level / max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown, start FROM lv",
    "perf_metrics": f"WITH {_LEVEL}, {_SIDES} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('cumulative_return', 'cagr', 'annualized_volatility', 'sharpe_ratio', 'max_drawdown'))} FROM m WHERE side = 'index'",
    "performance_block": f"""WITH {_LEVEL}, {_SIDES}, u AS (UNPIVOT m ON cumulative_return, cagr, annualized_volatility, sharpe_ratio, max_drawdown INTO NAME metric VALUE v)
SELECT metric, round(max(v) FILTER (side = 'index'), 5) AS "index", round(max(v) FILTER (side = 'benchmark'), 5) AS benchmark FROM u GROUP BY metric""",
    "tracking_table": f"""WITH {_LEVEL} SELECT min(start) AS eval_start, max(date) AS eval_end, count(ret) AS n_days, round(corr(ret, bench), 5) AS correlation, round(stddev_samp(ret - bench) * sqrt(252), 5) AS tracking_error,
  round(({_IC}) - ({_BC}), 5) AS tracking_difference, round({_B}, 5) AS beta FROM ev""",
    "yearly_returns": f"""WITH {_LEVEL}, y AS (SELECT CAST(year(date) AS INTEGER) AS year, arg_max(level, date) / arg_min(level, date) - 1 AS i, arg_max(bench_level, date) / arg_min(bench_level, date) - 1 AS b FROM lv GROUP BY 1)
SELECT year, round(i, 6) AS "index", round(b, 6) AS benchmark, round(i - b, 6) AS active_return FROM y""",
    "subperiod_tracking": f"""WITH {_LEVEL} SELECT CASE WHEN year(date) < 1997 THEN 'early' WHEN year(date) < 2000 THEN 'middle' ELSE 'late' END AS period, min(date) FILTER (ret IS NOT NULL) AS start, max(date) AS "end", count(ret) AS n_days,
  round(corr(ret, bench), 5) AS correlation, round(stddev_samp(ret - bench) * sqrt(252), 5) AS tracking_error, round(({_IC}) - ({_BC}), 5) AS tracking_difference, round({_B}, 5) AS beta,
  round((avg(ret) - {_B} * avg(bench)) * 252, 5) AS alpha, round({_IC}, 5) AS index_cagr, round({_BC}, 5) AS bench_cagr FROM moved GROUP BY 1 HAVING count(ret) >= 5""",
    "rolling_tracking": f"""WITH {_LEVEL}, r AS (SELECT date, count(*) OVER w AS n, corr(ret, bench) OVER w AS correlation, covar_samp(ret, bench) OVER w / var_samp(bench) OVER w AS beta, stddev_samp(ret - bench) OVER w * sqrt(252) AS tracking_error, avg(ret - bench) OVER w * 252 AS mean_active
  FROM moved WHERE ret IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) SELECT date, round(correlation, 4) AS correlation, round(beta, 4) AS beta, round(tracking_error, 4) AS tracking_error, round(mean_active, 4) AS mean_active FROM r WHERE n = 252""",
    "active_summary": f"""WITH {_LEVEL}, a AS (SELECT count(*) AS n_days, avg(ret - bench) AS m, stddev_samp(ret - bench) AS v, avg(CAST(ret > bench AS INTEGER)) AS p, covar_samp(ret, bench) / var_pop(bench) AS b FROM moved WHERE ret IS NOT NULL)
SELECT n_days, round(m, 6) AS mean_daily, round(m * 252, 6) AS mean_annualized, round(v, 6) AS volatility_daily, round(v * sqrt(252), 6) AS volatility_annualized, round(p, 6) AS positive_ratio, round(m * 252 / (v * sqrt(252)), 6) AS information_ratio, round(b, 6) AS beta_population FROM a""",
    "latest_prices": f"WITH {_CLOSE} SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM closes GROUP BY ticker",
}
QUERIES = {n: globals()[n] for n in ORACLES}
