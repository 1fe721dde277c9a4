"""Queries on tag choice, extracts, standard audits, scenarios and holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit, facts, integrity
from ..sources.stages import Stages
from . import prices as p
from .scores import _index_sql, _scored_sql, index_weights
from .snapshots import _FACTS, _SUPQ, _order_facts, quarters, read, supplier_quarters


def tag_search(spark, sf_dir):
    return audit.search_tags(read(spark, sf_dir, "part").select(F.col("p_type").alias("tag")), "a")


def priority_tag(spark, sf_dir):
    return audit.priority_tag(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("tag")), ("R", "A"), "l_orderkey")


def candidate_filter(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("theme"), (F.col("c_acctbal") / 50).alias("score"), F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no").alias("include"))
    return audit.candidate_filter(c, c.select("theme")).select("c_custkey", "theme", F.round("score", 6).alias("score"))


def key_lookup(spark, sf_dir):
    asked = read(spark, sf_dir, "region").select(F.concat(F.lit(" "), F.lower("r_name")).alias("name"))
    master = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), "n_nationkey")
    return audit.key_lookup(asked, master, "name")


def panel_extension(spark, sf_dir):
    c = p.closes(spark, sf_dir)
    even, third = F.substring("ticker", 2, 9).cast("int") % 2 == 0, F.substring("ticker", 2, 9).cast("int") % 3 == 0
    return audit.extend_panel(c.where(even), c.where(third).withColumn("close", F.lit(1.0)), "ticker")


def missing_prices(spark, sf_dir):
    asked = read(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("ticker"))
    return audit.missing_keys(asked, p.closes(spark, sf_dir), "ticker")


def metadata_fill(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    master = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("theme"))
    return audit.fill_metadata(rows, master, "s_suppkey")


def extract_errors(spark, sf_dir):
    _, fact, _ = _order_facts(spark, sf_dir)
    all_ = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cik"))
    good = fact.where("tag = 'R'").select("cik").distinct()
    return audit.error_rows(all_, good, fact)


def restated_prior(spark, sf_dir):
    anchor, fact, tags = _order_facts(spark, sf_dir)
    now = anchor.select("cik", "accession_key", F.col("end").alias("prev_end"), "filed", "form", "fy", "fp", F.lit("us-gaap").alias("current_taxonomy"))
    return audit.restated_prior(now, fact.withColumn("taxonomy", F.when(F.col("form") == "10-K", "ifrs-full").otherwise("us-gaap")), tags).select("cik", "metric", F.round("restated_value", 4).alias("restated_value"))


def standard_audit(spark, sf_dir):
    anchor, fact, tags = _order_facts(spark, sf_dir)
    best = facts.best_facts(anchor, fact.withColumn("taxonomy", F.when(F.col("form") == "10-K", "ifrs-full").otherwise("us-gaap")), tags)
    return audit.standard_audit(best).select("cik", "taxonomies", "mixed", "n_metrics")


def ratio_blocking(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("a"), F.when(F.col("l_linestatus") == "F", "A").otherwise("N").alias("b"), (F.col("l_quantity") > 10).alias("mixed"), F.col("l_discount").alias("margin"))
    return audit.block_ratios(li, "mixed", {"margin": ("a", "b")}).select("l_orderkey", "l_linenumber", "l_partkey", "margin", "margin_decision")


SCENARIOS = ("A", "B_pit", "B_retro")


def _gated(spark, sf_dir, quarters_: DataFrame) -> DataFrame:
    """Quarters of suppliers with verdicts: a low balance is evidence from the first big returned shipment on, a very low
    one means discontinued."""
    bal = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 49").groupBy("l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("evidence_date"))
    low = bal.where("s_acctbal < 1000").join(returned, "l_suppkey").select("l_suppkey", F.lit("low").alias("kind"), "evidence_date")
    evidence = low.unionByName(bal.where("s_acctbal < -500").select("l_suppkey", F.lit("discontinued").alias("kind"), F.lit(None).cast("date").alias("evidence_date")))
    rows = quarters_
    for mode in ("pit", "retro"):
        rows = integrity.apply_verdicts(rows, integrity.theme_verdicts(evidence, "l_suppkey", mode), "l_suppkey", "quarter_end", mode)
    return rows


def gate_verdicts(spark, sf_dir):
    rows = _gated(spark, sf_dir, supplier_quarters(spark, sf_dir).select("l_suppkey", "quarter_end"))
    return rows.select("l_suppkey", "quarter_end", "pit", "pit_reason", "retro", "retro_reason")


def scenario_comparison(spark, sf_dir):
    """Gate, score, weigh, backtest and metrics once for all scenarios; weights against scenario A."""
    with Stages(spark) as stages:
        gated = stages.write(_gated(spark, sf_dir, supplier_quarters(spark, sf_dir, exact=True)))
        rows = audit.scenario_rows(gated, {"A": F.lit(True), "B_pit": F.col("pit"), "B_retro": F.col("retro")})
        weights = stages.write(index_weights(spark, sf_dir, rows, ("scenario",)))
        done = p.run_backtest(spark, sf_dir, weights, ("scenario",))
        out = gated.select(F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), (~c).cast("int").alias("x")) for n, c in (("A", F.lit(True)), ("B_pit", F.col("pit")), ("B_retro", F.col("retro")))])).alias("e"))
        gone = out.groupBy(F.col("e.scenario").alias("scenario")).agg(F.sum("e.x").alias("theme_excluded_rows"))
        levels = done.levels()
        perf = p.backtest.performance(levels, done.by).where("side = 'index'").select("scenario", *[F.round(c, 6).alias(c) for c in ("cagr", "annualized_volatility", "sharpe_ratio", "max_drawdown")])
        track = p.backtest.active_summary(p.backtest.changes(levels, done.by), "scenario").select("scenario", F.round("correlation", 6).alias("correlation"), F.round("volatility_annualized", 6).alias("tracking_error"), F.round("beta_population", 6).alias("beta"))
        diff = audit.scenario_weights(weights, SCENARIOS, "A", "quarter_end", "l_suppkey").withColumn("max_weight_diff", F.round("max_weight_diff", 8))
        return stages.result(gone.join(perf, "scenario").join(track, "scenario").join(diff, "scenario"))


def evidence_levels(spark, sf_dir):
    """Suppliers with the audit of their prices and their last order known as filing; every seventh has curated evidence."""
    seen = p.backtest.suspension_audit(p.closes(spark, sf_dir), p.calendar(spark, sf_dir)).select("ticker", "status", "last_valid")
    filed = read(spark, sf_dir, "lineitem").where("l_suppkey % 4 > 0").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker")).agg(F.to_date(F.max("l_shipdate")).alias("latest_filed"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), "s_suppkey")
    level = F.when(F.col("s_suppkey") % 2 == 0, "OFFICIAL_FILING_VERIFIED").otherwise("KEYWORD_ONLY")
    curated = s.where("s_suppkey % 7 = 0").select("ticker", level.alias("evidence_level"), F.lit("read in full").alias("evidence_note"))
    names = s.select("ticker").join(seen.where("substring(ticker, 2) % 11 > 0"), "ticker", "left").join(filed, "ticker", "left")
    return audit.evidence_levels(names, curated, "ticker").select("ticker", "evidence_level", "evidence_note", "business_status_observed", "latest_filed")


def rationale_table(spark, sf_dir):
    s = read(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("double"))
    return s.select("p_partkey", audit.rationale("p_name", "p_brand", ("price", "p_retailprice"), ("size", "size")).alias("sentence"), audit.name_map({"price": "Price", "size": "Size"}).alias("names"))


def period_strings(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return audit.group_strings(o, "o_custkey", "day")


def rolling_quarter_error(spark, sf_dir):
    return audit.rolling_error(p.run_backtest(spark, sf_dir).moved()).select("date", F.round("tracking_error", 4).alias("tracking_error"))


def interval_membership(spark, sf_dir):
    q = quarters(spark, sf_dir).withColumn("until", F.lead("snapshot_date").over(Window.orderBy("snapshot_date")))  # a row per quarter
    d = p.calendar(spark, sf_dir)
    return d.join(F.broadcast(q), (F.col("date") > F.col("snapshot_date")) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))).groupBy("snapshot_date").agg(F.count("*").alias("n_days"))


_BEST = f"""{_FACTS}, t AS (SELECT * FROM (VALUES ('amount', 'R', 0), ('amount', 'A', 1), ('open', 'N', 0)) AS t(metric, tag, tag_rank)),
p AS (SELECT o.cik, metric, f.annual AS ifrs, val, row_number() OVER (PARTITION BY o.cik, metric ORDER BY (f.annual = o.annual) DESC, (f.fy = o.fy) DESC, tag_rank, f.filed DESC, accn DESC, val) AS n
  FROM o JOIN f ON o.cik = f.cik AND f.filed <= o.filed JOIN t ON f.tag = t.tag)"""
_SK = "scenario, quarter_end"
_VERDICT = """evidence AS (SELECT s_suppkey AS l_suppkey, s_acctbal < -500 AS gone, (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem l WHERE l.l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity >= 49 AND s_acctbal < 1000) AS edate FROM supplier),
judged AS (SELECT supq.*, gone, edate FROM supq JOIN evidence USING (l_suppkey)),
srows AS (SELECT 'A' AS scenario, * FROM judged UNION ALL SELECT 'B_pit', * FROM judged WHERE NOT gone AND NOT coalesce(quarter_end >= edate, false) UNION ALL SELECT 'B_retro', * FROM judged WHERE NOT gone AND edate IS NULL)"""
ORACLES = {
    "tag_search": "SELECT DISTINCT p_type AS tag FROM part WHERE contains(lower(p_type), 'a')",
    "priority_tag": "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' ELSE 'A' END AS tag FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1",
    "candidate_filter": "SELECT c_custkey, c_mktsegment AS theme, round(least(greatest(c_acctbal / 50, 0), 100), 6) AS score FROM customer WHERE c_custkey % 2 = 0",
    "key_lookup": "SELECT upper(r_name) AS name, min(n_nationkey) AS n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "panel_extension": f"WITH {p._CLOSE}, x AS (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS k FROM closes) SELECT date, ticker, CASE WHEN k % 2 = 0 THEN close ELSE 1.0 END AS close FROM x WHERE k % 2 = 0 OR k % 3 = 0",
    "missing_prices": "SELECT 'S' || c_custkey AS ticker FROM customer WHERE c_custkey NOT IN (SELECT l_suppkey FROM lineitem)",
    "metadata_fill": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE c_name END AS name, c_mktsegment AS theme FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey",
    "extract_errors": """WITH l AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS cik, CASE WHEN l_orderkey IS NULL THEN 'NO_FACTS' ELSE 'NO_ANNUAL_VALUE' END AS error_type, l_orderkey IS NULL AS structural_error FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE NOT coalesce(r, false)""",
    "restated_prior": f"""WITH {_FACTS}, t AS (SELECT * FROM (VALUES ('amount', 'R', 0), ('amount', 'A', 1), ('open', 'N', 0)) AS t(metric, tag, tag_rank)),
p AS (SELECT o.cik, metric, val, row_number() OVER (PARTITION BY o.cik, metric ORDER BY (f.annual = o.annual) DESC, (f.fy = o.fy - 1) DESC, tag_rank, f.filed DESC, accn DESC, val) AS n FROM o JOIN f ON o.cik = f.cik AND f.filed <= o.filed AND NOT f.annual JOIN t ON f.tag = t.tag)
SELECT cik, metric, round(val, 4) AS restated_value FROM p WHERE n = 1""",
    "standard_audit": f"""WITH {_BEST} SELECT cik, string_agg(DISTINCT CASE WHEN ifrs THEN 'ifrs-full' ELSE 'us-gaap' END, '|' ORDER BY CASE WHEN ifrs THEN 'ifrs-full' ELSE 'us-gaap' END) AS taxonomies, count(DISTINCT ifrs) > 1 AS mixed, count(*) AS n_metrics FROM p WHERE n = 1 GROUP BY cik""",
    "ratio_blocking": """WITH x AS (SELECT *, l_returnflag <> CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AND l_quantity > 10 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT c THEN l_discount END AS margin, CASE WHEN c THEN 'blocked' ELSE 'unchanged' END AS margin_decision FROM x""",
    "gate_verdicts": f"""WITH {_SUPQ}, {_VERDICT} SELECT l_suppkey, quarter_end, NOT gone AND NOT coalesce(quarter_end >= edate, false) AS pit,
  CASE WHEN gone THEN 'BUSINESS_DISCONTINUED' WHEN edate IS NULL THEN '' WHEN quarter_end >= edate THEN 'THEME_DIRECTNESS_LOW' ELSE 'PIT_EVIDENCE_NOT_YET_AVAILABLE' END AS pit_reason,
  NOT gone AND edate IS NULL AS retro, CASE WHEN gone THEN 'BUSINESS_DISCONTINUED' WHEN edate IS NOT NULL THEN 'THEME_DIRECTNESS_LOW' ELSE '' END AS retro_reason FROM judged""",
    "scenario_comparison": f"""WITH {_SUPQ}, {_VERDICT}, {_scored_sql("srows", _SK, "sscored")}, {_index_sql("idx", "SELECT * FROM sscored WHERE available_factor_count >= 3", _SK)}, {p._CLOSE},
{p._ret_sql("SELECT scenario, quarter_end AS snapshot_date, 'S' || l_suppkey AS ticker, weight FROM idx", "scenario, ")}, {p._level_sql("scenario, ")},
x AS (SELECT scenario, (SELECT count(*) FROM supq) - count(*) AS theme_excluded_rows FROM srows GROUP BY 1),
f AS (SELECT scenario, round({p._IC}, 6) AS cagr, round(stddev_samp(ret) * sqrt(252), 6) AS annualized_volatility, round(avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)), 6) AS sharpe_ratio FROM ev GROUP BY 1),
dd AS (SELECT scenario, round(min(d), 6) AS max_drawdown FROM (SELECT scenario, level / max(level) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM ev) GROUP BY 1),
t AS (SELECT scenario, round(corr(ret, bench), 6) AS correlation, round(stddev_samp(ret - bench) * sqrt(252), 6) AS tracking_error, round(covar_samp(ret, bench) / var_pop(bench), 6) AS beta FROM moved GROUP BY 1),
k AS (SELECT DISTINCT quarter_end, l_suppkey FROM idx),
v AS (SELECT s.scenario, round(max(abs(coalesce(b.weight, 0) - coalesce(a.weight, 0))), 8) AS max_weight_diff, count(*) FILTER ((coalesce(a.weight, 0) > 0) <> (coalesce(b.weight, 0) > 0)) AS membership_changes
  FROM k CROSS JOIN (SELECT DISTINCT scenario FROM idx) s LEFT JOIN idx b ON b.scenario = s.scenario AND b.quarter_end = k.quarter_end AND b.l_suppkey = k.l_suppkey
  LEFT JOIN idx a ON a.scenario = 'A' AND a.quarter_end = k.quarter_end AND a.l_suppkey = k.l_suppkey GROUP BY 1)
SELECT * FROM x JOIN f USING (scenario) JOIN dd USING (scenario) JOIN t USING (scenario) JOIN v USING (scenario)""",
    "evidence_levels": f"""WITH {p._CLOSE}, t AS (SELECT ticker, max(date) AS l FROM closes GROUP BY 1), n AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM calendar),
g AS (SELECT ticker, max(d) AS g FROM (SELECT ticker, i - lag(i) OVER (PARTITION BY ticker ORDER BY i) - 1 AS d FROM closes JOIN n USING (date)) GROUP BY 1),
a AS (SELECT ticker, l, CASE WHEN l < (SELECT max(date) FROM calendar) THEN 'DELISTED_OR_DATA_END' WHEN coalesce(g, 0) >= 20 THEN 'SUSPECTED_SUSPENSION' ELSE 'OK' END AS status FROM t LEFT JOIN g USING (ticker) WHERE CAST(substr(ticker, 2) AS INTEGER) % 11 > 0),
f AS (SELECT 'S' || l_suppkey AS ticker, CAST(max(l_shipdate) AS DATE) AS latest_filed FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1), s AS (SELECT 'S' || s_suppkey AS ticker, s_suppkey FROM supplier)
SELECT s.ticker, CASE WHEN s_suppkey % 7 > 0 THEN 'EXISTING_CLASSIFICATION_ONLY' WHEN s_suppkey % 2 = 0 THEN 'OFFICIAL_FILING_VERIFIED' ELSE 'KEYWORD_ONLY' END AS evidence_level,
  CASE WHEN s_suppkey % 7 > 0 THEN 'candidate list and theme only' ELSE 'read in full' END AS evidence_note,
  coalesce(nullif(concat_ws('; ', CASE WHEN status = 'OK' THEN 'LISTED_TRADING(~' || l || ')' WHEN status IS NOT NULL THEN 'CHECK(' || status || ')' END, CASE WHEN latest_filed IS NOT NULL THEN 'ACTIVE_FILER(' || latest_filed || ')' END), ''), 'UNVERIFIED') AS business_status_observed,
  latest_filed FROM s LEFT JOIN a USING (ticker) LEFT JOIN f USING (ticker)""",
    "rationale_table": "SELECT p_partkey, p_name || ' (' || p_brand || '): price ' || format('{:,.2f}', p_retailprice) || ', size ' || format('{:,.2f}', CAST(p_size AS DOUBLE)) AS sentence, 'price->Price; size->Size' AS names FROM part",
    "period_strings": "SELECT o_custkey, string_agg(DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '|' ORDER BY CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS joined, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1",
    "rolling_quarter_error": f"""WITH {p._LEVEL}, r AS (SELECT date, count(*) OVER w AS n, stddev_samp(ret - bench) OVER w * sqrt(252) AS tracking_error FROM moved WHERE ret IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) SELECT date, round(tracking_error, 4) AS tracking_error FROM r WHERE n = 63""",
    "interval_membership": """WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
q AS (SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS until FROM (SELECT last_day(CAST(d AS DATE) + INTERVAL 2 MONTH) AS snapshot_date, lo, hi FROM (SELECT lo, hi, unnest(generate_series(date_trunc('year', lo), hi + INTERVAL 3 MONTH, INTERVAL 3 MONTH)) AS d FROM b)) WHERE snapshot_date BETWEEN lo AND hi)
SELECT snapshot_date, count(*) AS n_days FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) JOIN q ON date > snapshot_date AND (until IS NULL OR date <= until) GROUP BY 1""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
