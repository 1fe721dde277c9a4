"""Queries on company facts: suppliers and orders as companies, their quarters and lines as filings and facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean
from ..operators import asof, audit, facts, integrity, score
from ..sources import readers
from ..sources.stages import Stages
from . import prices as p
from .scores import index_weights
from .snapshots import _SUPQ, read, supplier_quarters

# metric, tag, kind and the value by a supplier quarter's revenue and quantity; the SQL below computes the same values.
PANEL = (
    ("revenue", "Revenues", facts.FLOW, "revenue"), ("operating_income", "OperatingIncomeLoss", facts.FLOW, "revenue * 0.2D - 1000"), ("net_income", "NetIncomeLoss", facts.FLOW, "revenue * 0.1D - 500"),
    ("assets", "Assets", facts.STOCK, "quantity * 1000"), ("liabilities", "Liabilities", facts.STOCK, "CASE WHEN l_suppkey % 3 = 0 THEN quantity * 550 END"), ("equity", "StockholdersEquity", facts.STOCK, "quantity * 400 - 3000"),
    ("current_assets", "AssetsCurrent", facts.STOCK, "quantity * 200"), ("current_liabilities", "LiabilitiesCurrent", facts.STOCK, "CASE WHEN quantity % 5 = 0 THEN 0D ELSE quantity * 150 END"),
    ("operating_cash_flow", "NetCashProvidedByUsedInOperatingActivities", facts.FLOW, "revenue * 0.15D"),
    ("capital_expenditure", "PaymentsToAcquirePropertyPlantAndEquipment", facts.FLOW, "CASE WHEN l_suppkey % 4 > 0 THEN revenue * 0.05D END"),
)


def supplier_facts(spark, sf_dir) -> DataFrame:
    """A filing per supplier quarter (10-K for the fourth), a fact per metric that has a value; some fiscal years are missing."""
    q = supplier_quarters(spark, sf_dir).withColumn("revenue", F.round("revenue", 4))
    quarter = F.quarter("quarter_end")
    annual = quarter == 4
    cells = ", ".join(f"'{tag}', CAST({value} AS DOUBLE)" for _, tag, _, value in PANEL)
    rows = q.select(
        F.col("l_suppkey").cast("string").alias("cik"), F.lit("us-gaap").alias("taxonomy"), F.trunc("quarter_end", "quarter").alias("start"), F.col("quarter_end").alias("end"), F.date_add("quarter_end", 40).alias("filed"),
        F.when(annual, "10-K").otherwise("10-Q").alias("form"), F.concat_ws("-", "l_suppkey", "quarter_end").alias("accn"), F.when((F.col("l_suppkey") + quarter) % 11 > 0, F.year("quarter_end")).alias("fy"),
        F.when(annual, "FY").otherwise(F.concat(F.lit("q"), quarter.cast("string"))).alias("fp"), F.expr(f"stack({len(PANEL)}, {cells}) AS (tag, val)"),
    )
    return rows.where("val IS NOT NULL").withColumn("unit", F.lit("USD"))


def factor_panel(spark, sf_dir):
    tags = [(m, t, 0, k) for m, t, k, _ in PANEL]
    with Stages(spark) as stages:
        f = stages.write(facts.financial_only(facts.standardize(supplier_facts(spark, sf_dir))))
        a = stages.write(facts.anchors(f))
        out = stages.result(facts.factor_panel(a, facts.best_facts(a, f, tags)))
    return out.select("cik", "end", "period_type", "prev_end", "source_fact_count", "factor_available_count", "pit_valid", F.round("liabilities", 4).alias("liabilities"), *[F.round(c, 6).alias(c) for c in facts.FACTORS])


def _blocked(spark, sf_dir) -> DataFrame:
    """The factor panel where a third of the suppliers moves to another standard in 1998, metric by metric in some
    quarters; half of these file the previous period again under it, at nine tenths."""
    own = supplier_facts(spark, sf_dir).withColumn("_moved", (F.col("cik").cast("long") % 3 == 0) & (F.year("end") >= 1998))
    stays = ((F.col("tag") == "Revenues") & (F.month("end") == 6)) | ((F.col("tag") == "Liabilities") & (F.month("end") == 9)) | ((F.col("tag") == "NetIncomeLoss") & (F.month("end") == 3))
    own = own.withColumn("taxonomy", F.when(F.col("_moved") & ~stays, "ifrs-full").otherwise("us-gaap"))
    order = Window.partitionBy("cik", "tag", "form").orderBy("end")
    again = own.where("cik % 6 = 0").withColumns({c: F.lag(c).over(order) for c in ("val", "start", "end")} | {"taxonomy": F.lit("ifrs-full")}).where("end IS NOT NULL").withColumn("val", F.col("val") * 0.9)
    with Stages(spark) as stages:
        f = stages.write(facts.financial_only(facts.standardize(own.unionByName(again).drop("_moved"))))
        tags = [(m, t, 0, k) for m, t, k, _ in PANEL]
        a = stages.write(facts.anchors(f))
        best = stages.write(facts.best_facts(a, f, tags))
        rows = audit.row_standards(facts.factor_panel(a, best), best, METRICS)
        return stages.result(audit.block_mixed(audit.restated_bases(rows, f, tags)))


def mixed_blocking(spark, sf_dir):
    factors = [*[g for g, _ in audit.GROWTHS], *[w[0] for w in audit.WITHIN]]
    return _blocked(spark, sf_dir).select("cik", "end", "crossed", *[F.round(c, 6).alias(c) for c in factors])


def mixed_decisions(spark, sf_dir):
    return audit.decision_log(_blocked(spark, sf_dir), "cik", "end")


def _messy(spark, sf_dir) -> DataFrame:
    """Lines as facts with untidy texts, each twice; some are of other forms, without a value, or filed before their end."""
    li = read(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_suppkey").cast("string").alias("cik"), F.when(F.col("l_linenumber") == 7, F.lit(None)).when(F.col("l_returnflag") == "A", " US-GAAP ").otherwise("dei").alias("taxonomy"),
        F.when(F.col("l_partkey") % 2 == 0, "EntityPublicFloat").otherwise(F.col("l_returnflag")).alias("tag"), F.lit("USD").alias("unit"), F.lit(None).cast("date").alias("start"),
        F.date_add(F.to_date("l_shipdate"), (F.col("l_linenumber") % 3 - 1).cast("int")).alias("end"), F.to_date("l_shipdate").alias("filed"), F.when(F.col("l_linenumber") % 4 == 0, "8-K").when(F.col("l_linestatus") == "F", " 10-k ").otherwise("10-Q").alias("form"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("accn"), F.year("l_shipdate").alias("fy"), F.lit(" fy").alias("fp"), F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")).alias("val"),
    )
    return rows.unionByName(rows)


def fact_standardize(spark, sf_dir):
    return facts.standardize(_messy(spark, sf_dir)).select("cik", "taxonomy", "tag", "end", "filed", "form", "accn", "fp", "val")


def financial_fallback(spark, sf_dir):
    rows = _messy(spark, sf_dir).withColumns({"cik": F.element_at(F.split("accn", "-"), 1), "taxonomy": F.lower(F.trim("taxonomy"))}).distinct()
    return facts.financial_only(rows).select("cik", "taxonomy", "tag", "accn")


_TAG = "CASE l_linenumber WHEN 7 THEN 'L' WHEN 6 THEN 'E' WHEN 5 THEN 'T' ELSE l_returnflag END"
TAGS = (
    ("revenue", "A", 0, facts.FLOW), ("revenue", "R", 1, facts.FLOW), ("assets", "N", 0, facts.STOCK), ("liabilities", "L", 0, facts.STOCK), ("liabilities_and_equity", "T", 0, facts.STOCK), ("equity", "E", 0, facts.STOCK),
)


def yearly_facts(spark, sf_dir) -> tuple[DataFrame, tuple]:
    """Lines as facts of customers at month ends: of a few forms, not all FY, of zero to three hundred days."""
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.last_day("o_orderdate")
    rows = li.select(
        F.col("o_custkey").cast("string").alias("cik"), F.lit("us-gaap").alias("taxonomy"), F.expr(_TAG).alias("tag"), F.lit("USD").alias("unit"), F.date_sub(end, (F.col("l_partkey") % 4 * 100).cast("int")).alias("start"),
        end.alias("end"), F.to_date("l_shipdate").alias("filed"), F.when(F.col("l_suppkey") % 5 == 0, "10-Q").when(F.col("l_suppkey") % 5 == 1, "10-K/A").otherwise("10-K").alias("form"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("accn"), F.year("o_orderdate").alias("fy"), F.when((F.col("o_custkey") + F.col("l_partkey")) % 3 > 0, "FY").otherwise("Q4").alias("fp"), F.col("l_extendedprice").alias("val"),
    )
    return rows, TAGS


def annual_facts(spark, sf_dir):
    rows, tags = yearly_facts(spark, sf_dir)
    return facts.latest_annual(rows, tags).select("cik", "metric", "tag", "end", "filed", "accn", F.round("val", 2).alias("val"))


def latest_value(spark, sf_dir):
    return facts.latest_value(yearly_facts(spark, sf_dir)[0]).select("cik", "tag", "fy", "fp", "filed", "accn", F.round("val", 2).alias("val"))


def single_tag(spark, sf_dir):
    return readers.single_tag(yearly_facts(spark, sf_dir)[0], "R").groupBy("cik").agg(F.count("*").alias("n"), F.round(F.sum("val"), 2).alias("total"))


METRICS = ("revenue", "operating_income", "net_income", "assets", "liabilities")


def _extracted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows, tags = yearly_facts(spark, sf_dir)
    return rows, audit.company_extract(rows, tags, METRICS, as_of=F.lit("2002-01-01").cast("date"))


def company_extract(spark, sf_dir):
    out = _extracted(spark, sf_dir)[1]
    return out.select(
        "cik", "target_end", *[F.round(c, 2).alias(c) for c in ("revenue", "assets", "liabilities")], "revenue_tag", "assets_tag", "liabilities_tag", "liabilities_calculated", "liabilities_method", "revenue_fiscal_year", "revenue_filed_date",
        "data_age_days", "is_stale", "warning_count", "warning_messages", F.round("liability_to_assets", 6).alias("liability_to_assets"), "period_consistent", "period_issues",
    )


def company_records(spark, sf_dir):
    """Companies with their extract, and those without with the reason."""
    rows, out = _extracted(spark, sf_dir)
    companies = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cik"), F.lit("Nasdaq").alias("exchange")).distinct()
    good, bad = audit.company_records(companies, rows, out)
    return good.select("cik", "target_end", F.lit(None).cast("string").alias("error_type")).unionByName(bad.select("cik", F.lit(None).cast("date").alias("target_end"), "error_type"))


def standard_panel(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cik"), F.col("o_orderdate").alias("Filed"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 7 - 6).cast("int")).alias("end"), F.when(F.col("o_orderkey") % 3 == 0, "8-K").otherwise(" 10-q").alias("form"),
        F.col("o_orderkey").cast("string").alias("accn"), (F.col("o_orderkey") % 5 > 0).alias("pit_valid"), F.col("o_totalprice").alias("value"),
    )
    universe = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_mktsegment").alias("theme"))
    names = {"availability_date": ("availability_date", "filed"), "period_end": ("period_end", "end"), "form": ("form",), "accession_number": ("accession", "accn"), "pit_valid": ("pit_valid",)}
    panel, lost = audit.standard_panel(o, universe, names)
    none = lambda t: F.lit(None).cast(t)
    ok = panel.select("cik", "theme", "availability_date", "period_end", "form", "accession_number", none("string").alias("error_type"))
    return ok.unionByName(lost.select("cik", none("string").alias("theme"), none("date").alias("availability_date"), none("date").alias("period_end"), none("string").alias("form"), none("string").alias("accession_number"), "error_type"))


def theme_screen(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 11 > 0).alias("pit_valid"), F.when(F.col("o_orderkey") % 13 > 0, F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate")).alias("information_age_days"), (F.col("o_totalprice") / 2000).alias("data_quality_score"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(1.0)).alias("growth"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(2.0)).alias("revenue_growth"), F.when(F.col("o_orderkey") % 5 > 0, F.lit(3.0)).alias("margin"), F.when(F.col("o_orderkey") % 7 > 0, F.lit(4.0)).alias("roa"),
    )
    s = score.theme_screen(o, {"growth": ("growth", "revenue_growth"), "margin": ("margin",), "roa": ("roa",), "leverage": ("debt_ratio",)}, ("roa", "revenue"), 2, 40, 500)
    text = lambda c: F.array_join(c, "|").alias(c)
    source = F.coalesce(F.element_at("required_factor_columns", "growth"), F.lit("none")).alias("growth_from")
    return s.select("o_orderkey", "eligible", "decision", "decision_reason", "required_factor_count", *[text(c) for c in ("passed_reasons", "failed_reasons", "unavailable_checks", "available_required_factors", "missing_required_factors")], source)


def row_fields(spark, sf_dir):
    """Periods, ages and first values of a row."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("end"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5 - 2).cast("int")).alias("filed"), F.when(F.col("o_orderkey") % 3 == 0, "20-F").otherwise("6-K").alias("form"), F.when(F.col("o_orderkey") % 4 == 0, " q2").when(F.col("o_orderkey") % 4 == 1, "nan").alias("fp"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("a"), F.col("o_custkey").cast("double").alias("b"))
    known = asof.point_in_time(o, "filed", "end")
    return known.select("o_orderkey", clean.period_type("form").alias("period_type"), clean.fiscal_period("fp", "form").alias("fiscal_period"), clean.days_between("end", "filed").alias("days"), clean.is_stale("end", F.lit("1999-01-01").cast("date"), 365).alias("stale"), clean.first_of("a", "b").alias("value"), clean.first_name_of("a", "b").alias("from_column"))


def weight_universe(spark, sf_dir):
    """Tickers of a weights table, tidied, and the benchmark they are held against."""
    w = index_weights(spark, sf_dir).select(F.col("quarter_end").alias("snapshot_date"), F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("ticker"), "weight")
    return readers.weight_tickers(readers.weights_table(w))


def benchmark_series(spark, sf_dir):
    day = p.closes(spark, sf_dir).groupBy("date").agg(F.round(F.avg("close"), 6).alias("value"))
    return readers.benchmark_series(day.select("date", "value"), "ALL")


def boolean_coverage(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_totalprice") > 100000).alias("large"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus") == "F").alias("closed"))
    return integrity.boolean_coverage(o, "large", "closed")


def event_cross_check(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select((F.col("s_acctbal") < 0).alias("suspected_suspension"), (F.col("s_suppkey") % 7 == 0).alias("delisted_or_data_end"))
    c = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 == 0, "DELISTED").otherwise("LISTED").alias("listing_status"))
    return integrity.event_cross_check(s, c)


def tag_units(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.format_string('{"us-gaap":{"%s":{"units":{"USD":[],"%s":[{"val":"1"}]}}}}', "event_type", F.when(F.col("event_id") % 2 == 0, "EUR").otherwise("shares"))
    return readers.tag_units(e.select(F.col("event_id").cast("string").alias("cik"), text.alias("value")))


def run_log(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.run_log(o, li, o.where("o_orderkey % 4 = 0"), "o_orderkey")


def provenance_enrichment(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cik"), F.last_day(F.trunc("l_shipdate", "quarter")).alias("period_end"), "l_returnflag", "l_linestatus", "l_quantity")
    factors = li.groupBy("cik", "period_end").agg(F.sum("l_quantity").alias("quantity"))
    tags = integrity.provenance(li, ["cik", "period_end"], "l_linestatus", ["F", "O"], "l_returnflag").withColumnsRenamed({"F": "F_tag", "O": "O_tag"})
    mixed = li.where("l_quantity > 20").groupBy("cik", "period_end").agg((F.countDistinct("l_returnflag") > 1).alias("mixed_standard_warning"))
    moves = integrity.standard_transitions(li.where("l_quantity > 10"), ["cik"], "period_end", "l_returnflag").select("cik", "period_end", F.col("crossed").alias("growth_cross_standard_warning"))
    standards = integrity.classify_standard(li.where("cik % 3 > 0").select("cik", F.when(F.col("l_returnflag") == "A", "us-gaap").otherwise("dei").alias("taxonomy")), "cik").select("cik", F.col("standard").alias("accounting_standard"))
    universe = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("cik"), F.col("s_name").alias("ticker"))
    return integrity.enrich_provenance(factors, standards, tags, mixed, moves, universe, "cik", "period_end")


def corporate_actions(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), "s_suppkey")
    kind = F.when(F.col("s_suppkey") % 5 == 0, "TICKER_NAME_CHANGE").when(F.col("s_suppkey") % 5 == 1, "SPINOFF_NEW")
    curated = s.where("s_suppkey % 5 < 2").select("ticker", kind.alias("corporate_action_type"), F.lit("1996-01-01").cast("date").alias("announcement_date"), F.lit("1998-03-31").cast("date").alias("effective_date"), F.concat(F.col("ticker"), F.lit("X")).alias("successor"))
    spans = p.closes(spark, sf_dir).groupBy("ticker").agg(F.min("date").alias("first_valid"), F.max("date").alias("last_valid"))
    w = index_weights(spark, sf_dir).select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.col("quarter_end").alias("snapshot_date"))
    return integrity.corporate_actions(s.select("ticker"), curated, s.where("s_suppkey % 5 = 2").select("ticker"), spans, w)


def _sql() -> dict[str, str]:
    from .scores import _IDX

    g = lambda a, b: f"a.{a} / nullif(b.{b}, 0) - 1"
    mean = lambda c: f"coalesce((a.{c} + b.{c}) / 2, a.{c})"
    factors = {
        "revenue_growth": g("revenue", "revenue"), "operating_income_growth": g("operating_income", "operating_income"), "net_income_growth": g("net_income", "net_income"), "asset_growth": g("assets", "assets"),
        "operating_margin": "a.operating_income / nullif(a.revenue, 0)", "net_margin": "a.net_income / nullif(a.revenue, 0)", "roa": f"a.net_income / nullif({mean('assets')}, 0)", "roe": f"a.net_income / nullif({mean('equity')}, 0)",
        "debt_ratio": "a.liabilities / nullif(a.assets, 0)", "debt_to_equity": "a.liabilities / nullif(a.equity, 0)", "current_ratio": "a.current_assets / nullif(a.current_liabilities, 0)",
        "ocf_to_assets": f"a.operating_cash_flow / nullif({mean('assets')}, 0)", "free_cash_flow_proxy": "a.operating_cash_flow - abs(a.capital_expenditure)",
    }
    wide = ", ".join(f"CAST({re.sub(r'(?<=[0-9])D', '', v)} AS DOUBLE) AS {m}" for m, _, _, v in PANEL)
    messy = """li AS (SELECT CAST(l_suppkey AS VARCHAR) AS cik, l_orderkey, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'us-gaap' ELSE 'dei' END AS taxonomy, CASE WHEN l_partkey % 2 = 0 THEN 'EntityPublicFloat' ELSE l_returnflag END AS tag,
  CAST(l_shipdate AS DATE) + CAST(l_linenumber % 3 - 1 AS INTEGER) AS "end", CAST(l_shipdate AS DATE) AS filed, CASE WHEN l_linenumber % 4 = 0 THEN '8-K' WHEN l_linestatus = 'F' THEN '10-K' ELSE '10-Q' END AS form,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS accn, CASE WHEN l_quantity > 5 THEN l_extendedprice END AS val FROM lineitem)"""
    values = ", ".join(f"('{m}', '{t}', {r}, '{k}')" for m, t, r, k in TAGS)
    yearly = f"""f AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, {_TAG} AS tag, last_day(o_orderdate) - CAST(l_partkey % 4 * 100 AS INTEGER) AS start, last_day(o_orderdate) AS d_end, CAST(l_shipdate AS DATE) AS filed,
  CASE l_suppkey % 5 WHEN 0 THEN '10-Q' WHEN 1 THEN '10-K/A' ELSE '10-K' END AS form, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS accn, CAST(year(o_orderdate) AS INTEGER) AS fy, CASE WHEN (o_custkey + l_partkey) % 3 > 0 THEN 'FY' ELSE 'Q4' END AS fp, l_extendedprice AS val
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey), t AS (SELECT * FROM (VALUES {values}) AS t(metric, tag, tag_rank, kind)),
y1 AS (SELECT f.*, metric, tag_rank, kind FROM f JOIN t ON f.tag = t.tag WHERE form <> '10-Q' QUALIFY fp = 'FY' OR NOT bool_or(fp = 'FY') OVER (PARTITION BY cik, f.tag)),
y2 AS (SELECT * FROM y1 QUALIFY kind = 'stock' OR d_end - start BETWEEN 300 AND 400 OR NOT bool_or(d_end - start BETWEEN 300 AND 400) OVER (PARTITION BY cik, tag)),
annual AS (SELECT * FROM y2 QUALIFY row_number() OVER (PARTITION BY cik, tag, d_end ORDER BY filed DESC, accn DESC, val) = 1)"""
    extract = f"""{yearly}, target AS (SELECT cik, max(d_end) AS target_end FROM annual WHERE metric = 'revenue' GROUP BY cik),
b AS (SELECT a.*, target_end FROM annual a JOIN target USING (cik) WHERE d_end = target_end QUALIFY row_number() OVER (PARTITION BY cik, metric ORDER BY filed DESC, tag_rank, val) = 1),
w AS (SELECT cik, target_end, {", ".join(f"max({c}) FILTER (metric = '{m}') AS {m}_{c}" for m in ("revenue", "assets", "liabilities", "liabilities_and_equity", "equity") for c in ("val", "tag"))},
  max(fy) FILTER (metric = 'revenue') AS fy, max(filed) FILTER (metric = 'revenue') AS filed FROM b GROUP BY 1, 2),
x AS (SELECT *, liabilities_val IS NULL AND coalesce(liabilities_and_equity_val - equity_val >= 0, false) AS calc FROM w),
z AS (SELECT *, CASE WHEN calc THEN liabilities_and_equity_val - equity_val ELSE liabilities_val END AS li FROM x)"""
    screen_rows = """s AS (SELECT o_orderkey, o_orderkey % 11 > 0 AS pit, CASE WHEN o_orderkey % 13 > 0 THEN DATE '1999-01-01' - CAST(o_orderdate AS DATE) END AS age, o_totalprice / 2000 AS q, CASE WHEN o_orderkey % 2 = 0 THEN 'growth' WHEN o_orderkey % 3 = 0 THEN 'revenue_growth' END AS g,
  o_orderkey % 5 > 0 AS m, o_orderkey % 7 > 0 AS r FROM orders), n AS (SELECT *, CAST(g IS NOT NULL AS INTEGER) + CAST(m AS INTEGER) + CAST(r AS INTEGER) AS n FROM s),
w AS (SELECT *, concat_ws('|', CASE WHEN pit THEN 'PIT_VALID' END, CASE WHEN age <= 500 THEN 'INFORMATION_FRESH' END, CASE WHEN g IS NOT NULL THEN 'REQUIRED_FACTOR_GROWTH_AVAILABLE' END, CASE WHEN m THEN 'REQUIRED_FACTOR_MARGIN_AVAILABLE' END, CASE WHEN r THEN 'REQUIRED_FACTOR_ROA_AVAILABLE' END,
    CASE WHEN n >= 2 THEN 'REQUIRED_FACTOR_COVERAGE_' || n || '_OF_4' END, CASE WHEN q >= 40 THEN 'DATA_QUALITY_PASS' END, CASE WHEN r THEN 'ROA_AVAILABLE' END) AS passed_reasons,
  concat_ws('|', CASE WHEN NOT pit THEN 'PIT_INVALID' END, CASE WHEN age > 500 THEN 'STALE_INFORMATION_OVER_500D' END, CASE WHEN n < 2 THEN 'REQUIRED_FACTOR_COUNT_BELOW_2' END, CASE WHEN n < 2 AND g IS NULL THEN 'MISSING_REQUIRED_FACTOR_GROWTH' END, CASE WHEN n < 2 AND NOT m THEN 'MISSING_REQUIRED_FACTOR_MARGIN' END,
    CASE WHEN n < 2 AND NOT r THEN 'MISSING_REQUIRED_FACTOR_ROA' END, CASE WHEN n < 2 THEN 'MISSING_REQUIRED_FACTOR_LEVERAGE' END, CASE WHEN q < 40 THEN 'DATA_QUALITY_BELOW_40' END) AS failed_reasons,
  concat_ws('|', CASE WHEN age IS NULL THEN 'INFORMATION_AGE_NOT_AVAILABLE' END, 'FINANCIAL_WARNING_NOT_AVAILABLE', CASE WHEN NOT r THEN 'MISSING_ROA_NOT_ENFORCED' END, 'REVENUE_COLUMN_NOT_AVAILABLE') AS unavailable_checks FROM n)"""
    out = {
        "factor_panel": f"""WITH {_SUPQ}, v AS (SELECT l_suppkey, quarter_end, round(revenue, 4) AS revenue, quantity FROM supq),
k AS (SELECT l_suppkey, quarter_end, quarter(quarter_end) AS q, CASE WHEN (l_suppkey + quarter(quarter_end)) % 11 > 0 THEN year(quarter_end) END AS fy, {wide} FROM v),
m AS (SELECT * EXCLUDE liabilities, coalesce(liabilities, assets - equity) AS liabilities, CAST(8 + (l_suppkey % 3 = 0)::INT + (l_suppkey % 4 > 0)::INT AS BIGINT) AS source_fact_count FROM k),
j AS (SELECT a.l_suppkey, a.quarter_end, b.quarter_end AS prev_end, row_number() OVER (PARTITION BY a.l_suppkey, a.quarter_end ORDER BY
    CASE WHEN a.q = 4 THEN coalesce(b.fy = a.fy - 1, false) ELSE coalesce(b.q = a.q, false) AND (a.fy IS NULL OR b.fy IS NULL OR b.fy = a.fy - 1) END DESC, b.quarter_end DESC) AS n
  FROM m a LEFT JOIN m b ON a.l_suppkey = b.l_suppkey AND b.quarter_end < a.quarter_end AND (a.q = 4) = (b.q = 4)),
o AS (SELECT a.*, j.prev_end, {", ".join(f"{v} AS {n}" for n, v in factors.items())} FROM m a JOIN j ON j.n = 1 AND j.l_suppkey = a.l_suppkey AND j.quarter_end = a.quarter_end LEFT JOIN m b ON b.l_suppkey = a.l_suppkey AND b.quarter_end = j.prev_end)
SELECT CAST(l_suppkey AS VARCHAR) AS cik, quarter_end AS "end", CASE WHEN q = 4 THEN 'annual' ELSE 'quarterly' END AS period_type, prev_end, source_fact_count, true AS pit_valid,
  {" + ".join(f"CAST({n} IS NOT NULL AS INTEGER)" for n in factors)} AS factor_available_count, round(liabilities, 4) AS liabilities, {", ".join(f"round({n}, 6) AS {n}" for n in factors)} FROM o""",
        "fact_standardize": f"""WITH {messy} SELECT DISTINCT cik, taxonomy, tag, "end", filed, form, accn, 'FY' AS fp, val FROM li WHERE val IS NOT NULL AND filed >= "end" AND form <> '8-K'""",
        "financial_fallback": f"""WITH {messy}, d AS (SELECT DISTINCT l_orderkey, taxonomy, tag, accn, val, coalesce(taxonomy = 'us-gaap', false) AS fin, tag <> 'EntityPublicFloat' AS plain FROM li),
k AS (SELECT *, bool_or(fin) OVER w AS any_fin, bool_or(fin AND plain) OVER w AS both_, bool_or(plain) OVER w AS any_plain FROM d WINDOW w AS (PARTITION BY l_orderkey))
SELECT CAST(l_orderkey AS VARCHAR) AS cik, taxonomy, tag, accn FROM k WHERE CASE WHEN both_ THEN fin AND plain WHEN any_plain AND NOT any_fin THEN plain ELSE true END""",
        "annual_facts": f'WITH {yearly} SELECT cik, metric, tag, d_end AS "end", filed, accn, round(val, 2) AS val FROM annual',
        "latest_value": f"""WITH {yearly}, k AS (SELECT * FROM f WHERE form = '10-K' QUALIFY fp = 'FY' OR NOT bool_or(fp = 'FY') OVER (PARTITION BY cik, tag))
SELECT cik, tag, fy, fp, filed, accn, round(val, 2) AS val FROM k QUALIFY row_number() OVER (PARTITION BY cik, tag ORDER BY fy DESC, filed DESC, accn DESC, val) = 1""",
        "single_tag": f"WITH {yearly} SELECT cik, count(*) AS n, round(sum(val), 2) AS total FROM f WHERE tag = 'R' GROUP BY cik",
        "company_extract": f"""WITH {extract}, c AS (SELECT *, concat_ws('|', CASE WHEN revenue_val <= 0 THEN 'revenue_non_positive' END, CASE WHEN assets_val <= 0 THEN 'assets_non_positive' END, CASE WHEN li < 0 THEN 'liabilities_negative' END, CASE WHEN li > assets_val THEN 'liabilities_exceed_assets' END) AS codes,
  concat_ws(';', CASE WHEN assets_val IS NULL THEN 'assets:missing' END, CASE WHEN li IS NULL THEN 'liabilities:missing' END, 'net_income:missing', 'operating_income:missing') AS issues FROM z)
SELECT cik, target_end, round(revenue_val, 2) AS revenue, round(assets_val, 2) AS assets, round(li, 2) AS liabilities, revenue_tag, assets_tag, CASE WHEN calc THEN 'CALCULATED:T-E' ELSE liabilities_tag END AS liabilities_tag, calc AS liabilities_calculated,
  CASE WHEN calc THEN 'LiabilitiesAndEquity - Equity' END AS liabilities_method, fy AS revenue_fiscal_year, filed AS revenue_filed_date, CAST(DATE '2002-01-01' - target_end AS INTEGER) AS data_age_days, DATE '2002-01-01' - target_end > 500 AS is_stale,
  CAST(CASE WHEN codes = '' THEN 0 ELSE len(codes) - len(replace(codes, '|', '')) + 1 END AS INTEGER) AS warning_count, nullif(codes, '') AS warning_messages, round(li / nullif(assets_val, 0), 6) AS liability_to_assets, false AS period_consistent, issues AS period_issues FROM c""",
        "company_records": f"""WITH {extract}, c AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS cik FROM customer)
SELECT c.cik, target_end, CASE WHEN target_end IS NULL THEN CASE WHEN c.cik IN (SELECT cik FROM f) THEN 'NO_ANNUAL_VALUE' ELSE 'NO_FACTS' END END AS error_type FROM c LEFT JOIN z USING (cik)""",
        "standard_panel": """WITH o AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 - 6 AS INTEGER) AS e, CASE WHEN o_orderkey % 3 = 0 THEN '8-K' ELSE '10-Q' END AS form, CAST(o_orderkey AS VARCHAR) AS accn, o_orderkey % 5 > 0 AS ok FROM orders),
k AS (SELECT * FROM o WHERE ok AND cik IN (SELECT c_custkey FROM customer) QUALIFY form = '10-Q' OR NOT bool_or(form = '10-Q') OVER (PARTITION BY cik)), p AS (SELECT * FROM k WHERE d >= e)
SELECT cik, c_mktsegment AS theme, d AS availability_date, e AS period_end, form, accn AS accession_number, NULL AS error_type FROM p JOIN customer ON c_custkey = cik
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, CASE WHEN c_custkey IN (SELECT cik FROM o) THEN 'NO_VALID_ROW' ELSE 'NO_FACTORS' END FROM customer WHERE c_custkey NOT IN (SELECT cik FROM p)""",
        "theme_screen": f"""WITH {screen_rows} SELECT o_orderkey, failed_reasons = '' AS eligible, CASE WHEN failed_reasons = '' THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision, CASE WHEN failed_reasons = '' THEN 'ELIGIBLE' ELSE replace(failed_reasons, '|', ' | ') END AS decision_reason,
  n AS required_factor_count, passed_reasons, failed_reasons, unavailable_checks, concat_ws('|', CASE WHEN g IS NOT NULL THEN 'growth' END, CASE WHEN m THEN 'margin' END, CASE WHEN r THEN 'roa' END) AS available_required_factors,
  concat_ws('|', CASE WHEN g IS NULL THEN 'growth' END, CASE WHEN NOT m THEN 'margin' END, CASE WHEN NOT r THEN 'roa' END, 'leverage') AS missing_required_factors, coalesce(g, 'none') AS growth_from FROM w""",
        "row_fields": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'annual' ELSE 'quarterly' END AS period_type, CASE WHEN o_orderkey % 4 = 0 THEN 'Q2' WHEN o_orderkey % 3 = 0 THEN 'FY' ELSE 'Q' END AS fiscal_period, CAST(o_orderkey % 5 - 2 AS INTEGER) AS days,
  DATE '1999-01-01' - CAST(o_orderdate AS DATE) > 365 AS stale, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE CAST(o_custkey AS DOUBLE) END AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS from_column FROM orders WHERE o_orderkey % 5 >= 2""",
        "weight_universe": f"WITH {_IDX} SELECT DISTINCT 'S' || l_suppkey AS ticker FROM idx",
        "benchmark_series": f"WITH {p._CLOSE} SELECT date, 'ALL' AS ticker, round(avg(close), 6) AS close FROM closes GROUP BY date",
        "boolean_coverage": """WITH o AS (SELECT o_totalprice > 100000 AS large, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus = 'F' END AS closed FROM orders)
SELECT 'large_true' AS metric, count(*) FILTER (large) AS available, count(*) FILTER (NOT large) AS missing, round_even(count(*) FILTER (large) * 100 / count(*), 2) AS coverage_pct FROM o
UNION ALL SELECT 'closed_true', count(*) FILTER (closed), count(*) FILTER (NOT closed), round_even(count(*) FILTER (closed) * 100 / count(*), 2) FROM o""",
        "event_cross_check": "SELECT (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS n_long_suspensions, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = 0) AS n_delisted, (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0) AS n_not_listed",
        "tag_units": "SELECT CAST(event_id AS VARCHAR) AS cik, 'us-gaap' AS taxonomy, event_type AS tag, CASE WHEN event_id % 2 = 0 THEN 'EUR|USD' ELSE 'USD|shares' END AS units FROM events",
        "run_log": """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN 'success' WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'remaining' END AS status, coalesce(n, 0) AS n_rows FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
        "provenance_enrichment": """WITH li AS (SELECT l_suppkey AS cik, last_day(date_trunc('quarter', l_shipdate)) AS period_end, l_returnflag AS r, l_linestatus AS s, l_quantity AS q FROM lineitem),
f AS (SELECT cik, period_end, sum(q) AS quantity, min(r) FILTER (s = 'F') AS F_tag, min(r) FILTER (s = 'O') AS O_tag, coalesce(count(DISTINCT r) FILTER (q > 20) > 1, false) AS mixed_standard_warning FROM li GROUP BY ALL),
c AS (SELECT cik, period_end, r, count(*) AS n FROM li WHERE q > 10 GROUP BY ALL), u AS (SELECT cik, period_end, arg_max(r, (n, r)) AS r FROM c GROUP BY ALL), m AS (SELECT cik, period_end, coalesce(lag(r) OVER (PARTITION BY cik ORDER BY period_end) <> r, false) AS x FROM u),
k AS (SELECT cik, CASE WHEN bool_or(r = 'A') THEN 'US-GAAP' ELSE 'UNKNOWN' END AS st FROM li WHERE cik % 3 > 0 GROUP BY 1)
SELECT f.cik, f.period_end, quantity, s_name AS ticker, coalesce(st, 'UNKNOWN') AS accounting_standard, F_tag, O_tag, mixed_standard_warning, coalesce(x, false) AS growth_cross_standard_warning
FROM f JOIN supplier ON s_suppkey = f.cik AND s_acctbal > 0 LEFT JOIN k USING (cik) LEFT JOIN m ON m.cik = f.cik AND m.period_end = f.period_end""",
        "corporate_actions": f"""WITH {_IDX}, {p._CLOSE}, sp AS (SELECT ticker, min(date) AS first_valid, max(date) AS last_valid FROM closes GROUP BY 1),
s AS (SELECT 'S' || s_suppkey AS ticker, s_suppkey % 5 AS k FROM supplier), a AS (SELECT s.ticker, k, first_valid, last_valid, CASE WHEN k < 2 THEN DATE '1998-03-31' WHEN k = 2 THEN first_valid END AS effective_date FROM s LEFT JOIN sp USING (ticker)),
w AS (SELECT a.ticker, count(*) AS n, count(*) FILTER (quarter_end < effective_date) AS pre FROM idx JOIN a ON a.ticker = 'S' || l_suppkey GROUP BY 1),
j AS (SELECT a.*, coalesce(n, 0) AS n, coalesce(pre, 0) AS pre FROM a LEFT JOIN w USING (ticker))
SELECT ticker, CASE k WHEN 0 THEN 'TICKER_NAME_CHANGE' WHEN 1 THEN 'SPINOFF_NEW' WHEN 2 THEN 'IPO' ELSE 'NONE' END AS corporate_action_type, CASE WHEN k < 2 THEN DATE '1996-01-01' END AS announcement_date, effective_date,
  CASE WHEN k < 2 THEN ticker || 'X' ELSE ticker END AS successor, first_valid, last_valid, n AS n_index_snapshots, pre AS n_pre_event_snapshots, CASE WHEN k > 2 THEN 'NONE' ELSE 'COMPLETED' END AS action_status,
  CASE WHEN k = 0 AND pre > 0 THEN 'HELD_BEFORE_RENAME' WHEN k = 1 AND n = 0 THEN 'NOT_IN_INDEX' WHEN effective_date IS NOT NULL AND pre = 0 AND n > 0 THEN 'AFTER_EFFECTIVE_DATE' ELSE '' END AS pit_note FROM j""",
    }
    panel = out["factor_panel"].split("\nSELECT CAST(l_suppkey")[0]
    order = "OVER (PARTITION BY l_suppkey, q = 4 ORDER BY quarter_end)"
    blocked = f"""{panel}, s AS (SELECT o.*, l_suppkey % 3 = 0 AND year(quarter_end) >= 1998 AS ifrs, {", ".join(f"lag({m}) {order} AS b_{m}" for _, m in audit.GROWTHS)} FROM o),
x AS (SELECT *, coalesce(ifrs AND NOT lag(ifrs) {order}, false) AS crossed FROM s),
r AS (SELECT *, {", ".join(f"CASE WHEN crossed AND l_suppkey % 2 = 0 THEN b_{m} * 0.9::DOUBLE END AS r_{m}" for _, m in audit.GROWTHS)}, ifrs AND q = 2 AS w1, ifrs AND q = 3 AS w2, ifrs AND q = 1 AS w3 FROM x),
z AS (SELECT *, {", ".join(f"coalesce(r_{m} <> 0 AND {m} IS NOT NULL, false) AS ok_{m}" for _, m in audit.GROWTHS)}, crossed AND NOT w3 AND roa IS NOT NULL AS ra, r_assets IS NOT NULL AND net_income IS NOT NULL AND assets IS NOT NULL AS ok_roa FROM r)"""
    keys = 'CAST(l_suppkey AS VARCHAR) AS cik, quarter_end AS "end"'
    new = [f"round(CASE WHEN NOT crossed THEN {g} WHEN ok_{m} THEN {m} / r_{m} - 1 END, 6) AS {g}" for g, m in audit.GROWTHS]
    out["mixed_blocking"] = f"""{blocked} SELECT {keys}, crossed, {", ".join(new)}, round(CASE WHEN NOT w1 THEN operating_margin END, 6) AS operating_margin, round(CASE WHEN NOT w2 THEN debt_ratio END, 6) AS debt_ratio,
  round(CASE WHEN w3 THEN NULL WHEN NOT ra THEN roa WHEN ok_roa THEN net_income / ((assets + r_assets) / 2) END, 6) AS roa FROM z"""
    log = [f"SELECT {keys}, '{f}' AS factor, 'BLOCKED_NULLED' AS decision, 'STANDARDS_DIFFER_WITHIN_ROW' AS reason FROM z WHERE {w}" for f, w in (("operating_margin", "w1"), ("debt_ratio", "w2"), ("roa", "w3"))]
    for f, on, ok, why in [*[(g, "crossed", f"ok_{m}", ("RESTATED_BASE", "NO_RESTATED_BASE")) for g, m in audit.GROWTHS], ("roa", "ra", "ok_roa", ("RESTATED_MEAN_ASSETS", "NO_RESTATED_ASSETS"))]:
        log.append(f"SELECT {keys}, '{f}', CASE WHEN {ok} THEN 'RECOMPUTED_RESTATED' ELSE 'BLOCKED_NULLED' END, CASE WHEN {ok} THEN '{why[0]}' ELSE '{why[1]}' END FROM z WHERE {on}")
    out["mixed_decisions"] = f"{blocked} " + " UNION ALL ".join(log)
    return out


ORACLES = _sql()
QUERIES = {n: globals()[n] for n in ORACLES}
