"""Company facts: standardisation, best fact known at a date, factor panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean
from .asof import previous_comparable
from .pick import keep_first

# Facts of filing cover pages.
COVER_TAGS = (
    "EntityCommonStockSharesOutstanding", "EntityPublicFloat", "DocumentPeriodEndDate", "EntityWellKnownSeasonedIssuer", "EntityVoluntaryFilers", "EntityCurrentReportingStatus",
    "EntityFilerCategory", "EntityEmergingGrowthCompany", "EntitySmallBusiness", "EntityShellCompany", "AmendmentFlag", "DocumentFiscalYearFocus", "DocumentFiscalPeriodFocus",
)
FINANCIAL = ("us-gaap", "ifrs-full")
SUPPORTED_FORMS = (*clean.ANNUAL_FORMS, *clean.QUARTERLY_FORMS)
FLOW, STOCK = "flow", "stock"
#: Most tags that a list of tags may name: it becomes a filter of the scan and a literal of the plan.
MOST_TAGS = 10_000
ANNUAL_DAYS, QUARTER_DAYS = (300, 400), (55, 115)


def with_tags(facts: DataFrame, tags: Sequence[tuple[str, str, int, str]]) -> DataFrame:
    """Facts whose tag is in the list, once for each of its metrics, with metric, tag_rank and kind.

    tags: (metric, tag, tag_rank, kind), MOST_TAGS at most. The list is a filter that reaches the scan and a map literal,
    so facts aren't moved for it.
    """
    if len(tags) > MOST_TAGS:
        raise ValueError(f"a list of {len(tags)} tags; {MOST_TAGS} at most")
    by: dict[str, list[tuple[str, str, int, str]]] = {}
    for t in tags:
        by.setdefault(t[1], []).append(t)
    item = lambda m, r, k: F.struct(F.lit(m).alias("metric"), F.lit(r).cast("int").alias("tag_rank"), F.lit(k).alias("kind"))
    cells = [x for tag, many in by.items() for x in (F.lit(tag), F.array(*[item(m, r, k) for m, _, r, k in many]))]
    if not cells:
        return facts.where(F.lit(False)).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("metric", "string"), ("tag_rank", "int"), ("kind", "string"))])
    return facts.where(F.col("tag").isin(*by)).select("*", F.inline(F.element_at(F.create_map(*cells), F.col("tag"))))


def standardize(facts: DataFrame) -> DataFrame:
    """Facts with tag, value, end and filed, of supported forms, filed no earlier than their end; equal ones once.

    Taxonomies come in lower case, forms and periods in upper case, all trimmed.
    """
    facts = facts.withColumns({"taxonomy": F.lower(F.trim("taxonomy")), "form": F.upper(F.trim("form")), "fp": F.upper(F.trim("fp"))})
    ok = facts.where(F.col("tag").isNotNull() & F.col("val").isNotNull() & F.col("end").isNotNull() & (F.col("filed") >= F.col("end")) & F.col("form").isin(*SUPPORTED_FORMS))
    key = ["cik", "tag", "unit", "start", "end", "val", "filed", "form", "accn", "fy", "fp"]
    return keep_first(ok, key, F.col("taxonomy").desc_nulls_last())


def financial_only(facts: DataFrame) -> DataFrame:
    """Financial taxonomies where a company has any, without cover-page facts; all its facts if nothing would be left."""
    plain = F.coalesce(~F.col("tag").isin(*COVER_TAGS), F.lit(True))
    both = F.coalesce(F.col("taxonomy").isin(*FINANCIAL), F.lit(False))
    w = Window.partitionBy("cik")
    marked = facts.withColumns({"_fin": F.max(both).over(w), "_pf": F.max(both & plain).over(w), "_p": F.max(plain).over(w)})
    keep = F.when(F.col("_pf"), both & plain).when(F.col("_p") & ~F.col("_fin"), plain).otherwise(True)
    return marked.where(keep).drop("_fin", "_pf", "_p")


def anchors(facts: DataFrame) -> DataFrame:
    """One row per company and accession, that with the latest (filed, end)."""
    key = clean.accession_key("accn", "filed", "end", "form", "fy", "fp")
    rows = facts.withColumn("accession_key", key)
    return keep_first(rows, ["cik", "accession_key"], F.col("filed").desc(), F.col("end").desc(), "tag", F.col("val")).select("cik", "accession_key", "end", "filed", "form", "fy", "fp")


def best_facts(anchor: DataFrame, facts: DataFrame, tags: Sequence[tuple[str, str, int, str]], taxonomy: Column | None = None) -> DataFrame:
    """The best fact of each anchor and metric known when the anchor was filed.

    tags: of with_tags(), kind flow or stock. A fact has the anchor's end and was filed no later. Soft preferences in order:
    form of the same cycle, fiscal year, fiscal period, duration in the cycle's band; then tag rank, distance of filing
    dates, latest filing, accession, unit, value. All of it is one order and one window. Join and window are by cik and
    end, so tables bucketed by these (sources.readers.write_bucketed) need no shuffle at all.
    """
    f = with_tags(facts, tags).select("cik", F.col("end").alias("f_end"), F.col("filed").alias("f_filed"), F.col("form").alias("f_form"), F.col("fy").alias("f_fy"), F.col("fp").alias("f_fp"), F.col("accn").alias("f_accn"), "start", "unit", "val", "taxonomy", "tag", "tag_rank", "metric", "kind")
    pairs = anchor.join(f.withColumnRenamed("f_end", "end"), ["cik", "end"]).withColumn("f_end", F.col("end")).where(F.col("f_filed") <= F.col("filed"))
    if taxonomy is not None:
        pairs = pairs.where(F.col("taxonomy") == taxonomy)
    annual = clean.period_type("form") == "annual"
    cycle = F.col("f_form").isin(*clean.ANNUAL_FORMS) == annual
    days = F.datediff("f_end", "start")
    band = F.when(annual, days.between(*ANNUAL_DAYS)).otherwise(days.between(*QUARTER_DAYS))
    flow = F.col("kind") == FLOW
    in_band = F.when(flow, F.coalesce(band, F.lit(False))).otherwise(False)
    gap = F.when(in_band, F.abs(days - F.when(annual, 365).otherwise(90))).otherwise(0)
    named = ~F.coalesce(F.upper(F.trim("fp")), F.lit("")).isin("", "<NA>", "NAN", "NONE", "Q")
    order = Window.partitionBy("cik", "end", "accession_key", "metric").orderBy(
        cycle.desc(), F.coalesce(F.col("f_fy") == F.col("fy"), F.lit(False)).desc(), F.when(named, F.coalesce(F.col("f_fp") == F.upper(F.trim("fp")), F.lit(False))).otherwise(False).desc(), in_band.desc(),
        "tag_rank", gap, F.col("f_filed").desc(), F.col("f_accn").desc_nulls_last(), "unit", "val",
    )
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*anchor.columns, "metric", "val", "tag", "taxonomy", "unit", F.col("f_filed").alias("fact_filed"))


def latest_annual(facts: DataFrame, tag_order: Sequence[tuple[str, str, int, str]]) -> DataFrame:
    """The annual value of each company, tag and end: the latest filing of 10-K and 10-K/A.

    tag_order: of with_tags(). A tag of a company that has FY rows keeps only these; a flow tag that then
    has rows of about a year keeps only these. Both choices hold for all its ends.
    """
    rows = with_tags(facts.where(F.col("form").isin("10-K", "10-K/A")), tag_order)
    by = Window.partitionBy("cik", "tag", "metric")
    fy = F.coalesce(F.col("fp") == "FY", F.lit(False))
    rows = rows.withColumn("_fy", fy).withColumn("_any", F.max("_fy").over(by)).where(F.col("_fy") | ~F.col("_any"))
    year = F.coalesce(F.datediff("end", "start").between(*ANNUAL_DAYS), F.lit(False))
    rows = rows.withColumn("_year", year).withColumn("_any", F.max("_year").over(by)).where((F.col("kind") != FLOW) | F.col("_year") | ~F.col("_any"))
    rows = rows.where(F.col("val").isNotNull() & F.col("end").isNotNull() & F.col("filed").isNotNull()).drop("_fy", "_year", "_any")
    return keep_first(rows, ["cik", "tag", "metric", "end"], F.col("filed").desc(), F.col("accn").desc_nulls_last(), "val")


def latest_value(facts: DataFrame) -> DataFrame:
    """The latest 10-K value of each company and tag: FY rows where there are any, of each fiscal year the last filed, the last year's."""
    rows = facts.where(F.col("form") == "10-K")
    fy = F.coalesce(F.col("fp") == "FY", F.lit(False))
    rows = rows.withColumn("_fy", fy).withColumn("_any", F.max("_fy").over(Window.partitionBy("cik", "tag"))).where(F.col("_fy") | ~F.col("_any")).drop("_fy", "_any")
    return keep_first(rows, ["cik", "tag"], F.col("fy").desc_nulls_first(), F.col("filed").desc_nulls_first(), F.col("accn").desc_nulls_last(), "val")


def best_tag(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of the latest end; of equal ends the first tag in order."""
    return keep_first(rows, key, F.col("end").desc(), "tag_rank", F.col("filed").desc(), "val")


def liabilities_or(total: str = "liabilities", both: str = "liabilities_and_equity", equity: str = "equity") -> tuple[Column, Column]:
    """Liabilities, else total of the balance sheet minus equity unless negative; and the method's name."""
    rest = F.col(both) - F.col(equity)
    value = F.when(F.col(total).isNotNull(), F.col(total)).when(rest >= 0, rest)
    name = F.when(F.col(total).isNotNull(), "reported").when(rest >= 0, "calculated").otherwise("missing")
    return value, name


METRICS = ("revenue", "operating_income", "net_income", "assets", "liabilities", "equity", "current_assets", "current_liabilities", "operating_cash_flow", "capital_expenditure")
FACTORS = (
    "revenue_growth", "operating_income_growth", "net_income_growth", "asset_growth", "operating_margin", "net_margin", "roa", "roe", "debt_ratio", "debt_to_equity", "current_ratio", "ocf_to_assets",
    "free_cash_flow_proxy",
)


def factor_panel(anchor: DataFrame, best: DataFrame) -> DataFrame:
    """Anchors with one column per metric, the previous comparable row's metrics and the derived factors.

    Liabilities that aren't reported are assets minus equity. Annual rows compare with the fiscal year before, quarterly
    ones with the same quarter of the year before, where a missing year fits any; else with the latest earlier end.
    """
    cells = [F.first(F.when(F.col("metric") == m, F.col("val")), ignorenulls=True).alias(m) for m in METRICS]
    wide = best.groupBy("cik", "accession_key").agg(*cells, F.count("*").alias("source_fact_count"), F.max("fact_filed").alias("_last"))
    rows = anchor.join(wide, ["cik", "accession_key"], "left").withColumn("period_type", clean.period_type("form"))
    rows = rows.withColumns({"liabilities": F.coalesce("liabilities", F.col("assets") - F.col("equity")), "source_fact_count": F.coalesce("source_fact_count", F.lit(0))})
    rows = rows.withColumn("pit_valid", F.coalesce(F.col("_last") <= F.col("filed"), F.lit(True))).drop("_last")
    annual = F.col("period_type") == "annual"
    rows = previous_comparable(rows, ["cik", "period_type"], "end", F.col("fy"), F.when(annual, "FY").otherwise(clean.fiscal_period("fp", "form")), list(METRICS), ["filed", "accession_key"], ~annual)
    return derived_factors(rows)


def derived_factors(rows: DataFrame) -> DataFrame:
    """The thirteen factors and how many there are. Returns are on the mean of both balances where there is a previous one."""
    d, g = clean.safe_divide, clean.safe_growth
    mean = lambda c: F.coalesce((F.col(c) + F.col(f"prev_{c}")) / 2, F.col(c))
    out = {f"{c}_growth": g(c, f"prev_{c}") for c in ("revenue", "operating_income", "net_income")} | {"asset_growth": g("assets", "prev_assets")}
    out |= {"operating_margin": d("operating_income", "revenue"), "net_margin": d("net_income", "revenue"), "roa": d("net_income", mean("assets")), "roe": d("net_income", mean("equity"))}
    out |= {"debt_ratio": d("liabilities", "assets"), "debt_to_equity": d("liabilities", "equity"), "current_ratio": d("current_assets", "current_liabilities")}
    out |= {"ocf_to_assets": d("operating_cash_flow", mean("assets")), "free_cash_flow_proxy": F.col("operating_cash_flow") - F.abs("capital_expenditure")}
    return rows.withColumns(out).withColumn("factor_available_count", clean.available(*FACTORS))


def financial_warnings() -> Column:
    """Codes of implausible values in a row of revenue, operating_income, net_income, assets and liabilities."""
    c = F.col
    return clean.codes(
        ("revenue_non_positive", c("revenue") <= 0), ("operating_income_exceeds_revenue", c("operating_income") > c("revenue")), ("net_income_exceeds_revenue", c("net_income") > c("revenue")),
        ("assets_non_positive", c("assets") <= 0), ("liabilities_negative", c("liabilities") < 0), ("liabilities_exceed_assets", c("liabilities") > c("assets")),
    )


def financial_ratios() -> dict[str, Column]:
    """Margins and leverage; NULL where a side is missing or the base is 0."""
    d = clean.safe_divide
    return {"operating_margin": d("operating_income", "revenue"), "net_margin": d("net_income", "revenue"), "liability_to_assets": d("liabilities", "assets")}


def period_issues(target: str, ends: dict[str, str]) -> Column:
    """Map of metric to issue where its end is missing or differs from the target's."""
    issue = lambda e: F.when(F.col(e).isNull(), "missing").when(F.col(e) != F.col(target), "different")
    pairs = [x for m, e in ends.items() for x in (F.lit(m), issue(e))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
