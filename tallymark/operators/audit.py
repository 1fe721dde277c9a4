"""Tag choice, company extracts, standard audits, scenario and holding diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clean
from . import facts as _facts
from .pick import keep_first


def search_tags(facts: DataFrame, keyword: str) -> DataFrame:
    """Distinct tags that hold the keyword, in any case."""
    return facts.where(F.contains(F.lower("tag"), F.lit(keyword.lower()))).select("tag").distinct()


def priority_tag(facts: DataFrame, order: Sequence[str], key: str) -> DataFrame:
    """The first tag of an ordered list that each entity has; the list is a literal of the plan."""
    return _facts.with_tags(facts, [("", tag, rank, "") for rank, tag in enumerate(order)]).groupBy(key).agg(F.min_by("tag", "tag_rank").alias("tag"))


def candidate_filter(candidates: DataFrame, themes: DataFrame, score: str = "score") -> DataFrame:
    """Included candidates with scores clipped to 0..100; a theme outside the quota table raises at run time."""
    known = themes.select(F.col("theme"), F.lit(True).alias("_known")).distinct()
    rows = candidates.where(clean.parse_bool("include")).join(known, "theme", "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown theme: "), F.coalesce("theme", F.lit("NULL")))).cast("boolean")).otherwise(True)
    return rows.withColumn("_ok", checked).where("_ok").withColumn(score, F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(100.0))).drop("_known", "_ok")


def key_lookup(requests: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """The first master row of each requested key (upper case, trimmed)."""
    norm = lambda df: df.withColumn(key, F.upper(F.trim(key)))
    first = keep_first(norm(master), [key], *[c for c in master.columns if c != key])
    return norm(requests).select(key).distinct().join(first, key)


def extend_panel(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old panel and the new one's series that it lacks."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"))


def missing_keys(requested: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(prices.where("close IS NOT NULL").select(key).distinct(), key, "left_anti")


def fill_metadata(rows: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Master attributes where the row has none."""
    extra = [c for c in master.columns if c != key]
    m = master.select(key, *[F.col(c).alias(f"_{c}") for c in extra])
    out = rows.join(m, key, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") if c in rows.columns else F.col(f"_{c}") for c in extra}).drop(*[f"_{c}" for c in extra])


def restated_prior(current: DataFrame, facts: DataFrame, tags: Sequence[tuple[str, str, int, str]]) -> DataFrame:
    """The prior period's fact in the current row's taxonomy, as known when the current row was filed.

    current: cik, accession_key, prev_end, filed, form, fy, fp, current_taxonomy, metric.
    """
    anchor = current.select("cik", "accession_key", F.col("prev_end").alias("end"), "filed", "form", (F.col("fy") - 1).alias("fy"), "fp", "current_taxonomy")
    best = _facts.best_facts(anchor.distinct(), facts, tags, F.col("current_taxonomy"))
    return best.select("cik", "accession_key", "metric", F.col("val").alias("restated_value"))


def company_extract(facts: DataFrame, tags: Sequence[tuple[str, str, int, str]], metrics: tuple[str, ...], lead: str = "revenue", as_of: Column | None = None, most_days: int = 500) -> DataFrame:
    """One row per company with annual lead values: every metric at the end of the latest one, with tag, end, year and filing date.

    tags: metric, tag, tag_rank, kind (a short list); besides metrics it may name liabilities_and_equity and equity, whose
    difference stands in for missing liabilities unless negative. Adds how liabilities came about, the age at as_of,
    warnings, ratios and which metrics lack the target's end.
    """
    annual = _facts.latest_annual(facts, tags)
    target = _facts.best_tag(annual.where(F.col("metric") == lead), ["cik"]).select("cik", F.col("end").alias("target_end"))
    at = annual.join(target, "cik").where(F.col("end") == F.col("target_end"))
    best = keep_first(at, ["cik", "metric"], F.col("filed").desc(), "tag_rank", "val")
    every = [*metrics, *[m for m in ("liabilities_and_equity", "equity", "liabilities") if m not in metrics]]
    parts = {"value": "val", "tag": "tag", "end": "end", "filed": "filed", "fy": "fy"}
    wide = best.groupBy("cik", "target_end").pivot("metric", every).agg(*[F.first(c).alias(n) for n, c in parts.items()])
    wide = wide.select("cik", "target_end", *[F.col(f"{m}_value").alias(m) for m in every], *[f"{m}_{n}" for m in every for n in parts if n != "value"])
    value, method = _facts.liabilities_or()
    rest = method == "calculated"
    rows = wide.withColumns({
        "liabilities_method": F.when(rest, "LiabilitiesAndEquity - Equity"), "liabilities_calculated": rest,
        "liabilities_tag": F.when(rest, F.concat(F.lit("CALCULATED:"), "liabilities_and_equity_tag", F.lit("-"), "equity_tag")).otherwise(F.col("liabilities_tag")),
        "liabilities_end": F.when(rest, F.col("target_end")).otherwise(F.col("liabilities_end")), "liabilities": value,
    })
    age = F.datediff(as_of if as_of is not None else F.current_date(), "target_end")
    rows = rows.withColumns({"data_age_days": age, "is_stale": age > most_days, "_codes": _facts.financial_warnings(), **_facts.financial_ratios()})
    issues = _facts.period_issues("target_end", {m: f"{m}_end" for m in metrics})
    rows = rows.withColumns({"financial_warning": F.size("_codes") > 0, "warning_count": F.size("_codes"), "warning_messages": F.when(F.size("_codes") > 0, F.array_join("_codes", "|")), "_issues": issues})
    text = F.array_join(F.transform(F.array_sort(F.map_entries("_issues")), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    rows = rows.withColumns({"period_consistent": F.size("_issues") == 0, "period_issues": F.when(F.size("_issues") > 0, text)})
    return rows.select(
        "cik", "target_end", *metrics, *[f"{m}_tag" for m in metrics], "liabilities_calculated", "liabilities_method", *[f"{m}_end" for m in metrics], F.col(f"{lead}_fy").alias(f"{lead}_fiscal_year"),
        F.col(f"{lead}_filed").alias(f"{lead}_filed_date"), "data_age_days", "is_stale", "financial_warning", "warning_count", "warning_messages", *_facts.financial_ratios(), "period_consistent", "period_issues",
    )


def company_records(companies: DataFrame, facts: DataFrame, extracted: DataFrame, key: str = "cik") -> tuple[DataFrame, DataFrame]:
    """Companies with their extract, and error rows for those without."""
    return companies.join(extracted, key), error_rows(companies, extracted, facts, key)


def standard_panel(factors: DataFrame, universe: DataFrame, columns: dict[str, tuple[str, ...]], key: str = "cik") -> tuple[DataFrame, DataFrame]:
    """Factor rows of the universe's entities fit for point-in-time use, and a row for each entity left without any.

    columns: availability_date, period_end, form, accession_number, pit_valid -> names that may hold them. Rows go without
    an availability date, before their period's end, or not valid; where an entity has annual or quarterly reports, other
    forms go; of equal filings the last counts.
    """
    rows = factors
    names = {c.lower(): c for c in factors.columns}
    for to, many in columns.items():
        found = next((names[m.lower()] for m in many if m.lower() in names), None)
        kind = "date" if to in ("availability_date", "period_end") else "boolean" if to == "pit_valid" else "string"
        value = F.col(found).cast(kind) if found else F.lit(True if to == "pit_valid" else "" if kind == "string" else None).cast(kind)
        rows = rows.withColumn(to, F.upper(F.trim(value)) if to == "form" else value)
    fit = rows.join(universe.select(key).distinct(), key, "left_semi").where(F.coalesce("pit_valid", F.lit(False)) & F.col("availability_date").isNotNull())
    supported = F.col("form").isin(*clean.ANNUAL_FORMS, "10-Q", "10-Q/A")
    fit = fit.withColumn("_s", supported).withColumn("_any", F.max("_s").over(Window.partitionBy(key))).where(F.col("_s") | ~F.col("_any")).drop("_s", "_any")
    fit = fit.where(F.col("period_end").isNull() | (F.col("availability_date") >= F.col("period_end")))
    once = keep_first(fit, [key, "availability_date", "period_end", "form", "accession_number"], *[F.col(c).desc_nulls_last() for c in factors.columns if c != key])
    panel = once.join(universe, key)
    some = factors.select(key, F.lit(True).alias("_f")).distinct()
    lost = universe.select(key).distinct().join(fit.select(key), key, "left_anti").join(some, key, "left")
    return panel, lost.select(key, F.lit("failed").alias("status"), F.when(F.col("_f"), "NO_VALID_ROW").otherwise("NO_FACTORS").alias("error_type"))


def error_rows(companies: DataFrame, extracted: DataFrame, facts: DataFrame, key: str = "cik") -> DataFrame:
    """Companies without an extract and why: no facts at all, or no annual lead value."""
    some = facts.select(key, F.lit(True).alias("_f")).distinct()
    out = companies.select(key).join(extracted.select(key), key, "left_anti").join(some, key, "left")
    return out.select(key, F.when(F.col("_f"), "NO_ANNUAL_VALUE").otherwise("NO_FACTS").alias("error_type"), F.col("_f").isNull().alias("structural_error"))


def standard_audit(best: DataFrame) -> DataFrame:
    """Standards behind each filing's metrics: the taxonomies joined, and whether they are mixed."""
    return best.groupBy("cik", "accession_key").agg(F.array_join(F.array_sort(F.collect_set("taxonomy")), "|").alias("taxonomies"), (F.countDistinct("taxonomy") > 1).alias("mixed"), F.count("*").alias("n_metrics"))


# Growth factors with their metric, and ratios with the metrics above and below the line.
GROWTHS = (("revenue_growth", "revenue"), ("operating_income_growth", "operating_income"), ("net_income_growth", "net_income"), ("asset_growth", "assets"))
WITHIN = (("operating_margin", "operating_income", "revenue"), ("debt_ratio", "liabilities", "assets"), ("roa", "net_income", "assets"))


def row_standards(panel: DataFrame, best: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Adds {metric}_standard, the financial taxonomy behind each metric of a row, and of the row before in its entity and
    period type its standard and end, form, year and period (prev_standard, before_end ...)."""
    wide = best.where(F.col("taxonomy").isin(*_facts.FINANCIAL)).groupBy("cik", "accession_key").pivot("metric", list(metrics)).agg(F.first("taxonomy"))
    rows = panel.join(wide.select("cik", "accession_key", *[F.col(m).alias(f"{m}_standard") for m in metrics]), ["cik", "accession_key"], "left")
    order = Window.partitionBy("cik", "period_type").orderBy("end", "filed", "accession_key")
    before = {"prev_standard": F.lag(F.coalesce("assets_standard", "revenue_standard")).over(order)} | {f"before_{c}": F.lag(c).over(order) for c in ("end", "form", "fy", "fp")}
    return rows.withColumns(before).withColumn("standard", F.coalesce("assets_standard", "revenue_standard", "net_income_standard"))


def restated_bases(rows: DataFrame, facts: DataFrame, tags: Sequence[tuple[str, str, int, str]]) -> DataFrame:
    """Adds restated_{metric}: the previous row's value under the current standard, as known when the current row was filed.

    Only rows whose standard differs from that of the row before are looked up, in one join for all metrics.
    """
    crossed = F.coalesce(F.col("standard") != F.col("prev_standard"), F.lit(False))
    rows = rows.withColumn("crossed", crossed)
    ask = rows.where("crossed").select("cik", "accession_key", F.col("before_end").alias("end"), "filed", F.col("before_form").alias("form"), F.col("before_fy").alias("fy"), F.col("before_fp").alias("fp"), "standard")
    best = _facts.best_facts(ask, facts, [t for t in tags if t[0] in dict(GROWTHS).values()], F.col("standard"))
    wide = best.groupBy("cik", "accession_key").pivot("metric", [m for _, m in GROWTHS]).agg(F.first("val"))
    return rows.join(wide.select("cik", "accession_key", *[F.col(m).alias(f"restated_{m}") for _, m in GROWTHS]), ["cik", "accession_key"], "left")


def block_mixed(rows: DataFrame) -> DataFrame:
    """Factors of rows (of restated_bases()) that mix accounting standards, blocked or made anew, and the log of decisions.

    Ratios whose two metrics stand under different standards in the row become NULL. Where the row's standard differs from
    the row's before, growths are on the restated base and roa on the mean with restated assets; without them they become
    NULL. Adds decisions: an array of factor, decision and reason in the order of the rules; decision_log() makes rows.
    """
    said = lambda on, factor, done, why: F.when(on, F.struct(F.lit(factor).alias("factor"), F.lit(done).alias("decision"), F.lit(why).alias("reason")))
    new, log = {}, []
    for factor, top, bottom in WITHIN:
        split = F.coalesce(F.col(f"{top}_standard") != F.col(f"{bottom}_standard"), F.lit(False))
        new[factor] = F.when(~split, F.col(factor))
        log.append(said(split, factor, "BLOCKED_NULLED", "STANDARDS_DIFFER_WITHIN_ROW"))
    for growth, metric in GROWTHS:
        base, crossed = F.col(f"restated_{metric}"), F.col("crossed")
        again = base.isNotNull() & F.col(metric).isNotNull() & (base != 0)
        new[growth] = F.when(~crossed, F.col(growth)).when(again, F.try_divide(F.col(metric), base) - 1)
        log += [said(crossed & again, growth, "RECOMPUTED_RESTATED", "RESTATED_BASE"), said(crossed & ~again, growth, "BLOCKED_NULLED", "NO_RESTATED_BASE")]
    base, crossed = F.col("restated_assets"), F.col("crossed") & new["roa"].isNotNull()
    again = base.isNotNull() & F.col("net_income").isNotNull() & F.col("assets").isNotNull()
    mean = (F.col("assets") + base) / 2
    log += [said(crossed & again, "roa", "RECOMPUTED_RESTATED", "RESTATED_MEAN_ASSETS"), said(crossed & ~again, "roa", "BLOCKED_NULLED", "NO_RESTATED_ASSETS")]
    new["roa"] = F.when(crossed & again, F.try_divide(F.col("net_income"), mean)).when(~crossed, new["roa"])
    return rows.withColumns({**new, "decisions": F.array_compact(F.array(*log))})


def decision_log(blocked: DataFrame, *key: str) -> DataFrame:
    """key, factor, decision and reason of each decision."""
    return blocked.select(*key, F.inline("decisions"))


def block_ratios(panel: DataFrame, mixed: str, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios whose two inputs stand under different standards become NULL, with the decision.

    ratios: ratio -> (standard column of the numerator, of the denominator).
    """
    out = {}
    for ratio, (a, b) in ratios.items():
        cross = F.coalesce(F.col(a) != F.col(b), F.lit(False)) & F.col(mixed)
        out[ratio] = F.when(~cross, F.col(ratio))
        out[f"{ratio}_decision"] = F.when(cross, "blocked").otherwise("unchanged")
    return panel.withColumns(out)


def scenario_rows(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Each row once for every scenario whose gate it passes, in a column scenario: later steps keep it as a key of their
    windows and aggregates, so all scenarios take one plan. A gate that is NULL is closed."""
    names = F.array_compact(F.array(*[F.when(gate, F.lit(name)) for name, gate in gates.items()]))
    return rows.withColumn("scenario", F.explode(names))


def scenario_weights(weights: DataFrame, names: tuple[str, ...], base: str, *key: str) -> DataFrame:
    """scenario, max_weight_diff and membership_changes of each against the base one; a missing weight is 0. One pass."""
    of = lambda n: F.coalesce(F.max(F.when(F.col("scenario") == n, F.col("weight"))), F.lit(0.0))
    wide = weights.groupBy(*key).agg(*[of(n).alias(f"_{i}") for i, n in enumerate(names)])
    first = F.col(f"_{names.index(base)}")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.abs(F.col(f"_{i}") - first).alias("d"), ((F.col(f"_{i}") > 0) != (first > 0)).alias("c")) for i, n in enumerate(names)]))
    return wide.select(each.alias("e")).groupBy(F.col("e.scenario").alias("scenario")).agg(F.max("e.d").alias("max_weight_diff"), F.count_if("e.c").alias("membership_changes"))


# Fixed value: the level of names without curated evidence.
UNSEEN = "EXISTING_CLASSIFICATION_ONLY"


def observed_status(status: str = "status", last: str = "last_valid", filed: str = "latest_filed") -> Column:
    """What was seen of a name, joined by '; ': trading up to its last price, or an audit status to check, and its last
    filing; UNVERIFIED where nothing was."""
    day = lambda c: F.col(c).cast("string")
    listed = F.when((F.col(status) == "OK") & F.col(last).isNotNull(), F.concat(F.lit("LISTED_TRADING(~"), day(last), F.lit(")")))
    check = F.when(F.col(status).isin("SUSPECTED_SUSPENSION", "DELISTED_OR_DATA_END"), F.concat(F.lit("CHECK("), status, F.lit(")")))
    filer = F.when(F.col(filed).isNotNull(), F.concat(F.lit("ACTIVE_FILER("), day(filed), F.lit(")")))
    return F.coalesce(F.nullif(F.concat_ws("; ", F.coalesce(listed, check), filer), F.lit("")), F.lit("UNVERIFIED"))


def evidence_levels(names: DataFrame, curated: DataFrame, key: str) -> DataFrame:
    """names with evidence_level and evidence_note: curated ones (key, evidence_level, evidence_note), else none but the
    classification; and business_status_observed."""
    rows = names.join(curated.select(key, "evidence_level", "evidence_note"), key, "left")
    note = F.lit("candidate list and theme only")
    return rows.withColumns({"evidence_level": F.coalesce("evidence_level", F.lit(UNSEEN)), "evidence_note": F.coalesce("evidence_note", note), "business_status_observed": observed_status()})


#: Columns of selection_rationale(), in order.
RATIONALE = (
    "universe_rank", "ticker", "entity_name", "theme", "sub_theme", "quota_theme", "selection_stage", "candidate_score", "ai_relevance_score", "quality_component", "factor_component", "selection_score",
    "data_quality_score", "factor_available_count", "selection_reason_doc",
)


def selection_rationale(chosen: DataFrame, most_factors: int = 13) -> DataFrame:
    """A row per chosen name with all that led to its choice and a sentence that states it.

    chosen: the columns of RATIONALE but the last. Numbers in the sentence are rounded half up.
    """
    whole, one = (lambda c: F.format_string("%.0f", F.round(F.col(c).cast("double"), 0))), (lambda c: F.format_string("%.1f", F.round(F.col(c).cast("double"), 1)))
    stage = F.when(F.col("selection_stage") == "theme_quota", "theme quota").otherwise("shortage fill")
    text = F.concat(
        "theme", F.lit("/"), "sub_theme", F.lit(": candidate score "), F.col("candidate_score").cast("int").cast("string"), F.lit(", selection score "), one("selection_score"), F.lit(" (relevance 60% x "), whole("ai_relevance_score"),
        F.lit(", quality 25% x "), whole("quality_component"), F.lit(", factors 15% x "), whole("factor_component"), F.lit("); "), stage, F.lit(", rank "), F.col("universe_rank").cast("string"), F.lit("; data quality "), whole("data_quality_score"),
        F.lit(", factors "), F.col("factor_available_count").cast("int").cast("string"), F.lit(f" of {most_factors}"),
    )
    return chosen.withColumn("selection_reason_doc", text).select(*RATIONALE)


def rationale(name: str, theme: str, *parts: tuple[str, str]) -> Column:
    """A sentence with the score's parts."""
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{label} "), F.format_number(F.col(c), 2)) for label, c in parts])
    return F.concat(F.col(name), F.lit(" ("), F.col(theme), F.lit("): "), text)


def name_map(pairs: dict[str, str]) -> Column:
    """A fixed map of names as one text `k->v; ...`."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("->"), e["value"])), "; ")


def group_strings(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Values of each key: joined in order, their number, least and greatest."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), "|").alias("joined"), F.count("*").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"))


def rolling_error(joined: DataFrame, rows: int = 63) -> DataFrame:
    """Tracking error of the last `rows` days, where there are as many. A row per trading day, so one ordering."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(rows - 1), 0)
    out = joined.where("ret IS NOT NULL").withColumns({"_n": F.count("*").over(w), "tracking_error": F.stddev_samp(F.col("ret") - F.col("bench")).over(w) * F.sqrt(F.lit(252.0))})
    return out.where(F.col("_n") == rows).select("date", "tracking_error")
