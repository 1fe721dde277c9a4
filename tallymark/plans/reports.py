"""Queries on cleaning, lookups, quality reports, evidence and standards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import facts, integrity, pick, universe
from ..sources import readers
from .snapshots import _Q, _SUPQ, quarters, read, supplier_quarters


def clean_keys(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    raw = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, ".0").when(F.col("c_custkey") % 3 == 1, "-x").otherwise(""))
    name = F.when(F.col("c_custkey") % 5 == 0, "NaN").when(F.col("c_custkey") % 5 == 1, "  ").otherwise(F.col("c_name"))
    return c.select("c_custkey", clean.normalize_cik(raw).alias("cik"), clean.clean_text(name).alias("name"), clean.normalize_ticker(F.lower(F.col("c_name"))).alias("ticker"))


def bool_parse(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 4 == 0, " Yes").when(F.col("p_size") % 4 == 1, "0").when(F.col("p_size") % 4 == 2, "eligible")
    return p.select("p_partkey", clean.parse_bool(raw).alias("plain"), clean.parse_bool(raw, ("eligible",)).alias("scored"), clean.parse_bool(raw, default=True).alias("lenient"))


def numeric_parse(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    cents = F.floor(F.col("o_totalprice")).cast("long")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.format_number(cents, 0), F.lit("%"))).when(F.col("o_orderkey") % 4 == 1, "n/a").when(F.col("o_orderkey") % 4 == 2, "Infinity").otherwise(cents.cast("string"))
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("31/31/1999")
    return o.select("o_orderkey", clean.safe_numeric(raw).alias("value"), clean.safe_date(day).alias("day"))


def universe_filter(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("cik"), F.concat(F.lit(" t"), (F.col("c_custkey") % 700).cast("string"), F.when(F.col("c_custkey") % 11 == 0, "-WT").otherwise("")).alias("ticker"),
        F.when(F.col("c_custkey") % 7 == 0, "United Corp").when(F.col("c_custkey") % 13 == 0, "First Acquisition Corp").when(F.col("c_custkey") % 17 == 0, "Preferred Depositary Inc").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "Nasdaq").when(F.col("c_nationkey") % 3 == 0, "NYSE").otherwise("OTC").alias("exchange"),
    )
    return universe.target_universe(c)


def target_slice(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(clean.normalize_cik("s_nationkey").alias("cik"), F.col("s_name").alias("ticker"))
    return universe.target_slice(s, 3, 10)


def json_flatten(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    record = '[{"end":"2024-01-10","val":"%s","filed":"2024-02-30","form":"10-K","accn":"%s"},{"start":"2023-01-01","end":"2023-12-31","val":"x","filed":"2024-01-31","fy":"2023"}]'
    text = F.format_string(f'{{"us-gaap":{{"%s":{{"units":{{"USD":{record}}}}}}}}}', "event_type", F.get_json_object("props", "$.k"), F.col("event_id").cast("string"))
    docs = e.select(F.col("event_id").cast("string").alias("cik"), F.col("user_id").cast("string").alias("ticker"), text.alias("value"))
    return readers.flatten_facts(docs).select("cik", "ticker", "taxonomy", "tag", "unit", "start", "end", "val", "filed", "form", "accn", "fy")


def json_export(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    out = readers.nested_export(s, "s_nationkey", ["s_suppkey", "s_name"], "s_suppkey")
    return out.select("s_nationkey", F.to_json("items").alias("items"), "n")


def coverage(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("large"), F.nullif("o_orderstatus", F.lit("P")).alias("closed"))
    return integrity.coverage(o)


def numeric_summary(spark, sf_dir):
    n = integrity.numeric_summary(read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "c_acctbal", "c_nationkey")
    return n.select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max", "std")])


def distribution(spark, sf_dir):
    return integrity.distribution(read(spark, sf_dir, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING"))), "seg")


def rule_violations(spark, sf_dir):
    return integrity.rule_violations(read(spark, sf_dir, "customer"), ["c_acctbal"], ["c_acctbal", "c_nationkey"])


def key_summary(spark, sf_dir):
    return integrity.key_summary(read(spark, sf_dir, "orders"), "o_custkey")


def ambiguous_keys(spark, sf_dir):
    return integrity.ambiguous(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


def name_lookup_chain(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise("").alias("name"))
    first = read(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("name"))
    second = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    return universe.name_lookup(s, first, second, "s_suppkey", "s_nationkey", "name")


def candidate_match(spark, sf_dir):
    cand = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("theme"))
    ent = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("entity"), F.lit("other").alias("theme"))
    return universe.match_candidates(cand, ent, "key")


def one_to_one_join(spark, sf_dir):
    ranked = pick.keep_first(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), ["c_custkey"], F.col("o_totalprice").desc(), "o_orderkey")
    return universe.join_one_to_one(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), ranked, "c_custkey")


def suffix_join(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return universe.join_with_suffixes(a, b, "key", ("_left", "_right"))


def entity_master(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("period_end"), F.date_add(F.to_date("o_orderdate"), 40).alias("filed"), F.when(F.col("o_orderpriority").startswith("1"), "annual").otherwise("quarterly").alias("period_type"),
        (F.col("o_orderkey") % 5 != 0).alias("pit_valid"), (F.col("o_orderkey") % 8).cast("int").alias("factor_available_count"), F.col("o_orderkey").alias("accession"), (F.col("o_totalprice") - 30000).alias("revenue"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("net_income"), F.when(F.col("o_orderkey") % 7 > 0, F.lit(1.0)).alias("assets"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(1.0)).alias("margin"),
        F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderkey") % 12 - 2).alias("source_fact_count"),
    )
    tickers = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("ticker"))
    out = universe.entity_master(o, tickers, "o_custkey", ["revenue", "net_income", "assets"], ["margin"])
    return out.select("o_custkey", "ticker", "accession", "period_type", "selection_reason", "data_quality_score", "financial_warning")


def warning_codes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") - 20000).alias("revenue"), F.lit(90000.0).alias("operating_income"), F.when(F.col("o_orderkey") % 3 > 0, F.lit(40000.0)).alias("net_income"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 4 * 40000.0 - 40000).alias("assets"), (F.col("o_totalprice") - 15000).alias("liabilities"),
    )
    w = o.withColumn("codes", facts.financial_warnings())
    return w.select("o_orderkey", F.size("codes").alias("warning_count"), F.when(F.size("codes") > 0, F.array_join("codes", "|")).alias("warnings"))


def transition_flags(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc("l_shipdate", "quarter").alias("quarter"), "l_linestatus", "l_returnflag")
    return integrity.standard_transitions(li.withColumn("standard", F.col("l_returnflag")), ["l_suppkey"], "quarter", "standard")


def pivot_provenance(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return integrity.provenance(li, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "l_shipdate", "l_linenumber").select("l_suppkey", *[F.to_date(f"{f}_l_shipdate").alias(f"{f}_day") for f in "ANR"], *[f"{f}_l_linenumber" for f in "ANR"])


def classify_standard(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "us-gaap").when(F.col("l_returnflag") == "R", "ifrs-full").otherwise("dei").alias("taxonomy"))
    return integrity.classify_standard(li, "l_orderkey")


def cross_block(spark, sf_dir):
    q = supplier_quarters(spark, sf_dir).select("l_suppkey", "quarter_end", F.round("revenue", 2).alias("revenue"), F.round("quantity", 2).alias("quantity"))
    q = q.withColumns({"crossed": F.col("quantity") % 3 == 0, "restated": F.when(F.col("quantity") % 2 == 0, F.round(F.col("revenue") * 0.9, 2)), "growth": F.lit(0.5)})
    out = integrity.block_cross_standard(q, "crossed", {"growth": ("revenue", "restated")})
    return out.select("l_suppkey", "quarter_end", F.round("growth", 6).alias("growth"), "growth_decision")


def null_where(spark, sf_dir):
    li = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    keys = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return integrity.null_where(li, keys, ["o_custkey"], "o_totalprice", "o_orderpriority")


_KINDS = {"click": "ANNUAL_CONFIRM", "signup": "KEYWORD_DECLINE", "purchase": "OFFICIAL_EXIT", "view": "NO_NEW_INFO"}


def status_transition(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("evidence_date"), F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("PARTIAL_DIVEST")).alias("kind"))
    days = e.where("dayofmonth(evidence_date) % 7 = 1").select(F.col("evidence_date").alias("snapshot_date")).distinct()
    return integrity.status_history(e, days, "user_id")


def status_step(spark, sf_dir):
    """Each event as one piece of evidence on a status, at a rebalance up to three weeks before or after it."""
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    states = F.array(*[F.lit(s) for s in ("ACTIVE", "REDUCED", "DISCONTINUED", "UNCERTAIN", "NOT_REVIEWED")])
    e = read(spark, sf_dir, "events").select(
        "event_id", F.element_at(states, (F.col("user_id") % 5 + 1).cast("int")).alias("previous_status"), F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("PARTIAL_DIVEST")).alias("kind"),
        F.to_date("ts").alias("evidence_date"), F.date_add(F.to_date("ts"), (F.col("event_id") % 43 - 21).cast("int")).alias("rebalance_date"),
    )
    return integrity.status_step(e, "previous_status", "kind", "evidence_date", "rebalance_date").select("event_id", "previous_status", "new_status", "status_changed", "change_reason", "exclusion_candidate", "pit_ok")


def representative_modes(spark, sf_dir):
    """Each customer's representative order under the three modes."""
    o = read(spark, sf_dir, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("period_end"), F.date_add(F.to_date("o_orderdate"), 40).alias("filed"), F.when(F.col("o_orderpriority").startswith("1"), "annual").otherwise("quarterly").alias("period_type"),
        (F.col("o_orderkey") % 5 == 0).alias("pit_valid"), (F.col("o_orderkey") % 8).cast("int").alias("factor_available_count"), F.col("o_orderkey").alias("accession"),
    )
    parts = [universe.representative(o, "o_custkey", m).select("o_custkey", F.lit(m).alias("mode"), "accession", "selection_reason") for m in ("annual_only", "annual_preferred", "latest_any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def first_text(spark, sf_dir):
    """Each customer's first order clerk text that says something, by day and order."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" NaN ")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), "o_orderpriority")).alias("text"))
    return o.groupBy("o_custkey").agg(clean.first_text("text", "day", "o_orderkey").alias("first_text"))


def financial_ratios(spark, sf_dir):
    """Margins and leverage of orders; every fifth has no revenue, every third no assets."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).otherwise(0.0).alias("revenue"), (F.col("o_totalprice") / 4).alias("operating_income"), (F.col("o_totalprice") / 8 - 1000).alias("net_income"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") * 2).alias("assets"), (F.col("o_totalprice") - 5000).alias("liabilities"),
    )
    return o.select("o_orderkey", *[F.round(c, 6).alias(n) for n, c in facts.financial_ratios().items()])


def theme_gate(spark, sf_dir):
    days = quarters(spark, sf_dir)
    ev = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("evidence_date"))
    names = integrity.first_evidence(read(spark, sf_dir, "customer").select("c_custkey"), ev, "c_custkey")  # joined before the quarters are added: the grid isn't shuffled
    modes = F.array(*[F.struct(integrity.theme_open("snapshot_date", r).alias("theme_eligible"), F.lit(m).alias("mode")) for r, m in ((False, "pit"), (True, "retro"))])
    return names.crossJoin(F.broadcast(days)).select("c_custkey", "snapshot_date", F.inline(modes))


def event_windows(spark, sf_dir):
    """Each customer's first finished order is its event, all its orders are snapshots."""
    ev = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("effective_date"))
    snaps = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("snapshot_date"))
    return integrity.event_windows(ev, snaps, "c_custkey")


def override_dimension(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    curated = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("verdict"))
    return universe.override(rows, curated, "n_nationkey", {"verdict": "NONE"})


def resume_anti(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return readers.remaining(o.select("o_orderkey"), o.where("o_orderkey % 3 = 0"), "o_orderkey", failed=o.where("o_orderkey % 5 = 0"))


def upsert_last(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 4 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("new").alias("batch"))
    return readers.upsert_last(o, new, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "batch")


def run_outcomes(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 5 == 0, "failed").when(F.col("o_orderkey") % 3 == 0, "skipped").otherwise("success")
    return read(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def latest_snapshot(spark, sf_dir):
    return pick.latest_rows(supplier_quarters(spark, sf_dir).select("l_suppkey", "quarter_end", F.round("revenue", 4).alias("revenue")), "quarter_end")


def keep_if_any(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return pick.keep_if_any(o, F.col("o_orderstatus") == "F", "o_custkey")


def last_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return pick.top_n(o, ["o_custkey"], 6, F.col("day").desc(), F.col("o_orderkey").desc())


def period_consistency(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("target"), F.to_date("o_orderdate").alias("revenue_end"), F.when(F.col("o_orderkey") % 3 > 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 2).cast("int"))).alias("assets_end"))
    out = o.withColumn("issues", facts.period_issues("target", {"revenue": "revenue_end", "assets": "assets_end"}))
    return out.select("o_orderkey", F.array_join(F.transform(F.map_entries("issues"), lambda e: F.concat_ws(":", e["key"], e["value"])), ";").alias("issues"))


def liabilities_fallback(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("liabilities"), F.lit(100000.0).alias("liabilities_and_equity"), F.col("o_totalprice").alias("equity"))
    value, method = facts.liabilities_or()
    return o.select("o_orderkey", F.round(value, 2).alias("liabilities"), method.alias("method"))


_EVID = "e AS (SELECT user_id, CAST(ts AS DATE) AS evidence_date, CASE event_type WHEN 'click' THEN 'ANNUAL_CONFIRM' WHEN 'signup' THEN 'KEYWORD_DECLINE' WHEN 'purchase' THEN 'OFFICIAL_EXIT' WHEN 'view' THEN 'NO_NEW_INFO' ELSE 'PARTIAL_DIVEST' END AS kind FROM events), d AS (SELECT DISTINCT evidence_date AS snapshot_date FROM e WHERE day(evidence_date) % 7 = 1)"
_STATE_SQL = "CASE kind WHEN 'OFFICIAL_EXIT' THEN 'DISCONTINUED' WHEN 'PARTIAL_DIVEST' THEN 'REDUCED' WHEN 'KEYWORD_DECLINE' THEN 'UNCERTAIN' WHEN 'ANNUAL_CONFIRM' THEN 'ACTIVE' END"
ORACLES = {
    "clean_keys": """SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN c_custkey % 5 IN (0, 1) THEN '' ELSE trim(c_name) END AS name, regexp_replace(upper(trim(c_name)), '[^A-Z0-9.\\-]', '', 'g') AS ticker FROM customer""",
    "bool_parse": "SELECT p_partkey, p_size % 4 = 0 AS plain, p_size % 4 IN (0, 2) AS scored, p_size % 4 <> 1 AS lenient FROM part",
    "numeric_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 3) THEN floor(o_totalprice) END AS value, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "universe_filter": """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS cik, 'T' || (c_custkey % 700) || CASE WHEN c_custkey % 11 = 0 THEN '-WT' ELSE '' END AS ticker, CASE WHEN c_custkey % 7 = 0 THEN 'United Corp' WHEN c_custkey % 13 = 0 THEN 'First Acquisition Corp' WHEN c_custkey % 17 = 0 THEN 'Preferred Depositary Inc' ELSE c_name END AS name,
  CASE WHEN c_nationkey % 2 = 0 THEN 'Nasdaq' WHEN c_nationkey % 3 = 0 THEN 'NYSE' ELSE 'OTC' END AS exchange FROM customer)
SELECT * FROM (SELECT * FROM c WHERE exchange <> 'OTC' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY cik, name) = 1)
WHERE ticker NOT LIKE '%-%' AND NOT regexp_matches(upper(name), 'WARRANT|RIGHT|UNIT|BLANK CHECK|ACQUISITION CO')""",
    "target_slice": """SELECT * FROM (SELECT CASE WHEN s_nationkey >= 0 THEN lpad(CAST(s_nationkey AS VARCHAR), 10, '0') END AS cik, min(s_name) AS ticker FROM supplier WHERE s_nationkey <> 0 GROUP BY 1) ORDER BY ticker, cik LIMIT 10 OFFSET 3""",
    "json_flatten": """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS cik, CAST(user_id AS VARCHAR) AS ticker, event_type AS tag, CAST(props::JSON->>'$.k' AS DOUBLE) AS k FROM events)
SELECT cik, ticker, 'us-gaap' AS taxonomy, tag, 'USD' AS unit, CAST(NULL AS DATE) AS start, DATE '2024-01-10' AS "end", k AS val, CAST(NULL AS DATE) AS filed, '10-K' AS form, cik AS accn, CAST(NULL AS INTEGER) AS fy FROM e
UNION ALL SELECT cik, ticker, 'us-gaap', tag, 'USD', DATE '2023-01-01', DATE '2023-12-31', NULL, DATE '2024-01-31', NULL, NULL, 2023 FROM e""",
    "json_export": """SELECT s_nationkey, '[' || string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']' AS items, count(*) AS n FROM supplier GROUP BY s_nationkey""",
    "coverage": """WITH o AS (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS large, nullif(o_orderstatus, 'P') AS closed FROM orders), c AS (
SELECT 'o_orderkey' AS "column", count(o_orderkey) AS non_null, count(*) AS n FROM o UNION ALL SELECT 'large', count(large), count(*) FROM o UNION ALL SELECT 'closed', count(closed), count(*) FROM o)
SELECT "column", non_null, n - non_null AS missing, round_even(non_null * 100 / n, 4) AS percent FROM c""",
    "numeric_summary": """WITH c AS (SELECT 'c_acctbal' AS "column", c_acctbal AS v FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)
SELECT "column", count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_samp(v), 6) AS std FROM c GROUP BY 1""",
    "distribution": """WITH n AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'Missing' ELSE c_mktsegment END AS value, count(*) AS n FROM customer GROUP BY 1) SELECT value, n, round_even(n * 100 / (SELECT sum(n) FROM n), 2) AS percent FROM n""",
    "rule_violations": """WITH k AS (SELECT 'c_acctbal:negative' AS "check", count(*) FILTER (c_acctbal < 0) AS violations FROM customer UNION ALL SELECT 'c_acctbal:non_positive', count(*) FILTER (c_acctbal <= 0) FROM customer
UNION ALL SELECT 'c_nationkey:non_positive', count(*) FILTER (c_nationkey <= 0) FROM customer) SELECT "check", violations, violations = 0 AS passed FROM k""",
    "key_summary": "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, count(*) - count(DISTINCT o_custkey) AS n_duplicates, CAST(6 AS INTEGER) AS n_columns FROM orders",
    "ambiguous_keys": "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_values FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1",
    "name_lookup_chain": """SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE coalesce(c_name, n_name) END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'existing' WHEN c_name IS NOT NULL THEN 's_suppkey' WHEN n_name IS NOT NULL THEN 's_nationkey' ELSE 'none' END AS name_source
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_custkey % 4 = 0 LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 2 = 0""",
    "candidate_match": "SELECT c_custkey AS key, c_mktsegment AS theme, s_name AS entity, s_suppkey IS NOT NULL AS matched FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "one_to_one_join": "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON o_custkey = c_custkey",
    "suffix_join": "SELECT c_custkey AS key, c_nationkey AS nation_left, c_name AS name, s_nationkey AS nation_right, s_acctbal AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "entity_master": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS d, o_orderpriority LIKE '1%' AS annual FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY annual DESC, (o_orderkey % 5 <> 0) DESC, d DESC, o_orderkey % 8 DESC, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 12 - 2 END DESC NULLS LAST, o_orderkey DESC) AS n FROM o),
m AS (SELECT o_custkey, arg_max(o_orderpriority, (n, o_orderpriority)) AS ticker FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)
SELECT o_custkey, ticker, o_orderkey AS accession, CASE WHEN annual THEN 'annual' ELSE 'quarterly' END AS period_type, CASE WHEN annual THEN 'latest_annual' ELSE 'annual_missing_latest_any' END || CASE WHEN o_orderkey % 5 <> 0 THEN '_pit_valid' ELSE '' END AS selection_reason,
  round_even((1 + CAST(o_orderkey % 3 = 0 AS INTEGER) + CAST(o_orderkey % 7 > 0 AS INTEGER)) * 40.0::DOUBLE / 3 + (CASE WHEN o_orderkey % 2 = 0 THEN 35.0::DOUBLE ELSE 0 END) + (CASE WHEN o_orderkey % 5 <> 0 THEN 15.0::DOUBLE ELSE 0 END) + CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE least(10.0::DOUBLE, greatest(o_orderkey % 12 - 2, 0) / 9.0::DOUBLE * 10) END, 2) AS data_quality_score,
  o_totalprice <= 30000 OR o_orderkey % 3 <> 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 AS financial_warning FROM r JOIN m USING (o_custkey) WHERE n = 1""",
    "warning_codes": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice - 20000 END AS r, CASE WHEN o_orderkey % 3 > 0 THEN 40000 END AS ni, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 * 40000 - 40000 END AS a, o_totalprice - 15000 AS l FROM orders),
c AS (SELECT o_orderkey, concat_ws('|', CASE WHEN r <= 0 THEN 'revenue_non_positive' END, CASE WHEN 90000 > r THEN 'operating_income_exceeds_revenue' END, CASE WHEN ni > r THEN 'net_income_exceeds_revenue' END,
  CASE WHEN a <= 0 THEN 'assets_non_positive' END, CASE WHEN l < 0 THEN 'liabilities_negative' END, CASE WHEN l > a THEN 'liabilities_exceed_assets' END) AS c FROM o)
SELECT o_orderkey, CAST(CASE WHEN c = '' THEN 0 ELSE len(c) - len(replace(c, '|', '')) + 1 END AS INTEGER) AS warning_count, nullif(c, '') AS warnings FROM c""",
    "transition_flags": """WITH n AS (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, l_returnflag AS standard, count(*) AS n FROM lineitem GROUP BY ALL),
u AS (SELECT l_suppkey, quarter, arg_max(standard, (n, standard)) AS standard FROM n GROUP BY 1, 2), p AS (SELECT *, lag(standard) OVER (PARTITION BY l_suppkey ORDER BY quarter) AS previous_standard FROM u)
SELECT *, coalesce(previous_standard <> standard, false) AS crossed FROM p""",
    "pivot_provenance": f"""SELECT l_suppkey, {", ".join(f"CAST(min(l_shipdate) FILTER (l_returnflag = '{f}') AS DATE) AS {f}_day, min(l_linenumber) FILTER (l_returnflag = '{f}') AS {f}_l_linenumber" for f in "ANR")} FROM lineitem GROUP BY 1""",
    "classify_standard": """WITH n AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_us_gaap, count(*) FILTER (l_returnflag = 'R') AS n_ifrs FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN n_us_gaap > 0 AND n_ifrs > 0 THEN 'MIXED_FILER' WHEN n_us_gaap > 0 THEN 'US-GAAP' WHEN n_ifrs > 0 THEN 'IFRS' ELSE 'UNKNOWN' END AS standard FROM n""",
    "cross_block": f"""WITH {_SUPQ}, q AS (SELECT l_suppkey, quarter_end, round(revenue, 2) AS revenue, round(quantity, 2) AS quantity FROM supq), r AS (SELECT *, CASE WHEN quantity % 2 = 0 THEN round(revenue * 0.9::DOUBLE, 2) END AS restated, quantity % 3 = 0 AS crossed FROM q)
SELECT l_suppkey, quarter_end, round(CASE WHEN NOT crossed THEN 0.5::DOUBLE WHEN restated <> 0 THEN revenue / restated - 1 END, 6) AS growth, CASE WHEN NOT crossed THEN 'unchanged' WHEN restated IS NOT NULL THEN 'restated' ELSE 'blocked' END AS growth_decision FROM r""",
    "null_where": "SELECT o_custkey, o_orderkey, CASE WHEN c_custkey IS NULL THEN o_totalprice END AS o_totalprice, CASE WHEN c_custkey IS NULL THEN o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal < 0",
    "status_transition": f"""WITH {_EVID}, s AS (SELECT user_id, snapshot_date, arg_max(kind, (evidence_date, kind)) FILTER (evidence_date <= snapshot_date AND {_STATE_SQL} IS NOT NULL) AS change_reason,
  count(*) FILTER (evidence_date <= snapshot_date AND {_STATE_SQL} IS NOT NULL) AS n_evidence FROM d CROSS JOIN e GROUP BY 1, 2),
t AS (SELECT user_id, snapshot_date, change_reason, n_evidence, coalesce({_STATE_SQL.replace("kind", "change_reason")}, 'NOT_REVIEWED') AS status FROM s),
p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY snapshot_date), 'NOT_REVIEWED') AS previous_status FROM t)
SELECT *, status <> previous_status AS status_changed, status = 'DISCONTINUED' AS exclusion_candidate FROM p""",
    "status_step": """WITH e AS (SELECT event_id, ['ACTIVE', 'REDUCED', 'DISCONTINUED', 'UNCERTAIN', 'NOT_REVIEWED'][user_id % 5 + 1] AS p, CASE event_type WHEN 'click' THEN 'ANNUAL_CONFIRM' WHEN 'signup' THEN 'KEYWORD_DECLINE' WHEN 'purchase' THEN 'OFFICIAL_EXIT' WHEN 'view' THEN 'NO_NEW_INFO' ELSE 'PARTIAL_DIVEST' END AS k, event_id % 43 - 21 < 0 AS later FROM events),
n AS (SELECT *, CASE WHEN later THEN p ELSE CASE k WHEN 'ANNUAL_CONFIRM' THEN 'ACTIVE' WHEN 'KEYWORD_DECLINE' THEN 'UNCERTAIN' WHEN 'OFFICIAL_EXIT' THEN 'DISCONTINUED' WHEN 'PARTIAL_DIVEST' THEN 'REDUCED' ELSE p END END AS s FROM e)
SELECT event_id, p AS previous_status, s AS new_status, s <> p AS status_changed, CASE WHEN later THEN 'PIT_EVIDENCE_AFTER_REBALANCE' ELSE k END AS change_reason, s = 'DISCONTINUED' AS exclusion_candidate, NOT later AS pit_ok FROM n""",
    "representative_modes": """WITH o AS (SELECT o_custkey, o_orderkey AS a, o_orderpriority LIKE '1%' AS annual, o_orderkey % 5 = 0 AS ok, CAST(o_orderdate AS DATE) AS d, o_orderkey % 8 AS f FROM orders),
m AS (SELECT o.*, 'annual_only' AS mode FROM o WHERE annual UNION ALL SELECT o.*, 'annual_preferred' FROM o QUALIFY annual OR NOT bool_or(annual) OVER (PARTITION BY o_custkey) UNION ALL SELECT o.*, 'latest_any' FROM o),
v AS (SELECT * FROM m QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY mode, o_custkey)), r AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY mode, o_custkey ORDER BY d DESC, f DESC, a DESC) = 1)
SELECT o_custkey, mode, a AS accession, CASE WHEN mode = 'latest_any' THEN 'latest_any' WHEN annual THEN 'latest_annual' ELSE 'annual_missing_latest_any' END || CASE WHEN ok THEN '_pit_valid' ELSE '' END AS selection_reason FROM r""",
    "first_text": "SELECT o_custkey, coalesce(arg_min(o_orderpriority, (CAST(o_orderdate AS DATE), o_orderkey)) FILTER (o_orderkey % 3 = 1), '') AS first_text FROM orders GROUP BY 1",
    "financial_ratios": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / 4 / o_totalprice, 6) END AS operating_margin, CASE WHEN o_orderkey % 5 > 0 THEN round((o_totalprice / 8 - 1000) / o_totalprice, 6) END AS net_margin,
  CASE WHEN o_orderkey % 3 > 0 THEN round((o_totalprice - 5000) / (o_totalprice * 2), 6) END AS liability_to_assets FROM orders""",
    "theme_gate": f"""WITH {_Q}, ev AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_totalprice > 300000 GROUP BY 1), x AS (SELECT c_custkey, snapshot_date, ev.d FROM customer CROSS JOIN q LEFT JOIN ev ON o_custkey = c_custkey)
SELECT c_custkey, snapshot_date, NOT coalesce(snapshot_date >= d, false) AS theme_eligible, 'pit' AS mode FROM x UNION ALL SELECT c_custkey, snapshot_date, d IS NULL, 'retro' FROM x""",
    "event_windows": """WITH ev AS (SELECT o_custkey AS c_custkey, CAST(min(o_orderdate) AS DATE) AS effective_date FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, effective_date, count(*) FILTER (CAST(o_orderdate AS DATE) <= effective_date) AS n_before, count(*) FILTER (CAST(o_orderdate AS DATE) > effective_date) AS n_after,
  max(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) <= effective_date) AS last_before, min(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) > effective_date) AS first_after FROM ev LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
    "override_dimension": "SELECT n_nationkey, n_name, coalesce(r_name, 'NONE') AS verdict FROM nation LEFT JOIN region ON r_regionkey = n_nationkey",
    "resume_anti": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0",
    "upsert_last": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN 'new' END AS batch FROM orders",
    "run_outcomes": "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'skipped' ELSE 'success' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "latest_snapshot": f"WITH {_SUPQ} SELECT l_suppkey, quarter_end, round(revenue, 4) AS revenue FROM supq WHERE quarter_end = (SELECT max(quarter_end) FROM supq)",
    "keep_if_any": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY o_orderstatus = 'F' OR NOT max(o_orderstatus = 'F') OVER (PARTITION BY o_custkey)",
    "last_rows": "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) <= 6",
    "period_consistency": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'assets:missing' WHEN o_orderkey % 2 = 1 THEN 'assets:different' ELSE '' END AS issues FROM orders",
    "liabilities_fallback": """SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice WHEN 100000 - o_totalprice >= 0 THEN 100000 - o_totalprice END, 2) AS liabilities,
  CASE WHEN o_orderkey % 2 = 0 THEN 'reported' WHEN 100000 - o_totalprice >= 0 THEN 'calculated' ELSE 'missing' END AS method FROM orders""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
