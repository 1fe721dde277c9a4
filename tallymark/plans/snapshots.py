"""Queries on snapshots: orders as filings, customers as companies, quarter ends as snapshot dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import asof, facts, integrity, score
from ..sources.stages import Stages, buckets_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderkey", "o_totalprice")


def quarters(spark, sf_dir) -> DataFrame:
    return asof.period_ends(read(spark, sf_dir, "orders"), "o_orderdate")


def asof_backward_quarterly(spark, sf_dir):
    return asof.pit_snapshot(filings(spark, sf_dir), quarters(spark, sf_dir), "o_custkey", "o_orderdate", ["o_orderkey"])


def rebalance_dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    parts = [asof.period_ends(o, "o_orderdate", m).withColumn("freq", F.lit(n)) for m, n in ((1, "ME"), (3, "QE"), (12, "YE"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def asof_per_column(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kinds = ["click", "purchase", "view"]
    rows = e.select("user_id", F.to_date("ts").alias("day"), "event_id", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds])
    days = e.select(F.to_date("ts").alias("snapshot_date")).distinct()
    return asof.asof_columns(rows, days, "user_id", "day", kinds, ["event_id"])


def asof_forward_entry(spark, sf_dir):
    days = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return asof.asof_forward(quarters(spark, sf_dir), days)


def pit_checks(spark, sf_dir):
    snap = asof_backward_quarterly(spark, sf_dir)
    return integrity.checklist(snap, {"future": F.col("o_orderdate") > F.col("snapshot_date"), "negative_age": F.col("information_age_days") < 0, "no_value": F.col("o_totalprice").isNull(), "stale_flag": F.col("stale") != (F.col("information_age_days") > 365)})


def screened(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    snap = asof_backward_quarterly(spark, sf_dir).join(c, "o_custkey")
    return score.screen(
        snap,
        {
            "age": (~F.col("stale"), "FRESH", "STALE_365D"),
            "size": (F.col("o_totalprice") >= 50000, "LARGE_ENOUGH", "TOO_SMALL"),
            "balance": (F.when(F.col("c_acctbal") != 0, F.col("c_acctbal") > 0), "POSITIVE_BALANCE", "NEGATIVE_BALANCE"),
            "warning": (None, "NO_WARNING", "WARNING"),
        },
    )


def _flat(df):
    return df.select("snapshot_date", "o_custkey", "eligible", "decision", "decision_reason", *[F.array_join(c, "|").alias(c) for c in ("passed_reasons", "failed_reasons", "unavailable_checks")])


def eligibility_reasons(spark, sf_dir):
    return _flat(screened(spark, sf_dir))


def reason_long(spark, sf_dir):
    return score.long_reasons(screened(spark, sf_dir), "snapshot_date", "o_custkey")


def stale_grace(spark, sf_dir):
    graced = score.stale_grace(screened(spark, sf_dir), "o_custkey", "snapshot_date", 2)
    return graced.select("snapshot_date", "o_custkey", "eligible", "decision", "decision_reason", "stale_grace_applied", "stale_grace_source_date", F.array_join("passed_reasons", "|").alias("passed_reasons"))


def eligibility_summary(spark, sf_dir):
    s = screened(spark, sf_dir).groupBy("snapshot_date").agg(F.countDistinct("o_custkey").alias("n_names"), F.sum(F.col("eligible").cast("long")).alias("n_eligible"))
    return s.withColumns({"n_excluded": F.col("n_names") - F.col("n_eligible"), "percent": F.round(F.col("n_eligible") * 100 / F.col("n_names"), 4)})


def prev_comparable_growth(spark, sf_dir):
    q = supplier_quarters(spark, sf_dir).select("l_suppkey", "quarter_end", "revenue")
    year = F.when((F.col("l_suppkey") + F.quarter("quarter_end") * 3 + F.year("quarter_end")) % 5 > 0, F.year("quarter_end"))  # a fifth of the fiscal years is missing
    rows = asof.previous_comparable(q, ["l_suppkey"], "quarter_end", year, F.quarter("quarter_end"), ["revenue"], [], F.lit(True))
    return rows.select("l_suppkey", "quarter_end", F.round("revenue", 4).alias("revenue"), "prev_end", F.round(clean.safe_growth("revenue", "prev_revenue"), 6).alias("growth"))


def supplier_quarters(spark, sf_dir, rows=lambda li: li, exact: bool = False) -> DataFrame:
    """exact: sums that don't depend on the order of rows, for scores."""
    li = rows(read(spark, sf_dir, "lineitem"))
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    total, mean = (score.exact_sum, score.exact_mean) if exact else (F.sum, F.avg)
    return li.groupBy("l_suppkey", end.alias("quarter_end")).agg(
        total(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), mean(F.col("l_discount")).alias("discount"), total(F.col("l_quantity")).alias("quantity"), mean(F.col("l_tax")).alias("tax")
    )


def _order_facts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as filings, lineitems as their facts (known within 60 days), flags as tags in order of preference."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cik"), F.to_date("o_orderdate").alias("end"), F.date_add(F.to_date("o_orderdate"), 60).alias("filed"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form"), F.year("o_orderdate").alias("fy"), F.lit("Q1").alias("fp"))
    anchor = o.withColumn("accession_key", F.col("cik"))
    li = read(spark, sf_dir, "lineitem").join(o.select(F.col("cik"), F.col("end")), F.col("l_orderkey").cast("string") == F.col("cik"))
    fact = li.select(
        "cik", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("accn"), F.lit("us-gaap").alias("taxonomy"), F.col("l_returnflag").alias("tag"), F.lit("USD").alias("unit"), F.lit(None).cast("date").alias("start"),
        "end", F.to_date("l_shipdate").alias("filed"), F.when(F.col("l_linestatus") == "F", "10-K").otherwise("10-Q").alias("form"), F.year("l_shipdate").alias("fy"), F.lit("Q1").alias("fp"), F.col("l_extendedprice").alias("val"),
    )
    tags = [("amount", "R", 0, facts.STOCK), ("amount", "A", 1, facts.STOCK), ("open", "N", 0, facts.STOCK)]
    return anchor, fact, tags


def best_fact_choice(spark, sf_dir):
    anchor, fact, tags = _order_facts(spark, sf_dir)
    return facts.best_facts(anchor, fact, tags).select("cik", "metric", "tag", F.round("val", 4).alias("val"))


def bucketed_fact_choice(spark, sf_dir):
    """best_fact_choice over stores of anchors and facts that are bucketed by company and end."""
    anchor, fact, tags = _order_facts(spark, sf_dir)
    n = buckets_for(read(spark, sf_dir, "lineitem"), max(8, spark.sparkContext.defaultParallelism))
    with Stages(spark) as stages:
        best = facts.best_facts(stages.bucketed(anchor, n, "cik", "end"), stages.bucketed(fact, n, "cik", "end"), tags)
        return stages.result(best.select("cik", "metric", "tag", F.round("val", 4).alias("val")))


def filing_anchors(spark, sf_dir):
    _, fact, _ = _order_facts(spark, sf_dir)
    return facts.anchors(fact).select("cik", F.col("accession_key"), "filed", "form")


_Q = """
b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
q AS (SELECT snapshot_date FROM (SELECT last_day(CAST(d AS DATE) + INTERVAL 2 MONTH) AS snapshot_date, lo, hi
      FROM (SELECT lo, hi, unnest(generate_series(date_trunc('year', lo), hi + INTERVAL 3 MONTH, INTERVAL 3 MONTH)) AS d FROM b))
      WHERE snapshot_date BETWEEN lo AND hi)"""
_SNAP = f"""{_Q},
r AS (SELECT snapshot_date, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey, o_totalprice,
        row_number() OVER (PARTITION BY snapshot_date, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
      FROM q JOIN orders ON CAST(o_orderdate AS DATE) <= snapshot_date),
snap AS (SELECT snapshot_date, o_custkey, o_orderdate, o_orderkey, o_totalprice, CAST(snapshot_date - o_orderdate AS INTEGER) AS information_age_days,
         snapshot_date - o_orderdate > 365 AS stale FROM r WHERE n = 1)"""
_SCREEN = f"""{_SNAP},
c AS (SELECT s.*, c_acctbal FROM snap s JOIN customer ON c_custkey = o_custkey),
screened AS (SELECT snapshot_date, o_custkey, o_totalprice, NOT (stale OR o_totalprice < 50000 OR c_acctbal < 0) AS eligible,
  concat_ws('|', CASE WHEN NOT stale THEN 'FRESH' END, CASE WHEN o_totalprice >= 50000 THEN 'LARGE_ENOUGH' END, CASE WHEN c_acctbal > 0 THEN 'POSITIVE_BALANCE' END) AS passed_reasons,
  concat_ws('|', CASE WHEN stale THEN 'STALE_365D' END, CASE WHEN o_totalprice < 50000 THEN 'TOO_SMALL' END, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE_BALANCE' END) AS failed_reasons,
  concat_ws('|', CASE WHEN c_acctbal = 0 THEN 'balance' END, 'warning') AS unavailable_checks FROM c)"""
_DECIDE = "CASE WHEN eligible THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision, CASE WHEN eligible THEN 'ELIGIBLE' ELSE replace(failed_reasons, '|', ' | ') END AS decision_reason"
_SUPQ = """supq AS (SELECT l_suppkey, last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS quarter_end,
  sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS discount, sum(l_quantity) AS quantity, avg(l_tax) AS tax FROM lineitem GROUP BY ALL)"""
_SPINE = """SELECT snapshot_date, '{f}' AS freq FROM (SELECT last_day(CAST(d AS DATE) + INTERVAL {k} MONTH) AS snapshot_date, lo, hi
  FROM (SELECT lo, hi, unnest(generate_series(date_trunc('year', lo), hi + INTERVAL {m} MONTH, INTERVAL {m} MONTH)) AS d FROM b)) WHERE snapshot_date BETWEEN lo AND hi"""
_FACTS = """
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS cik, CAST(o_orderdate AS DATE) AS d_end, CAST(o_orderdate AS DATE) + 60 AS filed, o_orderstatus = 'F' AS annual, year(o_orderdate) AS fy FROM orders),
f AS (SELECT CAST(l_orderkey AS VARCHAR) AS cik, CAST(l_shipdate AS DATE) AS filed, l_returnflag AS tag, l_linestatus = 'F' AS annual, year(l_shipdate) AS fy,
      l_orderkey || '-' || l_linenumber || '-' || l_partkey AS accn, l_extendedprice AS val FROM lineitem)"""
ORACLES = {
    "asof_backward_quarterly": f"WITH {_SNAP} SELECT * FROM snap",
    "rebalance_dates": f"""WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)
{_SPINE.format(f="ME", k=0, m=1)} UNION ALL {_SPINE.format(f="QE", k=2, m=3)} UNION ALL {_SPINE.format(f="YE", k=11, m=12)}""",
    "asof_per_column": """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS snapshot_date FROM events), u AS (SELECT DISTINCT user_id FROM events)
SELECT snapshot_date, u.user_id,
  arg_max(CASE WHEN event_type = 'click' THEN value END, (CAST(ts AS DATE), event_id)) FILTER (event_type = 'click') AS click,
  arg_max(CASE WHEN event_type = 'purchase' THEN value END, (CAST(ts AS DATE), event_id)) FILTER (event_type = 'purchase') AS purchase,
  arg_max(CASE WHEN event_type = 'view' THEN value END, (CAST(ts AS DATE), event_id)) FILTER (event_type = 'view') AS view
FROM d CROSS JOIN u LEFT JOIN events e ON e.user_id = u.user_id AND CAST(ts AS DATE) <= snapshot_date GROUP BY ALL""",
    "asof_forward_entry": f"WITH {_Q} SELECT snapshot_date, min(CAST(l_shipdate AS DATE)) AS entry_date FROM q LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) >= snapshot_date GROUP BY snapshot_date",
    "pit_checks": f"""WITH {_SNAP}, k AS (SELECT 'future' AS "check", count(*) FILTER (o_orderdate > snapshot_date) AS violations FROM snap
UNION ALL SELECT 'negative_age', count(*) FILTER (information_age_days < 0) FROM snap UNION ALL SELECT 'no_value', count(*) FILTER (o_totalprice IS NULL) FROM snap
UNION ALL SELECT 'stale_flag', count(*) FILTER (stale <> (information_age_days > 365)) FROM snap) SELECT "check", violations, violations = 0 AS passed FROM k""",
    "eligibility_reasons": f"WITH {_SCREEN} SELECT snapshot_date, o_custkey, eligible, {_DECIDE}, passed_reasons, failed_reasons, unavailable_checks FROM screened",
    "reason_long": f"""WITH {_SCREEN} SELECT snapshot_date, o_custkey, eligible, 'passed' AS type, unnest(string_split(passed_reasons, '|')) AS reason FROM screened WHERE passed_reasons <> ''
UNION ALL SELECT snapshot_date, o_custkey, eligible, 'failed', unnest(string_split(failed_reasons, '|')) FROM screened WHERE failed_reasons <> ''""",
    "stale_grace": f"""WITH {_SCREEN}, i AS (SELECT *, dense_rank() OVER (ORDER BY snapshot_date) AS i FROM screened),
e AS (SELECT i, o_custkey, snapshot_date AS d FROM i WHERE eligible),
s AS (SELECT i.i, i.o_custkey, max(d) AS d FROM i JOIN e ON e.o_custkey = i.o_custkey AND e.i BETWEEN i.i - 2 AND i.i - 1 GROUP BY ALL),
g AS (SELECT i.*, d, failed_reasons = 'STALE_365D' AND d IS NOT NULL AS grace FROM i LEFT JOIN s USING (i, o_custkey))
SELECT snapshot_date, o_custkey, eligible OR grace AS eligible, CASE WHEN eligible OR grace THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision,
  CASE WHEN eligible THEN 'ELIGIBLE' WHEN grace THEN 'ELIGIBLE_VIA_STALE_GRACE' ELSE replace(failed_reasons, '|', ' | ') END AS decision_reason, grace AS stale_grace_applied,
  CASE WHEN grace THEN d END AS stale_grace_source_date, concat_ws('|', nullif(passed_reasons, ''), CASE WHEN grace THEN 'STALE_GRACE_APPLIED' END) AS passed_reasons FROM g""",
    "eligibility_summary": f"""WITH {_SCREEN}, s AS (SELECT snapshot_date, count(DISTINCT o_custkey) AS n_names, CAST(count(*) FILTER (eligible) AS BIGINT) AS n_eligible FROM screened GROUP BY snapshot_date)
SELECT *, n_names - n_eligible AS n_excluded, round(n_eligible * 100 / n_names, 4) AS percent FROM s""",
    "prev_comparable_growth": f"""WITH {_SUPQ}, y AS (SELECT *, CASE WHEN (l_suppkey + quarter(quarter_end) * 3 + year(quarter_end)) % 5 > 0 THEN year(quarter_end) END AS fy FROM supq),
p AS (SELECT a.l_suppkey, a.quarter_end, a.revenue, b.quarter_end AS prev_end, b.revenue AS prev_revenue,
  row_number() OVER (PARTITION BY a.l_suppkey, a.quarter_end ORDER BY coalesce(quarter(b.quarter_end) = quarter(a.quarter_end), false) AND (a.fy IS NULL OR b.fy IS NULL OR b.fy = a.fy - 1) DESC, b.quarter_end DESC) AS n
  FROM y a LEFT JOIN y b ON a.l_suppkey = b.l_suppkey AND b.quarter_end < a.quarter_end)
SELECT l_suppkey, quarter_end, round(revenue, 4) AS revenue, prev_end, round(revenue / prev_revenue - 1, 6) AS growth FROM p WHERE n = 1""",
    "best_fact_choice": f"""WITH {_FACTS}, t AS (SELECT * FROM (VALUES ('amount', 'R', 0), ('amount', 'A', 1), ('open', 'N', 0)) AS t(metric, tag, tag_rank)),
p AS (SELECT o.cik, metric, f.tag, val, row_number() OVER (PARTITION BY o.cik, metric ORDER BY (f.annual = o.annual) DESC, (f.fy = o.fy) DESC, tag_rank, f.filed DESC, accn DESC, val) AS n
  FROM o JOIN f ON o.cik = f.cik AND f.filed <= o.filed JOIN t ON f.tag = t.tag)
SELECT cik, metric, tag, round(val, 4) AS val FROM p WHERE n = 1""",
    "filing_anchors": f"WITH {_FACTS} SELECT f.cik, accn AS accession_key, max(f.filed) AS filed, arg_max(CASE WHEN f.annual THEN '10-K' ELSE '10-Q' END, (f.filed, tag)) AS form FROM f GROUP BY f.cik, accn",
}
ORACLES["bucketed_fact_choice"] = ORACLES["best_fact_choice"]
QUERIES = {n: globals()[n] for n in ORACLES}
