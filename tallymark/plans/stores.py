"""Queries on stores: tables written in the library's formats and read back, and runs that are taken up again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns
from ..operators import universe
from ..sources import readers
from ..sources.runs import Runs
from ..sources.stages import Stages, buckets_for, shared_folder
from .audits import _VERDICT, gate_verdicts
from .filings import yearly_facts
from .snapshots import _SUPQ, read, supplier_quarters


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def master_csv(spark, sf_dir):
    """Suppliers as a company master in CSV, with keys as text."""
    path = _folder(spark)
    rows = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 10).alias("cik"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("name"), F.lit("Nasdaq").alias("exchange"))
    rows.write.option("header", True).csv(path)
    return readers.master_csv(spark, path)


def candidate_seed(spark, sf_dir):
    """Parts as curated candidates in CSV, some twice, excluded or without a readable score."""
    path = _folder(spark)
    part = read(spark, sf_dir, "part").select(
        F.concat(F.lit(" p"), (F.col("p_partkey") % 1000).cast("string")).alias("ticker"), "p_partkey", F.col("p_brand").alias("theme"), F.col("p_type").alias("sub_theme"),
        F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise((F.col("p_size") * 3).cast("string")).alias("candidate_score"), F.when(F.col("p_partkey") % 5 == 0, "no").otherwise(" Yes ").alias("include"), F.col("p_partkey").cast("string").alias("note"),
    )
    part.drop("p_partkey").write.option("header", True).csv(path)
    return readers.candidates_csv(spark, path, [f"Brand#{k}" for k in range(100)])


def eligible_filter(spark, sf_dir):
    """Orders with untidy flags, dates and tickers."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "FALSE").when(F.col("o_orderkey") % 3 == 1, " true").otherwise("1").alias("is_eligible"),
        F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.col("o_orderdate").cast("string")).alias("snapshot_date"),
        F.when(F.col("o_orderkey") % 11 == 0, " nan ").when(F.col("o_orderkey") % 13 == 0, "  ").when(F.col("o_orderkey") % 17 > 0, F.concat(F.lit(" c"), F.col("o_custkey").cast("string"))).alias("ticker"),
    )
    return universe.eligible_rows(o, "is_eligible", "snapshot_date", "ticker").select("o_orderkey", "snapshot_date", "ticker")


def gated_rows(spark, sf_dir):
    """Supplier quarters without those judged ineligible at their quarter."""
    verdicts = gate_verdicts(spark, sf_dir).select("l_suppkey", "quarter_end", F.col("pit").alias("eligible"))
    return universe.gate(supplier_quarters(spark, sf_dir).select("l_suppkey", "quarter_end", F.round("quantity", 2).alias("quantity")), verdicts, "l_suppkey", "quarter_end")


def shared_days(spark, sf_dir):
    """Days with both orders and shipments, as two calendars share them."""
    o = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return universe.shared_keys(o, read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")), "date")


def fact_store_scan(spark, sf_dir):
    """The fact store written by company and one company's facts after another counted from it."""
    path = _folder(spark)
    readers.write_facts(yearly_facts(spark, sf_dir)[0], path, buckets_for(read(spark, sf_dir, "lineitem")))
    store = readers.fact_store(spark, path)
    return store.groupBy("cik").agg(F.count("*").alias("n_facts"), F.countDistinct("source_file").alias("n_files"), F.round(F.sum("val"), 2).alias("total"))


def dual_sinks(spark, sf_dir):
    """Suppliers written as CSV and Parquet, read back from both by the path's ending."""
    path = _folder(spark)
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    readers.write_both(rows, path)
    both = [readers.load_table(spark, f"{path}.{kind}", rows.schema).withColumn("kind", F.lit(kind)) for kind in ("csv", "parquet")]
    return both[0].unionByName(both[1])


def aliased_columns(spark, sf_dir):
    """A table whose columns go by other names: resolved, completed, required and put in order."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_name").alias("Company_Name"), F.col("c_custkey").alias("CIK_STR"), F.col("c_acctbal").alias("balance"))
    named = columns.resolve_aliases(rows, {"cik": ("cik_str", "central_index_key"), "name": ("company_name", "title")}, ("cik",))
    return columns.order_columns(columns.require_columns(columns.ensure_columns(named, {"exchange": "string", "ticker": "string"}), ("cik", "exchange")), "cik", "ticker", "name")


def sorted_rows(spark, sf_dir):
    """Orders in one total order by several keys, numbered through range partitions: the order that writers keep."""
    with Stages(spark) as stages:
        rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"), "o_totalprice")
        parts = max(8, spark.sparkContext.defaultParallelism)
        order = [F.col("o_orderpriority"), F.col("day").desc(), F.col("o_totalprice").desc(), F.col("o_orderkey")]
        ordered = stages.write(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
        by = ordered.groupBy("_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per part
        numbered = ordered.join(F.broadcast(by.withColumn("_before", before)), "_part")
        return stages.result(numbered.select((F.col("_before") + F.col("_place") - F.col("_first") + 1).alias("position"), "o_orderkey", "o_orderpriority", "day"))


def _two_runs(spark, sf_dir) -> tuple[Runs, list[dict]]:
    """Customers' orders collected in two attempts: the even customers, then all; very large orders are errors at first."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    runs = Runs(spark, _folder(spark), "o_custkey")

    def work(limit: float):
        return lambda todo: o.join(todo, "o_custkey", "left_semi").withColumn("_error", F.when(F.col("o_totalprice") > limit, "TOO_LARGE"))

    first = runs.run(c.where("o_custkey % 2 = 0"), work(450_000.0))
    return runs, [first, runs.run(c, work(480_000.0))]


def run_resume(spark, sf_dir):
    """The log of both attempts; what succeeded in the first isn't done again."""
    return _two_runs(spark, sf_dir)[0].log().select("attempt", "key", "status", "n_rows", "error")


def run_rows(spark, sf_dir):
    """What the two attempts left: rows of each customer from the attempt that succeeded."""
    return _two_runs(spark, sf_dir)[0].rows().groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_COUNTS = ("target_count", "existing_count", "remaining_count", "current_success", "current_failure", "final_success_count", "final_error_count")


def run_counts(spark, sf_dir) -> DataFrame:
    counts = _two_runs(spark, sf_dir)[1]
    return spark.createDataFrame([(i + 1, *[c[n] for n in _COUNTS]) for i, c in enumerate(counts)], "attempt int, " + ", ".join(f"{n} long" for n in _COUNTS))


_RUNS = """o AS (SELECT c_custkey AS k, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
a AS (SELECT *, n > 0 AND top <= 450000 AND k % 2 = 0 AS one, n > 0 AND top <= 480000 AS two FROM o)"""
_LOG = """l AS (SELECT 1 AS attempt, k, n, CASE WHEN one THEN 'success' ELSE 'failed' END AS status FROM a WHERE k % 2 = 0 UNION ALL SELECT 2, k, n, CASE WHEN one THEN 'skipped' WHEN two THEN 'success' ELSE 'failed' END FROM a)"""
ORACLES = {
    "master_csv": "SELECT lpad(CAST(s_suppkey * 10 AS VARCHAR), 10, '0') AS cik, 'S' || s_suppkey AS ticker, s_name AS name, 'Nasdaq' AS exchange FROM supplier",
    "candidate_seed": """WITH c AS (SELECT 'P' || p_partkey % 1000 AS ticker, p_brand AS theme, p_type AS sub_theme, CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE least(p_size * 3, 100)::DOUBLE END AS candidate_score, true AS include, CAST(p_partkey AS VARCHAR) AS note FROM part WHERE p_partkey % 5 > 0)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY candidate_score DESC, theme, sub_theme, note) = 1""",
    "eligible_filter": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS snapshot_date, 'C' || o_custkey AS ticker FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 17 > 0",
    "gated_rows": f"WITH {_SUPQ}, {_VERDICT} SELECT l_suppkey, quarter_end, round(quantity, 2) AS quantity FROM srows WHERE scenario = 'B_pit'",
    "shared_days": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)",
    "fact_store_scan": "SELECT CAST(o_custkey AS VARCHAR) AS cik, count(*) AS n_facts, CAST(1 AS BIGINT) AS n_files, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "dual_sinks": "SELECT s_suppkey, s_name, s_acctbal, k AS kind FROM supplier, (VALUES ('csv'), ('parquet')) AS t(k)",
    "aliased_columns": "SELECT c_custkey AS cik, CAST(NULL AS VARCHAR) AS ticker, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS exchange FROM customer",
    "sorted_rows": "SELECT row_number() OVER (ORDER BY o_orderpriority, CAST(o_orderdate AS DATE) DESC, o_totalprice DESC, o_orderkey) AS position, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders",
    "run_resume": f"WITH {_RUNS}, {_LOG} SELECT attempt, CAST(k AS VARCHAR) AS key, status, CASE WHEN status = 'success' THEN n ELSE 0 END AS n_rows, CASE WHEN status = 'failed' THEN CASE WHEN n = 0 THEN 'NO_ROWS' ELSE 'TOO_LARGE' END END AS error FROM l",
    "run_rows": f"WITH {_RUNS} SELECT k AS o_custkey, n, total FROM a WHERE one OR two",
    "run_counts": f"""WITH {_RUNS}, {_LOG} SELECT attempt, count(*) AS target_count, count(*) FILTER (status = 'skipped') AS existing_count, count(*) FILTER (status <> 'skipped') AS remaining_count, count(*) FILTER (status = 'success') AS current_success,
  count(*) FILTER (status = 'failed') AS current_failure, count(*) FILTER (status <> 'failed') AS final_success_count, count(*) FILTER (status = 'failed') AS final_error_count FROM l GROUP BY attempt""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
