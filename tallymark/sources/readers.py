"""Readers of filings, dimensions and prices, and the writers that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..operators.pick import keep_first

MASTER = "cik string, ticker string, name string, exchange string"
FACT = "`start` string, `end` string, `val` string, `filed` string, `form` string, `accn` string, `fy` string, `fp` string"
FACTS_JSON = f"map<string, map<string, struct<units: map<string, array<struct<{FACT.replace(' string', ': string')}>>>>>>"


def company_master_json(spark: SparkSession, path: str) -> DataFrame:
    """A payload {fields: [...], data: [[...], ...]} as a table with the fields' names."""
    raw = spark.read.schema("fields array<string>, data array<array<string>>").json(path, multiLine=True)
    fields = raw.select("fields").first()[0]
    rows = raw.select(F.explode("data").alias("r"))
    return rows.select(*[F.get("r", i).alias(f) for i, f in enumerate(fields)])


def master_csv(spark: SparkSession, path: str) -> DataFrame:
    """Company master with cik as text; cik, ticker and exchange must be there."""
    df = spark.read.csv(path, header=True)
    if missing := {"cik", "ticker", "exchange"} - set(df.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df.withColumn("cik", clean.normalize_cik("cik"))


def candidates_csv(spark: SparkSession, path: str, themes: Sequence[str]) -> DataFrame:
    """Curated candidates with a header: ticker, theme, sub_theme and candidate_score must be there; include and note may.

    Texts are tidied, scores that can't be read are 0 and all lie within 0..100. Rows that aren't included or have no
    ticker go; of a ticker's rows the highest score stays, then the first theme. A theme that isn't in the list (a fixed,
    short one) raises when rows are read.
    """
    df = spark.read.csv(path, header=True)
    if missing := {"ticker", "theme", "sub_theme", "candidate_score"} - set(df.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    include = clean.parse_bool("include") if "include" in df.columns else F.lit(True)
    score = F.least(F.greatest(F.coalesce(clean.safe_numeric("candidate_score"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    note = clean.clean_text("note") if "note" in df.columns else F.lit("")
    rows = df.select(clean.normalize_ticker("ticker").alias("ticker"), clean.clean_text("theme").alias("theme"), clean.clean_text("sub_theme").alias("sub_theme"), score.alias("candidate_score"), include.alias("include"), note.alias("note"))
    rows = rows.where(F.col("include") & (F.col("ticker") != ""))
    known = F.when(~F.col("theme").isin(*themes), F.raise_error(F.concat(F.lit("unknown theme: "), "theme")).cast("boolean")).otherwise(True)
    return keep_first(rows.where(known), ["ticker"], F.col("candidate_score").desc(), "theme", "sub_theme", "note")


def flatten_facts(docs: DataFrame, text: str | Column = "value") -> DataFrame:
    """Nested company facts (taxonomy, tag, unit, records) as one long row per record.

    docs: cik, ticker and the JSON text of `facts`. Every record stays; dates and numbers that can't be read become NULL.
    """
    nested = docs.select("cik", "ticker", F.from_json(text, FACTS_JSON).alias("f"))
    by_taxonomy = nested.select("cik", "ticker", F.explode("f").alias("taxonomy", "tags"))
    by_tag = by_taxonomy.select("cik", "ticker", "taxonomy", F.explode("tags").alias("tag", "t"))
    by_unit = by_tag.select("cik", "ticker", "taxonomy", "tag", F.explode("t.units").alias("unit", "records"))
    rows = by_unit.select("cik", "ticker", "taxonomy", "tag", "unit", F.inline("records"))
    dates = {c: clean.safe_date(c) for c in ("start", "end", "filed")}
    return rows.withColumns({**dates, "val": clean.safe_numeric("val"), "fy": F.col("fy").try_cast("int")})


def single_tag(facts: DataFrame, tag: str, unit: str = "USD", taxonomy: str = "us-gaap") -> DataFrame:
    return facts.where((F.col("taxonomy") == taxonomy) & (F.col("tag") == tag) & (F.col("unit") == unit))


def load_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Parquet or CSV, by the path's ending."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True) if path.lower().endswith(".csv") else reader.parquet(path)


def long_prices(wide: DataFrame, date: str = "date", keep: tuple[str, ...] = ()) -> DataFrame:
    """One column per ticker becomes (date, ticker, close); keep: other columns that aren't tickers and stay."""
    tickers = [c for c in wide.columns if c not in (date, *keep)]
    typed = wide.select(F.col(date).cast("date").alias("date"), *keep, *[F.col(f"`{c}`").cast("double").alias(c.upper()) for c in tickers])
    return typed.unpivot(["date", *keep], [c.upper() for c in tickers], "ticker", "close").withColumn("close", clean.finite("close"))


def benchmark_series(df: DataFrame, name: str) -> DataFrame:
    """The first column after the date as a series of the long shape."""
    date, value = df.columns[:2]
    return df.select(F.col(date).cast("date").alias("date"), F.lit(name).alias("ticker"), F.col(value).cast("double").alias("close"))


def weights_table(df: DataFrame) -> DataFrame:
    return df.select(F.col("snapshot_date").cast("date").alias("snapshot_date"), F.upper(F.trim("ticker")).alias("ticker"), F.col("weight").cast("double").alias("weight"))


def weight_tickers(weights: DataFrame) -> DataFrame:
    """Distinct tickers of a weights table without blanks."""
    t = F.upper(F.trim("ticker"))
    return weights.select(t.alias("ticker")).where((F.col("ticker") != "") & (F.col("ticker") != "NAN")).distinct()


def write_facts(facts: DataFrame, path: str, buckets: int, mode: str = "errorifexists") -> None:
    """Fact store of all companies, clustered by cik; empty input raises."""
    if facts.isEmpty():
        raise ValueError("no facts to write")
    facts.repartition(buckets, "cik").sortWithinPartitions("cik", "tag", "end", "filed").write.mode(mode).parquet(path)


def run_log(targets: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """key, status (success, failed or remaining) and rows of each target: done has a row per fact, failed one per error."""
    n = done.groupBy(key).agg(F.count("*").alias("n_rows"))
    rows = targets.select(key).distinct().join(n, key, "left").join(failed.select(key, F.lit(True).alias("_f")).distinct(), key, "left")
    status = F.when(F.col("n_rows").isNotNull(), "success").when(F.col("_f"), "failed").otherwise("remaining")
    return rows.select(key, status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def tag_units(docs: DataFrame, text: str | Column = "value") -> DataFrame:
    """cik, taxonomy, tag and its units, in order, of nested company facts."""
    nested = docs.select("cik", F.from_json(text, FACTS_JSON).alias("f")).select("cik", F.explode("f").alias("taxonomy", "tags"))
    by_tag = nested.select("cik", "taxonomy", F.explode("tags").alias("tag", "t"))
    return by_tag.select("cik", "taxonomy", "tag", F.array_join(F.array_sort(F.map_keys("t.units")), "|").alias("units"))


def fact_store(spark: SparkSession, path: str, cik: str | None = None) -> DataFrame:
    """The fact store of write_facts(), of one company where cik is given (pushed to the scan), with each row's file."""
    df = spark.read.parquet(path).withColumn("source_file", F.input_file_name())
    return df.where(F.col("cik") == cik) if cik is not None else df


def write_both(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV and Parquet side by side."""
    df.write.mode(mode).parquet(f"{path}.parquet")
    df.write.mode(mode).option("header", True).csv(f"{path}.csv")


def nested_export(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One document per key with its rows as an ordered array of structs."""
    item = F.struct(F.col(order).alias("_o"), *columns)
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return rows.groupBy(key).agg(items.alias("items"), F.count("*").alias("n"))


def upsert_last(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def remaining(targets: DataFrame, done: DataFrame, *key: str, failed: DataFrame | None = None) -> DataFrame:
    """Targets that aren't done yet, and haven't failed before if failures are to be skipped."""
    out = targets.join(done.select(*key).distinct(), list(key), "left_anti")
    return out.join(failed.select(*key).distinct(), list(key), "left_anti") if failed is not None else out
