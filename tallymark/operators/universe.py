"""Entity master, name lookups, candidate matching and the target universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from .pick import keep_first, mode_of

# Exchanges, endings of derivative tickers and words of derivative names.
EXCHANGES = ("Nasdaq", "NYSE")
BAD_SUFFIX = r"-(UN|U|WT|WS|RT|R)$"
BAD_WORDS = ("WARRANT", "RIGHT", "UNIT", "BLANK CHECK", "ACQUISITION CORP", "ACQUISITION CORPORATION", "ACQUISITION CO")


def target_universe(master: DataFrame, n: int | None = None) -> DataFrame:
    """Plain tickers of the exchanges, each once, in order; names with a word of derivatives go (as part of a word, too)."""
    rows = master.where(F.col("exchange").isin(*EXCHANGES)).withColumn("ticker", F.upper(F.trim("ticker")))
    rows = keep_first(rows, ["ticker"], "cik", "name")
    rows = rows.where(~F.col("ticker").rlike(BAD_SUFFIX) & F.col("ticker").rlike("^[A-Z0-9]+$"))
    upper = F.upper(F.coalesce("name", F.lit("")))
    for word in BAD_WORDS:
        rows = rows.where(~upper.contains(word))
    rows = rows.orderBy("ticker")
    return rows.limit(n) if n else rows


def target_slice(master: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """One row per cik, in order of ticker and cik, from row `start` on."""
    rows = keep_first(master.where("cik <> '' AND cik <> '0000000000'"), ["cik"], "ticker").orderBy("ticker", "cik").offset(start)
    return rows.limit(limit) if limit else rows


def eligible_rows(rows: DataFrame, flag: str, date: str, ticker: str) -> DataFrame:
    """Rows whose flag says yes, with a date and a ticker (trimmed, upper case, neither blank nor NAN)."""
    out = rows.withColumns({date: clean.safe_date(date), ticker: F.upper(F.trim(F.col(ticker)))})
    return out.where(clean.parse_bool(flag) & F.col(date).isNotNull() & F.coalesce(~F.col(ticker).isin("", "NAN"), F.lit(False)))


def gate(rows: DataFrame, verdicts: DataFrame, *keys: str) -> DataFrame:
    """Rows but those that verdicts (keys, eligible) name as not eligible, by all keys together."""
    return rows.join(verdicts.where(~F.col("eligible")).select(*keys).distinct(), list(keys), "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that both tables have."""
    return a.select(*keys).intersect(b.select(*keys))


def representative(records: DataFrame, key: str, mode: str = "annual_preferred") -> DataFrame:
    """The record that stands for each entity, with the reason of its choice.

    annual_only: annual records alone (an entity without one has no row); annual_preferred: these where there are any,
    else all; latest_any: all. Of these the valid ones where there are any; then the latest end, filing, most factors,
    most source facts, greatest accession, missing values last.
    """
    if mode not in ("annual_only", "annual_preferred", "latest_any"):
        raise ValueError(f"no such mode: {mode}")
    annual = F.coalesce(F.col("period_type") == "annual", F.lit(False))
    valid = F.coalesce(F.col("pit_valid"), F.lit(False))
    rows = records.where(annual) if mode == "annual_only" else records
    lead = [annual.desc()] if mode == "annual_preferred" else []
    last = [c for c in ("period_end", "filed", "factor_available_count", "source_fact_count", "accession") if c in records.columns]
    base = {"annual_only": F.lit("latest_annual"), "latest_any": F.lit("latest_any"), "annual_preferred": F.when(annual, "latest_annual").otherwise("annual_missing_latest_any")}[mode]
    reason = F.concat(base, F.when(valid, "_pit_valid").otherwise(""))
    return keep_first(rows, [key], *lead, valid.desc(), *[F.col(c).desc_nulls_last() for c in last]).withColumn("selection_reason", reason)


def quality_score(core: list[str], factors: list[str], pit: Column, sources: Column) -> Column:
    """40 for core values, 35 for factors, 15 for validity, up to 10 for sources (none where their number is missing or negative)."""
    from_sources = F.least(F.lit(10.0), F.greatest(F.coalesce(sources.cast("double"), F.lit(0.0)), F.lit(0.0)) / 9.0 * 10)
    score = clean.available(*core) * 40.0 / len(core) + clean.available(*factors) * 35.0 / len(factors) + F.when(pit, 15.0).otherwise(0.0) + from_sources
    return F.bround(score, 2)


def financial_warning(revenue: str = "revenue", assets: str = "assets", income: str = "net_income", pit: str = "pit_valid") -> Column:
    """A core value is missing, revenue or assets aren't positive, or the row isn't known to be valid in time."""
    some = F.coalesce((clean.finite(F.col(revenue)) > 0) & (clean.finite(F.col(assets)) > 0), F.lit(False)) & clean.finite(F.col(income)).isNotNull()
    return ~(some & F.coalesce(F.col(pit), F.lit(False)))


def entity_master(records: DataFrame, tickers: DataFrame, key: str, core: list[str], factors: list[str]) -> DataFrame:
    """Representative record of each entity with its most frequent ticker, quality score and warning.

    records: key, the columns of representative(), core (with revenue, assets and net_income), factors, source_fact_count.
    """
    rows = representative(records, key).join(mode_of(tickers, [key], "ticker"), key, "left")
    return rows.withColumns({"data_quality_score": quality_score(core, factors, F.col("pit_valid"), F.col("source_fact_count")), "financial_warning": financial_warning()})


def name_lookup(rows: DataFrame, first: DataFrame, second: DataFrame, by_first: str, by_second: str, name: str) -> DataFrame:
    """Existing name, else that of the first table, else of the second (each key's least name); and where it came from."""
    a = first.groupBy(by_first).agg(F.min(name).alias("_a"))
    b = second.groupBy(by_second).agg(F.min(name).alias("_b"))
    out = rows.join(a, by_first, "left").join(b, by_second, "left")
    mine = F.nullif(F.trim(F.col(name)), F.lit(""))
    source = F.when(mine.isNotNull(), "existing").when(F.col("_a").isNotNull(), by_first).when(F.col("_b").isNotNull(), by_second).otherwise("none")
    return out.withColumn("name_source", source).withColumn(name, F.coalesce(mine, "_a", "_b")).drop("_a", "_b")


def match_candidates(candidates: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Candidates with the entity's columns (the candidate's own win) and whether there is one."""
    other = entities.select(key, *[c for c in entities.columns if c not in candidates.columns], F.lit(True).alias("_hit"))
    return candidates.join(other, key, "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that raises at run time where right has a key twice."""
    once = right.groupBy(key).agg(*[F.first(c).alias(c) for c in right.columns if c != key], F.count("*").alias("_n"))
    once = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).cast("int")).otherwise(1))
    return left.join(once, key, "left").where("_ok = 1 OR _ok IS NULL").drop("_n", "_ok")


def join_with_suffixes(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Left join; columns of both sides but the key get a suffix."""
    both = (set(left.columns) & set(right.columns)) - {key}
    a = left.select(*[F.col(c).alias(c + suffixes[0]) if c in both else F.col(c) for c in left.columns])
    b = right.select(*[F.col(c).alias(c + suffixes[1]) if c in both else F.col(c) for c in right.columns])
    return a.join(b, key, "left")


def override(rows: DataFrame, curated: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Curated values where there are any, else the defaults."""
    c = curated.select(key, *[F.col(k).alias(f"_{k}") for k in defaults])
    return rows.join(c, key, "left").withColumns({k: F.coalesce(f"_{k}", F.lit(v)) for k, v in defaults.items()}).drop(*[f"_{k}" for k in defaults])
