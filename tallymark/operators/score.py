"""Cross-sectional scores, eligibility screens and capped weights."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pick import top_n


def _parts(value: Column) -> tuple[Column, Column]:
    """Sum of a group's doubles as a decimal of ten places, and whether all of them are finite and below 1e9.

    Whole parts and fractions are added as integers, so that the order of rows doesn't matter.
    """
    fits = F.abs(value) < 1e9
    whole = F.when(fits, F.floor(value))
    rest = F.rint((value - whole.cast("double")) * 1e10).try_cast("long")
    total = F.try_sum(whole).cast("decimal(20,0)") + F.try_sum(rest).cast("decimal(20,0)") * F.lit(Decimal("1e-10"))
    return total, F.bool_and(fits)


def exact_sum(value: Column) -> Column:
    """Sum of doubles, to ten decimals, that doesn't depend on the order of rows: the last bits of a sum of doubles do, and
    they break ties of ranks and turn roundings of halves. A group with greater or non-finite values is added as doubles."""
    total, fits = _parts(value)
    return F.coalesce(F.when(fits, total.cast("double")), F.sum(value))


def exact_mean(value: Column) -> Column:
    """Mean of doubles, as exact_sum()."""
    total, fits = _parts(value)
    return F.coalesce(F.when(fits, (total / F.count(value)).cast("double")), F.sum(value) / F.count(value))


def percentile(value: str, by: list[str], higher_is_better: bool = True, single: float | None = 50.0) -> Column:
    """Average rank among the non-null values of a group, in percent; of a single value `single`."""
    v = F.col(value)
    group = Window.partitionBy(*by)
    order = Window.partitionBy(*by).orderBy(v.asc_nulls_last() if higher_is_better else v.desc_nulls_last())
    ties = F.count(v).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # the rank's own sort
    n = F.count(v).over(group)
    score = (F.rank().over(order) + (ties - 1) / 2.0) / n * 100
    if single is not None:
        score = F.when(n == 1, F.lit(single)).otherwise(score)
    return F.when(v.isNotNull(), score)


def composite(scores: dict[str, float]) -> tuple[Column, Column]:
    """Weighted mean of the scores that are there (weights renormalised), and how many there are."""
    total, weight, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for c, w in scores.items():
        total = total + F.coalesce(F.col(c) * w, F.lit(0.0))
        weight = weight + F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0)
        n = n + F.col(c).isNotNull().cast("int")
    return F.try_divide(total, weight), n


def minmax(value: str, stats: DataFrame | None = None, default: float = 50.0) -> Column:
    """0 to 100 between the columns {value}_min and {value}_max; default where all are equal or the value is missing."""
    low, high = F.col(f"{value}_min"), F.col(f"{value}_max")
    return F.coalesce(F.when(high > low, (F.col(value) - low) / (high - low) * 100), F.lit(default))


def with_minmax(df: DataFrame, *values: str) -> DataFrame:
    """Adds global minima and maxima by a one-row aggregate, not by a window over everything."""
    stats = df.agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("max", F.max))])
    return df.join(F.broadcast(stats), F.lit(True))


def capped_weights(df: DataFrame, by: list[str], score: str, cap: float, *tie: str) -> DataFrame:
    """Adds raw_weight, weight, weight_capped and effective_cap: weights proportional to score, none over cap.

    Closed form of repeated capping and sharing out: sorted by score, the least k names are capped for which the next
    one's share of what is left stays within the cap. A cap that can't be reached (cap * n < 1) becomes 1/n; scores
    without a positive one give equal weights.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy(F.col("_s").desc(), *tie)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = df.withColumn("_s", F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_s", F.when(F.max("_s").over(group) > 0, F.col("_s")).otherwise(1.0))
    rows = rows.withColumns({"_n": F.count("*").over(group), "_k": F.row_number().over(order) - 1, "_suffix": F.sum("_s").over(rest), "_sum": F.sum("_s").over(group)})
    rows = rows.withColumn("effective_cap", F.greatest(F.lit(cap), 1.0 / F.col("_n")))
    # with the k names before this one capped, its weight would be
    share = (1 - F.col("_k") * F.col("effective_cap")) * F.try_divide(F.col("_s"), F.col("_suffix"))
    fits = F.coalesce(share, F.lit(0.0)) <= F.col("effective_cap") + 1e-15
    rows = rows.withColumn("_capped", F.coalesce(F.min(F.when(fits, F.col("_k"))).over(group), F.col("_n")))
    free = F.max(F.when(F.col("_k") == F.col("_capped"), F.col("_suffix"))).over(group)
    left = 1 - F.col("_capped") * F.col("effective_cap")
    weight = F.when(F.col("_k") < F.col("_capped"), F.col("effective_cap")).when(free > 0, left * F.col("_s") / free).otherwise(left / (F.col("_n") - F.col("_capped")))
    out = rows.withColumns({"raw_weight": F.col("_s") / F.col("_sum"), "weight": weight, "weight_capped": F.col("_k") < F.col("_capped")})
    return out.drop("_s", "_n", "_k", "_suffix", "_sum", "_capped")


def build_index(df: DataFrame, by: str | list[str], score: str, n: int, cap: float, *tie: str) -> DataFrame:
    """The n best rows of each date (by: or of each series and date) with capped weights; ranked by weight."""
    keys = [by] if isinstance(by, str) else by
    best = top_n(df, keys, n, F.col(score).desc_nulls_last(), *tie)
    out = capped_weights(best, keys, score, cap, *tie)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("weight").desc(), F.col(score).desc(), *tie))
    return out.withColumns({"index_rank": rank, "n_constituents": F.count("*").over(Window.partitionBy(*keys))})


def rebalance_summary(weights: DataFrame, by: str) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(w).alias("weight_sum"), F.max(w).alias("weight_max"), F.min(w).alias("weight_min"), F.count_if("weight_capped").alias("n_capped"),
        F.sum(F.when(F.col("index_rank") <= 5, w)).alias("top5"), F.sum(w * w).alias("hhi"), (1 / F.sum(w * w)).alias("effective_n"),
    )


def remove_names(weights: DataFrame, removed: DataFrame, by: str, name: str) -> DataFrame:
    """Take the removed names out and share their weight among the rest in proportion."""
    rest = weights.join(removed.select(name).distinct(), name, "left_anti")
    return rest.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(by)))


def selection_score(relevance: str, quality: str, factors: str) -> Column:
    """0.60 relevance, 0.25 quality and 0.15 factor availability, these two between the columns of with_minmax()."""
    return F.bround(0.60 * F.col(relevance) + 0.25 * minmax(quality) + 0.15 * minmax(factors), 4)


def _pack(reasons: list[Column]) -> Column:
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")


def _decide(df: DataFrame) -> DataFrame:
    """Adds eligible, decision and decision_reason from failed_reasons."""
    ok = F.size("failed_reasons") == 0
    return df.withColumns({"eligible": ok, "decision": F.when(ok, "INCLUDE").otherwise("EXCLUDE"), "decision_reason": F.when(ok, "ELIGIBLE").otherwise(F.array_join("failed_reasons", " | "))})


def screen(df: DataFrame, checks: dict[str, tuple[Column | None, str, str]]) -> DataFrame:
    """Adds eligible, decision, decision_reason and the arrays passed_reasons, failed_reasons, unavailable_checks.

    checks: name -> (test, reason if it passes, reason if it fails); a test of None (its input isn't there) or of NULL is
    unavailable and fails nothing.
    """
    passed, failed, absent = [], [], []
    for name, (test, yes, no) in checks.items():
        if test is None:
            absent.append(F.lit(name))
            continue
        passed.append(F.when(test, F.lit(yes)))
        failed.append(F.when(~test, F.lit(no)))
        absent.append(F.when(test.isNull(), F.lit(name)))
    return _decide(df.withColumns({"passed_reasons": _pack(passed), "failed_reasons": _pack(failed), "unavailable_checks": _pack(absent)}))


# The reason codes of theme_screen().
def theme_screen(df: DataFrame, required: dict[str, tuple[str, ...]], core: tuple[str, ...] = (), min_required: int = 4, min_quality: float = 60, max_age: int = 365, require_core: bool = False) -> DataFrame:
    """The eligibility screen of a snapshot: validity in time, age, required factors, data quality, warnings, core values.

    required: factor -> names of columns that may hold it, the first with a finite value counts. A column that df lacks
    makes its check unavailable, which fails nothing; so does a missing value of age, quality, or of core unless
    require_core. Adds what screen() does, the counts of reasons, available and missing required factors, and
    required_factor_columns (factor -> the column it came from).
    """
    names = set(df.columns)
    passed, failed, absent = [], [], []
    say = lambda test, text: F.when(F.coalesce(test, F.lit(False)), F.lit(text))

    def flag(column, good, bad, missing, wanted):
        if column not in names:
            absent.append(F.lit(missing))
            return
        hit = F.coalesce(F.col(column), F.lit(False)) == wanted
        passed.append(F.when(hit, F.lit(good)))
        failed.append(F.when(~hit, F.lit(bad)))

    def bound(column, test, good, bad, missing):
        value = F.col(column).cast("double") if column in names else F.lit(None).cast("double")
        value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        passed.append(say(test(value), good))
        failed.append(say(~test(value), bad))
        absent.append(F.when(value.isNull(), F.lit(missing)))

    flag("pit_valid", "PIT_VALID", "PIT_INVALID", "PIT_VALID_NOT_AVAILABLE", True)
    bound("information_age_days", lambda v: v <= max_age, "INFORMATION_FRESH", f"STALE_INFORMATION_OVER_{max_age}D", "INFORMATION_AGE_NOT_AVAILABLE")
    there, source = {}, {}
    for factor, aliases in required.items():
        live = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.lit(c)) for c in aliases if c in names]
        source[factor] = F.coalesce(*live, F.lit(None).cast("string"))
        there[factor] = source[factor].isNotNull()
        passed.append(F.when(there[factor], F.lit(f"REQUIRED_FACTOR_{factor.upper()}_AVAILABLE")))
    n = sum((t.cast("int") for t in there.values()), F.lit(0))
    enough = n >= min_required
    passed.append(F.when(enough, F.concat(F.lit("REQUIRED_FACTOR_COVERAGE_"), n.cast("string"), F.lit(f"_OF_{len(required)}"))))
    failed.append(F.when(~enough, F.lit(f"REQUIRED_FACTOR_COUNT_BELOW_{min_required}")))
    failed += [F.when(~enough & ~t, F.lit(f"MISSING_REQUIRED_FACTOR_{f.upper()}")) for f, t in there.items()]
    bound("data_quality_score", lambda v: v >= min_quality, "DATA_QUALITY_PASS", f"DATA_QUALITY_BELOW_{min_quality:g}", "DATA_QUALITY_NOT_AVAILABLE")
    flag("financial_warning", "NO_FINANCIAL_WARNING", "FINANCIAL_WARNING", "FINANCIAL_WARNING_NOT_AVAILABLE", False)
    for c in core:
        if c not in names:
            absent.append(F.lit(f"{c.upper()}_COLUMN_NOT_AVAILABLE"))
            continue
        value = F.col(c).cast("double")
        live = F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
        passed.append(F.when(live, F.lit(f"{c.upper()}_AVAILABLE")))
        (failed if require_core else absent).append(F.when(~live, F.lit(f"MISSING_{c.upper()}" + ("" if require_core else "_NOT_ENFORCED"))))
    listed = lambda want: F.array_compact(F.array(*[F.when(t == want, F.lit(f)) for f, t in there.items()]))
    out = df.withColumns({"passed_reasons": _pack(passed), "failed_reasons": _pack(failed), "unavailable_checks": _pack(absent)})
    counts = {f"{k}_count": F.size(c) for k, c in (("passed_reason", "passed_reasons"), ("failed_reason", "failed_reasons"), ("unavailable_check", "unavailable_checks"))}
    factors = {"required_factor_count": n, "available_required_factors": listed(True), "missing_required_factors": listed(False)}
    return _decide(out).withColumns({**counts, **factors, "required_factor_columns": F.create_map(*[x for f, c in source.items() for x in (F.lit(f), c)])})


def stale_grace(df: DataFrame, key: str, date: str, n: int, prefix: str = "STALE") -> DataFrame:
    """Rows that fail for one reason, and that staleness, become eligible if eligible by themselves in one of the n snapshots before.

    Adds stale_grace_applied and stale_grace_source_date (the latest such snapshot), and changes the decision columns. With
    n of 0 nothing changes.
    """
    if n <= 0:
        return df
    dates = df.select(date).distinct().withColumn("_i", F.dense_rank().over(Window.orderBy(date)))  # a calendar of snapshots
    rows = df.join(F.broadcast(dates), date)
    past = Window.partitionBy(key).orderBy("_i").rangeBetween(-n, -1)
    seen = F.max(F.when(F.col("eligible"), F.col(date))).over(past)
    only = (F.size("failed_reasons") == 1) & F.coalesce(F.col("failed_reasons")[0].startswith(prefix), F.lit(False))
    rows = rows.withColumn("_seen", seen).withColumn("stale_grace_applied", only & F.col("_seen").isNotNull())
    hit = F.col("stale_grace_applied")
    changed = {
        "stale_grace_source_date": F.when(hit, F.col("_seen")), "passed_reasons": F.when(hit, F.array_append("passed_reasons", F.lit("STALE_GRACE_APPLIED"))).otherwise(F.col("passed_reasons")),
        "eligible": F.col("eligible") | hit, "decision": F.when(hit, "INCLUDE").otherwise(F.col("decision")), "decision_reason": F.when(hit, "ELIGIBLE_VIA_STALE_GRACE").otherwise(F.col("decision_reason")),
    }
    return rows.withColumns(changed).drop("_i", "_seen")


def long_reasons(df: DataFrame, *keys: str) -> DataFrame:
    """One row per reason, with its type."""
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"{k}_reasons").alias("reasons")) for k in ("passed", "failed")])
    return df.select(*keys, "eligible", F.inline(kinds)).select(*keys, "eligible", "type", F.explode("reasons").alias("reason"))
