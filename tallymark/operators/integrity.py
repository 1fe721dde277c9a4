"""Ledgers, differences, transitions, evidence and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import Stages
from .pick import mode_of


def indexed(dates: DataFrame, date: str) -> DataFrame:
    """Snapshot dates with their number; there are as many as rebalances."""
    return dates.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))


def membership_changes(members: DataFrame, date: str, name: str) -> DataFrame:
    """NEW_ADD, MAINTAIN or DROP of each name against the snapshot before."""
    days = indexed(members, date)
    now = members.select(date, name).distinct().join(F.broadcast(days), date)
    before = now.select((F.col("_i") + 1).alias("_i"), name, F.lit(True).alias("was"))
    both = now.withColumn("is", F.lit(True)).join(before, ["_i", name], "full").drop(date).join(F.broadcast(days), "_i")
    action = F.when(F.col("is") & F.col("was"), "MAINTAIN").when(F.col("is"), "NEW_ADD").otherwise("DROP")
    return both.select(date, name, action.alias("action"))


# The actions and reason codes of membership_ledger().
def membership_ledger(candidates: DataFrame, scores: DataFrame, members: DataFrame, date: str, name: str) -> DataFrame:
    """Every candidate or scored name of each scored date, with its previous and current membership, action, reason, score and rank.

    candidates: date, name, theme_eligible, theme_reason; scores: date, name, factor_score; members: date, name.
    Membership explains a name first; for the others the theme's verdict goes before missing scores and these before the rank.
    """
    days = indexed(scores.select(date), date)
    ranked = scores.select(date, name, "factor_score", F.lit(True).alias("data_eligible"), F.rank().over(Window.partitionBy(date).orderBy(F.col("factor_score").desc())).alias("rank"))
    rows = candidates.select(date, name, "theme_eligible", "theme_reason").join(ranked, [date, name], "full").join(F.broadcast(days), date)
    inside = members.select(date, name).distinct().join(F.broadcast(days), date)
    rows = rows.join(inside.select("_i", name, F.lit(True).alias("_now")), ["_i", name], "left")
    rows = rows.join(inside.select((F.col("_i") + 1).alias("_i"), name, F.lit(True).alias("_was")), ["_i", name], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("theme_eligible", True), ("data_eligible", False), ("_now", False), ("_was", False))})
    now, was = F.col("_now"), F.col("_was")
    action = F.when(now & was, "MAINTAIN").when(now, "ADD").when(was, "DROP").otherwise("NONE")
    theme = F.coalesce(F.nullif("theme_reason", F.lit("")), F.lit("THEME_DIRECTNESS_LOW"))
    reason = F.when(now, "FACTOR_SCORE_TOP30").when(~F.col("theme_eligible"), theme).when(~F.col("data_eligible"), "DATA_OR_FACTOR_SCREEN").otherwise("FACTOR_SCORE_OUTSIDE_TOP30")
    side = lambda c: F.when(c, "IN").otherwise("OUT")
    return rows.select(date, name, side(was).alias("previous_membership"), side(now).alias("current_membership"), action.alias("action"), reason.alias("reason_code"), "factor_score", "rank", "theme_eligible", "data_eligible")


def set_difference(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Keys dropped from a and added in b."""
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return x.join(y, list(key), "left_anti").withColumn("change", F.lit("DROPPED")).unionByName(y.join(x, list(key), "left_anti").withColumn("change", F.lit("ADDED")))


def weight_differences(a: DataFrame, b: DataFrame, date: str, name: str) -> DataFrame:
    """Largest weight difference and number of membership flips at each date; a missing weight is 0."""
    both = a.select(date, name, F.col("weight").alias("_a")).join(b.select(date, name, F.col("weight").alias("_b")), [date, name], "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return both.groupBy(date).agg(F.max(F.abs(x - y)).alias("max_weight_diff"), F.count_if((x > 0) != (y > 0)).alias("membership_changes"))


def standard_transitions(detail: DataFrame, key: list[str], end: str, standard: str) -> DataFrame:
    """The usual standard of each period and whether it crossed from that of the period before."""
    usual = mode_of(detail, [*key, end], standard)
    before = F.lag(standard).over(Window.partitionBy(*key).orderBy(end))
    return usual.withColumn("previous_standard", before).withColumn("crossed", F.coalesce(F.col("previous_standard") != F.col(standard), F.lit(False)))


def provenance(detail: DataFrame, key: list[str], metric: str, metrics: list[str], *values: str) -> DataFrame:
    """One row per key with {metric}_{value} columns."""
    return detail.groupBy(*key).pivot(metric, metrics).agg(*[F.min(v).alias(v) for v in values])


def classify_standard(facts: DataFrame, key: str, taxonomy: str = "taxonomy") -> DataFrame:
    """US-GAAP, IFRS, MIXED_FILER or UNKNOWN from the facts of each taxonomy."""
    n = facts.groupBy(key).agg(F.count_if(F.col(taxonomy) == "us-gaap").alias("n_us_gaap"), F.count_if(F.col(taxonomy) == "ifrs-full").alias("n_ifrs"))
    us, ifrs = F.col("n_us_gaap") > 0, F.col("n_ifrs") > 0
    return n.withColumn("standard", F.when(us & ifrs, "MIXED_FILER").when(us, "US-GAAP").when(ifrs, "IFRS").otherwise("UNKNOWN"))


def block_cross_standard(panel: DataFrame, crossed: str, growths: dict[str, tuple[str, str]]) -> DataFrame:
    """Growth across standards: on the restated base if there is one, else NULL; with the decision.

    growths: growth column -> (current value, restated previous value).
    """
    out = {}
    for g, (now, restated) in growths.items():
        again = F.try_divide(F.col(now), F.col(restated)) - 1
        out[g] = F.when(~F.col(crossed), F.col(g)).when(F.col(restated).isNotNull(), again)
        out[f"{g}_decision"] = F.when(~F.col(crossed), "unchanged").when(F.col(restated).isNotNull(), "restated").otherwise("blocked")
    return panel.withColumns(out)


# The status that a kind of evidence sets; other kinds keep the one before.
STATES = {"OFFICIAL_EXIT": "DISCONTINUED", "PARTIAL_DIVEST": "REDUCED", "KEYWORD_DECLINE": "UNCERTAIN", "ANNUAL_CONFIRM": "ACTIVE"}


def status_step(rows: DataFrame, previous: str, kind: str, evidence_date: str, rebalance_date: str, states: dict[str, str] = STATES, out: str = "DISCONTINUED") -> DataFrame:
    """Adds new_status, status_changed, change_reason (the kind that was applied), exclusion_candidate and pit_ok of one step.

    Evidence dated after the rebalance isn't known yet: the status stays and pit_ok is false. A kind that sets no status
    keeps it. A missing date on either side is no obstacle.
    """
    later = F.coalesce(F.col(evidence_date) > F.col(rebalance_date), F.lit(False))
    mapping = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    to = F.when(later, F.col(previous)).otherwise(F.coalesce(F.try_element_at(mapping, F.col(kind)), F.col(previous)))
    rows = rows.withColumn("new_status", to)
    return rows.withColumns({
        "status_changed": ~F.col("new_status").eqNullSafe(F.col(previous)), "change_reason": F.when(later, "PIT_EVIDENCE_AFTER_REBALANCE").otherwise(F.coalesce(kind, F.lit("NO_NEW_INFO"))),
        "exclusion_candidate": F.coalesce(F.col("new_status") == out, F.lit(False)), "pit_ok": ~later,
    })


def status_history(evidence: DataFrame, dates: DataFrame, key: str, states: dict[str, str] = STATES, start: str = "NOT_REVIEWED", out: str = "DISCONTINUED") -> DataFrame:
    """Status of each key at each date: set by the last evidence up to then whose kind sets one; later evidence is ignored.

    Adds the status before, whether it changed, the evidence kind behind it, whether it makes the key a candidate for
    exclusion (status out), and how many status-setting pieces are known. Of pieces of one day the one whose kind is last in the
    alphabet counts. dates (snapshot_date) is a calendar. Evidence and
    dates of a key stand in one order, so a hot key is sorted, not multiplied.
    """
    mapping = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    sets = evidence.select(key, F.col("evidence_date").alias("_at"), F.lit(0).alias("_snap"), "kind", F.element_at(mapping, F.col("kind")).alias("_state")).where("_state IS NOT NULL")
    snaps = evidence.select(key).distinct().crossJoin(dates.select(F.col("snapshot_date").alias("_at")))
    none = F.lit(None).cast("string")
    line = sets.unionByName(snaps.select(key, "_at", F.lit(1).alias("_snap"), none.alias("kind"), none.alias("_state")))
    past = Window.partitionBy(key).orderBy("_at", "_snap", "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_snap") == 0, F.struct("_state", "kind"))
    rows = line.withColumns({"_last": F.last(known, ignorenulls=True).over(past), "n_evidence": F.count(known).over(past)}).where("_snap = 1")
    rows = rows.select(key, F.col("_at").alias("snapshot_date"), F.coalesce("_last._state", F.lit(start)).alias("status"), F.col("_last.kind").alias("change_reason"), "n_evidence")
    before = F.coalesce(F.lag("status").over(Window.partitionBy(key).orderBy("snapshot_date")), F.lit(start))
    rows = rows.withColumn("previous_status", before)
    return rows.withColumns({"status_changed": F.col("status") != F.col("previous_status"), "exclusion_candidate": F.col("status") == out})


def theme_gate(rows: DataFrame, evidence: DataFrame, key: str, date: str, retro: bool = False) -> DataFrame:
    """Adds theme_eligible: false once exclusion evidence is known (with retro, always). evidence: key, evidence_date."""
    return first_evidence(rows, evidence, key).withColumn("theme_eligible", theme_open(date, retro)).drop("_e")


def first_evidence(rows: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Adds _e, the key's first evidence_date. A grid of keys and dates takes it before its dates are added."""
    return rows.join(evidence.groupBy(key).agg(F.min("evidence_date").alias("_e")), key, "left")


def theme_open(date: str, retro: bool = False) -> Column:
    """Whether no evidence is known at the date (with retro, at any), from _e."""
    return ~(F.col("_e").isNotNull() if retro else F.coalesce(F.col(date) >= F.col("_e"), F.lit(False)))


# Reasons of a theme verdict.
DISCONTINUED, LOW, LATER = "BUSINESS_DISCONTINUED", "THEME_DIRECTNESS_LOW", "PIT_EVIDENCE_NOT_YET_AVAILABLE"


def theme_verdicts(evidence: DataFrame, key: str, mode: str) -> DataFrame:
    """Change points (key, at, eligible, reason) of each key's theme eligibility; at is NULL for a verdict from ever on.

    evidence: key, kind (discontinued or low), evidence_date. A discontinued business is out at all dates. Low directness
    is out from its first evidence on (mode pit; until then the name stays in, with a reason) or at all dates (retro).
    """
    if mode not in ("pit", "retro"):
        raise ValueError("mode is pit or retro")
    by = evidence.groupBy(key).agg(F.max(F.col("kind") == "discontinued").alias("_gone"), F.min(F.when(F.col("kind") == "low", F.col("evidence_date"))).alias("_low"))
    point = lambda at, ok, why: F.struct(at.cast("date").alias("at"), F.lit(ok).alias("eligible"), F.lit(why).alias("reason"))
    ever = F.lit(None)
    low = F.array(point(ever, True, LATER), point(F.col("_low"), False, LOW)) if mode == "pit" else F.array(point(ever, False, LOW))
    points = F.when(F.col("_gone"), F.array(point(ever, False, DISCONTINUED))).when(F.col("_low").isNotNull(), low)
    return by.select(key, F.explode(points).alias("p")).select(key, "p.*")


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, key: str, date: str, out: str = "eligible") -> DataFrame:
    """Adds out and {out}_reason: the last verdict on the row's key at or before its date; a key without one is eligible.

    Rows and change points of a key stand in one order, so there is no grid of keys and dates and no range join.
    """
    carried = F.struct(*rows.columns)
    line = rows.select(F.col(key).alias("_k"), F.col(date).cast("date").alias("_at"), F.lit(1).alias("_m"), carried.alias("_row"))
    marks = verdicts.select(F.col(key).alias("_k"), F.col("at").alias("_at"), F.lit(0).alias("_m"), F.struct("eligible", "reason").alias("_v"))
    past = Window.partitionBy("_k").orderBy(F.col("_at").asc_nulls_first(), "_m").rowsBetween(Window.unboundedPreceding, 0)
    both = line.unionByName(marks, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(past)).where("_m = 1")
    return both.select("_row.*", F.coalesce("_v.eligible", F.lit(True)).alias(out), F.coalesce("_v.reason", F.lit("")).alias(f"{out}_reason"))


def checklist(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check with its number of violations, in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in checks.items()])
    long = counts.unpivot([], list(checks), "check", "violations")
    return long.withColumn("passed", F.col("violations") == 0)


def null_where(df: DataFrame, keys: DataFrame, on: list[str], *columns: str) -> DataFrame:
    """Columns become NULL in rows that keys names."""
    marked = df.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return marked.withColumns({c: F.when(F.col("_hit").isNull(), F.col(c)) for c in columns}).drop("_hit")


def event_windows(events: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Snapshots before and after each event's day, and the nearest ones. snapshots: key, snapshot_date."""
    rows = events.join(snapshots, key, "left")
    before, after = F.col("snapshot_date") <= F.col("effective_date"), F.col("snapshot_date") > F.col("effective_date")
    return rows.groupBy(key, "effective_date").agg(F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"), F.max(F.when(before, F.col("snapshot_date"))).alias("last_before"), F.min(F.when(after, F.col("snapshot_date"))).alias("first_after"))


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with and without a value of each column."""
    names = list(columns) or df.columns
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in names])
    return one.unpivot("_n", names, "column", "non_null").select("column", "non_null", (F.col("_n") - F.col("non_null")).alias("missing"), F.bround(F.try_divide(F.col("non_null") * 100, F.col("_n")), 4).alias("percent"))


def boolean_coverage(df: DataFrame, *columns: str) -> DataFrame:
    """How often each flag is true and false, and the share of true ones among all rows."""
    one = df.agg(F.count("*").alias("_n"), *[x for c in columns for x in (F.count_if(F.col(c)).alias(f"{c}_true"), F.count_if(~F.col(c)).alias(f"{c}_false"))])
    cells = F.array(*[F.struct(F.lit(f"{c}_true").alias("metric"), F.col(f"{c}_true").alias("available"), F.col(f"{c}_false").alias("missing")) for c in columns])
    rows = one.select("_n", F.inline(cells))
    return rows.select("metric", "available", "missing", F.bround(F.coalesce(F.try_divide(F.col("available") * 100, F.col("_n")), F.lit(0.0)), 2).alias("coverage_pct"))


def event_cross_check(suspensions: DataFrame, listings: DataFrame) -> DataFrame:
    """One row: suspected suspensions, delistings or ends of data, names that aren't listed any more."""
    a = suspensions.agg(F.count_if("suspected_suspension").alias("n_long_suspensions"), F.count_if("delisted_or_data_end").alias("n_delisted"))
    return a.crossJoin(listings.agg(F.count_if(F.col("listing_status") != "LISTED").alias("n_not_listed")))  # one row each


def enrich_provenance(factors: DataFrame, standards: DataFrame, provenance_: DataFrame, mixed: DataFrame, transitions: DataFrame, universe: DataFrame, key: str, end: str) -> DataFrame:
    """Factor rows with the company's standard, the tags behind each metric, mixed-standard and cross-standard flags, and the universe's columns.

    standards: key, accounting_standard; provenance_ : key, end, ...; mixed: key, end, mixed_standard_warning; transitions: key,
    end, growth_cross_standard_warning; universe: key, ... (its keys count). Missing flags are false, a missing standard UNKNOWN.
    """
    rows = factors.join(universe, key).join(standards, key, "left").join(provenance_, [key, end], "left").join(mixed, [key, end], "left").join(transitions, [key, end], "left")
    flags = ("mixed_standard_warning", "growth_cross_standard_warning")
    return rows.withColumns({"accounting_standard": F.coalesce("accounting_standard", F.lit("UNKNOWN")), **{c: F.coalesce(c, F.lit(False)) for c in flags}})


def corporate_actions(universe: DataFrame, curated: DataFrame, ipos: DataFrame, spans: DataFrame, weights: DataFrame, name: str = "ticker") -> DataFrame:
    """One row per name: its curated action, else its IPO (effective on its first trading day), else NONE, and how it fits the index's snapshots.

    curated: name, corporate_action_type, announcement_date, effective_date, successor; ipos: name; spans: name, first_valid,
    last_valid; weights: name, snapshot_date.
    """
    rows = universe.join(curated, name, "left").join(ipos.select(name, F.lit(True).alias("_ipo")).distinct(), name, "left").join(spans, name, "left")
    ipo = F.col("corporate_action_type").isNull() & F.coalesce("_ipo", F.lit(False))
    rows = rows.withColumns({
        "effective_date": F.when(ipo, F.col("first_valid")).otherwise(F.col("effective_date")), "successor": F.coalesce("successor", F.col(name)),
        "corporate_action_type": F.when(ipo, "IPO").otherwise(F.coalesce("corporate_action_type", F.lit("NONE"))),
    }).drop("_ipo")
    held = weights.select(name, "snapshot_date").distinct().join(rows.select(name, F.col("effective_date").alias("_e")), name)
    counts = held.groupBy(name).agg(F.count("*").alias("n_index_snapshots"), F.count_if(F.col("snapshot_date") < F.col("_e")).alias("n_pre_event_snapshots"))
    rows = rows.join(counts, name, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_index_snapshots", "n_pre_event_snapshots")})
    kind, n, pre = F.col("corporate_action_type"), F.col("n_index_snapshots"), F.col("n_pre_event_snapshots")
    note = F.when((kind == "TICKER_NAME_CHANGE") & (pre > 0), "HELD_BEFORE_RENAME").when(kind.startswith("SPINOFF") & (n == 0), "NOT_IN_INDEX").when(F.col("effective_date").isNotNull() & (pre == 0) & (n > 0), "AFTER_EFFECTIVE_DATE").otherwise("")
    return rows.withColumns({"action_status": F.when(kind == "NONE", "NONE").otherwise("COMPLETED"), "pit_note": note})


def numeric_summary(df: DataFrame, *columns: str, bins: int = 1024, most: int = 1 << 16) -> DataFrame:
    """count, mean, median, min, max and standard deviation of each column; NaN and NULL are missing."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where("value IS NOT NULL AND NOT isnan(value)")
    stats = long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_samp("value").alias("std"))
    return stats.join(medians(long, ["column"], "value", bins, most), "column").select("column", "n", "mean", "median", "min", "max", "std")


def _place(value: str, low: str, high: str) -> Column:
    """Where a value lies between two others, 0 to 1, never falling as it grows: on a straight scale where both are of one
    magnitude, else by sign and logarithm, so that far outliers don't crowd all others at one end."""
    v, a, b = F.col(value), F.col(low), F.col(high)
    scale = lambda x: F.coalesce(F.signum(x) * (F.log2(F.abs(x)) + 1075), F.lit(0.0))
    near = (F.signum(a) == F.signum(b)) & (F.greatest(F.abs(a), F.abs(b)) / 2 <= F.least(F.abs(a), F.abs(b)))
    straight = F.try_divide(v / 2 - a / 2, b / 2 - a / 2)
    return F.coalesce(F.when(near, straight).otherwise(F.try_divide(scale(v) - scale(a), scale(b) - scale(a))), F.lit(0.0))


def medians(rows: DataFrame, by: list[str], value: str, bins: int = 1024, most: int = 1 << 16, small: int = 100_000) -> DataFrame:
    """by and the exact median of a double column (NULL and NaN are missing; groups without a value have no row).

    Distributed selection: for each of the two middle ranks of a group, a range of values that holds it is counted in
    `bins` parts and narrowed to the part with the rank, again until at most `most` values are left; only these are put in
    order. No group's values meet in one buffer. The ranges are a row or two per group: they are broadcast where there are
    at most `small` of them, else joined by key.
    """
    v = F.col(value).cast("double")
    values = rows.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    size = values.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    ranks = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    with Stages(rows.sparkSession) as stages:
        state = stages.write(size.select(*by, "_lo", "_hi", "_n", F.lit(0).cast("long").alias("_below"), F.explode(ranks).alias("_rank")))
        side = lambda: F.broadcast(state) if few else state
        few = state.count() <= small
        inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        keys = [*by, "_rank"]
        while not state.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > most)).isEmpty():
            part = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins).otherwise(F.least(F.greatest(F.floor(_place("_v", "_lo", "_hi") * bins), F.lit(0)), F.lit(bins)))
            found = values.join(side(), by).where(inside).groupBy(*keys, "_below", part.alias("_bin")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
            upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin"))  # a row per part
            found = found.withColumn("_upto", F.col("_below") + upto).where("_upto > _rank AND _upto - _n <= _rank")
            old, state = state, stages.write(found.select(*by, "_lo", "_hi", "_n", (F.col("_upto") - F.col("_n")).alias("_below"), "_rank"))
            stages.release(old)
        one = state.where("_lo = _hi").select(*keys, F.col("_lo").alias("_v"))
        rest = state.where("_lo < _hi")
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1 + F.col("_below")  # at most `most` values
        picked = values.join(F.broadcast(rest) if few else rest, by).where(inside).withColumn("_at", order).where("_at = _rank").select(*keys, "_v")
        return stages.result(one.unionByName(picked).groupBy(*by).agg(F.avg("_v").alias("median")))


def distribution(df: DataFrame, column: str, missing: str = "Missing") -> DataFrame:
    """Count and share of each value; NULL and '' are missing."""
    value = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(missing))
    n = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.join(F.broadcast(total), F.lit(True)).select("value", "n", F.bround(F.col("n") * 100 / F.col("_t"), 2).alias("percent"))


def rule_violations(df: DataFrame, negative: list[str], non_positive: list[str]) -> DataFrame:
    """How many values break each column's rule."""
    rules = {f"{c}:negative": F.col(c) < 0 for c in negative} | {f"{c}:non_positive": F.col(c) <= 0 for c in non_positive}
    return checklist(df, rules)


def key_summary(df: DataFrame, key: str) -> DataFrame:
    """Rows, columns, distinct and duplicate keys."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    return n.agg(F.sum("_n").alias("n_rows"), F.count(key).alias("n_keys"), F.sum(F.col("_n") - 1).alias("n_duplicates")).withColumn("n_columns", F.lit(len(df.columns)))


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")
