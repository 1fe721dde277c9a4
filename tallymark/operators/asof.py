"""As-of joins and date spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def period_ends(df: DataFrame, date: str, months: int = 3) -> DataFrame:
    """Ends of the calendar periods of so many months inside [min, max] of date; its greatest date where there is none."""
    span = df.agg(F.min(F.to_date(date)).alias("lo"), F.max(F.to_date(date)).alias("hi"))
    start = F.trunc("lo", "year")
    ends = F.transform(F.sequence(start, F.add_months("hi", months), F.expr(f"interval {months} months")), lambda d: F.last_day(F.add_months(d, months - 1)))
    inside = F.filter(ends, lambda d: (d >= F.col("lo")) & (d <= F.col("hi")))
    return span.where("lo is not null").select(F.explode(F.when(F.size(inside) > 0, inside).otherwise(F.array("hi"))).alias("snapshot_date"))


def _timeline(rows: DataFrame, dates: DataFrame, key: str, date: str, carried: list[str]) -> DataFrame:
    """Rows and the snapshots of each key in one table, rows first on equal dates."""
    snaps = rows.select(key).distinct().crossJoin(dates.select("snapshot_date"))
    snaps = snaps.select(key, F.col("snapshot_date").alias("_at"), F.lit(1).alias("_snap"), *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c in carried])
    return rows.select(key, F.col(date).cast("date").alias("_at"), F.lit(0).alias("_snap"), *carried).unionByName(snaps)


def asof_backward(rows: DataFrame, dates: DataFrame, key: str, date: str, tie: list[str]) -> DataFrame:
    """For each snapshot date and key, the last row dated on or before it; among one date the greatest by tie.

    dates has a column snapshot_date and is small (a calendar of period ends). One shuffle by key.
    """
    carried = [c for c in rows.columns if c not in (key,)]
    line = _timeline(rows, dates, key, date, carried)
    order = Window.partitionBy(key).orderBy("_at", "_snap", *tie).rowsBetween(Window.unboundedPreceding, 0)
    packed = F.when(F.col("_snap") == 0, F.struct(*carried))
    found = line.withColumn("_row", F.last(packed, ignorenulls=True).over(order)).where("_snap = 1 AND _row IS NOT NULL")
    return found.select(F.col("_at").alias("snapshot_date"), key, "_row.*")


def asof_columns(rows: DataFrame, dates: DataFrame, key: str, date: str, values: list[str], tie: list[str]) -> DataFrame:
    """For each snapshot date and key, every value's own last non-null on or before it."""
    line = _timeline(rows, dates, key, date, [*values, *[t for t in tie if t not in values]])
    order = Window.partitionBy(key).orderBy("_at", "_snap", *tie).rowsBetween(Window.unboundedPreceding, 0)
    filled = line.withColumns({v: F.last(v, ignorenulls=True).over(order) for v in values}).where("_snap = 1")
    return filled.select(F.col("_at").alias("snapshot_date"), key, *values)


def asof_forward(dates: DataFrame, calendar: DataFrame, day: str = "date") -> DataFrame:
    """The first calendar day on or after each snapshot date. Both are small."""
    days = calendar.select(F.to_date(day).alias("entry_date")).distinct()
    hit = dates.join(F.broadcast(days), F.col("entry_date") >= F.col("snapshot_date"), "left")
    return hit.groupBy("snapshot_date").agg(F.min("entry_date").alias("entry_date"))


def pit_snapshot(rows: DataFrame, dates: DataFrame, key: str, date: str, tie: list[str], most_days: int = 365) -> DataFrame:
    """asof_backward with the row's age in days and whether it is stale."""
    snap = asof_backward(rows, dates, key, date, tie)
    age = F.datediff("snapshot_date", F.to_date(date))
    return snap.withColumns({"information_age_days": age, "stale": age > most_days})


def point_in_time(df: DataFrame, availability: str, period_end: str) -> DataFrame:
    """Rows known no earlier than the end of their period."""
    return df.where(F.col(period_end).isNull() | (F.col(availability) >= F.col(period_end)))


def previous_comparable(df: DataFrame, key: list[str], end: str, year: Column, period: Column, carried: list[str], tie: list[str], any_year: Column | None = None) -> DataFrame:
    """Adds prev_end and prev_* of the row of the same key with the same period a year before, else of the latest earlier end.

    Where any_year holds, a missing year on either side also fits. Among several the latest end counts, among one end's the
    first by tie. Rows are numbered in their key by end; candidates are numbers found by windows and one equi-join, so no
    row meets all earlier ones.
    """
    day = F.datediff(F.col(end), F.lit("1970-01-01"))
    last_first = [F.col(end).asc(), *[F.col(t).desc() for t in tie]]
    now = df.withColumns({"_year": year.cast("int"), "_period": period, "_day": day, "_open": F.coalesce(any_year, F.lit(False)) if any_year is not None else F.lit(False)})
    now = now.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*last_first)))
    before = lambda *by: Window.partitionBy(*by).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    same = before(*key, "_period")
    now = now.withColumns({
        "_any": F.max("_rn").over(before(*key)),
        "_named": F.when(F.col("_open") & F.col("_year").isNull(), F.max("_rn").over(same)),
        "_nameless": F.when(F.col("_open"), F.max(F.when(F.col("_year").isNull(), F.col("_rn"))).over(same)),
    })
    ids = now.groupBy(*key, "_period", "_year", "_day").agg(F.max("_rn").alias("_hit")).where("_year IS NOT NULL AND _period IS NOT NULL")
    ask = now.select(*key, "_period", "_year", "_day", "_rn").alias("n")
    on = [F.col(f"n.{k}") == F.col(f"p.{k}") for k in (*key, "_period")] + [F.col("n._year") == F.col("p._year") + 1, F.col("p._day") < F.col("n._day")]
    exact = ask.join(ids.alias("p"), on).groupBy(*[F.col(f"n.{k}").alias(k) for k in key], F.col("n._rn").alias("_rn")).agg(F.max("_hit").alias("_exact"))
    now = now.join(exact, [*key, "_rn"], "left").withColumn("_pick", F.coalesce(F.greatest("_exact", "_named", "_nameless"), "_any"))
    prev = now.select(*key, F.col("_rn").alias("_pick"), F.col(end).alias("prev_end"), *[F.col(c).alias(f"prev_{c}") for c in carried])
    return now.join(prev, [*key, "_pick"], "left").select(*df.columns, "prev_end", *[f"prev_{c}" for c in carried])
