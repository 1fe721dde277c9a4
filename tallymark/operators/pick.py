"""Keeping one or a few rows of each group by an explicit total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """One row of each key, the first in the order given."""
    return top_n(df, key, 1, *order)


def top_n(df: DataFrame, key: list[str], n: int, *order: Column | str, rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_if_any(df: DataFrame, flag: Column, *key: str) -> DataFrame:
    """Rows with the flag where their group has any, else all rows of the group."""
    some = F.max(F.coalesce(flag, F.lit(False))).over(Window.partitionBy(*key))
    return df.withColumn("_any", some).where(F.coalesce(flag, F.lit(False)) | ~F.col("_any")).drop("_any")


def latest_rows(df: DataFrame, date: str) -> DataFrame:
    """Rows at the greatest date."""
    last = df.agg(F.max(date).alias("_last"))
    return df.join(F.broadcast(last), F.col(date) == F.col("_last")).drop("_last")


def mode_of(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the greatest."""
    n = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*key).agg(F.max_by(value, F.struct("_n", value)).alias(value))


def quota_selection(df: DataFrame, quota: DataFrame, theme: str, target: int, *order: Column) -> DataFrame:
    """The best rows of each theme up to its quota, then the best of the rest, target rows in all; adds stage and rank.

    Quotas that make more than target keep the best target of the chosen. No more than target rows of the rest can fill.
    """
    ranked = df.join(quota, theme).withColumn("_r", F.row_number().over(Window.partitionBy(theme).orderBy(*order)))
    chosen = ranked.where("_r <= quota").withColumn("stage", F.lit("theme_quota"))
    short = chosen.agg((F.lit(target) - F.count("*")).alias("_short"))  # one row
    rest = ranked.where(f"_r > quota AND _r <= quota + {target}")
    fill = rest.orderBy(*order).limit(target).withColumn("_f", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    fill = fill.join(F.broadcast(short), F.col("_f") <= F.col("_short")).drop("_f", "_short").withColumn("stage", F.lit("shortage_fill"))
    out = chosen.unionByName(fill).drop("_r").orderBy(*order).limit(target)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
