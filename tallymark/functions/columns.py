"""Schema adaptation: aliases, missing columns, required columns, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """Rename the first alias present (in any case) of each canonical column; an absent required one raises."""
    present = {c.lower(): c for c in reversed(df.columns)}
    chosen, missing = {}, []
    for name, others in aliases.items():
        hit = next((present[a.lower()] for a in (name, *others) if a.lower() in present), None)
        if hit is not None:
            chosen[hit] = name
        elif name in required:
            missing.append(name)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`").alias(chosen.get(c, c)) for c in df.columns])


def ensure_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Add absent columns as NULL of the type given."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def require_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def order_columns(df: DataFrame, *leading: str) -> DataFrame:
    return df.select(*[c for c in leading if c in df.columns], *[c for c in df.columns if c not in leading])
