"""Column names of the canonical tables and checks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame

XYZ, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")
COV = ("c00", "c01", "c02", "c11", "c12", "c22")


def require_columns(df: DataFrame, *columns: str) -> None:
    """Raise ValueError when df lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def mapped(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A table of any layout as a canonical one: names maps canonical columns to its own."""
    require_columns(df, *names.values())
    own = set(names.values())
    return df.select(*[df[old].alias(new) for new, old in names.items()], *[df[c] for c in df.columns if c not in own])
