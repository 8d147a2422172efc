"""Helpers that shape query plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Catalyst substitutes projected expressions into later filters and projections. For long geometry expressions
    that multiplies both the work per row and the size of the plan, so they are produced by a one-row generator,
    through which nothing is substituted.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def row_hash(df: DataFrame) -> Column:
    """Hash of a row's content (maps cannot be hashed and are left out): the same on every attempt of a task."""
    return F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
