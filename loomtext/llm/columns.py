"""Columns by position, so that no other column's name can clash with them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def place_of(df: DataFrame, name: str) -> int:
    """The position of a column: of the first of this very name, else of the only one in any case."""
    if name in df.columns:
        return df.columns.index(name)
    same = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(same) != 1:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...; ``toDF(*df.columns)`` gives them their names back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def fields(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, as f0, f1, ..."""
    places = [place_of(df, n) for n in names]
    return numbered(df).selectExpr(*(f"c{p} as f{i}" for i, p in enumerate(places)))
