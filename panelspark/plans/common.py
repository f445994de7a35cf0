"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.sources.panel import BARS_SQL, with_sql

KEYS = ("instrument", "date")


def r(value: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: dict[str, Column], keys: tuple[str, ...] = KEYS, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[r(value, digits).alias(name) for name, value in columns.items()])


def bars_sql(columns: dict[str, str], *parts: str, source: str = "bars", keys: tuple[str, ...] = KEYS, digits: int = 6) -> str:
    chosen = [*keys, *[f"(round({value}, {digits}) + 0.0) AS {name}" for name, value in columns.items()]]
    return with_sql(BARS_SQL, *parts, select=f"SELECT {', '.join(chosen)} FROM {source}")
