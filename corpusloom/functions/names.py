"""Column names of any table: quoting, and names that a table doesn't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(df: DataFrame) -> list[Column]:
    """df's columns by their quoted names, so that dots and blanks in names mean nothing."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, stem: str) -> str:
    """A name that begins with stem and that no column's name begins with, whatever the case."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem += "_"
    return stem
