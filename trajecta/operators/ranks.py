"""Orders of names in reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_categories(df: DataFrame, name: str, first: list[str]) -> DataFrame:
    """`place` from 1: listed names in the order of the list, then the others by name. One row a name, so one window holds them."""
    listed = F.array_position(F.array(*[F.lit(x) for x in first]), F.col(name))
    w = Window.orderBy((listed == 0).cast("int"), listed, name)
    return df.withColumn("place", F.row_number().over(w))


def natural_key(name: Column, digits: int = 12) -> Column:
    """A name without case whose numbers have one width, so that 2 comes before 10."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(\d+)", "0" * digits + "$1"), rf"0*(\d{{{digits}}})(?!\d)", "$1")


def is_count_metric(name: Column) -> Column:
    """Metrics that count something; these come last."""
    low = F.lower(name)
    out = low.startswith("num_")
    for mark in (".num_", "count", "pairs", "frames", "scenes"):
        out = out | low.contains(mark)
    return out


def order_metrics(df: DataFrame, name: str) -> DataFrame:
    """`place` from 1: counting metrics last, otherwise by name with numbers by value."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(is_count_metric(F.col(name)), natural_key(F.col(name)), name)))
