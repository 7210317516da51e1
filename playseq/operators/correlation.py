"""Correlations of many columns with one, in a single aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations(df: DataFrame, columns: Sequence[str], target: str, unit: str) -> DataFrame:
    """Pearson correlation of each column with `target`, and its standard error.

    Pairs with a null are left out of a correlation, but the error counts the
    distinct values of `unit` over the whole table.
    """
    row = df.agg(
        F.count_distinct(unit).alias("units"), *(F.corr(c, target).alias(c) for c in columns)
    )
    corr = F.col("corr")
    return (
        row.unpivot(["units"], list(columns), "metric", "corr")
        .withColumn("se", F.sqrt((1 - corr * corr) / (F.col("units") - 2)))
        .select("metric", "corr", "se")
    )
