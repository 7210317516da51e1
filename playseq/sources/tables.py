"""Reading rounds, keeping complete players, and writing result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playseq.domain import MIN_ROUNDS, ROUNDS
from playseq.operators.sizes import LIMITS, Limits, Sizes, measure


def read_rounds(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Read a rounds table with its declared schema.

    In CSV files, blanks around a value are dropped, "NA" and empty text become null, and a
    round number may be written as a whole decimal number.
    """
    if format == "csv":
        # The header may name further columns and any order, so bind by name.
        raw = spark.read.csv(path, header=True, inferSchema=False)
        return raw.select(*(_parsed(f).alias(f.name) for f in ROUNDS))
    return spark.read.format(format).load(path).select(*ROUNDS.fieldNames())


def _parsed(field: T.StructField) -> Column:
    text = f"nullif(nullif(btrim(`{field.name}`, ' \\t'), ''), 'NA')"
    if field.dataType == T.StringType():
        return F.expr(text)
    number = f"CAST({text} AS DOUBLE)"
    # A fraction is no round number, so it fails like other text.
    return F.expr(f"CAST(IF({number} = floor({number}), CAST({number} AS BIGINT), {text}) AS {field.dataType.simpleString()})")


def complete_rounds(
    rounds: DataFrame,
    min_rounds: int = MIN_ROUNDS,
    sizes: Sizes | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Drop every row of players whose last round, over all their games, is below `min_rounds`.

    A player with an unknown round number is kept, and players without an id are
    treated as one player. The opponents of dropped players stay.
    """
    sizes = sizes or measure(rounds, min_rounds, limits)
    if sizes.incomplete_players == 0:
        return rounds
    incomplete = sizes.incomplete
    # Beyond the broadcast limit this is a shuffled join, whose large keys AQE can split.
    if sizes.incomplete_players <= limits.broadcast_rows:
        incomplete = F.broadcast(incomplete)
    return rounds.join(
        incomplete, F.col("player_id").eqNullSafe(F.col("incomplete_id")), "left_anti"
    )


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result table; CSV files get a header."""
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
