"""Previous and next rows within a key, for keys of any size.

A window over a key runs in one task, so it only suits keys that are known to be
small. For larger keys the ordered rows are cut into slices; each slice is
windowed on its own, and the few rows at slice edges are windowed once more
across slices. No row is dropped and the result equals the plain window.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = "_slice"
ROW = "_row"

Shift = tuple[str | Column, int]


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names in spark.checkpoint.dir."""
    _set_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _set_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        # The warehouse is shared by all executors wherever it isn't a local folder.
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        if not context.master.startswith("local") and re.match(r"file:|/", folder):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(folder)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in all and in the largest group; counts are combined before the shuffle."""
    counts = df.groupBy(*keys).count()
    row = counts.agg(F.sum("count").alias("rows"), F.max("count").alias("largest")).first()
    return row["rows"] or 0, row["largest"] or 0


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int) -> DataFrame:
    """Cut the rows, ordered by keys and then order, into about equal slices.

    A key with many rows spans several consecutive slices. The slice number is
    checkpointed, so a lost task cannot cut differently the second time.
    """
    cut = df.repartitionByRange(slices, *keys, *order)
    return checkpoint(
        cut.select(
            "*",
            F.spark_partition_id().alias(SLICE),
            F.monotonically_increasing_id().alias(ROW),
        )
    )


def shift(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, Shift],
    *,
    slice_by: Sequence[str] = (),
    range_count: int = 0,
) -> DataFrame:
    """Add columns holding another row's value: offset 1 is the previous row, -1 the next.

    `slice_by` names columns that cut a key into consecutive runs of its order.
    `range_count` cuts by range instead, or cuts the edge rows if `slice_by` is given.
    With neither, each key is one window.
    """
    if not slice_by:
        if range_count:
            sliced = range_slices(df, keys, order, range_count)
            shifted = _shift_sliced(sliced, keys, [*order, ROW], outputs, [SLICE], 0)
            return shifted.drop(SLICE, ROW)
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *_shifted(outputs, window))
    return _shift_sliced(df, keys, order, outputs, slice_by, range_count)


def _shifted(outputs: Mapping[str, Shift], window) -> list[Column]:
    return [F.lag(value, offset).over(window).alias(name) for name, (value, offset) in outputs.items()]


def _shift_sliced(df, keys, order, outputs, slice_by, edge_range_count) -> DataFrame:
    reach = max(abs(offset) for _, offset in outputs.values())
    first, last = (f"_{side}_of_{slice_by[-1]}" for side in ("first", "last"))
    groups = list(dict.fromkeys([*keys, *slice_by]))
    window = Window.partitionBy(*groups).orderBy(*order)
    local = df.select(
        "*",
        *_shifted(outputs, window),
        F.lag(F.lit(True), reach).over(window).isNull().alias(first),
        F.lead(F.lit(True), reach).over(window).isNull().alias(last),
    )
    inner = local.filter(~F.col(first) & ~F.col(last))
    # The rows just before a slice's first rows, and just after its last, are edge rows too.
    edges = shift(
        local.filter(F.col(first) | F.col(last)),
        keys,
        order,
        {f"_across_{name}": spec for name, spec in outputs.items()},
        range_count=edge_range_count,
    )
    stitched = edges.select(
        *df.columns,
        *(
            F.when(F.col(first if offset > 0 else last), F.col(f"_across_{name}"))
            .otherwise(F.col(name))
            .alias(name)
            for name, (_, offset) in outputs.items()
        ),
    )
    return inner.drop(first, last).unionByName(stitched)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, range_count: int = 0
) -> DataFrame:
    """Number the rows of each key from 1 in the given order."""
    if not range_count:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", F.row_number().over(window).alias(name))

    sliced = range_slices(df, keys, order, range_count)
    within = Window.partitionBy(*keys, SLICE).orderBy(*order, ROW)
    numbered = sliced.select("*", F.row_number().over(within).cast("long").alias(name))

    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a slice can reach back into an earlier one,
    # so at most `range_count` offsets remain to broadcast.
    offsets = (
        sliced.groupBy(*keys, SLICE)
        .count()
        .select(*keys, SLICE, F.sum("count").over(earlier).alias("_before"))
        .filter("_before > 0")
    )
    n, o = numbered.alias("n"), F.broadcast(offsets).alias("o")
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*keys, SLICE)],
    )
    return n.join(o, same, "left").select(
        *(F.col(f"n.{c}") for c in df.columns),
        (F.col(f"n.{name}") + F.coalesce("o._before", F.lit(0))).alias(name),
    )
