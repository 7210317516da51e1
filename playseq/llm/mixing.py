"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playseq.llm.tables import checkpoint
from playseq.llm.text import NON_SPACE, Words, flat, slices

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Slices of the key range within each source: only one of them has to be sorted.
KEY_SLICES = 4096
#: Sources up to this number have their per-source plan broadcast; beyond it, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def with_size(documents: DataFrame, text: str, name: str, keep_text: bool) -> DataFrame:
    """The documents with their number of words, counted where they are read; a null text has none."""
    kept = [f for f in documents.schema if keep_text or f.name != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def count(batches):
        for batch in slices(batches, text):
            words = Words(*flat(batch.column(text)), NON_SPACE)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(words.counts, pa.int64())],
                [*(f.name for f in kept), name],
            )

    return documents.mapInArrow(count, f"{fields}, `{name}` long")


def targets(
    sources: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    most_epochs: float = MOST_EPOCHS,
) -> DataFrame:
    """Share the total size of all sources among them.

    `sources` has one row for each: source, source_size. Weights go round by code point of the
    source, null last. No target is above `most_epochs` times its source's size: with sources by
    falling weight per size, the excess of those that reach it goes to the others by weight.
    Adds weight and target. The windows here see one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sources.select(
        "source",
        "source_size",
        F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"),
    ).withColumn("_cap", F.lit(float(most_epochs)) * F.col("source_size"))
    # Targets are min(cap, level * weight). In order of cap / weight, a source is capped if the
    # level that the sources from it on would share lies above its own.
    order = Window.orderBy((F.col("_cap") / F.col("weight")), F.col("source").asc_nulls_first())
    capped_before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    total = F.sum("source_size").over(every).cast("double")
    leveled = weighed.withColumn("_level", (total - capped_before) / weight_left).withColumn(
        "_free", F.col("_cap") / F.col("weight") >= F.col("_level")
    )
    # The first source that stays below its cap sets the level for itself and all after it.
    level = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("weight")).alias("at"), "_level"))).over(every)["_level"]
    return leveled.select(
        "source",
        "source_size",
        "weight",
        F.coalesce(F.least("_cap", level * F.col("weight")), "_cap").alias("target"),
    )


def exponential_key(identity: Sequence[Column | str], weight: Column, seed: int) -> Column:
    """-ln(u) / weight, with u in (0, 1) from a hash of the row's content; the smallest keys are taken."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def mix(
    documents: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    identity: Sequence[str] = ("doc_id",),
    quality: DataFrame | None = None,
    weights: Sequence[float] = WEIGHTS,
    most_epochs: float = MOST_EPOCHS,
    seed: int = 0,
    carry: Sequence[str] = ("doc_id",),
    keep_text: bool = False,
) -> DataFrame:
    """Take words from the sources in proportion to weights, some documents several times.

    A source whose target is e epochs and a rest is taken e times in full; the rest goes to
    documents in order of exponential keys -ln(u) / quality, so better documents come first more
    often, until their sizes add up to it. The document at which the budget ends is taken in
    part, from its start. `quality` has the columns of `identity`, one row for each, and a positive
    weight; documents that it lacks, and weights that are null or not positive, count as 1.

    Returns, one row for each document: `row` (a struct of the `carry` columns), source, size
    (words; null or empty text: 0), source_size, target, epochs (full copies), cut_words (words
    of the partial copy; 0 if there is none) and taken (words in all); with `keep_text` also text. A null
    source is a source.
    Rows repeated in full have equal keys; which of them comes first makes no difference.

    No source is ever sorted as a whole: sizes are summed by slice of the key range where the
    documents are read, and only the slice in which the budget ends is ordered.
    """
    prepared = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.col(text).alias("text"),
        F.xxhash64(*identity, F.col(text)).alias("_tie"),
        *(F.col(c).alias(f"_id{k}") for k, c in enumerate(identity)),
    )
    ids = [f"_id{k}" for k in range(len(identity))]
    sized = with_size(prepared, "text", "size", keep_text)
    weight = F.lit(1.0)
    if quality is not None:
        named = quality.select(*(F.col(c).alias(f"_of{k}") for k, c in enumerate(identity)), F.col("weight").cast("double").alias("_weight"))
        same = reduce(and_, (F.col(f"_id{k}") == F.col(f"_of{k}") for k in range(len(ids))))
        sized = sized.join(named, same, "left").drop(*(f"_of{k}" for k in range(len(ids))))
        weight = F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(1.0)
    keyed = sized.withColumn("_key", exponential_key([*ids, "_tie"], weight, seed))
    # Monotone in the key, and about even for qualities around 1.
    keyed = keyed.withColumn(
        "_slice", F.least(F.floor((1 - F.exp(-F.col("_key"))) * KEY_SLICES), F.lit(KEY_SLICES - 1)).cast("int")
    )
    sums = checkpoint(keyed.groupBy("source", "_slice").agg(F.sum("size").alias("_sum")))
    shares = targets(
        sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights=weights, most_epochs=most_epochs
    ).withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    shares = shares.withColumn("_rest", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    running = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    # One row for each source: the slice in which its budget ends, and what the slices before it hold.
    ends = (
        sums.withColumn("_upto", F.sum("_sum").over(running))
        .join(shares.select(F.col("source").alias("_source"), "_rest"), F.col("source").eqNullSafe(F.col("_source")))
        .filter("_upto > _rest")
        .groupBy(F.col("_source"))
        .agg(F.min(F.struct("_slice", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("_end"))
    )
    plan = checkpoint(
        shares.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            F.col("source").alias("_source"),
            "source_size",
            "target",
            "_epochs",
            "_rest",
            F.coalesce("_end._slice", F.lit(KEY_SLICES)).alias("_end_slice"),
            F.coalesce("_end.before", F.lit(0)).alias("_before"),
        )
    )
    few = plan.count() <= BROADCAST_SOURCES
    planned = keyed.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source")))
    whole = planned.filter("_slice <> _end_slice").withColumn(
        "cut_words", F.when(F.col("_slice") < F.col("_end_slice"), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    earlier = Window.partitionBy("source").orderBy("_key", *ids, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    last = planned.filter("_slice = _end_slice").withColumn(
        "cut_words", F.greatest(F.least("size", F.col("_rest") - upto), F.lit(0)).cast("long")
    )
    full = F.col("cut_words") == F.col("size")
    return whole.unionByName(last).select(
        "row",
        "source",
        *(["text"] if keep_text else []),
        "size",
        "source_size",
        "target",
        (F.col("_epochs") + F.when(full & (F.col("size") > 0), 1).otherwise(0)).alias("epochs"),
        F.when(full, 0).otherwise(F.col("cut_words")).alias("cut_words"),
        (F.col("_epochs") * F.col("size") + F.col("cut_words")).alias("taken"),
    )


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself, from rows with their text: one row for each copy, the last one cut to its words where the budget ended.

    Adds copy (from 1) and copy_text; documents that are not taken have no row. The cut copy
    keeps its first words with the white space between them.
    """
    n = F.col("epochs") + F.when(F.col("cut_words") > 0, 1).otherwise(0)
    spread = mixed.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    spread = spread.withColumn("_words", F.when(F.col("copy") > F.col("epochs"), F.col("cut_words")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)

    def shorten(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            most = batch.column("_words")
            if most.null_count < len(most):
                words = Words(*flat(texts), NON_SPACE)
                values = texts.to_pylist()
                for k in np.flatnonzero(most.is_valid().to_numpy(zero_copy_only=False)):
                    last = words.first[k] + most[k].as_py() - 1
                    values[k] = values[k].encode()[: words.end[last] - words.at[k]].decode()
                texts = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "copy_text"])

    return spread.mapInArrow(shorten, f"{fields}, copy_text string").drop("_words")
