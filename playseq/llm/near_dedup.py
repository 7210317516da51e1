"""Near duplicates: fast similarity sketches, banding, and verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.components import components
from playseq.llm.tables import checkpoint, row_key
from playseq.llm.text import NON_SPACE, WORDS, Words, flat, mix, slices

SHINGLE = 5
PERCENT = 80
#: A pair at 80 % agrees in all rows of some band but for 1.3e-7 of pairs: (1 - 0.8 ** 5) ** 40.
BANDS, ROWS = 40, 5
#: Pairs that a set proposes with each other component of a bucket at first, likeliest first. Where they
#: fail and there are others, four times as many are proposed, until none is left out.
PROPOSED = 3
#: Members of one bucket that are compared with each other in one task; larger buckets go in blocks.
BLOCK = 1024

_ROUND = np.uint64(54)
_VALUE = np.uint64((1 << 54) - 1)


@dataclass
class ShingleSets:
    """The distinct shingles of each text, sorted, one text after another."""

    values: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: pa.Array, k: int) -> ShingleSets:
        words = Words(*flat(texts), NON_SPACE, lower=True)
        prefix = WORDS.prefix(words.hashes())
        start = np.flatnonzero(words.room() >= k)
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        values = np.concatenate(
            [
                WORDS.between(prefix, start, start + k),
                WORDS.between(prefix, words.first[short], words.first[short + 1]),
            ]
        )
        text = np.concatenate([words.document[start], short])
        order = np.argsort(values)
        order = order[np.argsort(text[order], kind="stable")]
        values, text = values[order], text[order]
        new = np.append(True, (values[1:] != values[:-1]) | (text[1:] != text[:-1]))[: len(values)]
        values, text = values[new], text[new]
        return ShingleSets(values, np.searchsorted(text, np.arange(len(texts) + 1)))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def sums(self, seed: int) -> np.ndarray:
        """A hash of each set that doesn't depend on order."""
        total = np.zeros(len(self.values) + 1, np.uint64)
        np.cumsum(mix(self.values ^ np.uint64(seed)), out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def sketches(self, t: int) -> np.ndarray:
        """Fast similarity sketching: t coordinates for each set that isn't empty.

        In round i each element of a set falls into one of t bins with a value in [i, i + 1); in the
        rounds from t on, all fall into bin i - t. A bin keeps its smallest value. A set is done
        when its bins are full, after 2 t rounds at the latest, and usually after a few.
        """
        sizes = self.sizes
        table = np.full((len(sizes), t), np.iinfo(np.uint64).max, np.uint64)
        flat_table = table.reshape(-1)
        values, text = self.values, np.repeat(np.arange(len(sizes)), sizes)
        for i in range(2 * t):
            if not len(values):
                break
            drawn = mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            if i < t:
                bins = ((drawn >> np.uint64(44)) * np.uint64(t) >> np.uint64(20)).astype(np.int64)
            else:
                bins = np.full(len(values), i - t)
            key = (np.uint64(i) << _ROUND) | (mix(drawn) & _VALUE)
            np.minimum.at(flat_table, text * t + bins, key)
            full = (table != np.iinfo(np.uint64).max).all(1)
            left = ~full[text]
            values, text = values[left], text[left]
        return table


def _bands(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketches), bands)).copy()
    parts = sketches.reshape(len(sketches), bands, rows)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return keys


@dataclass
class NearDuplicates:
    """rows: `row`, k1, k2, id, n_shingles, component, component_id, kept. links: verified pairs of distinct sets."""

    rows: DataFrame
    links: DataFrame


def near_duplicates(
    documents: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: Sequence[str] = (),
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    band_rows: int = ROWS,
) -> NearDuplicates:
    """Group documents by links between texts whose shingle sets overlap by `percent` of their union.

    A-Z are lower-cased, words are runs without white space, and a document's set holds its
    distinct runs of `shingle` words; with fewer words, all of them as one. Documents without words
    (null and empty texts) have an empty set and are linked with nothing.

    1. Documents with equal sets collapse to one set, however many they are.
    2. Each set gets a sketch of `bands` * `band_rows` coordinates; sets that agree in a band meet in
       its bucket. Every member is paired with the bucket's smallest set only.
    3. Pairs are verified on the full sets, and links make components.
    4. Where members of different components still share a bucket without having been compared,
       they are, block by block: each set outside the bucket's commonest component counts what it
       has in common with all others at once, over 24 bits of each shingle's hash. That can only
       overstate, so no link is missed, and the best few pairs with each component are verified.
    Sets go by a hash of 64 bits: among n different ones, about n * n / 2 ** 65 pairs are mixed up.

    rows, one for each document: `row` (a struct of the `carry` columns), k1, k2 (a hash of the row's
    id and text), id, n_shingles, component (one number for each, null without words), component_id (the smallest id reachable; null ids count as none)
    and kept (id is component_id, also if both are null). Rows repeated in full are all kept or not.
    """
    named = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row") if carry else F.lit(None).cast("int").alias("row"),
        F.col(doc_id).alias("id"),
        F.col(text).alias("text"),
        *row_key(F.struct(F.col(doc_id)), F.col(text)),
    )
    row_type = named.schema["row"].dataType.simpleString()
    id_type = named.schema["id"].dataType.simpleString()
    def sketch(batches):
        for batch in slices(batches, "text"):
            sets = ShingleSets.of(batch.column("text"), shingle)
            sketches = sets.sketches(bands * band_rows)
            some = sets.sizes > 0
            keys = _bands(sketches, bands, band_rows).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "id", "k1", "k2")),
                    pa.array(sets.sizes, pa.int64()),
                    pa.array(sets.sums(1).view(np.int64), mask=~some),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[some].ravel())),
                ],
                ["row", "id", "k1", "k2", "n_shingles", "node", "bands"],
            )

    base = checkpoint(
        named.mapInArrow(
            sketch,
            f"row {row_type}, id {id_type}, k1 long, k2 long, n_shingles long, node long, bands array<long>",
        )
    )
    # One row for each distinct set, with a document that has it.
    sets = checkpoint(
        base.filter("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("id").alias("least_id"), F.min(F.struct("k1", "k2")).alias("place"), F.first("bands").alias("bands"))
    )
    banded = sets.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    shared = checkpoint(banded.join(buckets, "band").filter("node <> lead"))
    pairs = checkpoint(shared.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    # Every set that shares a bucket is in a pair, so these serve all rounds.
    full = _full_sets(pairs, sets, named, shingle)
    links = checkpoint(_verified(pairs, full, percent))
    labels = components(links)
    proposed = PROPOSED
    while True:
        between = checkpoint(_between(shared, labels, full, percent, proposed))
        more = checkpoint(_verified(between.select("a", "b").distinct(), full, percent))
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = components(links)
        unsure = between.filter("rest")
        if not unsure.limit(1).count() or not _apart(unsure, labels).limit(1).count():
            break
        proposed *= 4
    grouped = sets.select("node", "least_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_node = checkpoint(grouped.join(least, "label").select("node", F.col("label").alias("component"), "component_id"))
    rows = base.join(of_node, "node", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    )
    rows = rows.select("row", "k1", "k2", "id", "n_shingles", "component", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return NearDuplicates(rows, links)


def _full_sets(pairs: DataFrame, sets: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """The shingles of every set in a pair, from the text of one document that has it."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    places = sets.select("node", "place").join(nodes, "node").select("node", "place.*")

    def collect(batches):
        for batch in slices(batches, "text"):
            found = ShingleSets.of(batch.column("text"), shingle)
            short = np.ascontiguousarray((found.values & np.uint64(0xFFFFFF)).astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]
            raw = [
                [x[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
                for x in (found.values, short)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *(pa.array(r, pa.binary()) for r in raw)], ["node", "shingles", "short"]
            )

    full = named.select("k1", "k2", "text").join(places, ["k1", "k2"]).select("node", "text")
    # Rows repeated in full bring the same set again.
    found = full.mapInArrow(collect, "node long, shingles binary, short binary")
    return checkpoint(found.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("short").alias("short")))


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs a, b whose full shingle sets are similar enough."""
    both = (
        pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
        .join(full.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        .select("a", "b", "of_a", "of_b")
    )

    def verify(batches):
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                merged = np.concatenate([x, y])
                merged.sort()
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                similar.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(similar))

    return both.mapInArrow(verify, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are in different components; a set without a label is one of its own."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    return pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))


def _between(shared: DataFrame, labels: DataFrame, full: DataFrame, percent: int, proposed: int) -> DataFrame:
    """Pairs of different components within a bucket that may be links; each bucket's smallest set was compared with all.

    `rest` tells that the same set may have more links than `proposed` with the other's component.
    """
    member = shared.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = member.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"))
    mixed = mixed.filter("low <> high").select("band", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    member = member.join(mixed, "band").join(full.select("node", "short"), "node")
    # Each pair of blocks meets once; a bucket within one block is one group.
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    member = member.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select(
        "band", "node", "label", "short", "mine", F.least("mine", "other").alias("low_block"), F.greatest("mine", "other").alias("high_block")
    )

    def compare(group):
        n = group.num_rows
        data, at = flat(group["short"])
        parts = np.zeros((len(data) // 3, 4), np.uint8)
        parts[:, :3] = data.reshape(-1, 3)
        sizes = np.diff(at) // 3
        ends = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(n), sizes)
        # For every distinct value, the sets that hold it.
        _, value, times = np.unique(parts.view("<u4").ravel(), return_inverse=True, return_counts=True)
        holders = owner[np.argsort(value, kind="stable")]
        first = np.cumsum(times) - times
        label, mine = group["label"].to_numpy(), group["mine"].to_numpy()
        apart = group["low_block"][0].as_py() != group["high_block"][0].as_py()
        _, kind, members = np.unique(label, return_inverse=True, return_counts=True)
        a, b, rest = [], [], []
        for i in np.flatnonzero(kind != members.argmax()):
            held = value[ends[i] : ends[i + 1]]
            count = times[held]
            places = np.repeat(first[held] - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.minimum(np.bincount(holders[places], minlength=n), np.minimum(sizes, sizes[i]))
            union = sizes + sizes[i] - common
            likely = (100 * common >= percent * union) & (kind != kind[i])
            if apart:
                likely &= mine != mine[i]
            found = np.flatnonzero(likely)
            found = found[np.argsort(-common[found] / union[found], kind="stable")]
            taken: dict[int, int] = {}
            candidates = np.bincount(kind[found], minlength=len(members))
            for j in found:
                taken[kind[j]] = taken.get(kind[j], 0) + 1
                if taken[kind[j]] <= proposed:
                    a.append(i)
                    b.append(j)
                    rest.append(bool(candidates[kind[j]] > proposed))
        nodes = group["node"]
        return pa.table({"a": nodes.take(pa.array(a, pa.int64())), "b": nodes.take(pa.array(b, pa.int64())), "rest": pa.array(rest, pa.bool_())})

    pairs = member.groupBy("band", "low_block", "high_block").applyInArrow(compare, "a long, b long, rest boolean")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rest").distinct()
