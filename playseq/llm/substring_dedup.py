"""Removing repeated runs of words, found at difference-cover anchors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.spread import SENT, found_twice, member, send, unpack
from playseq.llm.tables import checkpoint, row_key, total_bytes, width
from playseq.llm.text import NON_SPACE, WORDS, Words, covered, flat, per_text, runs, slices

WINDOW = 35
PERIOD = 21
#: Text of one chunk and hashes of one bucket: each is held by one task at a time.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest set of residues, with 0, whose differences give every residue."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            chosen = (0, *rest)
            if len({(a - b) % period for a in chosen for b in chosen}) == period:
                return chosen
    raise ValueError(f"no period: {period}")


class _Piece:
    """The words of one slice, their rolling hashes and the anchors among them."""

    def __init__(self, batch: pa.RecordBatch, window: int, period: int):
        self.words = Words(*flat(batch.column("text")), NON_SPACE)
        self.hashes = self.words.hashes()
        self.prefix = WORDS.prefix(self.hashes)
        self.room = self.words.room()
        # Any two places have an anchor at the same distance below `period`, so the rest of the
        # window after that distance is what an anchor may look at.
        self.reach = window - period + 1
        place = np.arange(len(self.words)) - np.repeat(self.words.first[:-1], self.words.counts)
        in_cover = np.zeros(period, bool)
        in_cover[list(difference_cover(period))] = True
        enough = np.repeat(self.words.counts >= window, self.words.counts)
        self.anchors = np.flatnonzero(in_cover[place % period] & enough & (self.room >= self.reach))

    def anchor_hashes(self) -> np.ndarray:
        return WORDS.between(self.prefix, self.anchors, self.anchors + self.reach)

    def candidates(self, repeated: np.ndarray, window: int, period: int) -> np.ndarray:
        """Starts of windows with a repeated anchor among their first `period` words."""
        at = self.anchors[member(self.anchor_hashes(), repeated)]
        first = np.maximum(at - period + 1, self.words.first[self.words.document[at]] if len(at) else 0)
        near = covered(first, at - first + 1, len(self.words))
        return np.flatnonzero(near & (self.room >= window))

    def window_hashes(self, starts: np.ndarray, window: int) -> np.ndarray:
        return WORDS.between(self.prefix, starts, starts + window)


def remove_repeats(
    documents: DataFrame,
    *,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    window: int = WINDOW,
    period: int = PERIOD,
    keep_text: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Remove each word inside a run of `window` words that also starts anywhere else.

    Words are runs without white space; runs stay within one document, and another start in the
    same document counts, overlapping ones included. All runs are judged on the input.

    1. Windows of `window - period + 1` words are hashed only at places whose number in the
       document, modulo `period`, is in a difference cover. Two equal runs anywhere have such
       anchors at equal distances from their starts, so the anchors' hashes repeat too.
    2. Around repeated anchors, whole windows are compared by hash.
    3. Words covered by repeated windows go.
    Documents are dealt to chunks by content, and hashes travel packed (see spread), so a passage
    in every document costs each task one hash, and no task meets all its occurrences.

    Returns, one row for each document: `row` (a struct of the `carry` columns), n_words,
    n_removed, kept_sha256 (of the kept words joined by single spaces) and, with `keep_text`,
    kept_text. Null, empty and short texts lose nothing; a null text's kept text is null.
    Rows repeated in full are other places: they lose all words in runs.
    """
    dealt = documents.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text).alias("text"))
    schema = "n_words long, n_removed long, kept_sha256 string, kept_text string"
    out = _compared(dealt, window, period, chunk_bytes, bucket_bytes, partial(_removed, keep_text=keep_text), _nothing, schema)
    return out if keep_text else out.drop("kept_text")


def repeated_spans(
    documents: DataFrame,
    *,
    text: str = "text",
    identity: Sequence[str] = ("doc_id",),
    window: int = WINDOW,
    period: int = PERIOD,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The bytes from the first word to the last of what `remove_repeats` removes: k1 and k2 (see row_key), first, past."""
    keys = row_key(F.struct(*(F.col(f"`{c}`") for c in identity)), F.col(text))
    dealt = documents.select(F.struct(*keys).alias("row"), F.col(text).alias("text"))
    schema = "spans array<struct<first:int,past:int>>"
    out = _compared(dealt, window, period, chunk_bytes, bucket_bytes, _spans, _no_spans, schema)
    return out.select("row.k1", "row.k2", F.explode("spans").alias("span")).select("k1", "k2", "span.first", "span.past")


def _compared(dealt, window, period, chunk_bytes, bucket_bytes, finish, nothing, schema) -> DataFrame:
    """What `finish` makes of every slice (row, text) and the repeated hashes of its chunk."""
    if not 1 <= period <= window:
        raise ValueError("the period must lie between 1 and the window")
    spark = dealt.sparkSession
    size = total_bytes(dealt)
    chunks = max(2 * width(spark), math.ceil(size / chunk_bytes))
    anchor_bytes = size / 6 * len(difference_cover(period)) / period * 8
    buckets = max(width(spark), math.ceil(anchor_bytes / bucket_bytes))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("row.*", "text"), F.lit(chunks)).cast("int"))

    def anchors(batches):
        found, chunk = [], []
        for batch in slices(batches, "text"):
            piece = _Piece(batch, window, period)
            found.append(piece.anchor_hashes())
            chunk.append(batch.column("chunk").to_numpy()[piece.words.document[piece.anchors]])
        if found:
            yield send(np.concatenate(found), np.concatenate(chunk), buckets)

    def windows(key, chunk, received):
        repeated = np.sort(unpack(received["hashes"].to_pylist()))
        found = []
        for batch in slices(chunk.to_batches() if len(repeated) else [], "text"):
            piece = _Piece(batch, window, period)
            found.append(piece.window_hashes(piece.candidates(repeated, window, period), window))
        found = np.concatenate(found) if found else repeated[:0]
        return pa.Table.from_batches([send(found, np.full(len(found), key[0].as_py()), buckets)])

    def remove(chunk, back):
        kinds = back["kind"].to_numpy()
        anchored, repeated = (np.sort(unpack(back.filter(pa.array(kinds == k))["hashes"].to_pylist())) for k in (1, 2))
        pieces = slices(chunk.to_batches(), "text")
        batches = [finish(batch, anchored, repeated, window, period) for batch in pieces]
        return pa.Table.from_batches(batches) if batches else nothing(chunk.schema.field("row").type)

    repeated_anchors = checkpoint(found_twice(dealt.select("chunk", "text").mapInArrow(anchors, SENT)))
    # From here on it is one query, in which the exchange of texts by chunk is made once and read twice.
    sent = dealt.groupBy("chunk").cogroup(repeated_anchors.groupBy("chunk")).applyInArrow(windows, SENT)
    back = repeated_anchors.withColumn("kind", F.lit(1)).unionByName(found_twice(sent).withColumn("kind", F.lit(2)))
    row_type = dealt.schema["row"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(remove, f"row {row_type}, {schema}")


def _nothing(row_type: pa.DataType) -> pa.Table:
    names = ["row", "n_words", "n_removed", "kept_sha256", "kept_text"]
    kinds = [row_type, pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.table([pa.array([], k) for k in kinds], names=names)


def _no_spans(row_type: pa.DataType) -> pa.Table:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
    keys = pa.struct([(f.name, f.type) for f in row_type])
    return pa.table([pa.array([], keys), pa.array([], kind)], names=["row", "spans"])


def _gone(piece: _Piece, repeated_anchors, repeated, window, period) -> np.ndarray:
    """Which words lie in repeated windows."""
    if not len(repeated):
        return np.zeros(len(piece.words), bool)
    starts = piece.candidates(repeated_anchors, window, period)
    starts = starts[member(piece.window_hashes(starts, window), repeated)]
    return covered(starts, window, len(piece.words))


def _spans(batch, repeated_anchors, repeated, window, period) -> pa.RecordBatch:
    piece = _Piece(batch, window, period)
    words = piece.words
    first, past = runs(_gone(piece, repeated_anchors, repeated, window, period), words.first)
    document = words.document[first]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(document, np.arange(batch.num_rows + 1)), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(x - words.at[document], pa.int32()) for x in (words.start[first], words.end[past - 1])], ["first", "past"]
        ),
    )
    # Spark's fields that are never null aren't those of the result.
    row = pa.StructArray.from_arrays(batch.column("row").flatten(), ["k1", "k2"])
    return pa.RecordBatch.from_arrays([row, spans], ["row", "spans"])


def _removed(batch, repeated_anchors, repeated, window, period, keep_text) -> pa.RecordBatch:
    piece = _Piece(batch, window, period)
    words = piece.words
    gone = _gone(piece, repeated_anchors, repeated, window, period)
    kept, at = joined(words, ~gone)
    raw = [kept[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    texts = pa.nulls(batch.num_rows, pa.string())
    if keep_text:
        null = batch.column("text").is_null().to_pylist()
        texts = pa.array([None if n else r.decode("utf-8", "replace") for n, r in zip(null, raw, strict=True)], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row"),
            pa.array(words.counts, pa.int64()),
            pa.array(per_text(gone, words.first), pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
            texts,
        ],
        ["row", "n_words", "n_removed", "kept_sha256", "kept_text"],
    )


def joined(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text with one space between them, as bytes, and where each text starts."""
    start, end = words.start[kept], words.end[kept]
    document = words.document[kept]
    data = words.data.copy()
    mask = covered(start, end - start, len(data))
    follows = start[1:][document[1:] == document[:-1]] - 1  # white space before all but a text's first word
    data[follows] = 0x20
    mask[follows] = True
    return data[mask], np.concatenate([[0], np.cumsum(per_text(mask, words.at))])
