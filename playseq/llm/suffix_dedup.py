"""Removing repeated byte strings with suffix arrays of shards, built by induced sorting."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.decontaminate import cut
from playseq.llm.spread import SENT, found_twice, member, send, unpack
from playseq.llm.suffixes import permuted_common_prefixes, suffix_array
from playseq.llm.tables import checkpoint, row_key, width
from playseq.llm.text import BYTES, covered, flat, per_text, runs, slices

LENGTH = 400
#: Bytes of the strings whose smallest hash within a window says where the window is compared.
GRAM = 50
#: Windows of one piece at most; a piece that repeats itself (one character, say) is cut there.
MOST_WINDOWS = 512
#: Text of one shard.
SHARD_BYTES = 2 << 20
#: A class with more different pieces than this is compared by window hashes, dealt to many tasks.
CLASS_PIECES = 2048

PIECES = "class long, content long, windows int, start int, recurs boolean, k1 long, k2 long"
SPANS = "k1 long, k2 long, first int, past int"


def _sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every `size` neighbours, by their first: block minima from both sides."""
    n = len(values)
    if n < size:
        return values[:0]
    padded = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def _pieces(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Runs of windows with the same smallest gram: class, content hash, number of windows, start,
    whether its smallest gram recurs in it, text."""
    if len(data) < length:
        return None
    prefix = BYTES.prefix(BYTES.table[data])
    grams = BYTES.windows(prefix, gram)
    smallest = _sliding_minimum(grams, length - gram + 1)
    room = np.zeros(len(data) + 1, np.int64)
    sizes = np.diff(at)
    long = sizes >= length
    room[at[:-1][long]] = 1
    np.add.at(room, at[:-1][long] + sizes[long] - length + 1, -1)
    valid = np.cumsum(room[: len(smallest)]) > 0
    new = valid.copy()
    new[1:] &= (smallest[1:] != smallest[:-1]) | ~valid[:-1]
    new[at[:-1][at[:-1] < len(new)]] = valid[at[:-1][at[:-1] < len(new)]]
    start = np.flatnonzero(new)
    if not len(start):
        return None
    # A run ends before the next one, or where its text has no further window.
    text = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(smallest)), at[text + 1] - length + 1)
    parts = -(-(end - start) // MOST_WINDOWS)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, end, text = np.repeat(start, parts) + within * MOST_WINDOWS, np.repeat(end, parts), np.repeat(text, parts)
    windows = np.minimum(end - start, MOST_WINDOWS)
    content = BYTES.between(prefix, start, start + windows + length - 1)
    # Only a piece that holds its smallest gram twice can repeat a window within itself.
    last = start + windows + length - gram
    recurs = [np.count_nonzero(grams[a:b] == g) > 1 for a, b, g in zip(start, last, smallest[start], strict=True)]
    return smallest[start], content, windows, start - at[text], np.array(recurs), text


def remove_repeats(
    documents: DataFrame,
    *,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    identity: Sequence[str] = ("doc_id",),
    length: int = LENGTH,
    gram: int = GRAM,
    keep_text: bool = False,
    shard_bytes: int = SHARD_BYTES,
    class_pieces: int = CLASS_PIECES,
    also: DataFrame | None = None,
) -> DataFrame:
    """Remove each byte inside a string of `length` bytes that also starts anywhere else.

    Texts are UTF-8; strings stay within one document, another start in the same document counts,
    overlapping ones included, and all strings are judged on the input.

    1. Every window of `length` bytes belongs to the class of its smallest hashed `gram`, so equal
       windows share a class wherever they stand. Neighbouring windows of one class form a piece.
    2. Pieces with equal content repeat each other. A class that is left with several different
       pieces, or one that may repeat itself, goes to a shard: its pieces' text is sorted by induced sorting, and windows whose
       permuted common prefix with a neighbour reaches `length` repeat. A class with more than
       `class_pieces` different ones (a passage in ever new surroundings) would outgrow a shard;
       the hashes of its windows are dealt to all tasks and compared there.
    3. Bytes covered by repeated windows go, and those in the spans `also` (k1 and k2 of the row, first, past).

    Returns, one row for each document: `row` (a struct of the `carry` columns), n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256, spans (their byte ranges) and, with
    `keep_text`, kept_text (a character cut in two is left out). Null and short texts lose
    nothing; a null text has 0 bytes and a null kept text. Rows repeated in full are other places.
    """
    if not 1 <= gram <= length:
        raise ValueError("the gram must lie between 1 and the length")
    spark = documents.sparkSession
    keyed = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.col(text).alias("text"),
        *row_key(F.struct(*(F.col(f"`{c}`") for c in identity)), F.col(text)),
    )

    def cut_up(batches):
        for batch in slices(batches, "text"):
            found = _pieces(*flat(batch.column("text")), length, gram)
            if found is None:
                continue
            group, content, windows, start, recurs, owner = found
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    pa.array(windows, pa.int32()),
                    pa.array(start, pa.int32()),
                    pa.array(recurs),
                    batch.column("k1").take(pa.array(owner)),
                    batch.column("k2").take(pa.array(owner)),
                ],
                ["class", "content", "windows", "start", "recurs", "k1", "k2"],
            )

    pieces = keyed.select("text", "k1", "k2").mapInArrow(cut_up, PIECES)
    same = ["class", "content", "windows"]
    # Counted before the shuffle. One place stands for all of equal content.
    kinds = pieces.groupBy(*same).agg(F.count("*").alias("times"), F.max("recurs").alias("recurs"), F.min(F.struct("k1", "k2", "start")).alias("place"))
    kinds = checkpoint(kinds)
    groups = kinds.groupBy("class").agg(
        F.count("*").alias("different"), F.max("times").alias("most"), F.max("recurs").alias("any_recurs")
    )
    groups = groups.filter("different > 1 or most > 1 or any_recurs").select("class", "different")
    mine = kinds.join(groups, "class")
    repeated = mine.filter("times > 1").select(*same)
    contested = checkpoint(
        mine.filter("different > 1 or (recurs and times = 1)").select(
            *same, "times", "different", F.col("place.k1").alias("k1"), F.col("place.k2").alias("k2"), F.col("place.start").alias("start")
        )
    )
    # Pieces that occur as a whole elsewhere: every place of theirs.
    whole = pieces.join(repeated, same, "left_semi").select(
        "k1", "k2", F.col("start").alias("first"), (F.col("start") + F.col("windows") + (length - 1)).alias("past")
    )
    sizes = contested.agg(F.sum(F.col("windows") + length).alias("bytes"), F.sum(F.when(F.col("different") > class_pieces, F.col("windows"))).alias("hot")).first()
    fetched = _fetch(keyed, contested, length)
    found = [whole]
    if sizes["bytes"]:
        shards = max(width(spark), math.ceil(2 * sizes["bytes"] / shard_bytes))
        fetched = checkpoint(fetched.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards))))

        def sort_shard(shard):
            return _repeats_in_shard(shard, length)

        found.append(fetched.filter(f"different <= {class_pieces}").groupBy("shard").applyInArrow(sort_shard, SPANS))
    if sizes["hot"]:
        found.append(_repeats_by_hash(fetched.filter(f"different > {class_pieces}"), length, sizes["hot"] * 8))
    if also is not None:
        found.append(also)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    # Rows repeated in full give equal spans, merged before they meet.
    spans = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    joined = keyed.join(spans, ["k1", "k2"], "left").select("row", "text", "spans")
    row_type = keyed.schema["row"].dataType.simpleString()

    def finish(batches):
        for batch in slices(batches, "text"):
            yield _removed(batch, keep_text)

    out = joined.mapInArrow(
        finish,
        f"row {row_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:int,past:int>>, kept_text string",
    )
    return out if keep_text else out.drop("kept_text")


def _fetch(keyed: DataFrame, contested: DataFrame, length: int) -> DataFrame:
    """The text of contested pieces, cut out where their documents are."""
    wanted = contested.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("class", "content", "windows", "times", "different", "start")).alias("wanted")
    )
    here = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"])

    def cut_out(batches):
        for batch in slices(batches, "text"):
            data, at = flat(batch.column("text"))
            lists = batch.column("wanted")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            flatten = lists.flatten()
            names = ["class", "content", "windows", "times", "different", "start"]
            columns = dict(zip(names, flatten.flatten(), strict=True))
            first = at[owner] + columns["start"].to_numpy()
            past = first + columns["windows"].to_numpy() + length - 1
            raw = [data[a:b].tobytes() for a, b in zip(first.tolist(), past.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), batch.column("k1").take(pa.array(owner)), batch.column("k2").take(pa.array(owner)), pa.array(raw, pa.binary())],
                [*names, "k1", "k2", "bytes"],
            )

    return here.mapInArrow(
        cut_out, "class long, content long, windows int, times long, different long, start int, k1 long, k2 long, bytes binary"
    )


def _spans(table: pa.Table, piece: np.ndarray, first: np.ndarray, past: np.ndarray) -> pa.Table:
    start = table["start"].to_numpy()[piece]
    piece = pa.array(piece)
    return pa.table(
        {
            "k1": table["k1"].take(piece),
            "k2": table["k2"].take(piece),
            "first": pa.array(start + first, pa.int32()),
            "past": pa.array(start + past, pa.int32()),
        }
    )


def _repeats_in_shard(shard: pa.Table, length: int) -> pa.Table:
    """Spans of repeated windows, for the pieces that occur once."""
    shard = shard.combine_chunks()
    # Rows repeated in full bring the same piece twice.
    seen, keep = set(), []
    for k, piece in enumerate(zip(*(shard[c].to_pylist() for c in ("class", "content", "windows")), strict=True)):
        if piece not in seen:
            seen.add(piece)
            keep.append(k)
    shard = shard.take(pa.array(keep))
    data, at = flat(shard["bytes"])
    sizes = np.diff(at)
    n = len(sizes)
    # Symbols: 0 ends the shard, 1 each piece, bytes from 2 on.
    symbols = np.zeros(len(data) + n + 1, np.uint16)
    begin = at[:-1] + np.arange(n)
    inside = np.ones(len(symbols), bool)
    inside[begin + sizes] = False
    inside[-1] = False
    symbols[inside] = data
    symbols[inside] += 2
    symbols[begin + sizes] = 1
    order = suffix_array(symbols)
    before, common = permuted_common_prefixes(symbols, order)
    left = np.zeros(len(symbols), np.int64)  # bytes left in the piece
    left[inside] = (np.repeat(begin + sizes, sizes)) - np.flatnonzero(inside)
    reach = np.minimum(common, np.minimum(left, left[before]))
    here = np.flatnonzero(reach >= length)
    repeats = np.zeros(len(symbols), bool)
    repeats[here] = True
    repeats[before[here]] = True
    first, past = runs(repeats, np.zeros(0, np.int64))
    piece = np.searchsorted(begin, first, "right") - 1
    once = shard["times"].to_numpy()[piece] == 1
    first, past, piece = first[once], past[once], piece[once]
    return _spans(shard, piece, first - begin[piece], past - begin[piece] + length - 1)


def _repeats_by_hash(pieces: DataFrame, length: int, hash_bytes: int) -> DataFrame:
    """The same for pieces of classes that outgrow a shard: hashes of their windows meet in buckets."""
    spark = pieces.sparkSession
    chunks = max(2 * width(spark), math.ceil(hash_bytes / (8 << 20)))
    buckets = max(width(spark), math.ceil(hash_bytes / (16 << 20)))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("k1", "k2", "start"), F.lit(chunks)).cast("int"))

    def hashed(chunk):
        chunk = chunk.combine_chunks()
        seen, keep = set(), []
        for k, piece in enumerate(zip(*(chunk[c].to_pylist() for c in ("class", "content", "windows")), strict=True)):
            if piece not in seen:
                seen.add(piece)
                keep.append(k)
        chunk = chunk.take(pa.array(keep))
        data, at = flat(chunk["bytes"])
        windows = np.diff(at) - length + 1
        piece = np.repeat(np.arange(len(windows)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = at[piece] + offset
        return chunk, piece, offset, BYTES.between(BYTES.prefix(BYTES.table[data]), start, start + length)

    def spread(key, chunk):
        values = hashed(chunk)[3]
        return pa.Table.from_batches([send(values, np.full(len(values), key[0].as_py()), buckets)])

    repeated = checkpoint(found_twice(dealt.groupBy("chunk").applyInArrow(spread, SENT)))

    def collect(key, chunk, received):
        if not len(received) or not len(chunk):
            return pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "first": pa.array([], pa.int32()), "past": pa.array([], pa.int32())})
        chunk, piece, offset, values = hashed(chunk)
        chosen = np.sort(unpack(received["hashes"].to_pylist()))
        once = chunk["times"].to_numpy()[piece] == 1
        first, past = runs(member(values, chosen) & once, np.flatnonzero(offset == 0))
        return _spans(chunk, piece[first], offset[first], offset[past - 1] + length)

    return dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(collect, SPANS)


def _removed(batch: pa.RecordBatch, keep_text: bool) -> pa.RecordBatch:
    data, at = flat(batch.column("text"))
    lists = batch.column("spans")
    owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
    first, past = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
    gone = covered(at[owner] + first, past - first, len(data))
    begin, end = runs(gone, at)
    document = np.searchsorted(at, begin, "right") - 1
    kept = data[~gone]
    ends = np.concatenate([[0], np.cumsum(per_text(~gone, at))])
    texts = pa.nulls(batch.num_rows, pa.string())
    if keep_text:
        texts = cut(batch.column("text"), document, begin - at[document], end - at[document])
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(document, np.arange(batch.num_rows + 1)), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(begin - at[document], pa.int32()), pa.array(end - at[document], pa.int32())], ["first", "past"]
        ),
    )
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row"),
            pa.array(np.diff(at), pa.int64()),
            pa.array(per_text(gone, at), pa.int64()),
            pa.array(np.bincount(document, minlength=batch.num_rows), pa.int64()),
            pa.array([hashlib.sha256(kept[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
            spans,
            texts,
        ],
        ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"],
    )
