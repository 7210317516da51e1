"""Benchmark decontamination with an FM-index for each shard of the training texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.fm_index import FMIndex
from playseq.llm.text import LETTER_OR_DIGIT, WORDS, Words, covered, flat, per_text, runs, slices

WINDOW = 10
#: Bytes of benchmark texts that are searched at a time, and so sent to every task at a time.
BLOCK_BYTES = 32 << 20


@dataclass
class Phrases:
    """The windows of one block of benchmark items, as rows of vocabulary numbers (from 2 on)."""

    vocabulary: np.ndarray  # sorted word hashes
    rows: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray  # item numbers, phrase by phrase
    first_owner: np.ndarray
    items: list[str]
    pairs: np.ndarray = field(init=False)  # neighbouring vocabulary numbers that occur in a phrase
    shortest: int = field(init=False)

    def __post_init__(self):
        left, right = self.rows[:, :-1], self.rows[:, 1:]
        both = right > 0
        self.pairs = np.unique(left[both] << 32 | right[both])
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.singles = np.unique(self.rows[self.lengths == 1, 0])


def phrases_of(items: Sequence[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
    data, at = flat(pa.array([text for _, text in items], pa.large_string()))
    words = Words(data, at, LETTER_OR_DIGIT, lower=True)
    hashes = words.hashes()
    vocabulary = np.unique(hashes)
    number = np.searchsorted(vocabulary, hashes) + 2
    names = sorted({item if item is not None else "null" for item, _ in items})
    of_name = {name: k for k, name in enumerate(names)}
    owner = np.array([of_name[item if item is not None else "null"] for item, _ in items], np.int64)
    counts = words.counts
    windows = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
    item = np.repeat(np.arange(len(items)), windows)
    start = np.repeat(words.first[:-1], windows) + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    length = np.minimum(counts[item], window)
    rows = np.zeros((len(item), window), np.int64)
    for k in range(window):
        inside = length > k
        rows[inside, k] = number[start[inside] + k]
    found, phrase = np.unique(rows, axis=0, return_inverse=True)
    owned = np.unique(np.stack([phrase.ravel(), owner[item]], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    return Phrases(
        vocabulary,
        found,
        (found > 0).sum(1),
        owned[:, 1],
        np.searchsorted(owned[:, 0], np.arange(len(found) + 1)),
        names,
    )


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Every place where a phrase occurs in one shard: word index and phrase number.

    Only runs of neighbouring words that are also neighbours in some phrase are indexed;
    no occurrence can reach beyond such a run.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not len(phrases.rows):
        return nothing
    hashes = words.hashes()
    number = np.searchsorted(phrases.vocabulary, hashes)
    number[phrases.vocabulary[np.minimum(number, len(phrases.vocabulary) - 1)] != hashes] = -2
    number += 2
    known = number > 0
    joined = known[:-1] & known[1:]
    joined[words.first[(words.first > 0) & (words.first < len(words))] - 1] = False
    places = np.flatnonzero(joined)
    pair = number[places] << 32 | number[places + 1]
    at = np.minimum(np.searchsorted(phrases.pairs, pair), max(len(phrases.pairs) - 1, 0))
    joined[places] = phrases.pairs[at] == pair if len(phrases.pairs) else False
    begin, end = runs(joined, np.zeros(0, np.int64))
    end = end + 1
    long = end - begin >= max(phrases.shortest, 2)
    begin, end = begin[long], end[long]
    if len(phrases.singles):
        alone = np.flatnonzero(np.isin(number, phrases.singles))
        alone = alone[~covered(begin, end - begin, len(words))[alone]]
        begin, end = np.append(begin, alone), np.append(end, alone + 1)
    if not len(begin):
        return nothing
    size = end - begin
    # Runs one after another, with a 1 after each: no phrase holds that symbol.
    target = np.repeat(np.cumsum(size + 1) - size - 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    source = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    sequence = np.ones(int((size + 1).sum()), np.int64)
    sequence[target] = number[source]
    origin = np.full(len(sequence), -1)
    origin[target] = source
    index = FMIndex(sequence)
    low, high = index.count(phrases.rows, phrases.lengths)
    times = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(times)), times)
    row = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return origin[index.locate(row)], phrase


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[list[tuple]]:
    """The items in blocks of bounded bytes; each block is fetched by itself."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes))
    if n == 1:
        yield [tuple(r) for r in items.collect()]
        return
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    window: int = WINDOW,
    clean: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Find every occurrence of `window` consecutive benchmark words in the documents.

    A-Z are lower-cased and words are runs of letters and digits (any non-ASCII character
    counts as one). An item of fewer words is one window; an item without words is none.
    Each shard of documents is indexed where it is read, and the benchmark's windows are
    searched in it. Nothing is shuffled. The benchmark goes to the tasks in blocks of
    `block_bytes`, each with a pass over the documents' words.

    Returns, one row for each document: `row` (a struct of the `carry` columns, whatever
    their names), n_words, n_hit (words inside any occurrence), items (ids of the items with
    an occurrence, as strings in order; a missing id is "null"), spans (merged byte ranges
    to be removed, from the first to past the last word) and, with `clean`, clean_text:
    the text with each span cut out, null if the text is null. Null and empty texts have no words.
    Rows that are repeated get equal results.
    """
    span = "array<struct<first:int,past:int>>"
    out = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.col(text).alias("text"),
        F.lit(None).cast("binary").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    row_type = out.schema["row"].dataType.simpleString()
    broadcast = documents.sparkSession.sparkContext.broadcast
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        phrases = broadcast(phrases_of(block, window))

        def search(batches, phrases=phrases):
            for batch in slices(batches, "text"):
                yield _search(batch, phrases.value)

        out = out.mapInArrow(search, f"row {row_type}, text string, hits binary, items array<string>")

    def finish(batches):
        for batch in slices(batches, "text"):
            yield _finish(batch, clean)

    return out.mapInArrow(
        finish,
        f"row {row_type}, n_words long, n_hit long, items array<string>, spans {span}, clean_text string",
    ).select("row", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), "spans", *(["clean_text"] if clean else []))


def _words(batch: pa.RecordBatch) -> Words:
    return Words(*flat(batch.column("text")), LETTER_OR_DIGIT, lower=True)


def _hits(batch: pa.RecordBatch, words: Words) -> np.ndarray:
    """One byte for each word, as earlier blocks left it."""
    data, _ = flat(batch.column("hits"))
    return data.astype(bool) if len(data) == len(words) else _spread(batch, words)


def _spread(batch, words) -> np.ndarray:
    data, at = flat(batch.column("hits"))
    hit = np.zeros(len(words), bool)
    kept = np.diff(at) > 0
    hit[np.repeat(kept, words.counts)] = data.astype(bool)
    return hit


def _search(batch: pa.RecordBatch, phrases: Phrases) -> pa.RecordBatch:
    words = _words(batch)
    start, phrase = occurrences(words, phrases)
    hit = _hits(batch, words) | covered(start, phrases.lengths[phrase], len(words))
    document = np.searchsorted(words.first, start, "right") - 1
    both = np.unique(np.stack([document, phrase], 1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    items = [list(x) if x else [] for x in batch.column("items").to_pylist()]
    for d, p in both.tolist():
        owners = phrases.owners[phrases.first_owner[p] : phrases.first_owner[p + 1]]
        items[d].extend(phrases.items[k] for k in owners)
    any_hit = per_text(hit, words.first) > 0
    packed = [
        hit[a:b].tobytes() if h else None
        for a, b, h in zip(words.first[:-1], words.first[1:], any_hit, strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), batch.column("text"), pa.array(packed, pa.binary()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
        ["row", "text", "hits", "items"],
    )


def _finish(batch: pa.RecordBatch, clean: bool) -> pa.RecordBatch:
    words = _words(batch)
    hit = _hits(batch, words)
    begin, end = runs(hit, words.first)
    first, past = words.start[begin], words.end[end - 1]
    document = np.searchsorted(words.first, begin, "right") - 1
    base = words.at[document]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(document, np.arange(batch.num_rows + 1)), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(first - base, pa.int32()), pa.array(past - base, pa.int32())], ["first", "past"]
        ),
    )
    texts = pa.nulls(batch.num_rows, pa.string())
    if clean:
        texts = cut(batch.column("text"), document, first - base, past - base)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row"),
            pa.array(words.counts, pa.int64()),
            pa.array(per_text(hit, words.first), pa.int64()),
            batch.column("items"),
            spans,
            texts,
        ],
        ["row", "n_words", "n_hit", "items", "spans", "clean_text"],
    )


def cut(texts: pa.Array, document: np.ndarray, first: np.ndarray, past: np.ndarray) -> pa.Array:
    """Texts without the given byte ranges, which are sorted by text and place and don't overlap."""
    if not len(document):
        return texts.cast(pa.string())
    out = texts.to_pylist()
    bounds = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
    for a, b in zip(bounds, np.append(bounds[1:], len(document)), strict=True):
        d = document[a]
        raw = out[d].encode()
        edges = [0, *np.stack([first[a:b], past[a:b]], 1).ravel().tolist(), len(raw)]
        out[d] = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
    return pa.array(out, pa.string())
