"""Ranked lexical search with whole-number scores, by classes of documents that score alike.

A document's score depends on nothing but its counts of the items' terms and on `m`, which its length
gives. Documents are restricted to the items' vocabulary, those that agree in both form a class, each
class is scored once against all items, and its members share the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playseq.llm.tables import checkpoint
from playseq.llm.text import LETTER_OR_DIGIT, Words, flat, slices

TOP = 10
#: Bytes of the items' distinct terms that are searched at a time, and so sent to every task at a time.
BLOCK_BYTES = 8 << 20
#: Pairs of a class's term and an item that holds it, scored at a time.
PAIRS = 1 << 20
#: Bytes of classes scored at a time.
PIECE_BYTES = 1 << 18
#: Whole numbers up to here are exact in doubles.
EXACT = 1 << 53


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a batch one after another, and where each text's terms start (one more at the end).

    Terms are maximal runs of ASCII letters and digits and any other characters beyond ASCII;
    only A-Z are lower-cased.
    """
    words = Words(*flat(texts), LETTER_OR_DIGIT, lower=True)
    inside = words.data[LETTER_OR_DIGIT[words.data]]  # the terms' bytes are all of these, in order
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.end - words.start, out=offsets[1:])
    found = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(inside)))
    return found, words.first


@dataclass
class Query:
    """A block of items: its vocabulary in order, and the items that hold each term."""

    items: pa.Array
    vocabulary: pa.Array
    first: np.ndarray  # where each term's items start
    holders: np.ndarray

    @classmethod
    def of(cls, pairs: pa.Table) -> Query:
        """From distinct pairs of item_id and term."""
        encoded = pc.dictionary_encode(pairs.column("item_id").combine_chunks(), null_encoding="encode")
        term = pairs.column("term").combine_chunks().cast(pa.large_string())
        vocabulary = pc.unique(term).sort()
        number = pc.index_in(term, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(number, kind="stable")
        holders = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        return cls(encoded.dictionary, vocabulary, np.searchsorted(number[order], np.arange(len(vocabulary) + 1)), holders)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct pairs of item_id and term."""

    def read(batches):
        for batch in slices(batches, "text"):
            found, first = terms(batch.column("text"))
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(owner), found.cast(pa.string())], ["item_id", "term"])

    return items.mapInArrow(read, f"item_id {items.schema['item_id'].dataType.simpleString()}, term string").distinct()


def _restricted(texts: pa.Array, query: Query) -> tuple[np.ndarray, list[bytes]]:
    """The number of terms of each text, and its bag: numbers and counts of the vocabulary terms that it holds."""
    found, first = terms(texts)
    number = pc.index_in(found, query.vocabulary)
    known = number.is_valid().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))[known]
    size = max(len(query.vocabulary), 1)
    pair, tf = np.unique(owner * size + number.drop_null().to_numpy().astype(np.int64), return_counts=True)
    packed = np.stack([pair % size, tf], 1).astype(np.int32)
    at = np.searchsorted(pair // size, np.arange(len(texts) + 1))
    return np.diff(first), [packed[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _smallest(keys: list, top: int) -> list:
    return sorted(keys, key=lambda k: (k is None, 0 if k is None else k))[:top]


def bags(documents: DataFrame, query, text: str, key: str, top: int) -> DataFrame:
    """Documents with a term, those of a slice that agree in length and bag in one row.

    Returns n (terms), bag, held (documents) and keys (the `top` smallest of them, in order).
    """
    chosen = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def restrict(batches):
        for batch in slices(batches, "text"):
            alike: dict[tuple[int, bytes], list] = {}
            for name, n, bag in zip(batch.column("key").to_pylist(), *_restricted(batch.column("text"), query.value), strict=True):
                if n:
                    alike.setdefault((int(n), bag), []).append(name)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n for n, _ in alike], pa.int64()),
                    pa.array([bag for _, bag in alike], pa.binary()),
                    pa.array([len(keys) for keys in alike.values()], pa.int64()),
                    pa.array([_smallest(keys, top) for keys in alike.values()], pa.list_(batch.column("key").type)),
                ],
                ["n", "bag", "held", "keys"],
            )

    return chosen.mapInArrow(restrict, f"n long, bag binary, held long, keys array<{chosen.schema['key'].dataType.simpleString()}>")


@dataclass(frozen=True)
class Corpus:
    """What scores depend on besides a document itself."""

    documents: int  # N
    terms: int  # L
    weights: np.ndarray


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _pairs(bags_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of term and count of a batch, and the row of each."""
    data, at = flat(bags_column)
    return data.view(np.int32).reshape(-1, 2).astype(np.int64), np.repeat(np.arange(len(bags_column)), np.diff(at) // 8)


def _corpus(found: DataFrame, size: int) -> Corpus:
    """N, L and document frequencies, added up by term on the executors."""

    def partial(batches):
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            bag, owner = _pairs(batch.column("bag"))
            held, n = batch.column("held").to_numpy(), batch.column("n").to_numpy()
            np.add.at(total, bag[:, 0], held[owner])
            total[size] += held.sum()
            total[size + 1] += (n * held).sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "value"])

    read = found.select("n", "held", "bag").mapInArrow(partial, "place long, value long")
    total = np.zeros(size + 2, np.int64)
    for row in read.groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[row.place] = row.value
    n = int(total[size])
    return Corpus(n, int(total[size + 1]), np.array([weight(n, df) for df in total[:size].tolist()], np.int64))


def classes(found: DataFrame, corpus: Corpus, top: int = TOP) -> DataFrame:
    """Documents of equal bag and m: bag, m and the `top` smallest keys of their members, in order.

    No more members of a class can be among an item's first `top`. Classes are dealt by a hash of
    the bag and told apart by the bag itself. The smallest keys are in the rows with the smallest
    first keys, so a task sends `top` rows of a class at most.
    """
    length = F.expr(f"10L + (90L * n * {corpus.documents}L) div {max(corpus.terms, 1)}L")
    hashed = found.filter(F.length("bag") > 0).select(F.xxhash64("bag").alias("hash"), length.alias("m"), "bag", "keys")
    alike = ["hash", "m", "bag"]
    place = F.row_number().over(Window.partitionBy(*alike).orderBy(F.asc_nulls_last(F.col("keys")[0])))
    kept = hashed.withColumn("place", place).filter(F.col("place") <= top)
    keys = F.flatten(F.collect_list("keys"))
    return kept.groupBy(*alike).agg(F.slice(F.array_sort(keys), 1, top).alias("keys")).select("bag", "m", "keys")


def score(bag: np.ndarray, m: np.ndarray, owner: np.ndarray, rows: int, query: Query, weights: np.ndarray) -> np.ndarray:
    """Scores of `rows` classes (bag: term, count; owner: the class of each) against all items of the block."""
    items = len(query.items)
    term, tf = bag[:, 0], bag[:, 1]
    gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
    out = np.zeros(rows * items, np.int64)
    held = query.first[term + 1] - query.first[term]
    ends = np.cumsum(held)
    at = 0
    while at < len(term):
        past = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        part = slice(at, past)
        each = np.repeat(np.arange(at, past), held[part])
        within = np.arange(len(each)) - np.repeat(np.cumsum(held[part]) - held[part], held[part])
        cell = owner[each] * items + query.holders[query.first[term[each]] + within]
        if len(each) and int(gain[part].max()) * len(each) < EXACT:
            out += np.bincount(cell, gain[each], len(out)).astype(np.int64)
        else:
            np.add.at(out, cell, gain[each])
        at = past
    return out.reshape(rows, items)


def _scored(found: DataFrame, query, corpus, top: int, key_type: str, item_type: str) -> DataFrame:
    """For each item the best `top` classes of every task; more can't hold one of its first documents."""

    def read(batches):
        best: dict[int, list] = {}
        kind = None
        for batch in batches:
            kind = batch.column("keys").type
            for piece in slices([batch], "bag", PIECE_BYTES):
                _merge(best, piece, query.value, corpus.value.weights, top)
        rows = [(k, score, keys) for k, found in best.items() for score, keys in found]
        if rows:
            items, scores, keys = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [query.value.items.take(pa.array(items, pa.int64())), pa.array(scores, pa.int64()), pa.array(keys, kind)],
                ["item_id", "score", "keys"],
            )

    return found.mapInArrow(read, f"item_id {item_type}, score long, keys array<{key_type}>")


def _merge(best: dict[int, list], piece: pa.RecordBatch, query: Query, weights: np.ndarray, top: int) -> None:
    bag, owner = _pairs(piece.column("bag"))
    scores = score(bag, piece.column("m").to_numpy(), owner, piece.num_rows, query, weights)
    keys = piece.column("keys").to_pylist()
    # By the smallest key, so that a stable order by score leaves equal scores in the right one.
    order = np.array(sorted(range(len(keys)), key=lambda k: (keys[k][0] is None, 0 if keys[k][0] is None else keys[k][0])))
    for item in range(scores.shape[1]):
        column = scores[order, item]
        held = best.get(item, [])
        some = np.flatnonzero(column >= (held[-1][0] if len(held) == top else 1))
        if len(some):
            some = some[np.argsort(-column[some], kind="stable")[:top]]
            held = held + [(int(column[k]), keys[order[k]]) for k in some]
            best[item] = sorted(held, key=lambda x: (-x[0], x[1][0] is None, 0 if x[1][0] is None else x[1][0]))[:top]


def search(
    documents: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The `top` documents with the highest scores above 0 for each item: item_id, rank, doc_id, score.

    A term's weight w is floor(1000 * ln((2N + 2) / (2df + 1))) with N documents that have a term, df of
    them holding it. With n of all L terms in a document, its m is 10 + 90nN div L, and its score is
    the sum of w * (1000000000tf div (1000tf + 8m)) over the item's distinct terms. Equal scores go by
    ascending `key`, a missing one last. Every row is a document of its own, repeated ones too; rows
    that agree in score and key are interchangeable. Items of one id are one, with the terms of all
    their texts. Null and empty texts have no terms; an item without terms, or whose terms occur
    nowhere, returns nothing.

    The items' distinct terms go to the tasks in blocks of about `block_bytes` (an item is never
    cut), each with a pass over the documents. In a pass every text is read once: its bag is
    checkpointed, and statistics, classes and scores come from there.
    """
    key_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((documents, key), (items, item_id)))
    asked = checkpoint(item_terms(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))))
    total = asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    parts = []
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        parts.append(_search_block(documents, Query.of(own.toArrow()), text, key, top, key_type, item_type))
    return reduce(DataFrame.unionAll, parts)


def _search_block(documents: DataFrame, query: Query, text: str, key: str, top: int, key_type: str, item_type: str) -> DataFrame:
    broadcast = documents.sparkSession.sparkContext.broadcast
    sent = broadcast(query)
    found = checkpoint(bags(documents, sent, text, key, top))
    corpus = _corpus(found, len(query.vocabulary))
    scored = _scored(classes(found, corpus, top), sent, broadcast(corpus), top, key_type, item_type)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = scored.select("item_id", "score", F.explode("keys").alias("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
