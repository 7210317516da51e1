"""Which hashes occur twice in a corpus, told to the chunks that hold them.

Rows here are packed arrays, not hashes: a task sends each bucket one array of its distinct
hashes, with the chunk that each was met in. A bucket answers every chunk with one array of those
that were sent twice. However often a hash occurs, a task sends it to a bucket once; what the task
itself has met twice, it tells the other chunks directly.

Hashes have 64 bits: among n different strings, about n * n / 2 ** 65 pairs are taken for equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "bucket int, hashes binary, chunks binary, twice binary"
RECEIVED = "chunk int, hashes binary"


def unpack(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint64)


def member(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are among the chosen ones, which are sorted."""
    if not len(chosen) or not len(values):
        return np.zeros(len(values), bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values together, and where each group starts in it."""
    order = np.argsort(values)
    ordered = values[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(values)])


def _by_chunk(hashes: np.ndarray, chunks: np.ndarray) -> tuple[list[int], list[bytes]]:
    if not len(chunks):
        return [], []
    order = np.argsort(chunks, kind="stable")
    hashes, chunks = hashes[order], chunks[order]
    first = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])[: len(chunks)])
    ends = np.append(first[1:], len(chunks))
    return chunks[first].tolist(), [hashes[a:b].tobytes() for a, b in zip(first, ends, strict=True)]


def send(values: np.ndarray, chunks: np.ndarray, buckets: int) -> pa.RecordBatch:
    """What one task tells: rows for buckets, and rows for chunks in the buckets -1 - chunk."""
    order, first = _groups(values)
    size = np.diff(np.append(first, len(values)))
    hashes, home, twice = values[order[first]], chunks[order[first]].astype(np.int32), size > 1
    # Buckets are ranges of the hash, so each is one stretch of the sorted ones.
    edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)
    at = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
    used = np.flatnonzero(np.diff(at))
    parts = [(at[b], at[b + 1]) for b in used]

    group = np.repeat(np.arange(len(first)), size)
    place = chunks[order].astype(np.int32)
    other = np.flatnonzero(twice[group] & (place != home[group]))
    direct, packed = [], []
    if len(other):
        pairs = np.unique(np.stack([place[other].astype(np.int64), group[other]], 1), axis=0)
        direct, packed = _by_chunk(hashes[pairs[:, 1]], pairs[:, 0])
    nothing = [None] * len(direct)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*used.tolist(), *(-1 - c for c in direct)], pa.int32()),
            pa.array([*(hashes[a:b].tobytes() for a, b in parts), *packed], pa.binary()),
            pa.array([*(home[a:b].tobytes() for a, b in parts), *nothing], pa.binary()),
            pa.array([*(np.packbits(twice[a:b]).tobytes() for a, b in parts), *nothing], pa.binary()),
        ],
        ["bucket", "hashes", "chunks", "twice"],
    )


def found_twice(sent: DataFrame) -> DataFrame:
    """For each chunk, its hashes that occur twice in all, in one or several rows.

    A bucket is read in one task; the number of buckets bounds its size.
    """

    def compare(key, bucket):
        raw = bucket["hashes"].to_pylist()
        if key[0].as_py() < 0:
            return pa.table({"chunk": pa.array([-1 - key[0].as_py()], pa.int32()), "hashes": pa.array([b"".join(raw)], pa.binary())})
        values = unpack(raw)
        chunks = np.frombuffer(b"".join(bucket["chunks"].to_pylist()), np.int32)
        twice = np.concatenate(
            [
                np.unpackbits(np.frombuffer(bits, np.uint8), count=len(r) // 8)
                for bits, r in zip(bucket["twice"].to_pylist(), raw, strict=True)
            ]
        )
        order, first = _groups(values)
        size = np.diff(np.append(first, len(values)))
        repeated = np.repeat((size > 1) | (np.add.reduceat(twice[order], first, dtype=np.int64) > 0), size)
        told, packed = _by_chunk(values[order[repeated]], chunks[order[repeated]])
        return pa.table({"chunk": pa.array(told, pa.int32()), "hashes": pa.array(packed, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(compare, RECEIVED)
