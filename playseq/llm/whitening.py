"""Whitening of embeddings by shifted Cholesky QR.

The centred vectors are the rows of a tall matrix A. Every pass over the table takes the rows
through triangular solves with the factors found so far and adds up their Gram matrix; its
Cholesky factor is the next one. The first factor is of a shifted Gram matrix, so that it exists
however close to dependent the dimensions are. The product R of the factors has the singular
values and right singular vectors of A, which are the whitening components.

Only Gram matrices leave the tasks: they are added up by entry, combined before the shuffle, and
the driver gets `d * (d + 1) / 2` numbers a pass for vectors of `d` dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Rows whose products are summed by one matrix product.
BLOCK_ROWS = 1024
#: Longest vectors: a Gram matrix then has 8 million entries of 8 bytes.
MOST_DIMENSIONS = 4096
#: A dimension with a smaller share of its length left, after the first pass, depends on those before it.
DEPENDENT = 1e-10
#: So does one with less left than this many roundings, for each dimension, of the longest one's length.
ROUNDINGS = 100
#: A pass is the last if no entry of its Gram matrix is further from the identity's: its factor mends the rest.
ORTHONORMAL = 1e-9
MOST_PASSES = 8
_EPS = np.finfo(np.float64).eps / 2


@dataclass(frozen=True)
class Whitening:
    """The fitted model: exact sums of the fit list, components by column and their eigenvalues."""

    rows: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def usable(vector: str) -> Column:
    """True for a vector without null, infinite or undefined entries."""
    return F.coalesce(
        F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)
    )


def integers(batch: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows of x = floor(scale * c) + offset."""
    if isinstance(batch, pa.ChunkedArray):
        batch = batch.combine_chunks()
    values = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(values * SCALE)
    if np.abs(scaled).max(initial=0.0) >= 2.0**62:
        raise OverflowError("an entry is too large for a 64-bit integer")
    return (scaled.astype(np.int64) + OFFSET).reshape(len(batch), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, with one rounding: the whole part is taken off in integers."""
    return (x - sums // n) - (sums % n) / n


def solve_right(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, by substitution column by column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def through(rows: np.ndarray, factors: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows after each factor's triangular solve; a factor names the columns it keeps."""
    for kept, factor in factors:
        rows = solve_right(rows[:, kept], factor[:, kept])
    return rows


def factorise(gram: np.ndarray, shift: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Upper factor of a shifted Gram matrix, without the rows of dependent columns; the columns kept."""
    d = len(gram)
    left = gram + shift * np.eye(d)
    length = np.diag(left).copy()
    least = ROUNDINGS * d * _EPS * length.max(initial=0.0) if tolerance else 0.0
    kept, rows = [], []
    for j in range(d):
        if left[j, j] > max(tolerance * length[j], least):
            row = left[j] / math.sqrt(left[j, j])
            row[kept] = 0.0
            left = left - np.outer(row, row)
            kept.append(j)
            rows.append(row)
    return np.array(kept, np.int64), np.array(rows).reshape(len(kept), d)


def _blocks(batch: pa.Array):
    for at in range(0, len(batch), BLOCK_ROWS):
        yield integers(batch.slice(at, BLOCK_ROWS))


def _added(vectors: DataFrame, per_block, width: int) -> np.ndarray:
    """The sum over all blocks of an array of `width` numbers, added up by entry on the executors."""

    def partial(batches):
        total = np.zeros(width)
        for batch in batches:
            for x in _blocks(batch.column(0)):
                total += per_block(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["entry", "value"])

    found = vectors.mapInArrow(partial, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    out = np.zeros(width)
    for row in found.collect():
        out[row.entry] = row.value
    return out


def exact_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors have the commonest length (the smaller of two as common), and their integer sums."""

    def partial(batches):
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(0)
            lengths = np.diff(lists.offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                same = lists if (lengths == d).all() else lists.filter(pa.array(lengths == d))
                counts[d] = counts.get(d, 0) + len(same)
                for x in _blocks(same) if d else ():
                    sums[d] = sums.get(d, 0) + x.sum(0)
        for d, total in sums.items():
            values = [pa.array(np.full(d + 1, d)), pa.array(np.arange(-1, d)), pa.array(np.append(counts[d], total))]
            yield pa.RecordBatch.from_arrays(values, ["d", "entry", "value"])

    added = vectors.mapInArrow(partial, "d long, entry long, value long").groupBy("d", "entry").agg(F.sum("value").alias("value"))
    by_length = added.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("entry", "value"))).alias("sums"))
    found = by_length.orderBy(F.desc(F.col("sums")[-1]), "d").limit(1).collect()
    if not found:
        return 0, np.zeros(0, np.int64)
    return found[0].sums[-1], np.array([found[0].sums[j] for j in range(found[0].d)], np.int64)


def _symmetric(upper: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return out + np.triu(out, 1).T


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on every usable vector of the commonest length; None if they don't vary at all.

    Takes a pass for lengths and sums and one for each Gram matrix, of which three are usual.
    Dimensions that depend on others, but for rounding (constant or repeated ones, or all beyond the
    number of vectors), get no row in the factor; there are as many components as the rank at most.
    """
    usable_ones = vectors.select(F.col(f"`{vector}`").alias("vector")).filter(usable("vector"))
    n, sums = exact_sums(usable_ones)
    d = len(sums)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions; at most {MOST_DIMENSIONS} can be whitened")
    if not n:
        return None
    chosen = usable_ones.filter(F.size("vector") == d)
    factors: list[tuple[np.ndarray, np.ndarray]] = []
    whole = np.eye(d)
    trace = 0.0
    for step in range(MOST_PASSES):
        width = len(whole)

        def gram_of(x: np.ndarray, factors=tuple(factors), width=width) -> np.ndarray:
            rows = through(centred(x, n, sums), factors)
            return (rows.T @ rows)[np.triu_indices(width)]

        gram = _symmetric(_added(chosen, gram_of, width * (width + 1) // 2), width)
        shift = 0.0
        if step == 0:
            trace = float(np.trace(gram)) / n
            if trace == 0.0:
                return None
            shift = 11 * (n * d + d * (d + 1)) * _EPS * float(np.linalg.norm(gram, 2))
        kept, factor = factorise(gram, shift, DEPENDENT if step == 1 else 0.0)
        factors.append((kept, factor))
        whole = factor @ whole
        # From here a further pass would only change what rounding has left.
        if step > 0 and np.abs(gram - np.eye(width)).max() <= ORTHONORMAL:
            break
    _, singular, right = np.linalg.svd(whole, full_matrices=False)
    shown = min(components, int(np.count_nonzero(singular > 0)))
    return Whitening(n, tuple(sums.tolist()), np.ascontiguousarray(right[:shown].T), singular[:shown] ** 2 / n, trace)


def whiten(
    vectors: DataFrame,
    model: Whitening | None,
    *,
    vector: str = "embedding",
    carry: Sequence[str] = ("vec_id",),
) -> DataFrame:
    """Each usable vector projected on the components, over the root of their eigenvalues.

    Returns `row` (a struct of the `carry` columns, whatever their names), deviation (the sum over
    dimensions of (n * x - S) squared, exact, a decimal without fraction) and whitened (an array with
    a number for each component). Rows whose vector is null, holds a null, infinite or undefined
    entry or hasn't the model's dimension are left out. Without a model, that is if all vectors are
    equal or there are none, there are no components, and each usable vector has an empty array
    and a deviation of 0. Repeated rows are rows of their own.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    chosen = vectors.select(row, F.col(f"`{vector}`").alias("vector")).filter(usable("vector"))
    kind = chosen.schema["row"].dataType.simpleString()
    schema = f"row {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return chosen.select("row", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    chosen = chosen.filter(F.size("vector") == len(model.sums))
    n, sums = model.rows, np.array(model.sums, np.int64)
    projection = model.components / np.sqrt(model.eigenvalues)
    width = projection.shape[1]

    def project(batches):
        for batch in batches:
            x = integers(batch.column("vector"))
            found = centred(x, n, sums) @ projection
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(deviations(x, n, sums), pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(np.arange(0, found.size + 1, width, dtype=np.int32), pa.array(found.ravel())),
                ],
                ["row", "deviation", "whitened"],
            )

    return chosen.mapInArrow(project, schema)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The exact sums of squares, in 64-bit integers where they fit."""
    furthest = n * int(np.abs(x - sums // n).max(initial=0) + 1)
    if furthest * furthest * x.shape[1] < 1 << 62:
        away = n * (x - sums // n) - sums % n
        return (away * away).sum(1).tolist()
    away = n * x.astype(object) - sums.astype(object)
    return (away * away).sum(1).tolist()


def identity_error(whitened: DataFrame, rows: int, width: int) -> float:
    """The largest absolute entry of the whitened values' covariance minus the identity, from one pass."""
    if not width:
        return 0.0

    def partial(batches):
        total = np.zeros(width + width * width)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += np.concatenate([values.sum(0), (values.T @ values).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["entry", "value"])

    found = whitened.select("whitened").mapInArrow(partial, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    total = np.zeros(width + width * width)
    for row in found.collect():
        total[row.entry] = row.value
    mean, products = total[:width] / rows, total[width:].reshape(width, width) / rows
    return float(np.abs(products - np.outer(mean, mean) - np.eye(width)).max())


def whitened_components(vectors: DataFrame, *, vector: str = "embedding", carry: Sequence[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: row, component (from 1), n, deviation, whitened, explained, identity_error.

    An empty table, or vectors that are all equal, have no components and so no rows.
    """
    model = fit(vectors, vector, components)
    found = whiten(vectors, model, vector=vector, carry=carry)
    shares = [] if model is None else model.explained.tolist()
    error = 0.0 if model is None else identity_error(found, model.rows, len(shares))
    return found.select("row", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "row",
        (F.col("place") + 1).alias("component"),
        F.lit(0 if model is None else model.rows).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*(F.lit(s) for s in shares)).cast("array<double>"), F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
