"""Whitening against numpy's singular vectors and whole-number sums."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from playseq.llm.whitening import factorise, fit, solve_right, usable, whiten, whitened_components

SCHEMA = "vec_id bigint, embedding array<float>, row string, vector int, entry string, component string, whitened int"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, "r", 1, "e", "c", 2) for k, v in vectors], SCHEMA).repartition(3)


def remaining(vectors):
    whole = [(k, v) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    length = min(Counter(len(v) for _, v in whole).items(), key=lambda x: (-x[1], x[0]))[0]
    return [(k, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for k, v in whole if len(v) == length]


def check(spark, vectors, rank=None, components=8):
    kept = remaining(vectors)
    x = np.array([v for _, v in kept], object)
    n, sums = len(x), x.sum(0)
    centred = np.array(x * n - sums, float) / n
    # Of the rows themselves: a Gram matrix would lose half of the digits.
    _, singular, axes = np.linalg.svd(centred, full_matrices=False)
    values, axes = singular**2 / n, axes.T
    shown = min(components, rank or len(values))

    rows = whitened_components(table(spark, vectors), components=components).collect()
    assert len(rows) == n * shown
    by_component = defaultdict(list)
    for r in rows:
        by_component[r.component].append((r.row.vec_id, float(r.whitened)))
        assert r.n == n and r.identity_error <= 1e-8
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-8 * r.explained
    deviation = Counter((k, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for k, v in kept)
    assert Counter((r.row.vec_id, int(r.deviation)) for r in rows if r.component == 1) == deviation
    for number, found in by_component.items():
        want = centred @ axes[:, number - 1] / math.sqrt(values[number - 1])
        ids = [k for k, _ in kept]
        order = sorted(range(n), key=lambda k: (ids[k] is None, ids[k] or 0, want[k]))
        got = np.array([w for _, w in sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1]))])
        flipped = np.array([-w for _, w in sorted(found, key=lambda x: (x[0] is None, x[0] or 0, -x[1]))])
        expected = want[order]
        assert min(np.abs(got - expected).max(), np.abs(flipped - expected).max()) < 1e-7


def vectors_of(rng, n, d, scale=1.0):
    spread = [scale * (1 + k) for k in range(d)]
    return [(k, [rng.gauss(0.3, s) for s in spread]) for k in range(n)]


def test_whitening_equals_singular_vectors(spark):
    rng = random.Random(1)
    vectors = vectors_of(rng, 300, 12)
    bad = [(900, None), (901, [float("nan")] + [0.0] * 11), (902, [float("inf")] * 12), (903, [None] + [1.0] * 11), (904, []), (905, [1.0])]
    check(spark, vectors + bad + [vectors[3], vectors[3], (None, vectors[9][1])])


def test_constant_and_repeated_dimensions(spark):
    rng = random.Random(2)
    vectors = [(k, [*v, 2.5, v[0], v[1]]) for k, v in vectors_of(rng, 200, 5)]
    check(spark, vectors, rank=5)


def test_fewer_rows_than_dimensions(spark):
    check(spark, vectors_of(random.Random(3), 5, 9), rank=4)


def test_nearly_dependent_dimensions(spark):
    rng = random.Random(4)
    vectors = [(k, [v[0] * 1000, v[0] * 1000 + rng.gauss(0, 0.01), *v[1:]]) for k, v in vectors_of(rng, 400, 4)]
    check(spark, vectors, components=5)


def test_large_entries_keep_exact_deviations(spark):
    vectors = [(k, [c * 2.0**20 for c in v]) for k, v in vectors_of(random.Random(5), 100, 6)]
    check(spark, vectors, components=3)


def test_nothing_to_whiten(spark):
    assert whitened_components(table(spark, [])).collect() == []
    same = table(spark, [(k, [1.0, 2.0]) for k in range(4)])
    assert fit(same) is None
    assert whitened_components(same).collect() == []
    assert [(r.whitened, int(r.deviation)) for r in whiten(same, None).collect()] == [([], 0)] * 4
    assert table(spark, [(1, None), (2, [None])]).filter(usable("embedding")).count() == 0


@pytest.mark.parametrize("d", [1, 2, 7])
def test_factor_and_solve(d):
    rng = np.random.default_rng(d)
    rows = rng.normal(size=(40, d))
    kept, factor = factorise(rows.T @ rows, 0.0, 0.0)
    assert kept.tolist() == list(range(d))
    assert np.allclose(factor.T @ factor, rows.T @ rows)
    q = solve_right(rows, factor)
    assert np.allclose(q.T @ q, np.eye(d))
