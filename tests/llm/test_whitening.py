import math
from fractions import Fraction

import numpy as np
import pytest

from sluice.llm import queries, whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], 0) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def integers(vector):
    return [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in vector]


def brute(vectors):
    """n, sums, eigenvalues (falling) and eigenvectors (columns) of the covariance, from exact moments."""
    fitted = sorted({tuple(integers(v)) for v in vectors})
    n, d = len(fitted), len(fitted[0])
    sums = [sum(v[i] for v in fitted) for i in range(d)]
    exact = [
        [sum(n * v[i] * v[j] for v in fitted) - sums[i] * sums[j] for j in range(d)] for i in range(d)
    ]
    values, components = np.linalg.eigh(np.array([[float(Fraction(e, n * n)) for e in r] for r in exact]))
    return n, sums, values[::-1], components[:, ::-1], exact


def check(rows, vectors, ids, most=16):
    n, sums, values, components, _ = brute([v for v in vectors])
    size = sum(v > 1e-9 * values[0] for v in values[:most])
    assert len(rows) == len(vectors) * size
    signs = {}
    for row in rows:
        x = integers(vectors[ids.index(row["vec_id"])])
        k = row["component"] - 1
        assert row["n"] == n
        assert row["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert row["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert row["identity_error"] < 1e-9
        want = float((np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ components[:, k]) / np.sqrt(values[k]))
        if abs(want) > 1e-6:
            signs.setdefault(k, set()).add(np.sign(want) * np.sign(row["whitened"]))
        assert abs(row["whitened"]) == pytest.approx(abs(want), abs=1e-7)
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("d", [1, 2, 7, 24])
def test_equals_brute_force(spark, d):
    draw = np.random.default_rng(d)
    vectors = (draw.normal(size=(90, d)) @ draw.normal(size=(d, d))).astype(np.float32).tolist()
    vectors += [vectors[3]] * 40
    ids = list(range(len(vectors)))
    check(w.whitening_report(table(spark, vectors)).collect(), vectors, ids)


def test_dropped_rows_and_clashing_columns(spark):
    draw = np.random.default_rng(5)
    good = draw.normal(size=(30, 3)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0, 0], [1.0, 2.0], [1e30, 0, 0], [-float("inf")] * 3]
    docs = table(spark, good + odd, [*range(30), *range(100, 100 + len(odd))]).selectExpr("*", "1 AS n", "2 AS component", "3 AS key")
    rows = w.whitening_report(docs).collect()
    assert {r["vec_id"] for r in rows} == set(range(30))
    check(rows, good, list(range(30)))


def test_equal_eigenvalues_and_directions_without_variance(spark):
    square = [[a, b, 5.0, a] for a in (-1.0, 1.0) for b in (-1.0, 1.0)]  # one doubled direction, one constant
    rows = w.whitening_report(table(spark, square)).collect()
    assert {r["component"] for r in rows} == {1, 2}
    cube = [[a, b, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    rows = w.whitening_report(table(spark, cube)).collect()
    found = np.zeros((8, 3))
    for r in rows:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(1 / 3) and r["identity_error"] < 1e-12
    assert np.abs(found.T @ found / 8 - np.eye(3)).max() < 1e-12


def test_without_variance_and_without_rows(spark):
    assert w.whitening_report(table(spark, [[1.0, 2.0]] * 5)).collect() == []
    assert w.whitening_report(table(spark, [[1.0, 2.0]]).limit(0)).collect() == []
    assert w.whitening_report(table(spark, [None, []])).collect() == []


def test_null_and_repeated_ids(spark):
    rows = w.whitening_report(table(spark, [[0.0, 1.0], [1.0, 0.0], [3.0, 2.0]], [None, 7, 7])).collect()
    assert sorted((r["vec_id"] is None, r["component"]) for r in rows) == sorted([(True, 1), (True, 2)] + [(False, 1), (False, 2)] * 2)


def test_large_entries_keep_exact_sums(spark):
    """Beyond doubles' integers, in the products and in the deviations."""
    vectors = [[float(2**36), 1.0], [float(-(2**35)), 2.0], [0.5, 77.0]]
    rows = w.whitening_report(table(spark, vectors)).collect()
    n, sums, values, _, exact = brute(vectors)
    for r in rows:
        x = integers(vectors[r["vec_id"]])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert r["deviation"] == (deviation if deviation < 2**63 else None)
    poly = [exact[0][0] * exact[1][1] - exact[0][1] ** 2, -(exact[0][0] + exact[1][1]), 1]
    assert w.characteristic_polynomial(spark, exact) == poly


def test_polynomial_against_exact_arithmetic(spark):
    """Faddeev and LeVerrier's recurrence in fractions."""
    draw = np.random.default_rng(2)
    for d in (3, 6, 9):
        x = draw.integers(-40, 40, (d - 1, d)).astype(object)
        m = x.T @ x
        want, work = [Fraction(1)], np.zeros((d, d), object)
        for k in range(1, d + 1):
            work = m @ work + np.eye(d, dtype=int).astype(object) * want[-1]
            want.append(-Fraction(int((m @ work).trace()), k) if not isinstance((m @ work).trace(), Fraction) else -(m @ work).trace() / k)
        assert w.characteristic_polynomial(spark, m.tolist()) == [int(c) for c in reversed(want)]


def test_roots_by_rank():
    poly = np.array([1], object)
    for r in (9, 4, 4, 4, 1, 0):
        poly = np.convolve(poly, np.array([1, -r], object))
    poly = [int(c) for c in reversed(poly)]
    for rank, want in enumerate((9, 4, 4, 4, 1), 1):
        low, shift, _ = w.root(poly, rank)
        assert low < want * Fraction(2) ** shift <= low + 1 and low.bit_length() >= w.BITS
    assert w.root(poly, 6) is None
    near = [int(c) for c in reversed(np.convolve(np.convolve([1, -(10**15)], np.array([1, -(10**15) - 1], object)), [1, -3]))]
    assert [w.roots_beyond(near, p) for p in (2, 3, 10**15 - 1, 10**15, 10**15 + 1)] == [3, 2, 2, 1, 0]
    assert w.root(near, 1)[:2] != w.root(near, 2)[:2]


def test_the_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = queries.op11_whitening(spark, folder).collect()
    check(rows, [r["embedding"] for r in given], [r["vec_id"] for r in given])
