"""Whitening of embeddings from the exact characteristic polynomial of their scatter.

Vectors become integers (``floor(scale * c) + offset``), and each distinct integer vector counts
once. With n of them, sums S and products P, the scatter ``n * P - S * S'`` is an integer matrix,
n * n times the covariance. Its characteristic polynomial is found exactly: by Hessenberg
reduction modulo many primes, each prime a row of a Spark job, put together by Chinese
remaindering. All roots are real, so by Descartes' rule the sign changes of the polynomial moved
to a point count the roots beyond it: that isolates each of the largest roots, which is then
narrowed to ``BITS`` binary digits. Components are null vectors of the matrix less the root, by
inverse iteration in fixed-point integers, equal roots together.

Rows are read for their lengths, for the distinct integer vectors (packed, and combined before the
only shuffle that grows with the rows) and to be projected where they lie. Products are summed up
in tasks and combined by entry. What is collected or broadcast grows with the square of the
dimension, not with the rows.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those
with an entry whose integer is beyond ``LIMIT`` and those that do not have the most frequent
dimension (of equally frequent ones the largest). A direction without variance has no whitened
value, so there are as many components as positive eigenvalues, ``components`` at most: a table
with fewer than two distinct vectors gives an empty result. A deviation beyond 64 bits is null.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import pin

#: Integers beyond this would not be exact as doubles before they are rounded down.
LIMIT = 1 << 52
#: Binary digits of a root, and of the fixed-point numbers of the inverse iteration.
BITS = 110
_GUARD = 320
#: Sums travel in limbs of so many bits, so that plain long sums cannot overflow.
_LIMB, _LIMBS = 40, 5
_ROWS = 4096


@dataclass(frozen=True)
class Rules:
    components: int = 16
    scale: int = 64
    offset: int = 1_000_000


@dataclass(frozen=True)
class Whitening:
    """What was fitted: count and sums of the distinct integer vectors, unit components, eigenvalues of the covariance."""

    rules: Rules
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def integer_vectors(column: pa.Array, rules: Rules, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole vectors of the dimension, and their integers before the offset.

    Without a dimension, the lengths of whole vectors come in place of the integers; 0 for the others.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    entries = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    with np.errstate(invalid="ignore", over="ignore"):
        entries = np.floor(entries * rules.scale)
        bad = ~(np.abs(entries) < LIMIT)
    ends = np.cumsum(lengths)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    whole = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
    if dimension is None:
        return whole, np.where(whole, lengths, 0)
    whole &= lengths == dimension
    return whole, entries[np.repeat(whole, lengths)].astype(np.int64).reshape(-1, dimension)


def _dimension(rows: DataFrame, rules: Rules) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            for size, count in zip(*np.unique(integer_vectors(batch.column(0), rules)[1], return_counts=True)):
                counts[int(size)] = counts.get(int(size), 0) + int(count)
        counts.pop(0, None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["size", "rows"]
        )

    sizes = rows.select("vector").mapInArrow(run, "size long, rows long").groupBy("size").agg(F.sum("rows").alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("size")).head()
    return 0 if first is None else first["size"]


def _distinct(rows: DataFrame, rules: Rules, dimension: int) -> DataFrame:
    """Each integer vector once, packed: in two bytes an entry where that holds them, else in eight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integer_vectors(batch.column(0), rules, dimension)
            small = (np.abs(x) < 1 << 15).all(1)
            packed = [v.astype("<i2").tobytes() if s else v.astype("<i8").tobytes() for v, s in zip(x, small)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["x"])

    return rows.select("vector").mapInArrow(run, "x binary").distinct()


def unpack(column: pa.Array, dimension: int) -> np.ndarray:
    values = column.to_pylist()
    kinds = ["<i2" if len(v) == 2 * dimension else "<i8" for v in values]
    out = np.empty((len(values), dimension), np.int64)
    for kind in set(kinds):
        own = np.array([k == kind for k in kinds])
        out[own] = np.frombuffer(b"".join(v for v, k in zip(values, kinds) if k == kind), kind).reshape(-1, dimension)
    return out


def exact_products(x: np.ndarray) -> np.ndarray:
    """``x' x`` as Python integers; in floating point only where every sum is exact."""
    most = int(np.abs(x).max(initial=0))
    if most * most * max(1, len(x)) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _limbs(values: list[int]) -> list[list[int]]:
    """Signed integers as limbs of ``_LIMB`` bits, the last one with the sign."""
    out = []
    for _ in range(_LIMBS - 1):
        out.append([v & ((1 << _LIMB) - 1) for v in values])
        values = [v >> _LIMB for v in values]
    return [*out, values]


def _moments(distinct: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and products of the distinct vectors, without the offset: exact.

    The vector gets a leading 1, so that count and sums are products too.
    """
    upper = np.triu_indices(dimension + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension + 1, dimension + 1), object)
        for batch in batches:
            x = unpack(batch.column(0), dimension)
            for low in range(0, len(x), _ROWS):
                part = x[low : low + _ROWS]
                total += exact_products(np.hstack([np.ones((len(part), 1), np.int64), part]))
        if total[0, 0]:
            columns = _limbs(total[upper].tolist())
            places = pa.array(np.arange(len(upper[0])), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [places, *(pa.array(c, pa.int64()) for c in columns)], ["place", *(f"l{i}" for i in range(_LIMBS))]
            )

    names = [f"l{i}" for i in range(_LIMBS)]
    partial = distinct.mapInArrow(run, ", ".join(["place long", *(f"{c} long" for c in names)]))
    found = partial.groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).collect()
    whole = [[0] * (dimension + 1) for _ in range(dimension + 1)]
    for row in found:
        value = sum(row[c] << (_LIMB * i) for i, c in enumerate(names))
        i, j = int(upper[0][row["place"]]), int(upper[1][row["place"]])
        whole[i][j] = whole[j][i] = value
    return whole[0][0], whole[0][1:], [r[1:] for r in whole[1:]]


# --- characteristic polynomial -------------------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The largest primes below ``top``."""
    found, low = [], top
    while len(found) < count:
        high, low = low, low - 40 * (count - len(found)) - 1000
        sieve = np.ones(high - low, bool)
        for p in range(2, math.isqrt(high) + 1):
            sieve[(-low) % p :: p] = False
        found += (np.flatnonzero(sieve)[::-1] + low).tolist()
    return found[:count]


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of ``det(x - matrix)`` modulo a prime below 2^31, the constant first."""
    h, d = matrix.copy() % p, len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        inverse = pow(int(h[m, m - 1]), -1, p)
        u = h[m + 1 :, m - 1] * inverse % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        # Products stay below 2^62, but sums of them must be reduced one by one.
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for m in range(1, d + 1):
        poly[m, 1:] = poly[m - 1, :-1]
        poly[m] = (poly[m] - poly[m - 1] * h[m - 1, m - 1] % p) % p
        chain = 1
        for i in range(1, m):
            chain = chain * int(h[m - i, m - i - 1]) % p
            if not chain:
                break
            poly[m] = (poly[m] - poly[m - i - 1] * (int(h[m - i - 1, m - 1]) * chain % p) % p) % p
    return poly[d].tolist()


def coefficient_bits(d: int, trace: int) -> int:
    """Bits of the largest coefficient: roots are not negative, so Maclaurin bounds their symmetric sums."""
    return max(
        (math.comb(d, k) * trace**k // d**k + 1).bit_length() for k in range(d + 1)
    ) + 1


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of a matrix without negative eigenvalues, constant first; one row of a job per prime."""
    d = len(matrix)
    bits = coefficient_bits(d, sum(matrix[i][i] for i in range(d)))
    primes = primes_below(1 << 31, bits // 30 + 2)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(shared.value, object)
        for batch in batches:
            found = [polynomial_modulo((whole % p).astype(np.int64), p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["prime", "residues"]
            )

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    found = rows.mapInArrow(run, "prime long, residues array<long>").collect()
    return chinese_remainder([r["prime"] for r in found], [r["residues"] for r in found])


def chinese_remainder(primes: list[int], residues: list[list[int]]) -> list[int]:
    """The integers of least absolute value with the residues."""
    product = math.prod(primes)
    weights = [product // p * pow(product // p, -1, p) for p in primes]
    values = [sum(w * r for w, r in zip(weights, own)) % product for own in zip(*residues)]
    return [v - product if v > product // 2 else v for v in values]


# --- roots ---------------------------------------------------------------------------------


def _scaled(poly: list[int], shift: int) -> list[int]:
    """Coefficients of the polynomial whose roots are ``2^shift`` times as large, without fractions."""
    d = len(poly) - 1
    if shift >= 0:
        return [c << (shift * (d - i)) for i, c in enumerate(poly)]
    return [c << (-shift * i) for i, c in enumerate(poly)]


def roots_beyond(poly: list[int], point: int) -> int:
    """How many roots are larger than an integer: sign changes after moving there, as all are real."""
    moved = list(poly)
    for low in range(len(moved) - 1):
        for i in range(len(moved) - 2, low - 1, -1):
            moved[i] += point * moved[i + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def root(poly: list[int], rank: int, bits: int = BITS) -> tuple[int, int, int] | None:
    """The root of a rank (1 is the largest) as ``low < root * 2^shift <= low + 1``, low of ``bits`` bits.

    Also how many roots lie there. None if it is zero. The bracket is halved by counting until
    it holds one root only, from then on by signs.
    """
    if roots_beyond(poly, 0) < rank:
        return None
    # A root is at most the sum of all of them, the negated second coefficient.
    shift, low = -((-poly[-2]).bit_length() + 1), 0
    inside, above = None, None
    while low.bit_length() < bits:
        shift += 1
        here = _scaled(poly, shift)
        middle = 2 * low + 1
        if inside == 1:
            value = 0
            for c in reversed(here):
                value = value * middle + c
            # Beyond an even number of roots the polynomial has the sign of its first coefficient.
            beyond = rank - 1 + (1 if value and (value > 0) == ((rank - 1) % 2 == 1) else 0)
        else:
            beyond = roots_beyond(here, middle)
        if beyond >= rank:
            low = middle
        else:
            low, above = middle - 1, beyond
        if inside != 1 and above is not None:
            inside = roots_beyond(here, low) - above if beyond < rank else beyond - above
    return low, shift, inside or 1


# --- components ----------------------------------------------------------------------------


def null_vectors(matrix: list[list[int]], low: int, shift: int, count: int) -> np.ndarray:
    """``count`` orthonormal vectors of the eigenvalue ``(low + 1/2) / 2^shift``, by inverse iteration.

    Fixed-point numbers with ``_GUARD`` bits beyond the size of the matrix's entries; rows are
    exchanged for the largest pivot, and a pivot of zero is as good as the smallest one.
    """
    d = len(matrix)
    one = 1 << _GUARD
    value = ((2 * low + 1) << _GUARD) >> (shift + 1) if shift >= 0 else ((2 * low + 1) << (_GUARD - shift - 1))
    a = np.array([[v << _GUARD for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= value
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1
        for i in range(k + 1, d):
            if a[i, k]:
                factor = (a[i, k] << _GUARD) // a[k, k]
                a[i, k] = factor
                a[i, k + 1 :] -= (a[k, k + 1 :] * factor) >> _GUARD
    draw = np.random.default_rng(1)
    vectors = [[int(v) << (_GUARD - 30) for v in draw.integers(-(1 << 30), 1 << 30, d)] for _ in range(count)]
    for _ in range(3):
        done: list[np.ndarray] = []
        for v in vectors:
            y = np.array([v[i] for i in order], object)
            for i in range(1, d):
                y[i] -= int((a[i, :i] * y[:i]).sum()) >> _GUARD
            for i in range(d - 1, -1, -1):
                rest = y[i] - (int((a[i, i + 1 :] * y[i + 1 :]).sum()) >> _GUARD)
                y[i] = (rest << _GUARD) // a[i, i]
            y = _normal(y, one)
            for _ in range(2):
                for u in done:
                    y = y - ((u * (int((u * y).sum()) >> _GUARD)) >> _GUARD)
                y = _normal(y, one)
            done.append(y)
        vectors = [list(v) for v in done]
    return np.array([[v / one for v in vector] for vector in vectors])


def _normal(vector: np.ndarray, one: int) -> np.ndarray:
    """To length 1; first to entries with enough bits, so that the length has them too."""
    most = max(abs(int(v)) for v in vector) or 1
    vector = np.array([int(v) * one // most for v in vector], object)
    length = math.isqrt(sum(v * v for v in vector))
    return np.array([v * one // length for v in vector], object)


def principal_components(spark: SparkSession, matrix: list[list[int]], poly: list[int], most: int) -> list[tuple]:
    """``rank, eigenvalue, vector`` of the largest positive eigenvalues, the largest first.

    One row of a job per rank, then one per bracket: roots that the digits do not tell apart
    share an eigenspace, and any orthonormal vectors of it will do.
    """
    context = spark.sparkContext
    shared = context.broadcast((matrix, poly))

    def isolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, root(shared.value[1], k)) for k in batch.column(0).to_pylist()]
            rows = [(k, str(r[0]), r[1]) for k, r in found if r]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32()))],
                ["rank", "low", "shift"],
            )

    def iterate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, lows, shifts, counts = (c.to_pylist() for c in batch.columns)
            found = [
                null_vectors(shared.value[0], int(low), shift, count).tolist()
                for low, shift, count in zip(lows, shifts, counts)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranks, pa.int32()), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["rank", "vectors"]
            )

    ranks = spark.createDataFrame([(k,) for k in range(1, most + 1)], "rank int").repartition(most)
    brackets = ranks.mapInArrow(isolate, "rank int, low string, shift int").collect()
    groups: dict[tuple, list[int]] = {}
    for row in brackets:
        groups.setdefault((row["low"], row["shift"]), []).append(row["rank"])
    if not groups:
        return []
    rows = [(min(own), low, shift, len(own)) for (low, shift), own in groups.items()]
    spaces = spark.createDataFrame(rows, "rank int, low string, shift int, count int").repartition(len(rows))
    found = spaces.mapInArrow(iterate, "rank int, vectors array<array<double>>").collect()
    vectors = {row["rank"] + i: v for row in found for i, v in enumerate(row["vectors"])}
    values = {k: _ratio(2 * int(low) + 1, shift + 1) for (low, shift), own in groups.items() for k in own}
    return [(k, values[k], vectors[k]) for k in sorted(values)]


def _ratio(value: int, shift: int) -> tuple[int, int]:
    """``value / 2^shift`` as numerator and denominator."""
    return (value, 1 << shift) if shift >= 0 else (value << -shift, 1)


# --- fit and apply -------------------------------------------------------------------------


def _rows(frame: DataFrame, key: str, vector: str) -> DataFrame:
    return frame.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))


def fit(frame: DataFrame, vector: str = "embedding", rules: Rules = Rules()) -> Whitening | None:
    """None where no direction has variance."""
    spark = frame.sparkSession
    rows = _rows(frame, vector, vector)
    dimension = _dimension(rows, rules)
    if not dimension:
        return None
    distinct = pin(_distinct(rows, rules, dimension), "integer-vectors")
    n, sums, products = _moments(distinct, dimension)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dimension)] for i in range(dimension)]
    trace = sum(matrix[i][i] for i in range(dimension))
    if not trace:
        return None
    poly = characteristic_polynomial(spark, matrix)
    found = principal_components(spark, matrix, poly, min(rules.components, dimension))
    model = Whitening(
        rules,
        n,
        [s + n * rules.offset for s in sums],
        np.array([v for _, _, v in found]),
        np.array([a / (b * n * n) for _, (a, b), _ in found]),
        np.array([a / (b * trace) for _, (a, b), _ in found]),
    )
    return Whitening(*(getattr(model, f) for f in list(model.__dataclass_fields__)[:-1]), _identity_error(distinct, model))


def deviations(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """``n * x - S`` over n as doubles, and its exact squared length before the division."""
    sums = np.array([s - model.n * model.rules.offset for s in model.sums], object)
    most = model.n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    exact = (model.n * x - sums.astype(np.int64)) if most < 1 << 62 else model.n * x.astype(object) - sums
    if most * most * x.shape[1] < 1 << 63:
        squares = (exact * exact).sum(1).tolist()
    else:
        squares = [sum(int(v) * int(v) for v in row) for row in exact]
    centred = (exact / model.n).astype(np.float64)
    return centred, [s if s < 1 << 63 else None for s in squares]


def whitened(centred: np.ndarray, model: Whitening) -> np.ndarray:
    return centred @ model.components.T / np.sqrt(model.eigenvalues)


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, centred in two passes."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)
    size = len(model.eigenvalues)
    dimension = model.components.shape[1]

    def sums(weigh: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                centred, _ = deviations(unpack(batch.column(0), dimension), shared.value)
                total = total + weigh(whitened(centred, shared.value)).ravel()
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.float64())], ["place", "part"]
                )

        parts = distinct.mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("part"))
        return np.array([r["part"] for r in sorted(parts.collect())]) / model.n

    mean = sums(lambda z: z.sum(0))
    covariance = sums(lambda z: (z - mean).T @ (z - mean)).reshape(size, size)
    return float(np.abs(covariance - np.eye(size)).max())


SCHEMA = (
    "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def transform(frame: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per whole vector and component."""
    spark = frame.sparkSession
    rows = _rows(frame, key, vector)
    schema = SCHEMA.format(rows.schema["key"].dataType.simpleString())
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        size, dimension = own.components.shape
        for batch in batches:
            whole, x = integer_vectors(batch.column(1), own.rules, dimension)
            centred, squares = deviations(x, own)
            places = np.repeat(np.flatnonzero(whole), size)
            count = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(places)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * size, own.n), pa.int64()),
                    pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(count), size))),
                    pa.array(whitened(centred, own).ravel()),
                    pa.array(np.tile(own.explained, count)),
                    pa.array(np.full(count * size, own.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def whitening_report(vectors: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return transform(vectors, fit(vectors, "embedding", rules), "vec_id", "embedding")
