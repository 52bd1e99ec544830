"""Whitening of embeddings through the exact characteristic polynomial of their integer scatter.

Every component c becomes x = floor(1024 * c) + 100000. With n vectors and sums S the scatter M = n * sum(x x') - S S' is an integer matrix, n ** 2
times the covariance; it is summed exactly, each task folding its batches into one triangle of partial sums. The characteristic polynomial of M is
computed modulo primes of 31 bits, each by reduction to Hessenberg form and its recurrence; Spark deals the primes to tasks. As M has no
negative eigenvalue, the coefficient of degree d - k is at most C(d, k) * (trace / d) ** k in size, which tells how many primes Chinese remaindering needs.
All roots are real, so by Descartes' rule the sign changes of p(z + a) are the number of roots above a, multiplicities included: bisection with exact
Taylor shifts isolates the leading roots, signs of p alone refine them to PRECISION bits. A component is the null vector of M - root * I by
inverse iteration on a triangular factorisation in DIGITS decimal digits; of a multiple root the vectors are made orthogonal.

Whitened values are ((n * x - S) / n) . component / sqrt(eigenvalue), from exact integers. Means and covariances of the whitened values are two
aggregates over the written rows, centred before multiplying.

What passes the driver is d ** 2 sums, d + 1 residues a prime and the components: bounded by the dimension, whatever the number of vectors.

Defined results: rows whose vector is null or empty, or holds null or non-finite entries, are dropped, and so are vectors of another length than the commonest one
(the longest of equally common lengths). Entries count up to 2 ** 40 in size after scaling, larger ones as that. Roots that are zero (fewer
vectors than dimensions, constant columns) have no whitened value, so fewer than ``top`` components may come out, none at all where all vectors
are equal. deviation is null where it does not fit a long. Repeated rows and null ids are vectors like others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import parts, query, table
from formline.session import stored

SCALE, SHIFT, LARGEST = 1024, 100000, 1 << 40
PRECISION, DIGITS = 160, 90
EXACT, LIMB = 1 << 53, 32


# --- exact sums -------------------------------------------------------------------------------

def scaled(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, y (x without its constant, array<long>) of the rows that take part, and their dimension."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("vec_id", v.alias("v")).filter(F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    dims = rows.groupBy(F.size("v").alias("d")).count()
    common = dims.agg(F.max_by("d", F.struct("count", "d")).alias("d")).first().d or 0
    bound = float(LARGEST)
    return rows.filter(F.size("v") == common).select("vec_id", F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))).cast("long")).alias("y")), common


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers, by floating products of blocks and limbs whose sums are exact."""
    top = int(np.abs(y).max(initial=0))
    bits = max(top.bit_length(), 1)
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    width = 20
    limbs = [((y >> at) if at + width >= bits else (y >> at) & ((1 << width) - 1)).astype(np.float64) for at in range(0, bits, width)]  # the last one has the sign
    rows = max(1, EXACT >> (2 * width + 1))
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            for at in range(0, len(y), rows):
                part = (a[at:at + rows].T @ b[at:at + rows]).astype(np.int64)
                total += part.astype(object) << (width * (i + j))
    return total


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and scatter (integers) of ``rows`` (y of d components)."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, square = 0, None, None
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column("y"))
                p, s = products(y), y.astype(object).sum(axis=0) if np.abs(y).max() >= (1 << 62) // len(y) else y.sum(axis=0).astype(object)
                n, sums, square = n + len(y), s if sums is None else sums + s, p if square is None else square + p
        if n:
            i, j = np.triu_indices(d)
            at = np.concatenate([[-1], np.arange(d), d + np.arange(len(i))])
            value = [n, *sums.tolist(), *square[i, j].tolist()]
            # limbs of 32 bits: their sums over all tasks fit a long
            limbs = [(a, k, v >> (LIMB * k) if k == 3 else (v >> (LIMB * k)) & ((1 << LIMB) - 1)) for a, v in zip(at.tolist(), value) for k in range(4)]
            a, k, v = zip(*[x for x in limbs if x[2]] or [(-1, 0, 0)])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.int64())], names=["at", "limb", "v"])

    found: dict[int, int] = {}
    for r in rows.select("y").mapInArrow(fold, "at int, limb int, v long").groupBy("at", "limb").agg(F.sum("v").alias("v")).collect():
        found[r.at] = found.get(r.at, 0) + (r.v << (LIMB * r.limb))
    n, sums = found.get(-1, 0), [found.get(i, 0) for i in range(d)]
    m = np.zeros((d, d), dtype=object)
    for k, (i, j) in enumerate(zip(*np.triu_indices(d))):
        m[i, j] = m[j, i] = n * found.get(d + k, 0) - sums[i] * sums[j]
    return n, sums, m


# --- characteristic polynomial ----------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Exact below 3.4e14 (these bases suffice there)."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    s = (n - 1 & 1 - n).bit_length() - 1
    return all(pow(a, n - 1 >> s, n) == 1 or any(pow(a, n - 1 >> k, n) == n - 1 for k in range(1, s + 1)) for a in (2, 3, 5, 7, 11, 13, 17))


def primes(count: int) -> list[int]:
    """The largest ones below 2 ** 31."""
    found, n = [], (1 << 31) - 1
    while len(found) < count:
        if is_prime(n):
            found.append(n)
        n -= 2
    return found


def residues(m: np.ndarray, modulus: np.ndarray) -> np.ndarray:
    """Coefficients (highest degree first) of det(z - m) for each prime, by (prime, coefficient)."""
    d, q = len(m), modulus[:, None]
    every = np.arange(len(modulus))
    h = np.array([(m % int(p)).astype(np.int64) for p in modulus])
    inverse = lambda x: np.array([pow(int(v), -1, int(p)) if v else 0 for v, p in zip(x, modulus)], dtype=np.int64)
    for k in range(d - 2):
        below = h[:, k + 1:, k] != 0
        pivot = k + 1 + below.argmax(axis=1)  # without a pivot the column is reduced already
        rows = h[every, pivot].copy()
        h[every, pivot], h[:, k + 1] = h[:, k + 1].copy(), rows
        cols = h[every, :, pivot].copy()
        h[every, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), cols
        u = h[:, k + 2:, k] * inverse(h[:, k + 1, k])[:, None] % q
        h[:, k + 2:] = (h[:, k + 2:] - u[:, :, None] * h[:, None, k + 1] % q[:, :, None]) % q[:, :, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * u[:, None, :] % q[:, :, None]).sum(axis=2)) % q
    p = np.zeros((d + 1, len(modulus), d + 1), dtype=np.int64)  # lowest degree first
    p[0, :, 0] = 1
    for k in range(1, d + 1):
        p[k, :, 1:] = p[k - 1, :, :-1]
        p[k] = (p[k] - h[:, k - 1, k - 1, None] * p[k - 1]) % q
        under = np.ones(len(modulus), dtype=np.int64)
        for i in range(k - 1, 0, -1):
            under = under * h[:, i, i - 1] % modulus
            p[k] = (p[k] - (h[:, i - 1, k - 1] * under % modulus)[:, None] * p[i - 1]) % q
    return p[d, :, ::-1]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients, highest degree first, of det(z - m) for a symmetric integer matrix without negative eigenvalues."""
    d, trace = len(m), int(sum(m[i, i] for i in range(len(m))))
    bound = max([1, *[math.comb(d, k) * -(-trace ** k // d ** k) for k in range(1, d + 1)]])
    chosen = primes((2 * bound).bit_length() // 30 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("p").to_numpy()
            for at in range(0, len(mine), 16):
                some = mine[at:at + 16]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(residues(m, some).tolist(), pa.list_(pa.int64()))], names=["p", "r"])

    dealt = spark.range(len(chosen), numPartitions=min(parts(spark), len(chosen))).select(F.element_at(F.lit(chosen), (F.col("id") + 1).cast("int")).cast("long").alias("p"))
    by = {r.p: r.r for r in dealt.mapInArrow(run, "p long, r array<long>").collect()}
    whole, values = 1, [0] * (d + 1)
    for p in chosen:
        back = pow(whole, -1, p)
        values = [v + whole * ((r - v) * back % p) for v, r in zip(values, by[p])]
        whole *= p
    return [v - whole if 2 * v > whole else v for v in values]


# --- roots ------------------------------------------------------------------------------------

def sign_at(p: list[int], a: int, s: int) -> int:
    """Sign of p(a / 2 ** s)."""
    value, scale = 0, 0
    for c in p:
        value = value * a + (c << scale)
        scale += s
    return (value > 0) - (value < 0)


def roots_above(p: list[int], a: int, s: int) -> int:
    """How many roots of the real-rooted ``p`` are above a / 2 ** s: sign changes of the Taylor shift."""
    q = [c << (s * k) for k, c in enumerate(p)]
    for stop in range(len(q) - 1, 0, -1):
        for i in range(1, stop + 1):
            q[i] += a * q[i - 1]
    signs = [c > 0 for c in q if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def leading_roots(p: list[int], top: int) -> list[tuple[int, int, int]]:
    """(low, high, s): the largest positive roots, falling, each repeated by multiplicity, in (low, high] / 2 ** s."""
    d = len(p) - 1
    first = next((k for k in range(d, -1, -1) if p[k]), 0)  # trailing zeros are zero roots
    if not first:
        return []
    high = max(1, -p[1])  # the trace bounds every root
    s = max(0, PRECISION - high.bit_length()) + 8
    high <<= s
    found: list[tuple[int, int, int]] = []
    open_ = [(0, high, min(roots_above(p, 0, s), first), 0)]  # low, high, roots above low, roots above high
    while open_ and len(found) < top:
        low, high, many, fewer = open_.pop()
        if many == fewer:
            continue
        inside = many - fewer
        if inside == 1:
            at_low = sign_at(p, low, s) if low else (-1) ** (fewer + 1)
            while high - low > max(1, high >> PRECISION):
                mid = (low + high) // 2
                sign = sign_at(p, mid, s)
                if sign == 0:
                    low, high = mid - 1, mid
                elif sign == at_low:
                    low = mid
                else:
                    high = mid
            found.append((low, high, s))
        elif high - low <= max(1, high >> PRECISION):
            found += [(low, high, s)] * inside
        else:
            mid = (low + high) // 2
            middle = roots_above(p, mid, s)
            open_ += [(low, mid, many, middle), (mid, high, middle, fewer)]
    return found[:top]


# --- components -------------------------------------------------------------------------------

def null_vectors(m: np.ndarray, root: Decimal, many: int) -> list[np.ndarray]:
    """``many`` orthogonal unit vectors of the null space of m - root, by inverse iteration."""
    d = len(m)
    a = np.array([[Decimal(int(v)) for v in row] for row in m], dtype=object)
    for i in range(d):
        a[i, i] -= root
    tiny = max(abs(v) for v in a.ravel()) * Decimal(10) ** (8 - DIGITS) + Decimal(10) ** -DIGITS
    order = np.arange(d)
    for k in range(d):
        best = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        if k + 1 < d:
            a[k + 1:, k] = a[k + 1:, k] / a[k, k]
            a[k + 1:, k + 1:] -= np.multiply.outer(a[k + 1:, k], a[k, k + 1:])

    def solve(b: np.ndarray) -> np.ndarray:
        z = b[order]
        for k in range(d):
            z[k + 1:] -= a[k + 1:, k] * z[k]
        for k in range(d - 1, -1, -1):
            z[k] /= a[k, k]
            z[:k] -= a[:k, k] * z[k]
        return z

    found: list[np.ndarray] = []
    rng = np.random.default_rng(d)
    for _ in range(many):
        z = np.array([Decimal(float(v)) for v in rng.normal(size=d)], dtype=object)
        for _ in range(4):
            z = solve(z)
            for _ in range(2):
                for f in found:
                    z = z - f * (f @ z)
            z = z / (z @ z).sqrt()
        found.append(z)
    return found


def spectrum(spark: SparkSession, m: np.ndarray, top: int) -> tuple[np.ndarray, list[Decimal]]:
    """Leading components (by column) of the integer matrix and their positive eigenvalues, falling."""
    roots = leading_roots(characteristic(spark, m), top) if len(m) else []
    with localcontext(Context(prec=DIGITS)):
        values = [Decimal(low + high) / 2 / Decimal(1 << s) for low, high, s in roots]
        vectors: list[np.ndarray] = []
        for r in dict.fromkeys(values):
            vectors += null_vectors(m, r, values.count(r))
        signed = [v * (1 if v[int(np.argmax(np.abs(v)))] > 0 else -1) for v in vectors]
        return np.array([[float(x) for x in v] for v in signed]).reshape(len(values), len(m)).T, values


# --- whitened rows ----------------------------------------------------------------------------

def whitened_rows(rows: DataFrame, n: int, sums: list[int], basis: np.ndarray, scale: np.ndarray) -> DataFrame:
    """vec_id, deviation, w (a value a component)."""
    total = np.array(sums, dtype=object)
    largest = max([abs(s) for s in sums], default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(batch.column("y"))
            small = n * int(np.abs(y).max(initial=0)) + largest < 1 << 62
            centred = y * n - total.astype(np.int64) if small else y.astype(object) * n - total
            about = (centred.astype(np.float64) ** 2).sum(axis=1)
            fits = about.max(initial=0) < 9e18
            exact = (centred * centred).sum(axis=1) if small and fits else [int(sum(int(v) ** 2 for v in r)) for r in centred]
            deviation = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
            w = centred.astype(np.float64) / n @ basis * scale
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(w: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``w`` minus the identity."""
    if not k:
        return None
    col = lambda i: F.get("w", F.lit(i))
    mean = w.agg(*[F.avg(col(i)).alias(f"m{i}") for i in range(k)]).first()
    if mean[0] is None:
        return None
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = w.agg(*[F.avg((col(i) - F.lit(mean[i])) * (col(j) - F.lit(mean[j]))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def whitened(vectors: DataFrame, top: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row of ``vectors`` (vec_id, embedding) and component."""
    spark = vectors.sparkSession
    rows, d = scaled(vectors)
    n, sums, m = scatter(rows, d)
    basis, values = spectrum(spark, m, top)
    trace = sum(m[i, i] for i in range(d))
    with localcontext(Context(prec=DIGITS)):
        scale = np.array([float(Decimal(n) / v.sqrt()) for v in values])  # the covariance's eigenvalue is value / n ** 2
        explained = [float(v / Decimal(int(trace))) for v in values]
    w = stored(whitened_rows(rows, n, sums, basis, scale), "whitened") if values else whitened_rows(rows.limit(0), max(n, 1), sums, np.zeros((len(sums), 0)), scale)
    error = identity_error(w, len(values))
    told = w.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    shares = F.element_at(F.lit(explained or [0.0]).cast("array<double>"), F.col("at") + 1)
    return told.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       shares.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
