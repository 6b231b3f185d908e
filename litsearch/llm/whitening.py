"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

Every entry c becomes the whole number x = floor(1024 c) + 100000. Tasks add up x and its products
exactly; the scatter M = n * sum(x x') - S S' is a matrix of whole numbers, n squared times the
covariance. Its characteristic polynomial is found modulo many primes, each by Hessenberg reduction in
a Spark task of its own, and put together by Chinese remaindering. All roots are real and none is negative, so
the sign changes of the polynomial shifted to a point count the roots above that point, repeated ones
included: bisection with exact whole numbers isolates each wanted root to ``ROOT_BITS`` bits. A
component is the null vector of M - root, by inverse iteration with ``DIGITS`` digits, orthogonal to
the components before it.

The driver holds the sums, the matrix and its polynomial, whose sizes depend on the length of a vector only.

Defined results: dropped are vectors that are null, empty, hold a null or non-finite entry or one whose x is
beyond 2^62, and vectors of another than the most frequent length (of equally frequent ones the
longest). Repeated rows and null or repeated ids count row by row. Components with eigenvalue zero do not exist, so a
table of equal vectors, of one vector or of none gives no rows. Of equal eigenvalues any orthonormal basis
may come. ``deviation`` is null where it does not fit a long. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.llm.common import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits to which a root is known, counted from the bit length of the largest.
ROOT_BITS = 112
#: Digits of the null vectors' arithmetic, besides those that the matrix entries themselves have.
DIGITS = 60
#: Rows whose products are added up in one matrix product.
BLOCK = 2048


# ---------------------------------------------------------------- sums

def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c), which is x without its constant; floats in, 64-bit whole numbers out."""
    return np.floor(vectors * SCALE).astype(np.int64)


def _products(y: np.ndarray) -> tuple[list[int], list[int]]:
    """Sums of the columns of y and of their products (upper triangle by rows), as exact whole numbers."""
    d = y.shape[1]
    top = int(np.abs(y).max(initial=0))
    upper = np.triu_indices(d)
    if top * top * BLOCK < 1 << 53:  # then every partial sum of the product is a whole number that a double holds
        f = y.astype(np.float64)
        sums, both = f.sum(0).astype(np.int64), (f.T @ f).astype(np.int64)[upper]
        return sums.tolist(), both.tolist()
    o = y.astype(object)
    return list(o.sum(0)), list((o.T @ o)[upper])


def exact_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[int]]:
    """(rows, sums of y, sums of products of y), added up in tasks, then by Spark as decimals."""
    schema = pa.schema([("at", pa.int32()), ("part", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            y = whole(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            for at in range(0, len(y), BLOCK):
                sums, both = _products(y[at : at + BLOCK])
                total = [a + b for a, b in zip(total, sums + both, strict=True)] if total else sums + both
            n += len(y)
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(total) + 1), pa.int32()), pa.array([Decimal(n), *map(Decimal, total)], schema.field("part").type)],
                schema=schema)

    got = (vectors.mapInArrow(run, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("total")).orderBy("at").collect())
    values = [int(r.total) for r in got] or [0] * (1 + dim + dim * (dim + 1) // 2)
    return values[0], values[1 : dim + 1], values[dim + 1 :]


def scatter(n: int, sums: list[int], products: list[int]) -> list[list[int]]:
    """n * sum(y y') - S S', whole numbers."""
    d, it = len(sums), iter(products)
    m = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            m[i][j] = m[j][i] = n * next(it) - sums[i] * sums[j]
    return m


# ---------------------------------------------------------------- characteristic polynomial

def _is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 3.4e14 with these bases."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(m: list[list[int]]) -> list[int]:
    """Primes below 2^31 whose product exceeds twice every coefficient: for roots of sum t, the k-th
    coefficient is at most C(d, k) (t/d)^k."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    found, product, candidate = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if _is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def polynomial_modulo(m: list[list[int]], p: int) -> list[int]:
    """det(X - m) modulo p, highest power first: similarity to Hessenberg form, then the recurrence
    over its leading blocks."""
    d = len(m)
    h = np.array([[v % p for v in row] for row in m], np.int64)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[at, k + 1]] = h[[k + 1, at]]
            h[:, [at, k + 1]] = h[:, [k + 1, at]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(1)) % p
    blocks = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k x k block, lowest power first
    blocks[0, 0] = 1
    for k in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = blocks[k, :-1]
        new = (new - h[k, k] * blocks[k]) % p
        beneath = 1
        for i in range(k - 1, -1, -1):
            beneath = beneath * int(h[i + 1, i]) % p
            if not beneath:
                break
            new = (new - int(h[i, k]) * beneath % p * blocks[i]) % p
        blocks[k + 1] = new
    return blocks[d][::-1].tolist()


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(X - m), highest power first, exact. One Spark row per prime."""
    primes = primes_for(m)
    rows = [[str(v) for v in row] for row in m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_numbers = [[int(v) for v in row] for row in rows]
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([polynomial_modulo(whole_numbers, p)], pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(tasks)
    found = [0] * (len(m) + 1)
    product = 1
    for row in dealt.mapInArrow(run, "p bigint, residues array<bigint>").collect():
        inverse = pow(product % row.p, -1, row.p)
        found = [c + product * ((r - c) * inverse % row.p) for c, r in zip(found, row.residues, strict=True)]
        product *= row.p
    return [c - product if 2 * c > product else c for c in found]


# ---------------------------------------------------------------- roots and components

def roots_above(poly: list[int], point: int) -> int:
    """Roots greater than ``point``, repeated ones counted: sign changes after shifting the polynomial there
    (exact for polynomials with real roots only)."""
    c = list(poly)
    for end in range(len(c) - 1, 0, -1):
        for i in range(1, end + 1):
            c[i] += point * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], k: int) -> tuple[list[int], int]:
    """The ``k`` largest positive roots (fewer if there are fewer), falling, as whole numbers in
    units of 2^-shift: each at most one unit below the root."""
    k = min(k, roots_above(poly, 0))
    if not k:
        return [], 0
    top = 1
    while roots_above(poly, top):
        top *= 2
    shift = max(0, ROOT_BITS - top.bit_length())
    fine = [c << shift * i for i, c in enumerate(poly)]
    borders = {0: len(poly), top << shift: 0}  # points whose count is known
    found = []
    for wanted in range(1, k + 1):
        low = max(p for p, n in borders.items() if n >= wanted)
        high = min(p for p, n in borders.items() if n < wanted)
        while high - low > 1:
            middle = (low + high) // 2
            borders[middle] = n = roots_above(fine, middle)
            low, high = (middle, high) if n >= wanted else (low, middle)
        found.append(low)
    return found, shift


def _solve(lower_upper: list[list[Decimal]], order: list[int], v: list[Decimal]) -> list[Decimal]:
    d = len(v)
    x = [v[i] for i in order]
    for i in range(d):
        row = lower_upper[i]
        x[i] -= sum((row[j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        row = lower_upper[i]
        x[i] = (x[i] - sum((row[j] * x[j] for j in range(i + 1, d)), Decimal(0))) / row[i]
    return x


def _factors(a: list[list[Decimal]]) -> tuple[list[list[Decimal]], list[int]]:
    """LU with row exchange; ``a`` is overwritten."""
    d, order = len(a), list(range(len(a)))
    tiny = Decimal(10) ** -DIGITS * max(abs(v) for row in a for v in row)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        for i in range(k + 1, d):
            if a[i][k]:
                f = a[i][k] = a[i][k] / a[k][k]
                top, row = a[k], a[i]
                for j in range(k + 1, d):
                    row[j] -= f * top[j]
    return a, order


def _unit(v: list[Decimal], before: list[list[Decimal]]) -> list[Decimal]:
    for _ in range(2):
        for b in before:
            part = sum((x * y for x, y in zip(v, b, strict=True)), Decimal(0))
            v = [x - part * y for x, y in zip(v, b, strict=True)]
    norm = sum((x * x for x in v), Decimal(0)).sqrt()
    return [x / norm for x in v]


def components(m: list[list[int]], roots: list[int], shift: int) -> list[list[float]]:
    """Unit eigenvectors of ``m`` to the given roots, orthogonal, in double precision."""
    d = len(m)
    digits = DIGITS + len(str(max(abs(v) for row in m for v in row)))
    found: list[list[Decimal]] = []
    with localcontext(Context(prec=digits)):
        for root in roots:
            value = Decimal(root) / (1 << shift)
            lower_upper, order = _factors([[Decimal(v) - value if i == j else Decimal(v) for j, v in enumerate(row)]
                                           for i, row in enumerate(m)])
            bound = Decimal(10) ** -25 * max(abs(v) for row in m for v in row)
            for start in range(d):  # a start that is orthogonal to the null space leaves a residual; then the next
                v = [Decimal(1) / (1 + (i + start) % d) for i in range(d)]
                for _ in range(4):
                    v = _unit(_solve(lower_upper, order, _unit(v, found)), found)
                rest = max(abs(sum((Decimal(a) * x for a, x in zip(row, v, strict=True)), -value * v[i])) for i, row in enumerate(m))
                if rest <= bound:
                    break
            found.append(v)
    return [[float(x) for x in v] for v in found]


# ---------------------------------------------------------------- the operator

def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(key, v as doubles) of the rows that take part, and their length."""
    limit = float((1 << 62) // SCALE)
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = (df.select(F.col(id_col).alias("key"), v.alias("v")).where(F.size("v") > 0)
            .where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit))))
    lengths = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0].dim if lengths else 1
    return fine.where(F.size("v") == dim), dim


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: the id column, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    rows, dim = usable(df, id_col, vector_col)
    n, sums, products = exact_sums(rows.select("v"), dim)
    m = scatter(n, sums, products)
    roots, shift = largest_roots(characteristic_polynomial(spark, m), k) if n else ([], 0)
    axes = np.array(components(m, roots, shift)).reshape(-1, dim)
    trace = sum(m[i][i] for i in range(dim))
    explained = [root / (trace << shift) for root in roots]
    # sqrt(root) with 64 bits to spare; whitened = (n x - S) v / sqrt(root), as e = root / n^2
    spread = [isqrt(root << 2 * 64 + shift) / (1 << 64 + shift) for root in roots]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, deviation bigint, w array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            top = int(np.abs(y).max(initial=0))
            small = (top * n + max(map(abs, sums))) ** 2 * dim < 1 << 63
            off = y * n - np.array(sums) if small else y.astype(object) * n - np.array(sums, object)
            squares = (off * off).sum(1)
            w = (off.astype(np.float64) @ axes.T) / np.array(spread) if len(axes) else np.zeros((len(y), 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([s if s < 1 << 63 else None for s in squares.tolist()], pa.int64()),
                pa.array(w.tolist(), pa.list_(pa.float64()))], names=["key", "deviation", "w"])

    held = stored(rows.mapInArrow(run, schema), "whitened")
    part = [F.element_at("w", i + 1) for i in range(len(roots))]
    means = held.agg(*[F.avg(p).alias(f"m{i}") for i, p in enumerate(part)], F.count("*").alias("n")).first()
    pairs = [(i, j) for i in range(len(roots)) for j in range(i, len(roots))]
    covariance = held.agg(F.count("*").alias("n"), *[
        F.avg((part[i] - means[f"m{i}"]) * (part[j] - means[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else {}
    error = max((abs(covariance[f"c{i}_{j}"] - (i == j)) for i, j in pairs), default=0.0)
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return (held.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select(F.col("key").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error")))
