"""Whitened embeddings whose components come from the exact characteristic polynomial of the scatter matrix.

* Entries become integers, so the scatter matrix C = n * sum(x x') - S S' is exact; the covariance is C / n^2. Tasks add up products
  of integers, Spark adds the tasks' sums as decimals, and at most (d + 1)^2 sums of d dimensions reach the driver.
* Its characteristic polynomial is worked out modulo many primes, one task for some of them, by reduction to Hessenberg form,
  and put together by Chinese remainders. Two more primes check it.
* All eigenvalues are real, so the sign changes of the polynomial moved by t count those above t, copies included. Bisection
  by that count isolates the largest eigenvalues, bisection by sign narrows them to ``BITS`` bits of the trace.
* Components are null vectors of C - e: inverse iteration in decimal numbers of ``DIGITS`` digits. Equal eigenvalues share one iteration
  over as many orthogonal vectors.

A row is left out if its vector is null, has null, NaN or infinite entries or entries of 2^30 or more, or has another length than
most (of equally frequent lengths the largest counts). An entry c becomes floor(1024 c) + 100000. Repeated rows count as often as
they occur, a null id stays null, other columns are left out, an empty table gives no rows. A component without variance has
null ``whitened``, and ``explained`` is 0, or null if there is no variance at all; ``identity_error`` is over the other components.
``deviation`` is null where it does not fit a long. The work on the driver is bounded by the dimension (``MOST_DIMENSIONS``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import importable, partitions, slices
from assaykit.session import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Eigenvalues are isolated to this part of the trace, and components worked out with so many digits.
BITS, DIGITS = 256, 100
MOST_DIMENSIONS = 1024
ROUNDS = 3
OUTPUT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and y = floor(1024 c), the entries without the constant, which no covariance depends on."""
    sound = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0 ** 30, F.lit(False)))
    rows = embeddings.where(F.col(vector_col).isNotNull() & sound & (F.size(vector_col) > 0))
    rows = rows.select(F.col(id_col).alias("vec_id"),
                       F.transform(vector_col, lambda c: F.floor(SCALE * c.cast("double")).cast("long")).alias("y"))
    usual = rows.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("y") == (usual.d if usual else 0))


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(y: np.ndarray) -> np.ndarray:
    """y'y exactly: in doubles, 64-bit or Python's integers, whichever holds every sum."""
    top = max(int(abs(y).max(initial=0)), 1) ** 2 * len(y)
    if top < 1 << 53:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    return y.T @ y if top < 1 << 63 else y.T.astype(object) @ y.astype(object)


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, sums per dimension and n^2 times the covariance of y, exactly."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, 0, 0
        for part in slices(batches, "y"):
            y = matrix_of(part.column("y"))
            n, sums, total = n + len(y), sums + y.sum(axis=0).astype(object), total + products(y).astype(object)
        if n:
            d = len(sums)
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*i.tolist(), *range(d), -1], pa.int32()), pa.array([*j.tolist(), *[-1] * d, -1], pa.int32()),
                 pa.array([Decimal(v) for v in (*total[i, j], *sums, n)], pa.decimal128(38, 0))], names=["i", "j", "value"])

    summed = rows.select("y").mapInArrow(work, "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = {(r.i, r.j): int(r.value) for r in summed.collect()}  # one row for each pair of dimensions
    n = found.get((-1, -1), 0)
    d = sum(j == -1 for _, j in found) - 1 if n else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the polynomial is worked out for {MOST_DIMENSIONS} at most")
    sums = [found[i, -1] for i in range(d)]
    return n, sums, [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def primes(bits: int) -> list[int]:
    """Primes below 2^31, from the top, whose product has more than so many bits; two more to check by."""
    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # decides every number below 3,215,031,751
            x = pow(base, odd, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, p = [], (1 << 31) + 1
    while len(found) < 2 + -(-(bits + 1) // 30):
        p -= 2
        if prime(p):
            found.append(p)
    return found


def polynomial_modulo(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, the constant first: similar Hessenberg form, then its recurrence."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        k = m + below[0]
        if k != m:
            h[[m, k]] = h[[k, m]]
            h[:, [m, k]] = h[:, [k, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for m in range(1, d + 1):
        found[m, 1:] = found[m - 1, :-1]
        found[m] = (found[m] - h[m - 1, m - 1] * found[m - 1]) % p
        chain = 1
        for i in range(1, m):
            chain = chain * int(h[m - i, m - i - 1]) % p
            if not chain:
                break
            found[m] = (found[m] - chain * int(h[m - i - 1, m - 1]) % p * found[m - i - 1]) % p
    return found[d]


def characteristic_polynomial(rows: DataFrame, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), that of the highest power first."""
    spark, d = rows.sparkSession, len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # each coefficient is a sum of products of eigenvalues, none negative: at most that of d equal ones
    mean = -(-trace // d)
    chosen = primes(max(math.comb(d, k) * mean ** k for k in range(d + 1)).bit_length())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [chosen[k] for k in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([polynomial_modulo(matrix, p).tolist() for p in own],
                                                                                   pa.list_(pa.int64()))], names=["p", "found"])

    tasks = min(len(chosen), partitions(spark))
    residues = spark.range(0, len(chosen), 1, tasks).mapInArrow(work, "p long, found array<long>").orderBy("p").collect()
    residues, checks = residues[:-2], residues[-2:]
    modulus = math.prod(r.p for r in residues)
    shares = [modulus // r.p * pow(modulus // r.p, -1, r.p) for r in residues]
    out = []
    for k in range(d, -1, -1):
        sign = -1 if (d - k) % 2 else 1
        value = sign * (sum(s * (sign * r.found[k] % r.p) for s, r in zip(shares, residues)) % modulus)
        if any((value - r.found[k]) % r.p for r in checks):
            raise ArithmeticError("remainders do not agree")
        out.append(value)
    return out


def above(poly: list[int], t: int) -> int:
    """Roots above t: sign changes of the coefficients once moved by t, as all roots are real."""
    moved = list(poly)
    for end in range(len(moved), 1, -1):
        for k in range(1, end):
            moved[k] += t * moved[k - 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """Of the largest roots: (value, bits, copies), the root being about value / 2^bits, by falling value."""
    trace = -poly[1]
    bits = max(0, BITS - trace.bit_length())
    fine = [c << bits * k for k, c in enumerate(poly)]  # its roots are 2^bits as large
    d, top = len(poly) - 1, (trace << bits) + 1
    found, counts = [], {0: above(fine, 0), top: 0}
    found_copies, high = 0, top
    while found_copies < min(most, d):
        if counts[0] <= found_copies:  # what is left is zero
            found.append((0, bits, d - found_copies))
            break
        low = 0
        for t in sorted(counts):  # the nearest known point below the next root
            if counts[t] > found_copies:
                low = t
        high = min(t for t in counts if counts[t] <= found_copies)
        while high - low > 1 and counts[low] - counts[high] > 1:
            mid = (low + high) // 2
            counts[mid] = above(fine, mid)
            low, high = (mid, high) if counts[mid] > found_copies else (low, mid)
        copies = counts[low] - counts[high]
        if copies == 1:
            end = value_at(fine, high)
            if not end:
                low = high - 1
            sign = end > 0
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if (value_at(fine, mid) >= 0) == sign else (mid, high)
        found.append((high, bits, copies))
        found_copies += copies
    return found


def value_at(poly: list[int], t: int) -> int:
    return reduce(lambda total, c: total * t + c, poly, 0)


def null_vectors(matrix: list[list[int]], root: int, bits: int, copies: int) -> list[list[float]]:
    """Orthogonal unit vectors v with (matrix - root / 2^bits) v = 0 as nearly as ``DIGITS`` digits allow."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        e = Decimal(root) / (1 << bits)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= e
        size = max([abs(v) for v in a.ravel()] + [Decimal(1)])
        vectors = np.array([[Decimal((i * 7919 + k * 104729 + i * i * 31 + k * i * 17) % 1009 - 504) for k in range(copies)]
                            for i in range(d)], object)
        order, lower = list(range(d)), np.full((d, d), Decimal(0), object)
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
            if pivot != k:
                a[[k, pivot]], lower[[k, pivot]] = a[[pivot, k]], lower[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < size.scaleb(-DIGITS + 10):
                a[k, k] = size.scaleb(-DIGITS + 10)
            lower[k + 1:, k] = a[k + 1:, k] / a[k, k]
            a[k + 1:, k:] -= lower[k + 1:, k][:, None] * a[k, k:][None, :]
        for _ in range(ROUNDS):
            x = vectors[order]
            for k in range(d):
                x[k + 1:] -= lower[k + 1:, k][:, None] * x[k][None, :]
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - a[k, k + 1:].dot(x[k + 1:]) if k < d - 1 else x[k]) / a[k, k]
            for c in range(copies):
                x[:, c] /= max(abs(v) for v in x[:, c])
                for _again in range(2):
                    for b in range(c):
                        x[:, c] -= x[:, b] * x[:, b].dot(x[:, c])
                    x[:, c] /= x[:, c].dot(x[:, c]).sqrt()
            vectors = x
        return [[float(v) for v in vectors[:, c]] for c in range(copies)]


def components(rows: DataFrame, matrix: list[list[int]], most: int) -> list[tuple[float, list[float], float]]:
    """Eigenvalue of ``matrix`` in doubles, unit vector and share of the trace, by falling eigenvalue."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return [(0.0, [float(i == k) for i in range(d)], math.nan) for k in range(min(most, d))]
    content = math.gcd(*(v for row in matrix for v in row))
    small = [[v // content for v in row] for row in matrix]
    out = []
    for root, bits, copies in largest_roots(characteristic_polynomial(rows, small), most):
        for vector in null_vectors(small, root, bits, copies):
            out.append((root * content / (1 << bits), vector, root * content / (trace << bits)))
    return out[:most]


def whitened(embeddings: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row and component."""
    importable(embeddings.sparkSession)
    kind = embeddings.schema[id_col].dataType.simpleString()
    rows = integers(embeddings, id_col, vector_col)
    n, sums, matrix = scatter(rows)
    if not n:
        return embeddings.sparkSession.createDataFrame([], OUTPUT.format(kind))
    found = components(rows, matrix, most)
    alive = [k for k, (e, _, _) in enumerate(found) if e > 0]
    shift = np.array(sums, object)
    basis = np.array([[v * n / math.sqrt(e) for v in vector] for e, vector, _ in found if e > 0]).reshape(len(alive), len(sums)).T

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "y"):
            y = matrix_of(part.column("y"))
            widest = (int(abs(y).max()) * n + max(abs(s) for s in sums)) ** 2 * len(sums)
            moved = n * y - shift.astype(np.int64) if widest < 1 << 63 else n * y.astype(object) - shift
            deviation = [int(v) if v < 1 << 63 else None for v in (moved * moved).sum(axis=1)]
            values = np.full((len(y), len(found)), np.nan)
            values[:, alive] = (moved / n).astype(np.float64) @ basis
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(deviation, pa.int64()),
                 pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * len(found), pa.array(values.ravel(), from_pandas=True))],
                names=["vec_id", "deviation", "whitened"])

    wide = stored(rows.mapInArrow(work, f"vec_id {kind}, deviation long, whitened array<double>"), "whitened")
    entries = [F.abs(F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]) - float(a == b)) for a in alive for b in alive if a <= b]
    error = wide.agg(F.array_max(F.array(*entries)).alias("error")).first().error if alive else None
    shares = F.array(*(F.lit(None if math.isnan(s) else s).cast("double") for _, _, s in found))
    return (wide.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation")
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error")))
