"""Embedding whitening from an exact characteristic polynomial.

Entries become whole numbers, so their scatter n * sum(x x') - S S' is a matrix of integers, summed exactly over all rows.
Its characteristic polynomial is computed modulo one 31-bit prime a task, by reduction to Hessenberg form, and put
together by Chinese remaindering: its coefficients are exact. All roots are real and not negative, so the sign changes of
the polynomial shifted by a count the roots above a exactly; that isolates them, and bracketed secants on whole numbers
refine them to over 100 bits. Components are null vectors of scatter - root, by inverse iteration on an LU decomposition in
fixed-point arithmetic; roots that can't be told apart share one iteration with orthogonal vectors.

Only sums and polynomials pass through the driver: their size follows the number of dimensions, not of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.ship import ship

SCALE = 64  # an entry c becomes floor(64 c) + 1000000; the constant cancels out of all that is centred
LIMB, LIMBS = 40, 5  # sums travel as five numbers of 40 bits
HALF = 20  # entries are multiplied in parts of 20 bits, exact in doubles
ROWS = 4096
GUARD, BITS, STEPS = 64, 192, 3


@dataclass
class Whitening:
    """n rows with sums S of floor(64 c); components as columns of basis, largest eigenvalue first."""

    n: int
    sums: list[int]
    basis: np.ndarray  # dimensions x components, unit vectors
    roots: np.ndarray  # eigenvalues of the scatter, n^2 times those of the covariance
    explained: np.ndarray
    identity_error: float


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """vectors with a column ``_v`` of doubles: without rows whose vector is null, holds a null or non-finite entry or one beyond 2^50,
    or hasn't the most common length (the greater one on ties)."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 50)))
    rows = vectors.withColumn("_v", v).filter(F.col("_v").isNotNull()).filter(ok)
    width = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("_v") == (width["n"] if width else 0))


def whole(batch: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c) of a list array."""
    return np.floor(batch.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64).reshape(-1, dim)


def products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers: exact products of 20-bit parts, of ROWS rows at most."""
    parts = []
    while True:
        low = ((y + (1 << (HALF - 1))) & ((1 << HALF) - 1)) - (1 << (HALF - 1))
        parts.append(low.astype(np.float64))
        y = (y - low) >> HALF
        if not y.any():
            break
    total = np.zeros((parts[0].shape[1],) * 2, object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) << (HALF * (i + j))
    return total


def scatter(rows: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the scatter n * sum(y y') - S S' of the rows' ``_v``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, both = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = whole(batch.column(0).slice(at, ROWS), dim)
                n += len(y)
                total += np.array([sum(c) for c in y.T.tolist()], object)
                both += products(y)
        i, j = np.triu_indices(dim)
        values = [n, *total, *both[i, j]]
        limbs = {}
        for k in range(LIMBS):
            limbs[f"s{k}"] = pa.array([int(v >> (LIMB * k)) if k == LIMBS - 1 else int(v >> (LIMB * k)) & ((1 << LIMB) - 1) for v in values], pa.int64())
        yield pa.RecordBatch.from_pydict({"i": pa.array([-2, *[-1] * dim, *i.tolist()], pa.int32()), "j": pa.array([0, *range(dim), *j.tolist()], pa.int32())} | limbs)

    made = rows.select("_v").mapInArrow(sums, "i int, j int, " + ", ".join(f"s{k} long" for k in range(LIMBS)))
    found = made.groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(LIMBS)]).collect()  # a row a pair of dimensions
    value = {(r["i"], r["j"]): sum(r[f"s{k}"] << (LIMB * k) for k in range(LIMBS)) for r in found}
    n, total = value[-2, 0], [value[-1, j] for j in range(dim)]
    m = np.array([[n * value[min(i, j), max(i, j)] - total[i] * total[j] for j in range(dim)] for i in range(dim)], object)
    return n, total, m


# -- the polynomial -----------------------------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """For n below 2^32, by strong tests to the bases 2, 7 and 61."""
    if n % 2 == 0 or n < 3:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 7, 61):
        x = pow(base, d, n)
        if n != base and x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(product: int) -> list[int]:
    """Primes from below 2^31 downwards whose product is above ``product``."""
    out, p, got = [], (1 << 31) - 1, 1
    while got <= product:
        if _is_prime(p):
            out.append(p)
            got *= p
        p -= 2
    return out


def bound(m: np.ndarray) -> int:
    """No coefficient is greater: the elementary symmetric means of roots >= 0 lie under powers of their mean."""
    d, trace = len(m), int(sum(m.diagonal()))
    return max((math.comb(d, k) * trace**k // d**k for k in range(1, d + 1)), default=0) + 1


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - m) modulo p, lowest first."""
    d = len(m)
    a = (m % p).astype(np.int64)
    for k in range(d - 2):
        nonzero = np.flatnonzero(a[k + 1 :, k])
        if not len(nonzero):
            continue
        i = k + 1 + int(nonzero[0])
        if i != k + 1:
            a[[i, k + 1]] = a[[k + 1, i]]
            a[:, [i, k + 1]] = a[:, [k + 1, i]]
        u = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :, k:] = (a[k + 2 :, k:] - u[:, None] * a[k + 1, k:] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * u % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # row k: of the leading k x k block
    poly[0, 0] = 1
    for k in range(d):
        weight = np.zeros(k + 1, np.int64)
        below = 1
        for i in range(k, -1, -1):
            weight[i] = a[i, k] * below % p
            below = below * int(a[i, i - 1]) % p if i else 0
        row = -((weight[:, None] * poly[: k + 1] % p).sum(0)) % p
        row[1:] = (row[1:] + poly[k, :-1]) % p
        poly[k + 1] = row
    return poly[d]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of det(x - m), lowest first, exact."""
    moduli = primes(2 * bound(m))
    shared = spark.sparkContext.broadcast(m)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            if ps:
                yield pa.RecordBatch.from_pydict({"p": pa.array(ps, pa.int64()), "c": pa.array([polynomial_mod(shared.value, p).tolist() for p in ps], pa.list_(pa.int64()))})

    tasks = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(max(1, min(len(moduli), 4 * spark.sparkContext.defaultParallelism)))
    found = {r["p"]: r["c"] for r in tasks.mapInArrow(reduce, "p long, c array<long>").collect()}  # a row a prime
    whole_product = math.prod(moduli)
    lifts = {p: (q := whole_product // p) * pow(q, -1, p) for p in moduli}
    out = []
    for k in range(len(m) + 1):
        x = sum(found[p][k] * lifts[p] for p in moduli) % whole_product
        out.append(x - whole_product if 2 * x > whole_product else x)
    return out


# -- its roots ----------------------------------------------------------------------------------------------


def value_at(c: list[int], x: int) -> int:
    out = 0
    for a in reversed(c):
        out = out * x + a
    return out


def roots_above(c: list[int], a: int) -> int:
    """Roots greater than a, with multiplicity: the sign changes of c shifted by a, as all roots are real."""
    shifted = list(c)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            shifted[k] += a * shifted[k + 1]
    signs = [x > 0 for x in shifted if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def isolate(c: list[int], most: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(f, [(low, high, how many)]) for the ``most`` largest roots above 0, largest first: low < root * 2^f <= high.

    An interval holds one root, or several that differ by less than 2^-f. f is such that each has 100 bits.
    """
    zeros = next(k for k, a in enumerate(c) if a)
    c = c[zeros:]
    degree = len(c) - 1
    most = min(most, degree)
    if not most:
        return 0, []
    f = GUARD
    while True:
        scaled = [a << (f * (degree - k)) for k, a in enumerate(c)]
        if roots_above(scaled, 1 << 100) >= most:
            break
        f += GUARD
    top = 1
    while roots_above(scaled, 1 << top):
        top += 1
    out: list[tuple[int, int, int]] = []
    stack = [(0, 1 << top, degree, 0)]
    while stack and sum(x[2] for x in out) < most:
        low, high, above_low, above_high = stack.pop()
        n = above_low - above_high
        if not n:
            continue
        if n == 1 or high - low == 1:
            out.append((low, high, n))
            continue
        middle = (low + high) // 2
        above = roots_above(scaled, middle)
        stack += [(low, middle, above_low, above), (middle, high, above, above_high)]  # the upper half comes first
    return f, out


def refine(c: list[int], f: int, low: int, high: int) -> int:
    """The root times 2^f, rounded up, of an interval with one root: bracketed secants, and a halving every third step."""
    zeros = next(k for k, a in enumerate(c) if a)
    c = [a << (f * (len(c) - 1 - zeros - k)) for k, a in enumerate(c[zeros:])]
    at_low, at_high = value_at(c, low), value_at(c, high)
    if not at_high:
        return high
    step, side = 0, 0
    while high - low > 1:
        step += 1
        middle = (low + high) // 2 if step % 3 == 0 or not at_low else low + (high - low) * at_low // (at_low - at_high)
        middle = min(max(middle, low + 1), high - 1)
        now = value_at(c, middle)
        if not now:
            return middle
        if (now > 0) == (at_high > 0):
            high, at_high = middle, now
            at_low = at_low // 2 if side == 1 and step % 3 else at_low  # else one end would stay for good
            side = 1
        else:
            low, at_low = middle, now
            at_high = at_high // 2 if side == -1 and step % 3 else at_high
            side = -1
        if not at_low or not at_high:
            at_low, at_high = value_at(c, low), value_at(c, high)
    return high


# -- its null spaces ----------------------------------------------------------------------------------------


def null_vectors(m: np.ndarray, root: int, f: int, how_many: int) -> list[list[float]]:
    """Unit vectors of the null space of m - root / 2^f, by inverse iteration in fixed-point arithmetic."""
    d = len(m)
    a = m << (f + GUARD)
    a[np.arange(d), np.arange(d)] -= (root << GUARD) - (1 << (GUARD - 1))
    order = np.arange(d)
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        if i != k:
            a[[i, k]] = a[[k, i]]
            order[[i, k]] = order[[k, i]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            times = (a[k + 1 :, k] << BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (times[:, None] * a[k, k + 1 :]) >> BITS
            a[k + 1 :, k] = times

    def solved(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(d - 1):
            y[k + 1 :] -= (a[k + 1 :, k] * y[k]) >> BITS
        size = max(abs(x) for x in a.flat).bit_length()
        y = y << (size + BITS)
        for k in range(d - 1, -1, -1):
            y[k] = y[k] // a[k, k]
            y[:k] -= a[:k, k] * y[k]
        return y

    def unit(x: np.ndarray) -> np.ndarray:
        norm = math.isqrt(int((x * x).sum()))
        return (x << BITS) // max(1, norm)

    rng = np.random.default_rng(7)
    found = [unit(np.array(rng.integers(-(1 << 40), 1 << 40, d).tolist(), object)) for _ in range(how_many)]
    for _ in range(STEPS):
        for i, x in enumerate(found):
            x = unit(solved(x))
            for _ in range(2):
                for y in found[:i]:
                    x = x - (((x * y).sum() >> BITS) * y >> BITS)
            found[i] = unit(x)
    out = []
    for x in found:
        sign = 1 if max(x, key=abs) > 0 else -1
        out.append([sign * int(v) / (1 << BITS) for v in x])
    return out


def components(spark: SparkSession, m: np.ndarray, c: list[int], most: int) -> tuple[np.ndarray, list[float], list[float]]:
    """Basis, roots and shares of the trace of the ``most`` largest roots above 0; a task for each isolated root."""
    f, cells = isolate(c, most)
    dim, trace = len(m), int(sum(m.diagonal()))
    if not cells:
        return np.zeros((dim, 0)), [], []
    shared = spark.sparkContext.broadcast((m, c))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                root = refine(c, f, int(row["low"]), int(row["high"])) if row["n"] == 1 else int(row["high"])
                vectors = null_vectors(m, root, f, row["n"])
                size = len(vectors)
                yield pa.RecordBatch.from_pydict({"at": pa.array([row["at"]] * size, pa.int32()), "nth": pa.array(range(size), pa.int32()), "root": pa.array([str(root)] * size), "vector": pa.array(vectors, pa.list_(pa.float64()))})

    tasks = spark.createDataFrame([(k, str(low), str(high), n) for k, (low, high, n) in enumerate(cells)], "at int, low string, high string, n int").repartition(len(cells))
    rows = sorted(tasks.mapInArrow(solve, "at int, nth int, root string, vector array<double>").collect(), key=lambda r: (r["at"], r["nth"]))[:most]
    roots = [int(r["root"]) for r in rows]
    return np.array([r["vector"] for r in rows]).T, [x / (1 << f) for x in roots], [x / (trace << f) for x in roots]


# -- rows ---------------------------------------------------------------------------------------------------


def whitened_rows(y: np.ndarray, n: int, sums: list[int], basis: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """Whitened coordinates, and the squared deviation of n x from the sums (None where it is beyond a long)."""
    reach = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if reach * reach * max(1, len(sums)) < 1 << 63:
        off = n * y - np.array(sums, np.int64)
        deviation = (off * off).sum(1).tolist()
    else:
        off = n * y.astype(object) - np.array(sums, object)
        deviation = [x if x < 1 << 63 else None for x in map(int, (off * off).sum(1))]
    return (off.astype(np.float64) @ basis) / np.sqrt(roots), deviation


def _identity_error(rows: DataFrame, n: int, sums: list[int], basis: np.ndarray, roots: np.ndarray) -> float:
    """Largest entry of the covariance of all whitened rows minus the identity."""
    dim, k = basis.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w, _ = whitened_rows(whole(batch.column(0).slice(at, ROWS), dim), n, sums, basis, roots)
                total[0] += w.sum(0)
                total[1:] += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)), "s": pa.array(total.ravel())})

    found = rows.select("_v").mapInArrow(part, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1, k))
    for r in found:
        total[r["i"], r["j"]] = r["s"]
    mean = total[0] / n
    return float(np.abs(total[1:] / n - np.outer(mean, mean) - np.eye(k)).max())


def fit(vectors: DataFrame, vector_col: str = "embedding", most: int = 32) -> Whitening | None:
    """The whitening of all usable rows; None without any. Components of eigenvalue 0 don't count, so there may be fewer than most."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors.select(vector_col), vector_col)
    first = rows.first()
    if first is None:
        return None
    dim = len(first["_v"])
    if not dim:
        return None
    n, sums, m = scatter(rows, dim)
    basis, roots, explained = components(spark, m, characteristic(spark, m), most)
    error = _identity_error(rows, n, sums, basis, np.array(roots)) if roots else 0.0
    return Whitening(n, sums, basis, np.array(roots), np.array(explained), error)


def whiten(vectors: DataFrame, model: Whitening, keep: list[str | Column], vector_col: str = "embedding") -> DataFrame:
    """The columns ``keep`` of the usable rows with deviation and whitened, an array of a number for each component.

    Repeated rows and null ids stay as they are. Further columns are ignored, whatever their names.
    """
    ship(vectors.sparkSession)
    picked = usable(vectors.select(*keep, F.col(vector_col).alias("_vector")), "_vector").drop("_vector")
    names = [c for c in picked.columns if c != "_v"]
    dim = len(model.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                w, deviation = whitened_rows(whole(some.column(len(names)), dim), fitted.n, fitted.sums, fitted.basis, fitted.roots)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(names))), pa.array(deviation, pa.int64()), values], names=[*names, "deviation", "whitened"])

    kinds = dict(picked.dtypes)
    return picked.select(*names, "_v").mapInArrow(each, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", deviation long, whitened array<double>")


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], OUT)
    shares = F.array(*[F.lit(float(x)) for x in model.explained]) if len(model.roots) else F.array().cast("array<double>")
    rows = whiten(vectors, model, [F.col("vec_id").cast("long").alias("vec_id")]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
