"""Whitening of embeddings through the singular values of a bidiagonal matrix.

Blocks of centred rows are reduced to triangles by QR and the triangles of all
partitions by a tree of QRs; the last one, dimension x dimension, goes through
Householder bidiagonalisation.  dqds finds its singular values to high relative
accuracy, twisted factorisations their directions.  Entries are integers, so
that sums, centring and deviations are exact.
"""

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialise, work_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this don't fit a long when scaled; their rows go like non-finite ones.
LARGEST = 2.0**55
COMPONENTS = 32
#: Rows that one QR takes in, triangles that one task of the tree takes in.
BLOCK_ROWS, FAN = 4096, 16
EPS = 2.0**-52
#: Eigenvalues closer than this, relatively, get their directions together.
CLOSE = 1e-4


def integers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST))  # false for NaN, which exceeds all
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Centre:
    """Exact sums of n rows."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n with one rounding after an exact difference."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 by row, exact; None where it doesn't fit a long."""
        away = x - self.whole
        most = (float(np.abs(away).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2.0**62:
            u = away * self.n - self.rest
            return (u * u).sum(axis=1).tolist()
        u = away.astype(object) * self.n - self.rest.astype(object)
        return [v if v < 1 << 63 else None for v in (u * u).sum(axis=1)]


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows' QR, square."""
    r = np.linalg.qr(rows, mode="r")
    d = rows.shape[1]
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Householder: diagonal, superdiagonal, and the reflections from the right."""
    a, d, right = r.copy(), len(r), []

    def mirror(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0:
            return None
        v = x / size
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = mirror(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = mirror(a[k, k + 1:]) if k + 2 < d else None
        if v is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal matrix with squares ``q`` on the
    diagonal and ``e`` above it, unordered.

    Each round makes one pass without a shift, whose d's bound the least value
    from below (1 / sum of 1 / d), and one with the largest shift that keeps all
    d's from being negative.
    """
    out: list[float] = []
    todo = [(list(q), list(e), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while q:
            n = len(q)
            if n == 1:
                out.append(sigma + q[0])
                break
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (sigma + min(q[k], q[k + 1])) or e[k] == 0), None)
            if cut == n - 2:
                out.append(sigma + q.pop())
                e.pop()
                continue
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # the least values belong at the end
                q.reverse()
                e.reverse()
            plain = stationary(q, e, 0.0)
            q, e, ds = plain
            least = min(ds)
            if least <= 0:
                continue
            low = 1 / sum(1 / x for x in ds)
            for shift in (0.98 * least, 0.5 * least, low * (1 - 1e-12), low / 2):
                if shift <= EPS * sigma * 0.125:
                    break
                moved = stationary(q, e, shift)
                if min(moved[2]) >= 0:
                    q, e, _ = moved
                    sigma += shift
                    break
    return out


def stationary(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One pass of dqds; the d's come third."""
    d = q[0] - shift
    new_q, new_e, ds = [], [], [d]
    for k in range(len(e)):
        x = d + e[k]
        if x == 0:
            new_q.append(0.0)
            new_e.append(0.0)
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / x
            new_q.append(x)
            new_e.append(e[k] * t)
            d = d * t - shift
        ds.append(d)
    new_q.append(d)
    return new_q, new_e, ds


def twisted(q: np.ndarray, l: np.ndarray, value: float) -> np.ndarray:  # noqa: E741
    """Eigenvector of L D L' (D = q, L with l below its diagonal) to an eigenvalue:
    the factorisations from both ends meet where the twist is least."""
    n = len(q)
    tiny = 1e-300
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for k in range(n - 1):
        x = s[k] + q[k]
        x = x if abs(x) > tiny else tiny
        down[k] = q[k] * l[k] / x
        s[k + 1] = down[k] * l[k] * s[k] - value
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        x = q[k] * l[k] * l[k] + p[k + 1]
        x = x if abs(x) > tiny else tiny
        t = q[k] / x
        up[k] = l[k] * t
        p[k] = p[k + 1] * t - value
    twist = np.abs(s + p + value)
    r = int(np.argmin(np.where(np.isfinite(twist), twist, np.inf)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def directions(b: np.ndarray, f: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of B'B, falling, and the eigenvectors of the first ``want``."""
    d = len(b)
    norm = max(float(np.abs(b).max(initial=0)), float(np.abs(f).max(initial=0)))
    if norm == 0:
        return np.zeros(d), np.zeros((d, 0))
    b, f = b / norm, f / norm
    b = np.where(np.abs(b) < EPS * EPS, EPS * EPS, b)  # L D L' needs a diagonal
    edges = [0, *(np.flatnonzero(np.abs(f) <= EPS * EPS) + 1).tolist(), d]
    found = []  # (value, block start, block end)
    for lo, hi in zip(edges, edges[1:]):
        for v in dqds((b[lo:hi] ** 2).tolist(), (f[lo:hi - 1] ** 2).tolist()):
            found.append((max(v, 0.0), lo, hi))
    found.sort(key=lambda x: (-x[0], x[1]))
    values = np.array([x[0] for x in found])
    real = int((values > (d * EPS) ** 2 * 64 * values[0]).sum())
    want = min(want, real)
    t = np.diag(b * b + np.concatenate(([0.0], f * f))) + np.diag(b[:-1] * f, 1) + np.diag(b[:-1] * f, -1)
    z, at, noise = np.zeros((d, want)), 0, np.random.default_rng(0)
    while at < want:
        end = at + 1
        while end < real and values[end - 1] - values[end] <= CLOSE * values[end - 1]:
            end += 1
        cols = np.zeros((d, end - at))
        for i in range(at, end):
            v, lo, hi = found[i]
            cols[lo:hi, i - at] = twisted(b[lo:hi] ** 2, f[lo:hi - 1] / b[lo:hi - 1], v)
        if end - at > 1:  # close values: iterate on their space, then part it
            cols, _ = np.linalg.qr(cols + 1e-8 * noise.standard_normal(cols.shape))
            for _ in range(3):
                cols, _ = np.linalg.qr(np.linalg.solve(t - (values[at] * (1 + 4 * EPS)) * np.eye(d) - EPS * values[0] * np.eye(d), cols))
            _, turn = np.linalg.eigh(cols.T @ t @ cols)
            cols = cols @ turn[:, ::-1]
        z[:, at:min(end, want)] = cols[:, :min(end, want) - at]
        at = end
    return values * norm * norm, z


def spectrum(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors (columns) of R'R / n, and its trace."""
    b, f, right = bidiagonal(r)
    values, z = directions(b, f, min(components, len(r)))
    for k, v in reversed(right):
        z[k:] -= 2 * np.outer(v, v @ z[k:])
    return values[:z.shape[1]] / n, z, float((r * r).sum() / n)


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Vectors that are null, empty, or hold null, non-finite or giant (over 2**55)
    entries go.  All others must be of one length: of several lengths the most
    frequent stays, the longest of equally frequent ones.  Directions in which the vectors don't
    vary beyond rounding have no component, so equal vectors, a single one and an
    empty table give no rows.  Repeated rows and ids are rows like any other, a null id stays null.  A
    deviation that doesn't fit a long is null.  Further columns are ignored and
    may have any name.
    """
    spark, base = df.sparkSession, work_dir(df.sparkSession)
    v = F.col(f"`{vector}`")
    rows = df.where(usable(v)).select(F.col(f"`{vec_id}`").alias("vec_id"), integers(v).alias("x"))
    id_type = rows.schema["vec_id"].dataType
    schema = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    top = rows.groupBy(F.size("x").alias("dim")).count().agg(F.max(F.struct("count", "dim"))).first()[0]
    if top is None:
        return spark.createDataFrame([], schema)
    dim = top["dim"]
    rows = rows.where(F.size("x") == dim)
    centre = sums(rows, dim)
    r = reduced(rows, centre, dim, base)
    values, z, trace = spectrum(r, centre.n, components)
    scaled = z / np.sqrt(values)
    error = identity_error(rows, centre, dim, scaled)
    share, k = values / trace if trace else values, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x, m = matrix(part.column(1), dim), part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n)), pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array((centre.centred(x) @ scaled).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def sums(rows: DataFrame, dim: int) -> Centre:
    """Number of rows and exact sums, by upper and lower halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dim)
            n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & 0x7FFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)],
                                         names=["i", "n", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "i long, n long, high long, low long")
    got = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()  # one row per dimension
    return Centre(got[0]["n"], [(g["high"] << 31) + g["low"] for g in got])


def reduced(rows: DataFrame, centre: Centre, dim: int, base: str) -> np.ndarray:
    """R of all centred rows: one triangle per partition, then a tree of them."""
    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, node = np.zeros((dim, dim)), None
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                node = part.column(0)[0].as_py()
                r = triangle(np.vstack([r, centre.centred(matrix(part.column(1), dim))]))
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        r = np.zeros((dim, dim))
        for b in table.column("r"):
            r = triangle(np.vstack([r, np.frombuffer(b.as_py()).reshape(dim, dim)]))
        return pa.table({"node": pa.array([table.column("node")[0].as_py() // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    level = materialise(rows.select(F.spark_partition_id().cast("long").alias("node"), "x").mapInArrow(leaf, "node long, r binary"), "triangles", base)
    most = level.agg(F.max("node")).first()[0]
    while True:
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("_up")).applyInArrow(join, "node long, r binary")
        most //= FAN
        if not most:
            return np.frombuffer(level.first()["r"]).reshape(dim, dim)


def identity_error(rows: DataFrame, centre: Centre, dim: int, scaled: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = scaled.shape[1]
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((k + 1, k))
        for batch in batches:
            y = centre.centred(matrix(batch.column(0), dim)) @ scaled
            moments += np.vstack([y.T @ y, y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(moments.size)), pa.array(moments.ravel())], names=["i", "v"])

    got = rows.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    moments = np.array([g["v"] for g in got]).reshape(k + 1, k) / centre.n
    cov = moments[:-1] - np.outer(moments[-1], moments[-1])
    return float(np.abs(cov - np.eye(k)).max())
