"""Embedding whitening: exact moments, pivoted Cholesky of the centred scatter, one-sided Jacobi.

Entries become whole numbers, so means and deviations are exact. Tasks add up the centred products
of their rows; the scatter (one row per dimension) is factored on the driver, whose work depends on
the dimensions only. Rotating the columns of the triangular factor until they are orthogonal gives
the eigenvalues as squared column norms and the components as normalised columns, without ever
squaring the condition number again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from siteweave.plans.stages import written

SCALE, SHIFT = 1024, 100_000
# Entries beyond this give no whole number in 64 bits.
_LARGEST = float(1 << 52)
# A column of the factor below this share of the largest one is rounding, not a component.
_RANK = 1e-14
_TILE = 4096
_MOST = (1 << 63) - 1


@dataclass
class Fit:
    """Exact sums and the leading components of all vectors of one length."""

    n: int
    sums: list[int]
    components: np.ndarray  # one row per component
    eigenvalues: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite entries, and with entries that fit 64 bits."""
    def fits(x: Column) -> Column:
        return F.coalesce(F.abs(x.cast("double")) < _LARGEST, F.lit(False)) & ~F.isnan(x)

    return F.coalesce(F.forall(vector, fits), F.lit(False))


def _whole(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of whole numbers) for each length that occurs in a batch."""
    values = batch.column(batch.schema.get_field_index("vector"))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths := values.value_lengths().to_numpy(zero_copy_only=False))
    for d in np.unique(lengths):
        if d == 0:
            continue
        at = np.flatnonzero(lengths == d)
        rows = flat[(ends[at] - d)[:, None] + np.arange(d)]
        yield at, np.floor(rows * SCALE).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums per dimension, for each length."""
    entry = F.posexplode("vector").alias("i", "c")
    x = F.floor(F.col("c").cast("double") * SCALE).cast("decimal(38,0)") + SHIFT
    rows = vectors.where(F.size("vector") > 0).select(F.size("vector").alias("d"), entry)
    found = rows.groupBy("d", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found, key=lambda r: (r.d, r.i)):
        out.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return out


def _scatter(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Sum of centred products for each length: a task sends one row per dimension."""
    whole = {d: [s // n for s in ss] for d, (n, ss) in sums.items()}
    rest = {d: [(s - n * w) / n for s, w in zip(ss, whole[d], strict=True)] for d, (n, ss) in sums.items()}

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _whole(batch):
                d = x.shape[1]
                total = held.setdefault(d, np.zeros((d, d)))
                for i in range(0, len(x), _TILE):
                    # the whole part of the mean leaves exactly, so no digits are lost
                    c = (x[i : i + _TILE] - np.array(whole[d])).astype(np.float64) - np.array(rest[d])
                    total += c.T @ c
        for d, total in held.items():
            yield pa.RecordBatch.from_pydict(
                {"d": [d] * d, "i": list(range(d)), "row": list(total)}, schema=schema
            )

    def added(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[d, i] = held.get((d, i), 0) + np.array(row)
        if held:
            yield pa.RecordBatch.from_pydict(
                {"d": [k[0] for k in held], "i": [k[1] for k in held], "row": list(held.values())}, schema=schema
            )

    import pyarrow as pa

    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])
    spark_schema = "d int, i int, row array<double>"
    parts = vectors.select("vector").mapInArrow(partial, spark_schema).repartition("d", "i")
    out = {d: np.zeros((d, d)) for d in sums}
    for r in parts.mapInArrow(added, spark_schema).toLocalIterator():
        out[r.d][r.i] = r.row
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(l, order)`` with ``a[order][:, order] = l @ l.T``; ``l`` has as many columns as ``a`` has rank."""
    d = len(a)
    left, order = np.array((a + a.T) / 2), np.arange(d)
    l = np.zeros((d, d))
    floor = np.diag(left).max(initial=0.0) * _RANK
    for k in range(d):
        p = k + int(np.argmax(np.diag(left)[k:]))
        if left[p, p] <= floor:
            return l[:, :k], order
        for m in (left, l):
            m[[k, p]] = m[[p, k]]
        left[:, [k, p]] = left[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        l[k, k] = np.sqrt(left[k, k])
        l[k + 1 :, k] = left[k + 1 :, k] / l[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(l[k + 1 :, k], l[k + 1 :, k])
    return l, order


def jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate the columns of ``l`` until all are orthogonal; disjoint pairs turn at the same time."""
    u = np.array(l.T)  # rows are the columns of the factor
    if len(u) % 2:
        u = np.vstack([u, np.zeros(u.shape[1])])
    k = len(u)
    if k < 2:
        return u.T
    ring = np.arange(k)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(k - 1):
            p, q = ring[: k // 2], ring[k // 2 :][::-1]
            x, y = u[p], u[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(xx * yy)
            wrong = np.divide(np.abs(xy), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, wrong.max())
            turn = wrong > 1e-16
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)[:, None]
            s = np.where(turn, t, 0.0)[:, None] * c
            u[p], u[q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst < 1e-15:
            break
    return u.T


def components(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``scatter / n``, falling, and unit components as rows; only those of its rank."""
    l, order = pivoted_cholesky(scatter)
    u = jacobi(l)
    norms = np.sqrt((u * u).sum(0))
    kept = np.argsort(-norms, kind="stable")[: l.shape[1]]
    kept = kept[norms[kept] > 0]
    vectors = np.zeros((len(kept), len(scatter)))
    vectors[:, order] = (u[:, kept] / norms[kept]).T
    return norms[kept] ** 2 / n, vectors


def fit(vectors: DataFrame, most: int) -> dict[int, Fit]:
    """The fit of all vectors of each length. ``vectors`` has ``vector`` with usable entries only."""
    sums = _sums(vectors)
    out = {}
    for d, scatter in _scatter(vectors, sums).items():
        n, ss = sums[d]
        values, rows = components(scatter, n)
        out[d] = Fit(n, ss, rows[:most], values[:most], float(np.trace(scatter)) / n)
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of ``(n x - S)^2`` of each row, exactly; null where it does not fit 64 bits."""
    largest = max(max(abs(n * int(x[:, j].max()) - s), abs(n * int(x[:, j].min()) - s)) for j, s in enumerate(sums))
    if largest**2 * len(sums) <= _MOST and max(n * int(np.abs(x).max()), *(abs(s) for s in sums)) <= _MOST:
        away = x * n - np.array(sums, dtype=np.int64)
        return (away * away).sum(1).tolist()
    exact = (sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v <= _MOST else None for v in exact]


def project(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """``(vec_id, d, deviation, whitened)`` per vector; ``whitened`` has one number per component."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for at, x in _whole(batch):
                f = fits[x.shape[1]]
                whole = np.array([s // f.n for s in f.sums])
                rest = np.array([(s % f.n) / f.n for s in f.sums])
                centred = (x - whole).astype(np.float64) - rest
                out = centred @ f.components.T / np.sqrt(f.eigenvalues)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)), pa.array([x.shape[1]] * len(at), pa.int32()),
                    pa.array(_deviations(x, f.n, f.sums), pa.int64()), pa.array(list(out), pa.list_(pa.float64())),
                ], names=["vec_id", "d", "deviation", "whitened"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, d int, deviation long, whitened array<double>"
    return vectors.select("vec_id", "vector").mapInArrow(run, schema)


def _identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest entry of the whitened rows' own covariance minus the identity, measured on the rows."""
    most = max((len(f.eigenvalues) for f in fits.values()), default=0)
    w = [F.get("whitened", F.lit(i)) for i in range(most)]
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    measured = [F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]
    measured += [F.avg(w[i] * w[j]).alias(f"c{i}_{j}") for i, j in pairs]
    out = {}
    for r in (rows.groupBy("d").agg(*measured).collect() if most else ()):
        k = len(fits[r.d].eigenvalues)
        errors = [abs(r[f"c{i}_{j}"] - r[f"m{i}"] * r[f"m{j}"] - (i == j)) for i, j in pairs if j < k]
        out[r.d] = max(errors, default=0.0)
    return out


def whiten(embeddings: DataFrame, most: int = 8, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    Vectors that are null, hold null or non-finite entries or entries beyond 2^52 are left out; an
    empty vector has no components and so no rows. Vectors of different lengths have no common
    covariance: each length is fitted over its own vectors (``n`` counts those). Components without
    variance (beyond the rank, so all of them when vectors are alike or only one is left) have no
    whitened value and no row. Equal eigenvalues (ties) share their plane in any orthonormal way.
    Repeated rows count and return as often as they occur, null ids too. ``deviation`` is null where
    the exact number passes 64 bits. Other columns are ignored, whatever their names; an empty table
    gives no rows. The driver holds d x d numbers for each length d, nothing that grows with rows.
    """
    named = embeddings.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("vector"))
    vectors = named.where(usable(F.col("vector")))
    fits = fit(vectors, most)
    rows = written(project(vectors, fits), "whitened")
    errors = _identity_errors(rows, fits)
    facts = [
        (d, f.n, [float(v) / f.trace for v in f.eigenvalues], errors[d])
        for d, f in fits.items() if len(f.eigenvalues) and d in errors
    ]
    known = embeddings.sparkSession.createDataFrame(facts, "d int, n long, shares array<double>, identity_error double")
    # one row for each length that occurs
    joined = rows.join(F.broadcast(known), "d")
    each = joined.select("vec_id", "n", "deviation", "identity_error", "shares", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("shares", F.col("i")).alias("explained"), "identity_error",
    )
