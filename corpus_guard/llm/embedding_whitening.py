"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

1. One pass counts the vectors and sums their whole-number entries exactly.
2. Every further pass computes V Q for a block Q of columns without forming V: tasks centre their
   rows, (n x - S) / n from exact integers, and return X'(X Q) of d rows, which Spark sums with
   map-side combine. Only blocks of d x ``BLOCK`` numbers reach the driver and travel back; no vector does.
3. A polynomial of V by the three-term Chebyshev recurrence, one pass a degree, damps all eigenvalues under
   the smallest Ritz value of the block; then QR and a Rayleigh-Ritz step give new Ritz pairs.
4. Pairs are certified by their residuals, |V u - e u| <= ``TOLERANCE`` x the largest eigenvalue, checked by one
   more pass over the vectors. Rounding may hold residuals up: they are accepted up to ``FLOOR`` when a round no longer
   halves them; without a certificate after ``ROUNDS`` rounds the fit raises instead of returning anything.
5. Rows are projected and scaled, and one pass measures how far the covariance of the result is from the identity.

Vectors of different lengths have no common covariance: each length is a fit of its own, with its own n,
and all are fitted in the same passes. The driver holds d x BLOCK numbers for each length.

Defined results: null vectors and those with null or non-finite entries give no row; entries beyond the range of a long
are held at its end; repeated rows count as often as they occur and each gives its rows; a component
whose eigenvalue is no more than ``RANK`` of the trace has no scale and is left out, so equal vectors,
a single one, empty ones and an empty table give no rows; ``deviation`` is null where it does not fit a long, ``deviation_exact`` has
it as a decimal of 38 digits (null beyond); null ids stay; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS, BLOCK, DEGREE, ROUNDS = 8, 32, 8, 60
TOLERANCE, FLOOR, RANK = 2e-14, 1e-11, 1e-13
SCALE, OFFSET = 1024.0, 100_000
#: Largest entry that a long holds.
_TOP = float((1 << 63) - 1024)
#: Rows of a block of a task's matrices.
ROWS = 8192


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: np.ndarray  # Python integers
    top: int
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    identity_error: float = 0.0


def whole_numbers(c: np.ndarray, scale: float, offset: int) -> np.ndarray:
    """floor(scale c) + offset as longs."""
    return np.clip(np.floor(scale * c), -_TOP, _TOP - offset).astype(np.int64) + offset


def valid_rows(column: pa.Array, scale: float, offset: int):
    """(row numbers, whole-number matrix) for each length among the valid vectors of an Arrow list column."""
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    for d in np.unique(lengths[lengths > 0]):
        all_rows = np.flatnonzero(lengths == d)
        for i in range(0, len(all_rows), ROWS):
            rows = all_rows[i : i + ROWS]
            x = values[starts[rows][:, None] + np.arange(d)]
            good = np.isfinite(x).all(axis=1)
            if good.any():
                yield int(d), rows[good], whole_numbers(x[good], scale, offset)


def deviations(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n x - S: longs where they fit, Python integers otherwise."""
    if max(fit.top, int(np.abs(x).max(initial=0))) * 2 * fit.n < 1 << 62:
        return x * np.int64(fit.n) - fit.sums.astype(np.int64)
    return x.astype(object) * fit.n - fit.sums


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    return deviations(x, fit).astype(np.float64) / fit.n


def squares(y: np.ndarray) -> list[int]:
    """The exact sums of squares of the rows."""
    if y.dtype == object:
        return [int(v) for v in (y * y).sum(axis=1)]
    high = y >> 31
    low = y - (high << 31)
    if int(np.abs(high).max(initial=0)) < 1 << 24 and y.shape[1] < 1 << 12:
        a, b = (high * high).sum(axis=1), (high * low).sum(axis=1)
        c1, c0 = ((low * low) >> 32).sum(axis=1), ((low * low) & 0xFFFFFFFF).sum(axis=1)
        return [(p << 62) + (q << 32) + (r << 32) + s for p, q, r, s in zip(a.tolist(), b.tolist(), c1.tolist(), c0.tolist())]
    return [sum(v * v for v in row) for row in y.tolist()]



def _count(scale: float, offset: int):
    def count(batches):
        seen: dict[int, list] = {}
        for batch in batches:
            for d, _, x in valid_rows(batch.column(0), scale, offset):
                top = int(np.abs(x).max())
                total = x.sum(axis=0) if top < 1 << 48 else x.astype(object).sum(axis=0)
                held = seen.setdefault(d, [0, np.zeros(d, object), 0])
                held[0] += len(x)
                held[1] = held[1] + total.astype(object)
                held[2] = max(held[2], top)
        for d, (n, total, top) in seen.items():
            yield pa.RecordBatch.from_pydict(
                {"d": [d] * (d + 2), "at": list(range(d + 2)), "value": [Decimal(int(v)) for v in [*total, n, top]]},
                pa.schema([("d", pa.int32()), ("at", pa.int32()), ("value", pa.decimal128(38, 0))]),
            )

    return count


def start(vectors: DataFrame, scale: float, offset: int) -> dict[int, Fit]:
    """Vectors of each length counted and summed."""
    parts = vectors.mapInArrow(_count(scale, offset), "d int, at int, value decimal(38,0)")
    kept = F.when(F.col("at") == F.col("d") + 1, F.max("value")).otherwise(F.sum("value"))
    found: dict[int, dict] = {}
    for r in parts.groupBy("d", "at").agg(kept.cast("decimal(38,0)").alias("value")).toLocalIterator():
        found.setdefault(r.d, {})[r["at"]] = int(r.value)
    return {d: Fit(v[d], np.array([v[i] for i in range(d)], object), v[d + 1]) for d, v in found.items()}


def _summed(vectors: DataFrame, fits: dict[int, Fit], work, scale: float, offset: int) -> dict[int, np.ndarray]:
    """The sum over all tasks of the matrix work(d, centred rows), flat, for each length."""

    def block(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in valid_rows(batch.column(0), scale, offset):
                if d in fits:
                    part = work(d, centred(x, fits[d]))
                    held[d] = held[d] + part if d in held else part
        for d, total in held.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["d", "at", "value"])

    summed = vectors.mapInArrow(block, "d int, at int, value double").groupBy("d", "at").agg(F.sum("value").alias("value"))
    found = summed.toPandas().sort_values(["d", "at"])
    return {int(d): g.value.to_numpy() for d, g in found.groupby("d")}


def covariance_times(vectors: DataFrame, fits: dict[int, Fit], blocks: dict[int, np.ndarray], scale: float, offset: int) -> dict[int, np.ndarray]:
    """V Q for the block Q of each length, one pass over the vectors."""
    got = _summed(vectors, {d: fits[d] for d in blocks}, lambda d, x: x.T @ (x @ blocks[d]), scale, offset)
    return {d: v.reshape(blocks[d].shape) / fits[d].n for d, v in got.items()}


def _filtered(multiply, blocks, images, bounds, degree):
    """Chebyshev polynomials of V on all blocks; images are V X, already known; bounds: (damped up to, largest Ritz value)."""
    before, now, sigma = dict(blocks), {}, {}
    for d, x in blocks.items():
        half, high = bounds[d][0] / 2, bounds[d][1]
        sigma[d] = half / (high - half)
        now[d] = (images[d] - half * x) * (sigma[d] / half)
    first = dict(sigma)
    for _ in range(degree - 1):
        image = multiply(now)
        for d in blocks:
            half = bounds[d][0] / 2
            further = 1 / (2 / first[d] - sigma[d])
            new = (image[d] - half * now[d]) * (2 * further / half) - sigma[d] * further * before[d]
            before[d], now[d], sigma[d] = now[d], new, further
    return now


def solve(vectors: DataFrame, fits: dict[int, Fit], components: int, block: int, degree: int, rounds: int, scale: float, offset: int) -> None:
    """Set the leading eigenpairs of each fit; raises when they cannot be certified."""
    multiply = lambda b: covariance_times(vectors, fits, b, scale, offset)
    random = np.random.default_rng(11)
    q = {d: np.linalg.qr(random.normal(size=(d, min(d, max(block, components)))))[0] for d in fits}
    last: dict[int, float] = {}
    for _ in range(rounds):
        images = multiply(q)
        x, vx, bounds = {}, {}, {}
        for d in list(q):
            h = q[d].T @ images[d]
            values, turn = np.linalg.eigh((h + h.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            u, vu = q[d] @ turn, images[d] @ turn
            wanted = [i for i in range(min(components, d)) if values[i] > RANK * fits[d].trace]
            residual = max((float(np.linalg.norm(vu[:, i] - values[i] * u[:, i])) for i in wanted), default=0.0)
            limit = max(values[0], 0.0)
            whole = u.shape[1] == d
            if residual <= TOLERANCE * limit or (residual <= FLOOR * limit and residual > last.get(d, np.inf) / 2) or (whole and residual <= FLOOR * limit):
                fits[d].values, fits[d].vectors = values[: len(wanted)], u[:, : len(wanted)]
                continue
            last[d] = residual
            x[d], vx[d], bounds[d] = u, vu, (max(values[-1], values[0] * 1e-6), values[0])
        if not x:
            return
        out = _filtered(multiply, x, vx, bounds, degree)
        q = {d: np.linalg.qr(y)[0] for d, y in out.items()}
    raise RuntimeError(f"eigenvectors not certified after {rounds} rounds: residuals {last}")


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, rounds: int = ROUNDS,
    scale: float = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """One row per valid vector and component: id, component, n, deviation, whitened, explained, identity_error, eigenvalue, deviation_exact."""
    vectors = rows.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("vector"))
    fits = start(vectors, scale, offset)
    for d, v in _summed(vectors, fits, lambda d, x: np.array([(x * x).sum()]), scale, offset).items():
        fits[d].trace = float(v[0]) / fits[d].n
    fits = {d: f for d, f in fits.items() if f.trace > 0}
    if fits:
        solve(vectors, fits, components, block, degree, rounds, scale, offset)

    def project(d: int, x: np.ndarray) -> np.ndarray:
        return x @ fits[d].vectors / np.sqrt(fits[d].values)

    def gram(d: int, x: np.ndarray) -> np.ndarray:
        w = project(d, x)
        k = w.shape[1]
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)]) if k else np.zeros(1)

    if fits:
        for d, v in _summed(vectors, fits, gram, scale, offset).items():
            k, n = len(fits[d].values), fits[d].n
            mean = v[k * k :] / n
            fits[d].identity_error = float(np.abs(v[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))

    names = ["component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "deviation_exact"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.decimal128(38, 0)]

    def give(batches):
        for batch in batches:
            for d, at, x in valid_rows(batch.column(1), scale, offset):
                fit = fits.get(d)
                k = 0 if fit is None else len(fit.values)
                if not k:
                    continue
                y = deviations(x, fit)
                exact = squares(y)
                w = project(d, y.astype(np.float64) / fit.n)
                each = lambda v: np.repeat(v, k)
                fits_long = [v if v < 1 << 63 else None for v in exact]
                fits_decimal = [Decimal(v) if v < 10**38 else None for v in exact]
                take = pa.array(each(np.arange(len(at))))
                columns = [
                    np.tile(np.arange(1, k + 1), len(at)), np.full(len(at) * k, fit.n), pa.array(fits_long, pa.int64()).take(take), w.ravel(), np.tile(fit.values / fit.trace, len(at)),
                    np.full(len(at) * k, fit.identity_error), np.tile(fit.values, len(at)), pa.array(fits_decimal, pa.decimal128(38, 0)).take(take),
                ]
                ids = batch.column(0).take(pa.array(at)).take(take)
                yield pa.RecordBatch.from_arrays([ids, *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds))], [id_col, *names])

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType)])
    for name, kind in zip(names, [T.IntegerType(), T.LongType(), T.LongType(), *[T.DoubleType()] * 4, T.DecimalType(38, 0)]):
        schema = schema.add(name, kind)
    return rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("_vector")).mapInArrow(give, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
