"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the eigenvalues and eigenvectors of the scatter of the vectors it has seen. A vector, centred on
the running mean, is a rank-one update: deflation takes out directions and equal eigenvalues that it does not touch, the
roots of the secular equation are the new eigenvalues, and the eigenvectors follow from them. Two spectra are combined
in the same way, by one update for the distance of the means and one for each eigenpair of the other; Spark combines
them in a tree of groups of ``FAN_IN``. The merged basis is then refined by a distributed Rayleigh-Ritz step: the
covariance, projected on the basis, is summed over all rows and its small eigenproblem solved. Whitened values and their
covariance, which shows how far from the identity they are, come from further passes over all rows.

What travels is a spectrum per partition, of d x d numbers; rows never move. Sums of the long vectors are exact.

Rows whose vector is null or holds null or non-finite entries are dropped; null, repeated and extreme ids are kept as
rows. Shorter vectors are filled up with zeros to the longest. Entries beyond 2^42 in size are held there. ``deviation``
is null where it does not fit a long. A component without variance has whitened null and explained 0 (null if there is
no variance at all), and is left out of identity_error, which is null if no component is left. Without rows, or with
vectors without entries, the result is empty. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import stored

#: x = floor(SCALE * c) + SHIFT; components returned; spectra combined by one task.
SCALE, SHIFT, COMPONENTS, FAN_IN = 1024, 100_000, 8, 16
#: Updates after which rounding in the eigenvectors is taken out.
REORTHOGONAL = 512
_LIMIT = float(1 << 42)
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """``d[i] - root[k]`` for the roots of 1 + sum z2 / (d - root) = 0, with d ascending and distinct and z2 positive.

    Every root lies between two poles (the last one above all) and is kept as a distance from the nearer of them, so no
    digits are lost. All are found together by interpolating with the two neighbouring poles, bracketed by bisection.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + 2 * z2.sum())
    middle = (d + upper) / 2
    at_middle = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    left = (at_middle > 0) | (np.arange(n) == n - 1)
    origin = np.where(left, d, upper)
    delta = d[None, :] - origin[:, None]
    a, b = d - origin, upper - origin
    half = middle - origin
    low, high = np.where(at_middle > 0, a, half), np.where(at_middle > 0, half, b)
    x = (low + high) / 2
    below = np.tri(n, dtype=bool)
    for _ in range(80):
        gap = delta - x[:, None]
        part = z2 / gap
        f = 1 + part.sum(axis=1)
        slope = part / gap
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        done = np.abs(f) <= n * _EPS * (1 + np.abs(part).sum(axis=1))
        done |= high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        psi = np.where(below, slope, 0).sum(axis=1)
        phi = slope.sum(axis=1) - psi
        da, db = a - x, b - x
        p = (da + db) * f - da * db * (psi + phi)
        q = da * db * f
        r = f - da * psi - db * phi
        root = np.sqrt(np.maximum(p * p - 4 * q * r, 0))
        with np.errstate(all="ignore"):
            step = x + np.where(p <= 0, (p - root) / (2 * r), 2 * q / (p + root))
        x = np.where(done, x, np.where((step > low) & (step < high), step, (low + high) / 2))
    return (delta - x[:, None]).T


@dataclass
class Spectrum:
    """Count, exact sums, and eigenvalues (ascending) and eigenvectors (columns) of the scatter of the vectors seen."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    updates: int = 0

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d, np.int64), np.zeros(d), np.eye(d))

    def _deflated(self, z: np.ndarray) -> np.ndarray:
        """Turns the basis of equal eigenvalues so that one direction takes all of ``z``; the entries that stay."""
        tolerance = 8 * _EPS * max(self.values[-1], z @ z)
        breaks = np.flatnonzero(np.append(True, np.diff(self.values) > tolerance))
        if len(breaks) < len(z):
            for lo, hi in zip(breaks, np.append(breaks[1:], len(z))):
                norm = np.linalg.norm(z[lo:hi])
                if hi - lo > 1 and norm > 0:
                    mirror = z[lo:hi].copy()
                    sign = 1.0 if mirror[-1] >= 0 else -1.0
                    mirror[-1] += sign * norm
                    block = self.vectors[:, lo:hi]
                    block -= np.outer(block @ mirror, mirror * (2 / (mirror @ mirror)))
                    z[lo:hi] = 0
                    z[hi - 1] = -sign * norm
        return np.flatnonzero(np.abs(z) * np.linalg.norm(z) > tolerance)

    def add(self, v: np.ndarray) -> None:
        """Rank-one update of the scatter by ``v v'``."""
        z = self.vectors.T @ v
        live = self._deflated(z)
        if not len(live):
            return
        d, z = self.values[live], z[live]
        gap = secular_roots(d, z * z)
        # the vector whose update has exactly these roots, so that eigenvectors are orthogonal to working precision
        between = d[None, :] - d[:, None]
        np.fill_diagonal(between, 1)
        exact = np.copysign(np.sqrt(np.abs(np.prod(-gap / between, axis=1))), z)
        turn = exact[:, None] / gap
        turn /= np.linalg.norm(turn, axis=0)
        self.vectors[:, live] = self.vectors[:, live] @ turn
        self.values[live] = d - np.diagonal(gap)
        order = np.argsort(self.values, kind="stable")
        if (order[1:] < order[:-1]).any():
            self.values, self.vectors = self.values[order], self.vectors[:, order]
        self.updates += 1
        if self.updates % REORTHOGONAL == 0:
            self.vectors = orthogonal(self.vectors)

    def add_row(self, x: np.ndarray) -> None:
        if self.n:
            self.add((self.n * x - self.sums) / self.n * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.sums = self.sums + x

    def merge(self, other: Spectrum) -> None:
        if self.n and other.n:
            self.add((other.sums / other.n - self.sums / self.n) * np.sqrt(self.n / (self.n + other.n) * other.n))
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.add(np.sqrt(value) * vector)
        self.n, self.sums = self.n + other.n, self.sums + other.sums


def orthogonal(vectors: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(vectors)
    return q * np.where(np.diagonal(r) < 0, -1.0, 1.0)


def long_vectors(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an array column as long vectors of ``d`` entries."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not (sizes == d).all():
        full = np.zeros((len(sizes), d))
        full[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        flat = full
    return np.clip(np.floor(SCALE * flat.reshape(-1, d)), -_LIMIT, _LIMIT).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from the exact difference n * x - sums where that fits."""
    rough = x - sums / n
    return np.where(np.abs(rough) * n < 2.0**62, (n * x - sums) / n, rough)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum of (n * x - sums)^2 per row; None where it does not fit a long."""
    rough = ((x - sums / n) * n) ** 2
    whole = n * x - sums
    exact = (whole * whole).sum(axis=1)
    return [int(e) if r < 2.0**62 else _in_long(row, n, sums) for e, r, row in zip(exact, rough.sum(axis=1), x)]


def _in_long(row: np.ndarray, n: int, sums: np.ndarray) -> int | None:
    total = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
    return total if total < 1 << 63 else None


_SPECTRA = "part long, n long, sums binary, vals binary, vecs binary"
_NAMES = ["part", "n", "sums", "vals", "vecs"]


def _packed(part: int, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([s.n]), *[pa.array([a.tobytes()], pa.binary()) for a in (s.sums, s.values, s.vectors)]], _NAMES)


def _unpacked(row: dict) -> Spectrum:
    sums, values = np.frombuffer(row["sums"], np.int64), np.frombuffer(row["vals"]).copy()
    return Spectrum(row["n"], sums, values, np.frombuffer(row["vecs"]).reshape(len(values), -1).copy())


def _partition_spectrum(d: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectrum = Spectrum.empty(d)
        for batch in batches:
            for x in long_vectors(batch.column("embedding"), d):
                spectrum.add_row(x)
        if spectrum.n:
            yield _packed(TaskContext.get().partitionId(), spectrum)

    return fit


def _combined(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = _unpacked(rows[0])
    for row in rows[1:]:
        total.merge(_unpacked(row))
    return pa.Table.from_batches([_packed(rows[0]["part"], total)])


def fitted_spectrum(vectors: DataFrame, d: int) -> Spectrum:
    """Spectrum of all rows: one per partition, combined in a tree."""
    spectra = stored(vectors.select("embedding").mapInArrow(_partition_spectrum(d), _SPECTRA), "spectra")
    width = FAN_IN
    while spectra.limit(2).count() > 1:
        spectra = stored(spectra.groupBy(F.floor(F.col("part") / width)).applyInArrow(_combined, _SPECTRA), "spectra")
        width *= FAN_IN
    first = spectra.first()
    return _unpacked(first.asDict()) if first else Spectrum.empty(d)


@dataclass
class Whitener:
    """n and sums of the fit list, components as columns (by falling eigenvalue), their eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def _projected_sums(n: int, sums: np.ndarray, basis: np.ndarray):
    d = len(sums)
    i, j = np.triu_indices(basis.shape[1])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            y = centred(long_vectors(batch.column("embedding"), d), n, sums) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return project


def fit(vectors: DataFrame) -> Whitener | None:
    """Components of usable rows (vec_id, embedding): the merged incremental basis after a Rayleigh-Ritz step."""
    d = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if not d:
        return None
    spectrum = fitted_spectrum(vectors, d)
    basis = orthogonal(spectrum.vectors)
    sums = vectors.select("embedding").mapInArrow(_projected_sums(spectrum.n, spectrum.sums, basis), "i int, j int, v double")
    small = np.zeros((d, d))
    for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d x d numbers, however many rows
        small[r.i, r.j] = small[r.j, r.i] = r.v / spectrum.n
    values, turn = np.linalg.eigh(small)
    trace = float(np.trace(small))
    values = np.where(values > d * _EPS * max(trace, 0), values, 0.0)
    return Whitener(spectrum.n, spectrum.sums, (basis @ turn)[:, ::-1], values[::-1], trace)


def _whitened(w: Whitener, k: int):
    d, used = len(w.sums), w.values[:k] > 0
    scale = np.where(used, 1 / np.sqrt(np.where(used, w.values[:k], 1)), np.nan)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = long_vectors(batch.column("embedding"), d)
            y = centred(x, w.n, w.sums) @ w.components[:, :k] * scale
            flat = pa.array(y.ravel(), from_pandas=True)  # nan: no variance
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(x, w.n, w.sums), pa.int64()), lists], ["vec_id", "deviation", "values"])

    return whiten


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.coalesce(fine, F.lit(False)))


def whitening(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable row of ``vectors``
    (vec_id, embedding) and component."""
    rows = usable(vectors)
    made = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], made)
    k = min(components, len(fitted.sums))
    white = stored(rows.mapInArrow(_whitened(fitted, k), "vec_id long, deviation long, values array<double>"), "whitened")
    used = [i for i in range(k) if fitted.values[i] > 0]
    error = F.lit(None).cast("double")
    if used:
        cells = [F.abs(F.covar_pop(F.col("values")[i], F.col("values")[j]) - int(i == j)) for i in used for j in used if i <= j]
        error = F.lit(white.agg(F.greatest(*cells, F.lit(0.0))).first()[0])
    explained = F.array(*[F.lit(float(v / fitted.trace) if fitted.trace > 0 else None).cast("double") for v in fitted.values[:k]])
    out = white.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), error.alias("identity_error"),
    )
