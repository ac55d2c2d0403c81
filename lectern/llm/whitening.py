"""Whitening of embeddings by an incremental eigendecomposition.

Vectors are laid on a lattice of whole numbers, so that sums over them are exact. Each task keeps count, sums and the
eigendecomposition of the scatter of its distinct vectors and takes in one vector after the other as a centred rank-one
update: with z the vector in the eigenbasis, the new eigenvalues are the roots of the secular equation
1 + rho * sum z_i^2 / (l_i - t) = 0, after deflation (equal eigenvalues are turned until all but one has z = 0, tiny z_i
leave their eigenpair as it is), and the new eigenvectors follow from z made anew of the roots, which keeps them
orthogonal. The tasks' spectra are combined, FAN at a time, by successive rank-one updates: one for each eigenpair of
the other scatter and one for the distance of the means. A distributed Rayleigh-Ritz refinement on the leading
subspace then works from centred vectors: V Q summed over tasks, the projected problem solved, until the residuals
are at rounding level.

Each distinct vector counts once, so that copies are pre-aggregated away. A task holds one spectrum and a batch; a
spectrum is d x d doubles, the driver sees the last one and d x (components + EXTRA) sums. The vectors of the fit are
written once in the shared folder, as they are read in several passes.

Cases: a null vector, one with null or non-finite entries, and one of another length than the commonest (the shorter in
a tie) are dropped. Repeated rows each get their result; null ids and ties stay. Components whose variance is
nil (fewer distinct vectors than dimensions) have whitened null; there are at most d. deviation is null where it exceeds
64 bits. Other columns pass through; the output columns replace namesakes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.base import materialize

SCALE = 256
COMPONENTS = 4
EXTRA = 8  # more directions in the refinement than are asked for
FAN = 16
PASSES = 30
_EPS = np.finfo(float).eps
_SPECTRUM = "n long, sums array<long>, values array<double>, vectors binary"
_OUT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def lattice(vector: Column) -> Column:
    """floor(SCALE * c) of the entries as longs; null for a null vector or one with null or non-finite entries."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(F.forall(vector, lambda c: sound(c.cast("double"))), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum z2_j / (d_j - t) = 0 for rising, unlike d and positive z2: as the pole each is counted from, and the distance to it."""
    k, rows = len(d), np.arange(len(d))
    top = float(z2.sum())
    gap = np.append(np.diff(d), top)  # the width of each root's interval
    middle = 1 + (z2[None, :] / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    right = (middle < 0) & (rows < k - 1)  # nearer to the next pole
    origin = rows + right
    delta = d[None, :] - d[origin][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where((rows < k - 1) | (middle >= 0), gap / 2, gap))
    low[-1] = gap[-1] / 2 if middle[-1] < 0 else 0.0
    t = (low + high) / 2
    left = rows[None, :] <= rows[:, None]  # the poles up to each root
    open_ = np.ones(k, bool)
    for _ in range(100):
        at = np.flatnonzero(open_)
        off = delta[at] - t[at, None]
        off[off == 0] = _EPS * top
        term = z2[None, :] / off
        psi, phi = np.where(left[at], term, 0), np.where(left[at], 0, term)
        f = 1 + term.sum(1)
        low[at], high[at] = np.where(f < 0, t[at], low[at]), np.where(f < 0, high[at], t[at])
        near = np.abs(f) <= 4 * _EPS * (1 + np.abs(term).sum(1))
        # both sides as one pole each, with their value and slope; then a quadratic for the step
        d0, d1 = off[np.arange(len(at)), at], off[np.arange(len(at)), np.minimum(at + 1, k - 1)]
        slope0, slope1 = (psi / off).sum(1), (phi / off).sum(1)
        c = f - slope0 * d0 - slope1 * d1
        s0, s1 = slope0 * d0 * d0, slope1 * d1 * d1
        a, b = c * (d0 + d1) + s0 + s1, c * d0 * d1 + s0 * d1 + s1 * d0
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(at == k - 1, d0 + s0 / (f - slope0 * d0), step)
        new = t[at] + step
        inside = np.isfinite(new) & (new > low[at]) & (new < high[at])
        new = np.where(near, t[at], np.where(inside, new, (low[at] + high[at]) / 2))
        still = ~near & (np.abs(new - t[at]) > 2 * _EPS * np.abs(new)) & (new != t[at])
        t[at] = new
        open_[at] = still
        if not open_.any():
            break
    return origin, t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and the eigenvectors of vectors diag(values) vectors^T + rho v v^T, for rising values and rho >= 0."""
    z = vectors.T @ v
    norm2 = float(z @ z)
    if not rho * norm2 > 0:
        return values, vectors
    tiny = 8 * _EPS * max(abs(values[0]), abs(values[-1]), rho * norm2)
    vectors = vectors.copy()
    start = 0
    while start < len(values):  # equal eigenvalues: a reflection leaves one z
        end = int(np.searchsorted(values, values[start] + tiny, "right"))
        if end - start > 1:
            own = z[start:end]
            length = float(np.sqrt(own @ own))
            mirror = own.copy()
            mirror[-1] += length if own[-1] >= 0 else -length
            if (size := float(mirror @ mirror)) > 0:
                vectors[:, start:end] -= np.outer(vectors[:, start:end] @ mirror, mirror) * (2 / size)
                z[start : end - 1] = 0
                z[end - 1] = -length if own[-1] >= 0 else length
        start = max(end, start + 1)
    live = np.flatnonzero(rho * np.abs(z) * np.sqrt(norm2) > tiny)
    if not len(live):
        return values, vectors
    d, z2 = values[live], rho * z[live] ** 2
    origin, t = secular(d, z2)
    apart = t[:, None] - (d[None, :] - d[origin][:, None])  # root j - pole i, exactly where they are near
    k, rows = len(live), np.arange(len(live))
    below = rows[:, None] < rows[None, :]
    poles = np.where(below, d[None, :] - d[:, None], np.append(d[1:], 0.0)[:, None] - d[None, :])
    poles[k - 1, :] = np.where(below[k - 1], poles[k - 1], 1.0)
    made = np.sqrt(np.prod(np.abs(apart / poles), axis=0)) * np.sign(z[live])  # z that has exactly these roots
    apart[apart == 0] = _EPS * tiny
    turn = made[None, :] / apart
    turn /= np.sqrt((turn * turn).sum(1))[:, None]
    values = values.copy()
    values[live], vectors[:, live] = d[origin] + t, vectors[:, live] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums and the eigendecomposition of the scatter of the vectors taken in so far."""

    sums: list[int]
    n: int = 0
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.values is None:
            self.values, self.vectors = np.zeros(len(self.sums)), np.eye(len(self.sums))

    def take(self, x: list[int]) -> None:
        if self.n:
            off = np.array([self.n * a - s for a, s in zip(x, self.sums, strict=True)], float) / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n / (self.n + 1))
        self.n, self.sums = self.n + 1, [s + a for a, s in zip(x, self.sums, strict=True)]

    def join(self, other: Spectrum) -> None:
        if self.n and other.n:
            n = self.n + other.n
            off = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)], float)
            for value, vector in [*zip(other.values, other.vectors.T, strict=True), (self.n * other.n / n, off)]:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, max(0.0, float(value)))
        elif other.n:
            self.values, self.vectors = other.values, other.vectors
        self.n, self.sums = self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def table(self) -> pa.Table:
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary())
        cells = (self.n, self.sums, self.values, self.vectors.tobytes())
        return pa.table([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["n", "sums", "values", "vectors"])

    @staticmethod
    def of(row: dict) -> Spectrum:
        d = len(row["sums"])
        return Spectrum(list(row["sums"]), row["n"], np.array(row["values"], float), np.frombuffer(row["vectors"], float).reshape(d, d))


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray  # d x components
    values: np.ndarray  # falling
    trace: float
    identity_error: float


def _matrix(batch: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def spectrum(fit: DataFrame, d: int) -> Spectrum:
    """The combined spectrum of fit (x array<long> of d entries, distinct rows): a spectrum a task, then FAN of them at a time."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum([0] * d)
        for batch in batches:
            for x in _matrix(batch, 0, d):
                own.take(x.tolist())
        if own.n:
            yield from own.table().to_batches()

    def joined(rows: pa.Table) -> pa.Table:
        first, *rest = sorted(map(Spectrum.of, rows.drop_columns("slot").to_pylist()), key=lambda s: (-s.n, s.sums))
        for other in rest:
            first.join(other)
        return first.table()

    held = materialize(fit.select("x").mapInArrow(taken, _SPECTRUM), "spectra")
    left = held.count()
    while left > 1:
        slots = -(-left // FAN)
        held = materialize(held.withColumn("slot", F.pmod(F.xxhash64("n", "sums"), F.lit(slots))).groupBy("slot").applyInArrow(joined, _SPECTRUM), "spectra")
        left = held.count()
    return Spectrum.of(held.first().asDict()) if left else Spectrum([0] * d)


def _products(fit: DataFrame, d: int, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V, the covariance of fit, from centred vectors, summed over the tasks."""
    mean = np.array([s / n for s in sums])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((d, q.shape[1])), 0.0
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                x = _matrix(batch.slice(start, 2000), 0, d) - mean
                total += x.T @ (x @ q)
                squares += float((x * x).sum())
        cells = np.append(total.ravel(), squares)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    rows = fit.select("x").mapInArrow(part, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()
    cells = np.array([r["value"] for r in rows]) / n
    return cells[:-1].reshape(d, q.shape[1]), float(cells[-1])


def refine(fit: DataFrame, start: Spectrum, components: int = COMPONENTS) -> Whitening:
    """Rayleigh-Ritz on the leading directions of `start`: each pass turns them by the projected covariance and measures what the pass before found."""
    d, n = len(start.sums), start.n
    k = min(components, d)
    q = np.linalg.qr(start.vectors[:, ::-1][:, : min(d, k + EXTRA)])[0]
    values = None
    for _ in range(PASSES):
        product, trace = _products(fit, d, n, start.sums, q)
        projected = q.T @ product
        projected = (projected + projected.T) / 2
        if values is not None:
            residual = np.abs(product[:, :k] - q[:, :k] * values[:k]).max()
            if residual <= 64 * _EPS * max(trace, 1e-300):
                break
            if residual > 1e-10 * max(trace, 1e-300):  # not yet invariant: go on with V q
                q = np.linalg.qr(product)[0]
                product, trace = _products(fit, d, n, start.sums, q)
                projected = (q.T @ product + product.T @ q) / 2
        found, turn = np.linalg.eigh(projected)
        values, q = found[::-1], np.linalg.qr(q @ turn[:, ::-1])[0]
    live = values[:k] > 1e-12 * max(trace, 1e-300)
    scale = np.sqrt(np.where(live, values[:k], 1.0))
    off = np.abs(projected[:k, :k] / np.outer(scale, scale) - np.eye(k))[np.ix_(live, live)]
    return Whitening(n, start.sums, q[:, :k], np.where(live, values[:k], 0.0), trace, float(off.max()) if live.any() else 0.0)


def fit_whitening(df: DataFrame, column: str, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of an array<long> column; None without any."""
    sound = df.select(F.col(column).alias("x")).where("x is not null and size(x) > 0")
    lengths = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    fit = materialize(sound.where(F.size("x") == lengths["d"]).distinct(), "whitening-fit")
    return refine(fit, spectrum(fit, lengths["d"]), components)


def whiten(df: DataFrame, column: str, known: Whitening | None) -> DataFrame:
    """df, a row per component, with component, n, deviation, whitened, explained and identity_error; rows whose vector doesn't fit are dropped."""
    df = df.drop(*(c for c in _OUT if c != column))
    made_spec = StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")
    spec = StructType([f for f in df.schema.fields if f.name != column] + made_spec.fields)
    names, at = df.columns, df.columns.index(column)
    d = len(known.sums) if known else 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = known.vectors.shape[1]
        mean, sums = np.array([s / known.n for s in known.sums]), np.array(known.sums, float)
        scale = np.sqrt(np.where(known.values > 0, known.values, np.nan))
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                x = _matrix(part, at, d)
                rough = known.n * x.astype(float) - sums
                fits = ((rough * rough).sum(1) < 2.0**62) & (np.abs(known.n * x.astype(float)).max(1) < 2.0**62)
                exact = known.n * np.where(fits[:, None], x, 0) - np.array([s if abs(s) < 2**62 else 0 for s in known.sums])
                deviation = np.where(fits, (exact * exact * fits[:, None]).sum(1), 0)
                white = ((x - mean) @ known.vectors) / scale
                again = np.repeat(np.arange(part.num_rows), k)
                made = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(len(again), known.n)), pa.array(deviation[again], mask=~fits[again]),
                    pa.array(white.ravel(), mask=np.isnan(white.ravel())), pa.array(np.tile(known.values / max(known.trace, 1e-300), part.num_rows)), pa.array(np.full(len(again), known.identity_error)),
                ]
                kept = [c.take(pa.array(again)) for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, *made], [n for n in names if n != column] + _OUT)

    return df.where(F.size(column) == d if d else F.lit(False)).mapInArrow(rows, spec)
