"""Whitened embeddings: covariances from variances of sums (polarisation), principal components, projections.

An entry ``c`` becomes the integer ``x = floor(scale * c) + offset``. With ``u = x - m``, ``m`` the integer next to the
mean of the dimension, the squares of ``u_i`` and of every pair sum ``u_i + u_j`` are added up as integers, and
``n * sum(u ** 2) - sum(u) ** 2`` is n times the sum of squares about the exact mean. So every variance is exact, and

    2 * cov(i, j) = var(x_i + x_j) - var(x_i) - var(x_j)

is one division of integers, rounded once. ``eigh`` of these gives the components.

Passes over the table: n and the sums S; the squares; the covariance of the whitened rows (for ``identity_error``); the
rows themselves. Tasks return sums only, at most ``d * (d + 1) / 2`` whole numbers each, cut into limbs of 30 bits that
Spark adds up as longs, so that no total overflows. The driver holds ``d ** 2`` numbers and no row. Integers that do not
fit 64 bits within a batch are added up as Python's.

Rows: vectors that are null, empty, or hold null or non-finite entries are dropped, and those shorter than the longest
of the rest, whose missing entries count as null. Repeated rows count each. A null id stays null. An empty table gives no
rows. Components whose eigenvalue is zero to rounding (at most ``d`` times the machine precision of the largest) have
``whitened`` null and do not count in ``identity_error``; ``explained`` is null if no dimension varies. Other columns
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMB = 30
#: Rows that are worked on at once.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """``components`` bounds the components returned."""

    components: int = 32
    scale: int = 64
    offset: int = 1_000_000


@dataclass(frozen=True)
class Model:
    """n, sums and covariance matrix over the fit list; eigenvalues (falling) and components (columns) of the latter."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    rank: int
    trace: float

    @property
    def centre(self) -> list[int]:
        """The integers next to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]


def integers(c: np.ndarray, how: Whitening) -> np.ndarray:
    """floor(scale * c) + offset, as 64-bit integers, or as Python's where these are too small."""
    most = float(np.abs(c).max(initial=0.0)) * how.scale
    if most < 2.0**52 and abs(how.offset) < 2**52:
        return np.floor(c * how.scale).astype(np.int64) + how.offset
    whole = np.floor(c)
    rest = np.floor((c - whole) * how.scale).astype(np.int64)  # 0 where an entry is so large that it has no fraction
    out = np.empty(c.shape, object)
    out.flat = [int(w) * how.scale + int(r) + how.offset for w, r in zip(whole.flat, rest.flat, strict=True)]
    return out


def _bits(x: np.ndarray) -> int:
    return max((int(abs(v)).bit_length() for v in (x.max(), x.min())), default=0) if x.size else 0


def exact_total(x: np.ndarray) -> list[int]:
    """Column sums."""
    if x.dtype != object and _bits(x) + len(x).bit_length() > 62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)] if len(x) else [0] * x.shape[1]


def exact_squares(x: np.ndarray) -> list[int]:
    """Column sums of squares."""
    if x.dtype != object and 2 * _bits(x) + len(x).bit_length() > 62:
        x = x.astype(object)
    return [int(v) for v in ((x * x).sum(axis=0) if x.dtype == object else np.einsum("ij,ij->j", x, x))] if len(x) else [0] * x.shape[1]


def _vectors(column: pa.Array, length: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and entries of the usable vectors of a batch, by length (or of the one length), in runs of ROWS."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(math.nan))
    ends = np.cumsum(sizes)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
    for size in [length] if length is not None else np.unique(sizes[usable]):
        places = np.flatnonzero(usable & (sizes == size))
        for i in range(0, len(places), ROWS):
            some = places[i : i + ROWS]
            yield some, flat[(ends[some] - size)[:, None] + np.arange(size)]


def limbs_of(total: int) -> list[int]:
    """A whole number in base 2 ** LIMB, the sign with every digit."""
    sign, total, out = (-1 if total < 0 else 1), abs(total), []
    while total:
        out.append(sign * (total & ((1 << LIMB) - 1)))
        total >>= LIMB
    return out


def _sums_frame(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    rows = [(a, b, k, v) for (a, b), total in totals.items() for k, v in enumerate(limbs_of(total)) if v]
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "limb", "v"])


def _collect_totals(partial: DataFrame) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("a", "b", "limb").agg(F.sum("v").alias("v")).collect():
        out[r.a, r.b] = out.get((r.a, r.b), 0) + (r.v << (LIMB * r.limb))
    return out


_SUMS = "a long, b long, limb long, v long"


def _entries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))


def fit_sums(vectors: DataFrame, how: Whitening) -> tuple[int, list[int]]:
    """Size of the fit list and sums of its dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, c in _vectors(batch.column("embedding"), None):
                d = c.shape[1]
                totals[d, -1] = totals.get((d, -1), 0) + len(c)
                for i, s in enumerate(exact_total(integers(c, how))):
                    totals[d, i] = totals.get((d, i), 0) + s
        yield _sums_frame(totals)

    totals = _collect_totals(_entries(vectors).mapInArrow(run, _SUMS))
    d = max((length for length, _ in totals), default=0)
    return totals.get((d, -1), 0), [totals.get((d, i), 0) for i in range(d)]


def centred(c: np.ndarray, centre: list[int], how: Whitening) -> np.ndarray:
    """Integers less the integer next to their dimension's mean."""
    x = integers(c, how)
    if x.dtype == object or any(abs(m) > 2**61 for m in centre):
        x = x.astype(object)
    return x - np.array(centre, x.dtype)


def fit_squares(vectors: DataFrame, n: int, centre: list[int], how: Whitening) -> dict[tuple[int, int], int]:
    """Sums of ``u_i ** 2`` at (i, i) and of ``(u_i + u_j) ** 2`` at (i, j), and of ``u_i`` at (i, -1)."""
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}

        def add(key: tuple[int, int], value: int) -> None:
            totals[key] = totals.get(key, 0) + value

        for batch in batches:
            for _, c in _vectors(batch.column("embedding"), d):
                u = centred(c, centre, how)
                for i, s in enumerate(exact_total(u)):
                    add((i, -1), s)
                for i, s in enumerate(exact_squares(u)):
                    add((i, i), s)
                for i in range(d - 1):
                    for k, s in enumerate(exact_squares(u[:, i : i + 1] + u[:, i + 1 :])):
                        add((i, i + 1 + k), s)
        yield _sums_frame(totals)

    return _collect_totals(_entries(vectors).mapInArrow(run, _SUMS))


def covariance_of(n: int, d: int, squares: dict[tuple[int, int], int]) -> tuple[np.ndarray, float]:
    """The covariance matrix, divisor n, and its trace, each entry rounded once from whole numbers."""
    first = [squares.get((i, -1), 0) for i in range(d)]
    spread = {(i, i): n * squares.get((i, i), 0) - first[i] ** 2 for i in range(d)}  # n ** 2 times the variance
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = spread[i, i] / n**2
        for j in range(i + 1, d):
            of_sum = n * squares.get((i, j), 0) - (first[i] + first[j]) ** 2
            out[i, j] = out[j, i] = (of_sum - spread[i, i] - spread[j, j]) / (2 * n**2)
    return out, sum(spread.values()) / n**2


def fit(vectors: DataFrame, how: Whitening = Whitening()) -> Model | None:
    """The model of a table with a column ``embedding``; None if no vector is usable."""
    n, sums = fit_sums(vectors, how)
    if not n:
        return None
    d = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    covariance, trace = covariance_of(n, d, fit_squares(vectors, n, centre, how))
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components[:, ::-1]
    rank = int(np.count_nonzero(values > max(values[0], 0) * d * np.finfo(float).eps))
    return Model(n, sums, covariance, values, components, rank, trace)


def _deviations(u: np.ndarray, model: Model) -> list[Decimal | None]:
    """The sums over dimensions of (n * x - S) ** 2; null with more than 38 digits."""
    rest = [s - model.n * m for s, m in zip(model.sums, model.centre, strict=True)]
    if u.dtype != object and 2 * (_bits(u) + 1 + model.n.bit_length()) + u.shape[1].bit_length() <= 62:
        y = u * model.n - np.array(rest, np.int64)
        return [Decimal(int(v)) for v in np.einsum("ij,ij->i", y, y)]
    y = u.astype(object) * model.n - np.array(rest, object)
    return [Decimal(v) if v < 10**38 else None for v in (y * y).sum(axis=1)]


def _projector(model: Model, how: Whitening):
    kept = min(how.components, model.rank)
    weights = model.vectors[:, :kept] / np.sqrt(model.values[:kept])
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, model.centre, strict=True)])
    return lambda u: (u.astype(float) - rest) @ weights


def identity_error(vectors: DataFrame, model: Model, how: Whitening = Whitening()) -> float | None:
    """The largest entry, without sign, of the whitened rows' covariance less the identity, measured over all rows."""
    project, centre, kept = _projector(model, how), model.centre, min(how.components, model.rank)
    if not kept:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept))
        for batch in batches:
            for _, c in _vectors(batch.column("embedding"), len(centre)):
                w = project(centred(c, centre, how))
                total[:kept] += w.T @ w
                total[kept] += w.sum(axis=0)
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["a", "b", "v"])

    found = np.zeros((kept + 1, kept))
    for r in _entries(vectors).mapInArrow(run, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
        found[r.a, r.b] = r.v / model.n
    return float(np.abs(found[:kept] - np.outer(found[kept], found[kept]) - np.eye(kept)).max())


def project(vectors: DataFrame, model: Model, how: Whitening = Whitening()) -> DataFrame:
    """Per usable vector: ``vec_id``, ``deviation`` decimal(38,0), ``whitened`` array of doubles by component."""
    to, centre = _projector(model, how), model.centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, c in _vectors(batch.column("embedding"), len(centre)):
                u = centred(c, centre, how)
                w = to(u)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(places)), pa.array(_deviations(u, model), pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    entries = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return entries.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, how: Whitening = Whitening()) -> DataFrame:
    """Per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, how)
    if model is None:
        empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty)
    shown = min(how.components, len(model.sums))
    shares = F.lit([float(v) / model.trace if model.trace else None for v in np.maximum(model.values[:shown], 0)]).cast("array<double>")
    rows = project(vectors, model, how).withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(shown))))
    error = F.lit(identity_error(vectors, model, how)).cast("double")
    return rows.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", F.get("whitened", F.col("component") - 1).alias("whitened"),
        F.get(shares, F.col("component") - 1).alias("explained"), error.alias("identity_error"),
    )
