"""Embedding whitening by incremental eigendecomposition.

1. One pass sums the integer vectors exactly: their number n and sums S, so the mean S / n.
2. Every partition keeps the eigenvalues and eigenvectors of the scatter of its rows, centred by that mean. A row v changes
   them by a rank-one update: in the present eigenbasis the new matrix is diag(d) + z z', whose eigenvalues are the roots
   of the secular equation 1 + sum z_i^2 / (d_i - x) = 0, one between each two neighbours d_i. Entries z_i without weight and
   (nearly) equal d_i are deflated first. Blocks of more rows than dimensions are rotated into as many rows as dimensions
   with the same scatter before, so the cost per row stays that of a product with a matrix.
3. Spectra of partitions are combined by successive rank-one updates with sqrt(d_i) q_i, in a tree of fixed fan-in.
4. The eigenvectors found span a basis in which the scatter is almost diagonal. A distributed Rayleigh-Ritz step measures the
   scatter in this basis over all rows and rotates the basis by the eigenvectors of the small matrix that results.
5. Rows are projected on the components and divided by the root of the eigenvalue.

Partial results are one row per partition and dimension-sized (d x d), so what reaches the driver depends on the
dimensions alone. All passes read the table anew; nothing is kept but the partial results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import keep

#: Partial results folded by one task; a tree of this fan-in leads to one row.
FAN_IN = 16
#: Entries of the rows that one task gathers before their rank-one updates (64 MB).
BLOCK_ENTRIES = 8_000_000
#: An entry becomes floor(SCALE * c) + SHIFT (fixed by the contract of the query).
SCALE, SHIFT = 64, 1_000_000
EPS = np.finfo(np.float64).eps


# ---- secular equation ----------------------------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2_j / (d_j - x) for strictly ascending d and positive z2, as (index of the nearest pole, distance).

    Each root is found relative to the pole nearest to it, so differences d_j - x keep full relative accuracy. Steps
    match the sums left and right of the root by one pole each, and fall back to bisection outside the bracket.
    """
    k = len(d)
    total = z2.sum()
    upper = np.append(d[1:], d[-1] + total)
    gap = upper - d
    mid = d + gap / 2
    value = 1 + (z2 / (d[None, :] - mid[:, None])).sum(axis=1)
    near = np.arange(k) + (value <= 0)  # the function grows between poles: negative in the middle, the root is in the right half
    near[-1] = k - 1
    delta = d[None, :] - d[near][:, None]
    low = np.where(near == np.arange(k), 0.0, -gap / 2)
    high = np.where(near == np.arange(k), gap / 2, 0.0)
    low[-1], high[-1] = 0.0, total
    x = (low + high) / 2
    left = np.tri(k, dtype=bool)
    todo = np.arange(k)  # roots that still move
    for _ in range(100):
        now = x[todo]
        away = delta[todo] - now[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            part = z2 / away
            slope = part / away
            side = left[todo]
            psi, dpsi = np.where(side, part, 0.0).sum(axis=1), np.where(side, slope, 0.0).sum(axis=1)
            phi, dphi = part.sum(axis=1, where=~side), slope.sum(axis=1, where=~side)
            f = 1 + psi + phi
            low[todo], high[todo] = np.where(f < 0, now, low[todo]), np.where(f < 0, high[todo], now)
            final = todo == k - 1
            place = np.arange(len(todo))
            a, b = away[place, todo], away[place, np.minimum(todo + 1, k - 1)]  # distances to the poles on both sides
            # psi ~ r + s / (d_i - x), phi ~ p + q / (d_i+1 - x), equal in value and slope; the root of 1 + both
            s, q = dpsi * a * a, np.where(final, 0.0, dphi * b * b)
            c = np.where(final, 1 + psi - dpsi * a, 1 + (psi - dpsi * a) + (phi - dphi * b))
            first = c * (a + b) + s + q
            last = c * a * b + s * b + q * a
            root = np.sqrt(np.maximum(first * first - 4 * c * last, 0.0))
            step = np.where(final, a + s / c, np.where(first > 0, 2 * last / (first + root), (first - root) / (2 * c)))
            still = (np.abs(f) > 2 * EPS * k * (1 + np.abs(psi) + np.abs(phi))) & ~(np.abs(step) <= 2 * EPS * np.abs(now))
        new = now + step
        inside = (new > low[todo]) & (new < high[todo])
        new = np.where(inside, new, (low[todo] + high[todo]) / 2)
        still &= new != now
        todo = todo[still]
        x[todo] = new[still]
        if not len(todo):
            break
    return near, x


class Spectrum:
    """Eigenvalues (ascending) and eigenvectors of a sum of v v', updated one v at a time."""

    def __init__(self, values: np.ndarray, vectors: np.ndarray):
        self.values, self.vectors = values, vectors

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(np.zeros(size), np.eye(size))

    def add(self, row: np.ndarray) -> None:
        """Adds row' row: deflation, secular equation, and vectors from weights made anew from the roots."""
        d, q = self.values, self.vectors
        z = q.T @ row
        norm = float(z @ z)
        if norm == 0.0:
            return
        tolerance = 8 * EPS * max(abs(d[-1]), norm)
        live = np.abs(z) * np.sqrt(norm) > tolerance
        last = -1
        for at in np.flatnonzero(live):  # of (nearly) equal values one keeps all weight, by a rotation of their vectors
            if last >= 0 and d[at] - d[last] <= tolerance:
                length = np.hypot(z[last], z[at])
                cos, sin = z[at] / length, z[last] / length
                q[:, last], q[:, at] = cos * q[:, last] - sin * q[:, at], sin * q[:, last] + cos * q[:, at]
                z[at], z[last], live[last] = length, 0.0, False
            last = at
        at = np.flatnonzero(live)
        if not len(at):
            return
        poles, weights = d[at], z[at] ** 2
        near, x = secular_roots(poles, weights)
        away = (poles[None, :] - poles[near][:, None]) - x[:, None]  # pole_j - root_i
        if len(at) > 1:  # the weights that have exactly these roots keep the vectors orthogonal
            ratio = -away.T  # root_i - pole_j, by pole
            spread = poles[None, :] - poles[:, None]
            np.fill_diagonal(spread, 1.0)
            product = np.log(np.abs(ratio)).sum(axis=1) - np.log(np.abs(spread)).sum(axis=1)
            z_new = np.copysign(np.exp(product / 2), z[at])
        else:
            z_new = z[at]
        turn = z_new[:, None] / away.T
        turn /= np.linalg.norm(turn, axis=0)
        d, q = d.copy(), q.copy()
        d[at] = poles[near] + x
        q[:, at] = q[:, at] @ turn
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def add_rows(self, rows: np.ndarray) -> None:
        """Adds many rows; more rows than dimensions are first rotated into as many with the same scatter."""
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        for row in rows:
            self.add(row)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values[::-1], other.vectors.T[::-1], strict=True):
            if value > 0:
                self.add(np.sqrt(value) * vector)


# ---- distributed passes --------------------------------------------------------------------------------------------

def _matrix(batch: pa.RecordBatch, vector_col: str, dims: int | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Usable rows of a batch: for each number of dimensions, row places and the integer vectors (as exact doubles)."""
    column = batch[vector_col]
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
    begin = np.cumsum(sizes) - sizes
    found = []
    for size in np.unique(sizes) if dims is None else [dims]:
        rows = np.flatnonzero(sizes == size) if size else np.zeros(0, np.int64)
        if len(rows):
            x = flat[begin[rows][:, None] + np.arange(size)]
            x = np.floor(SCALE * x) + SHIFT
            fine = (np.abs(x) < 2.0**52).all(axis=1)
            if fine.any():
                found.append((rows[fine], x[fine]))
    return sizes, found


def _partial(vectors: DataFrame, vector_col: str, dims: int | None, make: Callable[[], Callable], schema: str) -> DataFrame:
    """One pass: `make()` gives a function that takes the rows of each batch and, called with None, gives the partition's result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = make()
        for batch in batches:
            for _, x in _matrix(batch, vector_col, dims)[1]:
                take(x)
        rows = take(None)
        names = ["part", "dims", "rows", "state"]
        part = TaskContext.get().partitionId()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names)

    return vectors.select(vector_col).mapInArrow(run, schema)


STATE = "part long, dims long, rows long, state binary"


def _fold(partial: DataFrame, merge: Callable[[int, list[bytes]], bytes]) -> list:
    """Folds the partial results of each number of dimensions in a tree; every task folds at most FAN_IN of them, in order."""
    level = keep(partial, "partial")
    while True:
        top = level.agg({"part": "max"}).first()[0]
        if not top:
            return level.collect()

        def fold(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["part"])
            made = merge(rows[0]["dims"], [r["state"] for r in rows]) if len(rows) > 1 else rows[0]["state"]
            return pa.table({"part": [rows[0]["part"] // FAN_IN], "dims": [rows[0]["dims"]], "rows": [sum(r["rows"] for r in rows)], "state": pa.array([made], pa.binary())})

        level = keep(level.selectExpr("*", f"part div {FAN_IN} as __group").groupBy("dims", "__group").applyInArrow(
            lambda table: fold(table.drop_columns(["__group"])), STATE), "partial")


LOW = (1 << 26) - 1


def _sums(vectors: DataFrame, vector_col: str) -> tuple[int, int, list[int], float] | None:
    """Number of dimensions, of rows, exact sums and largest absolute entry of the vectors of the most frequent size."""

    def make():
        state: dict[int, list] = {}

        def take(x):
            if x is None:
                return [(size, n, np.concatenate([high, low, [top]]).astype("<i8").tobytes()) for size, (n, high, low, top) in state.items()]
            whole = x.astype(np.int64)
            n, high, low, top = state.get(x.shape[1], (0, 0, 0, 0))
            high, low = high + (whole >> 26).sum(axis=0), low + (whole & LOW).sum(axis=0)
            state[x.shape[1]] = [n + len(x), high + (low >> 26), low & LOW, max(top, int(np.abs(whole).max()))]

        return take

    def merge(dims: int, states: list[bytes]) -> bytes:
        all_ = np.array([np.frombuffer(s, "<i8") for s in states])
        high, low = all_[:, :dims].sum(axis=0), all_[:, dims:-1].sum(axis=0)
        return np.concatenate([high + (low >> 26), low & LOW, [all_[:, -1].max()]]).astype("<i8").tobytes()

    rows = _fold(_partial(vectors, vector_col, None, make, STATE), merge)
    if not rows:
        return None
    best = max(rows, key=lambda r: (r["rows"], r["dims"]))
    state, size = np.frombuffer(bytes(best["state"]), "<i8"), best["dims"]
    return size, best["rows"], [(int(h) << 26) + int(w) for h, w in zip(state[:size], state[size:-1], strict=True)], float(state[-1])


def _add_states(dims: int, states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s, np.float64) for s in states], axis=0).tobytes()


def _gram(vectors: DataFrame, vector_col: str, dims: int, transform: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the transformed rows, over all rows."""

    def make():
        total, first, n = np.zeros((width, width)), np.zeros(width), 0

        def take(x):
            nonlocal n
            if x is None:
                return [(dims, n, np.concatenate([first, total.ravel()]).tobytes())] if n else []
            y = transform(x)
            np.add(total, y.T @ y, out=total)
            np.add(first, y.sum(axis=0), out=first)
            n += len(x)

        return take

    state = np.frombuffer(bytes(_fold(_partial(vectors, vector_col, dims, make, STATE), _add_states)[0]["state"]))
    return state[:width], state[width:].reshape(width, width)


def _spectrum(vectors: DataFrame, vector_col: str, dims: int, centre: Callable[[np.ndarray], np.ndarray], block_rows: int) -> Spectrum:
    """Spectrum of the scatter of all centred rows, by rank-one updates in the partitions and between their results."""

    def pack(s: Spectrum) -> bytes:
        return np.concatenate([s.values, s.vectors.ravel()]).tobytes()

    def unpack(state: bytes) -> Spectrum:
        flat = np.frombuffer(state, np.float64)
        return Spectrum(flat[:dims].copy(), flat[dims:].reshape(dims, dims).copy())

    def make():
        own, waiting, n = Spectrum.empty(dims), [], 0

        def take(x):
            nonlocal waiting, n
            if x is not None:
                n += len(x)
                waiting.append(centre(x))
            if waiting and (x is None or sum(map(len, waiting)) >= block_rows):
                rows = np.concatenate(waiting)
                for at in range(0, len(rows), block_rows):
                    own.add_rows(rows[at : at + block_rows])
                waiting = []
            if x is None:
                return [(dims, n, pack(own))] if n else []

        return take

    def merge(_: int, states: list[bytes]) -> bytes:
        own = unpack(states[0])
        for state in states[1:]:
            own.merge(unpack(state))
        return pack(own)

    return unpack(bytes(_fold(_partial(vectors, vector_col, dims, make, STATE), merge)[0]["state"]))


@dataclass(frozen=True)
class Whitening:
    """What whitening needs to know: the rows' number and exact sums, components (columns) and eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    largest: float
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit integers where they cannot overflow, else Python integers."""
        if 2 * self.n * self.largest < 2.0**62:
            return x.astype(np.int64) * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(np.int64).astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 over the dimensions, exact; None where a long cannot hold it."""
        off = self.offsets(x)
        if off.dtype == object or float(np.abs(off).max(initial=0)) ** 2 * self.dims >= 2.0**62:
            exact = [sum(int(v) ** 2 for v in row) for row in off]
            return [v if v < 2**63 else None for v in exact]
        return (off * off).sum(axis=1).tolist()

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def fit(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 32, block_rows: int | None = None) -> Whitening | None:
    """Fits a whitening of all usable vectors; None if there is none.

    Vectors that are null, empty or hold null, non-finite or huge entries (2^52 or more after scaling) take no part, nor do vectors of
    another size than the most frequent one (of equally frequent sizes, the largest counts). `block_rows` rows are rotated together before their
    rank-one updates (default: 64 times the dimensions, at most BLOCK_ENTRIES entries; 1: each row by itself). The result is the
    same up to rounding.
    """
    found = _sums(vectors, vector_col)
    if found is None:
        return None
    dims, n, sums, largest = found
    base = Whitening(n, tuple(sums), largest, np.eye(dims), np.ones(dims), 1.0)
    rough = _spectrum(vectors, vector_col, dims, base.centred, block_rows or max(dims, min(64 * dims, BLOCK_ENTRIES // dims)))
    basis = np.linalg.qr(rough.vectors[:, ::-1])[0]
    _, scatter = _gram(vectors, vector_col, dims, lambda x: base.centred(x) @ basis, dims)
    values, turn = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    trace = float(np.trace(scatter)) / n
    values = values[order]
    values[values <= 64 * dims * EPS * trace] = 0.0
    return Whitening(n, tuple(sums), largest, basis @ turn[:, order], values, trace)


def identity_error(vectors: DataFrame, model: Whitening, *, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, over components with an eigenvalue above 0."""
    live = np.flatnonzero(model.eigenvalues > 0)
    if not len(live):
        return None
    first, total = _gram(vectors, vector_col, model.dims, lambda x: model.project(x)[:, live], len(live))
    mean = first / model.n
    return float(np.abs(total / model.n - np.outer(mean, mean) - np.eye(len(live))).max())


def whiten(vectors: DataFrame, model: Whitening | None, *, id_col: str = "vec_id", vector_col: str = "embedding", error: float | None = None) -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that took no part in the fit (see `fit`) give no rows; without a model there are none. Repeated ids and null ids keep their rows. A component
    without variance has explained 0 and a null `whitened`; a deviation beyond a long is null. Other columns are not read.
    """
    fields = [vectors.schema[id_col]] + [T.StructField(n, k) for n, k in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]
    schema = T.StructType(fields)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    count = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if model.trace > 0 else np.zeros(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrix(batch, vector_col, model.dims)[1]:
                y = model.project(x).ravel()
                deviations = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), count)))
                ids = batch[id_col].take(pa.array(np.repeat(rows, count)))
                size = len(x) * count
                dead = np.tile(model.eigenvalues <= 0, len(x))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(size, model.n, np.int64)), deviations,
                     pa.array(y, pa.float64(), mask=dead), pa.array(np.tile(explained, len(x))), pa.array([error] * size, pa.float64())],
                    [f.name for f in fields])

    return vectors.select(id_col, vector_col).mapInArrow(run, schema)
