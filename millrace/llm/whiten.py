"""Whitening of integer vectors from an exact scatter.

Every vector is turned into whole numbers; the fit list holds each different vector once. A task subtracts a whole shift of
its own from its vectors and adds up entries and cross products in Python's unbounded integers (matrix products run on
blocks whose sums are exact in doubles or 64 bits). Tasks' sums are brought to one shift and added exactly, in
two levels. From n, S and the cross products C the matrix n C - S S', which no shift changes, is formed exactly; only then it is
divided by n * n as floating point and decomposed by eigh.

Vectors travel in blocks of bounded size; a model (means, components) meets blocks, and is broadcast only when the models
of all vector lengths together are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, lean, materialize, partitions

#: Entries of one block of vectors (8 bytes each).
BLOCK_ENTRIES = 1 << 18
#: Stored bytes up to which the models of all vector lengths are sent to every task.
MODEL_BYTES = 32 << 20
COMPONENTS = 4
#: Variances of at most so many times the largest one and the machine's precision are zero.
FLAT = 16
LIMIT = 2**63


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each entry as double. Vectors that are null or hold null or non-finite entries are
    dropped, rows without vec_id are not. Entries beyond 64 bits are held at the ends of that range."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    held = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))).cast("long")
    return rows.select("vec_id", F.transform("v", held).alias("v"))


def _blocks(rows: DataFrame) -> DataFrame:
    """dim, ids, data: rows (vec_id, v) in blocks of one vector length each."""

    def pack(dim: int, ids: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(vectors).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["dim", "ids", "data"])

    def run(batches: Batches) -> Batches:
        held: dict[int, tuple[list, list[np.ndarray]]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy(zero_copy_only=False)
                if not len(v):
                    continue
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) * len(v) >= BLOCK_ENTRIES or sum(len(x[0]) * d for d, x in held.items()) >= 8 * BLOCK_ENTRIES:
                    yield pack(len(v), *held.pop(len(v)))
        for dim in list(held):
            yield pack(dim, *held.pop(dim))

    return rows.mapInArrow(lean(run), "dim int, ids array<long>, data binary")


class Scatter:
    """n, and about a whole shift: the sums and cross products of vectors, exactly."""

    def __init__(self, shift: np.ndarray):
        dim = len(shift)
        self.n, self.shift, self.sums, self.cross = 0, shift, np.zeros(dim, object), np.zeros((dim, dim), object)

    def add(self, x: np.ndarray) -> None:
        if max(abs(int(x.min())), abs(int(x.max()))) >= 2**61 or max(map(abs, self.shift.tolist())) >= 2**61:
            y = x.astype(object) - self.shift
        else:
            y = x - self.shift.astype(np.int64)
        top = max(abs(int(y.min())), abs(int(y.max())), 1)
        bound = top * top * len(y)
        y = y.astype(np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object)
        self.n += len(y)
        self.sums += _integers(y.sum(axis=0))
        self.cross += _integers(y.T @ y)

    def merge(self, other: Scatter) -> None:
        move = other.shift - self.shift
        self.cross += other.cross + np.outer(other.sums, move) + np.outer(move, other.sums) + other.n * np.outer(move, move)
        self.sums += other.sums + other.n * move
        self.n += other.n

    def total(self) -> np.ndarray:
        return self.sums + self.n * self.shift

    def centred(self) -> np.ndarray:
        """n * X'X - S S' in whole numbers."""
        return self.n * self.cross - np.outer(self.sums, self.sums)

    def packed(self) -> tuple[str, str, str, str]:
        return str(self.n), *(" ".join(map(str, x.ravel().tolist())) for x in (self.shift, self.sums, self.cross))

    @classmethod
    def unpacked(cls, n: str, shift: str, sums: str, cross: str) -> Scatter:
        numbers = lambda x: np.array([int(s) for s in x.split()], object)
        out = cls(numbers(shift))
        out.n, out.sums = int(n), numbers(sums)
        out.cross = numbers(cross).reshape(out.cross.shape)
        return out


def _integers(x: np.ndarray) -> np.ndarray:
    """Exact values as Python integers."""
    return (x if x.dtype == object else x.astype(np.int64)).astype(object)


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim)


def _scatters(batches: Batches) -> Iterator[tuple[int, Scatter]]:
    held: dict[int, Scatter] = {}
    for batch in batches:
        for dim, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = _matrix(data, dim)
            if dim not in held:
                held[dim] = Scatter(np.array([int(m) for m in np.rint(x.astype(float).mean(axis=0)).tolist()], object))
            held[dim].add(x)
    yield from held.items()


_PARTS = "dim int, n string, shift string, sums string, cross string"


def _folded(parts: DataFrame, kind: str, load: Callable, merge: Callable, save: Callable) -> DataFrame:
    """One row for each dim: ``parts`` merged over salts first, so that no task gets what every task of the table made."""
    names = parts.columns

    def fold(batches: Batches) -> Batches:
        key = held = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[0] == key:
                    merge(held, load(*row[1:]))
                    continue
                if held is not None:
                    yield _row(names, key, save(held), batch.schema)
                key, held, schema = row[0], load(*row[1:]), batch.schema
        if held is not None:
            yield _row(names, key, save(held), schema)

    n = partitions(parts.sparkSession)
    salted = parts.repartition(n, "dim", F.pmod(F.xxhash64(*names), F.lit(max(1, round(n**0.5))))).sortWithinPartitions("dim").mapInArrow(lean(fold), kind)
    return salted.repartition(n, "dim").sortWithinPartitions("dim").mapInArrow(lean(fold), kind)


def _row(names: list[str], dim: int, values: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], schema.field(c).type) for c, x in zip(names, (dim, *values))], names)


def scatter(blocks: DataFrame) -> DataFrame:
    """dim, n, shift, sums, cross (decimal numbers in texts): the exact sums of all vectors of each length."""

    def run(batches: Batches) -> Batches:
        for dim, s in _scatters(batches):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x]) for x in s.packed())], [c.split()[0] for c in _PARTS.split(", ")])

    parts = blocks.select("dim", "data").mapInArrow(lean(run), _PARTS)
    return _folded(parts, _PARTS, Scatter.unpacked, Scatter.merge, Scatter.packed)


def decomposed(s: Scatter, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest variances (falling; zero if not above the precision), their unit vectors as rows, and the trace."""
    square = s.n * s.n
    of = np.array([[g / square for g in row] for row in s.centred().tolist()], float)
    values, vectors = np.linalg.eigh(of)
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    values = np.where(values > FLAT * len(of) * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    return values, vectors, float(np.trace(of))


_MODEL = "dim int, n long, total string, trace double, variances array<double>, components binary"


def models(sums: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """dim, n, total, trace, variances, components (rows of doubles) of each vector length."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for dim, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                s = Scatter.unpacked(*parts)
                values, vectors, trace = decomposed(s, k)
                arrays = [pa.array([dim], pa.int32()), pa.array([s.n], pa.int64()), pa.array([" ".join(map(str, s.total().tolist()))]), pa.array([trace])]
                arrays += [pa.array([values.tolist()], pa.list_(pa.float64())), pa.array([np.ascontiguousarray(vectors).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _MODEL.split(", ")])

    return sums.mapInArrow(lean(run), _MODEL)


class Model:
    def __init__(self, dim: int, n: int, total: str, variances: list[float], components: bytes):
        self.n = n
        # S = n * whole + rest, so that entries stay small and deviations exact
        parts = [divmod(int(s), n) for s in total.split()]
        self.whole, self.rest = (np.array(x, object) for x in zip(*parts))
        self.share = np.array([r / n for r in self.rest.tolist()])
        self.variances = np.array(variances)
        vectors = np.frombuffer(components).reshape(-1, dim)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.weights = np.where(self.variances[:, None] > 0, vectors / np.sqrt(self.variances)[:, None], 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers x - floor(S / n)."""
        if max(abs(int(x.min())), abs(int(x.max())), *(abs(w) for w in self.whole.tolist())) >= 2**62:
            return x.astype(object) - self.whole
        return x - self.whole.astype(np.int64)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(float) - self.share) @ self.weights.T

    def deviations(self, y: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 = n^2 sum y^2 - 2 n sum y r + sum r^2 with y = x - whole, r = rest."""
        top = max(abs(int(y.min())), abs(int(y.max())), 1)
        small = top * top * y.shape[1] < 2**63 and top * max(self.rest.tolist()) * y.shape[1] < 2**63
        y, rest = (y.astype(np.int64), self.rest.astype(np.int64)) if small else (y.astype(object), self.rest)
        own = sum(r * r for r in self.rest.tolist())
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + own for a, b in zip((y * y).sum(axis=1).tolist(), (y @ rest).tolist())]


def _met(blocks: DataFrame, fitted: DataFrame) -> DataFrame:
    """Blocks with the model of their length; ``fitted`` is broadcast only if its stored bytes are few."""
    stored = fitted.agg(F.sum(F.length("total") + F.length("components"))).first()[0] or 0
    return blocks.join(F.broadcast(fitted) if stored <= MODEL_BYTES else fitted.hint("merge"), "dim")


_MODEL_COLUMNS = ("dim", "n", "total", "variances", "components")


def _each(batches: Batches, *columns: str) -> Iterator[tuple]:
    """Model and matrix of each block, and further columns; the last model is kept."""
    last: tuple = (None, None)
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*_MODEL_COLUMNS, "data", *columns))):
            if last[0] != row[0]:
                last = row[0], Model(*row[:5])
            yield last[1], row[0], _matrix(row[5], row[0]), *row[6:]


def identity_errors(blocks: DataFrame, fitted: DataFrame) -> DataFrame:
    """dim, identity_error: the largest absolute entry of the covariance of the whitened fit list less the identity. Vectors are
    centred on the mean of their task before multiplying, and tasks' moments are merged in two levels."""
    kind = "dim int, n long, mean array<double>, moments array<double>"

    def run(batches: Batches) -> Batches:
        held: dict[int, list] = {}
        for model, dim, x in _each(batches):
            w = model.whitened(model.centred(x))
            mean = w.mean(axis=0)
            part = [len(w), mean, (w - mean).T @ (w - mean)]
            if dim in held:
                merge(held[dim], part)
            else:
                held[dim] = part
        for dim, part in held.items():
            arrays = [pa.array([dim], pa.int32()), pa.array([part[0]], pa.int64()), *(pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in part[1:])]
            yield pa.RecordBatch.from_arrays(arrays, ["dim", "n", "mean", "moments"])

    def merge(a: list, b: list) -> None:
        n = a[0] + b[0]
        move = b[1] - a[1]
        a[2] = a[2] + b[2] + np.outer(move, move) * (a[0] * b[0] / n)
        a[1] = a[1] + move * (b[0] / n)
        a[0] = n

    load = lambda n, mean, moments: [n, np.array(mean), np.array(moments).reshape(len(mean), -1)]
    save = lambda part: (part[0], part[1].tolist(), part[2].ravel().tolist())
    parts = _met(blocks, fitted).select(*_MODEL_COLUMNS, "data").mapInArrow(lean(run), kind)
    sums = _folded(parts, kind, load, merge, save).join(fitted.select("dim", "variances"), "dim")

    def error(batches: Batches) -> Batches:
        for batch in batches:
            for dim, n, moments, variances in zip(*(c.to_pylist() for c in batch.columns)):
                real = np.flatnonzero(np.array(variances) > 0)
                off = np.abs(np.array(moments).reshape(len(variances), -1) / n - np.eye(len(variances)))[np.ix_(real, real)]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([float(off.max()) if len(real) else None], pa.float64())], ["dim", "identity_error"])

    return sums.select("dim", "n", "moments", "variances").mapInArrow(lean(error), "dim int, identity_error double")


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """``vectors``: vec_id, v (array of whole numbers). For each row and each of the k leading components of the vectors of its
    length: vec_id, component (from 1), n (different vectors of the fit list), deviation (sum of (n v - S)^2, exact, as a decimal
    of 38 digits; null beyond), whitened, explained (share of the component in the trace), identity_error.

    The fit list has each different vector once, however many copies there are. Vectors of different lengths are fitted apart;
    a length below k has fewer components, an empty vector none. Where all vectors of a length agree in a direction, its
    component has no variance: whitened is null and explained 0, or null if the trace is 0; such components take no part in
    identity_error. Repeated rows and rows without vec_id get their own rows; an empty table gives an empty result;
    other columns are ignored."""
    fit = materialize(_blocks(vectors.groupBy("v").agg(F.lit(None).cast("long").alias("vec_id")).select("vec_id", "v")), "fit")
    fitted = materialize(models(scatter(fit), k), "models")
    errors = materialize(identity_errors(fit, fitted), "errors")
    kind = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def run(batches: Batches) -> Batches:
        from decimal import Decimal

        for model, dim, x, ids, trace, error in _each(batches, "ids", "trace", "identity_error"):
            y = model.centred(x)
            out = model.whitened(y)
            c, n = len(model.variances), len(ids)
            far = [Decimal(d) if d < 10**38 else None for d in model.deviations(y)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(n), c))),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * c, model.n)),
                    pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(n), c))),
                    pa.array(out.ravel(), mask=np.tile(model.variances <= 0, n)),
                    pa.array([None if trace == 0 else v / trace for v in model.variances.tolist()] * n, pa.float64()),
                    pa.array([error] * (n * c), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    met = _met(_blocks(vectors), fitted.join(errors, "dim"))
    return met.select(*_MODEL_COLUMNS, "data", "ids", "trace", "identity_error").mapInArrow(lean(run), kind)


def report(embeddings: DataFrame) -> DataFrame:
    """``whiten`` of the integer vectors of a table; a deviation that 64 bits cannot hold is null."""
    return whiten(integer_vectors(embeddings)).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
