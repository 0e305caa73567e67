"""Whitening of embeddings by hierarchical SVD merging.

Every entry c of a vector becomes the whole number x = floor(64 c) + 1000000. The distinct x vectors are the fit
list. Each part of it keeps its number of vectors, their exact sums, and the factor diag(s) V' of the centred part's
SVD with all its singular values. Two parts merge by stacking both factors on a mean-correction row,
sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), whose SVD is the factor of both together: no dimension is lost on the way.
Parts merge in a tree, ``FAN`` at a time, so no task holds more than two factors (dimension squared numbers each).
The components are the right singular vectors of the last factor. A second pass over the fit list measures how far
the whitened list's covariance is from the identity, merged in the same tree.

Defined results: rows whose vector is null, or holds a null, non-finite or immense entry (64 |c| from 2^61 on, which
leaves the long range), take no part; vectors of different lengths are lists of their own, each with its own fit; an
empty vector has no components, and an empty table no rows; repeated rows and rows without an id each have
their rows; a component without variance (within rounding) has a null ``whitened`` and counts not for
``identity_error``, which is null where no component has any; ``explained`` is null where no dimension varies; a
``deviation`` beyond the long range is null; ids are whole numbers (text that isn't one fails the job); extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, saved, spread

#: Fixed values of the contract: x = floor(SCALE * c) + SHIFT; components returned at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Parts that merge in one task; vectors that Python works on at a time.
FAN, PIECE = 8, 4_000
#: From here on whole numbers may leave the long range.
WIDE = 1 << 62
PART = "dim int, part int, n long, sums array<decimal(38,0)>, factor binary"
SPREAD = "dim int, part int, n long, mean binary, products binary"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(column: str) -> Column:
    """The x vector; null if the vector or an entry can't take part."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= float(1 << 55)))
    return F.when(~bad, F.transform(column, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + F.lit(SHIFT)))


def vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that take part."""
    return embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), whole(embedding).alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0))


def matrices(column: pa.Array, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of a column's vectors of each length, some thousands at a time."""
    lengths = np.diff(column.offsets.to_numpy())
    values, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        for i in range(0, len(at), most):
            rows = at[i : i + most]
            yield rows, values[first[rows][:, None] + np.arange(d)]


def whole_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of each column as Python's whole numbers."""
    wide = int(np.abs(x).max()) * len(x) >= WIDE
    return (x.astype(object) if wide else x).sum(0).astype(object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the whole part of the means leaves before anything is rounded."""
    near = sums // n
    wide = max(int(np.abs(x).max()), max(map(abs, near.tolist()))) >= WIDE // 2
    apart = (x.astype(object) - near if wide else x - near.astype(np.int64)).astype(float)
    return apart - np.array([int(r) / n for r in sums - near * n])


def factor(rows: np.ndarray) -> np.ndarray:
    """diag(s) V' of the rows' SVD, with all singular values."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


Part = tuple[int, np.ndarray, np.ndarray]


def merged(a: Part, b: Part) -> Part:
    (n, s, f), (m, t, g) = a, b
    apart = np.array([int(x) / (n * m) for x in s * m - t * n])
    return n + m, s + t, factor(np.concatenate([f, g, np.sqrt(n * m / (n + m)) * apart[None]]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of each length of a task's vectors."""
    found: dict[int, Part] = {}
    for batch in pieces(batches, PIECE):
        for _, x in matrices(batch.column(0)):
            sums = whole_sums(x)
            part = (len(x), sums, factor(centred(x, len(x), sums)))
            d = x.shape[1]
            found[d] = merged(found[d], part) if d in found else part
    task = TaskContext.get().partitionId()
    for d, (n, s, f) in sorted(found.items()):
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "part": pa.array([task], pa.int32()), "n": [n], "sums": pa.array([[Decimal(int(x)) for x in s]], pa.list_(pa.decimal128(38, 0))), "factor": pa.array([f.tobytes()], pa.binary())})


def _merge_parts(rows: pd.DataFrame) -> pd.DataFrame:
    d, parts = int(rows["dim"].iloc[0]), rows.sort_values("part")
    at = int(parts["part"].iloc[0]) // FAN
    state = None
    for n, s, f in zip(parts["n"], parts["sums"], parts["factor"]):
        part = (int(n), np.array([int(x) for x in s], object), np.frombuffer(f).reshape(-1, d))
        state = merged(state, part) if state else part
    n, s, f = state
    return pd.DataFrame({"dim": [d], "part": [at], "n": [n], "sums": [[Decimal(int(x)) for x in s]], "factor": [f.tobytes()]})


def in_a_tree(parts: DataFrame, count: int, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row for each length, from parts numbered below count that merge ``FAN`` at a time."""
    while True:
        parts = parts.groupBy("dim", F.floor(F.col("part") / FAN).alias("_at")).applyInPandas(merge, schema)
        count = -(-count // FAN)
        if count <= 1:
            return parts


class Model:
    """n, sums, and the first components of the fit list of one length."""

    def __init__(self, n: int, sums: np.ndarray, f: np.ndarray, components: int = COMPONENTS):
        d = len(sums)
        _, s, v = np.linalg.svd(f, full_matrices=True)
        values = np.zeros(d)
        values[: len(s)] = s * s / n
        self.n, self.sums, k = n, sums, min(d, components)
        self.values, self.trace = values[:k], float(values.sum())
        signs = np.where(v[np.arange(k), np.abs(v[:k]).argmax(1)] < 0, -1.0, 1.0)
        self.axes = v[:k] * signs[:, None]
        self.varies = self.values > max(values[0], 0.0) * d * np.finfo(float).eps * 4

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exactly: long, or Python's whole numbers where long might not do."""
        wide = self.n * int(np.abs(x).max()) >= WIDE // 2 or max(map(abs, self.sums.tolist())) >= WIDE // 2
        return x.astype(object) * self.n - self.sums if wide else x * self.n - self.sums.astype(np.int64)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        """Coordinates of n x - sums; those of components without variance are NaN."""
        scale = np.where(self.varies, np.sqrt(np.where(self.varies, self.values, 1.0)), np.nan)
        return (apart.astype(float) / self.n) @ self.axes.T / scale

    def deviation(self, apart: np.ndarray) -> list[int | None]:
        large = float(np.abs(apart.astype(float)).max())
        if large * large * apart.shape[1] < WIDE:
            return (apart.astype(np.int64) ** 2).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in apart]
        return [v if v < 1 << 63 else None for v in exact]


def fit(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The fit list (written to the shared folder), and dim, n, sums and factor of each length of vectors."""
    rows = vectors(embeddings, vec_id, embedding)
    lists = saved(rows.select("x").distinct(), "fit-list")
    count = lists.rdd.getNumPartitions()
    return lists, in_a_tree(lists.mapInArrow(_parts, PART), count, _merge_parts, PART)


def models(parts: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length. The driver holds a factor (dimension squared) of each length, whatever the number of rows."""
    found = {}
    for r in parts.toLocalIterator():
        found[r["dim"]] = Model(r["n"], np.array([int(x) for x in r["sums"]], object), np.frombuffer(bytes(r["factor"])).reshape(-1, r["dim"]), components)
    return found


def _chan(a: tuple, b: tuple) -> tuple:
    (n, u, p), (m, v, q) = a, b
    return n + m, (n * u + m * v) / (n + m), p + q + np.outer(u - v, u - v) * (n * m / (n + m))


def _merge_products(rows: pd.DataFrame) -> pd.DataFrame:
    parts, state = rows.sort_values("part"), None
    for n, u, p in zip(parts["n"], parts["mean"], parts["products"]):
        u = np.frombuffer(u)
        part = (int(n), u, np.frombuffer(p).reshape(len(u), len(u)))
        state = _chan(state, part) if state else part
    n, u, p = state
    return pd.DataFrame({"dim": [int(parts["dim"].iloc[0])], "part": [int(parts["part"].iloc[0]) // FAN], "n": [n], "mean": [u.tobytes()], "products": [p.tobytes()]})


def identity_errors(lists: DataFrame, found: dict[int, Model]) -> dict[int, float | None]:
    """For each length, the largest absolute entry of the whitened fit list's covariance minus the identity."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}
        for batch in pieces(batches, PIECE):
            for _, x in matrices(batch.column(0)):
                model = found[x.shape[1]]
                w = model.whitened(model.apart(x))[:, model.varies]
                u = w.mean(0)
                part = (len(w), u, (w - u).T @ (w - u))
                state[x.shape[1]] = _chan(state[x.shape[1]], part) if x.shape[1] in state else part
        task = TaskContext.get().partitionId()
        for d, (n, u, p) in sorted(state.items()):
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "part": pa.array([task], pa.int32()), "n": [n], "mean": pa.array([u.tobytes()], pa.binary()), "products": pa.array([np.ascontiguousarray(p).tobytes()], pa.binary())})

    out: dict[int, float | None] = {}
    for r in in_a_tree(lists.mapInArrow(products, SPREAD), lists.rdd.getNumPartitions(), _merge_products, SPREAD).toLocalIterator():
        k = int(found[r["dim"]].varies.sum())
        out[r["dim"]] = float(np.abs(np.frombuffer(bytes(r["products"])).reshape(k, k) / r["n"] - np.eye(k)).max()) if k else None
    return out


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row that takes part and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    One shuffle of distinct vectors, written once; three passes over them or the table; merges move factors only.
    """
    lists, parts = fit(embeddings, vec_id, embedding)
    found = models(parts, components)
    errors = identity_errors(lists, found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            ids = batch.column(0)
            for at, x in matrices(batch.column(1)):
                model = found[x.shape[1]]
                apart, k, m = model.apart(x), len(model.values), len(x)
                w = model.whitened(apart).ravel()
                share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
                error = errors[x.shape[1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviation(apart), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(np.tile(share, m), mask=np.isnan(np.tile(share, m))),
                        pa.array(np.full(m * k, np.nan if error is None else error), mask=np.full(m * k, error is None)),
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return vectors(spread(embeddings), vec_id, embedding).mapInArrow(rows, OUT)
