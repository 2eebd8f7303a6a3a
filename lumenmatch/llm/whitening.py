"""Embedding whitening: exact scatter matrices from bit planes, centred as integers before the eigenvectors."""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenmatch.llm.arrow import fields, map_batches
from lumenmatch.session import staged

#: An entry c becomes floor(SCALE * c) + OFFSET. Entries whose magnitude is beyond LARGEST are taken as LARGEST.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 46)
COMPONENTS = 16
#: Rows of which bit planes are made at once.
ROWS = 1 << 14
MOMENT = "i int, j int, total decimal(38,0)"


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of vectors: rows without null or non-finite entries, their lengths, and all their entries in a row."""
    valid = np.asarray(column.is_valid())
    flat = column.flatten()
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
    ends = np.cumsum(size)
    value = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    fit = valid & (bad[ends] == bad[ends - size])
    return np.flatnonzero(fit), size[fit], value[np.repeat(fit, size)]


def integers(embeddings: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep`` columns, ``dims`` (int) and ``x``: the entries floor(64 c) of each sound vector as little-endian 64-bit integers.

    Rows whose vector is null or holds a null or non-finite entry go.
    """

    def work(batch):
        rows, size, value = _entries(batch.column("__vector"))
        whole = np.floor(np.clip(value, -LARGEST, LARGEST) * SCALE).astype("<i8")
        offsets = np.concatenate([[0], np.cumsum(size)]) * 8
        yield {
            **{k: batch.column(k).take(pa.array(rows)) for k in keep},
            "dims": size.astype(np.int32),
            "x": pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(whole)]),
        }

    return map_batches(embeddings.select(*keep, F.col(vector).alias("__vector")), fields(embeddings, keep, "dims int, x binary"), work)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def bit_planes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of non-negative integers (rows by dimensions): row bits packed into 64-bit words, their exponents and the first
    plane of each dimension. A dimension has as many planes as its largest value has bits, one at least."""
    bits = [max(1, int(m).bit_length()) for m in z.max(axis=0)]
    first = np.concatenate([[0], np.cumsum(bits)])
    planes = np.zeros((first[-1], -(-len(z) // 64) * 8), np.uint8)
    for d, n in enumerate(bits):
        column = z[:, d]
        for b in range(n):
            packed = np.packbits(((column >> b) & 1).astype(np.uint8))
            planes[first[d] + b, : len(packed)] = packed
    return planes.view(np.uint64), np.concatenate([np.arange(n) for n in bits]), first


def cross_products(z: np.ndarray) -> np.ndarray:
    """Upper triangle of z^T z in whole numbers: 2^(a+b) times the popcount of plane a of one dimension AND plane b of another."""
    planes, power, first = bit_planes(z)
    dims = z.shape[1]
    exact = np.int64 if 2 * (int(power.max()) + 1) + len(z).bit_length() < 62 else object
    weight = np.array([1 << int(p) for p in power], exact)
    out = np.zeros((dims, dims), object)
    for i in range(dims):
        start = first[i]
        total = np.zeros(dims - i, exact)
        for a in range(start, first[i + 1]):
            counts = np.bitwise_count(planes[a] & planes[start:]).sum(axis=1, dtype=np.int64)
            total = total + np.add.reduceat(counts.astype(exact) * weight[start:], first[i:-1] - start) * weight[a]
        out[i, i:] = total
    return out


def scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and the symmetric matrix of cross-products of ``x``, exact.

    Every task tells one partial matrix; Spark adds them up by entry. What reaches the driver has dims * (dims + 3) / 2 + 1 rows.
    """
    schema = T.StructType.fromDDL(MOMENT)
    target = to_arrow_schema(schema)

    def run(batches):
        n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _matrix(batch.column("x").slice(at, ROWS), dims)
                low = y.min(axis=0)
                z = y - low
                part, own = cross_products(z), z.sum(axis=0).astype(object)
                low = low.astype(object)
                # (z + low)(z + low)' from zz', with the sums of z
                cross += part + np.outer(low, own) + np.outer(own, low) + len(y) * np.outer(low, low)
                sums += own + len(y) * low
                n += len(y)
        if n:
            i, j = np.triu_indices(dims)
            total = [n, *sums, *cross[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] + [-1] * dims + i.tolist(), pa.int32()), pa.array([-1, *range(dims)] + j.tolist(), pa.int32()), pa.array(map(decimal.Decimal, total), target.field("total").type)], schema=target
            )

    rows = fit.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    n, sums, cross = 0, [0] * dims, np.zeros((dims, dims), object)
    for r in rows:
        if r["j"] < 0:
            n = int(r["total"])
        elif r["i"] < 0:
            sums[r["j"]] = int(r["total"])
        else:
            cross[r["i"], r["j"]] = cross[r["j"], r["i"]] = int(r["total"])
    return n, sums, cross


@dataclass
class Whitener:
    """Sums (of floor(64 c)), count, components by falling eigenvalue (columns) and their shares of the trace. Its size is
    dims * components numbers."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n x - S, exact; as Python's integers where 64 bits don't hold their squares' sum."""
        s = np.array(self.sums, object)
        most = max((abs(int(e) * self.n - int(t)) for edge in (y.min(axis=0), y.max(axis=0)) for e, t in zip(edge, s)), default=0) if len(y) else 0
        if most * most * max(1, y.shape[1]) < 1 << 63:
            return y * self.n - s.astype(np.int64)
        return y.astype(object) * self.n - s

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.vectors / np.sqrt(self.values)


def whitener(n: int, sums: list[int], cross: np.ndarray, components: int = COMPONENTS) -> Whitener:
    """Eigenvectors of the covariance. n^2 times it is n cross - S S', taken in whole numbers. Directions in which the vectors
    don't differ (eigenvalue 0 within the precision) are no components."""
    dims = len(sums)
    if not n or not dims:
        return Whitener(n, sums, np.zeros(0), np.zeros((dims, 0)), np.zeros(0))
    s = np.array(sums, object)
    whole = n * cross - np.outer(s, s)
    trace = sum(int(whole[d, d]) for d in range(dims)) / (n * n)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in whole])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(trace, 0) * dims * np.finfo(float).eps * 4]
    return Whitener(n, sums, values[order], vectors[:, order], values[order] / trace if trace else np.zeros(0))


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, from its rows."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = fit.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType.fromDDL("i int, j int, total double")
    target = to_arrow_schema(schema)

    def run(batches):
        m = shared.value
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = m.whiten(m.centred(_matrix(batch.column("x"), len(m.sums))))
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel(), f.type) for v, f in zip((i.astype(np.int32), j.astype(np.int32), total), target)], schema=target)

    rows = fit.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k + 1, k))
    for r in rows:
        total[r["i"], r["j"]] = r["total"]
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def fit_list(ints: DataFrame) -> tuple[DataFrame, int]:
    """Each different vector once (written to the shared folder), and the number of dimensions: the most frequent one, the
    larger of several. Copies are counted as one before they are shuffled."""
    sizes = ints.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    return staged(ints.filter(F.col("dims") == dims).select("x").distinct(), "fit"), dims


def whiten(embeddings: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """``keep`` columns, component (from 1), n, deviation, whitened, explained, identity_error of each sound row and component.

    Defined cases: vectors that are null or hold a null or non-finite entry go, and so do those whose length isn't the most
    frequent one; empty vectors have no components; if fewer dimensions than ``components`` vary, there are only so many
    components (none for one vector alone); repeated vectors and ids count once in the fit and stay as rows; entries beyond 2^46
    count as 2^46; a deviation that no long holds is null; an empty table gives no rows. Other columns are ignored.
    """
    ints = integers(embeddings, vector, keep)
    fit, dims = fit_list(ints)
    model = whitener(*scatter(fit, dims), components) if dims else Whitener(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    error = identity_error(fit, model)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def work(batch):
        m = shared.value
        for at in range(0, batch.num_rows if k else 0, 1024):
            part = batch.slice(at, 1024)
            centred = m.centred(_matrix(part.column("x"), dims))
            deviation = [int(v) if v < 1 << 63 else None for v in (centred * centred).sum(axis=1)]
            rows = pa.array(np.repeat(np.arange(part.num_rows), k))
            yield {
                **{c: part.column(c).take(rows) for c in keep},
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows),
                "n": np.full(len(rows), m.n),
                "deviation": pa.array(deviation, pa.int64()).take(rows),
                "whitened": m.whiten(centred).ravel(),
                "explained": np.tile(m.explained, part.num_rows),
                "identity_error": np.full(len(rows), error),
            }

    added = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    return map_batches(ints.filter(F.col("dims") == dims), fields(embeddings, keep, added), work)
