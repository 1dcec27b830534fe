"""Embedding whitening by an exact two-pass covariance.

Entries become integers on a grid. The first pass sums the distinct vectors exactly; the second sums the outer products of
centred blocks, one matrix product a block, merged in a tree of tasks. The driver gets one matrix of dimensions squared
and its eigenvectors by LAPACK; the projection is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiddenpath.llm.common import cut

GRID, SHIFT = 64, 1_000_000
#: Entries of this size or more have no place on the grid of 64-bit integers.
TOO_LARGE = 2.0**54
#: Dimensions at most: the driver's matrix takes 8 bytes for each pair, the broadcast projection 8 for each dimension and component.
MOST_DIMENSIONS = 4096
#: Vectors of a matrix product.
BLOCK_ROWS = 4096
_LOW = np.int64(0xFFFFFFFF)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """One row: per dimension the sums of high halves, of low halves, and the largest magnitude."""
    out = np.zeros((3, dims), np.int64)
    for _, x in _blocks(batches, dims):
        out[0] += (x >> 32).sum(0)
        out[1] += (x & _LOW).sum(0)
        out[2] = np.maximum(out[2], np.abs(x).max(0))
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])


def exact_offsets(x: np.ndarray, n: int, total: list[int], wide: bool) -> np.ndarray:
    """n * x - S, exact: 64-bit integers, or Python's where those could overflow."""
    if wide:
        return x.astype(object) * n - np.array(total, object)
    return x * np.int64(n) - np.array(total, np.int64)


def _products(batches: Iterator[pa.RecordBatch], dims: int, n: int, total: list[int], wide: bool, projection: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row: the sum of outer products of the centred vectors, projected where a projection is given."""
    out = None
    for _, x in _blocks(batches, dims):
        y = (exact_offsets(x, n, total, wide) / n).astype(np.float64)
        if projection is not None:
            y = y @ projection
        out = y.T @ y if out is None else out + y.T @ y
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])


def _add_sums(a: np.ndarray | None, b: bytes | np.ndarray | None) -> np.ndarray | None:
    """Sums of halves, with carries from the low ones, and the larger magnitudes."""
    if b is None:
        return a
    b = np.frombuffer(b, np.int64).reshape(3, -1) if isinstance(b, bytes | bytearray) else b
    if a is None:
        return b
    low = a[1] + b[1]
    return np.array([a[0] + b[0] + (low >> 32), low & _LOW, np.maximum(a[2], b[2])])


def _add_products(a: np.ndarray | None, b: bytes | np.ndarray | None) -> np.ndarray | None:
    if b is None:
        return a
    b = np.frombuffer(b, np.float64) if isinstance(b, bytes | bytearray) else b
    return b if a is None else a + b


def squares(offsets: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None where one doesn't fit a long."""
    if offsets.dtype == object:
        sums = [int(v) for v in (offsets * offsets).sum(1)] if offsets.shape[1] else [0] * len(offsets)
        return [v if v < 2**63 else None for v in sums]
    about = (offsets.astype(np.float64) ** 2).sum(1)
    with np.errstate(over="ignore"):
        sure = (offsets * offsets).sum(1)  # modulo 2**64, and right where the sum fits
    out: list[int | None] = sure.tolist()
    for i in np.flatnonzero(about > 2.0**63 * (1 - 1e-9)):
        exact = sum(int(v) ** 2 for v in offsets[i])
        out[i] = exact if exact < 2**63 else None
    return out


def _project(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    m = model.value
    for part, x in _blocks(batches, m["dims"]):
        offsets = exact_offsets(x, m["n"], m["total"], m["wide"])
        white = ((offsets / m["n"]).astype(np.float64) @ m["projection"]).reshape(-1)
        k, rows = m["projection"].shape[1], len(x)
        none = np.tile(~m["spread"], rows)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id").take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, m["n"], np.int64)),
                pa.array(squares(offsets), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(white, mask=none),
                pa.array(np.tile(m["explained"], rows), mask=np.tile(np.isnan(m["explained"]), rows)),
                pa.array(np.full(rows * k, m["error"]), mask=np.full(rows * k, np.isnan(m["error"]))),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(vectors: DataFrame, identifier: str = "vec_id", column: str = "embedding", components: int = 16) -> DataFrame:
    """Whitened leading components: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    An entry c becomes x = floor(64 * c) + 1000000. Mean and covariance (divisor n) are those of the distinct x vectors.
    A row of the result is one vector's component, numbered by falling eigenvalue; each eigenvector's largest entry is positive.
    ``deviation`` is the exact sum over dimensions of (n * x - S) ** 2, null where that is no 64-bit integer.

    Rows are left out if the vector is null or empty, has a null, NaN or infinite entry, one of 2 ** 54 or more (no
    place on the grid), or another number of entries than most vectors (ties: than the longer ones). Components
    without variance, up to rounding, have a null ``whitened`` and don't count in ``identity_error``; if no component has any,
    ``explained`` and ``identity_error`` are null. Ids may be null or repeat; other columns are ignored. An empty table gives
    an empty result. More than MOST_DIMENSIONS dimensions are refused.
    """
    spark = vectors.sparkSession
    fine = F.forall(F.col("v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    rows = vectors.select(F.col(f"`{identifier}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["dims"]
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; at most {MOST_DIMENSIONS} are whitened")
    grid = rows.where(F.size("v") == dims).select("id", F.transform("v", lambda c: F.floor(c * GRID) + SHIFT).alias("x"))
    fit = cut(grid.select("x").distinct())

    sums = fit.mapInArrow(partial(_sums, dims=dims), "part binary").rdd.map(lambda r: r.part).treeAggregate(None, _add_sums, _add_sums)
    n = fit.count()
    total = [(int(h) << 32) + int(low) for h, low in zip(sums[0], sums[1], strict=True)]
    wide = int(sums[2].max()) * n >= 2**61

    def products(projection: np.ndarray | None) -> np.ndarray:
        task = partial(_products, dims=dims, n=n, total=total, wide=wide, projection=projection)
        return fit.mapInArrow(task, "part binary").rdd.map(lambda r: r.part).treeAggregate(None, _add_products, _add_products)

    covariance = products(None).reshape(dims, dims) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, dims)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None, :], 0)[0] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    spread = values > trace * dims * 2.0**-50
    projection = np.where(spread, axes / np.sqrt(np.where(spread, values, 1.0)), 0.0)
    used = int(spread.sum())
    error = float(np.abs(products(np.ascontiguousarray(projection[:, :used])).reshape(used, used) / n - np.eye(used)).max()) if used else np.nan
    explained = np.maximum(values, 0) / trace if trace > 0 else np.full(k, np.nan)
    model = spark.sparkContext.broadcast({"dims": dims, "n": n, "total": total, "wide": wide, "projection": projection, "spread": spread, "explained": explained, "error": error})
    return grid.mapInArrow(partial(_project, model=model), schema)
