"""Diffusion components of a neighbour graph and pseudotime from a root.

The leading eigenvectors of the density-normalised, symmetric transition matrix come from block iteration: a block of columns is
multiplied by the matrix (partial sums before the shuffle) through a Chebyshev polynomial
that damps the unwanted part of the spectrum. Cells are dealt to parts of bounded size, whose rows and edges lie in arrays, and a whole
polynomial is one job with a shuffle of edges and partial sums for each of its products. Between polynomials the block is made orthonormal and rotated to its Ritz vectors by
the Gram matrix of its few columns, which is all the driver sees. Iteration ends when the residuals are below ``tol``; a block that
isn't there after ``rounds`` is an error, never a quiet result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.order_stats import attach
from tallycell.session import checkpointed

#: Eigenvalues from here on belong to the stationary states of the graph's parts: they carry no time.
STATIONARY = 0.9994
#: Cells of a part at most, about: its rows of the block and the edges that end in it are one row of a table.
PART = 1 << 13


class Components(NamedTuple):
    """cell_id and columns x0, x1, ...; eigenvalues, largest first; norm of T x - value x of each."""

    cells: DataFrame
    values: np.ndarray
    residuals: np.ndarray


def transitions(edges: DataFrame) -> DataFrame:
    """``(src, dst, t)``: weights over both ends' densities, made symmetric by the row sums."""
    e = edges.where("weight > 0").select("src", "dst", F.col("weight").cast("double").alias("w"))

    def scaled(e: DataFrame, power: float) -> DataFrame:
        q = e.groupBy(F.col("src").alias("node")).agg(F.pow(F.sum("w"), power).alias("q"))
        return (e.join(q.select(F.col("node").alias("src"), F.col("q").alias("_a")), "src").join(q.select(F.col("node").alias("dst"), F.col("q").alias("_b")), "dst")
                .select("src", "dst", (F.col("w") / F.col("_a") / F.col("_b")).alias("w")))
    return scaled(checkpointed(scaled(e, 1.0)), 0.5).withColumnRenamed("w", "t")


def _names(m: int) -> list[str]:
    return [f"x{i}" for i in range(m)]


def _packed(rows: DataFrame, columns: list[str], kinds: list[type]) -> DataFrame:
    """One row ``part`` and the bytes of each column, in the order of the rows, for each part of ``rows``, which come part by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in held]], ["part", *columns])
        now, held = None, []
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            values = [np.stack(batch.column(c).to_numpy(zero_copy_only=False)).astype(k) if pa.types.is_list(batch.column(c).type) else batch.column(c).to_numpy().astype(k)
                      for c, k in zip(columns, kinds, strict=True)] if len(part) else []
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if part[i] != now:
                    if now is not None:
                        yield row()
                    now, held = int(part[i]), [[] for _ in columns]
                for x, v in zip(held, values, strict=True):
                    x.append(v[i:j])
        if now is not None:
            yield row()
    return rows.mapInArrow(run, "part int, " + ", ".join(f"{c} binary" for c in columns))


def _matrix(x: bytes, m: int) -> np.ndarray:
    return np.frombuffer(x).reshape(-1, m)


_FLOW = ["part", "side", "a", "b"]


def _turn(flow: DataFrame, matrix: DataFrame, m: int, parts: int, times: float, own: float, before: float, last: bool = False) -> DataFrame:
    """One product. ``flow`` has, for each part, a block and the one before it (side 0) and sums of the matrix times the block from all
    parts (side 1). Of them the part's next block is made, ``times`` the sums + ``own`` block + ``before`` the one before; with the
    edges that end in the part (side 2) it gives the sums for the turn that follows, or, if it is the ``last``, ``(part, now, last)``."""
    def row(part: int, side: int, a: bytes, b: bytes) -> pa.RecordBatch:
        if last:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["part", "now", "last"])
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([side], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], _FLOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, former, total = b"", b"", np.zeros((0, m))
        for batch in batches:
            for i in range(batch.num_rows):
                part, side, a, b = (batch.column(c)[i].as_py() for c in _FLOW)
                if side == 0:
                    now, former, total = a, b, np.zeros((len(a) // 8 // m, m))
                elif side == 1:
                    total[np.frombuffer(a, np.int32)] += _matrix(b, m)
                else:
                    x = times * total + own * _matrix(now, m) + before * _matrix(former, m)
                    yield row(part, 0, x.tobytes(), now)
                    if last:
                        continue
                    (to, at, end), t = np.frombuffer(a, np.int32).reshape(3, -1), np.frombuffer(b)
                    bounds = np.searchsorted(to, np.arange(parts + 1))
                    for j in np.flatnonzero(np.diff(bounds)):
                        some = slice(bounds[j], bounds[j + 1])
                        first = np.concatenate([[0], np.flatnonzero(np.diff(at[some])) + 1])
                        yield row(int(j), 1, at[some][first].tobytes(), np.add.reduceat(x[end[some]] * t[some, None], first, axis=0).tobytes())

    met = flow.unionByName(matrix).repartition(parts, "part").sortWithinPartitions("part", "side")
    return met.mapInArrow(run, "part int, now binary, last binary" if last else "part int, side int, a binary, b binary")


def _begun(block: DataFrame, matrix: DataFrame, m: int, parts: int) -> DataFrame:
    """A flow that has the sums of the matrix times ``now`` of a block."""
    return _turn(block.select("part", F.lit(0).alias("side"), F.col("now").alias("a"), F.col("now").alias("b")), matrix, m, parts, 0.0, 1.0, 0.0)


def _rotated(block: DataFrame, column: str, by: np.ndarray) -> DataFrame:
    """``(part, now, last)``, both the ``column`` of ``block`` times a small matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([(_matrix(v, len(by)) @ by).tobytes() for v in batch.column(column).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("part"), x, x], ["part", "now", "last"])
    return block.select("part", column).mapInArrow(run, "part int, now binary, last binary")


def _gram(block: DataFrame, m: int, left: list[str], right: str) -> np.ndarray:
    """Products of the columns of ``left`` and ``right`` summed over all rows: a small matrix from each task, added up by Spark."""
    size = len(left) * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, m))
        for batch in batches:
            for r in batch.to_pylist():
                total += np.hstack([_matrix(r[c], m) for c in left]).T @ _matrix(r[right], m)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])
    out = np.zeros((size, m))
    for r in block.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _filtered(matrix: DataFrame, block: DataFrame, m: int, parts: int, upper: float, degree: int) -> DataFrame:
    """The Chebyshev polynomial that is small on [-1, upper], applied to a block; one job."""
    centre, half = (upper - 1) / 2, (upper + 1) / 2
    out = _begun(block, matrix, m, parts)
    for i in range(degree):
        first = i == 0
        out = _turn(out, matrix, m, parts, (1 if first else 2) / half, -(1 if first else 2) * centre / half, 0.0 if first else -1.0, i == degree - 1)
    return checkpointed(out)


def _orthonormal(block: DataFrame, m: int) -> DataFrame:
    gram = _gram(block, m, ["now"], "now")
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    values, vectors = np.linalg.eigh(gram / size[:, None] / size[None, :])
    return _rotated(block, "now", (vectors / np.sqrt(np.maximum(values, 1e-14))) / size[:, None])


def _cells(block: DataFrame, nodes: DataFrame, n: int, m: int) -> DataFrame:
    """cell_id and the first ``n`` columns of ``now``."""
    names = _names(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _matrix(r["now"], m)
                at = np.arange(len(x), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r["part"], np.int32)), pa.array(at), *[pa.array(x[:, i].copy()) for i in range(n)]], ["part", "at", *names])
    rows = block.select("part", "now").mapInArrow(run, "part int, at int, " + ", ".join(f"{c} double" for c in names))
    return checkpointed(nodes.join(rows, ["part", "at"]).select("cell_id", *names))


def components(edges: DataFrame, n: int = 15, extra: int = 5, tol: float = 1e-4, degree: int = 8, rounds: int = 60, seed: int = 0) -> Components:
    """The ``n`` leading diffusion components of symmetric weighted ``edges``; fewer where the graph has fewer cells."""
    t = checkpointed(transitions(edges))
    nodes = t.select(F.col("src").alias("cell_id")).distinct()
    size = nodes.count()
    m = min(n + extra, size)
    n = min(n, m)
    if not n:
        raise ValueError("the graph has no edges")
    parts = max(1, math.ceil(size / PART), min(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(size / 512)))
    placed = nodes.withColumn("part", F.pmod(F.xxhash64("cell_id"), F.lit(parts)).cast("int"))
    order = Window.partitionBy("part").orderBy("cell_id")
    nodes = checkpointed(placed.select("cell_id", "part", (F.row_number().over(order) - 1).alias("at")))
    ends = (t.join(nodes.select(F.col("cell_id").alias("src"), F.col("part").alias("to"), "at"), "src")
            .join(nodes.select(F.col("cell_id").alias("dst"), "part", F.col("at").alias("end")), "dst").select("part", "to", "at", "end", "t"))
    laid = _packed(ends.repartition(parts, "part").sortWithinPartitions("part", "to", "at", "end"), ["to", "at", "end", "t"], [np.int32, np.int32, np.int32, np.float64])
    matrix = checkpointed(laid.select("part", F.lit(2).alias("side"), F.concat("to", "at", "end").alias("a"), F.col("t").alias("b")))
    draws = F.array(*[F.xxhash64(F.lit(seed), F.lit(i), F.col("cell_id").cast("string")) / F.lit(2.0 ** 63) for i in range(m)])
    start = nodes.select("part", "at", draws.alias("now")).repartition(parts, "part").sortWithinPartitions("part", "at")
    block = _orthonormal(checkpointed(_packed(start, ["now"], [np.float64])), m)
    for _ in range(rounds):
        both = checkpointed(_turn(_begun(block, matrix, m, parts), matrix, m, parts, 1.0, 0.0, 0.0, True))
        products = _gram(both, m, ["last", "now"], "now")
        ritz, square = products[:m], products[m:]
        values, vectors = np.linalg.eigh((ritz + ritz.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", vectors, square, vectors) - values ** 2, 0))
        block = _rotated(both, "last", vectors)
        if residuals[:n].max() <= tol or m == size:
            return Components(_cells(block, nodes, n, m), values[:n], residuals[:n])
        block = _orthonormal(_filtered(matrix, block, m, parts, float(min(values[-1], 0.999)), degree), m)
    raise ValueError(f"residuals are {residuals[:n].max():.2g} after {rounds} rounds")


def choose_root(found: Components, cells: DataFrame, root_label: str, label: str = "label") -> DataFrame:
    """The cell of ``root_label`` nearest to the label's mean in the second to fourth component; of equal ones the first by id."""
    axes = _names(len(found.values))[1:4]
    mine = found.cells.join(cells.where(F.col(label) == root_label).select("cell_id"), "cell_id").select("cell_id", *axes)
    means = mine.agg(*[F.avg(c).alias("_m" + c) for c in axes])
    far = sum(((F.col(c) - F.col("_m" + c)) ** 2 for c in axes), F.lit(0.0))
    return attach(mine, means, []).agg(F.min_by("cell_id", F.struct(F.round(far, 12), F.col("cell_id"))).alias("root"))


def pseudotime(found: Components, root: DataFrame) -> DataFrame:
    """``(cell_id, pseudotime)``: diffusion distance from ``root`` (one row), scaled so that the farthest cell has one. Cells that have
    no edges aren't in it."""
    names = _names(len(found.values))
    here = root.join(found.cells, F.col("root") == F.col("cell_id")).select(*[F.col(c).alias("_r" + c) for c in names])
    weight = [1.0 if v >= STATIONARY else float(v / (1 - v)) for v in found.values]
    far = F.sqrt(sum(((F.col(c) - F.col("_r" + c)) ** 2 * w ** 2 for c, w in zip(names, weight, strict=True)), F.lit(0.0)))
    apart = checkpointed(attach(found.cells, here, []).select("cell_id", far.alias("d")))
    most = apart.agg(F.max("d").alias("_most"))
    return attach(apart, most, []).select("cell_id", F.when(F.col("_most") > 0, F.col("d") / F.col("_most")).otherwise(0.0).alias("pseudotime"))


def diffusion_pseudotime(edges: DataFrame, cells: DataFrame, root_label: str, label: str = "label", n: int = 15) -> DataFrame:
    """``(cell_id, pseudotime)`` for all ``cells``; NULL for a cell without edges. An unknown ``root_label`` is an error."""
    found = components(edges, n)
    root = choose_root(found, cells, root_label, label)
    if root.first()[0] is None:
        raise ValueError(f"no cell with edges has the label {root_label!r}")
    return cells.select("cell_id").join(pseudotime(found, root), "cell_id", "left")


def residual_table(found: Components) -> DataFrame:
    """One row per component: ``component, eigenvalue, residual``."""
    rows = [(i, float(v), float(r)) for i, (v, r) in enumerate(zip(found.values, found.residuals, strict=True))]
    return found.cells.sparkSession.createDataFrame(rows, "component int, eigenvalue double, residual double")
