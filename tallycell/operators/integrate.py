"""Batch confounding checks, batch mixing scores and iterative batch correction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.numeric import ratio
from tallycell.session import checkpointed


def contingency(obs: DataFrame, batch: str, candidates: Sequence[str]) -> DataFrame:
    """Cell numbers per ``(candidate, batch, bio)``; occupied combinations only."""
    long = obs.unpivot([F.col(batch)], [F.col(c).cast("string").alias(c) for c in candidates], "candidate", "bio")
    return (long.groupBy("candidate", F.col(batch).cast("string").alias("batch"), "bio")
            .agg(F.count(F.lit(1)).alias("n")))


def cramers_v(table: DataFrame) -> DataFrame:
    """Association of batch and each candidate, without continuity correction.

    ``chi2 = n * (sum o^2 / (row * col) - 1)`` needs the occupied cells only.  Fewer than two levels on
    either side count as full association.
    """
    rows = table.groupBy("candidate", "batch").agg(F.sum("n").alias("r"))
    cols = table.groupBy("candidate", "bio").agg(F.sum("n").alias("c"))
    n = F.col("n").cast("double")
    share = (table.join(rows, ["candidate", "batch"]).join(cols, ["candidate", "bio"]).groupBy("candidate")
             .agg(F.sum(n * n / (F.col("r") * F.col("c"))).alias("q")))
    levels = (rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_batch"))
              .join(cols.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_bio")), "candidate"))
    small = F.least("n_batch", "n_bio")
    return share.join(levels, "candidate").select(
        "candidate", "n_batch", "n_bio",
        F.when(small < 2, F.lit(1.0)).otherwise(
            F.sqrt(F.greatest(F.lit(0.0), F.col("q") - 1) / (small - 1))).alias("cramers_v"))


def confounding_guard(table: DataFrame, min_cells: int = 10) -> DataFrame:
    """Is it safe to correct for batch?  Confounded when some level of a candidate occupies under two batches."""
    occupied = (F.col("n") >= min_cells).cast("int")
    per_bio = table.groupBy("candidate", "bio").agg(F.sum(occupied).alias("b"))
    per_batch = table.groupBy("candidate", "batch").agg(F.sum(occupied).alias("b"))
    least = per_bio.groupBy("candidate").agg(F.min("b").alias("min_batches"))
    spanning = per_batch.groupBy("candidate").agg(F.count_if(F.col("b") > 1).alias("n_spanning"))
    safe = F.col("min_batches") >= 2
    return (cramers_v(table).join(least, "candidate").join(spanning, "candidate")
            .withColumn("confounded", ~safe).withColumn("nested_but_safe", safe & (F.col("cramers_v") > 0.9)))


def worst_confounder(guard: DataFrame) -> DataFrame:
    """The candidate to worry about most: confounded first, then by association."""
    return guard.orderBy(F.desc("confounded"), F.desc(F.round("cramers_v", 9)), "candidate").limit(1)


def inverse_simpson(neighbours: DataFrame, obs: DataFrame, column: str) -> DataFrame:
    """Effective number of levels of ``column`` among each cell's neighbours: ``(cell_id, lisi)``.

    ``neighbours`` has one row ``(src, dst)`` per edge.
    """
    level = obs.select(F.col("cell_id").alias("dst"), F.col(column).alias("level"))
    per = neighbours.select("src", "dst").join(level, "dst").groupBy("src", "level").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("src").agg(
        (F.pow(F.sum("n"), F.lit(2)) / F.sum(F.col("n") * F.col("n"))).alias("lisi")).withColumnRenamed("src", "cell_id")


def mixing_report(before: DataFrame, after: DataFrame, obs: DataFrame, batch: str, label: str) -> DataFrame:
    """Mean batch and label LISI on two neighbour tables, with the gain and the cost of correction."""
    def mean(nb: DataFrame, column: str):
        return inverse_simpson(nb, obs, column).agg(F.avg("lisi")).toDF("m").scalar()

    return before.sparkSession.range(1).select(
        mean(before, batch).alias("batch_before"), mean(after, batch).alias("batch_after"),
        mean(before, label).alias("label_before"), mean(after, label).alias("label_after")).select(
        "*", (F.col("batch_after") - F.col("batch_before")).alias("batch_gain"),
        (F.col("label_after") - F.col("label_before")).alias("label_cost"))


def harmonize(embedding: DataFrame, batch: str, n_clusters: int = 20, theta: float = 2.0, lamb: float = 1.0,
              sigma: float = 0.1, max_iter: int = 10, seed: int = 0, tol: float = 1e-4) -> DataFrame:
    """Remove batch effects from an embedding by soft clustering with a diversity penalty.

    Input ``(cell_id, v, batch column)``.  Each round: soft assignments on unit vectors against broadcast
    centroids, with clusters over-filled by a batch made less attractive; per (cluster, batch) sums by
    aggregation; a small ridge solve per cluster on the driver; corrected vectors.  What reaches the driver
    is clusters x batches x dimensions, whatever the number of cells.
    """
    spark = embedding.sparkSession
    base = embedding.select("cell_id", F.col(batch).cast("string").alias("batch"), "v")
    levels = base.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect()
    names = [r["batch"] for r in levels]
    if len(names) < 2:
        raise ValueError("correction needs at least two batches")
    if len(names) * n_clusters > 1_000_000:
        raise ValueError("too many batches for the per-cluster solves")
    share = np.array([r["n"] for r in levels], dtype=float)
    n_all = share.sum()
    share /= n_all
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12)))
    km = KMeans(k=n_clusters, seed=seed, maxIter=25, initSteps=5).fit(
        base.select(array_to_vector(unit).alias("features")))
    centroids = np.array(km.clusterCenters())
    k, dim, b = len(centroids), centroids.shape[1], len(names)
    index = {name: i for i, name in enumerate(names)}
    balance = np.ones((k, b))
    work = base.withColumn("z", F.col("v"))
    previous = None
    for step in range(max_iter):
        y = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        penalty = balance ** theta
        state = spark.sparkContext.broadcast((y, penalty))

        def soft(z: np.ndarray, bi: np.ndarray, state=state) -> np.ndarray:
            y, penalty = state.value
            u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            e = -2.0 * (1.0 - u @ y.T) / sigma
            r = np.exp(e - e.max(axis=1, keepdims=True)) * penalty.T[bi]
            return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)

        def totals(batches):
            """Per-partition sums: one row per batch with assignment mass and weighted vectors."""
            acc = np.zeros((b, k, 1 + 2 * dim))
            for pdf in batches:
                z, v = np.vstack(pdf["z"].to_numpy()), np.vstack(pdf["v"].to_numpy())
                bi = pdf["batch"].map(index).to_numpy()
                r = soft(z, bi)
                u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                for i in np.unique(bi):
                    m = bi == i
                    acc[i, :, 0] += r[m].sum(axis=0)
                    acc[i, :, 1:1 + dim] += r[m].T @ v[m]
                    acc[i, :, 1 + dim:] += r[m].T @ u[m]
            for i in range(b):
                for c in range(k):
                    yield pd.DataFrame({"b": [i], "c": [c], "s": [acc[i, c].tolist()]})

        rows = (work.mapInPandas(totals, "b int, c int, s array<double>")
                .select("b", "c", F.posexplode("s").alias("i", "x")).groupBy("b", "c", "i")
                .agg(F.sum("x").alias("x")).groupBy("b", "c")
                .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).collect())
        sums = np.zeros((b, k, 1 + 2 * dim))
        for row in rows:
            sums[row["b"], row["c"]] = [e["x"] for e in row["s"]]
        mass, moved = sums[:, :, 0], sums[:, :, 1:1 + dim]
        centroids = sums[:, :, 1 + dim:].sum(axis=0)
        expected = np.outer(mass.sum(axis=0), share)
        balance = (expected + 1.0) / (mass.T + 1.0)
        shift = np.zeros((k, b, dim))
        for c in range(k):
            design = np.zeros((b + 1, b + 1))
            design[0, 0] = mass[:, c].sum()
            design[0, 1:] = design[1:, 0] = mass[:, c]
            design[1:, 1:] = np.diag(mass[:, c])
            design += np.diag([0.0] + [lamb] * b)
            target = np.vstack([moved[:, c].sum(axis=0), moved[:, c]])
            shift[c] = np.linalg.lstsq(design, target, rcond=None)[0][1:]
        bshift = spark.sparkContext.broadcast(shift)

        def correct(batches):
            for pdf in batches:
                z, v = np.vstack(pdf["z"].to_numpy()), np.vstack(pdf["v"].to_numpy())
                bi = pdf["batch"].map(index).to_numpy()
                r = soft(z, bi)
                out = v - np.einsum("nk,nkd->nd", r, bshift.value.transpose(1, 0, 2)[bi])
                yield pdf.assign(z=list(out))

        work = checkpointed(work.mapInPandas(correct, work.schema))
        size = float(np.abs(shift).mean())
        if previous is not None and abs(previous - size) <= tol * max(previous, 1e-12):
            break
        previous = size
    return work.select("cell_id", "batch", F.col("z").alias("v"))
