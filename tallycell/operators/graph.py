"""Neighbour graphs, fuzzy connectivities, community detection and cluster comparison."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.order_stats import hash_order
from tallycell.operators.neighbours import nearest
from tallycell.session import checkpointed

EMBEDDING_FALLBACK = ("harmony", "scvi", "pca")
#: Resolutions that a sweep compares.
RESOLUTIONS = (0.2, 0.4, 0.6, 0.8, 1.0, 1.2)


def choose_embedding(available: Sequence[str]) -> str:
    """The preferred representation among those present."""
    for rep in EMBEDDING_FALLBACK:
        if rep in available:
            return rep
    raise ValueError(f"no usable embedding among {list(available)}")


def neighbour_graph(embedding: DataFrame, k: int = 15, metric: str = "euclidean", dims: int | None = None,
                    block: int = 2048, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """Each cell's k nearest other cells; exact unless ``probes`` is given."""
    return nearest(embedding, embedding, k, metric, dims, True, block, lists, probes)


def balanced_neighbours(embedding: DataFrame, batch: str, k_per_batch: int = 3, metric: str = "euclidean",
                        block: int = 2048, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """The nearest cells in every batch, so that no batch is left out of a neighbourhood; one job for all batches."""
    return nearest(embedding, embedding, k_per_batch, metric, None, True, block, lists, probes, batch)


def connectivities(edges: DataFrame) -> DataFrame:
    """Fuzzy weights from neighbour distances, made symmetric by ``a + b - a*b``.

    Per cell a bandwidth is searched so that the weights sum to ``log2(k)``; the search runs on arrays of
    k distances, one row per cell.
    """
    rows = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("e"))

    @F.pandas_udf("array<double>")
    def weights(ds: pd.Series) -> pd.Series:
        out = []
        for d in ds:
            d = np.asarray(d, dtype=float)
            positive = d[d > 0]
            rho = positive.min() if len(positive) else 0.0
            gap, goal = np.maximum(d - rho, 0.0), math.log2(max(len(d), 2))
            lo, hi, mid = 0.0, np.inf, 1.0
            for _ in range(64):
                total = np.exp(-gap / mid).sum()
                if abs(total - goal) < 1e-5:
                    break
                if total > goal:
                    hi, mid = mid, (lo + mid) / 2
                else:
                    lo, mid = mid, mid * 2 if hi == np.inf else (mid + hi) / 2
            mid = max(mid, 1e-3 * (d.mean() if len(d) else 1.0), 1e-300)
            out.append(np.exp(-gap / mid))
        return pd.Series(out)

    dists = F.transform("e", lambda s: s["dist"])
    one_way = (rows.select("src", "e", weights(dists).alias("w"))
               .select("src", F.explode(F.arrays_zip(F.transform("e", lambda s: s["dst"]).alias("dst"),
                                                     F.col("w"))).alias("z"))
               .select("src", F.col("z.dst").alias("dst"), F.col("z.w").alias("w")))
    both = one_way.withColumn("fwd", F.lit(True)).union(one_way.select("dst", "src", "w", F.lit(False)))
    a = F.coalesce(F.max(F.when(F.col("fwd"), F.col("w"))), F.lit(0.0))
    b = F.coalesce(F.max(F.when(~F.col("fwd"), F.col("w"))), F.lit(0.0))
    return both.groupBy("src", "dst").agg((a + b - a * b).alias("weight"))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 6, levels: int = 3) -> DataFrame:
    """Modularity communities of a symmetric weighted graph: ``(cell_id, cluster)``, largest first.

    Every round all nodes weigh the communities of their neighbours and move to the best one.  When hardly
    any node moves, communities become the nodes of the next level.  Lineage is cut once a round.
    """
    one = edges.select(F.lit(0).alias("run"), "src", "dst", F.col("weight").alias("w"))
    return communities_of_runs(one, {0: resolution}, rounds, levels).select("cell_id", "cluster")


def _of_run(values: Mapping[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for run, v in values.items() for x in (run, float(v))])[F.col("run")]


def communities_of_runs(edges: DataFrame, resolutions: Mapping[int, float], rounds: int = 6, levels: int = 3) -> DataFrame:
    """``(run, cell_id, cluster)``: the communities of several graphs ``(run, src, dst, w)``, each as ``communities`` finds them, by
    the jobs of one. ``resolutions`` has the resolution of each run (a few dozen of them; the driver keeps some numbers for each)."""
    graph = checkpointed(edges.select("run", "src", "dst", "w"))
    m2 = {r["run"]: r["w"] for r in graph.groupBy("run").agg(F.sum("w").alias("w")).collect()}
    res, total = _of_run(resolutions), _of_run(m2 or {0: 0.0})
    member, open_runs = None, set(m2)
    for _ in range(levels):
        state = checkpointed(graph.groupBy("run", F.col("src").alias("node")).agg(F.sum("w").alias("deg")).withColumn("comm", F.col("node")))
        n_nodes = {r["run"]: r["count"] for r in state.groupBy("run").count().collect()}
        # The edges lie by the end that is asked for its community, so that a round sends nodes to edges and no edges to nodes.
        laid = graph.where(F.col("src") != F.col("dst")).repartition("run", "dst").persist(StorageLevel.MEMORY_AND_DISK)
        moving = set(open_runs)
        for step in range(rounds):
            totals = state.groupBy("run", "comm").agg(F.sum("deg").alias("tot"))
            placed = state.select("run", "node", "comm", "deg").join(totals, ["run", "comm"])
            links = (laid.where(F.col("run").isin(moving)).join(placed.select("run", F.col("node").alias("dst"), "comm", "tot"), ["run", "dst"])
                     .select("run", F.col("src").alias("node"), "comm", "w", "tot", F.lit(None).cast("double").alias("deg")))
            # A node may always stay, even with no link into its own community; nodes of a settled run have nothing else. Only that
            # option has the node's degree.
            stay = placed.select("run", "node", "comm", F.lit(0.0).alias("w"), "tot", "deg")
            options = (links.union(stay).repartition("run", "node").groupBy("run", "node", "comm")
                       .agg(F.sum("w").alias("to"), F.max("tot").alias("tot"), F.max("deg").alias("_deg")))
            mine = Window.partitionBy("run", "node")
            options = (options.withColumn("deg", F.max("_deg").over(mine))
                       .withColumn("own", F.max(F.when(F.col("_deg").isNotNull(), F.col("comm"))).over(mine)))
            others = F.col("tot") - F.when(F.col("comm") == F.col("own"), F.col("deg")).otherwise(0.0)
            gain = F.col("to") - res * F.col("deg") * others / total
            # Odd rounds only look at communities with smaller names, even rounds at larger ones: two nodes
            # can never trade places.
            onward = F.col("comm") < F.col("own") if step % 2 == 0 else F.col("comm") > F.col("own")
            scored = options.where((F.col("comm") == F.col("own")) | onward).withColumn("gain", gain)
            best = scored.groupBy("run", "node").agg(
                F.first("deg").alias("deg"), F.first("own").alias("own"),
                F.min_by("comm", F.struct(-F.round("gain", 9), F.col("comm"))).alias("best"),
                F.max("gain").alias("top"),
                F.max(F.when(F.col("comm") == F.col("own"), F.col("gain"))).alias("stay"))
            go = F.col("top") > F.col("stay") + 1e-9
            state = checkpointed(best.select("run", "node", "deg", F.when(go, F.col("best")).otherwise(F.col("own")).alias("comm"), go.alias("moved")))
            if step % 2:
                moved = {r["run"]: r["n"] for r in state.groupBy("run").agg(F.count_if("moved").alias("n")).collect()}
                moving = {run for run in moving if moved[run] > n_nodes[run] * 0.001}
                if not moving:
                    break
        laid.unpersist()
        link = state.select("run", "node", "comm")
        member = link.toDF("run", "cell_id", "c") if member is None else (
            member.join(link.toDF("run", "c", "d"), ["run", "c"], "left").select("run", "cell_id", F.coalesce("d", "c").alias("c")))
        member = checkpointed(member)
        left = {r["run"]: r["n"] for r in state.groupBy("run").agg(F.countDistinct("comm").alias("n")).collect()}
        open_runs = {run for run in open_runs if left[run] < n_nodes[run]}
        if not open_runs:
            break
        graph = checkpointed(
            graph.where(F.col("run").isin(open_runs)).join(link.toDF("run", "src", "a"), ["run", "src"]).join(link.toDF("run", "dst", "b"), ["run", "dst"])
            .groupBy("run", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    sizes = member.groupBy("run", "c").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("run").orderBy(F.desc("n"), "c")
    names = sizes.select("run", "c", (F.row_number().over(order) - 1).cast("string").alias("cluster"))
    return member.join(names, ["run", "c"]).select("run", "cell_id", "cluster")


def cluster_column(resolution: float) -> str:
    """Column name of a clustering; the decimal point becomes an underscore."""
    return f"leiden_res{resolution:g}".replace(".", "_")


def cluster_warnings(labels: DataFrame, min_size: int = 20, max_clusters: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Number of clusters, how many are tiny, and whether the graph looks over-split; one row, or one for each value of ``by``."""
    sizes = labels.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n") < min_size).alias("n_tiny"),
                                  F.min("n").alias("min_size")).withColumn("over_split", F.col("n_clusters") > max_clusters)


def adjusted_rand(labels: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two label columns; one row ``ari``, or one for each value of ``by``."""
    def pairs(c):
        return c.cast("double") * (c - 1) / 2

    def of(label: str, name: str) -> DataFrame:
        sizes = cells.groupBy(*by, label).agg(F.sum("n").alias("n"))
        return sizes.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias(name))

    def beside(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, list(by)) if by else x.crossJoin(y)

    cells = labels.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    s = beside(beside(both, of(a, "one")), of(b, "two")).withColumn("every", pairs(F.col("n")))
    chance = F.col("one") * F.col("two") / F.col("every")
    top = (F.col("one") + F.col("two")) / 2
    return s.select(*by, F.when(top == chance, 1.0).otherwise((F.col("both") - chance) / (top - chance)).alias("ari"))


def silhouette(labels: DataFrame, embedding: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distance, from cluster sums (no pairwise distances)."""
    codes = labels.select("cell_id", F.col("cluster").cast("int").alias("prediction"))
    data = embedding.select("cell_id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    return ClusteringEvaluator().evaluate(data.join(codes, "cell_id"))


def resolution_sweep(embedding: DataFrame, edges: DataFrame, resolutions: Sequence[float] = RESOLUTIONS,
                     n_boot: int = 3, share: float = 0.8, seed: int = 0, rounds: int = 6,
                     levels: int = 3) -> DataFrame:
    """Compare resolutions by stability, separation and tiny clusters; one row per resolution.

    Stability is the adjusted Rand index between the clustering and reclusterings of ``share`` of the
    cells (picked by hash order, so that runs repeat). All clusterings, of all cells and of the shares, go through the same jobs.
    """
    def drawn(b: int, c: str) -> Column:
        return F.conv(F.substring(hash_order(seed + b, c), 1, 8), 16, 10).cast("bigint") < int(share * 2 ** 32)

    # Run i of n is resolution i on all cells, run b * n + i on those of draw b.
    n = len(resolutions)
    each = [F.array(*[F.lit(b * n + i) for i in range(n)]) for b in range(n_boot + 1)]
    none = F.array().cast("array<int>")
    within = [F.when(drawn(b, "src") & drawn(b, "dst"), each[b]).otherwise(none) for b in range(1, n_boot + 1)]
    graphs = edges.select(F.explode(F.concat(each[0], *within)).alias("run"), "src", "dst", F.col("weight").alias("w"))
    found = checkpointed(communities_of_runs(graphs, {b * n + i: r for b in range(n_boot + 1) for i, r in enumerate(resolutions)}, rounds, levels)
                         .select((F.col("run") % n).alias("i"), F.floor(F.col("run") / n).cast("int").alias("draw"), "cell_id", "cluster"))
    full = found.where("draw = 0").drop("draw")
    again = found.where("draw > 0").withColumnRenamed("cluster", "again")
    aris = {r["i"]: r["ari"] for r in adjusted_rand(full.join(again, ["i", "cell_id"]), "cluster", "again", ["i", "draw"])
            .groupBy("i").agg(F.avg("ari").alias("ari")).collect()}
    rows = []
    for w in sorted(cluster_warnings(full, by=["i"]).collect(), key=lambda r: r["i"]):
        i, tiny = w["i"], w["n_tiny"]
        sil = silhouette(full.where(F.col("i") == i), embedding) if w["n_clusters"] > 1 else 0.0
        ari = float(aris.get(i, 0.0))
        rows.append((float(resolutions[i]), w["n_clusters"], float(sil), ari, w["min_size"], tiny,
                     2 * ari + float(sil) - 0.15 * tiny))
    return embedding.sparkSession.createDataFrame(
        rows, "resolution double, n_clusters bigint, silhouette double, ari double, min_size bigint, "
              "n_tiny bigint, score double")
