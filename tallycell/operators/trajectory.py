"""Root choice, pseudotime checks, cluster connectivity, fate flow and genes along pseudotime."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from tallycell.functions.numeric import first_number
from tallycell.functions.order_stats import attach, average_ranks, quantile_name, quantiles
from tallycell.session import checkpointed


def choose_root(assigned: DataFrame, edges: DataFrame, root_label: str, min_share: float = 0.35) -> DataFrame:
    """The node to start from: ``assigned`` is ``(cell_id, node, label, time)``, ``edges`` the tree ``(a, b)``.

    Nodes rich in the root label come first, then leaves, then purity plus a quarter of the share of
    earliest cells.
    """
    t = first_number("time")
    start = assigned.agg(F.min(t).alias("t0"))
    per = attach(assigned, start, []).groupBy("node").agg(
        F.avg((F.col("label") == root_label).cast("double")).alias("purity"),
        F.avg(F.coalesce((t == F.col("t0")).cast("double"), F.lit(0.0))).alias("early"))
    degree = edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return (per.join(degree, "node", "left").fillna(0, ["degree"])
            .withColumn("rich", F.col("purity") >= min_share).withColumn("is_leaf", F.col("degree") == 1)
            .withColumn("merit", F.col("purity") + 0.25 * F.col("early"))
            .orderBy(F.desc("rich"), F.desc("is_leaf"), F.desc(F.round("merit", 9)), "node").limit(1)
            .select("node", "purity", "is_leaf", "merit"))


def time_correlation(cells: DataFrame, pseudotime: str, time: str) -> DataFrame:
    """Spearman correlation of pseudotime with the number in the time label; warns when near zero."""
    t = cells.select(F.col(pseudotime).alias("p"), first_number(time).alias("t")).where("p IS NOT NULL AND t IS NOT NULL")
    ranked = average_ranks(average_ranks(t, [], "p", "rp"), [], "t", "rt")
    return ranked.agg(F.corr("rp", "rt").alias("rho"), F.count(F.lit(1)).alias("n")).withColumn(
        "warn", (F.abs("rho") < 0.15) & (F.col("n") > 50))


def cluster_connectivity(edges: DataFrame, labels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges between clusters over the number expected by chance, capped at one."""
    a = labels.select(F.col("cell_id").alias("src"), F.col("label").alias("a"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("b"))
    m = checkpointed(edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    sizes = labels.groupBy(F.col("label").alias("a")).agg(F.count(F.lit(1)).alias("size"))
    out = m.groupBy("a").agg(F.sum("n").alias("es")).join(sizes, "a")
    total = labels.agg(F.count(F.lit(1)).alias("n_all"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    inter = m.where("a <> b").groupBy(low.alias("a"), high.alias("b")).agg(F.sum("n").alias("n"))
    other = out.select(F.col("a").alias("b"), F.col("es").alias("es_b"), F.col("size").alias("size_b"))
    expected = (F.col("es") * F.col("size_b") + F.col("es_b") * F.col("size")) / (F.col("n_all") - 1)
    return attach(inter.join(out, "a").join(other, "b"), total, []).select(
        "a", "b", F.least(F.lit(1.0), F.col("n") / expected).alias("connectivity")).where(F.col("connectivity") > threshold)


def fate_probabilities(edges: DataFrame, cells: DataFrame, time: str = "timepoint", label: str = "label") -> DataFrame:
    """Probability of ending in each final label when steps lead only from one time to the next.

    ``edges`` are weighted neighbours ``(src, dst, weight)``; cells of the last time are absorbed by their
    own label.  One backward pass per time step: ``(cell_id, fate, p)``.  A cell without a time or without an
    onward path has one row with a NULL fate.
    """
    t = checkpointed(cells.select("cell_id", first_number(time).alias("t"), F.col(label).alias("fate")).where("t IS NOT NULL"))
    times = [r[0] for r in t.select("t").distinct().orderBy("t").collect()]
    steps = edges.join(t.select(F.col("cell_id").alias("src"), F.col("t").alias("ts")), "src").join(
        t.select(F.col("cell_id").alias("dst"), F.col("t").alias("td")), "dst")
    reached = t.where(F.col("t") == times[-1]).select("cell_id", "fate", F.lit(1.0).alias("p"))
    result = reached
    for now, later in reversed(list(zip(times, times[1:]))):
        move = steps.where((F.col("ts") == now) & (F.col("td") == later))
        mass = (move.join(reached.withColumnRenamed("cell_id", "dst"), "dst").groupBy("src", "fate")
                .agg(F.sum(F.col("weight") * F.col("p")).alias("m")))
        norm = mass.groupBy("src").agg(F.sum("m").alias("s"))
        reached = checkpointed(mass.join(norm, "src").select(F.col("src").alias("cell_id"), "fate", (F.col("m") / F.col("s")).alias("p")))
        result = result.union(reached)
    result = checkpointed(result)
    lost = cells.select("cell_id").join(result.select("cell_id"), "cell_id", "left_anti")
    return result.union(lost.select("cell_id", F.lit(None).cast("string").alias("fate"), F.lit(None).cast("double").alias("p")))


def pseudotime_genes(lognorm: DataFrame, cells: DataFrame, pseudotime: str, min_share: float = 0.10,
                     max_genes: int | None = None, min_rho: float = 0.2) -> DataFrame:
    """Spearman correlation of genes with pseudotime, zeros included.

    Ranks of the non-zero entries are shifted by the zeros; the zeros' contribution follows from the total of
    the pseudotime ranks.
    """
    p = checkpointed(average_ranks(cells.select("cell_id", F.col(pseudotime).alias("pt")).where("pt IS NOT NULL"), [], "pt", "rp"))
    whole = p.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("rp").alias("mp"), F.var_pop("rp").alias("vp"))
    x = lognorm.join(p.select("cell_id", "rp"), "cell_id")
    stats = attach(x.groupBy("gene_id").agg(F.count(F.lit(1)).alias("k"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")), whole, [])
    mean = F.col("s") / F.col("n")
    chosen = stats.where(F.col("k") / F.col("n") > min_share).withColumn("v", F.col("ss") / F.col("n") - mean * mean)
    if max_genes is not None:
        chosen = chosen.orderBy(F.desc(F.round("v", 9)), "gene_id").limit(max_genes)
    chosen = chosen.select("gene_id", "k", "n", "mp", "vp")
    chosen = checkpointed(chosen)
    r = average_ranks(checkpointed(x.join(chosen, "gene_id")), ["gene_id"], "x", "rx")
    zeros = F.col("n") - F.col("k")
    full = (F.col("rx") + zeros) - (zeros + 1) / 2
    # Against the zero block as origin, zeros add nothing to the cross sum.
    g = r.groupBy("gene_id", "n", "mp", "vp").agg(F.sum(full).alias("a"), F.sum(full * full).alias("aa"), F.sum(full * F.col("rp")).alias("ap"))
    cov = F.col("ap") / F.col("n") - F.col("a") / F.col("n") * F.col("mp")
    var = F.col("aa") / F.col("n") - F.pow(F.col("a") / F.col("n"), F.lit(2.0))
    return g.where((var > 0) & (F.col("vp") > 0)).select("gene_id", (cov / F.sqrt(var * F.col("vp"))).alias("rho")).where(F.abs("rho") >= min_rho)


def binned_expression(lognorm: DataFrame, cells: DataFrame, pseudotime: str, genes: DataFrame, n_bins: int = 10) -> DataFrame:
    """Mean expression in quantile bins of pseudotime, z-scored per gene."""
    probs = [i / n_bins for i in range(1, n_bins)]
    pt = cells.select("cell_id", F.col(pseudotime).alias("pt")).where("pt IS NOT NULL")
    cuts = quantiles(pt, [], {"pt": probs}).select(F.array(*[quantile_name("pt", q) for q in probs]).alias("cuts"))
    b = attach(pt, cuts, []).select("cell_id", F.size(F.filter("cuts", lambda c: c <= F.col("pt"))).alias("bin"))
    sizes = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = sizes.agg(F.collect_list(F.struct("bin", "n"))).toDF("b").scalar()
    sums = (lognorm.join(genes.select("gene_id"), "gene_id", "left_semi").join(b, "cell_id").groupBy("gene_id", "bin").agg(F.sum("x").alias("s")))
    grid = genes.select("gene_id").withColumn("b", bins).select("gene_id", F.explode("b").alias("b")).select("gene_id", "b.*")
    m = grid.join(sums, ["gene_id", "bin"], "left").select("gene_id", "bin", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))
    c = m.groupBy("gene_id").agg(F.avg("mean").alias("gm"), F.stddev_pop("mean").alias("gs"))
    return m.join(c, "gene_id").select("gene_id", "bin", "mean", ((F.col("mean") - F.col("gm")) / (F.col("gs") + 1e-9)).alias("z"))


class PrincipalTree(NamedTuple):
    """Node positions, tree edges, and each cell's closest node ``(cell_id, node)``."""

    nodes: np.ndarray
    edges: list[tuple[int, int]]
    assigned: DataFrame


def _spanning_tree(points: np.ndarray) -> list[tuple[int, int]]:
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    inside, edges = {0}, []
    while len(inside) < len(points):
        rest = [j for j in range(len(points)) if j not in inside]
        a, b = min(((i, j) for i in inside for j in rest), key=lambda e: d[e])
        edges.append((a, b))
        inside.add(b)
    return edges


def principal_tree(embedding: DataFrame, n_nodes: int = 20, min_share: float = 0.01, seed: int = 0) -> PrincipalTree:
    """Cluster centres joined by a minimum spanning tree; leaves with hardly any cells are cut off.

    Clustering and assignment run on Spark; only the centres (a few dozen) meet on the driver.
    """
    data = embedding.select("cell_id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=n_nodes, seed=seed, initSteps=5).fit(data)
    points = np.array(model.clusterCenters())
    sizes = {r["prediction"]: r["count"] for r in model.transform(data).groupBy("prediction").count().collect()}
    edges, total = _spanning_tree(points), sum(sizes.values())
    while len(points) > 3:
        degree = np.bincount(np.array(edges).ravel(), minlength=len(points))
        weak = [i for i in np.flatnonzero(degree == 1) if sizes.get(i, 0) < min_share * total]
        if not weak:
            break
        keep = [i for i in range(len(points)) if i != weak[0]]
        place = {old: new for new, old in enumerate(keep)}
        edges = [(place[a], place[b]) for a, b in edges if weak[0] not in (a, b)]
        sizes = {place[i]: n for i, n in sizes.items() if i in place}
        points = points[keep]

    @F.pandas_udf(IntegerType())
    def closest(v: pd.Series) -> pd.Series:
        m = np.vstack(v.to_numpy())
        return pd.Series(((m[:, None] - points[None]) ** 2).sum(-1).argmin(1).astype("int32"))

    return PrincipalTree(points, edges, embedding.select("cell_id", closest(F.col("v").cast("array<double>")).alias("node")))


def pseudotime(embedding: DataFrame, tree: PrincipalTree, root: int) -> DataFrame:
    """Distance from the root along the tree at each cell's projection, scaled to [0, 1]."""
    points, edges = tree.nodes, list(tree.edges)
    near: dict[int, list[int]] = {i: [] for i in range(len(points))}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    far, stack = {root: 0.0}, [root]
    while stack:
        i = stack.pop()
        for j in near[i]:
            if j not in far:
                far[j] = far[i] + float(np.linalg.norm(points[i] - points[j]))
                stack.append(j)

    @F.pandas_udf(DoubleType())
    def along(v: pd.Series, node: pd.Series) -> pd.Series:
        m, out = np.vstack(v.to_numpy()), np.full(len(v), np.nan)
        gap = np.full(len(v), np.inf)
        nodes = node.to_numpy()
        for a, b in edges:
            use = (nodes == a) | (nodes == b)
            if not use.any() or a not in far:
                continue
            step = points[b] - points[a]
            t = np.clip(((m[use] - points[a]) @ step) / max(step @ step, 1e-12), 0, 1)
            d = np.linalg.norm(m[use] - points[a] - t[:, None] * step, axis=1)
            better = d < gap[use]
            where = np.flatnonzero(use)[better]
            gap[where], out[where] = d[better], (far[a] + t * (far[b] - far[a]))[better]
        return pd.Series(out)

    raw = checkpointed(embedding.join(tree.assigned, "cell_id").select(
        "cell_id", along(F.col("v").cast("array<double>"), "node").alias("d")).withColumn("d", F.nanvl("d", F.lit(None).cast("double"))))
    span = raw.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return attach(raw, span, []).select("cell_id", ((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12)).alias("pseudotime"))
