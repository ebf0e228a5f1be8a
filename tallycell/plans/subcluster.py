"""Sub-clustering as one chain of operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.operators import graph, integrate, markers, normalize, subset


class SubClusters(NamedTuple):
    obs: DataFrame
    markers: DataFrame
    corrected: bool


def subcluster(obs: DataFrame, counts: DataFrame, var: DataFrame, label: str, keep: Sequence[str],
               batch: str | None = None, resolution: float = 0.5, n_hvg: int = 2000, n_comps: int = 30, k: int = 15,
               exclude: DataFrame | None = None, rounds: int = 6, levels: int = 3) -> SubClusters:
    """Extract labels, choose variable genes, reduce, correct for batch, build a graph, cluster and test.

    Correction is skipped when the batch column has fewer than two levels in the subset; ``exclude`` takes
    genes out of the feature space but not out of the counts.
    """
    part = subset.extract_labels(obs, counts, label, keep)
    subset.require_cells(part.obs)
    raw = part.counts.persist(StorageLevel.MEMORY_AND_DISK)
    space = raw if exclude is None else raw.join(exclude.select("gene_id"), "gene_id", "left_anti")
    n = normalize.cell_number(part.obs)
    lognorm = normalize.log_normalize(space)
    hvg = normalize.hvg_by_mean_bins(lognorm, n, n_hvg).select("gene_id").persist()
    par = normalize.scale_parameters(lognorm, n, hvg)
    vectors, size = normalize.feature_vectors(part.obs, normalize.scaled_entries(lognorm, par), hvg)
    emb = normalize.principal_components(vectors.persist(StorageLevel.MEMORY_AND_DISK), size, n.first()[0],
                                         n_comps).embedding
    corrected = batch is not None and part.obs.select(batch).distinct().limit(2).count() == 2
    if corrected:
        emb = integrate.harmonize(emb.join(part.obs.select("cell_id", batch), "cell_id"), batch, max_iter=5)
    edges = graph.connectivities(graph.neighbour_graph(emb, k))
    clusters = graph.communities(edges, resolution, rounds, levels)
    name = graph.cluster_column(resolution)
    named = part.obs.join(clusters.withColumnRenamed("cluster", name), "cell_id", "left")
    tested = markers.rank_sum_test(normalize.log_normalize(raw), named.where(F.col(name).isNotNull()), var, name)
    return SubClusters(named, markers.top_markers(tested, name), corrected)
