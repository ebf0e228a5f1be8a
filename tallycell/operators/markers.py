"""Rank-sum and t tests of every gene for every group, and marker tables.

Zeros are never materialised: ranks are taken among the non-zero entries of a gene and shifted by the
number of zeros, which all share one mid-rank.  The rank window is cut into value ranges, so that an
ubiquitous gene is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.numeric import ratio, two_sided_normal_p
from tallycell.functions.order_stats import adjust_bh, dealt, top_k
from tallycell.functions.tails import student_two_sided_p
from tallycell.session import checkpointed

# Log-normalised values lie between 0 and about 12; a slice is 1/32 wide.
SLICES_PER_UNIT = 32


def group_sums(lognorm: DataFrame, cells: DataFrame, group: str, strata: Sequence[str] = (),
               ranks: bool = True) -> DataFrame:
    """Per (strata, gene, group): ``nnz``, ``s``, ``ss`` and, on request, ``rsum`` over non-zero ranks."""
    strata = list(strata)
    x = lognorm.select("cell_id", "gene_id", "x").join(cells.select("cell_id", group, *strata), "cell_id")
    sums = [F.count(F.lit(1)).alias("nnz"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")]
    if not ranks:
        return x.groupBy(*strata, "gene_id", group).agg(*sums)
    part = [*strata, "gene_id", "slice"]
    sliced = dealt(x.drop("cell_id").withColumn("slice", F.floor(F.col("x") * SLICES_PER_UNIT)), *part, like=lognorm)
    peers = F.count(F.lit(1)).over(Window.partitionBy(*part, "x"))
    inner = F.rank().over(Window.partitionBy(*part).orderBy("x")) + (peers - 1) / 2
    local = (sliced.withColumn("r", inner).groupBy(*part, group)
             .agg(*sums, F.sum("r").alias("rl")))
    below = Window.partitionBy(*strata, "gene_id").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("nnz").over(below), F.lit(0))
    return (local.withColumn("rl", F.col("rl") + off * F.col("nnz"))
            .groupBy(*strata, "gene_id", group)
            .agg(F.sum("nnz").alias("nnz"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("rl").alias("rsum")))


def group_sizes(cells: DataFrame, group: str, strata: Sequence[str] = (), min_cells: int = 3) -> DataFrame:
    """Cells per group, and per stratum over the groups that are large enough."""
    sizes = cells.groupBy(*strata, group).agg(F.count(F.lit(1)).alias("n_g")).where(F.col("n_g") >= min_cells)
    return sizes.withColumn("n_all", F.sum("n_g").over(Window.partitionBy(*strata)))


def _grid(sums: DataFrame, var: DataFrame, sizes: DataFrame, group: str, strata: Sequence[str]) -> DataFrame:
    """Every gene of the feature space for every group, with group and rest statistics."""
    strata = list(strata)
    levels = sizes.select(F.struct(*strata, group, "n_g", "n_all").alias("l")).agg(F.collect_list("l")).toDF("l").scalar()
    grid = var.select("gene_id", F.explode(levels).alias("l")).select("gene_id", "l.*")
    measured = [c for c in ("nnz", "s", "ss", "rsum") if c in sums.columns]
    full = grid.join(sums, [*strata, "gene_id", group], "left").fillna(0, measured)
    whole = Window.partitionBy(*strata, "gene_id")
    return full.select("*", *[F.sum(c).over(whole).alias(f"{c}_all") for c in measured if c != "rsum"])


def _effects() -> list[Column]:
    n_r = F.col("n_all") - F.col("n_g")
    mean_g, mean_r = F.col("s") / F.col("n_g"), ratio(F.col("s_all") - F.col("s"), n_r)
    lfc = F.log2((F.expm1(mean_g) + 1e-9) / (F.expm1(mean_r) + 1e-9))
    return [lfc.alias("lfc"), (F.col("nnz") / F.col("n_g")).alias("pct_group"),
            ratio(F.col("nnz_all") - F.col("nnz"), n_r).alias("pct_rest")]


def rank_sum_test(lognorm: DataFrame, cells: DataFrame, var: DataFrame, group: str = "label",
                  strata: Sequence[str] = (), min_cells: int = 3) -> DataFrame:
    """Each group against the rest of its stratum: rank-sum z without tie correction, p, BH, effects.

    Groups under ``min_cells`` are left out of the comparison.  For two arms, pass cells of those arms
    only: each arm's rest is then the other.
    """
    strata = list(strata)
    sizes = group_sizes(cells, group, strata, min_cells)
    kept = cells.join(sizes.select(*strata, group), [*strata, group], "left_semi")
    full = _grid(group_sums(lognorm, kept, group, strata), var, sizes, group, strata)
    n, n_g, n0 = F.col("n_all"), F.col("n_g"), F.col("n_all") - F.col("nnz_all")
    total = F.col("rsum") + n0 * F.col("nnz") + (n_g - F.col("nnz")) * (n0 + 1) / 2
    z = (total - n_g * (n + 1) / 2) / F.sqrt(n_g * (n - n_g) * (n + 1) / 12.0)
    tested = checkpointed(full.where(n > n_g).select(*strata, group, "gene_id", z.alias("score"), *_effects()))
    return adjust_bh(tested.withColumn("pval", two_sided_normal_p("score")), [*strata, group], "pval", "padj")


def t_test(lognorm: DataFrame, cells: DataFrame, var: DataFrame, group: str = "label",
           overestimate_variance: bool = False, min_cells: int = 3) -> DataFrame:
    """Welch test of each group against the rest; optionally the rest's variance over the group's size."""
    sizes = group_sizes(cells, group, (), min_cells)
    kept = cells.join(sizes.select(group), group, "left_semi")
    full = _grid(group_sums(lognorm, kept, group, ranks=False), var, sizes, group, ())
    n_g = F.col("n_g").cast("double")
    n_r = F.col("n_all") - n_g
    s_r, ss_r = F.col("s_all") - F.col("s"), F.col("ss_all") - F.col("ss")
    mean_g, mean_r = F.col("s") / n_g, s_r / n_r
    var_g = F.greatest(F.lit(0.0), F.col("ss") - n_g * mean_g * mean_g) / (n_g - 1)
    var_r = F.greatest(F.lit(0.0), ss_r - n_r * mean_r * mean_r) / (n_r - 1)
    m_r = n_g if overestimate_variance else n_r
    a, b = var_g / n_g, var_r / m_r
    stats = full.where(n_r > 1).select(
        group, "gene_id", ratio(mean_g - mean_r, F.sqrt(a + b)).alias("score"),
        ratio((a + b) * (a + b), a * a / (n_g - 1) + b * b / (m_r - 1)).alias("dof"), *_effects())
    p = F.coalesce(student_two_sided_p(F.col("score"), F.col("dof")), F.lit(1.0))
    stats = checkpointed(stats)
    return adjust_bh(stats.withColumn("pval", p), [group], "pval", "padj")


def logistic_markers(vectors: DataFrame, cells: DataFrame, genes: Sequence, group: str = "label",
                     reg: float = 1e-3, max_iter: int = 50) -> DataFrame:
    """Multinomial logistic regression; coefficients of every chosen gene for every group."""
    data = vectors.join(cells.select("cell_id", group), "cell_id")
    indexer = StringIndexer(inputCol=group, outputCol="y", stringOrderType="alphabetAsc").fit(data)
    model = LogisticRegression(family="multinomial", labelCol="y", featuresCol="features", regParam=reg,
                               maxIter=max_iter).fit(indexer.transform(data))
    weights = model.coefficientMatrix.toArray()
    rows = [(name, g, float(weights[i, j])) for i, name in enumerate(indexer.labels) for j, g in enumerate(genes)]
    kind = "bigint" if genes and isinstance(genes[0], int) else "string"
    return vectors.sparkSession.createDataFrame(rows, f"{group} string, gene_id {kind}, score double")


def top_markers(tested: DataFrame, group: str = "label", n: int = 10, strata: Sequence[str] = ()) -> DataFrame:
    """Best genes per group by adjusted p, then score, then gene."""
    order = [F.round("padj", 12), F.desc(F.round("score", 9)), F.col("gene_id")]
    return top_k(tested, [*strata, group], order, n)


def cluster_qc(metrics: DataFrame, cluster: str = "label", sample: str = "sample",
               called: str = "predicted_doublet") -> DataFrame:
    """Size, medians, doublet share, sample entropy and dominant sample of each cluster, with flags."""
    from tallycell.functions.order_stats import attach, medians
    cols = ["n_genes", "total_counts", "pct_counts_mt"]
    per = metrics.groupBy(cluster, sample).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(called).cast("double")).alias("dbl"))
    n_samples = metrics.agg(F.count_distinct(sample).alias("n_samples"))
    sizes = per.groupBy(cluster).agg(F.sum("n").alias("n_cells"),
                                     (F.sum(F.col("dbl") * F.col("n")) / F.sum("n")).alias("doublet_fraction"))
    whole = sizes.agg(F.sum("n_cells").alias("n_total"))
    p = F.col("n") / F.col("n_cells")
    mix = per.join(sizes.select(cluster, "n_cells"), cluster).groupBy(cluster).agg(
        (-F.sum(p * F.log(p))).alias("sample_entropy"),
        F.min_by(sample, F.struct(-F.col("n"), F.col(sample))).alias("dominant_sample"),
        F.max(p).alias("dominant_sample_frac"))
    table = attach(attach(sizes.join(mix, cluster).join(medians(metrics, [cluster], cols), cluster),
                          whole, []), n_samples, [])
    several = F.col("n_samples") > 1
    return table.select(
        cluster, "n_cells", (100.0 * F.col("n_cells") / F.col("n_total")).alias("pct_of_total"),
        *[f"median_{c}" for c in cols], "doublet_fraction", "sample_entropy",
        (F.col("sample_entropy") / F.when(several, F.log("n_samples")).otherwise(1.0)).alias("sample_entropy_norm"),
        "dominant_sample", "dominant_sample_frac",
        F.array_join(F.array_compact(F.array(
            F.when((F.col("dominant_sample_frac") > 0.8) & (F.col("n_samples") > 2), F.lit("one_sample")),
            F.when(F.col("doublet_fraction") > 0.3, F.lit("doublets")),
            F.when(F.col("median_pct_counts_mt") > 25, F.lit("high_mt")),
            F.when(F.col("median_n_genes") < 250, F.lit("few_genes")))), ",").alias("flags"))
