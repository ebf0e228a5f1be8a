"""Feature-space choice, normalisation, variable genes, scaling, PCA and regression.

Zeros are implicit in the count table, so every gene moment divides by the number of cells, which the
caller passes as a one-row table ``n_cells`` (see :func:`cell_number`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycell.functions.order_stats import attach, quantiles
from tallycell.knowledge import fixed
from tallycell.session import checkpointed


def cell_number(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count(F.lit(1)).alias("n_all"))


def log_value(target_sum: float = 1e4) -> Column:
    """``log1p(count * target_sum / total)``, the total being that of the cell."""
    return F.log1p(F.col("count") * F.lit(float(target_sum)) / F.col("total"))


def log_normalize(counts: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """Add ``x = log1p(count * target_sum / cell total)``; the raw count is kept."""
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("total"))
    return counts.join(totals, "cell_id").select(
        *counts.columns, log_value(target_sum).alias("x"))


def resolve_groups(names: Sequence[str], organism: str = "mouse",
                   groups: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Patterns of named gene groups and bundles; an unknown name is an error."""
    groups = groups or fixed.GENE_GROUPS[organism]
    wanted: list[str] = []
    for n in names:
        wanted += fixed.GENE_GROUP_BUNDLES.get(n, [n])
    unknown = [n for n in wanted if n not in groups]
    if unknown:
        raise ValueError(f"unknown gene groups {unknown}; known: {sorted(groups)}")
    return {n: list(groups[n]) for n in wanted}


def genes_in_groups(var: DataFrame, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(gene_id, symbol, group)`` for every gene that matches a group."""
    hits = [F.when(F.col("symbol").rlike("|".join(f"(?:{p})" for p in ps)), F.lit(g))
            for g, ps in patterns.items()]
    return var.select("gene_id", "symbol", F.explode(F.array_compact(F.array(*hits))).alias("group"))


def exclude_groups(counts: DataFrame, var: DataFrame, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Counts without the genes of the given groups; the full count table stays as it is."""
    return counts.join(genes_in_groups(var, patterns).select("gene_id").distinct(), "gene_id", "left_anti")


def gene_moments(values: DataFrame, n_cells: DataFrame, x: Column, ddof: int = 1) -> DataFrame:
    """Mean and variance of ``x`` per gene over all cells, zeros included."""
    sums = values.groupBy("gene_id").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    mean = F.col("s") / F.col("n_all")
    return attach(sums, n_cells, []).select(
        "gene_id", mean.alias("mean"),
        F.greatest(F.lit(0.0), (F.col("ss") - F.col("n_all") * mean * mean) / (F.col("n_all") - ddof)).alias("var"))


def hvg_by_mean_bins(lognorm: DataFrame, n_cells: DataFrame, n_top: int, n_bins: int = 20) -> DataFrame:
    """Variable genes by log dispersion, standardised inside equal-width bins of log mean expression."""
    m = gene_moments(lognorm, n_cells, F.expm1("x")).where(F.col("mean") > 0).select(
        "gene_id", F.log1p("mean").alias("log_mean"),
        F.when(F.col("var") > 0, F.log(F.col("var") / F.col("mean"))).alias("log_disp"))
    edges = m.agg(F.min("log_mean").alias("lo"), F.max("log_mean").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    slot = F.when(width > 0, F.ceil((F.col("log_mean") - F.col("lo")) / width) - 1).otherwise(0)
    binned = attach(m, edges, []).withColumn(
        "bin", F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), slot)).cast("int")).drop("lo", "hi")
    per = binned.groupBy("bin").agg(F.avg("log_disp").alias("bin_mean"), F.stddev_samp("log_disp").alias("bin_std"))
    # A bin with one gene has no spread: its gene scores one.
    lone = F.col("bin_std").isNull()
    z = ((F.col("log_disp") - F.when(lone, 0.0).otherwise(F.col("bin_mean")))
         / F.when(lone, F.col("bin_mean")).otherwise(F.col("bin_std")))
    return (binned.join(per, "bin").select("gene_id", "log_mean", "log_disp", "bin", z.alias("disp_norm"))
            .where("disp_norm IS NOT NULL").orderBy(F.desc("disp_norm"), "gene_id").limit(n_top))


def hvg_by_quantile_bins(lognorm: DataFrame, n_cells: DataFrame, n_top: int) -> DataFrame:
    """Variable genes by dispersion, centred by median and scaled by MAD inside 5 %-wide mean bins."""
    m = gene_moments(lognorm, n_cells, F.expm1("x")).where(F.col("mean") > 0).select(
        "gene_id", "mean", (F.col("var") / F.col("mean")).alias("disp"))
    m = checkpointed(m)
    probs = [p / 100 for p in range(10, 105, 5)]
    cuts = quantiles(m, [], {"mean": probs})
    array = cuts.select(F.array(*cuts.columns)).toDF("c").scalar()
    binned = m.withColumn("_cuts", array).withColumn(
        "bin", F.size(F.filter("_cuts", lambda c: c < F.col("mean")))).drop("_cuts")
    centre = quantiles(binned, ["bin"], {"disp": [0.5]})
    dev = checkpointed(binned.join(centre, "bin").withColumn("dev", F.abs(F.col("disp") - F.col("disp_q50"))))
    spread = quantiles(dev, ["bin"], {"dev": [0.5]})
    z = (F.col("disp") - F.col("disp_q50")) / (F.col("dev_q50") / 0.6744897501960817)
    return (dev.join(spread, "bin").where(F.col("dev_q50") > 0)
            .select("gene_id", "mean", "disp", "bin", z.alias("disp_norm"))
            .orderBy(F.desc("disp_norm"), "gene_id").limit(n_top))


def _trend_grid(points: DataFrame, span: float, n_bins: int) -> tuple[list[float], list[float]]:
    """Local quadratic trend of ``y`` on ``x`` at bin centres, from per-bin sums.

    At most ``n_bins`` rows reach the driver whatever the number of points.
    """
    lo, hi = points.agg(F.min("x"), F.max("x")).first()
    width = (hi - lo) / n_bins or 1.0
    slot = F.least(F.lit(n_bins - 1), F.floor((F.col("x") - lo) / width))
    rows = (points.groupBy(slot.alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")).orderBy("b").collect())
    n, x, y = (np.array([r[c] for r in rows], dtype=float) for c in ("n", "mx", "my"))
    need = max(span * n.sum(), 3.0)
    fitted = []
    for centre in x:
        d = np.abs(x - centre)
        order = np.argsort(d, kind="stable")
        reach = d[order][min(np.searchsorted(np.cumsum(n[order]), need), len(x) - 1)]
        reach = max(reach, np.sort(d)[min(3, len(d) - 1)], 1e-12) * 1.0000001
        w = n * np.clip(1 - (d / reach) ** 3, 0, None) ** 3
        basis = np.vander(x - centre, 3, increasing=True)
        root = np.sqrt(w)[:, None]
        coef, *_ = np.linalg.lstsq(basis * root, y * root[:, 0], rcond=None)
        fitted.append(float(coef[0]))
    return [float(v) for v in x], fitted


def _interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear lookup in a bounded grid."""
    gx, gy = F.array(*[F.lit(v) for v in xs]), F.array(*[F.lit(v) for v in ys])
    if len(xs) == 1:
        return F.lit(ys[0])
    i = F.greatest(F.lit(1), F.least(F.lit(len(xs) - 1), F.size(F.filter(gx, lambda g: g < x))))
    x0, x1, y0, y1 = F.get(gx, i - 1), F.get(gx, i), F.get(gy, i - 1), F.get(gy, i)
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def hvg_by_variance_trend(counts: DataFrame, n_cells: DataFrame, n_top: int, span: float = 0.3) -> DataFrame:
    """Variable genes by clipped standardised variance of raw counts around a mean-variance trend."""
    c = F.col("count").cast("double")
    m = gene_moments(counts, n_cells, c).where("mean > 0 AND var > 0")
    points = m.select("gene_id", "mean", "var", F.log10("mean").alias("x"), F.log10("var").alias("y"))
    xs, ys = _trend_grid(points, span, 256)
    sigma = F.sqrt(F.pow(F.lit(10.0), _interpolate(F.col("x"), xs, ys)))
    fit = attach(points.withColumn("sigma", sigma), n_cells, []).withColumn(
        "ceiling", F.col("sigma") * F.sqrt("n_all") + F.col("mean"))
    clipped = F.least(c, F.col("ceiling"))
    sums = (counts.join(fit.select("gene_id", "ceiling"), "gene_id").groupBy("gene_id")
            .agg(F.sum(clipped).alias("s"), F.sum(clipped * clipped).alias("ss")))
    n, mean = F.col("n_all"), F.col("mean")
    norm = (n * mean * mean + F.col("ss") - 2 * mean * F.col("s")) / ((n - 1) * F.col("sigma") * F.col("sigma"))
    return (fit.join(sums, "gene_id").select("gene_id", "mean", "var", norm.alias("var_norm"))
            .orderBy(F.desc("var_norm"), "gene_id").limit(n_top))


def hvg_by_pearson_residuals(counts: DataFrame, n_cells: DataFrame, n_top: int, theta: float = 100.0) -> DataFrame:
    """Variable genes by variance of clipped negative-binomial Pearson residuals.

    Residuals of zeros depend on the gene total and the cell total only.  Each distinct gene total meets the distinct
    cell totals (both whole numbers, so far fewer than genes and cells) in blocks and sums over them; a gene's
    non-zero entries then replace their zero residual exactly.
    """
    totals = counts.groupBy("cell_id").agg(F.sum("count").cast("double").alias("c"))
    grand = totals.agg(F.sum("c").alias("grand"))
    bins = checkpointed(totals.groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("n")))
    n_blocks = max(1, math.ceil(bins.count() / TOTALS_BLOCK))
    depth = bins.groupBy(F.pmod(F.xxhash64("c"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("n", "c")).alias("depth"))
    genes = checkpointed(counts.groupBy("gene_id").agg(F.sum("count").cast("double").alias("g")))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")).alias("block")
    both = attach(attach(genes.select("g").distinct(), n_cells, []), grand, []).select("*", blocks).join(depth, "block")

    def residual(x: Column, mu: Column) -> Column:
        edge = F.sqrt(F.col("n_all").cast("double"))
        raw = (x - mu) / F.sqrt(mu + mu * mu / theta)
        return F.least(edge, F.greatest(-edge, raw))

    rate = F.col("g") / F.col("grand")
    zero_sum = F.aggregate("depth", F.lit(0.0), lambda a, b: a + b["n"] * residual(F.lit(0.0), rate * b["c"]))
    zero_sq = F.aggregate("depth", F.lit(0.0), lambda a, b: a + b["n"] * F.pow(
        residual(F.lit(0.0), rate * b["c"]), F.lit(2.0)))
    sums = checkpointed(both.select("g", "n_all", "grand", zero_sum.alias("z1"), zero_sq.alias("z2"))
                        .groupBy("g", "n_all", "grand").agg(F.sum("z1").alias("z1"), F.sum("z2").alias("z2")))
    base = genes.join(sums, "g")
    mu = rate * F.col("c")
    r1, r0 = residual(F.col("count").cast("double"), mu), residual(F.lit(0.0), mu)
    fix = (counts.join(totals, "cell_id").join(base.select("gene_id", "g", "n_all", "grand"), "gene_id")
           .groupBy("gene_id").agg(F.sum(r1 - r0).alias("d1"), F.sum(r1 * r1 - r0 * r0).alias("d2")))
    n = F.col("n_all")
    mean = (F.col("z1") + F.col("d1")) / n
    return (base.join(fix, "gene_id")
            .select("gene_id", ((F.col("z2") + F.col("d2")) / n - mean * mean).alias("residual_var"))
            .orderBy(F.desc("residual_var"), "gene_id").limit(n_top))


def scale_parameters(lognorm: DataFrame, n_cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the chosen genes; a constant gene gets deviation one."""
    m = gene_moments(lognorm.join(genes.select("gene_id"), "gene_id", "left_semi"), n_cells, F.col("x"))
    return m.select("gene_id", "mean", F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0).alias("std"))


def scaled_entries(lognorm: DataFrame, parameters: DataFrame, max_value: float = 10.0) -> DataFrame:
    """Scaled, clipped values of the non-zero entries; a zero of gene g is ``-mean/std`` (clipped)."""
    z = (F.col("x") - F.col("mean")) / F.col("std")
    return lognorm.join(parameters, "gene_id").select(
        "cell_id", "gene_id", F.least(F.lit(max_value), F.greatest(F.lit(-max_value), z)).alias("z"),
        F.greatest(F.lit(-max_value), -F.col("mean") / F.col("std")).alias("z0"))


MAX_FEATURES = 8192
TOTALS_BLOCK = 512


def feature_vectors(obs: DataFrame, entries: DataFrame, genes: DataFrame) -> tuple[DataFrame, int]:
    """Sparse vectors over the chosen genes, shifted so that a zero count stays a zero.

    The shift is constant per gene, so covariances and distances are those of the dense scaled matrix.
    The number of chosen genes is checked: vectors and the covariance matrix grow with it.
    """
    ids = [r["gene_id"] for r in genes.select("gene_id").orderBy("gene_id").limit(MAX_FEATURES + 1).collect()]
    if len(ids) > MAX_FEATURES:
        raise ValueError(f"choose at most {MAX_FEATURES} genes")
    where = genes.select("gene_id").withColumn("ix", F.array_position(F.lit(ids), F.col("gene_id")).cast("int") - 1)
    size = len(ids)
    per_cell = (entries.join(where, "gene_id").groupBy("cell_id")
                .agg(F.sort_array(F.collect_list(F.struct("ix", (F.col("z") - F.col("z0")).alias("v")))).alias("e")))

    @F.udf(VectorUDT())
    def pack(e):
        if not e:
            return SparseVector(size, [], [])
        return Vectors.sparse(size, [r["ix"] for r in e], [r["v"] for r in e])

    return obs.select("cell_id").join(per_cell, "cell_id", "left").select("cell_id", pack("e").alias("features")), size


class Components(NamedTuple):
    """Cell scores, variance ratios, and the loadings matrix (genes by components, on the driver)."""

    embedding: DataFrame
    variance_ratio: list[float]
    loadings: np.ndarray


def principal_components(vectors: DataFrame, n_features: int, n_cells: int, n_comps: int = 50) -> Components:
    """Principal components; each loading's largest entry is made positive so that signs are fixed."""
    k = min(n_comps, max(2, min(n_cells, n_features) - 1))
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    centre = model.transform(vectors).select(vector_to_array("pcs").alias("p")).agg(
        *[F.avg(F.get("p", i)).alias(f"m{i}") for i in range(k)]).first()
    shift = F.array(*[F.lit(float(centre[i])) for i in range(k)])
    flip = F.array(*[F.lit(float(s)) for s in sign])
    centred = F.zip_with(vector_to_array("pcs"), shift, lambda a, b: a - b)
    emb = model.transform(vectors).select("cell_id", F.zip_with(centred, flip, lambda a, s: a * s).alias("v"))
    return Components(emb, [float(v) for v in model.explainedVariance.toArray()], loadings * sign)


def regression_coefficients(lognorm: DataFrame, obs: DataFrame, covariates: Sequence[str],
                            n_cells: DataFrame) -> DataFrame:
    """Least-squares fit of every gene on an intercept and the covariates, zeros included.

    Only the covariates' small cross-product matrix reaches the driver; the per-gene sums stay
    distributed.  Columns: ``gene_id``, ``b0`` (intercept), ``b1`` ...
    """
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    k = len(z)
    gram = obs.agg(*[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    inverse = np.linalg.pinv(g)
    sums = (lognorm.join(obs.select("cell_id", *covariates), "cell_id").groupBy("gene_id")
            .agg(*[F.sum(F.col("x") * z[i]).alias(f"s{i}") for i in range(k)]))
    out = []
    for i in range(k):
        total: Column = F.lit(0.0)
        for j in range(k):
            total = total + F.lit(float(inverse[i, j])) * F.col(f"s{j}")
        out.append(total.alias(f"b{i}"))
    return sums.select("gene_id", *out)


def regressed_entries(lognorm: DataFrame, obs: DataFrame, covariates: Sequence[str],
                      coefficients: DataFrame) -> DataFrame:
    """Residuals of the non-zero entries; a zero entry's residual is minus its fitted value."""
    fitted = F.col("b0")
    for i, c in enumerate(covariates):
        fitted = fitted + F.col(f"b{i + 1}") * F.col(c)
    return (lognorm.join(obs.select("cell_id", *covariates), "cell_id").join(coefficients, "gene_id")
            .select("cell_id", "gene_id", (F.col("x") - fitted).alias("residual")))
