"""Composition by sample, two-arm tests, neighbourhood abundance and log-ratio tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycell.functions.numeric import ratio, stars, two_sided_normal_p
from tallycell.functions.order_stats import adjust_bh, adjust_weighted_bh, attach, hash_order, quantiles
from tallycell.functions.tails import student_two_sided_p
from tallycell.session import checkpointed


def proportions(obs: DataFrame, label: str = "label", keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Share of every label in every sample, zeros included; samples under 100 cells are flagged."""
    n = obs.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    totals = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    levels = F.array_sort(F.collect_set(label))
    grid = totals.withColumn("_l", n.agg(levels).toDF("l").scalar()).select(
        *keys, "total", F.explode("_l").alias(label))
    return grid.join(n, [*keys, label], "left").fillna(0, ["n"]).select(
        *keys, label, "n", "total", ratio(F.col("n").cast("double"), F.col("total")).alias("proportion"),
        (F.col("total") < 100).alias("small_sample"))


def transformed(p: Column, how: str = "arcsine") -> Column:
    v = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return {"arcsine": F.asin(F.sqrt(v)), "logit": F.log(v / (1 - v)), "raw": v}[how]


def _welch(df: DataFrame, by: Sequence[str], arm: str, value: Column, arm_a: str) -> DataFrame:
    a = F.col(arm) == arm_a
    x, y = F.when(a, value), F.when(~a, value)
    m = df.groupBy(*by).agg(F.count(x).alias("n_a"), F.count(y).alias("n_b"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"),
                            F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"))
    u, w = F.col("va") / F.col("n_a"), F.col("vb") / F.col("n_b")
    t = ratio(F.col("mean_a") - F.col("mean_b"), F.sqrt(u + w))
    dof = ratio((u + w) * (u + w), u * u / (F.col("n_a") - 1) + w * w / (F.col("n_b") - 1))
    out = m.select(*by, "n_a", "n_b", "mean_a", "mean_b", t.alias("t"), dof.alias("dof"))
    return out.withColumn("pval", student_two_sided_p(F.col("t"), F.col("dof")))


def two_arm_test(props: DataFrame, arm: str, arm_a: str, label: str = "label", strata: Sequence[str] = (),
                 how: str = "arcsine") -> DataFrame:
    """Welch test of transformed proportions for each label and stratum; one value per sample.

    Under two samples in an arm the statistic is NULL.
    """
    t = _welch(props.where("proportion IS NOT NULL"), [label, *strata], arm, transformed(F.col("proportion"), how), arm_a)
    return t.withColumn("stars", stars("pval"))


def rank_test(props: DataFrame, arm: str, arm_a: str, label: str = "label", how: str = "raw") -> DataFrame:
    """Mann-Whitney U per label with the tie-corrected, continuity-corrected normal approximation."""
    v = props.where("proportion IS NOT NULL").withColumn("v", transformed(F.col("proportion"), how))
    w = Window.partitionBy(label).orderBy("v")
    ties = F.count(F.lit(1)).over(Window.partitionBy(label, "v"))
    r = v.withColumn("t", ties).withColumn("r", F.rank().over(w) + (F.col("t") - 1) / 2)
    a = F.col(arm) == arm_a
    t = F.col("t").cast("double")
    s = r.groupBy(label).agg(F.count_if(a).alias("n_a"), F.count_if(~a).alias("n_b"), F.sum(F.when(a, F.col("r"))).alias("ra"),
                             F.sum(t * t - 1).alias("tie"))
    n = F.col("n_a") + F.col("n_b")
    u = F.col("ra") - F.col("n_a") * (F.col("n_a") + 1) / 2
    mid = F.col("n_a") * F.col("n_b") / 2
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = ratio(F.greatest(F.abs(u - mid) - 0.5, F.lit(0.0)), sd)
    return s.where((F.col("n_a") >= 2) & (F.col("n_b") >= 2)).select(
        label, "n_a", "n_b", u.alias("u"), z.alias("z"), two_sided_normal_p(z).alias("pval"))


def group_bars(props: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Mean of the per-sample proportions for each level of a sample-constant column."""
    return props.groupBy(by, label).agg(F.avg("proportion").alias("mean_proportion"))


def time_course(props: DataFrame, condition: str, time: str, label: str = "label") -> DataFrame:
    """Mean and standard error of the proportion over time per condition."""
    return props.groupBy(condition, time, label).agg(
        F.avg("proportion").alias("mean"), (F.stddev_samp("proportion") / F.sqrt(F.count("proportion"))).alias("sem"))


def neighbourhoods(edges: DataFrame, embedding: DataFrame, prop: float = 0.1, seed: int = 0) -> DataFrame:
    """Members of refined neighbourhoods: ``(nhood, cell_id)``.

    The graph is made symmetric with self loops; ``prop`` of the cells are drawn in hash order, each snaps
    to the member nearest its neighbourhood's mean, and repeats are merged.
    """
    e = edges.select("src", "dst")
    me = embedding.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"))
    graph = checkpointed(e.union(e.select("dst", "src")).union(me).distinct())
    n_draw = max(1, int(prop * embedding.count()))
    drawn = embedding.orderBy(hash_order(seed, "cell_id"), "cell_id").limit(n_draw).select(F.col("cell_id").alias("src"))
    v = embedding.select(F.col("cell_id").alias("dst"), F.col("v").cast("array<double>").alias("v"))
    members = checkpointed(graph.join(drawn, "src", "left_semi").join(v, "dst"))
    centre = members.groupBy("src").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("c"))
    gap = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    snapped = members.join(centre, "src").groupBy("src").agg(
        F.min_by("dst", F.struct(F.round(gap, 9), F.col("dst"))).alias("nhood"))
    index = snapped.select(F.col("nhood").alias("src")).distinct()
    return graph.join(index, "src", "left_semi").select(F.col("src").alias("nhood"), F.col("dst").alias("cell_id"))


def neighbourhood_counts(members: DataFrame, obs: DataFrame, sample: str = "sample") -> DataFrame:
    return members.join(obs.select("cell_id", sample), "cell_id").groupBy("nhood", sample).agg(F.count(F.lit(1)).alias("n"))


def neighbourhood_test(counts: DataFrame, samples: DataFrame, arm: str, arm_a: str, covariates: Sequence[str] = (),
                       sample: str = "sample") -> DataFrame:
    """Quasi-Poisson test of each neighbourhood between two arms, offset by library size.

    A neighbourhood is one row with an array over the samples, so fits run batch-wise on the executors; the
    dispersion is shared: the median Pearson ratio, at least one.  A neighbourhood of fewer than five cells isn't
    fitted: it stays with a p and an FDR of one.
    """
    libs = counts.groupBy(sample).agg(F.sum("n").alias("lib"))
    info = samples.select(sample, F.col(arm).alias("arm"), *covariates).join(libs, sample).orderBy(sample).collect()
    is_a = np.array([r["arm"] == arm_a for r in info], dtype=float)
    if is_a.sum() < 2 or (1 - is_a).sum() < 2:
        raise ValueError("at least two samples per arm are needed")
    offset = np.log([r["lib"] for r in info])
    cols = [np.ones(len(info))]
    for c in covariates:
        levels = sorted({str(r[c]) for r in info})
        cols += [np.array([str(r[c]) == v for r in info], dtype=float) for v in levels[1:]]
    x = np.column_stack([*cols, is_a])
    if np.linalg.matrix_rank(x) < x.shape[1]:
        x = np.column_stack([np.ones(len(info)), is_a])
    where = {r[sample]: i for i, r in enumerate(info)}

    def fit(batches):
        from tallycell.operators.de import _irls
        for pdf in batches:
            y = np.zeros((len(pdf), len(info)))
            for i, m in enumerate(pdf["by_sample"]):
                for e in m:
                    if e["s"] in where:
                        y[i, where[e["s"]]] = e["n"]
            keep = y.sum(axis=1) >= 5
            out = pd.DataFrame({"nhood": pdf["nhood"], "coef": 0.0, "se": np.nan, "phi": np.nan})
            if keep.any():
                beta, cov, mu = _irls(y[keep], x, offset, np.zeros(keep.sum()))
                out.loc[keep, "coef"], out.loc[keep, "se"] = beta[:, -1], np.sqrt(cov[:, -1, -1])
                out.loc[keep, "phi"] = ((y[keep] - mu) ** 2 / mu).sum(axis=1) / max(len(info) - x.shape[1], 1)
            yield out

    rows = counts.groupBy("nhood").agg(F.collect_list(F.struct(F.col(sample).alias("s"), "n")).alias("by_sample"))
    kind = dict(counts.dtypes)["nhood"]
    fits = checkpointed(rows.mapInPandas(fit, f"nhood {kind}, coef double, se double, phi double"))
    shared = quantiles(fits, [], {"phi": [0.5]}).select(F.greatest(F.lit(1.0), "phi_q50").alias("phi_common"))
    z = F.col("coef") / (F.col("se") * F.sqrt("phi_common"))
    few = F.isnan("se")
    tested = attach(fits, shared, []).select("nhood", (F.col("coef") / float(np.log(2))).alias("lfc"), F.when(~few, z).alias("z"))
    adjusted = adjust_bh(tested.withColumn("pval", two_sided_normal_p("z")), [], "pval", "fdr")
    return adjusted.select("nhood", "lfc", "z", F.coalesce("pval", F.lit(1.0)).alias("pval"), F.coalesce("fdr", F.lit(1.0)).alias("fdr"))


def neighbourhood_labels(members: DataFrame, obs: DataFrame, label: str = "label", mix_thresh: float = 0.7) -> DataFrame:
    """Majority label of each neighbourhood, ``Mixed`` when its share is low."""
    n = members.join(obs.select("cell_id", label), "cell_id").groupBy("nhood", label).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("nhood").agg(F.sum("n").alias("size"), F.max("n").alias("m"),
                                 F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority"))
    share = F.col("m") / F.col("size")
    return top.select("nhood", "size", share.alias("share"), F.when(share < mix_thresh, "Mixed").otherwise(F.col("majority")).alias("label"))


def neighbourhood_summary(tested: DataFrame, labels: DataFrame, alpha: float = 0.1) -> DataFrame:
    sig = F.col("fdr") < alpha
    return tested.join(labels.select("nhood", "label"), "nhood").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_nhoods"), F.count_if(sig).alias("n_sig"), F.count_if(sig & (F.col("lfc") > 0)).alias("n_up"),
        F.count_if(sig & (F.col("lfc") < 0)).alias("n_down"), F.median("lfc").alias("median_lfc"))


def spatial_fdr(tested: DataFrame, kth_distance: str, out: str = "spatial_fdr") -> DataFrame:
    """Step-up adjustment with weights one over the distance to the k-th neighbour."""
    w = tested.withColumn("_w", 1.0 / F.greatest(F.col(kth_distance), F.lit(1e-12)))
    return adjust_weighted_bh(w, [], "pval", "_w", out).drop("_w")


def log_ratio_test(props: DataFrame, arm: str, arm_a: str, label: str = "label", reference: str | None = None,
                   sample: str = "sample") -> DataFrame:
    """Welch test of log-ratios to a reference label; by default the label whose share varies least."""
    if reference is None:
        spread = props.groupBy(label).agg((F.stddev_samp("proportion") / F.avg("proportion")).alias("cv"))
        reference = spread.where("cv IS NOT NULL").orderBy(F.round("cv", 12), label).first()[0]
    ref = props.where(F.col(label) == reference).select(sample, F.col("n").alias("n_ref"))
    lr = F.log((F.col("n") + 0.5) / (F.col("n_ref") + 0.5))
    t = _welch(props.where(F.col(label) != reference).join(ref, sample), [label], arm, lr, arm_a)
    return adjust_bh(checkpointed(t), [], "pval", "padj").withColumn("reference", F.lit(reference))
