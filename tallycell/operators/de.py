"""Pseudobulk units, design resolution, size factors and negative-binomial tests."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.functions.numeric import two_sided_normal_p
from tallycell.functions.order_stats import adjust_bh, average_ranks, quantiles, top_k
from tallycell.operators.markers import rank_sum_test
from tallycell.session import checkpointed


class Pseudobulk(NamedTuple):
    """Unit sizes, thin units that were left out, and summed counts per unit and gene."""

    units: DataFrame
    dropped: DataFrame
    counts: DataFrame


def pseudobulk(counts: DataFrame, obs: DataFrame, label: str = "label", sample: str = "sample",
               min_cells: int = 10) -> Pseudobulk:
    """Sum raw counts by label and sample; units under ``min_cells`` cells are listed, not used."""
    sizes = obs.groupBy(F.col(label).alias("label"), F.col(sample).alias("sample")).agg(
        F.count(F.lit(1)).alias("n_cells"))
    units = sizes.where(F.col("n_cells") >= min_cells)
    dropped = sizes.where(F.col("n_cells") < min_cells).withColumn(
        "reason", F.lit(f"fewer than min_cells={min_cells}"))
    cells = obs.select("cell_id", F.col(label).alias("label"), F.col(sample).alias("sample"))
    sums = (counts.join(cells, "cell_id").groupBy("label", "sample", "gene_id").agg(F.sum("count").alias("count"))
            .join(units.select("label", "sample"), ["label", "sample"], "left_semi"))
    return Pseudobulk(units, dropped, sums)


class Design(NamedTuple):
    """Units and genes to fit per label, and the labels left out with the reason."""

    units: DataFrame
    genes: DataFrame
    skipped: DataFrame


def resolve_design(bulk: Pseudobulk, sample_info: DataFrame, condition: str, arm_a: str, arm_b: str,
                   covariates: Sequence[str] = (), min_samples: int = 2, min_count_sum: int = 10,
                   min_genes: int = 50) -> Design:
    """Keep the two arms, drop covariate levels without both, and list labels with too few samples or genes.

    The condition never blocks itself.
    """
    covariates = [c for c in covariates if c != condition]
    info = sample_info.select("sample", F.col(condition).alias("arm"), *covariates)
    bulk = Pseudobulk(checkpointed(bulk.units), bulk.dropped, checkpointed(bulk.counts))
    units = checkpointed(bulk.units.join(info, "sample").where(F.col("arm").isin(arm_a, arm_b)))
    enough = [F.count_if(F.col("arm") == a) for a in (arm_a, arm_b)]

    def tally(df: DataFrame) -> DataFrame:
        return df.groupBy("label").agg(enough[0].alias("n_a"), enough[1].alias("n_b"))

    few = (F.col("n_a") < min_samples) | (F.col("n_b") < min_samples)
    start = tally(units)
    kept = units
    for c in covariates:
        both = kept.groupBy("label", c).agg(F.count_distinct("arm").alias("k")).where(F.col("k") == 2)
        kept = checkpointed(kept.join(both.select("label", c), ["label", c], "left_semi"))
    after = tally(kept)
    labels = bulk.units.select("label").distinct()
    early = labels.join(start, "label", "left").fillna(0, ["n_a", "n_b"]).where(few).select(
        "label", F.lit("too few samples in an arm").alias("reason"))
    fine = start.where(~few).select("label")
    late = fine.join(after, "label", "left").fillna(0, ["n_a", "n_b"]).where(few).select(
        "label", F.lit("too few samples after dropping unbalanced covariate levels").alias("reason"))
    usable = fine.join(late, "label", "left_anti")
    kept = kept.join(usable, "label", "left_semi")
    sums = (bulk.counts.join(kept.select("label", "sample"), ["label", "sample"], "left_semi")
            .groupBy("label", "gene_id").agg(F.sum("count").alias("total")).where(F.col("total") >= min_count_sum))
    rich = sums.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    thin = usable.join(rich, "label", "left").fillna(0, ["k"]).where(F.col("k") < min_genes).select(
        "label", F.lit(f"fewer than {min_genes} genes reach min_count_sum={min_count_sum}").alias("reason"))
    final = usable.join(thin, "label", "left_anti")
    return Design(kept.join(final, "label", "left_semi"),
                  sums.join(final, "label", "left_semi").select("label", "gene_id"),
                  early.union(late).union(thin))


def size_factors(counts: DataFrame, units: DataFrame) -> DataFrame:
    """Median ratio to the geometric mean, over genes seen in every unit of a label."""
    seen = counts.join(units.select("label", "sample"), ["label", "sample"], "left_semi").where(F.col("count") > 0)
    n_units = units.groupBy("label").agg(F.count(F.lit(1)).alias("n_units"))
    centre = (seen.groupBy("label", "gene_id").agg(F.avg(F.log("count")).alias("gm"), F.count(F.lit(1)).alias("k"))
              .join(n_units, "label").where(F.col("k") == F.col("n_units")).select("label", "gene_id", "gm"))
    ratios = seen.join(centre, ["label", "gene_id"]).select(
        "label", "sample", (F.log("count") - F.col("gm")).alias("ratio"))
    return quantiles(ratios, ["label", "sample"], {"ratio": [0.5]}).select(
        "label", "sample", F.exp("ratio_q50").alias("size_factor"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Vectorised ln(gamma) by Stirling's series after a shift by eight."""
    shift = np.log(x)
    for i in range(1, 8):
        shift = shift + np.log(x + i)
    y = x + 8
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + inv / 12 - inv ** 3 / 360 + inv ** 5 / 1260 - shift


def _products(x: np.ndarray) -> np.ndarray:
    """Products of all pairs of columns, one row per unit: weighted cross-products of many genes are one matrix product."""
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


def _irls(y: np.ndarray, x: np.ndarray, offset: np.ndarray, alpha: np.ndarray, rounds: int = 60):
    """Negative-binomial log-link fits with a light ridge for many genes at once.

    ``y`` is genes by units; returns coefficients, their covariances and fitted means.
    """
    p = x.shape[1]
    ridge, products = np.eye(p) * 1e-6, _products(x)
    beta = np.zeros((len(y), p))
    beta[:, 0] = np.log(np.maximum(y.mean(axis=1), 0.1)) - offset.mean()

    def state(beta, alpha):
        mu = np.maximum(np.exp(np.clip(beta @ x.T + offset, -30, 30)), 1e-6)
        w = mu / (1 + alpha[:, None] * mu)
        return mu, w, (w @ products).reshape(-1, p, p) + ridge

    # A gene that has settled takes no part in later rounds, so one that doesn't settle holds up no others.
    moving = np.arange(len(y))
    for _ in range(rounds):
        old = beta[moving]
        mu, w, xtx = state(old, alpha[moving])
        z = old @ x.T + (y[moving] - mu) / mu
        new = np.linalg.solve(xtx, ((w * z) @ x)[..., None])[..., 0]
        beta[moving] = new
        moving = moving[~(np.abs(new - old).max(axis=1) < 1e-8)]
        if not len(moving):
            break
    mu, _, xtx = state(beta, alpha)
    return beta, np.linalg.inv(xtx), mu


def _profile_dispersion(y, x, mu, centre=None, spread=None) -> np.ndarray:
    """Dispersions that maximise the adjusted profile likelihood, on a log grid refined twice."""
    p, products = x.shape[1], _products(x)

    def score(log_a: np.ndarray) -> np.ndarray:
        a = np.exp(log_a)[:, None]
        k = 1 / a
        ll = (_log_gamma(y + k) - _log_gamma(k) - k * np.log1p(a * mu) + y * np.log(a * mu / (1 + a * mu))).sum(axis=1)
        w = mu / (1 + a * mu)
        ll -= 0.5 * np.linalg.slogdet((w @ products).reshape(-1, p, p) + np.eye(p) * 1e-9)[1]
        return ll if centre is None else ll - (log_a - centre) ** 2 / (2 * spread)

    lo, hi = np.full(len(y), np.log(1e-8)), np.full(len(y), np.log(10.0))
    best = lo
    for _ in range(3):
        step = (hi - lo) / 20
        values = np.stack([score(lo + i * step) for i in range(21)])
        best = lo + values.argmax(axis=0) * step
        lo, hi = best - step, best + step
    return np.exp(best)


def _design_matrix(frame: pd.DataFrame, arm_a: str, covariates: Sequence[str],
                   interaction: str | None = None) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Model matrix and the coefficients to test, by position: the arm, or its product with each later level."""
    cols = [np.ones(len(frame))]
    for c in covariates:
        levels = sorted(frame[c].astype(str).unique())
        cols += [(frame[c].astype(str) == v).to_numpy(float) for v in levels[1:]]
    arm = (frame["arm"] == arm_a).to_numpy(float)
    if interaction is None:
        return np.column_stack([*cols, arm]), [(len(cols), arm_a)]
    levels = sorted(frame[interaction].astype(str).unique())[1:]
    dummies = [(frame[interaction].astype(str) == v).to_numpy(float) for v in levels]
    base = [*cols, *dummies, arm]
    tested = [(len(base) + i, f"{arm_a}:{v}") for i, v in enumerate(levels)]
    return np.column_stack([*base, *[arm * x for x in dummies]]), tested


def nb_test(counts: DataFrame, design: Design, factors: DataFrame, arm_a: str,
            covariates: Sequence[str] = (), interaction: str | None = None) -> DataFrame:
    """Per-gene negative-binomial Wald test of arm A against the other arm, for every label at once.

    With ``interaction`` (a sample attribute carried by the units) the products of the arm with its later
    levels are tested instead, one row per gene and product, named in ``coefficient``.

    Units of a gene (dozens of samples) form one small group; genes are spread over the cluster.  Pass one
    gives gene-wise dispersions; their trend ``a1 / mean + a0`` comes from per-label sums; pass two shrinks
    each dispersion towards the trend and tests.  Genes without a finite p are left out.
    """
    units = checkpointed(design.units.join(factors, ["label", "sample"]))
    carried = [*covariates, *([interaction] if interaction else [])]
    # A sample without counts for a gene is a zero. Units are one row a label: they are sent to the genes, never genes to a label.
    unit_rows = checkpointed(units.groupBy("label").agg(F.collect_list(F.struct(
        "sample", "arm", "size_factor", *carried)).alias("units")))
    designs = {r["label"]: r["design"] for r in unit_rows.select("label", F.to_json("units").alias("design")).collect()}
    cells = counts.join(design.genes, ["label", "gene_id"], "left_semi").join(
        units.select("label", "sample"), ["label", "sample"], "left_semi")
    per_gene = (cells.groupBy("label", "gene_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", "count"))).alias("n"))
                .join(F.broadcast(unit_rows), "label"))
    y = F.transform("units", lambda u: F.coalesce(F.element_at("n", u["sample"]), F.lit(0)).cast("double"))
    kind = dict(counts.dtypes)["gene_id"]
    tasks = counts.sparkSession.sparkContext.defaultParallelism * 4
    ready = per_gene.select("label", "gene_id", y.alias("y")).repartition(tasks, "label", "gene_id")

    def frame_of(text: str):
        f = pd.DataFrame(json.loads(text))
        f["arm"] = f["arm"].astype(str)
        x, tested = _design_matrix(f, arm_a, covariates, interaction)
        return x, np.log(f["size_factor"].to_numpy(float)), tested

    def fits(batches, final: bool):
        """Fit all genes of a batch that share a design together."""
        for pdf in batches:
            for label, part in pdf.groupby("label", sort=False):
                x, off, tested = frame_of(designs[label])
                v = np.vstack(part["y"].to_numpy()).astype(float)
                norm = v / np.exp(off)
                base = norm.mean(axis=1)
                if not final:
                    rough = (norm.var(axis=1, ddof=1) - base) / np.maximum(base * base, 1e-12)
                    _, _, mu = _irls(v, x, off, np.clip(rough, 1e-8, 10.0))
                    yield part.assign(base_mean=base, disp=_profile_dispersion(v, x, mu))[
                        ["label", "gene_id", "y", "base_mean", "disp"]]
                    continue
                disp, wide = part["disp"].to_numpy(), np.maximum(part["spread"].to_numpy(), 0.25)
                target = np.log(part["a1"].to_numpy() / np.maximum(base, 1e-12) + part["a0"].to_numpy())
                _, _, mu = _irls(v, x, off, disp)
                alpha = _profile_dispersion(v, x, mu, target, wide)
                outlier = np.log(disp) > target + 2 * np.sqrt(wide)
                beta, cov, _ = _irls(v, x, off, np.where(outlier, disp, alpha))
                for i, name in tested:
                    lfc, se = beta[:, i] / np.log(2), np.sqrt(cov[:, i, i]) / np.log(2)
                    yield pd.DataFrame({"label": part["label"].to_numpy(), "gene_id": part["gene_id"].to_numpy(),
                                        "coefficient": name, "base_mean": base, "lfc": lfc, "lfc_se": se, "stat": lfc / se})

    first = ready.mapInPandas(lambda b: fits(b, False),
                              f"label string, gene_id {kind}, y array<double>, base_mean double, disp double")
    first = checkpointed(first)
    inv = 1.0 / F.greatest("base_mean", F.lit(1e-12))
    ok = first.where((F.col("disp") > 1e-7) & (F.col("disp") < 9.9))
    slope = F.covar_pop("disp", inv) / F.var_pop(inv)
    trend = ok.groupBy("label").agg(F.avg("disp").alias("ad"), slope.alias("b")).select(
        "label", F.greatest(F.lit(0.0), F.coalesce(F.nanvl("b", F.lit(0.0)), F.lit(0.0))).alias("a1"), "ad")
    mean_inv = ok.groupBy("label").agg(F.avg(inv).alias("mi"))
    trend = trend.join(mean_inv, "label").select(
        "label", "a1", F.greatest(F.lit(1e-4), F.col("ad") - F.col("a1") * F.col("mi")).alias("a0"))
    resid = ok.join(F.broadcast(trend), "label").select(
        "label", (F.log("disp") - F.log(F.col("a1") / F.greatest("base_mean", F.lit(1e-12)) + F.col("a0"))).alias("r"))
    dev = quantiles(resid.withColumn("r", F.abs("r")), ["label"], {"r": [0.5]}).select(
        "label", F.pow(F.col("r_q50") * 1.4826, F.lit(2.0)).alias("spread"))
    second = first.join(F.broadcast(trend), "label").join(F.broadcast(dev), "label").mapInPandas(
        lambda b: fits(b, True), f"label string, gene_id {kind}, coefficient string, base_mean double, lfc double, "
                              "lfc_se double, stat double")
    second = checkpointed(second)
    tested = second.where("stat IS NOT NULL AND NOT isnan(stat)").withColumn("pval", two_sided_normal_p("stat"))
    return adjust_bh(tested, ["label", "coefficient"], "pval", "padj").where("padj IS NOT NULL")


def shrink_lfc(tested: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Shrink fold changes by a zero-centred normal prior whose width matches the 95 % quantile of |lfc|."""
    wide = quantiles(tested.withColumn("_a", F.abs("lfc")), list(keys), {"_a": [0.95]})
    width = F.pow(F.greatest(F.col("_a_q95") / 1.959963984540054, F.lit(1e-3)), F.lit(2.0))
    factor = width / (width + F.col("lfc_se") * F.col("lfc_se"))
    return (tested.join(wide, list(keys)).withColumn("lfc_unshrunk", F.col("lfc"))
            .withColumn("lfc", F.col("lfc") * factor).withColumn("shrunk", F.lit(True)).drop("_a_q95"))


def cellwise_test(lognorm: DataFrame, obs: DataFrame, var: DataFrame, condition: str, arm_a: str, arm_b: str,
                  label: str = "label", min_cells: int = 3) -> DataFrame:
    """Exploratory rank-sum test of arm A against arm B inside every label; the unit is the cell."""
    arms = obs.where(F.col(condition).isin(arm_a, arm_b))
    t = rank_sum_test(lognorm, arms, var, condition, [label], min_cells)
    return t.where(F.col(condition) == arm_a).drop(condition).withColumn("exploratory", F.lit(True))


def direction_counts(tested: DataFrame, keys: Sequence[str] = ("label",), fdr: float = 0.05, lfc: float = 0.5) -> DataFrame:
    sig = F.col("padj") < fdr
    return tested.groupBy(*keys).agg(F.count_if(sig & (F.col("lfc") > lfc)).alias("n_up"),
                                     F.count_if(sig & (F.col("lfc") < -lfc)).alias("n_down"))


def interaction_balance(units: DataFrame, sample_info: DataFrame, condition: str, time: str, min_samples: int = 2) -> DataFrame:
    """Samples in every condition-by-time cell per label, and whether an interaction can be tested."""
    info = sample_info.select("sample", F.col(condition).alias("c"), F.col(time).alias("t"))
    per = units.join(info, "sample").groupBy("label", "c", "t").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_combinations"), F.min("n").alias("min_samples"),
        F.count_distinct("c").alias("n_c"), F.count_distinct("t").alias("n_t")).select(
        "label", "n_combinations", "min_samples",
        ((F.col("n_combinations") == F.col("n_c") * F.col("n_t")) & (F.col("n_combinations") >= 4)
         & (F.col("min_samples") >= min_samples)).alias("testable"))


def compare_runs(a: DataFrame, b: DataFrame, top_n: int = 100, min_common: int = 20) -> DataFrame:
    """Agreement of two result tables ``(label, gene_id, lfc, padj)`` per shared label."""
    both = a.select("label", "gene_id", F.col("lfc").alias("x")).join(
        b.select("label", "gene_id", F.col("lfc").alias("y")), ["label", "gene_id"])
    ranked = average_ranks(average_ranks(both, ["label"], "x", "rx"), ["label"], "y", "ry")
    rho = ranked.groupBy("label").agg(F.count(F.lit(1)).alias("n_common_genes"), F.corr("rx", "ry").alias("spearman_lfc"))

    def best(df: DataFrame) -> DataFrame:
        return top_k(df, ["label"], [F.round("padj", 12), F.col("gene_id")], top_n).select("label", "gene_id")

    mix = best(a).withColumn("side", F.lit(1)).union(best(b).withColumn("side", F.lit(2)))
    overlap = (mix.groupBy("label", "gene_id").agg(F.count(F.lit(1)).alias("k")).groupBy("label")
               .agg((F.count_if(F.col("k") == 2) / F.count(F.lit(1))).alias("jaccard_top")))

    def n_sig(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("label").agg(F.count_if(F.col("padj") < 0.05).alias(name))

    return (rho.where(F.col("n_common_genes") >= min_common).join(overlap, "label")
            .join(n_sig(a, "n_sig_a"), "label").join(n_sig(b, "n_sig_b"), "label"))
