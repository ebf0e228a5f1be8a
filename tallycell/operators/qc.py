"""Per-cell and per-sample quality control, threshold proposals, filtering and ambient profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycell.functions.numeric import ratio
from tallycell.functions.order_stats import (attach, median_and_mad, quantile_name, quantiles, top_k)
from tallycell.knowledge import fixed

MAD_TO_SIGMA = 1.4826
THRESHOLD_ORDER = (
    ("min_genes", "n_genes", "ge"), ("max_genes", "n_genes", "le"),
    ("min_counts", "total_counts", "ge"), ("max_counts", "total_counts", "le"),
    ("max_pct_mt", "pct_counts_mt", "le"),
)


def cell_metrics(counts: DataFrame, obs: DataFrame, var: DataFrame,
                 patterns: Mapping[str, str]) -> DataFrame:
    """One row per cell of ``obs`` with depth, gene and pattern metrics; zero-count cells are kept.

    Patterns ``mt``, ``ribo`` and ``hb`` give percentages of 100, the other patterns give fractions.
    """
    flags = var.select("gene_id", *[F.col("symbol").rlike(p).alias(f"is_{k}")
                                    for k, p in patterns.items()])
    sums = (counts.join(flags, "gene_id").groupBy("cell_id")
            .agg(F.count(F.lit(1)).alias("n_genes"), F.sum("count").alias("total_counts"),
                 *[F.sum(F.when(F.col(f"is_{k}"), F.col("count")).otherwise(0)).alias(f"sum_{k}")
                   for k in patterns]))
    top = (top_k(counts, ["cell_id"], [F.desc("count"), F.col("gene_id")], 50)
           .groupBy("cell_id")
           .agg(F.sum("count").alias("top50"),
                F.sum(F.when(F.col("rank") <= 20, F.col("count"))).alias("top20")))
    total, n = F.coalesce("total_counts", F.lit(0)), F.coalesce("n_genes", F.lit(0))
    percents = [k for k in patterns if k in ("mt", "ribo", "hb")]
    out = [n.alias("n_genes"), total.alias("total_counts")]
    out += [ratio(100.0 * F.col(f"sum_{k}"), F.col("total_counts")).alias(f"pct_counts_{k}")
            for k in percents]
    out += [ratio(100.0 * F.col(f"top{k}"), F.col("total_counts")).alias(f"pct_counts_in_top_{k}_genes")
            for k in (20, 50)]
    out.append(F.when(total == 0, F.lit(0.0))
               .otherwise(F.log10(n + 1) / F.log10(total + 1)).alias("complexity"))
    out += [F.coalesce(ratio(F.col(f"sum_{k}").cast("double"), F.col("total_counts")), F.lit(0.0))
            .alias(f"frac_{k}") for k in patterns if k not in percents]
    return (obs.join(sums, "cell_id", "left").join(top, "cell_id", "left")
            .select(*obs.columns, *out))


def expected_doublet_rate(n: Column) -> Column:
    """Piecewise-linear multiplet rate for ``n`` recovered cells."""
    table = fixed.MULTIPLET_TABLE
    last_n, last_rate = table[-1]
    rate = F.when(n <= table[0][0], F.lit(table[0][1]))
    for (n0, r0), (n1, r1) in zip(table, table[1:]):
        rate = rate.when(n <= n1, r0 + (n - n0) * ((r1 - r0) / (n1 - n0)))
    beyond = last_rate + (n - last_n) * fixed.MULTIPLET_SLOPE
    return rate.otherwise(F.least(F.lit(fixed.MULTIPLET_CEILING), beyond))


def sample_stats(metrics: DataFrame, sample: str = "sample") -> DataFrame:
    """Per-sample size, medians, unscaled MADs, quantile ladders and expected doublet rate."""
    ladder = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    deep = ["n_genes", "total_counts"]
    others = [c for c in metrics.columns if c.startswith(("pct_counts_", "frac_")) or c == "complexity"]
    q = quantiles(metrics, [sample], {**{c: ladder for c in deep}, **{c: [0.5] for c in others}})
    medians = q.select(sample, *[F.col(quantile_name(c, 0.5)).alias(f"median_{c}") for c in deep + others],
                       *[F.col(quantile_name(c, p)) for c in deep for p in ladder])
    dev = metrics.join(medians.select(sample, *[f"median_{c}" for c in deep]), sample).select(
        sample, *[F.abs(F.col(c) - F.col(f"median_{c}")).alias(c) for c in deep])
    mads = quantiles(dev, [sample], {c: [0.5] for c in deep}).select(
        sample, *[F.col(quantile_name(c, 0.5)).alias(f"mad_{c}") for c in deep])
    sizes = metrics.groupBy(sample).agg(F.count(F.lit(1)).alias("n_cells"))
    return (sizes.join(medians, sample, "left").join(mads, sample, "left")
            .withColumn("expected_doublet_rate", F.round(expected_doublet_rate(F.col("n_cells")), 4)))


def _melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], "metric", "value")


def cohort_outliers(stats: DataFrame, n_mads: float = 3.0, sample: str = "sample") -> DataFrame:
    """Samples whose median lies more than ``n_mads`` scaled MADs from the cohort median.

    The input has one row per sample, so the cohort medians are taken directly.
    """
    core = ["median_n_genes", "median_total_counts", "median_pct_counts_mt", "median_complexity"]
    long = _melt(stats, [sample], core)
    centre = long.groupBy("metric").agg(F.median("value").alias("cohort_median"))
    dev = long.join(centre, "metric").withColumn("dev", F.abs(F.col("value") - F.col("cohort_median")))
    mad = dev.groupBy("metric").agg(F.median("dev").alias("m")).select(
        "metric", F.when(F.col("m") == 0, F.lit(1e-9)).otherwise(F.col("m")).alias("cohort_mad"))
    scaled = F.col("dev") / (F.col("cohort_mad") * MAD_TO_SIGMA)
    return (dev.join(mad, "metric").where(F.col("dev") > n_mads * F.col("cohort_mad") * MAD_TO_SIGMA)
            .select(sample, "metric", "value", "cohort_median", scaled.alias("n_mads")))


def rule_flags(stats: DataFrame, organism: str = "mouse", chemistry: str = "10x_3prime_v3",
               sample: str = "sample") -> DataFrame:
    """Fixed-threshold flags per sample: ``(sample, flag, severity, value)``."""
    t = fixed.QC_FLAGS
    mito = "high_mito_human" if organism == "human" else "high_mito_mouse"

    def flag(name: str, severity: str, hit: Column, value: str) -> Column:
        return F.when(hit, F.struct(F.lit(name).alias("flag"), F.lit(severity).alias("severity"),
                                    F.col(value).cast("double").alias("value")))

    def above(name: str, key: str, value: str, scale: float = 1.0) -> Column:
        return flag(name, t[key][1], F.col(value) > t[key][0] * scale, value)

    def below(name: str, key: str, value: str) -> Column:
        return flag(name, t[key][1], F.col(value) < t[key][0], value)

    n = F.col("n_cells")
    very_low, low = t["very_low_cell_count"], t["low_cell_count"]
    rules = [
        flag("low_cell_count", very_low[1], n < very_low[0], "n_cells"),
        flag("low_cell_count", low[1], (n >= very_low[0]) & (n < low[0]), "n_cells"),
        below("low_median_genes", "low_median_genes", "median_n_genes"),
        above("high_ambient_keratin", "high_ambient_keratin", "median_frac_keratin"),
        above("high_ambient_collagen", "high_ambient_collagen", "median_frac_collagen"),
        above("high_hemoglobin", "high_hemoglobin", "median_pct_counts_hb", 100),
        below("low_complexity", "low_complexity", "median_complexity"),
        above("saturating_doublet_rate", "saturating_doublet_rate", "expected_doublet_rate"),
    ]
    if chemistry not in fixed.MITO_NOT_VIABILITY:
        rules.append(above("high_mito", mito, "median_pct_counts_mt"))
    return (stats.select(sample, F.explode(F.array_compact(F.array(*rules))).alias("f"))
            .select(sample, "f.flag", "f.severity", "f.value"))


def cohort_range(stats: DataFrame) -> DataFrame:
    """Minimum, median and maximum of the main sample medians; one row per metric."""
    cols = ["n_cells", "median_n_genes", "median_total_counts", "median_pct_counts_mt",
            "median_frac_keratin", "median_frac_collagen"]
    return _melt(stats, [], cols).groupBy("metric").agg(
        F.min("value").alias("low"), F.median("value").alias("mid"), F.max("value").alias("high"))


def mad_bounds(metrics: DataFrame, keys: Sequence[str], log_scale: Mapping[str, bool],
               n_mads: float = 3.0) -> DataFrame:
    """Lower and upper outlier bounds per group: ``{column}_lo`` and ``{column}_hi``.

    Columns marked True are judged on the log1p scale and mapped back.
    """
    keys = list(keys)
    moved = metrics.select(*keys, *[
        (F.log1p(F.col(c)) if logged else F.col(c).cast("double")).alias(c)
        for c, logged in log_scale.items()])
    mm = median_and_mad(moved, keys, list(log_scale))
    out = []
    for c, logged in log_scale.items():
        half = n_mads * MAD_TO_SIGMA * F.col(f"mad_{c}")
        for name, edge in (("lo", F.col(f"median_{c}") - half), ("hi", F.col(f"median_{c}") + half)):
            out.append((F.expm1(edge) if logged else edge).alias(f"{c}_{name}"))
    return mm.select(*keys, *out)


class Thresholds(NamedTuple):
    """Proposed thresholds: one row per sample, and one row for the cohort."""

    per_sample: DataFrame
    cohort: DataFrame


def recommend_thresholds(metrics: DataFrame, method: str = "mad", n_mads: float = 3.0,
                         organism: str = "mouse", chemistry: str = "10x_3prime_v3",
                         sample: str = "sample") -> Thresholds:
    """Threshold proposals from robust bounds, a chemistry preset, or the stricter of both."""
    preset = dict(zip([k for k, _, _ in THRESHOLD_ORDER], fixed.QC_PRESETS[organism][chemistry]))
    mito_ok = chemistry not in fixed.MITO_NOT_VIABILITY
    b = mad_bounds(metrics, [sample], {"n_genes": True, "total_counts": True, "pct_counts_mt": False},
                   n_mads)

    def whole(c: Column) -> Column:
        return c.cast("bigint")

    per_sample = b.select(
        sample,
        whole(F.greatest(F.col("n_genes_lo"), F.lit(0.0))).alias("min_genes"),
        whole(F.col("n_genes_hi")).alias("max_genes"),
        whole(F.greatest(F.col("total_counts_lo"), F.lit(0.0))).alias("min_counts"),
        whole(F.col("total_counts_hi")).alias("max_counts"),
        (F.round("pct_counts_mt_hi", 2) if mito_ok else F.lit(None).cast("double")).alias("max_pct_mt"))
    ints = ["min_genes", "max_genes", "min_counts", "max_counts"]
    mad = per_sample.agg(*[whole(F.median(c)).alias(c) for c in ints],
                         F.round(F.median("max_pct_mt"), 2).alias("max_pct_mt"))
    if method == "mad":
        return Thresholds(per_sample, mad)

    def fixed_value(name: str) -> Column:
        kind = "double" if name == "max_pct_mt" else "bigint"
        return F.lit(preset[name]).cast(kind)

    chosen = []
    for name in [*ints, "max_pct_mt"]:
        mine = fixed_value(name)
        if method == "both":
            # greatest and least skip a missing preset, leaving the robust bound.
            pick = F.greatest if name.startswith("min") else F.least
            mine = pick(F.col(name), mine)
        if name == "max_pct_mt" and not mito_ok:
            mine = F.lit(None).cast("double")
        chosen.append(mine.alias(name))
    return Thresholds(per_sample, mad.select(*chosen))


def first_failure(thresholds: Mapping[str, float | None]) -> Column:
    """Name of the first criterion a cell fails, NULL when it passes; a None threshold is skipped."""
    reason: Column | None = None
    for key, metric, op in THRESHOLD_ORDER:
        v = thresholds.get(key)
        if v is None:
            continue
        ok = F.col(metric) >= v if op == "ge" else F.col(metric) <= v
        failed = ~F.coalesce(ok, F.lit(False))
        reason = F.when(failed, key) if reason is None else reason.when(failed, key)
    return F.lit(None).cast("string") if reason is None else reason


class FilterPreview(NamedTuple):
    """Loss per criterion (each cell counted once, at its first failure) and per sample."""

    by_criterion: DataFrame
    by_sample: DataFrame


def preview_filters(metrics: DataFrame, thresholds: Mapping[str, float | None],
                    sample: str = "sample") -> FilterPreview:
    marked = metrics.withColumn("reason", first_failure(thresholds))
    by_criterion = (marked.where("reason IS NOT NULL").groupBy("reason")
                    .agg(F.count(F.lit(1)).alias("removed")))
    kept = F.col("reason").isNull().cast("bigint")
    by_sample = marked.groupBy(sample).agg(
        F.count(F.lit(1)).alias("before"), F.sum(kept).alias("after"),
        F.sum(1 - kept).alias("removed"))
    return FilterPreview(by_criterion, by_sample)


def low_complexity_risk(metrics: DataFrame, counts: DataFrame, probes: DataFrame, min_genes: float,
                        floor: float = 250) -> DataFrame:
    """Would a ``min_genes`` floor mainly throw away cells of a naturally low-complexity type?

    A cell looks like that type with at least two probe genes detected and one percent of its counts in
    them.  One row: sizes, percentages of discarded and kept cells, and the verdict.
    """
    hits = (counts.join(probes.select("gene_id").distinct(), "gene_id", "left_semi").groupBy("cell_id")
            .agg(F.count(F.lit(1)).alias("n_det"), F.sum("count").alias("probe_sum")))
    like = ((F.coalesce("n_det", F.lit(0)) >= 2)
            & (F.coalesce("probe_sum", F.lit(0)) / F.greatest(F.col("total_counts"), F.lit(1)) >= 0.01))
    marked = (metrics.select("cell_id", "n_genes", "total_counts").join(hits, "cell_id", "left")
              .select((F.col("n_genes") < min_genes).alias("lost"), like.alias("like")))
    lost, is_like = F.col("lost"), F.col("like")
    g = marked.agg(F.count_if(lost).alias("n_discarded"),
                   F.count_if(lost & is_like).alias("n_like"),
                   F.count_if(~lost).alias("n_kept"),
                   F.count_if(~lost & is_like).alias("n_kept_like"))
    g = g.select("n_discarded", "n_like",
                 F.round(100 * F.col("n_like") / F.greatest("n_discarded", F.lit(1)), 1).alias("pct_like"),
                 F.round(100 * F.col("n_kept_like") / F.greatest("n_kept", F.lit(1)), 1).alias("pct_like_kept"))
    risk = ((F.lit(min_genes) > floor) & (F.col("n_like") >= 10) & (F.col("pct_like") >= 2.0)
            & (F.col("pct_like") > 1.5 * F.greatest(F.col("pct_like_kept"), F.lit(0.1))))
    return g.withColumn("at_risk", risk)


def detected_markers(counts: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """Number of detected genes of each set per cell: ``(cell_id, set_name, n_det)``, hits only."""
    members = gene_sets.select("set_name", "gene_id").distinct()
    return (counts.join(members, "gene_id").groupBy("cell_id", "set_name")
            .agg(F.count(F.lit(1)).alias("n_det")))


def present_sets(gene_sets: DataFrame, var: DataFrame, at_least: int) -> DataFrame:
    """Members of those sets that keep ``at_least`` genes of the feature space."""
    here = gene_sets.select("set_name", "gene_id").distinct().join(var.select("gene_id"), "gene_id", "left_semi")
    big = here.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_present")).where(F.col("n_present") >= at_least)
    return here.join(big, "set_name")


def lost_lineages(metrics: DataFrame, counts: DataFrame, var: DataFrame, gene_sets: DataFrame,
                  thresholds: Mapping[str, float | None]) -> DataFrame:
    """Which lineages would the filter remove: share of lost and of kept cells that express each set."""
    marked = metrics.select("cell_id", first_failure(thresholds).isNotNull().alias("lost"))
    sizes = marked.agg(F.count_if(F.col("lost")).alias("n_lost"), F.count_if(~F.col("lost")).alias("n_kept"))
    usable = present_sets(gene_sets, var, 3)
    det = detected_markers(counts, usable).where(F.col("n_det") >= 2)
    hit = (det.join(marked, "cell_id").groupBy("set_name")
           .agg(F.count_if(F.col("lost")).alias("h_lost"), F.count_if(~F.col("lost")).alias("h_kept")))
    shares = attach(hit, sizes, []).select(
        "set_name",
        ratio(F.col("h_lost").cast("double"), F.col("n_lost")).alias("lost"),
        F.coalesce(ratio(F.col("h_kept").cast("double"), F.col("n_kept")), F.lit(0.0)).alias("kept"))
    return shares.where(F.col("lost") > 0.02).select(
        "set_name", (100 * F.col("lost")).alias("pct_of_lost"), (100 * F.col("kept")).alias("pct_of_kept"),
        (F.col("lost") / F.greatest(F.col("kept"), F.lit(1e-6))).alias("enrichment_in_lost"))


class Filtered(NamedTuple):
    """Surviving cells, the genes still seen often enough, and their counts."""

    obs: DataFrame
    genes: DataFrame
    counts: DataFrame


def detected_genes(counts: DataFrame, min_cells: int) -> DataFrame:
    """Genes seen in at least ``min_cells`` cells."""
    return (counts.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_cells"))
            .where(F.col("n_cells") >= min_cells))


def apply_filters(metrics: DataFrame, counts: DataFrame, thresholds: Mapping[str, float | None],
                  exclude_samples: Sequence[str] = (), min_cells_per_gene: int = 3,
                  sample: str = "sample") -> Filtered:
    keep = metrics.where(first_failure(thresholds).isNull())
    if exclude_samples:
        keep = keep.where(~F.col(sample).isin(list(exclude_samples)))
    left = counts.join(keep.select("cell_id"), "cell_id", "left_semi")
    genes = detected_genes(left, min_cells_per_gene)
    return Filtered(keep, genes, left.join(genes, "gene_id", "left_semi"))


def check_loss(before: int, after: int, confirm: bool = False, limit: float = 0.30) -> None:
    """Refuse an empty result, and a loss above ``limit`` unless confirmed."""
    if after == 0:
        raise ValueError("no cell survives these thresholds")
    if before and (before - after) / before > limit and not confirm:
        raise ValueError(f"{before - after} of {before} cells would be removed; pass confirm=True")


def empty_droplet_profile(raw: DataFrame, counts: DataFrame, low: int = 1, high: int = 100) -> DataFrame:
    """Gene fractions in near-empty droplets beside the fractions in cells, over shared genes."""
    empty = (raw.groupBy("cell_id").agg(F.sum("count").alias("t"))
             .where(F.col("t").between(low, high)).select("cell_id"))
    soup = raw.join(empty, "cell_id", "left_semi").groupBy("gene_id").agg(F.sum("count").alias("soup_n"))
    cells = counts.groupBy("gene_id").agg(F.sum("count").alias("cell_n"))
    raw_genes = raw.select("gene_id").distinct()
    both = cells.join(raw_genes, "gene_id").join(soup, "gene_id", "left").fillna(0, ["soup_n"])
    totals = both.agg(F.sum("soup_n").alias("soup_t"), F.sum("cell_n").alias("cell_t"))
    return attach(both, totals, []).select(
        "gene_id",
        (F.col("soup_n") / F.greatest("soup_t", F.lit(1))).alias("soup_frac"),
        (F.col("cell_n") / F.greatest("cell_t", F.lit(1))).alias("cell_frac"))


def empty_droplet_correlation(profile: DataFrame) -> DataFrame:
    """Pearson correlation of the two log profiles; one row."""
    return profile.agg(F.corr(F.log1p(F.col("soup_frac") * 1e4), F.log1p(F.col("cell_frac") * 1e4))
                       .alias("pearson_r_log"))


def top_ambient_genes(profile: DataFrame, n: int = 15) -> DataFrame:
    return profile.orderBy(F.desc("soup_frac"), "gene_id").limit(n).select("gene_id", "soup_frac")


def soup_profile(counts: DataFrame, obs: DataFrame, sample: str = "sample") -> DataFrame:
    """Share of every gene in a sample's total counts."""
    per_gene = (counts.join(obs.select("cell_id", sample), "cell_id").groupBy(sample, "gene_id")
                .agg(F.sum("count").alias("n")))
    totals = per_gene.groupBy(sample).agg(F.sum("n").alias("t"))
    return per_gene.join(totals, sample).select(sample, "gene_id", (F.col("n") / F.col("t")).alias("soup"))


def ambient_fraction(counts: DataFrame, obs: DataFrame, gene_sets: DataFrame,
                     soup: DataFrame, sample: str = "sample") -> DataFrame:
    """Contamination share per sample.

    For each cell the sets it does not express (fewer than two genes detected) act as negative
    controls: observed counts in them over the counts the soup profile predicts.  The sample value is the
    median over cells, capped at one.
    """
    members = gene_sets.select("set_name", "gene_id").distinct()
    cells = obs.select("cell_id", sample)
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("total"))
    set_soup = soup.join(members, "gene_id").groupBy(sample, "set_name").agg(F.sum("soup").alias("set_soup"))
    all_soup = set_soup.groupBy(sample).agg(F.sum("set_soup").alias("all_soup"))
    seen = (counts.join(members, "gene_id").groupBy("cell_id", "set_name")
            .agg(F.count(F.lit(1)).alias("n_det"), F.sum("count").alias("n")))
    own = seen.join(cells, "cell_id").join(set_soup, [sample, "set_name"])
    expressed = F.col("n_det") >= 2
    per_cell = own.groupBy("cell_id").agg(
        F.sum(F.when(expressed, F.col("set_soup")).otherwise(0.0)).alias("expressed_soup"),
        F.sum(F.when(~expressed, F.col("n")).otherwise(0)).alias("observed"))
    expected = F.col("total") * (F.col("all_soup") - F.coalesce("expressed_soup", F.lit(0.0)))
    rho = (cells.join(totals, "cell_id").join(all_soup, sample).join(per_cell, "cell_id", "left")
           .withColumn("expected", expected).where(F.col("expected") > 1e-12)
           .select(sample, F.least(F.lit(1.0), F.coalesce("observed", F.lit(0)) / F.col("expected")).alias("rho")))
    med = quantiles(rho, [sample], {"rho": [0.5]}).select(sample, F.col("rho_q50").alias("median_rho"))
    return rho.groupBy(sample).agg(F.avg("rho").alias("mean_rho")).join(med, sample)


def remove_ambient(counts: DataFrame, obs: DataFrame, soup: DataFrame, rho: DataFrame,
                   sample: str = "sample") -> DataFrame:
    """Corrected counts beside the originals: ``max(0, round(count - rho * total * soup))``."""
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("total"))
    fixed_n = F.greatest(F.lit(0.0), F.round(F.col("count") - F.col("median_rho") * F.col("total") * F.col("soup")))
    return (counts.join(obs.select("cell_id", sample), "cell_id").join(totals, "cell_id")
            .join(rho.select(sample, "median_rho"), sample).join(soup, [sample, "gene_id"])
            .select("cell_id", "gene_id", F.col("count").alias("count_raw"), fixed_n.cast("bigint").alias("count")))


def figure_quantiles(metrics: DataFrame, columns: Sequence[str], sample: str = "sample",
                     probs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Distribution data per sample and metric in long form: ``(sample, metric, prob, value)``."""
    q = quantiles(metrics, [sample], {c: probs for c in columns})
    cells = [F.struct(F.lit(c).alias("metric"), F.lit(float(p)).alias("prob"),
                      F.col(quantile_name(c, p)).alias("value")) for c in columns for p in probs]
    return (q.select(sample, F.explode(F.array(*cells)).alias("e"))
            .select(sample, "e.metric", "e.prob", "e.value"))
