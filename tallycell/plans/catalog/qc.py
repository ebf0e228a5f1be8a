"""Quality-control queries."""

from pyspark.sql import functions as F

from tallycell.operators import qc
from tallycell.plans.registry import query, six
from tallycell.plans.standin import PATTERNS, r, sql

LIMITS = {"min_genes": 25, "max_genes": 60, "min_counts": 600, "max_counts": 2000, "max_pct_mt": 20.0}
_REASON = """CASE WHEN NOT n_genes >= 25 THEN 'min_genes' WHEN NOT n_genes <= 60 THEN 'max_genes'
    WHEN NOT total_counts >= 600 THEN 'min_counts' WHEN NOT total_counts <= 2000 THEN 'max_counts'
    WHEN NOT coalesce(pct_mt <= 20.0, false) THEN 'max_pct_mt' END"""
_LADDER = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
_MED = {"pct_counts_mt": "pct_mt", "pct_counts_ribo": "pct_ribo", "pct_counts_hb": "pct_hb",
        "pct_counts_in_top_20_genes": "pct_top20", "pct_counts_in_top_50_genes": "pct_top50",
        "complexity": "complexity", "frac_keratin": "frac_keratin", "frac_collagen": "frac_collagen",
        "frac_cornified": "frac_cornified"}
_RATE = """CASE WHEN n_cells <= 500 THEN 0.004 WHEN n_cells <= 1000 THEN 0.004 + (n_cells - 500) * 0.004 / 500
    WHEN n_cells <= 2000 THEN 0.008 + (n_cells - 1000) * 0.008 / 1000
    WHEN n_cells <= 3000 THEN 0.016 + (n_cells - 2000) * 0.007 / 1000
    WHEN n_cells <= 4000 THEN 0.023 + (n_cells - 3000) * 0.008 / 1000
    WHEN n_cells <= 5000 THEN 0.031 + (n_cells - 4000) * 0.008 / 1000
    WHEN n_cells <= 6000 THEN 0.039 + (n_cells - 5000) * 0.007 / 1000
    WHEN n_cells <= 7000 THEN 0.046 + (n_cells - 6000) * 0.008 / 1000
    WHEN n_cells <= 8000 THEN 0.054 + (n_cells - 7000) * 0.007 / 1000
    WHEN n_cells <= 9000 THEN 0.061 + (n_cells - 8000) * 0.008 / 1000
    WHEN n_cells <= 10000 THEN 0.069 + (n_cells - 9000) * 0.007 / 1000
    WHEN n_cells <= 15000 THEN 0.076 + (n_cells - 10000) * 0.039 / 5000
    WHEN n_cells <= 20000 THEN 0.115 + (n_cells - 15000) * 0.037 / 5000
    ELSE least(0.35, 0.152 + (n_cells - 20000) * 7.6e-6) END"""
_QS = ", ".join(f"quantile_cont({c}::DOUBLE, {p}) AS {c}_q{p * 100:g}" for c in ("n_genes", "total_counts")
                for p in _LADDER)
_MEDS = ", ".join(f"median({s}) AS median_{c}" for c, s in _MED.items())
STATS = f"""SELECT a.*, mad_n_genes, mad_total_counts, round({_RATE}, 4) AS expected_doublet_rate FROM (
    SELECT sample, count(*) AS n_cells, median(n_genes::DOUBLE) AS median_n_genes,
      median(total_counts::DOUBLE) AS median_total_counts, {_MEDS}, {_QS} FROM metrics GROUP BY 1) a JOIN (
    SELECT sample, median(abs(n_genes - mg)) AS mad_n_genes, median(abs(total_counts - mc)) AS mad_total_counts
    FROM metrics JOIN (SELECT sample, median(n_genes::DOUBLE) mg, median(total_counts::DOUBLE) mc
      FROM metrics GROUP BY 1) USING (sample) GROUP BY 1) USING (sample)"""
_STAT_COLS = ([f"median_{c}" for c in ("n_genes", "total_counts", *_MED)]
              + [f"{c}_q{p * 100:g}" for c in ("n_genes", "total_counts") for p in _LADDER]
              + ["mad_n_genes", "mad_total_counts"])


_METRIC_OUT = ", ".join(f"{r(s)} AS {c}" for c, s in _MED.items())


@query("qc_cell_metrics", sql(
    f"SELECT cell_id, sample, n_genes, CAST(total_counts AS BIGINT) AS total_counts, {_METRIC_OUT} FROM metrics",
    "metrics"))
def _(d):
    return six(qc.cell_metrics(d.counts, d.obs, d.var, PATTERNS).drop("condition", "label", "batch", "timepoint", "score"))


@query("qc_sample_stats", sql(
    "SELECT sample, n_cells, expected_doublet_rate, " + ", ".join(f"{r(c)} AS {c}" for c in _STAT_COLS)
    + " FROM stats", "metrics", stats=STATS))
def _(d):
    return six(qc.sample_stats(d.metrics))


@query("qc_cohort_outliers", sql(
    f"""SELECT sample, metric, {r('value')} AS value, {r('med')} AS cohort_median,
      {r('abs(value - med) / (mad * 1.4826)')} AS n_mads
    FROM long JOIN (SELECT metric, med, CASE WHEN median(abs(value - med)) = 0 THEN 1e-9 ELSE
        median(abs(value - med)) END AS mad
      FROM long JOIN (SELECT metric, median(value) AS med FROM long GROUP BY 1) USING (metric) GROUP BY 1, 2)
      USING (metric) WHERE abs(value - med) > 1.0 * mad * 1.4826""", "metrics", stats=STATS,
    long=" UNION ALL ".join(f"SELECT sample, '{c}' AS metric, {c} AS value FROM stats" for c in
                            ("median_n_genes", "median_total_counts", "median_pct_counts_mt",
                             "median_complexity"))))
def _(d):
    return six(qc.cohort_outliers(qc.sample_stats(d.metrics), n_mads=1.0))


_FLAGS = [("low_cell_count", "exclude_candidate", "n_cells", "n_cells < 200"),
          ("low_cell_count", "warn", "n_cells", "n_cells >= 200 AND n_cells < 500"),
          ("low_median_genes", "warn", "median_n_genes", "median_n_genes < 500"),
          ("high_mito", "warn", "median_pct_counts_mt", "median_pct_counts_mt > 15"),
          ("high_ambient_keratin", "warn", "median_frac_keratin", "median_frac_keratin > 0.15"),
          ("high_ambient_collagen", "warn", "median_frac_collagen", "median_frac_collagen > 0.10"),
          ("high_hemoglobin", "warn", "median_pct_counts_hb", "median_pct_counts_hb > 5"),
          ("low_complexity", "warn", "median_complexity", "median_complexity < 0.8"),
          ("saturating_doublet_rate", "warn", "expected_doublet_rate", "expected_doublet_rate > 0.10")]


@query("qc_rule_flags", sql(
    " UNION ALL ".join(f"SELECT sample, '{f}' AS flag, '{s}' AS severity, {r(f'{v}::DOUBLE')} AS value "
                       f"FROM stats WHERE {w}" for f, s, v, w in _FLAGS), "metrics", stats=STATS))
def _(d):
    return six(qc.rule_flags(qc.sample_stats(d.metrics)))


_RANGE = ["n_cells", "median_n_genes", "median_total_counts", "median_pct_counts_mt", "median_frac_keratin",
          "median_frac_collagen"]


@query("qc_cohort_range", sql(
    " UNION ALL ".join(f"SELECT '{c}' AS metric, {r(f'min({c}::DOUBLE)')} AS low, {r(f'median({c}::DOUBLE)')} AS mid, "
                       f"{r(f'max({c}::DOUBLE)')} AS high FROM stats" for c in _RANGE), "metrics", stats=STATS))
def _(d):
    return six(qc.cohort_range(qc.sample_stats(d.metrics)))


@query("qc_expected_doublet_rate", sql(
    f"SELECT n_cells, {r(_RATE)} AS rate FROM (SELECT p_partkey * 37 AS n_cells FROM part)"))
def _(d):
    n = d.table("part").select((F.col("p_partkey") * 37).alias("n_cells"))
    return six(n.select("n_cells", qc.expected_doublet_rate(F.col("n_cells")).alias("rate")))


_BOUNDS = """SELECT sample, mg - 3 * 1.4826 * sg AS glo, mg + 3 * 1.4826 * sg AS ghi,
      mc - 3 * 1.4826 * sc AS clo, mc + 3 * 1.4826 * sc AS chi,
      mm - 3 * 1.4826 * sm AS mlo, mm + 3 * 1.4826 * sm AS mhi FROM (
    SELECT sample, any_value(mg) mg, any_value(mc) mc, any_value(mm) mm, median(abs(ln(1 + n_genes) - mg)) sg,
      median(abs(ln(1 + total_counts) - mc)) sc, median(abs(pct_mt - mm)) sm
    FROM metrics JOIN (SELECT sample, median(ln(1 + n_genes)) mg, median(ln(1 + total_counts)) mc,
      median(pct_mt) mm FROM metrics GROUP BY 1) USING (sample) GROUP BY 1)"""


@query("qc_mad_bounds", sql(
    f"""SELECT sample, {r('exp(glo) - 1')} AS n_genes_lo, {r('exp(ghi) - 1')} AS n_genes_hi,
      {r('exp(clo) - 1')} AS total_counts_lo, {r('exp(chi) - 1')} AS total_counts_hi,
      {r('mlo')} AS pct_counts_mt_lo, {r('mhi')} AS pct_counts_mt_hi FROM bounds""", "metrics", bounds=_BOUNDS))
def _(d):
    return six(qc.mad_bounds(d.metrics, ["sample"],
                             {"n_genes": True, "total_counts": True, "pct_counts_mt": False}))


_PER_SAMPLE = """SELECT sample, CAST(trunc(greatest(exp(glo) - 1, 0)) AS BIGINT) AS min_genes,
    CAST(trunc(exp(ghi) - 1) AS BIGINT) AS max_genes, CAST(trunc(greatest(exp(clo) - 1, 0)) AS BIGINT) AS min_counts,
    CAST(trunc(exp(chi) - 1) AS BIGINT) AS max_counts, round(mhi, 2) AS max_pct_mt FROM bounds"""
_COHORT = """SELECT CAST(trunc(median(min_genes)) AS BIGINT) AS min_genes,
    CAST(trunc(median(max_genes)) AS BIGINT) AS max_genes, CAST(trunc(median(min_counts)) AS BIGINT) AS min_counts,
    CAST(trunc(median(max_counts)) AS BIGINT) AS max_counts, round(median(max_pct_mt), 2) AS max_pct_mt FROM per"""


@query("qc_thresholds_by_sample", sql(_PER_SAMPLE, "metrics", bounds=_BOUNDS))
def _(d):
    return qc.recommend_thresholds(d.metrics).per_sample


@query("qc_thresholds_cohort", sql(_COHORT, "metrics", bounds=_BOUNDS, per=_PER_SAMPLE))
def _(d):
    return qc.recommend_thresholds(d.metrics).cohort


@query("qc_thresholds_both", sql(
    """SELECT greatest(min_genes, 200) AS min_genes, least(max_genes, 6000) AS max_genes,
      greatest(min_counts, 500) AS min_counts, least(max_counts, 60000) AS max_counts,
      least(max_pct_mt, 10.0) AS max_pct_mt FROM cohort""",
    "metrics", bounds=_BOUNDS, per=_PER_SAMPLE, cohort=_COHORT))
def _(d):
    return qc.recommend_thresholds(d.metrics, method="both").cohort


@query("qc_low_complexity_risk", sql(
    """SELECT CAST(n_discarded AS BIGINT) AS n_discarded, CAST(n_like AS BIGINT) AS n_like, pct_like, pct_like_kept,
      (n_like >= 10 AND pct_like >= 2.0 AND pct_like > 1.5 * greatest(pct_like_kept, 0.1)) AS at_risk FROM (
      SELECT sum(lost::INT) AS n_discarded, sum((lost AND hit)::INT) AS n_like,
        round(100.0 * sum((lost AND hit)::INT) / greatest(sum(lost::INT), 1), 1) AS pct_like,
        round(100.0 * sum((NOT lost AND hit)::INT) / greatest(sum((NOT lost)::INT), 1), 1) AS pct_like_kept
      FROM (SELECT n_genes < 35 AS lost, coalesce(nd, 0) >= 2 AND coalesce(ps, 0) / greatest(total_counts, 1) >= 0.01
        AS hit FROM metrics LEFT JOIN (SELECT cell_id, count(*) AS nd, sum(n)::DOUBLE AS ps
          FROM counts JOIN sets USING (gene_id) WHERE set_name = 'Brand#7' GROUP BY 1) USING (cell_id)))""",
    "metrics", "sets"))
def _(d):
    probes = d.gene_sets.where("set_name = 'Brand#7'")
    return qc.low_complexity_risk(d.metrics, d.counts, probes, min_genes=35, floor=25)


@query("qc_preview_by_criterion", sql(
    f"SELECT reason, count(*) AS removed FROM (SELECT {_REASON} AS reason FROM metrics) "
    "WHERE reason IS NOT NULL GROUP BY 1", "metrics"))
def _(d):
    return qc.preview_filters(d.metrics, LIMITS).by_criterion


@query("qc_preview_by_sample", sql(
    f"""SELECT sample, count(*) AS before, CAST(sum((reason IS NULL)::INT) AS BIGINT) AS after,
      CAST(sum((reason IS NOT NULL)::INT) AS BIGINT) AS removed
    FROM (SELECT sample, {_REASON} AS reason FROM metrics) GROUP BY 1""", "metrics"))
def _(d):
    return qc.preview_filters(d.metrics, LIMITS).by_sample


@query("qc_lost_lineages", sql(
    f"""SELECT set_name, {r('100 * lost')} AS pct_of_lost, {r('100 * kept')} AS pct_of_kept,
      {r('lost / greatest(kept, 1e-6)')} AS enrichment_in_lost FROM (
      SELECT set_name, sum(out::INT) / (SELECT sum(out::INT)::DOUBLE FROM m) AS lost,
        sum((NOT out)::INT) / (SELECT sum((NOT out)::INT)::DOUBLE FROM m) AS kept
      FROM (SELECT cell_id, set_name FROM counts JOIN sets USING (gene_id) GROUP BY 1, 2 HAVING count(*) >= 2)
      JOIN m USING (cell_id) GROUP BY 1) WHERE lost > 0.02""",
    "metrics", "sets", m=f"SELECT cell_id, ({_REASON}) IS NOT NULL AS out FROM metrics"))
def _(d):
    return six(qc.lost_lineages(d.metrics, d.counts, d.var, d.gene_sets, LIMITS))


_KEEP = f"SELECT * FROM metrics WHERE ({_REASON}) IS NULL AND sample <> 'NATION_3'"
_GENES = "SELECT gene_id, count(*) AS n_cells FROM counts SEMI JOIN keep USING (cell_id) GROUP BY 1 HAVING count(*) >= 20"


@query("qc_filtered_cells", sql("SELECT cell_id, sample, label FROM keep", "metrics", keep=_KEEP))
def _(d):
    return qc.apply_filters(d.metrics, d.counts, LIMITS, ["NATION_3"], 20).obs.select("cell_id", "sample", "label")


@query("qc_filtered_genes", sql("SELECT * FROM genes", "metrics", keep=_KEEP, genes=_GENES))
def _(d):
    return qc.apply_filters(d.metrics, d.counts, LIMITS, ["NATION_3"], 20).genes


@query("qc_filtered_totals", sql(
    """SELECT cell_id, count(*) AS n_genes, CAST(sum(n) AS BIGINT) AS total FROM counts SEMI JOIN keep USING (cell_id)
    SEMI JOIN genes USING (gene_id) GROUP BY 1""", "metrics", keep=_KEEP, genes=_GENES))
def _(d):
    left = qc.apply_filters(d.metrics, d.counts, LIMITS, ["NATION_3"], 20).counts
    return left.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("count").alias("total"))


_PROFILE = """SELECT gene_id, coalesce(s, 0) / greatest(sum(coalesce(s, 0)) OVER (), 1) AS soup,
    c / greatest(sum(c) OVER (), 1) AS cells FROM (SELECT gene_id, sum(n)::DOUBLE AS c FROM counts GROUP BY 1)
  LEFT JOIN (SELECT gene_id, sum(n)::DOUBLE AS s FROM counts SEMI JOIN (SELECT cell_id FROM tot
    WHERE total BETWEEN 1 AND 600) USING (cell_id) GROUP BY 1) USING (gene_id)"""


@query("qc_empty_droplet_correlation", sql(
    f"SELECT {r('corr(ln(1 + soup * 10000), ln(1 + cells * 10000))')} AS pearson_r_log FROM p", "tot", p=_PROFILE))
def _(d):
    return six(qc.empty_droplet_correlation(qc.empty_droplet_profile(d.counts, d.counts, 1, 600)))


@query("qc_top_ambient_genes", sql(
    f"SELECT gene_id, {r('soup')} AS soup_frac FROM p ORDER BY soup DESC, gene_id LIMIT 15", "tot", p=_PROFILE))
def _(d):
    return six(qc.top_ambient_genes(qc.empty_droplet_profile(d.counts, d.counts, 1, 600)))


_SOUP = """SELECT sample, gene_id, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY sample) AS soup
    FROM counts JOIN obs USING (cell_id) GROUP BY 1, 2"""
_RHO = """SELECT sample, least(1.0, observed / expected) AS rho FROM (
    SELECT cell_id, sample, sum(CASE WHEN coalesce(nd, 0) < 2 THEN coalesce(nn, 0) ELSE 0 END) AS observed,
      any_value(total) * sum(CASE WHEN coalesce(nd, 0) < 2 THEN ss ELSE 0 END) AS expected
    FROM (SELECT cell_id, sample, total FROM obs JOIN tot USING (cell_id))
    JOIN (SELECT sample, set_name, sum(soup) AS ss FROM soup JOIN sets USING (gene_id) GROUP BY 1, 2) USING (sample)
    LEFT JOIN (SELECT cell_id, set_name, count(*) AS nd, sum(n)::DOUBLE AS nn FROM counts JOIN sets USING (gene_id)
      GROUP BY 1, 2) USING (cell_id, set_name) GROUP BY 1, 2) WHERE expected > 1e-12"""


@query("qc_ambient_fraction", sql(
    f"SELECT sample, {r('avg(rho)')} AS mean_rho, {r('median(rho)')} AS median_rho FROM rho GROUP BY 1",
    "obs", "tot", "sets", soup=_SOUP, rho=_RHO))
def _(d):
    soup = qc.soup_profile(d.counts, d.obs)
    return six(qc.ambient_fraction(d.counts, d.obs, d.gene_sets, soup))


@query("qc_ambient_corrected", sql(
    """SELECT sample, CAST(sum(n) AS BIGINT) AS before,
      CAST(sum(greatest(0.0, round(n - mr * total * soup))) AS BIGINT) AS after
    FROM counts JOIN tot USING (cell_id) JOIN obs USING (cell_id) JOIN soup USING (sample, gene_id)
    JOIN (SELECT sample, median(rho) AS mr FROM rho GROUP BY 1) USING (sample) GROUP BY 1""",
    "obs", "tot", "sets", soup=_SOUP, rho=_RHO))
def _(d):
    soup = qc.soup_profile(d.counts, d.obs)
    rho = qc.ambient_fraction(d.counts, d.obs, d.gene_sets, soup)
    fixed = qc.remove_ambient(d.counts, d.obs, soup, rho)
    return (fixed.join(d.obs.select("cell_id", "sample"), "cell_id").groupBy("sample")
            .agg(F.sum("count_raw").alias("before"), F.sum("count").alias("after")))


_FIG = {"n_genes": "n_genes", "total_counts": "total_counts", "pct_counts_mt": "pct_mt", "complexity": "complexity"}


@query("qc_figure_quantiles", sql(
    " UNION ALL ".join(f"SELECT sample, '{c}' AS metric, {p}::DOUBLE AS prob, "
                       f"{r(f'quantile_cont({s}::DOUBLE, {p})')} AS value FROM metrics GROUP BY 1"
                       for c, s in _FIG.items() for p in (0.0, 0.25, 0.5, 0.75, 1.0)), "metrics"))
def _(d):
    return six(qc.figure_quantiles(d.metrics, list(_FIG)))
