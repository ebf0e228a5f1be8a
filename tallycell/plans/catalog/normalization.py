"""Normalisation, feature selection and integration-check queries."""

from pyspark.sql import functions as F

from tallycell.operators import integrate, normalize
from tallycell.plans.registry import query, six
from tallycell.plans.standin import r, sql

GROUPS = {"warm": ["^red", "^hot"], "cool": ["^blue", "^cold"], "tools": ["anvil$"]}


@query("norm_gene_groups", sql(
    """SELECT gene_id, symbol, 'warm' AS "group" FROM var WHERE symbol LIKE 'red%' OR symbol LIKE 'hot%'
    UNION ALL SELECT gene_id, symbol, 'cool' FROM var WHERE symbol LIKE 'blue%' OR symbol LIKE 'cold%'
    UNION ALL SELECT gene_id, symbol, 'tools' FROM var WHERE symbol LIKE '%anvil'""", "var"))
def _(d):
    return normalize.genes_in_groups(d.var, normalize.resolve_groups(["warm", "cool", "tools"], groups=GROUPS))


@query("norm_excluded_groups", sql(
    """SELECT cell_id, count(*) AS n_genes, CAST(sum(n) AS BIGINT) AS total FROM counts JOIN var USING (gene_id)
    WHERE NOT (symbol LIKE 'red%' OR symbol LIKE 'hot%' OR symbol LIKE '%anvil') GROUP BY 1""", "counts", "var"))
def _(d):
    left = normalize.exclude_groups(d.counts, d.var, normalize.resolve_groups(["warm", "tools"], groups=GROUPS))
    return left.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("count").alias("total"))


@query("norm_genes_by_min_cells", sql(
    "SELECT gene_id, count(*) AS n_cells FROM counts GROUP BY 1 HAVING count(*) >= 30", "counts"))
def _(d):
    from tallycell.operators.qc import detected_genes
    return detected_genes(d.counts, 30)


@query("norm_log_normalize", sql(f"SELECT cell_id, gene_id, n AS count, {r('x')} AS x FROM ln", "ln"))
def _(d):
    return six(d.lognorm)


_MOM = """SELECT gene_id, s / n_all AS mean, (ss - s * s / n_all) / (n_all - 1) AS var FROM (
    SELECT gene_id, sum(exp(x) - 1) AS s, sum((exp(x) - 1) ** 2) AS ss FROM ln GROUP BY 1), size"""
_BINNED = """SELECT gene_id, m, d, CAST(least(19, greatest(0, ceil((m - lo) / ((hi - lo) / 20)) - 1)) AS INT) AS bin FROM (
    SELECT *, min(m) OVER () AS lo, max(m) OVER () AS hi FROM (
      SELECT gene_id, ln(1 + mean) AS m, ln(var / mean) AS d FROM mom))"""


@query("norm_hvg_mean_bins", sql(
    f"""SELECT gene_id, {r('m')} AS log_mean, {r('d')} AS log_disp, bin, {r('z', 5)} AS disp_norm FROM (
      SELECT *, (d - CASE WHEN sd IS NULL THEN 0 ELSE am END) / coalesce(sd, am) AS z FROM binned
      JOIN (SELECT bin, avg(d) AS am, stddev_samp(d) AS sd FROM binned GROUP BY 1) USING (bin))
    ORDER BY z DESC, gene_id LIMIT 300""", "ln", "size", mom=_MOM, binned=_BINNED))
def _(d):
    hvg = normalize.hvg_by_mean_bins(d.lognorm, normalize.cell_number(d.obs), 300)
    return six(hvg.withColumn("disp_norm", F.round("disp_norm", 5)))


_QB = """SELECT gene_id, mean, var / mean AS disp, len(list_filter((SELECT quantile_cont(mean, [""" + ", ".join(
    str(p / 100) for p in range(10, 105, 5)) + """]) FROM mom), lambda c: c < mean)) AS bin FROM mom"""


@query("norm_hvg_quantile_bins", sql(
    f"""SELECT gene_id, {r('mean')} AS mean, {r('disp')} AS disp, CAST(bin AS INT) AS bin, {r('z')} AS disp_norm FROM (
      SELECT gene_id, mean, disp, bin, (disp - med) / (mad / 0.6744897501960817) AS z FROM qb
      JOIN (SELECT bin, med, median(abs(disp - med)) AS mad FROM qb JOIN (SELECT bin, median(disp) AS med FROM qb
        GROUP BY 1) USING (bin) GROUP BY 1, 2) USING (bin) WHERE mad > 0)
    ORDER BY z DESC, gene_id LIMIT 300""", "ln", "size", mom=_MOM, qb=_QB))
def _(d):
    return six(normalize.hvg_by_quantile_bins(d.lognorm, normalize.cell_number(d.obs), 300))


@query("norm_hvg_variance_trend")
def _(d):
    return six(normalize.hvg_by_variance_trend(d.counts, normalize.cell_number(d.obs), 300))


_PEAR = """SELECT gene_id, coalesce(n, 0) AS n, n_all, g * total / grand AS mu
    FROM (SELECT * FROM (SELECT gene_id, sum(n)::DOUBLE AS g FROM counts GROUP BY 1), tot,
      (SELECT sum(n)::DOUBLE AS grand FROM counts), size)
    LEFT JOIN counts USING (gene_id, cell_id)"""


@query("norm_hvg_pearson_residuals", sql(
    f"""SELECT gene_id, {r('avg(z * z) - avg(z) * avg(z)')} AS residual_var FROM (
      SELECT gene_id, least(sqrt(n_all), greatest(-sqrt(n_all), (n - mu) / sqrt(mu + mu * mu / 100))) AS z FROM pear)
    GROUP BY 1 ORDER BY avg(z * z) - avg(z) * avg(z) DESC, gene_id LIMIT 300""", "counts", "tot", "size", pear=_PEAR))
def _(d):
    return six(normalize.hvg_by_pearson_residuals(d.counts, normalize.cell_number(d.obs), 300))


_SC = """SELECT gene_id, s / n_all AS mean, sqrt((ss - s * s / n_all) / (n_all - 1)) AS sd FROM (
    SELECT gene_id, sum(x) AS s, sum(x * x) AS ss FROM ln GROUP BY 1), size"""


@query("norm_scaled_entries", sql(
    f"""SELECT cell_id, gene_id, {r('least(10.0, greatest(-10.0, (x - mean) / sd))')} AS z,
      {r('greatest(-10.0, -mean / sd)')} AS z0 FROM ln JOIN sc USING (gene_id)""", "ln", "size", sc=_SC))
def _(d):
    par = normalize.scale_parameters(d.lognorm, normalize.cell_number(d.obs), d.var)
    return six(normalize.scaled_entries(d.lognorm, par))


def components(d, n_top=200, k=10):
    n = normalize.cell_number(d.obs)
    hvg = normalize.hvg_by_mean_bins(d.lognorm, n, n_top).select("gene_id").persist()
    par = normalize.scale_parameters(d.lognorm, n, hvg)
    vectors, size = normalize.feature_vectors(d.obs, normalize.scaled_entries(d.lognorm, par), hvg)
    return normalize.principal_components(vectors.persist(), size, d.obs.count(), k)


@query("norm_pca_scores")
def _(d):
    return six(components(d).embedding.select("cell_id", F.posexplode("v").alias("component", "value")))


_REG = """SELECT gene_id, (sxz - sx * sz / n) / (szz - sz * sz / n) AS b1,
      sx / n - (sxz - sx * sz / n) / (szz - sz * sz / n) * sz / n AS b0 FROM
    (SELECT gene_id, sum(x) AS sx, sum(x * score) AS sxz FROM ln JOIN obs USING (cell_id) GROUP BY 1),
    (SELECT count(*)::DOUBLE AS n, sum(score) AS sz, sum(score * score) AS szz FROM obs)"""


@query("norm_regression_coefficients", sql(
    f"SELECT gene_id, {r('b0')} AS b0, {r('b1 * 10000')} AS b1 FROM reg", "ln", "obs", reg=_REG))
def _(d):
    co = normalize.regression_coefficients(d.lognorm, d.obs, ["score"], normalize.cell_number(d.obs))
    return six(co.withColumn("b1", F.col("b1") * 10000))


@query("norm_regressed_entries", sql(
    f"SELECT cell_id, gene_id, {r('x - b0 - b1 * score')} AS residual FROM ln JOIN obs USING (cell_id) JOIN reg USING (gene_id)",
    "ln", "obs", reg=_REG))
def _(d):
    co = normalize.regression_coefficients(d.lognorm, d.obs, ["score"], normalize.cell_number(d.obs))
    return six(normalize.regressed_entries(d.lognorm, d.obs, ["score"], co))


_CANDS = ["condition", "label", "batch", "timepoint"]
_TAB = " UNION ALL ".join(f"SELECT '{c}' AS candidate, sample AS batch, {c} AS bio, count(*) AS n FROM obs GROUP BY ALL"
                          for c in _CANDS)
# The full cross of levels, zeros included, as the textbook statistic has it.
_V = """SELECT candidate, nb AS n_batch, ny AS n_bio, CASE WHEN least(nb, ny) < 2 THEN 1.0
      ELSE sqrt(chi / (t * (least(nb, ny) - 1))) END AS v FROM (
    SELECT candidate, any_value(t) AS t, count(DISTINCT batch) AS nb, count(DISTINCT bio) AS ny,
      sum((coalesce(n, 0) - rn * cn / t) ** 2 / (rn * cn / t)) AS chi
    FROM (SELECT candidate, batch, sum(n)::DOUBLE AS rn FROM tab GROUP BY 1, 2)
    JOIN (SELECT candidate, bio, sum(n)::DOUBLE AS cn FROM tab GROUP BY 1, 2) USING (candidate)
    JOIN (SELECT candidate, sum(n)::DOUBLE AS t FROM tab GROUP BY 1) USING (candidate)
    LEFT JOIN tab USING (candidate, batch, bio) GROUP BY 1)"""
_GUARD = f"""SELECT candidate, n_batch, n_bio, {r('v')} AS cramers_v, CAST(mb AS BIGINT) AS min_batches,
      CAST(ns AS BIGINT) AS n_spanning, mb < 2 AS confounded, (mb >= 2 AND v > 0.9) AS nested_but_safe FROM v
    JOIN (SELECT candidate, min(b) AS mb FROM (SELECT candidate, bio, sum((n >= 10)::INT) AS b FROM tab GROUP BY 1, 2)
      GROUP BY 1) USING (candidate)
    JOIN (SELECT candidate, sum((b > 1)::INT) AS ns FROM (SELECT candidate, batch, sum((n >= 10)::INT) AS b FROM tab
      GROUP BY 1, 2) GROUP BY 1) USING (candidate)"""


@query("integrate_cramers_v", sql(
    f"SELECT candidate, n_batch, n_bio, {r('v')} AS cramers_v FROM v", "obs", tab=_TAB, v=_V))
def _(d):
    return six(integrate.cramers_v(integrate.contingency(d.obs, "sample", _CANDS)))


@query("integrate_confounding_guard", sql(_GUARD, "obs", tab=_TAB, v=_V))
def _(d):
    return six(integrate.confounding_guard(integrate.contingency(d.obs, "sample", _CANDS)))


@query("integrate_worst_confounder", sql(
    f"SELECT * FROM ({_GUARD}) ORDER BY confounded DESC, cramers_v DESC, candidate LIMIT 1", "obs", tab=_TAB, v=_V))
def _(d):
    return six(integrate.worst_confounder(integrate.confounding_guard(integrate.contingency(d.obs, "sample", _CANDS))))


@query("integrate_harmonized_embedding")
def _(d):
    z = integrate.harmonize(d.embedding, "batch", n_clusters=10, max_iter=4)
    return six(z.select("cell_id", F.posexplode("v").alias("dim", "value")))
