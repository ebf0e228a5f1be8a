"""Pseudobulk, differential expression and enrichment queries."""

from pyspark.sql import functions as F

from tallycell.operators import de, enrich, markers
from tallycell.plans.catalog.graph import ADJ, P_NORMAL
from tallycell.plans.registry import query, six
from tallycell.plans.standin import r, sql
from tallycell.session import checkpointed

A, B = "ASIA", "EUROPE"
UNITS = "SELECT label, sample, count(*) AS n_cells FROM obs GROUP BY 1, 2 HAVING count(*) >= 10"
BULK = """SELECT label, sample, gene_id, CAST(sum(n) AS BIGINT) AS count FROM counts JOIN obs USING (cell_id)
    SEMI JOIN units USING (label, sample) GROUP BY 1, 2, 3"""


def bulk(d):
    return de.pseudobulk(d.counts, d.obs)


def info(d):
    return d.obs.select("sample", "condition", "timepoint").distinct()


def design(d):
    return de.resolve_design(bulk(d), info(d), "condition", A, B, ["timepoint"], min_samples=2, min_count_sum=100)


@query("de_pseudobulk_counts", sql("SELECT * FROM bulk", "obs", "counts", units=UNITS, bulk=BULK))
def _(d):
    return bulk(d).counts


@query("de_pseudobulk_dropped", sql(
    """SELECT label, sample, count(*) AS n_cells, 'fewer than min_cells=10' AS reason FROM obs GROUP BY 1, 2
    HAVING count(*) < 10""", "obs"))
def _(d):
    return bulk(d).dropped


@query("de_pseudobulk_matrix", sql(
    """SELECT label, sample, condition, timepoint, n_cells, CAST(sum(count) AS BIGINT) AS total, count(*) AS n_genes
    FROM bulk JOIN units USING (label, sample) JOIN (SELECT DISTINCT sample, condition, timepoint FROM obs) USING (sample)
    GROUP BY 1, 2, 3, 4, 5""", "obs", "counts", units=UNITS, bulk=BULK))
def _(d):
    b = bulk(d)
    return (b.counts.join(b.units, ["label", "sample"]).join(info(d), "sample")
            .groupBy("label", "sample", "condition", "timepoint", "n_cells")
            .agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_genes")))


_ARMS = f"""SELECT label, sample, condition AS arm, timepoint FROM units JOIN (SELECT DISTINCT sample, condition, timepoint FROM obs)
    USING (sample) WHERE condition IN ('{A}', '{B}')"""
_KEPT = f"""SELECT * FROM arms SEMI JOIN (SELECT label, timepoint FROM arms GROUP BY 1, 2 HAVING count(DISTINCT arm) = 2)
    USING (label, timepoint)"""
_STATE = f"""SELECT label, coalesce(a1, 0) < 2 OR coalesce(b1, 0) < 2 AS early, coalesce(a2, 0) < 2 OR coalesce(b2, 0) < 2 AS late,
      coalesce(g, 0) < 50 AS thin FROM (SELECT DISTINCT label FROM units)
    LEFT JOIN (SELECT label, sum((arm = '{A}')::INT) AS a1, sum((arm = '{B}')::INT) AS b1 FROM arms GROUP BY 1) USING (label)
    LEFT JOIN (SELECT label, sum((arm = '{A}')::INT) AS a2, sum((arm = '{B}')::INT) AS b2 FROM kept GROUP BY 1) USING (label)
    LEFT JOIN (SELECT label, count(*) AS g FROM gsum GROUP BY 1) USING (label)"""
_GSUM = """SELECT label, gene_id FROM bulk SEMI JOIN kept USING (label, sample) GROUP BY 1, 2 HAVING sum(count) >= 100"""
_DESIGN = {"units": UNITS, "bulk": BULK, "arms": _ARMS, "kept": _KEPT, "gsum": _GSUM, "state": _STATE}


@query("de_design_units", sql(
    "SELECT label, sample, arm, timepoint FROM kept JOIN state USING (label) WHERE NOT (early OR late OR thin)",
    "obs", "counts", **_DESIGN))
def _(d):
    return design(d).units.select("label", "sample", "arm", "timepoint")


@query("de_design_genes", sql(
    "SELECT label, gene_id FROM gsum JOIN state USING (label) WHERE NOT (early OR late OR thin)", "obs", "counts", **_DESIGN))
def _(d):
    return design(d).genes


@query("de_design_skipped", sql(
    """SELECT label, CASE WHEN early THEN 'too few samples in an arm' WHEN late THEN
      'too few samples after dropping unbalanced covariate levels' ELSE 'fewer than 50 genes reach min_count_sum=100' END AS reason
    FROM state WHERE early OR late OR thin""", "obs", "counts",
    **{k: v.replace("< 2 ", "< 3 ").replace("< 2 AS", "< 3 AS") for k, v in _DESIGN.items()}))
def _(d):
    return de.resolve_design(bulk(d), info(d), "condition", A, B, ["timepoint"], min_samples=3, min_count_sum=100).skipped


@query("de_size_factors", sql(
    f"""SELECT label, sample, {r('exp(median(ln(count) - gm))')} AS size_factor FROM big JOIN (
      SELECT label, gene_id, avg(ln(count)) AS gm FROM big GROUP BY 1, 2 HAVING count(*) = 5) USING (label, gene_id) GROUP BY 1, 2""",
    "obs", "counts", big="""SELECT 'all' AS label, condition AS sample, gene_id, sum(n)::DOUBLE AS count FROM counts
      JOIN obs USING (cell_id) GROUP BY 1, 2, 3"""))
def _(d):
    b = de.pseudobulk(d.counts, d.obs.withColumn("label", F.lit("all")), sample="condition")
    return six(de.size_factors(b.counts, b.units))


def nb_results(d):
    whole = d.obs.withColumn("label", F.lit("all"))
    b = de.Pseudobulk(*[checkpointed(t) for t in de.pseudobulk(d.counts, whole)])
    des = de.resolve_design(b, info(d), "condition", A, B, min_samples=2)
    # Samples are too sparse here for a gene seen in all of them; library size over its mean serves instead.
    totals = b.counts.groupBy("label", "sample").agg(F.sum("count").alias("t"))
    mean = totals.groupBy("label").agg(F.avg("t").alias("m"))
    factors = totals.join(mean, "label").select("label", "sample", (F.col("t") / F.col("m")).alias("size_factor"))
    return de.nb_test(b.counts, des, checkpointed(factors), A)


@query("de_nb_test")
def _(d):
    return six(nb_results(d))


@query("de_interaction_fit")
def _(d):
    whole = d.obs.withColumn("label", F.lit("all"))
    b = de.Pseudobulk(*[checkpointed(t) for t in de.pseudobulk(d.counts, whole)])
    des = de.resolve_design(b, info(d), "condition", A, B, min_samples=2)
    units = des.units.join(info(d).select("sample", "timepoint"), "sample")
    factors = checkpointed(des.units.select("label", "sample", F.lit(1.0).alias("size_factor")))
    return six(de.nb_test(b.counts, des._replace(units=checkpointed(units)), factors, A, interaction="timepoint"))


_ARMCELLS = f"SELECT * FROM obs WHERE condition IN ('{A}', '{B}')"
_CW = {
    "cells": _ARMCELLS,
    "sizes": """SELECT label, sum((condition = 'ASIA')::INT) AS ng, count(*) AS na FROM cells GROUP BY 1""",
    "dense": """SELECT gene_id, cell_id, label, condition, coalesce(x, 0.0) AS x FROM (SELECT * FROM var, cells)
        LEFT JOIN ln USING (gene_id, cell_id)""",
    "ranked": """SELECT *, rank() OVER (PARTITION BY label, gene_id ORDER BY x)
        + (count(*) OVER (PARTITION BY label, gene_id, x) - 1) / 2.0::DOUBLE AS rk FROM dense""",
    "per": """SELECT gene_id, label, sum(rk) FILTER (condition = 'ASIA') AS rs, coalesce(sum(x) FILTER (condition = 'ASIA'), 0) AS s,
        sum(x) AS st FROM ranked GROUP BY 1, 2""",
    "test": f"""SELECT *, {P_NORMAL} AS p FROM (SELECT gene_id, label, (rs - ng * (na + 1) / 2.0)
        / sqrt(ng::DOUBLE * (na - ng) * (na + 1) / 12.0) AS z,
        log2((exp(s / ng) - 1 + 1e-9) / (exp((st - s) / (na - ng)) - 1 + 1e-9)) AS lfc FROM per JOIN sizes USING (label))""",
    "adj": ADJ}


@query("de_cellwise_test", sql(
    f"SELECT gene_id, label, {r('z')} AS score, {r('p')} AS pval, {r('q')} AS padj, {r('lfc')} AS lfc, true AS exploratory FROM adj",
    "ln", "obs", "var", **_CW))
def _(d):
    return six(cellwise(d).drop("pct_group", "pct_rest"))


def cellwise(d):
    return checkpointed(de.cellwise_test(d.lognorm, d.obs, d.var, "condition", A, B))


@query("de_direction_counts", sql(
    """SELECT label, sum((p < 0.05 AND lfc > 0.5)::INT)::BIGINT AS n_up, sum((p < 0.05 AND lfc < -0.5)::INT)::BIGINT AS n_down
    FROM test GROUP BY 1""", "ln", "obs", "var", **_CW))
def _(d):
    return de.direction_counts(cellwise(d).withColumn("padj", F.col("pval")))


@query("de_shrunken_lfc", sql(
    f"""SELECT label, gene_id, {r('lfc')} AS lfc_unshrunk, {r('lfc * w / (w + 0.25)')} AS lfc FROM test JOIN (
      SELECT label, greatest(quantile_cont(abs(lfc), 0.95) / 1.959963984540054, 1e-3) ** 2 AS w FROM test GROUP BY 1) USING (label)""",
    "ln", "obs", "var", **_CW))
def _(d):
    t = cellwise(d).withColumn("lfc_se", F.lit(0.5))
    return six(de.shrink_lfc(t).select("label", "gene_id", "lfc_unshrunk", "lfc"))


@query("de_interaction_balance", sql(
    """SELECT label, count(*) AS n_combinations, min(n) AS min_samples,
      count(*) = count(DISTINCT condition) * count(DISTINCT timepoint) AND count(*) >= 4 AND min(n) >= 2 AS testable FROM (
      SELECT label, condition, timepoint, count(*) AS n FROM units JOIN (SELECT DISTINCT sample, condition, timepoint FROM obs)
      USING (sample) GROUP BY 1, 2, 3) GROUP BY 1""", "obs", units=UNITS))
def _(d):
    return de.interaction_balance(bulk(d).units, info(d), "condition", "timepoint")


_RUNS = {**_CW, "run_a": "SELECT label, gene_id, lfc, q AS padj FROM adj",
         "run_b": "SELECT label, gene_id, lfc * (CASE WHEN gene_id % 3 = 0 THEN -1 ELSE 1 END) AS lfc, p AS padj FROM test WHERE gene_id % 5 > 0"}


@query("de_compare_runs", sql(
    f"""SELECT label, n_common_genes, {r('rho')} AS spearman_lfc, {r('jac')} AS jaccard_top, n_sig_a, n_sig_b FROM (
      SELECT label, count(*) AS n_common_genes, corr(rx, ry) AS rho FROM (SELECT label,
        rank() OVER (PARTITION BY label ORDER BY a.lfc) + (count(*) OVER (PARTITION BY label, a.lfc) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY label ORDER BY b.lfc) + (count(*) OVER (PARTITION BY label, b.lfc) - 1) / 2.0::DOUBLE AS ry
        FROM run_a a JOIN run_b b USING (label, gene_id)) GROUP BY 1)
    JOIN (SELECT label, sum((k = 2)::INT)::DOUBLE / count(*) AS jac FROM (SELECT label, gene_id, count(*) AS k FROM (
      SELECT * FROM (SELECT label, gene_id, row_number() OVER (PARTITION BY label ORDER BY round(padj, 12), gene_id) AS i FROM run_a) WHERE i <= 100
      UNION ALL SELECT * FROM (SELECT label, gene_id, row_number() OVER (PARTITION BY label ORDER BY round(padj, 12), gene_id) AS i FROM run_b)
        WHERE i <= 100) GROUP BY 1, 2) GROUP BY 1) USING (label)
    JOIN (SELECT label, sum((padj < 0.05)::INT)::BIGINT AS n_sig_a FROM run_a GROUP BY 1) USING (label)
    JOIN (SELECT label, sum((padj < 0.05)::INT)::BIGINT AS n_sig_b FROM run_b GROUP BY 1) USING (label)""", "ln", "obs", "var", **_RUNS))
def _(d):
    a = cellwise(d).select("label", "gene_id", "lfc", "padj", "pval")
    b = a.where(F.col("gene_id") % 5 > 0).select(
        "label", "gene_id", (F.col("lfc") * F.when(F.col("gene_id") % 3 == 0, -1).otherwise(1)).alias("lfc"),
        F.col("pval").alias("padj"))
    return six(de.compare_runs(a.drop("pval"), b))


# Enrichment of the genes each label prefers at a nominal p of .05.
_SIG = """SELECT label, gene_id, CASE WHEN lfc > 0.1 THEN 'up' ELSE 'down' END AS direction FROM test
    WHERE p < 0.9 AND abs(lfc) > 0.1"""
_ORA = """SELECT *, least(1.0, (SELECT sum(exp(lgamma(n_set + 1) - lgamma(i + 1) - lgamma(n_set - i + 1)
      + lgamma(bg - n_set + 1) - lgamma(n_list - i + 1) - lgamma(bg - n_set - n_list + i + 1)
      - lgamma(bg + 1) + lgamma(n_list + 1) + lgamma(bg - n_list + 1)))
      FROM range(0, 20000) t(i) WHERE i >= overlap AND i <= least(n_set, n_list))) AS pval FROM (
    SELECT label, direction, set_name, count(*) AS overlap, any_value(n_list) AS n_list, any_value(n_set) AS n_set, 15000 AS bg
    FROM sig JOIN (SELECT *, count(*) OVER (PARTITION BY set_name) AS n_set FROM sets) USING (gene_id)
    JOIN (SELECT label, direction, count(*) AS n_list FROM sig GROUP BY 1, 2 HAVING count(*) >= 5) USING (label, direction) GROUP BY 1, 2, 3)"""
_ORAQ = """SELECT *, least(1.0, min(pval * m / rk) OVER (PARTITION BY label, direction ORDER BY pval DESC ROWS UNBOUNDED PRECEDING)) AS padj
    FROM (SELECT *, count(*) OVER (PARTITION BY label, direction) AS m, rank() OVER (PARTITION BY label, direction ORDER BY pval)
      + count(*) OVER (PARTITION BY label, direction, pval) - 1 AS rk FROM ora)"""
_ENR = {**_CW, "sig": _SIG, "ora": _ORA, "oraq": _ORAQ}


def ora(d):
    sig = enrich.directions(cellwise(d).withColumn("padj", F.col("pval")), 0.9, 0.1)
    return enrich.over_representation(sig, d.gene_sets)


@query("enrich_over_representation", sql(
    f"""SELECT label, direction, set_name, overlap, n_list, n_set, {r('pval')} AS pval,
      {r('(overlap::DOUBLE / n_list) / (n_set / 15000.0::DOUBLE)')} AS fold, {r('padj')} AS padj FROM oraq""",
    "ln", "obs", "var", "sets", **_ENR))
def _(d):
    return six(ora(d))


@query("enrich_tile_data", sql(
    f"""SELECT label, direction, set_name, {r('-log10(greatest(padj, 1e-300))')} AS log_padj,
      CAST(CASE direction WHEN 'down' THEN 1 ELSE 2 END AS INT) AS dir_ord, row_number() OVER (PARTITION BY label ORDER BY
      direction, round(-log10(greatest(padj, 1e-300)), 9) DESC, set_name) AS display FROM oraq""", "ln", "obs", "var", "sets", **_ENR))
def _(d):
    return six(enrich.tile_data(ora(d)).select("label", "direction", "set_name", "log_padj", "dir_ord", "display"))


_TERM = "upper(left({0}, 1)) || substr({0}, 2)"


@query("enrich_clean_terms", """SELECT term, upper(left(t, 1)) || substr(t, 2) AS clean FROM (SELECT DISTINCT p_name || '_set (GO:' || p_size || ')' AS term,
    replace(trim(split_part(p_name || '_set (GO:' || p_size || ')', '(', 1)), '_', ' ') AS t FROM part)""")
def _(d):
    t = d.table("part").select(F.concat("p_name", F.lit("_set (GO:"), F.col("p_size").cast("string"), F.lit(")")).alias("term")).distinct()
    return t.withColumn("clean", enrich.clean_term(F.col("term")))


@query("enrich_kept_terms", "SELECT DISTINCT p_name AS term FROM part WHERE p_name NOT LIKE '%anvil%' AND p_name NOT LIKE '%red r%'")
def _(d):
    return enrich.exclude_terms(d.table("part").select(F.col("p_name").alias("term")).distinct(), ["ANVIL", "Red r"]).kept


@query("enrich_dropped_terms", "SELECT DISTINCT p_name AS term FROM part WHERE p_name LIKE '%anvil%' OR p_name LIKE '%red r%'")
def _(d):
    return enrich.exclude_terms(d.table("part").select(F.col("p_name").alias("term")).distinct(), ["ANVIL", "Red r"]).dropped


_ES = """SELECT label, set_name, n_hits, CASE WHEN hi >= -lo THEN hi ELSE lo END AS es FROM (
    SELECT label, set_name, any_value(nh) AS n_hits, max(cw / tw - miss) AS hi, min(cwb / tw - missb) AS lo FROM (
      SELECT *, sum(h * abs(z)) OVER w AS cw, sum(h * abs(z)) OVER w - h * abs(z) AS cwb, sum(h * abs(z)) OVER (PARTITION BY label, set_name) AS tw,
        sum(1 - h) OVER w / (n - nh)::DOUBLE AS miss, (sum(1 - h) OVER w - (1 - h)) / (n - nh)::DOUBLE AS missb FROM (
        SELECT label, s.set_name, gene_id, z, (brand = s.set_name)::INT AS h, sum((brand = s.set_name)::INT) OVER (PARTITION BY label, s.set_name) AS nh,
          count(*) OVER (PARTITION BY label, s.set_name) AS n FROM test JOIN var USING (gene_id), (SELECT DISTINCT set_name FROM sets) s)
      WINDOW w AS (PARTITION BY label, set_name ORDER BY z DESC, gene_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2) WHERE n_hits BETWEEN 10 AND 500"""


@query("enrich_preranked_scores", sql(
    f"SELECT label, set_name, CAST(n_hits AS BIGINT) AS n_hits, {r('es')} AS es FROM es", "ln", "obs", "var", "sets", **_CW, es=_ES))
def _(d):
    return six(enrich.observed_enrichment(enrich.ranking_metric(cellwise(d), "score"), d.gene_sets))


@query("enrich_preranked_permutations")
def _(d):
    ranked = enrich.ranking_metric(cellwise(d), "score")
    return six(enrich.preranked_enrichment(ranked, d.gene_sets, n_perm=100, max_size=5000))


@query("enrich_regulator_activity", sql(
    f"""SELECT label, set_name, n_targets, {r('rho * sqrt((n - 2) / (1 - rho * rho))')} AS activity FROM (
      SELECT label, s.set_name, corr(z, CASE WHEN brand = s.set_name THEN weight ELSE 0 END) AS rho, count(*) AS n,
        sum((brand = s.set_name)::INT)::BIGINT AS n_targets FROM test JOIN var USING (gene_id) JOIN sets USING (gene_id),
        (SELECT DISTINCT set_name FROM sets) s GROUP BY 1, 2)""", "ln", "obs", "var", "sets", **_CW))
def _(d):
    return six(enrich.regulator_activity(cellwise(d), d.gene_sets))


@query("enrich_libraries", """SELECT p_name AS library, p_type AS question FROM part WHERE p_type = 'ECONOMY' GROUP BY 1, 2""")
def _(d):
    cat = d.table("part").select(F.col("p_name").alias("library"), F.col("p_type").alias("question")).distinct()
    return enrich.libraries_for(cat, "ECONOMY", "mouse")
