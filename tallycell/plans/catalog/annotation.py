"""Scoring, annotation, audit and subset queries."""

from pyspark.sql import functions as F

from tallycell.operators import annotate, markers, normalize, qc, score, subset
from tallycell.plans.catalog.graph import CHAIN
from tallycell.plans.registry import query, six
from tallycell.plans.standin import r, sql
from tallycell.plans.subcluster import subcluster
from tallycell.session import checkpointed, stored

MEANS = """SELECT gene_id, coalesce(s, 0.0) / n_all AS mean FROM (SELECT * FROM var, size)
    LEFT JOIN (SELECT gene_id, sum(x) AS s FROM ln GROUP BY 1) USING (gene_id)"""
BINS = """SELECT gene_id, floor(rank() OVER (ORDER BY mean) / greatest(1, round((SELECT count(*) FROM var) / 24))) AS bin FROM gm"""
POOL = """SELECT bin, gene_id FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('0:' || gene_id), gene_id) AS k
    FROM bins) WHERE k <= 50"""
WEIGHTS = """SELECT set_name, gene_id, 1.0 / count(*) OVER (PARTITION BY set_name) AS w FROM sets
    UNION ALL SELECT set_name, gene_id, -1.0 / count(*) OVER (PARTITION BY set_name) FROM (
      SELECT DISTINCT set_name, gene_id FROM (SELECT DISTINCT set_name, bin FROM sets JOIN bins USING (gene_id)) q
      JOIN pool USING (bin)) c WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.set_name = c.set_name AND s.gene_id = c.gene_id)"""
SCORES = """SELECT cell_id, set_name, coalesce(sum(x * w), 0.0) AS score FROM (SELECT cell_id, set_name FROM obs,
    (SELECT DISTINCT set_name FROM sets)) LEFT JOIN (SELECT cell_id, set_name, x, w FROM ln JOIN weights USING (gene_id))
    USING (cell_id, set_name) GROUP BY 1, 2"""
GMEANS = """SELECT label, set_name, count(*) AS n_cells, avg(scores.score) AS ms FROM scores JOIN obs USING (cell_id) GROUP BY 1, 2"""
STEPS = {"gm": MEANS, "bins": BINS, "pool": POOL, "weights": WEIGHTS, "scores": SCORES}
USES = ("ln", "obs", "var", "sets", "size")


def weights(d):
    return checkpointed(score.module_weights(d.lognorm, d.var, d.gene_sets, normalize.cell_number(d.obs)))


def scores(d, w):
    return score.module_scores(d.lognorm, w)


def means(d):
    sums = stored(score.gene_sums(d.lognorm, d.obs, "label"), "sums")
    w = checkpointed(score.module_weights(sums, d.var, d.gene_sets, normalize.cell_number(d.obs)))
    return score.group_means_of_sums(sums, d.obs, w, "label")


@query("score_set_coverage", sql(
    """SELECT set_name, count(*) AS n_genes, count(p) AS n_present, count(p) >= 3 AS usable, count(p) < 0.5 * count(*) AS thin
    FROM sets LEFT JOIN (SELECT DISTINCT gene_id, 1 AS p FROM counts) USING (gene_id) GROUP BY 1""", "sets", "counts"))
def _(d):
    return score.set_coverage(d.gene_sets, d.counts.select("gene_id").distinct())


@query("score_modules", sql(f"SELECT cell_id, set_name, {r('score')} AS score FROM scores", *USES, **STEPS))
def _(d):
    w = weights(d)
    return six(score.every_cell(scores(d, w), d.obs, w))


@query("score_group_means", sql(
    f"SELECT label, set_name, n_cells, {r('ms')} AS mean_score FROM gmeans", *USES, **STEPS, gmeans=GMEANS))
def _(d):
    return six(means(d))


@query("score_cell_cycle", sql(
    f"""SELECT cell_id, {r('s')} AS S_score, {r('g')} AS G2M_score,
      CASE WHEN s <= 0 AND g <= 0 THEN 'G1' WHEN g > s THEN 'G2M' ELSE 'S' END AS phase FROM (
      SELECT cell_id, max(CASE WHEN set_name = 'S' THEN score END) AS s, max(CASE WHEN set_name = 'G2M' THEN score END) AS g
      FROM scores GROUP BY 1)""", "ln", "obs", "var", "size",
    sets="""SELECT CASE p_brand WHEN 'Brand#9' THEN 'S' ELSE 'G2M' END AS set_name, p_partkey AS gene_id FROM part
      WHERE p_brand IN ('Brand#9', 'Brand#10')""", **STEPS))
def _(d):
    sets = (d.gene_sets.where(F.col("set_name").isin("Brand#9", "Brand#10"))
            .withColumn("set_name", F.when(F.col("set_name") == "Brand#9", "S").otherwise("G2M")))
    w = checkpointed(score.module_weights(d.lognorm, d.var, sets, normalize.cell_number(d.obs)))
    return six(score.cell_cycle_phase(score.every_cell(scores(d, w), d.obs, w)))


@query("score_recovery", sql(
    f"""SELECT cell_id, set_name, {r('area / (m * t - m * (m + 1) / 2.0)')} AS score FROM (
      SELECT cell_id, set_name, sum(t - rk)::DOUBLE AS area, any_value(t) AS t, least(any_value(sn), any_value(t)) AS m FROM (
        SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY x DESC, md5('0:' || gene_id), gene_id) AS rk,
          (SELECT ceil(count(*) * 0.05)::BIGINT FROM var) AS t FROM ln)
      JOIN (SELECT *, count(*) OVER (PARTITION BY set_name) AS sn FROM sets) USING (gene_id) WHERE rk <= t GROUP BY 1, 2)""",
    "ln", "var", "sets"))
def _(d):
    return six(score.recovery_scores(d.lognorm, d.gene_sets, d.var))


@query("score_rank_weighted", sql(
    f"""SELECT cell_id, set_name, {r('((wl + ms * (ms + 1) / 2.0) / (ws + ms) - (ng * (ng + 1) / 2.0 - ls - ms * (ms + 1) / 2.0) / (ng - sn)) / ng')}
      AS score FROM (SELECT cell_id, set_name, any_value(ng)::DOUBLE AS ng, any_value(sn)::DOUBLE AS sn,
        any_value(sn)::DOUBLE - count(*) AS ms, sum((ng - pos + 1) ** 0.25 * (ng - pos + 1)) AS wl,
        sum((ng - pos + 1) ** 0.25) AS ws, sum(ng - pos + 1)::DOUBLE AS ls FROM (
        SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY x DESC, gene_id) AS pos FROM ln),
        (SELECT count(*) AS ng FROM var) JOIN (SELECT *, count(*) OVER (PARTITION BY set_name) AS sn FROM sets) USING (gene_id)
      GROUP BY 1, 2)""".replace("FROM ln),\n        (SELECT count(*) AS ng FROM var) JOIN", "FROM ln) JOIN (SELECT count(*) AS ng FROM var) ON true JOIN"),
    "ln", "var", "sets"))
def _(d):
    return six(score.rank_weighted_scores(d.lognorm, d.gene_sets, d.var))


_PROFILE = f"""SELECT label, n_cells, {r('-sum(p * ln(p)) / ln(count(*))')} AS entropy,
      array_to_string(list(set_name ORDER BY round(ms, 9) DESC, set_name)[1:3], '|') AS top,
      -sum(p * ln(p)) / ln(count(*)) > 0.85 AS ambiguous FROM (
    SELECT *, greatest(e / sum(e) OVER (PARTITION BY label), 1e-12) AS p FROM (
      SELECT *, exp((ms - avg(ms) OVER (PARTITION BY label)) / stddev_samp(ms) OVER (PARTITION BY label)) AS e FROM gmeans))
    GROUP BY 1, 2"""


@query("annotate_lineage_profile", sql(_PROFILE, *USES, **STEPS, gmeans=GMEANS))
def _(d):
    return six(annotate.lineage_profile(means(d)))


_COMBINED = """SELECT label, set_name, n_cells, round(0.6::DOUBLE * coalesce(v::DOUBLE / max(v) OVER (PARTITION BY label), 0)
      + 0.4::DOUBLE * (ms - min(ms) OVER (PARTITION BY label)) / (max(ms) OVER (PARTITION BY label) - min(ms) OVER (PARTITION BY label)), 3) AS c
    FROM gmeans LEFT JOIN (SELECT label, set_name, count(*) AS v FROM (SELECT label, gene_id, row_number() OVER (PARTITION BY label
      ORDER BY round(q, 12), round(z, 9) DESC, gene_id) AS k FROM adj) JOIN sets USING (gene_id) WHERE k <= 50 GROUP BY 1, 2)
    USING (label, set_name)"""


@query("annotate_marker_report", sql(
    f"""SELECT label, n_cells, proposed_label, runner_up, {r('margin')} AS margin,
      {r('least(0.97, greatest(0.0, 0.35 + 1.6 * margin))')} AS confidence, count(*) OVER (PARTITION BY proposed_label) > 1 AS repeated
    FROM (SELECT label, n_cells, max(CASE WHEN k = 1 THEN set_name END) AS proposed_label,
      max(CASE WHEN k = 2 THEN set_name END) AS runner_up, max(CASE WHEN k = 1 THEN c END) - max(CASE WHEN k = 2 THEN c END) AS margin
      FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, set_name) AS k FROM combined) GROUP BY 1, 2)""",
    *USES, **STEPS, gmeans=GMEANS, **CHAIN, combined=_COMBINED))
def _(d):
    tested = markers.rank_sum_test(d.lognorm, d.obs, d.var)
    return six(annotate.propose_labels(tested, d.gene_sets, means(d)))


_MAP = {"AUTOMOBILE": "T cells", "BUILDING": "Unknown bucket", "FURNITURE": "Macrophages", "HOUSEHOLD": "T cells",
        "GARDEN": "Doublets"}


@query("annotate_apply_labels", sql(
    """SELECT cell_id, label, CASE label WHEN 'AUTOMOBILE' THEN 'T cells' WHEN 'BUILDING' THEN 'Unknown bucket'
      WHEN 'FURNITURE' THEN 'Macrophages' WHEN 'HOUSEHOLD' THEN 'T cells' END AS cell_type FROM obs""", "obs"))
def _(d):
    return annotate.apply_labels(d.obs, _MAP, "label").obs.select("cell_id", "label", "cell_type")


@query("annotate_unmapped_clusters", sql("SELECT DISTINCT label FROM obs WHERE label = 'MACHINERY'", "obs"))
def _(d):
    return annotate.apply_labels(d.obs, _MAP, "label").unmapped


@query("annotate_discard_share", sql(
    f"""SELECT CAST(sum((label = 'BUILDING')::INT) AS BIGINT) AS n_discarded, count(*) AS n_cells,
      {r("100.0 * sum((label = 'BUILDING')::INT) / count(*)")} AS pct, 100.0 * sum((label = 'BUILDING')::INT) / count(*) >= 15 AS warn
    FROM obs""", "obs"))
def _(d):
    labelled = annotate.apply_labels(d.obs, {**_MAP, "MACHINERY": "NK"}, "label").obs
    return six(annotate.discard_share(labelled, "cell_type"))


@query("annotate_match_labels", """SELECT DISTINCT p_brand AS label, CASE p_brand WHEN 'Brand#1' THEN 'Brand 1' ELSE
    (CASE WHEN p_brand LIKE 'Brand#1%' THEN 'Brand 1' WHEN p_brand LIKE 'Brand#2%' THEN 'Brand 2' END) END AS matched FROM part""")
def _(d):
    return annotate.match_label(d.var.select(F.col("brand").alias("label")).distinct(), ["Brand 1", "Brand 2"])


EXPR = """SELECT cell_id, set_name FROM (SELECT cell_id, set_name FROM counts JOIN sets USING (gene_id) GROUP BY 1, 2
    HAVING count(*) >= 2) JOIN scores USING (cell_id, set_name) WHERE score > 0"""
EXCESS = """SELECT label, a, b, rate, base, rate - base AS excess FROM (
    SELECT label, a, b, k / n AS rate, sum(k) OVER (PARTITION BY a, b) / (SELECT count(*) FROM obs) AS base FROM (
      SELECT label, a, b, count(*)::DOUBLE AS k FROM expr x JOIN pairs ON x.set_name = a
      JOIN expr y ON y.cell_id = x.cell_id AND y.set_name = b JOIN obs ON obs.cell_id = x.cell_id GROUP BY 1, 2, 3)
    JOIN (SELECT label, count(*) AS n FROM obs GROUP BY 1) USING (label)) WHERE rate - base > 0.02"""
FOREIGN = """SELECT label, s.set_name, avg((round(s.score, 9) > round(o.score, 9))::INT) AS fraction FROM scores s JOIN obs USING (cell_id)
    JOIN native n USING (label) JOIN scores o ON o.cell_id = s.cell_id AND o.set_name = n.set_name
    WHERE s.set_name <> n.set_name GROUP BY 1, 2 HAVING avg((round(s.score, 9) > round(o.score, 9))::INT) > 0.05"""
AMBIENT = """SELECT label, coalesce(corr(coalesce(s, 0) / n, sa / na), 0.0) AS ar FROM (
    SELECT gene_id FROM counts GROUP BY 1 ORDER BY sum(n) DESC, gene_id LIMIT 20) JOIN (SELECT label, count(*) AS n FROM obs GROUP BY 1) ON true
    JOIN (SELECT gene_id, sum(x) AS sa FROM ln GROUP BY 1) USING (gene_id) JOIN (SELECT count(*) AS na FROM obs) ON true
    LEFT JOIN (SELECT gene_id, label, sum(x) AS s FROM ln JOIN obs USING (cell_id) GROUP BY 1, 2) USING (gene_id, label) GROUP BY 1"""
COMP = """SELECT label, n_cells, doublet_fraction, dominant_sample, dominant_sample_frac FROM (
      SELECT label, count(*) AS n_cells, avg((score > 8000)::INT) AS doublet_fraction FROM obs GROUP BY 1)
    JOIN (SELECT label, first(sample ORDER BY n DESC, sample) AS dominant_sample, max(n)::DOUBLE / sum(n) AS dominant_sample_frac
      FROM (SELECT label, sample, count(*) AS n FROM obs GROUP BY 1, 2) GROUP BY 1) USING (label)"""
AUDIT_USES = (*USES, "pairs", "native", "counts")
AUDIT_STEPS = {**STEPS, "expr": EXPR, "excess": EXCESS, "foreign_p": FOREIGN, "ambient": AMBIENT, "comp": COMP}


def _expressed(d):
    return annotate.expresses(score.module_scores(d.lognorm, weights(d), True), qc.present_sets(d.gene_sets, d.var, 3))


@query("annotate_expressed_programs", sql("SELECT * FROM expr", *AUDIT_USES, **STEPS, expr=EXPR))
def _(d):
    return _expressed(d)


@query("annotate_codetection_excess", sql(
    f"SELECT label, a, b, {r('rate')} AS rate, {r('base')} AS base, {r('excess')} AS excess FROM excess",
    *AUDIT_USES, **STEPS, expr=EXPR, excess=EXCESS.replace("> 0.02", "> 0.0")))
def _(d):
    return six(annotate.codetection_excess(_expressed(d), d.obs, d.pairs, keep_above=0.0))


@query("annotate_foreign_programs", sql(
    f"SELECT label, set_name, {r('fraction')} AS fraction FROM foreign_p", *AUDIT_USES, **STEPS, foreign_p=FOREIGN))
def _(d):
    w = weights(d)
    return six(annotate.foreign_programs(score.every_cell(scores(d, w), d.obs, w), d.obs, d.native))


@query("annotate_ambient_correlation", sql(
    f"SELECT label, {r('ar')} AS ambient_r FROM ambient", *AUDIT_USES, ambient=AMBIENT))
def _(d):
    return six(annotate.ambient_correlation(d.lognorm, d.counts, d.obs))


def _called(d):
    return d.obs.withColumn("predicted_doublet", F.col("score") > 8000)


@query("annotate_label_composition", sql(
    f"SELECT label, n_cells, {r('doublet_fraction')} AS doublet_fraction, dominant_sample, {r('dominant_sample_frac')} AS dominant_sample_frac FROM comp",
    "obs", comp=COMP))
def _(d):
    return six(annotate.label_composition(_called(d)))


_AUDIT = """SELECT *, 0.5 * max_foreign + 0.35 * max_excess + 0.15 * least(doublet_fraction * 3, 1.0) AS contamination_score,
      CASE WHEN ar > 0.9 AND max_excess < 0.10 AND max_foreign < 0.25 THEN 'ambient'
        WHEN doublet_fraction > 0.25 AND max_foreign > 0.2 THEN 'doublet'
        WHEN max_foreign > 0.35 AND bimodality > 1.2 AND doublet_fraction < 0.25 THEN 'mixed_cluster'
        WHEN max_foreign > 0.10 AND max_foreign <= 0.35 AND bimodality <= 1.2 THEN 'true_biology' ELSE 'clean' END AS likely_cause
    FROM (SELECT comp.*, coalesce(ar, 0) AS ar, coalesce(max_excess, 0) AS max_excess, coalesce(max_foreign, 0) AS max_foreign,
        dominant, coalesce(bimodality, 0) AS bimodality FROM comp LEFT JOIN ambient USING (label)
      LEFT JOIN (SELECT label, max(round(excess, 3)) AS max_excess FROM excess GROUP BY 1) USING (label)
      LEFT JOIN dom USING (label)
      LEFT JOIN (SELECT label, (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / (stddev_pop(score) + 1e-9) AS bimodality
        FROM scores JOIN (SELECT cell_id, label FROM obs) USING (cell_id) JOIN dom USING (label) WHERE set_name = dominant GROUP BY 1) USING (label))"""
_DOM = """SELECT label, max(fraction) AS max_foreign, first(set_name ORDER BY round(fraction, 3) DESC, set_name) AS dominant
    FROM foreign_p GROUP BY 1"""
_AUDIT_COLS = ["doublet_fraction", "dominant_sample_frac", "max_excess", "max_foreign", "bimodality", "contamination_score"]


def _audit(d):
    w = weights(d)
    return annotate.contamination_audit(d.lognorm, d.counts, _called(d), d.var, d.gene_sets, w,
                                        stored(score.module_scores(d.lognorm, w, True), "detected"), d.pairs, d.native)


@query("annotate_contamination_audit", sql(
    "SELECT label, n_cells, dominant_sample, dominant, likely_cause, CASE likely_cause WHEN 'ambient' THEN 'estimate ambient signal' "
    "WHEN 'doublet' THEN 'test doublet enrichment by cluster' WHEN 'mixed_cluster' THEN 'subcluster and label anew' "
    "WHEN 'true_biology' THEN 'keep and note the shared program' ELSE 'none' END AS recommended_action, " + r("ar") + " AS ambient_r, "
    + ", ".join(f"{r(c)} AS {c}" for c in _AUDIT_COLS) + " FROM audit", *AUDIT_USES, **AUDIT_STEPS, dom=_DOM, audit=_AUDIT))
def _(d):
    return six(_audit(d))


@query("annotate_refinement_plan", sql(
    """SELECT label, likely_cause AS cause, action, CASE WHEN likely_cause = 'mixed_cluster' THEN 0.6 END::DOUBLE AS resolution
    FROM audit JOIN (VALUES ('ambient', 'estimate_ambient'), ('doublet', 'test_doublet_enrichment'),
      ('mixed_cluster', 'subcluster'), ('mixed_cluster', 'propose_labels')) t(likely_cause, action) USING (likely_cause)
    WHERE contamination_score > 0.1""", *AUDIT_USES, **AUDIT_STEPS, dom=_DOM, audit=_AUDIT))
def _(d):
    return six(annotate.refinement_plan(_audit(d), threshold=0.1, round_no=2))


@query("subset_extract_labels", sql(
    """SELECT cell_id, label, sample AS parent_leiden_res1, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total FROM obs
    LEFT JOIN counts USING (cell_id) WHERE label IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2, 3""", "obs", "counts"))
def _(d):
    obs = d.obs.select("cell_id", "label", F.col("sample").alias("leiden_res1"))
    part = subset.extract_labels(obs, d.counts, "label", ["BUILDING", "MACHINERY"])
    totals = part.counts.groupBy("cell_id").agg(F.sum("count").alias("total"))
    return part.obs.join(totals, "cell_id", "left").fillna(0, ["total"])


@query("subset_drop_clusters", sql("SELECT cell_id, sample FROM obs WHERE sample NOT IN ('NATION_1', 'NATION_2')", "obs"))
def _(d):
    return subset.drop_clusters(d.obs, "sample", ["NATION_1", "NATION_2"], "debris", True).obs.select("cell_id", "sample")


@query("subset_drop_decision", sql(
    """SELECT 'NATION_1,NATION_2' AS clusters, 'debris' AS reason, CAST(sum((sample IN ('NATION_1', 'NATION_2'))::INT) AS BIGINT)
      AS n_dropped, count(*) AS n_before, false AS warn FROM obs""", "obs"))
def _(d):
    return subset.drop_clusters(d.obs, "sample", ["NATION_1", "NATION_2"], "debris", True).decision


@query("subset_map_back", sql(
    """SELECT cell_id, CASE WHEN label = 'BUILDING' THEN 'sub_' || batch ELSE label END AS fine FROM obs""", "obs"))
def _(d):
    sub = d.obs.where("label = 'BUILDING'").select("cell_id", F.concat(F.lit("sub_"), "batch").alias("s"))
    return subset.map_back(d.obs, sub, "s", "fine", "label").obs.select("cell_id", "fine")


@query("subset_match_rate", sql(
    f"SELECT count(*) AS n_matched, count(*) AS n_sub, 1.0::DOUBLE AS rate FROM obs WHERE label = 'BUILDING'", "obs"))
def _(d):
    sub = d.obs.where("label = 'BUILDING'").select("cell_id", F.concat(F.lit("sub_"), "batch").alias("s"))
    return six(subset.map_back(d.obs, sub, "s", "fine", "label").match)


@query("subset_subcluster")
def _(d):
    out = subcluster(d.obs, d.counts, d.var, "label", ["BUILDING", "MACHINERY"], "batch", n_hvg=100, n_comps=5,
                     rounds=2, levels=2)
    return out.obs.select("cell_id", "label", F.col("leiden_res0_5").alias("cluster"))
