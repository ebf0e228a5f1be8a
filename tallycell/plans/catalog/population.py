"""Abundance, trajectory, communication, atlas, figure and provenance queries."""

from pyspark.sql import functions as F

from tallycell.operators import abundance, atlas, communication, diffusion, figures, graph, provenance, trajectory
from tallycell.plans.catalog.differential import _CW, cellwise
from tallycell.plans.catalog.graph import KNN
from tallycell.plans.registry import query, six
from tallycell.plans.standin import r, sql
from tallycell.session import checkpointed

PROPS = """SELECT sample, label, coalesce(n, 0) AS n, total, coalesce(n, 0)::DOUBLE / total AS proportion, total < 100 AS small_sample
    FROM (SELECT sample, count(*) AS total FROM obs GROUP BY 1) JOIN (SELECT DISTINCT label FROM obs) ON true
    LEFT JOIN (SELECT sample, label, count(*) AS n FROM obs GROUP BY 1, 2) USING (sample, label)"""
ATTR = "SELECT DISTINCT sample, condition, timepoint, condition IN ('AFRICA', 'ASIA') AS arm FROM obs"


def props(d):
    attr = d.obs.select("sample", "condition", "timepoint").distinct()
    return abundance.proportions(d.obs).join(attr, "sample").withColumn("arm", F.when(F.col("condition").isin("AFRICA", "ASIA"), "A").otherwise("B"))


@query("abundance_proportions", sql(f"SELECT sample, label, n, total, {r('proportion')} AS proportion, small_sample FROM p", "obs", p=PROPS))
def _(d):
    return six(abundance.proportions(d.obs))


def _welch_sql(src, by, value):
    return f"""SELECT {by}, n_a, n_b, {r('ma')} AS mean_a, {r('mb')} AS mean_b, {r('(ma - mb) / sqrt(u + w)')} AS t,
      {r('(u + w) ** 2 / (u * u / (n_a - 1) + w * w / (n_b - 1))')} AS dof FROM (SELECT {by}, count(*) FILTER (arm) AS n_a,
        count(*) FILTER (NOT arm) AS n_b, avg(x) FILTER (arm) AS ma, avg(x) FILTER (NOT arm) AS mb,
        var_samp(x) FILTER (arm) / count(*) FILTER (arm) AS u, var_samp(x) FILTER (NOT arm) / count(*) FILTER (NOT arm) AS w
      FROM (SELECT *, {value} AS x FROM {src}) GROUP BY ALL)"""


_CLIP = "least(1 - 1e-6, greatest(1e-6, proportion))"


@query("abundance_two_arm_test", sql(_welch_sql("p JOIN attr USING (sample)", "label", f"asin(sqrt({_CLIP}))"), "obs", p=PROPS, attr=ATTR))
def _(d):
    return six(abundance.two_arm_test(props(d), "arm", "A").drop("pval", "stars"))


@query("abundance_two_arm_by_time", sql(
    _welch_sql("p JOIN attr USING (sample)", "label, timepoint", f"ln({_CLIP} / (1 - {_CLIP}))"), "obs", p=PROPS, attr=ATTR))
def _(d):
    return six(abundance.two_arm_test(props(d), "arm", "A", strata=["timepoint"], how="logit").drop("pval", "stars"))


@query("abundance_rank_test", sql(
    f"""SELECT label, na AS n_a, nb AS n_b, {r('ra - na * (na + 1) / 2.0')} AS u,
      {r('greatest(abs(ra - na * (na + 1) / 2.0 - na * nb / 2.0) - 0.5, 0) / sqrt(na * nb / 12.0 * ((na + nb + 1) - tie / ((na + nb) * (na + nb - 1.0))))')} AS z
    FROM (SELECT label, count(*) FILTER (arm) AS na, count(*) FILTER (NOT arm) AS nb, sum(rk) FILTER (arm) AS ra, sum(t * t - 1)::DOUBLE AS tie
      FROM (SELECT *, count(*) OVER (PARTITION BY label, proportion) AS t, rank() OVER (PARTITION BY label ORDER BY proportion)
        + (count(*) OVER (PARTITION BY label, proportion) - 1) / 2.0::DOUBLE AS rk FROM p JOIN attr USING (sample)) GROUP BY 1)""",
    "obs", p=PROPS, attr=ATTR))
def _(d):
    return six(abundance.rank_test(props(d), "arm", "A").drop("pval"))


@query("abundance_group_bars", sql(
    f"SELECT condition, label, {r('avg(proportion)')} AS mean_proportion FROM p JOIN attr USING (sample) GROUP BY 1, 2", "obs", p=PROPS, attr=ATTR))
def _(d):
    return six(abundance.group_bars(props(d), "condition"))


@query("abundance_time_course", sql(
    f"""SELECT condition, timepoint, label, {r('avg(proportion)')} AS mean, {r('stddev_samp(proportion) / sqrt(count(*))')} AS sem
    FROM p JOIN attr USING (sample) GROUP BY 1, 2, 3""", "obs", p=PROPS, attr=ATTR))
def _(d):
    return six(abundance.time_course(props(d), "condition", "timepoint"))


@query("abundance_log_ratio_test", sql(
    _welch_sql("lr", "label", "v").replace("n_a, n_b,", "n_a, n_b, (SELECT label FROM ref) AS reference,", 1), "obs", p=PROPS, attr=ATTR,
    ref="SELECT label FROM p GROUP BY 1 ORDER BY round(stddev_samp(proportion) / avg(proportion), 12), label LIMIT 1",
    lr="""SELECT a.label, arm, ln((a.n + 0.5) / (b.n + 0.5)) AS v FROM p a JOIN (SELECT sample, n FROM p SEMI JOIN ref USING (label)) b USING (sample)
      JOIN attr USING (sample) WHERE a.label <> (SELECT label FROM ref)"""))
def _(d):
    return six(abundance.log_ratio_test(props(d), "arm", "A").drop("pval", "padj"))


_NH = {
    "knn": KNN,
    "g": "SELECT src, dst FROM knn UNION SELECT dst, src FROM knn UNION SELECT cell_id, cell_id FROM emb",
    "drawn": "SELECT cell_id AS src FROM emb ORDER BY md5('0:' || cell_id), cell_id LIMIT (SELECT greatest(1, floor(0.2 * count(*)))::BIGINT FROM emb)",
    "mem": "SELECT src, dst, v::DOUBLE[] AS v FROM g SEMI JOIN drawn USING (src) JOIN emb ON dst = cell_id",
    "cen": """SELECT src, list(x ORDER BY i) AS c FROM (SELECT src, i, avg(x) AS x FROM (SELECT src, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM mem)
        GROUP BY 1, 2) GROUP BY 1""",
    "idx": "SELECT DISTINCT m AS src FROM (SELECT src, first(dst ORDER BY round(list_distance(v, c) ** 2, 9), dst) AS m FROM mem JOIN cen USING (src) GROUP BY 1)",
    "nh": "SELECT src AS nhood, dst AS cell_id FROM g SEMI JOIN idx USING (src)"}


def nhoods(d):
    return checkpointed(abundance.neighbourhoods(graph.neighbour_graph(d.embedding, 15), d.embedding, 0.2))


@query("abundance_neighbourhood_counts", sql(
    "SELECT nhood, sample, count(*) AS n FROM nh JOIN emb USING (cell_id) GROUP BY 1, 2", "emb", **_NH))
def _(d):
    return abundance.neighbourhood_counts(nhoods(d), d.embedding)


@query("abundance_neighbourhood_labels", sql(
    f"""SELECT nhood, CAST(sum(n) AS BIGINT) AS size, {r('max(n) / sum(n)')} AS share, CASE WHEN max(n) / sum(n) < 0.7 THEN 'Mixed'
      ELSE first(label ORDER BY n DESC, label) END AS label FROM (SELECT nhood, label, count(*) AS n FROM nh JOIN emb USING (cell_id) GROUP BY 1, 2)
    GROUP BY 1""", "emb", **_NH))
def _(d):
    return six(abundance.neighbourhood_labels(nhoods(d), d.embedding))


def nhood_test(d, members):
    counts = abundance.neighbourhood_counts(members, d.embedding)
    return abundance.neighbourhood_test(checkpointed(counts), d.embedding.select("sample", "condition").distinct(), "condition", "A")


@query("abundance_neighbourhood_test")
def _(d):
    return six(nhood_test(d, nhoods(d)))


@query("abundance_neighbourhood_summary")
def _(d):
    members = nhoods(d)  # the neighbour join, which is most of the work, is made once
    return six(abundance.neighbourhood_summary(checkpointed(nhood_test(d, members)), abundance.neighbourhood_labels(members, d.embedding)))


@query("abundance_spatial_fdr", sql(
    f"""SELECT cell_id, {r('least(1.0, min(pval * (SELECT sum(w) FROM t) / cw) OVER (ORDER BY pval DESC ROWS UNBOUNDED PRECEDING))')} AS spatial_fdr
    FROM (SELECT *, sum(w) OVER (ORDER BY pval) AS cw FROM t)""", "emb", knn=KNN,
    t="""SELECT src AS cell_id, 1 / dist AS w, (src % 97 + 1) / 100.0::DOUBLE AS pval FROM knn WHERE rank = 15"""))
def _(d):
    t = graph.neighbour_graph(d.embedding, 15).where("rank = 15").select(F.col("src").alias("cell_id"), "dist", ((F.col("src") % 97 + 1) / 100.0).alias("pval"))
    return six(abundance.spatial_fdr(checkpointed(t), "dist").select("cell_id", "spatial_fdr"))


# Trajectories on the embedding: pseudotime stands in as the first coordinate.
@query("trajectory_root", sql(
    f"""SELECT node, {r('purity')} AS purity, degree = 1 AS is_leaf, {r('purity + 0.25 * early')} AS merit FROM (
      SELECT sample AS node, avg((label = 'c3')::INT) AS purity, avg((timepoint = 'D1')::INT) AS early FROM emb GROUP BY 1)
    LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT 's' || i AS node FROM range(7) t(i) UNION ALL SELECT 's' || (i + 1) FROM range(7) t(i)) GROUP BY 1)
      USING (node) ORDER BY purity >= 0.1 DESC, degree = 1 DESC, round(purity + 0.25 * early, 9) DESC, node LIMIT 1""", "emb"))
def _(d):
    cells = d.embedding.select("cell_id", F.col("sample").alias("node"), "label", F.col("timepoint").alias("time"))
    tree = d.spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(7)], "a string, b string")
    return six(trajectory.choose_root(cells, tree, "c3", min_share=0.1))


@query("trajectory_time_correlation", sql(
    f"""SELECT {r('corr(rp, rt)')} AS rho, count(*) AS n, abs(corr(rp, rt)) < 0.15 AND count(*) > 50 AS warn FROM (SELECT
      rank() OVER (ORDER BY v[1]) + (count(*) OVER (PARTITION BY v[1]) - 1) / 2.0::DOUBLE AS rp,
      rank() OVER (ORDER BY timepoint) + (count(*) OVER (PARTITION BY timepoint) - 1) / 2.0::DOUBLE AS rt FROM emb)""", "emb"))
def _(d):
    return six(trajectory.time_correlation(d.embedding.withColumn("pt", F.get("v", 0)), "pt", "timepoint"))


@query("trajectory_cluster_connectivity", sql(
    f"""SELECT a, b, {r('least(1.0, n / ((ea * sb + eb * sa) / ((SELECT count(*) FROM emb) - 1)))')} AS connectivity FROM (
      SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, count(*) AS n FROM knn JOIN emb x ON src = x.cell_id
      JOIN emb y ON dst = y.cell_id WHERE x.label <> y.label GROUP BY 1, 2)
    JOIN (SELECT label AS a, count(*) AS sa, count(*) * 15.0 AS ea FROM emb GROUP BY 1) USING (a)
    JOIN (SELECT label AS b, count(*) AS sb, count(*) * 15.0 AS eb FROM emb GROUP BY 1) USING (b)""", "emb", knn=KNN))
def _(d):
    return six(trajectory.cluster_connectivity(graph.neighbour_graph(d.embedding, 15), d.embedding.select("cell_id", "label")))


_STEP = """SELECT src, dst, substr(s.timepoint, 2)::INT AS ts, substr(e.timepoint, 2)::INT AS td, 1 / (1 + dist) AS w FROM knn
    JOIN emb s ON src = s.cell_id JOIN emb e ON dst = e.cell_id"""


def _back(t, later):
    return f"""SELECT src AS cell_id, fate, m / sum(m) OVER (PARTITION BY src) AS p FROM (SELECT src, fate, sum(w * p) AS m FROM step
      JOIN {later} f ON dst = f.cell_id WHERE ts = {t} AND td = {t + 1} GROUP BY 1, 2)"""


@query("trajectory_fates", sql(
    f"SELECT cell_id, fate, {r('p')} AS p FROM fa UNION ALL SELECT cell_id, NULL, NULL FROM emb ANTI JOIN fa USING (cell_id)",
    "emb", knn=KNN, step=_STEP, f4="SELECT cell_id, label AS fate, 1.0::DOUBLE AS p FROM emb WHERE timepoint = 'D4'",
    f3=_back(3, "f4"), f2=_back(2, "f3"), f1=_back(1, "f2"),
    fa="SELECT * FROM f4 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f1"))
def _(d):
    e = graph.neighbour_graph(d.embedding, 15).withColumn("weight", 1 / (1 + F.col("dist")))
    return six(trajectory.fate_probabilities(checkpointed(e), d.embedding))


@query("trajectory_diffusion_components", sql(
    "SELECT CAST(i AS INT) AS component, true AS in_range, true AS settled, i = 0 AS stationary FROM range(15) t(i)"))
def _(d):
    t = diffusion.residual_table(diffusion.components(graph.connectivities(graph.neighbour_graph(d.embedding, 15))))
    return t.select("component", F.abs("eigenvalue").between(0.0, 1.0 + 1e-9).alias("in_range"), (F.col("residual") <= 1e-4).alias("settled"),
                    (F.col("eigenvalue") >= diffusion.STATIONARY).alias("stationary"))


@query("trajectory_diffusion_pseudotime")
def _(d):
    return six(diffusion.diffusion_pseudotime(graph.connectivities(graph.neighbour_graph(d.embedding, 15)), d.embedding, "c3"))


_SP = """SELECT gene_id, corr(rx, rp) AS rho FROM (SELECT gene_id, rp, rank() OVER (PARTITION BY gene_id ORDER BY coalesce(x, 0))
      + (count(*) OVER (PARTITION BY gene_id, coalesce(x, 0)) - 1) / 2.0::DOUBLE AS rx FROM (SELECT * FROM ch, pt)
    LEFT JOIN ln USING (gene_id, cell_id)) GROUP BY 1"""


@query("trajectory_genes", sql(
    f"SELECT gene_id, {r('rho')} AS rho FROM ({_SP}) WHERE abs(rho) >= 0.01", "ln", "obs",
    pt="SELECT cell_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rp FROM obs",
    ch="""SELECT gene_id FROM (SELECT gene_id, sum(x) AS s, sum(x * x) AS ss, (SELECT count(*) FROM obs)::DOUBLE AS n FROM ln GROUP BY 1
      HAVING count(*) / (SELECT count(*) FROM obs)::DOUBLE > 0.02)"""))
def _(d):
    return six(trajectory.pseudotime_genes(d.lognorm, d.obs, "score", min_share=0.02, min_rho=0.01))


@query("trajectory_binned_expression", sql(
    f"""SELECT gene_id, bin, {r('m')} AS mean, {r('(m - avg(m) OVER (PARTITION BY gene_id)) / (stddev_pop(m) OVER (PARTITION BY gene_id) + 1e-9)', 5)} AS z FROM (
      SELECT gene_id, bin, sum(coalesce(x, 0)) / count(*) AS m FROM (SELECT * FROM tg, b) LEFT JOIN ln USING (gene_id, cell_id) GROUP BY 1, 2)""", "ln", "obs",
    tg="SELECT DISTINCT gene_id FROM counts",
    b="""SELECT cell_id, CAST(len(list_filter((SELECT quantile_cont(score, [0.25, 0.5, 0.75]) FROM obs), lambda c: c <= score)) AS INT) AS bin FROM obs"""))
def _(d):
    out = trajectory.binned_expression(d.lognorm, d.obs, "score", checkpointed(d.counts.select("gene_id").distinct()), 4)
    return six(out.withColumn("z", F.round("z", 5)))


# Ligand-receptor pairs: gene i with genes i+1 (and i+2 for every third pair, as a complex).
_PAIRS = """SELECT gene_id AS pair_id, 'ligand' AS side, gene_id FROM var
    UNION ALL SELECT gene_id, 'receptor', gene_id + 1 FROM var
    UNION ALL SELECT gene_id, 'receptor', gene_id + 2 FROM var WHERE gene_id % 3 = 0"""
_LRS = """SELECT context, l.label AS source, r.label AS target, pair_id, (l.m + r.m) / 2 AS lr_means, l.m * r.m AS expr_prod FROM
      (SELECT * FROM sided WHERE side = 'ligand') l JOIN (SELECT * FROM sided WHERE side = 'receptor') r USING (context, pair_id)"""
_LR_STEPS = {
    "pr": _PAIRS, "cells": "SELECT *, CASE WHEN condition IN ('AFRICA', 'ASIA') THEN 'A' ELSE 'B' END AS context FROM obs",
    "floor": "SELECT context, label, count(*) AS nc FROM cells GROUP BY 1, 2 HAVING count(*) >= 100",
    "gl": """SELECT context, label, gene_id, sum(x) / nc AS mean, count(*)::DOUBLE / nc AS frac FROM ln SEMI JOIN pr USING (gene_id)
        JOIN cells USING (cell_id) JOIN floor USING (context, label) GROUP BY 1, 2, 3, nc""",
    "sided": """SELECT context, label, pair_id, side, min(mean) AS m FROM pr JOIN gl USING (gene_id) JOIN (SELECT pair_id, side, count(*) AS u FROM pr
        GROUP BY 1, 2) USING (pair_id, side) GROUP BY 1, 2, 3, 4, u HAVING count(*) = u AND min(frac) >= 0.02""",
    "lrs": _LRS}


def lr(d):
    obs = d.obs.withColumn("context", F.when(F.col("condition").isin("AFRICA", "ASIA"), "A").otherwise("B"))
    base = d.var.select(F.col("gene_id").alias("pair_id"))
    pairs = base.select("pair_id", F.lit("ligand").alias("side"), F.col("pair_id").alias("gene_id")).union(
        base.select("pair_id", F.lit("receptor"), F.col("pair_id") + 1)).union(
        base.where("pair_id % 3 = 0").select("pair_id", F.lit("receptor"), F.col("pair_id") + 2))
    kept, _ = communication.population_floor(obs, "label", ["context"], 100)
    stats = communication.gene_by_label(d.lognorm, obs, pairs.select("gene_id").distinct(), kept, "label", ["context"])
    return checkpointed(communication.pair_scores(stats, pairs, ["context"], 0.02))


@query("communication_population_floor", sql("SELECT context, label, nc AS n_cells FROM floor", "obs", cells=_LR_STEPS["cells"], floor=_LR_STEPS["floor"]))
def _(d):
    obs = d.obs.withColumn("context", F.when(F.col("condition").isin("AFRICA", "ASIA"), "A").otherwise("B"))
    return communication.population_floor(obs, "label", ["context"], 100)[0].select("context", "label", "n_cells")


@query("communication_pair_scores", sql(
    f"SELECT context, source, target, pair_id, {r('lr_means')} AS lr_means, {r('expr_prod')} AS expr_prod, "
    f"{r('expr_prod / sum(expr_prod) OVER (PARTITION BY context, pair_id)')} AS specific_weight FROM lrs", "ln", "obs", "var", **_LR_STEPS))
def _(d):
    return six(lr(d))


@query("communication_consensus", sql(
    f"""SELECT context, source, target, pair_id, {r('(rank() OVER (PARTITION BY context ORDER BY round(lr_means, 9) DESC) / count(*) OVER (PARTITION BY context) + rank() OVER (PARTITION BY context ORDER BY round(expr_prod, 9) DESC) / count(*) OVER (PARTITION BY context)) / 2.0')}
      AS consensus FROM lrs""", "ln", "obs", "var", **_LR_STEPS))
def _(d):
    return six(communication.consensus_rank(lr(d), ["lr_means", "expr_prod"], ["context"]).select("context", "source", "target", "pair_id", "consensus"))


@query("communication_differential", sql(
    f"""SELECT source, target, pair_id, {r('delta')} AS delta, direction, rank FROM (SELECT *, row_number() OVER (PARTITION BY direction
      ORDER BY round(abs(delta), 9) DESC, source, target, pair_id) AS rank FROM (SELECT source, target, pair_id, a.lr_means - b.lr_means AS delta,
      CASE WHEN a.lr_means > b.lr_means THEN 'up' ELSE 'down' END AS direction FROM (SELECT * FROM lrs WHERE context = 'A') a
      JOIN (SELECT * FROM lrs WHERE context = 'B') b USING (source, target, pair_id) WHERE a.lr_means <> b.lr_means)) WHERE rank <= 20""",
    "ln", "obs", "var", **_LR_STEPS))
def _(d):
    s = lr(d)
    out = communication.differential(s.where("context = 'A'"), s.where("context = 'B'"))
    return six(out.select("source", "target", "pair_id", "delta", "direction", "rank"))


@query("communication_dot_data", sql(
    f"""SELECT source, target, pair_id, {r('lr_means')} AS lr_means FROM lrs WHERE context = 'A' AND source = 'BUILDING'
    ORDER BY round(lr_means, 9) DESC, source, target, pair_id LIMIT 30""", "ln", "obs", "var", **_LR_STEPS))
def _(d):
    out = communication.dot_data(lr(d).where("context = 'A'"), sources=["BUILDING"])
    return six(out.select("source", "target", "pair_id", "lr_means"))


@query("atlas_inventory", sql(
    "SELECT label, condition, count(*) AS n_cells, count(DISTINCT sample) AS n_datasets FROM obs GROUP BY 1, 2", "obs"))
def _(d):
    return atlas.inventory(d.obs, ["label", "condition"], "sample")


_TOP = "SELECT DISTINCT gene_id FROM counts"
_GE = """SELECT gene_id, label, nc AS n_cells, coalesce(s, 0) / nc AS mean, coalesce(k, 0)::DOUBLE / nc AS fraction FROM tg
    JOIN (SELECT label, count(*) AS nc FROM obs GROUP BY 1) ON true
    LEFT JOIN (SELECT gene_id, label, sum(x) AS s, count(*) AS k FROM ln JOIN obs USING (cell_id) GROUP BY 1, 2) USING (gene_id, label)"""


def expression(d):
    return checkpointed(atlas.group_expression(d.lognorm, d.obs, checkpointed(d.counts.select("gene_id").distinct())))


@query("atlas_group_expression", sql(
    f"SELECT gene_id, label, n_cells, {r('mean')} AS mean, {r('fraction')} AS fraction FROM ge", "ln", "obs", tg=_TOP, ge=_GE))
def _(d):
    return six(expression(d))


@query("atlas_downsample", sql("SELECT cell_id, label FROM obs ORDER BY md5('0:' || cell_id), cell_id LIMIT 300", "obs"))
def _(d):
    return atlas.downsample(d.obs, 300).select("cell_id", "label")


_ORTH = "SELECT p_name AS source, p_brand AS target, p_partkey AS ord FROM part WHERE p_name NOT LIKE '%rod'"


def _orth(d):
    p = d.table("part")
    table = p.where("p_name NOT LIKE '%rod'").select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_partkey").alias("ord"))
    return atlas.map_orthologs(p.select(F.col("p_name").alias("gene")), table)


@query("atlas_orthologs_mapped", f"SELECT source, first(target ORDER BY ord) AS target FROM ({_ORTH}) GROUP BY 1")
def _(d):
    return _orth(d).mapped


@query("atlas_orthologs_ambiguous", f"SELECT source, count(DISTINCT target) AS n_targets FROM ({_ORTH}) GROUP BY 1 HAVING count(DISTINCT target) > 1")
def _(d):
    return _orth(d).ambiguous


@query("atlas_orthologs_unmapped", "SELECT DISTINCT p_name AS source FROM part WHERE p_name LIKE '%rod'")
def _(d):
    return _orth(d).unmapped


_VOTE = """SELECT src AS cell_id, first(label ORDER BY n DESC, label) AS predicted, max(n)::DOUBLE / sum(n) AS confidence FROM (
    SELECT src, label, count(*) AS n FROM knn JOIN emb ON dst = cell_id GROUP BY 1, 2) GROUP BY 1"""


@query("atlas_label_transfer", sql(f"SELECT cell_id, predicted, {r('confidence')} AS confidence, confidence < 0.6 AS low_confidence FROM ({_VOTE})", "emb", knn=KNN))
def _(d):
    return six(atlas.vote_labels(graph.neighbour_graph(d.embedding, 15), d.embedding))


@query("atlas_confusion", sql(f"SELECT label, predicted, count(*) AS n FROM ({_VOTE}) JOIN emb USING (cell_id) GROUP BY 1, 2", "emb", knn=KNN))
def _(d):
    return atlas.confusion(atlas.vote_labels(graph.neighbour_graph(d.embedding, 15), d.embedding), d.embedding)


@query("atlas_cluster_vote", sql(
    f"""SELECT cell_id, majority FROM emb JOIN (SELECT sample, first(predicted ORDER BY n DESC, predicted) AS majority FROM (
      SELECT sample, predicted, count(*) AS n FROM ({_VOTE}) JOIN emb USING (cell_id) GROUP BY 1, 2) GROUP BY 1) USING (sample)""", "emb", knn=KNN))
def _(d):
    p = atlas.vote_labels(graph.neighbour_graph(d.embedding, 15), d.embedding)
    return atlas.cluster_vote(p, d.embedding.select("cell_id", F.col("sample").alias("cluster")))


@query("atlas_domain_shift", sql(
    """SELECT DISTINCT 'label' AS "column", label AS value FROM obs WHERE label = 'FURNITURE' OR label = 'BUILDING'
    UNION ALL SELECT DISTINCT 'condition', condition FROM obs WHERE condition LIKE '%ASIA%'""", "obs"))
def _(d):
    return atlas.domain_shift(d.obs, ["label", "condition", "batch"], ["furni", "build", "asia"])


@query("atlas_marker_lookup", "SELECT p_brand AS set_name, p_partkey AS gene_id FROM part WHERE p_brand = 'Brand#1'")
def _(d):
    return atlas.marker_lookup(d.gene_sets, "brand 1")


@query("figure_dot_data", sql(
    f"""SELECT gene_id, label, {r('coalesce((mean - lo) / nullif(hi - lo, 0), 0)')} AS scaled FROM (SELECT *, min(mean) OVER (PARTITION BY gene_id) AS lo,
      max(mean) OVER (PARTITION BY gene_id) AS hi FROM ge)""", "ln", "obs", tg=_TOP, ge=_GE))
def _(d):
    return six(figures.dot_data(expression(d)).select("gene_id", "label", "scaled"))


@query("figure_gene_order", sql(
    """SELECT gene_id, block, row_number() OVER (PARTITION BY block ORDER BY round(peak, 9) DESC, gene_id) AS place FROM (
      SELECT gene_id, first(label ORDER BY round(fraction, 9) DESC, label) AS block, max(fraction) AS peak FROM ge GROUP BY 1)""", "ln", "obs", tg=_TOP, ge=_GE))
def _(d):
    return figures.gene_order(expression(d))


@query("figure_heatmap", sql(
    f"""SELECT gene_id, label, {r('(mean - avg(mean) OVER (PARTITION BY gene_id)) / coalesce(nullif(stddev_samp(mean) OVER (PARTITION BY gene_id), 0), 1)')} AS z FROM ge""",
    "ln", "obs", tg=_TOP, ge=_GE))
def _(d):
    return six(figures.heatmap(expression(d)).select("gene_id", "label", "z"))


@query("figure_volcano", sql(
    f"""SELECT label, gene_id, {r('-log10(greatest(p, 1e-300))')} AS log_padj, CASE WHEN p < 0.05 AND lfc > 0.5 THEN 'up' WHEN p < 0.05 AND lfc < -0.5
      THEN 'down' ELSE 'none' END AS class FROM test""", "ln", "obs", "var", **_CW))
def _(d):
    return six(figures.volcano(cellwise(d).withColumn("padj", F.col("pval"))).select("label", "gene_id", "log_padj", "class"))


@query("figure_volcano_labels", sql(
    """SELECT DISTINCT label, gene_id FROM (SELECT label, gene_id, row_number() OVER (PARTITION BY label ORDER BY round(p, 12), round(abs(lfc), 9) DESC, gene_id) AS i,
      row_number() OVER (PARTITION BY label ORDER BY round(abs(lfc), 9) DESC, gene_id) AS j FROM test) WHERE i <= 5 OR j <= 5 OR gene_id = 7""", "ln", "obs", "var", **_CW))
def _(d):
    return figures.volcano_labels(cellwise(d).withColumn("padj", F.col("pval")), forced=[7])


@query("figure_state_space", sql(
    f"""SELECT label, count(*) AS n_cells, {r('avg(x)')} AS cx, {r('avg(y)')} AS cy, {r('var_samp(x)')} AS vxx, {r('var_samp(y)')} AS vyy, {r('covar_samp(x, y)')} AS vxy,
      {r('sqrt(greatest(0, (var_samp(x) + var_samp(y)) / 2 + sqrt(((var_samp(x) - var_samp(y)) / 2) ** 2 + covar_samp(x, y) ** 2)))')} AS major,
      {r('sqrt(greatest(0, (var_samp(x) + var_samp(y)) / 2 - sqrt(((var_samp(x) - var_samp(y)) / 2) ** 2 + covar_samp(x, y) ** 2)))')} AS minor,
      {r('degrees(atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2)', 4)} AS angle
    FROM (SELECT label, v[1]::DOUBLE AS x, v[2]::DOUBLE AS y FROM emb) GROUP BY 1""", "emb"))
def _(d):
    s = figures.state_space(d.embedding.select("label", F.get("v", 0).alias("x"), F.get("v", 1).alias("y")), "x", "y")
    return six(s.withColumn("angle", F.round("angle", 4)))


@query("figure_colour_limits", sql(
    f"SELECT label AS set_name, {r('quantile_cont(abs(v[1]::DOUBLE), 0.99)')} AS colour_limit FROM emb GROUP BY 1", "emb"))
def _(d):
    return six(figures.colour_limits(d.embedding.select(F.col("label").alias("set_name"), F.get("v", 0).alias("score"))))


@query("figure_facet_counts", sql(
    """SELECT condition, timepoint, count(*) AS n, CAST(sum((label = 'BUILDING')::INT) AS BIGINT) AS n_highlight FROM obs GROUP BY 1, 2""", "obs"))
def _(d):
    return figures.facet_counts(d.obs, ["condition", "timepoint"], "label", "BUILDING")


# Provenance on the event log: an event is a step, its parent the event with half its number.
def _steps(d):
    e = d.table("events")
    return e.select(F.col("event_id").alias("step_id"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"),
                    F.concat(F.lit("code "), (F.col("user_id") % 4).cast("string")).alias("error"), F.col("ts").alias("started_at"),
                    (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 60))).alias("ended_at"), (F.col("user_id") % 10).alias("project_id"))


def _datasets(d):
    return d.table("events").select(
        F.col("event_id").alias("dataset_id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2)).alias("parent_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("label"), F.col("event_type").alias("op"), F.col("props").alias("params_json"),
        F.col("ts").alias("created_at"), (F.col("user_id") % 10).alias("project_id"))


@query("provenance_lineage", sql(
    """SELECT id::VARCHAR AS dataset_id, relation, depth FROM up UNION SELECT id::VARCHAR, relation, depth FROM down""",
    up="""SELECT 37 AS id, 'self' AS relation, 0 AS depth UNION ALL SELECT id // 2, 'ancestor', depth + 1 FROM up WHERE id > 0""",
    down="""SELECT 37 AS id, 'self' AS relation, 0 AS depth UNION ALL SELECT event_id, 'descendant', depth + 1 FROM down
      JOIN (SELECT event_id FROM events WHERE event_id > 0) ON event_id // 2 = down.id"""))
def _(d):
    return provenance.lineage(_datasets(d), 37)


@query("provenance_resolve", "SELECT event_id AS dataset_id, 'u' || user_id AS label FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(d):
    return provenance.resolve(_datasets(d), "u7").select("dataset_id", "label")


@query("provenance_find_datasets", "SELECT event_id AS dataset_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '42'")
def _(d):
    return provenance.find_datasets(_datasets(d), "click", {"k": "42"}).select("dataset_id")


@query("provenance_current_annotations", "SELECT event_id AS annotation_id FROM events WHERE event_id * 3 NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id > 0)")
def _(d):
    a = d.table("events").select(F.col("event_id").alias("annotation_id"),
                                 F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") > 0), F.floor(F.col("event_id") / 3)).alias("supersedes"))
    return provenance.current_annotations(a).select("annotation_id")


@query("provenance_scoped_parameter", """SELECT event_id AS param_id, value FROM events WHERE event_type IN ('view', 'purchase') AND user_id = 11
    ORDER BY event_type = 'view' DESC, ts DESC, event_id DESC LIMIT 1""")
def _(d):
    p = d.table("events").select(F.col("event_id").alias("param_id"), F.col("user_id").cast("string").alias("name"), F.col("ts").alias("created_at"), "value",
                                 F.when(F.col("event_type") == "purchase", "global").otherwise(F.col("event_type")).alias("scope"))
    return provenance.scoped_parameter(p, "11", "view").select("param_id", "value")


@query("provenance_keyword_search", """SELECT kind, id, score FROM (SELECT kind, id, round((contains(h, 'sample')::INT + contains(h, 'the')::INT * 0
    + contains(h, 'data')::INT + contains(h, 'time')::INT) / 3.0::DOUBLE, 3) AS score FROM (SELECT 'document' AS kind, doc_id AS id, lower(source || ' ' || text) AS h FROM documents
    UNION ALL SELECT 'conversation', conv_id * 1000 + turn, lower(role || ' ' || text) FROM conversations)) WHERE score > 0 ORDER BY score DESC, kind, id LIMIT 50""")
def _(d):
    rows = d.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("body")).union(
        d.table("conversations").select(F.lit("conversation"), F.col("conv_id") * 1000 + F.col("turn"), "role", "text"))
    return six(provenance.keyword_search(rows, "what is the sample data and time", 50).select("kind", "id", "score"))


@query("provenance_repeated_failures", """SELECT 'error' AS tool, 'code ' || (user_id % 4) AS error, count(*) AS n, max(event_id) AS last_step FROM events
    WHERE event_type = 'error' GROUP BY 2 ORDER BY min(event_id) DESC LIMIT 6""")
def _(d):
    return provenance.repeated_failures(_steps(d))


_STAGES = [("load", "^click"), ("filter", "^apply"), ("cluster", "^leiden"), ("view", "^view"), ("label", "^label"), ("test", "^test")]


@query("provenance_missing_stages", """SELECT ord, stage FROM (VALUES (1, 'load', 'click'), (2, 'filter', 'apply'), (3, 'cluster', 'leiden'), (4, 'view', 'view'),
    (5, 'label', 'label'), (6, 'test', 'test')) t(ord, stage, tool) WHERE tool NOT IN (SELECT event_type FROM events WHERE event_type <> 'error') ORDER BY ord LIMIT 3""")
def _(d):
    return provenance.missing_stages(_steps(d), _STAGES)


@query("provenance_timeline", "SELECT event_id AS step_id, event_type AS tool, event_type <> 'error' AS ok, (event_id % 60)::DOUBLE AS seconds FROM events ORDER BY event_id DESC LIMIT 50")
def _(d):
    return six(provenance.timeline(_steps(d)))


@query("provenance_project_summary", "SELECT user_id % 10 AS project_id, count(*) AS n_steps, count(*) AS n_datasets FROM events GROUP BY 1")
def _(d):
    return provenance.project_summary(_steps(d), _datasets(d))
