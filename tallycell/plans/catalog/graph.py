"""Neighbour graph, clustering and marker queries."""

from pyspark.sql import functions as F

from tallycell.operators import graph, integrate, markers, neighbours, normalize
from tallycell.plans.registry import query, six
from tallycell.plans.standin import r, sql

KNN = """SELECT src, dst, dist, rank FROM (SELECT a.cell_id AS src, b.cell_id AS dst,
      list_distance(a.v::DOUBLE[], b.v::DOUBLE[]) AS dist,
      row_number() OVER (PARTITION BY a.cell_id ORDER BY round(list_distance(a.v::DOUBLE[], b.v::DOUBLE[]), 9), b.cell_id) AS rank
    FROM emb a, emb b WHERE a.cell_id <> b.cell_id) WHERE rank <= 15"""
_COS = KNN.replace("list_distance(a.v::DOUBLE[], b.v::DOUBLE[])", "(1 - list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]))")
_BB = KNN.replace("PARTITION BY a.cell_id", "PARTITION BY a.cell_id, b.batch").replace(
    "b.cell_id AS dst,", "b.cell_id AS dst, b.batch,").replace("SELECT src, dst, dist, rank", "SELECT src, dst, dist, rank, batch").replace("rank <= 15", "rank <= 3")


@query("graph_knn", sql(f"SELECT src, dst, {r('dist')} AS dist, CAST(rank AS INT) AS rank FROM ({KNN})", "emb"))
def _(d):
    return six(graph.neighbour_graph(d.embedding, 15))


@query("graph_knn_cosine", sql(f"SELECT src, dst, {r('dist')} AS dist FROM ({_COS})", "emb"))
def _(d):
    return six(graph.neighbour_graph(d.embedding, 15, metric="cosine").select("src", "dst", "dist"))


@query("graph_knn_batch_balanced", sql(
    f"SELECT src, dst, batch, {r('dist')} AS dist, CAST(rank AS INT) AS rank FROM ({_BB})", "emb"))
def _(d):
    return six(graph.balanced_neighbours(d.embedding, "batch", 3))


@query("graph_knn_recall", sql("SELECT count(*) * 15 AS n_edges, true AS recall_at_least_0_9 FROM emb", "emb"))
def _(d):
    found = graph.neighbour_graph(d.embedding, 15, lists=16, probes=12)
    return neighbours.recall(found, graph.neighbour_graph(d.embedding, 15)).select("n_edges", (F.col("recall") >= 0.9).alias("recall_at_least_0_9"))


def edges(d):
    return graph.connectivities(graph.neighbour_graph(d.embedding, 15))


@query("graph_connectivities")
def _(d):
    return six(edges(d))


@query("graph_communities")
def _(d):
    return graph.communities(edges(d), 1.0, rounds=4, levels=2)


@query("graph_resolution_sweep")
def _(d):
    return six(graph.resolution_sweep(d.embedding, edges(d)))


_LISI = """SELECT src AS cell_id, sum(n) * sum(n) / sum(n * n) AS lisi FROM (SELECT src, emb.{} AS level,
    count(*)::DOUBLE AS n FROM knn JOIN emb ON dst = cell_id GROUP BY 1, 2) GROUP BY 1"""


@query("integrate_lisi", sql(f"SELECT cell_id, {r('lisi')} AS lisi FROM ({_LISI.format('batch')})", "emb", knn=KNN))
def _(d):
    return six(integrate.inverse_simpson(graph.neighbour_graph(d.embedding, 15), d.embedding, "batch"))


@query("integrate_mixing_report", sql(
    f"""SELECT {r('a')} AS batch_before, {r('b')} AS batch_after, {r('c')} AS label_before, {r('e')} AS label_after,
      {r('b - a')} AS batch_gain, {r('e - c')} AS label_cost FROM
      (SELECT avg(lisi) a FROM ({_LISI.format('batch')})),
      (SELECT avg(lisi) b FROM ({_LISI.format('batch').replace('knn', 'knb')})),
      (SELECT avg(lisi) c FROM ({_LISI.format('label')})),
      (SELECT avg(lisi) e FROM ({_LISI.format('label').replace('knn', 'knb')}))""", "emb", knn=KNN, knb=_BB))
def _(d):
    before = graph.neighbour_graph(d.embedding, 15).persist()
    after = graph.balanced_neighbours(d.embedding, "batch", 3).persist()
    return six(integrate.mixing_report(before, after, d.embedding, "batch", "label"))


@query("graph_adjusted_rand", sql(
    f"""SELECT {r('(b - x * y / e) / ((x + y) / 2 - x * y / e)')} AS ari FROM
    (SELECT sum(n * (n - 1) / 2) AS b, sum(n) * (sum(n) - 1) / 2 AS e FROM t),
    (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM t GROUP BY label)),
    (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM t GROUP BY coarse))""", "emb",
    t="SELECT label, CAST(substr(label, 2) AS INT) // 2 AS coarse, count(*)::DOUBLE AS n FROM emb GROUP BY 1, 2"))
def _(d):
    e = d.embedding.withColumn("coarse", F.floor(F.substring("label", 2, 2).cast("int") / 2))
    return six(graph.adjusted_rand(e, "label", "coarse"))


# Dense ranks over every cell, zeros included: a brute-force twin of the sparse ranks.
SIZES = "SELECT label, count(*) AS ng, sum(count(*)) OVER () AS na FROM obs GROUP BY 1"
DENSE = """SELECT gene_id, cell_id, label, coalesce(x, 0.0) AS x FROM (SELECT * FROM var, obs) LEFT JOIN ln USING (gene_id, cell_id)"""
RANKED = """SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY x)
      + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2.0::DOUBLE AS rk FROM dense"""
PER = """SELECT gene_id, label, sum(rk) AS rs, sum(x) AS s, sum(x * x) AS ss, sum((x > 0)::INT) AS nnz FROM ranked GROUP BY 1, 2"""
# Two-sided normal tail by the same rational formula the engine uses.
_T = "(1.0 / (1.0 + abs(z) / sqrt(2.0) / 2.0))"
P_NORMAL = (f"({_T} * exp(-z * z / 2.0 - 1.26551223 + {_T} * (1.00002368 + {_T} * (0.37409196 + {_T} * (0.09678418 + {_T} * "
            f"(-0.18628806 + {_T} * (0.27886807 + {_T} * (-1.13520398 + {_T} * (1.48851587 + {_T} * (-0.82215223 + {_T} * "
            "0.17087277))))))))))")
TEST = f"""SELECT *, {P_NORMAL} AS p FROM (SELECT gene_id, label, (rs - ng * (na + 1) / 2.0)
      / sqrt(ng::DOUBLE * (na - ng) * (na + 1) / 12.0) AS z,
      log2((exp(s / ng) - 1 + 1e-9) / (exp((st - s) / (na - ng)) - 1 + 1e-9)) AS lfc, nnz::DOUBLE / ng AS pg,
      (nt - nnz)::DOUBLE / (na - ng) AS pr FROM per JOIN sizes USING (label)
      JOIN (SELECT gene_id, sum(s) AS st, sum(nnz) AS nt FROM per GROUP BY 1) USING (gene_id))"""
ADJ = """SELECT *, least(1.0, min(p * m / rk) OVER (PARTITION BY label ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (
    SELECT *, count(*) OVER (PARTITION BY label) AS m, rank() OVER (PARTITION BY label ORDER BY p)
      + count(*) OVER (PARTITION BY label, p) - 1 AS rk FROM test)"""
CHAIN = {"sizes": SIZES, "dense": DENSE, "ranked": RANKED, "per": PER, "test": TEST, "adj": ADJ}


@query("markers_rank_sum", sql(
    f"""SELECT gene_id, label, {r('z')} AS score, {r('p')} AS pval, {r('q')} AS padj, {r('lfc')} AS lfc,
      {r('pg')} AS pct_group, {r('pr')} AS pct_rest FROM adj""", "ln", "obs", "var", **CHAIN))
def _(d):
    return six(markers.rank_sum_test(d.lognorm, d.obs, d.var))


@query("markers_top", sql(
    f"""SELECT label, gene_id, rank FROM (SELECT label, gene_id, row_number() OVER (PARTITION BY label
      ORDER BY round(q, 12), round(z, 9) DESC, gene_id) AS rank FROM adj) WHERE rank <= 10""", "ln", "obs", "var", **CHAIN))
def _(d):
    return markers.top_markers(markers.rank_sum_test(d.lognorm, d.obs, d.var)).select("label", "gene_id", "rank")


def _welch(m):
    return f"""SELECT gene_id, label, {r('CASE WHEN a + b > 0 THEN (mg - mr) / sqrt(a + b) END')} AS score,
      {r('CASE WHEN a + b > 0 THEN (a + b) ** 2 / (a * a / (ng - 1) + b * b / (m - 1)) END', 4)} AS dof FROM (
      SELECT gene_id, label, ng, {m} AS m, s / ng AS mg, (st - s) / (na - ng) AS mr,
        greatest(0, ss - s * s / ng) / (ng - 1) / ng AS a,
        greatest(0, (sst - ss) - (st - s) ** 2 / (na - ng)) / (na - ng - 1) / {m} AS b
      FROM per JOIN sizes USING (label) JOIN (SELECT gene_id, sum(s) AS st, sum(ss) AS sst FROM per GROUP BY 1) USING (gene_id))"""


@query("markers_t_test", sql(_welch("(na - ng)"), "ln", "obs", "var", **CHAIN))
def _(d):
    t = markers.t_test(d.lognorm, d.obs, d.var).select("gene_id", "label", "score", F.round("dof", 4).alias("dof"))
    return six(t)


@query("markers_t_test_overestimated", sql(_welch("ng"), "ln", "obs", "var", **CHAIN))
def _(d):
    t = markers.t_test(d.lognorm, d.obs, d.var, overestimate_variance=True)
    return six(t.select("gene_id", "label", "score", F.round("dof", 4).alias("dof")))


@query("markers_logistic")
def _(d):
    n = normalize.cell_number(d.obs)
    # A hundred genes: they are sent to the values, not the values to them.
    hvg = F.broadcast(normalize.hvg_by_mean_bins(d.lognorm, n, 100).select("gene_id").persist())
    par = F.broadcast(normalize.scale_parameters(d.lognorm, n, hvg))
    vectors, _ = normalize.feature_vectors(d.obs, normalize.scaled_entries(d.lognorm, par), hvg)
    genes = [x[0] for x in hvg.orderBy("gene_id").collect()]
    return six(markers.logistic_markers(vectors.persist(), d.obs, genes, max_iter=10))


@query("markers_cluster_qc", sql(
    f"""SELECT label, n_cells, {r('100.0 * n_cells / sum(n_cells) OVER ()')} AS pct_of_total,
      {r('mg')} AS median_n_genes, {r('mc')} AS median_total_counts, {r('mm')} AS median_pct_counts_mt,
      {r('dbl')} AS doublet_fraction, {r('h')} AS sample_entropy, {r('h / ln(25)')} AS sample_entropy_norm,
      dominant_sample, {r('frac')} AS dominant_sample_frac,
      array_to_string(list_filter([CASE WHEN frac > 0.8 THEN 'one_sample' END, CASE WHEN dbl > 0.3 THEN 'doublets' END,
        CASE WHEN mm > 25 THEN 'high_mt' END, CASE WHEN mg < 250 THEN 'few_genes' END], lambda x: x IS NOT NULL), ',') AS flags
    FROM (SELECT label, count(*) AS n_cells, median(n_genes::DOUBLE) AS mg, median(total_counts::DOUBLE) AS mc,
      median(pct_mt) AS mm, avg((score > 8000)::INT) AS dbl FROM metrics GROUP BY 1)
    JOIN (SELECT label, -sum(p * ln(p)) AS h, max(p) AS frac, first(sample ORDER BY n DESC, sample) AS dominant_sample
      FROM (SELECT label, sample, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY label) AS p
        FROM metrics GROUP BY 1, 2) GROUP BY 1) USING (label)""", "metrics"))
def _(d):
    m = d.metrics.withColumn("predicted_doublet", F.col("score") > 8000)
    return six(markers.cluster_qc(m))
