"""Operators on small fixtures: zeros, ties, guards, planted effects and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallycell.knowledge import fixed
from tallycell.operators import annotate, de, doublets, graph, ingest, integrate, markers, normalize, qc, score, subset
from tallycell.sources import assemble


@pytest.fixture(scope="module")
def planted(spark):
    """Three cell types in six samples of two arms; genes 0-9 mark type 0 and so on, gene 30 rises in arm A."""
    rng = np.random.default_rng(0)
    n, genes = 360, 60
    kind, sample = np.arange(n) % 3, (np.arange(n) // 3) % 6
    mean = np.full((n, genes), 0.6)
    for k in range(3):
        mean[kind == k, 10 * k:10 * k + 10] = 6.0
    mean[sample < 3, 30] *= 8
    x = rng.poisson(mean)
    i, j = np.nonzero(x)
    counts = spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene_id": j, "count": x[i, j]}))
    obs = spark.createDataFrame(pd.DataFrame({
        "cell_id": range(n), "label": [f"t{k}" for k in kind], "sample": [f"s{s}" for s in sample],
        "condition": ["A" if s < 3 else "B" for s in sample], "batch": [f"b{s % 2}" for s in sample]}))
    var = spark.createDataFrame(pd.DataFrame({"gene_id": range(genes), "symbol": [f"Gene{g}" for g in range(genes)]}))
    return {"x": x, "kind": kind, "counts": counts.cache(), "obs": obs.cache(), "var": var.cache()}


def dense_lognorm(x):
    total = x.sum(1, keepdims=True)
    return np.log1p(x * 1e4 / np.where(total == 0, 1, total))


def test_zero_count_cells_stay(spark):
    counts = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], "cell_id int, gene_id int, count bigint")
    obs = spark.createDataFrame([(1, "s"), (2, "s")], "cell_id int, sample string")
    var = spark.createDataFrame([(1, "mt-a"), (2, "Krt5")], "gene_id int, symbol string")
    m = {r["cell_id"]: r for r in qc.cell_metrics(counts, obs, var, fixed.QC_PATTERNS["mouse"]).collect()}
    assert m[1]["pct_counts_mt"] == 75.0 and m[1]["frac_keratin"] == 0.25
    assert m[2]["n_genes"] == 0 and m[2]["total_counts"] == 0 and m[2]["complexity"] == 0.0 and m[2]["pct_counts_mt"] is None


def test_threshold_none_is_skipped_and_zero_is_a_value(spark):
    m = spark.createDataFrame([(1, "s", 0, 5, 1.0), (2, "s", 9, 5, 50.0)],
                              "cell_id int, sample string, n_genes int, total_counts int, pct_counts_mt double")
    assert qc.preview_filters(m, {"min_genes": 0, "max_pct_mt": None}).by_criterion.count() == 0
    got = {r["reason"]: r["removed"] for r in qc.preview_filters(m, {"min_genes": 1, "max_pct_mt": 10}).by_criterion.collect()}
    assert got == {"min_genes": 1, "max_pct_mt": 1}


def test_large_losses_need_confirmation():
    with pytest.raises(ValueError):
        qc.check_loss(100, 60)
    with pytest.raises(ValueError):
        qc.check_loss(100, 0, confirm=True)
    qc.check_loss(100, 60, confirm=True)


def test_rank_sum_equals_dense_ranks(planted):
    x = dense_lognorm(planted["x"])
    ranks = pd.DataFrame(x).rank().to_numpy()
    got = markers.rank_sum_test(normalize.log_normalize(planted["counts"]), planted["obs"], planted["var"]).toPandas()
    n = len(x)
    for k in range(3):
        m = planted["kind"] == k
        want = (ranks[m].sum(0) - m.sum() * (n + 1) / 2) / np.sqrt(m.sum() * (n - m.sum()) * (n + 1) / 12)
        mine = got[got.label == f"t{k}"].sort_values("gene_id")
        np.testing.assert_allclose(mine["score"], want, atol=1e-9)
        assert set(mine.nlargest(10, "score")["gene_id"]) == set(range(10 * k, 10 * k + 10))


def test_pseudobulk_sums_and_drops(planted):
    b = de.pseudobulk(planted["counts"], planted["obs"], min_cells=10)
    assert b.dropped.count() == 0
    assert b.counts.agg(F.sum("count")).first()[0] == planted["x"].sum()


def test_planted_effect_is_found(planted):
    b = de.pseudobulk(planted["counts"], planted["obs"])
    info = planted["obs"].select("sample", "condition").distinct()
    design = de.resolve_design(b, info, "condition", "A", "B", ["condition"], min_genes=20)
    assert design.skipped.count() == 0
    t = de.nb_test(b.counts, design, de.size_factors(b.counts, design.units), "A").toPandas()
    hit = t[t.gene_id == 30]
    assert (hit["lfc"] > 1.5).all() and (hit["padj"] < 0.05).all()
    assert (t[t.gene_id != 30]["padj"] < 0.05).mean() < 0.1
    shrunk = de.shrink_lfc(t.pipe(planted["obs"].sparkSession.createDataFrame)).toPandas()
    assert (shrunk["lfc"].abs() <= shrunk["lfc_unshrunk"].abs() + 1e-12).all()


def test_interaction_terms_are_named(planted):
    obs = planted["obs"].withColumn("timepoint", F.concat(F.lit("D"), F.substring("sample", 2, 1).cast("int") % 2))
    b = de.pseudobulk(planted["counts"], obs)
    info = obs.select("sample", "condition", "timepoint").distinct()
    design = de.resolve_design(b, info, "condition", "A", "B", min_genes=20)
    units = design.units.join(info.select("sample", "timepoint"), "sample")
    t = de.nb_test(b.counts, design._replace(units=units), de.size_factors(b.counts, units), "A", interaction="timepoint").toPandas()
    assert set(t["coefficient"]) == {"A:D1"} and (t["padj"] < 0.05).mean() < 0.1


def test_too_few_samples_are_skipped_with_a_reason(planted):
    b = de.pseudobulk(planted["counts"], planted["obs"])
    info = planted["obs"].select("sample", "condition").distinct()
    design = de.resolve_design(b, info, "condition", "A", "B", min_samples=4, min_genes=20)
    assert design.units.count() == 0 and design.skipped.count() == 3


@pytest.mark.parametrize("block", [16, 4096])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(c, 0.3, (60, 3)) for c in (0, 4, 9)] + [np.zeros((20, 3))])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "cell_id bigint, v array<double>")
    got = graph.neighbour_graph(df, 5, block=block).toPandas()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)).round(9)
    np.fill_diagonal(d, np.inf)
    for i, part in got.sort_values("rank").groupby("src"):
        want = np.lexsort((np.arange(len(v)), d[i]))[:5]
        assert list(part["dst"]) == list(want)


def test_communities_recover_blobs(spark):
    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(c, 0.4, (40, 4)) for c in (0, 5, 10)])
    emb = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "cell_id bigint, v array<double>")
    w = graph.connectivities(graph.neighbour_graph(emb, 8))
    c = graph.communities(w, 0.5, rounds=4, levels=3).toPandas().set_index("cell_id").sort_index()["cluster"]
    truth = pd.Series(np.arange(120) // 40)
    purity = pd.crosstab(c, truth).max(axis=1).sum() / 120
    assert purity > 0.95 and c.nunique() <= 12
    both = graph.adjusted_rand(spark.createDataFrame(pd.DataFrame({"a": c.to_numpy(), "b": c.to_numpy()})), "a", "b")
    assert both.first()[0] == pytest.approx(1.0)


def test_batch_correction_mixes_batches_and_keeps_clusters(spark):
    rng = np.random.default_rng(5)
    kind, batch = np.arange(200) % 2, (np.arange(200) // 2) % 2
    v = rng.normal(0, 0.3, (200, 3)) + np.outer(kind, [6, 0, 0]) + np.outer(batch, [0, 1.5, 0]) + [3, 3, 3]
    df = spark.createDataFrame([(i, f"b{b}", r.tolist()) for i, (b, r) in enumerate(zip(batch, v))],
                               "cell_id bigint, batch string, v array<double>")
    z = np.vstack(integrate.harmonize(df, "batch", n_clusters=4, max_iter=5).orderBy("cell_id").toPandas()["v"])
    before = abs(v[batch == 1, 1].mean() - v[batch == 0, 1].mean())
    after = abs(z[batch == 1, 1].mean() - z[batch == 0, 1].mean())
    assert after < 0.4 * before
    assert abs(z[kind == 1, 0].mean() - z[kind == 0, 0].mean()) > 4


def test_confounded_batch_is_flagged(spark):
    rows = [(i, f"s{i % 4}", "A" if i % 4 < 2 else "B") for i in range(80)]
    obs = spark.createDataFrame(rows, "cell_id int, sample string, condition string").withColumn("same", F.col("condition"))
    ok = integrate.confounding_guard(integrate.contingency(obs, "sample", ["condition"])).first()
    assert not ok["confounded"] and ok["nested_but_safe"] and ok["cramers_v"] == pytest.approx(1.0)
    assert integrate.confounding_guard(integrate.contingency(obs, "same", ["condition"])).first()["confounded"]


def test_variance_trend_prefers_overdispersed_genes(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(rng.uniform(0.5, 20, 200), (150, 200))
    x[:, 7] = rng.poisson(np.where(np.arange(150) % 2, 1, 30))
    i, j = np.nonzero(x)
    counts = spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene_id": j, "count": x[i, j]}))
    n = normalize.cell_number(counts.select("cell_id").distinct())
    assert normalize.hvg_by_variance_trend(counts, n, 1).first()["gene_id"] == 7


def test_components_equal_dense_svd(planted):
    lognorm, n = normalize.log_normalize(planted["counts"]), normalize.cell_number(planted["obs"])
    genes = planted["var"].select("gene_id")
    vec, size = normalize.feature_vectors(planted["obs"], normalize.scaled_entries(lognorm, normalize.scale_parameters(lognorm, n, genes)), genes)
    pc = normalize.principal_components(vec, size, 360, 3)
    x = dense_lognorm(planted["x"])
    z = np.minimum((x - x.mean(0)) / x.std(0, ddof=1), 10)
    s = np.linalg.svd(z - z.mean(0), compute_uv=False) ** 2
    np.testing.assert_allclose(pc.variance_ratio, (s / s.sum())[:3], rtol=1e-6)
    emb = np.vstack(pc.embedding.orderBy("cell_id").toPandas()["v"])
    np.testing.assert_allclose(np.abs(emb.mean(0)), 0, atol=1e-8)


def test_module_scores_separate_types(planted):
    sets = planted["var"].where("gene_id < 30").select(F.concat(F.lit("m"), F.floor(F.col("gene_id") / 10)).alias("set_name"), "gene_id")
    lognorm = normalize.log_normalize(planted["counts"])
    w = score.module_weights(lognorm, planted["var"], sets, normalize.cell_number(planted["obs"]), n_bins=5)
    m = score.group_means(score.module_scores(lognorm, w), planted["obs"], w, "label").toPandas().pivot(index="label", columns="set_name", values="mean_score")
    assert list(m.idxmax(axis=1)) == ["m0", "m1", "m2"]


def test_labels_and_subsets(planted, spark):
    done = annotate.apply_labels(planted["obs"], {"t0": "x", "t1": "y"}, "label")
    assert [r[0] for r in done.unmapped.collect()] == ["t2"]
    names = spark.createDataFrame([("Mono-1",), ("T cells",), ("what",), ("macrophages (M2)",)], "label string")
    got = {r["label"]: r["matched"] for r in annotate.match_label(names, list(fixed.MOUSE_LINEAGES)).collect()}
    assert got == {"Mono-1": "Monocytes", "T cells": "T cells", "what": None, "macrophages (M2)": "Macrophages"}
    with pytest.raises(ValueError):
        subset.drop_clusters(planted["obs"], "label", ["t0"], " ", True)
    part = subset.extract_labels(planted["obs"].withColumn("leiden_res1", F.lit("0")), planted["counts"], "label", ["t0"])
    assert "parent_leiden_res1" in part.obs.columns and part.obs.count() == 120


def test_barcodes_align_despite_suffix(spark):
    target = spark.createDataFrame([(f"AAAC{i}-1",) for i in range(10)], "cell_id string")
    raw = spark.createDataFrame([(f"AAAC{i}", "g", 2.0) for i in range(8)], "cell_id string, gene_id string, count double")
    var = spark.createDataFrame([("g",)], "gene_id string")
    g = assemble.attach_counts(target, var, raw)
    assert g.counts.count() == 8 and g.report.first()["n_matched"] == 8
    assemble.check_graft(g.report)
    bad = assemble.attach_counts(target, var, raw.withColumn("count", F.col("count") + 0.5)).report
    with pytest.raises(ValueError):
        assemble.check_graft(bad)
    none = assemble.attach_counts(target, var, raw.withColumn("cell_id", F.concat(F.lit("zz"), "cell_id"))).report
    with pytest.raises(ValueError):
        assemble.check_graft(none)


def test_organism_is_checked(spark):
    counts = spark.createDataFrame([(1, 1, 40)], "cell_id int, gene_id int, count bigint")
    obs = spark.createDataFrame([(1,)], "cell_id int")
    var = spark.createDataFrame([(1, "ACTB", "Gene Expression"), (2, "GAPDH", "Gene Expression")], "gene_id int, symbol string, feature_type string")
    report = ingest.validation_report(counts, obs, var)
    ingest.require_organism(report, "human")
    with pytest.raises(ValueError):
        ingest.require_organism(report, "mouse")


def test_doublet_rate_table(spark):
    df = spark.createDataFrame([(100,), (1500,), (20000,), (90000,)], "n bigint")
    got = [r[0] for r in df.select(qc.expected_doublet_rate(F.col("n"))).collect()]
    assert got == pytest.approx([0.004, 0.012, 0.152, 0.35])
    assert doublets.drop_doublets(spark.createDataFrame([(1, True), (2, None)], "cell_id int, predicted_doublet boolean")).count() == 1
