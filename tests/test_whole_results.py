"""Operators give whole results: no caps, no size-dependent answers."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tallycell.functions import order_stats
from tallycell.operators import enrich, normalize, provenance, trajectory


def test_lineage_of_many_generations_and_cycles(spark):
    rows = [(f"d{i}", f"d{i - 1}" if i else None) for i in range(70)] + [("x", "y"), ("y", "z"), ("z", "x")]
    table = spark.createDataFrame(rows, "dataset_id string, parent_id string").coalesce(1)
    got = {r.dataset_id: r.depth for r in provenance.lineage(table, "d69").where("relation = 'ancestor'").collect()}
    assert got == {f"d{69 - k}": k for k in range(1, 70)}
    loop = provenance.lineage(table, "x")
    assert sorted((r.dataset_id, r.relation) for r in loop.collect()) == [("x", "self"), ("y", "ancestor"), ("y", "descendant"), ("z", "ancestor"), ("z", "descendant")]


def test_buckets_of_any_size_give_the_same_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 3000), ("b", 40), ("c", 1)) for v in rng.integers(0, n, n)]
    df = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    found = []
    for size in (3, 100, 4096):
        c = order_stats.cumulative(df, ["g"], "v", "n", size)
        found.append(sorted((r.g, r.v, r._cum, r._tie, r._total) for r in c.collect()))
        assert c.where("g = 'a'").select("_b").distinct().count() > (1 if size < 1000 else 0)
    assert found[0] == found[1] == found[2]


def test_pearson_residuals_with_many_distinct_totals(spark):
    rng = np.random.default_rng(2)
    n, genes = 6000, 4
    x = rng.poisson(rng.uniform(1, 30_000, n)[:, None] * np.array([.4, .3, .2, .1]))
    x[:, 3] = rng.poisson(.05, n)
    counts = spark.createDataFrame([(int(i), int(j), int(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cell_id long, gene_id long, count long")
    cells = spark.range(n).withColumnRenamed("id", "cell_id")
    got = {r.gene_id: r.residual_var for r in normalize.hvg_by_pearson_residuals(counts, normalize.cell_number(cells), genes).collect()}
    total = x.sum(axis=1)
    assert len(set(total.tolist())) > 4096
    mu = total[:, None] * x.sum(axis=0) / x.sum()
    mu = np.where(mu > 0, mu, 1e-300)
    z = np.clip((x - mu) / np.sqrt(mu + mu * mu / 100), -np.sqrt(n), np.sqrt(n))
    for j in range(genes):
        assert abs(got[j] - z[:, j].var()) < 1e-6 * max(1, z[:, j].var())


def test_draws_are_without_replacement(spark):
    drawn = spark.createDataFrame([("l", f"s{k}", p, k, 12) for k in (5, 12) for p in range(20)],
                                  "label string, set_name string, perm int, n_hits long, n long")
    rows = enrich._distinct_positions(drawn, ["label"], 0).collect()
    for k in (5, 12):
        for p in range(20):
            own = [r.pos for r in rows if r.set_name == f"s{k}" and r.perm == p]
            assert len(own) == len(set(own)) == k and min(own) >= 1 and max(own) <= 12


def test_cells_without_a_fate_stay(spark):
    cells = spark.createDataFrame([(1, "D1", "a"), (2, "D2", "b"), (3, "D1", "a"), (4, None, "a")], "cell_id long, timepoint string, label string")
    edges = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    got = {(r.cell_id, r.fate, r.p) for r in trajectory.fate_probabilities(edges, cells).collect()}
    assert got == {(1, "b", 1.0), (2, "b", 1.0), (3, None, None), (4, None, None)}


def test_counts_and_lognorm_are_made_once(spark):
    """Passes over the counts read a table; they neither join the lines again nor meet the cell totals again."""
    from tallycell.plans.standin import Standin
    d = Standin(spark, "/root/testdata/sf0.001")
    for df in (d.counts, d.lognorm):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert d.counts.count() == d.lognorm.count() > 0


def test_draws_of_large_sets_are_looked_up(spark):
    """Whether a place is taken is looked up, not searched for among all places drawn so far; the places stay those of the rule."""
    drawn = spark.createDataFrame([("l", "s", 1, 3000, 4000)], "label string, set_name string, perm int, n_hits long, n long")
    found = enrich._distinct_positions(drawn, ["label"], 0)
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
    taken = set()
    for j in range(1001, 4001):
        place = int(hashlib.md5(f"0:s:1:{j}".encode()).hexdigest()[:12], 16) % j + 1
        taken.add(j if place in taken else place)
    assert sorted(r.pos for r in found.collect()) == sorted(taken)


def test_genes_of_equal_totals_meet_the_cell_totals_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(normalize, "checkpointed", lambda df: met.append(df.count()) or df if "z1" in df.columns else df)
    counts = spark.createDataFrame([(c, g, 1 + c) for g in range(40) for c in range(3)], "cell_id long, gene_id long, count long")
    got = normalize.hvg_by_pearson_residuals(counts, normalize.cell_number(spark.range(3)), 40).collect()
    assert len(got) == 40 and met == [1]


def test_a_gene_that_does_not_settle_holds_up_no_others(monkeypatch):
    from tallycell.operators import de
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(8), np.repeat([0.0, 1.0], 4)])
    y = rng.poisson(20, (500, 8)).astype(float)
    y[0] = [1, 0, 0, 0, 0, 0, 0, 0]
    solved, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: solved.append(len(a)) or solve(a, b))
    both = de._irls(y, x, np.zeros(8), np.full(500, .1))
    assert sum(solved) < 500 * 12
    for i in (0, 7):
        one = de._irls(y[i:i + 1], x, np.zeros(8), np.full(1, .1))
        assert all(np.allclose(a[i], b[0], rtol=1e-6, atol=1e-7) for a, b in zip(both, one))


def test_genes_are_not_gathered_by_label(spark, monkeypatch):
    from tallycell.operators import de
    rng = np.random.default_rng(1)
    units = spark.createDataFrame([("all", f"s{i}", "ab"[i % 2]) for i in range(6)], "label string, sample string, arm string")
    counts = spark.createDataFrame([("all", f"s{i}", g, int(rng.poisson(9)) + 1) for g in range(60) for i in range(6)], "label string, sample string, gene_id long, count long")
    factors = units.select("label", "sample", F.lit(1.0).alias("size_factor"))
    seen, keep = [], de.checkpointed
    monkeypatch.setattr(de, "checkpointed", lambda df: (seen.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())), keep(df))[1])
    got = de.nb_test(counts, de.Design(units, counts.select("label", "gene_id").distinct(), units), factors, "a").collect()
    assert len(got) == 60
    first, second = [s for s in seen if "base_mean" in s[0]]
    assert "design" not in first[0]
    for _, plan in (first, second):
        assert "strategy=broadcast" in plan


def test_group_means_without_scores_of_cells(spark):
    from tallycell.operators import score
    rng = np.random.default_rng(3)
    values = spark.createDataFrame([(c, g, float(rng.random())) for c in range(30) for g in range(12) if rng.random() < .5], "cell_id long, gene_id long, x double")
    obs = spark.createDataFrame([(c, "uv"[c % 2]) for c in range(32)], "cell_id long, label string")
    w = spark.createDataFrame([("s", g, .25 if g < 4 else -.125) for g in range(12)] + [("t", 1, 1.0)], "set_name string, gene_id long, w double")
    scores = score.module_scores(values, w, True)
    def rows(df):
        return {(r.label, r.set_name): (r.n_cells, round(r.mean_score, 9)) for r in df.collect()}
    assert rows(score.group_means_of_sums(score.gene_sums(values, obs, "label"), obs, w, "label")) == rows(score.group_means(scores, obs, w, "label"))
    full = score.every_cell(scores.drop("n_det"), obs, w).collect()
    assert len(full) == 64 and {r.score for r in full if r.cell_id > 29} == {0.0}
    det = {(r.cell_id, r.set_name): r.n_det for r in scores.collect()}
    want = {(r.cell_id, "s"): 0 for r in values.collect()} | {(r.cell_id, "s"): r.n for r in values.where("gene_id < 4").groupBy("cell_id").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in det.items() if k[1] == "s"} == want


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "TASK_ROWS", 100)
    df = spark.range(5000).withColumn("g", F.col("id") % 700)
    parts = order_stats.dealt(df, "g").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("g").alias("g")).collect()
    assert len(parts) > 30 and max(r.n for r in parts) < 500 and sum(r.g for r in parts) == 700
