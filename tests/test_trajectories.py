"""Trees, robust means and simulated doublets on fixtures with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallycell.operators import communication, doublets, trajectory


def test_pseudotime_follows_a_line(spark):
    t = np.linspace(0, 10, 200)
    df = spark.createDataFrame([(i, [float(x), float(x) * 0.5]) for i, x in enumerate(t)], "cell_id bigint, v array<double>")
    tree = trajectory.principal_tree(df, 6)
    root = int(np.argmin(tree.nodes[:, 0]))
    pt = trajectory.pseudotime(df, tree, root).orderBy("cell_id").toPandas()["pseudotime"]
    assert pt.iloc[0] == pytest.approx(0) and pt.iloc[-1] == pytest.approx(1, abs=1e-6)
    assert (pt.diff().dropna() > -1e-9).all()


def test_robust_means_count_zeros(spark):
    x = {"a": [0, 0, 0, 5, 7], "b": [1, 2, 3, 4, 5]}
    rows = [(i, g, float(v)) for g, vs in x.items() for i, v in enumerate(vs) if v]
    obs = spark.createDataFrame([(i, "l") for i in range(5)], "cell_id int, label string")
    sizes, _ = communication.population_floor(obs, "label", [], 1)
    got = {r["gene_id"]: r["level"] for r in communication.robust_means(
        spark.createDataFrame(rows, "cell_id int, gene_id string, x double"), obs, sizes).collect()}
    for g, vs in x.items():
        q = np.quantile(vs, [0.25, 0.5, 0.75])
        assert got[g] == pytest.approx((q[0] + 2 * q[1] + q[2]) / 4)


def test_simulated_doublets_add_two_cells_of_one_sample(spark):
    counts = spark.createDataFrame([(i, i, 10 ** (i % 2)) for i in range(8)], "cell_id int, gene_id int, count bigint")
    obs = spark.createDataFrame([(i, f"s{i % 2}") for i in range(8)], "cell_id int, sample string")
    sim = doublets.simulated_pairs(counts, obs, per_cell=2)
    per = sim.groupBy("cell_id").agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("lo"), F.max("count").alias("hi")).collect()
    assert len(per) == 16 and all(r["k"] == 2 and r["lo"] == r["hi"] for r in per)


def test_fates_flow_forward(spark):
    cells = spark.createDataFrame([(1, "D1", "x"), (2, "D2", "p"), (3, "D2", "q")], "cell_id int, timepoint string, label string")
    edges = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0), (2, 1, 9.0)], "src int, dst int, weight double")
    got = {(r["cell_id"], r["fate"]): r["p"] for r in trajectory.fate_probabilities(edges, cells).collect()}
    assert got[(1, "p")] == pytest.approx(0.75) and got[(1, "q")] == pytest.approx(0.25) and got[(2, "p")] == 1.0


def test_pseudotime_genes_equal_dense_spearman(spark):
    rng = np.random.default_rng(7)
    x = rng.poisson(1.0, (80, 5)).astype(float)
    pt = rng.normal(size=80)
    x[:, 2] += np.maximum(pt, 0)
    i, j = np.nonzero(x)
    long = spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene_id": j, "x": x[i, j]}))
    cells = spark.createDataFrame(pd.DataFrame({"cell_id": range(80), "pt": pt}))
    got = trajectory.pseudotime_genes(long, cells, "pt", min_rho=0.0).toPandas().set_index("gene_id")["rho"]
    want = pd.DataFrame(x).rank().corrwith(pd.Series(pt).rank())
    np.testing.assert_allclose(got.sort_index(), want, atol=1e-9)
