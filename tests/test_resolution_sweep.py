"""A sweep of many clusterings through the same jobs gives what each gives by itself, and its query leaves no resolution out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycell.operators import graph
from tallycell.operators.graph import RESOLUTIONS
from tallycell.plans.registry import queries


def partition(rows):
    groups = {}
    for cell, cluster in rows:
        groups.setdefault(cluster, set()).add(cell)
    return {frozenset(x) for x in groups.values()}


def test_runs_equal_single_clusterings(spark):
    draw = np.random.default_rng(3)
    centre = 4 * draw.normal(size=(5, 8))
    cells = spark.createDataFrame([(i, (centre[i % 5] + draw.normal(size=8)).tolist()) for i in range(120)], "cell_id long, v array<double>")
    edges = graph.connectivities(graph.neighbour_graph(cells, 8)).select("src", "dst", F.col("weight").alias("w")).persist()
    part = edges.where("src % 5 > 0 AND dst % 5 > 0")
    runs = edges.withColumn("run", F.explode(F.array(F.lit(0), F.lit(2)))).unionByName(part.withColumn("run", F.lit(5)))
    got = graph.communities_of_runs(runs, {0: 0.3, 2: 1.2, 5: 0.8}, rounds=4, levels=2).collect()
    for run, e, resolution in ((0, edges, 0.3), (2, edges, 1.2), (5, part, 0.8)):
        alone = graph.communities(e.withColumnRenamed("w", "weight"), resolution, rounds=4, levels=2).collect()
        assert {(r.cell_id, r.cluster) for r in got if r.run == run} == {(r.cell_id, r.cluster) for r in alone}
        assert len(partition(alone)) > 1


def test_rand_by_group(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i % 3), int(a), int(b)) for i, (a, b) in enumerate(draw.integers(0, 4, (300, 2)))]
    labels = spark.createDataFrame(rows, "g int, a int, b int")
    got = {r.g: r.ari for r in graph.adjusted_rand(labels, "a", "b", ["g"]).collect()}
    assert sorted(got) == [0, 1, 2]
    for g in got:
        assert got[g] == pytest.approx(graph.adjusted_rand(labels.where(F.col("g") == g), "a", "b").first()[0], abs=1e-12)


def test_query_compares_all_resolutions(spark, monkeypatch):
    seen = {}

    def watch(edges, resolutions, rounds, levels):
        seen.update(resolutions=resolutions, rounds=rounds, levels=levels, runs=sorted(r[0] for r in edges.select("run").distinct().collect()))
        return edges.select("run", F.col("src").alias("cell_id"), F.pmod("src", F.lit(2)).cast("string").alias("cluster")).distinct()
    monkeypatch.setattr(graph, "communities_of_runs", watch)
    rows = queries()["graph_resolution_sweep"](spark, "/root/testdata/sf0.001").collect()
    assert [r.resolution for r in rows] == list(RESOLUTIONS) and all(r.ari == 1 for r in rows)
    assert seen["runs"] == list(range(4 * len(RESOLUTIONS))) and (seen["rounds"], seen["levels"]) == (6, 3)
    assert [seen["resolutions"][i] for i in seen["runs"]] == 4 * list(RESOLUTIONS)
