"""Diffusion components against a dense eigensolver, pseudotime along a planted line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycell.operators import diffusion, graph


@pytest.fixture(scope="module")
def line(spark):
    draw = np.random.default_rng(2)
    place = np.sort(draw.uniform(0, 10, 150))
    v = np.column_stack([place, 0.15 * draw.normal(size=150), 0.15 * draw.normal(size=150)])
    cells = spark.createDataFrame([(i, x.tolist(), "start" if i < 12 else "rest", float(p)) for i, (x, p) in enumerate(zip(v, place))],
                                  "cell_id long, v array<double>, label string, place double")
    edges = graph.connectivities(graph.neighbour_graph(cells, 10))
    return cells, edges.persist()


def test_components_equal_a_dense_solver(line):
    _, edges = line
    found = diffusion.components(edges, n=6, tol=1e-6)
    w = np.zeros((150, 150))
    for r in edges.collect():
        w[r.src, r.dst] = r.weight
    q = w.sum(1)
    w = w / q[:, None] / q[None, :]
    z = np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(w / z[:, None] / z[None, :])
    values, vectors = values[::-1][:6], vectors[:, ::-1][:, :6]
    np.testing.assert_allclose(found.values, values, atol=1e-6)
    assert found.residuals.max() <= 1e-6 and found.values[0] == pytest.approx(1)
    x = np.array([r[1:] for r in sorted(found.cells.collect())])
    np.testing.assert_allclose(x.T @ x, np.eye(6), atol=1e-8)
    np.testing.assert_allclose(np.abs((x * vectors).sum(0)), 1, atol=1e-4)


def test_pseudotime_rises_along_the_line(line):
    cells, edges = line
    alone = cells.where("cell_id = 3").withColumn("cell_id", F.lit(999).cast("long"))
    got = diffusion.diffusion_pseudotime(edges, cells.union(alone), "start", n=8).join(cells, "cell_id", "left").toPandas()
    assert got.set_index("cell_id").loc[999, "pseudotime"] is None or np.isnan(got.set_index("cell_id").loc[999, "pseudotime"])
    got = got[got.cell_id != 999]
    assert got["pseudotime"].min() == 0 and got["pseudotime"].max() == 1
    late = got[got["place"] > 1.5]
    assert late["pseudotime"].rank().corr(late["place"].rank()) > 0.98
    with pytest.raises(ValueError):
        diffusion.diffusion_pseudotime(edges, cells, "absent", n=4)


def test_few_cells_and_no_edges(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 0.5), (3, 2, 0.5)], "src long, dst long, weight double")
    assert len(diffusion.components(edges, 15).values) == 3
    with pytest.raises(ValueError):
        diffusion.components(edges.limit(0))


def test_parts_give_the_same_components(line, monkeypatch):
    _, edges = line
    monkeypatch.setattr(diffusion, "PART", 40)
    packed, parts = diffusion._packed, []
    monkeypatch.setattr(diffusion, "_packed", lambda *a: (parts.append(1), packed(*a))[1])
    test_components_equal_a_dense_solver(line)
    assert parts


def test_a_polynomial_is_one_job(line, monkeypatch):
    """Blocks are written twice a round, however many products a polynomial has."""
    _, edges = line
    written, made = [], diffusion.checkpointed
    monkeypatch.setattr(diffusion, "checkpointed", lambda df: (written.append(df), made(df))[1])
    with pytest.raises(ValueError):
        diffusion.components(edges, n=6, tol=0.0, degree=6, rounds=2)
    assert len(written) <= 10
