"""File layouts, handles and the query registry."""

import pytest
from pyspark.sql import functions as F

from tallycell.plans import registry
from tallycell.sources import triplets


def test_10x_directory(spark, tmp_path):
    (tmp_path / "features.tsv").write_text("E1\tActb\tGene Expression\nE2\tActb\tGene Expression\nE3\tCd4\tGene Expression\n")
    (tmp_path / "barcodes.tsv").write_text("AA-1\nCC-1\n")
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%x\n3 2 3\n1 1 5\n2 1 1\n3 2 7\n")
    counts, cells, genes = triplets.load_10x(spark, str(tmp_path), "s1")
    assert sorted(map(tuple, counts.collect())) == [("AA-1", "Actb", 5), ("AA-1", "Actb-1", 1), ("CC-1", "Cd4", 7)]
    assert cells.where("sample = 's1'").count() == 2 and genes.count() == 3


def test_truncated_matrix_is_refused(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n3 2 3\n1 1 5\n")
    with pytest.raises(ValueError):
        triplets.read_matrix(spark, str(tmp_path / "m.mtx"))


def test_export_layout(spark, tmp_path):
    (tmp_path / "genes.txt").write_text("g1\ng2\n")
    (tmp_path / "barcodes.txt").write_text("c2\nc1\n")
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 2\n1 1 4\n2 2 6\n")
    (tmp_path / "metadata.csv").write_text("cell_id,label\nc1,x\nc2,y\n")
    (tmp_path / "reducedDim_pca.csv").write_text("cell_id,d1,d2\nc1,0.5,1\nc2,2,3\n")
    counts, obs, emb = triplets.load_export(spark, str(tmp_path), ("pca",))
    assert sorted(map(tuple, counts.collect())) == [("c1", "g2", 6), ("c2", "g1", 4)]
    assert {r["cell_id"]: r["label"] for r in obs.collect()} == {"c1": "x", "c2": "y"}
    assert {r["cell_id"]: r["v"] for r in emb["pca"].collect()}["c2"] == [2.0, 3.0]


def test_written_export_reads_back(spark, tmp_path):
    counts = spark.createDataFrame([(f"c{i:03}", f"g{j:03}", i + j) for i in range(1, 80) for j in range(40) if (i * j) % 3 == 1], "cell_id string, gene_id string, count bigint")
    obs = spark.createDataFrame([(f"c{i:03}", f"x{i % 3}") for i in range(80)], "cell_id string, label string")
    var = spark.createDataFrame([(f"g{j:03}",) for j in range(40)], "gene_id string")
    triplets.write_export(counts.repartition(5), obs.repartition(3), var.repartition(4), str(tmp_path / "out"))
    back, cells, _ = triplets.load_export(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, counts.collect()))
    assert sorted(map(tuple, cells.select("cell_id", "label").collect())) == sorted(map(tuple, obs.collect()))


def test_lines_of_many_parts_are_numbered_in_file_order(spark, tmp_path):
    want = []
    for part, size in enumerate((3, 400, 1, 50)):  # the reader packs large parts first
        lines = [f"p{part}-{i}" for i in range(size)]
        (tmp_path / f"part-{part:05}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    for width in ("100", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)
        rows = sorted(triplets._numbered(spark, str(tmp_path), "line").collect())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.ix for r in rows] == list(range(1, len(want) + 1)) and [r.line for r in rows] == want


def test_fractional_counts_are_refused_and_zeros_dropped(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 0.7\n2 2 3\n")
    with pytest.raises(ValueError):
        triplets.read_matrix(spark, str(tmp_path / "a.mtx"))
    (tmp_path / "b.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 0\n2 2 3\n")
    assert [tuple(r) for r in triplets.read_matrix(spark, str(tmp_path / "b.mtx")).collect()] == [(2, 2, 3.0)]


def test_a_bundle_is_registered_once(spark, tmp_path):
    first = triplets.save_bundle({"obs": spark.range(5)}, str(tmp_path), None, "load", {})
    assert triplets.save_bundle({"obs": spark.range(9)}, str(tmp_path), None, "load", {}) == first
    assert triplets.load_bundle(spark, str(tmp_path), first, "obs").count() == 5
    assert spark.read.parquet(str(tmp_path / "catalogue")).count() == 1
    triplets.export_table(spark, str(tmp_path), first, "obs", str(tmp_path / "elsewhere"))
    assert spark.read.parquet(str(tmp_path / "elsewhere")).count() == 5
    with pytest.raises(ValueError):
        triplets.load_bundle(spark, str(tmp_path), "ds_none", "obs")


def test_handles_repeat_and_bundles_round_trip(spark, tmp_path):
    assert triplets.handle("ds_1", "qc", {"a": 1, "b": 2}) == triplets.handle("ds_1", "qc", {"b": 2, "a": 1})
    assert triplets.handle("ds_1", "qc", {"a": 1}) != triplets.handle("ds_1", "qc", {"a": 2})
    ds = triplets.save_bundle({"obs": spark.range(5)}, str(tmp_path), None, "load", {})
    assert triplets.load_bundle(spark, str(tmp_path), ds, "obs").count() == 5
    assert spark.read.parquet(str(tmp_path / "catalogue")).where(F.col("dataset_id") == ds).count() == 1


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_flagship(spark):
    df = registry.queries()["qc_preview_by_sample"](spark, "/root/testdata/sf0.001")
    assert df.agg(F.sum("before")).first()[0] == 150
