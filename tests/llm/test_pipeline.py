"""The pipeline's stages on planted documents, and the guard of the entry point."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tallycell.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[2]
RNG = random.Random(11)


def prose(n):
    return [f"w{RNG.randrange(20_000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents 0-299; junk 300-399; exact copies 400-419; near copies 420-439; contaminated 440-449."""
    path = str(tmp_path_factory.mktemp("corpus"))
    clean = [prose(RNG.randrange(60, 300)) for _ in range(300)]
    items = [prose(30) for _ in range(5)]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in prose(80))) for i in range(100)]
    rows += [(400 + i, "\t".join(clean[i])) for i in range(20)]
    rows += [(420 + i, " ".join(clean[100 + i][:20] + ["edit"] + clean[100 + i][21:])) for i in range(20)]
    rows += [(440 + i, " ".join(prose(40) + items[i % 5][5:20] + prose(40))) for i in range(10)]
    docs = [(i, t, "en", "s0", len(t)) for i, t in rows] + [(900, None, None, None, None), (901, "", "en", "s0", 0), (None, " ".join(prose(90)), "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    planted = {*range(300), *range(400, 450), None}
    assert left["quality"] & {*range(450), None} == planted
    assert left["exact_dedup"] == left["quality"] - {*range(400, 420)} - ({901} if {900, 901} <= left["quality"] else set())
    assert left["near_dedup"] == left["exact_dedup"] - {*range(420, 440)}
    assert left["decontamination"] == left["near_dedup"] - {*range(440, 450)}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == left["decontamination"]
    assert all(r.n_tokens > 0 for r in out if r.doc_id not in (900, 901))


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_names():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(QUERIES)


def test_the_entry_point_works_without_this_folder(tmp_path):
    for name in ("__spark_entry__.py", "tallycell"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['tallycell.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert n and 'pipeline' not in n and not any(x.startswith('op1_') for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
