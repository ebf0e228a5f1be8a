"""The decontamination stage removes rows, not all rows of a doc_id."""

import random

import corpus_pipeline

RNG = random.Random(8)


def prose(n):
    return [f"w{RNG.randrange(20_000)}" for _ in range(n)]


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    item = prose(30)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = {k: " ".join(prose(60)) for k in "abcd"}
    dirty = {k: " ".join(prose(20) + item[3:18] + prose(20)) for k in "xy"}
    rows = [(None, clean["a"]), (None, dirty["x"]), (None, clean["b"]), (7, clean["c"]), (7, dirty["y"]), (8, clean["d"]), (8, clean["d"]), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    key = str
    assert sorted(map(tuple, left.collect()), key=key) == sorted((r for r in rows if r[1] not in dirty.values()), key=key)
