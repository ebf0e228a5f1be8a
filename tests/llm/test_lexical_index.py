import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallycell.llm import lexical_index as lx

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(doc_id, Counter(words(text)), len(words(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(1 for _, _, n in bags if n), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, Counter()).update(words(text))
    out = []
    for item_id, terms in asked.items():
        scores = []
        for doc_id, bag, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms if n else 0
            score = sum(c * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, c in terms.items() if bag[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(120)] + ["Über", "naïve", "日本語", "ÀB"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.choice([0, 1, 2, 5, 20, 20, 60, 300]))) + draw.choice(["", ".", "\t!", " x"]) for _ in range(250)]
    docs = [(i * 3 % 251, t) for i, t in enumerate(texts)] + [(9, "w1 w1, W1"), (9, "w1 w1 w1"), (None, "w1 w1 w1"), (None, "w1 w1 w1"), (400, None), (401, ""), (402, " .,;"), (403, "rare-word w1 " * 30_000)]
    docs += [(1000 + i, "same text here, ten times and more: W3 w4") for i in range(30)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 3, 15, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "absent words"), (93, "w1"), (94, "w1 w1 rare word"), (94, "again w2"), (None, "w3 w5"), (95, "same text")]
    return docs, items


def frames(spark):
    docs, items = corpus()
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash")).withColumn("segment", F.lit(1)).withColumn("_row", F.lit(2)),
            spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("w1")).withColumn("block", F.lit(0)).withColumn("doc_id", F.lit(3)))


def test_matches_brute_force(spark):
    docs, items = frames(spark)
    assert sorted(map(tuple, lx.ranked(docs, items).collect()), key=str) == brute(*corpus())


def test_many_segments_and_blocks(spark):
    docs, items = frames(spark)
    index, stats = lx.build_index(docs.repartition(3), segment_bytes=4000)
    assert index.select("segment").distinct().count() > 8
    assert sorted(map(tuple, lx.search(index, stats, items, k=4, limit=40).collect()), key=str) == brute(*corpus(), k=4)


def test_blocks_hold_whole_items(spark):
    _, items = frames(spark)
    entries = lx.item_terms(items).withColumn("weight", F.lit(1))
    placed, numbers = lx.blocks(entries, 30)
    sizes = {}
    for block, item_id, n in placed.groupBy("block", "item_id").count().collect():
        sizes.setdefault(block, []).append(n)
    assert sorted(sizes) == numbers and len(numbers) > 3 and placed.count() == entries.count()
    assert all(sum(n) <= 30 or len(n) == 1 for n in sizes.values())
    assert placed.groupBy("item_id").agg(F.countDistinct("block").alias("b")).filter("b > 1").isEmpty()


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert lx.ranked(docs.limit(0), items).count() == 0
    assert lx.ranked(docs, items.limit(0)).count() == 0
    assert lx.ranked(docs.filter("text is null"), items).count() == 0


def test_strata_are_left_out_only_below_the_best(spark):
    draw = np.random.default_rng(3)
    for _ in range(60):
        n = int(draw.integers(1, 80))
        m = draw.integers(25, 32, n).astype(np.int32)
        rows, scores = {}, np.zeros(n, np.int64)
        for t in "abcd":
            docs = np.flatnonzero(draw.random(n) < 0.6)
            if not len(docs):
                continue
            tf = draw.integers(1, 4, len(docs)).astype(np.int32)
            by = np.lexsort((docs, -tf, m[docs]))
            docs, tf = docs[by], tf[by]
            cut = np.flatnonzero(np.concatenate([[True], (m[docs][1:] != m[docs][:-1]) | (tf[1:] != tf[:-1])]))
            rows[t] = (m[docs][cut], tf[cut], np.diff(np.append(cut, len(docs))), docs)
            scores[docs] += 3 * lx.impact(tf, m[docs])
        best = lx.Best(5)
        if rows:
            lx.Segment(np.arange(n) * 10, rows).search(lx.Query(1, list("abcd"), np.array([3, 3, 3, 3])), best)
        want = sorted(((int(s), -10 * i) for i, s in enumerate(scores) if s > 0), reverse=True)[:5]
        assert sorted(best.heap, reverse=True) == want
