"""Near copies that word fingerprints don't propose: every pair alike by shingles is found, against brute force."""

import random

import numpy as np
import pyarrow as pa

from tallycell.llm import simhash_dedup

RNG = random.Random(5)


def prose(n, words=5000):
    return [f"w{int(words * RNG.random() ** 3)}" for _ in range(n)]


def groups(rows):
    """Smallest id of the linked set of every document that has a smaller one, by comparing all pairs."""
    sets = {i: set(simhash_dedup.shingle_hashes(t.encode(), 5)) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common >= 0.8 * (len(sets[a] | sets[b])) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: r for i, r in root.items() if i != r}


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: r.group_id for r in simhash_dedup.similar_groups(docs).collect()}


def test_appended_and_truncated_copies(spark):
    rows = []
    for i in range(60):
        w = prose(RNG.randrange(100, 400))
        rows += [(i, " ".join(w)), (100 + i, " ".join(w + prose(int(len(w) * 0.22)))), (200 + i, " ".join(w[:int(len(w) * 0.83)]))]
    expected = groups(rows)
    assert sum(i < 200 for i in expected) == sum(i >= 200 for i in expected) == 60
    assert found(spark, rows) == expected


def test_cells_hold_all_pairs_of_a_common_shingle(spark):
    rows = [(7, i, 100 + i % 60) for i in range(300)]
    members = spark.createDataFrame(rows, "shingle long, doc_id long, size long")
    roots = spark.createDataFrame([(i, 0) for i in range(1, 150)], "node long, root long")
    got = [(r.b, r.a) for r in simhash_dedup.cell_pairs(members, roots, 0.8).collect()]
    size = {i: n for _, i, n in rows}
    expected = [(a, b) for a in range(300) for b in range(max(a + 1, 150), 300) if min(size[a], size[b]) >= 0.8 * max(size[a], size[b])]
    assert sorted(got) == expected


def test_copies_beside_other_texts_of_the_same_words(spark):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(8):
        order = RNG.sample(words, 300)
        rows += [(3 * i + 1, " ".join(order)), (3 * i + 2, " ".join([*order[:100], *order[101:], order[100]]))]
        rows.append((3 * i, " ".join(RNG.sample(words, 300))))
    assert groups(rows) == {3 * i + 2: 3 * i + 1 for i in range(8)}
    assert found(spark, rows) == groups(rows)


def test_proposals_choose_without_holding_all_links():
    fp = np.unique(np.array([RNG.getrandbits(9) for _ in range(400)], dtype=np.uint64))
    forest = simhash_dedup.Forest(fp, np.zeros(len(fp), dtype=np.int64))
    got = set(zip(*(x.tolist() for x in simhash_dedup.proposals(forest, 2)), strict=True))
    near = {a: [b for b in range(len(fp)) if a != b and (int(fp[a]) ^ int(fp[b])).bit_count() <= 2] for a in range(len(fp))}
    expected = {(a, min(bs, key=lambda b: ((int(fp[a]) ^ int(fp[b])).bit_count(), b))) for a, bs in near.items() if bs}
    assert got == expected | {(a, min(bs, key=lambda b: (-len(near[b]), b))) for a, bs in near.items() if bs}


def test_no_tree_of_proposals_holds_a_whole_large_shard(monkeypatch):
    sizes = []
    made = simhash_dedup.Forest.__init__
    monkeypatch.setattr(simhash_dedup.Forest, "__init__", lambda self, fp, shard: (sizes.append(np.bincount(shard).max()), made(self, fp, shard))[1])
    n = 2 * simhash_dedup.TREE + 5
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n) << 12)], ["choice", "shard", "fp"])
    assert sum(x.num_rows for x in simhash_dedup._shard_links(1, simhash_dedup.proposals)(iter([rows]))) > 0
    assert sizes == [simhash_dedup.TREE]


def test_pairs_that_meet_too_late_are_not_proposed(spark):
    """Of 40 documents with 20 shingles each that share only their last prefix shingle none can be alike; the two that share all are."""
    rows = [(100 * i + k, i, 20, 20 - k) for i in range(40) for k in range(4)] + [(9, i, 20, 16) for i in range(40)]
    rows += [(9000 + k, i, 20, 20 - k) for i in (50, 51) for k in range(5)]
    members = spark.createDataFrame(rows, "shingle long, doc_id long, size long, left long")
    roots = spark.createDataFrame([], "node long, root long")
    for propose in (simhash_dedup.cell_pairs, simhash_dedup.star_pairs):
        assert [(r.b, r.a) for r in propose(members, roots, 0.8).collect()] == [(50, 51)]
