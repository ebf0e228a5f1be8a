import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallycell.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, digest string, idx int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes, arity):
    """Levels of one tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def walked(levels, i, arity, digest):
    proof = ""
    for level in levels[:-1]:
        a = i // arity * arity
        before, after = "".join(level[a:i]), "".join(level[i + 1:a + arity])
        proof, digest, i = proof + before + after, h(before + digest + after), i // arity
    return proof, digest


def brute(rows, arity):
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {k: up([leaf(r) for r in trees[k]], arity) for k in langs}
    top = up([levels[k][-1][0] for k in langs], arity)
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(trees[k]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            low, d = walked(levels[k], i, arity, leaf(r, 1 if hit else 0))
            high, d = walked(top, j, arity, d)
            out.append((r[0], leaf(r), levels[k][-1][0], top[-1][0], h(low + high), d, d == top[-1][0]))
    return sorted(out, key=str)


def rows():
    made = [(i, f"s{i % 3}", ["en", "de", "zz", "é"][min(i % 5, 3) if i % 5 else 0], i * 3, f"text {i} ß") for i in range(1, 90)]
    made += [(200 + i, None, None, None, None) for i in range(3)] + [(None, "s", "en", 5, "without id"), (None, "s", "en", 5, "without id"), (None, None, "en", 5, None)]
    made += [(7, "s1", "en", 1, "again"), (7, "s1", "en", 1, "again"), (7, "s1", "de", 1, "again"), (500, "s", "alone", 4, ""), (501, "s", "long", 1, "wörd " * 200_000)]
    return made


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_matches_brute_force(spark, arity):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows()], SCHEMA)
    got = sorted(map(tuple, merkle.verified(docs, arity).collect()), key=str)
    assert got == brute(rows(), arity)


def test_groups_of_levels_hand_down_whole_paths(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ARM", 4)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows()], SCHEMA)
    assert sorted(map(tuple, merkle.verified(docs).collect()), key=str) == brute(rows(), 2)


def test_tampered_rows_alone_fail(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows()], SCHEMA)
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    want = {r.doc_id for r in docs.filter(hit).collect()}
    assert {r.doc_id for r in merkle.verified(docs).filter("not verified").collect()} == want and want


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "s", None, 1, "x", 0, "", 0)], SCHEMA)
    got = merkle.verified(one).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == h("")
    assert merkle.verified(one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        merkle.verified(one, 1)
