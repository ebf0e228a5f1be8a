"""Operators on documents against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tallycell.llm import components, cotraining, exact_dedup, license_scan, positional_index, simhash_dedup

RNG = random.Random(3)
SPACES = re.compile("[\x20\x09-\x0d]+")


def frame(spark, rows):
    """Documents with a column whose name an operator uses itself."""
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _salt string").repartition(5)


def prose(n):
    return " ".join(f"w{RNG.randrange(3000)}" for _ in range(n))


LONG = prose(30_000)
ROWS = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, " a b"), (4, " a b"), (5, None), (6, ""), (7, "  "), (8, "\n"), (None, "a b"), (None, "zz"), (None, "zz"),
        (9, LONG), (10, LONG.replace(" ", "\n")), (11, LONG + "!"), (12, "é\xa0b"), (13, "é b"), (14, prose(400)), (15, "ÉA b")]


def test_exact_dedup(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, ROWS)).collect()), key=str)
    want = []
    for i, t in ROWS:
        n = SPACES.sub(" ", t or "")
        same = [j for j, u in ROWS if SPACES.sub(" ", u or "") == n]
        keep = min((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    docs = frame(spark, ROWS)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((w[0] for w in want if w[3]), key=str)
    assert exact_dedup.exact_dedup(docs.filter("false")).count() == 0


def test_chunks_follow_content():
    data = exact_dedup.normalise(LONG.encode())
    cut = exact_dedup.chunks(data)
    assert b"".join(cut) == data and max(map(len, cut)) <= exact_dedup.MAX_CHUNK
    shifted = exact_dedup.chunks(b"some other start " + data)
    assert len(set(cut) & set(shifted)) > len(cut) // 2


def test_identifiers_that_meet_are_renamed(spark):
    weak = lambda chunk, seed: bytes([sum(chunk) % 2]) if seed == 0 else xxhash.xxh3_128_digest(chunk, seed)
    docs = frame(spark, [(1, "a"), (2, "c"), (3, "a")])
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs, weak).collect()} == {(1, 1), (2, 2), (3, 1)}


def fingerprint(text, width=3):
    data = (text or "").encode()
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    shingles = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def linked(ids, near):
    """Smallest id of each one's component, by flooding."""
    label = list(range(len(ids)))
    change = True
    while change:
        change = False
        for a, b in near:
            low = min(label[a], label[b])
            change |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_simhash(spark):
    base = prose(900).split()
    rows = ROWS + [(100 + i, " ".join(base[:i * 5] + ["changed"] + base[i * 5 + 1:])) for i in range(40)]
    fps = [fingerprint(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, linked([i for i, _ in rows], near), strict=True)]
    got = [tuple(r) for r in simhash_dedup.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash_dedup.near_duplicates(frame(spark, rows).filter("false")).count() == 0


def test_links_of_dense_and_sparse_fingerprints(spark):
    start = RNG.getrandbits(64)
    fps = {start}
    for _ in range(400):
        fps.add(RNG.choice(sorted(fps)) ^ 1 << RNG.randrange(64) ^ (1 << RNG.randrange(64)) * RNG.randrange(3))
    fps = sorted({f & (1 << 64) - 1 for f in fps} | {RNG.getrandbits(64) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = linked(signed, near)
    roots = {r.node: r.root for r in components.components(simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    assert [roots.get(f, f) for f in signed] == want


def test_forest_finds_all_within_any_radius():
    fp = np.unique(np.array([RNG.getrandbits(10) for _ in range(300)], dtype=np.uint64))
    shard = np.sort(np.array([RNG.randrange(3) for _ in fp]))
    forest = simhash_dedup.Forest(fp, shard)
    for radius in (0, 1, 2, 5, 64):
        found = sorted((int(a), int(b)) for x, y in forest.search(radius) for a, b in zip(x, y, strict=True))
        assert found == [(a, b) for a in range(len(fp)) for b in range(len(fp))
                         if a != b and shard[a] == shard[b] and (int(fp[a]) ^ int(fp[b])).bit_count() <= radius]


def test_similar_groups(spark):
    base = [prose(300).split() for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:20]):
        for k in range(3):
            edits = dict.fromkeys(RNG.sample(range(10, 290), 5), "edit")
            rows.append((100 + 3 * i + k, " ".join(edits.get(j, x) + str(k) if j in edits else x for j, x in enumerate(w))))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (5, rows[5][1])]
    docs = frame(spark, rows)
    got = {r.doc_id: r.group_id for r in simhash_dedup.similar_groups(docs).collect()}
    assert got == {100 + 3 * i + k: i for i in range(20) for k in range(3)}
    left = simhash_dedup.without_near_copies(docs)
    # The 60 near copies, the copy without doc_id and the second row of document 5.
    assert left.columns == docs.columns and left.count() == len(rows) - 62


def test_components_of_long_paths(spark):
    rows = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000), (7, 5), (5, 7)] + [(2000, x) for x in range(2001, 2400)]
    RNG.shuffle(rows)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "node long, root long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{x: 2000 for x in range(2001, 2400)}}


def hits(docs, items, width=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    out = []
    for i, t in docs:
        w, hit, met = split(t), set(), set()
        for item, text in items:
            v = split(text)
            for s in range(max(1, len(v) - width + 1)) if v else []:
                win = v[s:s + width]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        met.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    words = lambda n: " ".join(RNG.choices(["aa", "Bb", "cc,", "d-d", "é", "9"], k=n))
    items = [(1, "aa bb"), (2, words(12)), (10, words(25)), (None, "unknown word"), (4, None), (5, "..."), (6, "é é é"), (2, "aa bb cc")]
    docs = [(i, words(60)) for i in range(40)] + [(50, items[2][1]), (51, "x " + items[1][1] + " x"), (51, None), (None, "AA, BB"), (52, ""), (53, "an unknown word")]
    index = positional_index.build_index(frame(spark, docs))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(hits(docs, items), key=str)
    assert sorted((tuple(r) for r in positional_index.contamination(index, table).collect()), key=str) == want
    sent = positional_index.blocks(table, size=3)  # many small blocks
    assert len(sent) > 5
    many = index.mapInArrow(positional_index._hits(sent, 10), positional_index.contamination(index, table).schema)
    assert sorted((tuple(r) for r in many.collect()), key=str) == want
    assert {r.n_hit for r in positional_index.contamination(index, table.filter("false")).collect()} == {0}
    assert positional_index.contamination(positional_index.build_index(frame(spark, docs).filter("false")), table).count() == 0


def test_phrase_and_proximity_matches(spark):
    docs = frame(spark, [(1, "the quick brown fox"), (2, "brown the very quick fox"), (3, "quick"), (4, "fox one two three four five brown quick")])
    index = positional_index.build_index(docs)
    items = spark.createDataFrame([(7, "quick brown")], "item_id long, text string")
    assert [tuple(r) for r in positional_index.matches(index, items).collect()] == [(1, "7", 1)]
    assert {(r.doc_id, r.item_id) for r in positional_index.matches(index, items, reach=3).collect()} == {(1, "7"), (2, "7"), (4, "7")}
    assert {r.doc_id for r in positional_index.matches(index, items, reach=1).collect()} == {1, 4}


def test_licences(spark):
    mit = license_scan.TEMPLATES["mit"]
    changed = mit.replace("Software", "SOFTWARE").replace("without restriction", "with no restriction")
    docs = [(1, mit), (2, "Intro.\n\n" + changed + "\n\nOutro " + prose(50)), (3, "x\nReleased under the MIT Licence.\ny"), (4, prose(300)), (5, None), (6, ""),
            (7, "license"), (3, "x\nReleased under the MIT Licence.\ny"), (None, "Licensed under CC BY-NC 4.0"), (8, license_scan.TEMPLATES["isc"])]
    got = sorted(((r.doc_id, r.licence) for r in license_scan.licence_scan(frame(spark, docs)).collect()), key=str)
    assert got == sorted([(1, "mit"), (2, "mit"), (3, "mit-notice"), (3, "mit-notice"), (4, None), (5, None), (6, None), (7, None), (None, "cc-by-nc-4.0-notice"), (8, "isc")], key=str)
    units = {(r.doc_id, r.scope, r.unit) for r in license_scan.licence_units(frame(spark, docs)).collect()}
    assert {(2, "paragraph", 1), (3, "line", 1), (1, "text", 0)} <= units and (2, "text", 0) not in units


def test_size_bounds_shut_out_no_template():
    for _ in range(300):
        templates = {f"t{k}": " ".join(RNG.choices("abcd", k=RNG.randrange(2, 12))) for k in range(6)}
        unit = license_scan.bigrams(license_scan.words(" ".join(RNG.choices("abcd", k=RNG.randrange(2, 12))).encode()))
        t = RNG.choice([0.5, 0.7, 0.9])
        sets = {n: license_scan.bigrams(license_scan.words(x.encode())) for n, x in templates.items()}
        scores = [(-2 * len(unit & b) / (len(unit) + len(b)), n) for n, b in sets.items() if b and 2 * len(unit & b) / (len(unit) + len(b)) >= t]
        assert license_scan.Matcher(templates, t).best(unit) == (lambda s: s and (-s[0], s[1]))(min(scores, default=None))


@pytest.fixture(scope="module")
def marked(spark):
    """Documents of a plain kind, a junk kind and a rude kind; some with labels."""
    rows, labels = [], []
    for i in range(900):
        kind = i % 3
        words = [f"w{RNG.randrange(400)}" for _ in range(RNG.randrange(30, 200))]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            words[RNG.randrange(len(words))] = words[RNG.randrange(len(words))] = RNG.choice(["rude", "nasty"])
        rows.append((i, " ".join(words), RNG.choice(["en", None]), f"s{i % 5}", 0, "x"))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    labels += [labels[0], (None, 1, 0), (3, None, 0), (10**6, 1, 0)]
    docs = spark.createDataFrame(rows + [(None, None, None, None, None, "x"), (5, "", "en", "s1", 0, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars int, score string")
    return docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_near_copies_go_by_row_and_not_by_id(spark):
    """An unrelated row that shares its doc_id with a near copy stays; rows without doc_id are compared too; columns may have any name."""
    one, two = prose(200), prose(200)
    rows = [(3, one), (7, one + " more"), (7, prose(200)), (None, two), (None, two + " more"), (None, prose(200)), (8, "")]
    docs = spark.createDataFrame([(i, t, k, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, number int, row int, at int").repartition(3)
    assert sorted(r.number for r in simhash_dedup.without_near_copies(docs).collect() if r.number not in (3, 4)) == [0, 2, 5, 6]
    assert len({r.number for r in simhash_dedup.without_near_copies(docs).collect()} & {3, 4}) == 1


def test_exact_copies_of_rows_with_any_columns(spark):
    docs = spark.createDataFrame([(2, "a b", 1, 1), (1, "a  b", 2, 2), (None, "c", 3, 3)], "doc_id long, text string, _id int, _sha int")
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns and sorted(r._id for r in left.collect()) == [2, 3]


def test_cotraining_on_documents_without_labels(spark, marked):
    docs, labels = marked
    model = cotraining.train(docs, labels)
    got = {r.doc_id: r.good for r in cotraining.score(docs.filter("length(text) > 0"), model).collect()}
    assert set(got) == set(range(900))
    right = [got[i] == (i % 3 == 0) for i in range(0, 900, 2)]
    assert sum(right) >= 0.97 * len(right)
    left = cotraining.keep_good(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} - {None, 5} == {i for i, good in got.items() if good} - {5}


def test_cotraining_without_labels(spark, marked):
    docs, labels = marked
    for given in (labels.filter("false"), labels.filter("quality = 1 AND toxic = 0")):
        assert {(r.score, r.good) for r in cotraining.score(docs, cotraining.train(docs, given)).collect()} == {(1.0, True)}
    none = docs.filter("false")
    assert cotraining.score(none, cotraining.train(none, labels)).count() == 0
