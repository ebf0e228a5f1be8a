"""Near-duplicates by SimHash and BK-trees.

Fingerprints that differ in at most two bits agree in six of eight bytes at least. So each of the 28 choices of six bytes deals
the distinct fingerprints into shards that agree there; the other 16 bits leave at most 65,536 fingerprints to a shard, which
bounds every tree, however alike the texts are. A shard's BK-tree keys every child by its Hamming distance to the parent;
each of the shard's fingerprints follows only the edges within the radius of its own distance. The trees of all shards together
grow with the corpus and have no bound, so they aren't broadcast from the driver: a shuffle brings each shard to the task that
builds its tree. A shard gives a spanning star of each linked set, not its pairs; alternating stars then join the shards.

Documents alike by shingles (similar_groups): edits that leave a Jaccard similarity of 0.8 on five-word shingles move a shingle
fingerprint by ten bits or so, too far for any index. PRINTS fingerprints of the distinct words move about half as far under
scattered edits; through the same trees they propose pairs cheaply, but no more than a few to a document, and they miss about half
of the pairs that differ by an appended or cut block of a fifth. So nothing rests on them: an exact join finds what they leave. Of n
distinct shingles the first n - ceil(0.8 n) + 1 in any order common to all documents hold one of every document alike at 0.8; the
order is by how many documents have a shingle (counted in SKETCH buckets; collisions cost time, not results), then by hash. The
documents that share such a shingle are compared to the smallest and largest of them, then all pairs that are not yet joined by
checked links, within the size bounds and with enough left in the order from that shingle on, in cells of about BLOCK by BLOCK
documents, so a common shingle is dealt to many tasks. All pairs proposed are compared by their whole shingle sets; none is missed
and nothing dissimilar is ever linked.

Nulls: a null or empty text has fingerprint zero. Rows without doc_id take the component of their fingerprint, whose id is the
smallest doc_id in it that isn't null. Repeated rows are repeated in the result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycell.llm.common import attach, LOWER, scratch, slices, texts, written
from tallycell.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
BLOCKS = 8
WORDS, SIMILARITY = 5, 0.8
PRINTS, REACH = 4, (5, 7)  # fingerprints a document; radius and blocks of their trees
FRONTIER = 1 << 20
TREE = 1 << 12  # fingerprints to a tree that only proposes
SKETCH, BLOCK = 1 << 20, 64  # buckets that count shingles; documents to a side of a cell of pairs


def shingle_hashes(data: bytes, width: int) -> list[int]:
    """XXH64 of every run of ``width`` words, of the whole sequence if there are fewer, of nothing if there are none."""
    words = data.translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per group of ``sizes`` hashes: the bits that are set in over half of them; zero for an empty group."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_hashes(x, width) for x in texts(batch)]
            sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(majority(flat, sizes).view(np.int64))], ["doc_id", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long")


class Forest:
    """A BK-tree per shard. fp: distinct fingerprints, shard after shard; shard: the number of the shard of each."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        n = len(fp)
        self.fp = fp
        first = np.concatenate([[True], shard[1:] != shard[:-1]])
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        edge = np.full(n, -1)
        rest = np.flatnonzero(~first)
        at = self.root[rest]
        while len(rest):  # one level of all trees at a time: of those that come to one edge, the first becomes the child
            code = at * 65 + np.bitwise_count(fp[rest] ^ fp[at])
            _, index, inverse = np.unique(code, return_index=True, return_inverse=True)
            child = rest[index][inverse]
            edge[rest[index]] = code[index]
            below = child != rest
            rest, at = rest[below], child[below]
        self.children = np.argsort(edge, kind="stable")[np.count_nonzero(edge < 0):]
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(edge[edge >= 0], minlength=n * 65))])

    def search(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, found) within ``radius``, every fingerprint asking its own tree."""
        pending = [(np.arange(len(self.fp)), self.root)]
        while pending:
            query, node = pending.pop()
            if len(query) > FRONTIER:
                pending.append((query[FRONTIER:], node[FRONTIER:]))
                query, node = query[:FRONTIER], node[:FRONTIER]
            d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            near = (d <= radius) & (query != node)
            yield query[near], node[near]
            low = self.upto[node * 65 + np.maximum(d - radius, 0)]
            counts = self.upto[node * 65 + np.minimum(d + radius, 64) + 1] - low
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            if len(within):
                pending.append((np.repeat(query, counts), self.children[np.repeat(low, counts) + within]))


def spanning_stars(forest: Forest, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest linked node) for every fingerprint of the forest that is linked to an earlier one."""
    label = np.arange(len(forest.fp))
    for a, b in forest.search(radius):
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def proposals(forest: Forest, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fingerprint with a link: its nearest neighbour, and the neighbour with the most links. Links are counted as they
    are found, and found again to choose by the counts, so they are never held together."""
    n = len(forest.fp)
    links, none = np.zeros(n, dtype=np.int64), np.iinfo(np.int64).max
    nearest, fullest = np.full(n, none), np.full(n, none)
    for a, b in forest.search(radius):
        links += np.bincount(a, minlength=n)
        np.minimum.at(nearest, a, np.bitwise_count(forest.fp[a] ^ forest.fp[b]).astype(np.int64) << 32 | b)
    for a, b in forest.search(radius):
        np.minimum.at(fullest, a, (n - links[b]) << 32 | b)
    linked = np.flatnonzero(links)
    return np.tile(linked, 2), np.concatenate([nearest[linked], fullest[linked]]) & (1 << 32) - 1


Choice = Callable[[Forest, int], tuple[np.ndarray, np.ndarray]]


def _shard_links(radius: int, choice: Choice) -> Callable:
    def links(fp: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        if choice is proposals:  # which need not span: no tree grows beyond TREE
            starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            within = np.arange(len(shard)) - np.repeat(starts, np.diff(np.append(starts, len(shard))))
            shard = np.cumsum((within % TREE == 0)) - 1
        _, number, size = np.unique(shard, return_inverse=True, return_counts=True)
        shared = size[number] > 1
        fp, number = fp[shared], number[shared]
        a, b = choice(Forest(fp.view(np.uint64), number), radius) if len(fp) else (np.zeros(0, int),) * 2
        return pa.RecordBatch.from_arrays([pa.array(fp[a], pa.int64()), pa.array(fp[b], pa.int64())], ["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
            rows = np.concatenate([*held, rows], axis=1)
            change = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            last = change[-1] if len(change) else 0  # the last shard may go on in the next batch
            held = [rows[:, last:]]
            if last:
                yield links(rows[2, :last].copy(), np.repeat(np.arange(len(change)), np.diff(np.concatenate([[0], change]))))
        if held:
            yield links(held[0][2].copy(), np.zeros(held[0].shape[1], dtype=np.int64))
    return run


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, choice: Choice = spanning_stars) -> DataFrame:
    """node, root: pairs of fingerprints ``fp`` at most ``radius`` bits apart, by default enough of them to span every set that is
    joined by such steps."""
    bounds = [64 * b // blocks for b in range(blocks + 1)]
    open_bits = [sum((1 << bounds[b + 1]) - (1 << bounds[b]) for b in chosen) for chosen in combinations(range(blocks), radius)]
    signed = [(m ^ (1 << 64) - 1) - (1 << 64) if (m ^ (1 << 64) - 1) >= 1 << 63 else m ^ (1 << 64) - 1 for m in open_bits]
    shards = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard"))
                                 for i, m in enumerate(signed)]))
    dealt = distinct.select(shards.alias("s"), "fp").select("s.choice", "s.shard", "fp")
    return (dealt.repartition("choice", "shard").sortWithinPartitions("choice", "shard", "fp")
            .mapInArrow(_shard_links(radius, choice), "node long, root long").distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    made = written(fingerprints(docs, width), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(distinct.select("fp"), radius))
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("members"))
    shared = attach(placed.select("fp", "root"), ids.filter("members > 1"), ["root"], ["fp"], "inner").select("fp", "component_id")
    joined = attach(made, shared, ["fp"], ["doc_id"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.coalesce("component_id", "doc_id").alias("component_id"))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PRINTS fingerprints of the distinct words of every text."""
    for batch in slices(batches):
        split = [x.translate(LOWER).split() for x in texts(batch)]
        coded = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed) for seed in range(PRINTS // 2) for w in vocabulary), "<u8").reshape(PRINTS // 2, -1, 2)
        doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
        pairs = np.unique(doc * max(1, len(vocabulary)) + coded.indices.to_numpy())
        doc, word = np.divmod(pairs, max(1, len(vocabulary)))
        sizes = np.bincount(doc, minlength=len(split))
        prints = [majority(digests[i, word, j], sizes).view(np.int64) for i in range(PRINTS // 2) for j in range(2)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in split], pa.int64()),
                                          pa.array(list(np.stack(prints, axis=1)), pa.list_(pa.int64()))], ["doc_id", "n_words", "prints"])


def _shingle_sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(np.array(shingle_hashes(x, width), dtype=np.uint64)).view(np.int64) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"])
    return run


def _bucket_counts(width: int) -> Callable:
    """bucket, n: the texts of a task that have a shingle of the bucket, one for each such shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SKETCH, dtype=np.int64)
        for batch in slices(batches):
            found = [np.unique(np.array(shingle_hashes(x, width), dtype=np.uint64)) for x in texts(batch)]
            n += np.bincount((np.concatenate(found) % SKETCH).astype(np.int64), minlength=SKETCH)
        used = np.flatnonzero(n)
        for i in range(0, len(used), 1 << 16):
            part = used[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["bucket", "n"])
    return run


def _prefixes(width: int, similarity: float, sent: Broadcast) -> Callable:
    """shingle, doc_id, size, left: the rarest shingles of every text, enough of them to meet any text alike; ``left`` counts the
    shingles from this one on in the common order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(np.array(shingle_hashes(x, width), dtype=np.uint64)) for x in texts(batch)]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            firsts = [x[np.lexsort((x, sent.value[(x % SKETCH).astype(np.int64)]))[:len(x) - ceil(similarity * len(x) - 1e-9) + 1]] for x in sets]
            each = np.array([len(x) for x in firsts], dtype=np.int64)
            ids = batch.column("doc_id").to_numpy()
            place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(ids, each)),
                                              pa.array(np.repeat(sizes, each)), pa.array(np.repeat(sizes, each) - place)], ["shingle", "doc_id", "size", "left"])
    return run


def shared_prefixes(plain: DataFrame, similarity: float, width: int) -> DataFrame:
    """shingle, doc_id, size, left: the rarest shingles of every document that are among those of another one."""
    counted = np.zeros(SKETCH, dtype=np.int64)
    found = plain.mapInArrow(_bucket_counts(width), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counted[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    sent = plain.sparkSession.sparkContext.broadcast(counted)
    made = written(plain.mapInArrow(_prefixes(width, similarity, sent), "shingle long, doc_id long, size long, left long"), "prefixes")
    shared = made.groupBy("shingle").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first != last")
    out = written(made.join(shared.select("shingle"), "shingle"), "shared")
    sent.destroy()
    return out


def _unjoined(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with their group's id and, per shingle whose documents are of several groups, the first and last and the number. Members
    that don't say what they have left count as having all."""
    members = members if "left" in members.columns else members.withColumn("left", F.col("size"))
    own = (members.join(roots.select(F.col("node").alias("doc_id"), F.col("root").alias("part")), "doc_id", "left")
           .withColumn("part", F.coalesce("part", "doc_id")))
    row = F.struct("doc_id", "size", "part", "left")
    several = own.groupBy("shingle").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.min("part").alias("low"), F.max("part").alias("high"),
                                         F.count("*").alias("n")).filter("low != high")
    return own.join(several.select("shingle", "first", "last", "n"), "shingle")


def _may_be_alike(x: str, y: str, similarity: float) -> Column:
    """Whether two documents that share a shingle can be alike, were it the first in the common order that they share. Alike ones have
    similarity / (1 + similarity) of both sizes in common, all of it from their first shared shingle on, so there both must have as
    many left. Pairs that fail here at a later shared shingle have passed at the first, which is in the prefixes of both."""
    fits = F.least(f"{x}size", f"{y}size") >= F.lit(similarity) * F.greatest(f"{x}size", f"{y}size") - 1e-9
    common = F.lit(similarity / (1 + similarity)) * (F.col(f"{x}size") + F.col(f"{y}size")) - 1e-9
    return fits & (F.least(f"{x}left", f"{y}left") >= common)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def star_pairs(members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a, b: every document and the smallest and largest that share a shingle with it, if their sizes allow the similarity."""
    met = _unjoined(members, roots).select("doc_id", "size", "part", "left", F.explode(F.array("first", "last")).alias("y"))
    return _pairs(met.filter((F.col("part") != F.col("y.part")) & _may_be_alike("", "y.", similarity)).select(F.col("doc_id").alias("a"), F.col("y.doc_id").alias("b")))


def cell_pairs(members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a, b: all documents that share a shingle, are of different groups and may be alike by their sizes and what they have left there."""
    last = F.ceil(F.col("n") / BLOCK).cast("int") - 1
    dealt = (_unjoined(members, roots).withColumn("own", F.pmod(F.xxhash64("doc_id"), last + 1).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), last)))
             .select("shingle", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "doc_id", "size", "part", "left"))
    x, y = dealt.alias("x"), dealt.alias("y")
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "i", "j")]).filter(
        (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.part") != F.col("y.part")) & _may_be_alike("x.", "y.", similarity)
        & ((F.col("x.i") == F.col("x.j")) | (F.col("x.own") != F.col("y.own"))))
    return _pairs(met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")))


def tree_pairs(plain: DataFrame) -> DataFrame:
    """a, b: the pairs that fingerprints of the distinct words propose, some of those alike."""
    made = written(plain.mapInArrow(_sketches, "doc_id long, n_words long, prints array<long>").filter("n_words > 0"), "sketches")
    proposed = None
    for i in range(PRINTS):
        own = made.select("doc_id", F.col("prints")[i].alias("fp"))
        first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
        same = attach(own, first, ["fp"], ["doc_id"], "inner").filter("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
        near = (links(first.select("fp"), *REACH, choice=proposals).join(first.select(F.col("fp").alias("node"), F.col("first").alias("a")), "node")
                .join(first.select(F.col("fp").alias("root"), F.col("first").alias("b")), "root").select("a", "b"))
        found = same.unionByName(near)
        proposed = found if proposed is None else proposed.unionByName(found)
    return _pairs(proposed)


def _alike(plain: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """node, root: those of the written ``pairs`` that are alike by their whole shingle sets."""
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = written(plain.join(asked, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
                   .mapInArrow(_shingle_sets(width), "doc_id long, shingles array<long>"), "shingles")
    # One row to a document on the right: a document in many pairs is split by Spark's own skew handling, without copies of its set.
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select(F.col("a").alias("node"), F.col("b").alias("root"))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """doc_id, group_id (smallest doc_id of the group) for every document that is linked to a smaller one. Documents without
    doc_id or words take no part; of several rows with one doc_id the one with the smallest text speaks for it."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    checked = written(tree_pairs(plain), "proposed")
    roots = components(_alike(plain, checked, similarity, width))
    members = shared_prefixes(plain, similarity, width)
    for propose in (star_pairs, cell_pairs):
        pairs = written(propose(members, roots, similarity).join(checked, ["a", "b"], "left_anti"), "proposed")
        roots = components(roots.unionByName(_alike(plain, pairs, similarity, width)))
        checked = checked.unionByName(pairs)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of similar documents the one with the smallest doc_id stays (of several such
    rows, the first as read; rows without doc_id come last). Every row is compared by its own text, also those without doc_id and
    those that share one. Of the tables made on the way the numbered rows and the numbers of those that go stay."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
        groups = similar_groups(rows.select(F.col("number").alias("doc_id"), "row.text"), similarity, width)
        members = groups.unionByName(groups.select(F.col("group_id").alias("doc_id"), "group_id").distinct())
        named = (members.withColumnRenamed("doc_id", "number").join(rows.select("number", F.col("row.doc_id").cast("long").alias("doc_id")), "number")
                 .withColumn("at", F.struct(F.col("doc_id").isNull(), "doc_id", "number")))
        firsts = named.groupBy("group_id").agg(F.min("at").alias("first"))
        gone = keep(attach(named, firsts, ["group_id"], ["number"], "inner").filter("number != first.number").select("number"), "near-copies")
    return rows.join(gone, "number", "left_anti").select("row.*")
