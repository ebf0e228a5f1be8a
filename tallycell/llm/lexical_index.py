"""Ranked lexical search over a length-stratified index.

A document's score for a term depends on the document only through tf and the normaliser m, and m only on its length. So each
segment (the documents of about SEGMENT_BYTES of text) groups its documents by equal m. A term's postings are runs: stratum m, tf
(highest first), and the documents of the stratum with this tf; the impact is computed once for a run. A query first adds up, for
every stratum, the impact of each term's first run there: no document of the stratum scores more. Strata are visited from the
highest bound on, until it is below the k-th best score so far; that score is carried from segment to segment in a task.

Two passes over the texts: one counts N and L, from which m follows, one writes the index. A search takes the items in blocks of
at most BLOCK_ENTRIES (item, term) pairs; only the postings of a block's terms are read, and they are sent to one task for each
segment. A task returns at most k documents for an item, so what meets in the last ranking is small. Results are exact.

Nulls: a null text has no words, an item without words no results. Rows without doc_id count in N, L and df and can be results;
they come last among equal scores. Each row is a document: repeated ids are ranked as separate rows. Equal scores go by doc_id.
Texts are read whole; one text is never split over segments. Empty tables give empty results. An item_id that repeats is one item
with the words of all its rows; rows with a null item_id are one item. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycell.llm.common import SLICE_BYTES, slices, written

SEGMENT_BYTES = 16 << 20
BLOCK_ENTRIES = 1 << 18
TOP = 10
#: Stands for "no doc_id" inside the index: the largest number, so that it comes last.
NO_ID = (1 << 63) - 1

#: Bytes of terms in lower case, zero for all others.
_TERM = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


class Statistics(NamedTuple):
    documents: int
    terms: int

    def normaliser(self, n: np.ndarray) -> np.ndarray:
        return 25 + (75 * n.astype(np.int64) * self.documents) // max(self.terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf, m = tf.astype(np.int64), m.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a text column: its bytes as term bytes, starts and ends of the terms in them, and the row of each term."""
    data = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lowered = _TERM[raw]
    inside = lowered != 0
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    first = inside & ~np.concatenate([[False], inside[:-1]])
    first |= inside & border[:-1]
    last = inside & ~np.concatenate([inside[1:], [False]])
    last |= inside & border[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    # searchsorted on the right skips empty rows, which begin where the next one does.
    return lowered, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of a text column in order, as a dictionary array, and the row of each."""
    lowered, starts, ends, row = _bounds(column)
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(lowered[lowered != 0]))
    return flat.dictionary_encode(), row


def statistics(docs: DataFrame) -> Statistics:
    """N and L over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in slices(batches):
            row = _bounds(batch.column("text"))[3]
            documents += len(np.unique(row))
            terms += len(row)
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "documents long, terms long").agg(
        F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return Statistics(*found)


def _segment(number: int, batches: list[pa.RecordBatch], stats: Statistics) -> Iterator[pa.RecordBatch]:
    """Index rows of one segment: its documents' ids first (the row without a term), then a row for each term."""
    whole = pa.Table.from_batches(batches).combine_chunks()
    ids = whole.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy() if whole.num_rows else np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    terms, row = terms_of(whole.column("text").combine_chunks())
    code = terms.indices.to_numpy().astype(np.int64)
    n = np.bincount(row, minlength=len(ids))
    m = stats.normaliser(n)
    # One number for each (term, document); the runs of equal numbers are the tf.
    both, tf = np.unique(code * max(len(ids), 1) + row, return_counts=True)
    code, row = both // max(len(ids), 1), both % max(len(ids), 1)
    by = np.lexsort((place[row], -tf, m[row], code))
    code, tf, m, doc = code[by], tf[by], m[row[by]], place[row[by]]
    new_term = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
    new_run = new_term.copy()
    new_run[1:] |= (m[1:] != m[:-1]) | (tf[1:] != tf[:-1])
    runs = np.flatnonzero(new_run)
    lengths = np.diff(np.append(runs, len(code)))
    term_at, term_runs = np.flatnonzero(new_term), np.flatnonzero(new_term[runs])
    names = terms.dictionary.take(pa.array(code[term_at])).cast(pa.string())
    k = len(term_at)
    doc_cuts = pa.array(np.append(term_at, len(code)), pa.int32())
    run_cuts = pa.array(np.append(term_runs, len(runs)), pa.int32())

    def lists(cuts: pa.Array, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(cuts, pa.array(values, pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([ids[order].tolist()], pa.list_(pa.int64())),
                                      *[pa.array([[]], pa.list_(pa.int32()))] * 4], _COLUMNS)
    table = pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, number), pa.int64()), names, pa.nulls(k, pa.list_(pa.int64())), lists(run_cuts, m[runs]), lists(run_cuts, tf[runs]),
         lists(run_cuts, lengths), lists(doc_cuts, doc)], _COLUMNS)
    for at in range(0, k, 4096):
        yield table.slice(at, 4096)


_COLUMNS = ["segment", "term", "ids", "m", "tf", "length", "docs"]
_INDEX = "segment long, term string, ids array<long>, m array<int>, tf array<int>, length array<int>, docs array<int>"


def build_index(docs: DataFrame, stats: Statistics | None = None, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, Statistics]:
    """The written index of all documents. A row for each segment and term: runs of (m, tf, length), and the documents of the runs one
    after the other, as places in the segment's ``ids`` (its row without a term)."""
    stats = stats or statistics(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, None
        for batch in slices(batches, limit=min(SLICE_BYTES, segment_bytes)):
            if number is None:
                number = batch.column("_row")[0].as_py()
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= segment_bytes:
                yield from _segment(number, held, stats)
                held, size, number = [], 0, None
        if held:
            yield from _segment(number, held, stats)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    return written(plain.mapInArrow(run, _INDEX), "lexical-index"), stats


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: the words of every item with repeats counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms, row = terms_of(batch.column("text"))
            width = max(len(terms.dictionary), 1)
            both, times = np.unique(row.astype(np.int64) * width + terms.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(both // width)), terms.dictionary.take(pa.array(both % width)).cast(pa.string()),
                                              pa.array(times, pa.int64())], ["item_id", "term", "times"])
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Query(NamedTuple):
    item: int | None
    terms: list[str]
    weights: np.ndarray


class Best:
    """The k best documents of an item so far; of equal scores the one with the smaller id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for score, doc in zip(scores.tolist(), ids.tolist(), strict=True):
            entry = (score, -doc)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


class Segment:
    """The postings of some terms over one segment's documents."""

    def __init__(self, ids: np.ndarray, rows: dict[str, tuple[np.ndarray, ...]]):
        self.ids = ids
        self.strata = np.unique(np.concatenate([x[0] for x in rows.values()])) if rows else np.zeros(0, np.int32)
        self.terms = {}
        for term, (m, tf, length, docs) in rows.items():
            worth = impact(tf, m)
            first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))  # the highest tf of each stratum
            starts = np.append(np.cumsum(length) - length, len(docs))
            self.terms[term] = (np.searchsorted(self.strata, m[first]), worth[first], starts[np.append(first, len(m))], np.repeat(worth, length), docs)

    def search(self, query: Query, best: Best) -> None:
        found = [(self.terms[t], w) for t, w in zip(query.terms, query.weights.tolist(), strict=True) if w and t in self.terms]
        if not found:
            return
        bound = np.zeros(len(self.strata), np.int64)
        for (stratum, worth, _, _, _), w in found:
            bound[stratum] += worth * w
        order = np.argsort(-bound, kind="stable")
        at, width = 0, 1
        sums = np.zeros(len(self.ids), np.int64)
        while at < len(order):
            least = best.least()
            stop = at + int(np.searchsorted(-bound[order[at:at + width]], -least, side="right"))
            if stop == at:
                return
            visit = np.zeros(len(self.strata), bool)
            visit[order[at:stop]] = True
            touched = []
            for (stratum, _, cuts, worth, docs), w in found:
                here = np.flatnonzero(visit[stratum])
                if not len(here):
                    continue
                a, size = cuts[here], cuts[here + 1] - cuts[here]
                ends = np.cumsum(size)
                take = np.arange(ends[-1]) + np.repeat(a - ends + size, size)
                sums[docs[take]] += worth[take] * w  # a term names a document once
                touched.append(docs[take])
            seen = np.unique(np.concatenate(touched))
            scores = sums[seen]
            sums[seen] = 0
            good = scores >= least
            seen, scores = seen[good], scores[good]
            if len(seen) > best.k:  # by score, then by place: places follow the ids
                top = np.lexsort((seen, -scores))[:best.k]
                seen, scores = seen[top], scores[top]
            best.add(scores, self.ids[seen])
            if stop < at + width and stop < len(order):
                return
            at, width = stop, width * 2
        return


def _searched(queries: list[Query], k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]

        def finish(ids: np.ndarray | None, rows: dict) -> None:
            if ids is not None and rows:
                segment = Segment(ids, rows)
                for query, own in zip(queries, best, strict=True):
                    segment.search(query, own)
        number, ids, rows = None, None, {}
        for batch in batches:
            segments, terms, lists = batch.column("segment").to_pylist(), batch.column("term").to_pylist(), [batch.column(c) for c in _COLUMNS[2:]]
            for i, (segment, term) in enumerate(zip(segments, terms, strict=True)):
                if segment != number:
                    finish(ids, rows)
                    number, ids, rows = segment, None, {}
                if term is None:
                    ids = np.array(lists[0][i].values)
                else:
                    rows[term] = tuple(np.array(x[i].values) for x in lists[1:])
        finish(ids, rows)
        out = [(q, score, doc) for q, own in enumerate(best) for score, doc in own.heap]
        if out:
            item, score, doc = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([queries[q].item for q in item], pa.int64()), pa.array([None if -d == NO_ID else -d for d in doc], pa.int64()),
                                              pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])
    return run


def weighted(index: DataFrame, stats: Statistics, items: DataFrame) -> DataFrame:
    """item_id, term, weight: times a term's weight by its count of documents in the whole index; terms that no document has are out."""
    terms = item_terms(items)
    df = (index.filter("term IS NOT NULL").select("term", F.size("docs").alias("_n")).join(terms.select("term").distinct(), "term", "left_semi")
          .groupBy("term").agg(F.sum("_n").alias("df")))
    weight = F.floor(1000 * F.log(F.lit(float(2 * stats.documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return terms.join(df, "term").select("item_id", "term", (F.col("times") * weight).alias("weight"))


def blocks(entries: DataFrame, limit: int = BLOCK_ENTRIES) -> tuple[DataFrame, list[int]]:
    """``entries`` with their block, and the blocks' numbers: whole items, together at most ``limit`` entries (or one larger item).

    Items are hashed to blocks; a block that came out too large is halved by another hash until it fits.
    """
    count = -(-2 * entries.count() // limit) if limit else 1
    placed = entries.withColumn("block", F.pmod(F.xxhash64(F.lit(0), "item_id"), F.lit(max(1, count))))
    for seed in range(1, 48):
        placed = written(placed, "lexical-entries")
        sizes = placed.groupBy("block").agg(
            F.count("*").alias("n"), (F.countDistinct("item_id") + F.max(F.col("item_id").isNull().cast("int")) > 1).alias("more")).collect()
        large = [r.block for r in sizes if r.n > limit and r.more]
        if not large:
            break
        half = F.when(F.col("block").isin(large), F.pmod(F.xxhash64(F.lit(seed), "item_id"), F.lit(2))).otherwise(0)
        placed = placed.withColumn("block", F.col("block") * 2 + half)
    return placed, sorted(r.block for r in sizes)


def search(index: DataFrame, stats: Statistics, items: DataFrame, k: int = TOP, limit: int = BLOCK_ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 of every item, equal scores by doc_id."""
    entries, numbers = blocks(weighted(index, stats, items), limit)
    found = index.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in numbers:
        mine = entries.filter(F.col("block") == block)
        queries: dict[int | None, list[tuple[str, int]]] = {}
        for r in mine.select("item_id", "term", "weight").collect():
            queries.setdefault(r[0], []).append((r[1], r[2]))
        packed = [Query(item, [t for t, _ in own], np.array([w for _, w in own], np.int64)) for item, own in queries.items()]
        own = index.join(mine.select("term").distinct(), "term", "left_semi").unionByName(index.filter("term IS NULL")).select(_COLUMNS)
        part = own.repartition("segment").sortWithinPartitions("segment").mapInArrow(_searched(packed, k), "item_id long, doc_id long, score long")
        found = found.unionByName(written(part, "lexical-found"))
    ranks = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``search`` over an index of ``docs``."""
    index, stats = build_index(docs)
    return search(index, stats, items, k)


#: DuckDB twin of the registered query.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
