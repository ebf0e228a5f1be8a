"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: a segment holds the postings (ordered word positions by term) of about SEGMENT_WORDS words of
consecutive documents and is stored as one row in the shared folder. Test phrases come to the segments in blocks of bounded
size. In a segment, a phrase with a term that has no postings is out; otherwise the postings of its rarest term, less the
term's offset, are the candidate places, and the lists of the other terms, rarest first, are intersected with them.

Words: A-Z lower-cased, runs of ASCII letters, digits and bytes above 0x7F. A null text has no words. An item without words has
no phrases; items of one item_id count as one, a null item_id is listed as an empty string. Documents are passed through row by
row, with null or repeated doc_id. Empty tables give empty results or no hits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.llm.common import LOWER, slices, texts, written

WINDOW = 10
SEGMENT_BYTES = 6 << 20
BLOCK_WINDOWS = 1 << 16
_INNER = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_TABLE = LOWER.translate(_INNER)
_INDEX = "doc_ids array<long>, lengths binary, terms binary, term_ends binary, starts binary, positions binary"


def words(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


@dataclass
class Segment:
    """Postings of some documents. positions: places of every term's words, term after term, ascending; a document starts one
    place after the end of the one before, so that no phrase runs across."""

    doc_ids: list
    lengths: np.ndarray
    terms: pa.Array
    starts: np.ndarray
    positions: np.ndarray

    def __post_init__(self) -> None:
        self.bases = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1].astype(np.int64)
        self.size = int((self.lengths + 1).sum())
        self.key = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)) * self.size + self.positions

    @classmethod
    def build(cls, doc_ids: list, datas: list[bytes]) -> Segment:
        split = [words(x) for x in datas]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode()
        term = coded.indices.to_numpy().astype(np.int64)
        place = np.arange(len(term)) + np.repeat(np.arange(len(split)), lengths)
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))])
        return cls(doc_ids, lengths, coded.dictionary, starts, place[order])

    def pack(self) -> list:
        terms = self.terms.to_pylist()
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        return [self.doc_ids, self.lengths.astype("<i4").tobytes(), b"".join(terms), ends.astype("<i4").tobytes(),
                self.starts.astype("<i4").tobytes(), self.positions.astype("<i4").tobytes()]

    @classmethod
    def unpack(cls, row: list) -> Segment:
        doc_ids, lengths, terms, ends, starts, positions = row
        i4 = [np.frombuffer(x, "<i4").astype(np.int64) for x in (lengths, ends, starts, positions)]
        offsets = pa.py_buffer(np.concatenate([[0], i4[1]]).astype("<i4").tobytes())
        array = pa.Array.from_buffers(pa.binary(), len(i4[1]), [None, offsets, pa.py_buffer(terms)])
        return cls(doc_ids, i4[0], array, i4[2], i4[3])

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether ``term`` stands at ``place``."""
        wanted = term * self.size + place
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return (self.key[at] == wanted) & (place >= 0) & (place < self.size)

    def documents(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, place, side="right") - 1


@dataclass
class Block:
    """Phrases of equal form: terms are numbers into ``vocabulary`` by offset, -1 past the end of a shorter phrase."""

    vocabulary: pa.Array
    terms: np.ndarray
    items: list

    def candidates(self, segment: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every phrase whose terms all have postings here: its number, terms, their order from the rarest, list sizes."""
        here = pc.index_in(self.vocabulary, value_set=segment.terms)
        known = np.append(np.where(here.is_valid().to_numpy(zero_copy_only=False), here.fill_null(-1).to_numpy(zero_copy_only=False), -2), -1)
        terms = known[self.terms].astype(np.int64)
        phrase = np.flatnonzero((terms != -2).all(axis=1))
        terms = terms[phrase]
        counts = np.where(terms >= 0, np.diff(segment.starts)[terms] if len(segment.terms) else 0, np.iinfo(np.int64).max)
        return phrase, terms, np.argsort(counts, axis=1, kind="stable"), counts

    def phrases(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches: phrase numbers and the places where they start."""
        phrase, terms, order, counts = self.candidates(segment)
        if not len(phrase):
            return phrase, phrase
        row = np.arange(len(phrase))
        rarest = order[:, 0]
        owner, place = _postings(segment, terms[row, rarest], counts[row, rarest])
        place = place - rarest[owner]
        for k in range(1, terms.shape[1]):
            offset = order[owner, k]
            term = terms[owner, offset]
            ok = term < 0
            ok[~ok] = segment.holds(term[~ok], (place + offset)[~ok])
            owner, place = owner[ok], place[ok]
        return phrase[owner], place

    def near(self, segment: Segment, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Proximity matches: all terms of the phrase within ``reach`` places of a posting of its rarest term, in one document."""
        phrase, terms, order, counts = self.candidates(segment)
        if not len(phrase):
            return phrase, phrase
        row = np.arange(len(phrase))
        owner, place = _postings(segment, terms[row, order[:, 0]], counts[row, order[:, 0]])
        ends = segment.bases + segment.lengths
        for k in range(1, terms.shape[1]):
            term = terms[owner, order[owner, k]]
            ok = term < 0
            left, right = ~ok, segment.documents(place)
            low = np.maximum(place - reach, segment.bases[right])[left]
            high = np.minimum(place + reach, ends[right] - 1)[left]
            first = np.searchsorted(segment.key, term[left] * segment.size + low)
            last = np.searchsorted(segment.key, term[left] * segment.size + high, side="right")
            ok[left] = last > first
            owner, place = owner[ok], place[ok]
        return phrase[owner], place


def _postings(segment: Segment, term: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of every given term, with the number of the row that asks for it."""
    owner = np.repeat(np.arange(len(term)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, segment.positions[np.repeat(segment.starts[term], counts) + within]


def build_index(docs: DataFrame) -> DataFrame:
    """Segments in the shared folder, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SEGMENT_BYTES):
            packed = Segment.build(batch.column("doc_id").to_pylist(), texts(batch)).pack()
            yield pa.RecordBatch.from_arrays([pa.array([packed[0]], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in packed[1:]]],
                                             ["doc_ids", "lengths", "terms", "term_ends", "starts", "positions"])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(plain.mapInArrow(run, _INDEX), "index")


def _windows(given: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if not given:
        return []
    return [tuple(given[i:i + width]) for i in range(max(1, len(given) - width + 1))]


def blocks(items: DataFrame, width: int = WINDOW, size: int = BLOCK_WINDOWS) -> list[Broadcast]:
    """The phrases of ``items`` (item_id, text) in broadcast blocks of at most ``size`` phrases; the driver holds one at a time."""
    sc, out, held = items.sparkSession.sparkContext, [], {}

    def send() -> None:
        pairs = list(held)
        vocabulary = list(dict.fromkeys(w for _, p in pairs for w in p))
        number = {w: i for i, w in enumerate(vocabulary)}
        terms = np.full((len(pairs), width), len(vocabulary), dtype=np.int64)
        for i, (_, p) in enumerate(pairs):
            terms[i, :len(p)] = [number[w] for w in p]
        out.append(sc.broadcast(Block(pa.array(vocabulary, pa.binary()), terms, [x for x, _ in pairs])))
        held.clear()

    for row in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        for window in _windows(words((row.text or "").encode()), width):
            held[row.item_id or "", window] = None
            if len(held) == size:
                send()
    if held:
        send()
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment.unpack([batch.column("doc_ids")[i].as_py(), *[memoryview(batch.column(c)[i].as_buffer()) for c in range(1, 6)]])


def _hits(sent: list[Broadcast], width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            change = np.zeros(segment.size + 1, dtype=np.int64)
            items: list[set[str]] = [set() for _ in segment.doc_ids]
            for block in (b.value for b in sent):
                phrase, place = block.phrases(segment)
                long = (block.terms[phrase] < len(block.vocabulary)).sum(axis=1)
                np.add.at(change, place, 1)
                np.add.at(change, place + long, -1)
                for d, p in set(zip(segment.documents(place).tolist(), phrase.tolist(), strict=True)):
                    items[d].add(block.items[p])
            upto = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
            hit = upto[segment.bases + segment.lengths] - upto[segment.bases]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids, pa.int64()), pa.array(segment.lengths, pa.int64()), pa.array(hit, pa.int64()),
                 pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()), pa.array(hit > 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    return run


def contamination(index: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document of the index."""
    return index.mapInArrow(_hits(blocks(items, width), width),
                            "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def matches(index: DataFrame, items: DataFrame, width: int = WINDOW, reach: int | None = None) -> DataFrame:
    """doc_id, item_id, position (word number in the document): exact places of the items' phrases, or with ``reach`` the places
    of their rarest term that have all other terms within ``reach`` words."""
    sent = blocks(items, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            for block in (b.value for b in sent):
                phrase, place = block.phrases(segment) if reach is None else block.near(segment, reach)
                doc = segment.documents(place)
                yield pa.RecordBatch.from_arrays([pa.array([segment.doc_ids[d] for d in doc.tolist()], pa.int64()),
                                                  pa.array([block.items[p] for p in phrase.tolist()], pa.string()),
                                                  pa.array(place - segment.bases[doc], pa.int64())], ["doc_id", "item_id", "position"])
    return index.mapInArrow(run, "doc_id long, item_id string, position long").distinct()


#: DuckDB twin of the registered query.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
m AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, p)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
