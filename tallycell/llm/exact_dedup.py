"""Exact de-duplication by content-defined chunk recipes.

Every normalised text is cut where a rolling hash of its own bytes says so; a text becomes the ordered list of its chunks'
identifiers. An identifier is a 128-bit hash that is verified: the distinct contents under it are compared, each distinct
chunk travelling once per task; should two contents meet, all chunks are named anew under another seed. Texts are equal exactly
when their lists are, so long documents are compared by short lists and never moved themselves.

Nulls: a null text is empty. Rows without doc_id lose to any row with one; rows of one doc_id and one text count as one
document (all stay or go together). Empty tables give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.llm.common import attach, scratch, slices, texts, written

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 1 << 10, 12, 1 << 14
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], dtype=np.uint32)


def normalise(data: bytes) -> bytes:
    """Each run of ASCII white space becomes one space, at the ends too."""
    if not data:
        return data
    body = b" ".join(data.split())
    if not body:
        return b" "
    return b" " * data[:1].isspace() + body + b" " * data[-1:].isspace()


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: where the hash of the last 32 bytes has MEAN_BITS high zero bits, within the size limits."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
    ends, start = [], 0
    for i in (np.flatnonzero(h < np.uint32(1 << (32 - MEAN_BITS))) + 1).tolist():
        while i - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if i - start >= MIN_CHUNK:
            ends.append(i)
            start = i
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    return [*ends, n] if start < n else ends


def chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in cut_points(data):
        out.append(data[start:end])
        start = end
    return out


def identifier(chunk: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)


def _recipes(identify: Callable[[bytes, int], bytes], seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            normal = [normalise(x) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([[identify(c, seed) for c in chunks(x)] for x in normal], pa.list_(pa.binary())),
                 pa.array([hashlib.sha256(x).hexdigest() for x in normal], pa.string())], ["doc_id", "recipe", "text_sha256"])
    return run


def _contents(identify: Callable[[bytes, int], bytes], seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = {c for x in texts(batch) for c in chunks(normalise(x))}
            yield pa.RecordBatch.from_arrays([pa.array([identify(c, seed) for c in found], pa.binary()),
                                              pa.array(list(found), pa.binary())], ["chunk", "content"])
    return run


def contents(docs: DataFrame, identify: Callable[[bytes, int], bytes] = identifier, seed: int = 0) -> DataFrame:
    """chunk (identifier), content: every distinct chunk once; partial de-duplication runs before the shuffle."""
    return (docs.select("text").mapInArrow(_contents(identify, seed), "chunk binary, content binary")
            .dropDuplicates(["chunk", "content"]))


def recipes(docs: DataFrame, identify: Callable[[bytes, int], bytes] = identifier) -> DataFrame:
    """doc_id, recipe (ordered verified identifiers), text_sha256 of the normalised text; one row per row of ``docs``.

    Verification compares contents byte by byte; should two contents share an identifier, all get new ones under the next seed.
    """
    docs, seed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), 0
    while not contents(docs, identify, seed).groupBy("chunk").count().filter("count > 1").isEmpty():
        seed += 1
    return written(docs.mapInArrow(_recipes(identify, seed), "doc_id long, recipe array<binary>, text_sha256 string"), "recipes")


def exact_dedup(docs: DataFrame, identify: Callable[[bytes, int], bytes] = identifier) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    made = recipes(docs, identify)
    groups = (made.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .filter("group_size > 1"))
    joined = attach(made, groups, ["recipe"], ["doc_id"])
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay. The texts are not moved: short keys of the rows that go are, and of the tables
    made on the way only these stay."""
    with scratch(docs.sparkSession) as keep:
        gone = keep(exact_dedup(docs).filter("not kept").select("doc_id", "text_sha256").distinct(), "copies")
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256)
    # Each side in one column of its own: no column of ``docs`` can clash.
    rows, keys = docs.select(F.struct("*").alias("row")), gone.select(F.struct("*").alias("key"))
    return (rows.join(keys, F.col("row.doc_id").cast("long").eqNullSafe(F.col("key.doc_id")) & (sha == F.col("key.text_sha256")), "left_anti")
            .select("row.*"))


#: DuckDB twin of the registered query.
SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
