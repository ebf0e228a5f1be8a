"""Token ids in files of range asymmetric numeral systems, for decoding in parallel.

All files of a folder share one static frequency table, counted over every token and written beside them. A file is a row of
chunks of whole documents, then checkpoints: place, size, first token, counts and checksum of every chunk. A chunk names its
documents and holds their ids in blocks; a block is coded on its own by up to LANES interleaved states, so one numpy operation
moves all of them by a symbol. Any chunk can be read with the table and its checkpoint alone; a chunk or table that isn't what its
checksum says is an error.

Ids come from the tokenizers library: every piece of a text is encoded by it. Pieces end at white space and between an ASCII
letter and an ASCII digit or mark, where no pre-token of the vocabulary and no composed character can reach across; each distinct
piece is encoded once and its ids are gathered for all its places. Files are in ascending doc_id order: documents are sorted by
ranges, a task writes the files of its range under names of its own, and the written manifest alone says which files count.

Nulls: a null text is empty and has the end id alone. Rows without doc_id come first, rows of one doc_id follow each other by a
hash of their ids, then by the ids (equal rows are interchangeable). A document is in one chunk, whatever its length; its ids must
fit a task's memory, as its text does. Empty tables make no files and read as no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from string import ascii_uppercase
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallycell.llm.common import slices, written
from tallycell.llm.warc import place
from tallycell.session import checkpoint_folder

MAGIC = b"tokrans1"
LANES, BLOCK, CHUNK = 1024, 1 << 18, 1 << 18
FILE_BYTES = 128 << 20
TEXT_BYTES = 8 << 20
#: Distinct pieces whose ids a task keeps; beyond it starts anew, with the same results.
KEPT = 600_000
#: Stands alone between the pieces that the library encodes in one text.
_BETWEEN, _TOGETHER = "\x01", 512
#: Chunks that a reading task takes.
CHUNKS_A_TASK = 16

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Static frequencies that add up to 2**bits; every symbol that occurs has one of at least 1."""

    def __init__(self, bits: int, freq: np.ndarray):
        if int(freq.sum()) != 1 << bits:
            raise ValueError("frequencies must add up to the size of the table")
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        used = np.flatnonzero(counts)
        if not len(used):
            return cls(0, np.ones(1, np.int64))
        bits = max(20, len(used).bit_length() + 4)
        share = counts[used].astype(np.float64) * ((1 << bits) / counts.sum())
        near = np.maximum(1, np.floor(share)).astype(np.int64)
        # What is missing or too much goes to the most frequent symbols, in proportion, then one each.
        while (left := (1 << bits) - int(near.sum())) != 0:
            by = np.argsort(-near, kind="stable")
            step = np.trunc(left * (near / near.sum())).astype(np.int64)
            if not step.any():
                step[by[:abs(left)]] = np.sign(left)
            near = np.maximum(1, near + step)
        freq = np.zeros(len(counts), np.int64)
        freq[used] = near
        return cls(bits, freq)

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", self.bits, len(self.freq)) + zlib.compress(self.freq.astype("<u4").tobytes())
        return MAGIC + struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        body = data[12:]
        if data[:8] != MAGIC or struct.unpack("<I", data[8:12])[0] != zlib.crc32(body):
            raise ValueError("the frequency table is damaged")
        bits, n = struct.unpack("<II", body[:8])
        freq = np.frombuffer(zlib.decompress(body[8:]), "<u4")
        if len(freq) != n:
            raise ValueError("the frequency table is damaged")
        return cls(bits, freq)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """The block of some ids: count, lanes, words, the last states, the words in the order in which decoding takes them."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 256))
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id isn't in the frequency table")
    bits, limit = np.uint64(table.bits), np.uint64(63 - table.bits)
    states, out = np.full(lanes, _LOW), []
    for at in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        f = freq[at:at + lanes]
        x = states[:len(f)]
        over = x >= f << limit
        if over.any():
            full = x[over]
            out.append(full.astype(np.uint32))  # the low half
            x[over] = full >> _WORD
        q = x // f
        x[:] = (q << bits) + (x - q * f) + start[at:at + lanes]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return struct.pack("<III", n, lanes, len(words)) + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def decode_block(data: memoryview | bytes, at: int, table: Table) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at`` and where the next one begins."""
    n, lanes, count = struct.unpack_from("<III", data, at)
    states = np.frombuffer(data, "<u8", lanes, at + 12).astype(np.uint64)
    words = np.frombuffer(data, "<u4", count, at + 12 + 8 * lanes).astype(np.uint64)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    ids, taken = np.empty(n, np.uint32), 0
    for i in range(0, n, lanes):
        x = states[:n - i]
        slot = x & mask
        symbol = table.symbol[slot]
        ids[i:i + lanes] = symbol
        x[:] = table.freq[symbol] * (x >> bits) + slot - table.start[symbol]
        low = x < _LOW
        k = int(np.count_nonzero(low))
        if k:
            x[low] = x[low] << _WORD | words[taken:taken + k]
            taken += k
    if taken != count or not (states == _LOW).all():
        raise ValueError("a block doesn't end in the state in which it began")
    return ids, at + 12 + 8 * lanes + 4 * count


_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n_tokens", "<u8")])
_CHECKPOINT = np.dtype([("offset", "<u8"), ("size", "<u8"), ("first", "<u8"), ("n_tokens", "<u8"), ("n_docs", "<u4"), ("crc32", "<u4")])


def pack_chunk(docs: list[tuple[int | None, np.ndarray]], table: Table) -> bytes:
    head = np.array([(d or 0, d is not None, len(x)) for d, x in docs], _DOC)
    ids = np.concatenate([x for _, x in docs])
    return head.tobytes() + b"".join(encode_block(ids[i:i + BLOCK], table) for i in range(0, len(ids), BLOCK))


def unpack_chunk(data: bytes, n_docs: int, n_tokens: int, crc32: int, table: Table) -> Iterator[tuple[int | None, np.ndarray]]:
    if zlib.crc32(data) != crc32:
        raise ValueError("a chunk isn't what its checkpoint says")
    head, at, parts, have = np.frombuffer(data, _DOC, n_docs), n_docs * _DOC.itemsize, [], 0
    while have < n_tokens:
        ids, at = decode_block(data, at, table)
        parts.append(ids)
        have += len(ids)
    whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    ends = np.cumsum(head["n_tokens"].astype(np.int64))
    if have != n_tokens or (int(ends[-1]) if n_docs else 0) != n_tokens:
        raise ValueError("a chunk doesn't hold as many ids as it says")
    for (doc_id, has_id, size), end in zip(head.tolist(), ends.tolist(), strict=True):
        yield doc_id if has_id else None, whole[end - size:end]


class Writer:
    """Writes one file of chunks."""

    def __init__(self, sink: pa.NativeFile, table: Table, chunk: int = CHUNK):
        self.chunk, self.sink, self.table, self.checkpoints, self.docs, self.held, self.first = chunk, sink, table, [], [], 0, 0
        sink.write(MAGIC)
        self.size = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.held += len(ids)
        if self.held >= self.chunk:
            self.flush()

    def flush(self) -> None:
        if self.docs:
            data = pack_chunk(self.docs, self.table)
            self.checkpoints.append((self.size, len(data), self.first, self.held, len(self.docs), zlib.crc32(data)))
            self.sink.write(data)
            self.size += len(data)
            self.first += self.held
            self.docs, self.held = [], 0

    def close(self) -> tuple[int, int]:
        """Ends the file with its checkpoints; returns its documents and tokens."""
        self.flush()
        body = np.array(self.checkpoints, _CHECKPOINT).tobytes()
        self.sink.write(body + struct.pack("<II", len(self.checkpoints), zlib.crc32(body)) + MAGIC)
        self.sink.close()
        return sum(x[4] for x in self.checkpoints), self.first


def read_checkpoints(source: pa.NativeFile) -> np.ndarray:
    size = source.size()
    tail = source.read_at(16, size - 16) if size >= 24 else b""
    if tail[8:] != MAGIC:
        raise ValueError("the file has no end")
    n, crc32 = struct.unpack("<II", tail[:8])
    body = source.read_at(n * _CHECKPOINT.itemsize, size - 16 - n * _CHECKPOINT.itemsize)
    if zlib.crc32(body) != crc32:
        raise ValueError("the checkpoints are damaged")
    return np.frombuffer(body, _CHECKPOINT)


def _kinds() -> np.ndarray:
    """0 white space, 1 ASCII letter, 2 ASCII digit or mark, 3 all that may belong to both sides: an apostrophe, the signs of
    special tokens, bytes beyond ASCII, control characters."""
    return np.array([0 if b in (9, 10, 11, 12, 13, 32) else 1 if chr(b).isalpha() and b < 128 else 2 if 32 < b < 127 and chr(b) not in "'<|>" else 3
                     for b in range(256)], np.uint8)


class Encoder:
    """Ids of whole text columns by the tokenizers library, each distinct piece encoded once."""

    _kind = _kinds()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        [self.between] = self.library.encode(_BETWEEN, add_special_tokens=False).ids
        # A word of letters alone is one pre-token, whose last id and no other ends in the suffix.
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
        if suffix:
            self.ends_word[[i for w, i in self.library.get_vocab().items() if w.endswith(suffix)]] = True
        upper = " ".join(ascii_uppercase)
        self.folds = self.library.encode(upper, add_special_tokens=False).ids == self.library.encode(upper.lower(), add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.cuts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _pieces(self, column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        data = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if data.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = self._kind[raw]
        inside = kind > 0
        first = inside.copy()
        if len(raw):
            border = (kind[1:] ^ kind[:-1]) == 3  # 1 beside 2 (or 0 beside 3)
            first[1:] &= border | ~inside[:-1]
            first[offsets[offsets < len(raw)]] |= inside[offsets[offsets < len(raw)]]
        starts = np.flatnonzero(first)
        before = np.cumsum(inside)
        cuts = np.append(before[starts] - 1, before[-1] if len(raw) else 0).astype(np.int64)
        flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(raw[inside]))
        return flat.dictionary_encode(), np.searchsorted(offsets, starts, side="right") - 1

    def _library(self, joined: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(joined, add_special_tokens=False)]

    def _keep(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(sizes) != len(new):
            raise ValueError("the pieces came back in another number")
        first = len(self.cuts) - 1
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self, new: list[str], alone: bool) -> None:
        together = [[w] for w in new] if alone else [new[i:i + _TOGETHER] for i in range(0, len(new), _TOGETHER)]
        found = self._library([x[0] if alone else f" {_BETWEEN} ".join([*x, ""]) for x in together])
        ids = np.concatenate(found)
        if alone:
            self._keep(new, ids, np.array([len(x) for x in found]))
        else:
            last = ids == self.between
            self._keep(new, ids[~last], np.diff(np.append(-1, np.flatnonzero(last))) - 1)

    def _learn_letters(self, new: list[str]) -> list[str]:
        """Learns words of letters, which need nothing between them but a space; returns those of which some are more than one pre-token."""
        together = [new[i:i + _TOGETHER] for i in range(0, len(new), _TOGETHER)]
        left: list[str] = []
        learned: list[str] = []
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for some, ids in zip(together, self._library([" ".join(x) for x in together]), strict=True):
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) != len(some):
                left += some
                continue
            learned += some
            parts.append(ids)
            sizes.append(np.diff(np.append(-1, ends)))
        self._keep(learned, np.concatenate(parts), np.concatenate(sizes))
        return left

    def encode(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, each row's with ``end`` behind, and the number of ids of each row."""
        pieces, row = self._pieces(column)
        words = pieces.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self._forget()
            new = words
        # Letter case is nothing to the vocabulary: words of ASCII letters, which no mark composes with, are learned in lower case.
        folded = {w: w.lower() if self.folds and w.isascii() else w for w in new if w.isalpha()}
        left = self._learn_letters([w for w in dict.fromkeys(folded.values()) if w not in self.known])
        new = [w for w in new if w not in folded] + left
        # Pieces between white space don't touch each other, so many of them make one text for the library.
        for some, alone in ([w for w in new if _BETWEEN not in w], False), ([w for w in new if _BETWEEN in w], True):
            if some:
                self._learn(some, alone)
        self.known.update([(w, self.known[x]) for w, x in folded.items()])
        at = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        codes = at[pieces.indices.to_numpy()]
        start, size = self.cuts[codes], self.cuts[codes + 1] - self.cuts[codes]
        lengths = np.bincount(row, size, len(column)).astype(np.int64)
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(start - ends + size, size)] if len(ends) else np.zeros(0, np.uint32)
        if end is None:
            return ids, lengths
        out = np.empty(len(ids) + len(column), np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(column)), lengths)] = ids
        lengths += 1
        out[np.cumsum(lengths) - 1] = end
        return out, lengths


def _encoded(path: str, end: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = Encoder(path), zstandard.ZstdCompressor(3)
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, lengths = own.encode(batch.column("text"), end)
            narrow, ends = ids.astype(f"<u{own.width}"), np.cumsum(lengths)
            packed = [packer.compress(narrow[b - n:b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array(np.full(len(packed), own.width), pa.int32())],
                                             ["doc_id", "packed", "width"])
    return run


def token_ids(docs: DataFrame, path: str, end: int | None = 1) -> DataFrame:
    """doc_id, packed, width, spread for every row of ``docs``, written: the ids in ``width`` bytes each, compressed, and a hash."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = plain.mapInArrow(_encoded(path, end), "doc_id long, packed binary, width int")
    return written(made.withColumn("spread", F.xxhash64("packed")), "token-ids")


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    engine = zstandard.ZstdDecompressor()
    return [np.frombuffer(engine.decompress(x), f"<u{w}").astype(np.uint32) for x, w in zip(batch.column("packed").to_pylist(), batch.column("width").to_pylist(), strict=True)]


def frequencies(ids: DataFrame) -> Table:
    """The shared table, from the counts of all tokens; the driver sees a number for each symbol of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in slices(batches, "packed"):
            own = np.bincount(np.concatenate([np.zeros(0, np.uint32), *_unpacked(batch)]).astype(np.int64))
            wide = np.zeros(max(len(own), len(counts)), np.int64)
            wide[:len(counts)] = counts
            wide[:len(own)] += own
            counts = wide
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["id", "n"])
    found = ids.select("packed", "width").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r.id for r in found), default=-1), np.int64)
    for r in found:
        counts[r.id] = r.n
    return Table.of(counts)


@lru_cache(maxsize=2)
def load_table(folder: str) -> Table:
    store, path = place(folder)
    with store.open_input_stream(f"{path}/table", compression=None) as source:
        return Table.from_bytes(source.read())


class Archive(NamedTuple):
    folder: str
    #: part, seq (order of the files), name, n_docs, n_tokens, start (ids in all files before).
    files: DataFrame


def write_files(ids: DataFrame, folder: str, file_bytes: int = FILE_BYTES, chunk: int = CHUNK) -> Archive:
    """Write ``token_ids`` to files in ascending doc_id order."""
    table = frequencies(ids)
    store, path = place(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/table", compression=None) as sink:
        sink.write(table.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (store, path), part = load_table(folder), place(folder), TaskContext.get().partitionId()
        rows, writer, name = [], None, ""
        for batch in slices(batches, "packed"):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), _unpacked(batch), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.rans"
                    writer = Writer(store.open_output_stream(f"{path}/{name}", compression=None), table, chunk)
                writer.add(doc_id, own)
                if writer.size >= file_bytes:
                    rows.append((part, len(rows), name, *writer.close()))
                    writer = None
        if writer is not None:
            rows.append((part, len(rows), name, *writer.close()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)],
                                         ["part", "seq", "name", "n_docs", "n_tokens"])
    by = [F.col("doc_id").asc_nulls_first(), F.col("spread")]
    files = written(ids.repartitionByRange(*by).sortWithinPartitions(*by, "packed").mapInArrow(run, "part long, seq long, name string, n_docs long, n_tokens long"), "token-files")
    # Tokens before a file: those of the parts before, in two steps so that no task sees all parts, and of the files before in its own part.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n")).withColumn("_block", F.shiftright("part", 10))
    ahead = parts.groupBy("_block").agg(F.sum("_n").alias("_all")).withColumn("_ahead", F.sum("_all").over(Window.orderBy("_block")) - F.col("_all"))
    parts = parts.join(ahead, "_block").withColumn("_before", F.sum("_n").over(Window.partitionBy("_block").orderBy("part")) - F.col("_n") + F.col("_ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    placed = files.withColumn("_inside", inside).join(parts.select("part", "_before"), "part")
    return Archive(folder, written(placed.select("part", "seq", "name", "n_docs", "n_tokens", (F.col("_before") + F.col("_inside")).alias("start")), "token-manifest"))


def checkpoints(archive: Archive) -> DataFrame:
    """name, offset, size, first (ids of all documents before), n_tokens, n_docs, crc32 of every chunk of the archive."""
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        for batch in batches:
            for name, start, n_tokens in zip(*[batch.column(c).to_pylist() for c in ("name", "start", "n_tokens")], strict=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    found = read_checkpoints(source)
                if int(found["n_tokens"].sum()) != n_tokens:
                    raise ValueError(f"{name} doesn't hold as many ids as the manifest says")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), *[pa.array(x.astype(np.int64)) for x in (
                    found["offset"], found["size"], found["first"] + np.uint64(start), found["n_tokens"], found["n_docs"], found["crc32"])]],
                    ["name", "offset", "size", "first", "n_tokens", "n_docs", "crc32"])
    return written(archive.files.mapInArrow(run, "name string, offset long, size long, first long, n_tokens long, n_docs long, crc32 long"), "token-checkpoints")


def _read(folder: str, digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (store, path) = load_table(folder), place(folder)
        for batch in batches:
            for name, offset, size, first, n_tokens, n_docs, crc32 in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    docs = list(unpack_chunk(source.read_at(size, offset), n_docs, n_tokens, crc32, table))
                lengths = np.array([len(x) for _, x in docs], np.int64)
                last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs], pa.int64()) if digest else pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(np.concatenate([x for _, x in docs]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(first + np.cumsum(lengths) - lengths, pa.int64()),
                                                  pa.array(lengths, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    return run


def read_files(archive: Archive, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, with ``digest``, ids_crc32) of every document, chunk by chunk from the files."""
    chunks = checkpoints(archive)
    tasks = max(1, -(-chunks.count() // CHUNKS_A_TASK))
    return chunks.repartition(tasks).mapInArrow(_read(archive.folder, digest), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/token-files-{uuid.uuid4().hex}"


def through_files(docs: DataFrame, path: str, end: int | None = 1) -> DataFrame:
    """Encode ``docs``, write them to files, and read back doc_id, start, n_tokens, ids_crc32."""
    return read_files(write_files(token_ids(docs, path, end), new_folder(docs.sparkSession)), digest=True)
