"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie end to end in one numpy array of tokens. In every step each sequence looks up the ranks
of its neighbouring pairs, and all places that hold its lowest rank merge at once; sequences without a known pair leave the
array. A new token's rank is above the ranks of its parts, so no merge of a step can come before another one of the same step,
and the outcome is that of merging one place at a time. What is left are the surviving symbols.

Nulls: a null text has no bytes and no tokens; doc_id is passed through, null or repeated. Texts are counted whole at any
length. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.llm import word_bpe
from tallycell.llm.common import slices

LIMIT = 2048
NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of a token pair by open addressing in numpy arrays; NONE where the pair never merges."""

    def __init__(self, bpe: word_bpe.WordBpe):
        pairs = np.array(list(bpe.pairs), dtype=np.int64)
        wanted, rank = pairs[:, 0] << 17 | pairs[:, 1], np.array(list(bpe.pairs.values()), dtype=np.int32)
        self.bits = int(len(wanted) - 1).bit_length() + 2
        self.keys, self.ranks = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NONE)
        slot = self._slot(wanted)
        while len(wanted):
            free = self.keys[slot] < 0
            first = np.zeros(len(slot), dtype=bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = wanted[put], rank[put]
            wanted, rank, slot = wanted[~put], rank[~put], slot[~put] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x9E3779B97F4A7C1 | 1) >> np.int64(20)) & (1 << self.bits) - 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 17 | right
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at = slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            held = self.keys[at]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out


def surviving(tokens: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """How many tokens each sequence of the ragged array ends with. Every length is at least 1."""
    out = np.ones(len(lengths), dtype=np.int64)
    live = np.flatnonzero(lengths > 1)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    tokens = tokens[lengths[owner] > 1].astype(np.int32)
    lengths = lengths[live]
    while len(live):
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        rank = np.empty(len(tokens), dtype=np.int32)
        rank[:-1] = table.rank(tokens[:-1], tokens[1:])
        rank[start + lengths - 1] = NONE
        lowest = np.minimum.reduceat(rank, start)
        at = (rank == np.repeat(lowest, lengths)) & (rank != NONE)
        if (at[1:] & at[:-1]).any():  # a run of one repeated symbol: its first, third, ... pair merges
            place = np.arange(len(at))
            at &= (place - np.maximum.accumulate(np.where(at, -1, place)) - 1) % 2 == 0
        merged = np.flatnonzero(at)
        tokens[merged] = rank[merged]
        stays = np.ones(len(tokens), dtype=bool)
        stays[merged + 1] = False
        lengths = np.add.reduceat(stays, start, dtype=np.int64)
        ended = (lowest == NONE) | (lengths == 1)
        out[live[ended]] = lengths[ended]
        tokens = tokens[stays]
        if ended.any():
            tokens = tokens[np.repeat(~ended, lengths)]
            live, lengths = live[~ended], lengths[~ended]
    return out


def piece_counts(pieces: list[str], bpe: word_bpe.WordBpe, table: PairTable) -> np.ndarray:
    """Tokens of each of the distinct pre-tokens."""
    data = [p.encode() for p in pieces]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    symbols[np.cumsum(lengths) - 1] += 256
    counts = surviving(bpe.symbol_token[symbols], lengths, table)
    for i in (i for i, p in enumerate(pieces) if p in bpe.specials):
        counts[i] = 1
    return counts


def _count(path: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(path)
        table = PairTable(bpe)
        for batch in slices(batches):
            found = [x or "" for x in batch.column("text").to_pylist()]
            pieces = [bpe.pieces(x) for x in found]
            held = np.fromiter(map(len, pieces), np.int64, len(pieces))
            n_tokens = np.zeros(len(pieces), dtype=np.int64)
            if held.any():
                words = pa.array([p for x in pieces for p in x], pa.string()).dictionary_encode()
                counts = piece_counts(words.dictionary.to_pylist(), bpe, table)[words.indices.to_numpy()]
                upto = np.concatenate([[0], np.cumsum(counts)])
                ends = np.cumsum(held)
                n_tokens = upto[ends] - upto[ends - held]
            n_bytes = np.fromiter((len(x.encode()) for x in found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``. ``path``: vocabulary file, the same on all machines."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
