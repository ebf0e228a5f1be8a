"""BPE encoding by backtracking over longest matches, decoding through an offset table.

A sequence of tokens is what merging by rank gives exactly if merging gives back each neighbouring pair of it. So one pass of
an Aho-Corasick automaton finds all tokens of a pre-token; from the left, the longest one that may stand beside its
predecessor is taken, and where none may, the walk steps back and shortens the predecessor. A bit per place says that its rest
was tried already, which makes the walk linear. Whether two tokens may meet is a table filled on demand: both are taken apart
in reverse merge order, and no pair across their border may have merged earlier.

Decoding joins the token texts by spaces, as the vocabulary file (it has no decoder) asks for: all texts lie in one byte array,
and a document is gathered from it by offsets.

Nulls: a null text is empty, its id list and decoded text too; doc_id is passed through, null or repeated. Texts are encoded
whole at any length. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from weakref import WeakMethod

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.llm import word_bpe
from tallycell.llm.common import slices

#: Encoded words that a worker keeps; beyond it the half that was not seen for longest goes, with the same results. Pre-tokens
#: and checked pairs start anew beyond it.
KEPT = 1 << 19
_FIRST = 0x4E00  # symbols 0-511 as characters, for the automaton


class Words(dict):
    """Numbers of encoded words. The ids of all of them lie in one array, cut by ``starts``: no object for each word but its text."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = WeakMethod(encode)  # no cycle: a task's tables are gone when it ends, not when cycles are looked for
        self.flat, self.starts = array("I"), array("q", [0])
        self.seen = np.zeros(0, np.int64)
        self.clock = 0

    def __missing__(self, word: str) -> int:
        self.flat.extend(self.encode()(word))
        self.starts.append(len(self.flat))
        number = self[word] = len(self)
        return number

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words`` one behind the other, and how many each has."""
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.clock += 1
        self.seen = np.concatenate([self.seen, np.zeros(len(self) - len(self.seen), np.int64)])
        self.seen[numbers] = self.clock
        starts = np.array(self.starts)
        sizes = np.diff(starts)[numbers]
        found = np.array(self.flat)[_places(starts[numbers], sizes)]
        if len(self) > KEPT:
            self._forget()
        return found, sizes

    def _forget(self) -> None:
        """Drop the words that were not seen for longest, to half of KEPT."""
        stay = np.sort(np.argsort(self.seen, kind="stable")[len(self) - KEPT // 2:])
        starts, words = np.array(self.starts), list(self)
        sizes = np.diff(starts)[stay]
        self.flat = array("I", np.array(self.flat)[_places(starts[stay], sizes)].tobytes())
        self.starts = array("q", np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes())
        self.seen = self.seen[stay]
        self.clear()
        self.update((words[old], new) for new, old in enumerate(stay.tolist()))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Codec:
    def __init__(self, path: str):
        self.bpe = bpe = word_bpe.load(path)
        self.left, self.right = bpe.left.tolist(), bpe.right.tolist()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.words = Words(self._word)
        spelled = [""] * len(self.left)
        for symbol, token in enumerate(bpe.symbol_token.tolist()):
            spelled[token] = chr(_FIRST + symbol)
        for token in range(word_bpe.N_SYMBOLS, len(spelled)):
            spelled[token] = spelled[self.left[token]] + spelled[self.right[token]]
        self.lengths = list(map(len, spelled))
        self.automaton = ahocorasick.Automaton()
        whole: list[bool] = []
        for token, text in enumerate(spelled):
            a, b = self.left[token], self.right[token]
            whole.append(a < 0 or whole[a] and whole[b] and self._meet(a, b, token))
            if whole[token]:
                self.automaton.add_word(text, token)
        self.single = {text: token for token, text in enumerate(spelled) if whole[token]}
        #: The longest token that a token begins with, -1 if it has one symbol.
        self.prefix = [next((self.single[text[:i]] for i in range(len(text) - 1, 0, -1) if text[:i] in self.single), -1) for text in spelled]
        self.automaton.make_automaton()
        names = [x.encode() + b" " for x in bpe.names]
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)
        self.table = str.maketrans({chr(b): chr(_FIRST + b) for b in range(256)})

    def _meet(self, a: int, b: int, limit: int) -> bool:
        """Whether no pair across the border of a and b merges at a rank under ``limit`` before both are whole."""
        left, right, pairs = self.left, self.right, self.bpe.pairs
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            # The part that was merged last comes apart first; of equal ones the right, as places merge from the left.
            if a > b and left[a] >= 0:
                limit, a = a, right[a]
            elif left[b] >= 0:
                limit, b = b + 1, left[b]
            elif left[a] >= 0:
                limit, a = a, right[a]
            else:
                return True

    def _fit(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            known = self.fits[a, b] = self._meet(a, b, len(self.left))
        return known

    def _symbols(self, piece: str) -> str:
        text = piece.encode().decode("latin-1").translate(self.table)
        return text[:-1] + chr(ord(text[-1]) + 256)

    def _walk(self, text: str) -> list[int]:
        """Tokens of a pre-token given as symbols."""
        n, lengths, prefix, fits, longest = len(text), self.lengths, self.prefix, self.fits, self.automaton.iter_long
        out: list[int] = []
        tried = bytearray(n + 1)  # places whose rest can't be reached by any token that ended there
        at, coming = 0, longest(text)  # longest matches from here on, one behind the other
        token = next(coming)[1]
        while True:
            end = at + lengths[token]
            if not tried[end]:
                fit = True
                if out:
                    pair = out[-1], token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = self._fit(*pair)
                if fit:
                    out.append(token)
                    if end == n:
                        return out
                    if coming is None:
                        coming = longest(text, end)
                    at, token = end, next(coming)[1]
                    continue
            coming = None
            token = prefix[token]
            while token < 0:
                tried[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = prefix[token]

    def _piece(self, piece: str) -> tuple[int, ...]:
        known = self.known.get(piece)
        if known is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            if piece in self.bpe.specials:
                known = self.bpe.specials[piece],
            else:
                text = self._symbols(piece)
                token = self.single.get(text)  # the longest match is the whole: nothing to walk
                known = tuple(self._walk(text)) if token is None else (token,)
            self.known[piece] = known
        return known

    def _word(self, word: str) -> tuple[int, ...] | list[int]:
        if word.isascii() and word.isalpha():  # one pre-token
            return self._piece(word.lower())
        return [x for piece in self.bpe.pieces(word) for x in self._piece(piece)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array and the offsets that cut it by text."""
        split = [self.bpe.words(x) for x in texts]
        ids, sizes = self.words.ids([w for words in split for w in words])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in split], dtype=np.int64)])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The texts of ids that ``cuts`` divides by text."""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        joined = self.bytes[_places(start, size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[cuts].tolist()
        return [joined[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids, np.array([0, len(ids)]))[0]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, built once in a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path)  # for this task only: the worker goes on to other stages, which need the memory
        for batch in slices(batches):
            ids, cuts = own.encode_all([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])
    return run


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path)  # for this task only: the worker goes on to other stages, which need the memory
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype(np.uint32), ids.offsets.to_numpy()
            found = own.decode_all(flat[offsets[0]:offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode() for x in found], pa.string())], ["doc_id", "text"])
    return run


def _digest(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path)  # for this task only: the worker goes on to other stages, which need the memory
        for batch in slices(batches):
            ids, cuts = own.encode_all([x or "" for x in batch.column("text").to_pylist()])
            stored, bounds = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(cuts), pa.int64()),
                 pa.array([hashlib.sha256(stored[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in own.decode_all(ids, cuts)], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids for every row of ``docs``. ``path``: vocabulary file, the same on all machines."""
    return _plain(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from the ids of ``encode``."""
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(_decode(path), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without moving ids."""
    return _plain(docs).mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
