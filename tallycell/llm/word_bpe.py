"""The word-piece vocabulary file of a public tokenizer: normal form, pre-tokens and symbols shared by counting and encoding.

A pre-token is written as a sequence of byte symbols: 0-255 for a byte inside, 256-511 for the byte that ends it. Merge number i
makes token 512 + i, so a token's number is also its rank.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex

# The pre-token pattern of the vocabulary file, with white space as Unicode defines it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^" + WHITE + "\\p{L}\\p{N}]+"
END = "</w>"
N_SYMBOLS = 512
_SEPARATOR = regex.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """The parsed vocabulary.

    pairs: merge ranks by (left token, right token); left, right: the two parts of every token, -1 for a symbol;
    symbol_token: token of each symbol; specials: token by its text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = _byte_letters()
        self.symbol_token = np.array([vocab[x] for x in letters] + [vocab[x + END] for x in letters], dtype=np.int32)
        parts = np.array([[vocab[a], vocab[b]] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        if sorted(self.symbol_token.tolist()) != list(range(N_SYMBOLS)) or made.tolist() != list(range(N_SYMBOLS, N_SYMBOLS + len(made))):
            raise ValueError("the vocabulary must number its symbols first and its merges in order")
        self.left = np.concatenate([np.full(N_SYMBOLS, -1), parts[:, 0]])
        self.right = np.concatenate([np.full(N_SYMBOLS, -1), parts[:, 1]])
        self.pairs = {(int(a), int(b)): int(t) for (a, b), t in zip(parts, made, strict=True)}
        self.specials = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.names = [name for name, _ in sorted([*vocab.items(), *self.specials.items()], key=lambda x: x[1])]
        self._special = regex.compile("(" + "|".join(regex.escape(x) for x in self.specials) + ")")
        self._piece = regex.compile(PATTERN)
        self._divides = not any(c.isspace() for x in self.specials for c in x)

    def words(self, text: str) -> list[str]:
        """``text`` in parts that no pre-token reaches across, in order: their pre-tokens are those of the text. White space
        divides; the separators U+001C to U+001F are white space to Python and none to the pattern, a text with one stays whole."""
        if not self._divides or _SEPARATOR.search(text):
            return [text]
        return text.split()

    def pieces(self, text: str) -> Iterable[str]:
        """Pre-tokens of ``text`` in order; a special token's text comes out as it stands."""
        if not any(x in text for x in self.specials):
            return self._piece.findall(normal(text))
        out: list[str] = []
        for i, part in enumerate(self._special.split(text)):
            out += [part] if i % 2 else self._piece.findall(normal(part))
        return out


def normal(text: str) -> str:
    """Composed characters, lower case letter by letter (white space is dropped by the pre-token pattern)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)
