"""Quality classifier by co-training.

Two views of a document are learnt separately: its text content (which words, and which beginnings of words, occur) and its page
metadata (language, source, length and layout figures, in steps). Each view has two heads, for low quality and for toxicity of
documents that aren't of low quality (junk shares no words with prose, which says nothing of toxicity): a log-odds model over the
traits whose share differs beyond chance between the two classes. Traits are named by the hash of their text, one of SLOTS slots, so
what is counted, brought to the driver and sent to the tasks is bounded at any size; traits that share a slot share a weight. In every
round each view scores all unlabelled documents, and what it is sure of, by its calibrated score, joins the other view's counts as a
pseudo-label.
At the end both views are calibrated on labelled rows that no training has seen, a logistic model of the two calibrated logits,
fitted on those rows too, gives each head's probability, and a document is good with probability (1 - low) * (1 - toxic).

Several label rows for a doc_id count by their worst values; rows with a null are left out. Of labelled documents
training reads about LABELLED at most, drawn by the hash of doc_id; all other documents, also those without doc_id, count as
unlabelled. They are read where they lie, and their traits are counted in the tasks that score them: counts move, no texts.
A head without labels of both classes takes no part; with neither head (no labels, empty tables) every score is 1.

A null text is empty, null metadata are values of their own; doc_id may be null or repeated. Other columns are passed through by
``keep_good`` and not read by ``score``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycell.llm.common import scratch, slices, written

LABELLED = 20_000
SLOTS = 1 << 20  # of traits in each view
_SLICE = 1 << 20  # bytes of text whose traits are made at once
ROUNDS, SURE = 2, 0.98
HELD_OUT = 4  # one in so many labelled documents calibrates
CHANCE = 5.0  # standard errors that a trait's shares must lie apart
STEMS = (4, 5, 6)
HEADS, VIEWS = ("low", "toxic"), ("text", "meta")
_RANGE = 1 << 20
_FIELDS = "doc_id long, text array<int>, meta array<int>"
_COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
_ARROW = {"text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}


#: Slots of a slice of documents, those of a document together, distinct and ascending; and how many each document has.
Slots = tuple[np.ndarray, np.ndarray]

_SYMBOLS, _LINES = np.zeros(256, np.int64), np.zeros(256, np.int64)
_SYMBOLS[list(b"#$%&*|!<>{}[]\\/=+~^@_")] = 1
_LINES[10] = 1


#: A trait's hash is the sum of its characters times powers of an odd number, so sums over a slice give those of all its words at once.
_FACTOR, _MIX, _MASK = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), (1 << 64) - 1
_BLANK = np.uint64(ord(" ") + 1)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _FACTOR, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


def _slots(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return ((h ^ h >> np.uint64(29)) % np.uint64(SLOTS)).astype(np.int64)


def slot(trait: str) -> int:
    h, power = 0, 1
    for c in trait:
        h, power = (h + (ord(c) + 1) * power) & _MASK, power * _FACTOR & _MASK
    return int(_slots(np.array([h], np.uint64))[0])


def text_traits(word: str) -> list[str]:
    """The lower-case word and its beginnings, marked by a blank."""
    low = word.lower()
    return [low, *(low[:n] + " " for n in STEMS if len(low) > n)]


def _unique(keys: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting: several times faster on these keys than hashing."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _distinct(docs: np.ndarray, slots: np.ndarray, n: int) -> Slots:
    keys = _unique(docs * SLOTS + slots)
    return keys % SLOTS, np.bincount(keys // SLOTS, minlength=n)


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By character: whether it divides words, and its case (1 upper, 2 lower or title). The last entry stands for all above it."""
    chars = [chr(c) for c in range(0x20000)]
    return np.array([c.isspace() for c in chars] + [False]), np.array([2 if c.islower() or c.istitle() and not c.isupper() else int(c.isupper()) for c in chars] + [0], np.uint8)


class Words:
    """The words of a list of texts: hashes of their first characters, where each begins and ends, and how many each text has."""

    def __init__(self, texts: list[str]):
        joined = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        chars = np.minimum(joined, 0x20000)
        inside = np.concatenate([[False], ~_kinds()[0][chars], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, lengths = edges[::2], edges[1::2] - edges[::2]
        bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.number = np.diff(np.searchsorted(first, bounds))
        self.chars = chars[inside[1:-1]]
        self.ends = np.cumsum(lengths)
        self.starts, self.lengths = self.ends - lengths, lengths
        power = _powers(1 + max(int(lengths.max(initial=0)), *STEMS))
        values = (joined[inside[1:-1]].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(self.chars)) - np.repeat(self.starts, lengths)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        self.power = power

    def whole(self) -> np.ndarray:
        return self.sums[self.ends] - self.sums[self.starts]

    def stems(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than ``n`` characters and the hashes of their beginnings, marked by a blank."""
        long = np.flatnonzero(self.lengths > n)
        start = self.starts[long]
        return long, self.sums[start + n] - self.sums[start] + _BLANK * self.power[n:n + 1]

    def capitals(self) -> np.ndarray:
        """Of each word whether it is in capitals, as str.isupper."""
        return np.maximum.reduceat(_kinds()[1][self.chars], self.starts) == 1 if len(self.starts) else np.zeros(0, bool)


class Traits:
    def of(self, batch: pa.RecordBatch) -> dict[str, Slots]:
        """Both views of the documents of ``batch``: which words occur; language, source, and steps of length and layout."""
        texts = [x or "" for x in batch.column("text").to_pylist()]
        given, low, n = Words(texts), Words([x.lower() for x in texts]), len(texts)
        words = given.number
        docs = np.repeat(np.arange(n), words)
        found = [(docs, low.whole()), *((docs[long], h) for long, h in map(low.stems, STEMS))]
        names = given.whole()
        ends = np.cumsum(words).tolist()
        several = [len(_unique(names[e - w:e])) for e, w in zip(ends, words.tolist(), strict=True)]
        raw = [x.encode() for x in texts]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        symbols, lines = (np.diff(np.concatenate([[0], np.cumsum(kind[joined])])[cuts]) for kind in (_SYMBOLS, _LINES))
        size, some = np.maximum(1, np.array([len(x) for x in texts], np.int64)), np.maximum(1, words)
        chars = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float)
        again = (names[1:] == names[:-1]) & (docs[1:] == docs[:-1])
        figures = {"chars": np.log2(1 + np.where(np.isnan(chars), size, np.maximum(0, chars))), "lines": np.log2(1 + lines),
                   "word": np.log2(size / some) * 2, "symbols": np.log2(1e-3 + symbols / size),
                   "upper": 8 * np.bincount(docs, given.capitals(), n) / some,
                   "same": 16 * np.bincount(docs[1:][again], minlength=n) / some, "distinct": 8 * np.array(several, np.int64) / some}
        meta = [[_named(f"{k} {x}") for x in batch.column(k).to_pylist()] for k in ("lang", "source")]
        meta += [[_named(f"{k} {x}") for x in np.floor(v).astype(np.int64).tolist()] for k, v in figures.items()]
        return {"text": _distinct(np.concatenate([d for d, _ in found]), _slots(np.concatenate([h for _, h in found])), n),
                "meta": _distinct(np.tile(np.arange(n), len(meta)), np.array(meta, np.int64).ravel(), n)}


_named = lru_cache(1 << 16)(slot)


@dataclass
class Head:
    """Weights of the traits of each view (slots and their weights), the calibration (slope, offset) of each view, and the mix of
    their logits."""

    weights: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=lambda: {v: (np.zeros(0, np.int64), np.zeros(0)) for v in VIEWS})
    line: dict[str, tuple[float, float]] = field(default_factory=lambda: {v: (0.0, -60.0) for v in VIEWS})
    mix: tuple[float, float, float] = (0.5, 0.5, 0.0)

    def dense(self, view: str) -> np.ndarray:
        out = np.zeros(SLOTS)
        out[self.weights[view][0]] = self.weights[view][1]
        return out


class Scorer:
    """A head with its weights by slot."""

    def __init__(self, head: Head):
        self.head, self.weights = head, {v: head.dense(v) for v in VIEWS}

    def logits(self, view: str, traits: Slots) -> np.ndarray:
        slots, sizes = traits
        slope, offset = self.head.line[view]
        return slope * np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.weights[view][slots], len(sizes)) + offset

    def probability(self, traits: dict[str, Slots]) -> np.ndarray:
        z = sum(m * self.logits(v, traits[v]) for m, v in zip(self.head.mix, VIEWS, strict=False)) + self.head.mix[2]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


Model = dict[str, Head]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and constant of a small dense logistic model by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return w


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in _COLUMNS.items()])


def _lists(traits: Slots) -> pa.ListArray:
    slots, sizes = traits
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(slots, pa.int32()))


def _traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Traits()
    for batch in slices(batches, limit=_SLICE):
        found = known.of(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[_lists(found[v]) for v in VIEWS]], ["doc_id", *VIEWS])


def _drawn(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """About ``size`` rows at most, by the hash of doc_id."""
    share = min(1.0, size / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_RANGE)) < int(share * _RANGE))


def _marks(labels: DataFrame) -> DataFrame:
    """doc_id, low, toxic: the worst complete label of every document."""
    worst = [F.max((F.col("quality") != 1).cast("int")).alias("low"), F.max((F.col("toxic") != 0).cast("int")).alias("toxic")]
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(*worst)
    return marked.withColumn("toxic", F.when(F.col("low") == 0, F.col("toxic")))


def drawn(labels: DataFrame, labelled: int) -> DataFrame:
    """doc_id, low, toxic of about ``labelled`` documents at most."""
    return written(_drawn(_marks(labels), labelled, 1), "drawn")


def sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text and meta traits, low, toxic, held (calibration row) of the ``drawn`` documents."""
    # The list is bounded by the size it was drawn for, so it goes to the documents and no text moves.
    found = _plain(docs).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi").mapInArrow(_traits, _FIELDS)
    return written(found.join(F.broadcast(known), "doc_id").withColumn("held", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(HELD_OUT)) == 0), "sample")


def unlabelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The documents, all of them, that aren't among the ``drawn`` ones."""
    return _plain(docs).join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti").select(*_COLUMNS)


def counts(rows: DataFrame, view: str) -> DataFrame:
    """trait and, per head, the rows of either class that have it; the null trait counts all rows. A row whose label for a head is
    null counts for the others only."""
    sums: list[Column] = [F.sum((F.col(h) == c).cast("long")).alias(f"{h}_{c}") for h in HEADS for c in (0, 1)]
    traits = rows.select(F.explode(F.concat(F.col(view), F.array(F.lit(None).cast("int")))).alias("trait"), *HEADS)
    return traits.groupBy("trait").agg(*[F.coalesce(s, F.lit(0)).alias(f"{h}_{c}") for s, (h, c) in zip(sums, [(h, c) for h in HEADS for c in (0, 1)], strict=True)])


def pseudo_counts(rows: DataFrame, model: Model) -> DataFrame:
    """view, trait and the counts as of ``counts``: the labels that either view is sure of, counted over the other's traits."""
    sent, sure = rows.sparkSession.sparkContext.broadcast(model), math.log(SURE / (1 - SURE))
    names = [f"{h}_{c}" for h in HEADS for c in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads = Traits(), {h: Scorer(sent.value[h]) for h in HEADS}
        held = {v: np.zeros((len(names), SLOTS), np.int32) for v in VIEWS}
        totals = {v: [0] * len(names) for v in VIEWS}
        for batch in slices(batches, limit=_SLICE):
            traits = known.of(batch)
            for v, other in zip(VIEWS, reversed(VIEWS), strict=True):
                z = {h: heads[h].logits(other, traits[other]) for h in HEADS}
                good = z["low"] <= -sure
                chosen = [good, z["low"] >= sure, good & (z["toxic"] <= -sure), good & (z["toxic"] >= sure)]
                slots, sizes = traits[v]
                for i, rows in enumerate(chosen):
                    if not rows.any():
                        continue
                    totals[v][i] += int(rows.sum())
                    held[v][i] += np.bincount(slots[np.repeat(rows, sizes)], minlength=SLOTS).astype(np.int32)
        for v in VIEWS:
            if any(totals[v]):
                yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([None], pa.int32()), *[pa.array([n], pa.int64()) for n in totals[v]]], ["view", "trait", *names])
            used = np.flatnonzero(held[v].any(axis=0))
            for i in range(0, len(used), 1 << 16):
                part = used[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(part), pa.string()), pa.array(part, pa.int32()), *[pa.array(x[part], pa.int64()) for x in held[v]]],
                                                 ["view", "trait", *names])

    kinds = ", ".join(f"{c} long" for c in names)
    return written(rows.mapInArrow(run, f"view string, trait int, {kinds}").groupBy("view", "trait").agg(*[F.sum(c).alias(c) for c in names]), "pseudo")


def weights(table: DataFrame, total: dict[str, int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Slots and log-odds per head of the traits whose shares differ by more than CHANCE standard errors: SLOTS of them at most."""
    parts = []
    for h in HEADS:
        no, yes = max(1, total[f"{h}_0"]), max(1, total[f"{h}_1"])
        a, b = F.col(f"{h}_1"), F.col(f"{h}_0")
        share = (a + b) / (no + yes)
        apart = F.abs(a / yes - b / no) > CHANCE * F.sqrt(share * (1 - share) * (1 / no + 1 / yes))
        parts.append(table.filter(F.col("trait").isNotNull() & apart)
                     .select(F.lit(h).alias("head"), "trait", (F.log((a + 0.5) / (yes + 1)) - F.log((b + 0.5) / (no + 1))).alias("w")))
    found = parts[0].unionByName(parts[1]).toPandas()
    return {h: (own["trait"].to_numpy(np.int64), own["w"].to_numpy(float)) for h in HEADS for own in [found[found["head"] == h].sort_values("trait")]}


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    """rows with a column head_view for every logit."""
    names = [(h, v) for h in HEADS for v in VIEWS]
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {h: Scorer(sent.value[h]) for h in HEADS}
        for batch in batches:
            traits = {v: (batch.column(v).flatten().to_numpy(), pc.list_value_length(batch.column(v)).to_numpy()) for v in VIEWS}
            made = [pa.array(heads[h].logits(v, traits[v]), pa.float64()) for h, v in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f"{h}_{v}" for h, v in names)])
    kinds = ", ".join(f"{h}_{v} double" for h, v in names)
    return rows.mapInArrow(run, f"{_FIELDS}, low int, toxic int, held boolean, {kinds}")


def _calibrate(held: DataFrame, model: Model) -> None:
    """Slopes and offsets of the views and the mix of their logits, from the held-out rows (a share of a bounded sample)."""
    for head in model.values():
        head.line = {v: (1.0, 0.0) for v in VIEWS}
    rows = _logits(held, model).select(*HEADS, *[f"{h}_{v}" for h in HEADS for v in VIEWS]).toPandas()
    for h, head in model.items():
        own = rows[rows[h].notna()]
        y = own[h].to_numpy(float)
        for v in VIEWS:
            slope, offset = logistic(own[[f"{h}_{v}"]].to_numpy(), y)
            head.line[v] = float(slope), float(offset)
        z = np.column_stack([head.line[v][0] * own[f"{h}_{v}"] + head.line[v][1] for v in VIEWS])
        head.mix = tuple(logistic(z, y).tolist())


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """The heads for which there are labels of both classes."""
    with scratch(docs.sparkSession):
        return _train(docs, drawn(labels, labelled), rounds)


def _train(docs: DataFrame, marks: DataFrame, rounds: int) -> Model:
    rows = sample(docs, marks)
    held, base, rest = rows.filter("held"), rows.filter("NOT held"), unlabelled(docs, marks)
    known = {v: written(counts(base, v), f"counts-{v}") for v in VIEWS}
    found = held.agg(*[F.count_distinct(h).alias(h) for h in HEADS]).first()
    model: Model = {h: Head() for h in HEADS}
    extra: dict[str, DataFrame | None] = dict.fromkeys(VIEWS)
    for turn in range(rounds + 1):
        for v in VIEWS:
            table = known[v]
            if extra[v] is not None:
                table = table.unionByName(extra[v]).groupBy("trait").agg(*[F.sum(c).alias(c) for c in table.columns[1:]])
            total = table.filter("trait IS NULL").first()
            for h, w in weights(table, total.asDict() if total else {f"{h}_{c}": 0 for h in HEADS for c in (0, 1)}).items():
                model[h].weights[v] = w
        if min(found) > 0:
            _calibrate(held, model)
        if turn < rounds:
            given = pseudo_counts(rest, model)
            extra = {v: given.filter(F.col("view") == v).drop("view") for v in VIEWS}
    return {h: head for h, head in model.items() if found[h] > 1}


def _each(docs: DataFrame, model: Model, shape: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Callable:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights to a head and view at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads = Traits(), [Scorer(head) for head in sent.value.values()]
        for batch in slices(batches, limit=_SLICE):
            plain = pa.RecordBatch.from_arrays([batch.column(c).cast(t) for c, t in _ARROW.items()], list(_ARROW))
            traits = known.of(plain)
            yield shape(batch, math.prod((1 - head.probability(traits) for head in heads), start=np.ones(batch.num_rows)))
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of good), good (score of at least a half) for every row of ``docs``."""
    def shape(batch: pa.RecordBatch, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "score", "good"])
    return _plain(docs).mapInArrow(_each(docs, model, shape), "doc_id long, score double, good boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""
    return docs.mapInArrow(_each(docs, model, lambda batch, p: batch.filter(pa.array(p >= 0.5))), docs.schema)
