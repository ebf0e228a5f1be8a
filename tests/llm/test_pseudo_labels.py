"""Co-training reads every unlabelled document, not a sample of them."""

import math
import random

import numpy as np
import pyarrow as pa

from tallycell.llm import cotraining

RNG = random.Random(3)


def test_traits_of_a_small_source_among_many_unlabelled_documents(spark, monkeypatch):
    """The words of the small source are in no labelled document; its junk is known by its layout."""
    rows, labels = [], []
    for i in range(9000):
        junk = i % 2 == 0
        small = i >= 8600
        words = [f"{'q' if small and junk else 'r' if small else 'w'}{RNG.randrange(40 if small else 300)}x" for _ in range(30)]
        text = " ".join(w + "{}{}{}{}" for w in words) if junk else " ".join(words)
        rows.append((i, text, "en", "s", len(words)))
        if i < 800:
            labels.append((i, int(not junk), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert cotraining.unlabelled(docs, cotraining.drawn(given, 20_000)).count() == 8200
    seen = []
    counted = cotraining.pseudo_counts

    def watched(rest, model):
        table = counted(rest, model)
        seen.append(table.filter("view = 'text' AND trait IS NULL").first())
        return table

    monkeypatch.setattr(cotraining, "pseudo_counts", watched)
    model = cotraining.train(docs, given)
    assert [total.low_0 + total.low_1 for total in seen] == [8200, 8200]
    weights = model["low"].dense("text")
    assert all(weights[cotraining.slot(f"q{k}x{{}}{{}}{{}}{{}}")] > 0 for k in range(40))
    assert all(weights[cotraining.slot(f"r{k}x")] < 0 for k in range(40))


def test_traits_of_a_slice_equal_those_of_each_text():
    """Against sets of strings built word by word."""
    texts = ["Some WORDS some words", "", None, "a a a b ΣΑΣ\nLONGER words!! {x}", "wordsmith " * 50]
    rows = [(t, lang, s, n) for t, lang, s, n in zip(texts, ["en", None, "de", "en", "en"], ["s", "s", None, "x y", "s"], [21, None, None, -4, 7], strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), cotraining._ARROW.values(), strict=True)], list(cotraining._ARROW))
    got = cotraining.Traits().of(batch)
    for view in cotraining.VIEWS:
        parts = np.split(got[view][0], np.cumsum(got[view][1])[:-1])
        for part, (text, lang, source, n_chars) in zip(parts, rows, strict=True):
            text = text or ""
            words, size = text.split(), max(1, len(text))
            low, n = set(text.lower().split()), max(1, len(words))
            if view == "text":
                want = low | {w[:k] + " " for w in low for k in cotraining.STEMS if len(w) > k}
            else:
                figures = {"chars": math.log2(1 + (size if n_chars is None else max(0, n_chars))), "lines": math.log2(1 + text.count("\n")),
                           "word": math.log2(size / n) * 2, "symbols": math.log2(1e-3 + sum(map(text.count, "#$%&*|!<>{}[]\\/=+~^@_")) / size),
                           "upper": 8 * sum(w.isupper() for w in words) / n, "same": 16 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
                           "distinct": 8 * len(set(words)) / n}
                want = {f"lang {lang}", f"source {source}", *(f"{k} {math.floor(v)}" for k, v in figures.items())}
            assert part.tolist() == sorted({cotraining.slot(t) for t in want})
