import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from tallycell.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    draw = random.Random(11)
    marks = "aZéßΣςİ K9٣½'’.,;:!?-_=≠<>|#@̸́̌᷶  ​\x00\x1f\x7f\t\n日本語한국😀👩‍💻ﬁ"
    out = ["".join(draw.choices(marks, k=draw.choice([1, 3, 8, 40]))) for _ in range(400)]
    out += ["it's we'll I'M don't 'sa 's's x'd3", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|>x9<|", "J̌ ǰ Å ≠ a̸ 1̸ ≮",
            "abc123def4.5.6...x--y", "x" * 5000, "word " * 30_000, "", " ", "\n\n", "No break and line"]
    return out


def test_pieces_give_the_librarys_ids(library):
    own, rows = tf.Encoder(PATH), [*texts(), None, *texts()[:50]]
    for part in (rows[:7], rows[7:]):
        ids, lengths = own.encode(pa.array(part, pa.string()), 1)
        ends = np.cumsum(lengths)
        for text, end, n in zip(part, ends, lengths, strict=True):
            assert ids[end - n:end].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


def test_every_character_beside_letters_digits_and_marks(library):
    own = tf.Encoder(PATH)
    for a in range(0, 0x3200, 512):
        rows = [f"a{chr(c)}1{chr(c)}b.{chr(c)}'{chr(c)}s" for c in range(a, a + 512) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
        ids, lengths = own.encode(pa.array(rows, pa.string()), None)
        ends = np.cumsum(lengths)
        assert [ids[e - n:e].tolist() for e, n in zip(ends, lengths, strict=True)] == [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 511, 5000, 300_001])
def test_blocks_come_back(n):
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.zipf(1.3, n), 49_000).astype(np.uint32)
    table = tf.Table.of(np.bincount(ids, minlength=3) if n else np.array([1]))
    data = tf.encode_block(ids, table)
    back, end = tf.decode_block(b"xy" + data, 2, table)
    assert back.tolist() == ids.tolist() and end == len(data) + 2
    if n > 200_000:
        share = np.bincount(ids) / n
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() * n / 8
        assert len(data) < 1.05 * entropy


def test_tables():
    for counts in ([5], [1] * 60_000, [10 ** 12, 1, 1, 0, 1], list(range(3000)), [10 ** 9] * 40_000 + [1] * 9000):
        table = tf.Table.of(np.array(counts, np.int64))
        assert int(table.freq.sum()) == 1 << table.bits and ((table.freq > 0) == (np.array(counts) > 0)).all()
        assert tf.Table.from_bytes(table.to_bytes()).freq.tolist() == table.freq.tolist()
    with pytest.raises(ValueError):
        tf.Table.from_bytes(table.to_bytes()[:-3])
    with pytest.raises(ValueError):
        tf.encode_block(np.array([1], np.uint32), tf.Table.of(np.array([3, 0, 2])))


def rows():
    made = [((i * 37) % 401, t) for i, t in enumerate(texts())]
    return [*made, (None, "no id"), (None, "no id"), (None, None), (900, None), (901, ""), (3, "again"), (3, "again"), (-5, "first of all"), (902, "long " * 200_000)]


def wanted(library, given):
    made = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in given]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in made]
    return sorted(((d, len(x), c) for (d, x), c in zip(made, crc, strict=True)), key=str)


def test_round_trip(spark, library):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows()], "doc_id long, text string, packed string, start int").repartition(5)
    archive = tf.write_files(tf.token_ids(docs, PATH), tf.new_folder(spark), file_bytes=3000, chunk=500)
    assert archive.files.count() > 3
    got = tf.read_files(archive, digest=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == wanted(library, rows())
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    back = tf.read_files(archive).collect()
    assert sorted(((r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back), key=str) == wanted(library, rows())


def test_damage_is_found(spark, tmp_path):
    table = tf.Table.of(np.bincount([1, 2, 2, 3]))
    store = fs.LocalFileSystem()
    writer = tf.Writer(store.open_output_stream(f"{tmp_path}/a", compression=None), table)
    writer.add(4, np.array([1, 2, 3], np.uint32))
    assert writer.close() == (1, 3)
    with store.open_input_file(f"{tmp_path}/a") as source:
        [c] = tf.read_checkpoints(source)
        data = source.read_at(int(c["size"]), int(c["offset"]))
    said = int(c["n_docs"]), int(c["n_tokens"]), int(c["crc32"]), table
    assert [(d, x.tolist()) for d, x in tf.unpack_chunk(data, *said)] == [(4, [1, 2, 3])]
    with pytest.raises(ValueError):
        list(tf.unpack_chunk(data[:-1] + b"?", *said))
    (tmp_path / "b").write_bytes((tmp_path / "a").read_bytes()[:-5])
    with pytest.raises(ValueError), store.open_input_file(f"{tmp_path}/b") as source:
        tf.read_checkpoints(source)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.through_files(docs, PATH).count() == 0


def test_words_are_learned_once_whatever_their_case(library):
    own = tf.Encoder(PATH)
    for texts in (["Quorbly QUORBLY quorbly, qUORBLY"], ["İstanbul H̱ ẖ Don't <|ENDOFTEXT|> <|endoftext|> ΣΑΣ Ⅷ quorbly"]):
        ids, lengths = own.encode(pa.array(texts), None)
        assert ids.tolist() == [i for x in texts for i in library.encode(x, add_special_tokens=False).ids] and lengths.sum() == len(ids)
        if texts[0].isascii():
            assert len(own.cuts) - 1 == 2  # the word and the comma
