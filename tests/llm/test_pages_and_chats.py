"""Archives and chats: round trips."""

import base64
import hashlib
import io
import re
import uuid
import zlib

import pytest

from tallycell.llm import chat_format, warc


def test_archives(spark):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nv", None), (4, "u", ""), (4, "u", ""), (0, "u", "big " * 700_000), (None, "u", "<p>é</p>"),
            (None, "u", "alone"), (9, "u", "WARC/1.1\r\n\r\n"), (8, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, revisit string").repartition(3)
    got = sorted((tuple(r) for r in warc.through_archives(pages).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        response = first is None or i == first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first, html or "" if response else None))
    assert got == sorted(want, key=str)
    assert warc.through_archives(pages.filter("false")).count() == 0


def test_members_and_sidecar_offsets(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * i) for i in range(50)], "page_id long, url string, html string").repartition(2)
    folder = str(tmp_path / uuid.uuid4().hex)
    mono = warc.write_monolithic(warc.classified(pages), folder)
    made = warc.normalise(mono, folder).collect()
    assert sum(r.n_records for r in made) == 50
    for r in made:
        data = open(f"{folder}/{r.archive}", "rb").read()
        index = [x.split() for x in open(f"{folder}/{r.sidecar}")]
        assert sum(int(n) for _, n, _ in index) == len(data)
        for offset, n, name in index:
            fields, body = warc.parse(zlib.decompress(data[int(offset):int(offset) + int(n)], 31))
            page = int(name[len("<urn:page:"):-1])
            assert fields["WARC-Record-ID"] == name and body.partition(b"\r\n\r\n")[2].decode() == f"page {page} " * page


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_streams_of_one_or_many_members(monkeypatch, block):
    records = [warc.record(i, "u", b"x" * i * 100, None, False) for i in range(30)]
    one = zlib.compressobj(6, zlib.DEFLATED, 31)
    streams = [one.compress(b"".join(records)) + one.flush(), b"".join(map(warc._member, records))]
    monkeypatch.setattr(warc, "BLOCK", block)
    for data in streams:
        assert list(warc.split_records(warc.inflated(io.BytesIO(data)))) == records
    with pytest.raises((ValueError, zlib.error)):
        list(warc.split_records(warc.inflated(io.BytesIO(streams[0][:-20]))))


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>\n<|im_start|>user\n"), (1, 2, "user", ""), (1, 3, "assistant", "<~|x|> <~~| <<|>"),
         (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 0, "system", "s"), (3, 1, "user", "é😀"), (3, 2, "assistant", "ok\n"),
         (4, 5, "user\n<|im_end|>", "odd role"), (4, 5, "user\n<|im_end|>", "odd role"), (5, None, None, None), (5, 1, "assistant", "a"), (None, 0, "user", "no id"), (6, 1, "tool", "<")]


def test_chats(spark):
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    chats = chat_format.format_chats(rows)
    got = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in chats.select("conv_id", chat_format.read_back(chats["formatted"]).alias("turns")).collect()}
    shown = {r.conv_id: r for r in chats.collect()}
    for conv in {t[0] for t in TURNS}:
        turns = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        plain = [(t[2] or "", t[3] or "") for t in turns]
        loss = "".join(x for role, x in plain if role == "assistant")
        assert back[conv] == plain
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(plain), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in plain).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = shown[conv].formatted
        assert r.formatted_chars == len(text) and "".join(s.text for s in shown[conv].segments) == text
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(plain)
        roles = " ".join(a for a, _ in plain)
        assert r.valid == bool(re.fullmatch(r"(system )?user assistant( user assistant)*", roles))
    assert {c: r.refused for c, r in shown.items()} == {1: None, 2: 1, 3: None, 4: 1, 5: 1, 6: 1, None: None}
    assert chat_format.format_chats(rows.filter("false")).count() == 0
