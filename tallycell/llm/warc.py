"""WARC archives: a normaliser for monolithic gzip files, and pages written, de-duplicated and read back through it.

Writers leave whole-file gzip streams. The normaliser inflates such a stream once, block by block, writes every record as a
gzip member of its own and a sidecar index of their offsets, through which single records are read. Archives and indexes are
files in the shared folder (reached through pyarrow's file systems); an attempt that fails leaves a file that nothing names.

Equal payloads: the page with the smallest page_id is the response, others are revisits that name it. Nulls: a null html is an
empty payload; a page without page_id is a revisit where an equal payload has one, and a response else; several rows with the
smallest page_id are all responses. A null url leaves out its header. Empty tables give no archives and no rows. Columns other
than page_id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.llm.common import attach, checkpoint_folder, slices, texts, written

ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 20
LEVEL = 3
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
              ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_PAGE}{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the blocks of an inflated stream."""
    held, need = bytearray(), 0
    for block in stream:
        held += block
        while len(held) >= max(need, 1):
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                sizes = [x[15:] for x in bytes(held[:end]).split(b"\r\n") if x[:15].lower() == b"content-length:"]
                need = end + 4 + int(sizes[0]) + 4
                continue
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends inside a record")


def inflated(source: pa.NativeFile) -> Iterator[bytes]:
    """The content of a gzip file in blocks, be it one stream or many members."""
    engine = zlib.decompressobj(31)
    while block := source.read(BLOCK):
        while block:
            yield engine.decompress(block, BLOCK)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, BLOCK)
            block = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def _member(raw: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, revisit."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"), F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")), 256).alias("_sha"))
    groups = plain.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 AND _first IS NOT NULL")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return attach(plain, groups, ["_sha"], ["page_id"]).select(
        "page_id", "url", "html", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write classified pages to archives of one gzip stream each; returns their names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        store.create_dir(path, recursive=True)
        names, sink, engine, size = [], None, None, 0
        for batch in slices(batches, "html"):
            payloads = texts(batch, "html")
            for i, (page_id, url, refers_to, revisit) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit")], strict=True)):
                if sink is None:
                    names.append(f"{uuid.uuid4().hex}.mono.warc.gz")
                    sink, engine, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                raw = record(page_id, url, payloads[i], refers_to, revisit)
                sink.write(engine.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    sink.write(engine.flush())
                    sink.close()
                    sink = None
        if sink is not None:
            sink.write(engine.flush())
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["archive"])
    return written(pages.mapInArrow(run, "archive string"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record beside a sidecar index; returns archive, sidecar and n_records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                made = f"{uuid.uuid4().hex}.warc.gz"
                offset, index = 0, []
                with store.open_input_file(f"{path}/{name}") as source, store.open_output_stream(f"{path}/{made}", compression=None) as sink:
                    for raw in split_records(inflated(source)):
                        member = _member(raw)
                        sink.write(member)
                        index.append((offset, len(member), parse(raw)[0]["WARC-Record-ID"]))
                        offset += len(member)
                with store.open_output_stream(f"{path}/{made}.idx", compression=None) as sink:
                    sink.write("".join(f"{a} {n} {x}\n" for a, n, x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([f"{made}.idx"]), pa.array([len(index)], pa.int64())],
                                                 ["archive", "sidecar", "n_records"])
    return written(archives.repartition(max(1, archives.count())).mapInArrow(run, "archive string, sidecar string, n_records long"), "normalised")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of normalised archives, each read at its offset: page_id, payload_bytes, payload_digest, record_type,
    refers_to, html (null for revisits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        for batch in batches:
            for name, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{sidecar}", compression=None) as source:
                    index = [line.split(" ") for line in source.read().decode().splitlines()]
                with store.open_input_file(f"{path}/{name}") as source:
                    for start in range(0, len(index), 256):
                        rows = [_row(zlib.decompress(source.read_at(int(n), int(a)), 31)) for a, n, _ in index[start:start + 256]]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
    return archives.repartition(max(1, archives.count())).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix(f"<{_PAGE}").removesuffix(">")
    return int(number) if number else None


def _row(raw: bytes) -> tuple:
    fields, body = parse(raw)
    head, _, payload = body.partition(b"\r\n\r\n")
    size = int(head.decode().rpartition("Content-Length: ")[2])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (digest(payload) != said or len(payload) != size):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what its header says")
    return (_page(fields["WARC-Record-ID"]), size, said, kind, _page(fields.get("WARC-Refers-To")), payload.decode() if kind == "response" else None)


def through_archives(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, read the records back."""
    folder = f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(normalise(write_monolithic(classified(pages), folder), folder), folder)


#: DuckDB twin of the registered query.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p),
b AS (SELECT DISTINCT d, array_to_string(list_transform(range(0, 160, 5), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, i + j + 1, 1) AS INT) * (16 >> (j::INT))))::INT, 1)), '') AS b32
  FROM (SELECT d, array_to_string(list_transform(range(1, 41), lambda k: substr('0000000100100011010001010110011110001001101010111100110111101111',
    1 + 4 * (instr('0123456789abcdef', substr(d, k, 1)) - 1), 4)), '') AS bits FROM (SELECT DISTINCT d FROM p)))
SELECT page_id, octet_length(encode(t)) AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f JOIN b USING (d)"""
