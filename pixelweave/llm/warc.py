"""WARC derivatives: metadata and plain-text conversion records of responses.

``write_responses`` stores pages as response records, ``derive`` turns every
response file into a metadata file (JSON on the record, its headers and links)
and a conversion file (plain text), and ``read_derivatives`` reads the pairs.
A derivative names its response in WARC-Refers-To, keeps its target, date and
source key, and carries digests of its own block; the metadata also keeps the
response's WARC and HTTP headers and digests, which ``derive`` verifies.

Files are WARC/1.1, one gzip member a record, written under a temporary name
and moved, so a lost executor leaves no part of a file. Readers stream record
by record. An identifier is made from a record's contents and its place (file
and number), so equal records have different ones and a rerun of a task makes
the same.

Defined cases: a null html is an empty payload, a null url the target
``about:blank``, a null page_id no source key. Bytes that a header can't hold
are percent-encoded. Repeated rows are records of equal content, each with its
own identifiers. Pages are parsed in one pass whose time grows as their length,
however long or broken they are; one page at a time is in memory. An empty table
makes no file and gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, pick, tune_arrow
from .storage import open_store, write_whole

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6f2a63c4-54be-5f0e-9f0b-0d6a3c1c8d11")
#: Bytes of records (before gzip) after which a file is closed.
FILE_BYTES = 32 << 20

DERIVED = "page_id long, response_id string, metadata_id string, conversion_id string, metadata_refers_to string, conversion_refers_to string, target string, payload_digest string, metadata_digest string, conversion_digest string, title string, n_links long, text_chars long, text_crc32 long"

Header = list[tuple[str, str]]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_value(text: str) -> str:
    """A header value: white space and control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, headers: Header, block: bytes, place: str = "") -> tuple[str, bytes]:
    """(record id, bytes) of a record; the id comes from its headers and block, and its place if equal ones may follow."""
    own = [("WARC-Block-Digest", sha1(block)), *headers]
    number = uuid.uuid5(NAMESPACE, "\n".join([kind, place, *(f"{k}: {v}" for k, v in own)]))
    name = f"<urn:uuid:{number}>"
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *(f"{k}: {v}" for k, v in own), f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open, uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            last, _, value = line.decode("utf-8", "replace").partition(":")
            headers[last] = value.strip()
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record ends early")
        yield headers, block


def open_records(address: str) -> Iterator[tuple[dict[str, str], bytes]]:
    store, path = open_store(address)
    with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as plain:
        yield from read_records(io.BufferedReader(plain, 1 << 20))


def http_block(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def response(page_id: int | None, url: str | None, page: str | None, place: str = "") -> bytes:
    payload = (page or "").encode("utf-8", "surrogatepass")
    headers = [("WARC-Target-URI", safe_value(url or "about:blank")), ("WARC-Date", DATE), ("WARC-Payload-Digest", sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Source-Key", str(page_id)))
    return record("response", headers, http_block(payload), place)[1]


HIDDEN = {"script", "style", "noscript", "template"}
BREAKS = set("p div br hr li ul ol tr td th table h1 h2 h3 h4 h5 h6 section article header footer nav aside main blockquote pre title head body html dl dt dd form option".split())

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*HIDDEN, "title")}
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


def unescape(text: str) -> str:
    """Character references resolved; numbers beyond all characters become the replacement character."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def parse_page(page: str) -> tuple[str, str, list[str]]:
    """(plain text, title, links) in one pass that never looks at a character more than a few times.

    A tag runs from < and a letter, /, ! or ? to the next >; without one, the
    rest is text. What hidden elements and comments hold is left out, to the end
    of the page if they never close. Block elements begin a line. The title is
    what the first title element that closes holds; links are the href of each a.
    """
    out: list[str] = []
    links: list[str] = []
    title: str | None = None
    at, tag = 0, page.find("<")
    while tag >= 0:
        ahead = page[tag + 1 : tag + 2]
        if not (ahead in "/!?" or "a" <= ahead.lower() <= "z") or not ahead:
            tag = page.find("<", tag + 1)
            continue
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
            tag = page.find("<", at)
            continue
        end = page.find(">", tag)
        if end < 0:  # nor is there a later tag
            at = tag
            break
        at = end + 1
        found = _NAME.match(page, tag + 1, end)
        name = found[0].lower() if found else ""
        if name in HIDDEN:
            close = _CLOSING[name].search(page, at)
            close_end = page.find(">", close.start()) if close else -1
            out.append(" ")
            at = close_end + 1 if close_end >= 0 else len(page)
        elif name.removeprefix("/") in BREAKS:
            out.append("\n")
            if name == "title" and title is None:
                close = _CLOSING[name].search(page, at)
                title = " ".join(unescape(page[at : close.start()]).split()) if close else ""  # without an end, no later one has any
        elif name == "a":
            href = _HREF.search(page, found.end(), end)
            if href:
                links.append(unescape(href[1] or href[2] or href[3] or ""))
        tag = page.find("<", at)
    out.append(page[at:])
    lines = (" ".join(line.split()) for line in unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line), title or "", links


def plain_text(page: str) -> str:
    """Visible text: a line per block element, white space collapsed."""
    return parse_page(page)[0]


def derivatives(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The metadata and conversion records of a response record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    payload_digest = sha1(payload)
    if headers.get("WARC-Payload-Digest", payload_digest) != payload_digest or "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != sha1(block):
        raise ValueError(f"digest mismatch in {headers.get('WARC-Record-ID')}")
    status, *fields = head.decode("latin-1").split("\r\n")
    page = payload.decode("utf-8", "replace")
    text, title, links = parse_page(page)
    envelope = {
        "source": headers,
        "http": {"status": status, "headers": dict(f.split(": ", 1) for f in fields if ": " in f)},
        "title": title,
        "links": links,
    }
    linked = [("WARC-Refers-To", headers["WARC-Record-ID"]), *((k, headers[k]) for k in ("WARC-Target-URI", "WARC-Date", "X-Source-Key") if k in headers)]
    meta = record("metadata", [*linked, ("Content-Type", "application/json")], json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"))[1]
    return meta, record("conversion", [*linked, ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", "text/plain; charset=utf-8")], text.encode("utf-8", "replace"))[1]


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes on every run."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_responses(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Response files of ``pages`` (page_id, url, html); one row (path, records) a file."""
    spark = pages.sparkSession
    tune_arrow(spark)
    folder = folder or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        part, k, held = TaskContext.get().partitionId(), 0, next(rows, None)
        while held is not None:
            address, count = f"{folder}/{part:06d}-{k:04d}.warc.gz", [0]

            def fill(out):
                nonlocal held
                size = 0
                while held is not None and size < file_bytes:
                    data = response(*held, f"{part}/{k}/{count[0]}")
                    out.write(member(data))
                    size, count[0], held = size + len(data), count[0] + 1, next(rows, None)

            write_whole(address, fill)
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([address]), pa.array(count, pa.int64())], names=["path", "records"])

    chosen = pick(pages, ["page_id", "url", "html"]).withColumn("page_id", F.col("page_id").cast("long"))
    return materialise(chosen.mapInArrow(run, "path string, records long"), "warc-files")


def _each_file(files: DataFrame) -> DataFrame:
    """A task for each file."""
    n = max(1, files.count())
    return files.select("path").repartition(n, "path") if n > 1 else files.select("path").coalesce(1)


def derive(files: DataFrame) -> DataFrame:
    """Writes the metadata (.wat.gz) and conversion (.wet.gz) file of each response file, beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                stem = address.removesuffix(".warc.gz")
                count = [0]

                def fill_meta(meta_out, address=address, stem=stem, count=count):
                    def fill_text(text_out):
                        for headers, block in open_records(address):
                            if headers.get("WARC-Type") != "response":
                                continue
                            meta, text = derivatives(headers, block)
                            meta_out.write(member(meta))
                            text_out.write(member(text))
                            count[0] += 1

                    write_whole(f"{stem}.wet.gz", fill_text)

                write_whole(f"{stem}.wat.gz", fill_meta)
                yield pa.RecordBatch.from_arrays([pa.array([stem]), pa.array(count, pa.int64())], names=["path", "records"])

    return materialise(_each_file(files).mapInArrow(run, "path string, records long"), "warc-derived")


def read_derivatives(stems: DataFrame) -> DataFrame:
    """One row a response, from its metadata and conversion records."""
    names = [c.split()[0] for c in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem in batch.column(0).to_pylist():
                rows = []
                for (mh, mb), (ch, cb) in zip(open_records(f"{stem}.wat.gz"), open_records(f"{stem}.wet.gz"), strict=True):
                    envelope = json.loads(mb)
                    source = envelope["source"]
                    if not sha1(mb) == mh["WARC-Block-Digest"] or not sha1(cb) == ch["WARC-Block-Digest"]:
                        raise ValueError(f"digest mismatch in {stem}")
                    key = mh.get("X-Source-Key")
                    rows.append((int(key) if key is not None else None, source["WARC-Record-ID"], mh["WARC-Record-ID"], ch["WARC-Record-ID"], mh["WARC-Refers-To"], ch["WARC-Refers-To"], mh["WARC-Target-URI"], ch["WARC-Source-Payload-Digest"], mh["WARC-Block-Digest"], ch["WARC-Block-Digest"], envelope["title"], len(envelope["links"]), len(cb.decode()), zlib.crc32(cb)))
                    if len(rows) == 5000:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return _each_file(stems).mapInArrow(run, DERIVED)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    whole_numbers = {c.split()[0] for c in DERIVED.split(", ") if c.endswith("long")}
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n in whole_numbers else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def build_derivatives(pages: DataFrame) -> DataFrame:
    """Pages to response files to derivative files, and the rows read back from those."""
    return read_derivatives(derive(write_responses(pages)))
