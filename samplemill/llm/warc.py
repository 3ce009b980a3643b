"""WARC derivatives: responses to linked metadata and plain-text conversion records.

A response record is parsed from its bytes, and the codings of its body are undone; from its HTML come
a conversion record (text/plain) and a metadata record (warc-fields). Both refer to the response by WARC-Refers-To with its URI and date, are
concurrent to one another, and carry the response's HTTP headers and digests along. Record ids are
derived from the source's id, so that a task that runs twice writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, write_atomically, written

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|svg|head)\b", re.IGNORECASE)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.IGNORECASE) for k in ("script", "style", "noscript", "template", "svg", "head")} | {"": re.compile("-->")}
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|nav|header|footer|main|aside|blockquote|pre|form|dd|dt|dl|hr|figure|figcaption|option)\b[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.IGNORECASE), re.compile(r"</title\s*>", re.IGNORECASE)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([\w-]+)", re.IGNORECASE)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_BLANKS = re.compile(r"[^\S\n]+")
_SCHEMA = "source_id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_headers string, source_block_digest string, source_payload_digest string, block string, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, what: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{what}')}>"


def one_line(value: str) -> str:
    """A header value: line breaks and other white space become blanks."""
    return " ".join(value.split())


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {one_line(v)}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def header_list(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line, and (lower-case name, value) of each header in order, repeated ones too; a line that
    begins with a blank goes on with the header before."""
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif colon:
            out.append((name.strip().lower(), value.strip()))
    return first, out


def by_name(headers: list[tuple[str, str]]) -> dict[str, str]:
    """The first value of each name."""
    return dict(reversed(headers))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC headers by lower-case name, block); ValueError says why a record can't be read."""
    head, end, rest = record.partition(b"\r\n\r\n")
    first, headers = header_list(head)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = by_name(headers)
    size = warc.get("content-length", "")
    if not end or not (size.isascii() and size.isdigit()):
        raise ValueError("no Content-Length")
    if len(rest) < int(size):
        raise ValueError("shorter than its Content-Length")
    if not warc.get("warc-record-id"):
        raise ValueError("no WARC-Record-ID")
    return warc, rest[: int(size)]


def unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; ValueError where the chunks don't fit."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + size])
        if len(out[-1]) < size:
            raise ValueError("a chunk is cut off")
        at = line + 2 + size + 2


def plain_body(payload: bytes, http: dict[str, str]) -> bytes:
    """The body without its transfer and content codings (chunked; gzip, deflate, zstd), the last one first.
    What isn't coded as its header says, and codings that aren't known, stay as they are."""
    import zstandard

    undo = {
        "chunked": unchunked,
        "gzip": lambda b: zlib.decompressobj(31).decompress(b),
        "deflate": lambda b: zlib.decompress(b, 15 if b[:1] and b[0] & 15 == 8 else -15),
        "zstd": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b),
    }
    codings = [c.strip().lower().removeprefix("x-") for h in ("content-encoding", "transfer-encoding") for c in http.get(h, "").split(",")]
    for coding in reversed([c for c in codings if c not in ("", "identity")]):
        try:
            payload = undo[coding](payload)
        except (KeyError, ValueError, zlib.error, zstandard.ZstdError):
            return payload
    return payload


def parse_all(data: bytes) -> Iterator[bytes]:
    """The records of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at) + 4
        end = head + int(by_name(header_list(data[at : head - 4])[1])["content-length"]) + 4
        yield data[at:end]
        at = end


def response_record(url: str | None, page_id: int | None, page: str | None, date: str = DATE) -> bytes:
    """A response with the page; a null url or page is empty."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return record_bytes([
        ("WARC-Type", "response"), ("WARC-Record-ID", derived_id(url or "", f"response-{page_id}")), ("WARC-Target-URI", url or ""), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(http)), ("WARC-Payload-Digest", digest(payload)),
    ], http)


def without_hidden(page: str) -> str:
    """The page with a blank for each comment, script, style, head and the like. One that is never closed
    stays; its kind isn't looked for again, so that a page of them takes linear time."""
    out, at, done, unclosed = [], 0, 0, set()
    while found := _HIDDEN.search(page, at):
        kind = (found[1] or "").lower()
        end = None if kind in unclosed else _CLOSE[kind].search(page, found.end())
        if end is None:
            unclosed.add(kind)
            at = found.end()
        else:
            out += [page[done : found.start()], " "]
            at = done = end.end()
    return "".join([*out, page[done:]])


def title_of(page: str) -> str:
    """What stands between the first <title> and the </title> after it; empty without either."""
    begins = _TITLE.search(page)
    ends = begins and _TITLE_END.search(page, begins.end())
    return one_line(html.unescape(page[begins.end() : ends.start()])) if ends else ""


def plain_text(page: str) -> str:
    """Visible text, a line for each block that isn't empty."""
    shown = without_hidden(page)
    # nothing after the last > is a tag: so each < finds its > without another look at the whole rest
    cut = shown.rfind(">") + 1
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", shown[:cut])) + shown[cut:])
    return "\n".join(line for line in (_BLANKS.sub(" ", x).strip() for x in text.split("\n")) if line)


def derive(record: bytes) -> list[tuple]:
    """The conversion and metadata rows of a response record, in the order of the schema after source_id;
    none for a record of another type."""
    warc, block = parse_record(record)
    if warc.get("warc-type", "").lower() != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, headers = header_list(head)
    http = by_name(headers)
    payload = plain_body(payload, http)
    charset = (re.search(r"charset=[\"']?([\w-]+)", http.get("content-type", ""), re.IGNORECASE) or [None, "utf-8"])[1]
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source, uri, date = warc["warc-record-id"], warc.get("warc-target-uri", ""), warc.get("warc-date", "")
    ids = {k: derived_id(source, k) for k in ("conversion", "metadata")}
    fields = [("title", title_of(page)), ("language", (_LANG.search(page) or ["", ""])[1]), ("http-status", status), *[(f"http-{k}", v) for k, v in headers]]
    fields += [("source-block-digest", warc.get("warc-block-digest", "")), ("source-payload-digest", warc.get("warc-payload-digest", "")), ("via", uri)]
    fields += [("outlink", one_line(html.unescape(next(g for g in (*m.groups(), "") if g is not None)))) for m in _LINK.finditer(page)]
    blocks = {"conversion": ("text/plain; charset=utf-8", plain_text(page)), "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields))}
    out = []
    for kind, (content_type, text) in blocks.items():
        data, other = text.encode("utf-8", "surrogatepass"), ids["metadata" if kind == "conversion" else "conversion"]
        made = record_bytes([
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", other), ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type),
        ], data)
        out.append((kind, ids[kind], source, other, uri, date, content_type, len(data), digest(data), head.decode("utf-8", "replace"), warc.get("warc-block-digest"), warc.get("warc-payload-digest"), text, made))
    return out


def build_responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """pages (page_id, url, html) to source_id and record (a response's bytes).

    A null or empty url or html is empty; a null page_id stays null. Repeated rows give repeated records
    with equal ids. Very long pages are one record. An empty table gives none. Other columns aren't read.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["source_id"].astype("Int64")
            yield pd.DataFrame({"source_id": ids, "record": [response_record(u, None if pd.isna(i) else int(i), h, date) for i, u, h in zip(ids, batch["url"], batch["html"], strict=True)]})

    rows = pages.select(F.col("page_id").cast("long").alias("source_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(build, "source_id long, record binary")


def fault_of(record: bytes | None) -> str | None:
    """Why a record can't be read; null if it can."""
    try:
        parse_record(record or b"")
    except ValueError as e:
        return str(e)
    return None


def unreadable_records(responses: DataFrame) -> DataFrame:
    """source_id and reason of each record of responses (source_id, record) that build_derivatives passes over
    because it is null or can't be read. Repeated rows are listed each; no rows: none."""

    def faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reasons = [fault_of(None if r is None else bytes(r)) for r in batch["record"]]
            found = pd.DataFrame({"source_id": batch["source_id"].astype("Int64"), "reason": reasons})
            yield found[found["reason"].notna()]

    return responses.select(F.col("source_id").cast("long").alias("source_id"), "record").mapInPandas(faults, "source_id long, reason string")


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for each response of responses (source_id, record): its conversion and its metadata.

    Columns: source_id, warc_type, record_id, refers_to, concurrent_to, target_uri, warc_date,
    content_type, content_length, block_digest, source_headers, source_block_digest,
    source_payload_digest, block (text) and record (the whole WARC record).

    Of repeated headers all are kept. A record of another type than response gives no rows, nor does a
    null record or one that can't be read: unreadable_records lists those. An empty page has empty text
    and its metadata. A null source_id stays null; repeated responses give repeated rows with equal ids. Very
    long pages are converted whole. An empty table gives an empty result. Other columns aren't read.
    """

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                rows = [(i, *d) for i, r in zip(some["source_id"], some["record"], strict=True) if fault_of(bytes(r)) is None for d in derive(bytes(r))]
                yield pd.DataFrame(rows, columns=columns).astype({"source_id": "Int64"})

    return responses.select(F.col("source_id").cast("long").alias("source_id"), "record").filter("record is not null").mapInPandas(convert, _SCHEMA)


def write_warc(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write records (record) to .warc.gz files, a gzip member each; returns path and n_records.

    A file for each partition of records, under a name that a second run of the task replaces. Null records
    are left out; repeated ones are written each. No records: files without members. Other columns aren't
    read.
    """
    folder = folder or new_folder(records.sparkSession, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        path, n = f"{folder}/derived-{TaskContext.get().partitionId():06d}.warc.gz", [0]

        def members() -> Iterator[bytes]:
            for batch in batches:
                n[0] += len(batch)
                yield from (gzip.compress(bytes(r), 6, mtime=0) for r in batch["record"])

        write_atomically(path, members())
        yield pd.DataFrame({"path": [path], "n_records": n})

    return written(records.select("record").filter("record is not null").mapInPandas(write, "path string, n_records long"), "warc-files")
