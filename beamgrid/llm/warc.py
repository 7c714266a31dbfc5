"""WARC derivatives: responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import _stage

VERSION = "WARC/1.1"
_SPACE = bytes.fromhex("6ba7b8119dad11d180b400c04fd430c8")  # the URL name space, a fixed value of RFC 9562
#: Headers of a response that its derivatives carry on under "WARC-Source-", as their own have these names.
_OWN = {"warc-type", "content-type", "content-length", "warc-block-digest", "warc-payload-digest"}

_ATTRIBUTES = r"(?:[^=<>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
#: Comments and elements that say nothing (to their end tag, or the page's end), tags that break a line, other tags.
_MARKUP = re.compile(
    rf"(?i)<(?:!--(?s:.*?)(?:-->|\Z)|(script|style|noscript|template|svg)\b{_ATTRIBUTES}(?:[^<]++|<(?!/\1\b))*+(?:</\1\b[^>]*+>|\Z)"
    rf"|/?+(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|aside|main|blockquote|pre|title|head|body|form|dd|dt|dl|figure|hr)\b{_ATTRIBUTES}|[a-z/!?]{_ATTRIBUTES})"
)
_TITLE = re.compile(rf"(?i)<title\b{_ATTRIBUTES}([^<]*+(?:<(?!/title\b)[^<]*+)*+)</title\b")
_LINK = re.compile(r"(?i)<a\s(?:[^=<>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*?\bhref\s*=\s*[\"']?[^\"'\s>]")
_CHARSET = re.compile(r"(?i)charset=[\"']?([\w.:-]+)")


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(x: str) -> str:
    return re.sub(r"[\r\n]+", " ", x) if "\r" in x or "\n" in x else x


def record(headers: list[tuple[str, str]], block: bytes, digest: str | None = None) -> bytes:
    """A WARC record; Content-Length and WARC-Block-Digest (the block's, if it is known already) are added."""
    lines = [VERSION, *[f"{k}: {_one_line(v)}" for k, v in headers], f"WARC-Block-Digest: {digest or sha1_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        x = line.decode("utf-8", "replace")
        if x[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}")
        elif ":" in x:
            k, _, v = x.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record; the block has Content-Length bytes, all that are there if it isn't given."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _headers(lines)
    n = next((v for k, v in headers if k.lower() == "content-length"), "")
    return headers, rest[: int(n)] if n.isdigit() else rest


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = head.split(b"\r\n")
    return first.decode("latin-1"), _headers(lines), payload


def _unchunked(payload: bytes) -> bytes:
    """The body of a chunked message, as far as its chunks are whole; the payload as it is if it doesn't begin with a chunk."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        size = payload[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else payload


def _decompressed(body: bytes, encoding: str) -> bytes:
    """The body without its content codings (gzip and deflate), as far as it can be read; other codings stay."""
    for name in reversed([x.strip().lower() for x in encoding.split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(name, ()):
            d, parts = zlib.decompressobj(bits), []
            try:
                for k in range(0, len(body), 1 << 16):  # what was read before an error or a cut counts
                    parts.append(d.decompress(body[k : k + (1 << 16)]))
            except zlib.error:
                pass
            if any(parts):
                body = b"".join(parts)
                break
    return body


def plain_text(page: str) -> str:
    """What a page says: without scripts, styles and tags, a line for each block, entities resolved, blanks squeezed."""
    x = html_lib.unescape(_MARKUP.sub(lambda m: "\n" if m[2] else "", page))
    return "\n".join([y for line in x.split("\n") if (y := " ".join(line.split()))])


def _id(kind: str, of: str) -> str:
    """A name-based UUID (version 5) of the URL name space."""
    h = bytearray(hashlib.sha1(_SPACE + f"{kind} {of}".encode()).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def derive(data: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record; none of what is no WARC record.

    Both refer to the response's id, keep its target, date and other headers (those that derivatives have themselves as
    WARC-Source-Type, WARC-Source-Content-Type and so on), and state the digest of the payload they were made from; their ids follow
    from the response's, so a rerun gives the same records. Chunks and gzip or deflate codings of the payload are undone for the
    text; the digest is of the payload as it was sent.
    """
    if not data.startswith(b"WARC/"):
        return []
    headers, block = parse(data)
    by = {k.lower(): v for k, v in headers}
    status, http, payload = split_http(block)
    sent = {k.lower(): v for k, v in http}
    source, digest = by.get("warc-record-id", ""), sha1_digest(payload)
    valid, body = by.get("warc-payload-digest") == digest, payload
    if "chunked" in sent.get("transfer-encoding", "").lower():
        body = _unchunked(payload)
        valid = valid or by.get("warc-payload-digest") == sha1_digest(body)  # some writers leave the chunks' frame out
    if "content-encoding" in sent:
        body = _decompressed(body, sent["content-encoding"])
    charset = (_CHARSET.search(sent.get("content-type", "")) or [None, "utf-8"])[1]
    try:
        page = body.decode(charset, "replace")
    except (LookupError, ValueError):  # unknown, or no text encoding
        page = body.decode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "replace")
    title = _TITLE.search(page)
    conversion_id, metadata_id, text_digest = _id("conversion", source), _id("metadata", source), sha1_digest(text)
    shared = [("WARC-Refers-To", source), ("WARC-Source-Payload-Digest", digest)]
    if "warc-payload-digest" in by:
        shared.append(("WARC-Source-Digest-Valid", str(valid).lower()))
        if not valid:
            shared.append(("WARC-Source-Stated-Payload-Digest", by["warc-payload-digest"]))
    for k, v in headers:
        low = k.lower()
        if low in _OWN:
            if low != "warc-payload-digest":
                shared.append((f"WARC-Source-{k[5:] if low.startswith('warc-') else k}", v))
        elif low not in ("warc-record-id", "warc-refers-to", "warc-concurrent-to"):
            shared.append((k, v))
    fields = [("title", " ".join(html_lib.unescape(title[1]).split()) if title else ""), ("http-status", status), ("charset", charset), ("outlinks", str(len(_LINK.findall(page)))), ("text-record", conversion_id), ("text-digest", text_digest)]
    fields += [(f"http-{k.lower()}", v) for k, v in http]
    about = "".join([f"{k}: {_one_line(v)}\r\n" for k, v in fields]).encode("utf-8", "replace")
    out = []
    for warc_type, record_id, mime, content, own_digest, other in (("metadata", metadata_id, "application/warc-fields", about, sha1_digest(about), conversion_id), ("conversion", conversion_id, "text/plain; charset=utf-8", text, text_digest, metadata_id)):
        own = [("WARC-Type", warc_type), ("WARC-Record-ID", record_id), ("Content-Type", mime), ("WARC-Concurrent-To", other), *shared]
        out.append({"warc_type": warc_type, "record_id": record_id, "refers_to": source, "target_uri": by.get("warc-target-uri", ""), "source_digest": digest, "block_digest": own_digest, "content_length": len(content), "content": content.decode(), "record": record(own, content, own_digest)})
    return out


_DERIVED_NAMES = ("warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", "content", "record")
_DERIVED = "array<struct<warc_type: string, record_id: string, refers_to: string, target_uri: string, source_digest: string, block_digest: string, content_length: long, content: string, record: binary>>"


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages with a binary `response`, a WARC response record of the page as served over HTTP. Null urls and html are empty."""

    @arrow_udf("binary")
    def build(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, urls, bodies in columns:
            out = []
            for i, u, b in zip(ids.to_pylist(), urls.to_pylist(), bodies.to_pylist(), strict=True):
                payload = (b or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                head = [("WARC-Type", "response"), ("WARC-Record-ID", _id("response", f"{i} {u}")), ("WARC-Date", date), ("WARC-Target-URI", u or ""), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1_digest(payload))]
                out.append(record(head, block))
            yield pa.array(out, pa.binary())

    return pages.withColumn("response", build(F.col(page_id), F.col(url), F.col(html)))


def derivatives(records: DataFrame, response: str | Column = "response") -> DataFrame:
    """Two rows for each response: the other columns of records, and warc_type, record_id, refers_to, target_uri, source_digest,
    block_digest, content_length, content and the whole record.

    Null responses, and what isn't a WARC record, give no rows; an empty payload gives an empty conversion and a metadata record that
    says so; repeated responses give equal records. Columns of records that are named like the results are replaced.
    """

    @arrow_udf(_DERIVED)
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([*((k, pa.string()) for k in ("warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest")), ("content_length", pa.int64()), ("content", pa.string()), ("record", pa.binary())]))
        for column in batches:
            yield pa.array([None if not x.is_valid else derive(x.as_py()) for x in column], kind)

    own = _stage.Own(records if isinstance(response, str) else records.withColumn("response", response))
    source = response if isinstance(response, str) else "response"
    made = own.df.withColumn("made", F.explode(build(F.col(own.of(source)))))
    return made.select(*own.back(source, *_DERIVED_NAMES), "made.*")
