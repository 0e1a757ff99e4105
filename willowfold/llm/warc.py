"""WARC derivatives: metadata and plain-text conversion records for response records, linked to them.

For every response two records are built: a ``metadata`` record of fields (title, charset, language, counts, and the
source's HTTP headers, each behind ``source-``) and a ``conversion`` record with the page's text.  Both keep the response's target URI and
date, refer to it by WARC-Refers-To, carry a digest of their own block and the response's payload digest as WARC-Source-Digest, and in files
the source's HTTP headers, each behind ``WARC-Source-HTTP-``.  Record ids are made from type and source id, so that a lost task makes the same ones again.
Everything works on one row at a time: no shuffle, and one scan.  All but the decoding of entities is built-in expressions.

Text: comments, scripts, styles and the head are removed, tags become blanks, all HTML entities, named and numeric, are
decoded in one pass from left to right (so ``&amp;lt;`` becomes ``&lt;``), those of the no-break space to a blank, and
white space is folded.  The query's SQL has the standard's names and rules itself.

Files are read by record, so neither their size nor gzip matters; a record's block has the length that its header tells, whatever it holds, the mark of
another record included.  Names of fields are told apart whatever their case, with or without a blank, folded or repeated.  A record that is cut short, and what is no
record, comes back with its fault named, and every other record of that file and of others is whole.  Payloads are decoded by their byte order mark, HTTP header or meta element,
else as UTF-8, chunks and compression undone first; what their charset has no letter for becomes U+FFFD.

Defined results: a null html is an empty payload, with an empty title and text; a null url has an empty target URI;
repeated rows give repeated records; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import html as html_entities
import html.entities
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from willowfold.llm.shared import hinted, small_batches, stash

DATE = "2026-01-01T00:00:00Z"
MIME_HTML, MIME_TEXT, MIME_FIELDS = "text/html", "text/plain", "application/warc-fields"
#: What is not text, read from left to right in one pass; RE2 and Java take the same alternatives.
REMOVED = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|head\b.*?</head\s*>|[^>]*>)"
TITLE, CHARSET, LANGUAGE = r"(?is)<title[^>]*>(.*?)</title\s*>", r"(?i)<meta\s+charset=[\"']?([A-Za-z0-9_-]+)", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)"


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def decoded(text: str) -> str:
    """text with its HTML entities decoded, those of the no-break space to a blank."""
    return _ENTITY.sub(lambda m: html_entities.unescape(m[0]).replace("\xa0", " "), text) if "&" in text else text


@F.arrow_udf(StringType())
def _decoded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else decoded(t) for t in texts.to_pylist()], pa.string())


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def _raw_text(html: Column) -> Column:
    return _decoded(F.regexp_replace(html, REMOVED, " "))


def page_text(html: Column) -> Column:
    """The readable text of a page."""
    return _folded(_raw_text(html))


def record_id(*parts: Column | str) -> Column:
    """A urn:uuid made from the parts."""
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of pages: (page_id, record_id, target_uri, date, http_headers, payload, payload_digest)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    uri = F.coalesce(F.col(url_col), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    return pages.select(
        F.col(id_col).alias("page_id"), record_id("response", F.coalesce(F.col(id_col).cast("string"), F.lit("")), uri).alias("record_id"), uri.alias("target_uri"),
        F.lit(DATE).alias("date"), head.alias("http_headers"), html.alias("payload"), digest(html).alias("payload_digest"),
    )


def _prefixed(headers: Column, before: str, status: str) -> Column:
    """HTTP headers with something before the status line and before each name."""
    return F.concat(F.lit(before + status), F.regexp_replace(headers, r"\r\n", "\r\n" + before))


#: Labels of charsets whose usual meaning on the web is wider than the codec of that name.
_WIDER = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "euc-kr": "cp949", "ks_c_5601-1987": "cp949"}
_NAMED = re.compile(r"(?im)^content-type:[^\r\n]*?charset\s*=\s*[\"']?([\w.:-]+)")
_META = re.compile(rb"(?i)<meta\s[^>]*?charset\s*=\s*[\"']?([\w.:-]+)")
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def charset_of(headers: str, payload: bytes) -> str:
    """The codec of a payload: by its byte order mark, else the HTTP header, else a meta element in its first 4,096 bytes, else UTF-8; unknown names count for nothing."""
    for mark, name in _MARKS:
        if payload.startswith(mark):
            return name
    meta = _META.search(payload, 0, 4096)
    for name in ((m[1] if (m := _NAMED.search(headers)) else ""), meta[1].decode("ascii", "replace") if meta else ""):
        name = _WIDER.get(name.lower(), name)
        try:
            if name and codecs.lookup(name)._is_text_encoding:
                return codecs.lookup(name).name
        except (LookupError, ValueError):
            pass
    return "utf-8"


_CODED = re.compile(r"(?im)^(transfer|content)-encoding:[ \t]*([^\r\n]+)")


def unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; what does not keep to its form is taken as it is from there on."""
    parts, at = [], 0
    while line := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(data, at):
        size = int(line[1], 16)
        if not size:
            return b"".join(parts)
        parts.append(data[line.end() : line.end() + size])
        at = line.end() + size + 2
    return b"".join([*parts, data[at:]])


def plain_body(headers: str, payload: bytes) -> bytes:
    """The payload less its transfer and content codings (chunked, gzip, deflate); one that fails, or that we do not know, is left as it is."""
    codings = {kind.lower(): [c.strip().lower() for c in names.split(",")] for kind, names in _CODED.findall(headers)}
    if "chunked" in codings.get("transfer", ()):
        payload = unchunked(payload)
    for name in reversed(codings.get("content", ())):
        for window in {"gzip": (47,), "x-gzip": (47,), "deflate": (15, -15)}.get(name, ()):
            try:
                payload = zlib.decompressobj(window).decompress(payload)
                break
            except zlib.error:
                continue
    return payload


def http_parts(block: bytes) -> tuple[str, str, int, str]:
    """(HTTP headers, payload as text, its bytes, its SHA-256) of a response's block; without an empty line there are headers only."""
    head, _, payload = block.partition(b"\r\n\r\n")
    headers = _text(head)
    body = plain_body(headers, payload)
    text = body.decode(charset_of(headers, body), "replace").removeprefix("\ufeff")
    return headers, text, len(payload), hashlib.sha256(payload).hexdigest()


def _http(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = list(zip(*map(http_parts, batch.column(1).to_pylist()), strict=True)) or [[]] * 4
        types = pa.string(), pa.string(), pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["headers", "http_headers", "payload", "payload_bytes", "sha256"])


def responses_of(records: DataFrame) -> DataFrame:
    """The responses, in the shape of ``responses``, among whole records (headers, block) that were read from WARC files; page_id is their record id.

    Payloads are decoded by their charset; a payload digest that the record has is kept, else it is made from the bytes.
    """
    small_batches(records.sparkSession)
    at = lambda name: F.try_element_at("headers", F.lit(name))
    whole = records.where("fault is null") if "fault" in records.columns else records
    rows = whole.where(F.lower(at("WARC-Type")) == "response").select("headers", "block")
    rows = rows.mapInArrow(_http, "headers map<string,string>, http_headers string, payload string, payload_bytes long, sha256 string")
    return rows.select(
        at("WARC-Record-ID").alias("page_id"), at("WARC-Record-ID").alias("record_id"), F.coalesce(at("WARC-Target-URI"), F.lit("")).alias("target_uri"), F.coalesce(at("WARC-Date"), F.lit(DATE)).alias("date"),
        "http_headers", "payload", "payload_bytes", F.coalesce(at("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), "sha256")).alias("payload_digest"),
    )


def derive(source: DataFrame) -> DataFrame:
    """The two records of every response: (page_id, warc_type, record_id, refers_to, target_uri, date, content_type,
    source_headers, source_digest, block, block_digest, content_length)."""
    small_batches(source.sparkSession)
    # a lambda must not call Python, so what it decodes is made before
    source = source.withColumns({"_title": _decoded(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"(?s)<[^>]*>", " ")), "_text": _raw_text(F.col("payload"))})
    title = _folded(F.col("_title"))
    headers = lambda before, status: _prefixed(F.col("http_headers"), before, status)
    size = F.col("payload_bytes") if "payload_bytes" in source.columns else F.octet_length("payload")

    def records(text: Column) -> Column:
        fields = F.concat(
            F.lit("title: "), title, F.lit("\r\ncharset: "), F.lower(F.regexp_extract("payload", CHARSET, 1)), F.lit("\r\nlanguage: "), F.lower(F.regexp_extract("payload", LANGUAGE, 1)),
            F.lit("\r\nhtml-bytes: "), size.cast("string"), F.lit("\r\ntext-bytes: "), F.octet_length(text).cast("string"), F.lit("\r\n"), headers("source-", "status: "), F.lit("\r\n"),
        )
        return F.array(
            F.struct(F.lit("metadata").alias("warc_type"), F.lit(MIME_FIELDS).alias("content_type"), fields.alias("block")),
            F.struct(F.lit("conversion").alias("warc_type"), F.lit(MIME_TEXT).alias("content_type"), text.alias("block")),
        )

    # bound to a lambda's name, the text is made once for all its uses
    made = F.flatten(F.transform(F.array(_folded(F.col("_text"))), records))
    kept = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), made.alias("made"))
    rows = kept.select("*", F.inline("made"))
    return rows.select(
        "page_id", "warc_type", record_id("warc_type", F.col("warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", "content_type",
        "source_headers", "source_digest", "block", digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """(value): each derivative as WARC/1.1 text, less the empty lines that end a record."""
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "warc_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Source-Digest: "), "source_digest"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), _prefixed(F.col("source_headers"), "WARC-Source-HTTP-", "Status: "), F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit("\r\n\r\n"), "block").alias("value"))


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write WARC files, with compression "gzip" as one stream each: Spark's text files with the end of a record as their line end."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


#: Bytes of a head that a split may tear.
HEAD = 1 << 20
#: In place of the beginning of a block: a row of nothing but white space, which between records is no fault.
BLANK = -2
#: A block is one value, which can hold no more.
LONGEST = (1 << 31) - 1
#: What stands between two records; each row that the text reader makes ends before it.
_BETWEEN = b"\r\n\r\nWARC/1."
_HEAD = re.compile(rb"(?:WARC/1\.)?[01]\r\n(.*?)(\r\n\r\n|\Z)", re.S)
_LINE = re.compile(rb"([^\s:]+)[ \t]*:[ \t]*(.*?)[ \t]*\Z", re.S)

# The named fields of the WARC standard, which are told apart whatever their case.
_NAMES = (
    "WARC-Record-ID Content-Length WARC-Date WARC-Type Content-Type WARC-Concurrent-To WARC-Block-Digest WARC-Payload-Digest WARC-IP-Address WARC-Refers-To WARC-Refers-To-Target-URI WARC-Refers-To-Date "
    "WARC-Target-URI WARC-Truncated WARC-Warcinfo-ID WARC-Filename WARC-Profile WARC-Identified-Payload-Type WARC-Segment-Number WARC-Segment-Origin-ID WARC-Segment-Total-Length"
)
_SPELLED = {name.lower(): name for name in _NAMES.split()}


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def headers_of(row: bytes) -> tuple[dict[str, str], int] | None:
    """(named fields, where the block begins) of a row that begins with a record's head; None for any other.

    A row that ends with its last field had the empty line taken for the beginning of the next mark: its block begins four bytes behind it.
    Blanks around the colon, the case of the standard's names and lines folded by blanks make no difference; repeated names are joined by a comma.
    """
    if not (head := _HEAD.match(row)):
        return None
    named: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", head[1]).split(b"\r\n"):
        if not (field := _LINE.match(line)):
            return None
        name, value = _text(field[1]), _text(field[2])
        name = _SPELLED.get(name.lower(), name)
        named[name] = f"{named[name]}, {value}" if name in named else value
    told = named.get("Content-Length", "")
    return (named, head.end() + (0 if head[2] else 4)) if told.isdecimal() and int(told) <= LONGEST else None


def _ends(head: tuple[dict[str, str], int] | None, data: bytes) -> tuple[int, int]:
    """(where the block begins, its told length) of a row of lines; a row without a whole head may be blank."""
    return (head[1], int(head[0]["Content-Length"])) if head and head[1] <= len(data) else (-1 if data.strip() else BLANK, 0)


def walked(rows: Iterable[tuple[int, int, int]], gap: int, tail: int) -> Iterator[tuple[int, int, str | None]]:
    """(first row, number of rows, fault) of each record of one file, from its rows' (size, where the block begins or -1, told length), in order.

    gap: bytes between two rows; tail: bytes of a row behind the block that it ends with, of which the last row may lack some.
    A block that holds the mark of a record came in several rows; it ends where its length is reached, which must be the end of a row.  If it is not, the
    record was cut short where it was written: its own row is reported, and reading goes on with the next one.
    """
    rows = list(rows)
    at = 0
    while at < len(rows):
        size, begin, told = rows[at]
        if begin == BLANK:
            at += 1
            continue
        if begin < 0:
            yield at, 1, "no WARC record"
            at += 1
            continue
        have, end = size - begin, at + 1
        while have < told + tail and end < len(rows):
            have += gap + rows[end][0]
            end += 1
        if have == told + tail or end == len(rows) and told <= have <= told + 4:
            yield at, end - at, None
            at = end
        else:
            yield at, 1, "longer than its length" if size - begin > told + tail else "cut short"
            at += 1


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, length, at, value) of lines (path, start, length, line), put together from each line that begins a record to the next, within a split."""
    now, at, held = None, 0, []

    def made() -> tuple:
        return *now, at, b"\n".join(held) + b"\n"

    def out(found: list[tuple]) -> pa.RecordBatch:
        types = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
        columns = zip(*found, strict=True) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "start", "length", "at", "value"])

    for batch in batches:
        found = []
        for *key, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if held:
                    found.append(made())
                now, at, held = key, 0, [line]
            elif line.startswith(b"WARC/1."):
                found.append(made())
                at, held = at + 1, [line]
            else:
                held.append(line)
        yield out(found)
    if held:
        yield out([made()])


def _to_empty_line(data: bytes) -> bytes:
    """The lines up to the first empty one, HEAD bytes at most."""
    end = 2 if data.startswith(b"\r\n") else data.find(b"\r\n\r\n", 0, HEAD) + 4
    return data[: end if end > 3 or data.startswith(b"\r\n") else HEAD]


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, length, at, size, begin, told, marked, edge) of every row: which of its split it is, what its head tells, and of rows that a split may have
    torn within the head what could belong to it."""
    for batch in _segments(batches):
        data, at = batch.column(4).to_pylist(), batch.column(3).to_pylist()
        ends = [_ends(headers_of(d), d) for d in data]
        marked = [d.startswith(b"WARC/1.") for d in data]
        edges = [d[:HEAD] if m and e[0] == -1 else _to_empty_line(d) if not m and not i else None for d, e, m, i in zip(data, ends, marked, at, strict=True)]
        columns = [len(d) for d in data], [e[0] for e in ends], [e[1] for e in ends]
        rest = pa.array(marked, pa.bool_()), pa.array(edges, pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(c, pa.int64()) for c in columns], *rest], ["path", "start", "length", "at", "size", "begin", "told", "marked", "edge"])


def _mended(rows: Iterable[tuple]) -> list[list]:
    """[size, begin, told, edge, number of rows] of the rows (size, begin, told, marked, edge) of a file, what a split tore put together again."""
    whole: list[list] = []
    for size, begin, told, marked, edge in rows:
        if whole and not marked and edge is not None:
            last = whole[-1]
            last[0], last[4] = last[0] + size, last[4] + 1
            if last[3] is not None:
                last[3] += edge
                last[1], last[2] = _ends(headers_of(last[3]), last[3])
                last[3] = last[3] if last[1] < 0 else None
        else:
            whole.append([size, begin, told, edge if marked else None, 1])
    return whole


def _belonging(table: pa.Table) -> pa.Table:
    """(path, start, at, record_start, record_at, fault, extra) of one file's rows that are not a whole record by themselves; extra: the line end that the file lacks."""
    table = table.sort_by([("start", "ascending"), ("at", "ascending")])
    path, length, start, at, size = (table[c].to_pylist() for c in ("path", "length", "start", "at", "size"))
    extra = [0] * (len(size) - 1) + [sum(size) - length[0]]  # each line was given an end, which the last one may lack
    size[-1] -= extra[-1]
    whole = _mended(zip(size, *(table[c].to_pylist() for c in ("begin", "told", "marked", "edge")), strict=True))
    first = [0]
    for row in whole:
        first.append(first[-1] + row[4])
    found, seen = [], set()
    for k, n, fault in walked(((w[0], w[1], w[2]) for w in whole), 0, 4):
        own = range(first[k], first[k + n])
        seen.update(range(k, k + n))
        if len(own) > 1 or fault:
            found += [(path[i], start[i], at[i], start[own[0]], at[own[0]], fault, extra[i]) for i in own]
    found += [(path[i], start[i], at[i], None, None, "blank", 0) for k in range(len(whole)) if k not in seen for i in range(first[k], first[k + 1])]
    types = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()
    columns = zip(*found, strict=True) if found else [[]] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "start", "at", "record_start", "record_at", "fault", "extra"])


def _records(found: list[tuple[str, bytes, str | None]]) -> pa.RecordBatch:
    """Records of (path, rows put together, fault)."""
    paths, headers, blocks, faults = [], [], [], []
    for path, data, fault in found:
        named, begin = headers_of(data) or ({}, 0)
        size = int(named["Content-Length"]) if named else len(data)
        if fault and len(data) - begin < size:  # what there is, less the empty lines of a record that follows
            data = data.removesuffix(b"\r\n\r\n")
        paths.append(path)
        headers.append(list(named.items()))
        blocks.append(data[begin : begin + size])
        faults.append(fault)
    types = pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((paths, headers, blocks, faults), types, strict=True)], ["path", "headers", "block", "fault"])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of rows (path, value, fault)."""
    for batch in batches:
        yield _records(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of files that are read whole, one after another; only the rows of one record and the next one are held."""
    now, held, told, have = None, [], 0, 0

    def begun() -> None:
        nonlocal told, have
        head = headers_of(held[0])
        told = int(head[0]["Content-Length"]) if head else 0
        have = len(held[0]) - head[1] if head else 0

    def settled(narrow: list[tuple[int, int, int]]) -> list[tuple[str, bytes, str | None]]:
        if narrow[0][1] == BLANK:
            del held[:1]
            return []
        _, n, fault = next(walked(narrow, len(_BETWEEN), 0))
        record = now, _BETWEEN.join(held[:n]), fault
        del held[:n]
        return [record]

    def narrow() -> list[tuple[int, int, int]]:
        head = headers_of(held[0])
        begin = head[1] if head else -1 if held[0].strip() else BLANK
        return [(len(held[0]), begin, told), *((len(data), -1, 0) for data in held[1:])]

    def ended() -> Iterator[tuple[str, bytes, str | None]]:
        while held:
            begun()
            yield from settled(narrow())

    for batch in batches:
        found = []
        for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != now:
                found += ended()
                now = path
            held.append(data)
            while len(held) > 1 and have >= told:  # the first record ends before the last row
                found += settled(narrow())
                begun()
                if len(held) > 1:
                    have += sum(len(_BETWEEN) + len(d) for d in held[1:-1])
            if len(held) == 1:
                begun()
            else:
                have += len(_BETWEEN) + len(data)
        yield _records(found)
    yield _records(list(ended()))


_RECORD = "path string, headers map<string,string>, block binary, fault string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, block, fault) of the records in WARC files, plain or gzip; fault is null for whole ones.

    A gzip file is read by one task from its start, with what stands between two records as line end.  Plain files are split like any text, and by lines, since only an
    end of one byte cannot be torn by a split.  A line that begins like a record may lie in the block of another one; that is known from the
    lengths of all before it.  So plain files are read twice: first for a few numbers of each such line, which meet by
    file, then for the blocks, where only rows that are not a record by themselves are moved.
    A torn record is reported with what there is of its block, and takes nothing of the next record or file.
    """
    small_batches(spark)
    named = F.lower(F.col("_metadata.file_name")).endswith(".gz")
    at, value = F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")
    whole = spark.read.option("lineSep", _BETWEEN.decode()).text(path).where(named).select(at, value).mapInArrow(_streamed, _RECORD)
    lines = spark.read.option("lineSep", "\n").text(path).where(~named).select(at, F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("length"), value)
    narrow = lines.mapInArrow(_narrowed, "path string, start long, length long, at long, size long, begin long, told long, marked boolean, edge binary")
    moved = stash(narrow.groupBy("path").applyInArrow(_belonging, "path string, start long, at long, record_start long, record_at long, fault string, extra long"), "warc_rows")
    placed = lines.mapInArrow(_segments, "path string, start long, length long, at long, value binary").drop("length")
    marks = hinted(moved, moved.count())
    alone = placed.join(marks, ["path", "start", "at"], "left_anti").select("path", "value", F.lit(None).cast("string").alias("fault"))
    parts = placed.join(marks.where("record_at is not null"), ["path", "start", "at"]).groupBy("path", "record_start", "record_at").agg(F.array_sort(F.collect_list(F.struct("start", "at", F.expr("left(value, cast(length(value) - extra as int))").alias("value")))).alias("rows"), F.max("fault").alias("fault"))
    joined = parts.select("path", F.expr("aggregate(rows, X'', (a, r) -> a || r.value)").alias("value"), "fault")
    return whole.unionByName(alone.unionByName(joined).mapInArrow(_alone, _RECORD))


def _sql_text(text: str) -> str:
    """A DuckDB literal; what is not printable ASCII is spelled by numbers."""
    return " || ".join("'" + c.replace("'", "''") + "'" if c.isascii() and c.isprintable() else f"chr({ord(c)})" for c in text) or "''"


def _sql_map(pairs: dict) -> str:
    names = ", ".join(_sql_text(k) if isinstance(k, str) else str(k) for k in pairs)
    return f"map([{names}], [{', '.join(_sql_text(v) for v in pairs.values())}])"


#: The names and the odd numbers of the HTML standard, as one row; its functions in SQL are the lambdas' steps below.
_SQL_NAMES = f"""names AS (SELECT {_sql_map(html_entities.entities.html5)} AS named, {_sql_map(html_entities._invalid_charrefs)} AS odd, {sorted(html_entities._invalid_codepoints)} AS dropped)"""


def _sql_decoded(text: str) -> str:
    """All entities of a text in one pass: what lies between them, and what each becomes, put together."""
    number = "CASE WHEN m[3] IN ('x', 'X') THEN try_cast('0x' || rtrim(m[4:], ';') AS BIGINT) ELSE try_cast(rtrim(m[3:], ';') AS BIGINT) END"
    by_number = f"list_transform([{number}], lambda n: CASE WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN coalesce(odd[n], chr(65533)) WHEN map_contains(odd, n) THEN odd[n] WHEN list_contains(dropped, n) THEN '' ELSE chr(n::int) END)[1]"
    longest = "list_filter(range(length(m) - 2, 1, -1), lambda i: map_contains(named, m[2:i + 1]))[1]"
    by_name = f"CASE WHEN map_contains(named, m[2:]) THEN named[m[2:]] ELSE list_transform([{longest}], lambda i: CASE WHEN i IS NULL THEN m ELSE named[m[2:i + 1]] || m[i + 2:] END)[1] END"
    each = f"lambda m: replace(CASE WHEN m[2] = '#' THEN {by_number} ELSE {by_name} END, chr(160), ' ')"
    pattern = "'" + _ENTITY.pattern.replace("'", "''") + "'"
    found = f"list_append(list_transform(regexp_extract_all({text}, {pattern}), {each}), '')"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, {pattern}), {found}), lambda z: z[1] || z[2]), '')"


def _sql_folded(text: str) -> str:
    return f"trim(regexp_replace({text}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


def _sql_uuid(text: str) -> str:
    return f"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"


def oracle() -> str:
    quoted = [p.replace("'", "''") for p in (TITLE, CHARSET, LANGUAGE)]
    end = "chr(13) || chr(10)"
    return f"""
WITH {_SQL_NAMES},
p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, regexp_replace(payload, '{REMOVED}', ' ', 'g') AS bare, regexp_replace(regexp_extract(payload, '{quoted[0]}', 1), '(?s)<[^>]*>', ' ', 'g') AS raw_title FROM p),
s AS (SELECT page_id, target_uri, payload, {_sql_uuid("'response|' || coalesce(page_id::varchar, '') || '|' || target_uri")} AS refers_to, {_sql_folded(_sql_decoded("bare"))} AS txt, {_sql_folded(_sql_decoded("raw_title"))} AS title,
             'sha256:' || sha256(payload) AS source_digest,
             'HTTP/1.1 200 OK' || {end} || 'Content-Type: text/html; charset=utf-8' || {end} || 'Content-Length: ' || octet_length(encode(payload)) AS source_headers FROM r, names),
d AS (SELECT page_id, refers_to, target_uri, source_headers, source_digest, 'conversion' AS warc_type, '{MIME_TEXT}' AS content_type, txt AS block FROM s
      UNION ALL
      SELECT page_id, refers_to, target_uri, source_headers, source_digest, 'metadata', '{MIME_FIELDS}',
             'title: ' || title || {end} || 'charset: ' || lower(regexp_extract(payload, '{quoted[1]}', 1)) || {end} ||
             'language: ' || lower(regexp_extract(payload, '{quoted[2]}', 1)) || {end} || 'html-bytes: ' || octet_length(encode(payload)) || {end} ||
             'text-bytes: ' || octet_length(encode(txt)) || {end} || 'source-status: ' || replace(source_headers, {end}, {end} || 'source-') || {end} FROM s)
SELECT page_id, warc_type, {_sql_uuid("'warc_type|' || warc_type || '|' || refers_to")} AS record_id, refers_to, target_uri, '{DATE}' AS date, content_type,
       source_headers, source_digest, block, 'sha256:' || sha256(block) AS block_digest, octet_length(encode(block)) AS content_length
FROM d
"""
