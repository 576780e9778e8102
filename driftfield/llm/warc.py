"""WARC derivatives: every response becomes a metadata record and a plain-text conversion record that refer to it.

Responses come from WARC files (``read_warc``, ``http_responses``) or from a table of pages (``responses``). The identifiers
of derivatives follow from the response's identifier, so a task that runs again makes the same records. Source headers
(target URI, date, payload digest, IP address, the HTTP headers) go over unchanged, and each new record has the digest of
its own block. Records are rows; ``write_warc`` writes them to files from all executors, one gzip member each.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm.markup import attributes, decoded, tokens
from driftfield.llm.shared import byte_sizes, numbered, slices

#: Namespace of identifiers that are made here, from names that hold what they identify.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
VERSION = "WARC/1.1"
#: Elements that give no text, and those that begin and end a line.
SILENT = frozenset("script style template noscript svg iframe noembed noframes".split())
LINES = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside main blockquote pre title form figure dl dt dd".split())

RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in "warc_type record_id refers_to concurrent_to target_uri date content_type block_digest payload_digest refers_to_digest refers_to_uri refers_to_date ip_address block".split()])


def digest(data: bytes) -> str:
    """``sha1:`` and base32, as WARC files label digests."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(names))}>"


def read_page(page: str) -> tuple[str | None, str | None, list[str], str]:
    """Title, language, links and text of a page, in one pass over its tokens.

    Comments, scripts, styles and what else is not shown give no text, links or title; each block has a line of its own, and
    there are no blank ones. The first title and the first ``lang`` of ``html`` count.
    """
    title = lang = None
    links, parts, hidden = [], [], {}
    for text, tag, end, rest in tokens(page):
        if tag in ("template", "svg"):
            hidden[tag] = max(0, hidden.get(tag, 0) + (-1 if end else 0 if rest.endswith("/") else 1))
            parts.append(" ")
        elif any(hidden.values()):
            continue
        elif not tag or tag == "textarea" and not end:
            parts.append(decoded(text))
        elif tag in SILENT or tag == "!":
            parts.append(" ")
        elif tag == "title" and not end:
            title = " ".join(decoded(text).split()) if title is None else title
            parts.append("\n")
        elif tag in LINES:
            parts.append("\n")
        elif tag == "a" and not end:
            links += [decoded(v) for k, v in attributes(rest) if k == "href"][:1]
        elif tag == "html" and not end and lang is None:
            lang = next((v.strip() for k, v in attributes(rest) if k == "lang" and v.strip()), None)
    return title, lang, links, "\n".join(x for line in "".join(parts).split("\n") if (x := " ".join(line.split())))


def derivatives(source_id: str, uri: str, date: str, payload: str, payload_digest: str, ip: str | None = None, headers: str | None = None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    title, lang, links, text = read_page(payload)
    meta = {"title": title, "lang": lang, "links": links, "html_chars": len(payload), "text_chars": len(text)} | ({"http_headers": json.loads(headers)} if headers else {})
    meta = json.dumps(meta, ensure_ascii=False, sort_keys=True)
    same = {"refers_to": source_id, "target_uri": uri, "date": date, "refers_to_digest": payload_digest, "refers_to_uri": uri, "refers_to_date": date, "ip_address": ip}
    meta_id, text_id = record_id("metadata", source_id), record_id("conversion", source_id)
    return [
        same | {"warc_type": "metadata", "record_id": meta_id, "concurrent_to": text_id, "content_type": "application/json", "block_digest": digest(meta.encode()), "payload_digest": None, "block": meta},
        same | {"warc_type": "conversion", "record_id": text_id, "concurrent_to": meta_id, "content_type": "text/plain", "block_digest": digest(text.encode()), "payload_digest": digest(text.encode()), "block": text},
    ]


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: ``key``, ``source_id`` (from key, URL and payload), ``uri``, ``date`` and ``payload``.

    Null keys, URLs and payloads count as empty. Repeated rows are responses of their own: identifiers are unique, as copies
    are numbered. An empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(f"__row.`{c}`").cast("string"), F.lit(""))
    own = numbered(pages.select(*dict.fromkeys([key, url, payload])))
    h = F.sha1(F.concat_ws("\0", F.lit("response"), text(key), text(url), F.sha1(text(payload).cast("binary")), F.col("__copy").cast("string"), *[F.when(F.col(f"__row.`{c}`").isNull(), F.lit(c)) for c in (key, url, payload)]).cast("binary"))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4))], F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return own.select(F.col(f"__row.`{key}`").alias(key), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("source_id"), text(url).alias("uri"), F.lit(date).alias("date"), text(payload).alias("payload"))


def derived_records(source: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response (``key``, ``source_id``, ``uri``, ``date``, ``payload``, and if there ``payload_digest``,
    ``ip`` and ``http_headers``): ``key`` and the columns of ``RECORDS``.

    Nulls count as empty. An empty payload gives a metadata record without title or links and an empty conversion; an empty
    table gives an empty result. The digest of a source's payload is the one it declares, else that of the payload. Each
    response is handled on its own, in slices of a few MB, so that page sizes, repeated pages and hot hosts need no exchange.
    """
    names, more = ["source_id", "uri", "date", "payload"], ["payload_digest", "ip", "http_headers"]
    given = source.select(F.col(f"`{key}`").alias("key"), *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names], *[(F.col(n).cast("string") if n in source.columns else F.lit(None).cast("string")).alias(n) for n in more])
    out = T.StructType([T.StructField("key", given.schema["key"].dataType), *RECORDS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(4)), 2 << 20):
                part = batch.slice(a, b - a)
                rows = [r for i, u, d, p, s, ip, head in zip(*[part.column(k).to_pylist() for k in range(1, 8)]) for r in derivatives(i, u, d, p, s or digest(p.encode()), ip, head)]
                twice = pa.array([i for i in range(part.num_rows) for _ in range(2)], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(twice), *[pa.array([r[n] for r in rows], pa.string()) for n in RECORDS.names]], names=["key", *RECORDS.names])

    return given.mapInArrow(run, out).withColumnRenamed("key", key)


#: Headers of a record in a file, in order, and the columns that hold them.
HEADERS = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "target_uri", "WARC-IP-Address": "ip_address", "WARC-Refers-To": "refers_to", "WARC-Refers-To-Target-URI": "refers_to_uri", "WARC-Refers-To-Date": "refers_to_date", "WARC-Concurrent-To": "concurrent_to", "WARC-Source-Payload-Digest": "refers_to_digest", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest", "Content-Type": "content_type"}
RECORD_END = "\r\n\r\n"


def record_text() -> Column:
    """A record as it stands in a file, but for the two line ends that close it: version, headers that have a value, a blank line, the block."""
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    heads = [F.when(F.coalesce(F.col(c), F.lit("")) != "", head(n, F.regexp_replace(c, r"[\x00-\x20]+", " "))) for n, c in HEADERS.items()]
    block = F.coalesce("block", F.lit(""))
    return F.concat(F.lit(f"{VERSION}\r\n"), F.concat_ws("", *heads, head("Content-Length", F.octet_length(block).cast("string"))), F.lit("\r\n"), block)


class Unzipped:
    """The bytes of a file as they are or, if it is gzip, of its members one after the other; reads on in small steps."""

    STEP = 1 << 20

    def __init__(self, file: BinaryIO):
        self.file, self.held, self.at = file, b"", 0
        first = file.read(2)
        self.raw, self.member = first, None
        self.zipped = first == b"\x1f\x8b"

    def _more(self) -> bytes:
        while True:
            if not self.raw:
                self.raw = self.file.read(self.STEP)
                if not self.raw:
                    return b""
            if not self.zipped:
                out, self.raw = self.raw, b""
                return out
            if self.member is None or self.member.eof:
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(self.raw, self.STEP)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if out:
                return out

    def read(self, n: int) -> bytes:
        parts, have = [self.held[self.at : self.at + n]], min(n, len(self.held) - self.at)
        self.at += have
        while have < n and (got := self._more()):
            parts.append(got[: n - have])
            self.held, self.at = got, len(parts[-1])
            have += len(parts[-1])
        return b"".join(parts)

    def line(self) -> bytes:
        """Up to the next line end, which goes; what is left at the end of the file."""
        parts = []
        while True:
            end = self.held.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.held[self.at : end])
                self.at = end + 1
                return b"".join(parts).rstrip(b"\r")
            parts.append(self.held[self.at :])
            self.held, self.at = self._more(), 0
            if not self.held:
                return b"".join(parts)


def records_of(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file, gzip or not; lines that begin with a blank go on with the header before.

    A file that is cut off gives the records that are whole.
    """
    data = Unzipped(file)
    try:
        while True:
            version = data.line()
            if not version:
                if not data.held:
                    return
                continue  # the two line ends after a block
            heads, name = {}, None
            while line := data.line():
                if line[:1] in b" \t" and name:
                    heads[name] += " " + line.decode("utf-8", "replace").strip()
                elif b":" in line:
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    heads[name] = value.strip()
            if not version.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            size = next((v for k, v in heads.items() if k.lower() == "content-length"), "")
            if not size.isascii() or not size.isdigit():
                raise ValueError("a WARC record without a length")
            block = data.read(int(size))
            if len(block) < int(size):
                return
            yield heads, block
    except zlib.error:
        return


def parsed_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file's bytes."""
    import io

    return list(records_of(io.BytesIO(data)))


def _opened(uri: str) -> BinaryIO:
    from pyarrow import fs

    folder, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return folder.open_input_stream(path, compression=None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path``: ``file``, ``ordinal``, ``headers`` (names in lower case) and ``block``.

    A task reads a file from front to back in small steps and holds one record at a time; executors open files themselves,
    so the store has to be one that Arrow can open. What is no WARC file gives no records beyond the fault.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as f:
                    for i, (heads, block) in enumerate(records_of(f)):
                        heads = pa.array([[(k.lower(), v) for k, v in dict(heads).items()]], pa.map_(pa.string(), pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), heads, pa.array([block], pa.binary())], names=["file", "ordinal", "headers", "block"])

    return files.mapInArrow(run, "file string, ordinal long, headers map<string,string>, block binary")


def http_message(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers in order and body of an HTTP response; transfer in chunks and gzip or deflate coding are undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    parts = first.split(" ", 2)
    heads = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines) if c]
    own = {k.lower(): v.lower() for k, v in heads}
    if "chunked" in own.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            size = body[at:end].split(b";")[0].strip()
            if not size or any(c not in b"0123456789abcdefABCDEF" for c in size) or not (n := int(size, 16)):
                break
            out.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
        body = b"".join(out) if out else body
    coding = own.get("content-encoding", "")
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompressobj(47 if coding != "deflate" else 15).decompress(body)
        except zlib.error:
            pass  # as many servers say so of plain bodies, those stay as they are
    return int(parts[1]) if len(parts) > 1 and parts[1].isascii() and parts[1].isdigit() else None, heads, body


def http_responses(records: DataFrame) -> DataFrame:
    """Of the records of ``read_warc`` the HTTP responses: ``key`` (place of the record), ``source_id``, ``uri``, ``date``,
    ``ip``, ``http_status``, ``http_headers`` (JSON, a list of pairs), ``payload`` (text) and ``payload_digest``.

    The digest is the one that the record declares, else that of the body as it was sent. The text follows the charset that
    the headers name, else UTF-8; bytes that are not in it become replacement characters.
    """
    given = records.where((F.col("headers")["warc-type"] == "response") & F.coalesce(F.col("headers")["content-type"], F.lit("application/http")).startswith("application/http"))
    out = "key string, source_id string, uri string, date string, ip string, http_status int, http_headers string, payload string, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in out.split(", ")]
        for batch in batches:
            rows = []
            for file, i, heads, block in zip(*[c.to_pylist() for c in batch.columns]):
                heads = dict(heads)
                status, http, body = http_message(block or b"")
                kind = next((v for k, v in http if k.lower() == "content-type"), "")
                charset = kind.lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
                try:
                    text = body.decode(charset, "replace")
                except LookupError:
                    text = body.decode("utf-8", "replace")
                sent = (block or b"").partition(b"\r\n\r\n")[2]
                rows.append((f"{file}#{i}", heads.get("warc-record-id"), heads.get("warc-target-uri"), heads.get("warc-date"), heads.get("warc-ip-address"), status, json.dumps(http, ensure_ascii=False), text, heads.get("warc-payload-digest") or digest(sent)))
            kinds = [pa.int32() if n == "http_status" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return given.select("file", "ordinal", "headers", "block").mapInArrow(run, out)


def write_warc(records: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """Writes the records to WARC files below ``path``, one for each partition, in the partition's order.

    With gzip every record is a member of its own, so that a reader can begin at any. A task writes under a name of its own
    and hands that on; the driver then names the files of the attempts that counted, one short row for each partition.
    """
    spark, end = records.sparkSession, RECORD_END.encode()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if folder.exists(target):
        raise ValueError(f"{path} exists")
    folder.mkdirs(target)
    whole = folder.makeQualified(target).toUri()
    root = f"file://{whole.getPath()}" if whole.getScheme() == "file" else whole.toString()
    suffix = ".warc.gz" if compression else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        partition = TaskContext.get().partitionId()
        store, place = fs.FileSystem.from_uri(root)
        own, n = f".{partition}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(f"{place}/{own}") as out:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    data = text.encode() + end
                    out.write(gzip.compress(data, mtime=0) if compression else data)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([partition], pa.int32()), pa.array([own]), pa.array([n], pa.int64())], names=["partition", "own", "n"])

    done = records.select(record_text().alias("value")).mapInArrow(run, "partition int, own string, n long").collect()
    Path = spark._jvm.org.apache.hadoop.fs.Path
    for r in done:
        if r["n"]:
            folder.rename(Path(f"{path}/{r['own']}"), Path(f"{path}/part-{r['partition']:06d}{suffix}"))
    for left in folder.listStatus(target):
        if left.getPath().getName().startswith("."):
            folder.delete(left.getPath(), False)
