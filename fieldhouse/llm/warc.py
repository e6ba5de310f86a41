"""WARC archives with a two-level capture index (operator 13).

Writing: tasks write one gzip member per record into files of their own, with names that no other attempt of a task
has; a file belongs to the archive only where a line of the index names it, and those lines are committed by Spark,
so what a lost executor or a second attempt leaves behind is never read. Of records with equal payloads that with the
largest page id is the response, the others are revisits that refer to it and hold no payload.

The index: keys are urls with the host's labels reversed (``org,example,www)/path``). Lines, sorted by key and page
id over the whole archive, stand in compressed blocks of ``LINES``; each index file has a sparse directory of its
blocks (first line, place), and the table of parts has the first line of each file. A response that revisits refer to has a
second line under its record id.

Reading: requests (urls, with or without a page id) are binary-searched in the parts, sorted, then searched in the part's
directory and in the one block it names. The places found are sorted by file and offset, neighbours are read by one range,
and every record is checked: key, page id, length, digest of the payload.

Nulls, ties and odd rows: a null html is empty; a null url has the key ``-``, no target header; a null page id counts as the
smallest and is carried as null; of equal payloads all rows with the largest page id are responses (rows that repeat);
white space and control characters in a url are percent-encoded; keys over 500 bytes end in a digest; extra columns are
ignored; an empty table makes an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_ROWS, Scratch, documents, filled, public_id, release, schema_of, slices

#: lines of an index block; lines of an index part as long as there are at most ``PARTS``; bytes of a WARC file before the next is begun
LINES, PART_LINES, PARTS, FILE_BYTES = 3000, 20_000, 20_000, 1 << 30
#: bytes between two records up to which one read takes both; bytes of such a read
GAP, READ = 1 << 16, 8 << 20
LEVEL = 4
KEY_BYTES, KEY_HEAD = 500, 400
#: a payload that more than one in so many rows have is joined by broadcast where the table of repeated payloads is too large for it
HOT = 10_000
NO_ID = -(2**63)
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:fieldhouse:warc")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# ---------------------------------------------------------------- keys and records


def escaped(url: str) -> str:
    """The url as it stands in a header: white space and control characters percent-encoded."""
    if url.isascii() and url.isprintable() and " " not in url:
        return url
    return "".join(f"%{ord(c):02X}" if ord(c) <= 0x20 or ord(c) == 0x7F else c for c in url)


def capture_key(url: str | None) -> str:
    """Labels of the host from the last to the first, then the rest of the url without its scheme."""
    if url is None:
        return "-"
    url = escaped(url)
    _, found, rest = url.partition("://")
    if not found:
        key = ")" + url
    else:
        end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        key = ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]
    raw = key.encode()
    if len(raw) > KEY_BYTES:
        key = raw[:KEY_HEAD].decode(errors="ignore") + "~" + hashlib.sha256(raw).hexdigest()
    return key


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for all rows that repeat page id and payload."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}"


def _member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, level: int = LEVEL) -> bytes:
    """A response, or a revisit of the record ``refers_to``, as one gzip member."""
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id(page_id, digest)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", escaped(url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    return _member(fields, http_head(len(payload)) + (b"" if refers_to else payload), level)


def parsed(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or raw[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    head, _, payload = block.partition(b"\r\n\r\n")
    return fields, head, payload


# ---------------------------------------------------------------- files that tasks read and write


def file_system(uri: str):
    """The file system and path of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


class _Ranges:
    """Byte ranges of files under one root; the file of the last read stays open."""

    def __init__(self, root: str):
        self.fs, self.path = file_system(root)
        self.name, self.file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"{name} ends before {offset + length}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name, self.file = "", None


class _Writer:
    """Files of one task attempt, each under a name of its own."""

    def __init__(self, root: str, suffix: str, head: bytes = b""):
        self.fs, self.path = file_system(root)
        self.fs.create_dir(self.path, recursive=True)
        self.suffix, self.head, self.file, self.at = suffix, head, None, 0

    def add(self, data: bytes) -> tuple[str, int]:
        """Name of the file and place in it."""
        if self.file is None:
            self.name = uuid.uuid4().hex + self.suffix
            self.file = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.file.write(self.head)
            self.at = len(self.head)
        at = self.at
        self.file.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


# ---------------------------------------------------------------- writing


@dataclass
class Archive:
    """Where the files are, and the first line of every index part, in order (at most ``PARTS`` of some 600 bytes)."""

    root: str
    parts: list[tuple[str, int, str]]
    captures: DataFrame


def attach(rows: DataFrame, known: DataFrame, key: str, uses: str) -> DataFrame:
    """``rows`` left-joined with ``known`` (one row a key, of fixed width; ``uses``: how many of ``rows`` have the key).

    Small tables are broadcast. Else the keys of more than one in ``HOT`` rows, fewer than ``HOT`` of them, are broadcast, and
    only the others are shuffled.
    """
    n, total = known.agg(F.count("*"), F.coalesce(F.sum(uses), F.lit(0))).first()
    plain = known.drop(uses)
    if n <= SMALL_ROWS:
        return rows.join(F.broadcast(plain), key, "left")
    hot = F.col(uses) * HOT > total
    few = rows.join(F.broadcast(known.where(hot).drop(uses)), key, "inner")
    rest = rows.join(F.broadcast(known.where(hot).select(key)), key, "left_anti").join(known.where(~hot).drop(uses), key, "left")
    return few.unionByName(rest)


_LINE = "key string, page long, type string, file string, offset long, length long, digest string"


def _write(root: str, date: str, file_bytes: int, level: int):
    schema = schema_of(_LINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, date)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
        out = _Writer(root, ".warc.gz", info)
        for b in slices(batches, "_text"):
            lines = []
            texts = filled(b, "_text").cast(pa.large_binary())
            for i, url, sha1, first, uses, text in zip(*(b.column(c).to_pylist() for c in ("_id", "_url", "_sha1", "_first", "_uses")), texts, strict=True):
                page, digest = None if i == NO_ID else i, base32(sha1)
                revisit = uses is not None and first != i
                refers = record_id(None if first == NO_ID else first, digest) if revisit else None
                data = record(page, url, text.as_py(), digest, refers, date, level)
                name, at = out.add(data)
                kind = "revisit" if revisit else "response"
                lines.append((capture_key(url), i, kind, name, at, len(data), digest))
                if uses is not None and not revisit:
                    lines.append((record_id(page, digest), i, kind, name, at, len(data), digest))
                if out.at >= file_bytes:
                    out.close()
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), schema, strict=True)], schema=schema)
        out.close()

    return run


_PART = "key string, page long, file string, lines long"


def block_text(lines: list[tuple]) -> bytes:
    return "\n".join("\t".join(map(str, x)) for x in lines).encode()


def _write_index(root: str, lines_a_block: int):
    schema = schema_of(_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, block, total = _Writer(root, ".cdx.gz"), [], [], 0

        def flush() -> None:
            data = gzip.compress(block_text(block), 6, mtime=0)
            _, at = out.add(data)
            directory.append((block[0][0], block[0][1], at, len(data)))
            block.clear()

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block.append(x)
                total += 1
                if len(block) == lines_a_block:
                    flush()
        if block:
            flush()
        if directory:
            name = out.name
            out.close()
            with out.fs.open_output_stream(f"{out.path}/{name}.dir", compression=None) as f:
                f.write(gzip.compress(block_text(directory), 6, mtime=0))
            yield pa.record_batch([[directory[0][0]], [directory[0][1]], [name], [total]], schema=schema)

    return run


def write_archive(pages: DataFrame, scratch: Scratch, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES, lines_a_block: int = LINES, level: int = LEVEL) -> Archive:
    """A record for each row, and the index over them. Payloads under ``min_revisit_bytes`` are never revisits."""
    root = scratch.path("archive")
    rows = documents(pages, id_col, html_col, F.col(url_col).alias("_url")).drop("_th")
    rows = rows.withColumn("_sha1", F.unhex(F.sha1(F.coalesce(F.col("_text"), F.lit("")).cast("binary"))))
    again = rows.where(F.octet_length(F.coalesce("_text", F.lit(""))) >= min_revisit_bytes).groupBy("_sha1").agg(F.max("_id").alias("_first"), F.count("*").alias("_n"))
    again = scratch.write(again.where("_n > 1").select("_sha1", "_first", "_n", F.col("_n").alias("_uses")), "payloads")
    rows = attach(rows, again, "_sha1", "_n").select("_id", "_url", "_text", "_sha1", "_first", "_uses")
    captures = scratch.write(rows.mapInArrow(_write(f"{root}/warc", date, file_bytes, level), _LINE), "captures")
    n_parts = min(PARTS, captures.count() // PART_LINES + 1)
    order = ["key", "page", "file", "offset"]
    parts = captures.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(_write_index(f"{root}/index", lines_a_block), _PART)
    parts = scratch.write(parts, "parts")
    return Archive(root, sorted((r.key, r.page, r.file) for r in parts.select("key", "page", "file").collect()), captures)


# ---------------------------------------------------------------- reading


def covering(firsts: list[tuple[str, int]], low: tuple[str, int], high: tuple[str, int]) -> range:
    """Of ranges that begin at ``firsts``, those that may hold lines from ``low`` to ``high``."""
    return range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high))


def bounds(key: str, page: int | None) -> tuple[tuple[str, int], tuple[str, int]]:
    """First and last line that a request may name; without a page id all lines of the key."""
    return ((key, page), (key, page)) if page is not None else ((key, NO_ID), (key, 2**63 - 1))


_REQUEST = "part int, key string, page long"


def _route(firsts: list[tuple[str, int]]):
    schema = schema_of(_REQUEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for url, ready, page in zip(*(b.column(c).to_pylist() for c in ("_url", "_key", "_page")), strict=True):
                key = capture_key(url) if ready is None else ready
                found.update((p, key, page) for p in covering(firsts, *bounds(key, page)))
            if found:
                p, k, g = zip(*found, strict=True)
                yield pa.record_batch([pa.array(p, pa.int32()), pa.array(k), pa.array(g, pa.int64())], schema=schema)

    return run


class _Part:
    """One index part: its directory, and the block that was read last."""

    def __init__(self, files: _Ranges, name: str):
        self.files, self.name, self.block, self.lines = files, name, -1, []
        with files.fs.open_input_file(f"{files.path}/{name}.dir") as f:
            rows = [x.split("\t") for x in gzip.decompress(f.read()).decode().split("\n")]
        self.firsts = [(k, int(p)) for k, p, _, _ in rows]
        self.places = [(int(at), int(n)) for _, _, at, n in rows]

    def find(self, key: str, page: int | None) -> Iterator[list[str]]:
        low, high = bounds(key, page)
        for i in covering(self.firsts, low, high):
            if i != self.block:
                data = gzip.decompress(self.files.read(self.name, *self.places[i]))
                self.block, self.lines = i, data.decode().split("\n")
            place = lambda x: (x[: (t := x.index("\t"))], int(x[t + 1 : x.index("\t", t + 1)]))
            for x in self.lines[bisect_left(self.lines, low, key=place) : bisect_right(self.lines, high, key=place)]:
                yield x.split("\t")


def _resolve(root: str, names: list[str]):
    schema = schema_of(_LINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, part, now, last = _Ranges(f"{root}/index"), None, -1, None
        for b in batches:
            lines = []
            for p, key, page in zip(*(b.column(c).to_pylist() for c in ("part", "key", "page")), strict=True):
                if (p, key, page) == last:  # asked for more than once
                    continue
                last = (p, key, page)
                if p != now:
                    now, part = p, _Part(files, names[p])
                for k, g, kind, name, at, n, digest in part.find(key, page):
                    lines.append((k, int(g), kind, name, int(at), int(n), digest))
                    if len(lines) == 50_000:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), schema, strict=True)], schema=schema)
                        lines = []
            if lines:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), schema, strict=True)], schema=schema)
        files.close()

    return run


def locate(archive: Archive, requests: DataFrame, url_col: str | None = "url", page_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """Lines of the index for the urls (or record ids in ``id_col``) asked for, each line once however often it is asked for.

    With ``page_col`` only captures of that page id (a null id is the smallest).
    """
    page = F.coalesce(F.col(page_col).cast("long"), F.lit(NO_ID)) if page_col else F.lit(None).cast("long")
    asked = requests.select(
        F.col(url_col).alias("_url") if url_col else F.lit(None).cast("string").alias("_url"),
        F.col(id_col).alias("_key") if id_col else F.lit(None).cast("string").alias("_key"),
        page.alias("_page"),
    )
    routed = asked.mapInArrow(_route([p[:2] for p in archive.parts]), _REQUEST)
    order = ["part", "key", "page"]
    routed = routed.repartitionByRange(*order).sortWithinPartitions(*order)
    return routed.mapInArrow(_resolve(archive.root, [p[2] for p in archive.parts]), _LINE)


_RECORD = "_id long, url string, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"


def _fetch(root: str, payloads: bool):
    schema = schema_of(_RECORD)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Records of one file that one read takes."""
        near: list[tuple] = []
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length", "key", "page", "type", "digest")), strict=True):
                if near and (x[0] != near[0][0] or x[1] > near[-1][1] + near[-1][2] + GAP or x[1] + x[2] > near[0][1] + READ):
                    yield near
                    near = []
                near.append(x)
        if near:
            yield near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Ranges(f"{root}/warc")
        for near in groups(batches):
            start = near[0][1]
            data = files.read(near[0][0], start, near[-1][1] + near[-1][2] - start)
            rows = []
            for name, at, n, key, page, kind, digest in near:
                fields, head, payload = parsed(data[at - start : at - start + n])
                url, rid = fields.get("WARC-Target-URI"), fields["WARC-Record-ID"][1:-1]
                size = int(head.rsplit(b"Content-Length: ", 1)[1])
                read = base32(hashlib.sha1(payload).digest()) if kind == "response" else None
                if key not in (capture_key(url), rid) or int(fields.get("Page-ID", NO_ID)) != page or fields["WARC-Type"] != kind or fields["WARC-Payload-Digest"] != f"sha1:{digest}" or read not in (None, digest) or (read and size != len(payload)):
                    raise ValueError(f"{name} has another record at {at} than its index says")
                rows.append((page, url, rid, kind, fields.get("WARC-Refers-To", "")[1:-1] or None, len(payload) if read else None, read, payload if payloads and read else None))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        files.close()
        release()

    return run


def fetch(archive: Archive, lines: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of some index lines, read by ranges and checked; revisits have no payload (see ``resolved``)."""
    lines = lines.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return lines.mapInArrow(_fetch(archive.root, payloads), _RECORD)


def resolved(archive: Archive, records: DataFrame, scratch: Scratch, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of the records; those that revisits
    refer to are found in the index by their ids and read."""
    records = scratch.write(records, "records")
    revisits = records.where("refers_to_id is not null").drop("payload_bytes", "payload_digest", "payload")
    ids = scratch.write(revisits.groupBy("refers_to_id").agg(F.count("*").alias("_n")), "referred")
    lines = locate(archive, ids, url_col=None, id_col="refers_to_id")
    known = fetch(archive, lines, payloads).select(F.col("record_id").alias("refers_to_id"), F.col("_id").alias("_to"), "payload_bytes", "payload_digest", *(["payload"] if payloads else []))
    known = known.dropDuplicates(["refers_to_id"]).join(ids, "refers_to_id")
    known = scratch.write(known, "originals")
    if payloads:  # of any width: never broadcast
        found = revisits.join(known.drop("_n").hint("shuffle_merge"), "refers_to_id", "left")
    else:
        found = attach(revisits, known, "refers_to_id", "_n").withColumn("payload", F.lit(None).cast("binary"))
    out = records.where("refers_to_id is null").withColumn("_to", F.lit(None).cast("long")).unionByName(found)
    return out.select(public_id("page_id"), "url", "record_type", public_id("refers_to", "_to"), "payload_bytes", "payload_digest", "payload")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch = Scratch(spark, "warc")
    archive = write_archive(pages, scratch)
    records = fetch(archive, locate(archive, pages, page_col="page_id"), payloads=False)
    return resolved(archive, records, scratch, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM p
)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || x[(i // 8) * 10 + 1:(i // 8) * 10 + 10])::UBIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM q
"""
