"""WARC archives (operator 13): records, index, range reads, revisits, and rows against plain versions and SQL."""

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldhouse.llm import warc
from fieldhouse.llm.common import Scratch

PAGES = "page_id long, url string, html string, payload string, digest string, key string"


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def rows():
    r = random.Random(11)
    long_ = "<p>" + "".join(r.choices("abcdef ", k=400_000)) + "</p>"
    urls = [None, "", "no scheme", "http://", "http://Example.ORG/A?b#c", "https://a.b.example.org", "x://h\r\nWARC-Type: evil/ p\tq", "http://exämple.com/ü", "http://" + "l." * 5000 + "com/", "http://h.com/" + "p" * 3000, "http://h.com/" + "p" * 2999 + "q"]
    htmls = [None, "", "<html>one</html>", "two\r\n\r\nWARC/1.1\r\n\r\n", "\u00e9\U0001f600", long_, "three"]
    out = [(i, urls[i % len(urls)], htmls[r.randrange(len(htmls))], "c", "c", "c") for i in range(150)]
    out += [(1000 + i, f"http://host{i % 7}.example.org/{i % 40}", f"page {i % 90}" if i % 3 else "copy", None, None, None) for i in range(400)]
    out += [out[20], out[20], out[-1], (None, "http://null.org/", "of no id", None, None, None), (None, None, "copy", None, None, None), (None, None, None, None, None, None), (-7, "http://h.com/", "minus", None, None, None)]
    return out


def plain(table, least=0):
    top = {}
    for i, _, h, *_ in table:
        top[h or ""] = max(top.get(h or "", -(2**63)), -(2**63) if i is None else i)
    out = Counter()
    for i, _, h, *_ in table:
        first = top[h or ""]
        revisit = first != (-(2**63) if i is None else i) and len((h or "").encode()) >= least
        out[i, len((h or "").encode()), b32(h), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def read_all(spark, pages, scratch, least=0, **options):
    archive = warc.write_archive(pages, scratch, min_revisit_bytes=least, **options)
    records = warc.fetch(archive, warc.locate(archive, pages, page_col="page_id"))
    return archive, warc.resolved(archive, records, scratch)


@pytest.mark.parametrize(("least", "small", "hot", "options"), [(0, warc.SMALL_ROWS, warc.HOT, {}), (5, 0, 20, {"file_bytes": 20_000, "lines_a_block": 7, "level": 1})])
def test_rows_come_back(spark, monkeypatch, least, small, hot, options):
    monkeypatch.setattr(warc, "SMALL_ROWS", small)
    monkeypatch.setattr(warc, "HOT", hot)
    monkeypatch.setattr(warc, "PART_LINES", 100)
    table = rows()
    pages = spark.createDataFrame(table, PAGES).repartition(5)
    _, got = read_all(spark, pages, Scratch(spark, "t"), least, **options)
    got = got.collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain(table, least)
    assert Counter((r.page_id, None if r.url is None else r.url, bytes(r.payload)) for r in got) == Counter((i, None if u is None else warc.escaped(u), (h or "").encode()) for i, u, h, *_ in table)


def test_files_are_plain_warc(spark):
    """Every record by a sequential reader that knows nothing of the index."""
    table = rows()
    scratch = Scratch(spark, "t")
    archive = warc.write_archive(spark.createDataFrame(table, PAGES).repartition(3), scratch, file_bytes=100_000)
    fs, path = warc.file_system(f"{archive.root}/warc")
    from pyarrow.fs import FileSelector

    files = fs.get_file_info(FileSelector(path))
    assert len(files) > 3
    kinds, ids, refers = Counter(), set(), set()
    for f in files:
        with fs.open_input_file(f.path) as x:
            raw = gzip.decompress(x.read())
        n = 0
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            block, raw = rest[:size], rest[size:]
            assert raw[:4] == b"\r\n\r\n"
            raw = raw[4:]
            assert (n == 0) == (fields["WARC-Type"] == "warcinfo")
            n += 1
            kinds[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "response":
                ids.add(fields["WARC-Record-ID"])
                payload = block.partition(b"\r\n\r\n")[2]
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if fields["WARC-Type"] == "revisit":
                refers.add(fields["WARC-Refers-To"])
                assert block.endswith(b"\r\n\r\n")
    want = Counter(k[3] for k in plain(table).elements())
    assert (kinds["response"], kinds["revisit"]) == (want["response"], want["revisit"])
    assert refers <= ids


def test_captures_of_a_url(spark, monkeypatch):
    """All captures of some urls, over many blocks and parts of one hot url; asked for twice, found once; unknown ones not at all."""
    monkeypatch.setattr(warc, "PART_LINES", 50)
    table = [(i, "http://hot.org/" if i % 2 else f"http://h{i}.org/", f"text {i}") for i in range(600)]
    scratch = Scratch(spark, "t")
    pages = spark.createDataFrame(table, "page_id long, url string, html string").repartition(4)
    archive = warc.write_archive(pages, scratch, lines_a_block=9)
    assert len(archive.parts) > 4
    asked = spark.createDataFrame([("http://hot.org/",), ("https://HOT.org/",), ("http://h4.org/",), ("http://none.org/",), ("http://h4.org",), (None,)], "url string")
    got = warc.resolved(archive, warc.fetch(archive, warc.locate(archive, asked)), scratch).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in got) == Counter((i, t) for i, u, t in table if u in ("http://hot.org/", "http://h4.org/"))
    one = warc.locate(archive, spark.createDataFrame([("http://hot.org/", 7), ("http://hot.org/", 8), ("http://hot.org/", None)], "url string, page_id long"), page_col="page_id").collect()
    assert [(r.key, r.page) for r in one] == [("org,hot)/", 7)]


def test_a_second_attempt_does_not_matter(spark):
    """Files that no committed line names are not read; a line that names the wrong place is an error."""
    table = [(i, f"http://h{i}.org/", f"text {i}") for i in range(20)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").repartition(2)
    archive = warc.write_archive(pages, Scratch(spark, "t"))
    write = warc._write(f"{archive.root}/warc", "1970-01-01T00:00:00Z", 1 << 30, 1)
    b = pa.record_batch({"_id": [3], "_url": ["http://h3.org/"], "_text": ["left behind"], "_sha1": pa.array([b"x" * 20], pa.binary()), "_first": pa.array([None], pa.int64()), "_uses": pa.array([None], pa.int64())})
    next(write(iter([b])))
    lines = warc.locate(archive, pages)
    assert {(r._id, bytes(r.payload)) for r in warc.fetch(archive, lines).collect()} == {(i, t.encode()) for i, _, t in table}
    other = lines.withColumn("key", F.lit("org,other)/"))
    with pytest.raises(Exception, match="another record"):
        warc.fetch(archive, other).collect()


def test_keys():
    assert warc.capture_key("http://WWW.Example.org:80/A?b") == "org:80,example,www)/A?b"
    assert warc.capture_key("x://a.b") == "b,a)"
    assert warc.capture_key(None) == "-" and warc.capture_key("plain") == ")plain"
    keys = [warc.capture_key(f"http://h.org/{'é' * 400}{i}") for i in range(50)]
    assert len(set(keys)) == 50 and max(len(k.encode()) for k in keys) <= warc.KEY_BYTES


def test_covering_equals_plain():
    r = random.Random(2)
    lines = sorted((r.choice("abc"), r.randrange(6)) for _ in range(200))
    blocks = [lines[i : i + 7] for i in range(0, 200, 7)]
    firsts = [b[0] for b in blocks]
    for k in "`abcd":
        for p in (None, *range(7)):
            low, high = warc.bounds(k, p)
            have = {i for i, b in enumerate(blocks) if any(low <= x <= high for x in b)}
            cover = set(warc.covering(firsts, low, high))
            assert have <= cover and len(cover) <= len(have) + 2


def test_attach_ways_agree(spark, monkeypatch):
    keys = [0] * 500 + [1] * 200 + [*range(2, 60)] * 3 + [99]
    data = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    count = defaultdict(int)
    for k in keys:
        count[k] += 1
    known = spark.createDataFrame([(k, f"v{k}", n) for k, n in count.items() if k != 99], "k long, v string, n long")
    want = Counter((k, i, f"v{k}" if k != 99 else None) for i, k in enumerate(keys))
    for small, hot in ((10**6, 1), (0, 1), (0, 10), (0, 10**6)):
        monkeypatch.setattr(warc, "SMALL_ROWS", small)
        monkeypatch.setattr(warc, "HOT", hot)
        assert Counter(map(tuple, warc.attach(data, known, "k", "n").select("k", "i", "v").collect())) == want


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = warc.op13_warc(spark, sf)
    rel = con.sql(warc.OP13_SQL)
    assert sorted(df.columns) == sorted(rel.columns)
    assert Counter(map(tuple, df.select(rel.columns).collect())) == Counter(rel.fetchall())


def test_sql_equals_plain_on_odd_rows():
    import pandas as pd

    pages = pd.DataFrame([r[:3] for r in rows()], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})  # noqa: F841
    got = duckdb.sql(warc.OP13_SQL).select("page_id, payload_bytes, payload_digest, record_type, refers_to").fetchall()
    assert Counter(got) == plain(rows())


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    assert read_all(spark, pages, Scratch(spark, "t"))[1].collect() == []
