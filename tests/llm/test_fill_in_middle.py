"""Fill-in-the-middle (operator 12): the boundary set, and every row against a plain version and SQL."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldhouse.llm import fill_in_middle as fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, n string, form string, output string"


def plain(doc_id, text, fim_percent=50, spm_percent=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < spm_percent:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@pytest.mark.parametrize("values", [[0], [65535], range(70), [0, 1, 2, 9, 10, 65535], range(0, 65536, 2), range(65536), [*range(0, 30000, 3), *range(40000, 60000)], [x for x in range(65536) if x % 7 < 3]])
def test_containers_select_each_value(values):
    v = np.array(list(values), np.int64)
    for kind in (fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer):
        c = kind(v)
        assert c.n == len(v)
        assert [c.select(k) for k in range(0, len(v), max(1, len(v) // 500))] == v[:: max(1, len(v) // 500)].tolist()
        assert c.select(len(v) - 1) == v[-1]
    assert fim.container(v).nbytes == min(k(v).nbytes for k in (fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer))


def test_all_three_forms_are_chosen():
    kinds = [type(fim.container(np.array(list(v), np.int64))) for v in (range(0, 300, 3), range(0, 65536, 2), range(0, 60000))]
    assert kinds == [fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer]


@pytest.mark.parametrize("size", [0, 1, 2, 65534, 65535, 65536, 65537, 131072, 200_001])
@pytest.mark.parametrize("letters", [b"a", b" ", b"a ", b"ab  c\t\n"])
def test_boundaries_over_containers(size, letters):
    text = (letters * (size // len(letters) + 1))[:size]
    got, ends = fim.boundaries(np.frombuffer(text, np.uint8)), [0]
    for t in TOKEN.findall(text.decode()):
        ends.append(ends[-1] + len(t))
    assert len(got) == len(ends)
    step = max(1, len(ends) // 300)
    assert [got.select(k) for k in range(0, len(ends), step)] == ends[::step]
    assert got.select(len(ends) - 1) == ends[-1] == size


def rows():
    texts = [None, "", " ", "\n\n ", "word", " word ", "x <P> y", "a<S>b", "<M>", "almost <P and <S and <M", "> > <<P <S", "é à\x1cb 　c 漢字 \U0001f600 end\t", "a\r\nb\x0bc\x0cd " * 50, "long words " * 40_000, "y" * 200_000, "<" * 50 + " P>" * 20]
    out = [(i, texts[i % len(texts)], "clash", "clash", "clash") for i in range(12 * len(texts))]
    return out + [out[12], out[12], (None, "no id here at all", None, None, None), (None, None, None, None, None), (-5, "minus five words in this", "", "", "")]


@pytest.mark.parametrize(("fim_percent", "spm_percent"), [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_rows_equal_plain_version(spark, fim_percent, spm_percent):
    made = fim.transform(spark.createDataFrame(rows(), DOCS).repartition(3), fim_percent=fim_percent, spm_percent=spm_percent)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r[0], *plain(r[0], r[1], fim_percent, spm_percent), r[1] or "") for r in rows())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert fim_percent == 0 or len({r.form for r in got}) > 1


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = fim.op12_fill_in_middle(spark, sf)
    rel = con.sql(fim.OP12_SQL)
    assert df.columns == rel.columns
    got = Counter(map(tuple, df.collect()))
    assert got == Counter(rel.fetchall())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], DOCS)).collect() == []
