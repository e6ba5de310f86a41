"""Each stage of the pipeline on its own input, against plain versions."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from fieldhouse.llm import mixing
from fieldhouse.llm.common import Scratch
from tests.llm.test_corpus_operators import DOCS, brute_dedup, brute_link, brute_quality, odd_rows, pairs


def test_stages(spark, sf):
    scratch = Scratch(spark, "t")
    docs = scratch.write(spark.createDataFrame(odd_rows(), DOCS).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")))
    stages = dict(corpus_pipeline.STAGES)
    out = scratch.write(stages["quality_rules"](spark, docs, sf))
    assert Counter(pairs(out)) == Counter(p for p in pairs(docs) if not brute_quality(p[1])[5])
    docs, out = out, scratch.write(stages["ngram_join"](spark, out, sf))
    groups = brute_link(pairs(docs), 5, 80)
    assert out.columns == docs.columns
    assert Counter(i for i, _ in pairs(out)) == Counter({i for i, _, c in groups if i == c})
    docs, out = out, scratch.write(stages["substring_dedup"](spark, out, sf))
    want = brute_dedup(pairs(docs))
    assert out.columns == docs.columns
    assert Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in out.collect()) == Counter((i, n - k) for i, n, k, _ in want)
    assert out.where("n_chars <> length(text)").count() == 0
    docs, out = out, scratch.write(stages["source_mixing"](spark, out, sf))
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
    packed = stages["best_fit_packing"](spark, out, sf)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in pairs(out)}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "substring_dedup", "source_mixing", "best_fit_packing"]


def test_near_duplicates_by_text_not_by_id(spark, sf):
    """Rows without an id, and texts under one id, stay or go by their own links."""
    word = lambda a, n=60: " ".join(f"{a}{i}" for i in range(n))
    rows = [(None, word("a")), (None, word("b")), (None, word("c")), (7, word("d")), (7, word("e")), (3, word("d") + " tail"), (8, word("f")), (8, word("f") + " tail"), (9, word("g")), (9, word("g"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pairs(corpus_pipeline.near_duplicates(spark, docs, sf))
    assert Counter((i, t.split()[0]) for i, t in got) == Counter([(None, "a0"), (None, "b0"), (None, "c0"), (7, "e0"), (3, "d0"), (8, "f0"), (9, "g0")])


def test_mixing_reaches_the_sequences(spark, sf, monkeypatch):
    """Sequences are numbered in the order of the schedule, and other weights give another result."""
    n = {"a": 300, "b": 300, "c": 60}
    rows = [(i * 10 + k, " ".join(f"{s}{(i * 7919 + j * 31) % 9973}" for j in range(300 + i % 50)), "en", s, 0) for k, (s, m) in enumerate(n.items()) for i in range(m)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    source = {r[0]: r[3] for r in rows}
    mix, results, early = mixing.mix, [], []
    for weights in ({"a": 9.0, "b": 1.0, "c": 1.0}, {"a": 1.0, "b": 9.0, "c": 1.0}):
        monkeypatch.setattr(mixing, "mix", lambda d, w=weights, **kw: mix(d, w, block_bytes=1 << 12, **kw))
        stored = Scratch(spark, "t").write(corpus_pipeline.mixed(spark, docs, sf))
        place = {r.doc_id: (r.f, r.i) for r in stored.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()}
        out = corpus_pipeline.packed(spark, stored, sf).collect()
        assert {r.doc_id for r in out} == set(source)
        starts = sorted((r.sequence_id, place[r.doc_id]) for r in out if r.offset == 0)
        assert [q for q, _ in starts] == list(range(len({r.sequence_id for r in out})))
        assert [p for _, p in starts] == sorted(p for _, p in starts)
        early.append(Counter(source[r.doc_id] for r in out if r.sequence_id < len(starts) // 4))
        results.append(sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in out))
    assert results[0] != results[1]
    assert early[0]["a"] > 2 * early[0]["b"] and early[1]["b"] > 2 * early[1]["a"]
