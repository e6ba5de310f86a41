"""Substring dedup with a log-structured fingerprint index (operator 4).

A window is ``words`` consecutive words of one text. Its fingerprint is the smallest hash of the ``gram``-word
sequences inside it, so equal windows have equal fingerprints and neighbouring windows mostly share theirs.

* ``FingerprintIndex`` keeps sorted immutable runs of (fingerprint, row), each a table bucketed and sorted by
  fingerprint. A new batch becomes a run, is merge-joined with every older run without a shuffle of either, and
  fingerprints met before (or twice in the batch) are recorded. When more than ``fanout`` runs exist they are
  compacted into one.
* Candidates are verified on whole windows: stretches of windows with one fingerprint are grouped by
  (fingerprint, hash of the stretch), and where stretches of one fingerprint differ, by (fingerprint, hash of the
  window). Both hashes must agree, 128 bits in all.
* Words covered by a window that starts anywhere else too are removed, from every copy.

Nulls, ties and odd rows: a null text has no words; texts shorter than a window lose nothing; rows that repeat id
and text count as copies of each other; rows that share an id only are told apart by their texts; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, documents, filled, partitions, public_id, schema_of, slices

WORDS, GRAM = 35, 8


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbours, by doubling."""
    step, m = 1, x
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest and len(m) > rest else m[: max(0, len(m) - rest)]


def fingerprints(w: Words, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the window from each word on, and whether the window begins with the sequence that gave it."""
    grams = w.windows(gram)
    fp = window_minimum(grams, words - gram + 1)[: max(0, len(w.hash) - words + 1)]
    return fp, grams[: len(fp)] == fp


def stretches(fp: np.ndarray, leaves: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each stretch, in one text, whose fingerprint comes from one place.

    The leftmost place counts, so windows that are equal are never in one stretch, and have the same place in theirs.
    """
    at = np.flatnonzero(ok)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (fp[at[1:]] != fp[at[:-1]]) | leaves[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def _texts_of(w: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, at, "right") - 1


def _prints(words: int, gram: int):
    schema = schema_of("fp long, _id long, _th long, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            w = Words(filled(b, "_text"))
            fp, leaves = fingerprints(w, words, gram)
            at, _ = stretches(fp, leaves, w.inside(words))
            doc = _texts_of(w, at)
            key = fp[at]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(key)))
            doc = doc[first]
            yield pa.record_batch([pa.array(key[first].view(np.int64)), b.column("_id").take(pa.array(doc)), b.column("_th").take(pa.array(doc)), pa.array(n.astype(np.int32))], schema=schema)

    return run


class FingerprintIndex:
    """Sorted immutable runs of fingerprints; ``add`` returns the fingerprints that a batch has made repeated."""

    def __init__(self, spark: SparkSession, scratch: Scratch, words: int = WORDS, gram: int = GRAM, fanout: int = 1):
        self.spark, self.scratch, self.words, self.gram, self.fanout = spark, scratch, words, gram, fanout
        self.buckets = partitions(spark)
        self.runs: list[tuple[str, str]] = []

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"fingerprints_{uuid.uuid4().hex[:12]}", self.scratch.path("run")
        (
            df.repartition(self.buckets, "fp").sortWithinPartitions("fp")
            .write.option("compression", "zstd").option("path", path).bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        )
        return name, path

    def add(self, docs: DataFrame) -> DataFrame:
        """docs: rows of ``documents()``."""
        name, path = self._write(docs.select("_id", "_th", "_text").mapInArrow(_prints(self.words, self.gram), "fp long, _id long, _th long, n int"))
        run = self.spark.table(name)
        hits = run.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
        for old, _ in self.runs:
            both = run.select("fp").distinct().hint("merge").join(self.spark.table(old).select("fp").distinct(), "fp")
            hits = hits.unionByName(both)
        hits = self.scratch.write(hits.distinct(), "hits")
        self.runs.append((name, path))
        if len(self.runs) > self.fanout:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one and delete them."""
        merged = None
        for name, _ in self.runs:
            merged = self.spark.table(name) if merged is None else merged.unionByName(self.spark.table(name))
        new = self._write(merged)
        self.close()
        self.runs = [new]

    def close(self) -> None:
        """Delete the runs."""
        for name, path in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.drop(path)
        self.runs = []

    def rows(self, hits: DataFrame) -> DataFrame:
        """(_id, _th, fps): the repeated fingerprints of each row that has any."""
        found = None
        for name, _ in self.runs:
            r = self.spark.table(name).select("fp", "_id", "_th").join(hits, "fp", "left_semi")
            found = r if found is None else found.unionByName(r)
        return found.groupBy("_id", "_th").agg(F.collect_set("fp").alias("fps"))


_LOOKED = "_id long, _th long, _text string, fps array<long>, n_words long, kept_sha256 string, _row {row}"
_CUT = "_id long, _th long, n_words long, n_removed long, kept_sha256 string, kept_text string, _row {row}"
_SEGMENT = "fp long, whole long, _id long, _th long, start int, n int, windows array<long>"


def _look(text_for_all: bool, ddl: str):
    """Finish rows without repeated fingerprints; pass the text of the others on."""
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            fps = b.column("fps")
            open_ = np.asarray(fps.is_valid())
            texts, n, sha = b.column("_text"), [], []
            for t, o in zip(texts.to_pylist(), open_, strict=True):
                ws = [] if o else (t or "").encode().split()
                n.append(len(ws))
                sha.append(None if o else hashlib.sha256(b" ".join(ws)).hexdigest())
            keep = texts if text_for_all else pa.array([t if o else None for t, o in zip(texts.to_pylist(), open_, strict=True)], pa.string())
            yield pa.record_batch([b.column("_id"), b.column("_th"), keep.cast(pa.string()), fps, pa.array(n, pa.int64()), pa.array(sha, pa.string()), b.column("_row").cast(schema.field("_row").type)], schema=schema)

    return run


def _segments(words: int, gram: int):
    schema = schema_of(_SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            w = Words(filled(b, "_text"))
            (fp, leaves), wh = fingerprints(w, words, gram), w.windows(words)
            at, n = stretches(fp, leaves, w.inside(words))
            doc = _texts_of(w, at)
            lists = b.column("fps")
            flat, off = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets)
            off = off - off[0]
            keep = np.zeros(len(at), bool)
            bounds = np.searchsorted(doc, np.arange(b.num_rows + 1))
            for d in range(b.num_rows):
                lo, hi = bounds[d], bounds[d + 1]
                if hi > lo:
                    keep[lo:hi] = np.isin(fp[at[lo:hi]], flat[off[d] : off[d + 1]])
            at, n, doc = at[keep], n[keep], doc[keep]
            # the hash of a stretch covers the hashes of all its windows, in order
            total = np.zeros(len(wh) + 1, np.uint64)
            np.cumsum(wh * (np.arange(len(wh), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), out=total[1:])
            plain = np.zeros(len(wh) + 1, np.uint64)
            np.cumsum(wh, out=plain[1:])
            shift = (at.astype(np.uint64)) * np.uint64(2)
            whole = (total[at + n] - total[at]) - shift * (plain[at + n] - plain[at]) + n.astype(np.uint64)
            idx = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(wh[idx].view(np.int64)))
            yield pa.record_batch(
                [pa.array(fp[at].view(np.int64)), pa.array(whole.view(np.int64)), b.column("_id").take(pa.array(doc)), b.column("_th").take(pa.array(doc)),
                 pa.array((at - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), arrays], schema=schema)

    return run


def repeated_windows(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """(_id, _th, spans): per row, (start, idx) of the stretches with repeated windows and which of theirs repeat.

    Equal stretches repeat as wholes. A stretch met once may still share windows with others of its fingerprint:
    only for those fingerprints are single windows counted, once for each kind of stretch.
    """
    kinds = scratch.write(segments.groupBy("fp", "whole").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("windows").alias("windows")), "kinds")
    lone = kinds.where("c = 1")
    near = kinds.join(lone.select("fp").distinct(), "fp", "left_semi").select("fp", "c", F.explode("windows").alias("wh"))
    totals = near.groupBy("fp", "wh").agg(F.sum("c").alias("total")).where("total > 1").select("fp", "wh")
    parts = lone.select("fp", "whole", F.posexplode("windows").alias("i", "wh")).join(totals, ["fp", "wh"], "left_semi")
    again = parts.groupBy("fp", "whole").agg(F.sort_array(F.collect_set("i")).alias("idx"))
    again = again.unionByName(kinds.where("c > 1").select("fp", "whole", F.sequence(F.lit(0), F.col("n") - 1).alias("idx")))
    hit = segments.select("fp", "whole", "_id", "_th", "start").join(again, ["fp", "whole"])
    return hit.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "idx")).alias("spans"))


def covered(n_words: int, spans: list[dict], words: int) -> np.ndarray:
    mark = np.zeros(n_words + 1, np.int64)
    for s in spans:
        i = s["start"] + np.asarray(s["idx"])
        mark[i] += 1
        np.subtract.at(mark, np.minimum(i + words, n_words), 1)
    return np.cumsum(mark[:n_words]) > 0


def _cut(words: int, with_text: bool, ddl: str):
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            out: list[list] = [[], [], [], []]
            for t, spans in zip(b.column("_text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = (t or "").encode()
                ws = raw.split()
                gone = covered(len(ws), spans or [], words)
                kept = [x for x, g in zip(ws, gone, strict=True) if not g]
                out[0].append(len(ws))
                out[1].append(int(gone.sum()))
                out[2].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out[3].append(None if not with_text else t if not spans else remaining(raw, gone))
            yield pa.record_batch([b.column("_id"), b.column("_th"), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), b.column("_row").cast(schema.field("_row").type)], schema=schema)

    return run


def remaining(raw: bytes, gone: np.ndarray) -> str:
    """The text without the words marked, other white space as it was (a removed stretch leaves the space before it)."""
    w = Words(pa.array([raw.decode()], pa.large_string()))
    stop = np.append(w.start, len(raw))[1:]
    return b"".join(raw[a:z] for a, z, g in zip(w.start, stop, gone, strict=True) if not g).decode().rstrip(" \n\t")


def dedup(docs: DataFrame, words: int = WORDS, gram: int = GRAM, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Remove each word covered by a window of ``words`` words that starts anywhere else as well.

    The documents enter the index in ``batches`` parts by id, as they would arrive over time. Returns id_col,
    n_words, n_removed, kept_sha256; with ``carry`` also kept_text (null for null) and those columns.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    row = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("boolean")
    d = docs.withColumn("_row", row)
    d = documents(d, id_col, text_col, "_row")
    kind = d.schema["_row"].dataType.simpleString()
    index, hits = FingerprintIndex(spark, scratch, words, gram), None
    for k in range(batches):
        new = index.add(d.where(F.pmod(F.xxhash64("_id"), F.lit(batches)) == k) if batches > 1 else d)
        hits = new if hits is None else hits.unionByName(new)
    rows = index.rows(hits.distinct())
    looked, cut = _LOOKED.format(row=kind), _CUT.format(row=kind)
    looked = scratch.write(d.join(rows, ["_id", "_th"], "left").select("_id", "_th", "_text", "fps", "_row").mapInArrow(_look(bool(carry), looked), looked), "looked")
    index.close()
    scratch.keep_only(looked)
    open_ = looked.where("fps IS NOT NULL")
    segments = scratch.write(open_.select("_id", "_th", "_text", "fps").mapInArrow(_segments(words, gram), _SEGMENT), "segments")
    spans = scratch.write(repeated_windows(segments, scratch), "spans")
    scratch.keep_only(looked, spans)
    part = open_.select("_id", "_th", "_text", "_row").join(spans, ["_id", "_th"], "left").mapInArrow(_cut(words, bool(carry), cut), cut)
    done = looked.where("fps IS NULL").select("_id", "_th", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.col("_text").alias("kept_text"), "_row")
    out = part.unionByName(done)
    return out.select(public_id(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text", *(F.col("_row")[c].alias(c) for c in carry)] if carry else []))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
