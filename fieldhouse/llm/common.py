"""Shared pieces: scratch tables, distributed ranks, connected components, and word hashing in numpy.

Words everywhere are maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` in the UTF-8 text.
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one is set only where none is and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldhouse-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: bytes of an Arrow batch on its way to a Python worker; whole texts make Spark's default of 64 MB a real cost on both sides
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``ARROW_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


class Scratch:
    """Tables that one operator call writes to cut lineage; they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.tables = 0, []
        small_batches(spark)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def keep_only(self, *needed: DataFrame) -> None:
        """Delete all tables written so far but the given ones; whatever reads the others must be written itself."""
        for df, path in self.tables:
            if not any(df is k for k in needed):
                self.drop(path)
        self.tables = [t for t in self.tables if any(t[0] is k for k in needed)]

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def drop(self, path: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id and the text, under private names, so that extra columns cannot clash.

    ``_id`` (null ids become the smallest long) with ``_th`` (a hash of the text) names a row; rows that repeat
    both are equal and get equal results.
    """
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_th"),
        F.col(text_col).alias("_text"),
        *more,
    )


def public_id(name: str = "doc_id", col: str = "_id") -> Column:
    return F.when(F.col(col) != F.lit(-(2**63)), F.col(col)).alias(name)


def named(value: Column) -> Column:
    """A text value as a key that is never null, the null one apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def named_key(value: str | None) -> str:
    return "" if value is None else "=" + value


def unnamed(key: str) -> Column:
    return F.when(F.col(key) != "", F.expr(f"substr({key}, 2)"))


# ---------------------------------------------------------------- ranks without a window over a hot key


def running(df: DataFrame, key: str, order: list[Column], weight: Column, n_salts: int, out: str, salt: Column | None = None) -> DataFrame:
    """Exclusive running sum of ``weight`` within ``key``, over any one total order of the key's rows; in ``order`` itself
    where ``salt`` is given, a long that grows with it and has few enough rows a value and few enough values.

    A key may hold most of the rows: each key is dealt over ``n_salts`` by a hash of ``order``; sums run inside
    (key, salt), and the totals of the smaller salts, at most ``n_salts`` rows a key, are added.
    ``order`` must name a row, or rows that tie must be equal.
    """
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n_salts)).cast("int") if salt is None else salt).withColumn("_w", weight.cast("long"))
    totals = d.groupBy(key, "_salt").agg(F.sum("_w").alias("_sum"))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(F.col(key).alias("_bk"), F.col("_salt").alias("_bs"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy(key, "_salt").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    return (
        d.join(base, d[key].eqNullSafe(base["_bk"]) & (d["_salt"] == base["_bs"]), "inner")
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_salt", "_w", "_bk", "_bs", "_base", "_in")
    )


# ---------------------------------------------------------------- connected components


#: a side of a join is broadcast if it has at most so many rows of two longs (a few MB); else Spark shuffles it
SMALL_ROWS = 200_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, rows with a null left out); component is the smallest node reachable.

    Randomised contraction: each round every node moves to the neighbour (itself included) with the smallest
    salted hash, the edges follow, loops go. A round removes a constant share of the nodes on average, so rounds
    grow with the logarithm of the largest component. Nothing is collected but row counts.
    """
    e = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    first, moves = e, []
    while not e.isEmpty():
        salt = F.lit(len(moves) * 7919)
        rank = lambda c: F.struct(F.xxhash64(salt, c).alias("r"), c.alias("v"))
        ends = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
        move = ends.groupBy(F.col("x.a").alias("node")).agg(F.min(rank(F.col("x.b"))).alias("m"))
        move = scratch.write(move.select("node", F.least(F.col("m"), rank(F.col("node")))["v"].alias("to")), "moves")
        move = F.broadcast(move) if move.count() <= SMALL_ROWS else move
        moves.append(move)
        e = e.join(move.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        e = e.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        e = scratch.write(e.distinct() if len(moves) == 1 else e, "edges")
    if not moves:
        return first.select(F.col("a").alias("node"), F.col("a").alias("component"))
    label = moves[0].select("node", F.col("to").alias("root"))
    for m in moves[1:]:
        label = label.join(m.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    label = scratch.write(label, "labels")
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return scratch.write(label.join(least, "root").select("node", "component"), "components")


# ---------------------------------------------------------------- words and hashes in numpy

_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_VAL = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base % 2**64, pow(base, -1, 2**64), 0
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            steps = np.full(self.n, self.base, np.uint64), np.full(self.n, self.inverse, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


_POW, _POW2 = _Powers(_BASE), _Powers(_BASE2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of some texts: ``hash`` per word, ``start``/``end`` byte offsets into ``data``, ``first`` word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        if lower:
            data = _LOWER[data]
        self.data, self.bound = data, off - off[0]
        n = len(data)
        sep = _SEP[data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:], after[:n] = sep, sep
        before[self.bound], after[self.bound] = True, True
        self.start = np.flatnonzero(~sep & before[:n])
        self.end = np.flatnonzero(~sep & after[1:]) + 1
        up, down = _POW.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VAL[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.bound)

    def windows(self, k: int, second: bool = False) -> np.ndarray:
        """Hash of the k words from each word on, also where they run into the next text (see ``inside``)."""
        h, p = (mix(self.hash ^ _U(_BASE2)), _POW2) if second else (self.hash, _POW)
        n = len(h)
        if n < k:
            return np.zeros(0, np.uint64)
        up, down = p.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=total[1:])
        return mix((total[k:] - total[: n + 1 - k]) * down[: n + 1 - k])

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are of one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, bool)
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(n - k + 1) + k <= ends[: n - k + 1]


def distinct_counts(x: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs; sorting is many times faster than ``np.unique`` on long arrays."""
    x = x if ordered else np.sort(x)
    if not len(x):
        return x, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


def release() -> None:
    """Give freed memory back to the system: Python workers are used again and keep what earlier tasks took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of about ``most`` bytes of text (a longer text is a piece of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        if b.nbytes <= most:
            yield b
            continue
        col = b.column(text).cast(pa.large_string())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
    release()


def filled(b: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty texts."""
    import pyarrow.compute as pc

    return pc.fill_null(b.column(name), "").cast(pa.large_string())


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))
