"""N-gram Jaccard join by grouped prefixes (operator 9).

A text's set holds its distinct ``k``-word shingles (ASCII lower-cased); a text with fewer words has its whole
sequence as one; a text without words has an empty set and links with nothing. Two texts link when
``den * |a & b| >= num * |a | b|``.

1. A fixed-size sketch of shingle counts gives one global order, rare shingles first.
2. Texts with equal sets become one class; classes with equal prefixes (and sizes) become one group.
3. Groups meet in the posting lists of their prefix shingles. First every group is paired with its neighbour and
   with the leader of each list, members are expanded and verified on whole sets, and verified links are united.
4. Then every list that still holds two components gives all its group pairs across components that pass the size
   and position filters; their members are verified too. A pair left out is of one component already, so
   components are exact and the pairs inside a large group of near copies are never listed.

Nulls, ties and odd rows: null texts are empty; null ids are carried as null; rows that repeat are one class;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, Words, components, distinct_counts, documents, filled, mix, public_id, schema_of, slices

SKETCH_BITS, SLICE = 22, 1 << 15
HOT = 5000
SALTS = 64
FILTER_BITS = 23


def shingles(w: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    grams = w.windows(k)
    for a, z in zip(w.first[:-1], w.first[1:], strict=True):
        if z - a >= k:
            yield distinct_counts(grams[a : z - k + 1])[0]
        elif z > a:
            h = np.full(1, z - a, np.uint64)
            for i in range(a, z):
                h = mix(h ^ w.hash[i : i + 1]) + w.hash[i : i + 1]
            yield h
        else:
            yield np.zeros(0, np.uint64)


def _counted(k: int):
    schema = schema_of("part int, slice int, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in slices(batches, "_text"):
            w = Words(filled(b, "_text"), lower=True)
            g = w.windows(k)[w.inside(k)]
            total += np.bincount((g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        yield from _sliced(total, schema)

    return run


def _sliced(total: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if total.any():
        parts = np.minimum(total, 0xFFFF).astype(np.uint16).reshape(-1, SLICE)
        n = len(parts)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)


def _added(kind: type):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, kind)
        return pd.DataFrame({"part": [0], "slice": [pdf["slice"].iloc[0]], "counts": [total.tobytes()]})

    return run


def scaled(count: np.ndarray) -> np.ndarray:
    """Counts as two bytes on a logarithmic scale, so that the order holds for counts of any size."""
    return np.round(1024 * np.log2(1 + count.astype(np.float64))).astype(np.uint16)


def _gathered(part: DataFrame, bits: int, tasks: int) -> np.ndarray:
    """Partial counts of so many tasks added in two levels of about the square root of them, and scaled: 2**bits two-byte
    counts, whatever the input."""
    ddl = "part int, slice int, counts binary"
    groups = max(1, round(tasks**0.5))
    part = part.groupBy("slice", F.pmod("part", F.lit(groups)).alias("group")).applyInPandas(_added(np.uint16), ddl)
    total = np.zeros(1 << bits, np.uint16)
    for r in part.groupBy("slice").applyInPandas(_added(np.uint64), ddl).collect():
        total[r.slice * SLICE : (r.slice + 1) * SLICE] = scaled(np.frombuffer(r.counts, np.uint64))
    return total


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles by the first bits of their hash: 8 MB whatever the input. Any order is right for the join;
    counts only make it cheap."""
    texts = docs.select("_text")
    return _gathered(texts.mapInArrow(_counted(k), "part int, slice int, counts binary"), SKETCH_BITS, texts.rdd.getNumPartitions())


def _bit():
    return F.pmod(F.xxhash64("_id", "_th"), F.lit(1 << FILTER_BITS)) + 1


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose _id and _th may be in ``ids``: a bitmap of hashes, 1 MB in 256 rows whatever the input, is
    broadcast, so that the other rows need not be shuffled."""
    bits = ids.select(F.bitmap_bucket_number(_bit()).alias("_bucket"), F.bitmap_bit_position(_bit()).alias("p"))
    bits = F.broadcast(bits.groupBy("_bucket").agg(F.bitmap_construct_agg("p").alias("_bits")))
    d = docs.withColumn("_bucket", F.bitmap_bucket_number(_bit())).join(bits, "_bucket")
    place = F.bitmap_bit_position(_bit())
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return d.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0).select(*docs.columns)


_SIGNED = "_id long, _th long, n int, d1 long, d2 long, p1 long, p2 long, prefix array<long>, hot array<long>"


def _digest(s: np.ndarray) -> tuple[int, int]:
    a = mix(s).sum(dtype=np.uint64)
    b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _signed(k: int, num: int, den: int, counts):
    schema = schema_of(_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for b in slices(batches, "_text"):
            out: list[list] = [[] for _ in range(7)]
            for s in shingles(Words(filled(b, "_text"), lower=True), k):
                n = len(s)
                take = n + (-num * n) // den + 1 if n else 0  # n - ceil(num * n / den) + 1
                often = table[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((s, often))[:take]
                p, hot = s[first], often[first] > scaled(np.array([HOT]))[0]
                for c, v in zip(out, (n, *_digest(s), *_digest(p), p[~hot].view(np.int64), p[hot].view(np.int64)), strict=True):
                    c.append(v)
            yield pa.record_batch([b.column("_id"), b.column("_th"), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:5]), *(pa.array(c, pa.list_(pa.int64())) for c in out[5:])], schema=schema)

    return run


def _sets(k: int):
    schema = schema_of("node long, items array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            sets = [x.view(np.int64) for x in shingles(Words(filled(b, "_text"), lower=True), k)]
            yield pa.record_batch([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def _verified(pairs: DataFrame, docs: DataFrame, own: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) that link, on the whole sets of the texts that ``own`` (node, _id, _th) names.

    Only texts of the pairs are shuffled, but for a few that a fixed-size filter lets pass.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = scratch.write(own.select("node", "_id", "_th").join(ids, "node", "left_semi"), "ids")
    sets = only(docs.select("_id", "_th", "_text"), ids).join(ids, ["_id", "_th"]).select("node", "_text").mapInArrow(_sets(k), "node long, items array<long>")
    sets = scratch.write(sets, "sets")
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
        .select("a", "b", F.size("ia").alias("na"), F.size("ib").alias("nb"), F.size(F.array_intersect("ia", "ib")).alias("both"))
    )
    before = [t for t, _ in scratch.tables if t is not ids and t is not sets]
    links = scratch.write(both.where(F.lit(den).cast("long") * F.col("both") >= F.lit(num).cast("long") * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "links")
    scratch.keep_only(*before, links)
    return links


def _n(np_: str):
    return F.shiftright(np_, 32)


def _pos(np_: str):
    return F.shiftright(np_, 6).bitwiseAND(F.lit((1 << 26) - 1))


def _sized(x: str, y: str, num: int, den: int):
    return F.lit(den) * F.least(_n(x), _n(y)) >= F.lit(num) * F.greatest(_n(x), _n(y))


def _reaches(na, nb, pa_, pb, num: int, den: int):
    """Whether sets that meet first at these positions can still overlap enough."""
    return F.lit(num + den) * (F.lit(1) + F.least(na - pa_ - 1, nb - pb - 1)) >= F.lit(num) * (na + nb)


def link(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (smallest id reachable by links, itself included).

    With ``keys`` also _id and _th, which name the row, and of the smallest id's texts the one with the smallest
    hash, as root_id and root_th (the row's own where the text has no words).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    d = documents(docs, id_col, text_col)
    counts = spark.sparkContext.broadcast(sketch(d, k))
    signed = scratch.write(d.mapInArrow(_signed(k, num, den, counts), _SIGNED), "signed")

    same, group = ["n", "d1", "d2"], ["n", "p1", "p2"]
    # a class is a node of its own: rows that share an id, or have none, are linked by their texts alone
    classes = signed.where("n > 0").groupBy(*same).agg(F.min(F.struct("_id", "_th")).alias("at"))
    classes = scratch.write(classes.select(*same, "at._id", "at._th", F.monotonically_increasing_id().alias("node")), "classes")
    first = classes.select("node", "_id", "_th", "n", "d1", "d2")
    own = scratch.write(signed.where("n > 0").select("_id", "_th", *same, "p1", "p2").join(first, [*same, "_id", "_th"]).select("node", "_id", "_th", *group).distinct(), "own")
    groups = scratch.write(own.groupBy(*group).agg(F.min(F.struct("node", "_id", "_th")).alias("at")).select(*group, "at.*").withColumnRenamed("node", "gid"), "groups")
    members = scratch.write(own.select("node", *group).join(groups.select("gid", *group), group).select("node", "gid", "n"), "members")

    # posting lists (h, gid, np): np holds the size, the position and, for hot shingles, a salt
    led = signed.where("n > 0").join(groups, [*group, "_id", "_th"]).select("gid", "n", "prefix", "hot")
    salt = F.when(F.col("i") < F.size("prefix"), F.lit(0)).otherwise(F.pmod(F.xxhash64("gid"), F.lit(SALTS - 1)) + 1)
    lists = led.select("gid", "n", "prefix", F.posexplode(F.concat("prefix", "hot")).alias("i", "h"))
    lists = lists.select("h", "gid", (F.shiftleft(F.col("n").cast("long"), 32) + F.shiftleft(F.col("i").cast("long"), 6) + salt).alias("np"))
    # the set that has a shingle earliest has fewest that are rarer: it is the most central of the list, and leads it
    near = W.partitionBy("h", F.col("np").bitwiseAND(F.lit(SALTS - 1))).orderBy(_pos("np"), "np", "gid")
    entry = F.struct("gid", "np")
    lists = lists.select("*", F.lag(entry).over(near).alias("prev"), F.lead("gid").over(near).alias("next"), F.first(entry).over(near).alias("lead"))
    salted = F.col("np").bitwiseAND(F.lit(SALTS - 1)) > 0
    lists = scratch.write(lists.where(F.col("prev").isNotNull() | F.col("next").isNotNull() | salted), "lists")

    # first try: neighbours and leaders of the lists, for each group the two it meets most often
    met = lists.where("prev IS NOT NULL").select(F.explode(F.array_distinct(F.array("prev", "lead"))).alias("x"), F.col("gid").alias("b"), "np")
    met = met.where((F.col("x.gid") != F.col("b")) & _sized("x.np", "np", num, den) & _reaches(_n("x.np"), _n("np"), _pos("x.np"), _pos("np"), num, den))
    met = met.groupBy(F.col("x.gid").alias("a"), "b").count()
    best = W.partitionBy("b").orderBy(F.desc("count"), "a")
    met = met.withColumn("r", F.row_number().over(best)).where("r <= 2").select("a", "b")
    over = W.partitionBy("h").orderBy(_pos("np"), "np", "gid")
    heads = lists.where(salted & (F.col("gid") == F.col("lead.gid"))).select("h", "gid", "np")
    across = heads.select(F.lag("gid").over(over).alias("a"), F.col("gid").alias("b")).where("a IS NOT NULL AND a <> b")
    kin = W.partitionBy("gid").orderBy("node")
    inside = members.where("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    inside = inside.unionByName(members.select(F.col("node").alias("a"), F.lead("node").over(kin).alias("b")).where("b IS NOT NULL"))
    tried = met.unionByName(across).unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = scratch.write(tried, "tried")
    links = _verified(tried, d, own, k, num, den, scratch)
    parts = components(links, scratch)

    # then: whatever is still apart though it shares a list
    of = scratch.write(members.join(parts, "node", "left").select("node", "gid", F.coalesce("component", "node").alias("c")), "of")
    span = of.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    posted = scratch.write(lists.select("h", "gid", "np").join(span, "gid"), "posted")
    open_ = posted.groupBy("h").agg(F.min("lo").alias("l"), F.max("hi").alias("g")).where("l < g").select("h")
    posted = scratch.write(posted.join(open_, "h", "left_semi"), "open")
    x, y = posted.alias("x"), posted.alias("y")
    apart = (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))
    smaller = (F.col("x.np") < F.col("y.np")) | ((F.col("x.np") == F.col("y.np")) & (F.col("x.gid") < F.col("y.gid")))
    # the smaller set meets a larger one within a shorter prefix: n - ceil(2t / (1 + t) * n) + 1
    short = F.lit(num + den) * (_n("x.np") - _pos("x.np")) >= F.lit(2 * num) * _n("x.np")
    # a pair that links passes this in the list of the first shingle it shares
    reach = _reaches(_n("x.np"), _n("y.np"), _pos("x.np"), _pos("y.np"), num, den)
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & smaller & _sized("x.np", "y.np", num, den) & short & reach & apart)
    pairs = pairs.select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct()
    ma, mb = of.select(F.col("gid").alias("ga"), F.col("node").alias("a"), F.col("c").alias("ca")), of.select(F.col("gid").alias("gb"), F.col("node").alias("b"), F.col("c").alias("cb"))
    rest = pairs.join(ma, "ga").join(mb, "gb").where("ca <> cb").select("a", "b")
    mine = of.join(span.where("lo < hi").select("gid"), "gid", "left_semi")
    rest = rest.unionByName(mine.alias("p").join(mine.alias("q"), (F.col("p.gid") == F.col("q.gid")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.c") != F.col("q.c"))).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")))
    rest = scratch.write(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _verified(rest, d, own, k, num, den, scratch)
        if not more.isEmpty():
            parts = components(links.unionByName(more), scratch)

    roots = parts.join(first, "node").groupBy("component").agg(F.min(F.struct("_id", "_th")).alias("root"))
    roots = parts.join(roots, "component").select("node", "root")
    to = scratch.write(classes.join(roots, "node", "left").select(*same, F.coalesce("root", F.struct("_id", "_th")).alias("root")), "to")
    scratch.keep_only(signed, to)
    more = ["_id", "_th", F.col("root._id").alias("root_id"), F.col("root._th").alias("root_th")] if keys else []
    rooted = signed.where("n > 0").select("_id", "_th", *same).join(to, same).select("_id", "_th", "n", "root")
    rooted = rooted.unionByName(signed.where("n = 0").select("_id", "_th", "n", F.struct("_id", "_th").alias("root")))
    return rooted.select(public_id(id_col), F.col("n").cast("long").alias("n_shingles"), public_id("component_id", "root._id"), *more)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
