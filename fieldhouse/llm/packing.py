"""Best-fit packing from a histogram of lengths (operator 2).

1. Every text becomes ids and an end id; more than ``size`` ids are cut into pieces, all but the first full.
2. Best-fit decreasing runs over the counts of the at most ``size`` lengths, not over pieces: a step gives one
   length's pieces to one range of equal bins, and each range is touched at most log2(size) times, so the plan has
   a few steps for each length whatever the corpus.
3. Pieces take their places by joining the plan on their rank within their length; ranks need no single task.
4. Where the texts have an order, pieces of a length are ranked by it, and sequences are numbered by it: by the place
   of the piece at their start.

Nulls, ties and odd rows: a null text is empty (one piece, the end id); null ids are carried; rows that repeat are
packed each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, filled, public_id, running, schema_of, slices

SIZE, END = 2048, 0
_PLAIN = re.compile("[^\n -~¡-ɏ]|<\\|")
_ENCODERS: dict[str, object] = {}


class Encoder:
    """Ids as the tokenizers library gives them. Texts of common letters go through the same vocabulary as ranks
    (several times faster); others, and texts with special strings, through the library itself."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(json_path)

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def encoder(json_path: str, ranks_path: str) -> Encoder:
    if json_path not in _ENCODERS:
        _ENCODERS[json_path] = Encoder(json_path, ranks_path)
    return _ENCODERS[json_path]  # type: ignore[return-value]


_PIECE = "_id long, _th long, piece int, start long, length long, ids_crc32 long"
_ORDER = ", _part long, _row long"


def _pieces(json_path: str, ranks_path: str, size: int, ordered: bool):
    schema = schema_of(_PIECE + (_ORDER if ordered else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path, ranks_path)
        for b in slices(batches, "_text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(filled(b, "_text").to_pylist()):
                ids = np.append(enc.ids(t), np.uint32(END)).astype("<u4")
                n = len(ids)
                first = n % size or size
                cuts = [0, *range(first, n + 1, size)]
                for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(ids[a:z].tobytes()))
            at = pa.array(row, pa.int64())
            yield pa.record_batch([b.column("_id").take(at), b.column("_th").take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *(b.column(c).take(at) for c in ("_part", "_row") if ordered)], schema=schema)

    return run


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first bin, pieces a bin, offset of the first) of best-fit decreasing.

    ``open_[r]`` holds the ranges (first bin, bins) with r left. A piece goes to the bin with the least room that
    takes it; as lengths fall, that bin takes as many of the same length as fit.
    """
    open_: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    steps, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        room = length
        while left:
            while room < size and not open_[room]:
                room += 1
            if not open_[room]:  # room == size: new bins
                each = size // length
                new = -(-left // each)
                open_[size].append((bins, new))
                bins += new
            first, n = open_[room].pop()
            each = room // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, full * each, first, each, size - room))
                open_[room - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer than ``each`` are left: one bin more
                steps.append((length, rank, left, first + full, left, size - room))
                open_[room - left * length].append((first + full, 1))
                full, left = full + 1, 0
            if full < n:
                open_[room].append((first + full, n - full))
    return steps


def pack(docs: DataFrame, json_path: str, ranks_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", order: tuple[Column, Column] | None = None) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    ``order`` gives each row a part and a row within the part (longs); parts must be small enough for one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    at = [c.cast("long").alias(n) for c, n in zip(order or (), ("_part", "_row"))]
    pieces = documents(docs, id_col, text_col, *at).mapInArrow(_pieces(json_path, ranks_path, size, bool(at)), _PIECE + (_ORDER if at else ""))
    pieces = scratch.write(pieces, "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    steps = plan(counts, size) or [(0, 0, 0, 0, 1, 0)]
    table = spark.createDataFrame(steps, "len long, rank long, n long, bin long, each long, base long")
    table = table.groupBy("len").agg(F.collect_list(F.struct("rank", "n", "bin", "each", "base")).alias("steps"))
    salts = max(16, -(-max(counts.values(), default=1) // 200_000))
    if at:
        ranked = running(pieces, "length", [F.col("_part"), F.col("_row"), F.col("piece")], F.lit(1), 0, "_rank", salt=F.col("_part"))
    else:
        ranked = running(pieces, "length", [F.col("_id"), F.col("_th"), F.col("piece")], F.lit(1), salts, "_rank")
    placed = ranked.join(F.broadcast(table), F.col("length") == F.col("len"))  # at most ``size`` rows
    step = F.filter("steps", lambda s: (s["rank"] <= F.col("_rank")) & (F.col("_rank") < s["rank"] + s["n"]))[0]
    placed = placed.withColumn("_s", step).withColumn("_i", F.col("_rank") - F.col("_s.rank"))
    placed = placed.select(
        "_id", "piece", "start", "length", "ids_crc32",
        (F.col("_s.bin") + F.floor(F.col("_i") / F.col("_s.each"))).cast("long").alias("sequence_id"),
        (F.col("_s.base") + F.col("_i") % F.col("_s.each") * F.col("length")).cast("long").alias("offset"),
        *(["_part", "_row"] if at else []),
    )
    if at:
        placed = scratch.write(placed, "placed")
        starts = placed.where("offset = 0").select("sequence_id", "_part", "_row", "piece", F.lit(0).alias("_all"))
        starts = running(starts, "_all", [F.col("_part"), F.col("_row"), F.col("piece")], F.lit(1), 0, "_new", salt=F.col("_part"))
        placed = placed.join(starts.select("sequence_id", "_new"), "sequence_id").withColumn("sequence_id", F.col("_new"))
    return placed.select(public_id(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_paths())
