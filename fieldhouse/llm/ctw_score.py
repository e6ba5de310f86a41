"""Language-model scores by context-tree weighting (operator 10).

A text is its lower-cased (ASCII) words, each followed by a space, the last by a line end; an empty text is a line
end. Every byte is eight binary decisions. A decision's context is the bits of its byte so far and the ``depth``
bytes before it; for every suffix of that context, training gives counts of zeros and ones, their
Krichevsky-Trofimov estimate, and the weight of the estimate against the deeper ones (one half each before the data
is seen). The score is the log10 probability of the text under the mixture; ``bits_per_byte`` is its code length.

1. Documents are packed into compressed blocks of about 1 MB, stored once, and blocks are dealt in turn over chunks of
   some 80 MB of text. A chunk gives its distinct grams (a byte under the ``depth`` bytes before it) and words with
   their training counts, 0 where only held-out texts have them.
2. The counts are added by key. The tree below contexts of ``TOP`` bytes is weighted in numpy, all grams of one such
   context together; there are at most 256 ** (depth - TOP) contexts below one. Their weights go up to the root and
   the mixture comes down again level by level as DataFrame steps; then numpy carries it on to each gram.
3. The chunks' keys are joined with the finished logarithms, cross to their chunk as compressed packs of many keys, and meet
   the chunk's blocks again, which stream by.

The depth is the same for every input, no part of the tree or of the vocabulary is broadcast or sent to the driver,
and a gram that training has not seen goes through the tree as one with zero counts. Words are told apart by 63-bit
hashes.

Nulls, ties and odd rows: a null text is empty; a null id is carried and counted as the empty string in the split;
rows that repeat are scored (and trained on) each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, distinct_counts, documents, filled, partitions, public_id, release, schema_of, slices

#: bytes of context, at most 6 so that a gram fits a positive long; bytes down to which levels are DataFrame steps
DEPTH, TOP = 6, 3
CHUNK_BYTES, BLOCK_BYTES, GROUP_ROWS, PACK_ROWS = 80 << 20, 1 << 20, 1 << 17, 1 << 19
_U = np.uint64


def canonical(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def _low(d: int) -> int:
    """Mask of a byte and its d newest context bytes."""
    return (1 << 8 * (d + 1)) - 1


def coded(texts: list[bytes], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first text, text of each byte less the first (below 256), gram of each byte: the byte is lowest, under it the newest of
    the bytes before it, and so on) that cover every byte of every text once; a long text is several blocks."""
    pad = b"\n" * depth
    at = 0
    while at < len(texts):
        body, size = [], 0
        while at + len(body) < len(texts) and len(body) < 256 and size < BLOCK_BYTES:
            body.append(canonical(texts[at + len(body)]))
            size += len(body[-1])
        lengths = np.array([len(x) + depth for x in body])
        raw = np.frombuffer(b"".join(pad + x for x in body), np.uint8)
        who = np.repeat(np.arange(len(body), dtype=np.uint8), lengths)
        real = np.ones(len(raw), bool)
        real[(np.cumsum(lengths) - lengths)[:, None] + np.arange(depth)] = False
        for a in range(0, len(raw), 4 * BLOCK_BYTES):
            z, lo = min(len(raw), a + 4 * BLOCK_BYTES), max(0, a - depth)
            part = raw[lo:z].astype(_U)
            key = part.copy()
            for d in range(1, depth + 1):
                key[d:] |= part[:-d] << _U(8 * d)
            ok = real[a:z]
            yield at, who[a:z][ok], key[a - lo :][ok]
        at += len(body)


# ---------------------------------------------------------------- blocks of documents


def _compressed(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _packed(chunks: int):
    schema = schema_of("_chunk int, block binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7919
        for b in slices(batches, "_text", BLOCK_BYTES):
            yield pa.record_batch([pa.array([at % chunks], pa.int32()), pa.array([_compressed(b)], pa.binary())], schema=schema)
            at += 1

    return run


def _unpacked(block: pa.Scalar) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches of a block and their texts, nulls as empty ones."""
    with pa.ipc.open_stream(block.as_buffer()) as f:
        for b in f:
            yield b, filled(b, "_text")


# ---------------------------------------------------------------- a chunk's grams and words


def _word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A key (a negative long) for each word, and the text it is of."""
    w = Words(texts, lower=True)
    return (w.hash | _U(1 << 63)).view(np.int64), np.repeat(np.arange(len(texts)), np.diff(w.first))


class _Counted:
    """Keys with their counts, added up whenever as many new ones have come as a quarter of those there are."""

    def __init__(self):
        self.key, self.n, self.parts, self.new = np.zeros(0, np.int64), np.zeros(0, np.int32), [], 0

    def add(self, keys: np.ndarray, learn: bool) -> None:
        k, n = distinct_counts(keys)
        self.parts.append((k, n.astype(np.int32) if learn else np.zeros(len(n), np.int32)))
        self.new += len(k)
        if self.new > max(1 << 19, len(self.key) // 4):
            self.merge()

    def merge(self) -> None:
        key = np.concatenate([self.key, *(p[0] for p in self.parts)])
        n = np.concatenate([self.n, *(p[1] for p in self.parts)])
        self.key, self.n, self.parts, self.new = key[:0], n[:0], [], 0
        if not len(key):
            return
        order = np.argsort(key)
        n = n[order]
        key = key[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.n = np.add.reduceat(n, first, dtype=np.int32)
        self.key = key[first]


def _vocabulary(depth: int):
    schema = schema_of("_chunk int, key long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, kinds = None, (_Counted(), _Counted())

        def out() -> Iterator[pa.RecordBatch]:
            for c in kinds:
                c.merge()
                for a in range(0, len(c.key), GROUP_ROWS):
                    key, n = c.key[a : a + GROUP_ROWS], c.n[a : a + GROUP_ROWS]
                    yield pa.record_batch([pa.array(np.full(len(key), chunk, np.int32)), pa.array(key), pa.array(n.astype(np.int64))], schema=schema)
                c.__init__()
            release()

        for blocks in batches:
            for at, block in zip(blocks.column("_chunk").to_pylist(), blocks.column("block"), strict=True):
                if at != chunk:
                    yield from out()
                    chunk = at
                for b, texts in _unpacked(block):
                    for learn in (True, False):
                        some = texts.filter(pc.equal(b.column("_train"), learn))
                        if len(some):
                            kinds[0].add(_word_keys(some)[0], learn)
                            for _, _, gram in coded(some.cast(pa.large_binary()).to_pylist(), depth):
                                kinds[1].add(gram.view(np.int64), learn)
        yield from out()

    return run


# ---------------------------------------------------------------- the tree


def _lgamma(x, log):
    """ln gamma for x >= 0.5 by Stirling's series eight places on; for arrays and for Columns."""
    y = x + 8.0
    down = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    z = 1 / (y * y)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z / 1260)) / y - log(down)


def _kt(n0, n1, log):
    """ln of the Krichevsky-Trofimov probability of one sequence of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5, log) + _lgamma(n1 + 0.5, log) - _lgamma(n0 + n1 + 1.0, log) - math.log(math.pi)


class Below:
    """The tree below contexts of ``top`` bytes, from distinct grams and their counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int):
        order = np.argsort(key)
        self.depth, self.top, self.order = depth, top, order
        self.keys, self.n, self.up = {depth: key[order].astype(_U)}, {depth: n[order].astype(np.float64)}, {}
        for d in range(depth - 1, top - 1, -1):  # grams of one byte of context less, and where each goes
            short = self.keys[d + 1] & _U(_low(d))
            by = np.argsort(short, kind="stable")
            new = np.concatenate([[True], short[by][1:] != short[by][:-1]])
            self.keys[d], self.up[d + 1] = short[by][new], np.empty(len(by), np.int64)
            self.up[d + 1][by] = np.cumsum(new) - 1
            self.n[d] = np.bincount(self.up[d + 1], weights=self.n[d + 1])

    def weighted(self, j: int) -> dict[int, dict[str, np.ndarray]]:
        """depth -> the nodes after j bits of the byte, bottom-up: ``first`` gram, ``node`` of each gram, n0, n1, kt, below, lw, parent."""
        out: dict[int, dict[str, np.ndarray]] = {}
        for d in range(self.depth, self.top - 1, -1):
            k = self.keys[d]
            bits = k >> _U(8 - j)
            new = np.concatenate([[True], bits[1:] != bits[:-1]])
            c = {"first": np.flatnonzero(new), "node": np.cumsum(new) - 1}
            n1 = np.add.reduceat(self.n[d] * ((k >> _U(7 - j)) & _U(1)), c["first"])
            c["n0"], c["n1"] = np.add.reduceat(self.n[d], c["first"]) - n1, n1
            c["kt"] = c["lw"] = _kt(c["n0"], n1, np.log)
            if d < self.depth:
                deep = out[d + 1]
                deep["parent"] = c["node"][self.up[d + 1][deep["first"]]]
                c["below"] = np.bincount(deep["parent"], weights=deep["lw"])
                c["lw"] = np.logaddexp(c["kt"], c["below"]) - math.log(2)
            out[d] = c
        return out

    def names(self, j: int, first: np.ndarray) -> np.ndarray:
        """The keys of the top nodes after j bits: the context over the bits behind a leading one."""
        k = self.keys[self.top][first]
        byte = k & _U(255)
        return ((k - byte) + _U(1 << j) + (byte >> _U(8 - j))).astype(np.int64)

    def logs(self, names: np.ndarray, acc: np.ndarray, rem: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte, in the order given; ``acc`` of a top node is the mixture down to it, ``rem`` the weight
        that is left for deeper ones."""
        by = np.argsort(names)
        names, acc, rem = names[by], acc[by], rem[by]
        total = np.zeros(len(self.order))
        for j in range(8):
            nodes = self.weighted(j)
            at = np.searchsorted(names, self.names(j, nodes[self.top]["first"]))
            a, r = acc[at], rem[at]
            for d in range(self.top + 1, self.depth + 1):
                c = nodes[d]
                one = (c["n1"] + 0.5) / (c["n0"] + c["n1"] + 1.0)
                keep = 1 / (1 + np.exp(np.minimum(c["below"] - c["kt"], 700.0))) if "below" in c else np.ones(len(one))
                a, r = a[c["parent"]] + r[c["parent"]] * keep * one, r[c["parent"]] * (1 - keep)
            p = a[nodes[self.depth]["node"]]
            total += np.log10(np.where((self.keys[self.depth] >> _U(7 - j)) & _U(1) == 1, p, 1 - p))
        out = np.empty_like(total)
        out[self.order] = total
        return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by ``ctx`` again, some ``GROUP_ROWS`` at a time, each context whole."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append({k: b.column(k).to_numpy(zero_copy_only=False) for k in b.schema.names})
        rows += b.num_rows
        if rows >= GROUP_ROWS:
            all_ = joined()
            ctx = all_["ctx"]
            cut = int(np.searchsorted(ctx, ctx[-1]))
            if cut:
                yield {k: v[:cut] for k, v in all_.items()}
            held, rows = [{k: v[cut:] for k, v in all_.items()}], 0
    if held:
        yield joined()


def _up(depth: int, top: int):
    ddl = "key long, n0 double, n1 double, kt double, below double, lw double"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _together(batches):
            sub = Below(g["key"], g["n"], depth, top)
            for j in range(8):
                c = sub.weighted(j)[top]
                yield pa.record_batch([pa.array(sub.names(j, c["first"])), *(pa.array(c[x]) for x in ("n0", "n1", "kt", "below", "lw"))], schema=schema)
            del g, sub, c
        release()

    return run, ddl


def _down(depth: int, top: int):
    ddl = "key long, v double"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _together(batches):
            gram = g["n"] >= 0
            sub = Below(g["key"][gram], g["n"][gram], depth, top)
            v = sub.logs(g["key"][~gram], g["acc"][~gram], g["rem"][~gram])
            yield pa.record_batch([pa.array(g["key"][gram]), pa.array(v)], schema=schema)
            del g, sub, v
        release()

    return run, ddl


def gram_logs(grams: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(key, v): log10 probability of each gram's byte after its context, from distinct grams (key, n: training count)."""
    top = min(TOP, depth - 1)
    n_parts = partitions(grams.sparkSession)
    ctx = lambda d: F.col("key").bitwiseAND(F.lit(_low(d) - 255)).alias("ctx")
    dealt = lambda x: x.repartition(n_parts, "ctx").sortWithinPartitions("ctx")
    run, ddl = _up(depth, top)
    levels = [scratch.write(dealt(grams.select(ctx(top), "key", "n")).mapInArrow(run, ddl), f"level{top}")]
    for d in range(top - 1, -1, -1):
        # a node's key keeps its bits in the lowest byte at every level
        up = levels[0].groupBy(F.col("key").bitwiseAND(F.lit(_low(d))).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        up = up.select("key", "n0", "n1", _kt(F.col("n0"), F.col("n1"), F.log).alias("kt"), "below")
        high = F.greatest("kt", "below")
        up = up.withColumn("lw", high + F.log(0.5 * F.exp(F.col("kt") - high) + 0.5 * F.exp(F.col("below") - high)))
        levels.insert(0, scratch.write(up, f"level{d}"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    keep = 1 / (1 + F.exp(F.least(F.col("below") - F.col("kt"), F.lit(700.0))))
    done = None
    for d, level in enumerate(levels):
        here = level.select("key", one.alias("one"), keep.alias("keep"))
        if done is None:
            here = here.select("key", (F.col("keep") * F.col("one")).alias("acc"), (1 - F.col("keep")).alias("rem"))
        else:
            up = done.select(F.col("key").alias("up"), F.col("acc").alias("pa"), F.col("rem").alias("pr"))
            here = here.withColumn("up", F.col("key").bitwiseAND(F.lit(_low(d - 1)))).join(up, "up")
            here = here.select("key", (F.col("pa") + F.col("pr") * F.col("keep") * F.col("one")).alias("acc"), (F.col("pr") * (1 - F.col("keep"))).alias("rem"))
        done = scratch.write(here, f"mixed{d}")
    run, ddl = _down(depth, top)
    none = F.lit(None).cast("double")
    both = grams.select(ctx(top), "key", "n", none.alias("acc"), none.alias("rem")).unionByName(done.select(ctx(top), "key", F.lit(-1).cast("long").alias("n"), "acc", "rem"))
    return scratch.write(dealt(both).mapInArrow(run, ddl), "logs")


# ---------------------------------------------------------------- scoring


def _answers():
    """Rows (_chunk, key, v) as packs (_chunk, block): of some ``PACK_ROWS`` rows at a time, each chunk's keys in order, as steps from
    one to the next (modulo 2**64), and their values."""
    schema = schema_of("_chunk int, block binary")

    def packs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, key, v = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("_chunk", "key", "v"))
        order = np.lexsort((key, chunk))
        chunk, key, v = chunk[order], key[order], v[order]
        cut = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            pack = pa.record_batch([pa.array(np.diff(key[a:z], prepend=np.int64(0))), pa.array(v[a:z])], names=["step", "v"])
            yield pa.record_batch([pa.array(chunk[a : a + 1]), pa.array([_compressed(pack)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= PACK_ROWS:
                yield from packs(held)
                held, rows = [], 0
        if held:
            yield from packs(held)
        del held
        release()

    return run


def _answered(pack: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a pack and their values."""
    with pa.ipc.open_stream(pack.as_buffer()) as f:
        b = f.read_next_batch()
        return np.cumsum(b.column("step").to_numpy()), b.column("v").to_numpy()


_SCORED = "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _scored(depth: int, total: int, distinct: int, ends: int):
    schema = schema_of(_SCORED)
    log_total = math.log10(total + 0.5 * (distinct + 1))

    def scored(b: pa.RecordBatch, texts: pa.Array, key: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        n = b.num_rows
        words, who = _word_keys(texts)
        c = v[np.searchsorted(key, words)]
        base = np.bincount(who, weights=np.log10(c + 0.5), minlength=n) + math.log10(ends + 0.5)
        tokens = np.bincount(who, minlength=n) + 1
        seen = np.bincount(who, weights=c > 0, minlength=n).astype(np.int64) + (ends > 0)
        score, size = np.zeros(n), np.zeros(n, np.int64)
        for first, text, gram in coded(texts.cast(pa.large_binary()).to_pylist(), depth):
            pairs = np.sort(gram << _U(8) | text)  # the text's number stands under the gram
            grams, times = distinct_counts((pairs >> _U(8)).view(np.int64), ordered=True)
            logs = np.repeat(v[np.searchsorted(key, grams)], times)
            text = (pairs & _U(255)).astype(np.int64)
            last = int(text.max()) + 1
            score[first : first + last] += np.bincount(text, weights=logs)
            size[first : first + last] += np.bincount(text)
        cols = [b.column("_id"), pc.invert(b.column("_train")), pa.array(tokens), pa.array(seen), pa.array(np.full(n, total)), pa.array(base - tokens * log_total), pa.array(score), pa.array(size)]
        return pa.record_batch(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, key, v = None, [], None, None
        for rows in batches:  # of each chunk the keys come before the blocks
            for at, is_text, block in zip(rows.column("_chunk").to_pylist(), rows.column("_is_text").to_pylist(), rows.column("block"), strict=True):
                if at != chunk:
                    chunk, parts, key, v = at, [], None, None
                    release()
                if not is_text:
                    parts.append(_answered(block))
                    continue
                if parts:
                    key, parts = np.concatenate([p[0] for p in parts]), [p[1] for p in parts]
                    order = np.argsort(key)
                    key = key[order]
                    v, parts = np.concatenate(parts)[order], []
                    del order
                    release()
                for b, texts in _unpacked(block):
                    yield scored(b, texts, key, v)
        key = v = None
        release()

    return run


def score(docs: DataFrame, depth: int = DEPTH, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows whose crc32(id as text) mod ``folds`` is not ``held_out``; score all rows.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be from 1 to 6")
    scratch = Scratch(docs.sparkSession, "ctw")
    n_parts = partitions(docs.sparkSession)
    d = documents(docs, id_col, text_col)
    learn = F.pmod(F.crc32(F.coalesce(public_id("_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != held_out
    d = d.select("_id", "_text", learn.alias("_train"))
    size = d.agg(F.sum(F.octet_length("_text")).alias("b"), F.count_if(F.col("_train")).alias("ends")).first()
    chunks = max(1, math.ceil((size.b or 0) / CHUNK_BYTES))
    n_parts = max(n_parts, chunks)  # a partition has one chunk, or none
    blocks = scratch.write(d.mapInArrow(_packed(chunks), "_chunk int, block binary"), "blocks")
    vocabulary = blocks.repartitionById(n_parts, F.col("_chunk")).sortWithinPartitions("_chunk").mapInArrow(_vocabulary(depth), "_chunk int, key long, n long")
    vocabulary = scratch.write(vocabulary, "vocabulary")
    counts = scratch.write(vocabulary.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("key < 0")
    all_ = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    known = gram_logs(counts.where("key >= 0"), depth, scratch).unionByName(words.select("key", F.col("n").cast("double").alias("v")))
    answers = vocabulary.select("_chunk", "key").join(known, "key").select("_chunk", "key", "v").mapInArrow(_answers(), "_chunk int, block binary")
    both = answers.withColumn("_is_text", F.lit(False)).unionByName(blocks.withColumn("_is_text", F.lit(True)))
    both = both.repartitionById(n_parts, F.col("_chunk")).sortWithinPartitions("_chunk", "_is_text")
    out = both.mapInArrow(_scored(depth, (all_.n or 0) + size.ends, all_.v + (size.ends > 0), size.ends), _SCORED)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return out.select(public_id(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


def op10_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
