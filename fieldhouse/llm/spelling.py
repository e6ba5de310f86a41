"""Spelling variants by dynamic programming over a sorted vocabulary (operator 11).

1. Words and their counts: tasks count runs of letters, Spark adds the counts up.
2. The vocabulary is sorted twice, by the words and by the reversed words, in both cases by length first, and cut by
   ranges into blocks. One edit leaves the first or the last half of a word as it is, so each word looks for its near
   words among those that begin like it, and, reversed, among those that end like it.
3. A word goes to the blocks that may hold near words: a scan of the blocks' first words, which jumps over all blocks
   whose shared prefix is already more than one edit away.
4. In a block the scan goes down the sorted list letter by letter. Words that share a prefix (adjacent words' longest
   common prefixes say which) share one banded row of the edit matrix; a range whose row is above one edit is left.
   No pair is looked at for standing in the same group.
5. Each word takes its near word of largest count; roots come from doubling the steps along the forms.

A frequent prefix costs more blocks, not a larger one: blocks are bounded by the sort, and what reaches a block are
words within one edit of its shared prefix. The blocks' first words (at most 20,000, 200 letters each) go to the tasks.

Nulls, ties and odd rows: a null text has no words; a null id counts as the empty string in the hash; rows that
repeat count each; near words of equal count: the smallest by code points; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, filled, partitions, schema_of, slices

LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, DROP_ONE_IN, RATIO = 5, 3, 97, 2
#: entries of a task's count table after which it is handed on
TABLE = 300_000
#: words of a block, as long as there are at most ``BLOCKS`` blocks
BLOCK, BLOCKS, SHOWN = 10_000, 20_000, 200
#: words that go down a list together
TOGETHER = 20_000
_LAST, _FAR = "\U0010ffff", 9

# ---------------------------------------------------------------- words


def counted(text: bytes, doc_id: int | None, pattern: re.Pattern, drop_one_in: int) -> Iterator[tuple[str, int]]:
    """Runs of one text with counts; where ``drop_one_in`` divides the crc32 of ``<doc_id>:<run>``, a letter is left out."""
    low = text.lower().decode()  # bytes: A-Z alone
    runs = Counter(pattern.findall(low)) if len(low) < 1 << 20 else Counter(m.group() for m in pattern.finditer(low))
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), head)
        if drop_one_in and h % drop_one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


_COUNTS = "word string, n long"


def _count(letters: str, min_length: int, drop_one_in: int):
    schema = schema_of(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(f"[{letters}]{{{min_length},}}")
        table: Counter = Counter()
        out = lambda: pa.record_batch([pa.array(table.keys(), pa.string()), pa.array(table.values(), pa.int64())], schema=schema)
        for b in slices(batches, "_text"):
            for i, t in zip(b.column("_id").to_pylist(), filled(b, "_text").cast(pa.large_binary()), strict=True):
                for word, n in counted(t.as_py(), None if i == -(2**63) else i, pattern, drop_one_in):
                    table[word] += n
                if len(table) > TABLE:
                    yield out()
                    table.clear()
        if table:
            yield out()

    return run


def vocabulary(docs: DataFrame, letters: str = LETTERS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``min_length`` letters that occur at least ``min_count`` times.

    ``letters`` is what stands in the brackets of a regular expression, for texts whose A-Z are lower-cased.
    """
    words = documents(docs, id_col, text_col).mapInArrow(_count(letters, min_length, drop_one_in), _COUNTS)
    words = words.where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- which blocks a word goes to


def dead_at(q: str, prefix: str) -> int:
    """Letters of ``prefix`` after which it is more than one edit from every beginning of ``q``; 0 if it never is."""
    size = len(q)
    a, b, c = _FAR, 0, 1
    for d, x in enumerate(prefix):
        na = min(a + (d < 1 or d > size or x != q[d - 1]), b + 1) if d <= size else _FAR
        nb = min(b + (x != q[d]), c + 1, na + 1) if d < size else _FAR
        nc = min(c + (x != q[d + 1]), nb + 1) if d + 1 < size else _FAR
        a, b, c = na, nb, nc
        if min(a, b, c) > 1:
            return d + 1
    return 0


def common_prefix(a: str, b: str) -> str:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return a[:n]


class Directory:
    """First (direction, length, letters) of each block, letters cut at ``SHOWN``, in order."""

    def __init__(self, firsts: list[tuple[int, int, str]], blocks: list[int]):
        self.firsts, self.blocks = firsts, blocks
        self.shared = [common_prefix(x[2], y[2]) if x[:2] == y[:2] else "" for x, y in zip(firsts, firsts[1:], strict=False)] + [""]

    def route(self, direction: int, length: int, key: str, half: int) -> Iterator[int]:
        """Blocks of the list of ``length`` that may hold words near ``key`` that begin with its first ``half`` letters."""
        start = key[: min(half, SHOWN)]
        at = max(0, bisect_left(self.firsts, (direction, length, start)) - 1)
        end = bisect_right(self.firsts, (direction, length, start + _LAST))
        while at < end:
            if not (dead := dead_at(key, self.shared[at])):
                yield self.blocks[at]
                at += 1
            else:  # every block that begins with these letters is too far
                at = max(at + 1, bisect_left(self.firsts, (direction, length, self.shared[at][:dead] + _LAST)) - 1)


_ASK = "block int, asks int, direction int, size int, key string, n long"


def _asks(directory: Directory, min_length: int):
    schema = schema_of(_ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, directions, keys = [], [], []
            for word in b.column("word").to_pylist():
                for direction, key in enumerate((word, word[::-1])):
                    for length in range(max(min_length, len(word) - 1), len(word) + 2):
                        for block in directory.route(direction, length, key, len(word) // 2):
                            blocks.append(block)
                            directions.append(direction)
                            keys.append((key, length))
            rows = sorted({(x, y, k, n) for x, y, (k, n) in zip(blocks, directions, keys, strict=True)})
            if rows:
                x, y, k, n = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(x, pa.int32()), pa.array([1] * len(x), pa.int32()), pa.array(y, pa.int32()), pa.array(n, pa.int32()), pa.array(k), pa.array([0] * len(x), pa.int64())], schema=schema)

    return run


# ---------------------------------------------------------------- down the sorted list


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    size = len(words[0])
    return np.frombuffer("".join(words).encode("utf-32-be"), ">u4").reshape(len(words), size)


def shared_letters(keys: np.ndarray) -> np.ndarray:
    """For each row, the letters it shares with the row before; -1 for the first."""
    out = np.full(len(keys), -1, np.int64)
    if len(keys) > 1:
        same = keys[1:] == keys[:-1]
        out[1:] = np.where(same.all(1), keys.shape[1], (~same).argmax(1))
    return out


def _as_bytes(x: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(x)
    return x.view(f"S{4 * x.shape[1]}").ravel()


def near_pairs(keys: np.ndarray, lcp: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of ``queries``, of ``keys``) at exactly one edit whose first halves, of the query's length, are equal.

    ``keys`` are sorted and distinct, ``lcp`` is of ``shared_letters``. ``a``, ``b`` and ``c`` are the row of the edit
    matrix at depth d against the first d-1, d and d+1 letters of the query, one row for a whole range of the list.
    """
    n, size = keys.shape
    m, length = queries.shape
    half = length // 2
    starts = np.flatnonzero(lcp < half)
    heads, mine = _as_bytes(keys[starts, :half]), _as_bytes(queries[:, :half])
    at = np.minimum(np.searchsorted(heads, mine), len(heads) - 1)
    q = np.flatnonzero(heads[at] == mine)
    ends = np.append(starts[1:], n)
    lo, hi = starts[at[q]], ends[at[q]]
    a, b, c = np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
    padded = np.zeros((m, max(length, size) + 3), ">u4")  # no letter is 0
    padded[:, 1 : length + 1] = queries
    for d in range(half, size):
        starts = np.flatnonzero(lcp <= d)
        ends = np.append(starts[1:], n)
        first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        each = last - first
        up = np.repeat(np.arange(len(q)), each)
        child = np.repeat(first - np.cumsum(each) + each, each) + np.arange(len(up))
        q, lo, hi = q[up], starts[child], ends[child]
        x = keys[lo, d]
        na = np.minimum(a[up] + (x != padded[q, d]), b[up] + 1)
        nb = np.minimum(np.minimum(b[up] + (x != padded[q, d + 1]), c[up] + 1), na + 1) if d < length else np.full(len(q), _FAR)
        nc = np.minimum(c[up] + (x != padded[q, d + 2]), nb + 1) if d + 1 < length else np.full(len(q), _FAR)
        keep = np.minimum(np.minimum(na, nb), nc) <= 1
        q, lo, hi, a, b, c = q[keep], lo[keep], hi[keep], na[keep].astype(np.int8), nb[keep].astype(np.int8), nc[keep].astype(np.int8)
    found = {-1: a, 0: b, 1: c}[length - size] == 1
    return q[found], lo[found]


_NEAR = "word string, n_near long, near_n long, near string"


def _search():
    schema = schema_of(_NEAR)

    def answers(words: list[str], counts: np.ndarray, direction: int, asking: list[str]) -> Iterator[pa.RecordBatch]:
        keys = letters_of(words)
        lcp = shared_letters(keys)
        names = [w[::-1] for w in words] if direction else words
        rank = np.argsort(np.argsort(np.array(names, dtype=object))) if direction else np.arange(len(words))
        for length in sorted({len(w) for w in asking}):
            of = [w for w in asking if len(w) == length]
            queries = letters_of(of)
            q, w = near_pairs(keys, lcp, queries)
            if direction:  # the list in forward order has found these already
                half = length // 2
                new = (queries[q, length - half :] != keys[w, keys.shape[1] - half :]).any(1)
                q, w = q[new], w[new]
            order = np.lexsort((rank[w], -counts[w], q))
            q, w = q[order], w[order]
            head = np.flatnonzero(np.diff(q, prepend=-1))
            yield pa.record_batch(
                [
                    pa.array([of[i][::-1] if direction else of[i] for i in q[head]], pa.string()),
                    pa.array(np.diff(np.append(head, len(q))), pa.int64()),
                    pa.array(counts[w[head]], pa.int64()),
                    pa.array([names[i] for i in w[head]], pa.string()),
                ],
                schema=schema,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, direction and length of list, the words of the list before those that ask."""
        words: list[str] = []
        counts: list[int] = []
        asking: list[str] = []
        now: tuple | None = None

        def ask() -> Iterator[pa.RecordBatch]:
            if words and asking:
                yield from answers(words, np.array(counts, np.int64), now[1], asking)
            asking.clear()

        for b in batches:
            for block, asks, direction, size, key, n in zip(*(b.column(c).to_pylist() for c in ("block", "asks", "direction", "size", "key", "n")), strict=True):
                if (block, direction, size) != now:
                    yield from ask()
                    words.clear()
                    counts.clear()
                    now = (block, direction, size)
                if asks:
                    asking.append(key)
                    if len(asking) >= TOGETHER:
                        yield from ask()
                else:
                    words.append(key)
                    counts.append(n)
        yield from ask()

    return run


def near_words(vocab: DataFrame, scratch: Scratch, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n_near, near_n, near) for the words of ``vocab`` (word, n) that have near words: how many, and the one of largest n."""
    spark = vocab.sparkSession
    both = vocab.select(F.posexplode(F.array("word", F.reverse("word"))).alias("direction", "key"), F.length("word").alias("size"), "n")
    n_blocks = min(BLOCKS, 2 * vocab.count() // BLOCK + 1)
    lists = both.repartitionByRange(n_blocks, "direction", "size", "key").select(F.spark_partition_id().alias("block"), F.lit(0).alias("asks"), "direction", "size", "key", "n")
    lists = scratch.write(lists, "lists")
    heads = lists.groupBy("block").agg(F.min(F.struct("direction", "size", "key")).alias("s")).select("block", "s.direction", "s.size", F.substring("s.key", 1, SHOWN).alias("key"))
    firsts = sorted((r.direction, r.size, r.key, r.block) for r in heads.collect())  # a row for each block
    directory = Directory([f[:3] for f in firsts], [f[3] for f in firsts])
    asks = vocab.select("word").mapInArrow(_asks(directory, min_length), _ASK)
    rows = lists.select(*asks.columns).unionByName(asks)
    rows = rows.repartition(partitions(spark), "block").sortWithinPartitions("block", "direction", "size", "asks", "key")
    found = rows.mapInArrow(_search(), _NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("near_n"), "best.near")


# ---------------------------------------------------------------- forms and roots


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for (word, form) without circles: each round doubles the steps that every word has gone."""
    steps = scratch.write(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.write(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = further.select("word", "root")
        if further.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, letters: str = LETTERS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocab = scratch.write(vocabulary(docs, letters, min_length, min_count, drop_one_in, id_col, text_col), "vocabulary")
    near = scratch.write(near_words(vocab, scratch, min_length), "near")
    good = F.col("near_n") >= ratio * F.col("n")
    words = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n"))
    words = scratch.write(words, "words")
    known = roots(words.where("form is not null"), scratch)
    return words.join(known, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: the reflected polynomial 0xEDB88320, four bits at a time
_CRC = []
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 * (_c & 1))
    _CRC.append(_c)

OP11_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]{{5,}}')) AS run
  FROM documents
), per_doc AS (
  SELECT run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, c, xor(list_reduce(list_transform(range(len(hx)), lambda i: ('0x' || hx[xor(i, 1) + 1])::BIGINT),
                                 lambda a, x: xor(a >> 4, {_CRC}[(xor(a, x) & 15) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM per_doc
), vocab AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, c FROM hashed)
  WHERE len(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS MATERIALIZED (
  SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM vocab)
), pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN vocab b ON a.rest = b.word
), best AS (
  SELECT p.word, count(*) AS n_near, min(struct_pack(m := -v.n, w := p.near)) AS s FROM pairs p JOIN vocab v ON v.word = p.near GROUP BY p.word
), forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.s.m >= 2 * v.n THEN b.s.w END AS form, CASE WHEN -b.s.m >= 2 * v.n THEN -b.s.m END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word
), walk AS (
  SELECT word, word AS here, 0 AS steps FROM forms
  UNION ALL SELECT w.word, f.form, w.steps + 1 FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n::BIGINT AS form_n, r.root
FROM forms f JOIN (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word) r ON r.word = f.word
"""
