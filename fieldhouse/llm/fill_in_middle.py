"""Fill-in-the-middle examples cut at token boundaries (operator 12).

The places where a text may be cut (its beginning, its end, and wherever a word ends) are a set of byte offsets in
containers of 2**16 offsets, each in the smallest of three forms: sorted 16-bit array, bitmap, or runs. Cumulative
cardinalities stand over the containers, so the k-th boundary is one binary search for its container and one select
inside it; both cuts of a text come from two such selects. The set is filled one container at a time, so a long
text costs no more than one container of temporary arrays.

Forms: the sentinels ``<P>``, ``<S>`` and ``<M>`` stand before prefix, suffix and middle; a text that holds one of
them stays plain. As no text in another form holds a sentinel, splitting at the sentinels restores it.

Nulls, ties and odd rows: a null text is empty (n 0, plain); a null id counts as the empty string in the hash and is
carried as null; rows that repeat are cut alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SEP as SEPARATORS
from .common import documents, filled, public_id, schema_of, slices, small_batches

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
SPAN = 1 << 16
_SENTINEL = re.compile(b"<[PSM]>")
_U64 = np.uint64


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)
        self.n, self.nbytes = len(values), 2 * len(values)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """One bit for each value; counts of the bits before each word of 64."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.until = np.cumsum(np.bitwise_count(self.words).astype(np.int64))
        self.n, self.nbytes = int(self.until[-1]), SPAN // 8

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.until, k, "right"))
        left, word = k - (int(self.until[w - 1]) if w else 0), int(self.words[w])
        for _ in range(left):
            word &= word - 1
        return 64 * w + (word & -word).bit_length() - 1


class RunContainer:
    """Runs of consecutive values: first values and counts up to each run's end."""

    def __init__(self, values: np.ndarray):
        new = np.flatnonzero(np.diff(values) != 1) + 1
        self.first = values[np.concatenate([[0], new])].astype(np.uint16)
        self.until = np.append(new, len(values)).astype(np.int64)
        self.n, self.nbytes = len(values), 4 * len(self.first)

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.until, k, "right"))
        return int(self.first[r]) + k - (int(self.until[r - 1]) if r else 0)


def container(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form of some sorted values below 2**16, at least one."""
    runs = 1 + int(np.count_nonzero(np.diff(values) != 1))
    array, bitmap, run = 2 * len(values), SPAN // 8, 4 * runs
    if run < min(array, bitmap):
        return RunContainer(values)
    return ArrayContainer(values) if array <= bitmap else BitmapContainer(values)


class Offsets:
    """A growing sorted set of offsets: containers by their high bits, with cumulative cardinalities."""

    def __init__(self) -> None:
        self.high: list[int] = []
        self.parts: list[ArrayContainer | BitmapContainer | RunContainer] = []
        self.until: list[int] = []

    def add(self, high: int, low: np.ndarray) -> None:
        """The offsets ``high * 2**16 + low``; calls come in the order of ``high``."""
        if len(low):
            self.parts.append(container(low))
            self.high.append(high)
            self.until.append(len(self) + len(low))

    def __len__(self) -> int:
        return self.until[-1] if self.until else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        c = int(np.searchsorted(self.until, k, "right"))
        return self.high[c] * SPAN + self.parts[c].select(k - (self.until[c - 1] if c else 0))


def boundaries(data: np.ndarray) -> Offsets:
    """Where a text of these bytes may be cut: 0, its length, and every word's end before a separator."""
    out, size = Offsets(), len(data)
    for lo in range(0, size + 1, SPAN):
        hi = min(lo + SPAN, size)
        sep = SEPARATORS[data[max(lo - 1, 0) : hi]]
        at = np.flatnonzero(sep[1:] & ~sep[:-1]) + (lo == 0)
        first, last = [0] if lo == 0 else [], [size - lo] if 0 < size < lo + SPAN else []
        out.add(lo // SPAN, np.concatenate([first, at, last]).astype(np.int64))
    return out


def draws(seed: int, doc_id: int | None) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


_RESULT = "_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _chars(part: bytes) -> int:
    return len(part.decode())


def cut(text: bytes, data: np.ndarray, doc_id: int | None, seed: int, fim: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, output."""
    places = boundaries(data)
    n = len(places) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= fim or _SENTINEL.search(text):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places.select(a), places.select(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", _chars(prefix), _chars(middle), b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle
    return n, "psm", _chars(prefix), _chars(middle), b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle


def _transform(seed: int, fim: int, spm: int):
    schema = schema_of(_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            ids = b.column("_id").to_pylist()
            rows = []
            for i, t in zip(ids, filled(b, "_text").cast(pa.large_binary()), strict=True):
                text = t.as_py()
                rows.append(cut(text, np.frombuffer(text, np.uint8), None if i == -(2**63) else i, seed, fim, spm))
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.record_batch([b.column("_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], schema=schema)

    return run


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n, form, prefix_chars, middle_chars, output (the example itself)."""
    small_batches(docs.sparkSession)
    out = documents(docs, id_col, text_col).mapInArrow(_transform(seed, fim_percent, spm_percent), _RESULT)
    return out.select(public_id(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH cuts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), drawn AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
         ('0x' || h[1:8])::UBIGINT % (len(tokens) + 1) AS c1, ('0x' || h[9:16])::UBIGINT % (len(tokens) + 1) AS c2,
         ('0x' || h[17:24])::UBIGINT % 100 AS c3, ('0x' || h[25:32])::UBIGINT % 100 AS c4
  FROM cuts
), parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 50 THEN 'plain'
              WHEN c4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(tokens[1:least(c1, c2)], '') AS prefix,
         array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(tokens[greatest(c1, c2) + 1:n], '') AS suffix
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
