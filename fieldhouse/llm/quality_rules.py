"""Quality rules with risk-controlled thresholds (operator 8).

Each text gets counts and, from them, rule values that are high for bad text. Labelled rows (quality 1 = good)
are the holdout: for every stratum and rule, each cutoff of a fixed grid would reject some of the good rows, and
the exact (Clopper-Pearson) upper bound of that share is taken at level ``delta`` divided by the number of
stratum-rule-cutoff tests (Bonferroni). The lowest cutoff whose bound is at most ``alpha`` divided by the number of
rules is used; where no cutoff can be guaranteed, the rule rejects nothing in that stratum. So with probability
1 - delta, in every stratum at most a share ``alpha`` of good documents is rejected by the rules.

Only counts by (stratum, rule, grid cell) leave the executors, and they cover all labelled rows.

Nulls, ties and odd rows: a null text has no words (base_failed); a null stratum is one of its own; an id with
several labels is good if any says so; null labels are ignored; repeated rows are judged each; other columns,
also ones named like the results, are ignored; empty tables give an empty result, and without labels no rule
beyond the base rejects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _SEP, Scratch, Words, filled, named, public_id, slices

#: rule -> grid of cutoffs, ascending; a text is rejected where its value is above the cutoff
GRIDS: dict[str, list[float]] = {
    "symbols_per_word": [0.02 * 1.15**i for i in range(48)],
    "dup_line_share": [i / 40 for i in range(1, 40)],
    "repeat_word_share": [i / 100 for i in range(1, 21)],
    "long_words": [6 + 0.25 * i for i in range(40)],
    "short_words": [-5 + 0.1 * i for i in range(45)],
}
ALPHA, DELTA = 0.05, 0.05
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _repeats(grams: np.ndarray, n: int, k: int) -> int:
    """Words inside k-word windows that occur twice or more among ``grams``."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    mark = np.zeros(n + 1, np.int64)
    at = order[again]
    mark[at] += 1
    np.subtract.at(mark, at + k, 1)
    return int((np.cumsum(mark[:n]) > 0).sum())


def counts_of(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each text."""
    w = Words(texts)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])[w.bound]
    chars = np.diff(total(((w.data & 0xC0) != 0x80) & ~_SEP[w.data]))
    symbols = np.diff(total(_SYMBOL[w.data]))
    grams, words = w.windows(5), np.diff(w.first)
    dup, lines, repeat = [], [], []
    for i, t in enumerate(texts.to_pylist()):
        full = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        lines.append(len(full))
        dup.append(len(full) - len(set(full)))
        a, z = w.first[i], w.first[i + 1]
        repeat.append(_repeats(grams[a : z - 4], int(z - a), 5) if z - a > 5 else 0)
    return [np.asarray(x, np.int64) for x in (words, chars, symbols, dup, repeat, lines)]


def counted(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """The rows with their counts, in further columns named ``prefix`` + count."""
    fields = [*docs.schema.fields, *(T.StructField(prefix + c, T.LongType()) for c in COUNTS)]
    schema = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            more = [pa.array(x) for x in counts_of(filled(b, text_col))]
            yield pa.record_batch([*(c.cast(f.type) for c, f in zip(b.columns, schema, strict=False)), *more], schema=schema)

    return docs.mapInArrow(run, T.StructType(fields))


def upper_bound(bad: int, n: int, level: float) -> float:
    """Exact upper bound, at confidence 1 - level, of a share of which ``bad`` of ``n`` were seen."""
    if n == 0 or bad >= n:
        return 1.0

    def tail(p: float) -> float:  # P(X <= bad), term by term in logs
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(bad + 1)]
        top = max(logs)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)

    lo, hi = bad / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid <= 0 or (mid < 1 and tail(mid) > level) else (lo, mid)
    return hi


def cutoffs(cells: list[tuple[str, str, int, int]], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff, from (stratum, rule, cell, good rows); cell i holds values above i cutoffs exactly."""
    strata = sorted({s for s, *_ in cells})
    tests = max(1, len(strata)) * sum(map(len, GRIDS.values()))
    out: dict[str, dict[str, float]] = {s: {} for s in strata}
    seen = {(s, rule): np.zeros(len(grid) + 1, np.int64) for s in strata for rule, grid in GRIDS.items()}
    for s, rule, cell, good in cells:
        seen[s, rule][cell] += good
    for s in strata:
        for rule, grid in GRIDS.items():
            by = seen[s, rule]
            n, above = int(by.sum()), by[::-1].cumsum()[::-1]
            for i, cut in enumerate(grid):
                if above[i + 1] <= alpha / len(GRIDS) * n and upper_bound(int(above[i + 1]), n, delta / tests) <= alpha / len(GRIDS):
                    out[s][rule] = cut
                    break
    return out


def _rules(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(prefix + name)
    n = F.greatest(c("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": c("n_symbols") / n,
        "dup_line_share": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)).cast("double"),
        "repeat_word_share": c("n_repeat_words") / n,
        "long_words": c("word_chars") / n,
        "short_words": -c("word_chars") / n,
    }


def _base_failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * F.col(prefix + "n_words"))


def _rejected_by(prefix: str = "") -> Column:
    by = F.array_compact(F.array(*(F.when(x > F.col("_cuts")[i], F.lit(r)) for i, (r, x) in enumerate(_rules(prefix).items()))))
    return F.coalesce(by, F.array().cast("array<string>"))


def thresholds(seen: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(_stratum, _cuts): the cutoffs of each stratum, from counted rows (_id, _stratum, counts) and the labels."""
    good = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("quality")).where("quality = 1").select("_id")
    held = seen.join(good, "_id", "left_semi")
    cell = lambda rule, x: F.size(F.filter(F.array(*map(F.lit, GRIDS[rule])), lambda c: x > c))
    long_ = held.select("_stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), cell(r, x).alias("cell")) for r, x in _rules().items()))).alias("x"))
    cells = long_.groupBy("_stratum", "x.rule", "x.cell").count().collect()  # strata x rules x cells
    found = cutoffs([(r["_stratum"], r["rule"], r["cell"], r["count"]) for r in cells], alpha, delta)
    rows = [(s, [found[s].get(r) for r in GRIDS]) for s in found] or [("", [None] * len(GRIDS))]
    return seen.sparkSession.createDataFrame(rows, "_stratum string, _cuts array<double>")


def _slim(docs: DataFrame, stratum: str, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), named(F.col(stratum)).alias("_stratum"), F.col(text_col).alias("_text"))
    return counted(d, "_text").drop("_text")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, the counts, base_failed, rejected_by (the rules that reject) and kept."""
    seen = Scratch(docs.sparkSession, "quality").write(_slim(docs, stratum, id_col, text_col), "counted")
    table = thresholds(seen, labels, alpha, delta)
    out = seen.join(F.broadcast(table), "_stratum", "left").withColumn("rejected_by", _rejected_by())
    return out.select(public_id(id_col), *COUNTS[:5], _base_failed().alias("base_failed"), (~_base_failed() & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, whole. Texts are read twice and never shuffled."""
    seen = Scratch(docs.sparkSession, "quality").write(_slim(docs, stratum, id_col, text_col), "counted")
    table = thresholds(seen, labels, alpha, delta)
    d = counted(docs, text_col, "_q_").withColumn("_stratum", named(F.col(stratum)))
    d = d.join(F.broadcast(table), "_stratum", "left")
    return d.where(~_base_failed("_q_") & (F.size(_rejected_by("_q_")) == 0)).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
