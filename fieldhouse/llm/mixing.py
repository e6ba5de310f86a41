"""Mixing sources to target weights by Pfair scheduling (operator 6).

Each source's documents, in an order of hashes, form blocks of ``block_bytes``. One period has ``slots`` slots, of
which source s gets e(s), its weight in whole slots. Its i-th block of a period is released at floor((i-1)*slots/e)
and due at ceil(i*slots/e); each slot takes the released block that is due first. After every slot each source
then lags its share by less than one block. Periods repeat until a source has no whole period left, then run slot
by slot until it is used up; the others share its weight from there on, so every document is placed.

The driver makes one period for each set of sources still there, at most (sources x slots) entries; documents find
their slot by a join of that plan with the running size of their source, which needs no single task for a source.

Nulls, ties and odd rows: a null source is a source of its own; null and empty texts weigh one byte; weights that
are missing, zero or negative count as the smallest share (one slot); repeated rows are placed each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, named, named_key, public_id, running, unnamed

BLOCK_BYTES, SLOTS = 1 << 16, 1000


def shares(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Whole slots of a period, at least one each, by largest remainder."""
    total = sum(weights.values())
    free = slots - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - 1 - exact[s], s))[: slots - sum(out.values())]:
        out[s] += 1
    return out


def period(e: dict[str, int], slots: int) -> dict[str, list[int]]:
    """source -> slots of its blocks in one period, earliest deadline first among released blocks."""
    out: dict[str, list[int]] = {s: [] for s in e}
    coming = [(0, s, 1) for s in sorted(e)]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    for t in range(slots):
        while coming and coming[0][0] <= t:
            _, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-i * slots // e[s]), s, i))
        if not ready:
            continue
        _, s, i = heapq.heappop(ready)
        out[s].append(t)
        if i < e[s]:
            heapq.heappush(coming, (i * slots // e[s], s, i + 1))
    return out


def plan(blocks: dict[str, int], weights: dict[str, float], slots: int) -> list[tuple[str, int, int, int, int, list[int]]]:
    """Steps (source, first block, blocks, first slot, slots a period, places in the period)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, start, steps = dict.fromkeys(left, 0), 0, []
    least = min((w for w in weights.values() if w and w > 0), default=1.0)
    while left:
        # a period never needs more slots than are left
        now = min(max(slots, 2 * len(left)), max(sum(left.values()), len(left)))
        e = shares({s: w if (w := weights.get(s) or 0) > 0 else least / slots for s in left}, now)
        places = period(e, now)
        whole = min(left[s] // e[s] for s in left)
        take = {s: whole * e[s] for s in left}
        length = whole * now
        if not any(left[s] == take[s] for s in left):  # part of a period, until a source is used up
            end = min(places[s][left[s] - take[s] - 1] for s in left if left[s] - take[s] <= e[s]) + 1
            part = {s: sum(p < end for p in places[s]) for s in left}
            take = {s: take[s] + part[s] for s in left}
            length += end
        for s in left:
            if take[s]:
                steps.append((s, done[s], take[s], start, now, places[s]))
            done[s] += take[s]
        start += length
        left = {s: left[s] - take[s] for s in left if left[s] > take[s]}
    return steps


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: bool = False) -> DataFrame:
    """Per row: id_col, source, block, slot, place (bytes of its source before it). Order by slot, then place.

    ``weights`` (source, None for the null one, to its weight) default to the square roots of the sources' sizes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    d = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text_col).alias("_th"),
        named(F.col(source_col)).alias("source"), F.greatest(F.coalesce(F.octet_length(text_col), F.lit(0)), F.lit(1)).cast("long").alias("_size"),
    )
    d = scratch.write(d, "sizes")
    totals = {r.source: r.n for r in d.groupBy("source").agg(F.sum("_size").alias("n")).collect()}  # a row for each source
    placed = running(d, "source", [F.xxhash64("_id", "_th"), F.col("_id"), F.col("_th")], F.col("_size"), max(16, -(-max(totals.values(), default=1) // (1 << 30))), "place")
    placed = placed.withColumn("block", F.floor(F.col("place") / block_bytes).cast("long"))
    steps = plan({s: (n - 1) // block_bytes + 1 for s, n in totals.items()}, {named_key(s): w for s, w in weights.items()} if weights else {s: math.sqrt(n) for s, n in totals.items()}, slots)
    table = spark.createDataFrame(steps or [("", 0, 0, 0, 1, [0])], "s string, first long, n long, start long, slots long, places array<long>")
    table = table.groupBy("s").agg(F.collect_list(F.struct("first", "n", "start", "slots", "places")).alias("steps"))
    out = placed.join(F.broadcast(table), F.col("source") == F.col("s"))  # at most sources x slots entries
    step = F.filter("steps", lambda x: (x["first"] <= F.col("block")) & (F.col("block") < x["first"] + x["n"]))[0]
    out = out.withColumn("_x", step).withColumn("_i", F.col("block") - F.col("_x.first"))
    each = F.size("_x.places")
    slot = F.col("_x.start") + F.floor(F.col("_i") / each) * F.col("_x.slots") + F.get(F.col("_x.places"), (F.col("_i") % each).cast("int"))
    return out.select(public_id(id_col), unnamed("source").alias("source"), "block", slot.cast("long").alias("slot"), "place", *(["_id", "_th"] if keys else []))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
