"""Two-level scans against one plain pass, with hot keys, ties, nulls and one row a chunk."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldhouse.operators import windows

SCHEMA = "k string, day date, i long, v double"


@pytest.fixture(scope="module", params=["hot", "one day", "sparse", "odd"])
def bets(request):
    r = random.Random(request.param)
    day = lambda n: datetime.date(2022, 1, 1) + datetime.timedelta(days=n)
    if request.param == "hot":
        return [("a" if i % 10 else "b", day(r.randrange(40)), i, round(r.uniform(-100, 95), 2)) for i in range(3000)]
    if request.param == "one day":
        return [("a", day(0), i, float(r.choice([-1, 1]))) for i in range(500)]
    if request.param == "sparse":
        return [(f"k{i % 7}", day(i), i, -5.0 if i % 3 else 12.0) for i in range(200)]
    return [(None, day(0), 1, 3.0), ("a", None, 2, -4.0), ("a", None, 3, 9.0), (None, None, 4, 1.0), ("a", day(1), 5, -2.0)]


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.date.min, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_bankroll_equals_one_pass(spark, bets):
    got = {r.i: r for r in windows.bankroll(spark.createDataFrame(bets, SCHEMA).repartition(4), 1000.0, "k", ["day", "i"], "v").collect()}
    assert len(got) == len(bets)
    for rows in groups(bets).values():
        balance = peak = 1000.0
        for _, _, i, v in rows:
            balance += v
            peak = max(peak, balance)
            assert math.isclose(got[i].balance, balance, abs_tol=1e-6) and math.isclose(got[i].peak, peak, abs_tol=1e-6)
            assert math.isclose(got[i].drawdown, (peak - balance) / peak, abs_tol=1e-9)


def test_ema_equals_one_pass(spark, bets):
    got = {r.k: r for r in windows.ema_rate(spark.createDataFrame(bets, SCHEMA).repartition(4), ["k"], "day", [F.desc("i")], "v", 7.0).collect()}
    for k, rows in groups(bets).items():
        rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.date.min, r[2]), reverse=True)
        w = [0.5 ** (n / 7) for n in range(len(rows))]
        assert got[k].n == len(rows) and math.isclose(got[k].ema, sum(a * r[3] for a, r in zip(w, rows)) / sum(w), rel_tol=1e-9, abs_tol=1e-9)


def test_ranks_equal_one_sort(spark, bets):
    d = windows.ranked(spark.createDataFrame(bets, SCHEMA).repartition(5), [F.desc("v"), F.asc("i")])
    want = {r[2]: n for n, r in enumerate(sorted(bets, key=lambda r: (-r[3], r[2])), 1)}
    assert {r.i: r["rank"] for r in d.collect()} == want


def test_no_window_over_a_bare_key(spark, bets):
    """The rows themselves are only sorted within (key, day); what is sorted by key alone has been added up first."""
    plan = windows.bankroll(spark.createDataFrame(bets, SCHEMA), 1000.0, "k", ["day", "i"], "v")._jdf.queryExecution().optimizedPlan().toString()
    bare = [line for line in plan.splitlines() if "windowspecdefinition(k#" in line and "windowspecdefinition(k#" in line.split(", day#")[0] and "_sum" not in line and "_base" not in line]
    assert all(", day#" in line.split("windowspecdefinition(", 1)[1].split("ASC")[0] for line in bare)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert windows.bankroll(none, 1.0, "k", ["day", "i"], "v").count() == 0
    assert windows.ranked(none, [F.desc("v")]).count() == 0
