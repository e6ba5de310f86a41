"""Markets of all games: maps stay where they are made, and odd quotes are priced as before."""

import datetime

from fieldhouse.operators import betting as B
from fieldhouse.plans import registry

DAY = datetime.date(2024, 5, 1)
P = "game_id long, sport string, date date, probs map<string,double>, predicted_margin double, predicted_total double, confidence double"
Q = "game_id long, bookmaker long, prices map<string,double>, lines map<string,double>"


def test_no_map_is_shuffled_or_written(spark, sf):
    d = registry.queries()["j4_all_markets"](spark, sf)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    parts = d._jdf.queryExecution().explainString(mode).split("\n\n")
    dealt = [p for p in parts if ") Exchange" in p]
    assert dealt and not any(name in p for p in dealt for name in ("prices#", "probs#", "_picks#", "place#"))
    assert not any("predictions-" in f or "quotes-" in f for f in d.inputFiles())


def test_prices_over_several_rows_of_a_book(spark):
    """The first key with a price counts over all rows of a book, and the best price over the books."""
    p = spark.createDataFrame([(1, "a", DAY, {"ot_prob": 0.8, "btts_prob": 0.6}, None, None, None)], P)
    q = [(1, 5, {"overtime_odds": 9.0}, None), (1, 5, {"ot_odds": 2.0}, None), (1, 6, {"ot_odds": 2.0, "btts_yes_odds": 1.0, "btts_odds": 2.5}, {}), (1, 7, None, {}), (None, 8, {"ot_odds": 4.0}, {}), (2, 8, {"ot_odds": 4.0}, {})]
    got = sorted((r.market, r.selection, r.bookmaker, r.price) for r in B.candidates(p, spark.createDataFrame(q, Q)).collect())
    assert got == [("btts", "yes", 6, 2.5), ("overtime", "overtime", 5, 2.0)]


def test_bets_of_odd_tables_in_one_stage(spark):
    """Books without an id, rows of a game far from each other, equal prices, games of many books and of none; quotes meet without a sort of their maps."""
    import random

    r = random.Random(4)
    games = range(40)
    p = [(g, "a", DAY if g % 5 else None, {"btts_prob": round(r.uniform(0.3, 0.9), 3), "ot_prob": 0.7, "none": 1.0}, None if g % 3 else float(r.randrange(-9, 9)), 150.0, 0.6) for g in games]
    q = [(g, r.choice([None, *range(6)]), {"btts_yes_odds": r.choice([1.0, 1.9, 2.4]), "btts_no_odds": r.choice([None, 2.4, 3.0]), "btts_odds": 2.2, "overtime_odds": 2.0, "total_over": 2.1, "total_under": 2.1, "spread_home": 2.5, "spread_away": 2.5}, {"total_line": r.choice([140.0, 149.8, 160.0]), "spread_home": float(r.randrange(-5, 5))}) for g in games if g % 7 for _ in range(g)]
    r.shuffle(q)
    want = {}
    for g, _, _, probs, margin, total, confidence in p:
        for market, rows in (("btts", None), ("overtime", None), ("total", None), ("spread", None)):
            books = {}
            for _, book, prices, lines in (x for x in q if x[0] == g):
                if market == "btts":
                    yes = probs["btts_prob"] >= 1 - probs["btts_prob"]
                    chance, keys, line = max(probs["btts_prob"], 1 - probs["btts_prob"]), ("btts_yes_odds" if yes else "btts_no_odds", "btts_odds"), None
                elif market == "overtime":
                    chance, keys, line = 0.7, ("ot_odds", "overtime_odds"), None
                elif market == "total":
                    gap = total - lines["total_line"]
                    chance, keys, line = min(0.95, 0.5 + abs(gap) / (lines["total_line"] * 0.1 + 5), confidence + 0.1), ("total_over" if gap > 0 else "total_under",) if abs(gap) >= 0.5 else (), lines["total_line"]
                else:
                    c = 0.05 if margin is None else min(max(0.5 + 0.03 * (margin + lines["spread_home"]), 0.05), 0.95)
                    chance, keys, line = max(c, 1 - c), ("spread_home" if c > 0.5 else "spread_away",) if c != 0.5 else (), lines["spread_home"] if c > 0.5 else -lines["spread_home"]
                for nth, k in enumerate(keys):
                    if (prices.get(k) or 0) > 1:
                        by = round(chance * prices[k], 9) if market in ("total", "spread") else prices[k]
                        books.setdefault(book, []).append((nth, -by, chance, prices[k], line))
                        break
            best = sorted((min(x)[1], b is None, b or 0, *min(x)[2:4]) for b, x in books.items())
            if best and best[0][3] >= 0.52 and best[0][3] - 1 / best[0][4] >= 0.02:
                want[g, market] = (None if best[0][1] else best[0][2], round(best[0][3], 9), best[0][4])
    d = B.candidates(spark.createDataFrame(p, P).repartition(3), spark.createDataFrame(q, Q).repartition(5))
    got = {(x.game_id, x.market): (x.bookmaker, round(x.prob, 9), x.price) for x in d.collect()}
    assert got == want and len(got) > 60
    lines = d._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in lines
