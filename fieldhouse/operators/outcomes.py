"""What happened in a game, market by market: labels to train on and the backtest of predicted probabilities.

Games have home_score and away_score, home_q1 .. home_q4 and home_ot (null without overtime), the same for away, and the
lines total_line, home_line and away_line. A market is null where its columns are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(dominant: float | Column = 4.0) -> dict[str, Column]:
    """Every yes-or-no market, as a boolean; ``dominant`` is the margin of a dominant win."""
    h, a, line = F.col("home_score"), F.col("away_score"), lambda n: F.col(f"{n}_line")
    q = lambda side, *ns: sum((F.col(f"{side}_q{n}") for n in ns[1:]), F.col(f"{side}_q{ns[0]}"))
    half_h, half_a = q("home", 1, 2), q("away", 1, 2)
    late_h, late_a = F.coalesce(q("home", 3, 4), q("home", 2)), F.coalesce(q("away", 3, 4), q("away", 2))
    over = F.col("home_ot").isNotNull() & F.col("away_ot").isNotNull()
    reg_h, reg_a = (F.when(over & (h != a), s - F.col(c)).otherwise(s) for s, c in ((h, "home_ot"), (a, "away_ot")))
    both = lambda up, lo: (q(up, 1) > q(lo, 1)) & (q(up, 2) > q(lo, 2))
    best = F.greatest(h, a)
    return {
        "winner": h > a, "draw": h == a, "overtime": over, "first_period_home": q("home", 1) > q("away", 1), "halftime_home": half_h > half_a, "second_half_home": late_h > late_a,
        "regulation_home": reg_h > reg_a, "regulation_draw": reg_h == reg_a, "both_score": (h > 0) & (a > 0), "clean_sheet_home": a == 0, "clean_sheet_away": h == 0,
        "straight_sets": ((h > a) & both("home", "away")) | ((h <= a) & both("away", "home")), "dominant_win": F.abs(h - a) >= dominant,
        "total_over": h + a > line("total"), "home_total_over": h > line("home"), "away_total_over": a > line("away"),
        "comeback_home": F.when(half_h < half_a, h > a), "comeback_away": F.when(half_a < half_h, a > h),
        "clean_sweep": F.least(h, a) == 0, "maps_over_2": h + a > 2, "decider_map": (best > 0) & (h + a == 2 * best - 1), "home_sweep": (h > a) & (a == 0), "away_sweep": (a > h) & (h == 0),
    }


def total_band(low: float, high: float) -> Column:
    """low, mid or high, by the total of the scores."""
    s = F.col("home_score") + F.col("away_score")
    return F.when(s <= low, "low").when(s <= high, "mid").when(s > high, "high")


def labels(games: DataFrame, dominant: float = 4.0, low: float = 5.0, high: float = 8.0) -> DataFrame:
    """0/1 labels of all markets of final games, the band of the total, and the margin's side of its median over all of them."""
    d = games.where("home_score IS NOT NULL AND away_score IS NOT NULL")
    margin = F.abs(F.col("home_score") - F.col("away_score"))
    median = F.broadcast(d.agg(F.median(margin).alias("_m")))  # one row
    flags = (c.cast("int").alias(name) for name, c in outcomes(dominant).items())
    return d.join(median).select("game_id", *flags, total_band(low, high).alias("total_band"), F.when(margin <= F.col("_m"), "close").otherwise("wide").alias("margin_band"))


def report(records: DataFrame, markets: str = "markets", dominant: float = 4.0, low: float = 5.0, high: float = 8.0, least_draw: float = 0.28) -> DataFrame:
    """Accuracy, base rate and Brier score of every market with a predicted probability: one unpivot, one aggregation.

    ``markets`` is a map from market to probability. A market is called from one half on; a draw in regulation only where it
    is likelier than both wins and above ``least_draw``; of the bands total_low, total_mid and total_high the likeliest.
    """
    p = lambda name: F.col(markets)[name]
    home = p("regulation_home")
    calls = {"regulation_draw": (p("regulation_draw") > home) & (p("regulation_draw") > 1 - home) & (p("regulation_draw") > least_draw)}
    rows = [F.struct(F.lit(name).alias("bet_type"), (calls.get(name, p(name) >= 0.5) == c).alias("hit"), c.alias("happened"), p(name).alias("prob")) for name, c in outcomes(dominant).items()]
    bands = [p(f"total_{b}") for b in ("low", "mid", "high")]
    top = F.greatest(*bands)
    called = F.when(bands[0] == top, "low").when(bands[1] == top, "mid").otherwise("high")
    hit = F.when(bands[0].isNotNull() & bands[1].isNotNull() & bands[2].isNotNull(), called == total_band(low, high))
    rows.append(F.struct(F.lit("total_band").alias("bet_type"), hit.alias("hit"), F.lit(None).cast("boolean").alias("happened"), F.lit(None).cast("double").alias("prob")))
    d = records.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("hit IS NOT NULL")
    y = F.col("happened").cast("double")
    return d.groupBy("bet_type").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"), F.avg(y).alias("base_rate"), F.avg(F.pow(F.col("prob") - y, F.lit(2.0))).alias("brier"))
