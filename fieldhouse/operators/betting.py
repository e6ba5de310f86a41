"""All markets as data: candidates from probabilities and quotes, legs graded by what happened, the best parlays of a day.

A market is rows of ``SELECTIONS``; candidates are the likeliest sides of a prediction, priced by each quote of its game and judged by
one expression. A leg kind is a number of the game (or of a player) and a rule that says when it wins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import decimal_to_implied, expected_value, kelly
from .outcomes import outcomes, total_band

# ---------------------------------------------------------------- markets


@dataclass(frozen=True)
class Selection:
    """One side of a market: key of its probability (with "!" its complement), keys of its price in the quotes, the
    probability that it must be above to be looked at, and the key of its line."""

    market: str
    selection: str
    prob: str
    prices: tuple[str, ...]
    above: float = 0.0
    line: str | None = None


def _two(market: str, prob: str, prices: tuple[str, str], more: tuple[str, ...] = (), names: tuple[str, str] = ("home", "away"), above: float = 0.0, line: str | None = None) -> list[Selection]:
    return [Selection(market, n, k, (p, *more), above, line) for n, k, p in zip(names, (prob, f"!{prob}"), prices, strict=True)]


def _one(market: str, selection: str, prob: str, prices: tuple[str, ...], above: float) -> Selection:
    return Selection(market, selection, prob, prices, above)


#: fixed values: the markets, names of probabilities and prices, and least probabilities
SELECTIONS: tuple[Selection, ...] = (
    Selection("winner", "home", "home_win_prob", ("h2h_home",)), Selection("winner", "away", "away_win_prob", ("h2h_away",)),
    _one("draw", "draw", "draw_prob", ("h2h_draw", "draw_odds"), 0.01),
    _one("overtime", "overtime", "ot_prob", ("ot_odds", "overtime_odds"), 0.05),
    Selection("halftime_winner", "home", "halftime_home_win_prob", ("h1_home_odds", "halftime_winner_odds")), Selection("halftime_winner", "away", "halftime_away_win_prob", ("h1_away_odds", "halftime_winner_odds")),
    _one("esports_clean_sweep", "clean_sweep", "esports_clean_sweep_prob", ("clean_sweep_odds", "2_0_odds"), 0.0),
    *_two("esports_map_total", "esports_map_over_prob", ("map_over_odds", "map_under_odds"), names=("over", "under"), line="map_total_line"),
    _one("esports_decider_map", "decider_map", "esports_decider_map_prob", ("decider_map_odds",), 0.0),
    _one("esports_dominant_win", "dominant_win", "esports_dominant_win_prob", ("dominant_win_odds",), 0.0),
    *_two("btts", "btts_prob", ("btts_yes_odds", "btts_no_odds"), ("btts_odds",), ("yes", "no")),
    _one("clean_sheet_home", "home", "home_clean_sheet_prob", ("home_clean_sheet_odds",), 0.1), _one("clean_sheet_away", "away", "away_clean_sheet_prob", ("away_clean_sheet_odds",), 0.1),
    *_two("first_score", "first_score_home_prob", ("first_score_home_odds", "first_score_away_odds"), ("first_score_odds",)),
    *_two("last_score", "last_score_home_prob", ("last_score_home_odds", "last_score_away_odds"), ("last_score_odds",)),
    *_two("second_half_winner", "second_half_home_win_prob", ("second_half_home_odds", "second_half_away_odds"), ("second_half_winner_odds",)),
    *(Selection("regulation_result", s, f"regulation_{s}{'_win' if s != 'draw' else ''}_prob", (f"regulation_{s}_odds",)) for s in ("home", "draw", "away")),
    _one("comeback_home", "home", "comeback_home_prob", ("comeback_home_odds", "comeback_odds"), 0.15), _one("comeback_away", "away", "comeback_away_prob", ("comeback_away_odds", "comeback_odds"), 0.15),
    *(Selection("margin_band", b, f"margin_{b}_prob", (f"margin_{b}_odds", "margin_band_odds")) for b in ("close", "wide")),
    _one("large_margin", "dominant_win", "large_margin_prob", ("large_margin_odds", "dominant_win_odds"), 0.1),
    *(Selection("total_band", b, f"total_{b}_prob", (f"total_{b}_odds", "total_band_odds")) for b in ("low", "mid", "high")),
    *(s for q in range(1, 5) for s in _two(f"q{q}_winner", f"q{q}_home_win_prob", (f"q{q}_home_odds", f"q{q}_away_odds"))),
    *(s for q in range(1, 5) for s in _two(f"q{q}_total", f"q{q}_over_prob", (f"q{q}_over_odds", f"q{q}_under_odds"), names=("over", "under"), line=f"q{q}_line")),
    _one("method_ko", "ko_tko", "ko_tko_prob", ("ko_tko_odds",), 0.1), _one("method_submission", "submission", "submission_prob", ("submission_odds",), 0.1), _one("method_decision", "decision", "decision_prob", ("decision_odds",), 0.1),
    _one("straight_sets", "straight_sets", "straight_sets_prob", ("straight_sets_odds", "clean_sweep_odds"), 0.1),
    *_two("race_to_points", "race_to_20_prob", ("race_to_20_home_odds", "race_to_20_away_odds"), ("race_to_20_odds",), above=0.1),
    _one("exact_goals_band", "0_to_1", "goals_0_1_prob", ("goals_0_1_odds", "exact_goals_0_1_odds"), 0.2),
    _one("anytime_td_scorer", "home", "home_anytime_td_prob", ("anytime_td_scorer_odds", "td_scorer_odds"), 0.3),
    *_two("first_5_innings_winner", "first_5_innings_winner_prob", ("first_5_innings_home_odds", "first_5_innings_away_odds"), ("first_5_winner_odds",), above=0.1),
    *_two("first_period_total", "first_period_over_prob", ("first_period_total_over_odds", "first_period_total_under_odds"), names=("over", "under"), line="first_period_total_line"),
)
#: fixed values: tiers, best first, by least confidence and edge
TIERS = (("S", 0.75, 0.10), ("A", 0.65, 0.07), ("B", 0.60, 0.05), ("C", 0.55, 0.03))


def _dense(maps: pa.MapArray, keys: list[str]) -> np.ndarray:
    """A row a map with the values of the keys; none is nan."""
    offsets = maps.offsets.to_numpy()
    part = slice(offsets[0], offsets[-1])
    at = pc.fill_null(pc.index_in(maps.keys[part], value_set=pa.array(keys)), -1).to_numpy()
    row, known = np.repeat(np.arange(len(maps)), np.diff(offsets)), at >= 0
    out = np.full((len(maps), len(keys)), np.nan)
    out[row[known], at[known]] = maps.items[part].to_numpy(zero_copy_only=False)[known]
    return out


def picks(probs: pa.MapArray, least: float, selections: tuple[Selection, ...] = SELECTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (row, place, prob) of each market's likeliest side by the rows' maps of probabilities, ties by order.

    Sides without a probability, or not above their least, are not looked at, and picks under ``least`` are left out.
    """
    keys = list(dict.fromkeys(s.prob.lstrip("!") for s in selections))
    p = _dense(probs, keys)[:, [keys.index(s.prob.lstrip("!")) for s in selections]]
    p = np.where([s.prob.startswith("!") for s in selections], 1 - p, p)
    with np.errstate(invalid="ignore"):
        p = np.where(p > [s.above for s in selections], p, -np.inf)
    found = []
    for m in dict.fromkeys(s.market for s in selections):
        places = np.array([i for i, s in enumerate(selections) if s.market == m])
        best = places[np.argmax(p[:, places], axis=1)]
        prob = p[np.arange(len(p)), best]
        row = np.flatnonzero((prob > -np.inf) & (prob >= least))
        found.append((row, best[row], prob[row]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def offered(quotes: pa.StructArray, least: float, selections: tuple[Selection, ...] = SELECTIONS) -> tuple[np.ndarray, ...]:
    """Arrays (quote, place, prob, nth, price, line) of the offers of a batch's quotes: of each pick the first of its keys that has a price,
    and spread and total at the book's line on the side that the predicted margin or total is on, with the places from n on.
    Prices of 1 or less are none.

    A total's chance is a half plus the gap over a tenth of the line and 5, at most 0.95 and a tenth above the confidence; a gap
    under 0.5 is no bet. A spread's is a half plus 0.03 a point, in [0.05, 0.95].
    """
    n, most = len(selections), max(len(s.prices) for s in selections)
    prices = list(dict.fromkeys([*(k for s in selections for k in s.prices), "total_over", "total_under", "spread_home", "spread_away"]))
    lines = list(dict.fromkeys(["total_line", "spread_home", *(s.line for s in selections if s.line)]))
    price_at = np.array([[prices.index(s.prices[i]) if i < len(s.prices) else -1 for i in range(most)] for s in selections])
    line_at = np.array([lines.index(s.line) if s.line else -1 for s in selections])
    book, line = _dense(quotes.field("prices"), prices), _dense(quotes.field("lines"), lines)
    margin, total, confidence = (quotes.field(c).to_numpy(zero_copy_only=False) for c in ("predicted_margin", "predicted_total", "confidence"))
    rows, (row, place, prob) = np.arange(len(quotes)), picks(quotes.field("probs"), least, selections)
    price, nth = np.full(len(row), np.nan), np.zeros(len(row), int)
    for i in reversed(range(most)):
        k = price_at[place, i]
        v = np.where(k >= 0, book[row, k], np.nan)
        price, nth = np.where(v > 1, v, price), np.where(v > 1, i, nth)
    k = line_at[place]
    found = [(row, place, prob, nth, price, np.where(k >= 0, line[row, k], np.nan))]
    at = lambda key: book[:, prices.index(key)]
    with np.errstate(invalid="ignore", divide="ignore"):
        mark, home = line[:, lines.index("total_line")], line[:, lines.index("spread_home")]
        gap = total - mark
        chance = np.fmin(np.fmin(0.95, 0.5 + np.abs(gap) / (mark * 0.1 + 5)), confidence + 0.10)
        found.append((rows, np.where(gap > 0, n, n + 1), chance, 0 * rows, np.where(np.abs(gap) >= 0.5, np.where(gap > 0, at("total_over"), at("total_under")), np.nan), mark))
        cover = np.fmin(np.fmax(0.5 + 0.03 * (margin + home), 0.05), 0.95)
        up = cover > 0.5
        found.append((rows, np.where(up, n + 2, n + 3), np.where(up, cover, 1 - cover), 0 * rows, np.where(cover != 0.5, np.where(up, at("spread_home"), at("spread_away")), np.nan), np.where(up, home, -home)))
    row, place, prob, nth, price, line = (np.concatenate(x) for x in zip(*found, strict=True))
    some = price > 1
    return row[some], place[some], prob[some], nth[some], price[some], line[some]


def taken(kind: str, least: float, selections: tuple[Selection, ...] = SELECTIONS) -> Callable[..., Column]:
    """Of a game's quotes, an array of (bookmaker, prices, lines, predictions), each market's bet: of a book the first offer by key and
    best, over the books that of the best price, of spread and total of the best value; ties by the smallest book."""
    n, markets = len(selections), list(dict.fromkeys(s.market for s in selections))
    market = np.array([*(markets.index(s.market) for s in selections), *[len(markets)] * 2, *[len(markets) + 1] * 2])

    def best(quotes: pa.Array) -> pa.Array:
        books = quotes.flatten()
        game, id_ = np.repeat(np.arange(len(quotes)), np.diff(quotes.offsets.to_numpy())), books.field("bookmaker")
        of, place, prob, nth, price, line = offered(books, least, selections)
        # an offer is judged by its price, a spread or total by its value
        by, chance = np.where(place >= n, np.round(prob * price, 9), price), np.where(place >= n, 0.0, prob)
        offers = np.full((len(books), len(markets) + 2), -1)  # the quotes' offers of each market, by their numbers
        offers[of, market[place]] = np.arange(len(of))
        none, ids = id_.is_null().to_numpy(zero_copy_only=False), pc.fill_null(id_, 0).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, none, game))
        offers, game, none, ids = offers[order], game[order], none[order], ids[order]
        first = _firsts(game, none, ids)
        offers = _winners(offers, first, lambda a, b: (nth[b] < nth[a]) | ((nth[b] == nth[a]) & (by[b] > by[a])))
        game = game[first]
        won = _winners(offers, _firsts(game), lambda a, b: (chance[b] > chance[a]) | ((chance[b] == chance[a]) & (by[b] > by[a])))
        order = won[won >= 0]
        at = lambda x: pa.array(x[order], mask=np.isnan(x[order]))
        bets = pa.StructArray.from_arrays([pa.array(place[order].astype(np.int32)), at(prob), id_.take(pa.array(of[order])), at(price), at(line)], names=["place", "prob", "bookmaker", "price", "line"])
        count = np.zeros(len(quotes), np.int32)
        count[game[_firsts(game)]] = (won >= 0).sum(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), bets)

    # not made again for a filter on its result
    return F.arrow_udf(best, f"array<struct<place:int,prob:double,bookmaker:{kind},price:double,line:double>>").asNondeterministic()


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.full(len(keys[0]), True)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _winners(numbers: np.ndarray, first: np.ndarray, beats: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Of each run of rows and each column the number that no later one ``beats``; less than 0 is none."""
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(first)))
    won = numbers[start]
    for k in range(1, size.max(initial=1)):
        at = np.flatnonzero(size > k)
        a, b = won[at], numbers[start[at] + k]
        won[at] = np.where((b >= 0) & ((a < 0) | beats(a, b)), b, a)
    return won


#: fixed value: the least chance of a bet
LEAST_PROB = 0.52


def judged(d: DataFrame, least_prob: float = LEAST_PROB, least_edge: float = 0.02, thresholds: DataFrame | None = None, bank: float = 1000.0) -> DataFrame:
    """Edge, value, tier and stake of (…, prob, price) rows that are above the thresholds: of their sport (sport, threshold) where given."""
    d = d.withColumn("edge", F.col("prob") - decimal_to_implied("price"))
    if thresholds is not None:
        d = d.join(thresholds.select("sport", F.col("threshold").alias("_t")), "sport", "left")
    else:
        d = d.withColumn("_t", F.lit(None).cast("double"))
    d = d.where((F.col("prob") >= F.coalesce("_t", F.lit(least_prob))) & (F.col("edge") >= least_edge)).drop("_t")
    tier = F.lit("D")
    for name, confidence, edge in reversed(TIERS):
        tier = F.when((F.col("prob") >= confidence) & (F.col("edge") >= edge), name).otherwise(tier)
    return d.select("*", expected_value("prob", "price").alias("ev"), tier.alias("tier"), (bank * kelly("prob", "price")).alias("stake"))


def candidates(predictions: DataFrame, quotes: DataFrame, exclude: tuple = (), selections: tuple[Selection, ...] = SELECTIONS, **limits) -> DataFrame:
    """Bets of all markets, one a game and market, that pass ``judged``: at the best price over the books, of spread and total at the
    best value; ties by the smallest book.

    Predictions have a row a game, quotes a row or more a game and book. One join by game gives every quote the prediction of its game; they
    meet in a row of their game and are priced by arrays of a batch's games. Tables that are dealt by game need no shuffle; a task holds the
    quotes of its games, so it should have few of them.
    """
    q = quotes.where(~F.col("bookmaker").isin(*exclude)) if exclude else quotes
    # a pick has the same chance at every book, so one under a common threshold has no better side that steps in
    least = limits.get("least_prob", LEAST_PROB) if limits.get("thresholds") is None else -math.inf
    said = ("predicted_margin", "predicted_total", "confidence")
    p = predictions.select("game_id", "sport", "date", F.col("probs").cast("map<string,double>").alias("probs"), *(F.col(c).cast("double").alias(c) for c in said))
    d = q.select("game_id", "bookmaker", F.col("prices").cast("map<string,double>").alias("prices"), F.col("lines").cast("map<string,double>").alias("lines")).join(p.hint("shuffle_hash"), "game_id")
    # a game's quotes meet where the join has dealt them, before anything is made of them
    d = d.groupBy("game_id", "sport", "date").agg(F.collect_list(F.struct("bookmaker", "prices", "lines", "probs", *said)).alias("_quotes"))
    d = d.withColumn("b", taken(q.schema["bookmaker"].dataType.simpleString(), least, selections)("_quotes")).select("game_id", "sport", "date", F.inline("b"))
    name = lambda values: F.get(F.array(*map(F.lit, values)), F.col("place"))
    market, selection = name([*(s.market for s in selections), "total", "total", "spread", "spread"]), name([*(s.selection for s in selections), "over", "under", "home", "away"])
    return judged(d.select("game_id", market.alias("market"), selection.alias("selection"), "sport", "date", "prob", "bookmaker", "price", "line"), **limits)


# ---------------------------------------------------------------- legs


def leg_kinds(dominant: float = 4.0) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Numbers that a side wins by, numbers held against a line, and things that happen or not, by kind."""
    c = F.col
    q = lambda side, *ns: sum((c(f"{side}_q{n}") for n in ns[1:]), c(f"{side}_q{ns[0]}"))
    half_h, half_a = q("home", 1, 2), q("away", 1, 2)
    margin, both = c("home_score") - c("away_score"), c("home_score") + c("away_score")
    half = F.when((half_h != 0) | (half_a != 0), half_h - half_a)
    side = {"winner": margin, "spread": margin, "halftime_winner": half, "second_half_winner": q("home", 3, 4) - q("away", 3, 4)}
    side |= {f"q{n}_winner": c(f"home_q{n}") - c(f"away_q{n}") for n in range(1, 5)}
    line = {"total": both, "esports_map_total": F.when(both > 0, both), "home_total": c("home_score"), "away_total": c("away_score"), "first_period_total": c("home_q1") + c("away_q1"), "prop": c("stat_value")}
    line |= {f"q{n}_total": c(f"home_q{n}") + c(f"away_q{n}") for n in range(1, 5)}
    o = outcomes(dominant)
    event = {"draw": o["draw"], "overtime": F.coalesce(c("home_ot"), F.lit(0.0)) + F.coalesce(c("away_ot"), F.lit(0.0)) > 0, "btts": o["both_score"], "clean_sheet_home": o["clean_sheet_home"], "clean_sheet_away": o["clean_sheet_away"], "esports_clean_sweep": F.when(both > 0, o["clean_sweep"]), "esports_decider_map": F.when(both > 0, o["decider_map"]), "esports_dominant_win": o["dominant_win"], "large_margin": o["dominant_win"], "straight_sets": o["straight_sets"], "comeback_home": o["comeback_home"], "comeback_away": o["comeback_away"]}
    return side, line, event


def graded(legs: DataFrame, games: DataFrame, players: DataFrame | None = None, stats: tuple[str, ...] = ("pts", "reb", "ast"), dominant: float = 4.0, low: float = 5.0, high: float = 8.0) -> DataFrame:
    """Legs (game_id, kind, selection, line, player_id, stat) with ``result``: won, lost, push, void, or open while scores are missing.

    Void: an unknown kind, a missing line, a game that has not the scores of the kind, or a player without a row in the game.
    Selections are home, away and draw, over and under, no (anything else: yes), and the names of bands.
    """
    if players is not None:
        values = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats))).alias("x")
        made = players.select("game_id", "player_id", values).groupBy("game_id", "player_id", "x.stat").agg(F.sum("x.v").alias("stat_value"))
        of_player = F.col("player_id").isNotNull() & F.col("stat").isNotNull()
        d = legs.where(of_player).join(made, ["game_id", "player_id", "stat"], "left").select(*legs.columns, "stat_value")
        d = d.unionByName(legs.where(~of_player).withColumn("stat_value", F.lit(None).cast("double")))
    else:
        d = legs.withColumn("stat_value", F.lit(None).cast("double"))
    columns = ["home_score", "away_score", *(f"{s}_q{n}" for s in ("home", "away") for n in range(1, 5)), "home_ot", "away_ot", "total_line", "home_line", "away_line"]
    have = [F.col(c) if c in games.columns else F.lit(None).cast("double").alias(c) for c in columns]
    side, line, event = leg_kinds(dominant)
    line.pop("prop")
    regulation = F.when(outcomes()["regulation_draw"], "draw").when(outcomes()["regulation_home"], "home").otherwise("away")
    margin, both = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    bands = {"total_band": total_band(low, high), "margin_band": F.when(F.abs(margin) < dominant, "close").otherwise("wide"), "regulation_result": regulation, "exact_goals_band": F.when(both <= 1, "0_to_1").otherwise("more")}
    numbers = [*side.values(), *line.values(), *(v.cast("double") for v in event.values())]
    # what a game's legs of all kinds need is made once a game, not once a leg; a leg looks its kind up
    g = games.select(F.col("game_id").alias("_g"), *have).select("_g", "home_score", "away_score", F.array(*(v.cast("double") for v in numbers)).alias("_numbers"), F.array(*bands.values()).alias("_bands"))
    places = {k: i for names in ([*side, *line, *event], bands) for i, k in enumerate(names, 1)}
    place = F.create_map(*(F.lit(v) for item in places.items() for v in item))
    d = d.join(g, F.col("game_id") == F.col("_g"), "left")
    kind, selection, at = F.col("kind"), F.lower(F.trim("selection")), F.col("line")
    in_ = lambda names: kind.isin(*names)
    # each step is a column of its own, as the next reads it more than once
    d = d.withColumns({"_place": F.try_element_at(place, kind), "_selection": selection})
    d = d.withColumns({"_value": F.when(kind == "prop", F.col("stat_value")).otherwise(F.try_element_at("_numbers", F.col("_place"))), "_band": F.try_element_at("_bands", F.col("_place"))})
    value, band, selection = F.col("_value"), F.col("_band"), F.col("_selection")
    sign = F.when(selection == "home", 1.0).when(selection == "away", -1.0)
    by_side = sign * value + F.when(kind == "spread", at).otherwise(0.0)
    gap = value - at
    by_line = F.when(selection == "over", gap).when(selection == "under", -gap)
    by_event = F.when((value > 0) == (selection != "no"), 1.0).when(value.isNotNull(), -1.0)
    by_band = F.when(band == selection, 1.0).when(band.isNotNull(), -1.0)
    x = F.when(in_(side), by_side).when(in_([*line, "prop"]), by_line).when(in_(event), by_event).when(in_(bands), by_band)
    d, x = d.withColumn("_x", x), F.col("_x")
    result = F.when(F.col("home_score").isNull() | F.col("away_score").isNull(), "open").when(x > 0, "won").when(x < 0, "lost").when(x == 0, "push").otherwise("void")
    return d.select(*legs.columns, "stat_value", result.alias("result"))


# ---------------------------------------------------------------- parlays


@dataclass(frozen=True)
class ParlayRules:
    """Legs, how many of a day are wanted, and what a parlay must keep: least chance of all, most prop legs, and the largest share of
    legs on one side. Its score is ``weight`` times the chance plus the rest times the value, times the penalty of its length."""

    legs: int = 3
    most: int = 10
    least_prob: float = 0.0
    most_props: int = 2
    most_same: float = 0.67
    weight: float = 0.6
    penalty: float = 0.95


def search(legs: list[tuple], rules: ParlayRules) -> list[tuple[float, tuple, float, float]]:
    """The best parlays of some legs (key, game, side, is_prop, prob, price), exactly: branch and bound.

    Legs are tried best first; with the largest chance and value that are left, a branch has a bound, and as those only
    fall along the list, the first branch under the worst kept score ends the list.
    """
    n, w = rules.legs, rules.weight
    legs = sorted(legs, key=lambda x: (-(w * x[4] + (1 - w) * x[4] * x[5]), x[0]))
    p_left, v_left = [0.0] * (len(legs) + 1), [0.0] * (len(legs) + 1)
    for i in range(len(legs) - 1, -1, -1):
        p_left[i], v_left[i] = max(p_left[i + 1], legs[i][4]), max(v_left[i + 1], legs[i][4] * legs[i][5])
    same = int(rules.most_same * n + 1e-9)
    kept: list[tuple[float, tuple, float, float]] = []
    floor = -float("inf")

    def go(at: int, taken: list[tuple], prob: float, value: float) -> None:
        nonlocal floor
        left = n - len(taken)
        if not left:
            chance, price = 1.0, 1.0
            chosen = sorted(taken, key=lambda x: x[0])
            for x in chosen:
                chance, price = chance * x[4], price * x[5]
            ev = chance * (price - 1) - (1 - chance)
            if chance < rules.least_prob or ev < 0:
                return
            score = round((w * chance + (1 - w) * ev) * rules.penalty, 9)
            kept.append((-score, tuple(x[0] for x in chosen), chance, price))
            kept.sort()
            del kept[rules.most :]
            if len(kept) == rules.most:
                floor = -kept[-1][0]
            return
        for i in range(at, len(legs) - left + 1):
            p, v = prob * p_left[i] ** left, value * v_left[i] ** left
            if (w * p + (1 - w) * (v - 1)) * rules.penalty < floor - 1e-8 or p < rules.least_prob:
                break
            x = legs[i]
            if any(x[1] == y[1] for y in taken) or (x[3] and sum(y[3] for y in taken) >= rules.most_props) or sum(x[2] == y[2] for y in taken) >= same:
                continue
            go(i + 1, [*taken, x], prob * x[4], value * x[4] * x[5])

    go(0, [], 1.0, 1.0)
    return kept


_BEST = "date date, rank int, keys array<string>, prob double, price double, score double"


def _search(rules: ParlayRules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Days come one after the other."""
        day, legs = None, []

        def out() -> pd.DataFrame:
            found = search(legs, rules)
            return pd.DataFrame([(day, i, list(keys), p, o, -s) for i, (s, keys, p, o) in enumerate(found, 1)], columns=["date", "rank", "keys", "prob", "price", "score"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.date != day:
                    yield out()
                    day, legs = r.date, []
                legs.append((r.leg, r.game_id, r.side, bool(r.is_prop), r.prob, r.price))
        yield out()

    return run


def best_parlays(legs: DataFrame, rules: ParlayRules = ParlayRules()) -> DataFrame:
    """The best ``rules.most`` parlays of each day of legs (date, leg, game_id, side, is_prop, prob, price), as by trying all.

    First the best parlays of each day's few best legs by chance and by value are found: their worst score is a floor. A leg that with
    the day's largest chances and values cannot reach the floor is in no best parlay and goes, before any leg meets another.
    """
    few = rules.legs + 4 * rules.most
    d = legs.where("date IS NOT NULL AND prob > 0 AND price > 1").select("date", "leg", "game_id", "side", "is_prop", "prob", "price").withColumn("value", F.col("prob") * F.col("price"))
    ranks = [F.row_number().over(W.partitionBy("date").orderBy(F.desc(c), "leg")) for c in ("prob", "value")]
    head = d.withColumn("_a", ranks[0]).where(F.col("_a") <= few).drop("_a").unionByName(d.withColumn("_a", ranks[1]).where(F.col("_a") <= few).drop("_a")).distinct()
    ordered = lambda x: x.repartition("date").sortWithinPartitions("date", "leg")
    first = ordered(head).mapInPandas(_search(rules), _BEST)
    floor = first.groupBy("date").agg(F.when(F.count("*") >= rules.most, F.min("score")).alias("_floor"))
    top = d.groupBy("date").agg(F.max("prob").alias("_p"), F.max("value").alias("_v"))
    d = d.join(top, "date").join(floor, "date", "left")
    rest, w = rules.legs - 1, rules.weight
    bound = (w * F.col("prob") * F.pow("_p", F.lit(rest)) + (1 - w) * (F.col("value") * F.pow("_v", F.lit(rest)) - 1)) * rules.penalty
    d = d.where(F.col("_floor").isNull() | (bound >= F.col("_floor") - 1e-8))
    return ordered(d.drop("_p", "_v", "_floor", "value")).mapInPandas(_search(rules), _BEST)
