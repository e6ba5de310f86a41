"""All markets, leg kinds and the best parlays as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import betting as B, market as M
from .evaluation_queries import CANDS
from .registry import query
from .table_queries import rounded

PROBS = sorted({s.prob.lstrip("!") for s in B.SELECTIONS})
PRICES = sorted({k for s in B.SELECTIONS for k in s.prices} | {"total_over", "total_under", "spread_home", "spread_away"})
LINES = sorted({s.line for s in B.SELECTIONS if s.line})
BOOKS = 3

# ---------------------------------------------------------------- markets: made from the games, the same numbers in Spark and in SQL


def _once(*columns):
    """Columns made in a row of their own: what reads the maps does not make them again for every key."""
    return F.inline(F.array(F.struct(*columns)))


def predictions(games):
    g, i = F.col("game_id"), F.sequence(F.lit(0).cast("long"), F.lit(len(PROBS) - 1).cast("long"))
    probs = F.map_from_arrays(F.array(*map(F.lit, PROBS)), F.transform(i, lambda i: 0.02 + ((g * (7 + 2 * i) + i) % 96) / 100.0))
    return games.select("game_id", "sport", "date", _once(probs.alias("probs"), (g % 31 - 15).cast("double").alias("predicted_margin"), (140 + g % 61).cast("double").alias("predicted_total"), (0.5 + (g % 40) / 100.0).alias("confidence")))


def quotes(games):
    g, b = F.col("game_id"), F.col("bookmaker")
    price = lambda j: F.when((g + j + b) % 7 != 0, 1.02 + ((g * (5 + 3 * j) + b * 11 + j) % 83) / 40.0)
    named = lambda names, values: F.map_from_arrays(F.array(*map(F.lit, names)), values)
    # the lambda keeps this out of a stage's one method, in which so many prices would be too much to be compiled
    lines = named([*LINES, "total_line", "spread_home"], F.concat(F.transform(F.array(*map(F.lit, LINES)), lambda _: 1.5 + (g + b) % 3), F.array(150.0 + g % 40 + b, (g + b) % 9 - 4.0)))
    d = games.select("game_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BOOKS - 1).cast("long"))).alias("bookmaker"))
    return d.select("game_id", "bookmaker", named(PRICES, F.array(*map(price, range(len(PRICES))))).alias("prices"), lines.alias("lines"))


def _price(j: str) -> str:
    return f"CASE WHEN (g.game_id + {j} + b) % 7 <> 0 THEN 1.02 + ((g.game_id * (5 + 3 * {j}) + b * 11 + {j}) % 83) / 40.0 END"


def _spec() -> str:
    rows = []
    for i, s in enumerate(B.SELECTIONS):
        second = PRICES.index(s.prices[1]) if len(s.prices) > 1 else "NULL"
        rows.append(f"({i}, '{s.market}', '{s.selection}', {PROBS.index(s.prob.lstrip('!'))}, {str(s.prob.startswith('!')).upper()}, {s.above}, {PRICES.index(s.prices[0])}, {second}, {str(bool(s.line)).upper()})")
    return f"spec(place, market, selection, i, comp, above, j1, j2, lined) AS (VALUES {', '.join(rows)})"


MARKETS_SQL = f"""WITH {_spec()}, books AS (SELECT CAST(b AS BIGINT) AS b FROM range({BOOKS}) r(b)),
 pr AS (SELECT g.game_id, g.sport, s.*, 0.02 + ((g.game_id * (7 + 2 * i) + i) % 96) / 100.0 AS raw FROM games g, spec s),
 pk AS (SELECT *, CASE WHEN comp THEN 1 - raw ELSE raw END AS prob FROM pr WHERE CASE WHEN comp THEN 1 - raw ELSE raw END > above),
 pick AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY game_id, market ORDER BY prob DESC, place) = 1),
 off AS (SELECT g.game_id, g.sport, g.market, g.selection, g.prob, b AS bookmaker, coalesce({_price("j1")}, {_price("j2")}) AS price, CASE WHEN lined THEN 1.5 + (g.game_id + b) % 3 END AS line FROM pick g, books),
 fixed AS (SELECT game_id, sport, market, selection, prob, bookmaker, price, line FROM off WHERE price > 1 QUALIFY row_number() OVER (PARTITION BY game_id, market ORDER BY price DESC, bookmaker) = 1),
 ln AS (SELECT g.game_id, g.sport, b AS bookmaker, 150.0 + g.game_id % 40 + b AS tl, (g.game_id + b) % 9 - 4.0 AS sh, CAST(g.game_id % 31 - 15 AS DOUBLE) AS m, CAST(140 + g.game_id % 61 AS DOUBLE) AS pt, 0.5 + (g.game_id % 40) / 100.0 AS conf,
   {_price(str(PRICES.index("total_over")))} AS p_over, {_price(str(PRICES.index("total_under")))} AS p_under, {_price(str(PRICES.index("spread_home")))} AS p_home, {_price(str(PRICES.index("spread_away")))} AS p_away FROM games g, books),
 tot AS (SELECT game_id, sport, 'total' AS market, CASE WHEN pt > tl THEN 'over' ELSE 'under' END AS selection, least(0.95, 0.5 + abs(pt - tl) / (tl * 0.1 + 5), conf + 0.10) AS prob, bookmaker, CASE WHEN pt > tl THEN p_over ELSE p_under END AS price, tl AS line FROM ln WHERE abs(pt - tl) >= 0.5),
 cov AS (SELECT *, least(greatest(0.5 + 0.03 * (m + sh), 0.05), 0.95) AS c FROM ln),
 spr AS (SELECT game_id, sport, 'spread' AS market, CASE WHEN c > 0.5 THEN 'home' ELSE 'away' END AS selection, CASE WHEN c > 0.5 THEN c ELSE 1 - c END AS prob, bookmaker, CASE WHEN c > 0.5 THEN p_home ELSE p_away END AS price, CASE WHEN c > 0.5 THEN sh ELSE -sh END AS line FROM cov WHERE c <> 0.5),
 lined AS (SELECT * FROM (SELECT * FROM tot UNION ALL SELECT * FROM spr) u WHERE price > 1 QUALIFY row_number() OVER (PARTITION BY game_id, market ORDER BY round(prob * price, 9) DESC, bookmaker) = 1),
 allm AS (SELECT * FROM fixed UNION ALL SELECT * FROM lined), e AS (SELECT *, prob - 1 / price AS edge FROM allm WHERE prob >= 0.52 AND prob - 1 / price >= 0.02)
 SELECT game_id, market, selection, bookmaker, round(line, 6) + 0.0 AS line, round(prob, 6) AS prob, round(price, 6) AS price, round(edge, 6) AS edge, round(prob * (price - 1) - (1 - prob), 6) AS ev,
  CASE WHEN prob >= 0.75 AND edge >= 0.10 THEN 'S' WHEN prob >= 0.65 AND edge >= 0.07 THEN 'A' WHEN prob >= 0.60 AND edge >= 0.05 THEN 'B' WHEN prob >= 0.55 AND edge >= 0.03 THEN 'C' ELSE 'D' END AS tier FROM e"""


@query("j4_all_markets", MARKETS_SQL)
def _(t):
    """Games are dealt out while their rows are narrow; predictions and quotes are made where they meet, and neither is written or shuffled."""
    games = t.games.select("game_id", "sport", "date").repartition(8 * M.unmerged(t.spark), "game_id")
    d = B.candidates(predictions(games), quotes(games))
    return rounded(d.select("game_id", "market", "selection", "bookmaker", "line", "prob", "price", "edge", "ev", "tier"))


# ---------------------------------------------------------------- legs

KINDS = ["winner", "spread", "halftime_winner", "second_half_winner", "q1_winner", "q3_winner", "total", "esports_map_total", "home_total", "first_period_total", "q2_total", "draw", "overtime", "btts", "clean_sheet_home", "clean_sheet_away", "esports_clean_sweep", "esports_decider_map", "large_margin", "comeback_home", "comeback_away", "total_band", "margin_band", "regulation_result", "exact_goals_band", "nothing", "prop"]
_CHOICE = {"home": ["home", "away"], "over": ["over", "under"], "yes": ["yes", "no"]}


def choices(kind: str) -> list[str]:
    if kind in ("winner", "spread") or kind.endswith("_winner"):
        return ["home", "away"]
    if kind in ("prop", "total") or kind.endswith("_total"):
        return ["over", "under"]
    return {"total_band": ["low", "high"], "margin_band": ["close", "wide"], "regulation_result": ["home", "draw"], "exact_goals_band": ["0_to_1", "more"]}.get(kind, ["yes", "no"])


def legs(t):
    """A leg of each kind for every game; props on the players of the game and on one that did not play."""
    g = F.col("game_id")
    pick = lambda k: F.when(g % 2 == 0, choices(k)[0]).otherwise(choices(k)[1])
    rows = [F.struct(F.lit(k).alias("kind"), pick(k).alias("selection"), (F.lit(i % 3) + (g % 7) / 2.0).alias("line")) for i, k in enumerate(KINDS) if k != "prop"]
    d = t.games.select("game_id", F.explode(F.array(*rows)).alias("x")).select("game_id", "x.*", F.lit(None).cast("long").alias("player_id"), F.lit(None).cast("string").alias("stat"))
    stat = F.when(g % 3 == 0, "pts").when(g % 3 == 1, "reb").otherwise("ast")
    prop = [F.lit("prop").alias("kind"), F.when(g % 2 == 0, "over").otherwise("under").alias("selection"), (g % 12).cast("double").alias("line")]
    played = t.player_stats.where("seq = 1").select("game_id", *prop, F.col("player_id"), stat.alias("stat"))
    absent = t.games.select("game_id", *prop, F.lit(-1).cast("long").alias("player_id"), stat.alias("stat"))
    return d.unionByName(played).unionByName(absent)


_SIDE = {"winner": "home_score - away_score", "spread": "home_score - away_score", "halftime_winner": "CASE WHEN home_q1 + home_q2 <> 0 OR away_q1 + away_q2 <> 0 THEN home_q1 + home_q2 - away_q1 - away_q2 END", "second_half_winner": "home_q3 + home_q4 - away_q3 - away_q4", "q1_winner": "home_q1 - away_q1", "q3_winner": "home_q3 - away_q3"}
_OVER = {"total": "home_score + away_score", "esports_map_total": "nullif(home_score + away_score, 0)", "home_total": "home_score", "first_period_total": "home_q1 + away_q1", "q2_total": "home_q2 + away_q2", "prop": "v"}
_EVENT = {
    "draw": "home_score = away_score", "overtime": "coalesce(home_ot, 0) + coalesce(away_ot, 0) > 0", "btts": "home_score > 0 AND away_score > 0", "clean_sheet_home": "away_score = 0", "clean_sheet_away": "home_score = 0",
    "esports_clean_sweep": "CASE WHEN home_score + away_score > 0 THEN least(home_score, away_score) = 0 END", "esports_decider_map": "CASE WHEN home_score + away_score > 0 THEN home_score + away_score = 2 * greatest(home_score, away_score) - 1 END",
    "large_margin": "abs(home_score - away_score) >= 4", "comeback_home": "CASE WHEN home_q1 + home_q2 < away_q1 + away_q2 THEN home_score > away_score END", "comeback_away": "CASE WHEN away_q1 + away_q2 < home_q1 + home_q2 THEN away_score > home_score END",
}
_REG = "(CASE WHEN home_ot IS NOT NULL AND away_ot IS NOT NULL AND home_score <> away_score THEN home_score - home_ot - away_score + away_ot ELSE home_score - away_score END)"
_BAND = {"total_band": "CASE WHEN home_score + away_score <= 5 THEN 'low' WHEN home_score + away_score <= 8 THEN 'mid' ELSE 'high' END", "margin_band": "CASE WHEN abs(home_score - away_score) < 4 THEN 'close' ELSE 'wide' END", "regulation_result": f"CASE WHEN {_REG} = 0 THEN 'draw' WHEN {_REG} > 0 THEN 'home' ELSE 'away' END", "exact_goals_band": "CASE WHEN home_score + away_score <= 1 THEN '0_to_1' ELSE 'more' END"}
_CASES = " ".join(
    [f"WHEN kind = '{k}' THEN (CASE WHEN selection = 'home' THEN 1 ELSE -1 END) * ({e}){' + line' if k == 'spread' else ''}" for k, e in _SIDE.items()]
    + [f"WHEN kind = '{k}' THEN (CASE WHEN selection = 'over' THEN 1 ELSE -1 END) * ({e} - line)" for k, e in _OVER.items()]
    + [f"WHEN kind = '{k}' THEN CASE WHEN ({e}) = (selection = 'yes') THEN 1 WHEN ({e}) IS NOT NULL THEN -1 END" for k, e in _EVENT.items()]
    + [f"WHEN kind = '{k}' THEN CASE WHEN ({e}) = selection THEN 1 ELSE -1 END" for k, e in _BAND.items()]
)
_LEGS = " UNION ALL ".join(f"SELECT game_id, '{k}' AS kind, CASE WHEN game_id % 2 = 0 THEN '{choices(k)[0]}' ELSE '{choices(k)[1]}' END AS selection, {i % 3} + (game_id % 7) / 2.0 AS line, NULL AS player_id, NULL AS stat FROM games" for i, k in enumerate(KINDS) if k != "prop")
LEGS_SQL = f"""WITH l AS ({_LEGS} UNION ALL SELECT game_id, 'prop', CASE WHEN game_id % 2 = 0 THEN 'over' ELSE 'under' END, CAST(game_id % 12 AS DOUBLE), player_id, CASE game_id % 3 WHEN 0 THEN 'pts' WHEN 1 THEN 'reb' ELSE 'ast' END FROM (SELECT game_id, player_id FROM player_stats WHERE seq = 1 UNION ALL SELECT game_id, -1 FROM games) q),
 mv AS (SELECT game_id, player_id, sum(pts) AS pts, sum(reb) AS reb, sum(ast) AS ast FROM player_stats GROUP BY 1, 2),
 j AS (SELECT l.*, p.* EXCLUDE (game_id), CASE l.stat WHEN 'pts' THEN mv.pts WHEN 'reb' THEN mv.reb WHEN 'ast' THEN mv.ast END AS v FROM l LEFT JOIN period_scores p ON p.game_id = l.game_id LEFT JOIN mv ON mv.game_id = l.game_id AND mv.player_id = l.player_id),
 x AS (SELECT *, CASE {_CASES} END AS x FROM j)
 SELECT game_id, kind, selection, player_id, CASE WHEN home_score IS NULL OR away_score IS NULL THEN 'open' WHEN x > 0 THEN 'won' WHEN x < 0 THEN 'lost' WHEN x = 0 THEN 'push' ELSE 'void' END AS result FROM x"""


@query("j8_leg_kinds", LEGS_SQL)
def _(t):
    return B.graded(legs(t), t.period_scores, t.player_stats).select("game_id", "kind", "selection", "player_id", "result")


# ---------------------------------------------------------------- parlays

RULES = B.ParlayRules(legs=3, most=5, least_prob=0.02, most_props=1, most_same=0.67)
_PROP = "game_id % 3 = 0"
PARLAYS_SQL = f"""WITH {CANDS}, s AS (SELECT date, lpad(CAST(game_id AS VARCHAR), 12, '0') || ':' || selection AS leg, game_id, selection AS side, {_PROP} AS prop, prob, price FROM c),
 t3 AS (SELECT a.date, [a.leg, b.leg, d.leg] AS keys, a.prob * b.prob * d.prob AS prob, a.price * b.price * d.price AS price FROM s a JOIN s b ON a.date = b.date AND a.leg < b.leg AND a.game_id <> b.game_id JOIN s d ON d.date = b.date AND b.leg < d.leg AND d.game_id <> b.game_id AND d.game_id <> a.game_id
  WHERE CAST(a.prop AS INT) + CAST(b.prop AS INT) + CAST(d.prop AS INT) <= 1 AND NOT (a.side = b.side AND b.side = d.side)),
 e AS (SELECT *, prob * (price - 1) - (1 - prob) AS ev FROM t3 WHERE prob >= 0.02 AND prob * (price - 1) - (1 - prob) >= 0),
 r AS (SELECT *, round((0.6 * prob + (1 - 0.6) * ev) * 0.95, 9) AS score FROM e), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, keys) AS INT) AS rank FROM r)
 SELECT date, rank, array_to_string(keys, ' ') AS legs, round(prob, 6) AS prob, round(price, 6) AS price, round(score, 6) AS score FROM k WHERE rank <= 5"""


@query("j6_best_parlays", PARLAYS_SQL)
def _(t):
    """The five best parlays of three legs of every day: at most one prop, not all on one side."""
    c = M.candidates(t.predictions, t.odds)
    leg = F.concat_ws(":", F.lpad(F.col("game_id").cast("string"), 12, "0"), "selection")
    d = c.select("date", leg.alias("leg"), "game_id", F.col("selection").alias("side"), F.expr(_PROP).alias("is_prop"), "prob", "price")
    return rounded(B.best_parlays(d, RULES).select("date", "rank", F.concat_ws(" ", "keys").alias("legs"), "prob", "price", "score"))
