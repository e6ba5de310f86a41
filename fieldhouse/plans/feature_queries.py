"""Point-in-time features as registered queries. The SQL joins every row with its team's earlier games."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..features import asof, elo, families
from ..operators import games as G
from ..sources.stored import shared_dir
from .registry import query
from .table_queries import TG, half_up, rounded

WIN = "CASE WHEN pf > pa THEN 1 WHEN pf IS NOT NULL AND pa IS NOT NULL THEN 0 END"
PAST = f"""{TG}, w AS (SELECT *, {WIN} AS win FROM tg), past AS (
 SELECT t.game_id, t.team_id, t.is_home, t.date, p.game_id AS pg, p.date AS pdate, p.opp_id AS popp, p.is_home AS phome, p.pf, p.pa, p.win,
  row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home ORDER BY p.date DESC, p.game_id DESC) AS k
 FROM w t LEFT JOIN w p ON p.team_id = t.team_id AND p.completed AND p.date < t.date)"""
KEY = "game_id, team_id, is_home"


@query("i1_form", f"WITH {PAST} SELECT {KEY}, date, round(coalesce(avg(win), 0), 6) AS form_win_pct, round(coalesce(avg(pf), 0), 6) AS form_ppg, round(coalesce(avg(pa), 0), 6) AS form_opp_ppg, round(coalesce(avg(pf - pa), 0), 6) + 0.0 AS form_margin, count(pg) AS form_games FROM past WHERE k <= 10 GROUP BY {KEY}, date")
def _(t):
    return rounded(asof.form(t.games))


@query(
    "i2_venue_form",
    f"""WITH {PAST}, r AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, phome ORDER BY k) AS kv FROM past WHERE k <= 30),
 a AS (SELECT {KEY}, date, count(CASE WHEN phome THEN 1 END) AS nh, count(CASE WHEN NOT phome THEN 1 END) AS na, avg(CASE WHEN phome AND kv <= 10 THEN win END) AS h, avg(CASE WHEN NOT phome AND kv <= 10 THEN win END) AS w, avg(CASE WHEN k <= 10 THEN win END) AS al FROM r GROUP BY {KEY}, date)
 SELECT {KEY}, date, round(coalesce(CASE WHEN nh >= 3 THEN h ELSE al END, 0.5), 6) AS home_win_pct, round(coalesce(CASE WHEN na >= 3 THEN w ELSE al END, 0.5), 6) AS away_win_pct FROM a""",
)
def _(t):
    return rounded(asof.venue_form(t.games))


@query(
    "i3_head_to_head",
    f"""WITH {TG}, w AS (SELECT *, {WIN} AS win FROM tg), p AS (SELECT t.game_id, t.team_id, t.is_home, p.win, p.pf - p.pa AS m, p.game_id AS pg, p.is_home = t.is_home AS same,
  row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home ORDER BY p.date DESC, p.game_id DESC) AS k, row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home, p.is_home = t.is_home ORDER BY p.date DESC, p.game_id DESC) AS ks
  FROM w t LEFT JOIN w p ON p.team_id = t.team_id AND p.opp_id = t.opp_id AND p.completed AND p.date < t.date)
 SELECT {KEY}, round(coalesce(avg(CASE WHEN k <= 10 THEN win END), 0.5), 6) AS h2h_win_pct, round(coalesce(avg(CASE WHEN k <= 10 THEN m END), 0), 6) + 0.0 AS h2h_margin, count(CASE WHEN k <= 10 THEN pg END) AS h2h_games, round(coalesce(avg(CASE WHEN same AND ks <= 8 THEN win END), 0.5), 6) AS h2h_side_win_pct FROM p GROUP BY {KEY}""",
)
def _(t):
    return rounded(asof.head_to_head(t.games))


@query("i4_rest", f"WITH {PAST} SELECT {KEY}, date, CAST(coalesce(date_diff('day', max(pdate), date), 7) AS INT) AS rest_days, coalesce(date_diff('day', max(pdate), date), 7) <= 1 AS back_to_back, count(CASE WHEN pdate >= date - INTERVAL 7 DAY THEN 1 END) AS games_7d, count(CASE WHEN pdate >= date - INTERVAL 14 DAY THEN 1 END) AS games_14d FROM past GROUP BY {KEY}, date")
def _(t):
    return asof.rest(t.games)


@query("i5_season_split", f"WITH {TG}, w AS (SELECT *, {WIN} AS win FROM tg WHERE completed) SELECT season, team_id, count(*) AS games, round(avg(win), 6) AS win_pct, round(coalesce(avg(CASE WHEN is_home THEN win END), 0.5), 6) AS home_win_pct, round(coalesce(avg(CASE WHEN NOT is_home THEN win END), 0.5), 6) AS away_win_pct, round(avg(pf), 6) AS ppg FROM w GROUP BY 1, 2")
def _(t):
    return rounded(asof.season_split(t.games))


@query("i6_momentum", f"WITH {PAST}, n AS (SELECT *, count(pg) OVER (PARTITION BY {KEY}) AS n FROM past WHERE k <= 5), v AS (SELECT *, CASE WHEN n > 1 THEN 1 - 0.5 * (k - 1) / (n - 1) ELSE 1.0 END AS wt FROM n) SELECT {KEY}, round(coalesce(sum(CASE WHEN pg IS NOT NULL THEN (2 * win - 1) * wt END) / sum(CASE WHEN pg IS NOT NULL THEN wt END), 0), 6) + 0.0 AS momentum FROM v GROUP BY {KEY}")
def _(t):
    return rounded(asof.momentum(t.games))


@query("i7_elo", elo.ELO_SQL)
def _(t):
    d = elo.elo(t.games)
    return d.select("sport", "game_id", *(half_up(c, 4).alias(c) for c in ("home_elo", "away_elo", "elo_diff")), half_up("home_expected", 6).alias("home_expected"))


@query("i7_elo_ratings", elo.RATINGS_SQL)
def _(t):
    """Ratings after all games, by a book that is founded on the days until 1998 and goes on from there in one step a day."""
    book = elo.EloBook(t.spark, f"{shared_dir(t.spark)}/elo-book-{uuid.uuid4().hex[:12]}")
    played = t.games.where("home_score IS NOT NULL")
    last = played.agg(F.max("date")).first()[0]
    book.found(played, last - datetime.timedelta(days=5))
    book.advance(played)
    return book.table.read().select("sport", "team_id", half_up("rating", 4).alias("rating"))


@query("i9_injury_burden", "SELECT team_id, count(CASE WHEN status = 'Out' THEN 1 END) AS out, count(CASE WHEN status = 'Questionable' THEN 1 END) AS questionable, count(CASE WHEN status = 'Day-To-Day' THEN 1 END) AS day_to_day, CAST(sum(CASE status WHEN 'Out' THEN 3 WHEN 'Questionable' THEN 2 WHEN 'Day-To-Day' THEN 1 ELSE 0 END) AS BIGINT) AS severity FROM injuries GROUP BY 1")
def _(t):
    return asof.injury_burden(t.injuries)


@query(
    "i11_fatigue",
    f"""WITH {PAST}, r AS (SELECT {KEY}, date, coalesce(date_diff('day', max(pdate), date), 7) AS rd, count(CASE WHEN pdate >= date - INTERVAL 7 DAY THEN 1 END) AS g7, count(CASE WHEN pdate >= date - INTERVAL 14 DAY THEN 1 END) AS g14 FROM past GROUP BY {KEY}, date),
 s AS (SELECT *, CAST(least(CASE WHEN rd <= 1 THEN 30 ELSE 0 END + greatest(g7 - 2, 0) * 10 + greatest(g14 - 5, 0) * 5, 100) AS BIGINT) AS fatigue_score FROM r)
 SELECT {KEY}, fatigue_score, CASE WHEN fatigue_score >= 50 THEN 'high' WHEN fatigue_score >= 20 THEN 'medium' ELSE 'low' END AS fatigue_level FROM s""",
)
def _(t):
    return asof.fatigue(t.games).select("game_id", "team_id", "is_home", "fatigue_score", "fatigue_level")


@query("i13_team_players", "WITH d AS (SELECT DISTINCT team_id, date FROM player_stats), p AS (SELECT d.team_id, d.date, s.player_id, sum(s.pts) AS pts, count(s.pts) AS n FROM d LEFT JOIN player_stats s ON s.team_id = d.team_id AND s.date < d.date GROUP BY 1, 2, 3) SELECT team_id, date, round(coalesce(sum(pts) / nullif(sum(n), 0), 0), 6) AS ppr, round(coalesce(max(pts) / nullif(sum(pts), 0), 0), 6) AS top_share, count(player_id) AS roster FROM p GROUP BY 1, 2")
def _(t):
    return rounded(asof.team_players(t.player_stats))


@query(
    "i17_scoring",
    f"""WITH {PAST}, a AS (SELECT {KEY}, avg(CASE WHEN k <= 5 THEN pf END) AS l5, sum(pf) AS f, sum(pa) AS a, avg(win) AS pct, stddev_samp(pf - pa) AS v, avg(pf + pa) AS tp, avg(CASE WHEN abs(pf - pa) <= 5 THEN win END) AS c FROM past WHERE k <= 10 GROUP BY {KEY}),
 b AS (SELECT *, CASE WHEN f > 0 THEN 1 / (1 + pow(a / f, 13.91)) END AS py FROM a)
 SELECT {KEY}, round(coalesce(l5, 0), 6) AS last5_ppg, round(coalesce(py, 0.5), 6) AS pythagorean, round(coalesce(pct - py, 0), 6) + 0.0 AS luck, round(coalesce(v, 0), 6) AS volatility, round(coalesce(tp, 0), 6) AS total_points, round(coalesce(c, 0.5), 6) AS close_win_pct FROM b""",
)
def _(t):
    return rounded(asof.scoring(t.games))


@query("i18_trend_slope", f"WITH {PAST} SELECT {KEY}, round(CASE WHEN count(pg) > 1 THEN regr_slope(pf - pa, CAST(-k AS DOUBLE)) ELSE 0 END, 6) + 0.0 AS slope FROM past WHERE k <= 10 GROUP BY {KEY}")
def _(t):
    return rounded(asof.trend_slope(t.games))


@query("i20_short_trend", f"WITH {PAST} SELECT {KEY}, round(coalesce(avg(CASE WHEN k <= 3 THEN pf - pa END) - avg(CASE WHEN k > 3 THEN pf - pa END), 0), 6) + 0.0 AS trend FROM past WHERE k <= 10 GROUP BY {KEY}")
def _(t):
    return rounded(asof.short_trend(t.games))


@query(
    "i21_quality_form",
    f"""WITH {PAST}, o AS (SELECT p.game_id, p.team_id, p.is_home, p.pg, p.win, p.pf - p.pa AS m, q.win AS ow, q.pf - q.pa AS om, row_number() OVER (PARTITION BY p.game_id, p.team_id, p.is_home, p.pg ORDER BY q.date DESC, q.game_id DESC) AS j
  FROM past p LEFT JOIN w q ON q.team_id = p.popp AND q.completed AND q.date < p.date WHERE p.k <= 10),
 s AS (SELECT {KEY}, pg, any_value(win) AS win, any_value(m) AS m, avg(ow) AS op, avg(om) AS om FROM o WHERE j <= 20 GROUP BY {KEY}, pg)
 SELECT {KEY}, round(coalesce(avg(CASE WHEN pg IS NOT NULL THEN (2 * win - 1) * coalesce(op, 0.5) END), 0), 6) + 0.0 AS quality_form, round(coalesce(avg(CASE WHEN pg IS NOT NULL THEN coalesce(op, 0.5) END), 0.5), 6) AS schedule_strength,
  round(coalesce(avg(CASE WHEN pg IS NOT NULL THEN m + coalesce(om, 0) END), 0), 6) + 0.0 AS adjusted_margin FROM s GROUP BY {KEY}""",
)
def _(t):
    return rounded(asof.quality_form(t.games))


@query(
    "i23_tier_form",
    f"""WITH {TG}, w AS (SELECT *, {WIN} AS win FROM tg WHERE completed), p AS (SELECT season, w.team_id, avg(win) AS pct, any_value(conference) AS conference FROM w JOIN teams t ON w.team_id = t.team_id GROUP BY 1, 2),
 n AS (SELECT season, team_id, ntile(3) OVER (PARTITION BY season, conference ORDER BY pct DESC, team_id) AS third FROM p)
 SELECT w.season, w.team_id, round(avg(CASE WHEN third = 1 THEN win END), 6) AS vs_top, round(avg(CASE WHEN third = 2 THEN win END), 6) AS vs_middle, round(avg(CASE WHEN third = 3 THEN win END), 6) AS vs_bottom, count(*) AS games FROM w JOIN n ON w.season = n.season AND w.opp_id = n.team_id GROUP BY 1, 2""",
)
def _(t):
    return rounded(asof.tier_form(t.games, t.teams))


@query(
    "i24_stars",
    "WITH d AS (SELECT *, dense_rank() OVER (PARTITION BY season, team_id ORDER BY date DESC, game_id DESC) AS g FROM player_stats), a AS (SELECT season, team_id, player_id, sum(minutes) AS minutes, sum(pts) AS pts FROM d WHERE g <= 10 GROUP BY 1, 2, 3) SELECT season, team_id, CAST(row_number() OVER (PARTITION BY season, team_id ORDER BY minutes DESC, player_id) AS INT) AS star, player_id, minutes, round(pts / minutes, 6) AS per_minute FROM a QUALIFY star <= 3",
)
def _(t):
    return rounded(asof.stars(t.player_stats))


@query(
    "i24_star_absence",
    """WITH d AS (SELECT *, dense_rank() OVER (PARTITION BY season, team_id ORDER BY date DESC, game_id DESC) AS g FROM player_stats), a AS (SELECT season, team_id, player_id, sum(minutes) AS m FROM d WHERE g <= 10 GROUP BY 1, 2, 3),
 s AS (SELECT season, team_id, player_id FROM a QUALIFY row_number() OVER (PARTITION BY season, team_id ORDER BY m DESC, player_id) <= 3)
 SELECT g.game_id, s.player_id, s.season, s.team_id FROM (SELECT DISTINCT season, team_id, game_id FROM player_stats) g JOIN s ON g.season = s.season AND g.team_id = s.team_id WHERE (g.game_id, s.player_id) NOT IN (SELECT (game_id, player_id) FROM player_stats)""",
)
def _(t):
    return asof.star_absence(t.player_stats, asof.stars(t.player_stats)).select("game_id", "player_id", "season", "team_id")


@query("i26_player_state", "WITH p AS (SELECT t.player_id, t.game_id, t.seq, p.pts, p.reb, row_number() OVER (PARTITION BY t.player_id, t.game_id, t.seq ORDER BY p.date DESC, p.game_id DESC, p.seq DESC, p.pts DESC, p.reb DESC) AS k FROM (SELECT DISTINCT player_id, game_id, seq, date FROM player_stats) t LEFT JOIN player_stats p ON p.player_id = t.player_id AND p.date < t.date) SELECT player_id, game_id, seq, round(avg(pts), 6) AS avg_pts, round(avg(reb), 6) AS avg_reb, count(pts) AS n FROM p WHERE k <= 10 GROUP BY 1, 2, 3")
def _(t):
    d = asof.player_state(t.player_stats, ["pts", "reb"])
    return rounded(d.select("player_id", "game_id", "seq", "avg_pts", "avg_reb", F.coalesce("n_games", F.lit(0)).alias("n")).distinct())


@query(
    "i28_series_number",
    "WITH d AS (SELECT game_id, date, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi FROM games), c AS (SELECT *, CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY lo, hi ORDER BY date, game_id), date) <= 6 THEN 0 ELSE 1 END AS n FROM d), s AS (SELECT *, sum(n) OVER (PARTITION BY lo, hi ORDER BY date, game_id) AS g FROM c) SELECT game_id, lo, hi, CAST(row_number() OVER (PARTITION BY lo, hi, g ORDER BY date, game_id) AS INT) AS series_game FROM s",
)
def _(t):
    return asof.series_number(t.games)


@query(
    "i35_hero_rates",
    """WITH p AS (SELECT l_orderkey AS game_id, CASE WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS side, l_partkey % 40 AS hero, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_custkey % 2 = l_linenumber % 2 THEN 1 ELSE 0 END AS win FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 d AS (SELECT hero, date, sum(win) AS w, count(*) AS n FROM p GROUP BY 1, 2), c AS (SELECT hero, date, coalesce(sum(w) OVER x, 0) AS w, coalesce(sum(n) OVER x, 0) AS n FROM d WINDOW x AS (PARTITION BY hero ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 r AS (SELECT game_id, side, CASE WHEN n >= 5 THEN c.w / n ELSE 0.5 END AS r FROM p JOIN c ON p.hero = c.hero AND p.date = c.date)
 SELECT game_id, side, round(sum(r), 6) AS sum_rate, round(avg(r), 6) AS avg_rate, round(max(r), 6) AS best, round(min(r), 6) AS worst FROM r GROUP BY 1, 2""",
)
def _(t):
    d = t.base("lineitem").join(t.base("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = d.select(F.col("l_orderkey").alias("game_id"), F.when(F.col("l_linenumber") % 2 == 0, "home").otherwise("away").alias("side"), (F.col("l_partkey") % 40).alias("hero"), F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 2 == F.col("l_linenumber") % 2).cast("int").alias("win"))
    return rounded(asof.hero_rates(p))


@query(
    "i38_defence_allowed",
    f"""WITH {TG}, m AS (SELECT game_id, team_id AS opp_id, sum(pts) AS allowed FROM player_stats GROUP BY 1, 2), d AS (SELECT t.game_id, t.team_id, t.is_home, t.date, m.allowed FROM tg t LEFT JOIN m ON m.game_id = t.game_id AND m.opp_id = t.opp_id),
 p AS (SELECT t.game_id, t.team_id, t.is_home, q.allowed, row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home ORDER BY q.date DESC, q.game_id DESC) AS k FROM d t LEFT JOIN d q ON q.team_id = t.team_id AND q.allowed IS NOT NULL AND q.date < t.date)
 SELECT {KEY}, round(coalesce(avg(allowed), 0), 6) AS allowed_avg FROM p WHERE k <= 10 GROUP BY {KEY}""",
)
def _(t):
    return rounded(asof.defence_allowed(t.player_stats, t.games))


@query(
    "i12_streak",
    f"""WITH {TG}, f AS (SELECT team_id, game_id, date, {WIN} AS win FROM tg WHERE completed), c AS (SELECT *, CASE WHEN lag(win) OVER (PARTITION BY team_id ORDER BY date, game_id) = win THEN 0 ELSE 1 END AS ch FROM f), g AS (SELECT *, sum(ch) OVER (PARTITION BY team_id ORDER BY date, game_id) AS grp FROM c),
 n AS (SELECT *, CASE WHEN win = 1 THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY team_id, grp ORDER BY date, game_id) AS run FROM g)
 SELECT t.game_id, t.team_id, t.is_home, CAST(coalesce(arg_max(n.run, (n.date, n.game_id)), 0) AS INT) AS streak FROM tg t LEFT JOIN n ON n.team_id = t.team_id AND n.date < t.date GROUP BY 1, 2, 3""",
)
def _(t):
    return asof.current_streak(t.games)


@query(
    "i16_period_features",
    f"""WITH {TG}, p AS (SELECT game_id, team_id, is_home, date, completed, {WIN} AS win, floor(pf * 0.25) + game_id % 3 - (floor(pa * 0.25) + team_id % 3) AS first, floor(pf * 0.25) + game_id % 3 + floor(pf * 0.3) - (floor(pa * 0.25) + team_id % 3 + floor(pa * 0.3)) AS half FROM tg),
 q AS (SELECT t.game_id, t.team_id, t.is_home, p.first, p.half, p.win, p.game_id AS pg, row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home ORDER BY p.date DESC, p.game_id DESC) AS k FROM p t LEFT JOIN p ON p.team_id = t.team_id AND p.completed AND p.date < t.date)
 SELECT {KEY}, round(coalesce(avg(first), 0), 6) + 0.0 AS first_period, round(coalesce(avg(half), 0), 6) + 0.0 AS first_half, round(coalesce(avg(CASE WHEN pg IS NOT NULL THEN CASE WHEN half < 0 AND win = 1 THEN 1.0 ELSE 0.0 END END), 0), 6) AS comeback_rate FROM q WHERE k <= 10 GROUP BY {KEY}""",
)
def _(t):
    part = lambda x, k: F.array(F.floor(F.col(x) * 0.25) + F.col(k) % 3, F.floor(F.col(x) * 0.3), F.floor(F.col(x) * 0.2), F.floor(F.col(x) * 0.25)).cast("array<double>")
    tg = G.team_games(t.games).withColumn("mine", part("pf", "game_id")).withColumn("theirs", part("pa", "team_id"))
    return rounded(asof.period_features(tg).drop("overtime_rate"))


@query(
    "i_wide_deltas",
    f"WITH {PAST}, f AS (SELECT {KEY}, coalesce(avg(win), 0) AS v FROM past WHERE k <= 10 GROUP BY {KEY}) SELECT g.game_id, round(h.v, 6) AS home_form_win_pct, round(a.v, 6) AS away_form_win_pct, round(h.v - a.v, 6) + 0.0 AS delta_form_win_pct FROM games g JOIN f h ON h.game_id = g.game_id AND h.is_home JOIN f a ON a.game_id = g.game_id AND NOT a.is_home",
)
def _(t):
    return rounded(asof.wide(t.games, asof.form(t.games).select("game_id", "team_id", "is_home", "form_win_pct")).select("game_id", "home_form_win_pct", "away_form_win_pct", "delta_form_win_pct"))


def _family(name: str):
    family = families.FAMILIES[name]
    cols = families.oracle_columns(family)
    sql = f"""WITH d AS ({families.SOURCE_SQL}), past AS (SELECT t.game_id, t.entity_id, p.game_id AS pg, {', '.join(f'p.{c}' for c in families.STATS)}, row_number() OVER (PARTITION BY t.game_id, t.entity_id ORDER BY p.date DESC, p.game_id DESC) AS k
 FROM d t LEFT JOIN d p ON p.entity_id = t.entity_id AND p.date < t.date) SELECT game_id, entity_id, {cols} FROM past GROUP BY game_id, entity_id"""

    @query(f"i_family_{name}", sql)
    def _(t):
        return rounded(families.compute(families.source(t), family))


for _name in families.FAMILIES:
    _family(_name)
