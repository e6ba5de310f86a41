"""Scalar expressions; every function takes and returns Columns (names or Columns)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = "Column | str"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- odds and stakes


def american_to_decimal(o) -> Column:
    """Decimal price; quotes inside (-100, 100) carry no price and count as even money."""
    o = col(o)
    return F.when(F.abs(o) < 100, F.lit(2.0)).when(o > 0, 1 + o / 100).otherwise(1 + 100 / F.abs(o))


def american_to_implied(o, zero: float = 0.5) -> Column:
    """Implied probability; quotes inside (-100, 100) give ``zero``."""
    o = col(o)
    return F.when(F.abs(o) < 100, F.lit(zero)).when(o > 0, 100 / (o + 100)).otherwise(F.abs(o) / (F.abs(o) + 100))


def moneyline_probability(o) -> Column:
    """Implied probability where only an exact zero is no quote."""
    o = col(o)
    return F.when(o == 0, F.lit(0.5)).when(o > 0, 100 / (o + 100)).otherwise(F.abs(o) / (F.abs(o) + 100))


def decimal_to_american(d) -> Column:
    d = col(d)
    return F.when(d >= 2, (d - 1) * 100).when(d > 1, -100 / F.when(d > 1, d - 1))


def decimal_to_implied(d) -> Column:
    d = col(d)
    return F.when(d > 0, 1 / F.when(d > 0, d)).otherwise(0.0)


def profit(stake, odds) -> Column:
    """Winnings above the stake at an American price."""
    stake, odds = col(stake), col(odds)
    return F.when(odds > 0, stake * odds / 100).when(odds < 0, stake * 100 / F.abs(odds)).otherwise(0.0)


def fair_payout(p, stake: float = 100.0) -> Column:
    """Total return of a fair bet, the probability held within [0.01, 0.99]."""
    return F.lit(stake) / F.greatest(F.least(col(p), F.lit(0.99)), F.lit(0.01))


def kelly(p, decimal, fraction=0.25, most: float = 0.05) -> Column:
    """Share of bankroll, a fraction of Kelly's, within [0, most]."""
    p, b = col(p), col(decimal) - 1
    full = F.when(b > 0, (b * p - (1 - p)) / F.when(b > 0, b)).otherwise(0.0)
    return F.least(F.greatest(full * fraction, F.lit(0.0)), F.lit(most))


def expected_value(p, decimal) -> Column:
    """Expected profit of one unit."""
    p, decimal = col(p), col(decimal)
    return p * (decimal - 1) - (1 - p)


def edge(p, implied) -> Column:
    return col(p) - col(implied)


def spread_cover(p, spread, scale: float = 0.03) -> Column:
    """Chance to cover a spread: the win probability moved by ``scale`` a point, within [0.05, 0.95]."""
    return F.least(F.greatest(col(p) + col(spread) * scale, F.lit(0.05)), F.lit(0.95))


def grade(confidence) -> Column:
    """Letter grades at 0.75, 0.65, 0.58 and 0.52."""
    c = col(confidence)
    return F.when(c >= 0.75, "S").when(c >= 0.65, "A").when(c >= 0.58, "B").when(c >= 0.52, "C").otherwise("D")


def tier(confidence) -> Column:
    c = col(confidence)
    return F.when(c >= 0.7, "high").when(c >= 0.55, "medium").otherwise("low")


def confidence_band(confidence) -> Column:
    """Five bands of width 0.1 from 0.5."""
    c = col(confidence)
    return F.when(c >= 0.9, "90+").when(c >= 0.8, "80-90").when(c >= 0.7, "70-80").when(c >= 0.6, "60-70").otherwise("<60")


# ---------------------------------------------------------------- text, dates, records

#: fixed values: letters with marks, and the plain letters for them
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēėęěğīįıłńņňōőřśşšťţūůűųźżž"
PLAIN_ = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeeegiiilnnnoorsssttuuuuzzz"


def fold(name) -> Column:
    """Lower case, without marks on Latin letters, trimmed."""
    return F.trim(F.translate(F.lower(col(name)), MARKED, PLAIN_))


def snake(name) -> Column:
    spaced = F.regexp_replace(col(name), "([a-z0-9])([A-Z])", "$1_$2")
    return F.trim(F.regexp_replace(F.lower(spaced), "[^a-z0-9]+", "_"), F.lit("_"))


def last_first(name) -> Column:
    """``Last, First`` as ``First Last``."""
    n = col(name)
    parts = F.split(n, r",\s*", 2)
    return F.when(n.contains(","), F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(n)


def iso_minutes(text) -> Column:
    """Minutes of ``PT32M15.00S``."""
    t = col(text)
    part = lambda unit: F.coalesce(F.regexp_extract(t, rf"([\d.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(t.rlike(r"^PT"), part("H") * 60 + part("M") + part("S") / 60)


def clock_seconds(text) -> Column:
    """Seconds of ``MM:SS``."""
    t = col(text)
    m, s = F.regexp_extract(t, r"^(\d+):(\d+)", 1).try_cast("int"), F.regexp_extract(t, r"^(\d+):(\d+)", 2).try_cast("int")
    return m * 60 + s


def innings(text) -> Column:
    """Innings pitched as thirds: ``6.1`` is 6 1/3."""
    v = col(text).cast("double")
    whole = F.floor(v)
    return whole + F.round((v - whole) * 10) / 3


def record_part(record, i: int) -> Column:
    """The i-th number of ``W-L`` or ``W-L-T``; null if it isn't there."""
    return F.get(F.split(col(record), "-"), F.lit(i)).try_cast("int")


def streak(text) -> Column:
    """``W5`` as 5, ``L2`` as -2."""
    t = F.upper(F.trim(col(text)))
    n = F.regexp_extract(t, r"(\d+)", 1).try_cast("int")
    return F.when(t.startswith("L"), -n).otherwise(n)


def season_of(date, first_month: int = 1, label: str = "start") -> Column:
    """Season label of a date for a league whose season begins in ``first_month``."""
    d = col(date)
    start = F.year(d) - F.when(F.month(d) < first_month, 1).otherwise(0)
    return (start + (1 if label == "end" and first_month > 1 else 0)).cast("long")


def over_line(prop) -> Column:
    return F.regexp_extract(col(prop), r"_over_(\d+)", 1).try_cast("int")


#: fixed values: the sixteen points of the compass, from north
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def compass(degrees) -> Column:
    point = F.pmod(F.floor((col(degrees) + 11.25) / 22.5), F.lit(16)).cast("int")
    return F.get(F.array(*map(F.lit, COMPASS)), point)


def weather(text) -> tuple[Column, Column, Column]:
    """(temperature, wind speed, dome) of a line such as ``72 degrees, wind 8 mph, dome closed``."""
    t = F.lower(col(text))
    return (
        F.regexp_extract(t, r"(-?\d+)\s*(?:deg|°|f\b)", 1).try_cast("double"),
        F.regexp_extract(t, r"(\d+)\s*mph", 1).try_cast("double"),
        t.rlike("dome|roof closed|indoor"),
    )


def surface(venue) -> Column:
    """Court surface from a tournament's name."""
    v = F.lower(col(venue))
    return F.when(v.rlike("wimbledon|halle|queen|grass"), "grass").when(v.rlike("roland|clay|rome|madrid|monte"), "clay").otherwise("hard")


def is_clean(x) -> Column:
    """The number, with NaN and infinities as null."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


# ---------------------------------------------------------------- probabilities and losses


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit(p, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (1 - p))


def erf(x) -> Column:
    """Error function by a rational approximation with error under 1.5e-7."""
    x = col(x)
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_over(line, mean, std) -> Column:
    """P(X > line) of a normal variable."""
    z = (col(line) - col(mean)) / F.greatest(col(std), F.lit(1e-6))
    return 0.5 * (1 - erf(z / math.sqrt(2)))


def poisson_over(line, mean) -> Column:
    """P(X > line) of a Poisson variable with a mean above zero; the terms up to the line are added as nested products, innermost first."""
    mean, n = F.greatest(col(mean), F.lit(1e-9)), F.floor(col(line)).cast("int")
    nested = F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), F.lit(0.0), lambda a, k: 1 + a * mean / (n - k + 1))
    # at means of over some 700 the factor is 0 and the product may be infinite
    below = F.nanvl(F.exp(-mean) * nested, F.lit(0.0))
    return F.when(n < 0, 1.0).otherwise(F.greatest(1 - below, F.lit(0.0)))


def poisson_at(k, mean) -> Column:
    """P(X = k) of a Poisson variable with a mean above zero, for whole k of at least 0."""
    mean, k = F.greatest(col(mean), F.lit(1e-9)), col(k)
    factors = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(mean / i))
    return F.exp(F.when(k > 0, factors).otherwise(0.0) - mean)


def brier(p, outcome) -> Column:
    d = col(p) - col(outcome)
    return d * d


def log_loss(p, outcome, eps: float = 1e-9) -> Column:
    p = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    y = col(outcome)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def vote_confidence(probability, consensus) -> Column:
    """Margin from a half times the share of models that agree, within [0.5, 0.99]."""
    return F.least(F.greatest(0.5 + F.abs(col(probability) - 0.5) * col(consensus), F.lit(0.5)), F.lit(0.99))


# ---------------------------------------------------------------- box-score rates


def ratio(a, b, default: float | None = 0.0) -> Column:
    """a / b, or the default where b is not above zero."""
    a, b = col(a), col(b)
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(default).cast("double"))


def effective_fg(fgm, fg3m, fga) -> Column:
    return ratio(col(fgm) + 0.5 * col(fg3m), fga)


def true_shooting(pts, fga, fta) -> Column:
    return ratio(pts, 2 * (col(fga) + 0.44 * col(fta)))


def possessions(fga, orb, tov, fta) -> Column:
    return col(fga) - col(orb) + col(tov) + 0.44 * col(fta)


def batting_line(ab, h, doubles, triples, hr, bb, hbp, sh, sf) -> dict[str, Column]:
    """PA, total bases, average, on-base, slugging and their sum."""
    ab, h, d, t, hr, bb, hbp, sh, sf = map(col, (ab, h, doubles, triples, hr, bb, hbp, sh, sf))
    tb = h + d + 2 * t + 3 * hr
    obp, slg = ratio(h + bb + hbp, ab + bb + hbp + sf), ratio(tb, ab)
    return {"pa": ab + bb + hbp + sh + sf, "total_bases": tb, "avg": ratio(h, ab), "obp": obp, "slg": slg, "ops": obp + slg}


def pitching_line(ip, er, h, bb, so) -> dict[str, Column]:
    ip, er, h, bb, so = map(col, (ip, er, h, bb, so))
    return {"era": ratio(9 * er, ip), "whip": ratio(h + bb, ip), "k9": ratio(9 * so, ip)}
