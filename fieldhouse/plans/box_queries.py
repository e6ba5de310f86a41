"""Rolling box-score features as registered queries. The SQL joins every row with its team's earlier games and adds them up there."""

from __future__ import annotations

from ..features import boxscores as B
from .registry import query
from .table_queries import rounded

_PRIMES = [3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101, 103, 107, 109, 113, 127, 131, 137, 139, 149]


def box_sql(family: B.Family, orders: str = "{orders}") -> str:
    """A box score of the sport for every order: numbers of the order's price, some missing, none before a game is final."""
    def stat(i: int, side: int, x: str) -> str:
        high = 8 if x in ("s1", "s2", "s3", "s4", "s5") else 4 if x == "prestige" else 180 if x == "ranking" else 5 if x in ("score", "h1", "h2") or x[0] in "qpi" and x[1:].isdigit() else 3 if x in ("ot", "extras", "red_cards", "first_objective") else 9 + 7 * (i % 5)
        value = f"CAST(CAST(floor(o_totalprice / {_PRIMES[i] + side * 2}) AS BIGINT) % {high} AS DOUBLE)"
        missing = "o_orderkey % 6 <> 0" if x == "ot" else f"(o_orderkey + {i}) % 13 = 0" if x != "score" else "FALSE"
        return f"CASE WHEN o_orderstatus = 'F' AND NOT ({missing}) THEN {value} END AS {'away' if side else 'home'}_{x}"

    columns = ", ".join(stat(i, side, x) for side in (0, 1) for i, x in enumerate(family.stats))
    return f"SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS date, o_custkey AS home_team_id, o_custkey + 1 + (o_orderkey % 7) AS away_team_id, {columns} FROM {orders}"


def oracle(family: B.Family) -> str:
    side = lambda me, they: f"SELECT game_id, date, {me}_team_id AS team_id, {me == 'home'} AS is_home, " + ", ".join(f"{me}_{x} AS m_{x}, {they}_{x} AS o_{x}" for x in family.stats) + " FROM box"
    derived = "".join(f", {e} AS m_{k}" for k, e in family.derived.items())

    def column(kind: str, n: int, x: str) -> str:
        c = f"{'o' if kind in ('op', 'avgop', 'posop') else 'm'}_{x}"
        inside = f"CASE WHEN k <= {n} THEN {{}} END"
        e = {"games": f"nullif(count(CASE WHEN k <= {n} AND pg IS NOT NULL THEN 1 END), 0)", "my": f"sum({inside.format(f'coalesce({c}, 0)')})", "op": f"sum({inside.format(f'coalesce({c}, 0)')})", "sd": f"stddev_pop({inside.format(c)})"}
        mean = f"avg({inside.format(f'CASE WHEN {c} > 0 THEN {c} END' if kind.startswith('pos') else c)})"
        return f"{e.get(kind, mean)} AS {kind}{n}_{x}"

    most = max(n for _, n, _ in B.needs(family))
    alike = "".join(f" AND p.m_{x} = t.m_{x}" for x in family.within)
    values = ", ".join(f"round(coalesce({B.compiled(w, f)[0]}, {d}), 8) + 0.0 AS {name}" for name, (w, f, d) in family.features.items())
    names = ", ".join(f"p.m_{x}, p.o_{x}" for x in family.stats) + "".join(f", p.m_{k}" for k in family.derived)
    return f"""WITH box AS ({box_sql(family, "orders")}), t AS (SELECT *{derived} FROM ({side("home", "away")} UNION ALL {side("away", "home")}) u),
 past AS (SELECT t.game_id, t.team_id, t.is_home, p.game_id AS pg, {names}, row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home ORDER BY p.date DESC, p.game_id DESC) AS k
  FROM t LEFT JOIN t p ON p.team_id = t.team_id AND p.m_score IS NOT NULL AND p.o_score IS NOT NULL AND p.date < t.date{alike} QUALIFY k <= {most}),
 s AS (SELECT game_id, team_id, is_home, {", ".join(column(*x) for x in B.needs(family))} FROM past GROUP BY 1, 2, 3)
 SELECT game_id, team_id, is_home, {values} FROM s"""


def _register(name: str, number: str, family: B.Family) -> None:
    @query(f"{number}_{name}_box", oracle(family))
    def _(t):
        return rounded(B.box_features(t.spark.sql(box_sql(family), orders=t.base("orders")), family), 8)  # products of two ratios of 16 have eight decimals: no ties


for _name, _number in (("basketball", "i19"), ("baseball", "i27"), ("hockey", "i29"), ("football", "i30"), ("soccer", "i31"), ("esports", "i34"), ("tennis", "i32"), ("tennis_prestige", "i32"), ("combat", "i33")):
    _register(_name, _number, B.FAMILIES[_name])
for _name, _family in B.SCHEMES.items():
    _register(f"period_{_name}", "i16", _family)
_register("last_five", "i15", B.LAST_FIVE)
