"""Registry and the shared column spec of a query and its SQL twin.

A spec token is ``name`` (as is), ``name:4`` (double rounded to 4 places), ``name#`` (bigint),
``name@`` (string) or ``name!`` (date). Both sides are projected through the same spec. Before rounding,
0.137 of the last place is added: means of cents often lie exactly on a rounding edge, where the last
bit of each engine's sum would decide.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import prepare

Program = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Program
    sql: str | None


REGISTRY: dict[str, Query] = {}


def shift(digits: str) -> float:
    return 0.137 * 10.0 ** -int(digits)


def project(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for token in spec.split():
        if ":" in token:
            name, digits = token.split(":")
            cols.append(F.round(F.col(name).cast("double") + shift(digits), int(digits)).alias(name))
        elif token.endswith("#"):
            cols.append(F.col(token[:-1]).cast("bigint").alias(token[:-1]))
        elif token.endswith("@"):
            cols.append(F.col(token[:-1]).cast("string").alias(token[:-1]))
        elif token.endswith("!"):
            cols.append(F.col(token[:-1]).cast("date").alias(token[:-1]))
        else:
            cols.append(F.col(token))
    return df.select(*cols)


def project_sql(body: str, spec: str, ctes: str = "") -> str:
    cols = []
    for token in spec.split():
        if ":" in token:
            name, digits = token.split(":")
            cols.append(f'round(CAST("{name}" AS DOUBLE) + {shift(digits)!r}, {digits}) + 0.0 AS "{name}"')
        elif token.endswith("#"):
            cols.append(f'CAST("{token[:-1]}" AS BIGINT) AS "{token[:-1]}"')
        elif token.endswith("@"):
            cols.append(f'CAST("{token[:-1]}" AS VARCHAR) AS "{token[:-1]}"')
        elif token.endswith("!"):
            cols.append(f'CAST("{token[:-1]}" AS DATE) AS "{token[:-1]}"')
        else:
            cols.append(f'"{token}"')
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({body}) AS result_rows"


def query(name: str, spec: str, sql: str | None = None, ctes: str = "") -> Callable[[Program], Program]:
    def add(fn: Program) -> Program:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        text = None if sql is None else project_sql(sql, spec, ctes)

        def run(spark: SparkSession, sf: str) -> DataFrame:
            prepare(spark)
            return project(fn(spark, sf), spec)

        REGISTRY[name] = Query(run, text)
        return fn

    return add


# --- SQL building blocks ---------------------------------------------------------------------------
TICKS = """ticks AS (SELECT CAST(c_nationkey AS BIGINT) AS id,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS venue_id, o_orderdate AS ts, o_totalprice AS price,
  o_orderkey AS ord FROM orders JOIN customer ON o_custkey = c_custkey)"""

_OHLC = """arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, ord) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(price) AS dollar"""

NB = TICKS + f""", bars0 AS (SELECT id, ts, {_OHLC} FROM ticks GROUP BY id, ts),
bars AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS rn FROM bars0)"""

VB = TICKS + f""", vbars AS (SELECT id, venue_id, ts, {_OHLC} FROM ticks GROUP BY id, venue_id, ts)"""

SB = """sticks AS (SELECT l_suppkey AS id, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
  l_quantity AS qty, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_quantity,
  e := l_extendedprice) AS ord FROM lineitem),
bars0 AS (SELECT id, ts, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, ord) AS close, sum(qty) AS volume, sum(price * qty) AS dollar FROM sticks GROUP BY id, ts),
bars AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS rn FROM bars0)"""

UB = f"""uticks AS (SELECT user_id AS id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, value AS price,
  struct_pack(a := ts, b := event_id) AS ord FROM events),
bars0 AS (SELECT id, ts, {_OHLC} FROM uticks GROUP BY id, ts),
bars AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS rn FROM bars0)"""

W = "(PARTITION BY id ORDER BY ts)"


def ro(agg: str, x: str, n: int, need: int | None = None, part: str = "id", order: str = "ts") -> str:
    """Rolling aggregate over the last n rows; NULL until ``need`` non-null inputs."""
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS {n - 1} PRECEDING)"
    call = agg.format(x=x) if "{x}" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) OVER {w} >= {n if need is None else need} THEN {call} OVER {w} END"


def lag(x: str, k: int = 1, part: str = "id", order: str = "ts") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order})"


def lead(x: str, k: int = 1, part: str = "id", order: str = "ts") -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order})"


def ema_cte(name: str, src: str, x: str, outs: dict[str, float], part: str = "id", order: str = "ts") -> str:
    """First-value seeded EMA by its closed sum over all earlier rows (brute force, no recursion)."""
    keys = [k.strip() for k in part.split(",")]
    on = " AND ".join(f"s.{k} = t.{k}" for k in keys)
    tk = ", ".join(f"t.{k}" for k in keys)
    cols = ", ".join(
        f"sum(CASE WHEN s.n = 1 THEN 1.0 ELSE {a!r} END * s.x * pow({1 - a!r}, t.n - s.n)) AS {o}"
        for o, a in outs.items()
    )
    inner = f"SELECT {part}, {order}, {x} AS x, count({x}) OVER (PARTITION BY {part} ORDER BY {order}) AS n FROM {src}"
    return (
        f"{name} AS (SELECT {tk}, t.{order}, {cols} FROM ({inner}) t JOIN (SELECT * FROM ({inner}) z "
        f"WHERE x IS NOT NULL) s ON {on} AND s.n <= t.n GROUP BY {tk}, t.{order})"
    )


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


def phi(x: str) -> str:
    """Normal CDF in SQL by its power series (fine for |x| < 8 at six places)."""
    series = (
        f"list_sum(list_transform(range(0, 140), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) "
        f"- lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    )
    return f"CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE 0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {series} END"
