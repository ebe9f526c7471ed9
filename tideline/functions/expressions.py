"""Factor formulas as Column builders: ``$col`` names and sixteen operators over an ordered key.

``evaluate("Mean($close, 5) / Ref($close, 1) - 1", df, frame)`` is read by Spark SQL itself: operator
calls become temporary columns, innermost first, and the remaining arithmetic goes to ``expr``. Column
names are checked against the frame, unknown functions fail in Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.frames import Frame, sign
from tideline.functions.smoothing import ewm_span

Builder = Callable[..., Column]


def _wma(f: Frame, x: str, n: int) -> Column:
    """Linear weights, newest heaviest; a short window at the start is renormalised."""
    w = f.last_rows(n)
    k = F.count(F.lit(1)).over(w)
    terms = F.collect_list(F.struct(F.col("_rn").alias("r"), F.col(x).alias("v"))).over(w)
    pos = lambda s: s["r"] - F.col("_rn") + k
    num = F.aggregate(terms, F.lit(0.0), lambda a, s: a + s["v"] * pos(s))
    return num / (k * (k + 1) / 2.0)


BUILDERS: dict[str, Builder] = {
    "Ref": lambda f, x, n: f.lag(x, n),
    "Delta": lambda f, x, n: f.diff(x, n),
    "Mean": lambda f, x, n: f.mean(x, n, 1),
    "Std": lambda f, x, n: f.std(x, n, 1),
    "WMA": _wma,
    "Max": lambda f, x, n: f.max(x, n, 1),
    "Min": lambda f, x, n: f.min(x, n, 1),
    "Corr": lambda f, a, b, n: f.corr(a, b, n),
    "Slope": lambda f, x, n: f.slope(x, "_rn", n, 2),
    "Skew": lambda f, x, n: f.moments(x, n)[0],
    "Kurt": lambda f, x, n: f.moments(x, n)[1],
    "Abs": lambda f, x: F.abs(x),
    "Sign": lambda f, x: sign(x),
    "Log": lambda f, x: F.log(F.greatest(F.col(x), F.lit(1e-10))),
}


def _rank(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Percent rank with average ties of the group."""
    from tideline.plans.segments import group_rank

    return group_rank(df, keys, x).withColumn(out, F.col("rank_avg") / F.col("group_n")).drop("rank_avg", "rank_min", "group_n")


def columns_of(expression: str) -> set[str]:
    return set(re.findall(r"\$([A-Za-z_]\w*)", expression))


def check_columns(expression: str, allowed: set[str]) -> None:
    unknown = columns_of(expression) - allowed
    if unknown:
        raise ValueError(f"columns not allowed: {sorted(unknown)}")


_CALL = re.compile(r"\b(EMA|RankTs|RankCs|Rank|" + "|".join(BUILDERS) + r")\(([^()]*)\)")


def evaluate(expression: str, df: DataFrame, frame: Frame, out: str = "factor") -> DataFrame:
    """Add ``out``. ``Rank``/``RankTs`` rank over the key's history, ``RankCs`` over one timestamp."""
    check_columns(expression, set(df.columns))
    text = re.sub(r"\$([A-Za-z_]\w*)", r"\1", expression)
    df = df.withColumn("_rn", frame.rn())
    temps = ["_rn"]
    plain = re.compile(r"(?<!\w)\(([^()]*)\)")
    while True:
        hit = _CALL.search(text)
        if hit is None:
            inner = plain.search(text)
            if inner is None or not re.search(r"\b(EMA|RankTs|RankCs|Rank|" + "|".join(BUILDERS) + r")\(", text):
                break
            name = f"_x{len(temps)}"
            df = df.withColumn(name, F.expr(inner.group(1)))
            temps.append(name)
            text = text[: inner.start()] + name + text[inner.end() :]
            continue
        fn, args = hit.group(1), [a.strip() for a in hit.group(2).split(",")]
        numbers = [int(a) for a in args if re.fullmatch(r"\d+", a)]
        cols = []
        for a in args:
            if not re.fullmatch(r"\d+", a):
                c = f"_x{len(temps)}"
                df = df.withColumn(c, F.expr(a).cast("double"))
                temps.append(c)
                cols.append(c)
        name = f"_x{len(temps)}"
        temps.append(name)
        if fn == "EMA":
            df = ewm_span(df, frame, cols[0], {name: numbers[0]})
        elif fn in ("Rank", "RankTs", "RankCs"):
            df = _rank(df, [frame.order[0]] if fn == "RankCs" else list(frame.keys), cols[0], name)
        else:
            df = df.withColumn(name, BUILDERS[fn](frame, *cols, *numbers))
        text = text[: hit.start()] + name + text[hit.end() :]
    return df.withColumn(out, F.expr(text)).drop(*temps)
