"""Moving averages, indicators, volatility and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.functions.smoothing import ema_seeded, ewm_span
from tideline.operators import averages as A
from tideline.operators import bars as B
from tideline.operators import cycles as Y
from tideline.operators import indicators as I
from tideline.operators import volatility as V
from tideline.operators import returns as R
from tideline.plans import segments as S
from tideline.queries import bars as _bar_queries
from tideline.queries.base import NB, SB, TICKS, UB, W, ema_cte, lag, query, ro, span
from tideline.sources import market as M


def _nb(s, p):
    return M.nation_bars(s, p).select("id", "ts", "open", "high", "low", "close", "volume")


#: Features that are also registered on many keys: every supplier's and every user's daily bars.
WIDE = {
    "suppliers": ("ema_seeded_periods", "ema_span_first_seed", "rsi", "macd", "bollinger", "stochastic", "atr_simple", "adx", "range_volatility", "return_volatility", "ath_cycle"),
    "users": ("ema_span_first_seed", "stochastic", "obv"),
}
SOURCES = {"suppliers": (SB, M.supplier_bars), "users": (UB, M.user_day_bars)}


def feat(name, spec, op, sql, ctes=""):
    """Register a bar feature: op(df, frame) on nation bars against SQL over ``bars``; on wide tables too if listed."""
    query(name, "id ts " + spec, sql, NB + (", " + ctes if ctes else ""))(lambda s, p: op(_nb(s, p), Frame()))
    for kind, names in WIDE.items():
        if name in names:
            base, source = SOURCES[kind]
            query(f"{name}_{kind}", "id ts " + spec, sql, base + (", " + ctes if ctes else ""))(lambda s, p, _s=source: op(_s(s, p).select("id", "ts", "open", "high", "low", "close", "volume"), Frame()))


def seeded_cte(name, src, x, out, p, alpha=None, key="id"):
    """SMA-seeded EMA as one sum per row over the rows after the seed."""
    a = span(p) if alpha is None else alpha
    inner = f"""SELECT *, sum(CASE WHEN st AND x IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ts) AS n FROM (
      SELECT {key}, ts, st, CASE WHEN st AND NOT coalesce(lag(st) OVER (PARTITION BY {key} ORDER BY ts), false) THEN sma WHEN st THEN x END AS x FROM (
       SELECT {key}, ts, x, bool_or(fu) OVER (PARTITION BY {key} ORDER BY ts) AS st, sma FROM (
        SELECT {key}, ts, {x} AS x, count({x}) OVER q >= {p} AS fu, avg({x}) OVER q AS sma FROM {src}
        WINDOW q AS (PARTITION BY {key} ORDER BY ts ROWS {p - 1} PRECEDING))))"""
    on = " AND ".join(f"s.{k.strip()} = t.{k.strip()}" for k in key.split(","))
    tk = ", ".join(f"t.{k.strip()}" for k in key.split(","))
    return (
        f"{name} AS (SELECT {tk}, t.ts, sum(CASE WHEN s.n = 1 THEN 1.0 ELSE {a!r} END * s.x * pow({1 - a!r}, t.n - s.n)) AS {out} "
        f"FROM ({inner}) t LEFT JOIN (SELECT * FROM ({inner}) z WHERE x IS NOT NULL) s ON {on} AND s.n <= t.n AND t.n > 0 GROUP BY {tk}, t.ts)"
    )


# --- moving averages -------------------------------------------------------------------------------
feat("ema_seeded_periods", "close_ema_9:4 close_ema_21:4 close_ema_50:4",
     lambda d, f: A.add_emas(d, f, periods=(9, 21, 50)),
     "SELECT * FROM bars LEFT JOIN e9 USING (id, ts) LEFT JOIN e21 USING (id, ts) LEFT JOIN e50 USING (id, ts)",
     ", ".join(seeded_cte(f"e{p}", "bars", "close", f"close_ema_{p}", p) for p in (9, 21, 50)))
feat("ema_with_null_inputs", "e:4",
     lambda d, f: ema_seeded(d.withColumn("x", F.when(F.pmod(F.col("volume") + F.dayofmonth("ts"), F.lit(7)) != 0, F.col("close"))), f, "x", "e", A.span(5), 5),
     "SELECT * FROM bars LEFT JOIN e USING (id, ts)",
     "nx AS (SELECT *, CASE WHEN CAST(volume + day(ts) AS BIGINT) % 7 <> 0 THEN close END AS x FROM bars), " + seeded_cte("e", "nx", "x", "e", 5))
feat("ema_span_first_seed", "a:4 b:4 c:4", lambda d, f: ewm_span(d, f, "close", {"a": 4, "b": 30, "c": 200}),
     "SELECT * FROM e", ema_cte("e", "bars", "close", {"a": span(4), "b": span(30), "c": span(200)}))
feat("ema_horizon_d1_d2", "h:4 h_d1:4 h_d2:4 h_d1_bps:4",
     lambda d, f: A.scaled_differences(A.ema_by_horizon(d, f, "close", "h", 14), f, "h", "close"),
     f"""SELECT *, h_d1 / close * 10000 AS h_d1_bps FROM (SELECT *, h_d1 - {lag('h_d1')} AS h_d2 FROM (SELECT *, h - {lag('h')} AS h_d1 FROM bars LEFT JOIN e USING (id, ts)))""",
     seeded_cte("e", "bars", "close", "h", 14))
query("ema_periods_by_history", "id period# n_obs#",
      "SELECT id, period, n AS n_obs FROM (SELECT id, count(*) AS n FROM bars GROUP BY id) CROSS JOIN (SELECT unnest([9, 200, 640]) AS period) WHERE n >= period", NB,
      )(lambda s, p: A.periods_with_history(_nb(s, p), Frame(), (9, 200, 640)))

_TFE = """snap AS (SELECT b.*, n || 'D' AS tf, n AS tf_days, rn % n <> 0 AS roll, CASE WHEN rn % n = 0 THEN close END AS cc FROM bars b CROSS JOIN (SELECT unnest([2, 5]) AS n)),
 """ + seeded_cte("ce", "snap", "cc", "v", 3, key="id, tf") + """, ce2 AS (SELECT *, rank() OVER (PARTITION BY id, tf, roll ORDER BY ts) AS k FROM snap)"""
# the bar-space recursion counts canonical closes only
_CANON = """canon AS (SELECT *, row_number() OVER (PARTITION BY id, tf ORDER BY ts) AS k FROM snap WHERE NOT roll),
 cema AS (SELECT t.id, t.tf, t.ts, sum(CASE WHEN s.k = 3 THEN t3.m WHEN s.k > 3 THEN 0.5 * s.close ELSE 0 END * pow(0.5, t.k - s.k)) AS v
  FROM canon t JOIN canon s ON s.id = t.id AND s.tf = t.tf AND s.k <= t.k JOIN (SELECT id, tf, avg(close) AS m FROM canon WHERE k <= 3 GROUP BY id, tf) t3 ON t3.id = t.id AND t3.tf = t.tf
  WHERE t.k >= 3 GROUP BY ALL)"""
query("ema_timeframe_bar_space", "id tf ts period# roll ema_bar:4",
      """SELECT id, tf, ts, 3 AS period, roll, CASE WHEN NOT roll THEN v ELSE 0.5 * close + 0.5 * last_value(v IGNORE NULLS) OVER (PARTITION BY id, tf ORDER BY ts) END AS ema_bar
       FROM snap LEFT JOIN cema USING (id, tf, ts)""",
      NB + ", snap AS (SELECT b.*, n || 'D' AS tf, n AS tf_days, rn % n <> 0 AS roll FROM bars b CROSS JOIN (SELECT unnest([2, 5]) AS n)), " + _CANON,
      )(lambda s, p: A.timeframe_emas(B.count_snapshots(_nb(s, p), [2, 5]), {"2D": 2.0, "5D": 5.0}, (3,)))


def _tf_ema_sql(snap, days, periods=(3, 9), daily=True):
    """CTEs of both recursions as closed sums: canonical closes from a mean seed, then every row at the daily rate."""
    cases = " ".join(f"WHEN '{tf}' THEN {n!r}" for tf, n in days.items())
    head = f"""snap AS ({snap}), ps AS (SELECT unnest({list(periods)}) AS p), canon AS (SELECT *, row_number() OVER (PARTITION BY id, tf ORDER BY ts) AS k FROM snap WHERE NOT roll),
 sd AS (SELECT id, tf, p, avg(close) AS m FROM canon, ps WHERE k <= p GROUP BY ALL HAVING count(*) = p),
 ce AS (SELECT t.id, t.tf, t.ts, sd.p, sum(CASE WHEN s.k = sd.p THEN sd.m WHEN s.k > sd.p THEN 2.0 / (sd.p + 1) * s.close ELSE 0 END * pow(1 - 2.0 / (sd.p + 1), t.k - s.k)) AS v
  FROM sd JOIN canon t ON t.id = sd.id AND t.tf = sd.tf AND t.k >= sd.p JOIN canon s ON s.id = t.id AND s.tf = t.tf AND s.k <= t.k GROUP BY ALL),
 eb AS (SELECT snap.id, snap.tf, snap.ts, p, close, roll, v, CASE WHEN NOT roll THEN v ELSE 2.0 / (p + 1) * close + (1 - 2.0 / (p + 1)) * last_value(v IGNORE NULLS) OVER (PARTITION BY snap.id, snap.tf, p ORDER BY snap.ts) END AS ema_bar,
  count(v) OVER (PARTITION BY snap.id, snap.tf, p ORDER BY snap.ts) > 0 AS on FROM snap CROSS JOIN ps LEFT JOIN ce USING (id, tf, ts, p))"""
    if not daily:
        return head + ", bo AS (SELECT id, tf, ts, p AS period, roll, ema_bar FROM eb)"
    return head + f""",
 dq AS (SELECT *, row_number() OVER (PARTITION BY id, tf, p ORDER BY ts) AS q, pow(1 - 2.0 / (p + 1), 1 / CASE tf {cases} END) AS d FROM eb WHERE "on"),
 de AS (SELECT t.id, t.tf, t.ts, t.p, sum(CASE WHEN s.q = 1 THEN s.v ELSE (1 - s.d) * s.close END * pow(t.d, t.q - s.q)) AS ema FROM dq t JOIN dq s ON s.id = t.id AND s.tf = t.tf AND s.p = t.p AND s.q <= t.q GROUP BY ALL),
 bo AS (SELECT eb.id, eb.tf, eb.ts, eb.p AS period, roll, ema, ema_bar FROM eb LEFT JOIN de USING (id, tf, ts, p))"""


_TF_OUT = "id tf ts period# roll ema:2 ema_bar:2 ema_d1:2 ema_d2_roll:2 ema_bar_d1:2 ema_bar_d1_roll:2"
_TF_BODY = """SELECT *, ema_d1_roll - lag(ema_d1_roll) OVER u AS ema_d2_roll FROM (SELECT *, ema - lag(ema) OVER u AS ema_d1_roll, ema_bar - lag(ema_bar) OVER u AS ema_bar_d1_roll, CASE WHEN NOT roll THEN ema - lag(ema) OVER c END AS ema_d1,
 CASE WHEN NOT roll THEN ema_bar - lag(ema_bar) OVER c END AS ema_bar_d1 FROM bo WINDOW u AS (PARTITION BY id, tf, period ORDER BY ts), c AS (PARTITION BY id, tf, period, roll ORDER BY ts)) WINDOW u AS (PARTITION BY id, tf, period ORDER BY ts)"""
_TF_COUNT = {f"{n}D": float(n) for n in (2, 5, 7)}
_TF_CAL = {"1W": 7.0, "1M": 30.4375}
query("ema_timeframes_count", _TF_OUT, _TF_BODY, NB + ", " + _tf_ema_sql("SELECT b.id, n || 'D' AS tf, b.ts, b.close, b.rn % n <> 0 AS roll FROM bars b CROSS JOIN (SELECT unnest([2, 5, 7]) AS n)", _TF_COUNT))(
    lambda s, p: A.timeframe_emas(B.count_snapshots(_nb(s, p), [2, 5, 7]), _TF_COUNT, (3, 9)))


def _carried(s, p):
    """Nation bars on every day of their history, closes carried over days without a trade: complete calendar periods."""
    d = _nb(s, p).select("id", "ts", "close", "volume")
    days = d.groupBy("id").agg(F.explode(F.sequence(F.min("ts"), F.max("ts"), F.expr("INTERVAL 1 DAY"))).alias("ts"))
    d = days.join(d, ["id", "ts"], "left").withColumns({"close": Frame().ffill("close"), "volume": F.coalesce("volume", F.lit(0.0))})
    return d.withColumns({c: F.col("close") for c in ("open", "high", "low")})


_CARRIED = """, bars_t AS (SELECT id, ts, close, volume FROM bars), dense AS (SELECT *, close AS open, close AS high, close AS low FROM (SELECT id, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts) AS close, coalesce(volume, 0) AS volume
 FROM (SELECT id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM bars GROUP BY id) LEFT JOIN bars_t USING (id, ts))), dd AS (SELECT *, CAST(ts AS DATE) AS d, CAST(min(ts) OVER (PARTITION BY id) AS DATE) AS f FROM dense), """
for _kind, _build, _scheme, _src in (
    ("calendar", B.calendar_snapshots, "iso", _bar_queries._cal_sql), ("calendar", B.calendar_snapshots, "us", _bar_queries._cal_sql),
    ("anchored", B.anchored_snapshots, "iso", _bar_queries._anchor_sql), ("anchored", B.anchored_snapshots, "us", _bar_queries._anchor_sql),
):
    _tfs = ", ".join(repr(t) for t in _TF_CAL)
    _rows = f"SELECT *, pe - ps + 1 AS tf_days, count(*) OVER (PARTITION BY id, tf, ps ORDER BY ts) AS c, count(*) OVER (PARTITION BY id, tf, ps) AS n, CAST(max(ts) OVER (PARTITION BY id, tf) AS DATE) > pe AS ended FROM ({_src(_scheme)}) WHERE tf IN ({_tfs})"
    _open = "c < tf_days" if _kind == "calendar" else "c < CASE WHEN ended THEN n ELSE tf_days END"
    _ctes, _bar_ctes = (NB + _CARRIED + _tf_ema_sql(f"SELECT id, tf, ts, close, {_open} AS roll FROM ({_rows})", _TF_CAL, (5,), daily) for daily in (True, False))
    query(f"ema_timeframes_{_kind}_{_scheme}", _TF_OUT, _TF_BODY, _ctes)(
        lambda s, p, _b=_build, _c=_scheme: A.timeframe_emas(_b(_carried(s, p), [(1, "W"), (1, "M")], _c), _TF_CAL, (5,)))
    query(f"returns_ema_timeframes_{_kind}_{_scheme}", "id tf ts period# ema_bar_ret_arith:6 ema_bar_ret_arith_roll:6", """SELECT id, tf, ts, period, CASE WHEN NOT roll THEN ema_bar / lag(ema_bar) OVER c - 1 END AS ema_bar_ret_arith, ema_bar / lag(ema_bar) OVER u - 1 AS ema_bar_ret_arith_roll FROM bo
       WINDOW u AS (PARTITION BY id, tf, period ORDER BY ts), c AS (PARTITION BY id, tf, period, roll ORDER BY ts)""", _bar_ctes)(
        lambda s, p, _b=_build, _c=_scheme: R.value_returns(A.timeframe_emas(_b(_carried(s, p), [(1, "W"), (1, "M")], _c), _TF_CAL, (5,)), "ema_bar", ["id", "tf", "period"], roll="roll"))
query("ema_canonical_differences", "id ts roll close_d1:2 close_d1_roll:2 close_d2:2 close_d2_roll:2",
      f"""SELECT *, d1r - lag(d1r) OVER u AS close_d2_roll, CASE WHEN NOT roll THEN close_d1 - lag(close_d1) OVER c END AS close_d2, d1r AS close_d1_roll FROM (
       SELECT *, close - lag(close) OVER u AS d1r, CASE WHEN NOT roll THEN close - lag(close) OVER c END AS close_d1 FROM (SELECT *, rn % 3 <> 0 AS roll FROM bars)
       WINDOW u AS (PARTITION BY id ORDER BY ts), c AS (PARTITION BY id, roll ORDER BY ts)) WINDOW u AS (PARTITION BY id ORDER BY ts), c AS (PARTITION BY id, roll ORDER BY ts)""",
      NB)(lambda s, p: A.canonical_differences(_nb(s, p).withColumn("roll", A.roll_flag_by_count(Frame(), 3)), ["id"], "close", "roll"))
query("ema_returns_dual", "id ts e_ret_arith_roll:6 e_ret_log_roll:6 e_ret_arith:6 e_delta:4",
      """SELECT *, e / lag(e) OVER u - 1 AS e_ret_arith_roll, ln(e / lag(e) OVER u) AS e_ret_log_roll, CASE WHEN NOT roll THEN e / lag(e) OVER c - 1 END AS e_ret_arith,
       CASE WHEN NOT roll THEN e - lag(e) OVER c END AS e_delta FROM (SELECT id, ts, rn % 5 <> 0 AS roll, e FROM bars JOIN e USING (id, ts))
       WINDOW u AS (PARTITION BY id ORDER BY ts), c AS (PARTITION BY id, roll ORDER BY ts)""",
      NB + ", " + ema_cte("e", "bars", "close", {"e": span(10)}),
      )(lambda s, p: R.value_returns(ewm_span(_nb(s, p).withColumn("roll", A.roll_flag_by_count(Frame(), 5)), Frame(), "close", {"e": 10}), "e", ["id"], roll="roll"))
query("ema_roll_by_calendar", "id ts roll", "SELECT id, ts, ts <> max(ts) OVER (PARTITION BY id, date_trunc('month', ts)) AS roll FROM bars", NB)(
    lambda s, p: A.roll_flag_by_calendar(_nb(s, p), _nb(s, p).groupBy("id", F.trunc("ts", "month").alias("m")).agg(F.max("ts").alias("ts")), ["id"]))

_E3 = lambda n, x="close", src="bars": ", ".join([
    ema_cte("e1", src, x, {"v1": span(n)}),
    "b1 AS (SELECT * FROM bars JOIN e1 USING (id, ts))", ema_cte("e2", "b1", "v1", {"v2": span(n)}),
    "b2 AS (SELECT * FROM b1 JOIN e2 USING (id, ts))", ema_cte("e3", "b2", "v2", {"v3": span(n)}),
    "b3 AS (SELECT * FROM b2 JOIN e3 USING (id, ts))"])
feat("dema_tema", "dema_9:4 tema_9:4", lambda d, f: A.dema_tema(d, f, "close", 9),
     "SELECT id, ts, CASE WHEN rn > 17 THEN 2 * v1 - v2 END AS dema_9, CASE WHEN rn > 26 THEN 3 * v1 - 3 * v2 + v3 END AS tema_9 FROM b3", _E3(9))


def wma_sql(x, n, src):
    terms = " + ".join(f"{n - k} * {lag(x, k) if k else x}" for k in range(n))
    return f"SELECT *, ({terms}) / {n * (n + 1) / 2} AS w{n} FROM ({src})"


feat("hma", "hma_9:4", lambda d, f: A.hma(d, f, "close", 9),
     wma_sql("h", 3, f"SELECT *, 2 * w4 - w9 AS h FROM ({wma_sql('close', 9, wma_sql('close', 4, 'SELECT * FROM bars'))})").replace("AS w3", "AS hma_9"))

_ER = """er AS (SELECT *, CASE WHEN rn >= 10 THEN coalesce(abs(close - lag(close, 9) OVER w) / nullif(sum(st) OVER (PARTITION BY id ORDER BY ts ROWS 8 PRECEDING), 0), 0) END AS er
  FROM (SELECT *, abs(close - lag(close) OVER (PARTITION BY id ORDER BY ts)) AS st FROM bars) WINDOW w AS (PARTITION BY id ORDER BY ts)),
 al AS (SELECT *, pow(er * (2.0/3 - 2.0/31) + 2.0/31, 2) AS a FROM er),
 k AS (WITH RECURSIVE r AS (SELECT id, rn, close AS v FROM al WHERE rn = 10 UNION ALL SELECT al.id, al.rn, r.v + al.a * (al.close - r.v) FROM r JOIN al ON al.id = r.id AND al.rn = r.rn + 1) SELECT * FROM r)"""
feat("kama_er", "er_10:6 kama_10_2_30:4", lambda d, f: A.kama(d, f, sets=((10, 2, 30),)),
     "SELECT er.id, er.ts, er AS er_10, v AS kama_10_2_30 FROM er LEFT JOIN k USING (id, rn)", _ER)
_RECUR = """{name} AS (WITH RECURSIVE r AS (SELECT id, rn, close AS v FROM {src} WHERE rn = {start} UNION ALL
  SELECT s.id, s.rn, r.v + s.a * (s.close - r.v) FROM r JOIN {src} s ON s.id = r.id AND s.rn = r.rn + 1) SELECT * FROM r)"""
feat("vidya", "vidya_9:4", lambda d, f: A.vidya(d, f),
     "SELECT bars.id, bars.ts, v AS vidya_9 FROM bars LEFT JOIN k USING (id, rn)",
     f"""vd AS (SELECT *, CASE WHEN rn > 9 THEN 0.2 * abs(coalesce((sum(u) OVER q - sum(n) OVER q) / nullif(sum(u) OVER q + sum(n) OVER q, 0), 0)) END AS a FROM (
      SELECT *, greatest(close - {lag('close')}, 0) AS u, greatest({lag('close')} - close, 0) AS n FROM bars) WINDOW q AS (PARTITION BY id ORDER BY ts ROWS 8 PRECEDING)), """
     + _RECUR.format(name="k", src="vd", start=10))
feat("frama", "frama_16:4", lambda d, f: A.frama(d, f),
     "SELECT bars.id, bars.ts, v AS frama_16 FROM bars LEFT JOIN k USING (id, rn)",
     """fr AS (SELECT *, CASE WHEN n12 <= 0 OR n3 <= 0 THEN 1.0 ELSE coalesce(ln(2) / nullif(ln(n12) - ln(n3), 0), 1.0) END AS d FROM (
      SELECT *, (max(close) OVER h1 - min(close) OVER h1) / 8 + (max(close) OVER h2 - min(close) OVER h2) / 8 AS n12, (max(close) OVER h - min(close) OVER h) / 16 AS n3 FROM bars
      WINDOW h1 AS (PARTITION BY id ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 8 PRECEDING), h2 AS (PARTITION BY id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
       h AS (PARTITION BY id ORDER BY ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))),
     fa AS (SELECT *, least(greatest(exp(-4.6 * (d - 1)), 0.01), 1.0) AS a FROM fr), """ + _RECUR.format(name="k", src="fa", start=16))
def _ama_sql():
    """All adaptive sets: KAMA by recursion over its own rates, double and triple EMAs as chained closed sums, Hull by window sums."""
    ctes, rows = [], []
    h = lambda kind, **p: A.params_hash(p)
    for e, fa, sl in A.KAMA_SETS:
        n = f"k{e}"
        ctes.append(f"""{n}_a AS MATERIALIZED (SELECT *, pow(coalesce(abs(close - lag(close, {e - 1}) OVER {W}) / nullif(sum(st) OVER (PARTITION BY id ORDER BY ts ROWS {e - 2} PRECEDING), 0), 0) * ({span(fa)!r} - {span(sl)!r}) + {span(sl)!r}, 2) AS a
          FROM (SELECT *, abs(close - {lag('close')}) AS st FROM bars))""")
        ctes.append(_RECUR.format(name=n, src=f"{n}_a", start=e))
        rows.append(f"SELECT bars.id, ts, 'KAMA' AS indicator, '{h('KAMA', er_period=e, fast_period=fa, slow_period=sl)}' AS params_hash, v AS value FROM bars LEFT JOIN {n} USING (id, rn)")
    ctes.append(ema_cte("d1", "bars", "close", {f"a{n}": span(n) for n in A.LINEAR_PERIODS}))
    ctes.append("f1 AS MATERIALIZED (SELECT * FROM bars JOIN d1 USING (id, ts))")
    for n in A.LINEAR_PERIODS:
        ctes += [ema_cte(f"d2_{n}", "f1", f"a{n}", {f"b{n}": span(n)}), f"f2_{n} AS MATERIALIZED (SELECT * FROM f1 JOIN d2_{n} USING (id, ts))", ema_cte(f"d3_{n}", f"f2_{n}", f"b{n}", {f"c{n}": span(n)})]
        for kind, need, x in (("DEMA", 2 * n - 1, f"2 * a{n} - b{n}"), ("TEMA", 3 * n - 1, f"3 * a{n} - 3 * b{n} + c{n}")):
            rows.append(f"SELECT id, ts, '{kind}', '{h(kind, period=n)}', CASE WHEN rn > {need} THEN {x} END FROM f2_{n} JOIN d3_{n} USING (id, ts)")
        wma = lambda x, k: f"CASE WHEN count({x}) OVER (PARTITION BY id ORDER BY ts ROWS {k - 1} PRECEDING) = {k} THEN (sum({x} * rn) OVER (PARTITION BY id ORDER BY ts ROWS {k - 1} PRECEDING) - sum({x}) OVER (PARTITION BY id ORDER BY ts ROWS {k - 1} PRECEDING) * (rn - {k})) / {k * (k + 1) / 2} END"
        rows.append(f"SELECT id, ts, 'HMA', '{h('HMA', period=n)}', {wma('h', max(2, int(n**0.5)))} FROM (SELECT *, 2 * {wma('close', max(1, n // 2))} - {wma('close', n)} AS h FROM bars)")
    u = "(PARTITION BY id, indicator, params_hash ORDER BY ts)"
    body = f"SELECT *, value_d1 - lag(value_d1) OVER {u} AS value_d2 FROM (SELECT *, value - lag(value) OVER {u} AS value_d1 FROM ({' UNION ALL '.join(rows)}))"
    return body, NB + ", " + ", ".join(ctes)


def _ama_tf_sql():
    """The same sets over finished bars of each timeframe; a key of the recursion is id * 100 + days."""
    body, ctes = _ama_sql()
    own = TICKS + """, daily AS (SELECT id, ts, arg_max(price, ord) AS close, row_number() OVER (PARTITION BY id ORDER BY ts) AS n FROM ticks GROUP BY id, ts),
 bars AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS rn FROM (SELECT id * 100 + tf AS id, ts, close FROM daily, (SELECT unnest([2, 5, 7]) AS tf) WHERE n % tf = 0))"""
    u = "(PARTITION BY id, indicator, params_hash ORDER BY ts)"
    return (f"""SELECT id // 100 AS id, (id % 100) || 'D' AS tf, ts, indicator, params_hash, value, value_d1 AS d1, value_d2 AS d2, value_d1 AS d1_roll, value_d2 AS d2_roll,
     value / lag(value) OVER {u} - 1 AS ret_arith, CASE WHEN value > 0 AND lag(value) OVER {u} > 0 THEN ln(value / lag(value) OVER {u}) END AS ret_log FROM ({body})""", own + ctes[len(NB):])


query("ama_by_timeframe", "id tf ts indicator params_hash value:3 d1:3 d2:3 d1_roll:3 d2_roll:3 ret_arith:6 ret_log:6", *_ama_tf_sql())(
    lambda s, p: A.adaptive_timeframes(B.canonical(B.count_snapshots(_nb(s, p), [2, 5, 7])), Frame(("id", "tf")), roll="is_partial_end"))
query("ama_long_all_sets", "id ts indicator params_hash value:3 value_d1:3 value_d2:3", *_ama_sql())(
    lambda s, p: A.adaptive_long(_nb(s, p), Frame()))

# --- indicators ------------------------------------------------------------------------------------
_STEP = f"st AS (SELECT *, close - {lag('close')} AS d, greatest(close - {lag('close')}, 0) AS g, greatest({lag('close')} - close, 0) AS l FROM bars)"
_TR = f"tr AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars)"
feat("rsi", "rsi_14:5 rsi_7:5", lambda d, f: I.rsi(d, f, (14, 7)),
     """SELECT bars.id, bars.ts, 100 - 100 / (1 + g14 / nullif(l14, 0)) AS rsi_14, 100 - 100 / (1 + g7 / nullif(l7, 0)) AS rsi_7
      FROM bars LEFT JOIN gg USING (id, ts) LEFT JOIN ll USING (id, ts)""",
     "stn AS (SELECT id, ts, CASE WHEN d IS NOT NULL THEN g END AS g, CASE WHEN d IS NOT NULL THEN l END AS l FROM st), ".join([_STEP + ", ", ""])
     + ema_cte("gg", "stn", "g", {"g14": 1 / 14, "g7": 1 / 7}) + ", " + ema_cte("ll", "stn", "l", {"l14": 1 / 14, "l7": 1 / 7}))
feat("macd", "macd_12_26:4 macd_signal_12_26_9:4 macd_hist_12_26_9:4", lambda d, f: I.macd(d, f),
     "SELECT id, ts, m AS macd_12_26, sg AS macd_signal_12_26_9, m - sg AS macd_hist_12_26_9 FROM mm JOIN s USING (id, ts)",
     ema_cte("e", "bars", "close", {"f": span(12), "s": span(26)}) + ", mm AS (SELECT id, ts, f - s AS m FROM e), " + ema_cte("s", "mm", "m", {"sg": span(9)}))
feat("stochastic", "stoch_k_14:5 stoch_d_3:5", lambda d, f: I.stochastic(d, f),
     f"SELECT *, {ro('avg', 'stoch_k_14', 3)} AS stoch_d_3 FROM (SELECT *, 100 * (close - {ro('min', 'low', 14)}) / nullif({ro('max', 'high', 14)} - {ro('min', 'low', 14)}, 0) AS stoch_k_14 FROM bars)")
feat("bollinger", "bb_ma_20:4 bb_up_20:4 bb_lo_20:4 bb_width_20:6", lambda d, f: I.bollinger(d, f),
     f"SELECT *, m AS bb_ma_20, m + 2 * sd AS bb_up_20, m - 2 * sd AS bb_lo_20, 4 * sd / m AS bb_width_20 FROM (SELECT *, {ro('avg', 'close', 20)} AS m, {ro('stddev_samp', 'close', 20)} AS sd FROM bars)")
feat("atr_simple", "atr_14:4", lambda d, f: I.atr(d, f), f"SELECT *, {ro('avg', 'tr', 14)} AS atr_14 FROM tr", _TR)
_DM = f"""dm AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM (
  SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM tr))"""
feat("adx", "adx_14:5", lambda d, f: I.adx(d, f),
     f"SELECT *, {ro('avg', 'dx', 14)} AS adx_14 FROM (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM (SELECT *, 100 * {ro('sum', 'pdm', 14)} / {ro('avg', 'tr', 14)} AS p, 100 * {ro('sum', 'mdm', 14)} / {ro('avg', 'tr', 14)} AS m FROM dm))",
     _TR + ", " + _DM)
feat("obv", "obv:1", lambda d, f: I.obv(d, f), f"SELECT *, sum(coalesce(sign(dd) * volume, 0)) OVER {W} AS obv FROM (SELECT *, close - {lag('close')} AS dd FROM bars)")
feat("mfi", "mfi_14:5", lambda d, f: I.mfi(d, f),
     f"SELECT *, 100 - 100 / (1 + {ro('sum', 'p', 14)} / nullif({ro('sum', 'n', 14)}, 0)) AS mfi_14 FROM (SELECT *, CASE WHEN tp > lag(tp) OVER {W} THEN tp * volume ELSE 0.0 END AS p, CASE WHEN tp < lag(tp) OVER {W} THEN tp * volume ELSE 0.0 END AS n FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars))")
feat("ichimoku", "ichimoku_tenkan:4 ichimoku_kijun:4 ichimoku_span_a:4 ichimoku_span_b:4 ichimoku_chikou:4", lambda d, f: I.ichimoku(d, f),
     f"""SELECT *, (ichimoku_tenkan + ichimoku_kijun) / 2 AS ichimoku_span_a FROM (SELECT *, ({ro('max', 'high', 9)} + {ro('min', 'low', 9)}) / 2 AS ichimoku_tenkan, ({ro('max', 'high', 26)} + {ro('min', 'low', 26)}) / 2 AS ichimoku_kijun,
      ({ro('max', 'high', 52)} + {ro('min', 'low', 52)}) / 2 AS ichimoku_span_b, {lag('close', 26)} AS ichimoku_chikou FROM bars)""")
feat("williams_r", "willr_14:5", lambda d, f: I.williams_r(d, f), f"SELECT *, -100 * ({ro('max', 'high', 14)} - close) / nullif({ro('max', 'high', 14)} - {ro('min', 'low', 14)}, 0) AS willr_14 FROM bars")
feat("keltner", "kc_mid_20:4 kc_upper_20:4 kc_lower_20:4 kc_width_20:6", lambda d, f: I.keltner(d, f),
     f"SELECT id, ts, m AS kc_mid_20, m + 2 * a AS kc_upper_20, m - 2 * a AS kc_lower_20, 4 * a / m AS kc_width_20 FROM (SELECT id, ts, {ro('avg', 'tr', 10)} AS a FROM tr) JOIN e USING (id, ts)",
     _TR + ", " + ema_cte("e", "bars", "close", {"m": span(20)}))
feat("cci", "cci_20:4", lambda d, f: I.cci(d, f),
     f"SELECT *, (tp - m) / (0.015 * nullif({ro('avg', 'ad', 20)}, 0)) AS cci_20 FROM (SELECT *, abs(tp - m) AS ad FROM (SELECT *, {ro('avg', 'tp', 20)} AS m FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars)))")
feat("elder_ray", "elder_bull_13:4 elder_bear_13:4", lambda d, f: I.elder_ray(d, f), "SELECT id, ts, high - m AS elder_bull_13, low - m AS elder_bear_13 FROM bars JOIN e USING (id, ts)", ema_cte("e", "bars", "close", {"m": span(13)}))
feat("force_index", "fi_1:2 fi_13:3", lambda d, f: I.force_index(d, f), "SELECT id, ts, v AS fi_1, m AS fi_13 FROM fv LEFT JOIN e USING (id, ts)",
     f"fv AS (SELECT id, ts, (close - {lag('close')}) * volume AS v FROM bars), " + ema_cte("e", "fv", "v", {"m": span(13)}))
feat("rolling_vwap", "vwap_14:4 vwap_dev_14:6", lambda d, f: I.rolling_vwap(d, f),
     f"SELECT *, close / vwap_14 - 1 AS vwap_dev_14 FROM (SELECT *, {ro('sum', 'tv', 14)} / nullif({ro('sum', 'volume', 14)}, 0) AS vwap_14 FROM (SELECT *, (high + low + close) / 3 * volume AS tv FROM bars))")
_MFV = "mf AS (SELECT *, (2 * close - low - high) / nullif(high - low, 0) * volume AS mfv FROM bars)"
feat("cmf", "cmf_20:6", lambda d, f: I.cmf(d, f), f"SELECT *, {ro('sum', 'mfv', 20)} / nullif({ro('sum', 'volume', 20)}, 0) AS cmf_20 FROM mf", _MFV)


def _wide(s, p):
    """Bars whose range is never zero, so that flow features have no gaps."""
    return _nb(s, p).withColumns({"high": F.col("high") + 50.0, "low": F.col("low") - 25.0})


query("cmf_full", "id ts cmf_5:6", f"SELECT *, {ro('sum', 'mfv', 5)} / nullif({ro('sum', 'volume', 5)}, 0) AS cmf_5 FROM mf", NB + ", wb AS (SELECT * REPLACE (high + 50 AS high, low - 25 AS low) FROM bars), " + _MFV.replace("FROM bars", "FROM wb"))(
    lambda s, p: I.cmf(_wide(s, p), Frame(), 5))
query("chaikin_osc", "id ts chaikin_osc_3_10:4", "SELECT id, ts, a - b AS chaikin_osc_3_10 FROM e",
      NB + ", wb AS (SELECT * REPLACE (high + 50 AS high, low - 25 AS low) FROM bars), " + _MFV.replace("FROM bars", "FROM wb") + f", ad AS (SELECT *, sum(mfv) OVER {W} AS adl FROM mf), "
      + ema_cte("e", "ad", "adl", {"a": span(3), "b": span(10)}))(lambda s, p: I.chaikin(_wide(s, p), Frame()))
_HL = ", ".join(f"ln(sqrt(greatest(list_avg(list_transform(dk{k}, lambda z: z * z)) - pow(list_avg(dk{k}), 2), 0)) + 1e-16) AS t{k}" for k in range(2, 21))
_HD = ", ".join(f"list_transform(range(1, {101 - k}), lambda i: xs[i + {k}] - xs[i]) AS dk{k}" for k in range(2, 21))
_HS = "[" + ", ".join(f"{{'x': ln({k}), 'y': t{k}}}" for k in range(2, 21)) + "]"
feat("hurst", "hurst_100:5", lambda d, f: I.hurst(d, f),
     f"""SELECT bars.id, bars.ts, slope AS hurst_100 FROM bars LEFT JOIN (SELECT id, ts, regr_slope(v.y, v.x) AS slope FROM (SELECT id, ts, unnest({_HS}) AS v FROM (SELECT id, ts, {_HL} FROM (SELECT id, ts, {_HD} FROM (
      SELECT id, ts, rn, list(close) OVER (PARTITION BY id ORDER BY ts ROWS 99 PRECEDING) AS xs FROM bars) WHERE rn >= 100))) GROUP BY id, ts) USING (id, ts)""")
feat("aroon", "aroon_up_25:4 aroon_dn_25:4 aroon_osc_25:4", lambda d, f: I.aroon(d, f),
     """SELECT *, aroon_up_25 - aroon_dn_25 AS aroon_osc_25 FROM (SELECT *, CASE WHEN rn > 25 THEN 100.0 * (25 - (rn - arg_min(rn, struct_pack(a := -high, b := rn)) OVER q)) / 25 END AS aroon_up_25,
      CASE WHEN rn > 25 THEN 100.0 * (25 - (rn - arg_min(rn, struct_pack(a := low, b := rn)) OVER q)) / 25 END AS aroon_dn_25 FROM bars WINDOW q AS (PARTITION BY id ORDER BY ts ROWS 25 PRECEDING))""")
feat("trix", "trix_15:5 trix_signal_9:5", lambda d, f: I.trix(d, f), "SELECT t.id, t.ts, trix AS trix_15, sg AS trix_signal_9 FROM t LEFT JOIN s USING (id, ts)",
     _E3(15) + f", t AS (SELECT id, ts, (v3 / {lag('v3')} - 1) * 100 AS trix FROM b3), " + ema_cte("s", "t", "trix", {"sg": span(9)}))
feat("ultimate_osc", "uo_7_14_28:5", lambda d, f: I.ultimate(d, f),
     "SELECT *, 100 * (4 * " + " + ".join(f"{'2 * ' if n == 14 else ''}{ro('sum', 'bp', n)} / nullif({ro('sum', 'tr', n)}, 0)" for n in (7, 14, 28)) + f") / 7 AS uo_7_14_28 FROM (SELECT *, close - least(low, pc) AS bp, greatest(high, pc) - least(low, pc) AS tr FROM (SELECT *, {lag('close')} AS pc FROM bars))")
feat("vortex", "vi_plus_14:5 vi_minus_14:5", lambda d, f: I.vortex(d, f),
     f"SELECT *, {ro('sum', 'p', 14)} / nullif({ro('sum', 'tr', 14)}, 0) AS vi_plus_14, {ro('sum', 'm', 14)} / nullif({ro('sum', 'tr', 14)}, 0) AS vi_minus_14 FROM (SELECT *, abs(high - {lag('low')}) AS p, abs(low - {lag('high')}) AS m FROM tr)", _TR)
query("emv", "id ts emv_1:0 emv_14:0",
      f"SELECT *, {ro('avg', 'emv_1', 14)} AS emv_14 FROM (SELECT *, ((high + low) / 2 - ({lag('high')} + {lag('low')}) / 2) / nullif((volume / 1e6) / nullif(high - low, 0), 0) AS emv_1 FROM wb)",
      NB + ", wb AS (SELECT * REPLACE (high + 50 AS high, low - 25 AS low) FROM bars)")(lambda s, p: I.emv(_wide(s, p), Frame()))
query("mass_index", "id ts mass_index_25:5", f"SELECT *, {ro('sum', 'q', 25)} AS mass_index_25 FROM (SELECT id, ts, v1 / nullif(v2, 0) AS q FROM b2)",
      NB + ", wb AS (SELECT *, high - low + 75 AS r FROM bars), " + ema_cte("e1", "wb", "r", {"v1": span(9)}) + ", b1 AS (SELECT * FROM wb JOIN e1 USING (id, ts)), " + ema_cte("e2", "b1", "v1", {"v2": span(9)}) + ", b2 AS (SELECT * FROM b1 JOIN e2 USING (id, ts))",
      )(lambda s, p: I.mass_index(_wide(s, p), Frame()))
_ROC = lambda k: f"(close / {lag('close', k)} - 1) * 100"
feat("kst", "kst:4 kst_signal:4", lambda d, f: I.kst(d, f),
     f"SELECT *, {ro('avg', 'kst', 9)} AS kst_signal FROM (SELECT *, {ro('avg', 'r1', 10)} + 2 * {ro('avg', 'r2', 13)} + 3 * {ro('avg', 'r3', 14)} + 4 * {ro('avg', 'r4', 9)} AS kst FROM (SELECT *, {_ROC(10)} AS r1, {_ROC(13)} AS r2, {_ROC(14)} AS r3, {_ROC(15)} AS r4 FROM bars))")
feat("coppock", "coppock_10:4", lambda d, f: I.coppock(d, f), wma_sql("c", 10, f"SELECT *, {_ROC(14)} + {_ROC(11)} AS c FROM bars").replace("AS w10", "AS coppock_10"))
feat("indicator_pack_zscore", "rsi_14:4 stoch_k_14:4 atr_14:3 adx_14:4 bb_width_20:5 rsi_14_zscore:4", lambda d, f: I.indicator_pack(d, f),
     f"""SELECT b.id, b.ts, rsi_14, (rsi_14 - {ro('avg', 'rsi_14', 60, part='b.id', order='b.ts')}) / nullif({ro('stddev_samp', 'rsi_14', 60, part='b.id', order='b.ts')}, 0) AS rsi_14_zscore, k AS stoch_k_14, atr AS atr_14, adx AS adx_14, w AS bb_width_20
      FROM bars b LEFT JOIN (SELECT bars.id, bars.ts, 100 - 100 / (1 + g14 / nullif(l14, 0)) AS rsi_14 FROM bars LEFT JOIN gg USING (id, ts) LEFT JOIN ll USING (id, ts)) r USING (id, ts)
      LEFT JOIN (SELECT id, ts, 100 * (close - {ro('min', 'low', 14)}) / nullif({ro('max', 'high', 14)} - {ro('min', 'low', 14)}, 0) AS k, 4 * {ro('stddev_samp', 'close', 20)} / {ro('avg', 'close', 20)} AS w FROM bars) s USING (id, ts)
      LEFT JOIN (SELECT id, ts, {ro('avg', 'tr', 14)} AS atr FROM tr) t USING (id, ts)
      LEFT JOIN (SELECT id, ts, {ro('avg', 'dx', 14)} AS adx FROM (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM (SELECT *, 100 * {ro('sum', 'pdm', 14)} / {ro('avg', 'tr', 14)} AS p, 100 * {ro('sum', 'mdm', 14)} / {ro('avg', 'tr', 14)} AS m FROM dm))) x USING (id, ts)""",
     _STEP + ", stn AS (SELECT id, ts, CASE WHEN d IS NOT NULL THEN g END AS g, CASE WHEN d IS NOT NULL THEN l END AS l FROM st), " + ema_cte("gg", "stn", "g", {"g14": 1 / 14}) + ", " + ema_cte("ll", "stn", "l", {"l14": 1 / 14}) + ", " + _TR + ", " + _DM)
feat("core_feature_pack", "close_pct:6 close_log:6 ema_21:4 vol_20:5 acf_1_50:5 acf_5_50:5", lambda d, f: I.core_features(d, f),
     f"""SELECT *, {ro('stddev_pop', 'lr', 20)} * sqrt(252) AS vol_20, CASE WHEN count(l1) OVER q = 50 THEN covar_samp(lr, l1) OVER q / nullif(sqrt(var_samp(CASE WHEN l1 IS NOT NULL THEN lr END) OVER q * var_samp(l1) OVER q), 0) END AS acf_1_50,
      CASE WHEN count(l5) OVER q = 50 THEN covar_samp(lr, l5) OVER q / nullif(sqrt(var_samp(CASE WHEN l5 IS NOT NULL THEN lr END) OVER q * var_samp(l5) OVER q), 0) END AS acf_5_50, cp AS close_pct, lr AS close_log
      FROM (SELECT *, {lag('lr')} AS l1, {lag('lr', 5)} AS l5 FROM (SELECT *, close / {lag('close')} - 1 AS cp, ln(close / {lag('close')}) AS lr FROM bars JOIN e USING (id, ts))) WINDOW q AS (PARTITION BY id ORDER BY ts ROWS 49 PRECEDING)""",
     ema_cte("e", "bars", "close", {"ema_21": span(21)}))
_LR = f"lr AS (SELECT *, ln(close / {lag('close')}) AS r, {lag('close')} AS pc FROM bars)"
query("acf", "id lag# acf:6", "SELECT id, lag, sum(d * dl) / max(t) AS acf FROM (" + " UNION ALL ".join(
    f"SELECT id, {k} AS lag, d, lag(d, {k}) OVER {W} AS dl, t FROM dd" for k in range(6)) + ") GROUP BY id, lag",
    NB + ", " + _LR + ", dd AS (SELECT *, sum(d * d) OVER (PARTITION BY id) AS t FROM (SELECT id, ts, r - avg(r) OVER (PARTITION BY id) AS d FROM lr WHERE r IS NOT NULL))",
)(lambda s, p: I.acf(_nb(s, p).withColumn("r", Frame().log_return("close")), Frame(), "r", 5))
query("pacf_levinson", "id lag# pacf:6",
      "SELECT id, 0 AS lag, 1.0 AS pacf FROM a UNION ALL SELECT id, 1, r1 FROM a UNION ALL SELECT id, 2, (r2 - r1 * r1) / (1 - r1 * r1) FROM a",
      NB + ", " + _LR + f""", dd AS (SELECT *, sum(d * d) OVER (PARTITION BY id) AS t FROM (SELECT id, ts, r - avg(r) OVER (PARTITION BY id) AS d FROM lr WHERE r IS NOT NULL)),
      a AS (SELECT id, sum(d * d1) / max(t) AS r1, sum(d * d2) / max(t) AS r2 FROM (SELECT *, lag(d) OVER {W} AS d1, lag(d, 2) OVER {W} AS d2 FROM dd) GROUP BY id)""",
)(lambda s, p: I.pacf(I.acf(_nb(s, p).withColumn("r", Frame().log_return("close")), Frame(), "r", 2), ["id"], 2))
query("xcorr", "id lag# xcorr:6", "SELECT id, lag, sum(a * bl) / sqrt(max(ta) * max(tb)) AS xcorr FROM (" + " UNION ALL ".join(
    f"SELECT id, {k} AS lag, a, {lag('b', k) if k > 0 else f'lead(b, {-k}) OVER {W}' if k < 0 else 'b'} AS bl, ta, tb FROM dd" for k in range(-3, 4)) + ") GROUP BY id, lag",
    NB + ", dd AS (SELECT *, sum(a * a) OVER (PARTITION BY id) AS ta, sum(b * b) OVER (PARTITION BY id) AS tb FROM (SELECT id, ts, close - avg(close) OVER (PARTITION BY id) AS a, volume - avg(volume) OVER (PARTITION BY id) AS b FROM bars))",
)(lambda s, p: I.xcorr(_nb(s, p), Frame(), "close", "volume", 3))
_SLOPE = ro("regr_slope({x}, rn)", "close", 20)
feat("trend_labels_binary", "slope:4 trend#", lambda d, f: I.trend_labels(d, f), f"SELECT *, CASE WHEN slope > 0 THEN 1 WHEN slope IS NOT NULL THEN -1 END AS trend FROM (SELECT *, {_SLOPE} AS slope FROM bars)")
feat("trend_labels_three_state", "trend#", lambda d, f: I.trend_labels(d, f, mode="three_state"),
     f"SELECT id, ts, CASE WHEN abs(slope) <= quantile_cont(abs(slope), 0.33) OVER (PARTITION BY id) THEN 0 WHEN slope > 0 THEN 1 WHEN slope < 0 THEN -1 END AS trend FROM (SELECT *, {_SLOPE} AS slope FROM bars)")
query("flip_segments", "id segment# up start_ts end_ts start_price:2 end_price:2 n_bars# ret:6",
      f"""SELECT id, seg AS segment, up, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(close, ts) AS start_price, arg_max(close, ts) AS end_price, count(*) AS n_bars, arg_max(close, ts) / arg_min(close, ts) - 1 AS ret FROM (
       SELECT *, sum(CASE WHEN up IS DISTINCT FROM pu OR k = 1 THEN 1 ELSE 0 END) OVER {W} AS seg FROM (SELECT *, lag(up) OVER {W} AS pu, row_number() OVER {W} AS k FROM (SELECT * FROM (SELECT *, close > {ro('avg', 'close', 10)} AS up FROM bars) WHERE up IS NOT NULL))) GROUP BY id, seg, up""",
      NB)(lambda s, p: I.flip_segments(_nb(s, p).withColumn("up", F.col("close") > Frame().mean("close", 10)), Frame(), "up"))

# --- volatility ------------------------------------------------------------------------------------
_VT = """vt AS (SELECT *, pow(ln(high / low), 2) / (4 * ln(2)) AS pk, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars)"""


def _root(x, n):
    v = ro("avg", x, n)
    return f"CASE WHEN {v} >= 0 THEN sqrt({v}) * sqrt(252) END"


feat("range_volatility", "vol_parkinson_20:6 vol_gk_20:6 vol_rs_20:6 vol_parkinson_63:6", lambda d, f: V.range_volatility(d, f, (20, 63)),
     f"SELECT *, {_root('pk', 20)} AS vol_parkinson_20, {_root('gk', 20)} AS vol_gk_20, {_root('rs', 20)} AS vol_rs_20, {_root('pk', 63)} AS vol_parkinson_63 FROM vt", _VT)
feat("return_volatility", "vol_log_roll_20:6 vol_pct_roll_20:6 vol_log_roll_126:6", lambda d, f: V.return_volatility(d, f, (20, 126)),
     f"SELECT *, {ro('stddev_pop', 'r', 20)} * sqrt(252) AS vol_log_roll_20, {ro('stddev_pop', 'pr', 20)} * sqrt(252) AS vol_pct_roll_20, {ro('stddev_pop', 'r', 126)} * sqrt(252) AS vol_log_roll_126 FROM (SELECT *, close / pc - 1 AS pr FROM lr)", _LR)
feat("atr_wilder", "atr_wilder_14:4", lambda d, f: V.atr_wilder(d, f), "SELECT * FROM e", _TR + ", " + ema_cte("e", "tr", "tr", {"atr_wilder_14": 1 / 14}))
_EWS = lambda n: f"""lx AS (SELECT id, ts, r, count(r) OVER {W} AS n FROM lr),
 ew AS (SELECT id, ts, CASE WHEN n > 1 THEN sqrt(greatest((s2 / s0 - pow(s1 / s0, 2)) * s0 * s0 / (s0 * s0 - q0), 0)) END AS dv FROM (
  SELECT t.id, t.ts, t.n, sum(pow({1 - span(n)!r}, t.n - s.n)) AS s0, sum(pow({1 - span(n)!r}, t.n - s.n) * s.r) AS s1, sum(pow({1 - span(n)!r}, t.n - s.n) * s.r * s.r) AS s2, sum(pow({1 - span(n)!r}, 2 * (t.n - s.n))) AS q0
  FROM lx t LEFT JOIN lx s ON s.id = t.id AND s.n <= t.n AND s.r IS NOT NULL GROUP BY ALL))"""  # noqa: E731
feat("daily_vol_ewm", "daily_vol:6", lambda d, f: V.daily_vol(d, f), "SELECT id, ts, dv AS daily_vol FROM ew", _LR + ", " + _EWS(100))
feat("volatility_table", "atr_wilder_14:3 vol_gk_20:5 vol_log_roll_20_z:4 vol_log_roll_20_is_outlier", lambda d, f: V.volatility_table(d, f, (20, 63), 120),
     f"""SELECT id, ts, atr_wilder_14, vol_gk_20, z AS vol_log_roll_20_z, coalesce(abs(z) > 4, false) AS vol_log_roll_20_is_outlier FROM (
      SELECT *, (v - {ro('avg', 'v', 120, 30)}) / nullif({ro('stddev_samp', 'v', 120, 30)}, 0) AS z FROM (SELECT id, ts, {ro('stddev_pop', 'r', 20)} * sqrt(252) AS v FROM lr)) a
      JOIN (SELECT id, ts, {_root('gk', 20)} AS vol_gk_20 FROM vt) g USING (id, ts) JOIN e USING (id, ts)""",
     _LR + ", " + _VT + ", " + _TR + ", " + ema_cte("e", "tr", "tr", {"atr_wilder_14": 1 / 14}))

_FC = f"""fc AS (SELECT id, ts, 'sma' AS estimator, {ro('stddev_pop', 'r', 20)} AS forecast, {lag('r', -1)} AS nx FROM lr UNION ALL
 SELECT id, ts, 'park', CASE WHEN {ro('avg', 'pk', 20)} >= 0 THEN sqrt({ro('avg', 'pk', 20)}) END, lead(ln(close / pc)) OVER {W} FROM (SELECT vt.*, lr.pc FROM vt JOIN lr USING (id, ts))),
 fl AS (SELECT *, abs(nx) AS realized FROM fc)"""


def _forecasts(s, p):
    f = Frame()
    d = V.return_volatility(V.range_volatility(_nb(s, p), f, (20,), ("parkinson",), annualize=False), f, (20,), ("log",), annualize=False)
    d = d.withColumn("_r", f.log_return("close"))
    d = d.withColumn("realized", F.abs(f.lead("_r")))
    items = F.array(F.struct(F.lit("sma").alias("estimator"), F.col("vol_log_roll_20").alias("forecast")),
                    F.struct(F.lit("park").alias("estimator"), F.col("vol_parkinson_20").alias("forecast")))
    return d.select("id", "ts", "realized", F.explode(items).alias("_i")).select("id", "ts", "realized", "_i.*")


query("volatility_forecast_losses", "id estimator rmse:6 qlike:5 mz_r2:5 n# score:5",
      """SELECT id, estimator, n, mz_r2, rmse, ln(qlike + 20) AS qlike, ln(0.5 * rmse + 0.5 * qlike + 20) AS score FROM (SELECT id, estimator, sqrt(avg(pow(greatest(forecast, 1e-8) - greatest(realized, 1e-8), 2))) AS rmse,
       avg(ln(greatest(pow(forecast, 2), 1e-16)) + greatest(pow(realized, 2), 1e-16) / greatest(pow(forecast, 2), 1e-16)) AS qlike, regr_r2(realized, forecast) AS mz_r2, count(*) AS n
       FROM fl WHERE forecast IS NOT NULL AND realized IS NOT NULL GROUP BY ALL)""",
      NB + ", " + _LR + ", " + _VT + ", " + _FC.replace(lag('r', -1), f"lead(r) OVER {W}"))(lambda s, p: V.forecast_losses(_forecasts(s, p), ["id", "estimator"]).withColumns({"score": F.log(F.col("score") + 20), "qlike": F.log(F.col("qlike") + 20)}))
query("volatility_trailing_rmse", "id estimator ts trailing_rmse:6",
      f"SELECT id, estimator, ts, sqrt({ro('avg', 'e2', 63, part='id, estimator')}) AS trailing_rmse FROM (SELECT *, pow(forecast - realized, 2) AS e2 FROM fl)",
      NB + ", " + _LR + ", " + _VT + ", " + _FC.replace(lag('r', -1), f"lead(r) OVER {W}"))(lambda s, p: V.trailing_rmse(_forecasts(s, p), Frame(("id", "estimator"))))
query("volatility_blended", "id blended_vol:6 n_estimators#",
      """SELECT id, sum(fv * w) / sum(w) AS blended_vol, count(*) AS n_estimators FROM (SELECT *, (1 / rmse) / sum(1 / rmse) OVER (PARTITION BY id) AS w FROM (
       SELECT id, estimator, sqrt(avg(CASE WHEN realized IS NOT NULL THEN pow(greatest(forecast, 1e-8) - greatest(realized, 1e-8), 2) END)) AS rmse, arg_max(forecast, ts) AS fv FROM fl WHERE forecast IS NOT NULL GROUP BY ALL)) GROUP BY id""",
      NB + ", " + _LR + ", " + _VT + ", " + _FC.replace(lag('r', -1), f"lead(r) OVER {W}"))(
    lambda s, p: V.blended_vol(_forecasts(s, p), V.blend_weights(V.forecast_losses(_forecasts(s, p), ["id", "estimator"]), ["id"]), ["id"]))
query("volatility_gk_fallback", "id gk_vol:6 n#", "SELECT id, sqrt(greatest(avg(gk), 0)) AS gk_vol, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM vt) WHERE k <= 21 GROUP BY id", NB + ", " + _VT)(
    lambda s, p: V.gk_fallback(_nb(s, p), ["id"]))
query("volatility_carried_forecast", "id forecast:6 forecast_ts age_days# carried:6",
      """SELECT *, forecast * exp(-ln(2) / 5 * age_days) AS carried FROM (SELECT id, arg_max(forecast, ts) AS forecast, max(ts) AS forecast_ts, date_diff('day', max(ts), TIMESTAMP '2002-01-01') AS age_days
       FROM fl WHERE estimator = 'sma' AND forecast > 0.7 GROUP BY id)""",
      NB + ", " + _LR + ", " + _VT + ", " + _FC.replace(lag('r', -1), f"lead(r) OVER {W}"))(
    lambda s, p: V.carried_forecast(_forecasts(s, p).filter("estimator = 'sma'").withColumn("converged", F.coalesce(F.col("forecast") > 0.7, F.lit(False))), ["id"], F.lit("2002-01-01").cast("date")))
query("ljung_box", "id q_4:4 p_4:6 p_10:6 p_min:6 n#",
      """SELECT *, exp(-q_4 / 2) * (1 + q_4 / 2) AS p_4, exp(-h) * (1 + h + h * h / 2 + pow(h, 3) / 6 + pow(h, 4) / 24) AS p_10, least(exp(-q_4 / 2) * (1 + q_4 / 2), exp(-h) * (1 + h + h * h / 2 + pow(h, 3) / 6 + pow(h, 4) / 24)) AS p_min FROM (
       SELECT *, q10 / 2 AS h FROM (SELECT id, n, n * (n + 2) * sum(a * a / (n - lag)) FILTER (lag <= 4) AS q_4, n * (n + 2) * sum(a * a / (n - lag)) AS q10 FROM (
        SELECT id, lag, max(n) AS n, sum(d * dl) / max(t) AS a FROM (""" + " UNION ALL ".join(f"SELECT id, {k} AS lag, d, lag(d, {k}) OVER {W} AS dl, t, n FROM dd" for k in range(1, 11)) + ") GROUP BY id, lag) GROUP BY id, n))",
      NB + ", " + _LR + ", dd AS (SELECT *, sum(d * d) OVER (PARTITION BY id) AS t, count(*) OVER (PARTITION BY id) AS n FROM (SELECT id, ts, r - avg(r) OVER (PARTITION BY id) AS d FROM lr WHERE r IS NOT NULL))",
)(lambda s, p: V.ljung_box(_nb(s, p).withColumn("r", Frame().log_return("close")), Frame(), "r", (4, 10)))
query("garch_fit", "id omega:5 alpha:4 beta:4 loglik:3 forecast:5 n# converged message", None)(
    lambda s, p: V.fit_garch(_nb(s, p).withColumn("r", Frame().log_return("close")), Frame(), "r"))
query("garch_out_of_sample", "id split_end# forecast:5 realized:5", None)(
    lambda s, p: V.garch_out_of_sample(_nb(s, p).withColumn("r", Frame().log_return("close")), Frame(), "r"))

# --- cycles ----------------------------------------------------------------------------------------
feat("ath_cycle", "ath ath_ts is_at_ath cycle_number# dd_from_ath:6 bars_since_ath# days_since_ath# cycle_low cycle_low_ts dd_ath_to_low:6 bars_ath_to_low# days_ath_to_low#",
     lambda d, f: Y.ath_cycle(d, f),
     """SELECT *, (close - ath) / ath AS dd_from_ath, rn - arn AS bars_since_ath, date_diff('day', ath_ts, ts) AS days_since_ath, (cycle_low - ath) / ath AS dd_ath_to_low, lrn - arn AS bars_ath_to_low, date_diff('day', ath_ts, cycle_low_ts) AS days_ath_to_low FROM (
      SELECT *, first(ts) OVER c AS ath_ts, first(rn) OVER c AS arn, min(close) OVER c AS cycle_low, arg_min(ts, struct_pack(a := close, b := rn)) OVER c AS cycle_low_ts, arg_min(rn, struct_pack(a := close, b := rn)) OVER c AS lrn FROM (
       SELECT *, sum(CAST(is_at_ath AS INTEGER)) OVER (PARTITION BY id ORDER BY ts) AS cycle_number FROM (SELECT *, max(close) OVER (PARTITION BY id ORDER BY ts) AS ath, close >= max(close) OVER (PARTITION BY id ORDER BY ts) AS is_at_ath FROM bars))
      WINDOW c AS (PARTITION BY id, cycle_number ORDER BY ts))""")
query("rolling_extremes_long", "id ts lookback_bars# rolling_high rolling_high_ts bars_since_rolling_high# days_since_rolling_high# rolling_low rolling_low_ts bars_since_rolling_low# range_position:6 dd_from_rolling_high:6",
      " UNION ALL ".join(f"""SELECT id, ts, {n} AS lookback_bars, hi AS rolling_high, hts AS rolling_high_ts, rn - hrn AS bars_since_rolling_high, date_diff('day', hts, ts) AS days_since_rolling_high, lo AS rolling_low, lts AS rolling_low_ts, rn - lrn AS bars_since_rolling_low,
       CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 1.0 END AS range_position, (close - hi) / hi AS dd_from_rolling_high FROM (SELECT *, max(close) OVER q AS hi, min(close) OVER q AS lo, arg_max(ts, struct_pack(a := close, b := rn)) OVER q AS hts, arg_max(rn, struct_pack(a := close, b := rn)) OVER q AS hrn,
       arg_min(ts, struct_pack(a := close, b := -rn)) OVER q AS lts, arg_min(rn, struct_pack(a := close, b := -rn)) OVER q AS lrn FROM bars WINDOW q AS (PARTITION BY id ORDER BY ts ROWS {n - 1} PRECEDING))""" for n in (7, 30)),
      NB)(lambda s, p: Y.rolling_extremes_long(_nb(s, p), Frame(), (7, 30)))
query("sign_from_series", "id ts s#", f"SELECT id, ts, sign(close - {lag('close')}) AS s FROM bars", NB)(
    lambda s, p: _nb(s, p).withColumn("s", F.signum(Frame().diff("close"))))

# --- raw ticks: keys of any size -------------------------------------------------------------------
_KW = "(PARTITION BY event_type ORDER BY ts, event_id)"
_KTICK = f"kt AS (SELECT event_type AS kind, event_id, ts, value AS price, row_number() OVER {_KW} AS n FROM events)"


def _kind_ticks(s, p):
    f = Frame(("kind",), ("ts", "event_id"))
    t = M.event_ticks(s, p).select("kind", "ts", "event_id", "price")
    return S.number_rows(t, f, F.date_trunc("hour", F.col("ts"))), f


def _tick_ema(s, p):
    t, f = _kind_ticks(s, p)
    return S.ema(t, f, F.col("price"), {"ema_5": A.span(5), "ema_60": A.span(60)})


query("tick_ema_split_keys", "kind event_id n# ema_5:5 ema_60:5",
      f"""SELECT t.kind, t.event_id, t.n, {', '.join(f"sum(CASE WHEN s.n = 1 THEN 1.0 ELSE {span(k)!r} END * s.price * pow({1 - span(k)!r}, t.n - s.n)) AS ema_{k}" for k in (5, 60))}
       FROM kt t JOIN kt s ON s.kind = t.kind AND s.n BETWEEN t.n - 1200 AND t.n GROUP BY ALL""", _KTICK)(_tick_ema)


def _tick_rolling(s, p):
    t, f = _kind_ticks(s, p)
    t = S.sliding(t, f, 49, lambda d, fr: d.withColumns({"mean_50": fr.mean("price", 50), "std_20": fr.std("price", 20), "step": fr.diff("price")}), rows=4096)
    return S.running(t, f, {"total": ("sum", F.col("price")), "peak": ("max", F.col("price")), "seen": ("count", F.col("price"))}, rows=4096)


query("tick_windows_split_keys", "kind event_id n# mean_50:5 std_20:5 step:4 total:2 peak:2 seen#",
      f"""SELECT kind, event_id, n, CASE WHEN n >= 50 THEN avg(price) OVER (PARTITION BY kind ORDER BY n ROWS 49 PRECEDING) END AS mean_50, CASE WHEN n >= 20 THEN stddev_samp(price) OVER (PARTITION BY kind ORDER BY n ROWS 19 PRECEDING) END AS std_20,
       price - lag(price) OVER (PARTITION BY kind ORDER BY n) AS step, sum(price) OVER q AS total, max(price) OVER q AS peak, count(price) OVER q AS seen FROM kt WINDOW q AS (PARTITION BY kind ORDER BY n)""", _KTICK)(_tick_rolling)


def _tick_rank(s, p):
    t, _ = _kind_ticks(s, p)
    return S.group_rank(t, ["kind"], "price")


query("tick_rank_split_groups", "kind event_id rank_avg:1 rank_min# group_n#",
      "SELECT kind, event_id, rank() OVER q AS rank_min, rank() OVER q + (count(*) OVER (PARTITION BY kind, price) - 1) / 2.0 AS rank_avg, count(*) OVER (PARTITION BY kind) AS group_n FROM kt WINDOW q AS (PARTITION BY kind ORDER BY price)", _KTICK)(_tick_rank)
