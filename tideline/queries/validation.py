"""Validation gauntlet over the candidate features of all nation bars."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from tideline.functions.frames import Frame, div
from tideline.operators import gauntlet as G
from tideline.operators import resample as RS
from tideline.queries.base import NB, W, lag, lead, query, ro
from tideline.session import checkpoint_dir
from tideline.sources import market as M

FR = Frame(["id"], ["ts"])
CANDIDATES = ("body", "momentum_20", "momentum_5", "range_place", "reversal", "volume_ratio")


def shared_folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tideline-tables-{uuid.uuid4().hex}"


def candidate_features(bars):
    """Six candidates and the next bar's return; nine places, so that ties are ties whatever adds them up."""
    c = F.col("close")
    cols = {
        "body": div(c - F.col("open"), c), "momentum_20": div(c, FR.lag("close", 20)) - 1, "momentum_5": div(c, FR.lag("close", 5)) - 1,
        "range_place": div(c - F.col("low"), F.col("high") - F.col("low")), "reversal": 1 - div(c, FR.lag("close")), "volume_ratio": div("volume", FR.mean("volume", 20)),
        "y": FR.forward_return("close", 1),
    }
    return bars.select("id", "ts", *[F.round(v, 9).alias(k) for k, v in cols.items()])


_CHOICES = list(combinations(range(6), 2))
_FACTORS = ", ".join(map(str, RS.multipliers(1000)))


def _ranks(part: str) -> str:
    one = lambda c: f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0"
    return f"{one('x')} AS rx, {one('y')} AS ry"


_G = NB + f""", feat AS (SELECT id, ts, round((close - open) / close, 9) AS body, round(close / {lag('close', 20)} - 1, 9) AS momentum_20, round(close / {lag('close', 5)} - 1, 9) AS momentum_5,
  round((close - low) / nullif(high - low, 0), 9) AS range_place, round(1 - close / {lag('close')}, 9) AS reversal, round(volume / {ro('avg', 'volume', 20)}, 9) AS volume_ratio,
  round({lead('close')} / close - 1, 9) AS y, row_number() OVER {W} AS r, count(*) OVER (PARTITION BY id) AS nn FROM bars),
tall AS (SELECT id, ts, y, CASE WHEN r <= floor(nn * 0.8) THEN 'train' ELSE 'held_out' END AS part, unnest([{', '.join(repr(c) for c in CANDIDATES)}]) AS candidate, unnest([{', '.join(CANDIDATES)}]) AS x FROM feat),
good AS (SELECT candidate, id FROM tall GROUP BY 1, 2 HAVING count(x) FILTER (part = 'train') > 0 AND count(x) FILTER (part = 'train') >= 0.5 * count(*) FILTER (part = 'train')),
pr AS (SELECT tall.*, row_number() OVER (PARTITION BY candidate, part ORDER BY id, ts) AS pos FROM tall JOIN good USING (candidate, id) WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS MATERIALIZED (SELECT candidate, pos, count(*) OVER (PARTITION BY candidate) AS n, {_ranks('candidate')}, ('0x' || substr(md5(candidate || '/' || pos || '/42'), 1, 8))::BIGINT AS h FROM pr WHERE part = 'train'),
bl AS (SELECT *, h % CAST(ceil(n / 65536.0) AS BIGINT) AS blk FROM rk WHERE n >= 100),
ks AS MATERIALIZED (SELECT candidate, blk, rx, n, row_number() OVER (PARTITION BY candidate, blk ORDER BY h, pos) - 1 AS k, count(*) OVER (PARTITION BY candidate, blk) AS m FROM bl),
js AS MATERIALIZED (SELECT candidate, blk, ry, g, row_number() OVER (PARTITION BY candidate, blk, g ORDER BY (h % 2147483647) * f % 2147483647, h, pos) - 1 AS j
  FROM bl, (SELECT unnest([{_FACTORS}]) AS f, unnest(range(0, 10)) AS g)),
sh AS MATERIALIZED (SELECT candidate, blk, rx, s, (k + (1 + s * m // 100) % m) % m AS j FROM ks, range(0, 100) t(s)),
sm AS (SELECT candidate, g * 100 + s AS b, sum(rx * ry) AS product FROM sh JOIN js USING (candidate, blk, j) GROUP BY 1, 2),
wh AS (SELECT candidate, count(*) AS n_obs, sum(rx * ry) AS p, stddev_pop(rx) AS sx, stddev_pop(ry) AS sy FROM bl GROUP BY 1),
nul AS (SELECT candidate, n_obs, (p / n_obs - ((n_obs + 1) / 2.0) * ((n_obs + 1) / 2.0)) / nullif(sx * sy, 0) AS ic, abs((product / n_obs - ((n_obs + 1) / 2.0) * ((n_obs + 1) / 2.0)) / nullif(sx * sy, 0)) AS c FROM sm JOIN wh USING (candidate)),
pt AS (SELECT candidate, ic, n_obs, avg(CAST(c >= abs(ic) AS INTEGER)) AS p, quantile_cont(c, 0.95) AS null_95 FROM nul GROUP BY ALL),
fam AS (SELECT candidate, n_pairs, ic, n_obs, null_95, coalesce(p, 1.0) AS p_value, coalesce(abs(ic) >= null_95, false) AS permutation_passed, n_pairs >= 100 AS enough
  FROM (SELECT candidate, coalesce(n, 0) AS n_pairs FROM (SELECT unnest([{', '.join(repr(c) for c in CANDIDATES)}]) AS candidate) LEFT JOIN (SELECT candidate, count(*) AS n FROM rk GROUP BY 1) USING (candidate)) LEFT JOIN pt USING (candidate)),
bh AS (SELECT *, least(1.0, min(p_value * 6 / k) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING)) AS p_adj FROM (SELECT *, count(*) OVER (ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS k FROM fam)),
two AS MATERIALIZED (SELECT *, p_adj <= 0.05 AND enough AS fdr_passed FROM bh),
fo AS (SELECT candidate, x, y, CASE WHEN pos <= (n % 6) * (n // 6 + 1) THEN (pos - 1) // (n // 6 + 1) ELSE n % 6 + (pos - 1 - (n % 6) * (n // 6 + 1)) // (n // 6) END AS fold
  FROM (SELECT *, count(*) OVER (PARTITION BY candidate) AS n FROM pr JOIN two USING (candidate) WHERE part = 'train' AND fdr_passed) WHERE n >= 30),
pa AS (SELECT candidate, path, {_ranks('candidate, path')} FROM fo JOIN (VALUES {', '.join(f'({i}, {k})' for i, c in enumerate(_CHOICES) for k in c)}) v(path, fold) USING (fold)),
pc AS (SELECT candidate, path, corr(rx, ry) AS c FROM pa GROUP BY 1, 2 HAVING count(*) >= 10),
cp AS (SELECT candidate, count(*) AS n_paths, avg(c) AS cpcv_mean, stddev_pop(c) AS cpcv_std, avg(CAST(c > 0 AS INTEGER)) AS cpcv_positive, avg(c) > 0 AND avg(CAST(c > 0 AS INTEGER)) > 0.6 AS cpcv_passed FROM pc WHERE NOT isnan(c) GROUP BY 1),
hr AS (SELECT candidate, two.ic, {_ranks('candidate')} FROM pr JOIN two USING (candidate) JOIN cp USING (candidate) WHERE part = 'held_out' AND cpcv_passed),
ho AS (SELECT candidate, count(*) AS held_out_n, CASE WHEN count(*) >= 20 THEN corr(rx, ry) END AS held_out_ic, any_value(ic) AS ic0 FROM hr GROUP BY 1),
hs AS (SELECT *, CASE WHEN held_out_n < 20 THEN 'insufficient' WHEN coalesce(sign(held_out_ic) <> sign(ic0), true) THEN 'failed_sign_flip' WHEN abs(held_out_ic) < 0.01 THEN 'marginal' ELSE 'passed' END AS held_out_status FROM ho),
al AS (SELECT two.*, n_paths, cpcv_mean, cpcv_std, cpcv_positive, coalesce(cpcv_passed, false) AS cpcv_passed, held_out_n, held_out_ic, held_out_status,
  coalesce(held_out_status = 'passed', false) AS st, coalesce(held_out_status = 'marginal', false) AS mg FROM two LEFT JOIN cp USING (candidate) LEFT JOIN hs USING (candidate)),
ru AS (SELECT *, count(*) FILTER (st) OVER () AS s1, count(*) FILTER (st OR mg) OVER () AS s2 FROM al)"""

query(
    "research_validation_gauntlet",
    "candidate n_pairs# ic:6 p_value:6 null_95:6 permutation_passed p_adj:6 fdr_passed n_paths# cpcv_mean:6 cpcv_std:6 cpcv_positive:6 cpcv_passed held_out_n# held_out_ic:6 held_out_status left_at promoted rule",
    """SELECT *, CASE WHEN NOT enough THEN 'insufficient_data' WHEN NOT fdr_passed THEN 'fdr' WHEN NOT cpcv_passed THEN 'cpcv' WHEN NOT st THEN 'held_out' ELSE 'passed_all' END AS left_at,
  CASE WHEN s1 >= 2 THEN 'strict' WHEN s2 >= 2 THEN 'same_sign' ELSE 'one_strong' END AS rule,
  CASE WHEN s1 >= 2 THEN st WHEN s2 >= 2 THEN st OR mg ELSE st OR coalesce(fdr_passed AND abs(ic) > 0.03 AND p_value < 0.01, false) END AS promoted FROM ru""",
    _G,
)(lambda s, p: G.gauntlet(candidate_features(M.nation_bars(s, p)), CANDIDATES, shared_folder(s)))
