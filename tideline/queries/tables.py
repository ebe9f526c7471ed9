"""Sources, state, risk, quality, read-side reports, text, vectors, conversations and models."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.expressions import evaluate
from tideline.functions.frames import Frame
from tideline.functions.smoothing import ewm_span
from tideline.operators import bars as B
from tideline.operators import calendar as C
from tideline.operators import evaluate as E
from tideline.operators import labels as L
from tideline.operators import ml as ML
from tideline.operators import quality as Q
from tideline.operators import regimes as Z
from tideline.operators import research as RS
from tideline.operators import returns as R
from tideline.operators import signals as SG
from tideline.operators import stats as S
from tideline.operators import risk as K
from tideline.operators import text as X
from tideline.plans import incremental as P
from tideline.queries.base import NB, TICKS, VB, W, ema_cte, lag, query, ro, span
from tideline.queries.features import _nb
from tideline.queries.scoring import _F, _fx, _ic_sql
from tideline.session import checkpoint_dir
from tideline.sources import market as M
from tideline.sources import folders as FO
from tideline.sources import vendor as V

FR = Frame()

# --- sources ---------------------------------------------------------------------------------------
query("source_filtered_bars", "id ts close:2", "SELECT id, ts, close FROM bars WHERE id IN (3, 7, 11) AND ts BETWEEN '1996-01-01' AND '1998-06-30'", NB)(
    lambda s, p: V.filtered_bars(_nb(s, p), [3, 7, 11], "1996-01-01", "1998-06-30"))
query("source_close_panel", "ts 3:2 7:2", 'SELECT ts, max(close) FILTER (id = 3) AS "3", max(close) FILTER (id = 7) AS "7" FROM bars GROUP BY ts', NB)(lambda s, p: V.close_panel(_nb(s, p), [3, 7]))
_SERIES = "abcde"  # one for each of the five venues
query("source_daily_grid", "date! " + " ".join(f"{c}:2" for c in _SERIES),
      f"SELECT CAST(g.day AS DATE) AS date, {', '.join(_SERIES)} FROM (SELECT unnest(generate_series((SELECT min(ts) FROM ticks), (SELECT max(ts) FROM ticks), INTERVAL 1 DAY)) AS day) g LEFT JOIN (SELECT ts, {', '.join(f'sum(price) FILTER (venue_id = {i}) AS {c}' for i, c in enumerate(_SERIES, 1))} FROM ticks GROUP BY ts) v ON v.ts = g.day", TICKS)(
    lambda s, p: V.daily_grid(M.order_ticks(s, p).groupBy(F.substring(F.lit(_SERIES), F.col("venue_id").cast("int"), F.lit(1)).alias("series"), F.col("ts").cast("date").alias("date")).agg(F.sum("price").alias("value")), list(_SERIES)))
query("source_parse_numbers", "l_orderkey l_linenumber l_partkey a:2 b:4",
      "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 1000, 1) * 1000 AS a, l_discount * 100 AS b FROM lineitem")(
    lambda s, p: M.table(s, p, "lineitem").withColumns({"t": F.concat(F.lit("$"), F.format_string("%.1f", F.round(F.col("l_extendedprice") / 1000, 1)), F.lit(" K")), "u": F.concat(F.format_string("%.2f", F.col("l_discount") * 100), F.lit("%"))}).withColumns({"a": V.parse_number("t"), "b": V.parse_percent("u")}))
query("source_page_items", "page_id position# href label",
      r"""SELECT page_id, p - 1 AS position, regexp_extract(item, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(item, '<[^>]*>', '', 'gs')) AS label FROM (SELECT page_id, unnest(it) AS item, unnest(range(1, len(it) + 1)) AS p FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS it FROM pages))""")(
    lambda s, p: V.page_items(M.table(s, p, "pages")))
query("source_parse_names_classify", "id name venue ticker tf symbol cls",
      """SELECT id, v || '_' || t || ', 1D_x.csv' AS name, v AS venue, t AS ticker, '1D' AS tf, CASE WHEN v = 'BINANCE' THEN 'S' || id ELSE t END AS symbol, CASE WHEN v = 'BINANCE' THEN 'crypto' ELSE 'equity' END AS cls FROM (SELECT *, 'S' || id || CASE WHEN v = 'BINANCE' THEN 'USDT' ELSE '' END AS t FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'BINANCE' ELSE 'NASDAQ' END AS v FROM supplier))""")(
    lambda s, p: (lambda d: d.withColumns(V.parse_file_name("name")).withColumns({"symbol": V.canonical_symbol("ticker", "venue"), "cls": V.asset_class("ticker", "venue")}))(
        M.table(s, p, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("BINANCE_S"), F.col("s_suppkey").cast("string"), F.lit("USDT, 1D_x.csv"))).otherwise(F.concat(F.lit("NASDAQ_S"), F.col("s_suppkey").cast("string"), F.lit(", 1D_x.csv"))).alias("name"))))
query("source_json_entries", "event_id value# ts label",
      "SELECT event_id, floor(value) AS value, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS ts, event_type AS label FROM events")(
    lambda s, p: V.json_entries(M.table(s, p, "events").select("event_id", F.to_json(F.array(F.struct(F.floor("value").cast("string").alias("value"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), F.col("event_type").alias("label")))).alias("payload")), "payload").withColumn("ts", F.col("ts").cast("timestamp_ntz")))
query("source_keep_lowest_rank", "id venue_id price:2", "SELECT id, venue_id, arg_min(price, ord) AS price FROM ticks GROUP BY id, venue_id", TICKS)(lambda s, p: V.keep_lowest_rank(M.order_ticks(s, p), ["id", "venue_id"], "ord"))

_folder = lambda s: f"{checkpoint_dir(s).rstrip('/')}/tideline-tables-{uuid.uuid4().hex}"


def _parquet_round_trip(s, p):
    """Write bars by partitions and read them back; then write other values for the even keys' partitions only."""
    folder = _folder(s)
    V.write_parquet(_nb(s, p).select("id", "ts", "close"), folder, ["id"])
    changed = V.read_parquet(s, folder).filter("id % 2 = 0").withColumn("close", F.col("close") + 1)
    other = _folder(s)
    V.write_parquet(changed, other)
    P.write_partitions(V.read_parquet(s, other), folder, ["id"])
    return V.read_parquet(s, folder)


query("source_parquet_partitions", "id# ts close:2", "SELECT id, ts, CASE WHEN id % 2 = 0 THEN close + 1 ELSE close END AS close FROM bars", NB)(_parquet_round_trip)


def _resampled_file(s, p):
    source, target = _folder(s), _folder(s)
    V.write_parquet(_nb(s, p), source)
    B.resample_file(s, source, target, "1D")
    return V.read_parquet(s, target)


query("source_resampled_file", "id open:2 high:2 low:2 close:2", "SELECT id, open, high, low, close FROM bars", NB)(_resampled_file)
query("bars_to_timeframe", "id tf ts close:2 is_partial_end", "SELECT id, '5D' AS tf, ts, close, rn % 5 <> 0 AS is_partial_end FROM bars", NB)(lambda s, p: B.to_timeframe(_nb(s, p), 5, "D"))
query("bars_union_variants", "id ts close:2 alignment_source", "SELECT id, ts, close, 'daily' AS alignment_source FROM bars UNION ALL SELECT id, ts, close, 'five_days' FROM bars WHERE rn % 5 = 0", NB)(
    lambda s, p: R.union_variants({"daily": _nb(s, p).select("id", "ts", "close"), "five_days": B.canonical(B.to_timeframe(_nb(s, p), 5, "D")).select("id", "ts", "close")}))
query("bars_conform", "id ts volume:2 venue", "SELECT id, ts, CASE WHEN volume > 1 THEN volume ELSE -1 END AS volume, 'all' AS venue FROM bars", NB)(
    lambda s, p: B.conform(_nb(s, p).withColumn("volume", F.when(F.col("volume") > 1, F.col("volume"))), {"volume": F.lit(-1.0), "venue": F.lit("all")}))
query("bars_split_valid", "id kind n#", "SELECT id, CASE WHEN rn % 10 = 0 THEN 'rejected' ELSE 'valid' END AS kind, count(*) AS n FROM bars GROUP BY ALL", NB)(
    lambda s, p: (lambda v: v[0].withColumn("kind", F.lit("valid")).select("id", "kind").unionByName(v[1].withColumn("kind", F.lit("rejected")).select("id", "kind")).groupBy("id", "kind").agg(F.count("*").alias("n")))(
        B.split_valid(_nb(s, p).withColumn("rn", FR.rn()).withColumn("high", F.when(F.col("rn") % 10 == 0, F.col("low") - 1).otherwise(F.col("high"))))))
query("eval_cagr", "id cagr:6", "SELECT id, pow(arg_max(close, ts) / arg_min(close, ts), 252.0 / nullif(count(*) - 1, 0)) - 1 AS cagr FROM bars GROUP BY id", NB)(
    lambda s, p: _nb(s, p).groupBy("id").agg(F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("b"), (F.count("*") - 1).alias("n")).withColumn("cagr", E.cagr("a", "b", "n")))
query("signal_tf_alignment", "id ts tf_alignment:6", "SELECT id, ts, avg(CASE WHEN close > open THEN 1 ELSE 0 END) - 0.5 AS tf_alignment FROM (SELECT id, ts, open, close FROM bars UNION ALL SELECT id, ts, low, high FROM bars) GROUP BY id, ts", NB)(
    lambda s, p: SG.tf_alignment(_nb(s, p).select("id", "ts", F.explode(F.array((F.col("close") > F.col("open")).cast("double"), (F.col("high") > F.col("low")).cast("double"))).alias("agreement")), ["id"]))


def _csv_round_trip(s, p):
    """Write daily bars as semicolon text and read them back typed."""
    folder = f"{checkpoint_dir(s).rstrip('/')}/tideline-csv-{uuid.uuid4().hex}"
    d = _nb(s, p).select(F.col("ts").cast("string").alias("timeOpen"), F.col("ts").cast("string").alias("timeClose"), F.lit("bad").alias("timeHigh"), F.lit("").alias("timeLow"), F.col("id").cast("string").alias("name"),
                         *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")], F.lit("n/a").alias("volume"), F.lit(None).cast("string").alias("marketCap"), F.col("ts").cast("string").alias("timestamp"))
    d.write.mode("overwrite").option("sep", ";").option("header", True).csv(folder + "/x")
    t = V.typed_daily(V.read_daily_csv(s, folder + "/x"))
    return t.select(F.col("name").cast("bigint").alias("id"), F.col("timestamp").cast("timestamp_ntz").alias("ts"), "open", "close", "volume", F.col("timeHigh").isNull().alias("bad_time"))


query("source_csv_round_trip", "id ts open:2 close:2 volume:1 bad_time", "SELECT id, ts, open, close, NULL::DOUBLE AS volume, true AS bad_time FROM bars", NB)(_csv_round_trip)
query("source_rows_after_watermark", "id n#", "SELECT id, count(*) AS n FROM ticks WHERE ts > TIMESTAMP '1998-01-01' OR id >= 20 GROUP BY id", TICKS)(
    lambda s, p: V.rows_after_watermark(M.order_ticks(s, p), M.order_ticks(s, p).select("id").distinct().filter("id < 20").withColumn("ts", F.lit("1998-01-01").cast("timestamp_ntz")), ["id"], "ts").groupBy("id").agg(F.count("*").alias("n")))
query("source_unified_history", "source id n#", "SELECT 'a' AS source, id, count(*) AS n FROM bars GROUP BY id UNION ALL SELECT 'b', id, count(*) FROM vbars GROUP BY id", NB + ", " + VB[len(TICKS) + 2:])(
    lambda s, p: V.unified_history({"a": _nb(s, p), "b": M.nation_venue_bars(s, p)}).groupBy("source", "id").agg(F.count("*").alias("n")))
query("source_perp_frame", "id day! close:2 funding:6 oi:2 mark:2",
      "SELECT b.id, CAST(b.ts AS DATE) AS day, b.close, f.f AS funding, f.o AS oi, f.m AS mark FROM bars b LEFT JOIN (SELECT id, ts, sum(price / 1e6) AS f, arg_max(price, ord) AS o, arg_max(price / 2, ord) AS m FROM ticks GROUP BY id, ts) f USING (id, ts)", NB)(
    lambda s, p: (lambda t: V.perp_frame(t.withColumn("rate", F.col("price") / 1e6), t.withColumns({"oi": F.col("price"), "ts": F.col("ord")}), t.withColumns({"mark": F.col("price") / 2, "ts": F.col("ord")}), _nb(s, p).select("id", F.col("ts").cast("date").alias("day"), "close")))(
        M.order_ticks(s, p).withColumn("day", F.col("ts").cast("date"))))
query("source_join_prices_emas", "id ts close:2 e:3", "SELECT id, ts, close, CASE WHEN rn % 2 = 0 THEN v END AS e FROM bars LEFT JOIN e USING (id, ts)", NB + ", " + ema_cte("e", "bars", "close", {"v": span(10)}))(
    lambda s, p: _nb(s, p).select("id", "ts", "close").join(ewm_span(_nb(s, p).withColumn("rn", FR.rn()), FR, "close", {"e": 10}).filter("rn % 2 = 0").select("id", "ts", "e"), ["id", "ts"], "left"))

# --- state and incremental -------------------------------------------------------------------------
_cut = lambda s, p: _nb(s, p).withColumn("rn", FR.rn()).filter("rn <= 300 - id")
query("state_table", "id min_ts max_ts last_canonical_ts n_rows# last_close:2", "SELECT id, min(ts) AS min_ts, max(ts) AS max_ts, max(ts) FILTER (rn % 7 = 0) AS last_canonical_ts, count(*) AS n_rows, arg_max(close, ts) FILTER (rn % 7 = 0) AS last_close FROM bars GROUP BY id", NB)(
    lambda s, p: P.state_from(_nb(s, p).withColumn("rn", FR.rn()), ["id"], canonical=F.col("rn") % 7 == 0, values=["close"]))
query("state_dirty_starts", "id dirty_from", "SELECT id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '1990-01-01' ELSE max(ts) FILTER (rn <= 300 - id) END AS dirty_from FROM bars GROUP BY id", NB)(
    lambda s, p: P.dirty_starts(P.state_from(_cut(s, p).filter("id % 4 <> 0"), ["id"]), _nb(s, p), "id", F.lit("1990-01-01").cast("timestamp_ntz")))
query("state_changed_keys", "id source_ts state_ts", "SELECT id, max(ts) AS source_ts, max(ts) FILTER (id % 2 = 0 OR rn <= 100) AS state_ts FROM bars GROUP BY id HAVING id % 2 = 1 AND count(*) > 100", NB)(
    lambda s, p: P.changed_keys(_nb(s, p), P.state_from(_nb(s, p).withColumn("rn", FR.rn()).filter("id % 2 = 0 OR rn <= 100"), ["id"]), ["id"]))
query("state_up_to_date", "id is_current n_scopes#", "SELECT id, bool_and(id % 3 <> 0 OR venue_id <> 2) AS is_current, count(*) AS n_scopes FROM (SELECT DISTINCT id, venue_id FROM vbars) GROUP BY id", VB)(
    lambda s, p: (lambda v: P.up_to_date(v, P.state_from(v.filter("id % 3 <> 0 OR venue_id <> 2"), ["id", "venue_id"]), ["id"], ["venue_id"]))(M.nation_venue_bars(s, p)))
query("state_backfill_detect", "id source_min min_ts", "SELECT id, min(ts) AS source_min, min(ts) FILTER (rn > 5) AS min_ts FROM bars WHERE id % 5 = 0 GROUP BY id", NB)(
    lambda s, p: P.backfilled_keys(_nb(s, p), P.state_from(_nb(s, p).withColumn("rn", FR.rn()).filter("id % 5 <> 0 OR rn > 5"), ["id"]), ["id"]))
query("state_recent_stale", "id is_recent oldest is_stale age_hours:2", "SELECT id, date_diff('day', max(ts), TIMESTAMP '2001-08-04') <= 2 AS is_recent, max(ts) AS oldest, date_diff('second', max(ts), TIMESTAMP '2001-08-04') / 3600 > 50 AS is_stale, date_diff('second', max(ts), TIMESTAMP '2001-08-04') / 3600 AS age_hours FROM bars GROUP BY id", NB)(
    lambda s, p: P.recent(P.state_from(_nb(s, p), ["id"]), ["id"], F.lit("2001-08-04").cast("date"), 2).join(P.stale_sources(_nb(s, p), ["id"], F.lit("2001-08-04").cast("timestamp_ntz"), 50.0), "id"))
query("state_compute_window", "window_start window_end", "SELECT min(m) - INTERVAL 30 DAY AS window_start, (SELECT max(ts) FROM bars) AS window_end FROM (SELECT max(ts) AS m FROM bars WHERE rn <= 300 - id GROUP BY id)", NB)(
    lambda s, p: P.compute_window(_nb(s, p), P.state_from(_cut(s, p), ["id"]), 30))
query("state_seed_and_unprocessed", "id n#", "SELECT id, count(*) AS n FROM bars WHERE (id % 2 = 0 OR ts > TIMESTAMP '1997-01-01') AND id % 2 = 1 AND rn % 10 <> 0 GROUP BY id", NB)(
    lambda s, p: (lambda d, cfg: P.unprocessed(d, P.seed_watermarks(cfg, d, "id"), d.filter("rn % 10 = 0"), "id", ["id", "ts"]))(
        _nb(s, p).withColumn("rn", FR.rn()), _nb(s, p).select("id").distinct().withColumn("watermark", F.when(F.col("id") % 2 == 1, F.lit("1997-01-01").cast("timestamp_ntz")))).groupBy("id").agg(F.count("*").alias("n")))
query("merge_upsert", "id ts close:2", "SELECT id, ts, CASE WHEN rn % 3 = 0 THEN close + 1 ELSE close END AS close FROM bars", NB)(
    lambda s, p: (lambda d: P.upsert(d.filter("rn % 5 <> 0 OR rn % 3 = 0"), d.filter("rn % 3 = 0 OR rn % 5 = 0").withColumn("close", F.when(F.col("rn") % 3 == 0, F.col("close") + 1).otherwise(F.col("close"))), ["id", "ts"]))(_nb(s, p).withColumn("rn", FR.rn())))
query("merge_insert_missing", "id ts close:2", "SELECT id, ts, CASE WHEN rn % 5 = 0 THEN close + 1 ELSE close END AS close FROM bars", NB)(
    lambda s, p: (lambda d: P.insert_missing(d.filter("rn % 5 <> 0"), d.withColumn("close", F.col("close") + 1), ["id", "ts"]))(_nb(s, p).withColumn("rn", FR.rn())))
query("merge_replace_scope", "id n# total:2", "SELECT id, count(*) FILTER (id % 2 = 1 OR rn > 10) AS n, sum(close) FILTER (id % 2 = 1 OR rn > 10) AS total FROM bars GROUP BY id", NB)(
    lambda s, p: (lambda d: P.replace_scope(d, d.filter("id % 2 = 0 AND rn > 10"), ["id"]))(_nb(s, p).withColumn("rn", FR.rn())).groupBy("id").agg(F.count("*").alias("n"), F.sum("close").alias("total")))
_sma = lambda d: d.withColumn("sma", FR.mean("close", 20)).select("id", "ts", "close", "sma", *[c for c in d.columns if c.startswith("_")])
query("refresh_incremental_equals_full", "id ts close:2 sma:3", f"SELECT id, ts, close, {ro('avg', 'close', 20)} AS sma FROM bars", NB)(
    lambda s, p: P.refresh(_nb(s, p), _sma(_nb(s, p)).withColumn("rn", FR.rn()).filter("rn <= 200 + id AND NOT (id = 4 AND rn < 5)").drop("rn"), ["id"], _sma, 19))
query("sync_variants", "alignment_source id n#", "SELECT 'a' AS alignment_source, id, count(*) AS n FROM bars WHERE ts > TIMESTAMP '1998-01-01' GROUP BY id UNION ALL SELECT 'b', id, count(*) FROM bars WHERE rn % 7 = 0 GROUP BY id", NB)(
    lambda s, p: P.sync_variants({"a": _nb(s, p), "b": _nb(s, p).withColumn("rn", FR.rn()).filter("rn % 7 = 0")}, _nb(s, p).filter("ts <= timestamp_ntz'1998-01-01'").withColumns({"alignment_source": F.lit("a"), "ts": F.least("ts", F.lit("1998-01-01").cast("timestamp_ntz"))}).unionByName(
        _nb(s, p).limit(1).withColumns({"alignment_source": F.lit("a"), "ts": F.lit("1998-01-01").cast("timestamp_ntz")}))).groupBy("alignment_source", "id").agg(F.count("*").alias("n")))
query("ema_continued_from_state", "id ts ema:3", "SELECT e.id, e.ts, v AS ema FROM e JOIN bars USING (id, ts) WHERE rn > 200", NB + ", " + ema_cte("e", "bars", "close", {"v": span(15)}))(
    lambda s, p: (lambda full: P.continue_ema(full.filter("rn > 200").select("id", "ts", "close"), full.filter("rn = 200").select("id", F.col("ts").alias("last_ts"), F.col("e").alias("last_value")), FR, "close", span(15)))(
        ewm_span(_nb(s, p).withColumn("rn", FR.rn()), FR, "close", {"e": 15})))

# --- risk ------------------------------------------------------------------------------------------
_fill = lambda s, p: _nb(s, p).withColumn("k", FR.rn()).select("id", "ts", ((F.col("k") * 7 + F.col("id")) % 5 - 2).cast("double").alias("qty"), F.col("close").alias("price")).filter("qty <> 0")
_FOLD = """fl AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS n FROM (SELECT id, ts, CAST((rn * 7 + id) % 5 - 2 AS DOUBLE) AS q, close AS p FROM bars) WHERE q <> 0),
 fo AS (WITH RECURSIVE r AS (SELECT id, n, ts, q AS pos, p AS cost, 0.0::DOUBLE AS pnl FROM fl WHERE n = 1 UNION ALL SELECT f.id, f.n, f.ts, r.pos + f.q, CASE WHEN r.pos = 0 THEN f.p WHEN r.pos * f.q > 0 THEN (r.pos * r.cost + f.q * f.p) / (r.pos + f.q) WHEN r.pos + f.q = 0 THEN 0 WHEN (r.pos + f.q) * r.pos < 0 THEN f.p ELSE r.cost END,
  r.pnl + CASE WHEN r.pos * f.q < 0 THEN sign(r.pos) * (f.p - r.cost) * least(abs(f.q), abs(r.pos)) ELSE 0 END FROM r JOIN fl f ON f.id = r.id AND f.n = r.n + 1) SELECT * FROM r)"""
query("risk_position_fold", "id ts position:2 avg_cost:3 realized_pnl:2", "SELECT id, ts, pos AS position, cost AS avg_cost, pnl AS realized_pnl FROM fo", NB + ", " + _FOLD)(lambda s, p: K.fold_fills(_fill(s, p), ["id"], ["ts"]))
_USER_FOLD = _FOLD[_FOLD.index(" fo AS"):]
query("risk_user_fills_in_slices", "id ts position:2 avg_cost:3 realized_pnl:2", "SELECT id, ts, pos AS position, cost AS avg_cost, pnl AS realized_pnl FROM fo",
      "fl AS (SELECT user_id AS id, ts, CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 + event_id % 3 ELSE -2 END AS DOUBLE) AS q, 1 + round(value, 2) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), " + _USER_FOLD)(
    lambda s, p: (lambda d: K.fold_fills_in_slices(d, ["id"], ["ts"], P.slice_edges(d, "ts", 7), _folder(s)))(
        M.table(s, p, "events").select(F.col("user_id").alias("id"), "ts", F.when(F.col("event_type").isin("click", "view"), 1 + F.col("event_id") % 3).otherwise(-2).alias("qty"), (1 + F.round("value", 2)).alias("price"))))
query("risk_circuit_breaker", "id ts loss_streak# tripped",
      f"SELECT id, ts, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id, run ORDER BY ts) AS loss_streak, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id, run ORDER BY ts) >= 3 AS tripped FROM (SELECT *, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER {W} AS run FROM (SELECT *, close - open AS pnl FROM bars))", NB)(
    lambda s, p: K.breaker_state(_nb(s, p).withColumn("pnl", F.col("close") - F.col("open")), FR))
query("risk_daily_loss", "event_id intraday_dd:5 breach",
      "SELECT event_id, (value + 100 - o) / o AS intraday_dd, (value + 100 - o) / o < -0.03 AS breach FROM events JOIN (SELECT event_type AS k, CAST(ts AS DATE) AS d, arg_min(value, ts) + 100 AS o FROM events GROUP BY ALL) ON k = event_type AND d = CAST(ts AS DATE)")(
    lambda s, p: K.daily_loss(M.event_ticks(s, p).withColumn("v", F.col("price") + 100), ["kind"], "v"))
query("risk_check_orders", "id ts reasons approved",
      """SELECT id, ts, concat_ws(',', CASE WHEN h THEN 'halted' END, CASE WHEN abs(1000 + sg * close / 10) > 0.15 * 200000 THEN 'position_cap' END, CASE WHEN 120000 + close / 10 > 0.8 * 200000 AND sg > 0 THEN 'portfolio_cap' END, CASE WHEN volume / 100 > 0.03 THEN 'daily_loss' END) AS reasons,
       NOT (h OR abs(1000 + sg * close / 10) > 30000 OR (120000 + close / 10 > 160000 AND sg > 0) OR volume / 100 > 0.03) AS approved FROM (SELECT *, id % 7 = 0 AS h, CASE WHEN close > open THEN 1 ELSE -1 END AS sg FROM bars)""", NB)(
    lambda s, p: K.check_orders(_nb(s, p).select("id", "ts", F.lit(0.1).alias("qty"), F.col("close").alias("price"), F.when(F.col("close") > F.col("open"), "buy").otherwise("sell").alias("side"), F.lit(1000.0).alias("position_value"), F.lit(200000.0).alias("portfolio_value"), F.lit(120000.0).alias("gross_value"), (-F.col("volume") / 100).alias("day_pnl_pct")),
                                _nb(s, p).select("id").distinct().withColumns({"halted": F.col("id") % 7 == 0, "max_position_pct": F.lit(0.15), "max_portfolio_pct": F.lit(0.8), "daily_loss_cap": F.lit(0.03)}), ["id"]))
query("risk_flatten_trigger", "id ts state trigger",
      f"SELECT id, ts, CASE WHEN abs(r) > 0.15 OR v > 0.0194 OR c < -0.8 THEN 'flatten' WHEN v > 0.0185 THEN 'reduce' ELSE 'normal' END AS state, CASE WHEN abs(r) > 0.15 THEN 'abs_return' WHEN v > 0.0194 THEN 'vol_spike' WHEN c < -0.8 THEN 'correlation_breakdown' WHEN v > 0.0185 THEN 'vol_spike' END AS trigger FROM (SELECT *, {ro('stddev_samp', 'r', 20)} AS v, close / 250000 - 1 AS c FROM (SELECT *, (close / {lag('close')} - 1) / 100 AS r FROM bars))", NB)(
    lambda s, p: (lambda d: d.withColumn("t", K.flatten_trigger("v", "r", F.lit(True), "c", 0.0185, 0.0194, 0.15, -0.8)).select("id", "ts", "t.*"))(_nb(s, p).withColumn("r", FR.pct("close") / 100).withColumns({"v": FR.std("r", 20), "c": F.col("close") / 250000 - 1})))
query("risk_escalations", "id event since paused_days# escalate", "SELECT id, ev AS event, ts AS since, date_diff('day', ts, TIMESTAMP '2001-08-10') AS paused_days, ev = 'pause' AND date_diff('day', ts, TIMESTAMP '2001-08-10') > 8 AS escalate FROM (SELECT *, CASE WHEN close > 150000 THEN 'pause' ELSE 'resume' END AS ev, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM bars) WHERE k = 1", NB)(
    lambda s, p: K.escalations(_nb(s, p).withColumn("event", F.when(F.col("close") > 150000, "pause").otherwise("resume")), ["id"], F.lit("2001-08-10").cast("date"), 8))
query("risk_target_and_delta", "id order_qty:5", "SELECT id, sg * least(CASE id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.1 * 0.6 ELSE least(0.1 / (volume / 10), 1) END * 0.75, 0.12) * 1e6 / close - id AS order_qty FROM (SELECT *, CASE WHEN close > open THEN 1 ELSE -1 END AS sg, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM bars) WHERE k = 1", NB)(
    lambda s, p: (lambda sig: K.order_deltas(sig.select("id", F.col("id").cast("double").alias("qty")), K.target_positions(sig, sig.select("id", F.when(F.col("id") % 3 == 0, "fixed_fraction").when(F.col("id") % 3 == 1, "confidence").otherwise("vol").alias("mode"), F.lit(0.1).alias("fraction"), F.lit(0.12).alias("max_fraction")), ["id"]), ["id"]))(
        K.recent_rows(_nb(s, p), ["id"], F.desc("ts"), 1).select("id", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("direction"), F.lit(0.6).alias("confidence"), (F.col("volume") / 10).alias("vol"), F.lit(0.75).alias("regime_mult"), F.lit(1e6).alias("portfolio_value"), F.col("close").alias("price"))))
query("risk_stop_hits", "id ts hit", "SELECT id, ts, CASE WHEN close <= 60000 THEN 'stop' ELSE 'target' END AS hit FROM bars WHERE close <= 60000 OR close >= 400000", NB)(
    lambda s, p: K.stop_hits(_nb(s, p).select("id", "ts", F.col("close").alias("price")), _nb(s, p).select("id").distinct().withColumns({"side": F.lit("long"), "stop_price": F.lit(60000.0), "target_price": F.lit(400000.0)}), ["id"]))
query("risk_recent_orders", "venue_id ord# rank#", "SELECT venue_id, ord, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY ts DESC, ord DESC) AS k FROM ticks) WHERE k <= 5", TICKS)(
    lambda s, p: K.recent_rows(M.order_ticks(s, p), ["venue_id"], F.struct("ts", "ord").desc(), 5).withColumn("rank", F.row_number().over(Window.partitionBy("venue_id").orderBy(F.desc("ts"), F.desc("ord")))))

# --- quality ---------------------------------------------------------------------------------------
_broken = lambda s, p: _nb(s, p).withColumns({"tf": F.lit("1D"), "bar_seq": FR.rn()}).filter("bar_seq % 41 <> 0").withColumn("high", F.when(F.col("bar_seq") % 50 == 0, F.col("low") - 1).otherwise(F.col("high")))
_BRK = f"""br AS (SELECT * REPLACE (CASE WHEN rn % 50 = 0 THEN low - 1 ELSE high END AS high) FROM bars WHERE rn % 41 <> 0),
 bv AS (SELECT id, '1D' AS tf, ts, 'GAP' AS reason FROM (SELECT *, {lag('ts')} AS pt FROM br) WHERE date_diff('day', pt, ts) > 9 UNION ALL SELECT id, '1D', ts, 'BAR_SEQ_GAP' FROM (SELECT *, {lag('rn')} AS pr FROM br) WHERE rn > pr + 1 UNION ALL SELECT id, '1D', ts, 'OHLC_INVALID' FROM br WHERE high < greatest(open, close, low))"""
query("quality_bar_violations", "id tf ts reason", "SELECT * FROM bv", NB + ", " + _BRK)(lambda s, p: Q.bar_violations(_broken(s, p), max_gap_days=9))
query("quality_violation_summary", "reason n# examples", "SELECT reason, n, (SELECT string_agg(e, ';' ORDER BY e) FROM (SELECT id || '|' || tf || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS e FROM bv b WHERE b.reason = g.reason ORDER BY e LIMIT 3)) AS examples FROM (SELECT reason, count(*) AS n FROM bv GROUP BY reason) g", NB + ", " + _BRK)(lambda s, p: Q.violation_summary(Q.bar_violations(_broken(s, p), max_gap_days=9)))
query("quality_unknown_timeframes", "tf", "SELECT DISTINCT CAST(volume * 30 AS BIGINT) || 'W' AS tf FROM bars WHERE volume * 30 > 52", NB)(
    lambda s, p: Q.unknown_timeframes(_nb(s, p).select(F.concat((F.col("volume") * 30).cast("bigint").cast("string"), F.lit("W")).alias("tf")), C.timeframes(s)))
query("quality_ema_bounds", "id ts e:3 violation",
      """WITH b AS (SELECT id, min(close) * 0.5 AS lo, max(close) * 1.2 AS hi FROM (SELECT *, max(ts) OVER (PARTITION BY id) AS m FROM bars) WHERE date_diff('day', ts, m) <= 90 GROUP BY id), st AS (SELECT id, avg(v) - 2 * stddev_samp(v) AS slo, avg(v) + 2 * stddev_samp(v) AS shi FROM e GROUP BY id)
       SELECT id, ts, v AS e, 'price_bounds' AS violation FROM e JOIN b USING (id) WHERE v < lo OR v > hi UNION ALL SELECT id, ts, v, 'statistical_bounds' FROM e JOIN st USING (id) WHERE v < slo OR v > shi""", NB + ", " + ema_cte("e", "bars", "close", {"v": span(4)}))(
    lambda s, p: (lambda d: Q.ema_violations(d, "e", Q.price_bounds(_nb(s, p), ["id"], 90, 0.5, 1.2), Q.statistical_bounds(d, ["id"], "e", 2.0), ["id"]))(ewm_span(_nb(s, p), FR, "close", {"e": 4}).select("id", "ts", "e")))
query("quality_rowcounts", "id tf actual# expected# diff# status",
      "SELECT id, tf, c AS actual, e AS expected, c - e AS diff, CASE WHEN c = e THEN 'ok' WHEN c < e THEN 'missing' ELSE 'extra' END AS status FROM (SELECT id, n || 'D' AS tf, count(*) FILTER (rn % n = 0) AS c, (date_diff('day', DATE '1995-01-01', DATE '2001-08-01') + 1) // n AS e FROM bars CROSS JOIN (SELECT unnest([4, 30]) AS n) GROUP BY id, n)", NB)(
    lambda s, p: Q.rowcount_report(B.count_snapshots(_nb(s, p), [4, 30]), ["id", "tf"], F.lit("1995-01-01").cast("date"), F.lit("2001-08-01").cast("date"), canonical=~F.col("is_partial_end")))
query("quality_table_tests", "id test failing# status detail",
      f"""WITH g AS (SELECT id, count(*) AS n, count(*) FILTER (date_diff('day', pt, ts) > 5) AS gaps, count(*) FILTER (NOT close BETWEEN 1000 AND 450000) AS oc FROM (SELECT *, {lag('ts')} AS pt FROM bars) GROUP BY id),
       t AS (SELECT id, n, 'unique_key' AS test, 0 AS f FROM g UNION ALL SELECT id, n, 'gaps', gaps FROM g UNION ALL SELECT id, n, 'not_null_volume', 0 FROM g UNION ALL SELECT id, n, 'range_close', oc FROM g)
       SELECT id, test, f AS failing, CASE WHEN f > 0 THEN CASE WHEN test = 'gaps' THEN 'WARN' ELSE 'FAIL' END ELSE 'PASS' END AS status, '{{"rows":' || n || ',"failing":' || f || '}}' AS detail FROM t""", NB)(
    lambda s, p: Q.table_tests(_nb(s, p), ["id"], ["id", "ts"], ["volume"], {"close": (1000.0, 450000.0)}, 5, ["id"]))
query("quality_anchor_boundaries", "id tf gap_from! gap_to!",
      f"SELECT id, '1W' AS tf, pe + 1 AS gap_from, nx - 1 AS gap_to FROM (SELECT *, lead(ps) OVER (PARTITION BY id ORDER BY ps) AS nx FROM (SELECT DISTINCT id, CAST(date_trunc('week', ts) AS DATE) AS ps, CAST(date_trunc('week', ts) AS DATE) + 6 AS pe FROM bars)) WHERE nx > pe + 1", NB)(
    lambda s, p: Q.anchor_boundary_misses(B.anchored_snapshots(_nb(s, p), [(1, "W")], "iso"), ["id", "tf"]))
_stat = lambda s, p: _nb(s, p).withColumn("status", F.when(F.col("close") < 30000, "FAIL").when(F.col("close") < 90000, "WARN").otherwise("PASS"))
query("quality_weekly_delta", "status this_week# last_week# delta#", "SELECT status, count(*) FILTER (d BETWEEN 0 AND 6) AS this_week, count(*) FILTER (d BETWEEN 7 AND 13) AS last_week, count(*) FILTER (d BETWEEN 0 AND 6) - count(*) FILTER (d BETWEEN 7 AND 13) AS delta FROM (SELECT CASE WHEN close < 30000 THEN 'FAIL' WHEN close < 90000 THEN 'WARN' ELSE 'PASS' END AS status, date_diff('day', ts, TIMESTAMP '1999-06-30') AS d FROM bars) GROUP BY status", NB)(
    lambda s, p: Q.weekly_delta(_stat(s, p), "ts", F.lit("1999-06-30").cast("date")))
query("quality_compare_tables", "n_both# only_a# only_b# column_name mismatches# max_diff:4",
      "SELECT count(*) FILTER (rn % 31 <> 0) AS n_both, count(*) FILTER (rn % 31 = 0) AS only_a, 0 AS only_b, 'close' AS column_name, count(*) FILTER (rn % 31 <> 0 AND rn % 20 = 0) AS mismatches, 5.0 AS max_diff FROM bars UNION ALL SELECT count(*) FILTER (rn % 31 <> 0), count(*) FILTER (rn % 31 = 0), 0, 'volume', count(*) FILTER (rn % 31 <> 0 AND rn % 45 = 0), 0.0 FROM bars", NB)(
    lambda s, p: (lambda d: Q.compare_tables(d, d.filter("rn % 31 <> 0").withColumns({"close": F.when(F.col("rn") % 20 == 0, F.col("close") + 5).otherwise(F.col("close")), "volume": F.when(F.col("rn") % 45 != 0, F.col("volume"))}), ["id", "ts"], ["close", "volume"]))(_nb(s, p).withColumn("rn", FR.rn())))
query("quality_snapshot_diff", "table_name before# after# change delta#", "SELECT id || 'T' AS table_name, CASE WHEN id >= 3 THEN n - CASE WHEN id % 2 = 0 THEN 0 ELSE 4 END END AS before, CASE WHEN id < 22 THEN n END AS after, CASE WHEN id < 3 THEN 'added' WHEN id >= 22 THEN 'removed' WHEN id % 2 = 1 THEN 'changed' ELSE 'same' END AS change, CASE WHEN id < 22 THEN n ELSE 0 END - CASE WHEN id >= 3 THEN n - CASE WHEN id % 2 = 0 THEN 0 ELSE 4 END ELSE 0 END AS delta FROM (SELECT id, count(*) AS n FROM bars GROUP BY id)", NB)(
    lambda s, p: (lambda c: Q.snapshot_diff(c.filter("id >= 3").withColumn("n_rows", F.col("n_rows") - F.when(F.col("id") % 2 == 0, 0).otherwise(4)), c.filter("id < 22")))(_nb(s, p).groupBy("id").agg(F.count("*").alias("n_rows")).withColumn("table_name", F.concat(F.col("id").cast("string"), F.lit("T")))))
query("quality_canonical_gate", "check_name n#", "SELECT 'null_canonical_close' AS check_name, count(*) AS n FROM bars WHERE rn % 35 = 0", NB)(
    lambda s, p: Q.canonical_gate(B.count_snapshots(_nb(s, p).withColumn("rn", FR.rn()).withColumn("close", F.when(F.col("rn") % 35 != 0, F.col("close"))), [7]), ["id", "tf"], "is_partial_end"))
query("quality_set_differences", "id ts close:2 side", "SELECT id, ts, close, 'only_a' AS side FROM bars WHERE rn % 50 = 0 UNION ALL SELECT id, ts, close + 1, 'only_b' FROM bars WHERE rn % 50 = 0 UNION ALL SELECT id, ts, close, 'only_a' FROM bars WHERE rn % 50 = 1", NB)(
    lambda s, p: (lambda d: Q.set_differences(d, d.filter("rn % 50 <> 1").withColumn("close", F.when(F.col("rn") % 50 == 0, F.col("close") + 1).otherwise(F.col("close"))), ["id", "ts", "close"]))(_nb(s, p).withColumn("rn", FR.rn())))
query("quality_first_last", "id first_same last_same", "SELECT id, id % 4 <> 0 AS first_same, id % 3 <> 0 AS last_same FROM (SELECT DISTINCT id FROM bars)", NB)(
    lambda s, p: (lambda d: Q.first_last_changes(d, d.filter("NOT (id % 4 = 0 AND rn = 1)").withColumn("volume", F.when((F.col("id") % 3 != 0) | (F.col("back") > 1), F.col("volume"))), ["id"], ["close", "volume"]))(_nb(s, p).withColumns({"rn": FR.rn(), "back": F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ts")))})))
query("quality_missing_days", "id missing_day!", "SELECT id, CAST(d AS DATE) AS missing_day FROM (SELECT id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS d FROM bars GROUP BY id) g WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.id = g.id AND b.ts = g.d)", NB)(lambda s, p: Q.missing_days(_nb(s, p), ["id"]))
query("quality_grouped_names", "n_regionkey names n#", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")(lambda s, p: Q.grouped_names(M.table(s, p, "nation"), ["n_regionkey"], "n_name"))
query("quality_edge_sample", "id stratum n#",
      """SELECT id, stratum, count(*) AS n FROM (SELECT id, CASE WHEN date_diff('day', a, ts) < 30 THEN 'beginning' WHEN date_diff('day', ts, b) < 30 THEN 'end'
       WHEN ('0x' || substr(md5(concat_ws('/', id, strftime(ts, '%Y-%m-%d'), 1)), 1, 6))::BIGINT % 10000 < 500 THEN 'random' END AS stratum FROM (SELECT *, min(ts) OVER (PARTITION BY id) AS a, max(ts) OVER (PARTITION BY id) AS b FROM bars)) WHERE stratum IS NOT NULL GROUP BY id, stratum""", NB)(lambda s, p: Q.edge_sample(_nb(s, p), ["id"], 30, 30, 5.0).groupBy("id", "stratum").agg(F.count("*").alias("n")))
query("quality_log_gap_audit", "check_name n_missing# status", "SELECT 'bars_have_ticks' AS check_name, 0 AS n_missing, 'PASS' AS status FROM (SELECT count(*) FROM bars) UNION ALL SELECT 'ticks_in_log', count(*), 'FAIL' FROM bars WHERE rn % 60 = 0", NB)(
    lambda s, p: Q.log_gap_audit({"bars_have_ticks": (_nb(s, p), M.order_ticks(s, p), ["id", "ts"]), "ticks_in_log": (_nb(s, p), _nb(s, p).withColumn("rn", FR.rn()).filter("rn % 60 <> 0"), ["id", "ts"])}))

# --- read side -------------------------------------------------------------------------------------
query("report_latest_stats", "id ts close:2 sma_30:3", f"SELECT id, ts, close, sma_30 FROM (SELECT *, {ro('avg', 'close', 30)} AS sma_30, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM bars) WHERE k = 1", NB)(
    lambda s, p: _nb(s, p).withColumn("sma_30", FR.mean("close", 30)).groupBy("id").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"), F.max_by("sma_30", "ts").alias("sma_30")))
query("report_json_params", "k# event_type n# mean_value:4", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2")(
    lambda s, p: M.event_ticks(s, p).groupBy("k", F.col("kind").alias("event_type")).agg(F.count("*").alias("n"), F.avg("price").alias("mean_value")))
query("report_trading_pnl", "id day! pnl:2 cum_pnl:2 drawdown:2", f"SELECT id, CAST(ts AS DATE) AS day, pnl, c AS cum_pnl, c - greatest(max(c) OVER {W}, 0) AS drawdown FROM (SELECT *, sum(pnl) OVER {W} AS c FROM (SELECT *, close - open AS pnl FROM bars))", NB)(
    lambda s, p: _nb(s, p).withColumn("pnl", F.col("close") - F.col("open")).withColumn("cum_pnl", F.sum("pnl").over(FR.cum)).withColumn("drawdown", F.col("cum_pnl") - F.greatest(F.max("cum_pnl").over(FR.cum), F.lit(0.0))).withColumn("day", F.col("ts").cast("date")))
query("report_symbol_join", "name n_bars# last_ts", "SELECT n_name AS name, count(*) AS n_bars, max(ts) AS last_ts FROM bars JOIN nation ON n_nationkey = id GROUP BY 1", NB)(
    lambda s, p: _nb(s, p).groupBy("id").agg(F.count("*").alias("n_bars"), F.max("ts").alias("last_ts")).join(F.broadcast(M.table(s, p, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))), "id"))
query("report_table_freshness", "table_name n# newest", "SELECT 'orders' AS table_name, count(*) AS n, max(o_orderdate) AS newest FROM orders UNION ALL SELECT 'lineitem', count(*), max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', count(*), max(ts) FROM events")(
    lambda s, p: M.table(s, p, "orders").agg(F.lit("orders").alias("table_name"), F.count("*").alias("n"), F.max("o_orderdate").alias("newest")).unionByName(M.table(s, p, "lineitem").agg(F.lit("lineitem").alias("table_name"), F.count("*").alias("n"), F.max("l_shipdate").alias("newest"))).unionByName(M.table(s, p, "events").agg(F.lit("events").alias("table_name"), F.count("*").alias("n"), F.max("ts").alias("newest"))))

query("bars_synthetic_closes", "id tf ts bar_seq# close:2", "SELECT id, '6D' AS tf, ts, rn // 6 AS bar_seq, close FROM bars WHERE rn % 6 = 0", NB)(lambda s, p: B.synthetic_closes(_nb(s, p), 6))
query("regime_emas_wide", "id ts close_ema_5:3 close_ema_20:3", "SELECT id, ts, a AS close_ema_5, b AS close_ema_20 FROM e", NB + ", " + ema_cte("e", "bars", "close", {"a": span(5), "b": span(20)}))(
    lambda s, p: Z.emas_wide(ewm_span(_nb(s, p), FR, "close", {"a": 5, "b": 20}).select("id", "ts", F.explode(F.array(F.struct(F.lit(5).alias("period"), F.col("a").alias("ema")), F.struct(F.lit(20).alias("period"), F.col("b").alias("ema")))).alias("_i")).select("id", "ts", "_i.*"), ["id"], [5, 20]))
query("portfolio_cumulative_cost", "pf# ts cost:6 cum_cost:6", "SELECT 1 AS pf, ts, c AS cost, sum(c) OVER (ORDER BY ts) AS cum_cost FROM (SELECT ts, sum(volume) * 10 / 1e4 AS c FROM bars GROUP BY ts)", NB)(
    lambda s, p: S.cumulative_cost(S.turnover_cost(_nb(s, p).select(F.lit(1).alias("pf"), "ts", "id", F.lit(0.0).alias("weight")), _nb(s, p).select(F.lit(1).alias("pf"), "ts", "id", F.col("volume").alias("weight")), ["pf", "ts"]), ["pf"]))


def _strategies(s, p):
    """Three registered strategies over the same bars: needed columns, signals, positions, metrics."""
    out = None
    for name, kw in (("rsi_mean_revert", {"lower": 45, "upper": 55}), ("breakout_atr", {"n": 10}), ("macd_crossover", {})):
        d = SG.ensure_columns(name, _nb(s, p), FR)
        d = SG.STRATEGIES[name](d, FR, **kw)
        d = d.withColumn("position", SG.position_from(FR, "entry", "exit")).select("id", "ts", "close", "position", F.lit(name).alias("strategy"))
        out = d if out is None else out.unionByName(d)
    return out


_SK = "(PARTITION BY strategy, id ORDER BY ts)"
query("strategy_sweep", "strategy cost_bps:1 n# mean_sharpe:5",
      f"""SELECT strategy, cost_bps, count(*) AS n, avg(sharpe) AS mean_sharpe FROM (SELECT strategy, id, cost_bps, avg(h * r - c * cost_bps * 1e-4) * sqrt(252) / (stddev_samp(h * r - c * cost_bps * 1e-4) + 1e-12) AS sharpe FROM (
       SELECT *, abs(coalesce(h - lag(h) OVER {_SK}, 0)) AS c FROM (SELECT *, coalesce(lag(pos) OVER {_SK}, 0) AS h, coalesce(close / lag(close) OVER {_SK} - 1, 0) AS r FROM (
       SELECT strategy, id, ts, close, coalesce(last_value(CASE WHEN exit THEN 0 WHEN entry THEN 1 END IGNORE NULLS) OVER (PARTITION BY strategy, id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS pos FROM sg JOIN bars USING (id, ts)))) CROSS JOIN (SELECT unnest([0.0, 5.0, 10.0, 15.0]) AS cost_bps) GROUP BY ALL) GROUP BY ALL""",
      NB + f""", st AS (SELECT id, ts, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM (SELECT *, close - {lag('close')} AS d FROM bars)), stn AS (SELECT id, ts, CASE WHEN row_number() OVER {W} > 1 THEN g END AS g, CASE WHEN row_number() OVER {W} > 1 THEN l END AS l FROM st), """
      + ema_cte("gg", "stn", "g", {"g": 1 / 14}) + ", " + ema_cte("ll", "stn", "l", {"l": 1 / 14}) + ", " + ema_cte("e", "bars", "close", {"f": span(12), "s": span(26)}) + ", mm AS (SELECT id, ts, f - s AS m FROM e), " + ema_cte("sl", "mm", "m", {"sg": span(9)})
      + f""", rx AS (SELECT bars.id, bars.ts, 100 - 100 / (1 + g / nullif(l, 0)) AS x FROM bars LEFT JOIN gg USING (id, ts) LEFT JOIN ll USING (id, ts)),
      sg AS (SELECT id, ts, 'rsi_mean_revert' AS strategy, NOT b AND coalesce({lag('b')}, false) AS entry, (a AND NOT coalesce({lag('a')}, false)) OR coalesce({lag('x')} > x, false) AS exit FROM (SELECT *, coalesce(x <= 45, false) AS b, coalesce(x >= 55, false) AS a FROM rx)
       UNION ALL SELECT id, ts, 'breakout_atr', coalesce(close > {lag('hi')}, false), coalesce(close < {lag('lo')}, false) FROM (SELECT *, {ro('max', 'high', 10)} AS hi, {ro('min', 'low', 10)} AS lo FROM bars)
       UNION ALL SELECT id, ts, 'macd_crossover', coalesce(m > sg AND {lag('m')} <= {lag('sg')}, false), coalesce(m < sg AND {lag('m')} >= {lag('sg')}, false) FROM mm JOIN sl USING (id, ts))""")(
    lambda s, p: E.sweep(_strategies(s, p), ["strategy", "id"], E.cost_scenarios(s, [0.0, 10.0], [0.0, 5.0])).groupBy("strategy", "cost_bps").agg(F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe")))
_GRID = [(int(g["fast"][4:]), int(g["slow"][4:])) for g in SG.default_grid("ema_trend")]
_SPANS = sorted({x for g in _GRID for x in g})
query("strategy_ema_grid", "id fast slow n# n_long# switches# total_return:4",
      f"""SELECT id, 'ema_' || f AS fast, 'ema_' || s AS slow, count(*) AS n, sum(pos) AS n_long, sum(CASE WHEN pos <> coalesce(pp, 0) THEN 1 ELSE 0 END) AS switches, sum(coalesce(pp, 0) * coalesce(r, 0)) AS total_return FROM (
       SELECT *, lag(pos) OVER (PARTITION BY id, f, s ORDER BY ts) AS pp, close / lag(close) OVER (PARTITION BY id, f, s ORDER BY ts) - 1 AS r FROM (
       SELECT id, ts, close, f, s, coalesce(last_value(CASE WHEN vf < vs AND pf >= ps THEN 0 WHEN vf > vs AND pf <= ps THEN 1 END IGNORE NULLS) OVER (PARTITION BY id, f, s ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS pos FROM (
       SELECT *, lag(vf) OVER (PARTITION BY id, f, s ORDER BY ts) AS pf, lag(vs) OVER (PARTITION BY id, f, s ORDER BY ts) AS ps FROM (
       SELECT a.id, a.ts, b.close, a.n AS f, c.n AS s, a.v AS vf, c.v AS vs FROM el a JOIN el c ON a.id = c.id AND a.ts = c.ts AND a.n <= 60 AND c.n >= 80 AND c.n >= a.n + 5 JOIN bars b ON b.id = a.id AND b.ts = a.ts)))) GROUP BY ALL""",
      NB + ", " + ema_cte("ge", "bars", "close", {f"e{n}": span(n) for n in _SPANS}) + ", el AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT id, ts, {n} AS n, e{n} AS v FROM ge" for n in _SPANS) + ")")(
    lambda s, p: (lambda g, d: d.withColumns({"_pp": F.coalesce(g.lag("position"), F.lit(0)), "_r": F.coalesce(g.pct("close"), F.lit(0.0))}).groupBy("id", "fast", "slow").agg(
        F.count("*").alias("n"), F.sum("position").alias("n_long"), F.sum((F.col("position") != F.col("_pp")).cast("int")).alias("switches"), F.sum(F.col("_pp") * F.col("_r")).alias("total_return")))(
        Frame(("id", "fast", "slow"), ("ts",)), SG.ema_grid_positions(_nb(s, p), FR, SG.default_grid("ema_trend"))))
query("experiment_expression_ic", "id ic:6 n_obs#", _ic_sql(f"(SELECT *, {ro('avg', 'close', 5, 1)} / {ro('avg', 'close', 20, 1)} - 1 AS fc FROM fx)", "id", "fc", "y1"), NB + ", " + _F)(
    lambda s, p: RS.spearman_windows(evaluate("Mean($close, 5) / Mean($close, 20) - 1", _fx(s, p), FR), ["id"], "factor", "y1"))

# --- text ------------------------------------------------------------------------------------------
query("text_duplicate_groups", "content_hash size# copies# first_id# wasted#", "SELECT sha256(text) AS content_hash, length(text) AS size, count(*) AS copies, min(doc_id) AS first_id, length(text) * (count(*) - 1) AS wasted FROM documents WHERE length(text) >= 10 GROUP BY 1, 2 HAVING count(*) > 1")(
    lambda s, p: X.duplicate_groups(M.table(s, p, "documents"), min_size=10))
query("text_keep_one", "doc_id lang source n_chars", "SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")(lambda s, p: X.keep_one(M.table(s, p, "documents"), "text", ["doc_id"]))
_TIER = "CASE WHEN {x} >= 0.95 THEN 'exact' WHEN {x} >= 0.85 THEN 'very_similar' WHEN {x} >= 0.70 THEN 'related' END"
_ND = r"""nt AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents),
rp AS MATERIALIZED (SELECT t, min(doc_id) AS id, count(*) AS copies, length(t) AS chars, string_split(t, ' ') AS w FROM nt WHERE t IS NOT NULL GROUP BY t),
sg AS MATERIALIZED (SELECT DISTINCT id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM rp)),
sn AS (SELECT id, count(*) AS n FROM sg GROUP BY id),
bo AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM sg a JOIN sg b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
ln AS MATERIALIZED (SELECT id_a, id_b, k / (x.n + y.n - k) AS similarity FROM bo JOIN sn x ON x.id = id_a JOIN sn y ON y.id = id_b JOIN rp p ON p.id = id_a JOIN rp q ON q.id = id_b
  WHERE k / (x.n + y.n - k) >= 0.7 AND least(p.chars, q.chars) >= 0.7 * greatest(p.chars, q.chars))"""
query("text_near_duplicates", "id_a id_b similarity:6 tier", f"SELECT *, {_TIER.format(x='similarity')} AS tier FROM ln", _ND)(lambda s, p: X.near_duplicates(M.table(s, p, "documents")))
query("text_duplicate_classes", "doc_id rep_id copies# n_links# best_tier class_id",
      f"""WITH RECURSIVE ed AS (SELECT id_a AS a, id_b AS b, similarity FROM ln UNION ALL SELECT id_b, id_a, similarity FROM ln), rc AS (SELECT a, a AS b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON ed.a = rc.b),
       cl AS (SELECT a AS id, min(b) AS class_id FROM rc GROUP BY a), mi AS (SELECT a AS id, count(*) AS n_links, max(similarity) AS best FROM ed GROUP BY a)
       SELECT doc_id, coalesce(rp.id, doc_id) AS rep_id, coalesce(copies, 1) AS copies, coalesce(n_links, 0) AS n_links, {_TIER.format(x='best')} AS best_tier, coalesce(class_id, rp.id, doc_id) AS class_id FROM nt LEFT JOIN rp ON rp.t = nt.t LEFT JOIN mi ON mi.id = rp.id LEFT JOIN cl ON cl.id = rp.id""", _ND)(
    lambda s, p: X.duplicate_classes(M.table(s, p, "documents")))
query("text_registry", "id content_hash n_chars# n_lines# first_line has_header", r"SELECT doc_id AS id, sha256(text) AS content_hash, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10))[1] AS first_line, starts_with(text, '---' || chr(10)) AS has_header FROM documents")(
    lambda s, p: X.text_registry(M.table(s, p, "documents")))
query("text_category_digest", "lang source n# samples",
      """SELECT lang, source, max(n) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS samples FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n,
       row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '/1') DESC, doc_id) AS k FROM documents) WHERE k <= 3 GROUP BY lang, source""")(lambda s, p: X.category_digest(M.table(s, p, "documents"), ["lang", "source"], "doc_id"))
_CENT = "cen AS (SELECT label AS query_id, list_transform(range(1, 65), lambda i: list_avg(list_transform(es, lambda e: e[i]::DOUBLE))) AS q FROM (SELECT label, list(embedding) AS es FROM embeddings GROUP BY label))"


def _centroids(s, p):
    e = M.table(s, p, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("embedding"))


query("vector_top_matches", "query_id vec_id similarity:6 rank#",
      "SELECT query_id, vec_id, sim AS similarity, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS k FROM (SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS sim FROM cen CROSS JOIN embeddings WHERE list_cosine_similarity(q, embedding::DOUBLE[]) >= 0.1)) WHERE k <= 5", _CENT)(
    lambda s, p: X.top_matches(_centroids(s, p), M.table(s, p, "embeddings"), 5, 0.1))
query("vector_conflicts", "id_a id_b similarity:5",
      "SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45")(
    lambda s, p: X.conflicts(M.table(s, p, "embeddings"), 0.45))
query("text_age_buckets", "kind bucket n# n_stale# share:6", "SELECT *, n / sum(n) OVER (PARTITION BY kind) AS share FROM (SELECT event_type AS kind, CASE WHEN a < 30 THEN '0-30' WHEN a < 60 THEN '30-60' WHEN a < 90 THEN '60-90' ELSE '90+' END AS bucket, count(*) AS n, count(*) FILTER (a >= 45) AS n_stale FROM (SELECT event_type, date_diff('day', ts, TIMESTAMP '2024-03-05') AS a FROM events) GROUP BY 1, 2)")(
    lambda s, p: X.age_buckets(M.event_ticks(s, p), "ts", F.lit("2024-03-05").cast("date"), 45, ["kind"]))
_edges = lambda s, p: M.table(s, p, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 120 + 10).alias("target")).distinct()
_nodes = lambda s, p: M.table(s, p, "customer").select(F.col("c_custkey").alias("id"))
_ED = "ed AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 120 + 10 AS target FROM lineitem)"
query("graph_orphans", "id", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT source FROM ed UNION SELECT target FROM ed)", _ED)(lambda s, p: X.orphans(_nodes(s, p), _edges(s, p)))
query("graph_dangling_targets", "source target", "SELECT source, target FROM ed WHERE target NOT IN (SELECT s_suppkey FROM supplier)", _ED)(lambda s, p: X.dangling(M.table(s, p, "supplier").select(F.col("s_suppkey").alias("id")), _edges(s, p)))
_conv = lambda s, p: M.table(s, p, "conversations")
_newer = lambda s, p: _conv(s, p).filter("NOT (conv_id % 5 = 0 AND turn >= 2) AND conv_id % 11 <> 3").withColumn("text", F.when((F.col("conv_id") % 7 == 1) & (F.col("turn") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("conv_id", F.when(F.col("conv_id") % 13 == 4, F.col("conv_id") + 1000000).otherwise(F.col("conv_id")))
query("conversation_hashes", "conv_id n_turns# content_hash", "SELECT conv_id, count(*) AS n_turns, sha256(sha256(string_agg(sha256(role || chr(31) || text), '|' ORDER BY turn))) AS content_hash FROM conversations GROUP BY conv_id")(lambda s, p: X.conversation_hash(_conv(s, p)))
query("conversation_diff", "conv_id status old_turns# new_turns#",
      """WITH nw AS (SELECT CASE WHEN conv_id % 13 = 4 THEN conv_id + 1000000 ELSE conv_id END AS conv_id, turn, role, CASE WHEN conv_id % 7 = 1 AND turn = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn >= 2) AND conv_id % 11 <> 3),
       a AS (SELECT conv_id, list(role || text ORDER BY turn) AS h FROM conversations GROUP BY 1), b AS (SELECT conv_id, list(role || text ORDER BY turn) AS h FROM nw GROUP BY 1)
       SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' WHEN len(a.h) < len(b.h) AND b.h[1:len(a.h)] = a.h THEN 'appended' WHEN len(b.h) < len(a.h) AND a.h[1:len(b.h)] = b.h THEN 'truncated' ELSE 'edited' END AS status, coalesce(len(a.h), 0) AS old_turns, coalesce(len(b.h), 0) AS new_turns FROM a FULL JOIN b ON a.conv_id = b.conv_id""")(
    lambda s, p: X.conversation_diff(_conv(s, p), _newer(s, p)))
query("conversation_flat_turns", "conv_id turn position# n_chars# is_noise", r"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, length(text) AS n_chars, regexp_matches(text, '^\s*$') OR length(text) < 30 AS is_noise FROM conversations")(lambda s, p: X.flat_turns(_conv(s, p), noise=r"^\s*$", min_chars=30))
query("conversation_summary", "conv_id n_turns# n_user# n_assistant# n_chars# first_role last_role", "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, sum(length(text)) AS n_chars, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")(lambda s, p: X.conversation_summary(_conv(s, p)))
query("conversation_phases", "phase n_messages# first_ts last_ts",
      "SELECT kind || '_' || n AS phase, count(*) AS n_messages, min(e.ts) AS first_ts, max(e.ts) AS last_ts FROM (SELECT event_type AS kind, CAST(CAST(ts AS DATE) AS VARCHAR) AS n, min(ts) AS a, min(ts) + INTERVAL 30 HOUR AS b FROM events WHERE day(ts) % 10 = 1 GROUP BY 1, 2) ph JOIN events e ON e.ts BETWEEN a AND b GROUP BY 1")(
    lambda s, p: X.phases(M.table(s, p, "events").select("ts", "event_id"), M.table(s, p, "events").filter(F.dayofmonth("ts") % 10 == 1).groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.min("ts").alias("start_ts")).select(F.concat_ws("_", "event_type", F.col("d").cast("string")).alias("phase"), "start_ts", (F.col("start_ts") + F.expr("INTERVAL 30 HOURS")).alias("end_ts"))))
query("conversation_prompt_pairs", "conv_id turn prompt answer split",
      "SELECT conv_id, turn, text AS prompt, nx AS answer, CASE WHEN ('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 6))::BIGINT % 100 < 90 THEN 'train' ELSE 'valid' END AS split FROM (SELECT *, lead(text) OVER w AS nx, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant' AND length(text) >= 20 AND length(nx) >= 20")(
    lambda s, p: X.prompt_pairs(_conv(s, p)))

# --- models ----------------------------------------------------------------------------------------
_FEATS = ["mom", "vol", "rng"]


def _labelled(s, p):
    d = _fx(s, p).withColumns({"rng": (F.col("high") - F.col("low")) / F.col("close"), "label": (F.col("y5") > 0).cast("int"), "t1": L.vertical_barrier(FR, 5)})
    return d.filter("y5 IS NOT NULL AND mom IS NOT NULL").select("id", "ts", *_FEATS, "label", "t1", "y1")


_folded = lambda s, p: E.purged_kfold(_labelled(s, p), FR, 3, 0.01)
query("ml_meta_label_report", "tp# fp# fn# n# base_rate:6 precision:4 recall:4 f1:4", None)(
    lambda s, p: ML.classifier_report(ML.with_probability(ML.fit_meta(_labelled(s, p), _FEATS), _labelled(s, p), _FEATS)))
query("ml_logit_weights", "feature weight:4 place#", None)(lambda s, p: ML.logit_weights(_labelled(s, p), _FEATS))
query("ml_importance", "feature importance:5 spread:5 n_folds#", None)(lambda s, p: ML.importance(_folded(s, p), _FEATS, [["mom"], ["vol"], ["rng"], ["rng", "vol"]]))
query("ml_single_feature", "feature mean_loss:5 n_folds#", None)(lambda s, p: ML.single_feature(_folded(s, p), _FEATS))
query("ml_regime_router", "model n# mean_prob:4", None)(lambda s, p: ML.by_regime_models(
    _labelled(s, p).withColumn("regime", F.when(F.col("vol") > 1, "busy").otherwise("calm")), _labelled(s, p).withColumn("regime", F.when(F.col("vol") > 1, "busy").otherwise("calm")), _FEATS, "regime").groupBy("model").agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob")))
query("ml_rank_cross_validate", "fold# ic_mean:5 ic_ir:5 ndcg:5", None)(lambda s, p: ML.rank_cross_validate(_folded(s, p).filter("y1 IS NOT NULL"), _FEATS, "y1"))
query("ml_double_ensemble", "id n# score:5", None)(lambda s, p: ML.double_ensemble(_labelled(s, p).filter("y1 IS NOT NULL"), _FEATS, "y1", FR).groupBy("id").agg(F.count("*").alias("n"), F.avg("score").alias("score")))


# --- folder loads ----------------------------------------------------------------------------------
def _history_reader(s, p):
    """Semicolon files named by nation; nations of region 4 are not in the listing."""
    listing = M.table(s, p, "nation").filter("n_regionkey <> 4").select(F.col("n_nationkey").cast("bigint").alias("id"))

    def read(paths):
        rows = s.read.schema("day string, close double, volume double").option("sep", ";").option("header", True).csv(paths)
        rows = rows.withColumns({"source_file": F.col("_metadata.file_path"), "named": F.regexp_extract("_metadata.file_path", r"nation=(\d+)", 1).cast("bigint")})
        return rows.join(F.broadcast(listing), F.col("named") == F.col("id"), "left").select("id", F.col("day").try_cast("timestamp_ntz").alias("ts"), "close", "volume", "source_file")

    return read


def _exported(bars, folder):
    rows = bars.select(F.col("id").alias("nation"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("day"), "close", "volume")
    rows.repartition("nation").write.mode("append").partitionBy("nation").option("sep", ";").option("header", True).csv(folder)


def _loaded_folder(s, p):
    """Two deliveries: the second repeats half a year with other closes. Every load after a delivery, and one more without."""
    folder, target, read = _folder(s), _folder(s), _history_reader(s, p)
    cut, again = (F.lit(t).cast("timestamp_ntz") for t in ("1996-01-01", "1995-06-01"))
    _exported(_nb(s, p).filter(F.col("ts") < cut), folder)
    FO.load_folder(s, folder, target, read, "id", "ts", ["close", "volume"])
    _exported(_nb(s, p).filter(F.col("ts") >= again).withColumn("close", F.col("close") + 1), folder)
    for _ in range(2):
        FO.load_folder(s, folder, target, read, "id", "ts", ["close", "volume"])
    return s.read.parquet(f"{target}/data")


query("source_folder_loads", "id# ts close:2 volume:2",
      "SELECT id, ts, CASE WHEN ts > coalesce(m, TIMESTAMP '1900-01-01') THEN close + 1 ELSE close END AS close, volume FROM bars JOIN nation ON n_nationkey = id LEFT JOIN (SELECT id, max(ts) AS m FROM bars WHERE ts < TIMESTAMP '1996-01-01' GROUP BY id) USING (id) WHERE n_regionkey <> 4", NB)(_loaded_folder)
