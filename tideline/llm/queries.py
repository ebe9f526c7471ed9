"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import ann, chat, decontaminate, langid, licenses, lm, pieces, repair, similar, simhash, token_counts, toxicity, whiten
from tideline.llm.common import id_remainder, prepare, table

Program = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Program] = {}
ORACLES: dict[str, str] = {}


def register(fn: Program) -> Program:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@register
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@register
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", licenses.scan_licenses(docs, F.col("text")).alias("s")).select("doc_id", "s.*")
    names = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    base, spans = F.col("base.label"), F.col("spans.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, spans)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )


@register
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), held_out=id_remainder(F.col("doc_id"), 7) == 2)


@register
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return hits.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


ORACLES["op5_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS p FROM (SELECT item_id, w[i : i + 9] AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, win.n, item_id FROM dp JOIN win ON dp.p = win.p AND dp.n = win.n),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)"""


@register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0)
    profiles = langid.learn(docs.where("not held_out"), F.col("text"), F.col("lang"))
    found = docs.select("doc_id", "held_out", langid.predict(docs, F.col("text"), profiles).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


@register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register
def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, where=id_remainder(F.col("doc_id"), 5) != 0)
    scored = docs.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(docs, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    parts = chat.format_turns(chat.linear_parents(turns.unionByName(extra)))
    return chat.read_back(parts).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLES["op10_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
      (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) v(conv_id, turn, role, text)))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@register
def op11_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op11_minhash_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT DISTINCT a AS r, a AS t FROM link UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.t),
least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN least.r IS NULL THEN doc_id ELSE component_id END AS component_id,
  coalesce(doc_id = CASE WHEN least.r IS NULL THEN doc_id ELSE component_id END, false) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)"""


@register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repair(repair.damaged(turns))
    every = turns.select("conv_id").distinct().withColumn("c", repair.conversation_key(F.col("conv_id")))
    rows = every.join(found, "c", "left").select("conv_id", *found.columns[1:])
    return rows.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"]).fillna(hashlib.sha256().hexdigest(), ["repaired_sha256"])


ORACLES["op12_conversation_repair"] = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, list_reduce([(xor(c, b) & 255), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, x: xor(e >> 1, 3988292384 * (e & 1))))), 4294967295) % 20 AS h
  FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, role AS r0, text AS t0, k,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS k FROM o WHERE h <> 0)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, k) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM g),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS pr,
    count(*) OVER (PARTITION BY conv_id) AS n, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM p),
x AS (SELECT c, i, n, role, text, role[1] AS u, coalesce(fault IN ('blank', 'duplicate'), false) AS bad, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t FROM f),
back AS (
  SELECT c, n + 1 AS i, n, 0 AS f0, 10 AS f1, 5 AS f2, 0 AS f3 FROM x WHERE i = n
  UNION ALL
  SELECT c, i, n, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3, 10 + b2), least(b3, 5 + b2, 10 + b3) FROM (
    SELECT x.c, x.i, x.n,
      least(2 + f0, CASE WHEN NOT bad AND u = 's' THEN t + f1 END, CASE WHEN NOT bad AND u = 'u' THEN t + f2 END, CASE WHEN NOT bad THEN 1 + t + f2 END) AS b0,
      least(2 + f1, CASE WHEN NOT bad AND u = 'u' THEN t + f2 END, CASE WHEN NOT bad THEN 1 + t + f2 END) AS b1,
      least(2 + f2, CASE WHEN NOT bad AND u = 'a' THEN t + f3 END, CASE WHEN NOT bad THEN 1 + t + f3 END) AS b2,
      least(2 + f3, CASE WHEN NOT bad AND u = 'u' THEN t + f2 END, CASE WHEN NOT bad THEN 1 + t + f2 END) AS b3
    FROM back JOIN x ON x.c = back.c AND x.i = back.i - 1)),
j AS (SELECT b.c, b.i, b.n, [f0, f1, f2, f3] AS f, lead([f0, f1, f2, f3]) OVER (PARTITION BY b.c ORDER BY b.i) AS g, role, text, u, bad, t
  FROM back b LEFT JOIN x ON x.c = b.c AND x.i = b.i),
walk AS (
  SELECT c, n, CAST(1 AS BIGINT) AS i, 0 AS q, 0 AS step, '' AS l, CAST(NULL AS VARCHAR) AS piece FROM j WHERE i = 1
  UNION ALL
  SELECT c, n, CASE WHEN l = 'I' THEN i ELSE i + 1 END, CASE WHEN l = 'D' THEN q WHEN l = 'K' THEN kq ELSE nq END, step + 1, l,
    CASE l WHEN 'K' THEN role || ':' || text WHEN 'R' THEN CASE nq WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text
      WHEN 'I' THEN CASE nq WHEN 2 THEN 'user' ELSE 'assistant' END || ':' END
  FROM (SELECT *, CASE WHEN i <= n AND f[q + 1] = 2 + g[q + 1] THEN 'D' WHEN f[q + 1] = 5 + f[nq + 1] THEN 'I'
      WHEN NOT bad AND kq IS NOT NULL AND f[q + 1] = t + g[kq + 1] THEN 'K' WHEN NOT bad AND f[q + 1] = 1 + t + g[nq + 1] THEN 'R' END AS l
    FROM (SELECT w.c, w.n, w.i, w.q, w.step, j.f, j.g, j.role, j.text, j.bad, j.t, CASE w.q WHEN 2 THEN 3 ELSE 2 END AS nq,
        CASE WHEN u = 's' AND w.q = 0 THEN 1 WHEN u = 'a' AND w.q = 2 THEN 3 WHEN u = 'u' AND w.q <> 2 THEN 2 END AS kq
      FROM walk w JOIN j ON j.c = w.c AND j.i = w.i)) WHERE l IS NOT NULL),
done AS (SELECT c, string_agg(l, '' ORDER BY step) AS audit, string_agg(piece, chr(10) ORDER BY step) AS body FROM walk GROUP BY c),
best AS (SELECT c, f[1] AS cost FROM j WHERE i = 1),
stats AS (SELECT c, any_value(conv_id) AS id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pr IS NOT NULL AND pr || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN stats ON ids.conv_id IS NOT DISTINCT FROM stats.id LEFT JOIN done USING (c) LEFT JOIN best USING (c)"""


@register
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))
