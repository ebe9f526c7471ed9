"""Duplicate text, near-duplicate pairs, vector search and conversation tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Col, Frame, col, div
from tideline.operators.research import connected_features
from tideline.operators.setjoin import similar_sets
from tideline.plans.segments import number_rows
from tideline.session import checkpoint_dir


# --- duplicates ------------------------------------------------------------------------------------
def duplicate_groups(df: DataFrame, text: str = "text", id_col: str = "doc_id", min_size: int = 1) -> DataFrame:
    """Groups of identical content by SHA-256: size, copies, wasted characters, smallest id.

    Only hashes are shuffled, and counts are combined on the map side, so a group of any size costs one
    row per map task.
    """
    d = df.filter(F.length(text) >= min_size).select(F.col(id_col).alias("id"), F.sha2(F.col(text), 256).alias("content_hash"), F.length(text).alias("size"))
    g = d.groupBy("content_hash", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    return g.filter("copies > 1").withColumn("wasted", F.col("size") * (F.col("copies") - 1))


def keep_one(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """One row per content: the first in ``order`` (an aggregate, not a sort of the group)."""
    h = F.sha2(F.col(text), 256)
    payload = F.struct(*df.columns)
    return df.groupBy(h.alias("_h")).agg(F.min_by(payload, F.struct(*order)).alias("_r")).select("_r.*")


def normalized(text: Col) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def shingles(text: Col, k: int = 3) -> Column:
    """Distinct word k-grams of the whole text (the text itself when it has fewer words)."""

    def grams(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + (j - 1)) for j in range(k)]))

    # the split is bound once as a lambda variable; inside the inner lambda it would run per word
    return F.array_distinct(F.element_at(F.transform(F.array(F.split(col(text), " ")), grams), 1))


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.70, length_ratio: float = 0.70, k: int = 3) -> DataFrame:
    """All pairs of different texts at the threshold or above, with similarity and tier.

    Identical normalised texts are one representative, the smallest id (``duplicate_classes`` gives the members). Similarity is Jaccard
    on the word shingles of whole texts of any length; a text shorter than ``k`` words is its own shingle. Pairs whose
    lengths differ by more than ``length_ratio`` are left out. Null texts pair with nothing. Complete: see ``setjoin``. Runs a job when called.
    """
    return links_between(representatives(df, text, id_col, k), threshold, length_ratio)


def representatives(df: DataFrame, text: str, id_col: str, k: int = 3) -> DataFrame:
    """(text_hash, id, copies, chars, tokens): one row per distinct normalised text, shingles as 64-bit hashes; checkpointed."""
    checkpoint_dir(df.sparkSession)
    d = df.select(F.col(id_col).alias("_id"), normalized(text).alias("_t")).filter("_t IS NOT NULL AND _id IS NOT NULL")
    g = d.groupBy(F.sha2("_t", 256).alias("text_hash")).agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min_by("_t", "_id").alias("_t"))
    return g.select("text_hash", "id", "copies", F.length("_t").alias("chars"), F.array_distinct(F.transform(shingles("_t", k), lambda s: F.xxhash64(s))).alias("tokens")).checkpoint()


def links_between(rep: DataFrame, threshold: float, length_ratio: float) -> DataFrame:
    j = similar_sets(rep.select("id", "tokens"), threshold)
    a, b = (rep.select(F.col("id").alias(f"id_{s}"), F.col("chars").alias(f"_{s}")) for s in "ab")
    j = j.join(a, "id_a").join(b, "id_b").filter(F.least("_a", "_b") >= length_ratio * F.greatest("_a", "_b"))
    return j.select("id_a", "id_b", "similarity", similarity_tier("similarity").alias("tier"))


def duplicate_classes(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.70, length_ratio: float = 0.70, k: int = 3) -> DataFrame:
    """One row per text: its representative (smallest id of the same normalised text), copies, links to other texts, best tier and class.

    A class is what links reach from each other, named by its smallest id. Null texts are their own. Rows of one id are one text.
    """
    rep = representatives(df, text, id_col, k)
    links = links_between(rep, threshold, length_ratio).checkpoint()
    ends = links.select(F.col("id_a").alias("id"), "similarity").unionByName(links.select(F.col("id_b").alias("id"), "similarity"))
    mine = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"), F.max("similarity").alias("_best"))
    names = connected_features(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("similarity").alias("corr")), mine.select(F.col("id").alias("feature")), 0.0)
    found = rep.select("text_hash", F.col("id").alias("rep_id"), "copies").join(mine, F.col("rep_id") == F.col("id"), "left").drop("id")
    found = found.join(names.withColumnRenamed("feature", "rep_id"), "rep_id", "left")
    d = df.select(F.col(id_col), F.sha2(normalized(text), 256).alias("text_hash")).join(found, "text_hash", "left")
    own = F.coalesce("rep_id", id_col)
    return d.select(id_col, own.alias("rep_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), similarity_tier("_best").alias("best_tier"), F.coalesce("cluster", own).alias("class_id"))


def similarity_tier(s: Col) -> Column:
    return F.when(col(s) >= 0.95, "exact").when(col(s) >= 0.85, "very_similar").when(col(s) >= 0.70, "related")


# --- vectors ---------------------------------------------------------------------------------------
def dot(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Col, b: Col) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_matches(queries: DataFrame, base: DataFrame, k: int, min_similarity: float = 0.7, vec: str = "embedding", qid: str = "query_id", vid: str = "vec_id", where: Column | None = None, max_queries: int = 1024, max_vectors: int = 16_384) -> DataFrame:
    """Top-k base vectors per query by cosine, at least ``min_similarity``, after a metadata filter; ties by the base id.

    A block join of both sides: queries are dealt to blocks of about ``max_queries`` and base vectors to blocks of about ``max_vectors`` by
    hashes of their ids, and every pair of blocks is a task. A task compares its blocks with one matrix product and keeps the k best of
    each query, so at most k rows per query and block reach the final ranking. Both counts are one-row aggregates of the
    plan: nothing is collected, the base is scanned once beside its count, and any number of queries works. Null vectors are skipped.
    """
    b = (base if where is None else base.filter(where)).filter(F.col(vec).isNotNull()).select(vid, F.col(vec).alias("_v"))
    q = queries.filter(F.col(vec).isNotNull()).select(qid, F.col(vec).alias("_v"))
    blocks = q.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(max_queries)), F.lit(1)).cast("int").alias("_nq"))
    blocks = blocks.crossJoin(b.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(max_vectors)), F.lit(1)).cast("int").alias("_nb")))  # one row each
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q = q.crossJoin(F.broadcast(blocks)).select(qid, "_v", mine(qid, "_nq").alias("_q"), every("_nb").alias("_b"))
    b = b.crossJoin(F.broadcast(blocks)).select(vid, "_v", mine(vid, "_nb").alias("_b"), every("_nq").alias("_q"))
    schema = T.StructType([queries.schema[qid], base.schema[vid], T.StructField("similarity", T.DoubleType())])

    def unit(v: pd.Series) -> np.ndarray:
        m = np.stack(v.to_numpy()).astype(float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(some: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(vectors):
            return pd.DataFrame({f.name: [] for f in schema}).astype({"similarity": float})
        vectors = vectors.sort_values(vid)
        s = unit(some["_v"]) @ unit(vectors["_v"]).T
        rounded = np.where(s >= min_similarity - 1e-12, np.round(s, 9), -2.0)
        # a stable sort of rows in id order: ties go to the smaller id
        pick = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
        rows, cols = np.repeat(np.arange(len(some)), pick.shape[1]), pick.ravel()
        ok = rounded[rows, cols] > -2.0
        return pd.DataFrame({qid: some[qid].to_numpy()[rows[ok]], vid: vectors[vid].to_numpy()[cols[ok]], "similarity": s[rows[ok], cols[ok]]})

    found = q.groupBy("_q", "_b").cogroup(b.groupBy("_q", "_b")).applyInPandas(best, schema)
    w = Window.partitionBy(qid).orderBy(F.desc(F.round("similarity", 9)), vid)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def conflicts(df: DataFrame, threshold: float = 0.85, vec: str = "embedding", vid: str = "vec_id", dims: int | None = None, block: int = 4096) -> DataFrame:
    """All vector pairs at or above the threshold, exactly.

    Vectors are dealt to blocks of about ``block`` by an id hash. A block is one binary cell, written once to the checkpoint folder,
    and every pair of blocks (each once) is the unit of work: a task reads two cells, takes their products a slice at a time and emits the
    pairs that pass. Shuffle and disk grow with the vectors, the products with the pairs. Null vectors are skipped, and so
    are those not of length ``dims`` if it is given; vectors of different lengths don't meet. Runs jobs when called.
    """
    checkpoint_dir(df.sparkSession)
    rows = df.filter(F.col(vec).isNotNull() & F.col(vid).isNotNull()).select(F.col(vid).cast("long").alias("_id"), F.size(vec).alias("_dim"), F.col(vec).cast("array<double>").alias("_v"))
    rows = rows if dims is None else rows.filter(F.col("_dim") == dims)
    blocks = max(-(-rows.count() // block), 1)
    cell = pa.schema([("_block", pa.int32()), ("_dim", pa.int32()), ("_ids", pa.binary()), ("_cell", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for b in batches:
            dims, ids, v = (b.column(c) for c in ("_dim", "_id", "_v"))
            for d in set(dims.to_pylist()) - {0}:
                own = pc.equal(dims, d)
                m = v.filter(own).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                parts.setdefault((b.column("_block")[0].as_py(), d), []).append((ids.filter(own).to_numpy(), m))
        for (k, d), some in parts.items():
            cols = (np.concatenate([i for i, _ in some]).tobytes(), np.concatenate([m for _, m in some]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([d], pa.int32()), *[pa.array([c], pa.binary()) for c in cols]], schema=cell)

    schema = "id_a long, id_b long, similarity double"
    placed = rows.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).repartitionById(blocks, "_block")
    cells = placed.mapInArrow(pack, "_block int, _dim int, _ids binary, _cell binary").checkpoint()
    other = cells.select(*[F.col(c).alias(f"{c}2") for c in cells.columns])
    pairs = cells.hint("shuffle_replicate_nl").crossJoin(other).filter("_block <= _block2 AND _dim = _dim2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                raw = {c: b.column(c)[r] for c in b.schema.names}
                ids, ids2 = (np.frombuffer(raw[c].as_buffer(), dtype=np.int64) for c in ("_ids", "_ids2"))
                m, m2 = (np.frombuffer(raw[c].as_buffer()).reshape(-1, raw["_dim"].as_py()) for c in ("_cell", "_cell2"))
                alike = raw["_block"].as_py() == raw["_block2"].as_py()
                for lo in range(0, len(ids), 256):
                    s = m[lo:lo + 256] @ m2.T
                    i, j = np.nonzero(s >= threshold)
                    p, q = ids[lo + i], ids2[j]
                    ok = p < q if alike else p != q
                    first, second = np.minimum(p, q)[ok], np.maximum(p, q)[ok]
                    for k in range(0, len(first), 65536):
                        at = slice(k, k + 65536)
                        yield pa.RecordBatch.from_pydict({"id_a": first[at], "id_b": second[at], "similarity": s[i, j][ok][at]})

    return pairs.mapInArrow(compare, schema)


# --- ages, links -----------------------------------------------------------------------------------
def age_buckets(df: DataFrame, ts: str, as_of: Column, stale_days: int = 90, by: Sequence[str] = ()) -> DataFrame:
    age = F.datediff(as_of, ts)
    b = F.when(age < 30, "0-30").when(age < 60, "30-60").when(age < 90, "60-90").otherwise("90+")
    g = df.groupBy(*by, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(age >= stale_days).alias("n_stale"))
    return g.withColumn("share", div("n", F.sum("n").over(Window.partitionBy(*by))))


def orphans(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Nodes without an edge at either end."""
    ends = edges.select(F.col("source").alias(node)).unionByName(edges.select(F.col("target").alias(node))).distinct()
    return nodes.join(ends, node, "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Edges whose target does not exist."""
    return edges.join(nodes.select(F.col(node).alias("target")).distinct(), "target", "left_anti")


# --- conversations ---------------------------------------------------------------------------------
def turn_hash(role: Col, text: Col) -> Column:
    return F.sha2(F.concat_ws("\x1f", col(role), col(text)), 256)


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Position of each turn in its conversation; a conversation of any length is numbered in blocks."""
    return number_rows(turns, Frame((conv,), (turn,)), F.floor(F.col(turn) / 4096), "position")


def conversation_hash(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", block: int = 1024) -> DataFrame:
    """Number of turns and content hash: turn hashes are folded per block, then block hashes per conversation."""
    h = numbered_turns(turns, conv, turn).select(conv, "position", turn_hash("role", "text").alias("h"))
    fold = lambda k, v: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda s: s[v]), "|"), 256)
    b = h.groupBy(conv, F.floor((F.col("position") - 1) / block).alias("_b")).agg(fold("position", "h").alias("_h"), F.count(F.lit(1)).alias("_n"))
    return b.groupBy(conv).agg(F.sum("_n").alias("n_turns"), fold("_b", "_h").alias("content_hash"))


def conversation_diff(old: DataFrame, new: DataFrame, conv: str = "conv_id") -> DataFrame:
    """added / removed / same / appended (old is a prefix) / truncated / edited, with the turn counts.

    Turns meet on (conversation, position); the first differing position per conversation decides, so no
    list of turns is ever built.
    """
    side = lambda d, n: numbered_turns(d, conv).select(conv, "position", turn_hash("role", "text").alias(n))
    j = side(old, "ha").join(side(new, "hb"), [conv, "position"], "full")
    g = j.groupBy(conv).agg(
        F.count("ha").alias("old_turns"), F.count("hb").alias("new_turns"),
        F.count_if(F.col("ha").isNotNull() & F.col("hb").isNotNull() & (F.col("ha") != F.col("hb"))).alias("_changed"))
    a, b = F.col("old_turns"), F.col("new_turns")
    status = (F.when(a == 0, "added").when(b == 0, "removed").when(F.col("_changed") > 0, "edited")
              .when(a == b, "same").when(a < b, "appended").otherwise("truncated"))
    return g.select(conv, status.alias("status"), "old_turns", "new_turns")


def flat_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", noise: str = r"^\s*$|^\W+$", min_chars: int = 3) -> DataFrame:
    """Turns numbered in order with a noise flag."""
    return numbered_turns(turns, conv, turn).withColumns({"n_chars": F.length("text"), "is_noise": F.col("text").rlike(noise) | (F.length("text") < min_chars)})


def conversation_summary(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return turns.groupBy(conv).agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.sum(F.length("text")).alias("n_chars"), F.min_by("role", turn).alias("first_role"), F.max_by("role", turn).alias("last_role"))


def phases(messages: DataFrame, bounds: DataFrame, ts: str = "ts") -> DataFrame:
    """Messages per named phase by interval join on day buckets."""
    from tideline.operators.asof import interval_join

    m, b = messages.withColumn("_g", F.lit(0)), bounds.withColumn("_g", F.lit(0))
    return interval_join(m, b, ["_g"], ts, "start_ts", "end_ts", "day").groupBy("phase").agg(F.count(F.lit(1)).alias("n_messages"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def text_registry(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Hash, size, line count, first line and header field of each text."""
    return df.select(
        F.col(id_col).alias("id"), F.sha2(F.col(text), 256).alias("content_hash"), F.length(text).alias("n_chars"),
        F.size(F.split(F.col(text), "\n")).alias("n_lines"), F.regexp_extract(text, r"^([^\n]*)", 1).alias("first_line"), F.col(text).startswith("---\n").alias("has_header"))


def category_digest(df: DataFrame, by: Sequence[str], id_col: str, n: int = 3, seed: int = 1) -> DataFrame:
    """Counts and n sample ids per category, largest seeded md5 of the id first (bounded ranking in two steps)."""
    from tideline.operators.stats import top_k

    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    s = top_k(df.select(*by, id_col, F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"/{seed}")).cast("binary")).alias("_u")), by, "_u", n, id_col)
    return counts.join(s.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.col(id_col).cast("string"))), ",").alias("samples")), list(by), "left")


def prompt_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", min_chars: int = 20, train_share: float = 0.9) -> DataFrame:
    """(prompt, answer) of consecutive user / assistant turns, with a split by conversation hash."""
    n = numbered_turns(turns, conv, turn)
    ask = n.filter((F.col("role") == "user") & (F.length("text") >= min_chars))
    reply = n.filter((F.col("role") == "assistant") & (F.length("text") >= min_chars)).select(conv, (F.col("position") - 1).alias("position"), F.col("text").alias("answer"))
    d = ask.join(reply, [conv, "position"])
    u = F.conv(F.substring(F.md5(F.col(conv).cast("string")), 1, 6), 16, 10).cast("bigint") % 100
    return d.select(conv, turn, F.col("text").alias("prompt"), "answer", F.when(u < int(train_share * 100), "train").otherwise("valid").alias("split"))
