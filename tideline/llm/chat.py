"""Chat formatting: reply trees to one formatted conversation each.

``ranked_leaves`` and ``chosen_paths`` work on a message table (conv, node, parent): iterative self-joins by pointer
doubling give every node the sum of scores and the depth on its way to the root in log2(depth) rounds, so a tree
of n messages costs O(n log n) rows; root-to-leaf paths are not written out for every branch. Branches are ranked
by mean score, then depth, then smallest leaf; the nodes of the best ``branches`` leaves of each conversation are then
collected top-down through the same jump table. ``format_turns`` gives one row per turn with its formatted part: a
conversation is the concatenation of its parts, so no conversation has to fit in one cell or one task's memory.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In texts and roles a control string is escaped by one backslash
after its ``<`` (``<\\|``; ``<``, k backslashes, ``|`` becomes k + 1), roles also escape line feeds and backslashes. No
escaped text holds ``<|``, and ``read_back`` restores both exactly.

Null text or role: empty. Null turn sorts first; ties sort by role, then text. Null conversation ids form one
conversation. A node whose parent is missing from its conversation is a root. Nodes on a cycle have no root and
take no part (they are no root-to-leaf path).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import scratch

START, END = "<|im_start|>", "<|im_end|>\n"
PART = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
RAISED = re.compile(r"<\\(\\*)\|")


def escape_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    slashes = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(slashes, F.lit("\n"), F.lit("\\n")), F.lit("<|"), F.lit("<\\p"))


def unescape_text(text: str) -> str:
    return RAISED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def linear_parents(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows by turn as the simplest reply tree: each answers the one before. Adds node (1, 2, ...) and parent."""
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    return turns.withColumn("node", F.row_number().over(order).cast("long")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def to_root(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """nodes: conv, node, parent, score -> (conv, node, depth, total) over its path to the root, and the jump tables
    (conv, node, up) of 1, 2, 4, ... steps. Conversations take as many rounds as the deepest needs."""
    known = nodes.select(F.col("conv").alias("c"), F.col("node").alias("up")).distinct()
    step = nodes.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("up")), "left").select(
        "conv", "node", "up", F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")
    )
    step, jumps, done = scratch(step), [], None
    most = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while True:
        ended, live = step.where("up is null"), step.where("up is not null")
        done = ended if done is None else done.union(ended)
        # nodes that have reached their root take no part in later rounds; on a cycle none ever does
        if 1 << len(jumps) > most or not live.limit(1).count():
            return done, jumps
        jumps.append(live.select("conv", "node", "up"))
        above = done.union(live).select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("depth").alias("d"), F.col("total").alias("t"))
        step = scratch(
            live.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n")), "left")
            .select("conv", "node", F.col("u").alias("up"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("t", F.lit(0.0))).alias("total"))
        )


def ranked_leaves(nodes: DataFrame, branches: int = 1) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Best leaves (conv, node, rank) of each conversation, every node's depth, and the jump tables."""
    state, jumps = to_root(nodes)
    inner = nodes.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    leaves = state.alias("s").join(inner.alias("i"), F.col("s.conv").eqNullSafe(F.col("i.conv")) & (F.col("s.node") == F.col("i.node")), "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    return best.select("conv", "node", "rank"), state, jumps


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, rank, node, depth) of every message on the best root-to-leaf paths, root at depth 1."""
    best, state, jumps = ranked_leaves(nodes, branches)
    on = scratch(best)
    for jump in reversed(jumps):  # halves first: after the step of size 1 every ancestor is in
        j = jump.select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        higher = on.join(j, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv", F.col("up").alias("node"), "rank")
        on = scratch(on.union(higher))
    on = on.distinct()
    s = state.select(F.col("conv").alias("c"), F.col("node").alias("n"), "depth")
    return on.join(s, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv", "rank", "node", "depth")


def format_turns(turns: DataFrame, *, branches: int = 1, assistant: str = "assistant") -> DataFrame:
    """turns: conv_id, node, parent, role, text[, score] -> conv_id, rank, depth, part, loss_from, loss_to.

    Character positions loss_from..loss_to of ``part`` are under the loss mask (an assistant's text; else both null).
    """
    score = F.col("score") if "score" in turns.columns else F.lit(0.0)
    turns = scratch(turns)
    nodes = turns.select(F.col("conv_id").alias("conv"), "node", "parent", score.alias("score"))
    path = chosen_paths(nodes, branches)
    t = turns.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), escape_role(F.col("role")).alias("r"), escape_text(F.col("text")).alias("x"), F.coalesce(F.col("role") == assistant, F.lit(False)).alias("own"))
    start = F.length("r") + len(START) + 1
    return path.join(t, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select(
        F.col("conv").alias("conv_id"), "rank", "depth", F.concat(F.lit(START), "r", F.lit("\n"), "x", F.lit(END)).alias("part"),
        F.when(F.col("own"), start).alias("loss_from"), F.when(F.col("own"), start + F.length("x")).alias("loss_to"),
    )


DIGEST = "conv_id long, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each formatted conversation, parsed back from its parts in order.

    The rows of a conversation pass through one task as a stream (a digest is sequential); only the running digests
    are held, never the conversation.
    """
    names = [f.split() for f in DIGEST.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in names])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = turns = loss = None
        n = chars = loss_chars = 0
        done: list[tuple] = []

        def close() -> None:
            if turns is not None:
                done.append((*key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for conv, rank, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rank", "part", "loss_from", "loss_to"))):
                if turns is None or key != (conv, rank):
                    close()
                    key, turns, loss, n, chars, loss_chars = (conv, rank), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text in PART.findall(part):
                    n += 1
                    turns.update(f"{unescape_role(role)}\n{unescape_text(text)}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    own = unescape_text(part[a:b])
                    loss_chars += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
                chars += len(part)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    dealt = parts.repartition("conv_id", "rank").sortWithinPartitions("conv_id", "rank", "depth")
    return dealt.select("conv_id", "rank", "part", "loss_from", "loss_to").mapInArrow(digest, DIGEST)
