"""Conversation structure repair by an auction on the lattice of edits.

A repaired conversation's roles read ``(s?(ua)+)?`` (initials of system, user, assistant). The rows of a conversation and the four
states of that pattern span a lattice; Delete (2), Insert of an empty user or assistant text (5), Keep (0) and Rerole to user
or assistant (1) are its arcs, a truncated row that stays costs 5 more, and blank or repeated rows have no arc but Delete.

``auction`` is the auction algorithm for shortest paths: nodes hold integer prices with price(i) <= cost(i, j) + price(j). A path grows
from an origin: if the best arc out of its end costs more than the end's price, the price rises to it and the path contracts by the
end; else the arc is tight and the path extends along it. It ends at the goal or at a node that an earlier path has settled. Origins are
taken from the last row backwards, so prices of all nodes converge to their distance to the goal; an arc is then on a cheapest path
exactly if it is tight. ``trace`` follows tight arcs by their initials (D < I < K < R), which gives the ASCII-least audit: an audit
fixes the state after each edit, so only one node is ever at the front.

A conversation may be of any length. Rows are numbered from counts of (conversation, turn range) and cut to segments of ``SEGMENT`` rows,
of which only one character a row travels. Segments of longer conversations are solved for each state they can end in; these 4 x 4 costs
are folded from the last segment to the first and give every segment the prices of its end; segments are traced from each state they
can start in, and a second fold picks. No task holds more than a segment's rows, or the 16 costs of each of a conversation's segments. The
digest of the repaired rows is sequential by its nature: they pass through one task as a stream.

Defined results. Null roles and texts are one space, and so is a null in the text that chooses the damage. Null turns sort first; rows of
one turn sort by role and text. A null conversation id is a conversation. Roles with other initials (an empty one has none) can't be kept.
Rows without any row left after damage: zeros and an empty audit. An empty table gives no rows. Columns beside the four named may
have any names. Very long texts only pass through string functions and the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.llm.common import scratch
from tideline.plans.segments import number_rows

SEGMENT, SHORT = 4096, 64
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States: nothing yet, after system, after user, after assistant; and the state that one more user or assistant row leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
SPACES = " \t\n\x0b\x0c\r"

Arcs = list[list[tuple[str, int, int]]]
Exits = tuple[int | None, ...]


def kept_state(initial: str, state: int) -> int | None:
    """State after a row with this initial is kept, if it can be."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return USER if initial == "u" and state != USER else None


def lattice(symbols: str, exits: Exits | None) -> Arcs:
    """Arcs (initial, cost, node) of each node 4 * row + state, by initial. ``symbols``: one character a row, its role's initial (x:
    another), upper case if truncated, "-" if it has to go. ``exits``: costs from each state after the last row to the goal (the last
    node); None: the conversation ends here, which the states ``ENDS`` allow."""
    n, goal, out = len(symbols), 4 * len(symbols) + 4, []
    for i, symbol in enumerate(symbols):
        extra = CUT if symbol.isupper() else 0
        for q in range(4):
            arcs = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + NEXT[q])]
            if symbol != "-":
                kept = kept_state(symbol.lower(), q)
                if kept is not None:
                    arcs.append(("K", extra, 4 * i + 4 + kept))
                arcs.append(("R", REROLE + extra, 4 * i + 4 + NEXT[q]))
            out.append(arcs)
    for q in range(4):
        if exits is None:
            out.append([("I", INSERT, 4 * n + NEXT[q])] + [("", 0, goal)] * (q in ENDS))
        else:
            out.append([] if exits[q] is None else [("", exits[q], goal)])
    out.append([])
    return out


def auction(arcs: Arcs) -> list[int | None]:
    """Converged price (cheapest cost to the last node) of every node, None where it can't be reached."""
    goal = len(arcs) - 1
    into: list[list[int]] = [[] for _ in arcs]
    for i, some in enumerate(arcs):
        for _, _, j in some:
            into[j].append(i)
    price: list[int | None] = [None] * len(arcs)
    price[goal], waiting = 0, [goal]
    while waiting:
        for i in into[waiting.pop()]:
            if price[i] is None:
                price[i] = 0
                waiting.append(i)
    settled = [False] * len(arcs)
    settled[goal] = True
    for last in range(goal - 1, -1, -4):
        row = [i for i in range(last, last - 4, -1) if price[i] is not None]
        if last + 4 < goal:  # no node is nearer than the nearest of the next row: a feasible first price
            nearest = min((price[j] for j in range(last + 1, last + 5) if price[j] is not None), default=0)
            for i in row:
                price[i] = nearest
        for origin in row:
            path = [] if settled[origin] else [origin]
            while path:
                end = path[-1]
                best, to = min((cost + price[j], j) for _, cost, j in arcs[end] if price[j] is not None)
                if best > price[end]:
                    price[end] = best
                    if len(path) > 1:
                        path.pop()
                elif settled[to]:
                    break
                else:
                    path.append(to)
            for i in path:
                settled[i] = True
    return price


def trace(arcs: Arcs, price: list[int | None], node: int) -> tuple[str, int, int]:
    """(audit, cost, last node before the goal) of the ASCII-least path of tight arcs."""
    audit, total = [], 0
    while True:
        label, cost, to = next(a for a in arcs[node] if price[a[2]] is not None and price[node] == a[1] + price[a[2]])
        if not label:
            return "".join(audit), total, node
        audit.append(label)
        total += cost
        node = to


def solved(symbols: str, exits: Exits | None, starts: int) -> tuple[list[str], list[int], list[int]]:
    """Audit, cost and end state from each of the first ``starts`` states."""
    arcs = lattice(symbols, exits)
    price = auction(arcs)
    found = [trace(arcs, price, q) for q in range(starts)]
    return [f[0] for f in found], [f[1] for f in found], [f[2] % 4 for f in found]


short_solved = lru_cache(maxsize=1 << 16)(solved)


def crossing(symbols: pd.Series, last: pd.Series) -> pd.Series:
    """Costs of a segment, four for each start state (one for each end state, -1: none); of the last segment, each start state's cost."""
    out = []
    for s, end in zip(symbols, last):
        exits = [None] if end else [tuple(0 if q == to else None for q in range(4)) for to in range(4)]
        prices = [auction(lattice(s, e))[:4] for e in exits]
        out.append([-1 if p[q] is None else p[q] for q in range(4) for p in prices])
    return pd.Series(out, dtype=object)


def walked(symbols: pd.Series, exits: pd.Series, starts: pd.Series) -> pd.DataFrame:
    rows = []
    for s, e, k in zip(symbols, exits, starts):
        rows.append((short_solved if len(s) <= SHORT else solved)(s, None if e is None else tuple(int(x) for x in e), int(k)))
    return pd.DataFrame(rows, columns=["audits", "costs", "ends"])


def end_prices(segments: pd.DataFrame) -> pd.DataFrame:
    """Prices of the four states at the end of each segment of a conversation; null at its last."""
    rows, exits = [], None
    for row in segments.sort_values("seg", ascending=False).itertuples():
        rows.append((row.c, row.seg, exits))
        cost = [int(x) for x in row.costs]
        exits = cost if exits is None else [min(cost[4 * q + to] + exits[to] for to in range(4) if cost[4 * q + to] >= 0) for q in range(4)]
    return pd.DataFrame(rows, columns=["c", "seg", "exits"])


def entries(segments: pd.DataFrame) -> pd.DataFrame:
    """State in which each segment starts."""
    rows, state = [], START
    for row in segments.sort_values("seg").itertuples():
        rows.append((row.c, row.seg, state))
        state = int(row.ends[state])
    return pd.DataFrame(rows, columns=["c", "seg", "entry"])


def audits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """c, seg, audit, cost of each segment. ``rows``: c (conversation, not null), pos (from 1), symbol."""
    keyed = rows.select("c", F.floor((F.col("pos") - 1) / segment).alias("seg"), "pos", "symbol")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    segs = keyed.groupBy("c", "seg").agg(F.concat_ws("", F.transform(ordered, lambda r: r["symbol"])).alias("symbols"))
    segs = scratch(segs.withColumn("most", F.max("seg").over(Window.partitionBy("c"))))
    none = F.lit(None).cast("array<int>")
    long = segs.where("most > 0")
    cross, walk = F.pandas_udf(crossing, "array<int>"), F.pandas_udf(walked, "audits array<string>, costs array<int>, ends array<int>")
    crossed = long.select("c", "seg", cross("symbols", F.col("seg") == F.col("most")).alias("costs"))
    priced = crossed.groupBy("c").applyInPandas(end_prices, "c string, seg long, exits array<int>")
    work = segs.where("most = 0").select("c", "seg", "symbols", none.alias("exits"), F.lit(1).alias("starts"))
    work = work.union(long.join(priced, ["c", "seg"]).select("c", "seg", "symbols", "exits", F.lit(4)))
    traced = scratch(work.select("c", "seg", "starts", walk("symbols", "exits", "starts").alias("w")).select("c", "seg", "starts", "w.*"))
    chosen = traced.where("starts > 1").groupBy("c").applyInPandas(entries, "c string, seg long, entry int")
    named = traced.where("starts = 1").withColumn("entry", F.lit(0)).unionByName(traced.where("starts > 1").join(chosen, ["c", "seg"]))
    return named.select("c", "seg", F.get("audits", F.col("entry")).alias("audit"), F.get("costs", F.col("entry")).cast("long").alias("cost"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, c, turn, role, text after the damage that each row's id and turn choose, with its place among rows of a turn."""
    text_of = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    chosen = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", conversation_key(F.col("conv_id")).alias("c"), "turn", text_of("role").alias("role"), text_of("text").alias("text"), chosen.alias("damage"))
    copies = F.when(F.col("damage") == 3, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    placed = rows.where("damage <> 0").withColumn("copy", F.explode(copies))
    return placed.select("conv_id", "c", "turn", role.alias("role"), text.alias("text"), F.struct("role", "text", "copy").alias("place"))


def conversation_key(conv: Column) -> Column:
    return F.when(conv.isNull(), F.lit("null")).otherwise(F.concat(F.lit("id "), conv.cast("string")))


def faults(rows: DataFrame) -> DataFrame:
    """c, conv_id, pos, turn, role, text, fault, symbol. ``rows``: c, conv_id, turn, role, text, place (the order within a turn)."""
    span = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))
    numbered = scratch(number_rows(rows, Frame(("c",), ("turn", "place")), span, "pos").drop("place").withColumn("digest", F.md5("text")))
    first = numbered.groupBy("c", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    end = F.rtrim("text", F.lit(SPACES))
    fault = F.when(end == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return numbered.join(first, ["c", "role", "digest"], "left").select("c", "conv_id", "pos", "turn", "role", "text", fault.alias("fault")).withColumn("symbol", symbol)


STREAM = "c string, illegal long, repaired_sha256 string"


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows c, role, text, audit (on the first row of each segment) in order, gives ``STREAM`` of each conversation."""
    key = None
    done: list[tuple] = []
    digest, state, before, illegal, some = hashlib.sha256(), START, None, 0, False
    edits: Iterator[str] = iter("")

    def add(role: str, text: str) -> None:
        nonlocal some
        digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        some = True

    def inserted(label: str) -> bool:
        nonlocal state
        if label == "I":
            state = NEXT[state]
            add(NAMES[state], "")
        return label == "I"

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["c", "illegal", "repaired_sha256"])
        done.clear()
        return out

    for batch in batches:
        for c, role, text, audit in zip(*(batch.column(k).to_pylist() for k in ("c", "role", "text", "audit"))):
            if c != key or audit is not None:  # inserts after the last row
                for label in edits:
                    inserted(label)
            if c != key:
                if key is not None:
                    done.append((key, illegal, digest.hexdigest()))
                key, digest, state, before, illegal, some = c, hashlib.sha256(), START, None, 0, False
            if audit is not None:
                edits = iter(audit)
            label = next(edits)
            while inserted(label):
                label = next(edits)
            initial = role[:1]
            if before is not None and before + initial not in ("su", "ua", "au"):
                illegal += 1
            before = initial
            if label == "K":
                state = kept_state(initial, state)
                add(role, text)
            elif label == "R":
                state = NEXT[state]
                add(NAMES[state], text)
        if len(done) >= 1000:
            yield flush()
    for label in edits:
        inserted(label)
    if key is not None:
        done.append((key, illegal, digest.hexdigest()))
    yield flush()


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation with rows. ``turns``: see ``faults``."""
    rows = scratch(faults(turns))
    edits = scratch(audits(rows, segment))
    heads = edits.select("c", (F.col("seg") * segment + 1).alias("pos"), "audit")
    ordered = rows.join(heads, ["c", "pos"], "left").repartition("c").sortWithinPartitions("c", "pos")
    stream = ordered.select("c", "role", "text", "audit").mapInArrow(repaired, STREAM)
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    known = rows.groupBy("c").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), count("blank"), count("duplicate"), count("truncated"))
    kinds = rows.where("turn is not null").groupBy("c", "turn").count().groupBy("c").agg(F.count("*").alias("turns"))
    whole = F.array_sort(F.collect_list(F.struct("seg", "audit")))
    costs = edits.groupBy("c").agg(F.sum("cost").alias("cost"), F.concat_ws("", F.transform(whole, lambda r: r["audit"])).alias("audit"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    joined = known.join(kinds, "c", "left").join(costs, "c").join(stream, "c")
    return joined.select("c", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
