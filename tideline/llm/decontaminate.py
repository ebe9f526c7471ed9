"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores, for each shard of training texts (a bounded number of bytes), the posting lists of its words:
sorted positions in the shard, delta coded. Texts of a shard lie behind each other with a gap as long as any
window, so no match runs over a text's end. An index row is whole in itself: a shard whose executor is lost is
read again from the shared folder. Only terms that a test item can ask for are stored when ``terms`` is given.

``phrase_hits`` asks every shard for every window: it takes the postings of the window's rarest term (by counts over
the whole index), shifts them to the window's start, and intersects them with the shifted lists of the other
terms in order of rarity. ``proximity_hits`` finds places where all terms of a query lie within ``slop`` words.

The windows are broadcast, in blocks of ``BLOCK_TERMS`` terms; a larger test set takes more passes over the index (not
over the texts), so what is sent has a fixed bound.

Null text: no words, not contaminated. Empty items have no window; an item with fewer words than a window is one
window. Repeated texts, repeated items and null ids stay rows of their own. An empty test set hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import by_bytes, ragged, scratch, word_bytes

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_TERMS = 4_000_000
#: Candidate places that are intersected at once.
PLACES = 2_000_000

INDEX = "shard bigint, docs array<bigint>, lengths array<int>, terms array<binary>, counts array<int>, gaps array<binary>"
HITS = "row struct<shard:bigint,at:int>, doc bigint, n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def query_blocks(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """Windows with the ids of their items, in blocks of at most BLOCK_TERMS terms. Streams over the items."""
    rows = items.select(F.col(id_col).cast("string"), text_col)
    block: dict[tuple[bytes, ...], list[str]] = {}
    for item, text in rows.toLocalIterator():
        for w in windows_of(word_bytes(text), size):
            owners = block.setdefault(w, [])
            if item not in owners:
                owners.append(item)
        if len(block) * size > BLOCK_TERMS:
            yield block
            block = {}
    if block:
        yield block


def shard_rows(ids: list, texts: list[list[bytes]], numbers: dict[bytes, int] | None, gap: int) -> dict:
    """One index row of the words of a shard's texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1])) if len(texts) else lengths
    if numbers is None:
        numbers = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    get = numbers.get
    code = np.fromiter((get(w, -1) for t in texts for w in t), np.int32, int(lengths.sum()))
    place = np.arange(len(code)) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if len(texts) else code
    known = code >= 0
    code, place = code[known], place[known]
    order = np.argsort(code.astype(np.uint16) if len(numbers) < 1 << 16 else code, kind="stable")
    code, place = code[order], place[order]
    cuts = np.flatnonzero(np.diff(code, prepend=-1))
    names = list(numbers)
    lists = np.split(place, cuts[1:]) if len(cuts) else []
    return {
        "docs": ids, "lengths": lengths.astype(np.int32), "terms": [names[c] for c in code[cuts]],
        "counts": [len(x) for x in lists], "gaps": [np.diff(x, prepend=0).astype("<i4").tobytes() for x in lists],
    }


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", terms: Iterable[bytes] | None = None, gap: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Positional index of all texts, stored in the shared folder: one row for each shard.

    ``terms``: the terms to store (None: every word). Its size is the caller's to bound; it is broadcast.
    """
    numbers = None if terms is None else {t: i for i, t in enumerate(terms)}
    sent = docs.sparkSession.sparkContext.broadcast(numbers)
    schema = pa.schema([("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("gaps", pa.list_(pa.binary()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[str | None] = []
        size = 0
        shard = TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            row = {"shard": shard} | shard_rows(ids, [word_bytes(t) for t in held], sent.value, gap)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 0 if t is None else len(t)
                if ids and size + n > shard_bytes:
                    yield close()
                    ids, held, size, shard = [], [], 0, shard + 1
                ids.append(i)
                held.append(t)
                size += n
        if ids:
            yield close()

    return scratch(docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(index, INDEX))


def term_counts(index: DataFrame, terms: Iterable[bytes]) -> dict[bytes, int]:
    """Occurrences over the whole index; at most one row for each asked term reaches the driver."""
    rows = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts"))
    wanted = set(terms)
    return {bytes(t): n for t, n in rows.collect() if bytes(t) in wanted}


class Shard:
    """A row of the index, opened for searches."""

    def __init__(self, row: dict, gap: int = WINDOW):
        self.docs = row["docs"]
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + gap)[:-1])) if len(self.lengths) else self.lengths
        self.size = int(self.lengths.sum() + gap * len(self.lengths))
        self.lists = {bytes(t): np.cumsum(np.frombuffer(g, "<i4").astype(np.int64)) for t, g in zip(row["terms"], row["gaps"])}

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def shard_phrases(shard: Shard, windows: list[tuple[bytes, ...]], order: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(window number, start) of every phrase match. ``order``: each window's offsets, rarest term first."""
    have = shard.lists
    live = [k for k, w in enumerate(windows) if all(t in have for t in w)]
    number = {t: i for i, t in enumerate(have)}
    at = np.full(shard.size + 1, -1, np.int32)  # term at each place: membership in a posting list is one look-up
    for t, i in number.items():
        at[have[t]] = i
    counts = np.array([len(have[windows[k][order[k][0]]]) for k in live], np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in by_bytes(counts.tolist(), PLACES):
        some = live[a:b]
        width = max(len(windows[k]) for k in some)
        terms = np.full((len(some), width), -1, np.int32)
        shifts = np.zeros((len(some), width), np.int64)
        for r, k in enumerate(some):
            for c, o in enumerate(order[k]):
                terms[r, c], shifts[r, c] = number[windows[k][o]], o
        owner = np.repeat(np.arange(len(some)), counts[a:b])
        start = np.concatenate([have[windows[k][order[k][0]]] - order[k][0] for k in some])
        keep = start >= 0
        owner, start = owner[keep], start[keep]
        for c in range(1, width):
            term = terms[owner, c]
            keep = (term < 0) | (at[np.minimum(start + shifts[owner, c], shard.size)] == term)
            owner, start = owner[keep], start[keep]
        out.append((np.asarray(some, np.int64)[owner], start))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def phrase_hits(index: DataFrame, block: dict[tuple[bytes, ...], list[str]], gap: int = WINDOW) -> DataFrame:
    """row, doc, n_words, spans, items of every text of the index (of those without a match too). Spans are the
    word ranges [a, b) inside matches, joined where they meet or overlap."""
    windows = list(block)
    count = term_counts(index, {t for w in windows for t in w})
    order = [sorted(range(len(w)), key=lambda o: (count.get(w[o], 0), o)) for w in windows]
    sent = index.sparkSession.sparkContext.broadcast((windows, order, [block[w] for w in windows]))
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("row", pa.struct([("shard", pa.int64()), ("at", pa.int32())])), ("doc", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, order, owners = sent.value
        sizes = np.array([len(w) for w in windows], np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, gap)
                which, start = shard_phrases(shard, windows, order)
                edge = np.zeros(shard.size + 2, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + sizes[which], -1)
                turn = np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False))
                spans, items = defaultdict(list), defaultdict(set)
                doc = shard.doc_of(turn[::2])
                for d, x, y in zip(doc.tolist(), (turn[::2] - shard.starts[doc]).tolist(), (turn[1::2] - shard.starts[doc]).tolist()):
                    spans[d].append({"a": x, "b": y})
                for d, k in np.unique(np.stack((shard.doc_of(start), which)), axis=1).T.tolist():
                    items[d].update(x for x in owners[k] if x is not None)
                n = len(shard.docs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([{"shard": row["shard"], "at": d} for d in range(n)], schema.field("row").type), pa.array(shard.docs, pa.int64()), pa.array(shard.lengths),
                    pa.array([spans.get(d, []) for d in range(n)], pa.list_(span)), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                ], schema=schema)

    return index.mapInArrow(search, HITS)


def proximity_hits(index: DataFrame, queries: dict[str, tuple[bytes, ...]], slop: int, gap: int = WINDOW) -> DataFrame:
    """doc, query, place: every place of a query's rarest term with all its other terms less than ``slop`` words away
    in the same text (``slop`` up to the index's gap; a term asked twice needs two places)."""
    if slop > gap:
        raise ValueError(f"texts of a shard lie {gap} words apart, so slop can't be over {gap}")
    if sum(map(len, queries.values())) > BLOCK_TERMS:
        raise ValueError("pass the queries in smaller blocks")
    spark = index.sparkSession
    count = term_counts(index, {t for q in queries.values() for t in q})
    asked = {name: (min(q, key=lambda t: (count.get(t, 0), t)), q) for name, q in queries.items() if q}
    sent = spark.sparkContext.broadcast(asked)
    schema = pa.schema([("doc", pa.int64()), ("query", pa.string()), ("place", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, gap)
                for name, (rarest, terms) in sent.value.items():
                    if any(t not in shard.lists for t in terms):
                        continue
                    place = shard.lists[rarest]
                    for t in set(terms):
                        own = shard.lists[t]
                        near = np.searchsorted(own, place + slop) - np.searchsorted(own, place - slop, "right")
                        place = place[near >= terms.count(t)]
                    doc = shard.doc_of(place)
                    ids = [shard.docs[d] for d in doc.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(place - shard.starts[doc])], schema=schema)

    return index.mapInArrow(search, "doc bigint, query string, place bigint")


def covered(spans: str) -> str:
    """SQL for the number of words in the union of spans."""
    step = "(s, x) -> named_struct('n', s.n + greatest(0L, x.b - greatest(x.a, s.e)), 'e', greatest(s.e, x.b))"
    return f"aggregate(array_sort({spans}), named_struct('n', 0L, 'e', 0L), {step}).n"


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans, contaminated of every row of ``docs``."""
    blocks = query_blocks(items, id_col=item_id, text_col=item_text, size=size)
    first, second = next(blocks, {}), next(blocks, None)
    # one block: only its terms are ever asked for; more: every word is stored once and asked for block by block
    terms = dict.fromkeys(t for w in first for t in w) if second is None else None
    index = build_index(docs, id_col=id_col, text_col=text_col, terms=terms, gap=size)
    found = phrase_hits(index, first, size)
    if second is not None:
        for block in chain([second], blocks):
            found = found.unionByName(phrase_hits(index, block, size))
        found = found.groupBy("row").agg(
            F.first("doc").alias("doc"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found.withColumn("n_hit", F.expr(covered("spans"))).select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated")
    )
