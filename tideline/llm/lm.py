"""LM scoring: a gated recurrent model over corpus counts.

Tokens: lower-cased (A-Z) words between white space, then one end. Counts are taken over all training texts.

The model's symbols are the ``vocabulary`` most frequent tokens and ``BUCKETS`` groups of all others, by their last two bytes. The
recurrent model (see ``gru``) predicts symbols; a token of a group then has the share (c + 1) / (N_g + V_g + 1) of the group's
training tokens, so every text, with unseen words too, has a proper probability. Every training text is learned from whole,
in consecutive windows with the state carried (truncated backpropagation), so the work grows with the input: after a warm-up on a
bounded sample in one task, each task trains its own copy on its texts and the copies' weights are averaged by Spark.

Texts are cut to tokens and coded as symbols once; training and scoring read the symbols. Tokens of at least 1 / 2^19 of all training
tokens (so at most 2^19) are broadcast with their counts; the others meet their counts in a join.

Null text counts as empty: its only token is the end. Repeated rows and null ids stay rows of their own. With nothing to learn
from, N = V = 0 and the model is its random start over the end symbol and the groups.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import gru
from tideline.llm.common import scratch, smallest_hashes, space_words

END = b" "  # no word holds a space
VOCABULARY, BUCKETS = 4032, 64
SHARE = 1 << 19
STEPS, BATCH = 16, 512
WARM = 4_000
HELD = 400_000
BUFFER, LONG = 2_000_000, 1_024


class Buckets(dict):
    """Group of a token by its last two bytes, each pair of bytes hashed once."""

    def __missing__(self, last: bytes) -> int:
        self[last] = found = crc32(last) % BUCKETS
        return found


BUCKET_OF = Buckets()  # at most 2^16 + 2^8 + 1 entries


def bucket(token: bytes) -> int:
    return BUCKET_OF[token[-2:]]


def bucket_column(token) -> F.Column:
    return (F.crc32(F.substring(token, -2, 2)) % BUCKETS).cast("int")


def count_tokens(texts: DataFrame) -> DataFrame:
    """token, c over all rows of a text column."""
    schema = pa.schema([("token", pa.binary()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=schema)
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(space_words(t))
                held[END] += 1
                if len(held) > HELD:
                    yield rows()
        if held:
            yield rows()

    return texts.mapInArrow(count, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Symbols:
    """Frequent tokens with their counts, and the symbol of any token."""

    def __init__(self, frequent: list[tuple[bytes, int]], groups: list[tuple[int, int]], vocabulary: int):
        ranked = sorted(((t, c) for t, c in frequent if t != END), key=lambda x: (-x[1], x[0]))
        words, ends = ranked[:vocabulary], [c for t, c in frequent if t == END]
        self.texts = sum(ends)
        self.size = BUCKETS + 1 + len(words)
        self.type = np.dtype(np.uint16 if self.size <= 1 << 16 else np.int32)
        self.symbol_count = np.array([n for n, _ in groups] + [self.texts] + [c for _, c in words], np.float64)
        self.group_size = np.log10([n + v + 1 for n, v in groups])
        known = [*ranked, *[(END, c) for c in ends]]
        self.at = {t: i for i, (t, _) in enumerate(known)}
        of_known = [*range(BUCKETS + 1, self.size), *(bucket(t) for t, _ in ranked[vocabulary:]), *[BUCKETS] * len(ends)]
        self.symbol = np.array([*of_known, 0], self.type)  # the last place is that of all other tokens
        self.log_count = np.append(np.log10(np.array([c for _, c in known], np.float64) + 1), 0.0)
        in_group = self.symbol[:-1] < BUCKETS
        self.log_share = np.zeros(len(self.symbol))  # log10 of a frequent token's share of its group
        self.log_share[:-1][in_group] = self.log_count[:-1][in_group] - self.group_size[self.symbol[:-1][in_group]]

    def coded(self, tokens: list[bytes]) -> tuple[np.ndarray, float, float, list[bytes]]:
        """Symbols, sum of log10(c + 1) of the frequent tokens, sum of all tokens' log10 shares of their groups but for the counts of the
        tokens that aren't frequent, and these."""
        at = np.fromiter(map(self.at.get, tokens, repeat(-1)), np.int32, len(tokens))
        symbols, other = self.symbol[at], np.flatnonzero(at < 0)
        rare = [tokens[k] for k in other.tolist()]
        shares = self.log_share[at].sum()
        if rare:
            groups = np.array([BUCKETS if t == END else BUCKET_OF[t[-2:]] for t in rare])
            symbols[other] = groups
            shares -= self.group_size[groups[groups < BUCKETS]].sum()
        return symbols, float(self.log_count[at].sum()), float(shares), rare


def learn_symbols(counts: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Symbols, int, int]:
    """Symbols, N and V of a table of token counts."""
    by_group = {r.g: (r.n, r.v) for r in counts.groupBy(bucket_column(F.col("token")).alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n, v = (sum(x[k] for x in by_group.values()) for k in (0, 1))
    frequent = [(bytes(r.token), r.c) for r in counts.where(F.col("c") * SHARE >= n).collect()]  # at most SHARE rows
    in_words = sorted(((t, c) for t, c in frequent if t != END), key=lambda x: (-x[1], x[0]))[:vocabulary]
    groups = [list(by_group.get(g, (0, 0))) for g in range(BUCKETS)]
    for t, c in [*in_words, *((t, c) for t, c in frequent if t == END)]:
        groups[bucket(t)][0] -= c
        groups[bucket(t)][1] -= 1
    return Symbols(frequent, [tuple(g) for g in groups], vocabulary), n, v


class Lanes:
    """Streams texts whole through a trainer: ``BATCH`` lanes side by side, each one text after the other in windows of STEPS symbols,
    the state carried from window to window. ``learned`` counts the symbols that were predicted.

    Up to ``BUFFER`` symbols wait for a lane; those of a text of over ``LONG`` go first, so that at the end many lanes are still
    busy with short texts while the last long ones end."""

    def __init__(self, trainer: gru.Trainer):
        self.trainer, self.learned = trainer, 0
        self.left = [np.array([BUCKETS], np.int32) for _ in range(BATCH)]
        self.state = np.zeros((BATCH, gru.HIDDEN), np.float32)
        self.short = list(range(BATCH))
        self.waiting: tuple[deque, deque] = (deque(), deque())
        self.waits = 0

    def add(self, symbols: np.ndarray) -> None:
        """symbols: a text with its end."""
        self.waiting[len(symbols) <= LONG].append(symbols)
        self.waits += len(symbols) + STEPS  # so that empty texts count, too
        while self.waits > BUFFER:
            self.feed()

    def feed(self) -> None:
        symbols = (self.waiting[0] or self.waiting[1]).popleft()
        self.waits -= len(symbols) + STEPS
        lane = self.short[-1]
        self.left[lane] = np.concatenate((self.left[lane], symbols))
        if len(self.left[lane]) > STEPS:
            self.short.pop()
        while not self.short:
            self.learn(list(range(BATCH)))

    def learn(self, lanes: list[int], steps: int = STEPS) -> None:
        sizes = np.array([min(steps, len(self.left[b]) - 1) for b in lanes])
        x = np.full((steps + 1, len(lanes)), BUCKETS, np.int32)
        for i, b in enumerate(lanes):
            x[: sizes[i] + 1, i] = self.left[b][: steps + 1]
            self.left[b] = self.left[b][sizes[i] :]
        state = self.state[lanes]
        self.trainer.learn(x, state, end=BUCKETS, live=np.arange(steps)[:, None] < sizes, whole=STEPS * BATCH)
        self.state[lanes] = state
        self.learned += int(sizes.sum())
        self.short = [b for b in range(BATCH) if len(self.left[b]) <= STEPS]

    def close(self) -> None:
        """The fewer lanes are left, the longer are their windows: no more than a full minibatch at once."""
        while self.waits:
            self.feed()
        while lanes := [b for b in range(BATCH) if len(self.left[b]) > 1]:
            longest = max(len(self.left[b]) for b in lanes) - 1
            self.learn(lanes, max(STEPS, min(longest, 8 * STEPS, STEPS * BATCH // len(lanes))))


CODED = "id {id}, extra boolean, n_tokens bigint, n_known bigint, counted double, shares double, symbols binary, rare array<binary>"


def code_texts(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """docs: id, text, extra -> each text's symbols, sums over its frequent tokens, and the tokens whose counts are to be joined. Every
    text is cut to tokens once; training and scoring read its symbols."""
    sent = docs.sparkSession.sparkContext.broadcast(symbols)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = sent.value
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                tokens = [*space_words(t), END]
                s, counted, shares, rare = symbols.coded(tokens)
                rows.append((len(tokens), len(tokens) - len(rare), counted, shares, s.tobytes(), rare))
            cols = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *map(pa.array, cols, types)], names=["id", "extra", "n_tokens", "n_known", "counted", "shares", "symbols", "rare"]
            )

    return docs.select("id", "text", "extra").mapInArrow(run, CODED.format(id=kind))


def train(texts: DataFrame, symbols: Symbols, start: np.ndarray, *, rate: float) -> DataFrame:
    """i, w: weights averaged over the tasks, each weighed by its number of minibatches. texts: one column of coded texts."""
    size, kind = symbols.size, symbols.type
    sent = texts.sparkSession.sparkContext.broadcast(start)
    schema = pa.schema([("i", pa.int32()), ("s", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru.keep_freed()
        trainer = gru.Trainer(gru.unflat(sent.value.copy(), size), rate)
        lanes = Lanes(trainer)
        for batch in batches:
            for t in batch.column(0):
                lanes.add(np.frombuffer(t.as_buffer(), kind))
        lanes.close()
        if trainer.t:
            w = gru.flat(trainer.p).astype(np.float64) * trainer.t
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w), pa.array(np.full(len(w), trainer.t))], schema=schema)

    rows = texts.mapInArrow(run, "i int, s double, n bigint")
    return rows.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("w"))


def collected(weights: DataFrame, start: np.ndarray) -> np.ndarray:
    """The model's weights (as many as the model has) on the driver."""
    rows = weights.toPandas()
    out = start.copy()
    out[rows["i"].to_numpy()] = rows["w"].to_numpy(np.float32)
    return out


def fit(texts: DataFrame, symbols: Symbols, *, warm: int = WARM, rate: float = 0.01) -> np.ndarray:
    """texts: one column, the coded texts of all training rows."""
    text = texts.columns[0]
    start = gru.flat(gru.fresh(symbols.size, symbols.symbol_count))
    few = smallest_hashes(texts, warm, symbols.texts, text).repartition(1).sortWithinPartitions("h")
    start = collected(train(few.select(text), symbols, start, rate=rate), start)
    return collected(train(texts, symbols, start, rate=rate / 2), start)


def score_pass(coded: DataFrame, symbols: Symbols, weights: np.ndarray) -> DataFrame:
    """Every column but ``symbols``, which comes last, and model: log10 probability of the symbols."""
    size, kind, kept = symbols.size, symbols.type, coded.columns[:-1]
    sent = coded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru.keep_freed()
        p = gru.unflat(sent.value, size)
        rows: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        tokens = 0

        def close() -> list[pa.RecordBatch]:
            model = gru.score_texts(p, texts, BUCKETS) / np.log(10)
            return pa.Table.from_batches(rows).select(kept).append_column("model", pa.array(model)).combine_chunks().to_batches()

        for batch in batches:
            begin = 0
            for i, t in enumerate(batch.column(len(kept))):
                texts.append(np.frombuffer(t.as_buffer(), kind))
                tokens += len(texts[-1])
                if tokens >= BUFFER:
                    rows.append(batch.slice(begin, i + 1 - begin))
                    yield from close()
                    rows, texts, tokens, begin = [], [], 0, i + 1
            if begin < len(batch):
                rows.append(batch.slice(begin))
        if texts:
            yield from close()

    return coded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields[:-1]) + ", model double")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None, vocabulary: int = VOCABULARY, **training) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. ``held_out``: a condition on the
    rows that are not learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("extra"))
    counts = scratch(count_tokens(rows.where("not extra").select("text")))
    symbols, n, v = learn_symbols(counts, vocabulary)
    coded = scratch(code_texts(rows, symbols).withColumn("row", F.monotonically_increasing_id()))
    weights = fit(coded.where("not extra").select("symbols"), symbols, **training)
    scored = scratch(score_pass(coded.select(*[c for c in coded.columns if c not in ("rare", "symbols")], "symbols"), symbols, weights))
    rare = coded.select("row", F.explode("rare").alias("token"))
    met = rare.join(counts.where(F.col("c") * SHARE < n), "token").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("logs"), F.count("*").alias("known"))
    all_rows = scored.join(met, "row", "left").fillna({"logs": 0.0, "known": 0})
    size = float(np.log10(n + (v + 1)))
    return all_rows.select(
        F.col("id").alias("doc_id"), F.col("extra").alias("held_out"), "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("counted") + F.col("logs") - F.col("n_tokens") * F.lit(size)).alias("base_score"), (F.col("model") + F.col("shares") + F.col("logs")).alias("score"),
    )
