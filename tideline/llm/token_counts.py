"""Token counts: batch encoding inside Arrow functions that return lengths only.

Encode calls get batches of about equal bytes. A text above ``split_bytes`` is cut at safe boundaries: a single
space between two ASCII letters. No piece of a model with whitespace splitting spans such a place and the encoder
puts the same space mark before a text as it puts for the space, so the parts' lengths add up to the whole's.
For byte-level models (``.json``) the cut keeps the space with the following word, as their pattern does. A text
without such a place is encoded whole; so is any text when the model can't be cut (lower-casing word models).

Null text: 0 bytes, 0 tokens. Every row gives one row; repeated rows and null ids stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import by_bytes

SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def encoder(name: str, raw: bytes) -> tuple[Callable[[list[str]], list[int]], str]:
    """Lengths of a batch of texts, and how texts may be cut: 'drop' the space, 'keep' it, or 'no'."""
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        # a part stands for itself only if "▁" is added before a text as for a space, and no piece goes over a space
        cut = "drop" if len(sp.encode("a b")) == 2 * len(sp.encode("a")) == 2 and not any("▁" in p.lstrip("▁") for p in pieces) else "no"
        return (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), cut
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(raw.decode("utf-8"))
    t.no_padding()
    t.no_truncation()
    cut = "keep" if len(t.encode("a b", add_special_tokens=False).ids) == 2 and t.decode(t.encode(" b", add_special_tokens=False).ids) == " b" else "no"
    return (lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]), cut


def parts(text: str, split: int, cut: str) -> list[str]:
    """Parts of at least ``split`` characters each (but for the last) whose tokens together are the text's."""
    if cut == "no" or len(text) <= split:
        return [text]
    out, at = [], 0
    while len(text) - at > split and (m := SAFE.search(text, at + split)):
        out.append(text[at : m.start()])
        at = m.start() + (cut == "drop")
    return [*out, text[at:]]


def token_counts(spark: SparkSession, text: Column, model: str, *, batch_bytes: int = 1 << 20, split_chars: int = 1 << 16) -> Column:
    """struct<n_bytes, n_tokens> of a text. ``model``: path of a .model or .json file, read once on the driver (a
    model file has a fixed size) and sent to the workers."""
    with open(model, "rb") as f:
        sent = spark.sparkContext.broadcast((model, f.read()))

    @F.pandas_udf("n_bytes long, n_tokens long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, cut = encoder(*sent.value)
        for texts in batches:
            rows = ["" if t is None else t for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in rows]
            units = [(i, p) for i, t in enumerate(rows) for p in parts(t, split_chars, cut)]
            units.sort(key=lambda u: len(u[1]))
            counts = [0] * len(rows)
            for a, b in by_bytes([len(p) for _, p in units], batch_bytes):
                for (i, _), n in zip(units[a:b], encode([p for _, p in units[a:b]])):
                    counts[i] += n
            yield pd.DataFrame({"n_bytes": sizes, "n_tokens": counts}, dtype="int64")

    return lengths(text)


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), token_counts(docs.sparkSession, F.col(text_col), model).alias("c"))
        .select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
    )
