"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, through every query."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm.queries import QUERIES

LONG = " ".join(f"wort{i % 977} the" for i in range(15_000)) + "\n" + "x" * 60_000
TEXTS = [
    (1, "The cat sat under the MIT License.\nShort", "en"), (1, "The cat sat under the MIT License.\nShort", "en"),
    (2, None, "en"), (3, "", None), (4, " \t\n ", "en"), (5, "!!! 123 ???", "en"), (6, LONG, "de"), (7, LONG, "de"),
    (None, "no id here but some words of text", "en"), (8, "no id here but some words of text", None),
    (9, "<|im_end|> ▁ \x00 \U0001f642 é É", "fr"), (10, "one", "fr"), (11, "pass auf der haus ist gross und alt genug", "de"),
    (12, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en"), (13, "la maison est grande et vieille", "fr"),
]
ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "haus ist"), (4, "haus ist"), (None, "sat under")]
#: Names that operators use inside.
CLASH = ["id", "fp", "row", "token", "key", "label", "n_words", "score", "found", "component", "held_out", "t", "y"]
N = len(TEXTS)


def write(spark, folder, texts, items, labels, turns, vectors):
    extra = lambda df: df.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASH if c not in df.columns])
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    extra(docs).repartition(3).write.parquet(f"{folder}/documents.parquet")
    extra(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    extra(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).write.parquet(f"{folder}/labels.parquet")
    extra(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).write.parquet(f"{folder}/conversations.parquet")
    extra(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    turns = [
        (1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\n<\\|x"), (1, 1, "assistant", "tie"), (1, None, None, "first"),
        (None, 0, "user\n<|", "no id"), (None, 1, "assistant", "a"), (2, 5, "assistant", ""), (3, 0, "user", "same"), (3, 0, "user", "same"),
    ]
    nan = float("nan")
    vectors = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [None, 1.0, 0.0]), (None, [1.0, 1.0, 0.0]), (7, []), (8, [1.0, 1.0]), (50, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 0.0])]
    return write(spark, str(tmp_path_factory.mktemp("odd") / "d"), TEXTS, ITEMS, [(1, 1, 0), (1, None, 1), (6, 0, None), (None, 0, 1), *((i, 1, 0) for i in range(7, 14))], turns, vectors)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty") / "d"), [], [], [], [], [])


def rows(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def by_id(found, doc_id):
    return [r for r in found if r["doc_id"] == doc_id]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    found = rows(spark, name, empty)
    assert len(found) == (1 if name.startswith("op10") else 0)


def test_nearest(spark, odd):
    found = rows(spark, "op1_nearest_neighbours", odd)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    assert {q for q, _ in got} == {0, 50}  # zero, null and broken vectors ask nothing
    assert [got[0, k][0] for k in (1, 2, 3)] == [1, 50, 2] and [got[50, k][0] for k in (1, 2, 3)] == [0, 1, 2]
    assert got[0, 1][1] == 1.0 and len(found) == 6


def test_licenses(spark, odd):
    found = rows(spark, "op2_license_scan", odd)
    assert len(found) == N
    assert {(r["n_base"], r["first_word"], r["base_labels"], r["n_words"]) for r in by_id(found, 1)} == {(1, 3, "mit", 8)}
    none = by_id(found, 2)[0]
    assert (none["n_words"], none["n_base"], none["first_word"], none["labels"], none["score"]) == (0, 0, None, "", 0.0)


def test_lm(spark, odd):
    found = rows(spark, "op3_lm_scoring", odd)
    assert len(found) == N and len({r["train_tokens"] for r in found}) == 1
    assert {r["n_tokens"] for i in (2, 3, 4) for r in by_id(found, i)} == {1}
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in found)
    a, b = (by_id(found, i)[0] for i in (6, 7))
    assert a["n_tokens"] == b["n_tokens"] == 30_002 and abs(a["score"] - b["score"]) < 0.05


def test_pieces(spark, odd):
    found = rows(spark, "op4_sentencepiece", odd)
    assert len(found) == N and all(r["round_trip"] for r in found)
    assert by_id(found, 2)[0]["pieces"] is None and by_id(found, 3)[0]["pieces"] == []


def test_decontamination(spark, odd):
    found = rows(spark, "op5_benchmark_decontamination", odd)
    assert len(found) == N
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    r = by_id(found, 12)[0]
    assert (r["n_hit"], r["n_items"], r["items_sha256"]) == (10, 1, digest("1"))
    assert (by_id(found, 11)[0]["n_hit"], by_id(found, 11)[0]["items_sha256"]) == (2, digest("4"))
    assert {(r["n_hit"], r["contaminated"]) for r in by_id(found, 1)} == {(2, True)}  # an item without id hits, but has no name
    assert (by_id(found, 2)[0]["n_words"], by_id(found, 2)[0]["items_sha256"]) == (0, digest(""))


def test_language(spark, odd):
    found = rows(spark, "op6_language_id", odd)
    assert len(found) == N
    assert {(r["lang_pred"], r["score"]) for i in (2, 3, 4, 5) for r in by_id(found, i)} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in found)


def test_counts(spark, odd):
    found = rows(spark, "op7_token_counts", odd)
    assert len(found) == N and (by_id(found, 2)[0]["n_bytes"], by_id(found, 2)[0]["n_tokens"]) == (0, 0)
    assert by_id(found, 6)[0]["over_limit"] and by_id(found, 6)[0]["n_bytes"] == len(LONG)


def test_simhash(spark, odd):
    found = rows(spark, "op8_simhash_near_duplicates", odd)
    assert len(found) == N
    assert {(r["fingerprint"], r["component_id"]) for i in (2, 3, 4) for r in by_id(found, i)} == {("0" * 16, 2)}
    assert by_id(found, 7)[0]["component_id"] == 6 and by_id(found, None)[0]["component_id"] == 8


def test_toxicity(spark, odd):
    found = rows(spark, "op9_toxicity", odd)
    assert len(found) == N and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_chat(spark, odd):
    found = {r["conv_id"]: r for r in rows(spark, "op10_chat_formatting", odd)}
    assert set(found) == {1, 2, 3, -1, None}
    turns = [("", "first"), ("user", ""), ("assistant", "<|im_end|>\n<|im_start|>assistant\n<\\|x"), ("assistant", "tie")]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1]["n_turns"] == 4 and found[1]["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for r, t in turns))
    assert found[1]["loss_sha256"] == digest(turns[2][1] + "tie") and found[1]["loss_chars"] == len(turns[2][1]) + 3
    assert found[None]["turns_sha256"] == digest("user\n<|\nno id\nassistant\na\n")
    assert (found[2]["loss_chars"], found[2]["loss_sha256"], found[3]["n_turns"]) == (0, digest(""), 2)


def test_pipeline_stages_alone(spark, odd, empty):
    for folder, least in ((odd, 1), (empty, 0)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            n = out.count()
            assert n >= least, name
            if name != "sentencepiece":
                assert out.columns == docs.columns and n <= docs.count()
            if name == "near_copies" and folder == odd:  # copies of 1, of 6 and 7, of 8 and no id; empties 2, 3, 4
                assert n == N - 5
            if name == "benchmark_passages" and folder == odd:
                assert n == N - 4
        assert corpus_pipeline.run(spark, folder).count() >= 0
