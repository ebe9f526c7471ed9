"""Each operator against brute force, a library, an exact round trip or held-out accuracy."""

import itertools
import math
import random
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import ann, chat, copies, decontaminate, gru, langid, licenses, lm, pieces, simhash, token_counts
from tideline.llm.common import space_words, word_bytes
from tideline.llm.queries import ORACLES, QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf).toPandas()
    want = con.sql(ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


# --- 1
def test_nearest_recall(spark, sf):
    got = QUERIES["op1_nearest_neighbours"](spark, sf).toPandas()
    ids, vecs = zip(*duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY 1").fetchall())
    ids, u = np.array(ids), ann.units(np.array(vecs, np.float64))
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -2
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert len(mine) == 5 and np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], atol=1e-12)
        hit += len({*ids[np.lexsort((ids, -s))[:5]]} & {*mine.vec_id})
    assert hit / len(got) >= 0.9


def test_nearest_with_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 else rng.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 50 == 0, recall=1.0).toPandas()
    hot = [i for i, v in rows if v == [1.0, 0.0, 0.0, 0.0]]
    for q in (50, 100, 200):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for i in hot if i != q][:5]
    assert len(got) == 30


def test_hadamard_turns_keep_lengths():
    u = ann.units(np.random.default_rng(0).normal(size=(5, 48)))
    for table in range(3):
        x = ann.turned(u, table)
        assert np.allclose(x @ x.T, u @ u.T) and (ann.buckets(u, table, 4) == ann.bucket_scores(u, table, 4).argmax(axis=1)).all()


# --- 2
def test_license_base_and_spans(spark, sf, texts):
    got = QUERIES["op2_license_scan"](spark, sf).toPandas().set_index("doc_id")
    for i, t in texts:
        w = word_bytes(t)
        base = sorted((k, name) for p, name in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split())
        r = got.loc[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(base), ",".join(sorted({n for _, n in base})))
        assert (None if math.isnan(r.first_word) else r.first_word) == (base[0][0] if base else None)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        sam = licenses.Automaton(seqs)
        runs = {tuple(s[a:b]) for s in seqs for a, b in itertools.combinations(range(len(s) + 1), 2)}
        for run in itertools.product(range(3), repeat=4):
            for n in range(1, 5):
                state = 0
                for t in run[:n]:
                    state = sam.next[state].get(t) if state is not None else None
                assert (state is not None) == (run[:n] in runs)
                if state is not None:
                    assert sam.ends[state] == {(k, e) for k, s in enumerate(seqs) for e in range(n, len(s) + 1) if tuple(s[e - n : e]) == run[:n]}


def test_license_texts_with_edits():
    scan = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES).scan
    mit = licenses.TEMPLATES[0][1]
    edited = mit.replace("sublicense", "really sublicense").replace("ARISING FROM", "FROM")
    n, base, spans = scan("x y z " + edited + " tail words here")
    assert base == [] and [(s[0], s[2]) for s in spans] == [(3, "mit")] and 0.9 < spans[0][3] <= 1
    assert scan(" ".join(mit.split()[:40]))[2] == []  # a fragment is no license
    assert scan("under the mit license under the MIT-License")[1] == [(0, 3, "mit"), (4, 7, "mit")]


# --- 3
def test_lm_base_is_exact_and_the_model_is_better(spark, sf, texts):
    got = QUERIES["op3_lm_scoring"](spark, sf).toPandas().set_index("doc_id")
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in texts if not held(i) for w in [*space_words(t), b" "])
    n, v = sum(count.values()), len(count)
    for i, t in texts:
        w = [*space_words(t), b" "]
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(count[x] > 0 for x in w), n, held(i))
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() and (out.score > out.base_score).mean() > 0.8


def test_rare_tokens_are_joined(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    one = lm.score(df).toPandas().set_index("doc_id")
    monkeypatch.setattr(lm, "SHARE", 50)  # most tokens then meet their counts in the join
    two = lm.score(df, vocabulary=20).toPandas().set_index("doc_id")
    assert np.allclose(one.base_score.sort_index(), two.base_score.sort_index()) and (one.n_known == two.n_known).all()


def test_gru_probabilities_and_gradients():
    n = 100
    p = {k: v.astype(np.float64) for k, v in gru.fresh(n, np.arange(n) + 1.0).items()}
    h = np.random.default_rng(1).normal(size=(1, gru.HIDDEN))
    every = gru.log_probs(p, np.repeat(h, n, 0), np.arange(n))
    assert abs(np.exp(every).sum() - 1) < 1e-6
    x = np.random.default_rng(2).integers(0, n, (6, 3))

    def loss(q):
        return -np.mean([gru.score_texts(q, [x[1:, b]], int(x[0, b]))[0] for b in range(3)]) / 5

    class Kept(gru.Trainer):
        pass

    for name, at in (("emb", (int(x[1, 0]), 2)), ("u", (3, 20)), ("u", (4, 40)), ("wx", (1, 5)), ("wo", (int(x[2, 1]), 3)), ("wc", (2, 1))):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4
        t = Kept({k: v.copy() for k, v in p.items()}, 0.0)
        t.learn(x)
        assert math.isclose(t.m[name][at] / 0.1, slope, rel_tol=2e-2, abs_tol=1e-6), name


def test_state_is_carried_over_windows(monkeypatch):
    n = 70
    p = gru.fresh(n, np.ones(n))
    texts = [np.random.default_rng(i).integers(0, n, size) for i, size in enumerate((5, 200, 64, 129, 1))]
    one = gru.score_texts(p, texts, 0)
    monkeypatch.setattr(gru, "WINDOW", 7)
    assert np.allclose(one, gru.score_texts(p, texts, 0), rtol=1e-5) and np.allclose(one[1], gru.score_texts(p, texts[1:2], 0)[0], rtol=1e-5)


# --- 4
@pytest.fixture(scope="module")
def machine():
    return pieces.Machine(pieces.compiled_parts(MODEL))


def test_pieces_equal_the_library(machine, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    bits = ["a", "b", "the", "ing", "  ", "   ", " ", "\n", "\t", "é", "日", "語", "🙂", "▁", ".", "tion", "un", "A", "23", "<s>", "\x00", "ß", "...", "    ", "er", "st", "http://"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    for t in [*odd, *(t for _, t in texts)]:
        ids = machine.encode(t)
        assert ids == sp.encode(t) and machine.decode(ids) == t.replace("▁", " ")


def test_unigram_paths_are_shortest():
    words = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "bb": -4.2, "abb": -9.0, "ba": -4.0}
    parts = {"digest": "x", "prefix": True, "merges": False, "text": {p: (i + 1, s) for i, (p, s) in enumerate(words.items())}, "byte": {}, "unknown": 0, "size": 9}
    m = pieces.Machine(parts)
    for n in range(1, 8):
        for t in map("".join, itertools.product("ab", repeat=n)):
            full = "▁" + t

            def ways(s):
                return [[]] if not s else [[s[:k], *w] for k in range(1, len(s) + 1) if s[:k] in words for w in ways(s[k:])]

            best = max(sum(words[p] for p in w) for w in ways(full))
            assert math.isclose(sum(words[p] for p in m.best_path(full)), best)


def test_decode_is_a_query_of_its_own(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = dict(pieces.decode(pieces.encode(docs, MODEL), MODEL).collect())
    assert got == dict(texts)


# --- 5
def test_blocks_of_windows_agree(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    one = sorted(map(str, decontaminate.contamination(docs, items).select(cols).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_TERMS", 3000)
    assert len(list(decontaminate.query_blocks(items))) > 2
    assert sorted(map(str, decontaminate.contamination(docs, items).select(cols).collect())) == one


def test_proximity(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"), shard_bytes=200)
    query, slop = (b"a", b"b", b"b"), 4
    got = {(r.doc, r.place) for r in decontaminate.proximity_hits(index, {"q": query}, slop).collect()}
    total = Counter(w for _, t in docs for w in t.split())
    rarest = min(("a", "b"), key=lambda t: (total[t], t))
    want = set()
    for i, t in docs:
        w = t.split()
        for p, x in enumerate(w):
            near = Counter(w[max(0, p - slop + 1) : p + slop])
            if x == rarest and near["a"] >= 1 and near["b"] >= 2:
                want.add((i, p))
    assert got == want


# --- 6 and 9
def test_language_accuracy(spark, sf):
    found = QUERIES["op6_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = found[found.held_out]
    assert (out.lang == out.lang_pred).mean() >= 0.95


def test_out_of_place_distance(spark):
    profiles = langid.learn(spark.createDataFrame([("aab aab ab", "x"), ("ccc cd", "y")], "t string, l string"), F.col("t"), F.col("l"), top=5)
    codes, counts = langid.gram_counts(langid.coded("ab"))
    own = langid.ranked(codes, counts, 5).tolist()
    want = {n: sum(abs(k - p.index(g)) if g in p else 5 for k, g in enumerate(own)) for n, p in profiles.items()}
    df = spark.createDataFrame([("ab",)], "t string")
    r = df.select(langid.predict(df, F.col("t"), profiles, top=5).alias("p")).first().p
    assert r.lang == min(want, key=want.get) and math.isclose(r.score, 1 - min(want.values()) / (5 * len(own)))


def test_grams_of_pieces_equal_whole(monkeypatch):
    c = langid.coded("The quick (brown) fox, l'été  jumps 3 times over ÄÖÜ straße")
    whole = langid.gram_counts(c)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert all((a == b).all() for a, b in zip(whole, langid.gram_counts(c)))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op9_toxicity"](spark, sf).join(labels, "doc_id").toPandas()
    out = found[found.held_out]
    toxic = out.toxic == 1
    assert out[toxic].score.mean() > out[~toxic].score.mean() + 0.2 and (out[~toxic].predicted == 1).mean() <= 0.02


# --- 7
def test_counts_equal_the_library(spark, texts, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, t) for i, t in texts] + [(-1, "a  b c" * 3000), (-2, "word " * 3000), (-3, "x" * 5000)], "doc_id long, text string")
    count = token_counts.token_counts(spark, F.col("text"), MODEL, split_chars=100, batch_bytes=5000)
    for r in docs.select("text", count.alias("c")).collect():
        assert (r.c.n_tokens, r.c.n_bytes) == (len(sp.encode(r.text)), len(r.text.encode()))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_of_other_models(spark, texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    docs = spark.createDataFrame([(x,) for _, x in texts[:60]], "text string")
    for r in docs.select("text", token_counts.token_counts(spark, F.col("text"), public_tokenizers.path(name), split_chars=100).alias("c")).collect():
        assert r.c.n_tokens == len(t.encode(r.text, add_special_tokens=False).ids)


# --- 8
def brute_components(prints, radius):
    ids = sorted(prints)
    fp = np.array([prints[i] for i in ids], np.uint64)
    label = np.arange(len(ids))
    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius)
        label = simhash.merge_labels(label, np.full(len(near), i), near)
    return {ids[i]: ids[label[i]] for i in range(len(ids))}


def plain_print(text):
    w = space_words(text)
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, sf, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_near_duplicates"](spark, sf).collect()}
    prints = {i: plain_print(t) for i, t in texts}
    want = brute_components(prints, 3)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i, _ in texts}


def test_split_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 63, 6)
    prints = {i: int(centre[i % 6]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for i in range(900)}
    rows = [(i, bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()]
    df = spark.createDataFrame(rows, "id long, fp binary")
    want = brute_components(prints, 3)
    assert len(set(want.values())) > 20
    for shard, blocks in ((8192, 4), (40, 4), (40, 5)):
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "FOREST", 100)
        named = dict(simhash.linked_prints(df, 3, 1, blocks=blocks).collect())
        assert {i: named[p.to_bytes(8, "big")] for i, p in prints.items()} == want


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(bytearray(i.to_bytes(4, "big")), bytearray((i + 1).to_bytes(4, "big"))) for i in range(300) if i % 100 != 99], "a binary, b binary")
    assert Counter(int.from_bytes(r.root, "big") for r in simhash.components(links).collect()) == {0: 100, 100: 100, 200: 100}


# --- 10
def test_best_branches_equal_brute_force(spark):
    rng = random.Random(9)
    rows, score = [], {}
    for conv in range(12):
        for node in range(1, rng.randint(2, 14)):
            parent = rng.randint(1, node - 1) if node > 1 and rng.random() < 0.9 else None
            s = rng.choice([None, 0.0, 1.0, 0.25])
            rows.append((conv, node, parent, s))
            score[conv, node] = parent, s or 0.0
    rows.append((99, 1, 2, 1.0))
    rows.append((99, 2, 1, 1.0))  # a cycle has no root
    df = spark.createDataFrame(rows, "conv long, node long, parent long, score double")
    want = set()
    for conv in range(12):
        paths = []
        nodes = [n for c, n in score if c == conv]
        for leaf in set(nodes) - {score[conv, n][0] for n in nodes}:
            path = [leaf]
            while score[conv, path[-1]][0]:
                path.append(score[conv, path[-1]][0])
            paths.append((-sum(score[conv, n][1] for n in path) / len(path), -len(path), leaf, path[::-1]))
        for rank, (_, _, _, path) in enumerate(sorted(paths)[:2], 1):
            want |= {(conv, rank, n, d) for d, n in enumerate(path, 1)}
    assert {tuple(r) for r in chat.chosen_paths(df, branches=2).collect()} == want


def test_control_strings_are_reversible(spark):
    texts = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "<<||", "<", "|", "\\", "a<\\b", "<|<\\|<|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape_text(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r"))
    for r in df.collect():
        assert "<|" not in r.e + r.r and chat.unescape_text(r.e) == r.t and chat.unescape_role(r.r) == r.t


def test_model_learns_from_whole_texts(monkeypatch):
    symbols = lm.Symbols([(lm.END, 40)], [(1, 1)] * lm.BUCKETS, 0)
    trainer = gru.Trainer(gru.fresh(symbols.size, symbols.symbol_count))
    seen, states = [], []
    kept = gru.Trainer.learn

    def learn(self, x, state, **more):
        seen.extend(x[1:][more["live"]].tolist())
        states.append(float(np.abs(state).max()))
        return kept(self, x, state, **more)

    monkeypatch.setattr(gru.Trainer, "learn", learn)
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(0, lm.BUCKETS, n), lm.BUCKETS) for n in [1000, 0, 1, 31, 32, 33, *rng.integers(0, 90, 200)]]
    lanes = lm.Lanes(trainer)
    for t in texts:
        lanes.add(t)
    lanes.close()
    assert Counter(seen) == Counter(np.concatenate(texts).tolist()) and lanes.learned == len(seen)
    assert states[0] == 0 and states[-1] > 0  # the longest text goes on from its state


# --- pipeline
def test_pipeline_against_plain_python(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf).collect()}
    assert kept == {i for i, t in texts if any(c.isalpha() for c in t or "")}
    bad = {r.doc_id for r in QUERIES["op5_benchmark_decontamination"](spark, sf).where("contaminated").collect()}
    assert {r.doc_id for r in corpus_pipeline.benchmark_passages(spark, docs, sf).collect()} == {i for i, _ in texts} - bad
    staying = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf).collect()}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts for w in [space_words(t)]}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    ids = sorted(sets)
    near = {(a, b) for a, b in itertools.combinations(ids, 2) if alike(a, b) >= 0.9}
    assert all(len({a, b} & staying) < 2 for a, b in near) and near
    for gone in set(ids) - staying:
        assert max(alike(gone, other) for other in ids if other != gone) >= 0.6
    last = corpus_pipeline.run(spark, sf)
    got = {r.doc_id: r.pieces for r in last.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = dict(texts)
    assert got and all(p == sp.encode(plain[i]) for i, p in got.items())


def test_near_copies_are_exact_at_the_limit(spark, sf, monkeypatch):
    word = lambda rng: "".join(rng.choices("abcdefghij", k=7))
    rng = random.Random(5)
    rows, near, apart = [], [], []
    for i in range(160):
        words = [word(rng) for _ in range(104)]  # 100 shingles; cut to 80 or 79 of them: similarity 0.8 or 0.79
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 84 - i % 2]))]
        (apart if i % 2 else near).append(2 * i + 1)
    family = [word(rng) for _ in range(60)]
    rows += [(1000 + i, " ".join(family + [word(rng)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (copies.BLOCK, 700):
        monkeypatch.setattr(copies, "BLOCK", block)
        staying = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, sf).collect()}
        assert staying == {2 * i for i in range(160)} | set(apart) | {1000}


def test_near_copies_equal_brute_force(spark, sf, texts):
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := space_words(t)) else set() for i, t in texts}
    ids = sorted(sets)
    label = np.arange(len(ids))
    for a, b in itertools.combinations(range(len(ids)), 2):
        x, y = sets[ids[a]], sets[ids[b]]
        if 5 * len(x & y) >= 4 * len(x | y):
            label = simhash.merge_labels(label, np.array([a]), np.array([b]))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf).collect()} == {ids[k] for k in set(label.tolist())}


def test_pipeline_is_wired():
    import __spark_entry__ as entry

    assert len(corpus_pipeline.STAGES) == 5 and {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()

