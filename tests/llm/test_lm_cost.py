"""op3: few minibatches for whole texts, texts cut to tokens once, exact probabilities of the two-step class output."""

import math
import subprocess
import sys

import numpy as np

from tideline.llm import gru, lm


def trained(sizes):
    symbols = lm.Symbols([(lm.END, 40)], [(1, 1)] * lm.BUCKETS, 0)
    lanes = lm.Lanes(gru.Trainer(gru.fresh(symbols.size, symbols.symbol_count)))
    rng = np.random.default_rng(5)
    for n in sizes:
        lanes.add(np.append(rng.integers(0, lm.BUCKETS, n), lm.BUCKETS))
    lanes.close()
    assert lanes.learned == sum(sizes) + len(sizes)
    return lanes.trainer.t


def test_minibatches_of_one_long_text():
    assert trained([10_000]) <= 10_001 // (8 * lm.STEPS) + 1  # 313 when the windows stayed short


def test_minibatches_of_many_texts():
    assert trained([255] * 1024) <= 1.1 * 1024 * 256 / (lm.STEPS * lm.BATCH)


def test_a_late_long_text_does_not_end_alone(monkeypatch):
    class Counted:
        steps = 0

        def learn(self, x, *a, **k):
            self.steps += len(x) - 1

    monkeypatch.setattr(lm, "BATCH", 8)
    sizes = [255] * 200 + [5000]
    lanes = lm.Lanes(Counted())
    for n in sizes:
        lanes.add(np.append(np.zeros(n, np.int32), lm.BUCKETS))
    lanes.close()
    assert lanes.learned == sum(sizes) + len(sizes)
    assert lanes.trainer.steps <= 1.1 * lanes.learned / 8  # 11,400 when texts went in order


def test_minibatches_reuse_their_memory():
    code = """
import resource
import numpy as np
from tideline.llm import gru, lm
gru.keep_freed()
trainer = gru.Trainer(gru.fresh(200, np.ones(200)))
x = np.random.default_rng(0).integers(0, 200, (lm.STEPS + 1, 256))
faults = []
for _ in range(12):
    trainer.learn(x)
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print(faults[-1] - faults[1])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True).stdout
    assert int(out) < 5_000  # some 2,000 pages for each minibatch before


def test_steps_with_large_inputs_saturate():
    p = {k: v * np.float32(2000) if k != "wo" else v for k, v in gru.fresh(70, np.ones(70)).items()}
    found = gru.score_texts(p, [np.arange(64), np.arange(5)], 64)
    assert np.isfinite(found).all() and (found < 0).all()


def test_texts_are_cut_to_tokens_once_for_training_and_scoring(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    read = []
    kept = {name: getattr(lm, name) for name in ("train", "score_pass")}
    monkeypatch.setattr(lm, "train", lambda texts, *a, **k: read.append(texts.columns) or kept["train"](texts, *a, **k))
    monkeypatch.setattr(lm, "score_pass", lambda coded, *a: read.append(coded.columns) or kept["score_pass"](coded, *a))
    assert lm.score(df).count() == 40
    assert len(read) == 3 and not any("text" in columns for columns in read)


def test_later_classes_have_proper_probabilities_and_slopes():
    n = 11 * gru.WIDTH - 5
    p = {k: v.astype(np.float64) for k, v in gru.fresh(n, np.arange(n) + 1.0).items()}
    rng = np.random.default_rng(1)
    for scale in (1.0, 300.0):  # 300: logits beyond the range of exp without the largest taken off
        q = {k: v * (scale if k in ("wc", "wo") else 1.0) for k, v in p.items()}
        every = gru.log_probs(q, np.repeat(rng.normal(size=(1, gru.HIDDEN)), n, 0), np.arange(n))
        assert np.isfinite(every).all() and abs(np.exp(every).sum() - 1) < 1e-6
    states, symbols = rng.normal(size=(50, gru.HIDDEN)), rng.integers(0, n, 50)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    loss, ds = gru.Trainer(p).outputs(states, symbols, 0, g)
    assert math.isclose(loss, -gru.log_probs(p, states, symbols).mean(), rel_tol=1e-9)
    for name, at in (("wc", (2, 5)), ("wc", (1, gru.HEAD)), ("wc", (3, gru.HEAD + 2)), ("bc", (gru.HEAD + 1,)), ("wo", (int(symbols[0]), 3))):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (gru.log_probs(down, states, symbols).mean() - gru.log_probs(up, states, symbols).mean()) / 2e-5
        assert math.isclose(g[name][at], slope, rel_tol=1e-4, abs_tol=1e-8), name


def test_texts_in_groups_score_as_alone(monkeypatch):
    n = 70
    p = gru.fresh(n, np.ones(n))
    texts = [np.random.default_rng(i).integers(0, n, size) for i, size in enumerate((5, 200, 64, 129, 1))]
    one = gru.score_texts(p, texts, 0)
    monkeypatch.setattr(gru, "TEXTS", 2)
    assert np.allclose(one, gru.score_texts(p, texts, 0), rtol=1e-5)
