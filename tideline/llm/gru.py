"""Gated recurrent language model in numpy: class-factored output and truncated backpropagation through time.

Symbols are 0 .. n-1; class k holds the ``WIDTH`` symbols k*WIDTH .. . P(symbol) = P(class | state) P(symbol | class, state), and
the classes from ``HEAD`` on share one place of the first softmax: P(class) = P(later | state) P(class | later, state) for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN, WIDTH, HEAD = 16, 64, 8
#: Steps that are kept for one bulk softmax, rows of it at once, and texts that are scored side by side.
WINDOW, ROWS, TEXTS = 64, 512, 512


def keep_freed() -> None:
    """Free one array of 31 MB: from then on, the C library keeps freed memory of smaller arrays for the next ones, where it would
    give it back to the system and have every page cleared again in each minibatch."""
    np.empty(31 << 20, np.uint8)


def first_outputs(n: int) -> tuple[int, int, int]:
    """Classes of n symbols, and places of the first softmax and of that of the later classes."""
    k = -(-n // WIDTH)
    return (k, HEAD + 1, k - HEAD) if k > HEAD else (k, k, 0)


def shapes(n: int) -> dict[str, tuple[int, ...]]:
    k, first, later = first_outputs(n)
    return {"emb": (n, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, first + later), "bc": (first + later,), "wo": (k * WIDTH, HIDDEN), "bo": (k * WIDTH,)}


def fresh(n: int, counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights; output biases start at the symbols' log shares."""
    rng = np.random.default_rng(seed)
    p = {name: (rng.standard_normal(s) * (0 if name[0] == "b" else 0.1)).astype(np.float32) for name, s in shapes(n).items()}
    share = np.full(len(p["bo"]), -30.0)
    share[:n] = np.log((counts + 0.5) / (counts + 0.5).sum())
    classes = np.exp(share.reshape(-1, WIDTH)).sum(axis=1)
    if first_outputs(n)[2]:
        classes = np.concatenate((classes[:HEAD], [classes[HEAD:].sum()], classes[HEAD:]))
    p["bc"][:] = np.log(classes + 1e-30)
    p["bo"][:] = share
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def unflat(v: np.ndarray, n: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, s in shapes(n).items():
        size = int(np.prod(s))
        out[name] = np.asarray(v[at : at + size], np.float32).reshape(s)
        at += size
    return out


def joined(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the two gates (negated, for ``step``) and of the new state (times -2) by what is read: embedding, state and 1."""
    w = np.vstack((p["wx"], p["u"], p["b"])).T
    return -w[: 2 * HIDDEN], -2 * w[2 * HIDDEN :]


def squashed(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place; 0 where exp overflows."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(read: np.ndarray, reset: np.ndarray, gates: np.ndarray, new: np.ndarray, out: np.ndarray, w: tuple[np.ndarray, np.ndarray]) -> None:
    """One step of all lanes; arrays are (features, lanes). read: embedding, state and 1; reset gets the reset state between its own
    embedding and 1; tanh(x) = 2 / (1 + exp(-2 x)) - 1. The next state goes to ``out``."""
    h = read[HIDDEN : 2 * HIDDEN]
    np.matmul(w[0], read, out=gates)
    squashed(gates)
    np.multiply(gates[HIDDEN:], h, out=reset[HIDDEN : 2 * HIDDEN])
    np.matmul(w[1], reset, out=new)
    squashed(new)
    new *= 2
    new -= 1
    np.subtract(h, new, out=out)
    out *= gates[:HIDDEN]
    out += new


class Outputs:
    """The softmax steps of rows (state, symbol), which are sorted by class: each step takes a run of at most ``ROWS`` sorted rows.
    ``total`` gets the sums of each row's softmaxes, ``own`` the sum of its symbol's logits."""

    def __init__(self, p: dict[str, np.ndarray], states: np.ndarray, symbols: np.ndarray):
        classes, self.first, self.later = first_outputs(len(p["emb"]))
        k = (symbols // WIDTH).astype(np.uint16)
        self.order, n = np.argsort(k, kind="stable"), len(k)
        self.k, self.within = k[self.order].astype(np.int64), np.take(symbols, self.order) % WIDTH
        self.h = np.ones((n, HIDDEN + 1), states.dtype)  # the last column meets the biases
        self.h[:, :HIDDEN] = np.take(states, self.order, axis=0)
        self.wc, self.wo = np.vstack((p["wc"], p["bc"])), np.hstack((p["wo"], p["bo"][:, None]))
        largest = max(1.0, float(np.abs(states).max(initial=0.0))) * max(float(np.abs(self.wc).sum(axis=0).max()), float(np.abs(self.wo).sum(axis=1).max()))
        self.small = largest < 80  # so exp neither overflows nor vanishes
        kind = np.result_type(states, self.wc)
        self.logits = np.empty(min(ROWS, n) * max(WIDTH, self.first, self.later), kind)
        self.ones = np.ones(max(WIDTH, self.first, self.later), kind)
        self.total, self.own = np.ones((3, n), kind), np.zeros(n, kind)

    def steps(self) -> Iterator[tuple[int, bool, slice, slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Softmax of each row (0: classes, 1: symbols, 2: later classes), whether the run is its places' first, its places, rows, weights
        (HIDDEN + 1, places), place of each row's symbol in the flat exps, and these, but for a factor of each row (only until the next step)."""
        starts = np.searchsorted(self.k, np.arange(len(self.wo) // WIDTH + 1))
        each = np.arange(len(self.k))
        at = (each - starts[self.k]) * WIDTH + self.within
        starts = starts.tolist()
        runs = [(0, 0, self.first, 0, len(self.k), each * self.first + np.minimum(self.k, self.first - 1))]
        if self.later:
            runs.append((2, self.first, self.first + self.later, starts[HEAD], len(self.k), (each - starts[HEAD]) * self.later + self.k - HEAD))
        runs += [(1, c * WIDTH, (c + 1) * WIDTH, a, b, at) for c, (a, b) in enumerate(zip(starts, starts[1:])) if b > a]
        for which, low, high, begin, end, at in runs:
            w, width = self.wo[low:high].T if which == 1 else self.wc[:, low:high], high - low
            for a in range(begin, end, ROWS):
                rows = slice(a, min(a + ROWS, end))
                x = self.logits[: (rows.stop - a) * width]
                places, logits = at[rows] - (a - begin) * width if a > begin else at[rows], x.reshape(-1, width)
                np.matmul(self.h[rows], w, out=logits)
                if not self.small:
                    logits -= logits.max(axis=1, keepdims=True)
                self.own[rows] += x[places]
                np.exp(x, out=x)
                np.matmul(logits, self.ones[:width], out=self.total[which, rows])
                yield which, a == begin, slice(low, high), rows, w, places, x

    def log_shares(self) -> np.ndarray:
        """After the steps: log probability of each sorted row's symbol."""
        return self.own - np.log(self.total).sum(axis=0)


def log_probs(p: dict[str, np.ndarray], states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """log P(symbol | state) of each row."""
    outputs, out = Outputs(p, states, symbols), np.empty(len(symbols))
    for _ in outputs.steps():
        pass
    out[outputs.order] = outputs.log_shares()
    return out


@np.errstate(over="ignore")  # see squashed
def score_texts(p: dict[str, np.ndarray], texts: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log-likelihood of each whole text (symbol arrays, the end symbol last); the state is carried over windows.

    Texts go side by side, longest first; the ones that have ended drop out.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    if len(order) > TEXTS:
        out = np.empty(len(order))
        for a in range(0, len(order), TEXTS):
            out[order[a : a + TEXTS]] = score_texts(p, [texts[i] for i in order[a : a + TEXTS]], start)
        return out
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    total = np.zeros(len(order))
    emb, w = np.ascontiguousarray(p["emb"].T), joined(p)
    kind = emb.dtype
    h = np.zeros((HIDDEN, len(order)), kind)
    last = np.full(len(order), start, np.int64)
    for begin in range(0, int(sizes[0]) if len(order) else 0, WINDOW):
        live = int(np.searchsorted(-sizes, -begin, "left"))
        width = min(WINDOW, int(sizes[0]) - begin)
        left = np.minimum(sizes[:live] - begin, width)
        flat = np.concatenate([texts[order[b]][begin : begin + width] for b in range(live)])
        inside = np.arange(width) < left[:, None]
        x = np.full((live, width + 1), start, np.int64)
        x[:, 0] = last[:live]
        x[:, 1:][inside] = flat
        x = np.ascontiguousarray(x.T)
        hs = np.empty((width, live, HIDDEN), kind)
        state, on = np.ascontiguousarray(h[:, :live]), 0
        for t, now in enumerate(np.searchsorted(-left, -np.arange(width), "left").tolist()):
            if on != now:
                on = now
                read, reset = (np.ones((2 * HIDDEN + 1, on), kind) for _ in range(2))
                gates, new = (np.empty((n * HIDDEN, on), kind) for n in (2, 1))
                state = np.ascontiguousarray(state[:, :on])
            np.take(emb, x[t, :on], axis=1, out=read[:HIDDEN], mode="clip")
            reset[:HIDDEN] = read[:HIDDEN]
            read[HIDDEN : 2 * HIDDEN] = state
            step(read, reset, gates, new, state, w)
            hs[t, :on] = state.T
        inside = np.arange(width)[:, None] < left
        owner = np.broadcast_to(np.arange(live), (width, live))[inside]
        total[:live] += np.bincount(owner, log_probs(p, hs[inside], x[1:][inside]), live)
        h, last = state, x[width]
    out = np.empty(len(order))
    out[order] = total
    return out


class Trainer:
    """Adam over minibatches of windows."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    @np.errstate(over="ignore")
    def learn(self, x: np.ndarray, state: np.ndarray | None = None, *, end: int = -1, live: np.ndarray | None = None, whole: int = 0) -> float:
        """x: (steps + 1, batch); each symbol is predicted from those before it. Mean loss.

        ``state``: where each lane goes on from; it is moved to the last step. An ``end`` that is read starts a new text from zero.
        ``live``: (steps, batch) predictions that count. ``whole``: their number in a full minibatch, if it can be less.
        """
        p, (steps, batch) = self.p, (x.shape[0] - 1, x.shape[1])
        read, on = x[:-1], (x != end)[:, None, :]
        w = joined(p)  # these arrays are (steps, features, lanes)
        seen, reset = (np.ones((steps, 2 * HIDDEN + 1, batch), w[0].dtype) for _ in range(2))
        seen[:, :HIDDEN] = p["emb"][read].transpose(0, 2, 1)
        reset[:, :HIDDEN] = seen[:, :HIDDEN]
        outs, new = (np.empty((steps, HIDDEN, batch), seen.dtype) for _ in range(2))
        gates, hs = np.empty((steps, 2 * HIDDEN, batch), seen.dtype), seen[:, HIDDEN : 2 * HIDDEN]
        h = np.zeros((HIDDEN, batch), seen.dtype) if state is None else state.T
        for t in range(steps):
            np.multiply(h, on[t], out=hs[t])
            step(seen[t], reset[t], gates[t], new[t], outs[t], w)
            h = outs[t]
        if state is not None:
            state[:] = h.T
        counted = np.ones(steps * batch, bool) if live is None else live.ravel()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        loss, ds = self.outputs(outs.transpose(0, 2, 1).reshape(-1, HIDDEN)[counted], x[1:].ravel()[counted], whole, g)
        full = np.zeros((steps * batch, HIDDEN), seen.dtype)
        full[counted] = ds
        ds = np.ascontiguousarray(full.reshape(steps, batch, HIDDEN).transpose(0, 2, 1))
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        by_new, by_z, by_r = (1 - z) * (1 - new * new), (hs - new) * z * (1 - z), hs * r * (1 - r)
        da = np.empty((steps, 3 * HIDDEN, batch), seen.dtype)
        back = np.zeros((HIDDEN, batch), seen.dtype)
        u_gates, u_new = np.ascontiguousarray(p["u"][:, : 2 * HIDDEN]), np.ascontiguousarray(p["u"][:, 2 * HIDDEN :])
        for t in range(steps - 1, -1, -1):
            dh = ds[t]
            dh += back
            np.multiply(dh, by_new[t], out=da[t, 2 * HIDDEN :])
            np.multiply(dh, by_z[t], out=da[t, :HIDDEN])
            drh = u_new @ da[t, 2 * HIDDEN :]
            np.multiply(drh, by_r[t], out=da[t, HIDDEN : 2 * HIDDEN])
            back = u_gates @ da[t, : 2 * HIDDEN]
            back += dh * z[t]
            back += drh * r[t]
            back *= on[t]
        by = np.concatenate([np.matmul(x, d.transpose(0, 2, 1)).sum(axis=0) for x, d in ((seen, da[:, : 2 * HIDDEN]), (reset, da[:, 2 * HIDDEN :]))], axis=1)
        g["wx"], g["u"], g["b"] = by[:HIDDEN], by[HIDDEN : 2 * HIDDEN], by[2 * HIDDEN]
        de, places = np.matmul(p["wx"], da), read.ravel()
        for i in range(HIDDEN):
            g["emb"][:, i] = np.bincount(places, de[:, i].ravel(), len(g["emb"]))
        self.t += 1
        for name, q in p.items():
            d = g[name]
            self.m[name] += 0.1 * (d - self.m[name])
            self.v[name] += 0.01 * (d * d - self.v[name])
            q -= self.rate * (self.m[name] / (1 - 0.9**self.t)) / (np.sqrt(self.v[name] / (1 - 0.99**self.t)) + 1e-7)
        return float(loss)

    def outputs(self, states: np.ndarray, symbols: np.ndarray, whole: int, g: dict[str, np.ndarray]) -> tuple[float, np.ndarray]:
        """Mean loss of the rows and its slopes by the states; those by the output weights go to ``g``."""
        outputs, size = Outputs(self.p, states, symbols), whole or len(symbols)
        slopes, inverse = (np.zeros((3, len(symbols), n), states.dtype) for n in (HIDDEN, 1))
        by = {0: g["wc"], 2: g["wc"], 1: g["wo"]}
        biases = {0: g["bc"], 2: g["bc"], 1: g["bo"]}
        for which, _, places, rows, w, at, x in outputs.steps():
            total = outputs.total[which, rows]
            x[at] -= total  # the slopes by the logits, but for the row's factor
            d, factor = x.reshape(len(total), -1), inverse[which, rows]
            np.divide(1 / size, total[:, None], out=factor)
            np.matmul(d, w[:HIDDEN].T, out=slopes[which, rows])
            h = outputs.h[rows] * factor
            if which == 1:
                now = d.T @ h
                by[which][places] += now[:, :HIDDEN]
                biases[which][places] += now[:, HIDDEN]
            else:
                now = h.T @ d
                by[which][:, places] += now[:HIDDEN]
                biases[which][places] += now[HIDDEN]
        slopes *= inverse
        out = np.empty_like(states)
        out[outputs.order] = slopes.sum(axis=0)
        return -float(outputs.log_shares().sum()) / max(1, len(symbols)), out
