"""SentencePiece encoding and decoding as a weighted finite-state transduction.

Three machines are compiled from a model file and composed with each text:

* the normaliser maps a space to the mark "▁" and puts one before a text (identity else);
* the lexicon is a trie whose paths are pieces; a character that no piece spells goes to its UTF-8 byte pieces;
* the weights: a unigram model's arc weighs minus its score. In a merge (BPE) model the machine's states are pieces and the
  arc from piece a to b weighs 0 if merging the text of a and b gives back a, b and infinity else: a segmentation is
  the merge result just if all its neighbours are such pairs, so one path has a finite weight.

The best path (least weight in the tropical semiring) is found position by position. Text is cut where no piece can span:
before a mark that follows another character, and around characters without a piece; each cut-out part is a text of its own
for the shortest path, and parts are remembered in a bounded table for each worker.

Decoding is the inverse: bytes of the pieces, marks to spaces, without the first. A literal "▁" in a text is read as a space, as by the
format itself; lone surrogates can't be spelled and are read as U+FFFD. Null text: null pieces in ``encode``, which ``op4`` counts as
0 pieces; empty text: no pieces. Every row gives one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
REMEMBERED = 300_000
INF = float("inf")


def compiled_parts(path: str) -> dict:
    """What the machines need of a model file (a fixed size; it is sent to the workers)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        raw = f.read()
    model.ParseFromString(raw)
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only the identity normaliser with escaped spaces is compiled")
    kinds = pb.ModelProto.SentencePiece
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    return {
        "digest": hashlib.sha256(raw).hexdigest(), "prefix": spec.add_dummy_prefix, "merges": model.trainer_spec.model_type == pb.TrainerSpec.BPE,
        "text": {p: (i, s) for i, (p, s, t) in enumerate(pieces) if t in (kinds.NORMAL, kinds.USER_DEFINED)},
        "byte": {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == kinds.BYTE},
        "unknown": next(i for i, (_, _, t) in enumerate(pieces) if t == kinds.UNKNOWN), "size": len(pieces),
    }


class Machine:
    def __init__(self, parts: dict):
        self.prefix, self.merges = parts["prefix"], parts["merges"]
        self.score = {p: s for p, (_, s) in parts["text"].items()}
        self.ids = {p: i for p, (i, _) in parts["text"].items()}
        self.byte, self.unknown = parts["byte"], parts["unknown"]
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}  # longest piece that begins with these three characters
        for p in self.ids:
            if len(p) > 2:
                self.reach[p[:3]] = max(len(p), self.reach.get(p[:3], 0))
        self.bytes = [b""] * parts["size"]
        for p, i in self.ids.items():
            self.bytes[i] = p.encode("utf-8")
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.floor = min(self.score.values()) - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over a space")
        known = "".join(sorted({c for p in self.ids for c in p if c != MARK}))
        spelled = re.escape(known)
        self.cut = re.compile(f"{MARK}*[{spelled}]+|{MARK}+|[^{MARK}{spelled}]+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.sides: dict[str, tuple[list[str], list[str]]] = {}
        self.stable = {p for p in self.ids if not self.merges or self.merged(p) == [p]}

    def merged(self, text: str) -> list[str]:
        """Merge the best scored neighbours (leftmost of equals) until none spell a piece: what a pair weight asks."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -INF), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def spines(self, piece: str) -> tuple[list[str], list[str]]:
        """The parts that stand at a piece's left and at its right end while it is merged, smallest first."""
        found = self.sides.get(piece)
        if found is None:
            parts, left, right = list(piece), [piece[0]], [piece[-1]]
            while len(parts) > 1:
                best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -INF), -i))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
                if best == 0:
                    left.append(parts[0])
                if best == len(parts) - 1:
                    right.append(parts[-1])
            found = self.sides[piece] = left, right
        return found

    def apart(self, a: str, b: str) -> bool:
        """Whether merging the text of a and b gives a and b: nothing merges over their border on the way."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if not (a + b).strip(MARK):
                ok = self.merged(a + b) == [a, b]  # runs of marks: pieces of equal score
            else:
                ok = self._apart(self.spines(a)[1], self.spines(b)[0])
            if len(self.pairs) >= 4 * REMEMBERED:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def _apart(self, xs: list[str], ys: list[str]) -> bool:
        score, i, j = self.score, 0, 0
        while True:
            over = score.get(xs[i] + ys[j], -INF)
            left = score[xs[i + 1]] if i + 1 < len(xs) else -INF
            right = score[ys[j + 1]] if j + 1 < len(ys) else -INF
            if over > left and over >= right and over > -INF:  # of equals the leftmost merges first
                return False
            if left == right == -INF:
                return True
            if left >= right:
                i += 1
            else:
                j += 1

    def only_path(self, text: str) -> list[str]:
        """Merge model: the one path of finite weight, longest arcs first. The pieces before a place are the merge result
        of the text before it, so a place from which no arc goes on is dead for good."""
        stable, apart, known, reach = self.stable, self.apart, self.pairs.get, self.reach.get
        n, at, path, dead, last = len(text), 0, [], set(), None
        size = min(reach(text[:3], 2), n)
        while at < n:
            while size:
                piece = text[at : at + size]
                if piece in stable and at + size not in dead:
                    ok = last is None or known((last, piece))
                    if ok or (ok is None and apart(last, piece)):
                        break
                size -= 1
            if size:
                path.append(piece)
                last = piece
                at += size
                size = reach(text[at : at + 3], 2)
                if size > n - at:
                    size = n - at
            else:
                dead.add(at)
                at -= len(path.pop())
                size = len(last) - 1
                last = path[-1] if path else None
        return path

    def best_path(self, text: str) -> list[str]:
        """Unigram model: the path of least weight, place by place."""
        n = len(text)
        total, last = [0.0] + [INF] * n, [1] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                w = self.score.get(text[start:end])
                if w is not None and total[start] - w < total[end]:
                    total[end], last[end] = total[start] - w, end - start
            if total[end] == INF:  # no piece spells this character
                total[end] = total[end - 1] - self.floor
        path = []
        while n:
            path.append(text[n - last[n] : n])
            n -= last[n]
        return path[::-1]

    def shortest(self, part: str) -> list[str]:
        """Pieces of the least-weight path of one part."""
        if part in self.stable and self.merges:
            return [part]
        if part[-1] != MARK and part[-1] not in self.ids:
            return list(part)
        return self.only_path(part) if self.merges else self.best_path(part)

    def spelled(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        raw = piece.encode("utf-8", "replace") if not "\ud800" <= piece <= "\udfff" else "�".encode()
        return [self.byte[b] for b in raw] if self.byte else [self.unknown]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for part in self.cut.findall((MARK if self.prefix else "") + text.replace(" ", MARK)):
            ids = known.get(part)
            if ids is None:
                ids = self.older.get(part) or [i for p in self.shortest(part) for i in self.spelled(p)]
                if len(known) >= REMEMBERED:  # two generations: what is met again stays
                    self.older, known = known, {}
                    self.known = known
                if len(part) <= 64:
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text else text


MACHINES: dict[str, Machine] = {}


def machine_of(parts: dict) -> Machine:
    """One machine for each worker and model, with what it remembers."""
    if parts["digest"] not in MACHINES:
        MACHINES.clear()
        MACHINES[parts["digest"]] = Machine(parts)
    return MACHINES[parts["digest"]]


ENCODED = "n_pieces bigint, n_fallback bigint, round_trip boolean"


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pieces (array of ids; null for null), n_pieces, n_fallback (byte pieces), round_trip (decodes to its text)."""
    sent = docs.sparkSession.sparkContext.broadcast(compiled_parts(model))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(sent.value)
        fallback = np.zeros(sent.value["size"], bool)
        fallback[list(machine.byte.values())] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, max(1, len(texts)), 512):
                some = texts[a : a + 512]
                rows = [None if t is None else machine.encode(t) for t in some]
                sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
                flat = np.fromiter((i for r in rows if r for i in r), np.int32, int(sizes.sum()))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                bytes_used = np.concatenate(([0], np.cumsum(fallback[flat])))
                same = [r is None or machine.decode(r) == t.replace(MARK, " ") for r, t in zip(rows, some)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array([r is None for r in rows], pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 512), lists, pa.array(sizes), pa.array(bytes_used[ends[1:]] - bytes_used[ends[:-1]]), pa.array(same, pa.bool_())],
                    names=["doc_id", "pieces", "n_pieces", "n_fallback", "round_trip"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, pieces array<int>, {ENCODED}")


def decode(encoded: DataFrame, model: str, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text of piece ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(compiled_parts(model))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(sent.value)
        for batch in batches:
            texts = [None if p is None else machine.decode(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col), "pieces").mapInArrow(run, f"doc_id {kind}, text string")
