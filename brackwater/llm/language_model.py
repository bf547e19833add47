"""LM scoring (operator 3): a gated recurrent network with a class-factored output, learnt and run in numpy.

* Counts of every word of all training texts come from the hashed block exchange (see `exchange`): a chunk sends each
  distinct word once, its block adds up and answers every chunk that asked. They grow with the corpus and set the
  vocabulary, the base score, the spread of rare words and the starting biases of the network.
* The network's weights are learnt by truncated backpropagation in Spark tasks, in two steps. One task goes over a small
  sample several times, so that all start from the same place (`start_bytes` expected). Then come rounds that
  go over all training texts (`train_share` of them, if less is asked for), each text in one round: texts are dealt into lanes of about
  `lane_bytes` by a hash, each lane goes on from the common weights over its texts in the order of key and text, and the
  weights of all lanes, by their tokens, are averaged where they are summed up slice by slice, as whole numbers. So neither
  the partitions of the table nor the order in which tasks end change a score. Texts are given to rounds and lanes by hashes of
  key and text, so no hot key fills one lane. The driver holds one set of weights and no text.
* The output is factored: a softmax over classes, then one inside the class. The `vocabulary` commonest
  words fill classes of equal size; every other word is in one of the spelling classes (ASCII by length and last sign,
  others by their last non-ASCII byte), where its share is (c + 0.5) / (N_j + 0.5 (V_j + 1)). So all words, an unseen one
  in each spelling class included, share a probability of one.
* Scoring reads whole texts in lockstep, longest first, and carries the state across windows to the end of each.

Defined cases: a null or empty text is the end token alone; without training rows every count is 0 and the network
is the one it starts as; repeated rows get equal scores; a null key is never held out; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.llm.exchange import block_bounds, expand, in_chunks, index_blocks, squeeze, text_size
from brackwater.llm.words import Spans, best_of, bounded_batches, find_words, slices, text_bytes
from brackwater.session import cut_lineage

SPELLINGS = 24
F32 = np.float32
BLOCK = 1024  # tokens whose outputs are worked out at once


def spelling(spans: Spans) -> np.ndarray:
    """Spelling class of each word."""
    buf = spans.buf
    if not len(spans.start):
        return np.zeros(0, np.int64)
    other = np.maximum.accumulate(np.where(buf >= 0x80, np.arange(len(buf)), -1))[spans.end - 1]
    last = buf[spans.end - 1]
    letter = ((last | 0x20) >= 97) & ((last | 0x20) <= 122)
    return np.where(other >= spans.start, 8 + (buf[other] & 15), np.minimum((spans.end - spans.start) // 4, 3) + 4 * ~letter).astype(np.int64)


@dataclass
class Counts:
    """What the network needs to know of the corpus: totals, the commonest words, and the rest by spelling class."""

    tokens: int
    distinct: int
    ends: int
    words: np.ndarray  # hashes of the vocabulary, ascending
    count: np.ndarray  # of each
    rest_tokens: np.ndarray  # by spelling class
    rest_distinct: np.ndarray


class Network:
    """Token ids: vocabulary words in order of falling count, then the spelling classes, then the end; one more begins a text."""

    def __init__(self, counts: Counts, hidden: int = 32, per_class: int = 64, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.counts, self.hidden, self.per_class = counts, hidden, per_class
        k = len(counts.words)
        self.n_classes = -(-k // per_class)
        self.end, self.begin, outputs = k + SPELLINGS, k + SPELLINGS + 1, self.n_classes + SPELLINGS + 1
        by_count = np.argsort(-counts.count, kind="stable")
        self.rank = np.empty(k, np.int64)
        self.rank[by_count] = np.arange(k)  # vocabulary place -> token id
        c = np.zeros(self.n_classes * per_class)
        c[:k] = counts.count[by_count] + 0.5
        self.real = (np.arange(len(c)) < k).reshape(self.n_classes, per_class)
        c = c.reshape(self.n_classes, per_class)
        share = np.concatenate([c.sum(1), counts.rest_tokens + 0.5, [counts.ends + 0.5]])
        small = lambda *s: (rng.normal(0, 0.1, s)).astype(F32)
        self.p = {
            "x": small(k + SPELLINGS + 2, 3 * hidden),
            "h": small(hidden, 3 * hidden),
            "class_w": np.zeros((hidden, outputs), F32),
            "class_b": np.log(share / share.sum()).astype(F32),
            "word_w": np.zeros((self.n_classes, hidden, per_class), F32),
            "word_b": np.where(self.real, np.log(np.maximum(c, 1e-9)), -1e9).astype(F32),
        }
        self.class_of = np.concatenate([np.arange(k) // per_class, self.n_classes + np.arange(SPELLINGS), [outputs - 1]])

    def copy(self) -> Network:
        out = copy(self)
        out.p = {k: v.copy() for k, v in self.p.items()}
        return out

    def ids(self, hashes: np.ndarray, spellings: np.ndarray) -> np.ndarray:
        k = len(self.counts.words)
        if not k:
            return spellings.copy()
        at = np.minimum(np.searchsorted(self.counts.words, hashes), k - 1)
        return np.where(self.counts.words[at] == hashes, self.rank[at], k + spellings)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state of each row of inputs `x`, and what `_move` tells beside it."""
        return _move(_blocks(x), h, _blocks(self.p["h"]))

    def _by_class(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of tokens by class, and where each class of words begins in it."""
        order = _order(cls, len(self.p["class_b"]))
        return order, np.searchsorted(cls[order], np.arange(self.n_classes + 1))

    def log_p(self, hs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each token id given its state; of a spelling class for words outside the vocabulary."""
        p, cls = self.p, self.class_of[ids]
        out = np.empty(len(ids), hs.dtype)
        for lo in range(0, len(ids), BLOCK):
            out[lo : lo + BLOCK] = _log_share(hs[lo : lo + BLOCK], p["class_w"], p["class_b"], cls[lo : lo + BLOCK])
        order, cut = self._by_class(cls)
        words = order[: cut[-1]]
        hs, at = np.take(hs, words, axis=0), ids[words] % self.per_class
        found = np.empty(len(words), hs.dtype)
        for c in np.flatnonzero(np.diff(cut)):
            own = slice(cut[c], cut[c + 1])
            found[own] = _log_share(hs[own], p["word_w"][c], p["word_b"][c], at[own])
        out[words] += found
        return out

    def train(self, texts: list[np.ndarray], *, epochs: int = 1, rate: float = 0.01, decay: float = 0.95, **more: int) -> int:
        """Truncated backpropagation over texts, several times; the rate falls by `decay` to the end. Returns the tokens learnt from."""
        learner = Learner(self, rate, **more)
        total = max(1, epochs * learner.windows(sum(map(len, texts))))
        return sum(learner.learn(texts, lambda done: 1 - decay * done / total) for _ in range(epochs))

    def _window(self, before: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p, d = self.p, self.hidden
        begin = before == self.begin
        begins = begin.any(1)
        x, weights = _blocks(p["x"]), _blocks(p["h"])
        kept, hs = [], []
        for t in range(len(ids)):
            if begins[t]:
                h = np.where(begin[t][:, None], F32(0), h)
            new_h, *parts = _move(np.take(x, before[t], axis=1), h, weights)
            kept.append((h, *parts))
            hs.append(new_h)
            h = new_h
        g = {k: np.zeros_like(v) for k, v in p.items()}
        flat, y = np.concatenate(hs), ids.ravel()
        size = flat.dtype.type(1 / len(y))
        cls = self.class_of[y]
        down = np.empty_like(flat)
        for lo in range(0, len(y), BLOCK):
            own = slice(lo, lo + BLOCK)
            a = _misses(flat[own], p["class_w"], p["class_b"], cls[own], size)
            g["class_w"] += flat[own].T @ a
            g["class_b"] += _ones(len(a), a) @ a
            np.matmul(a, p["class_w"].T, out=down[own])
        order, cut = self._by_class(cls)
        words = order[: cut[-1]]
        flat, at = np.take(flat, words, axis=0), y[words] % self.per_class
        deeper = np.empty_like(flat)
        for c in np.flatnonzero(np.diff(cut)):
            own = slice(cut[c], cut[c + 1])
            a = _misses(flat[own], p["word_w"][c], p["word_b"][c], at[own], size)
            g["word_w"][c], g["word_b"][c] = flat[own].T @ a, np.where(self.real[c], _ones(len(a), a) @ a, 0)
            np.matmul(a, p["word_w"][c].T, out=deeper[own])
        down[words] += deeper
        down = down.reshape(len(ids), -1, d)
        back = np.zeros_like(h)
        turned, of_h = weights.transpose(0, 2, 1), np.zeros_like(weights)
        inputs = np.empty((3, *ids.shape, d), h.dtype)
        du = np.empty((3, ids.shape[1], d), h.dtype)
        for t in range(len(ids) - 1, -1, -1):
            old, gates, new, un = kept[t]
            dh = down[t]
            dh += back
            rest = 1 - gates
            dn = inputs[2, t]
            np.multiply(new, new, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dh
            dn *= rest[1]
            rest *= gates
            np.multiply(dn, un, out=du[0])
            np.subtract(old, new, out=du[1])
            du[1] *= dh
            du[:2] *= rest
            np.multiply(dn, gates[0], out=du[2])
            inputs[:2, t] = du[:2]
            of_h += old.T @ du
            dh *= gates[1]
            back = (du @ turned).sum(0)
            back += dh
            if begins[t]:
                back[begin[t]] = 0
        g["h"] = np.concatenate(of_h, axis=1)
        flat = before.ravel()
        order = _order(flat, len(p["x"]))
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        g["x"][flat[order[first]]] = np.concatenate([np.add.reduceat(np.take(part.reshape(-1, d), order, axis=0), first) for part in inputs], axis=1)
        return g, h

    def score(self, ids: np.ndarray, ptr: np.ndarray, window: int = 64, rows: int = 512) -> np.ndarray:
        """Natural log probability of each token of whole texts, their state carried to the end. Texts of like length are read
        together, `rows` at once, so that what a step needs stays in the processor's cache; the outputs of about `window`
        steps of them are worked out at once."""
        sizes = np.diff(ptr)
        by_size = np.argsort(-sizes, kind="stable")
        out = np.zeros(len(ids), np.float64)
        x, weights = _blocks(self.p["x"]), _blocks(self.p["h"])
        places, hs, held = [], [], 0

        def rate() -> None:
            at = np.concatenate(places)
            out[at] = self.log_p(np.concatenate(hs), ids[at])
            places.clear()
            hs.clear()

        for lo in range(0, len(sizes), rows):
            some = by_size[lo : lo + rows]
            first, ordered = ptr[some], sizes[some]
            h = np.zeros((len(some), self.hidden), F32)
            alive = np.searchsorted(-ordered, -np.arange(ordered[0]), "left")  # texts with a token at each time
            for t, n in enumerate(alive.tolist()):
                at = first[:n] + t
                before = ids[at - 1] if t else np.full(n, self.begin)
                h = _move(np.take(x, before, axis=1), h[:n], weights)[0]
                places.append(at)
                hs.append(h)
                held += n
                if held >= window * rows:
                    rate()
                    held = 0
        if places:
            rate()
        return out


class Learner:
    """Adam's state over the windows of one task. Texts follow one another in `streams` rows, and the state of the network is
    carried from window to window."""

    def __init__(self, network: Network, rate: float, streams: int = 128, window: int = 32):
        self.net, self.rate, self.streams, self.window, self.done = network, rate, streams, window, 0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in network.p.items()}

    def _rows(self, tokens: int) -> int:
        return max(1, min(self.streams, tokens // self.window))

    def windows(self, tokens: int) -> int:
        return -(-(tokens // self._rows(tokens)) // self.window)

    def learn(self, texts: list[np.ndarray], slower=lambda done: 1.0) -> int:
        if not texts:
            return 0
        flat = np.concatenate(texts)
        before = np.concatenate([[self.net.begin], flat[:-1]])
        before[np.cumsum([0, *map(len, texts[:-1])])] = self.net.begin
        rows = self._rows(len(flat))
        n = -(-len(flat) // rows)
        # the last row is filled up with the first tokens, so that none is left out
        flat, before = (np.resize(a, rows * n).reshape(rows, n).T for a in (flat, before))
        h = np.zeros((rows, self.net.hidden), F32)
        for lo in range(0, n, self.window):
            grads, h = self.net._window(before[lo : lo + self.window], flat[lo : lo + self.window], h)
            self._update(grads, self.rate * slower(self.done))
        return sum(map(len, texts))

    def _update(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.done += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = F32(min(1.0, 1.0 / max(norm, 1e-9)))
        pace, fade = F32(rate / (1 - 0.9**self.done)), F32(1 / (1 - 0.995**self.done))
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            g *= scale
            m += F32(0.1) * (g - m)
            g *= g
            v += F32(0.005) * (g - v)
            np.multiply(v, fade, out=g)
            np.sqrt(g, out=g)
            g += F32(1e-6)
            np.divide(m, g, out=g)
            g *= pace
            self.net.p[k] -= g


def _blocks(a: np.ndarray) -> np.ndarray:
    """Columns of resets, updates and candidates as three blocks, each in one piece: sums over narrow slices of wide rows take
    several times as long."""
    return np.ascontiguousarray(a.reshape(len(a), 3, -1).transpose(1, 0, 2))


def _move(x: np.ndarray, h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, both gates, the candidate, and its share of the old state, from blocks of inputs and weights."""
    u = h @ weights
    gates = x[:2] + u[:2]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    new = gates[0] * u[2]
    new += x[2]
    np.tanh(new, out=new)
    out = h - new
    out *= gates[1]
    out += new
    return out, gates, new, u[2]


def _order(a: np.ndarray, top: int) -> np.ndarray:
    """The stable order of whole numbers below `top`; those of 16 bits are sorted by digits."""
    return np.argsort(a.astype(np.uint16) if top <= 1 << 16 else a, kind="stable")


def _ones(n: int, like: np.ndarray) -> np.ndarray:
    return np.ones(n, like.dtype)


def _logits(hs: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Outputs less a number of each row that keeps their exponentials in range. States lie between -1 and 1, so the weights
    bound all rows at once; only if that bound is loose the largest of each row is looked for."""
    reach = np.abs(w).sum(0)
    top = (b + reach).max()
    a = hs @ w
    if top - (b - reach).max() < 60:
        a += b - top
    else:
        a += b
        a -= a.max(1)[:, None]
    return a


def _log_share(hs: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at one place."""
    a = _logits(hs, w, b)
    own = a[np.arange(len(a)), at]
    np.exp(a, out=a)
    return own - np.log(a @ _ones(a.shape[1], a))


def _misses(hs: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, size: float) -> np.ndarray:
    """The softmax of each row less 1 at one place, times `size`."""
    a = _logits(hs, w, b)
    np.exp(a, out=a)
    a *= (size / (a @ _ones(a.shape[1], a)))[:, None]
    a[np.arange(len(a)), at] -= size
    return a


def _tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[Spans, np.ndarray, np.ndarray]:
    spans = find_words(*text_bytes(texts))
    return spans, spans.hashes(lower=True), spelling(spans)


def _with_ends(ids: np.ndarray, ptr: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, ptr[1:], end), ptr + np.arange(len(ptr))


def _drawn(key: str, text: str, seed: int) -> Column:
    """A number in [0, 1) of each row, by hash of key and text."""
    return F.xxhash64(F.col(key), F.col(text), F.lit(seed)) / F.lit(2.0**64) + 0.5


def _ids(network: Network, texts: pa.Array) -> list[np.ndarray]:
    spans, h, kind = _tokens(texts)
    ids, ptr = _with_ends(network.ids(h, kind), spans.ptr, network.end)
    return [ids[a:b] for a, b in zip(ptr, ptr[1:], strict=False)]


_WEIGHTS = "slice int, tokens long, weights binary"
SLICES = 32
_UNIT = float(1 << 15)  # weights times tokens are added as whole numbers of 2**-15: in any order alike, for millions of lanes


def _sliced(network: Network, tokens: int) -> pa.RecordBatch:
    flat = np.concatenate([network.p[k].ravel() for k in sorted(network.p)]).astype(np.float64)
    parts = np.array_split(np.rint(flat * (tokens * _UNIT)).astype(np.int64), SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([tokens] * SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "tokens", "weights"])


def _averaged(network: Network, rows: DataFrame) -> int:
    """Sets the network's weights to the average of those in `rows`, by tokens; without rows they stay. Sums are streamed: a
    task holds one sum a slice however many tasks sent their weights."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, n, w in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = sums.setdefault(i, [0, 0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(w, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([w.tobytes() for _, w in sums.values()], pa.binary())], ["slice", "tokens", "weights"])

    found = sorted(rows.repartition(SLICES, "slice").mapInArrow(add_up, _WEIGHTS).collect(), key=lambda r: r[0])
    if not found:
        return 0
    tokens = int(found[0][1])
    flat, at = (np.concatenate([np.frombuffer(r[2], np.int64) for r in found]) / (tokens * _UNIT)).astype(F32), 0
    for k in sorted(network.p):
        size = network.p[k].size
        network.p[k] = flat[at : at + size].reshape(network.p[k].shape).copy()
        at += size
    return tokens


def learn(docs: DataFrame, network: Network, total: int, *, key: str, text: str, start_bytes: int, start_epochs: int, train_share: float, rounds: int, rate: float = 0.002, block_bytes: int = 4_000_000, lane_bytes: int = 8_000_000) -> tuple[int, int]:
    """Teaches the network the training texts `docs` (of a corpus of `total` bytes): the start, then the rounds. Returns the
    tokens of each. A task of a round holds one lane and works through it in blocks of `block_bytes`."""
    docs = bounded_batches(docs).select(key, text)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((k is None, k, t or "") for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), key=lambda r: (r[0], 0 if r[0] else r[1], r[2]))
        if rows:
            tokens = network.train(_ids(network, pa.array([t for _, _, t in rows], pa.string())), epochs=start_epochs)
            yield _sliced(network, tokens)

    few = docs.filter(_drawn(key, text, 41) < start_bytes / max(1, total))
    started = _averaged(network, few.repartition(1).mapInArrow(start, _WEIGHTS))
    learnt = 0
    for r in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(network)

        def go_on(table: pa.Table, shared=shared) -> pa.Table:
            own = shared.value.copy()  # the worker may keep the shared one for its next task
            learner, tokens = Learner(own, rate, streams=512), 0
            held, size = [], 0
            for part in slices(table.sort_by([(key, "ascending"), (text, "ascending")]), text):
                held.append(part.column(1))
                size += part.column(1).nbytes
                if size >= block_bytes:
                    tokens += learner.learn(_ids(own, pa.chunked_array(held)))
                    held, size = [], 0
            if held:
                tokens += learner.learn(_ids(own, pa.chunked_array(held)))
            return pa.Table.from_batches([_sliced(own, tokens)])

        drawn = _drawn(key, text, 43)
        last = r + 1 == rounds and train_share >= 1  # a number may be rounded up to 1
        mine = docs.filter((drawn >= train_share * r / rounds) & (F.lit(last) | (drawn < train_share * (r + 1) / rounds)))
        lanes = max(1, -(-int(total * train_share / rounds) // lane_bytes))
        dealt = mine.withColumn("_lane", F.pmod(F.xxhash64(key, text, F.lit(47)), F.lit(lanes)))
        learnt += _averaged(network, dealt.groupBy("_lane").applyInArrow(lambda table: go_on(table.select([0, 1])), _WEIGHTS))
        shared.unpersist()
    return started, learnt


def score(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", vocabulary: int = 2048, chunk_bytes: int = 6_000_000, start_bytes: int = 4_000_000, start_epochs: int = 4, train_share: float = 1.0, rounds: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each whole text."""
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    total = text_size(docs, text)
    blocks = index_blocks(total, 16_000_000)
    chunks = in_chunks(docs.select(key, text).withColumn("held_out", held), total, "held_out", key=key, text=text, chunk_bytes=chunk_bytes)

    def send(group: tuple, table: pa.Table) -> pa.Table:
        spans, h, kind = _tokens(table.column(text))
        learnt = ~table.column("held_out").to_numpy()[spans.doc]
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse.ravel()[learnt], minlength=len(distinct))
        cut = block_bounds(distinct, blocks)
        some = np.flatnonzero(np.diff(cut))
        parts = [slice(cut[b], cut[b + 1]) for b in some]
        columns = [[squeeze(distinct[s], True) for s in parts], [squeeze(n[s]) for s in parts], [squeeze(kind[first[s]]) for s in parts]]
        return pa.table({"block": pa.array(some, pa.int32()), "chunk": pa.array([group[0].as_py()] * len(some), pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in zip(("hashes", "counts", "kinds"), columns, strict=True)}})

    def answer(group: tuple, table: pa.Table) -> pa.Table:
        parts = [expand(b.as_py(), True) for b in table.column("hashes")]
        distinct, first, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        n = np.zeros(len(distinct), np.int64)
        np.add.at(n, inverse.ravel(), np.concatenate([expand(b.as_py()) for b in table.column("counts")]).astype(np.int64))
        kinds = np.concatenate([expand(b.as_py()) for b in table.column("kinds")]).astype(np.int64)[first]
        back = n[inverse.ravel()]
        cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        replies = [squeeze(back[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        known = n > 0
        best = np.argsort(-n, kind="stable")[:vocabulary]
        best = best[known[best]]
        stats = [np.bincount(kinds[known], n[known], SPELLINGS).astype(np.int64), np.bincount(kinds[known], minlength=SPELLINGS)]
        tops = [(h, c, k) for h, c, k in zip(distinct[best].view(np.int64).tolist(), n[best].tolist(), kinds[best].tolist(), strict=True)]
        top_type = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64()), ("kind", pa.int64())]))
        rows = len(replies)
        return pa.table({
            "block": pa.array([group[0].as_py()] * (rows + 1), pa.int32()),
            "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int32()),
            "counts": pa.array([*replies, None], pa.binary()),
            "tokens": pa.array([None] * rows + [stats[0].tolist()], pa.list_(pa.int64())),
            "distinct": pa.array([None] * rows + [stats[1].tolist()], pa.list_(pa.int64())),
            "tops": pa.array([None] * rows + [[dict(zip(("hash", "n", "kind"), t, strict=True)) for t in tops]], top_type),
        })

    sent = chunks.groupBy("chunk").applyInArrow(send, "block int, chunk int, hashes binary, counts binary, kinds binary")
    answers = cut_lineage(sent.groupBy("block").applyInArrow(answer, "block int, chunk int, counts binary, tokens array<long>, distinct array<long>, tops array<struct<hash: long, n: long, kind: long>>"))

    stats = answers.filter("chunk is null")
    sums = stats.agg(*[F.coalesce(F.sum(F.col(c)[i]), F.lit(0)).alias(f"{c}{i}") for c in ("tokens", "distinct") for i in range(SPELLINGS)]).first()
    ends = docs.filter(~held).count()
    top = best_of(stats.select(F.explode("tops").alias("t")).select("t.*"), vocabulary, F.desc("n"), "hash").toPandas().sort_values(["n", "hash"], ascending=[False, True])
    words = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    rest = np.array(sums, np.int64).reshape(2, SPELLINGS)
    everything = rest.sum(1)
    for row, weight in ((0, top["n"].to_numpy()), (1, np.ones(len(top)))):
        rest[row] -= np.bincount(top["kind"].to_numpy(np.int64), weight, SPELLINGS).astype(np.int64)
    counts = Counts(int(everything[0]) + ends, int(everything[1]) + (ends > 0), ends, words[order], top["n"].to_numpy(np.int64)[order], rest[0], rest[1])

    network = Network(counts)
    learn(docs.filter(~held), network, total, key=key, text=text, start_bytes=start_bytes, start_epochs=start_epochs, train_share=train_share, rounds=rounds)
    shared = spark.sparkContext.broadcast(network)

    def rate(group: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        model: Network = shared.value
        c = model.counts
        spans, h, kind = _tokens(table.column(text))
        distinct, inverse = np.unique(h, return_inverse=True)
        replies = replies.sort_by("block")
        known = np.concatenate([np.zeros(0, np.uint64), *(expand(b.as_py()) for b in replies.column("counts"))]).astype(np.int64)
        if len(known) != len(distinct):
            raise ValueError("a block has not answered for every word of the chunk")
        n = known[inverse.ravel()]
        ids, ptr = _with_ends(model.ids(h, kind), spans.ptr, model.end)
        n_all, _ = _with_ends(n, spans.ptr, c.ends)
        base = np.log10(n_all + 0.5) - np.log10(c.tokens + 0.5 * (c.distinct + 1))
        own = model.score(ids, ptr) / np.log(10)
        k = len(c.words)
        rare = (ids >= k) & (ids < model.end)
        j = ids[rare] - k
        own[rare] += np.log10(n_all[rare] + 0.5) - np.log10(c.rest_tokens[j] + 0.5 * (c.rest_distinct[j] + 1))
        add = lambda x: pa.array(np.add.reduceat(x, ptr[:-1]) if len(ptr) > 1 else x)
        return pa.table({
            key: table.column(key),
            "held_out": table.column("held_out"),
            "n_tokens": pa.array(np.diff(ptr)),
            "n_known": add((n_all > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(table), c.tokens, np.int64)),
            "base_score": add(base),
            "score": add(own),
        })

    kind = docs.schema[key].dataType.simpleString()
    replies = answers.filter("chunk is not null").select("chunk", "block", "counts")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(rate, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
