"""Language-model scores of whole documents from a gated recurrent network.

Tokens are words (A-Z lower-cased) and one end per document. Counting covers every training document. The network
has an entry for each of the ``KNOWN`` most frequent words, for the end, and for each of ``BUCKETS`` groups that the first two
bytes of all other words make; its output is factored: P(class | state) * P(entry | class, state), with classes
of entries of similar frequency. A word of a group has the probability of the group's entry times its share in it,
(count + 1) out of all such words' and one unseen one, so a text's score is a proper log-probability.

Training is truncated back-propagation through time in numpy. Every training document is dealt to one of ``ROUNDS`` rounds
and, in it, to a trainer; each runs over its documents in lanes, carrying states from
window to window, and the trainers' parameters are averaged, weighted by tokens, after each round. What is
trained on thus grows with the corpus, and a model's size does not. How many trainers there are follows from the
tokens alone, and each takes its documents in the order of a hash, so that scores do not depend on the cluster.

Scoring steps all documents of a chunk together, with states carried on from window to window, so a
document is scored as one sequence whatever its length.

Counts of the ``FREQUENT`` most frequent words (a bounded table) go to every task; the other words of a document are
joined with the counts of all words, which nothing broadcasts or collects.

Defined results: null and empty texts are one end token. Rows with a null id are training rows. Repeated rows count
and are scored each. An empty table gives no rows. Extra columns are ignored, whatever their names. Words count as
equal when their 64-bit hashes are.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import vectors as V
from sitegrain.llm.quality_crf import fold
from sitegrain.llm.scratch import Scratch, prepare

HELD_OUT, FOLDS = 2, 7
CLASSES, PER_CLASS = 64, 64
BUCKETS = 1024
KNOWN = CLASSES * PER_CLASS - BUCKETS - 1
FREQUENT = 1 << 18
HIDDEN, EMBED = 24, 16
ROUNDS = 2
LANES, WINDOW, PART = 512, 32, 2048
#: Tokens whose output is computed together in scoring.
SCORE_TOKENS = 1 << 15
#: Tokens whose classes' logits are computed together, so that these stay in a core's cache.
CLASS_TOKENS = 1 << 11
#: The first round's rate; each one after it has half. The first WARM steps rise to it.
RATE, WARM = 4e-3, 20
#: Training tokens to one trainer in a round, about.
TRAINER_TOKENS = 1_500_000
#: Parameters of a trainer in one row.
SLICE = 4096
#: Tokens whose documents are trained on together, by one trainer.
TRAIN_BLOCK = 1 << 20
#: Bytes of text whose documents are scored together.
BLOCK_BYTES = 1 << 24
#: The end token's place among word hashes.
END = np.uint64(zlib.crc32(b"end of document") << 32 | 1)


def _groups() -> np.ndarray:
    """The group of a word by its first two bytes (A-Z lower-cased; 0 for a missing second one)."""
    of = V.mix(np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) % np.uint64(BUCKETS)
    return of.astype(np.int16)


GROUPS = _groups()


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all documents, each followed by END, their groups, and the documents' bounds."""
    starts, ends, first = V.words(data, off)
    h = np.insert(V.word_hashes(data, starts, ends), first[1:], END)
    one = V.LOWER[data[starts]].astype(np.int64)
    two = np.where(ends - starts > 1, V.LOWER[data[np.minimum(starts + 1, max(0, len(data) - 1))]], 0)
    return h, np.insert(GROUPS[one << 8 | two], first[1:], 0), first + np.arange(len(first))


COUNTED = "h long, g int, n long"


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts, merged up to a bounded number of words."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        k, at, back = np.unique(h, return_index=True, return_inverse=True)
        return k, g[at], np.bincount(back, n).astype(np.int64)

    def out(h: np.ndarray, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.int32)), pa.array(n)], ["h", "g", "n"])

    for _, data, off in V.chunks(batches):
        h, g, _ = _tokens(data, off)
        k, at, n = np.unique(h, return_index=True, return_counts=True)
        held.append((k, g[at], n))
        if sum(len(x[0]) for x in held) > 1_000_000:
            held = [merged(held)]
            if len(held[0][0]) > 500_000:
                yield out(*held[0])
                held = []
    if held:
        yield out(*merged(held))


class Vocabulary:
    """The network's entries: words by count, the end and the groups of other words; and counts of frequent words."""

    def __init__(self, h: np.ndarray, n: np.ndarray, g: np.ndarray, total: int, distinct: int, group_n: np.ndarray, group_words: np.ndarray):
        """``h``, ``n``, ``g``: the most frequent tokens, descending; ``group_n`` and ``group_words``: tokens and words of each group but END."""
        self.total, self.distinct = total, distinct
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]
        word = h != END
        own, own_n, own_g = h[word][:KNOWN], n[word][:KNOWN], g[word][:KNOWN]
        rest = group_n - np.bincount(own_g, own_n, minlength=BUCKETS)
        entry_n = np.concatenate([own_n, np.zeros(KNOWN - len(own)), [n[~word].sum()], rest])
        by = np.argsort(-entry_n, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.groups, self.end = place[-BUCKETS:], int(place[KNOWN])
        names = np.append(own, END)
        order = np.argsort(names)
        self.names, self.places = names[order], np.append(place[: len(own)], self.end)[order]
        self.freq = np.zeros(CLASSES * PER_CLASS)
        self.freq[place] = entry_n
        # of each group's words outside: their counts plus one each, and one for a word never seen
        self.rest = np.log10(rest + (group_words - np.bincount(own_g, minlength=BUCKETS)) + 1)

    def entries(self, tokens: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' entries, and which of them have one of their own."""
        at = np.minimum(np.searchsorted(self.names, tokens), len(self.names) - 1)
        own = self.names[at] == tokens
        return np.where(own, self.places[at], self.groups[groups]), own

    def counts(self, tokens: np.ndarray, entry: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Counts of frequent tokens, given their ``entries``; 0 for others."""
        out = np.where(own, self.freq[entry], 0).astype(np.int64)
        if len(self.h):
            rest = np.flatnonzero(~own)
            others = tokens[rest]
            at = np.minimum(np.searchsorted(self.h, others), len(self.h) - 1)
            out[rest] = np.where(self.h[at] == others, self.n[at], 0)
        return out


SHAPES = {
    "x": (CLASSES * PER_CLASS, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
    "wc": (HIDDEN + 1, CLASSES), "ww": (CLASSES, HIDDEN + 1, PER_CLASS),  # the last of HIDDEN + 1 is the bias
}


def initial(freq: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; output biases that make the untrained network a unigram model."""
    rng = np.random.default_rng(11)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    share = (freq + 0.5).reshape(CLASSES, PER_CLASS)
    p["b"][:] = 0
    p["wc"][-1] = np.log(share.sum(1) / share.sum())
    p["ww"][:, -1] = np.log(share / share.sum(1, keepdims=True))
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _views(v: np.ndarray) -> dict[str, np.ndarray]:
    """As ``unflat``, on the memory of ``v``."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of ``table`` as columns: whole rows lie together in memory, so this takes less than taking columns does."""
    return np.ascontiguousarray(np.take(table, at, 0).T)


def _step(g: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next states, and the gates r and z, the candidates and their recurrent parts (each features x lanes)."""
    n = HIDDEN
    rz = _sigmoid(g[: 2 * n] + u[: 2 * n])
    r, z, uc = rz[:n], rz[n:], u[2 * n :]
    c = r * uc
    c += g[2 * n :]
    np.tanh(c, out=c)
    h = h - c
    h *= z
    h += c
    return h, r, z, c, uc


ONES = np.ones((1, max(CLASSES, PER_CLASS)), np.float32)


def _small(w: np.ndarray) -> np.ndarray:
    """Whether exp(w.T @ states) stays within a float for all states, as they lie in -1 to 1."""
    return np.abs(w).sum(-2).max(-1) < 80


def _exp(x: np.ndarray, small: bool) -> tuple[np.ndarray, float | np.ndarray]:
    """exp(x - shift) in place: its sums by column and the shift, which is 0 where no column needs one."""
    shift = 0.0
    if not small:
        shift = x.max(0)
        x -= shift
    np.exp(x, out=x)
    return (ONES[:, : len(x)] @ x)[0], shift


def _slope(x: np.ndarray, target: np.ndarray, scale: np.float32, small: bool) -> np.ndarray:
    """Slope of ``scale`` times the loss by the logits ``x`` (choices x tokens), in place."""
    total, _ = _exp(x, small)
    x *= scale / total
    x[target, np.arange(len(target))] -= scale
    return x


def _log_share(x: np.ndarray, target: np.ndarray, small: bool) -> np.ndarray:
    """The targets' log shares; overwrites the logits ``x`` (choices x tokens)."""
    own = x[target, np.arange(len(target))]
    total, shift = _exp(x, small)
    return own - np.log(total) - shift


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by class, and where each class starts in it."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])


def output_logs(p: dict[str, np.ndarray], state: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of the targets given the states (HIDDEN and a one x tokens) before them."""
    c, w = target // PER_CLASS, target % PER_CLASS
    order, cuts = _by_class(c)
    state, c, w = np.take(state, order, 1), c[order], w[order]
    logs, small = np.empty(len(c), np.float32), _small(p["wc"])
    for a in range(0, len(c), CLASS_TOKENS):
        b = a + CLASS_TOKENS
        logs[a:b] = _log_share(p["wc"].T @ state[:, a:b], c[a:b], small)
    small = _small(p["ww"])
    for k in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[k], cuts[k + 1]
        logs[a:b] += _log_share(p["ww"][k].T @ state[:, a:b], w[a:b], small[k])
    out = np.empty_like(logs)
    out[order] = logs
    return out


class Trainer:
    """Adam on windows of lanes; a lane goes on with the next document, from a zero state, when its own ends."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = RATE):
        self.rate = rate
        self.flat = flat(p)
        self.p = _views(self.flat)
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.t = 0
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array whose memory is kept from window to window, as fresh pages cost as much as what is computed in them."""
        n = int(np.prod(shape))
        if len(self.rooms.get(name, ())) < n:
            self.rooms[name] = np.empty(n, np.float32)
        return self.rooms[name][:n].reshape(shape)

    def _take(self, name: str, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Columns of ``x``."""
        return np.take(x, at, 1, out=self._room(name, len(x), *at.shape), mode="clip")

    def window(self, ids: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray, live: np.ndarray) -> np.ndarray:
        """One step of learning over (time x lanes) inputs; returns the last states (HIDDEN x lanes).

        Arrays are features x time x lanes, so that gates are whole blocks of memory.
        """
        p, n = self.p, HIDDEN
        steps, lanes = ids.shape
        keep = []
        befores, states = self._room("befores", n, steps, lanes), self._room("states", n + 1, steps, lanes)
        states[n] = 1
        old = (~fresh).astype(np.float32)
        given = p["x"] @ p["wx"] + p["b"]
        forth = np.ascontiguousarray(p["wh"].T)
        for t in range(steps):
            h = h * old[t]
            befores[:, t] = h
            h, *gates = _step(_rows(given, ids[t]), forth @ h, h)
            keep.append(gates)
            states[:n, t] = h
        slope = np.zeros_like(self.flat)
        grad = _views(slope)
        at = np.flatnonzero(live.ravel())
        order, cuts = _by_class(target.ravel()[at] // PER_CLASS)
        at = at[order]
        s, y = self._take("s", states.reshape(n + 1, -1), at), target.ravel()[at]
        scale = np.float32(1 / max(1, len(at)))
        cls, word = y // PER_CLASS, y % PER_CLASS
        ds, small = self._room("ds", n, len(at)), _small(p["wc"])
        for i in range(0, len(at), CLASS_TOKENS):
            j = i + CLASS_TOKENS
            d = _slope(p["wc"].T @ s[:, i:j], cls[i:j], scale, small)
            grad["wc"] += s[:, i:j] @ d.T
            ds[:, i:j] = p["wc"][:-1] @ d
        small = _small(p["ww"])
        for k in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[k], cuts[k + 1]
            e = _slope(p["ww"][k].T @ s[:, i:j], word[i:j], scale, small[k])
            grad["ww"][k] = s[:, i:j] @ e.T
            ds[:, i:j] += p["ww"][k][:-1] @ e
        dh_out = self._room("dh_out", n, steps * lanes)
        dh_out[:] = 0
        dh_out[:, at] = ds
        dh_out = dh_out.reshape(n, steps, lanes)
        dh = np.zeros_like(h)
        dgs, dus = (self._room(k, 3 * n, steps, lanes) for k in ("dgs", "dus"))
        for t in range(steps - 1, -1, -1):
            r, z, c, uc = keep[t]
            dh = dh + dh_out[:, t]
            dg, du, free = dgs[:, t], dus[:, t], 1 - z
            da = dh * free * (1 - c * c)
            dg[:n] = da * uc * r * (1 - r)
            dg[n : 2 * n] = dh * (befores[:, t] - c) * z * free
            dg[2 * n :] = da
            du[: 2 * n] = dg[: 2 * n]
            du[2 * n :] = da * r
            dh = (dh * z + p["wh"] @ du) * old[t]
        grad["wh"][:] = befores.reshape(n, -1) @ dus.reshape(3 * n, -1).T
        of = ids.ravel()
        order = np.argsort(of.astype(np.int16), kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(of[order]) > 0))
        entry = of[order][new]
        dgs = dgs.reshape(3 * n, -1)
        grad["b"][:] = dgs.sum(1)
        grad["wx"][:] = _rows(p["x"], of) @ dgs.T
        dx = np.matmul(p["wx"], dgs, out=self._room("dx", EMBED, len(of)))
        grad["x"][entry] = np.add.reduceat(self._take("dx by entry", dx, order), new, 1).T
        self.t += 1
        np.clip(slope, -1, 1, out=slope)
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * slope
        self.v *= np.float32(0.99)
        slope *= slope
        self.v += np.float32(0.01) * slope
        step = np.sqrt(self.v * np.float32(1 / (1 - 0.99**self.t)))
        step += np.float32(1e-6)
        np.divide(self.m, step, out=step)
        self.flat -= step * np.float32(self.rate * min(1.0, self.t / WARM) / (1 - 0.9**self.t))
        return h

    def run(self, docs: list[np.ndarray], start: int) -> int:
        """Learn from token sequences (each ends with the end); ``start`` is what precedes a document. Returns the tokens.

        A document of more than PART tokens is learned in parts, each from a zero state, so that lanes are of one length.
        """
        lanes: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(LANES)]
        shortest = [(0, i) for i in range(LANES)]
        parts = [(d[a - 1] if a else start, d[a : a + PART]) for d in docs for a in range(0, len(d), PART)]
        for part in sorted(parts, key=lambda x: -len(x[1])):
            size, i = shortest[0]
            lanes[i].append(part)
            heapq.heapreplace(shortest, (size + len(part[1]), i))
        total = lambda lane: sum(len(d) for _, d in lane)
        lanes = sorted((x for x in lanes if x), key=total, reverse=True)
        size = np.array([total(x) for x in lanes])
        head = np.cumsum(size) - size
        target = np.concatenate([d for x in lanes for _, d in x])
        lengths = np.array([len(d) for x in lanes for _, d in x])
        first = np.cumsum(lengths) - lengths
        fresh = np.zeros(len(target), bool)
        fresh[first] = True
        ids = np.roll(target, 1)
        ids[first] = [before for x in lanes for before, _ in x]
        h = np.zeros((HIDDEN, len(lanes)), np.float32)
        for a in range(0, int(size[0]), WINDOW):
            k = int(np.searchsorted(-size, -a))  # lanes longer than a
            t = np.arange(a, min(a + WINDOW, int(size[0])))[:, None]
            live = t < size[:k]
            at = head[:k] + np.minimum(t, size[:k] - 1)
            h = self.window(ids[at], target[at], fresh[at], h[:, :k], live)
        return len(target)


def sequence_logs(p: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """Natural log-probability of each document's entries, ids[bounds[i]:bounds[i + 1]]."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    head, size = bounds[:-1][order], n[order]
    table = p["x"] @ p["wx"] + p["b"]
    forth = np.ascontiguousarray(p["wh"].T)
    h = np.ones((HIDDEN + 1, len(order)), np.float32)
    h[:-1] = 0
    out = np.zeros(len(order))
    last = np.full(len(order), start)
    longest = int(size[0]) if len(size) else 0
    # documents longer than t, for each t
    alive = len(size) - np.cumsum(np.bincount(size, minlength=longest + 1))[:longest]
    states, targets, lanes, held = [], [], [], 0
    for t, k in enumerate(alive.tolist()):
        h = h[:, :k].copy()
        h[:-1] = _step(_rows(table, last[:k]), forth @ h[:-1], h[:-1])[0]
        last = ids[head[:k] + t]
        states.append(h)
        targets.append(last)
        lanes.append(k)
        held += k
        if held >= SCORE_TOKENS or t + 1 == longest:
            logs = output_logs(p, np.concatenate(states, 1), np.concatenate(targets))
            out += np.bincount(np.concatenate([np.arange(k) for k in lanes]), logs, minlength=len(out))
            states, targets, lanes, held = [], [], [], 0
    back = np.empty(len(out))
    back[order] = out
    return back


def _train(p: np.ndarray, vocabulary: Vocabulary, rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, tokens, held, size = Trainer(unflat(p.copy()), rate), 0, [], 0
        for _, data, off in V.chunks(batches):
            h, groups, bounds = _tokens(data, off)
            ids, _ = vocabulary.entries(h, groups)
            held += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            size += len(ids)
            if size >= TRAIN_BLOCK:
                tokens += trainer.run(held, vocabulary.end)
                held, size = [], 0
        if held:
            tokens += trainer.run(held, vocabulary.end)
        if tokens:
            v = flat(trainer.p)
            cut = [v[a : a + SLICE].tobytes() for a in range(0, len(v), SLICE)]
            part = TaskContext.get().partitionId()
            cols = ([part] * len(cut), pa.int32()), (range(len(cut)), pa.int32()), ([tokens] * len(cut), pa.int64()), (cut, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["part", "i", "tokens", "v"])

    return run


TRAINED = "part int, i int, tokens long, v binary"


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the trainers' parameters, summed by tokens in the trainers' order."""
    n, total = {}, {}
    for batch in batches:
        for _, i, tokens, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n[i] = n.get(i, 0) + tokens
            total[i] = total.get(i, 0) + np.frombuffer(v, np.float32).astype(np.float64) * tokens
    if n:
        cols = ([0] * len(n), pa.int32()), (list(n), pa.int32()), (list(n.values()), pa.int64()), ([v.tobytes() for v in total.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["part", "i", "tokens", "v"])


SCORED = "rid long, id long, n_tokens long, n_known long, logs double, logs_grouped double, rest double, net double, rare array<long>, rare_n array<long>"


def _score(p: np.ndarray, vocabulary: Vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unflat(p)
        rid = TaskContext.get().partitionId() << 40
        ids_of, tokens, grouped, lengths, size = [], [], [], [], 0

        def scored() -> pa.RecordBatch:
            nonlocal rid, ids_of, tokens, grouped, lengths, size
            h, groups = np.concatenate(tokens), np.concatenate(grouped)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
            docs = len(bounds) - 1
            doc = np.repeat(np.arange(docs), np.diff(bounds))
            entry, own = vocabulary.entries(h, groups)
            count = vocabulary.counts(h, entry, own)
            net = sequence_logs(model, entry, bounds, vocabulary.end) / np.log(10)
            logs, known = np.log10(count + 1.0), count > 0
            rare = np.flatnonzero(~known)
            order = rare[np.lexsort((h[rare], doc[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            cut = pa.array(np.searchsorted(doc[order][at], np.arange(docs + 1)).astype(np.int32))
            total = lambda x: np.bincount(doc, x, minlength=docs)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(rid + np.arange(docs)), pa.concat_arrays(ids_of), pa.array(np.diff(bounds)), pa.array(total(known).astype(np.int64)), pa.array(total(logs)), pa.array(total(logs * ~own)),
                    pa.array(total(np.where(own, 0.0, vocabulary.rest[groups]))), pa.array(net), pa.ListArray.from_arrays(cut, pa.array(h[order][at].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(n)),
                ],
                [f.split()[0] for f in SCORED.split(", ")],
            )
            rid += docs
            ids_of, tokens, grouped, lengths, size = [], [], [], [], 0
            return out

        for rows, data, off in V.chunks(batches):
            h, groups, bounds = _tokens(data, off)
            ids_of.append(rows.column("id"))
            tokens.append(h)
            grouped.append(groups)
            lengths.append(np.diff(bounds))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield scored()
        if tokens:
            yield scored()

    return run


def fit(spark: SparkSession, rows: DataFrame, counts: DataFrame) -> tuple[np.ndarray, Vocabulary]:
    """Averaged parameters and the vocabulary, from training rows (id, text) and the saved counts (h, g, n)."""
    end = F.col("h") == int(END.astype(np.int64))
    group_n, group_words = np.zeros((2, BUCKETS), np.int64)
    total, distinct = 0, 0
    for r in counts.groupBy("g", end.alias("end")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # BUCKETS rows and one
        total, distinct = total + r.n, distinct + r.words
        if not r.end:
            group_n[r.g], group_words[r.g] = r.n, r.words
    # the least count that at most FREQUENT words reach: from a histogram, as a sort would meet in one task
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    least, size = None, 0
    for r in sizes:
        size += r.words
        if size > FREQUENT:
            break
        least = r.step
    top = counts.where(F.lit(False) if least is None else step >= least).toArrow()  # at most FREQUENT rows
    h, n, g = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy(), top.column("g").to_numpy()
    order = np.lexsort((h, -n))
    vocabulary = Vocabulary(h[order], n[order], g[order], total, distinct, group_n, group_words)
    p = flat(initial(vocabulary.freq))
    row = F.xxhash64("id", "text")
    trainers = max(1, -(-total // (max(1, ROUNDS) * TRAINER_TOKENS)))
    for r in range(ROUNDS):
        own = rows.where(F.pmod(row, F.lit(ROUNDS)) == r).withColumn("row", row).repartition(trainers, "row").sortWithinPartitions("row", "id")
        trained = own.select("text").mapInArrow(_train(p, vocabulary, RATE / 2**r), TRAINED)
        got = trained.repartition("i").sortWithinPartitions("i", "part").mapInArrow(_sum, TRAINED).toArrow().sort_by("i").to_pylist()
        if got:
            p = np.concatenate([np.frombuffer(x["v"]) / x["tokens"] for x in got]).astype(np.float32)
    return p, vocabulary


def score_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    prepare(spark)
    s = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False))
    training = rows.where(~held_out)
    counts = s.save(training.select("text").mapInArrow(_count, COUNTED).groupBy("h").agg(F.min("g").alias("g"), F.sum("n").alias("n")))
    p, vocabulary = fit(spark, training, counts)
    scored = s.save(rows.mapInArrow(_score(p, vocabulary), SCORED))
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("rid", F.col("w.rare").alias("h"), F.col("w.rare_n").alias("k"))
    found = rare.join(counts.select("h", "n").hint("merge"), "h").groupBy("rid").agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    found = s.save(found)
    n, v = vocabulary.total, vocabulary.distinct
    more = F.coalesce("rare_logs", F.lit(0.0))
    return (
        scored.drop("rare", "rare_n").join(found.hint("merge"), "rid", "left")
        .select(
            F.col("id").alias("doc_id"), held_out.alias("held_out"), "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("logs") + more - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
            (F.col("net") + F.col("logs_grouped") + more - F.col("rest")).alias("score"),
        )
    )
