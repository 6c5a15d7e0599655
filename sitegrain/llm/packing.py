"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Each document's tokens, with an end id, are cut into whole windows and a rest; rests are cut into
pieces of at most ``PIECE`` tokens. A block of pieces is then partitioned into k windows: every piece
starts as a partial partition of its own, and the two partial partitions with the largest imbalances
are merged, largest window against smallest, until one is left. k starts at the least number of
windows that the block's tokens need and rises while the fullest window exceeds the capacity.

Blocks are what one task has read, at most ``BLOCK`` pieces at a time, so packing needs no shuffle and
a task's memory is bounded; a retried task reads the same rows and makes the same windows.

Tokenising: a pretoken's ids do not depend on what surrounds it, so each distinct pretoken of a task is
encoded once. Pretokens are found by array operations where the text has only Latin-1 characters and no
apostrophe; other texts are encoded whole, and so are those with a pretoken whose bytes are not the remembered ones.

Defined results: null and empty texts are the end id alone. Repeated rows are packed each. Extra
columns are ignored, whatever their names. A null id is carried. An empty table gives no rows.
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
from sitegrain.llm.scratch import prepare

WINDOW = 1024
#: Rests are cut to pieces of at most so many tokens: several to a window, so that differencing can even them out.
PIECE = 256
#: Pieces that are partitioned together.
BLOCK = 8192
END_ID = 0
#: Distinct pretokens whose ids a task remembers.
CACHE = 1_500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The k windows (lists of indices) that multiway differencing makes of ``sizes``.

    A partial partition holds the sums of its windows, largest first, without those that are empty,
    and for each the node of a tree whose leaves are the pieces in it.
    """
    children: dict[int, tuple[int, int]] = {}
    heap = [(-n, i, np.array([n]), np.array([i])) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    merges, nodes = len(sizes), len(sizes)
    while len(heap) > 1:
        _, _, x, p = heapq.heappop(heap)
        _, _, y, q = heapq.heappop(heap)
        if over := max(0, len(x) + len(y) - k):
            # x's smallest windows take y's smallest ones, in opposite orders; y's others have windows of their own
            own = len(x) - over
            for t in range(over):
                children[nodes + t] = (int(p[own + t]), int(q[len(y) - 1 - t]))
            x = np.concatenate([x[:own], x[own:] + y[::-1][:over], y[: len(y) - over]])
            p = np.concatenate([p[:own], np.arange(nodes, nodes + over), q[: len(q) - over]])
            nodes += over
            in_order = False
        else:
            in_order = y[0] <= x[-1]
            x, p = np.concatenate([x, y]), np.concatenate([p, q])
        if not in_order:
            order = np.argsort(-x, kind="stable")
            x, p = x[order], p[order]
        merges += 1
        heapq.heappush(heap, (-int(x[0] - (x[-1] if len(x) == k else 0)), merges, x, p))
    windows = []
    for node in heap[0][3].tolist() if heap else []:
        window, todo = [], [node]
        while todo:
            n = todo.pop()
            if n in children:
                todo += children[n]
            else:
                window.append(n)
        windows.append(sorted(window))
    return windows + [[] for _ in range(k - len(windows))]


def pack(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows of at most ``capacity``, near equal, as few as differencing finds from the least number upwards."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += max(1, k // 256)


LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 4


def _classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    c[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
    c[48:58] = NUMBER
    c[[*range(9, 14), 32]] = BLANK
    return c


CLASSES = _classes()
#: Second bytes of the characters U+0080 to U+00BF that are letters, numbers or blanks.
C2_LETTERS, C2_NUMBERS, C2_BLANKS = (0xAA, 0xB5, 0xBA), (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE), (0x85, 0xA0)


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pretokens of texts that have only Latin-1 characters and no apostrophe, and the rows that do not."""
    heads = off[:-1][off[:-1] < off[1:]]
    odd = np.flatnonzero((data >= 0xC4) | (data == 0x27))
    slow = np.unique(np.searchsorted(off, odd, "right") - 1)
    kind = CLASSES[data]
    for lead, seconds, is_a in ((0xC3, (0x97, 0xB7), OTHER), (0xC2, C2_LETTERS, LETTER), (0xC2, C2_NUMBERS, NUMBER), (0xC2, C2_BLANKS, BLANK)):
        at = np.flatnonzero(data == lead)
        kind[at[np.isin(data[at + 1], seconds)]] = is_a
    follow = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    kind[follow] = kind[follow - 1]
    start = np.empty(len(data), bool)
    start[0], start[1:] = True, kind[1:] != kind[:-1]
    # of blanks before something else, the last is apart, or with it if it is a space
    after = np.flatnonzero(start[1:] & (kind[:-1] == BLANK)) + 1
    after = after[~np.isin(after, heads)]
    last = after - 1 - ((data[after - 1] >= 0x80) & (data[after - 1] < 0xC0))
    start[last] = True
    start[after[data[last] == 32]] = False
    start[heads] = True
    return np.flatnonzero(start), slow


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first place of each, and each place's key; told apart by a hash table, so that only distinct ones are sorted."""
    found = pa.array(keys).dictionary_encode()
    values, at = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.full(len(order), len(keys), np.int64)
    # a key's number in the dictionary is the order of its first place: there the highest number so far rises
    top = np.maximum.accumulate(at)
    first[place] = np.flatnonzero(np.append(True, top[1:] > top[:-1]))
    return values[order], first, place[at]


class Encoder:
    """Token ids of texts; remembers the ids of distinct pretokens in sorted arrays."""

    def __init__(self, path: str):
        self.path, self.tokenizer, self.added = path, None, []
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.ids = np.empty(0, np.uint32)
        self.raw, self.raw_at, self.raw_n = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        if not texts:
            return []
        if self.tokenizer is None:  # a large object; a worker that waits for its next task doesn't keep it
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the fast form gives the same ids and keeps no places of tokens in the text
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        found = self._encoded([x.decode("utf-8", "replace") for x in raw])
        size = np.array([len(x) for x in raw], np.int64)
        begin = len(self.raw) + np.cumsum(size) - size
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(raw), np.uint8)])
        n = np.array([len(x) for x in found], np.uint32)
        at = (len(self.ids) + np.cumsum(n, dtype=np.int64) - n).astype(np.uint32)
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.n, where, n)
        self.raw_at, self.raw_n = np.insert(self.raw_at, where, begin), np.insert(self.raw_n, where, size)

    def _other(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Pretokens (which follow each other without gaps) whose bytes are not those remembered for their hash."""
        size = ends - starts
        at = np.arange(len(data)) + np.repeat(self.raw_at[where] - starts, size)
        differs = self.raw[np.minimum(at, len(self.raw) - 1)] != data
        return np.flatnonzero((self.raw_n[where] != size) | np.logical_or.reduceat(differs, starts))

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each row."""
        if not len(data):
            return [np.empty(0, np.uint32)] * (len(off) - 1)
        starts, slow = pretokens(data, off)
        ends = np.append(starts[1:], len(data))
        keys, first, back = distinct(V.word_hashes(data, starts, ends, V.PLAIN))
        if len(self.keys) > CACHE:
            self.clear()
        where = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[where] != keys) if len(self.keys) else np.arange(len(keys))
        raw = data.tobytes()
        self._learn(keys[new], [raw[a:b] for a, b in zip(starts[first[new]], ends[first[new]], strict=True)])
        where = np.searchsorted(self.keys, keys)[back]
        slow = np.union1d(slow, np.searchsorted(off, starts[self._other(data, starts, ends, where)], "right") - 1)
        # a text with an added token, which is one id and no pretokens, is encoded whole
        marked = []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                marked.append(at)
                at = raw.find(token, at + 1)
        slow = np.union1d(slow, np.searchsorted(off, np.array(marked, np.int64), "right") - 1)
        n = self.n[where].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.at[where].astype(np.int64) - total[:-1], n) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, off)]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, found in zip(slow, self._encoded([raw[off[i] : off[i + 1]].decode() for i in slow]), strict=True):
            out[i] = np.array(found, np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def _blocks(path: str, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        sequence = TaskContext.get().partitionId() << 40
        done: list[tuple] = []
        rest: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, done, rest
            for w in pack([x[2] for x in rest], window):
                at = 0
                for i in w:
                    done.append((*rest[i], sequence, at))
                    at += rest[i][2]
                sequence += 1
            cols = list(zip(*done, strict=True)) or [[]] * 7
            done, rest = [], []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

        for rows, data, off in V.chunks(batches):
            for doc, ids in zip(rows.column("id").to_pylist(), encoder.encode(data, off), strict=True):
                raw = memoryview(np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes())
                n = len(raw) // 4
                whole = n // window * window
                for a in range(0, whole, window):
                    done.append((doc, a, window, zlib.crc32(raw[4 * a : 4 * (a + window)]), n, sequence, 0))
                    sequence += 1
                parts = -(-(n - whole) // PIECE)
                for i in range(parts):
                    a, b = whole + (n - whole) * i // parts, whole + (n - whole) * (i + 1) // parts
                    rest.append((doc, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n))
                if len(rest) >= BLOCK or len(done) >= 8 * BLOCK:
                    yield flush()
        if done or rest:
            yield flush()
        encoder.tokenizer = None
        V.release()

    return run


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    prepare(spark)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_blocks(tokenizer, window), SCHEMA)
