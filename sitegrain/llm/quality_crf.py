"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. A line's features, and those of its neighbours, give
node scores; a 2 x 2 matrix scores neighbouring labels. Forward-backward gives each line's marginal
probability of being good; the mean over a document's lines, weighted by their length, is calibrated to the
document's score.

Training: a sample of at most ``SAMPLE`` labelled documents (the first by a hash of their ids, of those
that the fold allows and that have at most ``SAMPLE_LINES`` lines), every line with its document's label;
gradient ascent on the conditional log-likelihood. The model is a few dozen numbers. Scoring covers
whole texts of all documents, in Arrow batches.

Only the text enters a score. Defined results: a text without lines (null, empty, blank) gets the
training documents' share of label 1, or 0.5 where there are no labels at all. Repeated rows are scored each, and learned from
once; of an id's different texts, one. Repeated labels of one document: the largest counts. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import vectors as V
from sitegrain.llm.scratch import Scratch, prepare, sized

SAMPLE = 4000
SAMPLE_LINES = 400
ROUNDS = 150
RATE = 0.15
PENALTY = 1e-3
N_OWN = 11


def _class(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


UPPER = _class(bytes(range(65, 91)))
LETTERS = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
DIGITS = _class(b"0123456789")
SYMBOLS = _class(b"#*$%&<>~^@_=+\\/{}[]")
PIPES = _class(b"|")
SHOUTS = _class(b"!?")


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each document's first line, first word of each line): lines that have a word."""
    newline = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], newline + 1]))
    starts = cut[cut < len(data)]
    ends = np.append(starts[1:], len(data))
    ws, _, _ = V.words(data, off)
    first = np.searchsorted(ws, starts)
    last = np.searchsorted(ws, ends)
    keep = last > first
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, off), np.stack([first[keep], last[keep]])


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of every line, lengths in bytes, index of each document's first line)."""
    starts, ends, first, span = lines_of(data, off)
    if not len(starts):
        return np.empty((0, N_OWN), np.float32), np.empty(0), first
    ws, we, _ = V.words(data, off)
    h = V.word_hashes(data, ws, we)
    length = (ends - starts).astype(np.float64)
    n = (span[1] - span[0]).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return (total[ends] - total[starts]) / length

    letters = np.maximum(share(LETTERS), 1e-3)
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]))])
    again = (same[span[1]] - same[np.minimum(span[0] + 1, span[1])]) / n
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(7)))])
    whole = total[span[1]] - total[span[0]]
    doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    order = np.lexsort((np.arange(len(starts)), whole, doc))
    repeat = np.zeros(len(starts))
    repeat[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    word = np.concatenate([[0], np.cumsum(we - ws)])
    mean = (word[span[1]] - word[span[0]]) / n
    own = np.stack(
        [
            np.ones_like(n), np.log1p(n) / 4, 5 * share(SYMBOLS), np.sqrt(share(SYMBOLS)), 2 * share(UPPER) / letters, 5 * share(SHOUTS),
            5 * share(PIPES), 3 * share(DIGITS), 2 * again, repeat, (mean - 5) / 5,
        ],
        1,
    )
    return np.clip(own, -4, 4).astype(np.float32), length, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and of the line after (zeros at a document's ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    some = first[:-1][first[:-1] < first[1:]]
    before[some] = 0
    after[first[1:][first[:-1] < first[1:]] - 1] = 0
    return np.concatenate([own, before, after], 1)


def forward_backward(node: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals per line and label, expected transitions 2 x 2, log normaliser per document).

    ``node`` is lines x 2. Documents step together, longest first, so each step is one array operation.
    """
    n = np.diff(first)
    docs = np.argsort(-n, kind="stable")
    docs = docs[n[docs] > 0]
    head, m = first[:-1][docs], n[docs]
    alpha, beta, norm = np.zeros_like(node, dtype=np.float64), np.ones_like(node, dtype=np.float64), np.zeros(len(node))
    top = node.max(1, keepdims=True)
    e, t = np.exp(node - top), np.exp(pair)
    steps = int(m[0]) if len(m) else 0
    for k in range(steps):
        at = head[: np.searchsorted(-m, -k)] + k
        a = e[at] if k == 0 else (alpha[at - 1] @ t) * e[at]
        z = a.sum(1)
        alpha[at], norm[at] = a / z[:, None], np.log(z)
    edges = np.zeros((2, 2))
    for k in range(steps - 1, 0, -1):
        at = head[: np.searchsorted(-m, -k)] + k
        b = e[at] * beta[at]
        z = np.exp(norm[at])[:, None]
        edges += (alpha[at - 1][:, :, None] * t[None] * (b / z)[:, None, :]).sum(0)
        beta[at - 1] = (b @ t.T) / z
    marginal = alpha * beta
    total = norm + top[:, 0]
    sums = np.concatenate([[0.0], np.cumsum(total)])
    return marginal / np.maximum(marginal.sum(1, keepdims=True), 1e-300), edges, sums[first[1:]] - sums[first[:-1]]


def train(own: list[np.ndarray], length: list[np.ndarray], labels: np.ndarray) -> dict:
    """Weights from documents' line features and labels; the calibration also from the lines' lengths."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    x = with_neighbours(np.concatenate(own), first).astype(np.float64)
    y = np.repeat(labels, np.diff(first))
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    inside = np.ones(len(y), bool)
    inside[first[:-1][first[:-1] < first[1:]]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
    speed_w, speed_p = np.zeros_like(w), np.zeros_like(pair)
    scale = len(y)
    for r in range(ROUNDS):
        node = np.stack([np.zeros(len(y)), x @ w], 1)
        marginal, edges, _ = forward_backward(node, pair, first)
        grad = x.T @ (y - marginal[:, 1]) / scale - PENALTY * w
        gradp = (seen - edges) / scale - PENALTY * pair
        speed_w, speed_p = 0.9 * speed_w + grad, 0.9 * speed_p + gradp
        w += RATE * speed_w
        pair += RATE * speed_p
    model = {"w": w, "pair": pair, "prior": float(labels.mean()), "a": 1.0, "b": 0.0}
    raw = _raw(x, np.concatenate(length).astype(np.float64), first, model)
    ok = ~np.isnan(raw)
    z, t = np.log(raw[ok] / (1 - raw[ok])), labels[ok]
    a, b = 1.0, 0.0
    for _ in range(300):  # a logistic calibration of the mean
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a + 0.1 * ((t - p) * z).mean(), b + 0.5 * (t - p).mean()
    return model | {"a": float(a), "b": float(b)}


def _raw(x: np.ndarray, length: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    """Length-weighted mean marginal of label good per document; NaN without lines."""
    node = np.stack([np.zeros(len(x)), x @ model["w"]], 1)
    marginal, _, _ = forward_backward(node, model["pair"], first)
    good = np.concatenate([[0.0], np.cumsum(marginal[:, 1] * length)])
    total = np.concatenate([[0.0], np.cumsum(length)])
    n = total[first[1:]] - total[first[:-1]]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.clip((good[first[1:]] - good[first[:-1]]) / np.where(n > 0, n, np.nan), 1e-4, 1 - 1e-4)


def score_texts(data: np.ndarray, off: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(off) - 1, 0.5)
    own, length, first = features(data, off)
    raw = _raw(with_neighbours(own, first).astype(np.float64), length, first, model)
    z = model["a"] * np.log(raw / (1 - raw)) + model["b"]
    return np.where(np.isnan(raw), model["prior"], 1 / (1 + np.exp(-z)))


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in V.chunks(batches):
        own, length, first = features(data, off)
        few = np.diff(first) <= SAMPLE_LINES
        both = np.concatenate([own, length[:, None].astype(np.float32)], 1)
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([both[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["id", "lines"]).filter(pa.array(few & (np.diff(first) > 0)))


def _score(model: dict | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in V.chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(score_texts(data, off, model))], ["id", "score"])

    return run


def fold(id_col: str, n: int):
    """crc32 of an id's decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model of a bounded sample of the labelled documents (id, text), (id, label)."""
    prepare(spark)
    s = Scratch(spark)
    known = labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = s.save(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    lines = docs.join(sized(chosen.select("id")), "id", "left_semi").mapInArrow(_sampled, "id long, lines binary").groupBy("id").agg(F.min("lines").alias("lines")).join(sized(chosen), "id")
    rows = sorted(((r.id, r.lines, r.label) for r in lines.collect()))  # at most SAMPLE documents of SAMPLE_LINES lines
    if not rows:
        return None
    each = [np.frombuffer(x, np.float32).reshape(-1, N_OWN + 1) for _, x, _ in rows]
    return train([x[:, :N_OWN] for x in each], [x[:, N_OWN] for x in each], np.array([y for _, _, y in rows], np.int64))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Labels of held-out ids are not used."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(fold("id", 3) != 1)
    model = fit(spark, rows, known)
    scored = rows.mapInArrow(_score(model), "id long, score double")
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
