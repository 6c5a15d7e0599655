"""Language identification in two steps: the family, then the language within it.

A text becomes a unit vector of hashed byte trigrams (letters only, A-Z lower-cased, square roots of counts). Linear
support vector machines, one against one, first choose among families and then, within the chosen
family, among its languages. They are trained by dual coordinate descent on a bounded sample of what the fold allows: of each of
the ``LANGUAGES`` most frequent languages the first documents by a hash of their ids and texts, up to ``SAMPLE`` of a
language and ``TOTAL`` in all. The hash up to which they go is read off a histogram of its logarithm, so no language is sorted.

Families of common language codes are stated below; any other code is a family of its own.

``score`` is the logistic of the smallest margin by which the family, times that by which the language, won.

Only the text enters a prediction. Defined results: null text or text without a letter is ``und`` with score 0. With no labelled
document all texts are ``und``. Rows with a null language or id are not learned from. Repeated rows are predicted each.
Extra columns are ignored, whatever their names. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import vectors as V
from sitegrain.llm.quality_crf import fold
from sitegrain.llm.scratch import Scratch, prepare

SAMPLE, TOTAL, LANGUAGES = 500, 8000, 400
#: Histogram cells to a halving of the hash.
CELLS = 8
BITS = 12
EPOCHS = 12
COST = 8.0
#: Families of languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def _letters() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


LETTER_BYTES = _letters()


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unit vectors (rows x 2 ** BITS) of the texts' trigrams; zero for a text without any."""
    n, size = len(off) - 1, 1 << BITS
    if len(data) < 3:
        return np.zeros((n, size), np.float32)
    low = LETTER_BYTES[data].astype(np.uint32)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    row = np.repeat(np.arange(n), np.diff(off))
    ok = (row[:-2] == row[2:]) & (low[1:-1] != 32)
    at = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    out = np.sqrt(np.bincount((row[:-2] * size + at)[ok], minlength=n * size).reshape(n, size)).astype(np.float32)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights and a bias (last) of a linear machine with squared hinge loss, by dual coordinate descent; y is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    # both sides weigh the same, however many documents they have
    d = np.where(y > 0, (y > 0).mean(), (y < 0).mean()) / COST
    q = (x * x).sum(1) + d
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + d[i] * a[i]
            if a[i] > 0 or g < 0:
                new = max(0.0, a[i] - g / q[i])
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w.astype(np.float32)


def _pairs(x: np.ndarray, y: np.ndarray) -> tuple[list[str], dict[tuple[int, int], np.ndarray]]:
    """The classes and one machine for each two of them (positive: the first)."""
    names = sorted(set(y.tolist()))
    machines = {}
    for i, j in combinations(range(len(names)), 2):
        own = (y == names[i]) | (y == names[j])
        machines[i, j] = svm(x[own], np.where(y[own] == names[i], 1.0, -1.0))
    return names, machines


def train(x: np.ndarray, lang: np.ndarray) -> dict:
    family = np.array([FAMILY_OF.get(c, c) for c in lang.tolist()])
    return {"families": _pairs(x, family), "within": {f: _pairs(x[family == f], lang[family == f]) for f in sorted(set(family.tolist()))}}


def _vote(x: np.ndarray, classes: tuple[list[str], dict]) -> tuple[np.ndarray, np.ndarray]:
    """The class with most wins (ties: larger margins) and its smallest margin."""
    names, machines = classes
    wins = np.zeros((len(x), len(names)))
    least = np.full((len(x), len(names)), np.inf)
    for (i, j), w in machines.items():
        m = x @ w[:-1] + w[-1]
        wins[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
        wins[:, j] += (m < 0) - 1e-3 * np.tanh(m)
        least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
    best = wins.argmax(1)
    return best, least[np.arange(len(x)), best]


def predict(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    family, margin = _vote(x, model["families"])
    lang, score = np.empty(len(x), object), 1 / (1 + np.exp(-2 * margin))
    for f, name in enumerate(model["families"][0]):
        own = np.flatnonzero(family == f)
        if len(own):
            best, within = _vote(x[own], model["within"][name])
            lang[own] = np.array(model["within"][name][0], object)[best]
            score[own] *= 1 / (1 + np.exp(-2 * within))
    return lang, np.clip(score, 0, 1)


def has_letter(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with a letter: by their bytes where those are ASCII, else by Unicode."""
    ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    out = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    texts = rows.column("text")
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in V.chunks(batches):
        keep = pa.array(has_letter(rows, data, off))
        x = pa.array([v.tobytes() for v in vectors(data, off)], pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("lang"), x], ["id", "lang", "x"]).filter(keep)


def _predict(model: dict | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in V.chunks(batches):
            known = has_letter(rows, data, off) if model else np.zeros(rows.num_rows, bool)
            lang, score = np.full(rows.num_rows, "und", object), np.zeros(rows.num_rows)
            if known.any():
                lang[known], score[known] = predict(vectors(data, off)[known], model)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def fit(spark: SparkSession, rows: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model of at most ``sample`` rows (id, text, lang) of each language."""
    s = Scratch(spark)
    known = rows.where("id is not null and lang is not null").where(fold("id", 3) != 1)
    # the smaller the hash, the larger its cell
    share = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / float(1 << 53)
    cell = F.floor(F.log2(share + 2.0**-53) * -CELLS).cast("int").alias("cell")
    each = s.save(known.select("lang", "id", F.xxhash64("text").alias("th"), cell).distinct())
    cells = s.save(each.groupBy("lang", "cell").agg(F.count("*").alias("n")))
    frequent = s.save(cells.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang"))
    most = min(sample, TOTAL // max(1, frequent.count()))
    upto = cells.join(F.broadcast(frequent), "lang").selectExpr("lang", "cell", "sum(n) over (partition by lang order by cell desc) as upto")
    least = s.save(upto.where(F.col("upto") <= most).groupBy("lang").agg(F.min("cell").alias("least")))
    chosen = s.save(each.join(F.broadcast(least), "lang").where("cell >= least").select("id", "th", "lang"))  # at most TOTAL rows
    keyed = known.withColumn("th", F.xxhash64("text"))
    found = keyed.join(F.broadcast(chosen), ["id", "th", "lang"], "left_semi").mapInArrow(_sampled, "id long, lang string, x binary").distinct().collect()
    s.drop(each, cells, frequent, least, chosen)
    found.sort(key=lambda r: (r.id, r.lang, r.x))
    if not found:
        return None
    return train(np.stack([np.frombuffer(r.x, np.float32) for r in found]), np.array([r.lang for r in found], object))


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(spark, rows)
    out = rows.select("id", "text").mapInArrow(_predict(model), "id long, lang_pred string, score double")
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
