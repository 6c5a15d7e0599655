"""Toxicity: a weighted lexicon, learned from labels, matched in folded text and normalised by length.

Folding undoes what is done to words so that they pass: letters of other scripts that look like Latin ones, digits and signs in place
of letters, and letters set apart by dots or dashes. Entries are whole words and beginnings of words; an entry's weight is the
log-ratio of its document frequencies among toxic and other labelled documents. One Aho-Corasick automaton finds entries and
exception phrases; what lies in an exception phrase does not count, and of several entries in a word the heaviest does.
A logistic function of the weights' sum and of the sum per word gives the score.

Training takes at most ``SAMPLE`` labelled documents of either label, one of each group of near copies; what follows covers all rows. Null
and empty texts have no words and get the score of a document without entries. Without labels of both kinds the lexicon is empty
and every score is the share of toxic labels (none: 0). Of two labels of one id the larger counts; of two texts of one id one is learned
from and each is scored. Null ids are scored and not held out. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import vectors as V
from sitegrain.llm.quality_crf import fold
from sitegrain.llm.scratch import Scratch, prepare, sized

#: Labelled documents of either label that are learned from; entries and learned exception phrases of the lexicon.
SAMPLE, ENTRIES, PHRASES = 6000, 20_000, 1000
#: Lengths of beginnings of words, in code points.
BEGINNINGS = range(3, 8)
#: An entry needs so many toxic documents, so much evidence (Dunning's log-likelihood ratio) and so much weight.
LEAST_DOCS, LEAST_EVIDENCE, LEAST_WEIGHT = 3, 10.0, 2.0
#: A beginning goes if a longer entry has so large a share of its toxic documents, and weighs so much more.
SHARE, HEAVIER = 0.8, 0.3
#: Added to each document frequency.
PRIOR = 0.5
#: An exception is a phrase with an entry, in at least so many documents that are not toxic, and at least so many times as often there.
EXCEPTION_DOCS, EXCEPTION_RATIO = 2, 2.0
#: Penalty on the logistic function's slopes.
RIDGE = 0.05

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝкмтвнгαβεικνορτυχωγηı", "aeopcyxijshdqwkmtbhraeeiknoptuxwyni"))
LOOKALIKES["β"] = "b"
# Digits and signs that stand for letters in a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "!": "i"}
#: l and i are one letter, as 1, | and ! stand for either.
SAME = {"l": "i"}
# Phrases in which a word is not meant as an insult.
EXCEPTIONS = ("class clown", "clown fish", "trash bag", "trash bin", "trash can", "trash collection")

_ALIKE = str.maketrans(LOOKALIKES | SAME)
_PUT = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"[^\W\d_][0134578@$|!]|[0134578@$|!][^\W\d_]")
_SIGNED = re.compile(r"[\w@$|!]*[0134578@$|!][\w@$|!]*")
_LETTER = re.compile(r"[^\W\d_]")
_APART = re.compile(r"(?<!\w)[^\W\d_](?:[.\-_*·][^\W\d_]){2,}(?!\w)")
_BETWEEN = re.compile(r"[.\-_*·]")
_TOKEN = re.compile(r"[^\W_]+")


def _unsigned(m: re.Match) -> str:
    """A word with its digits and signs as letters; marks at its end are no letters, and a number stays."""
    word = m.group()
    core = word.rstrip("!|")
    return core.translate(_PUT) + " " * (len(core) < len(word)) if _LETTER.search(core) else word


def folded(text: str | None) -> list[str]:
    """The words of a text as they are matched."""
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    t = t.lower()
    if _APART.search(t):
        t = _APART.sub(lambda m: _BETWEEN.sub("", m.group()), t)
    if _MIXED.search(t):
        t = _SIGNED.sub(_unsigned, t)
    return _TOKEN.findall(t.translate(_ALIKE))


def entries_of(words: Iterable[str]) -> set[str]:
    """Entries that match some word: ``w `` a whole word, ``w`` a beginning."""
    out = set()
    for w in set(words):
        out.add(w + " ")
        out.update(w[:n] for n in BEGINNINGS if n <= len(w))
    return out


def weight(toxic, clean, n_toxic: int, n_clean: int):
    """Log-ratio of an entry's document frequencies."""
    return np.log((toxic + PRIOR) / (n_toxic + 2 * PRIOR)) - np.log((clean + PRIOR) / (n_clean + 2 * PRIOR))


def evidence(toxic, clean, n_toxic: int, n_clean: int):
    """Dunning's log-likelihood ratio of two document frequencies."""
    p = (toxic + clean) / (n_toxic + n_clean)
    part = lambda k, n: k * np.log(np.maximum(k, 1e-12) / np.maximum(n * p, 1e-12)) + (n - k) * np.log(np.maximum(n - k, 1e-12) / np.maximum(n * (1 - p), 1e-12))
    return 2 * (part(toxic, n_toxic) + part(clean, n_clean))


def specific(entries: list[str], toxic: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which entries stay: a beginning that owes its toxic documents to one heavier entry that continues it goes."""
    at = {e: i for i, e in enumerate(entries)}
    keep = np.ones(len(entries), bool)
    for i in sorted(range(len(entries)), key=lambda i: -len(entries[i])):
        for n in range(len(entries[i]) - 1, 0, -1):
            up = at.get(entries[i][:n])
            if up is not None and toxic[i] >= SHARE * toxic[up] and weights[i] >= weights[up] + HEAVIER:
                keep[up] = False
    return keep


class Matcher:
    """Entries and exception phrases in one Aho-Corasick automaton over `` word word ``."""

    def __init__(self, entries: list[str], phrases: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, e in enumerate(entries):
            self.automaton.add_word(" " + e, (i, 0))
        for p in phrases:
            if words := folded(p):
                key = f" {' '.join(words)} "
                self.automaton.add_word(key, (self.automaton.get(key, (-1, 0))[0], len(words)))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def matches(self, words: list[str]) -> dict[int, list[int]]:
        """Place of each word that counts: its entries."""
        if self.empty or not words:
            return {}
        text = f" {' '.join(words)} "
        found = list(self.automaton.iter(text))
        if not found:
            return {}
        spaces = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        out: dict[int, list[int]] = {}
        excepted: set[int] = set()
        for end, (entry, size) in found:
            last = int(np.searchsorted(spaces, end)) - 1  # of the words, where a match ends
            if size:
                excepted.update(range(last - size + 1, last + 1))
            if entry >= 0:
                out.setdefault(last, []).append(entry)
        return {k: v for k, v in out.items() if k not in excepted}


def near_key(words: list[str]) -> int:
    """A key that near copies mostly share: the least hash of five words in a row."""
    if not words:
        return 0
    data, off = V.text_bytes(pa.array([" ".join(words)]))
    starts, ends, first = V.words(data, off)
    h, _ = V.shingle_hashes(V.word_hashes(data, starts, ends), first, 5)
    return int(h.min().view(np.int64)) if len(h) else 0


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [near_key(folded(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], [*b.schema.names, "near"])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's entries by label."""
    n = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            n[label].update(entries_of(folded(text)))
    keys = sorted(n[0].keys() | n[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])


def _contexts(entries: list[str]):
    """Phrases of an entry's word and a neighbour, with their document frequencies by label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, n = Matcher(entries, ()), (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                words = folded(text)
                n[label].update({f"{words[i]} {words[i + 1]}" for k in matcher.matches(words) for i in (k - 1, k) if 0 <= i < len(words) - 1})
        keys = sorted(n[0])  # an exception occurs in documents that are not toxic
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["phrase", "toxic", "clean"])

    return run


def _measures(found: dict[int, list[int]], weights: np.ndarray, n_words: int) -> tuple[float, float]:
    """Logarithms of the weights' sum per hundred words, and of the sum."""
    total = sum(max(0.0, float(weights[own].max())) for own in found.values())
    return float(np.log1p(100 * total / max(1, n_words))), float(np.log1p(total))


def _measured(entries: list[str], phrases: list[str], by_label: tuple[np.ndarray, np.ndarray]):
    """Measures of the sample's documents; ``by_label`` has the weights without a document of that label, as each is to be unseen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, phrases)
        for b in batches:
            labels = b.column("label").to_pylist()
            out = [_measures(matcher.matches(words := folded(t)), by_label[y], len(words)) for t, y in zip(b.column("text").to_pylist(), labels)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.float64()), pa.array([x for _, x in out], pa.float64()), b.column("label")], ["density", "total", "label"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, toxic: float) -> np.ndarray:
    """Bias and slopes by Newton's method, where a share of ``toxic`` of all is toxic; slopes are not negative."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    share = np.where(y > 0, toxic / max(1, (y > 0).sum()), (1 - toxic) / max(1, (y == 0).sum()))
    penalty = np.diag([1e-6, *[RIDGE / 100] * x.shape[1]])
    use = np.ones(z.shape[1], bool)
    while True:
        b = np.zeros(z.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            g = z.T @ (share * (p - y)) + penalty @ b
            h = (z * (share * p * (1 - p))[:, None]).T @ z + penalty
            step = np.zeros_like(b)
            step[use] = np.linalg.solve(h[np.ix_(use, use)], g[use])
            b -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-7:
                break
        if (b[1:] >= 0).all():
            return b
        use[1:] &= b[1:] >= 0


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: Iterable[str] = EXCEPTIONS) -> dict:
    """The lexicon and the logistic function, from at most ``sample`` documents (id, text) of either label (id, label)."""
    prepare(spark)
    s = Scratch(spark)
    known = labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    every = dict(known.groupBy("label").count().collect())
    toxic = every.get(1, 0) / max(1, sum(every.values()))
    first = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = s.save(first(0).unionByName(first(1)))  # at most 2 * sample rows
    found = docs.join(sized(chosen), "id").withColumn("th", F.xxhash64("text"))
    near = s.save(found.mapInArrow(_grouped, "id long, text string, label int, th long, near long").select("id", "th", "label", "near").groupBy("id").agg(F.min(F.struct("th", "label", "near")).alias("r")).select("id", "r.*"))
    kept = s.save(near.groupBy("label", "near").agg(F.min(F.struct("id", "th")).alias("r")).select("label", "r.*"))
    rows = s.save(docs.withColumn("th", F.xxhash64("text")).join(sized(kept), ["id", "th"]).groupBy("id", "th").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("text", "label"))
    n = {r.label: r.n for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        s.drop(chosen, near, kept, rows)
        return {"entries": [], "phrases": [], "weights": np.empty(0), "b": None, "share": toxic}
    counts = s.save(rows.mapInArrow(_counted, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST_DOCS))
    more = counts.where(F.col("toxic") * n_clean > F.col("clean") * n_toxic).orderBy(F.desc(F.col("toxic") / (F.col("clean") + F.lit(n_clean / n_toxic))), "entry").limit(ENTRIES).toPandas()
    t, c = more["toxic"].to_numpy(float), more["clean"].to_numpy(float)
    keep = (weight(t, c, n_toxic, n_clean) >= LEAST_WEIGHT) & (evidence(t, c, n_toxic, n_clean) >= LEAST_EVIDENCE)
    entries, t, c = more["entry"][keep].tolist(), t[keep], c[keep]
    keep = specific(entries, t, weight(t, c, n_toxic, n_clean))
    entries, t, c = [e for e, k in zip(entries, keep) if k], t[keep], c[keep]
    ratio = (F.col("clean") + PRIOR) * (n_toxic + 1) / ((F.col("toxic") + PRIOR) * (n_clean + 1))
    pairs = rows.mapInArrow(_contexts(entries), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    learned = pairs.where((F.col("clean") >= EXCEPTION_DOCS) & (ratio >= EXCEPTION_RATIO)).orderBy(ratio.desc(), "phrase").limit(PHRASES).collect()
    phrases = [*exceptions, *(r.phrase for r in learned)]
    without = weight(t, np.maximum(c - 1, 0), n_toxic, n_clean), weight(np.maximum(t - 1, 0), c, n_toxic, n_clean)
    m = rows.mapInArrow(_measured(entries, phrases, without), "density double, total double, label int").toPandas()  # at most 2 * sample rows of numbers
    m = m.sort_values(["label", "density", "total"])
    b = logistic(m[["density", "total"]].to_numpy(float), m["label"].to_numpy(float), toxic)
    s.drop(chosen, near, kept, rows, counts)
    return {"entries": entries, "phrases": phrases, "weights": weight(t, c, n_toxic, n_clean), "b": b, "share": 0.0}


def _score(model: dict):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model["entries"], model["phrases"])
        for rows, _, _ in V.chunks(batches):
            score, n, hits = np.full(rows.num_rows, model["share"]), [], []
            for i, text in enumerate(rows.column("text").to_pylist()):
                words = folded(text)
                found = matcher.matches(words)
                n.append(len(words))
                hits.append(len(found))
                if model["b"] is not None:
                    x = _measures(found, model["weights"], len(words))
                    score[i] = 1 / (1 + np.exp(-np.clip(model["b"] @ [1.0, *x], -30, 30)))
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(score), pa.array(n, pa.int64()), pa.array(hits, pa.int64())], ["id", "score", "n_words", "n_hits"])

    return run


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: Iterable[str] = EXCEPTIONS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_words, n_hits. Labels of held-out ids are not used."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(fold("id", 4) != 2)
    scored = rows.mapInArrow(_score(fit(spark, rows, known, exceptions=exceptions)), "id long, score double, n_words long, n_hits long")
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_words", "n_hits")
