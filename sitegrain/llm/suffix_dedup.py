"""Repeated passages across documents, by sparse suffix arrays.

``repeated_passages`` finds every run of at least ``LEAST`` words that also stands in another document.

1. A document's suffixes are kept only where a minimiser starts: the smallest hashed run of ``GRAM`` words
   in some window of consecutive runs. A window spans ``LEAST`` words, and what it selects depends on those
   words alone, so a passage of that length has the same suffixes kept in every document.
2. Suffixes whose first run no other document has are dropped. The others get their context: the
   words that a match of ``LEAST`` words through this run can reach, to the right and to the left.
3. Suffixes with equal contexts are one entry. Every window of ``LEAST`` words of an entry's context that holds the run
   is compared by its hash with the same windows of all entries of that run, and stays where it has two documents or more.
   Runs of up to ``HOT`` entries are compared within a task; the windows of others are dealt by their hashes, so
   what is found depends neither on the size of a group nor on an order.
4. A document's matches are merged into maximal passages.

Words are runs other than ASCII blanks, A-Z lower-cased, compared by 32 bits of their hash within windows that
agree on a 64-bit hash. Contexts have a fixed size, so rows do whatever the texts' lengths.

Defined results: one row per passage; documents without one (null, empty, short) have none. A passage repeated only within one
document is not reported. Rows with the same id are one document. Null ids are left out. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import vectors as V
from sitegrain.llm.scratch import Scratch, prepare, sized

LEAST = 50
GRAM = 12
WINDOW = LEAST - GRAM + 1
#: Words of context from the run on, and before it.
RIGHT, LEFT = LEAST, LEAST - GRAM
#: Entries of one run beyond which their windows are dealt to several tasks.
HOT = 20_000
#: Entries whose windows are compared at once, at least.
CHUNK = 20_000


def _sliding(x: np.ndarray, n: int, of) -> np.ndarray:
    """``of`` over x[i : i + n], for all i that have n elements, by doubling."""
    have, out = 1, x
    while 2 * have <= n:
        out = of(out[:-have], out[have:])
        have *= 2
    rest = n - have
    return of(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Indices of the grams (of all documents, bounds[i]:bounds[i + 1]) that are smallest in a window of their document."""
    if len(grams) < WINDOW:
        return np.empty(0, np.int64)
    least = _sliding(grams, WINDOW, np.minimum)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least = np.where(doc[: len(least)] == doc[WINDOW - 1 :], least, np.uint64(0))
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    return np.flatnonzero((_sliding(padded, WINDOW, np.maximum) == grams) & (grams > 0))


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in V.chunks(batches):
        starts, ends, first = V.words(data, off)
        grams, bounds = V.shingle_hashes(V.word_hashes(data, starts, ends), first, GRAM)
        at = minimisers(grams, bounds)
        doc = np.searchsorted(bounds, at, "right") - 1
        yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(doc)), pa.array(at - bounds[doc]), pa.array(grams[at].view(np.int64))], ["id", "pos", "gram"])


ENTRY = "id long, pos long, gram long, ahead binary, n_ahead int, behind binary, n_behind int"


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in V.chunks(batches):
        starts, ends, first = V.words(data, off)
        h = V.word_hashes(data, starts, ends)
        grams, bounds = V.shingle_hashes(h, first, GRAM)
        h = (h >> np.uint64(32)).astype(np.uint32)
        h = np.concatenate([np.zeros(LEFT, np.uint32), h, np.zeros(RIGHT, np.uint32)])
        wanted = rows.column("at").to_pylist()
        doc = np.repeat(np.arange(rows.num_rows), [len(x) for x in wanted])
        pos = np.array([p for x in wanted for p in x], np.int64)
        inside = pos < np.diff(bounds)[doc]  # rows of one id have positions of each other
        doc, pos = doc[inside], pos[inside]
        word = first[doc] + pos
        ahead = h[(word + LEFT)[:, None] + np.arange(RIGHT)]
        behind = h[(word + LEFT - 1)[:, None] - np.arange(LEFT)]
        n_ahead, n_behind = np.minimum(RIGHT, first[doc + 1] - word), np.minimum(LEFT, pos)
        ahead[np.arange(RIGHT) >= n_ahead[:, None]] = 0
        behind[np.arange(LEFT) >= n_behind[:, None]] = 0
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("id").take(pa.array(doc)), pa.array(pos), pa.array(grams[bounds[doc] + pos].view(np.int64)),
                pa.array([x.tobytes() for x in ahead], pa.binary()), pa.array(n_ahead.astype(np.int32)), pa.array([x.tobytes() for x in behind], pa.binary()), pa.array(n_behind.astype(np.int32)),
            ],
            [f.split()[0] for f in ENTRY.split(", ")],
        )


SPAN = "ctx long, ahead_by int, behind_by int, partner long, partner2 long"
DEALT = "win long, ctx long, low long, high long, behind_by int"
#: Words before the run in each window.
SPLITS = np.arange(LEFT + 1)


def _mix(h: np.ndarray, x) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _windows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of each entry (rows) by the words that stand before the run (columns), and which the document has."""
    wide = lambda c, n: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32).reshape(-1, n).astype(np.uint64)
    of = lambda c: t.column(c).to_numpy()
    ahead, behind = wide("ahead", RIGHT), wide("behind", LEFT)
    h = of("gram").astype(np.int64).view(np.uint64)
    out = np.empty((len(h), len(SPLITS)), np.uint64)
    for k in range(RIGHT):
        h = _mix(h, ahead[:, k])
        if k + 1 >= LEAST - LEFT:
            out[:, LEAST - (k + 1)] = h
    h = np.full(len(h), LEAST, np.uint64)
    for b in SPLITS:
        out[:, b] = _mix(_mix(out[:, b], h), np.uint64(b))
        if b < LEFT:
            h = _mix(h, behind[:, b])
    return out, (of("n_ahead")[:, None] >= LEAST - SPLITS) & (of("n_behind")[:, None] >= SPLITS)


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the windows of another document cover of each entry, of entries sorted by their runs."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        win, has = _windows(t)
        low, high = t.column("low").to_numpy(), t.column("high").to_numpy()
        n = len(low)
        least, most = np.full(n, LEAST), np.full(n, -1)
        partner, partner2 = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        for b in SPLITS:
            i = np.flatnonzero(has[:, b])
            if not len(i):
                continue
            i = i[np.argsort(win[i, b])]
            at = np.flatnonzero(np.append(True, win[i[1:], b] != win[i[:-1], b]))
            size = np.diff(np.append(at, len(i)))
            first, last = (np.repeat(f.reduceat(x[i], at), size) for f, x in ((np.minimum, low), (np.maximum, high)))
            two = first != last
            i, first, last = i[two], first[two], last[two]
            least[i], most[i] = np.minimum(least[i], b), b
            partner[i], partner2[i] = np.minimum(partner[i], first), np.maximum(partner2[i], last)
        i = np.flatnonzero(most >= 0)
        cols = (t.column("ctx").to_numpy()[i], LEAST - least[i], most[i], partner[i], partner2[i])
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(x) for c, x in zip(cols, types, strict=True)], [f.split()[0] for f in SPAN.split(", ")])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            whole = int(np.flatnonzero(gram == gram[-1])[0])  # the last run may go on
            if whole:
                yield compare(t.slice(0, whole))
            held, size = t.slice(whole).to_batches(), t.num_rows - whole
    if size:
        yield compare(pa.Table.from_batches(held))


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of each entry."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        win, has = _windows(t)
        i, b = np.nonzero(has)
        cols = [pa.array(win[i, b].view(np.int64))] + [t.column(c).to_numpy()[i] for c in ("ctx", "low", "high")]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(b.astype(np.int32))], [f.split()[0] for f in DEALT.split(", ")])


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal repeated passage: doc_id, start_word, end_word (exclusive), n_words, partner_id (a document that has a part of it)."""
    prepare(spark)
    s = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    anchors = s.save(docs.mapInArrow(_anchors, "id long, pos long, gram long"))
    shared = s.save(anchors.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("gram"))
    kept = anchors.join(shared.hint("merge"), "gram", "left_semi").groupBy("id").agg(F.collect_set("pos").alias("at"))  # of one document
    kept = s.save(kept)
    texts = docs.join(sized(kept.select("id")), "id", "left_semi").join(kept.hint("merge"), "id")
    entries = s.save(texts.select("id", "text", "at").mapInArrow(_contexts, ENTRY))
    s.drop(anchors, shared, kept)

    # Equal contexts are one entry, with its smallest and largest document.
    same = ["gram", "ahead", "n_ahead", "behind", "n_behind"]
    ctx = F.xxhash64(*same).alias("ctx")
    classes = s.save(entries.groupBy(*same).agg(F.min("id").alias("low"), F.max("id").alias("high")).select("*", ctx))
    parts = ["gram", "ctx", "low", "high", "ahead", "n_ahead", "behind", "n_behind"]
    hot = s.save(classes.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram"))
    few = sized(hot)
    cold = classes.join(few, "gram", "left_anti").select(*parts).repartition("gram").sortWithinPartitions("gram")
    found = s.save(cold.mapInArrow(_shared, SPAN))
    dealt = s.save(classes.join(few, "gram", "left_semi").select(*parts).mapInArrow(_dealt, DEALT))
    two = dealt.groupBy("win").agg(F.min("low").alias("partner"), F.max("high").alias("partner2")).where("partner != partner2")
    wide = (
        dealt.select("win", "ctx", "behind_by").join(two.hint("merge"), "win").groupBy("ctx")
        .agg((LEAST - F.min("behind_by")).cast("int").alias("ahead_by"), F.max("behind_by").alias("behind_by"), F.min("partner").alias("partner"), F.max("partner2").alias("partner2"))
    )
    best = found.unionByName(wide)
    spans = s.save(
        entries.select("id", "pos", ctx).join(best.hint("merge"), "ctx")
        .select("id", (F.col("pos") - F.col("behind_by")).alias("start"), (F.col("pos") + F.col("ahead_by")).alias("stop"), F.when(F.col("partner") != F.col("id"), F.col("partner")).otherwise(F.col("partner2")).alias("partner"))
        .groupBy("id", "start").agg(F.max("stop").alias("stop"), F.min("partner").alias("partner"))
    )
    s.drop(entries, classes, hot, found, dealt)
    run = spans.selectExpr("*", "max(stop) over (partition by id order by start rows between unbounded preceding and 1 preceding) as before")
    run = run.selectExpr("*", "sum(if(start <= before, 0, 1)) over (partition by id order by start rows between unbounded preceding and current row) as run")
    merged = run.groupBy("id", "run").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("partner").alias("partner_id"))
    return merged.select(F.col("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id")
