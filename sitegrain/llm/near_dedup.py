"""Near-duplicate documents: SuperMinHash signatures, banding, verification and union-find grouping.

``near_duplicates`` links documents whose sets of five-word shingles have a Jaccard similarity of at
least 0.75 and groups what is linked.

1. One pass over the texts makes, per document, the size and a digest of its shingle set, a
   SuperMinHash signature (each element draws a *permutation* of the slots step by step, so ranks in
   different slots are correlated and no two of an element's ranks fall in the same unit interval; a
   document stops at the first step that can no longer lower any slot) and its 32 band keys.
2. Documents with equal digests are one class; only its smallest id goes on.
3. In every bucket of a band, the members are compared with the bucket's smallest and its largest member,
   and links are grouped. Buckets that then still hold several groups are finished by an
   exact prefix join: of their members, those of different groups that share one of their rarest
   shingles are compared. A bucket never needs all its pairs, texts that only have a frequent passage in common are
   not compared, and no pair that shares a bucket and could change the groups is left out.
4. Candidates are confirmed on the full shingle sets.

A pair with similarity s shares a bucket with probability 1 - (1 - s**4)**32: 0.999995 at 0.75. A digest or a bucket may hold a large share of the rows; those of hot ones are salted (``spread_join``).
Tables of a few numbers a row are counted and broadcast up to a bound, so on small inputs most joins need no shuffle; beyond it both sides are shuffled.
Shingles count as equal when their 64-bit hashes are.

Defined results: null or empty text, or text without words: no shingles, linked with nothing.
Fewer than five words: one shingle, the whole sequence. Rows with the same id count as one
document that has the shingles of each (they share a group), and every row is returned. A null id
is linked with nothing, and its ``component_id`` is null and ``kept`` true. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import vectors as V
from sitegrain.llm.scratch import Scratch, prepare, sized, spread_join, strategy

WORDS = 5
PERCENT = 75
SLOTS = 128
BAND_ROWS = 4
#: A candidate whose signatures agree on a smaller share is dropped unconfirmed. A slot agrees with probability s, so 70 of
#: 128 or fewer agree at s = 0.75 with a probability of less than 4e-7, a tenth of what banding alone may miss.
LEAST_AGREEMENT = 0.55
#: Cells in which shingles are counted for their rarity.
RARITY_CELLS = 1 << 18
#: Steps of a signature are kept as step << 24 | 24 random bits.
LEVEL = 24


def superminhash(values: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots) of the distinct values of each document, bounds[i]:bounds[i + 1].

    All elements of all documents take step j together; a document leaves when none of its slots
    holds a rank of step j or later.
    """
    docs = len(bounds) - 1
    sig = np.full(docs * slots, np.uint32(slots << LEVEL), np.uint32)
    own = np.repeat(np.arange(docs), np.diff(bounds))
    order = None
    for j in range(slots):
        if not len(values):
            break
        x = V.mix(values + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        slot = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if order is not None:
            rows = np.arange(len(values))
            chosen = order[rows, slot]
            order[rows, slot] = order[:, j]
            order[:, j] = chosen
        else:
            chosen = slot
        rank = np.uint32(j << LEVEL) | (x >> np.uint64(64 - LEVEL)).astype(np.uint32)
        np.minimum.at(sig, own * slots + chosen, rank)
        worst = sig.reshape(docs, slots).max(1) >> np.uint32(LEVEL)
        stay = worst[own] > j
        if order is None:
            values, own, slot = values[stay], own[stay], slot[stay]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
            rows = np.arange(len(values))
            order[rows, slot] = 0
            order[:, 0] = slot
        elif not stay.all():
            values, own, order = values[stay], own[stay], order[stay]
    return sig.reshape(docs, slots)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, one after another, and their bounds."""
    starts, ends, first = V.words(data, off)
    s, bounds = V.shingle_hashes(V.word_hashes(data, starts, ends), first, k)
    sets = [np.unique(s[bounds[i] : bounds[i + 1]]) for i in range(len(off) - 1)]
    return (np.concatenate(sets) if sets else s), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in V.chunks(batches):
        values, bounds = shingle_sets(data, off)
        sig = superminhash(values, bounds)
        keys = np.zeros((rows.num_rows, SLOTS // BAND_ROWS), np.uint64)
        for j in range(BAND_ROWS):
            keys = V.mix(keys + sig[:, j::BAND_ROWS].astype(np.uint64))
        keys = V.mix(keys + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)
        low = sig.astype(np.uint8)
        digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), pa.array(np.diff(bounds)), pa.array(digests, pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary())],
            ["id", "n_shingles", "digest", "bands", "low"],
        )


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in V.chunks(batches):
        values, bounds = shingle_sets(data, off)
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["id", "shingles"])


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose signatures agree often enough."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("low_a", "low_b"))
            keep = pa.array((x == y).mean(1) >= LEAST_AGREEMENT)
            yield b.select(["a", "b"]).filter(keep)


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= PERCENT * (len(both) - common))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over the links (a, b; written), for every id that has a link.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    the number of rounds follows the logarithm of a component's width. Labels are small rows that
    stay in Spark throughout; where they are few, a round is one shuffle.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("comp")))
    how = strategy(labels)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b").hint(how), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        hop = near.join(labels.hint(how), "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        up = labels.select(F.col("id").alias("mid"), F.col("comp").alias("up")).hint(how)
        new = scratch.save(hop.join(up, "mid", "left").select("id", "old", F.least("mid", F.coalesce("up", "mid")).alias("comp")))
        moved = bool(new.where("old != comp").take(1))
        scratch.drop(labels)
        labels = new.select("id", "comp")
        labels.__dict__["_scratch_path"] = new.__dict__.pop("_scratch_path")
        if not moved:
            return labels


def _histogram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall in each cell of the rarity table."""
    total = np.zeros(RARITY_CELLS, np.int64)
    for b in batches:
        for x in b.column("shingles"):
            np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(RARITY_CELLS)).astype(np.int64), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])


def _prefixes(count: np.ndarray):
    """The shingles of each set of which two sets of the least similarity must share one: its rarest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, places, keys = [], [], [], []
            for i, x in zip(b.column("id").to_pylist(), b.column("shingles"), strict=True):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(h) - -(-PERCENT * len(h) // 100) + 1
                order = np.lexsort((h, count[(h % np.uint64(RARITY_CELLS)).astype(np.int64)]))[:n]
                keys.append(h[order].view(np.int64))
                ids += [i] * len(order)
                sizes += [len(h)] * len(order)
                places += range(len(order))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(places, pa.int64()), pa.array(np.concatenate(keys))], ["id", "n", "i", "key"])

    return run


def _sharing_rare(s: Scratch, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs (id, other) with their comps, of documents that share one of their rarest shingles.

    With shingles in one order throughout, two sets of similarity at least t share one of the first
    n - ceil(t * n) + 1 shingles of each, and from the first one that they share enough are left in both: no link is missed. The order is by how many shingles of these documents share
    a cell of a table of fixed size, so what is gathered for it is bounded.
    """
    sets = s.save(docs.select("id", "text").join(sized(ids.select("id").distinct()), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary"))
    count = np.zeros(RARITY_CELLS, np.int64)
    for r in sets.mapInArrow(_histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        count[r.cell] = r.n
    first = s.save(sets.mapInArrow(_prefixes(count), "id long, n long, i long, key long").join(sized(ids), "id").select("key", "id", "n", "i", "comp"))
    often = s.save(first.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key"))
    some = s.save(first.join(sized(often), "key", "left_semi"))
    s.drop(sets, first)
    rest = some.toDF("key", "other", "m", "j", "other_comp").hint("merge")
    bound = f"{100 + PERCENT} * least(n - i, m - j) >= {PERCENT} * (n + m)"  # if this is the first that they share
    return some.join(rest, "key").where(f"id < other and comp != other_comp and {bound}")


class _Grouping:
    """Groups (id, comp) of the links confirmed so far; ids without a link have no row."""

    def __init__(self, scratch: Scratch, docs: DataFrame, reps: DataFrame):
        self.scratch, self.docs, self.reps = scratch, docs, reps
        self.tested = self.groups = None

    def confirmed(self, pairs: DataFrame) -> DataFrame | None:
        """The links among candidate pairs (a < b) that were not candidates before; None without such."""
        s = self.scratch
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(sized(self.tested), ["a", "b"], "left_anti")
        pairs = s.save(pairs)
        if not pairs.take(1):
            return None
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        # Signatures and sets are wide: pairs go to them where pairs are few, and of them only what is in a pair is shuffled.
        sig, how = self.reps.select("id", "n_shingles", "low"), strategy(pairs)
        if how == "broadcast":
            sig = s.save(sig.join(_ids(pairs).hint(how), "id", "left_semi"))
        near = sig.toDF("b", "n_b", "low_b").join(pairs.hint(how), "b").join(sig.toDF("a", "n_a", "low_a").hint("merge"), "a")
        near = near.where(F.expr(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")).select("a", "b", "low_a", "low_b")
        alike = s.save(near.mapInArrow(_alike, "a long, b long"))
        how = strategy(alike)
        sets = s.save(self.docs.select("id", "text").join(_ids(alike).hint(how), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary"))
        both = sets.toDF("b", "set_b").join(alike.hint(how), "b").join(sets.toDF("a", "set_a").hint("merge"), "a")
        found = s.save(both.mapInArrow(_confirmed, "a long, b long"))
        s.drop(alike, sets, sig)
        return found if found.take(1) else None

    def link(self, links: DataFrame | None) -> None:
        """Add links (written): those between present groups are grouped, and the result is composed with the groups."""
        s = self.scratch
        if links is None:
            return
        if self.groups is None:
            self.groups = components(s, links)
            return
        how = strategy(self.groups)
        of = lambda c: self.groups.toDF(c, f"comp_{c}").hint(how)
        between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a != b")
        between = s.save(between)
        more = components(s, between)
        joined = self.groups.join(sized(more.toDF("comp", "up")), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        new = s.save(joined.union(more.join(self.groups.select("id").hint(how), "id", "left_anti")))
        s.drop(self.groups, more, between)
        self.groups = new


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def _keyed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``spread_join``; where ``right`` has few rows, it is broadcast, and no key's rows meet in a task."""
    return left.join(right.drop("n").hint("broadcast"), key) if strategy(right) == "broadcast" else spread_join(left, right, key)


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; see the module's docstring."""
    prepare(spark)
    s = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = s.save(docs.mapInArrow(_signatures, "id long, n_shingles long, digest binary, bands array<long>, low binary"))
    some = sigs.where("n_shingles > 0 and id is not null")

    # Equal sets are a class, known by its smallest id: the row of that id goes on.
    row = F.struct("id", "n_shingles", "bands", "low")
    reps = s.save(some.groupBy("digest").agg(F.min_by(row, "id").alias("row"), F.count("*").alias("n")).select("digest", "n", "row.*"))
    classes = reps.where("n > 1").select("digest", F.col("id").alias("rep"), "n")
    same = s.save(_keyed(some.select("id", "digest"), classes, "digest").where("id != rep").select("id", "rep"))
    # An id with several texts belongs to the class of each.
    several = s.save(some.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x != y").select("id"))
    given = s.save(same.join(sized(several), "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b")))

    entries = reps.select("id", F.explode("bands").alias("key"))
    shared = s.save(entries.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other"), F.count("*").alias("n")).where("n > 1"))
    members = s.save(_keyed(entries, shared, "key"))

    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    g = _Grouping(s, docs, reps)
    g.link(given if given.take(1) else None)
    g.link(g.confirmed(members.select("id", F.explode(F.array("pivot", "other")).alias("other")).where("id != other").select(*pair("id", "other"))))
    # Without a link, every member is a group of its own.
    comp = members.select("key", "id", F.col("id").alias("comp")) if g.groups is None else members.join(sized(g.groups), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    now = s.save(comp)
    split = s.save(now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low != high").select("key", "n"))
    if split.take(1):
        left = s.save(_keyed(now, split, "key").select("id", "comp").distinct())
        g.link(g.confirmed(_sharing_rare(s, docs, left).select(*pair("id", "other"))))
    s.drop(now, split, members, shared, reps)

    # A row has its class's group; it keeps its own id where it is linked with nothing.
    group = same.withColumnRenamed("rep", "comp")
    if g.groups is not None:
        lookup = sized(g.groups.toDF("rep", "comp"))
        group = same.join(lookup, "rep", "left").select("id", F.coalesce("comp", "rep").alias("comp")).union(g.groups.select("id", "comp"))
    group = s.save(group.groupBy("id").agg(F.min("comp").alias("comp")).where("id != comp"))
    return (
        sigs.select("id", "n_shingles")
        .join(sized(group), "id", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.coalesce("comp", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("comp", "id"), F.lit(True)).alias("kept"),
        )
    )
