"""Collocations: frequent phrases of each language that occur together more often than their parts' counts lead one to expect.

Counts are exact and over all rows. Every task counts the phrases of its shard of text, sorts them and builds count automata of
them, one for each prefix range (of the language, first and second word); a range's automata are united, which sums the counts. A phrase of
two words is counted only where both words, and a longer one only where all its pairs, are frequent: that is read from bit maps
of a fixed size, which may let a phrase through that is not frequent, but never hold one back. Automata of the frequent phrases then
give the counts of every phrase's parts.

Null and empty texts have no words; a null language is ``und``. Words are compared by their bytes, within a shard by 64-bit
hashes. Rows alike count each. Ids and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegrain.llm import count_automaton as A
from sitegrain.llm import vectors as V
from sitegrain.llm.scratch import Scratch, prepare, spread_join

U64 = np.uint64
#: Where a piece of text ends.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
IS_WORD = ~PIECE_ENDS
IS_WORD[[0x20, 0x09]] = False
#: Bits of a map of frequent words or pairs, as a power of two: 16 MB, whatever the corpus.
MAP_BITS = 27
#: Words of a shard; words of the corpus for each prefix range.
SHARD_WORDS, RANGE_WORDS = 1 << 21, 1 << 23
#: Buckets in which the first of a language are taken before they meet.
TOP_BUCKETS = 64


def lang_hashes(langs: pa.Array) -> np.ndarray:
    data, off = V.text_bytes(langs)
    return V.mix(V.word_hashes(data, off[:-1], off[1:], V.PLAIN) ^ U64(0x5851F42D4C957F2D))


def keyed(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hash of a word of a language, from the hashes of both."""
    return V.mix(word + lang)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return V.mix(a * U64(0x9E3779B97F4A7C15) + b)


def bit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - MAP_BITS)).astype(np.int64)


def ranges(first: np.ndarray, second: np.ndarray | None, bits: int) -> np.ndarray:
    """Prefix range by the hashes of the first two words (None: there is no second)."""
    one, two = (bits + 1) // 2, bits // 2
    high = lambda h, n: (h >> U64(64 - n)).astype(np.int64) if n else np.zeros(len(h), np.int64)
    return high(first, one) << two | (0 if second is None else high(second, two))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(ends - starts)])
    raw = V.LOWER[data[np.repeat(starts - off[:-1], ends - starts) + np.arange(off[-1])]]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw))


class _Shard:
    """Words of a piece of the corpus: hashes in order, 0 between pieces, and each distinct word once."""

    def __init__(self):
        self.order: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.known: list[tuple[np.ndarray, pa.Array, pa.Array]] = []
        self.size = 0

    def add(self, rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, allowed) -> None:
        starts, ends, first = V.words(data, off, IS_WORD)
        if not len(starts):
            return
        codes = rows.column("lang").dictionary_encode()
        of_doc = lang_hashes(codes.dictionary)[codes.indices.to_numpy(zero_copy_only=False)]
        h = keyed(V.word_hashes(data, starts, ends), np.repeat(of_doc, np.diff(first)))
        h[h == 0] = 1
        ended = np.concatenate([[0], np.cumsum(PIECE_ENDS[data])])
        new = np.ones(len(h), bool)
        new[1:] = ended[starts[1:]] != ended[ends[:-1]]
        new[first[:-1][first[:-1] < len(h)]] = True
        keep = np.ones(len(h), bool) if allowed is None else allowed[bit(h) >> 3] >> (bit(h) & 7) & 1 > 0
        seen = h[keep]
        unique, at = np.unique(seen, return_index=True)
        at = np.flatnonzero(keep)[at]
        doc = np.searchsorted(first, at, "right") - 1
        self.known.append((unique, _strings(data, starts[at], ends[at]), rows.column("lang").take(pa.array(doc))))
        # a gap before each piece; words that are held back are gaps as well
        place = np.arange(len(h)) + np.cumsum(new)
        order = np.zeros(len(h) + int(new.sum()), U64)
        order[place[keep]] = seen
        self.order.append(order)
        self.size += len(h)

    def distinct(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Hashes in order, words and languages."""
        every = np.concatenate([u for u, _, _ in self.known])
        h, at = np.unique(every, return_index=True)
        take = pa.array(at)
        both = (pa.chunked_array([k[i] for k in self.known], pa.string()).take(take).combine_chunks() for i in (1, 2))
        return h, *both


def _shards(batches: Iterable[pa.RecordBatch], allowed=None) -> Iterator[_Shard]:
    own = _Shard()
    for rows, data, off in V.chunks(batches):
        own.add(rows, data, off, allowed)
        if own.size >= SHARD_WORDS:
            yield own
            own = _Shard()
    if own.size:
        yield own


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a shard's words, and of all of a language (null word)."""
    for shard in _shards(batches):
        h, word, lang = shard.distinct()
        order = np.concatenate(shard.order)
        n = np.bincount(np.searchsorted(h, order[order > 0]), minlength=len(h))
        codes = lang.dictionary_encode()
        total = np.bincount(codes.indices.to_numpy(zero_copy_only=False), n, len(codes.dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([lang, word, pa.array(n), pa.array(h.view(np.int64)), pa.array(bit(h))], ["lang", "word", "n", "h", "bit"])
        none = pa.nulls(len(total), pa.string())
        zero = pa.array(np.zeros(len(total), np.int64))
        yield pa.RecordBatch.from_arrays([codes.dictionary, none, pa.array(total), zero, zero], ["lang", "word", "n", "h", "bit"])


def _count_phrases(lengths: range, range_bits: int, words, pairs):
    """Automata of a shard's phrases of these lengths: (range, automaton). ``words``, ``pairs``: broadcast maps of frequent ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, words.value):
            got = list(_automata(shard, lengths, range_bits, None if pairs is None else pairs.value))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int64()), pa.array([b for _, b in got], pa.binary())], ["range", "automaton"])

    return run


def _automata(shard: _Shard, lengths: range, range_bits: int, pairs: np.ndarray | None) -> Iterator[tuple[int, bytes]]:
    h, word, lang = shard.distinct()
    if not len(h):
        return
    symbols = pa.concat_arrays([word, lang]).unique()
    symbols = symbols.take(pc.array_sort_indices(symbols))
    word_id = pc.index_in(word, symbols).to_numpy(zero_copy_only=False).astype(np.int32)
    lang_id = pc.index_in(lang, symbols).to_numpy(zero_copy_only=False).astype(np.int32)
    order = np.concatenate(shard.order)
    ids = np.where(order > 0, np.searchsorted(h, order), -1)
    good = (ids[:-1] >= 0) & (ids[1:] >= 0)
    if pairs is not None:
        at = np.flatnonzero(good)
        b = bit(pair(order[at], order[at + 1]))
        good[at] = pairs[b >> 3] >> (b & 7) & 1 > 0
    rows, counts = [], []
    for k in lengths:
        m = len(order) - k + 1
        if m <= 0:
            break
        ok = good[:m].copy()
        for j in range(1, k - 1):
            ok &= good[j : j + m]
        at = np.flatnonzero(ok)
        if not len(at):
            break
        # distinct runs of k ids, by ranks of ever longer prefixes
        rank, start = ids[at], at
        for j in range(1, k):
            _, where, rank, n = np.unique(rank << 32 | ids[at + j], return_index=True, return_inverse=True, return_counts=True)
            start = at[where]
        found = np.full((len(start), max(lengths)), A.END, np.int64)
        for j in range(k):
            found[:, j] = ids[start + j]
        rows.append(found)
        counts.append(n)
    if not rows:
        return
    rows, counts = np.concatenate(rows), np.concatenate(counts)
    of = ranges(h[rows[:, 0]], h[rows[:, 1]], range_bits)
    named = np.concatenate([lang_id[rows[:, :1]], np.where(rows >= 0, word_id[rows], A.END)], 1).astype(np.int32)
    by = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], of[by][1:] != of[by][:-1]]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
        own = by[a:b]
        yield int(of[own[0]]), A.build(*A.used(symbols, named[own]), counts[own]).to_bytes()


def _spelled(symbols: pa.Array, rows: np.ndarray) -> list[str]:
    """Keys of phrases: the language, a tab, and the words with a space between (a word has neither)."""
    text = symbols.to_pylist()
    return [f"{text[r[0]]}\t{' '.join([text[i] for i in r[1:]])}" for r in rows.tolist()]


def split(key: str) -> list[str]:
    lang, _, phrase = key.rpartition("\t")
    return [lang, *phrase.split(" ")]


def path_hashes(paths: list[list[str]], most: int = 2) -> list[np.ndarray]:
    """Hashes of the first words of paths (language, words...); all ones where there is none."""
    langs = pa.array([p[0] for p in paths], pa.string())
    of_lang = lang_hashes(langs)
    out = []
    for i in range(1, most + 1):
        data, off = V.text_bytes(pa.array([p[i] if len(p) > i else "" for p in paths], pa.string()))
        h = keyed(V.word_hashes(data, off[:-1], off[1:]), of_lang)
        h[h == 0] = 1
        out.append(h)
    return out


def range_of(paths: list[list[str]], bits: int) -> np.ndarray:
    if not paths:
        return np.empty(0, np.int64)
    one, two = path_hashes(paths)
    return np.where(np.array([len(p) > 2 for p in paths]), ranges(one, two, bits), ranges(one, None, bits))


def _united(least: int):
    """The frequent phrases of a prefix range: key, n, and the pair's place in the map."""

    def run(key, table):
        symbols, found = A.union([A.Automaton.from_bytes(b) for b in table.column("automaton").to_pylist()])
        keys, n, bits = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for rows, counts in found:
            often = counts >= least
            if often.any():
                own = _spelled(symbols, rows[often])
                keys += own
                n.append(counts[often])
                bits.append(bit(pair(*path_hashes([split(k) for k in own]))))
        return pa.table({"range": pa.array(np.full(len(keys), key[0].as_py(), np.int64)), "key": pa.array(keys, pa.string()), "n": np.concatenate(n), "bit": np.concatenate(bits)})

    return run


def _indexed(key, table):
    """The automaton of a range's frequent phrases."""
    paths = [split(k) for k in table.column("key").to_pylist()]
    symbols = pa.array(sorted({w for p in paths for w in p}, key=str.encode), pa.string())
    at = {w: i for i, w in enumerate(symbols.to_pylist())}
    rows = np.full((len(paths), max(map(len, paths))), A.END, np.int32)
    for i, p in enumerate(paths):
        rows[i, : len(p)] = [at[w] for w in p]
    built = A.build(symbols, rows, table.column("n").to_numpy())
    return pa.table({"range": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([built.to_bytes()], pa.binary())})


def _asked(bits: int):
    """Both parts of every cut of each phrase, with the prefix ranges where their counts are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, parts = [], []
            for key, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist()):
                lang, *words = split(key)
                for k in range(1, len(words)):
                    for side, part in ((0, words[:k]), (1, words[k:])):
                        out.append((key, n, len(words), k, side, f"{lang}\t{' '.join(part)}"))
                        parts.append([lang, *part])
            cols = list(zip(*out)) or [()] * 6
            kinds = pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array(range_of(parts, bits))], ["key", "a", "words", "k", "side", "part", "range"])

    return run


def _composed(key, asked, automata):
    """Counts of a range's asked parts, read off its automaton."""
    parts = asked.column("part").to_pylist()
    if not parts or not automata.num_rows:
        f = np.zeros(len(parts), np.int64)
    else:
        f = A.Automaton.from_bytes(automata.column("automaton")[0].as_py()).counts([split(p) for p in parts])
    return pa.table({"part": asked.column("part"), "n": asked.column("n"), "f": pa.array(f)})


def _score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(1000 a n / (l r)), in whole numbers of any size."""
    for b in batches:
        score = [1000 * a * n // (x * y) for a, n, x, y in zip(*(b.column(c).to_pylist() for c in ("a", "total", "l", "r")))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "lang", "k", "a", "l", "r", "total")), pa.array(score, pa.int64())], ["key", "lang", "k", "a", "l", "r", "total", "score"])


def bit_map(spark: SparkSession, places: DataFrame):
    """A broadcast map (bytes) with the bits in column ``bit`` set."""
    rows = places.select((F.col("bit") + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for at, bits in rows:  # 4 KB each, 16 MB at most
        out[at * 4096 - 4096 : at * 4096] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(out)


def count_phrases(spark: SparkSession, s: Scratch, texts: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, int]:
    """Words of each language (lang, total); words and phrases of at most ``longest`` words that occur ``least`` times (range, key, n, longer); range bits."""
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long, h long, bit long").groupBy("lang", "word")
    words = s.save(counted.agg(F.sum("n").alias("n"), F.first("h").alias("h"), F.first("bit").alias("bit")).where(F.col("word").isNull() | (F.col("n") >= least)))
    totals = words.where("word is null").select("lang", F.col("n").alias("total"))
    frequent = words.where("word is not null")
    n = totals.agg(F.sum("total")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, n / RANGE_WORDS)))))
    one, two = (bits + 1) // 2, bits // 2
    first = F.shiftright(F.shiftrightunsigned("h", 64 - one) if one else F.lit(0).cast("long"), 0)
    single = frequent.select(F.shiftleft(first, two).alias("range"), F.concat_ws("\t", "lang", "word").alias("key"), "n", F.lit(False).alias("longer"))
    found, maps = [single], [bit_map(spark, frequent)]
    for lengths in (range(2, 3), range(3, longest + 1)):
        if not len(lengths) or lengths[0] > longest:
            continue
        parts = texts.mapInArrow(_count_phrases(lengths, bits, maps[0], maps[1] if len(maps) > 1 else None), "range long, automaton binary")
        grams = s.save(parts.groupBy("range").applyInArrow(_united(least), "range long, key string, n long, bit long"))
        found.append(grams.select("range", "key", "n", F.lit(True).alias("longer")))
        if lengths[0] == 2 and longest > 2:
            maps.append(bit_map(spark, grams))
    for m in maps:
        m.unpersist()
    out = found[0]
    for t in found[1:]:
        out = out.unionByName(t)
    return totals, out, bits


def mine(spark: SparkSession, docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer one that contains it occurs at least ``cover`` percent as often. That a phrase one word longer is asked
    for is enough: what contains a phrase in a longer one occurs no less often than that.
    """
    prepare(spark)
    s = Scratch(spark)
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    totals, frequent, bits = count_phrases(spark, s, texts, least, longest)
    index = s.save(frequent.select("range", "key", "n").groupBy("range").applyInArrow(_indexed, "range long, automaton binary"))
    phrases = frequent.where("longer").select("key", "n")
    asked = s.save(phrases.mapInArrow(_asked(bits), "key string, a long, words int, k int, side int, part string, range long"))
    once = asked.groupBy("range", "part").agg(F.count("*").alias("n"))
    told = s.save(once.groupBy("range").cogroup(index.groupBy("range")).applyInArrow(_composed, "part string, n long, f long"))
    sides = s.save(spread_join(asked.drop("range"), told, "part"))
    covered = sides.where(f"(side = 0 and k = words - 1 or side = 1 and k = 1) and words > 2 and 100 * a >= {cover} * f").select(F.col("part").alias("key")).distinct()
    cuts = sides.groupBy("key", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    cuts = s.save(cuts.join(covered.hint("merge"), "key", "left_anti").withColumn("lang", F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)")))
    of_lang = cuts.groupBy("lang").agg(F.count("*").alias("n")).join(totals.hint("merge"), "lang")
    scored = spread_join(cuts, s.save(of_lang), "lang").mapInArrow(_score, "key string, lang string, k int, a long, l long, r long, total long, score long")
    lowest = scored.groupBy("key", "lang", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    named = lowest.select("lang", F.substring_index("key", "\t", -1).alias("phrase"), "a", "c.l", "c.r", F.col("total").alias("n"), "c.score")
    # the first of each bucket, then of these: a language's phrases don't meet in one task
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = named.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(TOP_BUCKETS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100) -> str:
    """SQL of ``mine``, with whole numbers of 128 bits."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), spot AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {longest + 1}) r(k) WHERE len(w) >= k
), f AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS p, any_value(w[i : i + k - 1]) AS ws, k AS size, count(*) AS f FROM spot GROUP BY lang, p, k HAVING count(*) >= {least}
), c AS (SELECT * FROM f WHERE size > 1
), gone AS (
  SELECT DISTINCT c.lang AS lang, s.p AS p FROM c JOIN f s ON s.lang = c.lang AND s.size = c.size - 1
    AND (s.p = array_to_string(c.ws[: c.size - 1], ' ') OR s.p = array_to_string(c.ws[2 :], ' ')) WHERE 100 * c.f >= {cover} * s.f
), cut AS (SELECT lang, p, ws, size, f, unnest(range(1, size)) AS k FROM c WHERE NOT EXISTS (FROM gone WHERE gone.lang = c.lang AND gone.p = c.p)
), scored AS (
  SELECT cut.lang AS lang, cut.p AS phrase, cut.f AS a, x.f AS l, y.f AS r, total.n AS n, cut.k AS k, 1000 * cut.f::HUGEINT * total.n // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN total USING (lang) JOIN f x ON x.lang = cut.lang AND x.p = array_to_string(cut.ws[: cut.k], ' ') JOIN f y ON y.lang = cut.lang AND y.p = array_to_string(cut.ws[cut.k + 1 :], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {top}
"""
