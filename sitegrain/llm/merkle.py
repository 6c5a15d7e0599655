"""Merkle manifest of a table: one tree a language, one over the languages, and a proof for each document.

A row's leaf is the hash of its values. Per language, leaves in order of their id are hashed in runs of FANOUT, level by level, to
a subroot; subroots in order of language are hashed to the root in the same way. Proofs come as an octopus multiproof: a block of
consecutive leaves names the smallest set of nodes that it can't derive from its own leaves, these are fetched once for the
whole block, the nodes between are derived once, and each leaf's own path is read off them.

Rows without id come first in their language, ids alike are ordered by their leaves, and rows alike in everything are leaves of
their own. A null language is a tree of its own and comes first. An empty table has no leaves and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegrain.llm.scratch import Scratch, prepare, sized, spread_join

#: Children of a node; levels of a block of leaves (FANOUT ** BLOCK_LEVELS of them), the unit of work.
FANOUT, BLOCK_LEVELS = 8, 4
#: The tree over the subroots; the others are numbered from 0 in order of language.
TOP = -1
NODE = "tree long, level int, pos long, digest string"
STEP = "array<struct<before string, after string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(*columns: Column) -> Column:
    """The columns' values one after another, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.concat(*(one(c) for c in columns))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(framed(*columns), 256)


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of ``n`` leaves, down to the one that remains."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def missing(known: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The fewest (level, place) of nodes that, with the leaves at ``known``, give every path of these leaves."""
    out, own = [], sorted(set(known))
    for level, size in enumerate(sizes(n)[:-1]):
        here, runs = set(own), sorted({p // FANOUT for p in own})
        out += [(level, q) for r in runs for q in range(r * FANOUT, min((r + 1) * FANOUT, size)) if q not in here]
        own = runs
    return out


def derive(known: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> tuple[list[dict[int, list[str]]], str]:
    """For each level, the digests of every run that the paths touch; and what remains at the top."""
    levels = []
    for level, size in enumerate(sizes(n)[:-1]):
        runs = {}
        for r in {p // FANOUT for p in known}:
            runs[r] = [known[q] if q in known else fetched[level, q] for q in range(r * FANOUT, min((r + 1) * FANOUT, size))]
        levels.append(runs)
        known = {r: digest_of(d) for r, d in runs.items()}
    return levels, known[0]


def path(levels: list[dict[int, list[str]]], pos: int, start: int = 0) -> list[tuple[str, str]]:
    """What stands before and after the node of each level on the way up from ``pos`` of level ``start``."""
    out = []
    for runs in levels[start:]:
        pos, i = divmod(pos, FANOUT)
        out.append(("".join(runs[pos][:i]), "".join(runs[pos][i + 1 :])))
    return out


def folded(leaf: Column, proof: Column) -> Column:
    """Column: the root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, step: F.sha2(F.concat(step["before"], d, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Column: the hash of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _block_nodes(block_levels: int):
    """Nodes above the leaves of one block, up to its own or, in a tree of one block, to the subroot."""

    def run(key, leaves):
        tree, block = (k.as_py() for k in key)
        order = leaves.sort_by("pos")
        own, n = order.column("leaf").to_pylist(), order.column("n")[0].as_py()
        rows, first = [(0, 0, own[0], True)] if n == 1 else [], block * FANOUT**block_levels
        for level, size in enumerate(sizes(n)[1 : block_levels + 1], 1):
            own = [digest_of(own[i : i + FANOUT]) for i in range(0, len(own), FANOUT)]
            first //= FANOUT
            rows += [(level, first + i, d, size == 1 or level == block_levels) for i, d in enumerate(own)]
        level, pos, digest, last = zip(*rows)
        const = lambda x: pa.array([x] * len(rows), pa.int64())
        return pa.table({"tree": const(tree), "level": pa.array(level, pa.int32()), "pos": pa.array(pos, pa.int64()), "digest": digest, "last": last, "n": const(n)})

    return run


def _coordinates(trees: int):
    """Of each block (tree, block, n, places): the nodes that it must fetch, of its own tree and of the one on top."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                out += [(r["tree"], r["block"], r["tree"], level, pos) for level, pos in missing(r["places"], r["n"])]
                out += [(r["tree"], r["block"], TOP, level, pos) for level, pos in missing([r["tree"]], trees)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["tree", "block", "of", "level", "pos"])

    return run


def _expand(trees: int):
    """Paths of a block's leaves, from its leaves and what was fetched for it."""

    def run(key, leaves, got):
        tree = key[0].as_py()
        places, digests = leaves.column("pos").to_pylist(), leaves.column("leaf").to_pylist()
        own, top = {}, {}
        for of, level, pos, d in zip(*(got.column(c).to_pylist() for c in ("of", "level", "pos", "digest"))):
            (top if of == TOP else own)[level, pos] = d
        levels, subroot = derive(dict(zip(places, digests)), own, leaves.column("n")[0].as_py() if places else 0) if places else ([], "")
        above, root = derive({tree: subroot}, top, trees)
        last = path(above, tree)
        shared: dict[int, list[tuple[str, str]]] = {}
        before, after, ends = [], [], [0]
        for p in places:
            if levels:
                run = p // FANOUT
                if run not in shared:
                    shared[run] = path(levels, run, 1) + last
                steps = path(levels[:1], p) + shared[run]
            else:
                steps = last
            before += [x for x, _ in steps]
            after += [x for _, x in steps]
            ends.append(len(before))
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
        n = len(places)
        return pa.table({"id": leaves.column("id"), "lang": leaves.column("lang"), "leaf": leaves.column("leaf"), "carried": leaves.column("carried"), "subroot": [subroot] * n, "root": [root] * n, "proof": proof})

    return run


@dataclass
class Manifest:
    """``leaves``: id, lang, leaf, carried, tree, n, pos, block. ``nodes``: tree, level (leaves: 0, only of trees of one leaf and of TOP), pos, digest."""

    spark: SparkSession
    scratch: Scratch
    leaves: DataFrame
    nodes: DataFrame
    trees: int

    def proofs(self, ids: DataFrame | None = None) -> DataFrame:
        """Proofs of all rows, or of the rows whose id is in ``ids`` (one column): id, lang, leaf, carried, subroot, root, proof.

        ``proof`` has a step for each level from the leaf up, with the digests before and after the node.
        """
        wanted = self.leaves
        nodes = self.nodes
        if ids is not None:
            wanted = self.scratch.save(wanted.join(ids.toDF("id").distinct().hint("merge"), "id", "left_semi"))
            level0 = self.leaves.where("n > 1").select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"))
            nodes = nodes.unionByName(level0)
        blocks = wanted.groupBy("tree", "block", "n").agg(F.collect_set("pos").alias("places"))
        asked = self.scratch.save(blocks.mapInArrow(_coordinates(self.trees), "tree long, block long, of long, level int, pos long"))
        got = _looked_up(self.scratch, asked, nodes.withColumnRenamed("tree", "of"))
        pairs = wanted.groupBy("tree", "block").cogroup(got.groupBy("tree", "block"))
        kind = dict(self.leaves.dtypes)["carried"]
        return pairs.applyInArrow(_expand(self.trees), f"id long, lang string, leaf string, carried {kind}, subroot string, root string, proof {STEP}")


def _looked_up(s: Scratch, asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked`` with digests. All blocks may ask for the nodes near the top: each is asked for once, and told to many by salted joins."""
    at = ["of", "level", "pos"]
    asked = asked.withColumn("key", F.concat_ws(":", *at))
    once = asked.groupBy("key", *at).agg(F.count("*").alias("n")).join(nodes.hint("merge"), at)
    return s.save(spread_join(asked, s.save(once.select("key", "digest", "n")), "key").drop("key"))


def _raise(s: Scratch, level: DataFrame, top: int, most: int) -> list[DataFrame]:
    """Tables of the levels above ``level`` (tree, level, pos, digest, n), for trees of at most ``most`` leaves."""
    out = []
    for k in range(top, len(sizes(most)) - 1):
        children = F.sort_array(F.collect_list(F.struct("pos", "digest")))
        up = level.where(F.col("n") > FANOUT**k).withColumn("pos_", F.expr(f"pos div {FANOUT}")).groupBy("tree", "n", "pos_").agg(children.alias("c"))
        level = s.save(up.select("tree", F.lit(k + 1).alias("level"), F.col("pos_").alias("pos"), F.sha2(F.array_join(F.col("c.digest"), ""), 256).alias("digest"), "n"))
        out.append(level)
    return out


def build(spark: SparkSession, docs: DataFrame, leaf: Column, id_col: str = "doc_id", lang_col: str = "lang", carry: Column | None = None, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The trees over the rows of ``docs``; ``carry`` (any column) comes along with each row."""
    prepare(spark)
    s = Scratch(spark)
    carried = (F.lit(None).cast("string") if carry is None else carry).alias("carried")
    rows = s.save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), leaf.alias("leaf"), carried).withColumn("row", F.monotonically_increasing_id()))
    # numbered in range partitions; equal rows are told apart, so that many of one id don't meet in one of them
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("row")]
    ranged = s.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()))
    s.drop(rows)
    part = F.shiftright("at", 33).alias("part")
    pieces = s.save(ranged.groupBy("lang", part).agg(F.count("*").alias("size"), F.min("at").alias("first")))
    langs = s.save(pieces.groupBy("lang").agg(F.sum("size").alias("n")))
    ranked = langs.repartitionByRange(F.asc_nulls_first("lang")).sortWithinPartitions(F.asc_nulls_first("lang")).withColumn("at", F.monotonically_increasing_id())
    ranked = s.save(ranked)
    heads = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("size")).selectExpr("part as p", "sum(size) over (order by part) - size as ahead")  # one row a partition
    trees = s.save(ranked.join(F.broadcast(heads), F.shiftright("at", 33) == F.col("p")).selectExpr("lang as tree_lang", "(at & ((1L << 33) - 1)) + ahead as tree", "n"))
    count, most = trees.agg(F.count("*"), F.max("n")).first()
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("part")) - F.col("size")
    offsets = pieces.withColumn("ahead", before).join(sized(trees), F.col("lang").eqNullSafe(F.col("tree_lang")))
    offsets = s.save(offsets.select(F.col("lang").alias("own_lang"), F.col("part").alias("own_part"), "first", "ahead", "tree", "n"))
    of_piece = F.col("lang").eqNullSafe(F.col("own_lang")) & (F.shiftright("at", 33) == F.col("own_part"))
    pos = (F.col("at") - F.col("first") + F.col("ahead")).alias("pos")
    leaves = ranged.join(sized(offsets), of_piece).select("id", "lang", "leaf", "carried", "tree", "n", pos).withColumn("block", F.expr(f"pos div {FANOUT**block_levels}"))
    leaves = s.save(leaves)
    s.drop(ranged, pieces, langs, ranked)

    inner = s.save(leaves.select("tree", "block", "n", "pos", "leaf").groupBy("tree", "block").applyInArrow(_block_nodes(block_levels), f"{NODE}, last boolean, n long"))
    higher = _raise(s, inner.where("last").drop("last").where(F.col("level") == block_levels), block_levels, most or 0)
    every = [inner.select("tree", "level", "pos", "digest", "n"), *higher]
    subroots = every[0]
    for t in every[1:]:
        subroots = subroots.unionByName(t)
    subroots = s.save(subroots.where(F.expr(f"n <= power({FANOUT}D, level) and (level = 0 or n > power({FANOUT}D, level - 1))")).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), "digest", F.lit(count).cast("long").alias("n")))
    nodes = None
    for t in [*every, subroots, *_raise(s, subroots, 0, count)]:
        t = t.select("tree", "level", "pos", "digest")
        nodes = t if nodes is None else nodes.unionByName(t)
    return Manifest(spark, s, leaves, nodes, count)


def crc_third(id_col: str) -> Column:
    """Whether 3 divides the crc32 of an id's decimal text; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def verify_documents(spark: SparkSession, docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Proofs of all documents, each verified against its text or, where ``crc_third`` holds, against the text with A-Z lower-cased."""
    of = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    claimed = F.when(crc_third("doc_id"), of(F.translate("text", UPPER, LOWER)))
    found = build(spark, docs, of(F.col("text")), carry=claimed, block_levels=block_levels).proofs()
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.coalesce("carried", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(depth: int = 8) -> str:
    """SQL of ``verify_documents`` for trees of at most FANOUT ** depth leaves."""
    frame = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ctes = [
        "bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8)",
        "crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)",
        f"leaf0 AS (SELECT doc_id, lang, {frame('text')} AS leaf, CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),"
        f" lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 THEN {frame(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claimed FROM documents, crc)",
        "p0 AS (SELECT row_number() OVER () AS id, doc_id, leaf, coalesce(claimed, leaf) AS fold, '' AS proof, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf0)",
        "l0 AS (SELECT g, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM p0)",
    ]
    at, node = 0, "l0"

    def climb() -> None:
        nonlocal at, node
        for _ in range(depth):
            ctes.append(f"r{at} AS (SELECT g, pos // {FANOUT} AS run, list(d ORDER BY pos) AS ds, any_value(n) AS n FROM {node} GROUP BY g, pos // {FANOUT})")
            ctes.append(f"l{at + 1} AS (SELECT g, run AS pos, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, (n + {FANOUT - 1}) // {FANOUT} AS n FROM r{at})")
            sides = f"array_to_string(ds[: pos % {FANOUT}], '')", f"array_to_string(ds[pos % {FANOUT} + 2 :], '')"
            ctes.append(
                f"p{at + 1} AS (SELECT id, doc_id, leaf, CASE WHEN n = 1 THEN fold ELSE sha256({sides[0]} || fold || {sides[1]}) END AS fold,"
                f" CASE WHEN n = 1 THEN proof ELSE proof || {sides[0]} || {sides[1]} END AS proof, p.g AS g, run AS pos{', subroot' * (node != 'l0' and at >= depth + 1)} FROM p{at} p JOIN r{at} r ON p.g = r.g AND p.pos // {FANOUT} = r.run)"
            )
            at, node = at + 1, f"l{at + 1}"

    climb()
    ctes.append(f"p{at + 1} AS (SELECT id, doc_id, leaf, fold, proof, d AS subroot, 0 AS g, p.g AS pos FROM p{at} p JOIN {node} t ON p.g = t.g)")
    ctes.append(f"l{at + 1} AS (SELECT 0 AS g, g AS pos, d, count(*) OVER () AS n FROM {node})")
    at, node = at + 1, f"l{at + 1}"
    climb()
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM p{at}, {node}"
