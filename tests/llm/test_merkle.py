"""The Merkle manifest against a plain recursion over small tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sitegrain.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, pos int, leaf string, n long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(one(r[0]), one(r[3]), one(r[2]), one(r[4]), one(text))


def climb(nodes, marked):
    """(what remains, siblings in order, a function that folds another digest in) for the node at place ``marked``."""
    steps, i = [], marked
    while len(nodes) > 1:
        runs = [nodes[a : a + 8] for a in range(0, len(nodes), 8)]
        steps.append((runs[i // 8][: i % 8], runs[i // 8][i % 8 + 1 :]))
        nodes, i = [h(*r) for r in runs], i // 8

    def fold(d):
        for a, b in steps:
            d = h(*a, d, *b)
        return d

    return nodes[0], [x for a, b in steps for x in a + b], fold


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for g in langs}
    subs = [climb([leaf(r, r[1]) for r in own[g]], 0)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        root, above, fold_top = climb(subs, k)
        leaves = [leaf(r, r[1]) for r in own[g]]
        for i, r in enumerate(own[g]):
            sub, sides, fold = climb(leaves, i)
            lower = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            claimed = leaf(r, lower) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaves[i]
            got = fold_top(fold(claimed))
            out.append((r[0], leaves[i], sub, root, h(*sides, *above), got, got == root))
    return out


def rows(seed, sizes):
    r = random.Random(seed)
    out = []
    for g, n in sizes.items():
        for _ in range(n):
            i = r.randint(1, 10**6)
            out.append((i, r.choice(["Aé b", "low", None, "", "X" * 3000]), g, r.choice([None, "s"]), r.choice([None, 3]), 5, 6, "clash", 7))
    return out + out[:5] + [(None, "A", "en", None, None, 1, 1, "x", 1)] * 2


@pytest.mark.parametrize("sizes", [{"en": 700, "de": 64, None: 9, "": 1, "fr": 8}, {f"l{i}": 1 + i % 3 for i in range(75)}, {"en": 1}])
def test_proofs_equal_recursion(spark, sizes):
    given = rows(3, sizes)
    got = merkle.verify_documents(spark, spark.createDataFrame(given, SCHEMA).repartition(5), block_levels=2).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(given), key=key)


def test_empty_table(spark):
    assert merkle.verify_documents(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_and_lone_leaf(spark):
    given = [(3, "Ab " * 2_000_000, "en", "s", 1, 0, 0, "", 0)]
    got = merkle.verify_documents(spark, spark.createDataFrame(given, SCHEMA)).collect()
    assert [tuple(r) for r in got] == brute(given) and got[0].root == got[0].leaf


def test_proofs_of_some_fetch_what_is_missing(spark):
    given = [(i, f"T{i}", "en" if i % 4 else "de", "s", i, 0, 0, "", 0) for i in range(1, 200)]
    docs = spark.createDataFrame(given, SCHEMA)
    m = merkle.build(spark, docs, merkle.leaf_hash(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))))
    some = spark.createDataFrame([(5,), (6,), (100,), (999,)], "x long")
    got = m.proofs(some).select("id", merkle.proof_digest(F.col("proof")).alias("p"), merkle.folded(F.col("leaf"), F.col("proof")).alias("f"), "root").collect()
    want = {r[0]: r for r in brute(given)}
    assert sorted(r.id for r in got) == [5, 6, 100]
    assert all(r.p == want[r.id][4] and r.f == r.root == want[r.id][3] for r in got)


def test_missing_is_least():
    n = 300
    for seed in range(20):
        r = random.Random(seed)
        known = r.sample(range(n), r.randint(1, 40))
        need = merkle.missing(known, n)
        leaves = {i: str(i) for i in range(n)}
        full, root = merkle.derive(leaves, {}, n)
        at = {(level, q * 8 + i): d for level, runs in enumerate(full) for q, ds in runs.items() for i, d in enumerate(ds)}
        levels, got = merkle.derive({k: str(k) for k in known}, {x: at[x] for x in need}, n)
        assert got == root and all(merkle.path(levels, k) == merkle.path(full, k) for k in known)
        with pytest.raises(KeyError):  # none can be left out
            merkle.derive({k: str(k) for k in known}, {x: at[x] for x in need[1:]}, n) if need else {}[0]
