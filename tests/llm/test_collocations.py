"""Collocations against brute force, and count automata against counters."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sitegrain.llm import collocations
from sitegrain.llm import count_automaton as A

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, n long, word string, range long"


def brute(rows, least, longest, top, cover):
    f, total, cand = collections.Counter(), collections.Counter(), []
    for _, text, lang, *_ in rows:
        g = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            w = tuple(x for x in re.split("[ \t]", piece) if x)
            total[g] += len(w)
            f.update((g, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = [p for p in f if len(p) > 2 and f[p] >= least]
    gone = {q for p in cand for size in range(2, len(p) - 1) for i in range(1, len(p) - size + 1) if 100 * f[p] >= cover * f[q := (p[0], *p[i : i + size])]}
    out = collections.defaultdict(list)
    for p in cand:
        if p not in gone:
            a, n, cuts = f[p], total[p[0]], []
            for k in range(2, len(p)):
                left, right = f[p[:k]], f[(p[0], *p[k:])]
                cuts.append((1000 * a * n // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right, n))
    rows = []
    for g, found in out.items():
        for i, (score, a, phrase, left, right, n) in enumerate(sorted(found)[:top], 1):
            rows.append((g, i, phrase.decode(), -a, left, right, n, -score))
    return sorted(rows)


def sentence(r):
    words = ["the", "of", "and", "É", "é", "x\x00y", "new", "york", "city", "The", "\x1f"]
    return "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " "]) for _ in range(r.randint(0, 60)))


@pytest.mark.parametrize(("least", "longest", "top", "cover"), [(2, 5, 2000, 100), (3, 3, 7, 60), (2, 2, 5, 100)])
def test_equals_brute_force(spark, least, longest, top, cover):
    r = random.Random(5)
    rows = [(i, sentence(r), r.choice(["en", "de", "und", None, "a b"]), "s", 1, "k", 2, 3, "w", 4) for i in range(60)]
    rows += [(1, None, "en", None, None, "k", 1, 1, "w", 1), (2, "", None, None, None, None, None, None, None, None), (3, " \n", "xx", "s", 0, "", 0, 0, "", 0)]
    rows += [(7, "one long passage that is copied", "en", "s", 1, "", 0, 0, "", 0)] * 9
    rows.append((8, "new york city " * 20000, "de", "s", 1, "", 0, 0, "", 0))
    got = collocations.mine(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), least, longest, top, cover).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, least, longest, top, cover)


def test_empty_table(spark):
    assert collocations.mine(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_shards_and_ranges_do_not_matter(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, sentence(r), "en", "s", 1, "", 0, 0, "", 0) for i in range(40)]
    monkeypatch.setattr(collocations, "RANGE_WORDS", 20)  # read on the driver
    got = collocations.mine(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), 2).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 2, 5, 2000, 100)


def test_automata():
    for seed in range(40):
        r = random.Random(seed)
        words = ["a", "b", "é", "zz", "", "q"]

        def counted(r=r, words=words):
            c = collections.Counter(tuple(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 80)))
            symbols = sorted({w for s in c for w in s}, key=str.encode)
            rows = np.full((len(c), 4), A.END, np.int32)
            for i, s in enumerate(c):
                rows[i, : len(s)] = [symbols.index(w) for w in s]
            return c, A.Automaton.from_bytes(A.build(pa.array(symbols, pa.string()), rows, np.array(list(c.values()), np.int64)).to_bytes())

        made = [counted() for _ in range(3)]
        for c, a in made:
            got = {tuple(a.symbols[int(i)].as_py() for i in x): int(y) for m, w in a.sequences() for x, y in zip(m, w)}
            asked = [*map(list, c), ["a"], ["b"] * 4, ["nope"], ["a", "nope"], ["a"] * 5]
            assert got == dict(c) and a.counts(asked).tolist() == [c.get(tuple(x), 0) for x in asked]
        symbols, rows = A.union([a for _, a in made])
        got = {tuple(symbols[int(i)].as_py() for i in x): int(y) for m, w in rows for x, y in zip(m, w)}
        assert got == dict(sum((c for c, _ in made), collections.Counter()))


def test_equal_states_are_shared():
    rows = np.array([[i, j, k] for i in range(5) for j in range(5) for k in range(5)], np.int32)
    a = A.build(pa.array(list("abcde")), rows, np.full(125, 3, np.int64))
    assert len(a.first) - 1 == 4 and len(a.label) == 15
