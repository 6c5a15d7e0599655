"""The toxicity lexicon: folding, matching against brute force, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrain.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, entry string"
PLAIN = ["stone", "river", "walk", "green", "light", "paper", "idle", "stump", "was", "the", "of", "table", "cloud"]
BAD = ["grobnik", "zantle", "flurbish"]


def prose(r, n, bad=0):
    words = [r.choice(PLAIN) for _ in range(n)]
    for _ in range(bad):
        words[r.randrange(n)] = r.choice(BAD) + r.choice(["", "", "s", "en"])
    return " ".join(words)


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("You 1d10t! i.d.i.o.t", ["you", "idiot", "idiot"]), ("$tup!d L0SER", ["stupid", "ioser"]), ("стyпid", ["ctyпid"]), ("ｉｄｉｏｔ", ["idiot"]), ("100 miles", ["100", "miies"]),
        (None, []), ("", []), (" \n", []), ("wow!! 5 cum|", ["wow", "5", "cum"]), ("a-b", ["a", "b"]), ("É é", ["é", "é"]),
    ],
)
def test_folding(text, words):
    assert T.folded(text) == words


def brute(words, entries, phrases):
    """Places and entries by looking at every word and phrase."""
    shut = {i + j for p in map(T.folded, phrases) for i in range(len(words)) if words[i : i + len(p)] == p for j in range(len(p))}
    out = {}
    for i, w in enumerate(words):
        own = [k for k, e in enumerate(entries) if (w + " ").startswith(e)]
        if own and i not in shut:
            out[i] = own
    return out


def test_matches_equal_brute_force():
    for seed in range(50):
        r = random.Random(seed)
        pick = lambda n: "".join(r.choice("ab") for _ in range(n))
        words = [pick(r.randint(1, 5)) for _ in range(60)]
        entries = sorted({pick(r.randint(1, 3)) + r.choice(["", " "]) for _ in range(6)})
        phrases = [f"{pick(2)} {pick(2)}", pick(1)]
        got = T.Matcher(entries, phrases).matches(words)
        assert {k: sorted(v) for k, v in got.items()} == brute(words, entries, phrases), seed


def test_held_out_accuracy_and_exceptions(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1, 801):
        toxic = i % 4 == 0
        text = prose(r, r.randint(30, 120), 3 if toxic else 0)
        if not toxic and i % 37 == 0:
            text += " a zantle engine"  # meant otherwise
        rows.append((i, text, "en", "s", len(text), 9, "clash"))
        labels.append((i, int(toxic)))
    rows += [(900 + i, rows[3][1], "en", "s", 1, 9, "") for i in range(40)]
    labels += [(900 + i, 1) for i in range(40)]
    docs, given = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in T.score_documents(spark, docs, given).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.99
    model = T.fit(spark, docs.select(F.col("doc_id").alias("id"), "text"), given.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    assert "zantie engine" in model["phrases"] and "grobnik " in model["entries"]
    # a copied document is one: what stands in it alone is no entry
    near = T.Matcher(model["entries"], ())
    assert all(e.strip()[:3] in {"gro", "zan", "fiu"} for e in model["entries"]) and not near.matches(["stone"])
    # hidden forms of entries count, in long texts less
    more = spark.createDataFrame([(1, "you gr0bn!k", "", "", 1, 1, ""), (2, prose(r, 30000) + " grobnik", "", "", 1, 1, ""), (3, "stone " * 40, "", "", 1, 1, "")], SCHEMA)
    a, b, c = (x.score for x in T.score_documents(spark, docs.limit(0).unionByName(more).unionByName(docs), given).orderBy(F.col("n_words") != 2, F.desc("n_words")).where("doc_id < 4 and (n_words in (2, 30001) or n_words = 40)").collect()[:3])
    assert a > b > c


def test_edges(spark):
    rows = [(1, None, "en", "s", 0, 0, ""), (2, "", None, None, None, None, None), (3, " \n", "", "", 0, 0, ""), (None, "word", "", "", 0, 0, ""), (4, "x" * 3_000_000, "", "", 0, 0, ""), (5, "w", "", "", 0, 0, ""), (5, "w", "", "", 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.score_documents(spark, docs, none).collect()
    assert len(got) == 7 and all(x.score == 0 and x.predicted == 0 for x in got) and [x.held_out for x in got if x.doc_id is None] == [False]
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 0), (3, 7)], "doc_id long, toxic int")
    assert {x.score for x in T.score_documents(spark, docs, odd).collect()} <= {0.5, 1.0}
    assert T.score_documents(spark, docs.limit(0), odd).collect() == []


def test_hot_id(spark):
    """One id of many different texts is learned from once."""
    r = random.Random(4)
    docs = spark.createDataFrame([(1, f"w{i} grobnik", "", "", 0, 0, "") for i in range(300)] + [(i, prose(r, 20), "", "", 0, 0, "") for i in range(2, 60)], SCHEMA)
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)], "id long, label int")
    model = T.fit(spark, docs.select(F.col("doc_id").alias("id"), "text"), labels)
    assert model["entries"] == []
