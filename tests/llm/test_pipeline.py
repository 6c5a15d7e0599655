"""The pipeline on a small table: each stage's decision takes effect, clean documents stay."""

import corpus_pipeline
from tests.llm.test_operators import prose
from sitegrain.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    passage = prose(40, 5000)
    docs = [(i, prose(90, 3000 + i), "en", f"s{i % 2}", 1) for i in range(200)]
    docs += [(300, docs[0][1], "en", "s0", 1), (301, docs[1][1] + " extra", "en", "s0", 1), (2, docs[2][1], "en", "s0", 1), (302, prose(50, 7000) + " " + passage, "en", "s1", 1)]
    docs += [(303, prose(60, 7001) + ' password = "abcdefgh12"', "en", "s1", 1), (304, "short", "en", "s1", 1), (305, None, None, None, None), (None, prose(70, 7002), "en", "s0", 1), (306, " ".join(w + "$$$" for w in prose(80, 7003).split()), "en", "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted([r.doc_id for r in now.select("doc_id").collect()], key=str) if k < 4 else None)
    clean = [*range(200), 303, None]
    assert sorted(kept[0], key=str) == sorted([*clean, 2, 300, 301, 302], key=str)
    assert kept[1] == sorted([*clean, 302], key=str) and kept[2] == kept[3] == sorted(clean, key=str)
    text = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 303").first()
    assert text.text.endswith("[assign]\"") and text.n_chars == len(text.text)
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == set(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count() and tokenizer_path()


def test_stages_keep_clashing_columns_and_different_texts_of_one_id(spark, tmp_path):
    odd = ["id", "row", "_id", "_hash", "_spans", "found", "several", "own", "a.b"]
    rows = [(1, prose(90, 8001)), (1, prose(90, 8002)), (2, prose(90, 8003)), (1, prose(90, 8001)), (None, prose(90, 8004)), (None, prose(90, 8004)), (3, prose(90, 8002) + " more"), (4, prose(60, 8005) + " token = abcdefgh12")]
    rows += [(100 + i, prose(90, 8100 + i)) for i in range(80)]
    columns = ", ".join(["doc_id long", "text string", "lang string", "source string", *(f"`{c}` string" for c in odd)])
    docs = spark.createDataFrame([(*r, "en", "s", *odd) for r in rows], columns)
    spark.createDataFrame([(1, prose(30, 9999))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), columns)
        assert all(tuple(r)[4:] == tuple(odd) for r in docs.collect())
    left = docs.collect()
    few = [(r.doc_id, r.text[:8]) for r in left if r.doc_id is None or r.doc_id < 4]
    assert sorted(few, key=str) == sorted([(1, prose(90, 8001)[:8]), (1, prose(90, 8002)[:8]), (2, prose(90, 8003)[:8]), (None, prose(90, 8004)[:8])], key=str)
    assert len(left) == 85 and [r.text.split(" ")[-1] for r in left if r.doc_id == 4] == ["[assign]"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
