"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``docs``, whatever their names: inside, rows are
(id, text, row), with the row's columns in one struct.

Defined results: a decision on a row follows from its own id and text. Null and empty texts are judged as the operators do: the quality rules
reject them. Rows with one id and different texts are documents of their own; rows that share id and text are repeated, and
of these the near-duplicate stage keeps one. Null ids are carried. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import decontaminate, near_dedup, packing, quality_rules, secret_scan
from sitegrain.llm.queries import tokenizer_path
from sitegrain.llm.scratch import Scratch, sized


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _rows(docs: DataFrame, *less: str) -> DataFrame:
    """(id, text, row) of ``docs``; the row without the columns ``less``."""
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"), F.struct(*[_named(c) for c in docs.columns if c not in less]).alias("row"))


def _without(scratch: Scratch, docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows with a (doc_id, text_hash) of ``rejected``; null ids compare as equal."""
    rejected = sized(scratch.save(rejected.select(F.col("doc_id").alias("rejected_id"), F.col("text_hash").alias("rejected_text")).distinct()))
    same = F.col("id").eqNullSafe(F.col("rejected_id")) & (F.xxhash64("text") == F.col("rejected_text"))
    return _rows(docs).join(rejected, same, "left_anti").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _without(Scratch(spark), docs, quality_rules.judge(spark, docs).where("not kept"))


def _own_id() -> Column:
    """A document's id; where it is null or has several texts, a negative one that its text makes."""
    of_text = -1 - F.shiftrightunsigned(F.xxhash64(F.col("id"), F.col("text"), F.lit("own")), 1)
    return F.when(F.col("id").isNull() | F.col("several"), of_text).otherwise(F.col("id").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id (those of ``_own_id`` come first), once."""
    s = Scratch(spark)
    rows = _rows(docs)
    texts = rows.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = sized(s.save(texts.where("a != b").select("id", F.lit(True).alias("several"))))
    own = rows.join(several, "id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    own = own.select(_own_id().alias("own"), "text", "row")
    groups = s.save(near_dedup.near_duplicates(spark, own, id_col="own"))
    copies = sized(s.save(groups.where("not kept").select(F.col("doc_id").alias("own")).distinct()))
    left = own.join(copies, "own", "left_anti")
    repeated = sized(s.save(groups.where("kept").groupBy(F.col("doc_id").alias("own")).count().where("count > 1").select("own")))
    # of rows that share id and text, the one that is smallest as text
    once = left.join(repeated, "own", "left_semi").groupBy("own").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(repeated, "own", "left_anti").select("row").unionByName(once.select("row")).select("row.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.find_windows(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(Scratch(spark), docs, found.where("contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; ``n_chars`` follows the text."""
    found = secret_scan.scan_documents(spark, _rows(docs, "text"), spans_col="found")
    clean = found.select("row", secret_scan.redacted(F.col("text"), F.col("found")).alias("text"), (F.size("found") > 0).alias("some"))
    out = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("some"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return clean.select(*[out[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token windows that hold all documents."""
    return packing.pack_documents(spark, docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scans", secrets),
    ("packing", pack),
]

#: The robust estimates and tokens of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    s = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = s.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
