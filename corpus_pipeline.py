"""The corpus pipeline: language, near copies, benchmark leaks, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns they had;
the last one returns the mix's accounts. The stages that compare documents judge every row by a
key of its own, so rows with a null or repeated doc_id are judged like others. Columns beyond those of
``documents`` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.llm import decontaminate, language, mixing, ngram_join, secret_scan
from tallyrack.llm.common import table, written
from tallyrack.llm.queries import fold


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no language: without a letter, or coded no shorter than random bytes by every language."""
    learn = docs.filter(F.col("doc_id").isNotNull() & F.coalesce(fold(4) != 2, F.lit(True)))
    model = language.train(learn)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    known = language.identify(rows, model, ["doc"])
    if model is None:  # nothing to tell languages by
        return docs.filter(language.has_letter(F.col("text")))
    return known.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") < 8)).select("doc.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): every row with a key of its own as doc_id, written so that it never changes."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return written(docs.select(F.monotonically_increasing_id().alias("doc_id"), row)).select("doc_id", F.col("doc.text").alias("text"), "doc")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep one row, the smallest doc_id (nulls last). Texts without a word are copies of nothing."""
    rows = _keyed(docs)
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), F.col("doc_id").alias("key")).alias("place")
    # written, as are the few groups of more than one row: a join with a written table can be split where a group is large
    placed = written(ngram_join.ngram_join(rows.select("doc_id", "text")).select("doc_id", "group_id").join(rows.select("doc_id", order), "doc_id"))
    groups = placed.groupBy("group_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = placed.join(written(groups.select("group_id", "first.key")), "group_id").filter("doc_id <> key").select("doc_id")
    return rows.join(gone, "doc_id", "left_anti").select("doc.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or an edited copy of one."""
    rows = _keyed(docs)
    gone = decontaminate.matches(rows.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return rows.join(gone, "doc_id", "left_anti").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark; all documents stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")
    found = secret_scan.scan(rows, secret_scan.train(docs)).withColumn("clean", secret_scan.redact(F.col("text"), F.col("spans")))
    hit = F.size("spans") > 0
    new = {"text": F.col("clean"), "n_chars": F.when(hit, F.length("clean")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return found.select(*[(new[c].cast(kinds[c]) if new.get(c) is not None else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources by weight takes from each document."""
    return mixing.mix_sources(docs)[1]


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: Code lengths, alignments and random draws are beyond SQL; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
