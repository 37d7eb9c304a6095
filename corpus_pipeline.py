"""The corpus pipeline: from documents to token ids, each stage by one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents`` (the last one
more), and is written before the next reads it. Null and empty texts have no language and go in
the first stage. Further columns of ``docs`` are handed on. An empty table gives an empty one. Texts
of any length are worked on whole, one in a task at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import bpe, langid, leaks, neardup, secrets
from passagemill.llm.common import Scratch
from passagemill.llm.queries import BYTE_BPE


def _rest(docs: DataFrame) -> Column:
    """All columns but the text, which crosses to Python once and on its own."""
    return F.struct(*(c for c in docs.columns if c != "text")).alias("document")


def _whole(docs: DataFrame) -> list[Column]:
    return [F.col("text") if c == "text" else F.col(f"document.{c}").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown or not clear go. Labels keep their column."""
    learned = langid.fit(docs.select("text", "lang"))
    guessed = langid.predict(docs.select("text", _rest(docs)), learned, ("text", "document"))
    return guessed.filter("accepted").select(*_whole(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies stays; rows that repeat id and text are one.

    Another text under the id of a document that stays is kept too. Rows without id are in no group
    and stay.
    """
    groups = neardup.near_duplicates(docs.select("doc_id", "text"))
    kept = groups.filter("kept and doc_id is not null").select("doc_id")
    content = max(docs.columns, key=len) + "_"  # a name that no column has
    named = docs.join(kept, "doc_id", "left_semi").withColumn(content, F.sha2("text", 256))
    named = named.dropDuplicates(["doc_id", content])
    return named.select(docs.columns).union(docs.filter("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = docs.select("text", F.col("doc_id"), _rest(docs))
    found = leaks.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("document",))
    return found.filter(F.size("hit_words") == 0).select(*_whole(docs))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, ``n_chars`` follows the text."""
    rows = docs.select("text", F.struct(*docs.columns).alias("document"))
    found = secrets.find_secrets(rows)
    text = F.when(F.col("document.text").isNotNull(), secrets.masked("text", "secrets"))
    found = found.withColumn("masked", text)
    changed = {
        "text": F.col("masked"),
        "n_chars": F.when(F.size("secrets") > 0, F.length("masked").cast("long")).otherwise(F.col("document.n_chars")),
    }
    return found.select(*(changed.get(c, F.col(f"document.{c}")).alias(c) for c in docs.columns))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit integers), after a check round."""
    coded = bpe.encode_checked(docs.select("text", _rest(docs)), BYTE_BPE, keep=("text", "document"))
    return coded.select(*_whole(docs), "n_tokens", "ids", "round_trip")


STAGES = [
    ("language ID", language),
    ("near-dedup", one_of_each),
    ("decontamination", decontaminated),
    ("secret scans", masked),
    ("BPE", tokenised),
]

#: SQL has no compressors, MinHash or BPE; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{number}")
        if number > 1:
            scratch.drop(f"stage-{number - 1}")
    return docs
