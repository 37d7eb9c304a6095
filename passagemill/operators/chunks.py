"""From raw text to numbered chunks, and chunk lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import (
    MIN_SIZE,
    TARGET_SIZE,
    chunk_fixed,
    chunk_sentences,
    is_blank,
    split_sentences,
)

# The two chunking rules: how a joining space counts, and what becomes of text
# without a sentence.
RULES = {
    "batch": {"separator": 0, "no_sentence": "drop"},
    "actor": {"separator": 1, "no_sentence": "whole"},
}


def drop_blank(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Leave out rows whose text is NULL or blank."""
    return df.filter(~is_blank(text))


def _number(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    # The array goes straight into the generator: as a column of its own it
    # would be computed a second time by the filter Spark infers for it.
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk_text")).filter(
        "chunk_text != ''"
    )


def chunk_table(
    df: DataFrame,
    rule: str = "batch",
    *,
    target: int = TARGET_SIZE,
    minimum: int = MIN_SIZE,
    text: str = "raw_text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Sentence-grouped chunks ``(keep..., chunk_index, chunk_text)``, numbered from 0 per row."""
    split = drop_blank(df, text).withColumn("_sentences", split_sentences(text))
    chunks = chunk_sentences(text, target, minimum, **RULES[rule], sentences="_sentences")
    return _number(split, chunks, keep or ["raw_data_id"])


def fixed_chunk_table(
    df: DataFrame,
    size: int,
    overlap: int = 0,
    *,
    text: str = "raw_text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Fixed-size overlapping chunks ``(keep..., chunk_index, chunk_text)``."""
    return _number(drop_blank(df, text), chunk_fixed(text, size, overlap), keep or ["raw_data_id"])


def flatten_chunks(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row per element of an array column; NULL and empty arrays give none."""
    rest = [c for c in df.columns if c != chunks]
    return df.select(*rest, F.explode(chunks).alias("chunk_text"))


def chunks_of(store: DataFrame, raw_data_id: int) -> DataFrame:
    """All chunks of one parent; the filter reaches the file scan."""
    return store.filter(F.col("raw_data_id") == raw_data_id)


#: Parents that are named in the filter of the scan.
NAMED_PARENTS = 1000


def chunks_of_many(store: DataFrame, parents: DataFrame) -> DataFrame:
    """All chunks of the parents listed in ``parents(raw_data_id)``.

    A few parents are named in the filter of the scan, so that a copy written by parent is read in
    their row groups only; more of them are joined.
    """
    wanted = parents.select("raw_data_id").filter("raw_data_id is not null")
    few = wanted.distinct().limit(NAMED_PARENTS + 1).collect()
    if len(few) <= NAMED_PARENTS:
        return store.filter(F.col("raw_data_id").isin(sorted(r.raw_data_id for r in few)))
    return store.join(wanted, "raw_data_id", "left_semi")
