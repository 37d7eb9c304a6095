"""The instruction CSV: columns ``instruction``, ``input`` and ``output``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import combine_text

# The columns that are read, in the order their texts are joined.
COLUMNS = ("instruction", "input", "output")


def read_instruction_csv(
    spark: SparkSession, path: str, *, multi_line: bool = True, escape: str = '"'
) -> DataFrame:
    """The three text columns of a CSV with a header row.

    Names match without regard to case, the last of a repeated name counts, and
    other columns are left alone. A missing column is an error before anything
    is read. Short rows and empty fields give empty text. ``multi_line`` lets
    quoted fields hold line breaks but reads each file in one task; turn it off
    for large files without such fields. ``escape`` is the character that
    escapes a quote inside quotes.
    """
    options = {"multiLine": multi_line, "quote": '"', "escape": escape, "mode": "PERMISSIVE"}
    head = spark.read.csv(path, header=False, **options).first()
    if head is None:
        raise ValueError(f"no header row in {path}")
    place = {(name or "").lower(): i for i, name in enumerate(head)}
    missing = [c for c in COLUMNS if c not in place]
    if missing:
        raise ValueError(f"columns {missing} not found in the header {list(head)}")
    # Spark renames repeated columns, so columns are taken by position. Where no
    # name is repeated or empty, it also checks that all files have this header.
    alike = len(place) < len(head) or "" in place
    data = spark.read.csv(path, header=True, enforceSchema=alike, **options)
    return data.toDF(*(f"_{i}" for i in range(len(data.columns)))).select(
        *(F.coalesce(f"_{place[c]}", F.lit("")).alias(c) for c in COLUMNS)
    )


def raw_text(instructions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(keep..., raw_text)``: the three texts combined, blank rows left out."""
    return instructions.select(*(keep or []), combine_text(*COLUMNS).alias("raw_text")).filter(
        "raw_text != ''"
    )
