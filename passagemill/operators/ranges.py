"""Ids and id ranges: dense numbering, bounds, ranges, samples and pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.session import shared_folder

# Rows per page, readers, and the share of the id span a sample keeps.
PAGE_SIZE = 100
READERS = 4
SAMPLE_FRACTION = 0.3


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b))


def dense_ids(
    df: DataFrame, order_by: list[str] | None = None, *, id_col: str = "id", start: int = 1
) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` without a gap.

    Rows are numbered in the order of ``order_by``, or as they lie in the source
    when it is None. Rows with equal keys follow a hash of the whole row, so they
    have the same ids whenever they are numbered, and one key with very many rows
    is split over several partitions; rows that are equal throughout are split by
    their place. Rows of files are then numbered file by file in the order
    of their paths, without a shuffle and without a copy: only counts per file
    split are gathered. Other sources keep the order of their partitions; for
    these, and for sorted rows, places are written once to the shared folder,
    so that counting and numbering see the same ones even when executors are
    lost in between.
    """
    if not order_by:
        try:
            located = df.select(
                "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_place"),
            )
            located.schema  # noqa: B018  (asks the analyser whether the rows come from files)
        except AnalysisException:
            pass
        else:
            return _numbered(located, ["_file", "_block"], df.columns, id_col, start)
    spark = df.sparkSession
    columns = df.columns
    if order_by:
        ties = ["_hash", "_lies"]
        tied = df.withColumn("_hash", F.xxhash64(*columns)).withColumn("_lies", F.monotonically_increasing_id())
        df = tied.repartitionByRange(*order_by, *ties).sortWithinPartitions(*order_by, *ties).drop(*ties)
    staged = shared_folder(spark, "dense-ids")
    df.withColumn("_place", F.monotonically_increasing_id()).write.parquet(staged)
    placed = spark.read.parquet(staged).withColumn("_part", F.shiftright("_place", 33))
    return _numbered(placed, ["_part"], columns, id_col, start)


def _numbered(placed: DataFrame, part: list[str], columns: list[str], id_col: str, start: int) -> DataFrame:
    """Number rows by part, and in a part by ``_place``, which goes up by one from row to row."""
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
        .select(*part, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    # One small row per part: a file split or a partition.
    return placed.join(F.broadcast(offsets), part).select(
        (F.col("_before") + F.col("_place") - F.col("_first") + start).alias(id_col), *columns
    )


def id_bounds(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: ``min_id`` (1 when empty), ``max_id`` (0 when empty) and ``id_span``."""
    lo = F.coalesce(F.min(id_col), F.lit(1).cast("long"))
    hi = F.coalesce(F.max(id_col), F.lit(0).cast("long"))
    return df.agg(lo.alias("min_id"), hi.alias("max_id")).withColumn(
        "id_span", F.col("max_id") - F.col("min_id") + 1
    )


def _scalars(df: DataFrame, id_col: str) -> tuple[Column, Column]:
    bounds = id_bounds(df, id_col)
    return bounds.select("min_id").scalar(), bounds.select("id_span").scalar()


def range_id(id_value: Column, lo: Column, span: Column, n: int) -> Column:
    """Which of ``n`` ranges an id lies in; the first ``span % n`` ranges hold one id more."""
    at, each, extra = id_value - lo, _div(span, n), span % n
    wide = extra * (each + 1)
    return F.when(at < wide, _div(at, each + 1)).otherwise(
        extra + _div(at - wide, F.greatest(each, F.lit(1)))
    ).cast("int")


def with_range_id(df: DataFrame, n: int = READERS, id_col: str = "id") -> DataFrame:
    """Add ``range_id``. The bounds are scalar subqueries, so rows are not shuffled."""
    lo, span = _scalars(df, id_col)
    return df.withColumn("range_id", range_id(F.col(id_col), lo, span, n))


def id_ranges(df: DataFrame, n: int = READERS, id_col: str = "id") -> DataFrame:
    """The half-open ranges ``(range_id, start_id, end_id)``; empty ones are left out."""
    i = F.col("range_id").cast("long")
    each, extra = _div(F.col("id_span"), n), F.col("id_span") % n
    begin = F.col("min_id") + i * each + F.least(i, extra)
    return (
        id_bounds(df, id_col)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("range_id"))
        .select(
            "range_id",
            begin.alias("start_id"),
            (begin + each + F.when(i < extra, 1).otherwise(0)).alias("end_id"),
        )
        .filter("start_id < end_id")
    )


def range_predicates(min_id: int, max_id: int, n: int = READERS, id_col: str = "id") -> list[str]:
    """The same ranges as SQL conditions, for ``spark.read.jdbc(predicates=...)``."""
    span = max_id - min_id + 1
    each, extra = divmod(max(span, 0), n)
    starts = [min_id + i * each + min(i, extra) for i in range(n + 1)]
    return [f"{id_col} >= {a} AND {id_col} < {b}" for a, b in zip(starts, starts[1:]) if a < b]


def prefix_sample(df: DataFrame, fraction: float = SAMPLE_FRACTION, id_col: str = "id") -> DataFrame:
    """Keep the ids in the first ``fraction`` of the id span, at least one id.

    The limit is a scalar subquery that reaches the file scan as a filter.
    """
    bounds = id_bounds(df, id_col)
    span = F.col("id_span")
    kept = F.greatest(F.lit(1).cast("long"), F.floor(span * F.lit(float(fraction))).cast("long"))
    last = bounds.select(F.col("min_id") + F.least(kept, span) - 1)
    return df.filter(F.col(id_col) <= last.scalar())


def keyset_page(
    df: DataFrame, after: int, end: int, size: int = PAGE_SIZE, id_col: str = "id"
) -> DataFrame:
    """The next ``size`` rows with ``after < id < end`` in id order."""
    return df.filter((F.col(id_col) > after) & (F.col(id_col) < end)).orderBy(id_col).limit(size)


def page_numbers(
    df: DataFrame, n: int = READERS, size: int = PAGE_SIZE, id_col: str = "id"
) -> DataFrame:
    """Add ``range_id`` and ``page``: the keyset page each row would be read on.

    Ids must be unique; how they are spread does not matter. All rows are
    numbered once in id order, and a range's first number gives its pages.
    """
    numbered = dense_ids(df, [id_col], id_col="_number")
    rows = numbered.withColumn("range_id", range_id(F.col(id_col), *_scalars(df, id_col), n))
    firsts = rows.groupBy("range_id").agg(F.min("_number").alias("_first"))
    return rows.join(F.broadcast(firsts), "range_id").select(  # one row per range
        *df.columns, "range_id", _div(F.col("_number") - F.col("_first"), size).alias("page")
    )


def range_counters(
    df: DataFrame, n: int = READERS, size: int = PAGE_SIZE, id_col: str = "id"
) -> DataFrame:
    """Records and pages per range. A full last page costs one more, empty, page."""
    counts = with_range_id(df, n, id_col).groupBy("range_id").agg(
        F.count(F.lit(1)).alias("records")
    )
    records = F.coalesce("records", F.lit(0))
    return id_ranges(df, n, id_col).join(counts, "range_id", "left").select(
        "range_id", records.alias("records"), (_div(records, size) + 1).alias("pages")
    )
