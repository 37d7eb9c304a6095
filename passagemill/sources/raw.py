"""The raw table ``(raw_data_id, raw_text[, source])``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.operators.ranges import READERS, dense_ids, id_bounds, range_predicates

RAW_SCHEMA = T.StructType(
    [
        T.StructField("raw_data_id", T.LongType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


def as_raw(df: DataFrame, id_col: str, text: str, source: str | None = None) -> DataFrame:
    """Any table as a raw table; only these columns reach the scan."""
    origin = F.col(source) if source else F.lit(None).cast("string")
    return df.select(
        F.col(id_col).cast("long").alias("raw_data_id"),
        F.col(text).alias("raw_text"),
        origin.alias("source"),
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def read_raw_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    n: int = READERS,
    id_col: str = "id",
    text: str = "raw_text",
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A raw table in a database, read by ``n`` tasks over equal id ranges."""
    options = properties or {}
    bounds = id_bounds(spark.read.jdbc(url, table, properties=options), id_col).first()
    ranges = range_predicates(bounds.min_id, bounds.max_id, n, id_col)
    rows = spark.read.jdbc(url, table, predicates=ranges or ["1 = 0"], properties=options)
    return as_raw(rows, id_col, text)


def append_raw(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """Append texts with the next ids. The whole append succeeds or nothing is added.

    For one writer at a time, as ids go on from the largest in the table.
    """
    spark = df.sparkSession
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    create_raw(spark, path)
    last = id_bounds(read_raw(spark, path), "raw_data_id").first().max_id
    texts = df.withColumn("source", source)
    numbered = dense_ids(texts, order_by, id_col="raw_data_id", start=last + 1)
    numbered.select(*RAW_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def create_raw(spark: SparkSession, path: str) -> None:
    """Create the table if there is none; an existing one is left as it is."""
    spark.createDataFrame([], RAW_SCHEMA).write.mode("ignore").parquet(path)


def reset_raw(spark: SparkSession, path: str) -> None:
    """Create the table, or empty it; ids start at 1 again."""
    spark.createDataFrame([], RAW_SCHEMA).write.mode("overwrite").parquet(path)
