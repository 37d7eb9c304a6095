"""What the store holds of each document, so that an ingest need not read the store to know.

The state has one row per document and run: ``raw_data_id, text_hash, run, failed``. Rows lie in
buckets of 2^20 neighbouring ids, and the store's manifest names the folder of each bucket. A batch
reads and rewrites the buckets of its own ids only: a bucket is bounded whatever the store's size,
and batches of new documents, whose ids go on from the last, touch the last buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.sources.store import names_of, read_attempts

BUCKET_BITS = 20
_SCHEMA = "raw_data_id long, text_hash long, run string, failed boolean"


def bucket(bits: int = BUCKET_BITS) -> Column:
    return F.shiftright("raw_data_id", bits).alias("bucket")


def touched(rows: DataFrame, bits: int = BUCKET_BITS) -> list[int]:
    """The buckets of the rows' ids: one number for each million of ids at most."""
    return sorted(r.bucket for r in rows.filter("raw_data_id is not null").select(bucket(bits)).distinct().collect())


def places(spark: SparkSession, root: str, buckets: list[int] | None = None) -> list[str]:
    """The folders of some buckets, or of all."""
    named = ((k.removeprefix("state/"), v) for k, v in names_of(spark, root).items() if k.startswith("state/"))
    return [f"{root}/_state/{v}/bucket={k}" for k, v in named if buckets is None or int(k) in buckets]


def read_state(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of some buckets, or of all."""
    held = places(spark, root, buckets)
    if not held:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(*held)


def write_state(rows: DataFrame, root: str, attempt: str, buckets: list[int], bits: int = BUCKET_BITS) -> dict:
    """Write the rows of whole buckets; gives the names to commit."""
    folder = f"{root}/_state/{attempt}"
    rows.select("raw_data_id", "text_hash", "run", "failed", bucket(bits)).repartition("bucket").write.mode(
        "overwrite"
    ).partitionBy("bucket").parquet(folder)
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    written = {s.getPath().getName() for s in files.listStatus(path)}
    # A bucket that has no rows any more has no folder.
    return {f"state/{b}": attempt if f"bucket={b}" in written else None for b in buckets}


def summed_up(rows: DataFrame) -> DataFrame:
    """The state of documents from their outcome rows."""
    return rows.filter("raw_data_id is not null").groupBy("raw_data_id", "text_hash", "run").agg(
        F.max(F.col("outcome") == "rejected").alias("failed")
    )


def outside(spark: SparkSession, root: str) -> tuple[dict[str, str], DataFrame]:
    """Runs that the state does not hold yet, such as those of batch jobs, and the state of their rows."""
    runs = {
        k.removeprefix("run/"): v["attempt"]
        for k, v in names_of(spark, root).items()
        if k.startswith("run/") and not v["in_state"]
    }
    return runs, summed_up(read_attempts(spark, root, runs))
