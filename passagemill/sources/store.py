"""The embedding store and its rejects.

One root folder holds both, by run, attempt and outcome::

    root/run=<run id>/attempt=<id>/outcome=stored/...
    root/run=<run id>/attempt=<id>/outcome=rejected/...

so a job writes its rows once, whatever became of them. The manifest names the attempt that counts
for a run: a repeated run takes the place of its former rows in one commit, and one that fails
leaves them. ``root/_superseded`` lists, by attempt, the documents whose rows in a run a later run
has replaced.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.sources.manifest import Manifest

STORE_SCHEMA = T.StructType(
    [
        T.StructField("raw_data_id", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("reason", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("chunk_id", T.StringType()),
    ]
)
_FOLDERS = [T.StructField(name, T.StringType()) for name in ("run", "attempt", "outcome")]


def names_of(spark: SparkSession, root: str) -> dict:
    """What the store's manifest names; an error where there is no store."""
    manifest = Manifest(spark, root)
    if not manifest.exists():
        raise FileNotFoundError(f"no store at {root}")
    return manifest.names()


def attempt_folder(root: str, run_id: str, attempt: str) -> str:
    return f"{root}/run={run_id}/attempt={attempt}"


def read_attempts(spark: SparkSession, root: str, attempts: dict[str, str]) -> DataFrame:
    """All rows of some attempts ``{run: attempt}``, with ``run`` and ``outcome``."""
    schema = T.StructType(STORE_SCHEMA.fields + _FOLDERS)
    if not attempts:
        return spark.createDataFrame([], schema).drop("attempt")
    places = [attempt_folder(root, run, attempt) for run, attempt in attempts.items()]
    return spark.read.schema(schema).option("basePath", root).parquet(*places).drop("attempt")


def read_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all runs, with ``run`` and ``outcome``, less those that were superseded."""
    names = names_of(spark, root)
    runs = {k.removeprefix("run/"): v["attempt"] for k, v in names.items() if k.startswith("run/")}
    rows = read_attempts(spark, root, runs)
    places = [f"{root}/_superseded/{k.removeprefix('superseded/')}" for k in names if k.startswith("superseded/")]
    if not places:
        return rows
    gone = spark.read.schema("run string, raw_data_id long").parquet(*places)
    return rows.join(gone.distinct(), ["run", "raw_data_id"], "left_anti")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The stored chunks with their vectors."""
    return read_outcomes(spark, root).filter("outcome = 'stored'").drop(
        "run", "outcome", "reason", "text_hash"
    )


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that were not stored, and why."""
    return (
        read_outcomes(spark, root)
        .filter("outcome = 'rejected'")
        .select("run", "raw_data_id", "chunk_index", "chunk_text", "source", "reason", "created_at")
    )


def stage_outcomes(df: DataFrame, root: str, run_id: str) -> str:
    """Write one run's rows where no reader sees them yet; gives the attempt.

    ``created_at`` is the time of the write, ``chunk_id`` names a row for good.
    """
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"a run is named by letters, digits, '_', '.' and '-', not {run_id!r}")
    known = df if "text_hash" in df.columns else df.withColumn("text_hash", F.lit(None).cast("long"))
    ready = known.withColumn("created_at", F.current_timestamp()).withColumn("chunk_id", F.expr("uuid()"))
    attempt = uuid.uuid4().hex
    rows = ready.select(*STORE_SCHEMA.fieldNames(), "outcome")
    rows.write.partitionBy("outcome").parquet(attempt_folder(root, run_id, attempt))
    return attempt


def commit_outcomes(
    spark: SparkSession, root: str, run_id: str, attempt: str, names: dict | None = None, in_state: bool = False
) -> None:
    """Let an attempt count for its run; further ``names`` are set in the same commit."""
    run = {"attempt": attempt, "in_state": in_state}
    Manifest(spark, root).commit({f"run/{run_id}": run, **(names or {})})


def write_outcomes(df: DataFrame, root: str, run_id: str) -> None:
    """Write one run's rows in place of its former ones, if there are any."""
    attempt = stage_outcomes(df, root, run_id)
    commit_outcomes(df.sparkSession, root, run_id, attempt)


def append_embeddings(df: DataFrame, root: str) -> str:
    """Append rows as they are, NULL vectors included; gives the id of the run they went to."""
    run_id = uuid.uuid4().hex
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    rows = (
        df.withColumn("source", source)
        .withColumn("reason", F.lit(None).cast("string"))
        .withColumn("outcome", F.lit("stored"))
    )
    write_outcomes(rows, root, run_id)
    return run_id


def create_store(spark: SparkSession, root: str) -> None:
    """Create the store if there is none; an existing one is left as it is."""
    manifest = Manifest(spark, root)
    if not manifest.exists():
        manifest.commit({})


def reset_store(spark: SparkSession, root: str) -> None:
    """Create the store, or empty it."""
    Manifest(spark, root).commit({}, replace_all=True)
    vacuum(spark, root)


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete the folders that the manifest does not name: former, failed and reset attempts.

    For times when nothing is written, and no reader is still at a former attempt.
    """
    manifest = Manifest(spark, root)
    names = manifest.names()
    path = spark._jvm.org.apache.hadoop.fs.Path
    counts = {(k.removeprefix("run/"), v["attempt"]) for k, v in names.items() if k.startswith("run/")}
    used = {v for k, v in names.items() if k.startswith("state/")}
    used |= {k.removeprefix("superseded/") for k in names if k.startswith("superseded/")}
    below = lambda place: manifest.files.listStatus(place) if manifest.files.exists(place) else []
    for run in below(path(root)):
        name = run.getPath().getName()
        if name.startswith("run="):
            for attempt in below(run.getPath()):
                if (name[4:], attempt.getPath().getName()[8:]) not in counts:
                    manifest.files.delete(attempt.getPath(), True)
        elif name in ("_state", "_superseded"):
            for attempt in below(run.getPath()):
                if attempt.getPath().getName() not in used:
                    manifest.files.delete(attempt.getPath(), True)


def write_by_parent(store: DataFrame, path: str) -> None:
    """A copy sorted by parent and chunk, with bloom filters of the parents.

    A lookup by parent skips the files and row groups whose range does not hold it, or whose
    filter does not know it. The chunk index takes part in the ranges: one parent with very many
    chunks is spread over several files.
    """
    order = ["raw_data_id", "chunk_index"]
    store.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "parquet.bloom.filter.enabled#raw_data_id", "true"
    ).parquet(path)


def write_by_source(store: DataFrame, path: str) -> None:
    """A copy with one folder per source.

    Rows are gathered by source, so that not every task writes to every folder,
    and the rebalance splits a large source over several tasks and files.
    """
    gathered = store.hint("rebalance", "source")
    gathered.write.mode("overwrite").partitionBy("source").parquet(path)
