"""Ingest of new rows as they arrive, by micro-batch."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.functions.embedding import EmbedFn
from passagemill.plans.ingest import ingest
from passagemill.session import delete, shared_folder
from passagemill.sources.manifest import Manifest
from passagemill.sources.store import create_store, read_attempts
from passagemill.streaming import state


def versions(batch: DataFrame) -> DataFrame:
    """One row per id. Rows of one batch have no order: of several texts the smallest is taken."""
    rest = [c for c in batch.columns if c != "raw_data_id"]
    first = batch.groupBy("raw_data_id").agg(F.min(F.struct(*rest)).alias("_row"))
    return first.select("raw_data_id", *(F.col("_row")[c].alias(c) for c in rest))


def only_new(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The documents of ``batch`` that ``known`` does not hold complete and with the same text.

    ``known`` has ``raw_data_id``, ``text_hash`` and ``failed``, whether a chunk was rejected. A
    document with a rejected chunk is tried again, and one with another text is new.
    """
    done = (
        known.groupBy("raw_data_id", "text_hash").agg(F.max("failed").alias("_failed"))
        .filter("not _failed").select("raw_data_id", "text_hash")
    )
    marked = versions(batch).withColumn("text_hash", F.xxhash64("raw_text"))
    return marked.join(done, ["raw_data_id", "text_hash"], "left_anti").drop("text_hash")


def fold_in(spark: SparkSession, root: str) -> None:
    """Take runs of batch jobs into the state: the one time that their rows are read."""
    runs, rows = state.outside(spark, root)
    if not runs:
        return
    attempt = uuid.uuid4().hex
    buckets = state.touched(rows)
    names = state.write_state(state.read_state(spark, root, buckets).unionByName(rows), root, attempt, buckets)
    noted = {f"run/{run}": {"attempt": a, "in_state": True} for run, a in runs.items()}
    Manifest(spark, root).commit(names | noted)


def ingest_batch(batch: DataFrame, root: str, fn: EmbedFn, run_id: str, **options) -> None:
    """Ingest the new and changed documents of a batch as the run ``run_id``.

    Rows, the replaced documents of former runs and the new state are written first and named in
    one commit. The store itself is not read.
    """
    spark = batch.sparkSession
    fold_in(spark, root)
    buckets = state.touched(batch)
    held = state.places(spark, root, buckets)
    known = state.read_state(spark, root, buckets).filter(F.col("run") != run_id)
    # Read three times below: the texts are gathered by id once, and written.
    fresh = only_new(batch, known)
    staged = shared_folder(spark, "fresh")
    fresh.write.parquet(staged)
    fresh = spark.read.schema(fresh.schema).parquet(staged)

    def before_commit(attempt: str) -> dict:
        ids = fresh.filter("raw_data_id is not null").select("raw_data_id", F.xxhash64("raw_text").alias("text_hash"))
        own = read_attempts(spark, root, {run_id: attempt}).groupBy("raw_data_id").agg(
            F.max(F.col("outcome") == "rejected").alias("failed")
        )
        # A document without chunks left no row in the run, but it is known from now on.
        added = ids.join(own, "raw_data_id", "left").select(
            "raw_data_id", "text_hash", F.lit(run_id).alias("run"), F.coalesce("failed", F.lit(False)).alias("failed")
        )
        if not held:
            return state.write_state(added, root, attempt, buckets)
        others = known.join(ids.select("raw_data_id"), "raw_data_id", "left_anti")
        names = state.write_state(others.select(*added.columns).unionByName(added), root, attempt, buckets)
        replaced = known.join(ids.select("raw_data_id"), "raw_data_id", "left_semi")
        seen = Observation()
        replaced.select("run", "raw_data_id").distinct().observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(
            f"{root}/_superseded/{attempt}"
        )
        return names | ({f"superseded/{attempt}": True} if seen.get["n"] else {})

    ingest(fresh, root, fn, run_id=run_id, before_commit=before_commit, **options)
    delete(spark, staged)


def ingest_stream(
    raw: DataFrame,
    root: str,
    checkpoint: str,
    fn: EmbedFn,
    *,
    name: str | None = None,
    ledger: str | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Start a query that ingests the new and changed rows of the streaming table ``raw``.

    Each micro-batch is a run named after the stream and the batch, and a repeated batch takes the
    place of its former rows. ``name`` must be the stream's own; by default it is its checkpoint.
    What was seen before is kept with the store, see ``state``, and not with the checkpoint, so
    several streams in turn and batch jobs may fill one store. Documents that another run holds
    with the same text and without a reject are left out; the others' rows in former runs are
    superseded by the commit that adds the new ones. One query at a time may write to a store.
    """
    create_store(raw.sparkSession, root)
    stream = name or hashlib.md5(checkpoint.encode()).hexdigest()

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, fn, f"{stream}-{batch_id}", ledger=ledger, **options)

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
