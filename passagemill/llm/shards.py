"""Shuffled shards by a two-pass external shuffle.

Pass one scatters records into memory-sized buckets by a seeded hash of the record. Pass two puts
each bucket into hash order, draws a Fisher-Yates permutation seeded by ``(seed, bucket)``, cuts
the sequence of all buckets into shards whose numbers of rows differ by one at most (the law
``rows``), and writes it.

Row ``p`` of ``n`` in the whole sequence goes to shard ``((p + 1) * shards - 1) // n``; so a bucket
touches few shards and is written as few files. The only thing gathered is one count per bucket,
at most ``MOST_BUCKETS``: from that number on buckets grow with the input instead.

Nulls: a null text counts no bytes and keeps its row. Repeated rows stay; fully equal ones share a
bucket. An empty table gives an empty set of shards. Columns named like the added ones are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 20
ADDED = ("bucket", "shard", "slot")


def record_bytes(text: str = "text") -> Column:
    """The size of a record: the UTF-8 bytes of its text and eight for its id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _permuted(offsets: pa.Array, rows: int, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = offsets.value

        def shuffled(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            order = np.random.default_rng([seed, bucket]).permutation(table.num_rows)
            places = int(starts[bucket]) + np.arange(table.num_rows, dtype=np.int64)
            shard = ((places + 1) * shards - 1) // rows
            table = table.take(pa.array(order)).append_column("shard", pa.array(shard.astype(np.int32)))
            slot = places - shard * rows // shards
            yield from table.append_column("slot", pa.array(slot)).to_batches(max_chunksize=2_000)

        open_bucket, parts = -1, []
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if buckets[lo] != open_bucket and parts:
                    yield from shuffled(open_bucket, parts)
                    parts = []
                open_bucket = int(buckets[lo])
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from shuffled(open_bucket, parts)

    return run


def write_shards(
    docs: DataFrame, path: str, shards: int, seed: int = 0, key: tuple[str, ...] = ("doc_id", "text"),
    size: Column | None = None, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write ``docs`` to ``path`` as shuffled shards and read them back with ``shard`` and ``slot``."""
    if clash := set(ADDED) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are added by the shuffle")
    spark = docs.sparkSession
    size = record_bytes() if size is None else size
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = min(max(1, -(-total // bucket_bytes)), MOST_BUCKETS)

    mark = F.xxhash64(F.lit(seed), *key)
    placed = docs.withColumn("bucket", F.pmod(mark, F.lit(buckets)).cast("int"))
    counts = np.zeros(buckets, np.int64)
    for row in placed.groupBy("bucket").count().toLocalIterator():
        counts[row["bucket"]] = row["count"]
    offsets = spark.sparkContext.broadcast(np.concatenate(([0], np.cumsum(counts)))[:-1])

    scattered = placed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", mark, *key)
    schema = placed.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).schema
    shuffled = scattered.mapInArrow(_permuted(offsets, rows, shards, seed), schema).drop("bucket")
    # In the order in which it is written, so that a task keeps one file open.
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(shuffled.schema).parquet(path)
