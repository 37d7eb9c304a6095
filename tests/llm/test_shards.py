import zlib
from collections import Counter

import pytest

from passagemill.llm import queries, shards

SF = "/root/testdata/sf0.001"


def check(rows, total, n_shards):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == total
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(n_shards)), default=0) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_shards(spark, SF).collect()
    check(rows, len(docs), 24)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


@pytest.mark.parametrize("n, n_shards, bucket_bytes", [(1000, 7, 500), (1000, 7, 1 << 20), (5, 24, 30), (0, 3, 10)])
def test_laws_hold_for_any_number_of_buckets(spark, tmp_path, n, n_shards, bucket_bytes):
    docs = spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text").repartition(3)
    out = shards.write_shards(docs, str(tmp_path / "s"), n_shards, seed=1, bucket_bytes=bucket_bytes)
    rows = out.collect()
    check(rows, n, n_shards)
    assert sorted((r.doc_id, r.text) for r in rows) == [(i, str(i)) for i in range(n)]


def order(df):
    return [r.doc_id for r in sorted(df.collect(), key=lambda r: (r.shard, r.slot))]


def test_same_seed_same_order_whatever_the_partitions(spark, tmp_path):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    made = [
        order(shards.write_shards(docs.repartition(k), str(tmp_path / f"{k}.{seed}"), 4, seed, bucket_bytes=2_000))
        for k, seed in ((1, 1), (5, 1), (5, 2))
    ]
    assert made[0] == made[1] != made[2]
    assert made[0] != sorted(made[0])


def test_order_is_uniform(spark, tmp_path):
    """The first slot is taken by every eighth of the ids about equally often."""
    docs = spark.range(64).selectExpr("id as doc_id", "'' as text").coalesce(1)
    firsts = Counter(
        order(shards.write_shards(docs, str(tmp_path / str(seed)), 1, seed, bucket_bytes=200))[0] // 16
        for seed in range(24)
    )
    assert max(firsts.values()) <= 15


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as key", "text as count")
    out = shards.write_shards(docs, str(tmp_path / "s"), 2)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows)
    check(out.collect(), 6, 2)
    with pytest.raises(ValueError, match="slot"):
        shards.write_shards(docs.withColumn("slot", docs.doc_id), str(tmp_path / "t"), 2)
