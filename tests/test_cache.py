"""Each text is sent to the model once, lookups read few rows, ties have fixed ids."""

import random

import pytest
from pyspark.sql import functions as F

from passagemill.functions.cache import VectorCache
from passagemill.functions.embedding import HashedEmbedder, embed_column
from passagemill.operators import chunks, ranges
from passagemill.sources.store import write_by_parent

DIM = 16
EMBED = HashedEmbedder(DIM)


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, chunk_text string")


def rows(df):
    return sorted((r.id, r.chunk_text, tuple(r.embedding or ()), r.embed_error) for r in df.collect())


def test_only_new_texts_are_sent_and_all_rows_come_back(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return EMBED(texts)

    cache = VectorCache(spark, str(tmp_path / "cache"))
    first = texts_of(spark, ["a fish"] * 300 + ["b fish", None, "", " ", "c"])
    got = cache.embed(first, counted, dim=DIM)
    want = rows(embed_column(first, EMBED, dim=DIM))
    assert rows(got) == want and calls.value == 3 and cache.sent == 5  # blank texts reach no model
    second = texts_of(spark, ["c", "d", "a fish", "d"])
    got = cache.embed(second, counted, dim=DIM)
    assert rows(got) == rows(embed_column(second, EMBED, dim=DIM)) and calls.value == 4
    assert rows(cache.embed(second, counted, dim=DIM)) == rows(got) and calls.value == 4


def test_failed_texts_are_tried_again(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"))
    table = texts_of(spark, ["one", "two"])

    def down(texts):
        raise RuntimeError("down")

    assert [r[3] for r in rows(cache.embed(table, down, dim=DIM))] == ["model error: down"] * 2
    assert rows(cache.embed(table, EMBED, dim=DIM)) == rows(embed_column(table, EMBED, dim=DIM))
    assert cache.sent == 2 and cache.read().filter("embed_error is null").count() == 2


def test_empty_tables(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"))
    assert cache.embed(texts_of(spark, ["x"]).limit(0), EMBED, dim=DIM).count() == 0 and cache.sent == 0


def test_rows_are_worked_out_once(spark, tmp_path):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(x):
        worked.add(1)
        return f"text {x % 7}"

    cache = VectorCache(spark, str(tmp_path / "cache"))
    table = spark.range(40).select("id", costly.asNondeterministic()("id").alias("chunk_text"))
    got = rows(cache.embed(table, EMBED, dim=DIM))
    assert worked.value == 40 and cache.sent == 7
    assert got == rows(embed_column(texts_of(spark, [f"text {i % 7}" for i in range(40)]), EMBED, dim=DIM))


def test_columns_that_files_do_not_hold_come_back(spark, tmp_path):
    table = texts_of(spark, ["a", "b", "a"]).withColumn("span", F.expr("make_interval(0, 1)")).withColumn("none", F.lit(None))
    got = VectorCache(spark, str(tmp_path / "cache")).embed(table, EMBED, dim=DIM)
    assert got.columns == [*table.columns, "embedding", "embed_error"]
    want = embed_column(table, EMBED, dim=DIM)
    assert rows(got.drop("span")) == rows(want.drop("span")) and [got.schema[c].dataType for c in table.columns] == [
        want.schema[c].dataType for c in table.columns
    ]


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_lookup_by_parents_reads_their_row_groups_only(spark, tmp_path):
    path = str(tmp_path / "by-parent")
    store = spark.range(0, 40_000, 1, 4).selectExpr(
        "(id div 4) * 2 AS raw_data_id", "cast(id % 4 AS int) AS chunk_index", "sha2(string(id), 256) AS chunk_text"
    )
    write_by_parent(store, path)
    copy = spark.read.parquet(path)
    parents = spark.createDataFrame([(20,), (20,), (26,), (None,), (10**9,)], "raw_data_id long")
    found = chunks.chunks_of_many(copy, parents)
    assert sorted((r.raw_data_id, r.chunk_index) for r in found.collect()) == [(p, i) for p in (20, 26) for i in range(4)]
    assert rows_read(found) < 25_000  # one of the files
    # 21 is in the range of a file, but in no file: its bloom filter tells.
    absent = chunks.chunks_of_many(copy, spark.createDataFrame([(21,)], "raw_data_id long"))
    assert rows_read(absent) == 0


@pytest.mark.parametrize("named", [1000, 3])
def test_few_and_many_parents_are_found_alike(spark, monkeypatch, named):
    monkeypatch.setattr(chunks, "NAMED_PARENTS", named)
    store = spark.range(100).selectExpr("id div 3 AS raw_data_id", "cast(id % 3 AS int) AS chunk_index")
    parents = spark.range(0, 40, 2).selectExpr("id AS raw_data_id")
    assert chunks.chunks_of_many(store, parents).count() == 17 * 3


def test_ids_of_tied_rows_are_fixed_and_hot_keys_are_split(spark):
    rng = random.Random(1)
    data = [("abc"[min(i % 5, 2)], i % 700) for i in range(6000)]
    ids = []
    for seed in range(2):
        rng.shuffle(data)
        df = spark.createDataFrame(data, "k string, x long").repartition(3 + seed)
        numbered = ranges.dense_ids(df, ["k"])
        ids.append({(r.id, r.k, r.x) for r in numbered.collect()})
    assert ids[0] == ids[1] and {i for i, *_ in ids[0]} == set(range(1, 6001))
    one = spark.range(0, 9000, 1, 5).select(F.lit("same").alias("k"))
    plan = ranges.dense_ids(one, ["k"])
    assert plan.agg(F.countDistinct("id"), F.min("id"), F.max("id")).first() == (9000, 1, 9000)
