import random

import pytest

from passagemill.llm import leaks, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def result(df):
    return {
        r.doc_id: (r.n_words, sum(h.end - h.start for h in r.hit_words), r["items"]) for r in df.collect()
    }


@pytest.mark.parametrize("block_bytes", [leaks.BLOCK_BYTES, 4_000])
def test_equals_brute_force(spark, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = brute.leaks(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert result(leaks.find_leaks(docs, items, block_bytes=block_bytes)) == expected
    assert sum(bool(v[1]) for v in expected.values()) > 0


def test_random_words(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "é", "a1", "ß"])
    text = lambda n: "".join(word() + rng.choice([" ", "\n", "-", " x "]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 400))) for i in range(60)] + [(99, None), (100, ""), (101, " -- ")]
    items = [(i, text(rng.randrange(0, 25))) for i in range(30)] + [(77, None), (78, ""), (79, "a1 a1 é")]
    found = leaks.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert result(found) == brute.leaks(docs, items)


def test_spans_point_into_the_original(spark):
    item = "one two three four five six seven eight nine ten"
    text = "Ünder – (ONE two, three; four-five SIX\nseven eight nine ten) end"
    docs = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, items string")
    found = leaks.find_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    (span,) = found.spans
    assert text[span.start : span.end] == "ONE two, three; four-five SIX\nseven eight nine ten"
    assert found["items"] == ["5"]


def test_empty_tables_repeats_and_null_items(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (2, None)], "item_id long, text string")
    assert leaks.find_leaks(none, items).collect() == []
    docs = spark.createDataFrame([(1, "x a b"), (1, "x a b"), (2, "c d"), (None, "a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r["items"]) for r in leaks.find_leaks(docs, items).collect()) == [
        ("1", ["1"]), ("1", ["1"]), ("2", [""]), ("None", ["1"]),
    ]
    no_items = leaks.find_leaks(docs, spark.createDataFrame([], "item_id long, text string"))
    assert {tuple(r["items"]) for r in no_items.collect()} == {()}


def test_query(spark):
    row = queries.op5_decontaminate(spark, SF).filter("contaminated").first()
    assert row.n_hit >= 1 and row.n_items >= 1 and len(row.items_sha256) == 64
