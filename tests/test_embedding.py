import hashlib
import re

import numpy as np
import pytest

from passagemill.functions.embedding import HashedEmbedder, embed_batch, embed_column
from passagemill.functions.generation import EMPTY_REPLY, FAILED_REPLY, generate_column

ONES = lambda texts: np.ones((len(texts), 3))


def reasons(texts, fn, **options):
    vectors, why = embed_batch(texts, fn, 3, **options)
    assert all((v == 0).all() == (w is not None) for v, w in zip(vectors, why))
    return why


def test_blank_texts_are_left_out_and_realigned():
    asked = []

    def fn(texts):
        asked.append(texts)
        return [[len(t)] * 3 for t in texts]

    vectors, why = embed_batch(["aa", "", None, "\t", "b"], fn, 3)
    assert asked == [["aa", "b"]]
    assert vectors[:, 0].tolist() == [2, 0, 0, 0, 1]
    assert why == [None, "blank text", "blank text", "blank text", None]


def test_only_blank_texts_make_no_call():
    def fn(texts):
        raise AssertionError

    assert reasons(["", None], fn) == ["blank text"] * 2


def test_failures_are_zero_vectors():
    def broken(texts):
        raise RuntimeError("down")

    assert reasons(["a", "", "b"], broken) == ["model error: down", "blank text", "model error: down"]
    assert reasons(["a"], lambda t: None) == ["reply count differs"]
    assert reasons(["a", "b"], lambda t: [[1, 2], [1, 2, 3]]) == ["wrong dimension", None]
    assert reasons(["a", "b"], lambda t: [[1, None, 3], None]) == ["null element", "wrong dimension"]
    assert reasons(["a", "b"], lambda t: np.ones((2, 4))) == ["wrong dimension"] * 2


def test_a_zero_vector_counts_as_failed():
    assert reasons(["a", "b"], lambda t: np.array([[0, 0, 0], [0, 1, 0]])) == ["zero vector", None]
    assert reasons(["a", "b"], lambda t: [[0, 0, 0], [0, 1, 0]]) == ["zero vector", None]


def test_short_reply():
    short = lambda texts: ONES(texts)[:-1]
    assert reasons(["a", "", "b"], short) == ["reply count differs", "blank text", "reply count differs"]
    got = reasons(["a", "", "b"], short, policy="positional")
    assert got == [None, "blank text", "reply count differs"]
    assert reasons(["a"], lambda t: np.ones((3, 3)), policy="positional") == [None]


def test_calls_hold_at_most_batch_size_texts(spark):
    def fn(texts):
        return np.full((len(texts), 3), len(texts))

    df = spark.range(1100).selectExpr("id", "'t' AS chunk_text").coalesce(1)
    made = embed_column(df, fn, dim=3).groupBy("embedding").count().collect()
    assert sorted((r.embedding[0], r["count"]) for r in made) == [(100.0, 100), (500.0, 1000)]


def test_workers_bound_the_partitions(spark):
    df = spark.range(100).selectExpr("id", "'t' AS chunk_text")
    made = embed_column(df, ONES, dim=3, workers=6)
    assert made.rdd.getNumPartitions() == 6
    assert made.filter("embed_error IS NULL").count() == 100
    with pytest.raises(ValueError):
        embed_column(df, ONES, policy="loose")


def test_model_runs_once_per_row(spark, tmp_path):
    """A filter and two uses of the vector still make one call per text."""
    log = str(tmp_path)

    def fn(texts):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return np.ones((len(texts), 3))

    df = spark.range(50).selectExpr("id", "concat('t', id) AS chunk_text")
    made = embed_column(df, fn, dim=3).filter("embed_error IS NULL").filter("embedding[0] > 0")
    assert len(made.selectExpr("id", "embedding[1] AS x", "size(embedding) AS n").collect()) == 50
    calls = [t for f in tmp_path.iterdir() for t in f.read_text().splitlines()]
    assert len(calls) == 50


def test_hashed_embedder():
    made = HashedEmbedder(64)(["a b a", "b a a", " ", "c"])
    assert (made[0] == made[1]).all() and not made[2].any()
    assert np.allclose(np.linalg.norm(made[[0, 1, 3]], axis=1), 1)
    assert sorted(made[0][made[0] > 0].round(6)) == [round(1 / 5**0.5, 6), round(2 / 5**0.5, 6)]


def test_generation(spark):
    def fn(system, prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return None if prompt == "none" else f"{system}|{prompt}"

    df = spark.createDataFrame([("hi",), ("bad",), ("none",), (None,)], "prompt string")
    got = {r.prompt: (r.reply, r.reply_error) for r in generate_column(df, fn, system="S").collect()}
    assert got == {
        "hi": ("S|hi", None),
        "bad": (FAILED_REPLY, "down"),
        "none": (EMPTY_REPLY, "no text in reply"),
        None: (None, None),
    }


@pytest.mark.parametrize(
    "vector, reason",
    [
        ([1.0, float("nan")], "not finite"), ([1e300, 0.0], "not finite"), ([float("-inf"), 1.0], "not finite"),
        (["a", "b"], "not a vector"), ("ab", "wrong dimension"), (7, "not a vector"), ([[1], [2, 3]], "not a vector"),
    ],
)
def test_odd_replies_reject_their_row_only(vector, reason):
    vectors, reasons = embed_batch(["x", "y"], lambda texts: [vector, [3.0, 4.0]], 2)
    assert reasons == [reason, None]
    assert vectors.tolist() == [[0, 0], [3, 4]]


def test_words_end_at_characters_up_to_the_space_only():
    """Every character that some splitter takes for white space, and those around them."""
    texts = [f"one{chr(c)}two three{chr(c)}" for c in [*range(0x100), *range(0x1670, 0x1690), *range(0x1FF0, 0x3010)]]
    want = np.zeros((len(texts), 16))
    for row, text in enumerate(texts):
        for word in re.findall(r"[^\x00-\x20]+", text):
            want[row, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(HashedEmbedder(16)(texts), want)
