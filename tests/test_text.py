import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.functions.text import (
    chunk_fixed,
    chunk_sentences,
    combine_text,
    group_sentences,
    is_blank,
    jtrim,
    split_sentences,
    utf16_length,
)
from passagemill.operators.chunks import chunk_table, drop_blank, flatten_chunks


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_trim_strips_all_low_characters(spark):
    assert one(spark, " \x00\t a b\n \x1f", jtrim("t")) == "a b"
    assert one(spark, " a ", jtrim("t")) == " a "
    assert one(spark, " " * 50 + "x" + "\n" * 50 + "y", jtrim("t")) == "x" + "\n" * 50 + "y"


def test_blank(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x01"), (4, "a")]
    df = spark.createDataFrame(rows, "id int, raw_text string")
    assert [r.id for r in df.filter(is_blank("raw_text")).orderBy("id").collect()] == [1, 2, 3]
    assert [r.id for r in drop_blank(df).collect()] == [4]


def test_length_counts_utf16_units(spark):
    assert one(spark, "aé\U0001f600", utf16_length("t")) == 4


def test_combine_keeps_two_spaces_for_an_empty_middle_part(spark):
    df = spark.createDataFrame(
        [("a ", " ", "\tc"), (" ", None, "\n"), ("a", "b", "c")], "x string, y string, z string"
    )
    got = [r.t for r in df.select(combine_text("x", "y", "z").alias("t")).collect()]
    assert got == ["a  c", "", "a b c"]


def test_sentences(spark):
    split = split_sentences("t")
    assert one(spark, "Hi there. It is 3.14! ? ok", split) == ["Hi there.", "It is 3.", "14!", "ok"]
    assert one(spark, "...", split) == []
    assert one(spark, "?!  A b ... c", split) == ["A b ...", "c"]


def test_text_without_a_sentence(spark):
    assert one(spark, " ... ", chunk_sentences("t")) == []
    assert one(spark, " ... ", chunk_sentences("t", no_sentence="whole")) == ["..."]
    assert one(spark, "." * 501, chunk_sentences("t", no_sentence="whole")) == []
    assert one(spark, None, chunk_sentences("t", no_sentence="whole")) == []
    assert one(spark, " \n", chunk_sentences("t", no_sentence="whole")) == []


def sentence(n):
    return "a" * (n - 1) + "."


def sizes(spark, lengths, **options):
    text = " ".join(sentence(n) for n in lengths)
    return [len(c) for c in one(spark, text, chunk_sentences("t", **options))]


def test_the_rules_differ_by_the_joining_space(spark):
    assert sizes(spark, [300, 200]) == [501]
    assert sizes(spark, [300, 200], separator=1) == [300, 200]


def test_a_short_chunk_is_not_closed(spark):
    assert sizes(spark, [40, 600]) == [641]
    assert sizes(spark, [700, 10]) == [700, 10]


def test_over_long_first_sentence_stands_alone_when_target_is_below_minimum(spark):
    assert sizes(spark, [20, 5, 5], target=10, minimum=30) == [20, 11]
    assert sizes(spark, [5, 20, 5], target=10, minimum=30) == [32]


def test_sizes_are_utf16_units(spark):
    # 130 characters outside the basic plane are 260 units.
    text = "\U0001f600" * 129 + ". " + "b" * 241 + "."
    assert len(one(spark, text, chunk_sentences("t", separator=1))) == 2
    assert len(one(spark, text.replace("\U0001f600", "c"), chunk_sentences("t", separator=1))) == 1


def test_many_chunks_keep_their_order(spark):
    """More chunks than the fold keeps in one block."""
    texts = [f"{i:04d}" + "x" * 495 + "." for i in range(700)]
    got = one(spark, " ".join(texts), chunk_sentences("t"))
    assert got == texts


def test_fixed_windows(spark):
    assert one(spark, "0123456789", chunk_fixed("t", 6, 2)) == ["012345", "456789", "89"]
    assert one(spark, "abc", chunk_fixed("t", 2, 2)) == ["ab", "bc", "c"]
    assert one(spark, "abc", chunk_fixed("t", 3, 1)) == ["abc"]
    assert one(spark, " \n", chunk_fixed("t", 3, 1)) == []
    assert one(spark, None, chunk_fixed("t", 3, 1)) == []
    assert one(spark, "a\nb\U0001f600c d", chunk_fixed("t", 4, 1)) == ["a\nb\U0001f600", "\U0001f600c d", "d"]


def test_flatten_skips_null_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "id int, chunks array<string>")
    assert [tuple(r) for r in flatten_chunks(df).collect()] == [(1, "a"), (1, "b")]


pieces = st.text(alphabet="ab .!?\n\té\U0001f600", max_size=60)
lists = st.lists(pieces, min_size=1, max_size=30)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=lists, target=st.integers(1, 40), minimum=st.integers(1, 40), separator=st.integers(0, 1))
def test_chunk_properties(spark, texts, target, minimum, separator):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select(
        "t",
        split_sentences("t").alias("s"),
        group_sentences(split_sentences("t"), target, minimum, separator).alias("c"),
        chunk_fixed("t", target, minimum).alias("w"),
    )
    low = "".join(map(chr, range(33)))
    units = lambda x: len(x.encode("utf-16-le")) // 2
    for text, s, chunks, windows in df.collect():
        trimmed = text.strip(low)
        found = [p.strip(low) for p in re.findall(r"[^.!?]+[.!?]+\s*|[^.!?]+$", trimmed)]
        assert s == [p for p in found if p]
        assert " ".join(chunks) == " ".join(s)
        left = list(s)
        for i, chunk in enumerate(chunks):
            inside = [left.pop(0)]
            while units(" ".join(inside)) < units(chunk):
                inside.append(left.pop(0))
            assert " ".join(inside) == chunk
            # No sentence was added to a chunk that should have been closed.
            for n in range(1, len(inside)):
                before = units(" ".join(inside[:n]))
                assert before < minimum or before + units(inside[n]) + separator <= target
            # And it was closed for a reason.
            if left:
                full = units(chunk) >= minimum and units(chunk) + units(left[0]) + separator > target
                assert full or (i == 0 and len(inside) == 1 and units(chunk) > target)
        assert left == []
        step = max(target - minimum, 1)
        if trimmed:
            want = [trimmed[i : i + target] for i in range(0, len(trimmed), step)]
            assert windows == (want if len(trimmed) > target else [trimmed])
        else:
            assert windows == []


def test_chunk_numbers_are_dense(spark):
    rows = [(1, "One. Two! " * 200), (2, None), (3, "..."), (4, "Three")]
    df = spark.createDataFrame(rows, "raw_data_id long, raw_text string")
    for rule, single in (("batch", [4]), ("actor", [3, 4])):
        got = chunk_table(df, rule).groupBy("raw_data_id").agg(
            F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.min("chunk_index").alias("first")
        ).orderBy("raw_data_id").collect()
        assert [r.raw_data_id for r in got] == [1, *single]
        assert all(r.first == 0 and r.last == r.n - 1 for r in got)


def test_only_lengths_leave_the_jvm(spark):
    df = spark.createDataFrame([(1, "One. Two!")], "raw_data_id long, raw_text string")
    plan = chunk_table(df)._jdf.queryExecution().executedPlan().toString()
    (call,) = re.findall(r"ArrowEvalPython \[cuts\((.*?)\)#\d+\]", plan)
    assert call.startswith("transform(_sentences") and "octet_length" in call
    assert plan.count("regexp_extract_all") == 1


def test_long_texts_take_linear_time(spark):
    import time

    def seconds(size):
        rows = [(1, "Some words of a sentence here. " * (size // 31))]
        df = spark.createDataFrame(rows, "raw_data_id long, raw_text string").persist()
        df.count()
        begun = time.perf_counter()
        n = chunk_table(df).agg(F.count("*"), F.sum(F.length("chunk_text"))).first()
        assert n[0] > size // 600
        return time.perf_counter() - begun

    seconds(1_000_000)
    assert seconds(16_000_000) < 16 * max(seconds(2_000_000), 0.25)
