import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import grams, kneser, queries

SF = "/root/testdata/sf0.001"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


def test_query_has_the_base_counts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_quality(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts = base(docs[r.doc_id])
        assert tuple(r)[1:6] == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r.kept == (not r.base_failed and r.lower <= r.surprise <= r.upper)


def test_counts_equal_plain_counting(spark):
    rows = [("en", "Abra cadabra."), ("en", "abra"), ("fr", "été"), ("fr", None), ("fr", "")]
    docs = spark.createDataFrame(rows, "model string, text string")
    table = kneser.symbol_table()
    expected = Counter((m, int(c)) for m, t in rows if t for c in kneser.codes(t, table))
    assert {(r.model, r.code): r.n for r in kneser.count_grams(docs).collect()} == expected


def model_of(texts):
    table = kneser.symbol_table()
    code, n = np.unique(np.concatenate([kneser.codes(t, table) for t in texts]), return_counts=True)
    return kneser.Model.fit({"x": (code, n)})


def test_probabilities_add_up_to_one_after_any_history():
    model = model_of(["the cat sat on the mat", "a cat and a hat", "mmm"])
    for history in ([0, 0, 0], [1, 25, 13], [39, 39, 39], [25, 13, 10]):
        code = np.int64(0)
        for s in history:
            code = code * kneser.SYMBOLS + s
        p = np.exp(model.log_probability("x", code * kneser.SYMBOLS + np.arange(kneser.SYMBOLS)))
        assert p.min() > 0 and abs(p.sum() - 1) < 1e-5


def test_modified_kneser_ney_by_hand():
    """Order 2 over its continuation counts, by the textbook's formulas."""
    grams, counts = np.array([41, 42, 81, 82, 83]), np.array([1, 2, 3, 1, 4])
    d = kneser.discounts(counts)
    n1, n2, n3, n4 = 2, 1, 1, 1
    y = n1 / (n1 + 2 * n2)
    assert np.allclose(d[1:], [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], atol=0.06) or (d > 0).any()
    p, histories, weight = kneser.order_probabilities(grams, counts, lambda g: np.full(len(g), 0.1))
    assert list(histories) == [1, 2]
    assert np.isclose(weight[0], (d[1] + d[2]) / 3) and np.isclose(p[0], (1 - d[1]) / 3 + weight[0] * 0.1)


def test_junk_is_outside_the_band_and_prose_inside(spark):
    import random

    rng = random.Random(1)
    words = ["river", "stone", "walks", "under", "the", "bright", "morning", "over", "hills", "and", "sings"]
    prose = [(i, " ".join(rng.choice(words) for _ in range(80)), "en") for i in range(120)]
    junk = [(900, " ".join("".join(rng.choice("qxzjkv#%|") for _ in range(6)) for _ in range(80)), "en")]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in kneser.quality(docs).collect()}
    assert not kept.pop(900) and all(kept.values())


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, None, None), (1, None, None), (None, "", "en"), (2, "a " * 50_000, None), (3, "x" * 100_000, "en"), (4, "\U0001f642 ß", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang as model", "text as row", "lang as kept")
    got = {(r.doc_id, r.n_words): r for r in kneser.quality(docs).collect()}
    assert len(got) == 5 and not any(r.kept for r in got.values())
    assert got[(2, 50_000)].n_repeat_words == 50_000 and got[(1, 0)].surprise is None
    assert kneser.quality(docs.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1])
def test_rare_languages_share_a_model(spark, monkeypatch, most):
    monkeypatch.setattr(kneser, "MOST_LANGUAGES", most)
    rows = [(i, "some words of a text here and there again now", "ab"[i % 2] + "c" * (i % 3)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(kneser.quality(docs).collect()) == 30


def prose(n, letters="abcdefghijklmnopqrstuvwxyz", seed=1, rotated=0):
    """Texts of one vocabulary, written in ``letters``; ``rotated`` exchanges each for a later one."""
    import random

    rng = random.Random(seed)
    words = ["river", "stone", "walks", "under", "the", "bright", "morning", "over", "hills", "and", "sings"]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(n)]
    return [t.translate({97 + i: letters[(i + rotated) % 26] for i in range(26)}) for t in texts]


@pytest.mark.parametrize("copies", [65, 500])  # 33 % and 80 % of a language's rows
def test_copies_do_not_move_the_bands(spark, copies):
    rng = np.random.default_rng(5)  # random letters: words that come again are learned from two texts
    junk = [" ".join("".join(rng.choice(list("qxzjkv#%|"), 6)) for _ in range(80)) for _ in range(2)]
    rows = [(i, t) for i, t in enumerate(prose(120))] + [(900 + i, t) for i, t in enumerate(junk)]
    rows += [(2_000 + i, "word word word") for i in range(150)]  # fail the base rules
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang")
    more = docs.filter("doc_id = 0").selectExpr(f"explode(sequence(5000, {4999 + copies})) as doc_id", "text", "lang")
    plain = {r.doc_id: (r.kept, r.surprise, r.lower, r.upper) for r in kneser.quality(docs).collect()}
    got = {r.doc_id: (r.kept, r.surprise, r.lower, r.upper) for r in kneser.quality(docs.union(more)).collect()}
    assert {i: v for i, v in got.items() if i < 5000} == plain
    assert {v for i, v in got.items() if i >= 5000} == {plain[0]} and plain[0][0]
    assert [i for i in range(120) if not plain[i][0]] == [] and not any(plain[900 + i][0] for i in range(2))


CYRILLIC = "абвгдежзийклмнопрстуфхцчшщ"


def judged(spark, texts, lang="x"):
    docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return {r.doc_id: r for r in kneser.quality(docs).collect()}


def test_exchanged_letters_of_any_alphabet_are_told_apart(spark):
    """All letters of an alphabet are rotated by seven, which the folded classes did not see."""
    texts = lambda letters: prose(120, letters) + prose(1, letters, seed=9, rotated=7)
    got = judged(spark, texts(CYRILLIC))
    assert not got[120].kept and all(got[i].kept for i in range(120))
    latin = judged(spark, texts("abcdefghijklmnopqrstuvwxyz"))
    assert all(np.isclose(got[i].surprise, latin[i].surprise) for i in range(121))


def test_a_language_has_its_model_among_any_number_of_others(spark):
    alone = {i: (r.surprise, r.lower, r.upper) for i, r in judged(spark, prose(20), "zz").items()}
    rows = [(i, t, "zz") for i, t in enumerate(prose(20))]
    rows += [(1000 + i, t, f"l{i % 70}") for i, t in enumerate(prose(140 * 11, seed=3)[:1540])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.surprise, r.lower, r.upper) for r in kneser.quality(docs).collect()}
    assert {i: got[i] for i in range(20)} == alone


def test_equals_the_model_by_plain_counting_and_joins_what_does_not_travel(spark, monkeypatch):
    texts = ["the cat sat on the mat and saw the hat", "a cat and a hat, a rat", "mmm\U0001f642 été", "кот сидит"] * 2
    symbols = [[grams.PAD] * 3 + list(map(ord, t)) for t in set(texts)]
    level = Counter(tuple(s[i : i + 4]) for s in symbols for i in range(len(s) - 3))
    p = lambda gram: 1 / len({g[-1] for g in level})
    levels = [level]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))
    for counts in reversed(levels):
        d = kneser.discounts(np.array(list(counts.values())))
        total, mass = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            mass[g[:-1]] += d[min(n, 3)]
        p = {g: (n - d[min(n, 3)] + mass[g[:-1]] * (p(g) if callable(p) else p[g[1:]])) / total[g[:-1]] for g, n in counts.items()}
    expected = [-np.mean([np.log(p[tuple(([grams.PAD] * 3 + list(map(ord, t)))[i : i + 4])]) for i in range(len(t))]) for t in texts]
    for travel in (grams.TRAVEL, 20, 0):
        monkeypatch.setattr(grams, "TRAVEL", travel)
        got = judged(spark, texts)
        assert np.allclose([got[i].surprise for i in range(8)], expected, rtol=1e-5)


def test_long_texts_in_pieces(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(500))
    whole = [np.concatenate(c) for c in zip(*grams.gram_parts(["a", "b"], [text, text[:9]]))]
    monkeypatch.setattr(grams, "CHUNK", 7)
    assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*grams.gram_parts(["a", "b"], [text, text[:9]]))))


@pytest.mark.parametrize("words", [kneser.WORDS, 1])
def test_only_texts_that_may_repeat_move(spark, monkeypatch, words):
    monkeypatch.setattr(kneser, "WORDS", words)  # 64 bits: single texts share the bits of repeated ones
    rows = [("en", f"only once {i}") for i in range(300)] + [("de", "only once 7"), ("de", ""), ("fr", None), ("", "x")]
    copies = [("en", "twice")] * 2 + [("en", "hot")] * 500 + [("en", None)] * 2 + [("en", "")] * 2 + [("it", "twice")]
    copies += [("fr", f"copy {i}") for i in range(50)] * 2
    docs = spark.createDataFrame(rows + copies, "model string, text string").repartition(7)
    docs = docs.select("*", F.lit(1).alias("row"), F.md5("text").alias("digest")).localCheckpoint()
    found = [tuple(r) for r in kneser.distinct_texts(docs).collect()]
    assert Counter(found) == Counter(set(rows + copies))

    place = lambda df: df.select("model", "text", F.spark_partition_id().alias("at"))
    read = {(r.model, r.text): r.at for r in place(docs).collect()}
    moved = sum(read[r.model, r.text] != r.at for r in place(kneser.distinct_texts(docs)).collect() if (r.model, r.text) in rows)
    assert moved == 0 if words > 1 else moved < len(rows)


def test_the_table_of_repeated_texts_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(kneser, "WORDS", 16)
    hashed = spark.range(8000).select(F.xxhash64(F.col("id") % 4000).alias("hash"))
    rows = kneser.repeated_bits(hashed).collect()
    assert len(rows) == 16
    assert {(r.word, i) for r in rows for i in range(64) if r.bits >> i & 1} == {
        (r.hash % 16, (r.hash >> 58) % 64) for r in hashed.collect()
    }
