import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from passagemill.llm import lattice, queries

SF = "/root/testdata/sf0.001"


def segmentations(weights, text):
    """The probabilities of all segmentations of a short text, one by one."""
    ((exponent, shift),) = weights.laws
    if not text:
        return [1.0]
    out = []
    for i in range(1, len(text) + 1):
        rank = weights.pieces.get(text[:i])
        if rank is not None:
            out += [math.exp(shift - exponent * rank) * q for q in segmentations(weights, text[i:])]
    if weights.pieces.get(text[0]) is None:
        byte = math.exp(shift - exponent * weights.byte)
        out += [byte ** len(text[0].encode()) * q for q in segmentations(weights, text[1:])]
    return out


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces.read(queries.PIECES)


@pytest.mark.parametrize("word", ["the", "thinking", "a", "żółw", "x🙂y", "été", "͸"])
def test_word_sums_all_segmentations(pieces, word):
    weights = pieces.weights((1.0,), 0.01)
    assert math.isclose(weights.word(word)[0], math.log(sum(segmentations(weights, "▁" + word))), rel_tol=1e-9)


def test_probabilities_of_pieces_bytes_and_end_add_up(pieces):
    weights = pieces.weights((0.7, 1.15), 0.2)
    for a, shift in weights.laws:
        total = sum(math.exp(shift - a * r) for r in weights.pieces.values() if r is not None)
        assert math.isclose(total + 256 * math.exp(shift - a * weights.byte), 0.8, rel_tol=1e-9)


def test_long_words_do_not_underflow(pieces):
    assert -1e7 < pieces.weights((1.0,), 0.01).word("ab" * 20_000)[0] < -1e4


def expected(rows):
    train = Counter()
    for i, text in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            train.update((text or "").encode().translate(lattice.LOWER).split())
            train[None] += 1
    total, distinct = sum(train.values()), len(train)
    out = []
    for i, text in rows:
        tokens = [*(text or "").encode().translate(lattice.LOWER).split(), None]
        base = sum(math.log10((train[t] + 1) / (total + distinct + 1)) for t in tokens)
        out.append((str(i), len(tokens), sum(train[t] > 0 for t in tokens), total, round(base, 6)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def test_query_has_the_base_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.op9_lattice(spark, SF)
    assert got(df) == expected(rows)
    assert all(r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in df.collect())


@pytest.mark.parametrize("hot", [0, 3, 1_000])
def test_scores_do_not_depend_on_what_is_kept_in_memory(spark, pieces, hot):
    texts = ["a b b c", "B C \t d é", None, "", "zz a", "a a a a"] * 3 + ["only here x" * 9_000]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "crc32(cast(doc_id as string)) % 7 = 2 as held_out", "text as word", "text as row", "text as key"
    )
    df = lattice.score(docs, queries.PIECES, hot=hot)
    assert got(df) == expected(rows)
    scores = sorted(r.score for r in df.collect())
    again = sorted(r.score for r in lattice.score(docs, queries.PIECES, hot=max(hot - 1, 0)).collect())
    assert scores == pytest.approx(again, rel=1e-9)


def test_no_training_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    row = lattice.score(docs, queries.PIECES).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0.0
    assert lattice.score(docs.limit(0), queries.PIECES).collect() == []


def test_held_out_scores_are_near_the_base_scores(spark):
    words = [f"{a}{b}" for a in ("gran", "tolv", "mire", "besk", "osta") for b in ("al", "erin", "ovik", "une")]
    text = lambda i: " ".join(words[(i * 7 + j * j) % len(words)] for j in range(40))
    rows = [(i, text(i), i % 3 == 0) for i in range(60)] + [(60, None, True), (61, "x" * 3_000, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    found = {r.doc_id: r for r in lattice.score(docs, queries.PIECES).collect()}
    assert all(math.isfinite(r.score) and r.score < 0 for r in found.values())
    known = [r for r in found.values() if r.held_out and r.doc_id < 60]
    assert known and all(r.score > 1.05 * r.base_score for r in known)


def test_training_documents_without_words(spark):
    rows = [(1, None, False), (2, "", False), (3, "a b", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    assert all(math.isfinite(r.score) and r.score < 0 for r in lattice.score(docs, queries.PIECES).collect())


@pytest.mark.parametrize("word", ["the", "été", "x🙂y", "thinking"])
def test_expected_pieces_are_those_of_all_segmentations(pieces, word):
    law, text = lattice.Law.of(pieces), "▁" + word

    def ways(at):
        if at == len(text):
            yield 1.0, Counter()
            return
        for end, number, p, taken in law.edges(text)[at]:
            for q, used in ways(end):
                yield p * q, used + Counter({number: taken})

    every = list(ways(0))
    total = sum(p for p, _ in every)
    assert math.isclose(law.word(word), math.log(total), rel_tol=1e-9)
    for expect in (law.expect, lambda w, seen: law._expect_long(law.edges(text), len(text), seen)):
        seen = [0.0] * len(law.p)
        expect(word, seen)
        for number in {n for _, used in every for n in used}:
            assert math.isclose(seen[number], sum(p * used[number] for p, used in every) / total, rel_tol=1e-9)
    after = law.learned({i: n for i, n in enumerate(seen) if n})
    assert math.isclose(sum(after.p[:-1]) + 256 * after.p[-1], 1.0, rel_tol=1e-9)
    assert after.word(word) > law.word(word)


def test_many_words_at_once_are_as_each_alone(pieces):
    law = lattice.Law.of(pieces)
    words = ["the", "été", "x🙂y", "a", "", "▁▁a", "͸" * 20, "日本語のテキスト", "a" * 62, "a" * 63, "a" * 64, "ab" * 900]
    assert law.words(pa.array(words)) == pytest.approx([law.word(w) for w in words], rel=1e-12)
    seen, all_seen = [0.0] * len(law.p), np.zeros(len(law.p))
    for word in words:
        law.expect(word, seen)
    law.expect_all(pa.array(words), all_seen)
    law.expect_all(pa.array([], pa.string()), all_seen)
    assert all_seen == pytest.approx(seen, rel=1e-9, abs=1e-12)
    assert len(law.words(pa.array([], pa.string()))) == 0


def test_every_step_takes_all_words(spark, pieces):
    letters = "abcdefghij"
    words = [a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in "stuvwxyz"]
    rows = [(w, i % 3) for i, w in enumerate(words)] + [("x" * 100, 1)]
    law = lattice.Law.of(pieces)
    for _ in range(4):
        seen = [0.0] * len(law.p)
        for word, n in rows:
            if n:
                law.expect(word, seen)
        law = law.learned({i: n for i, n in enumerate(seen) if n})
    counts = spark.createDataFrame(rows, "word string, n long")
    fitted = lattice.fit(pieces, counts, sum(n > 0 for _, n in rows))
    assert fitted.p == pytest.approx(law.p, rel=1e-6, abs=1e-10)
