"""Spelling variants against plain Python: composition, dealing by state, counts, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from passagemill.llm import variants as v
from passagemill.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    p = 0
    while p < len(x) and x[p] == y[p]:
        p += 1
    if len(x) == len(y):
        return x != y and x[p + 1 :] == y[p + 1 :]
    return len(y) == len(x) + 1 and x[p:] == y[p + 1 :]


def near(words):
    words = list(words)
    return {w: {o for o in words if one_edit(w, o)} for w in words}


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(docs):
    n = counted(docs)
    beside = near(n)
    form = {}
    for w in n:
        best = min(beside[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(beside[w]), n.get(form[w])) for w in n}


def vocabulary(rng, alphabet, size, least, most):
    return sorted({"".join(rng.choices(alphabet, k=rng.randint(least, most))) for _ in range(size)})


@pytest.mark.parametrize("seed", range(40))
def test_composition_finds_every_pair_once_whatever_the_stretches(seed):
    rng = random.Random(seed)
    words = vocabulary(rng, "ab" if seed % 3 == 0 else "abcé", rng.randint(2, 150), 3, 8)
    n = {w: rng.randint(1, 5) for w in words}
    rows = []
    for m in range(3, 9):
        cuts = [0] + sorted(rng.sample(range(1, m + 1), rng.randint(0, m))) + [m + 1]
        for lo, hi in zip(cuts, cuts[1:]):
            rows += [(m, lo, hi, w[:lo] + "|" + w[len(w) - max(m - hi, 0) :], w)
                     for w in words if len(w) in (m, m + 1)]
    rows.sort()
    group = np.cumsum([0] + [a[:4] != b[:4] for a, b in zip(rows, rows[1:])])
    column = lambda i: np.array([r[i] for r in rows])
    number, best = v._chunk(
        [r[4].encode("latin-1") for r in rows], np.array([n[r[4]] for r in rows]), group, *map(column, range(3))
    )
    total, first = Counter(), {}
    for i, r in enumerate(rows):
        total[r[4]] += int(number[i])
        if number[i]:
            other = rows[best[i]][4]
            first[r[4]] = min(first.get(r[4], (0, "")), (-n[other], other))
    want = near(words)
    assert {w: total[w] for w in words} == {w: len(o) for w, o in want.items()}
    assert first == {w: min((-n[o], o) for o in os) for w, os in want.items() if os}


def test_acceptor_is_minimal():
    words = [a + b + c for a in (b"a", b"b") for b in (b"xy", b"xz", b"yy") for c in (b"in", b"on")]
    letters = np.array(sorted(words), "S5").view(np.uint8).reshape(len(words), 5)
    first = np.zeros(len(words), bool)
    first[0] = True
    found = v.Acceptor(letters, np.full(len(words), 5), first)
    # n | in, on | y or z before these: one state, and one more for yy | a and b lead to one state.
    assert [len(np.unique(s)) for s in found.states] == [1, 1, 1, 2, 1, 1]
    assert found.number == [1, 1, 1, 2, 1, 1]


@pytest.mark.parametrize("letters", [v.PARTITION_LETTERS, 300, 40])
def test_hot_states_are_split_and_no_pair_is_lost(spark, letters):
    rng = random.Random(letters)
    words = vocabulary(rng, "ab", 400, 7, 9) + ["stately" + w for w in vocabulary(rng, "abc", 300, 1, 4)]
    words += [w + "ending" for w in vocabulary(rng, "abc", 200, 1, 4)]
    n = {w: rng.randint(2, 60) for w in set(words) if len(w) >= 7}
    scratch = Scratch(spark, "test")
    table = scratch.keep(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    got = {r.word: r for r in v.near_words(table, scratch, letters).collect()}
    want = {w: o for w, o in near(n).items() if o}
    assert {w: r.n_near for w, r in got.items()} == {w: len(o) for w, o in want.items()}
    assert {w: (r.best_n, r.best) for w, r in got.items()} == {
        w: min(((-n[x], x) for x in o)) and (n[min(o, key=lambda x: (-n[x], x))], min(o, key=lambda x: (-n[x], x)))
        for w, o in want.items()
    }
    items = v.partitions(table, scratch, letters).groupBy("m", "lo", "hi", "state").count().collect()
    assert all((r.m + 1) * r["count"] <= letters or r.hi - r.lo == 1 for r in items)


def texts(rng):
    stem = ["planting", "planning", "pläntingß", "platings", "Stations", "station", "aaaaaaa", "aaaaaaaa"]
    weights = [400, 40, 4, 4, 200, 20, 100, 6]
    docs = [(i, " ".join(rng.choices(stem, weights, k=rng.randint(0, 60)))) for i in range(60)]
    noise = ["".join(rng.choices("abcÿ÷", k=rng.randint(5, 9))) for _ in range(300)]
    docs += [(i, "; ".join(rng.choices(noise, k=40))) for i in range(60, 90)]
    docs += [(100 + i, "gardener " * 300 + "gardeners " * 10 + "gardenerss" * (i % 5 == 0)) for i in range(20)]
    return docs + [(90, None), (91, ""), (None, "planting planting"), (5, docs[5][1]), (5, docs[5][1])]


def test_query_equals_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    docs = texts(random.Random(1))
    rows = [(i, t, "x", "y", 1, "z") for i, t in docs]
    schema = "doc_id long, text string, word string, state string, n int, form string"
    got = {tuple(r) for r in v.variants(spark.createDataFrame(rows, schema)).collect()}
    assert got == brute(docs)
    # Chains of more than one step are among them.
    assert any(r[1] != r[2] for r in got if r[1])


def test_chains_are_followed_to_the_end(spark):
    chain = [f"w{i:02d}" for i in range(19)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    got = {r.word: r.root for r in v.roots(forms, Scratch(spark, "test")).collect()}
    assert got == dict.fromkeys(chain[:-1], chain[-1])


def test_empty_table_and_very_long_texts_and_runs(spark):
    assert v.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "".join(random.Random(2).choices("abcdefgh", k=100_000))
    docs = [(1, long), (2, long), (3, long[:50_000] + long[50_001:]), (4, long[:50_000] + long[50_001:]),
            (5, "harvested " * 200_000)]
    got = {tuple(r) for r in v.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
