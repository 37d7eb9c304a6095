import random

import pytest

from passagemill.llm import neardup
from passagemill.llm.common import Scratch, WordHashes
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def result(df):
    return sorted((r.doc_id, (r.n_shingles, r.component_id, r.kept)) for r in df.collect())


def test_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(neardup.near_duplicates(docs)) == sorted(brute.near_duplicates(rows).items())


def chain(n_words, step, n):
    """Texts each near to the next one only, and to no other."""
    rng = random.Random(3)
    words = [f"w{rng.random()}" for _ in range(n_words + step * n)]
    return [" ".join(words[i * step : i * step + n_words]) for i in range(n)]


def test_chains_groups_and_shared_passages(spark):
    """A chain of links, 300 near copies in one bucket, and texts that share half of their words."""
    rng = random.Random(5)
    rows = list(enumerate(chain(200, 20, 12)))
    base = [f"b{i}" for i in range(120)]
    for _ in range(300):
        own = list(base)
        own[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((len(rows), " ".join(own)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(len(rows) + i, passage + " " + " ".join(f"q{i}.{j}" for j in range(60))) for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(neardup.near_duplicates(docs)) == sorted(brute.near_duplicates(rows).items())


def test_open_buckets_meet_in_blocks(spark, monkeypatch):
    """Small blocks: pairs are still found across them, in buckets of several components."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = list(enumerate(chain(120, 12, 40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(docs)) == sorted(brute.near_duplicates(rows).items())


def test_nulls_repeats_ties_and_clashing_columns(spark):
    rows = [
        (1, "a b c", "k1"), (2, "A\tB  c", None), (3, None, "k"), (4, "", "k"), (5, " \n ", "k"),
        (6, "a b c d e f", "k"), (7, "a b", "k"), (7, "a b", "k"), (None, "a b c", "k"),
        (9, "x " * 50_000, "k"), (10, "x " * 49_999, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").selectExpr(
        "*", "component as node", "component as band", "component as kept"
    )
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str) == sorted(
        [
            (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
            (6, 2, 6, True), (7, 1, 7, True), (7, 1, 7, True), (None, 1, None, True),
            (9, 1, 9, True), (10, 1, 9, False),
        ],
        key=str,
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long")
    found = neardup.components(links, Scratch(spark, "t"), "cc").collect()
    assert {(r.node, r.component) for r in found} == {(n, min(min(e) for e in edges)) for e in edges for n in e}


def test_odd_sketch_estimates_similarity():
    """The population count of two texts at the threshold stays below the limit."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        union = rng.integers(0, 2**63, 800).astype(np.uint64)
        a, b = np.unique(union[:700]), np.unique(union[100:])  # 600 of 800
        x, y = (neardup.odd_sketch(neardup.minhash(s)).view(np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= neardup.LIMIT


def test_set_sketches_fold_and_keep_pairs_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(2)
    for n, m in ((140, 140), (1_400, 1_400), (14_000, 14_000), (9_100, 7_000)):
        for _ in range(40):
            shared = round(3 * (n + m) / 7)  # three quarters of the union
            union = rng.integers(0, 2**63, n + m - shared).astype(np.uint64)
            a, b = np.unique(union[:n]), np.unique(union[n - shared :])
            x, y = neardup.set_sketch(a), neardup.set_sketch(b)
            for bits in {8 * min(len(x), len(y)), neardup.BITS}:
                odd = neardup.folded(x, bits) ^ neardup.folded(y, bits)
                assert np.bitwise_count(odd).sum() <= neardup.set_limit(np.float64(n + m), bits)
            far = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            bits = 8 * min(len(x), len(y))
            odd = neardup.folded(x, bits) ^ neardup.folded(neardup.set_sketch(far), bits)
            assert np.bitwise_count(odd).sum() > neardup.set_limit(np.float64(2 * n), bits)


def test_the_full_sets_sieve_loses_less_than_the_bands():
    """At the threshold: six deviations above the exact mean of odd places (1e-9), the bands lose 2e-5."""
    for n, bits in ((400, 512), (2_000, 512), (4_000, 1_024)):
        differ = n * (100 - neardup.THRESHOLD) / (100 + neardup.THRESHOLD)
        odd = (1 - (1 - 2 / bits) ** differ) / 2
        mean = bits * odd
        # Two places are both odd:
        both = (1 - 2 * (1 - 2 / bits) ** differ + (1 - 4 / bits) ** differ) / 4
        deviation = (bits * odd * (1 - odd) + bits * (bits - 1) * (both - odd**2)) ** 0.5
        assert neardup.set_limit(neardup.np.float64(n), bits) >= mean + 5.5 * deviation


def _edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block, windows", [(256, 1 << 18), (5, 1 << 18), (256, 300)])
def test_many_texts_just_below_the_threshold_in_blocks_of_any_size(spark, monkeypatch, block, windows):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_WINDOWS", windows)
    rng = random.Random(block + windows)
    origin = [f"w{rng.randint(0, 5000)}" for _ in range(90)]
    rows = [(i, _edited(rng, origin, rng.choice([1, 2, 3, 4, 5]))) for i in range(70)]
    rows += [(1000 + i, _edited(rng, rows[i][1].split(), 1)) for i in range(15)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(rows)


def test_a_unit_gives_a_spanning_forest_of_its_links():
    rng = random.Random(8)
    origin = [f"w{i}" for i in range(60)]
    hashes = WordHashes()
    rows = []
    for i in range(40):
        text = _edited(rng, origin, rng.choice([0, 1, 2, 3, 9]))
        rows.append((i % 2, i, i, neardup.shingle_set(text.encode(), hashes)))
    for members in (rows, [(0, *r[1:]) for r in rows]):
        links = [
            (a[1], b[1]) for a in members for b in members if a[1] < b[1]
            and (a[0] != b[0] or not any(r[0] for r in members))
            and 100 * len(set(a[3]) & set(b[3])) >= 75 * len(set(a[3]) | set(b[3]))
        ]
        got = list(neardup._linked_in_unit(members))
        groups = lambda pairs: {i: min(_reach(i, pairs)) for i in range(40)}
        assert set(got) <= set(links) and groups(got) == groups(links)
        assert len(got) == 40 - len(set(groups(links).values())) < len(links)


def _reach(start, pairs):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            for one, other in ((a, b), (b, a)):
                if one == x and other not in seen:
                    seen.add(other), todo.append(other)
    return seen
