import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.functions import vectors as V
from passagemill.operators import search
from passagemill.operators.cells import Hyperplanes, InvertedLists
from passagemill.operators.search import top_k, top_k_one

KEY = ("id",)


def store_of(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def random_store(spark, n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    data = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    return store_of(spark, [(i, [float(x) for x in v]) for i, v in enumerate(data)])


def queries_of(store):
    return store.select(F.col("id").alias("query_id"), "embedding")


def hits(df):
    return {(r.query_id, r.rank, r.id, None if r.distance is None else round(r.distance, 6)) for r in df.collect()}


def pairs(df):
    return {(q, i) for q, _, i, _ in hits(df)}


def brute(store, queries, k):
    s = [(r.id, np.array(r.embedding, dtype=float)) for r in store.collect()]
    out = set()
    for q in queries.collect():
        v = np.array(q.embedding, dtype=float)
        d = sorted(
            (round(1 - v @ x / np.sqrt((v @ v) * (x @ x)), 9) + 0.0, i) for i, x in s
        )
        out |= {(q.query_id, n + 1, i, round(x, 6)) for n, (x, i) in enumerate(d[:k])}
    return out


def test_checks(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, None]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [])]
    df = store_of(spark, rows)
    got = df.select(
        "id",
        V.is_zero_vector("embedding").alias("zero"),
        V.has_null_element("embedding").alias("hole"),
        V.fit_dimension("embedding", 2).alias("fit"),
        V.reject_reason("embedding", 2).alias("why"),
    ).orderBy("id").collect()
    assert [r.zero for r in got] == [True, False, False, None, False, True]
    assert [r.hole for r in got] == [False, True, False, None, False, False]
    assert [r.fit for r in got][2:] == [[1.0, 0.0]] + [[0.0, 0.0]] * 3
    assert [r.why for r in got] == [
        "zero vector", "null element", None, "missing vector", "wrong dimension", "wrong dimension",
    ]


@pytest.mark.parametrize("measure", [V.cosine_distance, V.batch_cosine_distance])
def test_distance(spark, measure):
    rows = [
        (1, [1.0, 0.0], [0.0, 2.0]), (2, [1.0, 1.0], [2.0, 2.0]), (3, [1.0, 0.0], [-3.0, 0.0]),
        (4, [0.0, 0.0], [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, [1.0, None], [1.0, 0.0]),
        (7, [1.0], [1.0, 0.0]), (8, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]),
    ]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>").coalesce(1)
    got = [r.d for r in df.select("id", measure("a", "b").alias("d")).orderBy("id").collect()]
    assert got[:3] == pytest.approx([1, 0, 2]) and got[7] == pytest.approx(0)
    assert math.isnan(got[3]) and got[4:7] == [None] * 3


def test_exact_search_equals_brute_force(spark):
    store = random_store(spark)
    queries = queries_of(store)
    want = brute(store, queries, 4)
    assert hits(top_k(store, queries, 4, key=KEY)) == want
    sliced = top_k(store, queries, 4, key=KEY, max_broadcast_queries=70)
    assert hits(sliced) == want


def test_own_number_of_hits_per_query(spark):
    store = random_store(spark, 20)
    queries = queries_of(store).filter("query_id < 3").withColumn("k", (F.col("query_id") * 2 + 1).cast("int"))
    got = hits(top_k(store, queries, key=KEY))
    assert [sum(q == i for q, *_ in got) for i in range(3)] == [1, 3, 5]


def test_rows_without_a_direction_come_last(spark):
    store = store_of(
        spark, [(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, None]), (6, [1.0])]
    )
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, embedding array<float>")
    got = top_k(store, queries, 6, key=KEY).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, i) for i in (3, 4, 2, 1, 5, 6)]
    assert [r.distance for r in got][:2] == [0, 1]
    assert math.isnan(got[2].distance) and [r.distance for r in got][3:] == [None] * 3
    assert [r.id for r in top_k(store, queries, 3, key=KEY).orderBy("rank").collect()] == [3, 4, 2]
    one = top_k_one(store, [1.0, 0.0], 4, key=KEY).collect()
    assert [r.id for r in one] == [3, 4, 2, 1] and math.isnan(one[2].distance)
    assert top_k_one(store, [0.0, 0.0], 4, key=KEY).collect() == []


def test_a_third_of_the_rows_are_copies(spark):
    """Equal distances are ranked by key, however many there are."""
    rows = [(i, [1.0, 0.0] if i % 3 else [float(i), 1.0]) for i in range(900)]
    store = store_of(spark, rows).repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<float>")
    want = brute(store, queries, 7)
    assert hits(top_k(store, queries, 7, key=KEY)) == want
    assert hits(top_k(store, queries, 7, key=KEY, max_broadcast_queries=1)) == want


def test_further_columns(spark):
    store = random_store(spark, 50).withColumn("chunk_text", F.concat(F.lit("t"), "id"))
    got = top_k(store, queries_of(store), 2, key=KEY, columns=("chunk_text",)).collect()
    assert len(got) == 100 and all(r.chunk_text == f"t{r.id}" for r in got)
    one = top_k_one(store, store.first().embedding, 3, key=KEY, columns=("chunk_text",)).collect()
    assert [r.distance for r in one] == sorted(r.distance for r in one)
    assert all(r.chunk_text == f"t{r.id}" for r in one)


def test_no_usable_query(spark):
    store = random_store(spark, 5)
    none = queries_of(store).filter("query_id < 0")
    assert top_k(store, none, 2, key=KEY).collect() == []


def test_queries_of_different_dimensions_are_an_error(spark):
    store = random_store(spark, 5)
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id int, embedding array<float>")
    with pytest.raises(ValueError):
        top_k(store, mixed, 2, key=KEY)


def test_one_query_is_answered_without_sorting_the_store(spark):
    plan = top_k_one(random_store(spark, 5), [1.0] * 8, 2, key=KEY)
    assert "TakeOrderedAndProject" in plan._jdf.queryExecution().executedPlan().toString()


def test_inverted_lists(spark, tmp_path, monkeypatch):
    store = random_store(spark, 400)
    queries = queries_of(store)
    exact = hits(top_k(store, queries, 5, key=KEY))
    lists = InvertedLists.fit(store, 6)
    assert hits(lists.top_k(store, queries, 5, nprobe=6, key=KEY)) == exact
    near = lists.top_k(store, queries, 5, nprobe=2, key=KEY)
    assert len(pairs(near) & {(q, i) for q, _, i, _ in exact}) / len(exact) > 0.9
    sliced = lists.top_k(store, queries, 5, nprobe=2, key=KEY, max_broadcast_queries=50)
    assert hits(sliced) == hits(near)

    root = str(tmp_path / "cells")
    lists.write(store, root)
    written = lists.read(spark, root)
    assert written.count() == 400
    assert hits(lists.top_k(written, queries, 5, nprobe=2, key=KEY)) == hits(near)
    monkeypatch.setattr(search, "_ranked", kept_plans := Plans(search._ranked))
    lists.top_k(written, queries.filter("query_id = 0"), 5, nprobe=2, key=KEY)
    assert "PartitionFilters: [isnotnull(cell" in kept_plans.seen[0] or "PartitionFilters: [cell" in kept_plans.seen[0]


class Plans:
    """Notes the plan of every block's scan."""

    def __init__(self, ranked):
        self.ranked, self.seen = ranked, []

    def __call__(self, found, *rest):
        self.seen.append(found._jdf.queryExecution().executedPlan().toString())
        return self.ranked(found, *rest)


def test_many_queries_sweep_in_blocks_over_a_store_that_is_not_shuffled(spark, monkeypatch):
    store = random_store(spark, 500).repartition(20).persist()
    queries = queries_of(store)
    want = hits(top_k(store, queries, 3, key=KEY))
    monkeypatch.setattr(search, "BOUND_ROWS", 40)
    monkeypatch.setattr(search, "_ranked", plans := Plans(search._ranked))
    got = top_k(store, queries, 3, key=KEY, max_broadcast_queries=90)
    assert hits(got) == want and len(plans.seen) == 6
    for plan in plans.seen:
        assert "Exchange" not in plan.split("InMemoryTableScan")[0] and "Join" not in plan and "Generate" not in plan
    monkeypatch.setattr(search, "MAX_BROADCAST_BYTES", 8 * (8 * 8 + 4 + 16))
    plans.seen.clear()
    few = queries.filter("query_id < 20")
    assert {h for h in want if h[0] < 20} == hits(top_k(store, few, 3, key=KEY)) and len(plans.seen) == 3


def test_first_bounds_cut_what_tasks_hand_on(spark):
    store = random_store(spark, 2000).collect()
    table = lambda rows, **more: pa.table({
        "id": pa.array([r.id for r in rows]), "embedding": pa.array([r.embedding for r in rows], pa.list_(pa.float32())), **more
    })
    asked = table(store[:10], k=pa.array([3] * 10)).rename_columns(["query_id", "embedding", "k"])
    block = search._build_block(asked, "query_id", None, None)
    bound = search._first_bounds(block, table(store[:400]), KEY)
    part = table(store[1900:]).to_batches()
    loose = search.scan_batches(block, part, KEY)
    block.bound = bound
    tight = search.scan_batches(block, part, KEY)
    assert loose.num_rows == 30 and (tight is None or tight.num_rows < 15)
    whole = search.scan_batches(block, table(store).to_batches(), KEY)
    block.bound = None
    assert whole.equals(search.scan_batches(block, table(store).to_batches(), KEY))


def test_lloyd_steps_do_not_depend_on_partitions_and_equal_plain_steps(spark):
    bad = store_of(spark, [(1000, None), (1001, [0.0] * 8), (1002, [1.0])])
    store = random_store(spark, 300).union(bad)
    start = store.filter("id < 5").select((9 - F.col("id")).alias("cell"), "embedding")
    lists = InvertedLists.lloyd(store, start, 3)
    assert (lists.centroids == InvertedLists.lloyd(store.repartition(7), start, 3).centroids).all()
    unit = np.array([r.embedding for r in store.filter("id < 1000").orderBy("id").collect()])
    unit = unit / np.sqrt((unit**2).sum(axis=1))[:, None]
    centroids = unit[4::-1].copy()
    for _ in range(3):
        at = ((unit[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(5):
            if (at == c).any():
                centroids[c] = unit[at == c].mean(axis=0)
    assert np.abs(centroids - lists.centroids).max() < 1e-5
    twice = start.union(start.withColumn("cell", F.col("cell") + 100))  # the lower of equal ones gets all
    assert (InvertedLists.lloyd(store, twice, 1).centroids[5:] == InvertedLists.lloyd(store, start, 0).centroids).all()
    with pytest.raises(ValueError, match="direction"):
        InvertedLists.lloyd(store, bad.filter("id = 1001").select(F.col("id").alias("cell"), "embedding"))


def test_an_index_stays_with_its_store(spark, tmp_path):
    root, bad = str(tmp_path / "cells"), store_of(spark, [(1000, None), (1001, [0.0] * 8), (1002, [1.0])])
    store = random_store(spark, 300)
    queries = queries_of(store)
    start = store.filter("id < 6").select(F.col("id").alias("cell"), "embedding")
    lists = InvertedLists.lloyd(store, start)
    want = hits(lists.top_k(store, queries, 5, nprobe=2, key=KEY))
    lists.write(store.filter("id < 100"), root)
    for part in ("id between 100 and 150", "id > 150"):
        InvertedLists.load(spark, root).append(store.filter(part), root)
    again = InvertedLists.load(spark, root)
    again.append(bad, root)
    rows = again.read(spark, root)
    assert rows.count() == 303 and {r.id for r in rows.filter("cell = -1").collect()} == {1000, 1001, 1002}
    assert hits(again.top_k(rows, queries, 5, nprobe=2, key=KEY)) == want
    other = InvertedLists.lloyd(store, start, 1)
    for act in (lambda: other.append(store, root), lambda: other.read(spark, root)):
        with pytest.raises(ValueError, match="not placed by these centroids"):
            act()
    other.write(store.filter("id < 20"), root)
    assert InvertedLists.load(spark, root).read(spark, root).count() == 20
    with pytest.raises(ValueError, match="not placed"):
        again.read(spark, root)
    with pytest.raises(FileNotFoundError):
        InvertedLists.load(spark, str(tmp_path / "none"))


def test_index_leaves_out_rows_without_a_direction(spark):
    good = random_store(spark, 60)
    bad = store_of(spark, [(1000, None), (1001, [0.0] * 8), (1002, [1.0])])
    store, queries = good.union(bad), queries_of(good).filter("query_id < 5")
    lists = InvertedLists.fit(store, 3, dim=8)
    assert lists.assign(store).filter("cell IS NULL").count() == 3
    for sizes in ({}, {"max_broadcast_queries": 2}):
        assert max(i for _, i in pairs(lists.top_k(store, queries, 100, nprobe=3, key=KEY, **sizes))) < 60
        assert max(i for _, i in pairs(Hyperplanes(8).top_k(store, queries, 100, key=KEY, **sizes))) < 60


def test_hyperplanes(spark):
    store = random_store(spark, 400)
    queries = queries_of(store)
    exact = pairs(top_k(store, queries, 5, key=KEY))
    planes = Hyperplanes(8, tables=6, bits=6)
    near = planes.top_k(store, queries, 5, key=KEY)
    assert len(pairs(near) & exact) / len(exact) > 0.9
    sliced = planes.top_k(store, queries, 5, key=KEY, max_broadcast_queries=50)
    assert hits(sliced) == hits(near)
    # Every candidate's rank is among the query's candidates, each met once.
    assert len(hits(near)) == len(pairs(near))
    everything = Hyperplanes(8, tables=1, bits=2, flips=2)
    assert pairs(everything.top_k(store, queries, 5, key=KEY)) == exact


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 1000), k=st.integers(1, 12), many=st.integers(7, 60))
def test_blocks_equal_one_block(spark, seed, k, many):
    store = random_store(spark, 60, dim=3, seed=seed)
    queries = queries_of(store)
    want = hits(top_k(store, queries, k, key=KEY))
    assert hits(top_k(store, queries, k, key=KEY, max_broadcast_queries=many)) == want


def test_one_hot_cell(spark):
    """A third of the rows are copies and share every cell; whatever the blocks."""
    good = random_store(spark, 200)
    copies = spark.range(1000, 1100).select("id", F.array(*[F.lit(float(i)).cast("float") for i in range(8)]).alias("embedding"))
    store = good.union(copies)
    queries = queries_of(store).filter("query_id % 20 = 0")
    small = {"max_broadcast_queries": 3}
    for search in (InvertedLists.fit(store, 4).top_k, Hyperplanes(8, tables=3, bits=4).top_k):
        want = hits(search(store, queries, 6, key=KEY))
        assert hits(search(store, queries, 6, key=KEY, **small)) == want
        first = sorted(i for q, rank, i, _ in want if q == 1040)
        assert first == list(range(1000, 1006))


def test_reject_reason_of_values_that_are_not_finite(spark):
    rows = [([1.0, 2.0],), ([float("nan"), 1.0],), ([1e300, 1.0],), ([1.0, float("-inf")],)]
    got = spark.createDataFrame(rows, "e array<double>").select(V.reject_reason("e", 2).alias("r")).collect()
    assert [r.r for r in got] == [None] + ["not finite"] * 3


def test_mixed_lengths_are_refused_alike(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="2 to 3"):
        InvertedLists.fit(store, 1)
    asked = store.withColumnRenamed("vec_id", "query_id")
    for most in (10, 1):
        with pytest.raises(ValueError, match="one length"):
            top_k(store.limit(1), asked, 1, key=("vec_id",), max_broadcast_queries=most)


def test_many_small_blocks_share_sweeps(spark, monkeypatch):
    store = random_store(spark, 120)
    queries = queries_of(store)
    want = hits(top_k(store, queries, 3, key=KEY))
    monkeypatch.setattr(search, "_ranked", plans := Plans(search._ranked))
    assert hits(top_k(store, queries, 3, key=KEY, max_broadcast_queries=2)) == want
    assert len(plans.seen) <= 10  # 60 blocks
    want = hits(Hyperplanes(8).top_k(store, queries, 3, key=KEY))
    assert hits(Hyperplanes(8).top_k(store, queries, 3, key=KEY, max_broadcast_queries=2)) == want


def test_a_batch_hands_on_k_rows_a_query(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 16))
    vectors[1000:1500] = vectors[7]  # copies of one, farther than k of them
    table = pa.table({"id": np.arange(3000), "embedding": pa.array(list(vectors), pa.list_(pa.float64()))})
    asked = table.slice(0, 40).rename_columns(["query_id", "embedding"]).append_column("k", pa.array([4] * 40))
    block = search._build_block(asked, "query_id", None, None)
    met, keep = [], search._keep_nearest
    monkeypatch.setattr(search, "_TILE", 12_000)
    monkeypatch.setattr(search, "_keep_nearest", lambda rows, *rest: met.append(rows.num_rows) or keep(rows, *rest))
    found = search.scan_batches(block, table.to_batches(max_chunksize=1000), KEY)
    assert max(met) <= 2 * 4 * 40
    d = np.round(1 - block.unit @ (vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]).T, 9)
    want = [sorted((x, i) for i, x in enumerate(row))[:4] for row in d]
    got = list(zip(found.column("distance").to_pylist(), found.column("id").to_pylist()))
    assert [got[4 * q : 4 * q + 4] for q in range(40)] == [[(pytest.approx(x), i) for x, i in row] for row in want]


@pytest.mark.parametrize("tile, tile_rows, pairs", [(60, 7, 10), (4_000, 64, 200_000), (1, 1, 1)])
def test_tiles_part_the_rows_of_a_batch(monkeypatch, tile, tile_rows, pairs):
    rng = np.random.default_rng(5)
    vectors = list(rng.normal(size=(300, 8)))
    vectors[40:140] = [vectors[3]] * 100  # copies of one, in many tiles
    vectors[20], vectors[150], vectors[299] = np.zeros(8), np.zeros(8), None
    table = pa.table({"id": np.arange(300), "embedding": pa.array(vectors, pa.list_(pa.float64()))})
    asked = pa.table({"query_id": np.arange(12), "embedding": pa.array(vectors[:12], pa.list_(pa.float64()))})
    block = search._build_block(asked.append_column("k", pa.array([3, 300] * 6)), "query_id", None, None)
    want = search.scan_batches(block, table.to_batches(), KEY)
    made, of = [], search._Room.of
    monkeypatch.setattr(search._Room, "of", lambda room, q, r: made.append((q * r, r)) or of(room, q, r))
    monkeypatch.setattr(search, "_TILE", tile)
    monkeypatch.setattr(search, "_TILE_ROWS", tile_rows)
    monkeypatch.setattr(search, "_PAIRS", pairs)
    assert search.scan_batches(block, table.to_batches(max_chunksize=170), KEY).equals(want)
    assert max(size for size, _ in made) <= max(tile, tile_rows) and max(r for _, r in made) <= tile_rows
    unit = block.unit @ np.array([v / (np.linalg.norm(v) or 1) if v is not None else np.zeros(8) for v in vectors]).T
    place = [0 if v is not None and any(v) else 3 + (v is None) for v in vectors]
    d = np.where(np.array(place) > 0, np.array(place), np.round(1 - unit, 9))
    for q in range(12):
        best = sorted((x, i) for i, x in enumerate(d[q]))[: 3 if q % 2 == 0 else 300]
        rows = want.filter(pc.equal(want.column("q"), q))
        assert rows.column("id").to_pylist() == [i for _, i in best]
