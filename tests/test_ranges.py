from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from passagemill.operators import ranges


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_bounds(spark):
    assert tuple(ranges.id_bounds(ids(spark, [7, 3, 9])).first()) == (3, 9, 7)
    assert tuple(ranges.id_bounds(ids(spark, [])).first()) == (1, 0, 0)


def test_ranges(spark):
    got = lambda values, n: [tuple(r)[1:] for r in ranges.id_ranges(ids(spark, values), n).orderBy("range_id").collect()]
    assert got(range(1, 11), 4) == [(1, 4), (4, 7), (7, 9), (9, 11)]
    assert got([1, 2], 4) == [(1, 2), (2, 3)]
    assert got([], 4) == []


def test_predicates():
    assert ranges.range_predicates(1, 2, 4) == ["id >= 1 AND id < 2", "id >= 2 AND id < 3"]
    assert ranges.range_predicates(1, 0, 4) == []


def test_sample(spark):
    got = lambda values: sorted(r.id for r in ranges.prefix_sample(ids(spark, values)).collect())
    assert got(range(1, 11)) == [1, 2, 3]
    assert got([5]) == [5]
    assert got([1, 100]) == [1]
    assert got([1, 30, 31, 100]) == [1, 30]
    assert got([]) == []


def test_sample_reaches_the_scan(spark, tmp_path):
    ids(spark, range(1000)).write.parquet(str(tmp_path / "t"))
    plan = ranges.prefix_sample(spark.read.parquet(str(tmp_path / "t")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,ScalarSubquery" in text


def test_keyset_page(spark):
    got = ranges.keyset_page(ids(spark, range(0, 100, 3)), 6, 60, 4)
    assert [r.id for r in got.collect()] == [9, 12, 15, 18]


def test_page_counter(spark):
    pages = lambda n: ranges.range_counters(ids(spark, range(1, n + 1)), 1, 100).first().pages
    assert (pages(200), pages(199)) == (3, 2)


def test_empty_range_costs_one_page(spark):
    got = ranges.range_counters(ids(spark, [1, 100]), 4, 10).orderBy("range_id").collect()
    assert [(r.records, r.pages) for r in got] == [(1, 1), (0, 1), (0, 1), (1, 1)]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.sets(st.integers(-300, 2**60), min_size=1, max_size=60), n=st.integers(1, 9), size=st.integers(1, 7))
def test_ranges_cover_and_pages_count(spark, values, n, size):
    df = ids(spark, values)
    table = [tuple(r) for r in ranges.id_ranges(df, n).orderBy("range_id").collect()]
    assert table[0][1] == min(values) and table[-1][2] == max(values) + 1
    assert all(a[2] == b[1] for a, b in zip(table, table[1:]))
    of = {r: (a, b) for r, a, b in table}
    paged = ranges.page_numbers(df, n, size).collect()
    assert sorted(r.id for r in paged) == sorted(values)
    for r, (a, b) in of.items():
        inside = sorted((x.id, x.page) for x in paged if x.range_id == r)
        assert [i for i, _ in inside] == [v for v in sorted(values) if a <= v < b]
        assert [p for _, p in inside] == [i // size for i in range(len(inside))]
    predicates = ranges.range_predicates(min(values), max(values), n)
    assert predicates == [f"id >= {a} AND id < {b}" for _, a, b in table]


def test_dense_ids(spark):
    rows = [(i % 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = ranges.dense_ids(df, ["a", "b"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 501))
    assert [(r.a, r.b) for r in got] == sorted(rows)
    kept = ranges.dense_ids(df, start=10).collect()
    assert sorted(r.id for r in kept) == list(range(10, 510))


def test_dense_ids_with_one_hot_key(spark):
    """A third of the rows share the first sort key; the second spreads them."""
    rows = [(0 if i % 3 == 0 else i, i) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = ranges.dense_ids(df, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows)


def test_dense_ids_follow_the_files(spark, tmp_path):
    """Spark packs files by size; the ids follow their names and lines all the same."""
    sizes = {"a": 3, "b": 3_000, "c": 700, "d": 1}
    for name, n in sizes.items():
        (tmp_path / f"{name}.csv").write_text("x\n" + "".join(f"{name}{i}\n" for i in range(n)))
    rows = spark.read.csv(str(tmp_path), header=True)
    for df in (rows, rows.filter("x != 'b7'").selectExpr("x", "upper(x) as y")):
        numbered = ranges.dense_ids(df)
        assert numbered.columns == ["id", *df.columns]
        expected = [f"{n}{i}" for n, size in sizes.items() for i in range(size) if len(df.columns) == 1 or (n, i) != ("b", 7)]
        assert [r.x for r in sorted(numbered.collect())] == expected
        assert sorted(r.id for r in numbered.collect()) == list(range(1, len(expected) + 1))
