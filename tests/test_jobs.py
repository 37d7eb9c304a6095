import pytest
from pyspark.sql import functions as F

from passagemill.functions.embedding import HashedEmbedder
from passagemill.operators.prompts import EMPTY_MESSAGE, admit, context_sections, prompts
from passagemill.plans.answer import answer, search_text
from passagemill.plans.ingest import embed_chunks, ingest, read_ledger, run_metrics
from passagemill.sources.instructions import raw_text, read_instruction_csv
from passagemill.sources.raw import append_raw, as_raw, read_raw, reset_raw
from passagemill.sources.store import (
    append_embeddings,
    create_store,
    read_outcomes,
    read_rejects,
    read_store,
    reset_store,
    write_by_parent,
    write_by_source,
)
from passagemill.streaming.ingest import ingest_stream, only_new

DIM = 16
EMBED = HashedEmbedder(DIM)


def raw_of(spark, rows):
    return spark.createDataFrame(rows, "raw_data_id long, raw_text string, source string")


RAW = [
    (1, "One fish. Two fish! " * 60, "a"),
    (2, " \n", "a"),
    (3, None, "b"),
    (4, "...", "b"),
    (5, "Red fish? Blue fish", "b"),
]


def chunks_of(df):
    return sorted((r.raw_data_id, r.chunk_index, r.chunk_text, tuple(r.embedding)) for r in df.collect())


# --- CSV


def write_csv(path, text):
    path.write_text(text)
    return str(path)


def test_csv_header_names(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", "Instruction,input,INPUT,output,x\na,b,c,d,e\n")
    assert [tuple(r) for r in read_instruction_csv(spark, path).collect()] == [("a", "c", "d")]
    path = write_csv(tmp_path / "b.csv", "output,INSTRUCTION,Input\n1,2,3\n")
    assert [tuple(r) for r in read_instruction_csv(spark, path).collect()] == [("2", "3", "1")]


def test_csv_without_a_needed_column(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", "instruction,input,answer\na,b,c\n")
    with pytest.raises(ValueError, match="output"):
        read_instruction_csv(spark, path)
    with pytest.raises(ValueError, match="header"):
        read_instruction_csv(spark, write_csv(tmp_path / "b.csv", ""))


def test_csv_body(spark, tmp_path):
    body = 'instruction,input,output\n"a, ""b""\nc",,d\ne\nf,g,h,too much\n,,\n" ", ,\t\n'
    path = write_csv(tmp_path / "a.csv", body)
    rows = [tuple(r) for r in read_instruction_csv(spark, path).collect()]
    assert rows[:3] == [('a, "b"\nc', "", "d"), ("e", "", ""), ("f", "g", "h")]
    texts = [r.raw_text for r in raw_text(read_instruction_csv(spark, path)).collect()]
    assert texts == ['a, "b"\nc  d', "e", "f g h"]


def test_csv_files_with_other_headers_are_an_error(spark, tmp_path):
    (tmp_path / "t").mkdir()
    write_csv(tmp_path / "t" / "a.csv", "instruction,input,output\n1,2,3\n")
    write_csv(tmp_path / "t" / "b.csv", "output,input,instruction\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_instruction_csv(spark, str(tmp_path / "t")).collect()


# --- raw table


def test_raw_ids_go_on_and_restart(spark, tmp_path):
    path = str(tmp_path / "raw")
    texts = spark.createDataFrame([(c,) for c in "abc"], "raw_text string")
    for _ in range(2):
        append_raw(texts, path, ["raw_text"])
    got = [(r.raw_data_id, r.raw_text) for r in read_raw(spark, path).orderBy("raw_data_id").collect()]
    assert got == list(enumerate("abcabc", 1))
    reset_raw(spark, path)
    assert read_raw(spark, path).count() == 0
    append_raw(texts, path, ["raw_text"])
    assert read_raw(spark, path).agg(F.max("raw_data_id")).first()[0] == 3


def test_raw_table_prunes_columns(spark, tmp_path):
    spark.createDataFrame([(1, "t", "s", 9)], "id long, text string, origin string, n int").write.parquet(
        str(tmp_path / "t")
    )
    plan = as_raw(spark.read.parquet(str(tmp_path / "t")), "id", "text").select("raw_data_id", "raw_text")
    assert "ReadSchema: struct<id:bigint,text:string>" in plan._jdf.queryExecution().toString()


# --- ingest


def test_ingest(spark, tmp_path):
    root, ledger = str(tmp_path / "store"), str(tmp_path / "ledger")
    run = ingest(raw_of(spark, RAW), root, EMBED, dim=DIM, ledger=ledger)
    want = embed_chunks(raw_of(spark, RAW), EMBED, dim=DIM)
    store = read_store(spark, root)
    assert chunks_of(store) == chunks_of(want) and store.count() == 4
    assert store.filter("created_at IS NULL").count() == 0
    assert {r.source for r in store.filter("raw_data_id = 5").collect()} == {"b"}
    assert run.counts == {"records": 5, "blank": 2, "chunks": 4, "stored": 4, "rejected": 0}
    row = read_ledger(spark, ledger).first()
    assert (row.run_id, row.status, row.read_count, row.write_count) == (run.run_id, "COMPLETED", 5, 4)
    assert row.started_at <= row.ended_at
    metrics = {(r.stage, r.metric): r.value for r in run_metrics(read_ledger(spark, ledger)).collect()}
    assert metrics[("read", "filter_count")] == 2 and metrics[("embed", "skip_count")] == 0


def test_ingest_of_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    run = ingest(raw_of(spark, []), root, EMBED, dim=DIM)
    assert run.counts["records"] == 0 and read_store(spark, root).count() == 0


def test_actor_rule_keeps_text_without_a_sentence(spark, tmp_path):
    root = str(tmp_path / "store")
    ingest(raw_of(spark, RAW), root, EMBED, dim=DIM, rule="actor", workers=3)
    assert read_store(spark, root).filter("raw_data_id = 4").first().chunk_text == "..."


def test_rejects_are_kept_with_a_reason(spark, tmp_path):
    root = str(tmp_path / "store")

    def flaky(texts):
        return [None if "Red" in t else v for t, v in zip(texts, EMBED(texts))]

    run = ingest(raw_of(spark, RAW), root, flaky, dim=DIM)
    assert run.counts["rejected"] == 1 and run.counts["stored"] == 3
    rejected = read_rejects(spark, root).first()
    assert (rejected.raw_data_id, rejected.reason) == (5, "wrong dimension")
    assert rejected.chunk_text == "Red fish? Blue fish"
    assert read_outcomes(spark, root).filter("outcome = 'rejected' AND embedding IS NOT NULL").count() == 0


def test_repeated_run_replaces_its_own_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    for _ in range(2):
        ingest(raw_of(spark, RAW), root, EMBED, dim=DIM, run_id="one")
    ingest(raw_of(spark, RAW), root, EMBED, dim=DIM, run_id="two")
    assert read_store(spark, root).count() == 8
    create_store(spark, root)
    assert read_store(spark, root).count() == 8
    reset_store(spark, root)
    assert read_store(spark, root).count() == 0


def test_failed_write_is_noted_and_raised(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    with pytest.raises(Exception):
        ingest(raw_of(spark, RAW), str(blocked), EMBED, dim=DIM, ledger=ledger)
    row = read_ledger(spark, ledger).first()
    assert row.status == "FAILED" and row.exit_message


def test_null_vectors_can_be_appended(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame(
        [(1, 0, "a", [1.0]), (1, 1, "b", None)],
        "raw_data_id long, chunk_index int, chunk_text string, embedding array<float>",
    )
    append_embeddings(rows, root)
    append_embeddings(rows, root)
    assert read_store(spark, root).filter("embedding IS NULL").count() == 2


def test_lookup_by_parent_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "by-parent")
    rows = spark.range(2000).selectExpr("id div 4 AS raw_data_id", "cast(id % 4 AS int) AS chunk_index")
    write_by_parent(rows.repartition(5), path)
    looked_up = spark.read.parquet(path).filter("raw_data_id = 77")
    assert looked_up.count() == 4
    assert "PushedFilters: [IsNotNull(raw_data_id), EqualTo(raw_data_id,77)]" in (
        looked_up._jdf.queryExecution().executedPlan().toString()
    )


# --- stream


def test_stream_equals_batch_and_adds_nothing_twice(spark, tmp_path):
    raw, store, twin = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "twin")
    rows = [(i, f"Fish {i}. And fish {i + 1}! " * (i + 1), "s") for i in range(40)]
    frame = raw_of(spark, rows)

    def stream(checkpoint):
        source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(raw))
        ingest_stream(source, store, str(tmp_path / checkpoint), EMBED, dim=DIM).awaitTermination()

    frame.filter("raw_data_id < 25").repartition(3).write.mode("append").parquet(str(raw))
    stream("c")
    frame.filter("raw_data_id >= 20").repartition(2).write.mode("append").parquet(str(raw))
    stream("c")
    stream("c")
    stream("other checkpoint")
    ingest(frame, twin, EMBED, dim=DIM)
    assert chunks_of(read_store(spark, store)) == chunks_of(read_store(spark, twin))


def test_stream_repeats_a_batch_that_was_lost(spark, tmp_path):
    """The commit of the last batch is lost: it runs again and replaces its folder."""
    raw, store, checkpoint = tmp_path / "raw", str(tmp_path / "store"), tmp_path / "c"
    frame = raw_of(spark, RAW)
    frame.write.parquet(str(raw))

    def stream():
        source = spark.readStream.schema(frame.schema).parquet(str(raw))
        ingest_stream(source, store, str(checkpoint), EMBED, dim=DIM).awaitTermination()

    stream()
    before = chunks_of(read_store(spark, store))
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    stream()
    assert chunks_of(read_store(spark, store)) == before and len(before) == 4


def test_only_new(spark):
    batch = raw_of(spark, [(1, "b", "s"), (1, "a", "s"), (2, "c", "s"), (3, "d", "s"), (4, "e", "s"), (None, "f", "s")])
    seen = spark.createDataFrame(
        [(2, "c", False), (2, "c", False), (3, "old", False), (4, "e", False), (4, "e", True)],
        "raw_data_id long, raw_text string, failed boolean",
    ).withColumn("text_hash", F.xxhash64("raw_text"))
    got = {(r.raw_data_id, r.raw_text) for r in only_new(batch, seen).collect()}
    assert got == {(1, "a"), (3, "d"), (4, "e"), (None, "f")}
    assert only_new(batch.limit(0), seen).count() == 0


def stream_once(spark, tmp_path, root, rows, model, name):
    folder = str(tmp_path / f"in-{name}")
    raw_of(spark, rows).write.parquet(folder)
    schema = "raw_data_id long, raw_text string, source string"
    stream = spark.readStream.schema(schema).parquet(folder)
    ingest_stream(stream, root, str(tmp_path / f"check-{name}"), model, name=name, dim=DIM).awaitTermination()


def down(texts):
    raise RuntimeError("down")


def test_stream_after_an_outage_and_with_changed_texts(spark, tmp_path):
    """Rejected documents are tried again, changed ones replace their former version."""
    root, plain = str(tmp_path / "store"), str(tmp_path / "plain")
    stream_once(spark, tmp_path, root, RAW, down, "first")
    assert read_store(spark, root).count() == 0 and read_rejects(spark, root).count() > 0
    stream_once(spark, tmp_path, root, RAW, EMBED, "second")
    create_store(spark, plain)
    ingest(raw_of(spark, RAW), plain, EMBED, dim=DIM)
    assert chunks_of(read_store(spark, root)) == chunks_of(read_store(spark, plain))
    assert read_rejects(spark, root).count() == 0

    changed = [(5, "Green fish. " * 80, "b") if r[0] == 5 else r for r in RAW]
    stream_once(spark, tmp_path, root, changed, EMBED, "third")
    reset_store(spark, plain)
    ingest(raw_of(spark, changed), plain, EMBED, dim=DIM)
    assert chunks_of(read_store(spark, root)) == chunks_of(read_store(spark, plain))


def test_failed_repeat_leaves_the_former_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    ingest(raw_of(spark, RAW), root, EMBED, run_id="r", dim=DIM)
    before = chunks_of(read_store(spark, root))
    broken = raw_of(spark, RAW).withColumn("raw_text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        ingest(broken, root, EMBED, run_id="r", dim=DIM)
    assert chunks_of(read_store(spark, root)) == before != []


def test_documents_ingested_twice_are_hits_of_their_own(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    for _ in range(2):
        ingest(raw_of(spark, RAW), root, EMBED, dim=DIM)
    asked = spark.createDataFrame([(1, "red fish blue")], "query_id long, query string")
    for k in (1, 2, 3):
        hits = search_text(read_store(spark, root), asked, EMBED, k, dim=DIM).collect()
        assert sorted(r["rank"] for r in hits) == list(range(1, k + 1))


def test_each_query_text_is_sent_once(spark, tmp_path):
    root, calls = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    create_store(spark, root)
    ingest(raw_of(spark, RAW), root, EMBED, dim=DIM)

    def counted(texts):
        calls.add(len(texts))
        return EMBED(texts)

    asked = spark.createDataFrame([(i, f"fish {i}") for i in range(30)], "query_id long, query string")
    search_text(read_store(spark, root), asked, counted, 2, dim=DIM, max_broadcast_queries=10).collect()
    assert calls.value == 30


# --- questions


def test_admission(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", 0), ("c", -3), ("d", 7), (None, 1), (" \n", 1)], "query string, limit int"
    )
    got = [(r.k, r.error) for r in admit(df).collect()]
    assert [k for k, _ in got] == [5, 5, 5, 7, 1, 1]
    assert [e for _, e in got] == [None] * 4 + ["Query cannot be empty."] * 2


def test_prompts(spark):
    messages = spark.createDataFrame([(1, " q"), (2, "r")], "query_id int, message string")
    hits = spark.createDataFrame([(2, 2, "y"), (2, 1, "x")], "query_id int, rank int, chunk_text string")
    got = {r.query_id: r.prompt for r in prompts(messages, hits).collect()}
    end = (
        "\n\nInstruction: Use the context to answer the question. If the answer is not in the "
        'context, say "I don\'t know. No data is provided to us"'
    )
    assert got[1] == "Context:\n\n\nQuestion:\n q" + end
    assert got[2] == "Context:\n--- x ---\n--- y ---\n\nQuestion:\nr" + end
    assert context_sections(hits).first().context == "--- x ---\n--- y ---"


def test_search_by_text_and_answers(spark, tmp_path):
    root = str(tmp_path / "store")
    ingest(raw_of(spark, RAW), root, EMBED, dim=DIM)
    store = read_store(spark, root)
    asked = spark.createDataFrame(
        [(1, "Red fish? Blue fish"), (2, " "), (3, None)], "query_id int, query string"
    )
    got = search_text(store, asked, EMBED, 2, dim=DIM).orderBy("rank").collect()
    assert [(r.query_id, r.rank) for r in got] == [(1, 1), (1, 2)]
    assert got[0].chunk_text == "Red fish? Blue fish" and abs(got[0].distance) < 1e-6

    messages = asked.withColumnRenamed("query", "message")
    replies = {
        r.query_id: (r.prompt, r.reply, r.reply_error)
        for r in answer(store, messages, EMBED, lambda s, p: p.splitlines()[1], dim=DIM, k=1).collect()
    }
    assert replies[1][1:] == ("--- Red fish? Blue fish ---", None)
    assert replies[2] == replies[3] == (None, EMPTY_MESSAGE, EMPTY_MESSAGE)


def test_a_failing_model_finds_nothing(spark):
    def broken(texts):
        raise RuntimeError("down")

    store = embed_chunks(raw_of(spark, RAW), EMBED, dim=DIM)
    asked = spark.createDataFrame([(1, "fish")], "query_id int, query string")
    assert search_text(store, asked, broken, dim=DIM).collect() == []


def test_a_large_source_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "by-source")
    rows = spark.range(0, 30_000, 1, 6).selectExpr(
        "id AS raw_data_id", "sha2(string(id), 256) AS chunk_text",
        "if(id % 3 = 0, 'hot', concat('s', id % 10)) AS source",
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "100kb")
    try:
        write_by_source(rows, path)
    finally:
        spark.conf.set(size, before)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "by-source").iterdir() if p.is_dir()}
    # Without gathering, each of the 6 tasks would write to each of the 11 folders.
    assert files["source=hot"] > 2 and sum(files.values()) < 6 * 11
    assert spark.read.parquet(path).count() == 30_000


def test_csv_with_backslash_escapes(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", 'instruction,input,output\n"a \\"b\\"",c,d\n')
    assert read_instruction_csv(spark, path, escape="\\").first().instruction == 'a "b"'


def test_csv_without_line_breaks_can_be_split(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", "instruction,input,output\n" + "a,b,c\n" * 50)
    assert raw_text(read_instruction_csv(spark, path, multi_line=False)).count() == 50


def test_a_batch_gathers_its_texts_once(spark, tmp_path, monkeypatch):
    from passagemill.streaming import ingest as streaming

    root, plans = str(tmp_path / "store"), []
    real = streaming.ingest

    def noted(fresh, *rest, **options):
        plans.append(fresh._jdf.queryExecution().executedPlan().toString())
        return real(fresh, *rest, **options)

    monkeypatch.setattr(streaming, "ingest", noted)
    streaming.create_store(spark, root)
    for run, texts in (("one", ["A b. C d.", "E f."]), ("two", ["A b. C d.", "G h."])):
        rows = [(i, t, "s") for i, t in enumerate(texts)]
        batch = spark.createDataFrame(rows, "raw_data_id long, raw_text string, source string")
        streaming.ingest_batch(batch, root, HashedEmbedder(8), run, dim=8)
    assert all("Aggregate" not in plan and "Exchange" not in plan for plan in plans) and len(plans) == 2
    from passagemill.sources.store import read_store

    assert sorted(r.chunk_text for r in read_store(spark, root).collect()) == ["A b. C d.", "G h."]
