"""The registered queries: every operator run over the whole test tables.

Each takes ``(spark, sf_dir)`` and gives a DataFrame. ``documents`` stands in
for the raw table, ``embeddings`` for a vector store, ``benchmark`` for text
queries and ``conversations`` for instruction records and chat messages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.cache import VectorCache
from passagemill.functions.embedding import HashedEmbedder, embed_batch, embed_column
from passagemill.functions.text import combine_text, split_sentences
from passagemill.functions.vectors import (
    batch_cosine_distance,
    cosine_distance,
    fit_dimension,
    has_null_element,
    is_zero_vector,
    reject_reason,
    to_float,
)
from passagemill.operators import ranges
from passagemill.operators.cells import Hyperplanes, InvertedLists
from passagemill.operators.chunks import (
    chunk_table,
    chunks_of_many,
    drop_blank,
    fixed_chunk_table,
    flatten_chunks,
)
from passagemill.operators.counters import stage_counters
from passagemill.operators.prompts import admit, context_sections, prompts
from passagemill.operators.search import CHAT_K, top_k, top_k_one
from passagemill.plans.answer import answer, search_text
from passagemill.plans.ingest import embed_chunks, ingest, read_ledger, run_metrics
from passagemill.session import shared_folder, spread
from passagemill.sources.instructions import COLUMNS, raw_text, read_instruction_csv
from passagemill.sources.raw import append_raw, as_raw, read_raw
from passagemill.sources.store import (
    append_embeddings,
    create_store,
    read_rejects,
    read_store,
    reset_store,
    write_by_parent,
    write_by_source,
)
from passagemill.streaming.ingest import ingest_stream

DIM = 64
RANGES = 7
WINDOW, OVERLAP = 500, 50
LISTS, NPROBE, STEPS = 10, 3, 4
CHUNK_KEY = ("raw_data_id", "chunk_index")
ONE = ("vec_id",)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _raw(spark, sf) -> DataFrame:
    return as_raw(_table(spark, sf, "documents"), "doc_id", "text", "source")


def _texts(spark, sf) -> DataFrame:
    """The raw table, ready for work on its texts."""
    return spread(_raw(spark, sf))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def digest_reply(system: str, prompt: str) -> str:
    """Stands in for a chat model: the MD5 of what it was sent."""
    return hashlib.md5(f"{system}\n{prompt}".encode()).hexdigest()


# --- ids and ranges


def dense_ids(spark, sf):
    talk = _table(spark, sf, "conversations").select("conv_id", "turn")
    return ranges.dense_ids(talk, ["conv_id", "turn"])


def dense_ids_tied(spark, sf):
    """Numbered by a key of three values: where the ids of each begin and end, and how many there are."""
    talk = _table(spark, sf, "conversations").select("role", "text")
    numbered = ranges.dense_ids(talk, ["role"])
    return numbered.groupBy("role").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("id").alias("ids")
    )


def dense_ids_of_files(spark, sf):
    """Numbered as the rows lie in their file."""
    return ranges.dense_ids(_table(spark, sf, "documents").select("doc_id"))


def ordered_scan(spark, sf):
    return _raw(spark, sf).select("raw_data_id", "raw_text").orderBy("raw_data_id")


def id_bounds(spark, sf):
    return ranges.id_bounds(_raw(spark, sf), "raw_data_id")


def id_ranges(spark, sf):
    return ranges.id_ranges(_raw(spark, sf), RANGES, "raw_data_id")


def range_scan(spark, sf):
    return ranges.with_range_id(_raw(spark, sf).select("raw_data_id"), RANGES, "raw_data_id")


def range_counters(spark, sf):
    return ranges.range_counters(_raw(spark, sf), RANGES, id_col="raw_data_id")


def keyset_page(spark, sf):
    raw = _raw(spark, sf).select("raw_data_id", "raw_text")
    return ranges.keyset_page(raw, 99, 400, id_col="raw_data_id")


def page_numbers(spark, sf):
    return ranges.page_numbers(_raw(spark, sf).select("raw_data_id"), RANGES, id_col="raw_data_id")


def prefix_sample(spark, sf):
    raw = _raw(spark, sf).select("raw_data_id", "raw_text")
    return ranges.prefix_sample(raw, id_col="raw_data_id")


# --- text


RECORD = ("conv_id", "exchange")


def _instructions(spark, sf) -> DataFrame:
    """One instruction record per exchange: a user's turn with all up to the next one.

    Every turn is in one record; a system text opens the first.
    """
    asked = F.count(F.when(F.col("role") == "user", 1)).over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = _table(spark, sf, "conversations").withColumn("exchange", F.greatest(asked, F.lit(1)))

    def part(role, name):
        texts = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
        return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda t: t["text"]), "\n")).alias(name)

    return turns.groupBy(*RECORD).agg(
        part("system", "instruction"), part("user", "input"), part("assistant", "output")
    )


def combined_text(spark, sf):
    return _instructions(spark, sf).select(*RECORD, combine_text(*COLUMNS).alias("raw_text"))


def csv_source(spark, sf):
    """The records written as CSV with further columns, read back and loaded as raw text."""
    path = shared_folder(spark, "instructions")
    records = _instructions(spark, sf).select(
        F.col("conv_id").alias("id"),
        F.coalesce("output", F.lit("")).alias("Output"),
        F.coalesce("instruction", F.lit("")).alias("INSTRUCTION"),
        F.coalesce("input", F.lit("")).alias("input"),
    )
    records.write.csv(path, header=True, quoteAll=True, escape='"')
    return raw_text(read_instruction_csv(spark, path))


def raw_sink(spark, sf):
    """Two appends to a raw table: ids go on where the first stopped."""
    path = shared_folder(spark, "raw")
    texts = _instructions(spark, sf).select(*RECORD, combine_text(*COLUMNS).alias("raw_text"))
    append_raw(texts, path, list(RECORD))
    append_raw(texts, path, list(RECORD))
    return read_raw(spark, path).select("raw_data_id", "raw_text")


def blanks_dropped(spark, sf):
    """All turns, and for each a blank or missing one beside it."""
    talk = _table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("raw_text"))
    blank = F.when(F.col("turn") % 2 == 0, F.lit(" \t\n\x01 ")).alias("raw_text")
    beside = talk.select("conv_id", (-1 - F.col("turn")).alias("turn"), blank)
    return drop_blank(talk.union(beside)).select("conv_id", "turn")


def sentences(spark, sf):
    return _texts(spark, sf).select(
        "raw_data_id", F.posexplode(split_sentences("raw_text")).alias("pos", "sentence")
    )


def chunks_batch(spark, sf):
    return chunk_table(_texts(spark, sf), "batch")


def chunks_actor(spark, sf):
    return chunk_table(_texts(spark, sf), "actor")


def chunks_small(spark, sf):
    """A target below the minimum, where an over-long first sentence stands alone."""
    return chunk_table(_texts(spark, sf), "actor", target=40, minimum=60)


def chunk_fallback(spark, sf):
    """The documents' marks alone: text without a sentence."""
    marks = F.regexp_replace("raw_text", r"[^.!?]", "").alias("raw_text")
    return chunk_table(_texts(spark, sf).select("raw_data_id", marks), "actor")


def chunks_fixed(spark, sf):
    return fixed_chunk_table(_texts(spark, sf), WINDOW, OVERLAP)


def chunks_flattened(spark, sf):
    """Every text's lines, and as many documents without a list."""
    lists = _table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("chunks"))
    return flatten_chunks(lists.union(lists.select("doc_id", F.lit(None).cast("array<string>"))))


def chunks_of_parents(spark, sf):
    """A copy of all chunks written by parent, and the parents' chunks read from it."""
    path = shared_folder(spark, "by-parent")
    write_by_parent(chunk_table(_texts(spark, sf)), path)
    parents = _table(spark, sf, "labels").select(F.col("doc_id").alias("raw_data_id"))
    return chunks_of_many(spark.read.parquet(path), parents)


def by_source(spark, sf):
    path = shared_folder(spark, "by-source")
    write_by_source(chunk_table(_texts(spark, sf), keep=["raw_data_id", "source"]), path)
    return spark.read.parquet(path).select(
        "raw_data_id", "chunk_index", F.col("source").cast("string").alias("source")
    )


# --- vectors


def _vectors(spark, sf) -> DataFrame:
    return _table(spark, sf, "embeddings").select("vec_id", "embedding")


def _flawed(spark, sf) -> DataFrame:
    """All vectors, and beside them zero, short, holed and missing ones by negative ids."""
    e, kind = F.col("embedding"), F.col("vec_id") % 10
    flawed: Column = (
        F.when(kind == 0, F.transform(e, lambda x: F.lit(0.0).cast("float")))
        .when(kind == 1, F.slice(e, 1, DIM - 1))
        .when(kind == 2, F.transform(e, lambda x, i: F.when(i != 5, x)))
    )
    beside = _vectors(spark, sf).filter(kind < 4).select(
        (-1 - F.col("vec_id")).alias("vec_id"), flawed.alias("embedding")
    )
    return _vectors(spark, sf).union(beside)


def zero_vectors_dropped(spark, sf):
    return _flawed(spark, sf).filter(~is_zero_vector("embedding")).select("vec_id")


def dimension_check(spark, sf):
    fitted = fit_dimension("embedding", DIM)
    return _flawed(spark, sf).select(
        "vec_id", F.size(fitted).alias("dim"), is_zero_vector(fitted).alias("is_zero")
    )


def null_element_check(spark, sf):
    return _flawed(spark, sf).filter(has_null_element("embedding")).select("vec_id")


def reject_reasons(spark, sf):
    """The flawed vectors and, by ids from 10^12 on, some with an element that is not finite."""
    odd = F.when(F.col("vec_id") % 2 == 0, float("nan")).otherwise(float("inf")).cast("float")
    wild = _vectors(spark, sf).filter("vec_id % 10 = 7").select(
        (F.col("vec_id") + 10**12).alias("vec_id"),
        F.transform("embedding", lambda x, i: F.when(i == 5, odd).otherwise(x)).alias("embedding"),
    )
    return _flawed(spark, sf).union(wild).select("vec_id", reject_reason("embedding", DIM).alias("reason"))


def narrowed_vectors(spark, sf):
    thirds = F.transform("embedding", lambda x: x.cast("double") / 3)
    return _vectors(spark, sf).select(
        "vec_id", F.posexplode(to_float(thirds)).alias("pos", "x")
    ).select("vec_id", "pos", (F.round(F.col("x").cast("double"), 6) + F.lit(0.0)).alias("x"))


def _neighbour_distances(spark, sf, measure) -> DataFrame:
    """Each vector and the one with the next id, flawed vectors among them."""
    of = F.when(F.col("vec_id") < 0, -1 - F.col("vec_id")).otherwise(F.col("vec_id"))
    left = _flawed(spark, sf).withColumn("of", of)
    right = _vectors(spark, sf).select(
        (F.col("vec_id") - 1).alias("of"), F.col("embedding").alias("other")
    )
    measured = left.join(right, "of").select("vec_id", measure("embedding", "other").alias("d"))
    return measured.select(
        "vec_id", F.when(~F.isnan("d"), F.round("d", 6) + F.lit(0.0)).alias("distance"),
        F.coalesce(F.isnan("d"), F.lit(False)).alias("no_direction"),
    )


def cosine_distances(spark, sf):
    return _neighbour_distances(spark, sf, batch_cosine_distance)


def cosine_expression(spark, sf):
    return _neighbour_distances(spark, sf, cosine_distance)


def _as_queries(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def topk_one(spark, sf):
    store = _vectors(spark, sf)
    query = store.orderBy("vec_id").first().embedding
    return _rounded(top_k_one(store, query, 10, key=ONE))


def topk_cosine(spark, sf):
    store = _vectors(spark, sf)
    return _rounded(top_k(store, _as_queries(store), 5, key=ONE))


def topk_sliced(spark, sf):
    """The same search in several blocks of queries, as it runs when they are too many for one."""
    store = _vectors(spark, sf)
    return _rounded(top_k(store, _as_queries(store), 5, key=ONE, max_broadcast_queries=200))


def topk_flawed(spark, sf):
    """All vectors and the flawed ones: zero ones come after all distances, missing ones last.

    Every first vector of a label asks; the one of label 0 wants more hits than a small table has vectors.
    """
    firsts = _table(spark, sf, "embeddings").groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )
    asked = firsts.select(
        F.col("label").alias("query_id"), "embedding",
        F.when(F.col("label") == 0, 700).otherwise(3).alias("k"),
    )
    found = top_k(_flawed(spark, sf), asked, key=ONE)
    return found.select(
        "query_id", "rank", "vec_id",
        F.when(~F.isnan("distance"), F.round("distance", 6) + F.lit(0.0)).alias("distance"),
    )


def _lists(store: DataFrame) -> InvertedLists:
    """Lists that start from the vectors of the least ids."""
    first = store.orderBy("vec_id").limit(LISTS).select(F.col("vec_id").alias("cell"), "embedding")
    return InvertedLists.lloyd(store, first, STEPS)


def ann_ivf(spark, sf):
    store = _vectors(spark, sf)
    return _rounded(_lists(store).top_k(store, _as_queries(store), 5, nprobe=NPROBE, key=ONE))


def ann_ivf_all_lists(spark, sf):
    """An index kept with its store, filled in two parts and loaded again: all lists are the exact search."""
    store, root = _vectors(spark, sf), shared_folder(spark, "cells")
    early = F.col("vec_id") % 3 != 0
    _lists(store).write(store.filter(early), root)
    InvertedLists.load(spark, root).append(store.filter(~early), root)
    lists = InvertedLists.load(spark, root)
    return _rounded(lists.top_k(lists.read(spark, root), _as_queries(store), 5, nprobe=LISTS, key=ONE))


def ann_ivf_kept(spark, sf):
    """The same index probed in part: as if it had been made of all rows at once."""
    store, root = _vectors(spark, sf), shared_folder(spark, "cells")
    early = F.col("vec_id") % 3 != 0
    _lists(store).write(store.filter(early), root)
    InvertedLists.load(spark, root).append(store.filter(~early), root)
    lists = InvertedLists.load(spark, root)
    return _rounded(lists.top_k(lists.read(spark, root), _as_queries(store), 5, nprobe=NPROBE, key=ONE))


def ann_lsh(spark, sf):
    store = _vectors(spark, sf)
    return _rounded(Hyperplanes(DIM).top_k(store, _as_queries(store), 5, key=ONE))


# --- embedding, search by text, prompts and answers


def embedded_texts(spark, sf):
    """All turns and blank ones beside those of system, embedded in calls of 7 texts by 3 workers."""
    talk = _table(spark, sf, "conversations")
    blank = talk.filter("role = 'system'").select("conv_id", (-1 - F.col("turn")).alias("turn"), F.lit(" \n"))
    texts = talk.select("conv_id", "turn", F.col("text").alias("chunk_text")).union(blank)
    made = embed_column(texts, HashedEmbedder(DIM), dim=DIM, batch_size=7, workers=3)
    return made.select(
        "conv_id", "turn", is_zero_vector("embedding").alias("is_zero"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("slots"), "embed_error",
    )


def _one_too_few(texts: list[str]):
    """An embedder that loses the first vector of a call of an odd number of texts."""
    return HashedEmbedder(DIM)(texts)[len(texts) % 2 :]


def short_replies(spark, sf):
    """One call per conversation: where the reply is a vector short, all of the call is zeroed and says so."""

    def call(rows: pa.Table) -> pa.Table:
        vectors, reasons = embed_batch(rows.column("text").to_pylist(), _one_too_few, DIM)
        return pa.table({
            "conv_id": rows.column("conv_id"), "turn": rows.column("turn"),
            "is_zero": pa.array(~vectors.any(axis=1)), "embed_error": pa.array(reasons, pa.string()),
        })

    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return turns.groupBy("conv_id").applyInArrow(
        call, "conv_id long, turn long, is_zero boolean, embed_error string"
    )


def embedded_once(spark, sf):
    """Chunks of both rules through one cache: how many there are, and how many texts were sent."""
    cache, counted = VectorCache(spark, shared_folder(spark, "vectors")), []
    for rule in ("batch", "actor", "batch"):
        chunks = chunk_table(_texts(spark, sf), rule, keep=["raw_data_id"])
        made = cache.embed(chunks, HashedEmbedder(DIM), dim=DIM)
        slots = F.size(F.filter("embedding", lambda x: x != 0))
        counted.append(made.agg(
            F.lit(len(counted)).alias("call"), F.lit(rule).alias("rule"), F.count("*").alias("chunks"),
            F.lit(cache.sent).cast("long").alias("sent"), F.sum(slots).cast("long").alias("slots"),
        ))
    return reduce(DataFrame.union, counted)


def hashed_embedding(spark, sf):
    made = embed_column(chunk_table(_texts(spark, sf)), HashedEmbedder(DIM), dim=DIM)
    weights = made.select(*CHUNK_KEY, F.posexplode("embedding").alias("slot", "weight"))
    return weights.filter("weight != 0").withColumn(
        "weight", F.round(F.col("weight").cast("double"), 6)
    )


def _store(spark, sf) -> DataFrame:
    """The documents ingested, as a search finds them: a written store."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    ingest(_texts(spark, sf), root, HashedEmbedder(DIM), dim=DIM)
    return read_store(spark, root)


def query_admission(spark, sf):
    """All items as queries, and blank ones beside them."""
    item = F.col("item_id")
    limit = F.when(item % 4 == 1, 0).when(item % 4 == 2, -3).when(item % 4 == 3, 7).alias("limit")
    items = _table(spark, sf, "benchmark")
    asked = items.select("item_id", F.col("text").alias("query"), limit)
    blank = items.select((-1 - item).alias("item_id"), F.lit("\t "), limit)
    return admit(asked.union(blank)).select("item_id", "k", "error")


def topk_text(spark, sf):
    asked = _table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return _rounded(search_text(_store(spark, sf), asked, HashedEmbedder(DIM), dim=DIM))


def topk_text_twice(spark, sf):
    """Documents ingested twice: equal chunks are hits of their own, k in all."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    for _ in range(2):
        ingest(_texts(spark, sf), root, HashedEmbedder(DIM), dim=DIM)
    asked = _table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return _rounded(search_text(read_store(spark, root), asked, HashedEmbedder(DIM), dim=DIM))


def limited_search(spark, sf):
    """Queries admitted with a limit of their own, then searched."""
    item = F.col("item_id")
    asked = _table(spark, sf, "benchmark").select(
        item.alias("query_id"), F.col("text").alias("query"),
        F.when(item % 4 == 1, 0).when(item % 4 == 2, -3).when(item % 4 == 3, 7).alias("limit"),
    )
    admitted = admit(asked).filter("error IS NULL")
    return _rounded(search_text(_store(spark, sf), admitted, HashedEmbedder(DIM), dim=DIM))


def _messages(spark, sf) -> DataFrame:
    """Every user turn, and a blank one by a negative id beside those that follow an opening text."""
    talk = _table(spark, sf, "conversations").filter("role = 'user'")
    query_id = F.col("conv_id") * 1000 + F.col("turn")
    blank = talk.filter("turn = 1").select((-1 - query_id).alias("query_id"), F.lit(" \n"))
    return talk.select(query_id.alias("query_id"), F.col("text").alias("message")).union(blank)


def _hits(spark, sf) -> DataFrame:
    return search_text(
        _store(spark, sf), _messages(spark, sf), HashedEmbedder(DIM), CHAT_K, text="message", dim=DIM
    )


def context_section(spark, sf):
    return context_sections(_hits(spark, sf))


def built_prompts(spark, sf):
    return prompts(_messages(spark, sf), _hits(spark, sf)).select("query_id", "prompt")


def answers(spark, sf):
    answered = answer(
        _store(spark, sf), _messages(spark, sf), HashedEmbedder(DIM), digest_reply, dim=DIM
    )
    return answered.select("query_id", "reply", "reply_error")


# --- jobs


def stage_counts(spark, sf):
    """What a stream over the documents observed, four id ranges, of one file each, in a micro-batch."""
    root, ledger, arrived = (shared_folder(spark, x) for x in ("store", "ledger", "arrived"))
    raw = ranges.with_range_id(_raw(spark, sf), RANGES, "raw_data_id")
    raw.repartition("range_id").write.partitionBy("range_id").parquet(arrived)
    files = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 4).parquet(arrived)
    stream = ingest_stream(
        files.drop("range_id"), root, shared_folder(spark, "stream"), HashedEmbedder(DIM), dim=DIM, ledger=ledger
    )
    stream.awaitTermination()
    return stage_counters(read_ledger(spark, ledger))


def _summary(store: DataFrame) -> DataFrame:
    slots = F.size(F.filter("embedding", lambda x: x != 0)).alias("slots")
    return store.select(*CHUNK_KEY, "chunk_text", "source", slots)


def ingested(spark, sf):
    """The job's store, read back."""
    return _summary(_store(spark, sf))


def ingested_stream(spark, sf):
    """The same by a stream, run twice: the second run finds nothing new."""
    root = shared_folder(spark, "store")
    schema = _table(spark, sf, "documents").schema
    for checkpoint in (shared_folder(spark, "stream"), shared_folder(spark, "stream")):
        files = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet")
        raw = as_raw(files.parquet(sf), "doc_id", "text", "source")
        ingest_stream(raw, root, checkpoint, HashedEmbedder(DIM), dim=DIM).awaitTermination()
    return _summary(read_store(spark, root))


def _down(texts: list[str]):
    raise ConnectionError("the model is down")


def _streams(spark, sf, *runs) -> DataFrame:
    """The store after one stream run per ``(documents, model)``."""
    root = shared_folder(spark, "store")
    for number, (docs, model) in enumerate(runs):
        folder = shared_folder(spark, "arrived")
        as_raw(docs, "doc_id", "text", "source").write.parquet(folder)
        raw = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        checkpoint = shared_folder(spark, "stream")
        ingest_stream(raw, root, checkpoint, model, name=f"run-{number}", dim=DIM).awaitTermination()
    return _summary(read_store(spark, root))


def stream_after_outage(spark, sf):
    """All chunks rejected by a failing model, then the same documents again."""
    docs = _table(spark, sf, "documents")
    return _streams(spark, sf, (docs, _down), (docs, HashedEmbedder(DIM)))


def stream_updated(spark, sf):
    """Every document arrives with another text first: the later version replaces it."""
    docs = _table(spark, sf, "documents")
    older = docs.withColumn("text", F.concat(F.lit("Old news. "), F.reverse("text")))
    return _streams(spark, sf, (older, HashedEmbedder(DIM)), (docs, HashedEmbedder(DIM)))


def store_reset(spark, sf):
    """A filled store is emptied and filled again."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    for _ in range(2):
        reset_store(spark, root)
        ingest(_texts(spark, sf), root, HashedEmbedder(DIM), dim=DIM)
    return _summary(read_store(spark, root))


def _no_long_texts(texts: list[str]):
    """An embedder that gives no vector for a text of more than 500 characters."""
    vectors = HashedEmbedder(DIM)(texts)
    return [v if len(t) <= 500 else None for t, v in zip(texts, vectors)]


def rejects(spark, sf):
    """What a failing model leaves behind."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    ingest(_texts(spark, sf), root, _no_long_texts, dim=DIM)
    return read_rejects(spark, root).select(*CHUNK_KEY, "source", "reason")


def null_vector_sink(spark, sf):
    """Rows appended as they are: a missing vector is kept, and found last."""
    root = shared_folder(spark, "store")
    create_store(spark, root)
    rows = _flawed(spark, sf).select(
        F.col("vec_id").alias("raw_data_id"),
        F.lit(0).alias("chunk_index"),
        F.lit("").alias("chunk_text"),
        "embedding",
    )
    append_embeddings(rows, root)
    return read_store(spark, root).select(
        "raw_data_id", F.col("embedding").isNull().alias("no_vector"),
        F.col("created_at").isNotNull().alias("dated"),
    )


def run_ledger(spark, sf):
    root, ledger = shared_folder(spark, "store"), shared_folder(spark, "ledger")
    create_store(spark, root)
    ingest(_texts(spark, sf), root, _no_long_texts, dim=DIM, ledger=ledger)
    done = read_ledger(spark, ledger).filter("status = 'COMPLETED'")
    return run_metrics(done).select("stage", "metric", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dense_ids, dense_ids_tied, dense_ids_of_files, ordered_scan, id_bounds, id_ranges, range_scan, range_counters, keyset_page,
        page_numbers, prefix_sample,
        combined_text, csv_source, raw_sink, blanks_dropped, sentences, chunks_batch, chunks_actor,
        chunks_small, chunk_fallback, chunks_fixed, chunks_flattened, chunks_of_parents, by_source,
        zero_vectors_dropped, dimension_check, null_element_check, reject_reasons,
        narrowed_vectors, cosine_distances, cosine_expression, topk_one, topk_cosine, topk_sliced, topk_flawed,
        ann_ivf, ann_ivf_all_lists, ann_ivf_kept, ann_lsh,
        embedded_texts, embedded_once, short_replies, hashed_embedding, query_admission, topk_text, topk_text_twice, limited_search,
        context_section,
        built_prompts, answers,
        stage_counts, ingested, ingested_stream, stream_after_outage, stream_updated,
        store_reset, rejects, null_vector_sink, run_ledger,
    )
}
