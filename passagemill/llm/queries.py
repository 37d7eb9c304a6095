"""The registered queries: each operator with its production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import (
    bpe, chat, collocations, kneser, langid, lattice, leaks, maintext, neardup, secrets, shards,
    variants, warc,
)
from passagemill.llm.common import Scratch

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
SHARDS, SEED = 24, 20
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_shards(spark, sf):
    """Law ``rows``. The shards are written, and the digests come from the written shards."""
    docs = _table(spark, sf, "documents")
    written = shards.write_shards(docs, f"{Scratch(spark, 'shards').root}/shuffled", SHARDS, SEED)
    return written.select(
        "doc_id", shards.record_bytes().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_neardup(spark, sf):
    return neardup.near_duplicates(_table(spark, sf, "documents"))


def op3_maintext(spark, sf):
    found = maintext.extract(_table(spark, sf, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_warc(spark, sf):
    """Pages as an archive and a replica of it with faults, audited; every record with its state.

    The replica loses a few records, has bytes changed in others and gains some.
    """
    scratch = Scratch(spark, "warc")
    first, second = f"{scratch.root}/first", f"{scratch.root}/second"
    warc.write_archive(_table(spark, sf, "pages"), first)
    leaves = scratch.keep(warc.read_archive(spark, first, payload=False), "leaves")

    copy = warc.read_archive(spark, first).withColumn("id", F.col("page").cast("long"))
    changed = F.when(F.col("id") % 101 == 7, F.regexp_replace("record", "<title>", "<tit1e>")).otherwise(F.col("record"))
    copy = copy.filter("id is null or id % 211 != 5").withColumn("record", changed)
    warc.write_records(copy.select("file", "number", "record"), second)

    states = warc.audit(leaves, scratch.keep(warc.read_archive(spark, second, payload=False), "replica"))
    place = ["file", "offset"]
    return leaves.join(states.select(*place, "status"), place, "left").select(
        F.col("page").cast("long").alias("page_id"), "url", F.col("length").alias("n_bytes"),
        F.lower(F.hex("hash")).alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"),
    )


def op5_decontaminate(spark, sf):
    found = leaks.find_leaks(
        _table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark")
    )
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op6_bpe(spark, sf):
    coded = bpe.encode_decode(_table(spark, sf, "documents"), BYTE_BPE)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_quality(spark, sf):
    judged = kneser.quality(_table(spark, sf, "documents"))
    return judged.select("doc_id", *kneser.COUNTS, "base_failed", "kept", "surprise", "lower", "upper")


def op8_langid(spark, sf):
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang", held_out)
    # A row without id is not known to be held out, and not learned from.
    learned = langid.fit(docs.filter("held_out = false").select("text", "lang"))
    guessed = langid.predict(docs.select("doc_id", "text", "held_out"), learned, keep=("doc_id", "held_out"))
    return guessed.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_lattice(spark, sf):
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out")
    return lattice.score(_table(spark, sf, "documents").select("doc_id", "text", held_out), PIECES)


def op10_secrets(spark, sf):
    found = secrets.find_secrets(_table(spark, sf, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("secrets", lambda m: m["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda m: m["kind"] < secrets.KINDS.index("random"))
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


def op11_chat(spark, sf):
    """All conversations and one whose texts hold marks; the digests are read back from the formatted text."""
    talk = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = talk.union(marked).withColumn("content", chat.text_part(F.col("text")))
    done = chat.format_chats(turns)
    said = lambda turn: F.concat(turn["role"], F.lit("\n"), F.array_join(turn["texts"], ""), F.lit("\n"))
    read = done.select(
        "conv_id", "n_turns", F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(F.transform(chat.read_back(F.col("formatted")), said), "").alias("turns"),
        F.array_join(chat.under_mask(F.col("formatted"), F.col("loss")), "").alias("learned"),
    )
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op12_collocations(spark, sf):
    return collocations.collocations(_table(spark, sf, "documents").select("text", "lang"))


def op13_variants(spark, sf):
    return variants.variants(_table(spark, sf, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_shards, op2_neardup, op3_maintext, op4_warc, op5_decontaminate, op6_bpe, op7_quality,
        op8_langid, op9_lattice, op10_secrets, op11_chat, op12_collocations,
        op13_variants,
    )
}
