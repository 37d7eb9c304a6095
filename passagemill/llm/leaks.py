"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised to lower-cased ASCII words (other characters are word characters) that stand
between single spaces. Every window of ten item words, or a shorter item as a whole, is a pattern;
a document is scanned once, and matches are mapped back to words and to characters of the original.

The automaton reads word numbers: each distinct word of the benchmark has a number, written as two
characters of two alphabets, so that a place in the automaton has few branches and no match begins
inside a word. Other words of a document share a pair that no pattern has. A window is then twenty
characters, whatever the lengths of its words. The benchmark is read in blocks of bounded bytes
(``BLOCK_BYTES`` of text, at most half as many words), one automaton each, of up to some 300 MB. A
benchmark of one block, the usual case, needs one scan. More blocks add a scan each, with the state
of the documents written in between, so that a task holds one automaton; documents are never shuffled.

Nulls: a null text has no words, an item without words has no window and is never found. An item
without id is scanned, its hits count, and it is named by the empty string. Repeated items and ids
count once per id, repeated documents are each scanned. Very long texts are scanned whole in linear
time. Empty tables give no rows or no hits. Further columns travel in a struct and cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import Scratch, runs, text_bytes

WINDOW = 10
BLOCK_BYTES = 1 << 19
#: The two alphabets begin here, below the surrogates; at most 8,192 characters each.
FIRST, SECOND = 0x4000, 0x8000
UNKNOWN = "\x00\x00"

#: ASCII letters and digits stay (letters in lower case), other ASCII becomes a space, and the
#: bytes of longer characters stay.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


@dataclass
class Machine:
    """The codes of the benchmark's words, the automaton, and size and items of each pattern."""

    codes: dict[bytes, str]
    patterns: ahocorasick.Automaton
    found: list[tuple[int, tuple[str, ...]]]


def word_codes(vocabulary: set[bytes]) -> dict[bytes, str]:
    """Two characters for each word, from alphabets of about the root of their number."""
    base = math.isqrt(len(vocabulary)) + 1
    return {
        w: chr(FIRST + number // base) + chr(SECOND + number % base) for number, w in enumerate(sorted(vocabulary))
    }


def automaton(items: list[tuple[str, bytes]]) -> Machine:
    split = [(item, words(text)) for item, text in items]
    codes = word_codes({w for _, own in split for w in own})
    owners: dict[str, list[str]] = {}
    for item, own in split:
        size = min(len(own), WINDOW)
        coded = "".join([codes[w] for w in own])
        for i in range(len(own) - size + 1 if size else 0):
            owners.setdefault(coded[2 * i : 2 * (i + size)], []).append(item)
    patterns = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    found = []
    for number, (pattern, names) in enumerate(owners.items()):
        patterns.add_word(pattern, number)
        found.append((len(pattern) // 2, tuple(sorted(set(names)))))
    if found:
        patterns.make_automaton()
    return Machine(codes, patterns, found)


def scan(machine: Machine, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Half-open ranges of hit words, merged and in order, and the items found."""
    if not w or not machine.found:
        return [], set()
    known = machine.codes.get
    matches = list(machine.patterns.iter("".join([known(x, UNKNOWN) for x in w])))
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    for number in {number for _, number in matches}:
        items.update(machine.found[number][1])
    ends = [((end + 1) // 2, machine.found[number][0]) for end, number in matches]
    for start, end in sorted((end - size, end) for end, size in ends):
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
        else:
            ranges.append((start, end))
    return ranges, items


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as half-open ranges of code points of the original text."""
    if not ranges:
        return []
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(heads)))
    return [
        {"start": int(points[starts[lo]]), "end": int(points[ends[hi - 1]])} for lo, hi in ranges
    ]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded bytes, each brought to the driver on its own."""
    sized = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    total = sized.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total <= block_bytes:
        yield [(r.item, r.text.encode()) for r in sized.collect()]
        return
    number = -(-total // (block_bytes // 2))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(number)))
    for block in range(number):
        yield [(r.item, r.text.encode()) for r in dealt.filter(F.col("block") == block).collect()]


def find_leaks(
    docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id``, ``text`` and the columns ``keep`` of ``docs``, each with what was found in it:

    ``n_words``, ``hit_words`` (half-open word ranges), ``items`` (sorted ids) and ``spans``
    (half-open ranges of code points of the text).
    """
    spark = docs.sparkSession
    ranges_type = "array<struct<start:int,end:int>>"
    state = docs.select("text", F.struct("doc_id", *keep).alias("row")).withColumns(
        {
            "hit_words": F.lit(None).cast(ranges_type),
            "items": F.lit(None).cast("array<string>"),
            "n_words": F.lit(0).cast("long"),
        }
    )
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    scratch = Scratch(spark, "leaks")
    for number, block in enumerate(_blocks(items, block_bytes)):
        if number:
            state = scratch.keep(state, f"state-{number}")
            if number > 1:
                scratch.drop(f"state-{number - 1}")
        shared = spark.sparkContext.broadcast(block)

        def scan_batches(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in (rows for whole in batches for rows in runs(whole)):
                hit, found, counts = [], [], []
                former = batch.column("hit_words").to_pylist(), batch.column("items").to_pylist()
                for text, old_hit, old_items in zip(text_bytes(batch.column("text")), *former):
                    w = words(text)
                    ranges, ids = scan(machine, w)
                    for r in old_hit or ():
                        ranges.append((r["start"], r["end"]))
                    merged: list[tuple[int, int]] = []
                    for lo, hi in sorted(ranges):
                        if merged and lo <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
                        else:
                            merged.append((lo, hi))
                    hit.append([{"start": lo, "end": hi} for lo, hi in merged])
                    found.append(sorted(ids | set(old_items or ())))
                    counts.append(len(w))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("text"), batch.column("row"), pa.array(hit, pair),
                        pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.int64()),
                    ],
                    ["text", "row", "hit_words", "items", "n_words"],
                )

        state = state.mapInArrow(scan_batches, state.schema)

    def span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (rows for whole in batches for rows in runs(whole)):
            hits = batch.column("hit_words").to_pylist()
            spans = [
                original_spans(t, [(r["start"], r["end"]) for r in h]) if h else []
                for t, h in zip(text_bytes(batch.column("text")), hits)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, pair)], [*batch.schema.names, "spans"]
            )

    schema = state.withColumn("spans", F.lit(None).cast(ranges_type)).schema
    return state.mapInArrow(span_batches, schema).select(
        "row.*", "text", "n_words", "hit_words", "items", "spans"
    )
