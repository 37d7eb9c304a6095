"""Text functions: built-in Spark expressions, but for the cuts between chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as surrounding white space, and what a sentence is.
BLANK_CHARS = "".join(chr(c) for c in range(0x21))
SENTENCE = r"[^.!?]+[.!?]+\s*|[^.!?]+$"

# Default chunk sizes, in UTF-16 units.
TARGET_SIZE = 500
MIN_SIZE = 50

_STRINGS = T.ArrayType(T.StringType(), containsNull=True)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jtrim(c: Column | str) -> Column:
    """Strip every character up to U+0020 from both ends (Spark's ``trim`` strips spaces only)."""
    return F.btrim(_col(c), F.lit(BLANK_CHARS))


def is_blank(c: Column | str) -> Column:
    """True for NULL and for text of nothing but white space and control characters."""
    return _col(c).isNull() | ~_col(c).rlike(r"[^\x00-\x20]")


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units; a character outside the basic plane counts two."""
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("int")


def combine_text(*parts: Column | str) -> Column:
    """Trim each part, join with one space, trim the whole. An empty middle part leaves two spaces."""
    trimmed = [F.coalesce(jtrim(p), F.lit("")) for p in parts]
    return jtrim(F.concat_ws(" ", *trimmed))


def split_sentences(c: Column | str) -> Column:
    """Array of trimmed, non-empty sentences."""
    pieces = F.regexp_extract_all(jtrim(c), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, jtrim), lambda s: s != "")


def group_sentences(
    sentences: Column | str,
    target: int = TARGET_SIZE,
    minimum: int = MIN_SIZE,
    separator: int = 0,
) -> Column:
    """Group an array of sentences greedily into an array of chunks.

    A chunk is closed when it has at least ``minimum`` units and the next
    sentence would take it over ``target``. ``separator`` says how many units
    the joining space counts in that test: 0 under the batch rule, 1 under the
    actor rule. A sentence is never cut, and a first sentence longer than
    ``target`` is a chunk of its own.

    Only the sentences' lengths leave the JVM, and the places of the cuts come
    back. ``sentences`` is read twice, so it should be a column and not a costly
    expression.
    """

    @F.arrow_udf("array<struct<at: int, n: int>>")
    def cuts(lengths: pa.Array) -> pa.Array:
        return _cuts(lengths, target, minimum, separator)

    s = _col(sentences)
    # Bound once: a lambda would work an outer expression out anew for every chunk.
    both = F.array(F.struct(s.alias("s"), cuts(F.transform(s, utf16_length)).alias("cuts")))
    joined = lambda x: F.transform(
        x["cuts"], lambda c: F.array_join(F.slice(x["s"], c["at"], c["n"]), " ")
    )
    return F.flatten(F.transform(both, joined))


def _cuts(lengths: pa.Array, target: int, minimum: int, separator: int) -> pa.Array:
    """Where the chunks of each list of sentence lengths begin (from 1), and how many sentences they have.

    With running sums of the lengths and spaces, both conditions of a cut hold from some sentence
    on, so the next cut after each sentence is found by search, for all sentences at once.
    """
    flat = pc.fill_null(lengths.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
    sums = np.concatenate([[0], np.cumsum(flat + 1)])
    begin = sums[:-1]
    # At sentence j, those from i on have sums[j] - sums[i] - 1 units. Sums of other rows do not matter.
    enough = np.searchsorted(sums, begin + 1 + minimum)
    over = np.searchsorted(sums[1:], begin + target + 2 - separator, side="right")
    cut = np.maximum(np.maximum(enough, over), np.arange(len(flat)) + 1).tolist()
    at, counts, chunks = [], [], []
    first = 0
    for size in sizes.tolist():
        end, i, made = first + size, first, 0
        while i < end:
            to = min(cut[i], end)
            if i == first and flat[i] > target:
                to = i + 1
            at.append(i - first + 1)
            counts.append(to - i)
            i, made = to, made + 1
        chunks.append(made)
        first = end
    places = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(counts, pa.int32())], ["at", "n"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(chunks)]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, places)
    return pc.if_else(lengths.is_valid(), lists, pa.scalar(None, lists.type)) if lengths.null_count else lists


def chunk_sentences(
    c: Column | str,
    target: int = TARGET_SIZE,
    minimum: int = MIN_SIZE,
    separator: int = 0,
    no_sentence: str = "drop",
    sentences: Column | str | None = None,
) -> Column:
    """Split a text into sentences and group them; NULL or blank text gives no chunk.

    ``sentences`` names a column that holds them already.

    ``no_sentence`` decides on text that holds no sentence at all, such as
    ``...``: ``"drop"`` gives no chunk, ``"whole"`` keeps it as one chunk when
    it is no longer than ``target``.
    """
    if no_sentence not in ("drop", "whole"):
        raise ValueError("no_sentence must be 'drop' or 'whole'")
    chunks = group_sentences(split_sentences(c) if sentences is None else sentences, target, minimum, separator)
    if no_sentence == "whole":
        # Every other character starts a sentence, so only marks means no sentence.
        text = jtrim(c)
        only_marks = (text != "") & (F.btrim(text, F.lit(".!?")) == "")
        chunks = F.when(only_marks & (utf16_length(text) <= target), F.array(text)).otherwise(chunks)
    return F.coalesce(chunks, F.array().cast(_STRINGS))


def chunk_fixed(c: Column | str, size: int, overlap: int = 0) -> Column:
    """Fixed windows of ``size`` characters that start ``size - overlap`` apart (at least 1).

    Windows are cut from the trimmed text and not trimmed again, and short
    windows at the end are kept. Sizes are in code points.
    """
    if size < 1:
        raise ValueError("size must be positive")
    step = max(size - overlap, 1)
    text = jtrim(c)
    # One pass over the text: look ahead to take a window, then move on by a step.
    windows = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    return (
        F.when(is_blank(c), F.array().cast(_STRINGS))
        .when(F.length(text) <= size, F.array(text))
        .otherwise(windows)
    )
