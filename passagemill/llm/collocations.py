"""Phrases of two and three words that stand together more often than their parts would.

N-grams are counted in sorted *counting quotient filters*. Words have numbers, and an n-gram is the
packed string of its words' numbers. A Feistel network permutes the packed bits, so that keys are
spread evenly whatever the words, and can be taken back: the key's upper bits are its *quotient*,
written in unary in the order of the sorted keys, all bits below are its *remainder*, written in
full, and each key has a counter. Nothing is lost, and a filter takes some bytes an n-gram.

* ``tokenised`` turns texts into *shards* of about two million words: a list of the shard's words
  with their counts, one for each language, and the text as places in that list. It is written once.
* ``dictionary`` adds the counts up and numbers the words that are frequent enough. A phrase cannot
  be more frequent than its words, so all others only part phrases. Each shard gets back the
  numbers of its own words, by join; no task ever holds the whole dictionary.
* ``_count_batches`` counts the n-grams of a shard and cuts the sorted filter into blocks of keys.
* ``_merge_batches`` merges the filters of a block across all shards, drops what is too rare, and
  takes the permutation back. Blocks are even, as keys are, and as many as the words need. A word
  or phrase that is everywhere is one entry a shard.
* Scores are joins of the n-grams' counts with each other, in exact decimals.

Nulls: a null text has no words, a null ``lang`` is the language ``und``. Empty texts and tables
give nothing. Long texts are read in slices, and may go on in the next shard. Equal scores are
ranked by count, then phrase. Repeated rows count again. Further columns are left out, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import Scratch, mix, text_bytes
from passagemill.operators.ranges import dense_ids

#: Least count of a phrase, phrases of a language that are returned, and the percentage of a
#: phrase's count at which a longer one replaces it.
LEAST, TOP, REPLACED = 10, 2000, 50
LONGEST = 3

SHARD_WORDS = 1 << 21
#: Entries of a block, before equal ones of different shards are added up.
BLOCK_ENTRIES = 1 << 20
_SLICE = 1 << 20

# A-Z to a-z; the marks that part pieces become one byte that UTF-8 never holds.
_BREAK = 0xFF
_TABLE = bytes(
    _BREAK if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_MARK = bytes([_BREAK])

_SHARD = "shard string, lang string, words array<string>, counts array<long>, stream binary, carried int, total long"


# --- words


class _Shard:
    """The words of one language in a shard, and the texts as places in their list; 0 is a break."""

    def __init__(self, carried: list[bytes] = ()):
        self.places: dict[bytes, int] = {_MARK: 0}
        self.parts: list[np.ndarray] = []
        self.size, self.carried = 0, len(carried)
        self.add(carried)

    def add(self, words: list[bytes]) -> None:
        places = self.places
        numbers = [places.setdefault(w, len(places)) for w in words]
        self.parts.append(np.array(numbers, np.int32))
        self.size += len(words)

    def row(self, lang: str) -> tuple:
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream[self.carried :], minlength=len(self.places))[1:]
        words = list(self.places)[1:]
        return uuid.uuid4().hex, lang, words, counts, stream.tobytes(), self.carried, int(counts.sum())


def _sliced(text: bytes) -> Iterator[list[bytes]]:
    """The words and breaks of a text, a slice at a time."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].translate(_TABLE).replace(_MARK, b" \xff ").split()
        at = end


def _shard_batches(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    shards: dict[str, _Shard] = {}

    def closed():
        for lang, shard in shards.items():
            name, lang, words, counts, stream, carried, total = shard.row(lang)
            lists = lambda values, kind: pa.ListArray.from_arrays(
                pa.array([0, len(values)], pa.int32()), pa.array(values, kind)
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([lang]), lists(words, pa.binary()).cast(pa.list_(pa.string())),
                 lists(counts, pa.int64()), pa.array([stream], pa.binary()), pa.array([carried], pa.int32()),
                 pa.array([total], pa.int64())],
                ["shard", "lang", "words", "counts", "stream", "carried", "total"],
            )
        shards.clear()

    size = 0
    for batch in batches:
        for text, lang in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
            tail: list[bytes] = []
            for words in _sliced(text or b""):
                if size >= shard_words:
                    yield from closed()
                    size = 0
                if lang not in shards:
                    shards[lang] = _Shard(tail)
                shards[lang].add(words)
                size += len(words)
                tail = (tail + words[-LONGEST + 1 :])[-LONGEST + 1 :]
            if tail and lang in shards:
                shards[lang].add([_MARK])
    yield from closed()


def tokenised(docs: DataFrame, text_col: str, lang_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard and language: its words with their counts, and its texts as their places."""
    texts = docs.select(text_col, F.coalesce(lang_col, F.lit("und")).alias("lang"))
    return texts.mapInArrow(lambda batches: _shard_batches(batches, shard_words), _SHARD)


def dictionary(shards: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """``(id, lang, word, n)`` of the words that occur ``least`` times in a language."""
    entry = F.explode(F.arrays_zip("words", "counts")).alias("e")
    each = shards.select("lang", entry).select("lang", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    counted = each.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return scratch.keep(dense_ids(scratch.keep(counted, "frequent")), "dictionary")


# --- filters


class Packing:
    """Word numbers of ``bits`` bits packed into a key of two halves, permuted and back."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits = n, bits
        self.half = -(-n * bits // 2)
        if self.half > 64:
            raise ValueError(f"{n} numbers of {bits} bits do not fit in a key")
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, k: int, x: np.ndarray) -> np.ndarray:
        return mix(x + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) >> np.uint64(64 - self.half)

    def keys(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The permuted halves of n-grams whose words are ``ids[0][i], ids[1][i], ...``."""
        high, low = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
        at = self.n * self.bits
        for part in ids:
            part = part.astype(np.uint64)
            at -= self.bits
            if at >= self.half:
                high |= part << np.uint64(at - self.half)
            else:
                low |= (part << np.uint64(at)) & self.mask
                if at + self.bits > self.half:
                    high |= part >> np.uint64(self.half - at)
        for k in range(4):
            high, low = low, high ^ self._round(k, low)
        return high, low

    def ids(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        for k in reversed(range(4)):
            high, low = low ^ self._round(k, high), high
        parts, at = [], self.n * self.bits
        whole = np.uint64((1 << self.bits) - 1)
        for _ in range(self.n):
            at -= self.bits
            if at >= self.half:
                part = high >> np.uint64(at - self.half)
            else:
                part = low >> np.uint64(at)
                if at + self.bits > self.half:
                    part = part | (high << np.uint64(self.half - at))
            parts.append((part & whole).astype(np.int64))
        return parts

    def summed(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None):
        """Distinct keys in order with the sums of their counts (one each if there are none)."""
        if 2 * self.half <= 64:
            whole = (high << np.uint64(self.half)) | low
            order = whole.argsort(kind="stable")
        else:
            order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else order > 0
        begin = np.flatnonzero(new)
        if counts is None:
            total = np.diff(np.append(begin, len(high)))
        else:
            total = np.add.reduceat(counts[order], begin) if len(begin) else counts[order]
        return high[begin], low[begin], total


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _from_bytes(data: memoryview, k: int, bits: int) -> tuple[np.ndarray, int]:
    width = -(-bits // 8)
    wide = np.zeros((k, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, k * width).reshape(k, width)
    return wide.view("<u8").ravel().astype(np.uint64), k * width


class Filter:
    """Sorted keys with counters, as bytes, for keys that agree in their first ``block`` bits.

    Quotients stand in unary: for each one a 1 bit a key and a 0 bit. Remainders are whole bytes.
    A counter is one byte; larger counts follow at the end.
    """

    @staticmethod
    def packed(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, block: int) -> bytes:
        k, rest = len(high), half - block
        quotient = min(rest, max(k - 1, 0).bit_length())
        inside = high & np.uint64((1 << rest) - 1)
        unary = np.zeros(k + (1 << quotient), np.uint8)
        if k:
            unary[(inside >> np.uint64(rest - quotient)).astype(np.int64) + np.arange(k)] = 1
        remainder = inside & np.uint64((1 << (rest - quotient)) - 1)
        small = np.minimum(counts - 1, 255).astype(np.uint8)
        return b"".join([
            np.array([k, quotient], "<u8").tobytes(), np.packbits(unary).tobytes(),
            _bytes_of(remainder, rest - quotient), _bytes_of(low, half), small.tobytes(),
            counts[small == 255].astype("<u8").tobytes(),
        ])

    @staticmethod
    def unpacked(data: bytes, half: int, block: int, number: int):
        """The keys and counters of block ``number``."""
        view = memoryview(data)
        k, quotient = (int(x) for x in np.frombuffer(view, "<u8", 2))
        rest, at = half - block, 16
        length = k + (1 << quotient)
        unary = np.unpackbits(np.frombuffer(view, np.uint8, -(-length // 8), at), count=length)
        at += -(-length // 8)
        quotients = (np.flatnonzero(unary) - np.arange(k)).astype(np.uint64)
        remainder, used = _from_bytes(view[at:], k, rest - quotient)
        low, more = _from_bytes(view[at + used :], k, half)
        at += used + more
        counts = np.frombuffer(view, np.uint8, k, at).astype(np.int64) + 1
        counts[counts == 256] = np.frombuffer(view, "<u8", -1, at + k)
        top = np.uint64(number << rest) if block else np.uint64(0)
        return top | (quotients << np.uint64(rest - quotient)) | remainder, low, counts


def _count_batches(batches: Iterator[pa.RecordBatch], bits: int, blocks: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Shards ``(stream, carried, ids: (place, id))`` to filters ``(words, block, filter)``."""
    for batch in batches:
        for i in range(batch.num_rows):
            stream = np.frombuffer(batch.column(0)[i].as_py(), np.int32)
            carried, known = batch.column(1)[i].as_py(), batch.column(2)[i].values
            number = np.zeros(int(stream.max(initial=0)) + 1, np.int64)
            if known is not None and len(known):
                number[known.field("place").to_numpy()] = known.field("id").to_numpy()
            ids = number[stream]
            for n in range(2, LONGEST + 1):
                packing = Packing(n, bits)
                whole = np.ones(max(len(ids) - n + 1, 0), bool)
                for j in range(n):
                    whole &= ids[j : len(whole) + j] > 0
                # What ends in the words carried over was counted in the shard before.
                whole[: max(carried - n + 1, 0)] = False
                at = np.flatnonzero(whole)
                high, low, counts = packing.summed(*packing.keys([ids[at + j] for j in range(n)]))
                shift = np.uint64(packing.half - blocks[n])
                block = (high >> shift).astype(np.int64) if blocks[n] else np.zeros(len(high), np.int64)
                begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else block
                if not len(begin):
                    continue
                cuts = zip(begin, np.append(begin[1:], len(block)))
                filters = [Filter.packed(high[a:b], low[a:b], counts[a:b], packing.half, blocks[n]) for a, b in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begin), n, np.int32)), pa.array(block[begin]), pa.array(filters, pa.binary())],
                    ["words", "block", "filter"],
                )


def _merge_batches(
    batches: Iterator[pa.RecordBatch], bits: int, blocks: dict[int, int], least: int
) -> Iterator[pa.RecordBatch]:
    """Filters sorted by ``(words, block)`` to the phrases ``(id_1, id_2, id_3, a)``; ``id_3`` may be null."""
    current, held, size = None, [], 0

    def merged():
        n = current[0]
        packing = Packing(n, bits)
        held[:] = [packing.summed(*(np.concatenate(part) for part in zip(*held)))]
        return packing, *held[0]

    def finished():
        packing, high, low, counts = merged()
        often = counts >= least
        ids = packing.ids(high[often], low[often])
        third = pa.array(ids[2]) if len(ids) > 2 else pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[0]), pa.array(ids[1]), third, pa.array(counts[often])], ["id_1", "id_2", "id_3", "a"]
        )

    for batch in batches:
        numbers = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for i, place in enumerate(numbers):
            if place != current:
                if held:
                    yield finished()
                current, held, size = place, [], 0
            n, block = place
            part = Filter.unpacked(batch.column(2)[i].as_py(), Packing(n, bits).half, blocks[n], block)
            held.append(part)
            size += len(part[0])
            if size > 4 * BLOCK_ENTRIES + 2 * len(held[0][0]):
                size = len(merged()[1])
    if held:
        yield finished()


def phrases(shards: DataFrame, known: DataFrame, scratch: Scratch, least: int = LEAST,
            block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``(id_1, id_2, id_3, a)``: all phrases of two (``id_3`` null) or three words that occur ``least`` times."""
    largest, total = known.agg(F.max("id")).first()[0], shards.agg(F.sum("total")).first()[0]
    bits = max(int(largest or 1).bit_length(), 1)
    wanted = max(-(-int(total or 0) // block_entries), 1)
    blocks = {n: min((wanted - 1).bit_length(), Packing(n, bits).half) for n in range(2, LONGEST + 1)}

    place = shards.select("shard", "lang", F.posexplode("words").alias("place", "word"))
    numbered = place.join(known.select("lang", "word", "id"), ["lang", "word"])
    entry = F.struct((F.col("place") + 1).alias("place"), "id")
    ids = numbered.groupBy("shard").agg(F.collect_list(entry).alias("ids"))
    filters = shards.select("shard", "stream", "carried").join(ids, "shard").select("stream", "carried", "ids")
    made = filters.mapInArrow(
        lambda batches: _count_batches(batches, bits, blocks), "words int, block long, filter binary"
    )
    key = ["words", "block"]
    merged = made.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        lambda batches: _merge_batches(batches, bits, blocks, least), "id_1 long, id_2 long, id_3 long, a long"
    )
    return scratch.keep(merged, "phrases")


# --- scores


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exact: products may have 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    square = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def scored(found: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of all phrases that no longer one replaces."""
    word = lambda i: known.select(
        F.col("id").alias(f"id_{i}"), F.col("word").alias(f"word_{i}"), F.col("n").alias(f"n_{i}"),
        *(["lang"] if i == 1 else []),
    )
    pairs = scratch.keep(
        found.filter("id_3 is null").drop("id_3").join(word(1), "id_1").join(word(2), "id_2"), "pairs"
    )
    triples = found.filter("id_3 is not null")
    # Every part of a frequent phrase is frequent, so nothing is lost in the joins.
    front = pairs.select("id_1", "id_2", "lang", "word_1", "word_2", F.col("a").alias("front"), "n_1")
    back = pairs.select(
        F.col("id_1").alias("id_2"), F.col("id_2").alias("id_3"), F.col("word_2").alias("word_3"),
        F.col("a").alias("back"), F.col("n_2").alias("n_3"),
    )
    three = triples.join(front, ["id_1", "id_2"]).join(back, ["id_2", "id_3"])
    three = three.withColumn("first", _score(F.col("a"), F.col("n_1"), F.col("back"))).withColumn(
        "second", _score(F.col("a"), F.col("front"), F.col("n_3"))
    )
    later = F.col("second") < F.col("first")
    three = three.select(
        "lang", F.concat_ws(" ", "word_1", "word_2", "word_3").alias("phrase"), "a",
        F.when(later, F.col("front")).otherwise(F.col("n_1")).alias("l"),
        F.when(later, F.col("n_3")).otherwise(F.col("back")).alias("r"),
        F.least("first", "second").alias("score"),
    )
    inside = triples.select("id_1", "id_2", "a").union(triples.select("id_2", "id_3", "a"))
    longer = inside.groupBy("id_1", "id_2").agg(F.max("a").alias("longer"))
    two = pairs.join(longer, ["id_1", "id_2"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < REPLACED * F.col("a"))
    )
    two = two.select(
        "lang", F.concat_ws(" ", "word_1", "word_2").alias("phrase"), "a", F.col("n_1").alias("l"),
        F.col("n_2").alias("r"), _score(F.col("a"), F.col("n_1"), F.col("n_2")).alias("score"),
    )
    return two.union(three)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = LEAST, top: int = TOP,
    shard_words: int = SHARD_WORDS, block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    shards = scratch.keep(tokenised(docs, text_col, lang_col, shard_words), "shards")
    known = dictionary(shards, scratch, least)
    found = phrases(shards, known, scratch, least, block_entries)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(found, known, scratch).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = shards.groupBy("lang").agg(F.sum("total").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
