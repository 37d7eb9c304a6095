"""Modified Kneser-Ney over the 4-grams of unfolded characters, for every language, in Spark.

An n-gram is kept exactly: the code point three places before, and the last three in 63 bits. Tasks
count what they read, Spark adds up by (language, n-gram) and works out continuation counts,
discounts and probabilities of all orders by groups of n-grams, so neither an alphabet nor the
number of languages has a bound. A history has no more followers than its language has characters.

The n-grams that occur most often, up to ``TRAVEL``, travel to the tasks as sorted hashes; what a
document holds of the others is joined, once for each distinct text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import Scratch

#: Stands before a text; no code point.
PAD = 0x110000
BITS = 21
TWO, ONE = (1 << 2 * BITS) - 1, (1 << BITS) - 1
#: Characters worked on at once, and n-grams a task counts before it hands them on.
CHUNK, HELD = 1 << 20, 1 << 21
#: N-grams that travel to the tasks, and languages whose few values are broadcast.
TRAVEL, FEW_LANGUAGES = 1 << 22, 10_000

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))
_HEAD = np.full(3, PAD, "<u4").tobytes()


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a long, after what gave the seed."""
    h = seed + _P5 + np.uint64(8)
    h = h ^ (_rotated(x.astype(np.uint64) * _P2, 31) * _P1)
    h = _rotated(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def key_column():
    return F.xxhash64("model", F.col("first").cast("long"), "rest")


def gram_parts(models: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """``(text, key, first, rest)`` of the 4-gram that ends at each character, ``CHUNK`` or so at once."""
    seeds = np.array([xxhash.xxh64_intdigest(m.encode(), seed=42) for m in models], np.uint64)

    def worked_out(at: list[int], parts: list[bytes]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(p) // 4 for p in parts])
        s = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
        own = np.ones(len(s), bool)
        own[(np.cumsum(sizes) - sizes)[:, None] + np.arange(3)] = False
        text, own = np.repeat(np.array(at), sizes)[own], own[3:]
        rest = (s[1:-2] << 2 * BITS | s[2:-1] << BITS | s[3:])[own]
        first = s[:-3][own]
        return text, hash_long(rest, hash_long(first, seeds[text])), first, rest

    at, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text), CHUNK):
            head = _HEAD if not lo else text[lo - 3 : lo].encode("utf-32-le")
            at.append(i), parts.append(head + text[lo : lo + CHUNK].encode("utf-32-le"))
            held += len(parts[-1]) // 4
            if held >= CHUNK:
                yield worked_out(at, parts)
                at, parts, held = [], [], 0
    if parts:
        yield worked_out(at, parts)


# --- counting


def _tally(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of equal key (the first column) become one."""
    order = np.argsort(columns[0])
    ordered = columns[0][order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return [c[order[starts]] for c in columns], np.add.reduceat(n[order], starts)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[str, int] = {}
    parts: list[tuple[list[np.ndarray], np.ndarray]] = []

    def merged():
        columns = [np.concatenate([p[0][i] for p in parts]) for i in range(4)]
        return _tally(columns, np.concatenate([p[1] for p in parts]))

    def rows() -> Iterator[pa.RecordBatch]:
        names = pa.array(list(numbers), pa.string())
        for (_, model, first, rest), n in parts:
            for lo in range(0, len(n), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(model[part])), *(pa.array(c[part]) for c in (first.astype(np.int32), rest, n))],
                    ["model", "first", "rest", "n"],
                )

    for batch in batches:
        models, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        number = np.array([numbers.setdefault(m, len(numbers)) for m in models], np.int64)
        for text, key, first, rest in gram_parts(models, texts):
            parts.append(_tally([key, number[text], first, rest], np.ones(len(key), np.int64)))
            if sum(len(n) for _, n in parts) > HELD:
                parts = [merged()]
                if len(parts[0][1]) > HELD // 2:
                    yield from rows()
                    parts = []
    if parts:
        parts = [merged()]
        yield from rows()


def count(docs: DataFrame) -> DataFrame:
    """``(model, first, rest, n)``: the 4-grams of every ``(model, text)``."""
    return (
        docs.select("model", "text").mapInArrow(_count_batches, "model string, first int, rest long, n long")
        .groupBy("model", "first", "rest").agg(F.sum("n").alias("n"))
    )


# --- the model


def _discounts(grams: DataFrame) -> DataFrame:
    """By language: what is taken from n-grams seen once, twice and more often, as in ``kneser.discounts``."""
    n = [F.sum((F.col("n") == k).cast("long")) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])

    def taken(k: int, otherwise: float):
        value = F.lit(float(k)) - (k + 1) * y * n[k] / n[k - 1]
        value = F.least(F.greatest(value, F.lit(0.05)), F.lit(k - 0.05))
        return F.when((n[0] > 0) & (n[1] > 0) & (n[k - 1] > 0), value).otherwise(otherwise).alias(f"d{k}")

    return grams.groupBy("model").agg(taken(1, 0.5), taken(2, 0.75), taken(3, 0.9), F.count("*").alias("grams"))


def probabilities(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, step, logp)`` for every n-gram of the highest order; ``step`` grows with its count."""
    fewer = lambda grams, mask, name: scratch.keep(
        grams.groupBy("model", F.col("rest").bitwiseAND(F.lit(mask)).alias("rest")).agg(F.count("*").alias("n")), name
    )
    three = fewer(counts, (1 << 63) - 1, "grams-3")
    two = fewer(three, TWO, "grams-2")
    one = fewer(two, ONE, "grams-1")
    few = one.select("model").distinct().limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES
    small = F.broadcast if few else lambda table: table

    history = F.shiftright("rest", BITS)
    lower = None
    for grams, before, suffix in (
        (one, [], None), (two, [history], ONE), (three, [history], TWO), (counts, ["first", history], (1 << 63) - 1),
    ):
        table = grams.join(small(_discounts(grams)), "model")
        if lower is None:
            table = table.withColumn("below", 1 / F.col("grams"))
        else:
            table = table.withColumn("suffix", F.col("rest").bitwiseAND(F.lit(suffix)))
            below = lower.select("model", F.col("rest").alias("suffix"), F.col("p").alias("below"))
            table = table.join(below, ["model", "suffix"])  # every suffix of a seen n-gram was seen
        over = Window.partitionBy("model", *before)
        seen = lambda which: F.sum(which.cast("long")).over(over)
        mass = sum(F.col(f"d{k}") * seen(F.col("n") == k if k < 3 else F.col("n") > 2) for k in (1, 2, 3))
        own = F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = (own + mass * F.col("below")) / F.sum("n").over(over)
        lower = table.select(*grams.columns, p.alias("p"))
    return lower.select(
        key_column().alias("key"), F.floor(8 * F.log2("n")).cast("int").alias("step"), F.log("p").cast("float").alias("logp")
    )


def travelling(model: DataFrame, most: int) -> int:
    """The least ``step`` from which on at most ``most`` n-grams are."""
    held, least = 0, None
    for step, n in model.groupBy("step").count().orderBy(F.desc("step")).collect():  # 8 for each doubling
        held += n
        if held > most:
            return (least if least is not None else step + 1)
        least = step
    return 0


class Known:
    """Values by 64-bit key: a table of slots by the highest bits, binary search where slots clash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_keys, self.slot_values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan, np.float32)
        self.slot_keys[keys >> self.shift], self.slot_values[keys >> self.shift] = keys, values

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """NaN where there is no value."""
        slot = wanted >> self.shift
        found = np.where(self.slot_keys[slot] == wanted, self.slot_values[slot], np.float32(np.nan))
        missing = np.flatnonzero(np.isnan(found))
        if len(missing) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, wanted[missing]), len(self.keys) - 1)
            found[missing] = np.where(self.keys[at] == wanted[missing], self.values[at], np.float32(np.nan))
        return found


def collected(model: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of the ``TRAVEL`` n-grams at most that travel."""
    table = model.filter(F.col("step") >= least).select("key", "logp").toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("logp").to_numpy()[order]


def surprises(known: Known, models: list[str], texts: list[str]) -> tuple[np.ndarray, list[dict[int, int]]]:
    """Each text's sum of negative log probabilities, and how often it has keys without a value."""
    sums, left = np.zeros(len(texts)), [{} for _ in texts]
    for text, key, _, _ in gram_parts(models, texts):
        values = known.find(key)
        missing = np.isnan(values)
        sums += np.bincount(text[~missing], -values[~missing].astype(float), len(texts))
        for i, k in zip(text[missing].tolist(), key[missing].view(np.int64).tolist()):
            left[i][k] = left[i].get(k, 0) + 1
    return sums, left
