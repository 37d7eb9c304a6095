"""Quality rules with an n-gram perplexity: modified Kneser-Ney over unfolded characters.

Spark counts the character 4-grams of all distinct texts by language and works out an interpolated
modified Kneser-Ney model of each language (``passagemill.llm.grams``).

A document's score is its mean negative log probability per character. The bands of a language lie
``REACH`` interquartile ranges below the first and above the third quartile of the scores of its
distinct texts that pass the base rules, so copies weigh as one; every row is judged. Short
documents get ``SLACK / sqrt(characters)`` more on both sides.

The model of folded 4-grams with ``MOST_LANGUAGES`` that ``quality`` used before is no longer part of
it; its functions (``count_grams``, ``Model``) are what tests hold the formulas to.

Nulls: a null text is empty: no words, so the base rule rejects it. A null language is a language.
"""

from __future__ import annotations

import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import grams
from passagemill.llm.common import Scratch, WordHashes, mix, text_bytes, windows

ORDER = 4
SYMBOLS = 40
GRAMS = SYMBOLS**ORDER
REACH, SLACK = 3.0, 1.5
MOST_LANGUAGES = 64
REST = "*rest*"
#: Characters counted or scored at once, and languages whose dense tables are held at once.
CHUNK, OPEN_LANGUAGES = 1 << 20, 8
#: Longs (64 bits each) that mark which texts may repeat; a broadcast table of that many rows at most.
WORDS = 1 << 18

PAD, SPACE, DIGIT, STOP, SIGN, CONTROL = range(6)
LETTER = 6  # a-z: 6..31; letters of other scripts: 32..38 by code point; the rest: 39
OTHER = 39


def _symbol(point: int) -> int:
    c = chr(point)
    if c.isspace():
        return SPACE
    if c.isdigit():
        return DIGIT
    if c in ".,;:!?'\"-()":
        return STOP
    base = unicodedata.normalize("NFD", c)[0].lower()
    if "a" <= base <= "z":
        return LETTER + ord(base) - 97
    if c.isalpha():
        return 32 + point % 7
    return SIGN if point > 32 and unicodedata.category(c)[0] in "PS" else CONTROL


def symbol_table() -> np.ndarray:
    """The symbol of each code point below U+10000; those above are ``OTHER``."""
    table = np.full(65_536, OTHER, np.int32)
    for point in range(65_536):
        if not 0xD800 <= point < 0xE000:
            table[point] = _symbol(point)
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def codes(text: str, table: np.ndarray) -> np.ndarray:
    """The code of the 4-gram that ends at each character; pads stand before the first."""
    at = points(text)
    symbols = np.full(len(at) + ORDER - 1, PAD, np.int32)
    symbols[ORDER - 1 :] = np.where(at < 65_536, table[np.minimum(at, 65_535)], OTHER)
    out = symbols[: len(at)].copy()
    for i in range(1, ORDER):
        out *= SYMBOLS
        out += symbols[i : i + len(at)]
    return out


# --- counting


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = symbol_table()
    dense: OrderedDict[str, np.ndarray] = OrderedDict()
    waiting: dict[str, list[np.ndarray]] = {}

    def settle(lang: str) -> None:
        parts = waiting.pop(lang, [])
        if parts:
            dense[lang] += np.bincount(np.concatenate(parts), minlength=GRAMS)

    def rows(lang: str) -> Iterator[pa.RecordBatch]:
        settle(lang)
        counts = dense.pop(lang)
        found = np.flatnonzero(counts)
        for lo in range(0, len(found), 50_000):
            part = found[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part.astype(np.int32)), pa.array(counts[part])],
                ["model", "code", "n"],
            )

    held: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            if lang not in dense:
                if len(dense) >= OPEN_LANGUAGES:
                    yield from rows(next(iter(dense)))
                dense[lang] = np.zeros(GRAMS, np.int64)
            dense.move_to_end(lang)
            waiting.setdefault(lang, []).append(codes(text, table))
            held[lang] = held.get(lang, 0) + len(text)
            if held[lang] >= CHUNK:
                settle(lang)
                held[lang] = 0
    for lang in list(dense):
        yield from rows(lang)


def count_grams(docs: DataFrame) -> DataFrame:
    """``(model, code, n)``: the 4-grams of every ``(model, text)``, summed over all documents."""
    return (
        docs.select("model", "text")
        .mapInArrow(_count_batches, "model string, code int, n long")
        .groupBy("model", "code").agg(F.sum("n").alias("n"))
    )


# --- the model


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from n-grams seen once, twice and more often (index 0 is unused)."""
    n = [int((counts == k).sum()) for k in range(1, 5)]
    out = np.array([0.0, 0.5, 0.75, 0.9])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in range(1, 4):
            if n[k - 1]:
                out[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)
    return out


def order_probabilities(grams: np.ndarray, counts: np.ndarray, lower) -> tuple[np.ndarray, ...]:
    """``(probability of each gram, histories, weight of each history)``, interpolated with ``lower``."""
    d = discounts(counts)
    group = np.minimum(counts, 3)
    histories, at = np.unique(grams // SYMBOLS, return_inverse=True)
    total = np.bincount(at, counts)
    weight = np.bincount(at, d[group]) / total
    p = (counts - d[group]) / total[at] + weight[at] * lower(grams)
    return p, histories, weight


@dataclass(frozen=True)
class Model:
    """Sorted hashes of n-grams with probabilities, and of histories with weights."""

    grams: np.ndarray
    probability: np.ndarray
    histories: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """``counts``: the sorted 4-gram codes and their numbers, by language."""
        grams, probs, histories, weights = [], [], [], []
        for model, (code, n) in counts.items():
            levels = [(code.astype(np.int64), n.astype(np.int64))]
            for k in range(ORDER - 1, 0, -1):  # distinct symbols before: continuation counts
                levels.append(np.unique(levels[-1][0] % SYMBOLS**k, return_counts=True))
            known = lambda g: np.full(len(g), 1 / SYMBOLS)
            for k, (code_k, n_k) in enumerate(reversed(levels), 1):
                p, h, w = order_probabilities(code_k, n_k, known)
                grams.append(key(model, k, code_k)), probs.append(p)
                histories.append(key(model, -k, h)), weights.append(w)

                def known(g, code_k=code_k, p=p, k=k):  # every suffix of a seen n-gram was seen
                    return p[np.searchsorted(code_k, g % SYMBOLS**k)]

        def by_hash(keys, values):
            keys = np.concatenate(keys or [np.empty(0, np.uint64)])
            values = np.concatenate(values or [np.empty(0)])
            order = np.argsort(keys)
            return keys[order], values[order].astype(np.float32)

        return cls(*by_hash(grams, probs), *by_hash(histories, weights))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float):
        if not len(keys):
            return np.zeros(len(wanted), bool), np.full(len(wanted), otherwise)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = keys[at] == wanted
        return found, np.where(found, values[at].astype(float), otherwise)

    def log_probability(self, model: str, code: np.ndarray) -> np.ndarray:
        """Natural log probability of the last symbol of each 4-gram after the others."""
        code = code.astype(np.int64)
        p = np.full(len(code), 1 / SYMBOLS)
        for k in range(1, ORDER + 1):
            gram = code % SYMBOLS**k
            seen, own = self._find(self.grams, self.probability, key(model, k, gram), 0.0)
            _, weight = self._find(self.histories, self.weight, key(model, -k, gram // SYMBOLS), 1.0)
            p = np.where(seen, own, weight * p)
        return np.log(p)


def key(model: str, level: int, code: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams (``level`` > 0) and histories (``level`` < 0) of a language."""
    salt = np.uint64(xxhash.xxh3_64_intdigest(f"{level} {model}"))
    return mix(code.astype(np.uint64) + salt)


def read_counts(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Bounded by ``(MOST_LANGUAGES + 1) * 40**4`` rows, of a few bytes each, read by language."""
    out = {}
    for row in sorted(r.model for r in counts.select("model").distinct().collect()):
        table = counts.filter(F.col("model") == row).select("code", "n").toArrow()
        code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(code)
        out[row] = code[order], n[order]
    return out


# --- rules on single documents


_SYMBOL_BYTES = np.isin(np.arange(256), list(b"#*$%&|<>"))
_HEAD_BYTES = (np.arange(256) & 0xC0) != 0x80
_SPACE_BYTES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def base_counts(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = int(_HEAD_BYTES[raw].sum() - _SPACE_BYTES[raw].sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) >= 5:
        _, at, times = np.unique(windows(hashes.of(words)), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[at] > 1)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + 5, -1)
        repeated = int((np.cumsum(edge) > 0).sum())
    return len(words), chars, int(_SYMBOL_BYTES[raw].sum()), len(lines) - len(set(lines)), repeated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = grams.Known(*shared.value), WordHashes()
        for batch in batches:
            raw = [t or b"" for t in text_bytes(batch.column(1))]
            counts = [base_counts(t, hashes) for t in raw]
            texts = [t.decode() for t in raw]
            sums, left = grams.surprises(known, batch.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), batch.column(3),
                    *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))),
                    pa.array(sums, pa.float64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([list(x.items()) for x in left], pa.map_(pa.int64(), pa.int64())),
                ],
                ["model", "row", "digest", *COUNTS, "total", "n_points", "left"],
            )

    return run


def with_joined(scored: DataFrame, rare: DataFrame) -> DataFrame:
    """``total`` with the n-grams in ``left``, joined once for each distinct text."""
    text = ["model", "digest"]
    left = scored.select(*text, F.explode("left").alias("key", "times"))
    sums = (
        left.groupBy(*text, "key").agg(F.first("times").alias("times")).join(rare, "key")
        .groupBy(*text).agg(F.sum(-F.col("times") * F.col("logp").cast("double")).alias("more"))
    )
    added = scored.join(sums, text, "left")
    return added.withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).drop("more")


def repeated_bits(hashed: DataFrame) -> DataFrame:
    """``(word, bits)``: a bit is set if a ``hash`` that occurs more than once falls on it; ``WORDS`` rows at most."""
    often = hashed.groupBy("hash").count().filter("count > 1").select(_word().alias("word"), _place().alias("place"))
    return often.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))


def _word():
    return F.pmod("hash", F.lit(WORDS))


def _place():
    return F.shiftrightunsigned("hash", 58).cast("int")


def may_repeat(docs: DataFrame) -> DataFrame:
    """``docs`` with ``repeats``: false only where no other row has the same ``model`` and ``text``.

    A text that falls on the bit of a repeated one is taken for one that may repeat.
    """
    hashed = docs.withColumn("hash", F.xxhash64("model", "text"))
    marked = hashed.withColumn("word", _word()).join(F.broadcast(repeated_bits(hashed)), "word", "left")
    repeats = F.coalesce(F.getbit("bits", _place()), F.lit(0)) == 1
    return marked.select(*docs.columns, repeats.alias("repeats"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``(model, text)`` once for each language and ``digest`` (128 bits).

    Only texts that may repeat are shuffled, copies meet map-side first; the others stay where they are read.
    """
    marked = may_repeat(docs.select("model", "digest", "text"))
    copies = marked.filter("repeats").groupBy("model", "digest").agg(F.first("text").alias("text"))
    return marked.filter("not repeats").select("model", "text").union(copies.select("model", "text"))


def quality(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), lang: str = "lang",
    max_repeat_percent: int = 20, min_words: int = 10, reach: float = REACH, slack: float = SLACK,
) -> DataFrame:
    """The columns ``keep`` with the base counts, ``surprise``, its band, ``base_failed`` and ``kept``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    named = docs.select(
        F.coalesce(F.col(lang), F.lit("")).alias("model"), F.col("text"), F.struct(*keep).alias("row"),
        F.md5("text").alias("digest"),
    )
    counts = scratch.keep(grams.count(distinct_texts(named)), "counts")
    model = scratch.keep(grams.probabilities(counts, scratch), "model")
    least = grams.travelling(model, grams.TRAVEL)
    shared = spark.sparkContext.broadcast(grams.collected(model, least))
    schema = named.select(
        "model", "row", "digest", *(F.lit(0).cast("long").alias(c) for c in COUNTS),
        F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n_points"),
        F.lit(None).cast("map<bigint,bigint>").alias("left"),
    ).schema
    for field in schema.fields:
        field.nullable = True
    scored = named.select("model", "text", "row", "digest").mapInArrow(_score_batches(shared), schema)
    scored = scratch.keep(scored, "scored")
    if least > 0:
        scored = scratch.keep(with_joined(scored, model.filter(F.col("step") < least)), "joined")
    scratch.drop("counts", "grams-1", "grams-2", "grams-3", "model")
    scored = scored.withColumn("surprise", F.when(F.col("n_points") > 0, F.col("total") / F.col("n_points")))

    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    # Copies have equal scores: each distinct text that passes the base rules counts once.
    once = scored.filter(~failed).groupBy("model", "digest").agg(F.max("surprise").alias("surprise"))
    quarter, three = (F.percentile_approx("surprise", q, 10_000) for q in (0.25, 0.75))
    bands = scratch.keep(once.groupBy("model").agg(quarter.alias("q1"), three.alias("q3")), "bands")
    if bands.limit(grams.FEW_LANGUAGES + 1).count() <= grams.FEW_LANGUAGES:  # one row per language
        bands = F.broadcast(bands)
    more = F.lit(slack) / F.sqrt(F.greatest("n_points", F.lit(1)))
    judged = (
        scored.join(bands, "model", "left")
        .withColumn("lower", F.col("q1") - reach * (F.col("q3") - F.col("q1")) - more)
        .withColumn("upper", F.col("q3") + reach * (F.col("q3") - F.col("q1")) + more)
    )
    inside = F.coalesce(F.col("surprise").between(F.col("lower"), F.col("upper")), F.lit(False))
    return judged.select(
        "row.*", *COUNTS, "surprise", "lower", "upper", failed.alias("base_failed"),
        (~failed & inside).alias("kept"),
    )
