"""Document probability over all subword segmentations of an existing vocabulary.

A text is a sequence of words and one end. Each word, led by the vocabulary's space sign, is the
sum over all its segmentations into pieces of the product of the pieces' probabilities; a forward
recursion in log space adds them up. Characters without a piece are spelled in byte pieces.

Pieces start with probabilities by their ranks, as the vocabulary's scores are ranks (0, -1, -2,
...), not logarithms: a piece of rank ``r`` weighs ``(r + SHIFT) ** -EXPONENT``. They are then trained
by expectation and maximisation, ``STEPS`` steps, each over all distinct training words. Forward and
backward sums are taken for many words at once, place by place. A training word is one more edge of its
lattice, from its beginning to its end: it keeps its count less a discount ``D``, and what was taken
off is dealt to all words by their pieces. So a word ``w`` of count ``c`` has the probability
``(max(c - D, 0) + D * words * pieces(w)) / tokens``, the end its share of the training tokens, and
all of them add up to one. ``D`` is estimated from the numbers of words that occur once and twice.

Words are counted over all documents, training and held out. The most frequent words, ``HOT`` at
most, travel to every task with their counts and probabilities; what else a document holds is
joined with the table of counts. So nothing that is broadcast grows with the corpus, and no word is
too frequent for the join.

Nulls: a null text is empty and consists of the end. A row without ``doc_id`` is held out of
training. Without training words, pieces weigh by rank and a word is as likely as an end. Repeated rows are documents of their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import LOWER, Scratch, text_bytes

HOT = 200_000
EXPONENT = 1.0
SHIFT = 2.7
#: Training steps, each over all distinct words.
STEPS = 4
#: Weight of the start in each step: of the words' pieces, and for each piece of the vocabulary.
PRIOR, PRIOR_PIECE = 0.002, 0.01
#: Words less likely than this are worked out in logarithms.
TINY = 1e-200
#: Places of a word that is worked out with others. Of longer ones most would need logarithms.
PLACES = 64
SPACE = "▁"
#: Distinct words that a counting or scoring task remembers at once.
HELD_WORDS = 300_000


@dataclass(frozen=True)
class Pieces:
    """Ranks of the pieces, and of a byte; byte pieces count as the rarest."""

    ranks: dict[str, float]
    byte_rank: float

    @classmethod
    def read(cls, path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks = {}
        for i in range(model.get_piece_size()):
            plain = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
            # Some pieces of repeated spaces carry a sentinel instead of a rank.
            if plain and model.get_score(i) > -1e8:
                ranks[model.id_to_piece(i)] = -model.get_score(i)
        return cls(ranks, max(ranks.values(), default=0.0))

    def weights(self, exponents: tuple[float, ...], end: float) -> Weights:
        """For each exponent, log probabilities that add up to one with the end's."""
        log_rank = {p: math.log(r + SHIFT) for p, r in self.ranks.items()}
        byte = math.log(self.byte_rank + SHIFT)
        shifts = []
        for a in exponents:
            total = sum(math.exp(-a * x) for x in log_rank.values()) + 256 * math.exp(-a * byte)
            shifts.append(math.log1p(-end) - math.log(total))
        beginnings = {p[:i] for p in log_rank for i in range(1, len(p))}
        table = {p: log_rank.get(p) for p in beginnings | log_rank.keys()}
        return Weights(table, byte, tuple(zip(exponents, shifts)))


@dataclass(frozen=True)
class Weights:
    """``pieces``: log rank of each piece, None for a mere beginning of pieces; ``byte``: that of a
    byte. A piece's log probability is ``shift - exponent * log rank``, for each of ``laws``."""

    pieces: dict[str, float | None]
    byte: float
    laws: tuple[tuple[float, float], ...]

    def edges(self, text: str) -> list[list[tuple[int, float, int]]]:
        """From each place, the places that pieces lead to, with their log ranks and numbers."""
        find, n = self.pieces.get, len(text)
        out = []
        for start in range(n):
            end = start + 1
            first = find(text[start], "")
            steps = []
            if first == "" or first is None:
                size = len(text[start].encode())
                steps.append((end, self.byte * size, size))
            while first != "":
                if first is not None:
                    steps.append((end, first, 1))
                if end == n:
                    break
                end += 1
                first = find(text[start:end], "")
            out.append(steps)
        return out

    def word(self, word: str) -> list[float]:
        """Natural log of the probability of a word under each law: the sum over all segmentations."""
        text = SPACE + word
        edges, n = self.edges(text), len(text)
        return [_forward(edges, n, a, shift) for a, shift in self.laws]


def _forward(edges: list[list[tuple[int, float, int]]], n: int, exponent: float, shift: float) -> float:
    reached: list[list[float]] = [[] for _ in range(n + 1)]
    reached[0].append(0.0)
    for start, steps in enumerate(edges):
        ways = reached[start]
        if not ways:
            continue
        here = _log_sum(ways)
        reached[start] = ()
        for end, rank, number in steps:
            reached[end].append(here + number * shift - exponent * rank)
    return _log_sum(reached[n])


@dataclass(frozen=True)
class Trie:
    """All beginnings of pieces as arrays, to find the pieces of many words at once.

    Each beginning has a row. ``keys``, ``row * len(letters) + letter`` each, lie in a hash table with
    linear probing and lead to ``rows``; ``letters`` are the sorted code points of pieces. ``numbers``: the
    number of a row's piece, -1 without one.
    """

    letters: np.ndarray
    keys: np.ndarray
    rows: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, numbers: dict[str, int | None]) -> Trie:
        row = {"": 0} | {text: i for i, text in enumerate(numbers, 1)}
        letters = sorted({text[-1] for text in numbers})
        letter = {c: i for i, c in enumerate(letters)}
        key = np.array([row[text[:-1]] * len(letters) + letter[text[-1]] for text in numbers], np.int64)
        size = 1 << max(4 * len(key), 2).bit_length()
        keys, rows = np.full(size, -1), np.zeros(size, np.int64)
        slot, left = _slots(key, size), np.arange(len(key))
        while len(left):
            free = left[keys[slot[left]] < 0]
            keys[slot[free]] = key[free]  # of several the last one stays
            rows[slot[free]] = free + 1
            left = left[keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) % size
        return cls(
            np.array([ord(c) for c in letters], np.int64), keys, rows,
            np.array([-1] + [-1 if number is None else number for number in numbers.values()], np.int64),
        )

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys there are, and the rows that these lead to."""
        slot = _slots(key, len(self.keys))
        found = self.keys[slot]
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            found[left] = self.keys[slot[left]]
            left = left[(found[left] != key[left]) & (found[left] >= 0)]
        known = np.flatnonzero((found == key) & (key >= 0))
        return known, self.rows[slot[known]]

    def walk(self, text: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of code points, ``left`` of a word's from each on: for each length, where pieces start, and their numbers."""
        if not len(self.letters):
            return
        letter = np.minimum(np.searchsorted(self.letters, text), len(self.letters) - 1)
        letter[self.letters[letter] != text] = -1
        at, row, length = np.arange(len(text)), np.zeros(len(text), np.int64), 0
        while len(at):
            seen = letter[at + length]
            known, row = self._find(np.where(seen >= 0, row * len(self.letters) + seen, -1))
            at, length = at[known], length + 1
            number = self.numbers[row]
            whole = np.flatnonzero(number >= 0)
            yield at[whole], number[whole]
            more = np.flatnonzero(left[at] > length)
            at, row = at[more], row[more]


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    """Where to look first in a hash table whose size is a power of two."""
    spread = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(65 - size.bit_length())).astype(np.int64)


@dataclass(frozen=True)
class Law:
    """Trained pieces. ``numbers``: the number of each piece, None for a mere beginning of pieces;
    ``p``: the probabilities by number, the last one a byte's; ``start``: those before any training;
    ``trie``: the pieces once more, as arrays."""

    numbers: dict[str, int | None]
    p: list[float]
    start: list[float]
    trie: Trie

    @classmethod
    def of(cls, pieces: Pieces) -> Law:
        weights = pieces.weights((EXPONENT,), 0.0)
        ((a, shift),) = weights.laws
        numbers, p = {}, []
        for piece, rank in weights.pieces.items():
            numbers[piece] = None if rank is None else len(p)
            if rank is not None:
                p.append(math.exp(shift - a * rank))
        p.append(math.exp(shift - a * weights.byte))
        return cls(numbers, p, p, Trie.of(numbers))

    def edges(self, text: str) -> list[list[tuple[int, int, float, int]]]:
        """From each place, the places that pieces lead to: end, number, probability, pieces taken."""
        find, p, n, byte = self.numbers.get, self.p, len(text), len(self.p) - 1
        out = []
        for start in range(n):
            end = start + 1
            first = find(text[start], -1)
            steps = []
            if first == -1 or first is None:
                size = len(text[start].encode())
                steps.append((end, byte, p[byte] ** size, size))
            while first != -1:
                if first is not None:
                    steps.append((end, first, p[first], 1))
                if end == n:
                    break
                end += 1
                first = find(text[start:end], -1)
            out.append(steps)
        return out

    def word(self, word: str) -> float:
        """Natural log of the probability of a word's pieces: the sum over all segmentations."""
        text = SPACE + word
        edges = self.edges(text)
        ways = _ways(edges, len(text))
        return math.log(ways[-1]) if ways[-1] > TINY else _log_ways(edges, len(text))[-1]

    def expect(self, word: str, seen: list[float]) -> None:
        """Add to ``seen``, by number, how often each piece is expected in the segmentations of a word."""
        text = SPACE + word
        n, edges = len(text), self.edges(text)
        ways = _ways(edges, n)
        if ways[n] <= TINY:
            return self._expect_long(edges, n, seen)
        after = [0.0] * n + [1.0]
        for start in range(n - 1, -1, -1):
            total, here = 0.0, ways[start] / ways[n]
            for end, number, p, taken in edges[start]:
                rest = p * after[end]
                total += rest
                seen[number] += here * rest * taken
            after[start] = total

    @staticmethod
    def _expect_long(edges, n: int, seen: list[float]) -> None:
        ways = _log_ways(edges, n)
        after = [0.0] * (n + 1)
        for start in range(n - 1, -1, -1):
            rests = [math.log(p) + after[end] for end, _, p, _ in edges[start]]
            for (_, number, _, taken), rest in zip(edges[start], rests):
                seen[number] += math.exp(ways[start] + rest - ways[n]) * taken
            after[start] = _log_sum(rests)

    def learned(self, seen: dict[int, float]) -> Law:
        """The law after a step in which pieces were expected as often as ``seen``."""
        total = sum(seen.values())
        held = PRIOR * total + PRIOR_PIECE * len(self.p)
        byte = len(self.p) - 1
        p = [
            (seen.get(i, 0.0) / (256 if i == byte else 1) + held * first) / (total + held)
            for i, first in enumerate(self.start)
        ]
        return Law(self.numbers, p, self.start, self.trie)

    def words(self, words: pa.Array) -> np.ndarray:
        """As :meth:`word`, for each of many words."""
        out, (short, rest) = np.empty(len(words)), _by_length(words)
        if len(short):
            many = _Lattices(self, words.take(pa.array(short)))
            total = many.ways()[many.ends]
            usable = total > TINY
            out[short[usable]] = np.log(total[usable])
            rest = np.concatenate([rest, short[~usable]])
        for i in rest:
            out[i] = self.word(words[int(i)].as_py())
        return out

    def expect_all(self, words: pa.Array, seen: np.ndarray) -> None:
        """As :meth:`expect`, for each of many words."""
        short, rest = _by_length(words)
        if len(short):
            many = _Lattices(self, words.take(pa.array(short)))
            usable, found = many.expected(len(self.p))
            seen += found
            rest = np.concatenate([rest, short[~usable]])
        if len(rest):
            more = [0.0] * len(self.p)
            for i in rest:
                self.expect(words[int(i)].as_py(), more)
            seen += more


def _by_length(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which words, led by the space sign, have ``PLACES`` at most, and which have more."""
    short = pc.utf8_length(words).to_numpy(zero_copy_only=False) < PLACES
    return np.flatnonzero(short), np.flatnonzero(~short)


class _Lattices:
    """The lattices of many words side by side: each word has a place before each of its code points, and one at its end."""

    def __init__(self, law: Law, words: pa.Array):
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        whole = SPACE + SPACE.join(words.to_pylist())
        text = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(text)) - first[word]
        # A word has one more place than code points.
        node = np.arange(len(text)) + word
        self.n_places, self.ends = len(text) + len(sizes), first + sizes + np.arange(len(sizes))
        self.starts, self.word = self.ends - sizes, word

        p, byte = np.array(law.p), len(law.p) - 1
        spelled = np.ones(len(text), bool)
        at, number, length = [], [], []
        for i, (start, found) in enumerate(law.trie.walk(text, sizes[word] - place), 1):
            if i == 1:
                spelled[start] = False
            at.append(start), number.append(found), length.append(np.full(len(start), i))
        bare = np.flatnonzero(spelled)
        size = 1 + (text[bare] > 0x7F) + (text[bare] > 0x7FF) + (text[bare] > 0xFFFF)
        at, number = np.concatenate([*at, bare]), np.concatenate([*number, np.full(len(bare), byte)])
        length = np.concatenate([*length, np.ones(len(bare), np.int64)])
        taken, weight = np.ones(len(at), np.int64), p[number]
        taken[len(at) - len(bare) :] = size
        weight[len(at) - len(bare) :] **= size

        # Edges by the place they start at, as places of all words are worked out in turn.
        order = np.argsort(place[at].astype(np.uint8), kind="stable")
        at, self.number, length, self.taken = at[order], number[order], length[order], taken[order]
        self.edge_word, self.start, self.place = word[at], node[at], place[at]
        self.end, self.end_place = self.start + length, self.place + length
        self.p = weight[order]

    def ways(self) -> np.ndarray:
        """For each place, the summed probabilities of all ways there."""
        ways = np.zeros(self.n_places)
        ways[self.starts] = 1.0
        for lo, hi in _runs(self.place):
            # No two edges that start at one place of their words have the same end.
            ways[self.end[lo:hi]] += ways[self.start[lo:hi]] * self.p[lo:hi]
        return ways

    def expected(self, pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are likely enough, and how often pieces are expected in these, by number."""
        ways = self.ways()
        total = ways[self.ends]
        usable = total > TINY
        after = np.zeros(self.n_places)
        after[self.ends] = 1.0
        order = np.argsort(self.end_place.astype(np.uint8), kind="stable")
        start, end, p = self.start[order], self.end[order], self.p[order]
        for lo, hi in reversed(list(_runs(self.end_place[order]))):
            # Nor do two that end at one place have the same start.
            after[start[lo:hi]] += p[lo:hi] * after[end[lo:hi]]
        scale = np.divide(1.0, total, out=np.zeros(len(total)), where=usable)
        weights = ways[self.start] * scale[self.edge_word] * self.p * after[self.end] * self.taken
        return usable, np.bincount(self.number, weights, pieces)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Beginning and end of each run of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return zip([0, *cuts], [*cuts, len(values)])


def _ways(edges: list[list[tuple[int, int, float, int]]], n: int) -> list[float]:
    """For each place, the summed probabilities of all ways there."""
    ways = [1.0] + [0.0] * n
    for start, steps in enumerate(edges):
        here = ways[start]
        for end, _, p, _ in steps:
            ways[end] += here * p
    return ways


def _log_ways(edges: list[list[tuple[int, int, float, int]]], n: int) -> list[float]:
    """Their logarithms, where the probabilities themselves are too small."""
    reached: list[list[float]] = [[] for _ in range(n + 1)]
    reached[0].append(0.0)
    ways = []
    for start, steps in enumerate(edges):
        ways.append(_log_sum(reached[start]))
        reached[start] = ()
        for end, _, p, _ in steps:
            reached[end].append(ways[start] + math.log(p))
    return [*ways, _log_sum(reached[n])]


def _log_sum(ways: list[float]) -> float:
    if len(ways) == 1:
        return ways[0]
    top = max(ways)
    return top + math.log(sum([math.exp(w - top) for w in ways]))


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train: Counter[bytes] = Counter()
    other: set[bytes] = set()

    def rows() -> Iterator[pa.RecordBatch]:
        words = [*train, *(w for w in other if w not in train)]
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()).cast(pa.string()), pa.array([train[w] for w in part], pa.int64())],
                ["word", "n"],
            )
        train.clear(), other.clear()

    for batch in batches:
        for held_out, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            (other if held_out else train).update(tokens(text))
            if len(train) + len(other) > HELD_WORDS:
                yield from rows()
    yield from rows()


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of ``(held_out, text)``: every word, with its number in training documents."""
    partial = docs.select("held_out", "text").mapInArrow(_count_batches, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def hot_limit(counts: DataFrame, most: int) -> int:
    """The least count (2 at least) that no more than ``most`` words reach, to a sixteenth of an octave."""
    level = F.floor(F.log2("n") * 16).cast("int").alias("level")
    levels = counts.filter("n > 1").groupBy(level).count().collect()
    reached, lowest = 0, None
    for row in sorted(levels, key=lambda r: -r["level"]):
        reached += row["count"]
        if reached > most:
            break
        lowest = row["level"]
    return max(2, math.ceil(2 ** (lowest / 16))) if lowest is not None else 1 << 62


def fit(pieces: Pieces, counts: DataFrame, distinct: int) -> Law:
    """The law after training on the ``distinct`` words of ``counts(word, n)`` that have a count."""
    law = Law.of(pieces)
    if not distinct:
        return law
    words = counts.filter("n > 0").select("word")
    for _ in range(STEPS):
        # A row for each piece of the vocabulary at most.
        found = words.mapInArrow(_expectations(law), "number int, seen double").groupBy("number").agg(F.sum("seen"))
        # Rounded, so that the order of sums does not tell.
        law = law.learned({number: round(n, 6) for number, n in sorted(map(tuple, found.collect()))})
    return law


def _expectations(law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(law.p))
        for batch in batches:
            law.expect_all(batch.column(0), seen)
        numbers = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(seen[numbers])], ["number", "seen"])

    return run


def _with_probabilities(law: Law, discount: float, distinct: int, train_tokens: int):
    """Adds ``log_p``: the log10 probability of each word."""
    # Without training words, a word and an end are as likely.
    shared = math.log(discount * distinct / train_tokens) if distinct else math.log(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared + law.words(batch.column(0))
            n = batch.column(1).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(n)
            p[own] = np.logaddexp(np.log((n[own] - discount) / train_tokens), p[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p / math.log(10))], ["word", "n", "log_p"])

    return run


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, log_n, log_p = shared.value

        class Places(dict):
            def __missing__(self, word):
                return -1

        places = Places(zip(words, range(len(words))))
        rare_type = pa.list_(pa.string())
        for batch in batches:
            number, known, base, score, rare = [], [], [], [], []
            for text in text_bytes(batch.column(1)):
                w = tokens(text)
                at = np.fromiter(map(places.__getitem__, w), np.int64, len(w))
                hot = at[at >= 0]
                number.append(len(w))
                known.append(len(hot))
                base.append(float(log_n[hot].sum()))
                score.append(float(log_p[hot].sum()))
                rare.append([w[i] for i in np.flatnonzero(at < 0)])
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rare])))
            flat = pa.array([x for r in rare for x in r], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(number, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat).cast(rare_type),
                ],
                ["key", "row", "words", "known", "base", "lattice", "rare"],
            )

    return run


def score(
    docs: DataFrame, pieces_path: str, held_out: str = "held_out", keep: tuple[str, ...] = ("doc_id",),
    hot: int = HOT,
) -> DataFrame:
    """The columns ``keep`` and ``held_out`` with ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` of ``text``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    docs = docs.select(
        F.coalesce(held_out, F.lit(True)).alias("held_out"), "text",
        F.struct(*keep, F.coalesce(held_out, F.lit(True)).alias("held_out")).alias("row"),
    )
    pieces = Pieces.read(pieces_path)

    counts = scratch.keep(count_words(docs), "counts")
    ends = docs.filter("not held_out").count()
    times = lambda wanted: F.count(F.when(wanted, 1))
    total, words, once, twice = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), times(F.col("n") > 0), times(F.col("n") == 1), times(F.col("n") == 2)
    ).first()
    train_tokens, distinct = total + ends, words + (ends > 0)
    end = ends / train_tokens if words else 0.5
    discount = (once + 1) / (once + 2 * twice + 2)

    limit = hot_limit(counts, hot)
    law = fit(pieces, counts, words)
    known = scratch.keep(
        counts.mapInArrow(
            _with_probabilities(law, discount, words, train_tokens), "word string, n long, log_p double"
        ), "laws",
    )
    scratch.drop("counts")
    table = known.filter(F.col("n") >= limit).toArrow()  # ``hot`` rows at most
    log_n = np.log10(table.column("n").to_numpy() + 1.0)
    words = table.column("word").cast(pa.binary()).to_pylist()
    shared = spark.sparkContext.broadcast((words, log_n, table.column("log_p").to_numpy()))

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "text", "row")
    schema = keyed.select(
        "key", "row", *(F.lit(0).cast("long").alias(c) for c in ("words", "known")),
        *(F.lit(0.0).alias(c) for c in ("base", "lattice")), F.lit(None).cast("array<string>").alias("rare"),
    ).schema
    # Written, so that the keys are the same for both readers.
    scored = scratch.keep(keyed.mapInArrow(_score_batches(shared), schema), "scored")

    rest = (
        scored.select("key", F.explode("rare").alias("word"))
        .join(known.filter(F.col("n") < limit), "word")
        .groupBy("key")
        .agg(
            F.sum(F.log10(F.col("n") + 1)).alias("more_base"), F.sum("log_p").alias("more_lattice"),
            F.count(F.when(F.col("n") > 0, 1)).alias("more_known"),
        )
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    n_tokens = F.col("words") + 1
    return scored.join(rest, "key", "left").select(
        "row.*", n_tokens.alias("n_tokens"),
        (F.col("known") + none("more_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (
            F.col("base") + none("more_base") + math.log10(ends + 1)
            - n_tokens * math.log10(train_tokens + distinct + 1)
        ).alias("base_score"),
        (F.col("lattice") + none("more_lattice") + math.log10(end)).alias("score"),
    )
