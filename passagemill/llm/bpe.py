"""Byte-level BPE over a trie of the distinct words, so shared prefixes are encoded once.

For a prefix of a word, its *last token* is the last token of the prefix's own encoding. It is the
one token ``t`` that ends the prefix and may follow the last token of what is left before ``t``;
two tokens may stand side by side if encoding their joined bytes gives just these two. So the
last tokens of a prefix follow from those of shorter prefixes, and a word's encoding is read by
stepping back from its end.

The distinct words of a batch in sorted order are the trie in depth-first order: a stack holds the
states of the open path, and the next word goes on from the prefix it shares with the one before.

The vocabulary file is a parameter and is read on the driver; only its tokens and merge ranks
travel. Text that spells a special token becomes that token, as the public library does by default.

Nulls: a null text is an empty one, with no tokens. Any length and repeats are fine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import runs

# Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letters such files write for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """``tokens``: bytes to id; ``merges``: pair of ids to (rank, merged id); ``special``: text to id."""

    tokens: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = stored["model"]["vocab"]
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        merges = {}
        for rank, (left, right) in enumerate(stored["model"]["merges"]):
            merges[ids[left], ids[right]] = (rank, ids[left + right])
        return cls({raw(t): i for t, i in ids.items() if t not in special}, merges, special)

    def spelled(self) -> list[bytes]:
        """The bytes of each id."""
        size = max([*self.tokens.values(), *self.special.values()], default=-1) + 1
        out = [b""] * size
        for token, i in self.tokens.items():
            out[i] = token
        for text, i in self.special.items():
            out[i] = text.encode()
        return out


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.longest = max(map(len, self.tokens), default=0)
        self.spelled = vocabulary.spelled()
        self.rank_of = {pair: rank for pair, (rank, _) in vocabulary.merges.items()}
        # How each token came about: the two it was merged from, and when. Single bytes: never.
        self.made = {made: (rank, *pair) for pair, (rank, made) in reversed(vocabulary.merges.items())}
        self.fits: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Does the border between two tokens outlast all merges of their joined bytes?

        Goes back in time. At each moment one token touches the border from either side; the border
        falls if these two merge before either is merged on its own side. Of merges of equal rank
        the left one comes first.
        """
        pair = left, right
        known = self.fits.get(pair)
        if known is not None:
            return known
        if len(self.fits) >= CACHED_WORDS:
            self.fits.clear()
        never = (-1, 0, 0)
        until, fits = float("inf"), True
        while True:
            if self.rank_of.get((left, right), until) < until:
                fits = False
                break
            (born_l, _, inner_l), (born_r, inner_r, _) = self.made.get(left, never), self.made.get(right, never)
            if born_l < 0 and born_r < 0:
                break
            if born_l > born_r:
                left, until = inner_l, born_l
            else:
                right, until = inner_r, born_r + 0.5
        self.fits[pair] = fits
        return fits

    def stands(self, token: int) -> bool:
        """Is the token what its own bytes are encoded to?"""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self._merged(self.spelled[token]) == [token]
        return known

    def _merged(self, word: bytes) -> list[int]:
        """Plain BPE: merge the pair of least rank until none is left."""
        ids = [self.tokens[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            ranks = [(self.rank_of[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank_of]
            if not ranks:
                break
            _, at = min(ranks)
            ids[at : at + 2] = [self.tokens[self.spelled[ids[at]] + self.spelled[ids[at + 1]]]]
        return ids

    def encode_words(self, words: Iterator[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct word, as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        lengths = [len(t) for t in self.spelled]
        path, last = b"", [-1]  # last[d]: the last token of the open path's first d bytes
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                last.append(self._last_token(word, depth, last))
            path, at, ids = word, len(word), []
            while at:
                ids.append(last[at])
                at -= lengths[last[at]]
            out[word] = np.array(ids[::-1], "<u4").tobytes()
        return out

    def _last_token(self, word: bytes, depth: int, last: list[int]) -> int:
        # Exactly one token is right, so the order of trying does not matter.
        find, known = self.tokens.get, self.fits.get
        for start in range(depth - 1, max(0, depth - self.longest) - 1, -1):
            token = find(word[start:depth])
            if token is None:
                continue
            if not start:
                if self.stands(token):
                    return token
                continue
            fits = known((last[start], token))
            if fits or fits is None and self.may_follow(last[start], token):
                return token
        raise ValueError(f"no token ends {word[:depth]!r}; the vocabulary lacks single bytes")


def codec_batches(vocabulary: Vocabulary, made_columns=None, cached: int = CACHED_WORDS):
    """A function over batches of texts: adds ``ids`` and ``decoded``, or what ``made_columns`` makes
    of the texts and the pairs of both."""
    made_columns = made_columns or _ids_and_texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spelled = TrieEncoder(vocabulary), vocabulary.spelled()
        pattern = regex.compile(WORDS)
        marks = "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
        split = regex.compile(f"({marks})") if marks else None
        special = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary.special.items()}
        known: dict[str, bytes] = {}
        def coded(texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
            parts: list[list[str]] = []
            for text in texts:
                words: list[str] = []
                for i, piece in enumerate(split.split(text or "") if split else [text or ""]):
                    words += [piece] if i % 2 else pattern.findall(piece)
                parts.append(words)
            if len(known) >= cached:
                known.clear()
            known.update(special)
            fresh = {w for words in parts for w in words if w not in known}
            codes = encoder.encode_words(w.encode() for w in fresh)
            known.update((w, codes[w.encode()]) for w in fresh)
            for words in parts:
                ids = b"".join(map(known.__getitem__, words))
                numbers = np.frombuffer(ids, "<u4").tolist()
                yield ids, b"".join(map(spelled.__getitem__, numbers)).decode("utf-8", "replace")

        for batch in batches:
            for rows in runs(batch):
                texts = rows.column(0).to_pylist()
                made = made_columns(texts, list(coded(texts)))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *made.values()], [*rows.schema.names, *made]
                )

    return run


def _ids_and_texts(texts, made) -> dict[str, pa.Array]:
    return {
        "ids": pa.array([ids for ids, _ in made], pa.binary()),
        "decoded": pa.array([text for _, text in made], pa.string()),
    }


def _checked(texts, made) -> dict[str, pa.Array]:
    return {
        "n_tokens": pa.array([len(ids) // 4 for ids, _ in made], pa.int64()),
        "ids": pa.array([ids for ids, _ in made], pa.binary()),
        "round_trip": pa.array([back == (text or "") for text, (_, back) in zip(texts, made)], pa.bool_()),
    }


def encode_checked(docs: DataFrame, vocabulary_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``n_tokens``, ``ids`` and ``round_trip``, whether the ids decode to
    ``text``. The decoded text stays in the task."""
    rows = docs.select("text", F.struct(F.lit(0).alias("_"), *(c for c in keep if c != "text")).alias("row"))
    schema = rows.withColumns(
        {"n_tokens": F.lit(0).cast("long"), "ids": F.lit(None).cast("binary"), "round_trip": F.lit(True)}
    ).schema
    coded = rows.mapInArrow(codec_batches(Vocabulary.read(vocabulary_path), _checked, CACHED_WORDS // 2), schema)
    kept = [F.col("text") if c == "text" else F.col(f"row.{c}") for c in keep]
    return coded.select(*kept, "n_tokens", "ids", "round_trip")


def encode_decode(docs: DataFrame, vocabulary_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``ids`` (binary, little-endian 32-bit) and ``decoded`` of ``text``."""
    rows = docs.select("text", F.struct(*keep).alias("row"))
    schema = rows.withColumns(
        {"ids": F.lit(None).cast("binary"), "decoded": F.lit(None).cast("string")}
    ).schema
    coded = rows.mapInArrow(codec_batches(Vocabulary.read(vocabulary_path)), schema)
    return coded.select("row.*", "ids", "decoded")
