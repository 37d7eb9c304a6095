"""Embedding a text column through a batch function the user supplies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import BLANK_CHARS

# Most texts per model call, and the stored vector length.
BATCH_SIZE = 500
DIMENSION = 1536

_WORD = r"[^\x00-\x20]+"
# Where ``str.split`` and ``_WORD`` differ: control characters that are no white space, white space above U+0020.
_NOT_SPLIT = re.compile(r"[\x00-\x08\x0e-\x1b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CACHED_WORDS = 1 << 17

EmbedFn = Callable[[list[str]], "np.ndarray | Sequence[Sequence[float] | None]"]


def embed_batch(
    texts: list[str | None], fn: EmbedFn, dim: int, policy: str = "strict"
) -> tuple[np.ndarray, list[str | None]]:
    """Vectors and failure reasons for one model call, in the order of ``texts``.

    Blank texts are left out of the call. Whatever fails is a zero vector, and a
    zero vector from the model counts as failed. When the reply has another
    length than the request, ``"strict"`` zeroes the whole call and
    ``"positional"`` keeps what came and zeroes the rest.
    """
    vectors = np.zeros((len(texts), dim), dtype=np.float32)
    reasons: list[str | None] = ["blank text"] * len(texts)
    asked = [i for i, t in enumerate(texts) if t is not None and t.strip(BLANK_CHARS)]
    if not asked:
        return vectors, reasons
    try:
        reply = fn([texts[i] for i in asked])
        reply = [] if reply is None else reply
        complete = len(reply) == len(asked)
    except Exception as failure:  # a bad call becomes rejected rows, not a dead job
        for i in asked:
            reasons[i] = f"model error: {failure}"
        return vectors, reasons
    for i in asked:
        reasons[i] = None if complete else "reply count differs"
    if not complete and policy == "strict":
        return vectors, reasons
    numbers = isinstance(reply, np.ndarray) and reply.dtype.kind in "fiu"
    with np.errstate(over="ignore"):  # too large for the stored type: infinite, so rejected below
        if complete and numbers and reply.ndim == 2 and reply.shape[1] == dim:
            vectors[asked] = reply
        else:
            for i, vector in zip(asked, reply):
                reasons[i] = _place(vectors, i, vector, dim)
    for i in np.flatnonzero(~np.isfinite(vectors).all(axis=1)):
        vectors[i], reasons[i] = 0, "not finite"
    for i in np.flatnonzero(~vectors.any(axis=1)):
        reasons[i] = reasons[i] or "zero vector"
    return vectors, reasons


def _place(vectors: np.ndarray, i: int, vector, dim: int) -> str | None:
    """Put one vector of a reply in its row, or tell why it cannot be there."""
    try:
        if vector is None or isinstance(vector, (str, bytes)) or len(vector) != dim:
            return "wrong dimension"
        if any(x is None for x in vector):
            return "null element"
        vectors[i] = vector
        return None
    except (TypeError, ValueError):
        vectors[i] = 0
        return "not a vector"


def embed_column(
    df: DataFrame,
    fn: EmbedFn,
    *,
    text: str = "chunk_text",
    dim: int = DIMENSION,
    batch_size: int = BATCH_SIZE,
    policy: str = "strict",
    workers: int | None = None,
) -> DataFrame:
    """Add ``embedding array<float>`` and ``embed_error string``.

    Only the text crosses to Python; the other columns stay in the JVM. Each
    Arrow batch is cut into calls of at most ``batch_size`` texts. ``workers``
    first spreads the rows over that many partitions, which bounds how many
    calls are made at the same time.
    """
    if policy not in ("strict", "positional"):
        raise ValueError("policy must be 'strict' or 'positional'")
    if workers is not None:
        df = df.repartition(workers)

    @F.arrow_udf("struct<embedding: array<float>, embed_error: string>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            parts, reasons = [np.zeros((0, dim), dtype=np.float32)], []
            for at in range(0, len(texts), batch_size):
                vectors, why = embed_batch(texts[at : at + batch_size], fn, dim, policy)
                parts.append(vectors)
                reasons += why
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * dim
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(parts).ravel())
            yield pa.StructArray.from_arrays(
                [lists, pa.array(reasons, pa.string())], ["embedding", "embed_error"]
            )

    # A model call is dear and may not repeat itself: never run it twice for one row.
    made = df.withColumn("_made", embed.asNondeterministic()(F.col(text)))
    return made.select(*df.columns, "_made.embedding", "_made.embed_error")


class _Slots(dict):
    """The slot of each word, worked out when it is first asked for."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        digest = hashlib.md5(word.encode("utf-8")).digest()
        slot = self[word] = int.from_bytes(digest[:4], "big") % self.dim
        return slot


class HashedEmbedder:
    """Offline embedder: a hashed bag of words of unit length.

    It stands in where no model is at hand. A word is a run of characters above
    U+0020; its slot is the first 32 bits of its MD5 modulo ``dim``.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._seen = _Slots(dim)

    def __call__(self, texts: list[str]) -> np.ndarray:
        slots, sizes = [], []
        for text in texts:
            words = re.findall(_WORD, text) if _NOT_SPLIT.search(text) else text.split()
            slots.extend(map(self._seen.__getitem__, words))
            sizes.append(len(words))
        rows = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        flat = rows * self.dim + np.asarray(slots, dtype=np.int64)
        counts = np.bincount(flat, minlength=len(texts) * self.dim).reshape(len(texts), self.dim)
        counts = counts.astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0).astype(np.float32)
