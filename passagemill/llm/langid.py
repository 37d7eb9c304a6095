"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of labelled text. Texts are folded to
lower case with single spaces for signs and digits, and cut into windows of about 2,000 bytes (the
whole text, none left out). Each window is compressed with the dictionary of every language, and
the language with the smallest sum of sizes is chosen, of equal ones the one with more labels.
Windows keep the dictionary's help in proportion, whatever the length of the text. A text of a few
words is repeated, as the compressor stores what it can hardly shorten. Where the runner-up is too
close, the choice is not accepted.

The labelled sample is bounded: for each language ``SAMPLE_TEXTS`` documents, those of least hash
in as many hash slots, and the first ``SAMPLE_CHARS`` characters of each (96 KB a language on the
driver). All dictionaries are cut to the length of the shortest, but not below ``LEAST_BYTES``, as a
longer one would win by its length. Only text and label of the documents given are used.

Languages are compared in blocks of ``BLOCK``, so that a task holds as many compressors at most. More
languages add a pass each; the two smallest sizes so far are written with the documents in between.

Nulls: a text that is null or has no letter is ``und`` with score 0 and not accepted. Rows without
a label are not learned from. Without any label every text is ``und``. Repeated rows are each judged,
an empty table gives no rows, and columns of clashing names travel in a struct. Very long texts are
compressed whole, window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import Scratch, runs

UNKNOWN = "und"
SAMPLE_TEXTS, SAMPLE_CHARS = 64, 1_500
WINDOW_BYTES = 2_000
SHORT_BYTES, REPEATS = 200, 4
LEVEL = 5
#: Least relative distance of the runner-up's size for an accepted choice.
MARGIN = 0.005
#: Distance at which the score is one half of the way from even odds to certainty.
HALF = 0.02
BLOCK = 200
LEAST_BYTES = 8_192


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary per language. What reaches the driver is bounded: texts by slots by characters."""
    sample = (
        labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0))
        .select(
            F.col(lang).alias("lang"), F.substring(text, 1, SAMPLE_CHARS).alias("piece"),
            F.xxhash64(text).alias("mark"),
        )
        .groupBy("lang", F.pmod("mark", F.lit(SAMPLE_TEXTS)).alias("slot"))
        .agg(F.min(F.struct("mark", "piece")).alias("least"))
        .select("lang", "slot", "least.piece")
    )
    labels = labelled.filter(F.col(lang).isNotNull()).groupBy(lang).count()
    frequent = labels.orderBy(F.desc("count"), lang).collect()
    pieces: dict[str, list[bytes]] = {row[0]: [] for row in frequent}
    for row in sample.orderBy("lang", "slot").collect():
        pieces[row["lang"]].append(fold(row["piece"]))
    # Equal lengths, or a language with more text would have the better dictionary.
    joined = {k: b" ".join(v) for k, v in pieces.items() if any(v)}
    least = max(min(map(len, joined.values()), default=0), LEAST_BYTES)
    return {k: v[-least:] for k, v in joined.items()}


#: Bytes after lower-casing: ASCII other than letters becomes a space.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def cut(text: bytes, size: int = WINDOW_BYTES) -> list[bytes]:
    """The whole text in windows of nearly equal length."""
    parts = max(1, round(len(text) / size))
    edges = [len(text) * i // parts for i in range(parts + 1)]
    return [text[lo:hi] for lo, hi in zip(edges, edges[1:])]


#: A language, its size and the next size; nothing yet.
Leading = tuple[str | None, int | None, int | None]
NONE: Leading = (None, None, None)


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.tools = []
        for name in self.names:
            content = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.tools.append(zstd.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False))

    def sizes(self, text: bytes) -> np.ndarray:
        parts = cut(text) if len(text) >= SHORT_BYTES else [b" ".join([text] * REPEATS)]
        return np.array([sum(len(t.compress(p)) for p in parts) for t in self.tools])

    def leading(self, text: str | None, former: Leading = NONE) -> Leading:
        """The smallest size with its language, and the next, of these languages and the former ones."""
        if not self.names or not text or not regex.search(r"\p{L}", text):
            return former
        sizes = self.sizes(fold(text))
        best = int(sizes.argmin())  # of equal ones the first
        name, least, second = former
        known = sorted(size for size in (least, second, *sizes.tolist()) if size is not None)
        if least is None or sizes[best] < least:
            name = self.names[best]
        return name, known[0], known[1] if len(known) > 1 else None

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """``(language, score, accepted, margin)``."""
        return verdict(self.leading(text))


def verdict(leading: Leading) -> tuple[str, float, bool, float]:
    name, least, second = leading
    if name is None:
        return UNKNOWN, 0.0, False, 0.0
    margin = (second - least) / second if second is not None else 1.0
    return name, 0.5 + 0.5 * margin / (margin + HALF), margin >= MARGIN, margin


def predict(
    docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK
) -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``score``, ``accepted`` and ``margin`` of ``text``."""
    spark, names = docs.sparkSession, list(dictionaries)
    cuts = range(0, max(len(names), 1), block)
    # The text is sent once a block; it comes back if it is asked for or the next block needs it.
    state = docs.select(
        "text", F.struct(F.lit(0).alias("_"), *(c for c in keep if c != "text")).alias("row"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("least"),
        F.lit(None).cast("long").alias("second"),
    )
    scratch = Scratch(spark, "langid")
    for at in cuts:
        shared = spark.sparkContext.broadcast({n: dictionaries[n] for n in names[at : at + block]})
        with_text = "text" in keep or at != cuts[-1]

        def run(batches, shared=shared, with_text=with_text) -> Iterator[pa.RecordBatch]:
            tools = Compressors(shared.value)
            for batch in batches:
                for rows in runs(batch):
                    former = zip(*(rows.column(c).to_pylist() for c in ("name", "least", "second")))
                    made = [tools.leading(t, f) for t, f in zip(rows.column(0).to_pylist(), former)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *([rows.column(0)] if with_text else []), rows.column(1),
                            pa.array([m[0] for m in made], pa.string()),
                            pa.array([m[1] for m in made], pa.int64()),
                            pa.array([m[2] for m in made], pa.int64()),
                        ],
                        [*(["text"] if with_text else []), "row", "name", "least", "second"],
                    )

        state = state.mapInArrow(run, state.schema if with_text else state.drop("text").schema)
        if at != cuts[-1]:
            state = scratch.keep(state, f"state-{at}")
            if at:
                scratch.drop(f"state-{at - block}")
    kept = [F.col("text") if c == "text" else F.col(f"row.{c}") for c in keep]
    margin = F.when(F.col("name").isNull(), 0.0).otherwise(
        F.coalesce((F.col("second") - F.col("least")) / F.col("second"), F.lit(1.0))
    )
    return state.select(
        *kept, F.coalesce("name", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("name").isNull(), 0.0).otherwise(0.5 + 0.5 * margin / (margin + HALF)).alias("score"),
        (F.col("name").isNotNull() & (margin >= MARGIN)).alias("accepted"), margin.alias("margin"),
    )
