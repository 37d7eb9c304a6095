"""Written intermediate tables, and word hashing shared by the operators on word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from passagemill.session import shared_folder

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLE_WORDS = 5

# Odd 64-bit multipliers, one per place in a window.
_PLACES = np.array(
    [xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(SHINGLE_WORDS)], dtype=np.uint64
)
_CACHED_WORDS = 200_000


class Scratch:
    """Tables written to ``spark.checkpoint.dir``: they outlive executors and cut lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, shared_folder(spark, label)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, nulls kept."""
    return column.cast(pa.binary()).to_pylist()


#: Text that a task works on at once.
RUN_BYTES = 1 << 20


def runs(batch: pa.RecordBatch, size: int = RUN_BYTES, column: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows in order, in runs of about ``size`` bytes of a text column; a long text is one run."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of five words in order; fewer words make one window, none makes none."""
    n = len(hashes)
    width = min(n, SHINGLE_WORDS)
    if not width:
        return hashes
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += hashes[i : n - width + 1 + i] * _PLACES[i]
    return mix(total + np.uint64(width))
