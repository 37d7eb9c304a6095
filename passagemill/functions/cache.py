"""Vectors of texts that were embedded before, so that a model is asked for each text once.

The cache is a folder of attempts named in a manifest, with the SHA-256 of a text, its vector and
its error. Only texts that no attempt holds with a vector go to the model, each of them once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.embedding import DIMENSION, EmbedFn, embed_column
from passagemill.session import shared_folder
from passagemill.sources.manifest import Manifest

_SCHEMA = "key binary, embedding array<float>, embed_error string"


@dataclass
class VectorCache:
    """``root`` holds the vectors of one model; another model needs another root."""

    spark: SparkSession
    root: str
    #: Texts that the last call sent to the model.
    sent: int = 0

    def read(self) -> DataFrame:
        places = [f"{self.root}/{name}" for name in Manifest(self.spark, self.root).names()]
        if not places:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*places)

    def embed(
        self, df: DataFrame, fn: EmbedFn, *, text: str = "chunk_text", dim: int = DIMENSION, **options
    ) -> DataFrame:
        """As :func:`embed_column`. Texts that failed are asked for again by the next call.

        New texts are written and named before this returns, so a later failure does not lose
        them. A text that repeats very often is one row of the cache, and its rows are joined to it
        where Spark splits a join with skewed keys. The rows of ``df`` are worked out once and lie
        in a folder of their own, which the result reads.
        """
        keyed = self._staged(df.withColumn("_key", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))))
        known = self.read().filter("embed_error is null").select(F.col("key").alias("_key"))
        fresh = keyed.select("_key", F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["_key"]).join(
            known, "_key", "left_anti"
        )
        seen, attempt = Observation(), uuid.uuid4().hex
        made = embed_column(fresh, fn, text="text", dim=dim, **options).observe(seen, F.count(F.lit(1)).alias("sent"))
        made.select(F.col("_key").alias("key"), "embedding", "embed_error").write.parquet(f"{self.root}/{attempt}")
        self.sent = seen.get["sent"]
        new = self.spark.read.schema(_SCHEMA).parquet(f"{self.root}/{attempt}")
        old = self.read().filter("embed_error is null")
        Manifest(self.spark, self.root).commit({attempt: True})
        found = old.unionByName(new).withColumnRenamed("key", "_key")
        return keyed.join(found, "_key", "left").select(*df.columns, "embedding", "embed_error")

    def _staged(self, keyed: DataFrame) -> DataFrame:
        """Rows that are read twice, written first: what made them may be costly."""
        folder = shared_folder(self.spark, "keyed")
        try:
            keyed.write.parquet(folder)
        except AnalysisException:  # a column without a type, or of one that files do not hold
            return keyed
        return self.spark.read.schema(keyed.schema).parquet(folder)
