"""Approximate nearest vectors: inverted lists and random hyperplanes.

Both give every stored vector one or more cells and let a query meet only the
vectors in the cells it probes; the distances are exact. Vectors without a
direction (zero, missing) are in no cell.

Inverted lists can be kept with a store that is written by cell::

    root/attempt=<id>/cell=<n>/...      the rows, by cell; -1 holds what has none
    root/_centroids/<id>/...            one row per cell
    root/_manifest/...                  which attempts and centroids belong together
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.vectors import has_null_element, is_zero_vector, unit_rows
from passagemill.operators.search import QUERY_K, top_k
from passagemill.sources.manifest import Manifest

# Fixed value: default number of inverted lists.
LISTS = 100
# Unit vectors are added up as whole numbers of this fraction, so that no sum depends on its order.
FRACTION = 1 << 20
# The folder of rows that no cell holds.
NO_CELL = -1


@dataclass
class InvertedLists:
    """K-means cells over unit vectors, probed nearest cell first."""

    centroids: np.ndarray

    @classmethod
    def fit(
        cls,
        store: DataFrame,
        lists: int = LISTS,
        *,
        dim: int | None = None,
        seed: int = 1,
        max_iter: int = 20,
    ) -> InvertedLists:
        """Train the centroids on every usable vector. They are as many as ``lists``.

        Zero, holed and missing vectors are left out. All others must have one
        length, unless ``dim`` names the one that counts.
        """
        e = F.col("embedding")
        if dim is None:
            lo, dim = store.filter(F.size(e) > 0).agg(F.min(F.size(e)), F.max(F.size(e))).first()
            if lo != dim:
                raise ValueError(f"vectors of {lo} to {dim} numbers: name the length that counts")
        gathered = store.select(e).filter((F.size(e) == dim) & ~has_null_element(e) & ~is_zero_vector(e))
        unit = Normalizer(inputCol="vector", outputCol="unit").transform(
            gathered.select(array_to_vector(e).alias("vector"))
        )
        model = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="unit").fit(unit)
        return cls(np.array(model.clusterCenters()))

    @classmethod
    def lloyd(cls, store: DataFrame, start: DataFrame, steps: int = 4) -> InvertedLists:
        """Lloyd's steps from given centroids ``start(cell, embedding)``, numbered as they are sorted.

        A step is one scan of ``embedding``: each task adds up the unit vectors of each cell, and
        one aggregation adds up the tasks. A vector goes to the nearest centroid, the one of the
        lower number if two are as near; a cell's next centroid is the mean of its unit vectors, in
        whole numbers until the division; a cell without vectors keeps its centroid. So the result
        does not depend on partitions, and can be worked out by any other engine. Vectors without a
        direction or of another length than ``start`` are left out.
        """
        begun = start.orderBy("cell").toArrow()
        vectors = begun.column("embedding").combine_chunks()
        dim = len(vectors[0])
        unit, place = unit_rows(vectors, dim)
        if not len(unit) or place.any():
            raise ValueError("centroids to start from must be vectors of one length with a direction")
        lists = cls(unit)
        for _ in range(steps):
            lists = cls(lists._moved(store))
        return lists

    def _moved(self, store: DataFrame) -> np.ndarray:
        dim, here = self.centroids.shape[1], self

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(here.centroids), dim), np.int64)
            count = np.zeros(len(here.centroids), np.int64)
            for batch in batches:
                unit, place = unit_rows(batch.column(0), dim)
                unit = unit[place == 0]
                cell = here.nearest_cells(unit, 1)[:, 0]
                np.add.at(total, cell, np.floor(unit * FRACTION + 0.5).astype(np.int64))
                count += np.bincount(cell, minlength=len(count))
            cells = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int32)), pa.array(count[cells]),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * dim),
                                          pa.array(total[cells].ravel()))],
                ["cell", "n", "total"],
            )

        partial = store.select("embedding").mapInArrow(sums, "cell int, n long, total array<long>")
        # One row per cell and place, as many as the index has, comes to the driver.
        added = (
            partial.select("cell", "n", F.posexplode("total").alias("place", "x"))
            .groupBy("cell", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
        )
        moved = self.centroids.copy()
        cell, place, n, x = (added.column(c).to_numpy() for c in ("cell", "place", "n", "x"))
        moved[cell, place] = x / (n * float(FRACTION))
        return moved

    @property
    def name(self) -> str:
        """What tells these centroids from any others."""
        return hashlib.sha256(np.ascontiguousarray(self.centroids, "<f8").tobytes()).hexdigest()[:32]

    def nearest_cells(self, unit: np.ndarray, n: int) -> np.ndarray:
        closeness = unit @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)
        if n == 1:
            return closeness.argmax(axis=1)[:, None]
        return np.argsort(-closeness, axis=1, kind="stable")[:, :n]

    def assign(self, store: DataFrame) -> DataFrame:
        """Add ``cell``; NULL for a vector without a direction or of another length."""
        dim = self.centroids.shape[1]

        @F.arrow_udf("int")
        def cell(vectors: pa.Array) -> pa.Array:
            unit, place = unit_rows(vectors, dim)
            return pa.array(self.nearest_cells(unit, 1)[:, 0], pa.int32(), mask=place > 0)

        return store.withColumn("cell", cell("embedding"))

    def _place(self, store: DataFrame, root: str) -> str:
        attempt = f"a{uuid.uuid4().hex}"
        placed = self.assign(store).withColumn("cell", F.coalesce("cell", F.lit(NO_CELL)))
        # Rows are gathered by cell, and the rebalance splits a large cell over several tasks and files.
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{root}/attempt={attempt}")
        return attempt

    def write(self, store: DataFrame, root: str) -> None:
        """Write the store by cell, and the centroids with it, in place of what ``root`` holds.

        Rows that no cell holds are kept too, and no search by cell reads them.
        """
        spark, attempt = store.sparkSession, self._place(store, root)
        table = pa.table({
            "cell": pa.array(np.arange(len(self.centroids), dtype=np.int32)),
            "centroid": pa.array(list(self.centroids), pa.list_(pa.float64())),
        })
        spark.createDataFrame(table).coalesce(1).write.parquet(f"{root}/_centroids/{attempt}")
        index = {"name": self.name, "centroids": attempt}
        Manifest(spark, root).commit({"index": index, f"rows/{attempt}": self.name}, replace_all=True)

    def append(self, rows: DataFrame, root: str) -> None:
        """Add rows to the cells of a store that was written with these centroids."""
        manifest = Manifest(rows.sparkSession, root)
        _belongs(manifest.names(), self.name, root)
        manifest.commit({f"rows/{self._place(rows, root)}": self.name})

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> InvertedLists:
        """The centroids that the store at ``root`` was written with."""
        names = Manifest(spark, root).names()
        if "index" not in names:
            raise FileNotFoundError(f"no index at {root}")
        table = spark.read.schema("cell int, centroid array<double>").parquet(
            f"{root}/_centroids/{names['index']['centroids']}"
        )
        lists = cls(np.array([r.centroid for r in table.orderBy("cell").collect()]))
        _belongs(names, lists.name, root)
        return lists

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        """The rows of the store with their ``cell``, -1 where none holds them."""
        names = Manifest(spark, root).names()
        _belongs(names, self.name, root)
        places = [f"{root}/attempt={k.removeprefix('rows/')}" for k in names if k.startswith("rows/")]
        return spark.read.option("basePath", root).parquet(*places).drop("attempt")

    def top_k(
        self, store: DataFrame, queries: DataFrame, k: int = QUERY_K, *, nprobe: int = 10, **options
    ) -> DataFrame:
        """As :func:`search.top_k`, over the ``nprobe`` nearest cells of each query.

        A store that has a ``cell`` column, as :meth:`read` gives it, is read
        in the probed folders only.
        """
        nprobe = min(nprobe, len(self.centroids))
        return top_k(
            store, queries, k,
            cell_fn=lambda unit: self.nearest_cells(unit, 1),
            probe_fn=lambda unit: self.nearest_cells(unit, nprobe),
            cell_col="cell" if "cell" in store.columns else None,
            **options,
        )


def _belongs(names: dict, name: str, root: str) -> None:
    """An error unless the index and all rows at ``root`` go by the name of one set of centroids."""
    said = {names.get("index", {}).get("name"), *(v for k, v in names.items() if k.startswith("rows/"))}
    if said != {name}:
        raise ValueError(f"the rows at {root} were not placed by these centroids")


@dataclass
class Hyperplanes:
    """Sign patterns over random hyperplanes, in several independent tables.

    A query probes its own pattern in every table and those that differ in at
    most ``flips`` signs. The planes have entries +1 and -1 taken from the MD5
    of their position, so they need no storage and are the same everywhere.
    """

    dim: int
    tables: int = 8
    bits: int = 8
    flips: int = 1
    seed: int = 1

    def __post_init__(self):
        signs = np.empty((self.tables, self.bits, self.dim))
        for t, b, d in np.ndindex(signs.shape):
            digest = hashlib.md5(f"{self.seed}:{t}:{b}:{d}".encode()).hexdigest()
            signs[t, b, d] = 1.0 if digest[0] < "8" else -1.0
        self._planes = signs.reshape(self.tables * self.bits, self.dim)
        flipped = [0]
        for n in range(1, self.flips + 1):
            flipped += [sum(1 << i for i in c) for c in combinations(range(self.bits), n)]
        self._masks = np.array(flipped, dtype=np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """One cell per table: the table's number and the sign pattern."""
        positive = (unit @ self._planes.T >= 0).reshape(len(unit), self.tables, self.bits)
        pattern = positive @ (1 << np.arange(self.bits, dtype=np.int64))
        return pattern + (np.arange(self.tables, dtype=np.int64) << self.bits)

    def probes(self, unit: np.ndarray) -> np.ndarray:
        return (self.cells(unit)[:, :, None] ^ self._masks).reshape(len(unit), -1)

    def top_k(
        self, store: DataFrame, queries: DataFrame, k: int = QUERY_K, **options
    ) -> DataFrame:
        """As :func:`search.top_k`, over the cells each query probes."""
        return top_k(
            store, queries, k,
            cell_fn=self.cells, probe_fn=self.probes, many_cells=True, **options,
        )
