"""Nearest vectors by cosine distance, for one query vector or a table of them.

Every search here, exact or approximate, runs the same way. A block of query
vectors meets a stream of stored vectors in one matrix product per Arrow batch,
and each task keeps no more than the k nearest rows per query. Windows over
those few rows give the final ranks. All pairs are never materialised.

Queries are cut into blocks of bounded bytes. Blocks are broadcast and sweep over
the store, which stays where it lies: it is scanned once for as many blocks as
the default size of one holds, and never shuffled or copied. With several blocks, a few rows of the store
first give each query a distance that its k nearest rows cannot exceed, and
tasks hand on nothing beyond it.

A *cell* narrows which stored rows a query meets. The exact search has one
cell; the approximate searches in ``cells.py`` have many.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.vectors import ZERO, has_null_element, is_zero_vector, unit_rows
from passagemill.operators.ranges import dense_ids
from passagemill.session import shared_folder

KEY = ("raw_data_id", "chunk_index")

# Default number of hits for a query and for a chat message.
QUERY_K = 5
CHAT_K = 3

# Largest block of queries that is broadcast.
MAX_BROADCAST_QUERIES = 20_000
MAX_BROADCAST_BYTES = 128 << 20
# Blocks up to which, and sweeps from which on, small blocks share a sweep.
FEW_BLOCKS = 8
# Stored rows that give the first bounds when there are several blocks.
BOUND_ROWS = 4096

# Distances are ranked after rounding, so that sums taken in another order do
# not reorder equal vectors; the key breaks ties.
DIGITS = 9
_SLACK = 10.0 ** -DIGITS
# Products computed at a time in one task, few enough for a core's cache, and rows they are of at most;
# pairs that are worked out exactly at a time; and candidates gathered before the best are kept.
_TILE, _TILE_ROWS = 1 << 19, 1 << 10
_PAIRS = 200_000
_PENDING = 200_000

# Cells of each row of a matrix of unit vectors, as an integer matrix (rows, cells per row).
CellFn = Callable[[np.ndarray], np.ndarray]


@dataclass
class QueryBlock:
    """A bounded block of query vectors, ready to meet stored vectors."""

    ids: pa.Array
    unit: np.ndarray
    k: np.ndarray
    probes: dict[int, np.ndarray] | None = None
    cell_fn: CellFn | None = None
    many_cells: bool = False
    # Distances that the k nearest rows do not exceed, as far as they are known beforehand.
    bound: np.ndarray | None = None
    everyone: np.ndarray = field(init=False)

    def __post_init__(self):
        self.everyone = np.arange(len(self.ids))

    def meetings(self, cells: np.ndarray | None, n: int):
        """Which of a batch's n rows meet which queries."""
        if self.probes is None:
            yield np.arange(n), self.everyone
            return
        for column in cells.T:
            order = np.argsort(column, kind="stable")
            codes, starts = np.unique(column[order], return_index=True)
            for code, rows in zip(codes, np.split(order, starts[1:])):
                queries = self.probes.get(int(code))
                if queries is not None:
                    yield rows, queries

    def cells_of(self, unit: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Cells of each row, -1 for a row without a direction: an index leaves it out."""
        usable = place == 0
        if not usable.any():
            return np.full((len(unit), 1), -1)
        found = self.cell_fn(unit[usable]).reshape(usable.sum(), -1)
        cells = np.full((len(unit), found.shape[1]), -1)
        cells[usable] = found
        return cells


def scan_batches(
    block: QueryBlock,
    batches: Iterator[pa.RecordBatch],
    key: tuple[str, ...],
    cell_col: str | None = None,
) -> pa.Table | None:
    """The k nearest rows of a stream of batches per query: ``q``, ``distance``, key columns."""
    return scan_blocks([block], batches, key, cell_col)[0]


def scan_blocks(
    blocks: list[QueryBlock],
    batches: Iterator[pa.RecordBatch],
    key: tuple[str, ...],
    cell_col: str | None = None,
) -> list[pa.Table | None]:
    """As :func:`scan_batches`, for several blocks in one pass over the batches."""
    room = _Room()
    found = [_Nearest(block, key, room) for block in blocks]
    for batch in batches:
        # In key order, of equally distant rows the first ones are those to keep.
        batch = batch.take(pc.sort_indices(batch, [(name, "ascending") for name in key]))
        unit, place = unit_rows(batch.column("embedding"), blocks[0].unit.shape[1])
        cells = None
        if cell_col is not None:
            cells = batch.column(cell_col).to_numpy(zero_copy_only=False)[:, None]
        elif blocks[0].probes is not None:
            cells = blocks[0].cells_of(unit, place)
        rows = _Rows(batch, unit, unit.astype(np.float32), place)
        for nearest in found:
            nearest.meet(rows, cells)
    return [nearest.best for nearest in found]


@dataclass
class _Rows:
    """A batch of stored rows in key order; ``short`` are its unit vectors in single precision."""

    batch: pa.RecordBatch
    unit: np.ndarray
    short: np.ndarray
    place: np.ndarray


class _Room:
    """Memory for the products of one tile, used again by the next."""

    def __init__(self):
        self.products = np.empty(0, np.float32)

    def of(self, queries: int, rows: int) -> np.ndarray:
        size = queries * rows
        if len(self.products) < size:
            self.products = np.empty(size, np.float32)
        return self.products[:size].reshape(queries, rows)


class _Nearest:
    """The nearest rows that a block of queries has met."""

    def __init__(self, block: QueryBlock, key: tuple[str, ...], room: _Room):
        self.block, self.key, self.room = block, key, room
        n, dim = block.unit.shape
        self.bound = np.full(n, np.inf) if block.bound is None else block.bound.copy()
        self.short = block.unit.astype(np.float32)
        # More than a product of unit vectors in single precision is off from its exact value.
        self.error = (dim + 8) * 2.0**-22
        self.best: pa.Table | None = None

    def meet(self, rows: _Rows, cells: np.ndarray | None) -> None:
        found, pending = [], 0
        for met, queries in self.block.meetings(cells, rows.batch.num_rows):
            if not len(met):
                continue
            whole = len(met) == rows.batch.num_rows
            short, outside = (rows.short, rows.place) if whole else (rows.short[met], rows.place[met])
            outside = np.flatnonzero(outside > 0)
            step = max(_TILE // min(len(met), _TILE_ROWS), 1)
            for at in range(0, len(queries), step):
                for q, r, d in self._nearest_of(rows, met, short, outside, queries[at : at + step]):
                    found.append((q, r, d))
                    pending += len(q)
                if pending > _PENDING:
                    self._keep(rows.batch, found)
                    found, pending = [], 0
        if pending:
            self._keep(rows.batch, found)

    def _keep(self, batch: pa.RecordBatch, found: list) -> None:
        q, r, d = (np.concatenate(part) for part in zip(*found))
        rows = pa.array(r)
        fresh = pa.table({"q": q, "distance": d, **{name: batch.column(name).take(rows) for name in self.key}})
        rows = fresh if self.best is None else pa.concat_tables([self.best, fresh])
        self.best = _keep_nearest(rows, self.block, self.key, self.bound)

    def _nearest_of(self, rows, met, short, outside, queries):
        """Queries, rows and distances that can still be among the k nearest, in some parts.

        Products in single precision tell which pairs are near enough to be worked out exactly. Of
        the rows at the k-th distance itself only the first k are kept, so that any number of copies
        of one vector costs no more than k of them.
        """
        most = int(self.block.k[queries].max())
        first, last = queries[0], queries[-1]
        asked = self.short[first : last + 1] if last - first + 1 == len(queries) else self.short[queries]
        least = (1.0 - self.bound[queries] - _SLACK - self.error).astype(np.float32)
        pairs, pending = [], 0
        for lo in range(0, len(met), _TILE_ROWS):
            tile = short[lo : lo + _TILE_ROWS]
            closeness = self.room.of(len(queries), len(tile))
            np.matmul(asked, tile.T, out=closeness)
            # Behind all real distances, at most 2 away, for the exact distance to place them.
            lost = outside[slice(*np.searchsorted(outside, (lo, lo + len(tile))))]
            if len(lost):
                closeness[:, lost - lo] = 1.0 - rows.place[met[lost]]
            # Most queries have no near row in a tile, which their nearest one tells.
            q = np.flatnonzero(closeness.max(axis=1) >= least)
            if not len(q):
                continue
            closeness = closeness[q]
            near = closeness >= least[q, None]
            crowded = np.flatnonzero(near.sum(axis=1) > 4 * most)
            if len(crowded):
                kth = -np.partition(-closeness[crowded], most - 1, axis=1)[:, most - 1]
                # The k-th is off by its error too, and a rounded distance may be farther than the exact
                # one. What is farther than these k is so in the tiles to come as well.
                who = q[crowded]
                least[who] = np.maximum(least[who], kth - np.float32(2 * self.error + _SLACK))
                near[crowded] = closeness[crowded] >= least[who, None]
            flat = np.flatnonzero(near)
            pairs.append((q[flat // len(tile)], lo + flat % len(tile)))
            pending += len(flat)
            if pending > _PAIRS:
                yield self._exact(rows, met, queries, pairs, most)
                pairs, pending = [], 0
        if pending:
            yield self._exact(rows, met, queries, pairs, most)

    def _exact(self, rows, met, queries, pairs, most):
        """Of some pairs, those that are among the first ``most`` of their query and within its bound."""
        q, r = (np.concatenate(part) for part in zip(*pairs))
        who, row = queries[q], met[r]
        d = np.empty(len(q))
        for at in range(0, len(q), _PAIRS):
            part = slice(at, at + _PAIRS)
            d[part] = 1.0 - np.einsum("ij,ij->i", self.block.unit[who[part]], rows.unit[row[part]])
        place = rows.place[row]
        d = np.where(place > 0, place, np.round(d, DIGITS) + 0.0)  # no -0.0
        order = np.lexsort((row, d, who))
        who, row, d = who[order], row[order], d[order]
        kept = (_rank_in_group(who) < most) & (d <= self.bound[who])
        return who[kept], row[kept], d[kept]


def _rank_in_group(sorted_groups: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal values."""
    if not len(sorted_groups):
        return sorted_groups
    starts = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]]))
    sizes = np.diff(np.append(starts, len(sorted_groups)))
    return np.arange(len(sorted_groups)) - np.repeat(starts, sizes)


def _keep_nearest(
    rows: pa.Table, block: QueryBlock, key: tuple[str, ...], bound: np.ndarray
) -> pa.Table:
    if block.many_cells:
        # A row can meet a query in several cells; count it once.
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("q", *key)]))
        same = np.ones(rows.num_rows - 1, dtype=bool)
        for name in ("q", *key):
            column = rows.column(name).combine_chunks()
            same &= pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(False)
        rows = rows.filter(pa.array(np.concatenate([[True], ~same])))
    rows = rows.take(
        pc.sort_indices(rows, [(c, "ascending") for c in ("q", "distance", *key)])
    ).combine_chunks()
    q = rows.column("q").to_numpy()
    rank = _rank_in_group(q)
    last = rank == block.k[q] - 1
    bound[q[last]] = rows.column("distance").to_numpy()[last]
    return rows.filter(pa.array(rank < block.k[q]))


def usable_queries(queries: DataFrame) -> DataFrame:
    """Queries whose vector has a direction; the others find nothing."""
    e = F.col("embedding")
    return queries.filter(e.isNotNull() & ~has_null_element(e) & ~is_zero_vector(e))


def _build_block(
    table: pa.Table, query_key: str, cell_fn: CellFn | None, probe_fn: CellFn | None
) -> QueryBlock:
    vectors = table.column("embedding").combine_chunks()
    dims = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(dims) != 1:
        raise ValueError(f"query vectors have different dimensions: {sorted(dims)}")
    unit, _ = unit_rows(vectors, dims[0])
    block = QueryBlock(
        ids=table.column(query_key).combine_chunks(),
        unit=unit,
        k=table.column("k").to_numpy().astype(np.int64),
        cell_fn=cell_fn,
    )
    if probe_fn is not None:
        probed = probe_fn(unit)
        who = np.repeat(np.arange(len(unit)), probed.shape[1])
        order = np.argsort(probed.ravel(), kind="stable")
        codes, starts = np.unique(probed.ravel()[order], return_index=True)
        block.probes = {
            int(c): np.unique(who[at]) for c, at in zip(codes, np.split(order, starts[1:]))
        }
    return block


def _blocks_of(
    table: pa.Table, query_key: str, cell_fn: CellFn | None, probe_fn: CellFn | None
) -> Iterator[QueryBlock]:
    """The blocks of a sweep; a table without block numbers is one."""
    if "_block" not in table.column_names:
        yield _build_block(table, query_key, cell_fn, probe_fn)
        return
    table = table.sort_by("_block")
    numbers = table.column("_block").to_numpy()
    cuts = np.flatnonzero(np.diff(numbers)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
        yield _build_block(table.slice(lo, hi - lo).drop(["_block"]), query_key, cell_fn, probe_fn)


def _emit(best: pa.Table, block: QueryBlock, query_key: str, key: tuple[str, ...], schema: pa.Schema):
    q = best.column("q").combine_chunks()
    columns = [block.ids.take(q), pa.array(block.k[q.to_numpy()])]
    columns += [best.column(name) for name in (*key, "distance")]
    return pa.table(columns, names=schema.names).cast(schema)


def top_k(
    store: DataFrame,
    queries: DataFrame,
    k: int = QUERY_K,
    *,
    key: tuple[str, ...] = KEY,
    query_key: str = "query_id",
    columns: tuple[str, ...] = (),
    cell_fn: CellFn | None = None,
    probe_fn: CellFn | None = None,
    cell_col: str | None = None,
    many_cells: bool = False,
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """The nearest stored rows per query: ``(query_key, rank, key..., columns..., distance)``.

    ``store`` has ``key`` and ``embedding``; ``queries`` has ``query_key``,
    ``embedding`` and optionally its own number of hits ``k``. Both keys must
    be unique, and k modest: the last step ranks the rows that are left of a
    query together. Rows of the store without a direction come after all
    distances: zero vectors (NaN) first, then missing ones (NULL). ``columns``
    names further store columns to fetch for the hits.

    The search runs block by block when this is called, and its hits are
    written to the shared folder; what is returned reads them.
    """
    if query_key in key:
        raise ValueError(f"{query_key} names both a query and a stored row")
    spark = store.sparkSession
    own_k = F.col("k").cast("int") if "k" in queries.columns else F.lit(k)
    # Fresh columns, so that queries taken from the store itself stay apart from it.
    asked = usable_queries(queries).select(
        F.col(query_key).alias(query_key),
        own_k.alias("k"),
        F.col("embedding").alias("embedding"),
    )
    # Read several times, and its vectors may come from a model: written once, first of all.
    staged, seen = shared_folder(spark, "queries"), Observation()
    length, named = F.size("embedding"), F.octet_length(F.col(query_key).cast("string"))
    asked.observe(
        seen, F.count(F.lit(1)).alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest"),
        F.max(named).alias("named"),
    ).write.parquet(f"{staged}/asked")
    asked, told = spark.read.schema(asked.schema).parquet(f"{staged}/asked"), seen.get
    if told["n"] and told["shortest"] != told["longest"]:
        raise ValueError("queries must have vectors of one length")
    row_bytes = 8 * (told["longest"] or 0) + (told["named"] or 0) + 16
    size = max(min(max_broadcast_queries, MAX_BROADCAST_BYTES // row_bytes), 1)
    blocks = -(-told["n"] // size)
    # Few blocks sweep one by one. Of many small ones a sweep takes some, no more queries than a block
    # may hold by default, so that the sweeps do not grow in number as the blocks do.
    per_sweep = max(min(min(MAX_BROADCAST_QUERIES, MAX_BROADCAST_BYTES // row_bytes) // size, blocks // FEW_BLOCKS), 1)
    fields = [asked.schema[query_key], T.StructField("k", T.LongType())]
    fields += [store.schema[name] for name in key] + [T.StructField("distance", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    scanned = store.select(*key, "embedding", *([cell_col] if cell_col else []))
    ranked_schema = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])

    first = None
    if blocks > 1:
        numbered = dense_ids(asked, id_col="_number", start=0)
        number = F.col("_number")
        asked = numbered.select(
            *asked.columns, F.call_function("div", number, F.lit(size)).alias("_block"),
            F.call_function("div", number, F.lit(size * per_sweep)).alias("_sweep"),
        )
        asked.write.partitionBy("_sweep").parquet(f"{staged}/sweeps")
        if probe_fn is None:
            first = scanned.limit(BOUND_ROWS).toArrow()
    for sweep in range(-(-blocks // per_sweep)):
        if blocks > 1:
            asked = spark.read.schema(asked.drop("_sweep").schema).parquet(f"{staged}/sweeps/_sweep={sweep}")
        shared, most, probed = [], 0, set()
        for block in _blocks_of(asked.toArrow(), query_key, cell_fn, probe_fn):
            block.many_cells = many_cells
            if first is not None:
                block.bound = _first_bounds(block, first, key)
            most = max(most, int(block.k.max()))
            probed.update(block.probes or ())
            shared.append(_shared(spark, block))
        here = scanned
        if cell_col and probe_fn is not None:
            # At most one value per cell; prunes the folders of a store written by cell.
            here = here.filter(F.col(cell_col).isin(*sorted(probed)))
        found = _scan_broadcast(here, shared, cell_fn, many_cells, query_key, key, schema, cell_col)
        _ranked(found, query_key, key, most).write.mode("append").parquet(f"{staged}/hits")
        for block in shared:
            block.destroy()
    if not blocks:
        spark.createDataFrame([], ranked_schema).write.parquet(f"{staged}/hits")

    hits = spark.read.schema(ranked_schema).parquet(f"{staged}/hits").withColumn("distance", _distance())
    if columns:
        # The hits' size is known from their files: they are broadcast only if that is small.
        hits = store.select(*key, *columns).join(hits, list(key))
    return hits.select(query_key, "rank", *key, *columns, "distance")


def _first_bounds(block: QueryBlock, first: pa.Table, key: tuple[str, ...]) -> np.ndarray:
    """The distance of the k-th nearest of some rows: the k nearest of all are no farther."""
    bound = np.full(len(block.ids), np.inf)
    best = scan_batches(block, first.to_batches(), key)
    if best is not None and best.num_rows:
        q = best.column("q").to_numpy()
        last = _rank_in_group(q) == block.k[q] - 1
        bound[q[last]] = best.column("distance").to_numpy()[last]
    return bound


def _ranked(found: DataFrame, query_key: str, key: tuple[str, ...], most: int) -> DataFrame:
    """The first k rows of each query, of at most ``most``.

    A query's rows from many tasks are cut in some buckets of tasks before the rest meet.
    """
    nearest = lambda *by: F.row_number().over(Window.partitionBy(query_key, *by).orderBy("distance", *key))
    buckets = math.isqrt(found.rdd.getNumPartitions())
    if buckets > 1:
        dealt = found.withColumn("_bucket", F.spark_partition_id() % buckets)
        found = dealt.withColumn("rank", nearest("_bucket")).filter(F.col("rank") <= most).drop("_bucket", "rank")
    # A literal limit lets Spark cut each group before the shuffle.
    return found.withColumn("rank", nearest()).filter((F.col("rank") <= most) & (F.col("rank") <= F.col("k")))


def _distance():
    """Distances with NaN and NULL where a stored vector has no direction."""
    d = F.col("distance")
    return F.when(d == ZERO, F.lit(float("nan"))).when(d < ZERO, d)


def _shared(spark, block: QueryBlock):
    """A block's broadcast."""
    return spark.sparkContext.broadcast((block.ids, block.unit, block.k, block.probes, block.bound))


def _scan_broadcast(scanned, shared, cell_fn, many_cells, query_key, key, schema, cell_col):
    """The nearest rows of every task, for blocks that were broadcast."""
    arrow_schema = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for ids, unit, k, probes, bound in (block.value for block in shared):
            blocks.append(QueryBlock(ids, unit, k, probes, cell_fn, many_cells, bound))
        for block, best in zip(blocks, scan_blocks(blocks, batches, key, cell_col)):
            if best is not None and best.num_rows:
                yield from _emit(best, block, query_key, key, arrow_schema).to_batches()

    return scanned.mapInArrow(scan, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def top_k_one(
    store: DataFrame,
    vector: list[float],
    k: int = QUERY_K,
    *,
    key: tuple[str, ...] = KEY,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """The nearest stored rows to one vector, nearest first: ``(key..., columns..., distance)``.

    Each task hands on its k best rows; Spark merges those and never sorts the
    store. A vector without a direction finds nothing.
    """
    unit, place = unit_rows(pa.array([vector], pa.list_(pa.float64())), len(vector))
    block = QueryBlock(pa.array([0]), unit, np.array([k if place[0] == 0 else 0]))
    fields = [T.StructField("_query", T.LongType()), T.StructField("k", T.LongType())]
    fields += [T.StructField(c, store.schema[c].dataType) for c in key]
    schema = T.StructType(fields + [T.StructField("distance", T.DoubleType())])
    scanned = store.select(*key, "embedding").filter(F.lit(bool(place[0] == 0)))
    order = ["distance", *key]
    shared = [_shared(store.sparkSession, block)]
    found = _scan_broadcast(scanned, shared, None, False, "_query", key, schema, None)
    hits = found.orderBy(*order).limit(k).select(*order)
    if columns:
        # k rows, as many as the caller asked for.
        hits = store.select(*key, *columns).join(hits, list(key)).orderBy(*order).limit(k)
    return hits.select(*key, *columns, _distance().alias("distance"))
