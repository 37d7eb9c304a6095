"""Near-duplicate groups: MinHash bands find candidates, odd sketches sift them, full sets confirm.

A document's set holds its distinct windows of five lower-cased words. Two documents are linked
when ``100 * intersection >= 75 * union``; groups are the connected components of the links.

* ``sketch`` takes 200 MinHash samples of each set. 40 bands of five samples put two documents at
  the threshold into one bucket with probability 0.99998. The samples are also folded into an
  *odd sketch*: a bitmap of 512 bits in which each (place, sample) flips one bit. The population
  count of the XOR of two bitmaps tells how many samples differ.
* Equal word sequences are grouped first and go on as one node, so copies never meet as pairs.
* Round one compares the members of a bucket with one leader only: the member whose buckets are
  largest in sum, as the common origin of many copies is nearer to them than they to each other.
  Pairs that pass the odd sketch are confirmed on the full sets.
* Round two takes the buckets whose members are still in several components. Members are dealt
  into blocks of about 256, large components into blocks of their own, and only pairs of blocks
  of different components meet. Odd sketches, of the samples and of the full sets, tell which
  members have a possible partner, and only these members' texts are fetched. Their full sets are
  compared inside the task of the pair of blocks, which puts out no more links than it takes to
  connect its members. So many texts that are nearly, but not quite, near copies of each other
  cost comparisons, but never rows.

Nulls: a text that is null, empty or blank has an empty set and no links. A row without ``doc_id``
has no component and is kept. Rows that repeat a ``doc_id`` count as one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import LOWER, Scratch, WordHashes, mix, runs, text_bytes, windows

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
BITS = 512
WORDS_64 = BITS // 64
#: Percent of the union that two documents must share.
THRESHOLD = 75
#: Members and windows of a block, on average; pairs that share a copy of their first text.
BLOCK, BLOCK_WINDOWS, SHARE = 256, 1 << 18, 256

_MUL = np.array([xxhash.xxh32_intdigest(f"mul {i}") | 1 for i in range(SAMPLES)], np.uint32)[:, None]
_ADD = np.array([xxhash.xxh32_intdigest(f"add {i}") for i in range(SAMPLES)], np.uint32)[:, None]
_PLACE = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_STEP = 1024


def sifting_limit(threshold: int = THRESHOLD, deviations: float = 5.0) -> int:
    """The largest XOR population count that a pair at the threshold may show.

    With ``d`` differing samples, ``2 d`` bits flip and ``BITS / 2 * (1 - exp(-4 d / BITS))`` are
    expected to stay odd. The limit lies ``deviations`` above that: the deviations of the number of
    differing samples and of the bits they fall on are added in squares.
    """
    differ = SAMPLES * (1 - threshold / 100)
    fade = math.exp(-4 * differ / BITS)
    expected = BITS / 2 * (1 - fade)
    from_samples = 2 * math.sqrt(differ * threshold / 100) * fade
    from_bits = math.sqrt(BITS / 4 * (1 - fade**2))
    return math.ceil(expected + deviations * math.hypot(from_samples, from_bits))


LIMIT = sifting_limit()


def set_bits(n: int) -> int:
    """Bits of the full set's odd sketch: a power of two, half a bit for a window at least."""
    return max(BITS, 1 << max(n // 2 - 1, 0).bit_length())


def set_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the windows by the lowest bits of their hashes: folding halves gives fewer bits."""
    bits = set_bits(len(shingles))
    places = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)


def set_limit(windows: np.ndarray, bits: int, deviations: float = 6.0) -> np.ndarray:
    """The largest population count of two sets at the threshold, with so many windows together."""
    differ = windows * (100 - THRESHOLD) / (100 + THRESHOLD)
    fade = np.exp(-4 * differ / bits)
    variance = np.maximum(bits / 4 * (1 - fade) - differ * fade, 0)
    return bits / 2 * (1 - np.sqrt(fade)) + deviations * np.sqrt(variance) + 1


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct window hashes of a text."""
    return np.unique(windows(hashes.of((text or b"").translate(LOWER).split())))


def minhash(shingles: np.ndarray) -> np.ndarray:
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(upper), _STEP):
        np.minimum(least, (_MUL * upper[None, i : i + _STEP] + _ADD).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    placed = mix(least.astype(np.uint64) ^ _PLACE).reshape(BANDS, ROWS)
    return mix(placed.sum(axis=1, dtype=np.uint64)).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    bits = mix(mix(least.astype(np.uint64)) + _PLACE) % np.uint64(BITS)
    parity = (np.bincount(bits.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in (rows for whole in batches for rows in runs(whole, column=1)):
        contents, sizes, bands, odds, sets = [], [], [], [], []
        for text in text_bytes(batch.column(1)):
            words = (text or b"").translate(LOWER).split()
            shingles = np.unique(windows(hashes.of(words)))
            sizes.append(len(shingles))
            if not words:
                contents.append(None), bands.append(None), odds.append(None), sets.append(None)
                continue
            contents.append(xxhash.xxh3_128_digest(b" ".join(words)))
            least = minhash(shingles)
            bands.append(band_keys(least))
            odds.append(odd_sketch(least))
            sets.append(set_sketch(shingles))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(contents, pa.binary()), pa.array(sizes, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64())),
                pa.array(sets, pa.binary()),
            ],
            ["doc_id", "content", "n_shingles", "bands", "odd", "parities"],
        )


def sketch(docs: DataFrame) -> DataFrame:
    """``(doc_id, content, n_shingles, bands, odd, parities)`` of each ``(doc_id, text)``."""
    return docs.mapInArrow(
        _sketch_batches,
        "doc_id long, content binary, n_shingles long, bands array<long>, odd array<long>, parities binary",
    )


def _odd_bits(a: str, b: str) -> Column:
    """The population count of the XOR of two odd sketches."""
    return sum(
        (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS_64)), F.lit(0)
    )


def _sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    last, left = None, np.empty(0, np.uint64)
    for batch in batches:
        linked = []
        for first, second in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3))):
            if first != last:
                last, left = first, shingle_set(first, hashes)
            right = shingle_set(second, hashes)
            shared = len(np.intersect1d(left, right, assume_unique=True))
            linked.append(100 * shared >= THRESHOLD * (len(left) + len(right) - shared) > 0)
        both = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
        yield both.filter(pa.array(linked, pa.bool_()))


def _texts_of(ids: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, text)`` of the documents ``(node)``. Only texts of candidates are moved."""
    # Candidates are a share of the documents, so the plan is the same for every size.
    wanted = ids.distinct().hint("merge")
    texts = docs.join(wanted, F.col("doc_id") == F.col("node"), "left_semi")
    return scratch.keep(texts.select(F.col("doc_id").alias("node"), "text"), name)


def confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough.

    A node ``a`` of very many pairs gets several copies of its text, one for each ``SHARE`` pairs,
    so that its pairs are spread over tasks.
    """
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    texts = _texts_of(ids, docs, scratch, f"{name}-texts")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    first = parts.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "text_a"
    )
    joined = (
        dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(first, ["a", "part"]).select("a", "b", "text_a", "text_b")
    )
    links = scratch.keep(joined.mapInArrow(_confirm_batches, "a long, b long").distinct(), name)
    scratch.drop(f"{name}-texts")
    return links


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, component)``, the smallest node reachable, for every node of ``links (a, b)``.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its
    larger neighbours, then to its smaller ones. Both need a number of rounds that grows with the
    logarithm of the nodes. Minima are counted map-side and joined back, so a node with very many
    neighbours is no single group.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = scratch.keep(edges.filter("hi != lo").distinct(), f"{name}-0")
    state, turn = _state(edges), 0
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        )
        smallest = larger.groupBy("hi").agg(F.min("lo").alias("m"))
        handed = larger.join(smallest, "hi")
        smaller = handed.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(
            handed.select("hi", F.col("m").alias("lo"))
        )
        edges = scratch.keep(smaller.filter("hi != lo").distinct(), f"{name}-{turn + 1}")
        scratch.drop(f"{name}-{turn}")
        before, state, turn = state, _state(edges), turn + 1
        if state == before:
            break
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges; one row reaches the driver."""
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    )


def _set_near(n: int, small: np.ndarray, sizes: np.ndarray, smalls: np.ndarray) -> np.ndarray:
    """Which sets are near enough to one in size and in folded parities."""
    near = 100 * np.minimum(n, sizes) >= THRESHOLD * np.maximum(n, sizes)
    return near & (np.bitwise_count(small ^ smalls).sum(axis=1) <= set_limit(n + sizes, BITS))


def _parities_close(n: int, one: bytes, m: int, other: bytes) -> bool:
    bits = 8 * min(len(one), len(other))
    if bits == BITS:
        return True  # was compared folded
    odd = folded(one, bits) ^ folded(other, bits)
    return np.bitwise_count(odd).sum() <= set_limit(np.float64(n + m), bits)


def _sift_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of two blocks that have a partner of another component with near odd sketches.

    ``(unit, side, node, component)``: no more rows than members, however many pairs are near.
    """

    def unpacked(items: pa.Array):
        flat = items.flatten()
        column = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        odd = flat.field("odd").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # Unsigned, as the population count of a negative number is that of its absolute value.
        bits = odd.view(np.uint64).reshape(-1, WORDS_64)
        sets = flat.field("parities").to_pylist()
        small = np.array([folded(x, BITS) for x in sets])
        return column("node"), column("component"), column("n_shingles"), bits, sets, small

    for batch in batches:
        units, sides, nodes, labels = [], [], [], []
        for i in range(batch.num_rows):
            unit, leader, same = (batch.column(c)[i].as_py() for c in range(3))
            n1, c1, s1, o1, p1, f1 = unpacked(batch.column(3).slice(i, 1))
            n2, c2, s2, o2, p2, f2 = unpacked(batch.column(4).slice(i, 1))
            left, right = np.zeros(len(n1), bool), np.zeros(len(n2), bool)
            for row in np.flatnonzero(n1 != leader):
                near = np.bitwise_count(o1[row] ^ o2).sum(axis=1) <= LIMIT
                near &= (c1[row] != c2) & (n2 != leader)
                if same:
                    near &= n2 > n1[row]
                near &= _set_near(s1[row], f1[row], s2, f2)
                for k in np.flatnonzero(near):
                    if not (left[row] and right[k]) and _parities_close(s1[row], p1[row], s2[k], p2[k]):
                        left[row] = right[k] = True
            if same:
                left, right = left | right, np.zeros(len(n2), bool)
            for side, n, c, chosen in ((0, n1, c1, left), (1, n2, c2, right)):
                nodes.append(n[chosen]), labels.append(c[chosen])
                units.append(np.full(chosen.sum(), unit, np.int64))
                sides.append(np.full(chosen.sum(), side, np.int32))
        join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
        yield pa.RecordBatch.from_arrays(
            [join(units, np.int64), join(sides, np.int32), join(nodes, np.int64), join(labels, np.int64)],
            ["unit", "side", "node", "component"],
        )


def _linked_in_unit(rows: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the two sides ``(side, node, component, set)`` of a unit.

    Without a second side, the first one's members are compared with each other. Members that are
    connected already, by their component or a link found here, are not compared.
    """
    parent = {c: c for _, _, c, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(r[3]) for r in rows])
    small = np.array([folded(set_sketch(r[3]), BITS) for r in rows])
    sides = np.array([r[0] for r in rows])
    two = sides.any()
    for i, (side, node, label, own) in enumerate(rows):
        if two and side:
            continue
        near = _set_near(sizes[i], small[i], sizes, small)
        near &= sides == 1 if two else np.arange(len(rows)) > i
        for k in np.flatnonzero(near):
            _, other, its, theirs = rows[k]
            one, another = root(label), root(its)
            if one == another:
                continue
            shared = len(np.intersect1d(own, theirs, assume_unique=True))
            if 100 * shared >= THRESHOLD * (len(own) + len(theirs) - shared) > 0:
                parent[one] = another
                yield min(node, other), max(node, other)


def _confirm_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members ``(unit, side, node, component, text)`` sorted by unit to the links ``(a, b)``."""
    hashes, current, held = WordHashes(), None, []

    def links(rows):
        found = list(_linked_in_unit(rows))
        column = lambda i: pa.array([f[i] for f in found], pa.int64())
        return pa.RecordBatch.from_arrays([column(0), column(1)], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(4)]
        for i, (unit, side, node, label) in enumerate(zip(*columns)):
            if unit != current:
                if held:
                    yield links(held)
                current, held = unit, []
            held.append((side, node, label, shingle_set(batch.column(4)[i].as_py().encode(), hashes)))
    if held:
        yield links(held)


def _open_members(members: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``(unit, side, node, component)``: what is to be compared of buckets that hold several components.

    A unit is a pair of blocks of one bucket. The leaders' pairs were compared before.
    """
    labelled = members.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    labelled = labelled.join(nodes.select("node", "n_shingles"), "node")
    sized = labelled.groupBy("band", "component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("windows")
    )
    blocks_of = lambda n, windows: F.greatest(F.ceil(n / BLOCK), F.ceil(windows / BLOCK_WINDOWS))
    few = F.col("n") < BLOCK
    bucket = sized.groupBy("band").agg(
        F.count("*").alias("components"),
        blocks_of(F.sum(F.when(few, F.col("n"))), F.sum(F.when(few, F.col("windows")))).alias("rest"),
    ).filter("components > 1")
    large = sized.filter(~few).select(
        "band", "component", F.col("component").alias("own"), blocks_of(F.col("n"), F.col("windows")).alias("parts")
    )
    dealt = (
        labelled.join(bucket, "band")
        .join(large, ["band", "component"], "left")
        .select(
            "band", "leader", "node", "component", "own",
            F.pmod(F.xxhash64("node"), F.greatest(F.coalesce("parts", "rest"), F.lit(1))).alias("block"),
        )
        .join(nodes.select("node", "n_shingles", "odd", "parities"), "node")
    )
    at = F.struct(F.col("own").isNull().alias("mixed"), "own", "block").alias("at")
    blocks = dealt.groupBy("band", "leader", at).agg(
        F.collect_list(F.struct("node", "component", "n_shingles", "odd", "parities")).alias("items")
    )
    # Blocks meet by name first; their items are fetched for each pair by its own two names.
    names = dealt.select("band", "leader", at).distinct()
    side = lambda s: names.select("band", "leader", F.col("at").alias(f"at_{s}"))
    mixed = F.col("at_l.mixed")
    met = side("l").join(side("r"), ["band", "leader"]).filter(
        (F.col("at_l") < F.col("at_r")) & ~F.col("at_l.own").eqNullSafe(F.col("at_r.own"))
        | (F.col("at_l") <= F.col("at_r")) & mixed & F.col("at_r.mixed")
    )
    key = lambda a: F.xxhash64("band", a)
    items = lambda s: blocks.select(key("at").alias(f"key_{s}"), F.col("band").alias(f"band_{s}"),
                                    F.col("at").alias(f"is_{s}"), F.col("items").alias(f"items_{s}"))
    same_block = lambda s: (F.col("band") == F.col(f"band_{s}")) & F.col(f"at_{s}").eqNullSafe(F.col(f"is_{s}"))
    units = (
        met.withColumn("key_l", key("at_l")).withColumn("key_r", key("at_r"))
        .join(items("l"), "key_l").filter(same_block("l"))
        .join(items("r"), "key_r").filter(same_block("r"))
        .select(
            F.xxhash64("band", "at_l", "at_r").alias("unit"), "leader",
            (F.col("key_l") == F.col("key_r")).alias("same"), "items_l", "items_r",
        )
    )
    return units.mapInArrow(_sift_blocks, "unit long, side int, node long, component long")


def confirmed_in_units(open_members: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links ``(a, b)`` that connect all that the units' links connect, from their members' full sets."""
    texts = _texts_of(open_members.select("node"), docs, scratch, f"{name}-texts")
    told = open_members.join(texts, "node").select("unit", "side", "node", "component", "text")
    dealt = told.repartition("unit").sortWithinPartitions("unit", "side", "node")
    links = scratch.keep(dealt.mapInArrow(_confirm_units, "a long, b long").distinct(), name)
    scratch.drop(f"{name}-texts")
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.keep(sketch(docs), "sketches")

    nodes = scratch.keep(
        rows.filter("content is not null and doc_id is not null")
        .groupBy("content")
        .agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "odd", "parities"))),
        "nodes",
    )
    bands = nodes.select("node", F.explode("bands").alias("band")).distinct()
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.keep(bands.join(sizes, "band"), "shared")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    most = F.max(F.struct("weight", (-F.col("node")).alias("least")))
    leaders = shared.join(weights, "node").groupBy("band").agg((-most["least"]).alias("leader"))
    members = scratch.keep(shared.select("band", "node").join(leaders, "band"), "members")
    scratch.drop("shared")

    edges = members.filter("node != leader").select("leader", "node").distinct()
    side = lambda name: nodes.select(
        F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}")
    )
    sifted = (
        edges.select(F.col("leader").alias("a"), F.col("node").alias("b"))
        .join(side("b"), "b").join(side("a"), "a")
        .filter(_sizes_fit("n_a", "n_b") & (_odd_bits("odd_a", "odd_b") <= LIMIT))
        .select("a", "b").distinct()
    )
    docs = docs.filter("doc_id is not null")
    links = confirmed(scratch.keep(sifted, "pairs-1"), docs, scratch, "links-1")
    found = scratch.keep(components(links, scratch, "round-1"), "found-1")

    more = scratch.keep(_open_members(members, nodes, found), "open")
    links = links.union(confirmed_in_units(more, docs, scratch, "links-2"))
    found = scratch.keep(components(links, scratch, "round-2"), "found-2")

    by_content = nodes.select("content", "node").join(found, "node", "left").select(
        "content", F.coalesce("component", "node").alias("group")
    )
    named = rows.select("doc_id", "content", "n_shingles").join(by_content, "content", "left")
    # One id may stand on several contents when rows repeat it.
    result = named.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return result
