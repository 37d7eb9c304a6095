"""WARC files and a Merkle fixity audit of their replicas.

``write_archive`` writes records as WARC/1.1 files of 1,024 records each, gzipped, one folder per
file. ``read_archive`` reads the files by their declared lengths into records with file, number,
offset and payload. A replica's *tree* has the SHA-256 of each record as its leaves. A file's node
covers its records in the order of their offsets, and each node above covers 256 files or nodes.
A hash covers the children's places, offset ranges and hashes, so a moved, missing or added record
changes it as much as a changed one.

``audit`` compares the roots of two trees and goes down one level at a time, joining only the
children of nodes that differ. Intact replicas cost one comparison, and each fault costs a path.

Nulls: a null payload is an empty record, a null URL leaves the header out, a null id is written
as an empty one. Repeated rows are records of their own. An empty table has an empty tree: two
empty replicas agree, an empty and a filled one differ in every record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagemill.llm.common import Scratch

FILE_BITS, FAN_BITS = 10, 8
#: Files of one input partition: 2 ** 16 files of 2 ** 10 records.
PART_BITS = 16
END = "\r\n\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line, left out for null; line breaks in the value would end it."""
    return F.coalesce(
        F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]", " "), F.lit("\r\n")), F.lit("")
    )


def record(page_id: str, url: str, html: str) -> Column:
    """A resource record without its closing line breaks."""
    body = F.coalesce(F.col(html), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Target-URI", F.col(url)),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END), body,
    )


def write_records(records: DataFrame, path: str) -> None:
    """Write ``(file, number, record)``; each task writes its files one after the other."""
    (
        records.sortWithinPartitions("file", "number").select("file", "record")
        .write.partitionBy("file").option("lineSep", END).option("compression", "gzip").text(path)
    )


def write_archive(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Write pages as an archive, in the order of the input's partitions, without a shuffle."""
    # The partition is in the upper bits of this id, the row in the lower 33.
    records = pages.select(F.monotonically_increasing_id().alias("place"), record(page_id, url, html).alias("record"))
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    chunk = F.shiftright(row, FILE_BITS)
    file = F.when(chunk < 1 << PART_BITS, F.shiftleft(part, PART_BITS) + chunk)
    write_records(
        records.select(
            F.coalesce(file, F.raise_error(F.lit("use smaller input partitions")).cast("long")).alias("file"),
            row.bitwiseAND((1 << FILE_BITS) - 1).cast("int").alias("number"), "record",
        ),
        path,
    )


def parse(content: bytes) -> Iterator[tuple[int, bytes]]:
    """``(offset, record)`` of each record of an unpacked file, by the declared lengths.

    Bytes that are no record (a damaged header) are given as one record up to the end of the file.
    """
    at = 0
    while at < len(content):
        head = content.find(END.encode(), at)
        length = None
        if content.startswith(b"WARC/", at) and head >= 0:
            for line in content[at:head].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.lower() == b"content-length" and value.strip().isdigit():
                    length = int(value)
        if length is None:
            yield at, content[at:]
            return
        end = min(head + 4 + length, len(content))
        yield at, content[at:end]
        at = end + len(END) if content.startswith(END.encode(), end) else end


def header(rec: bytes, name: bytes) -> str | None:
    for line in rec.partition(END.encode())[0].split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key == name:
            return value.strip().decode("utf-8", "replace")
    return None


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
    number = F.regexp_extract("path", r"file=(\d+)/[^/]*$", 1).cast("long").alias("file")
    return files.load(path).select(number, "content")


def _unpacked(content: bytes) -> bytes:
    """What can be unpacked; a damaged file ends where its damage begins."""
    tool, out = zlib.decompressobj(31), []
    try:
        out.append(tool.decompress(content))
        out.append(tool.flush())
    except zlib.error:
        pass
    return b"".join(out)


def _record_batches(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = list(parse(_unpacked(content.as_py())))
                page = [(header(r, b"WARC-Record-ID") or "")[len("<urn:page:") : -1] for _, r in records]
                columns = {
                    "file": pa.array([file] * len(records), pa.int64()),
                    "number": pa.array(range(len(records)), pa.int32()),
                    "offset": pa.array([o for o, _ in records], pa.int64()),
                    "length": pa.array([len(r) for _, r in records], pa.int64()),
                    "page": pa.array(page, pa.string()),
                    "url": pa.array([header(r, b"WARC-Target-URI") for _, r in records], pa.string()),
                    "hash": pa.array([hashlib.sha256(r).digest() for _, r in records], pa.binary()),
                }
                if payload:
                    columns["record"] = pa.array([r.decode("utf-8", "replace") for _, r in records], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


LEAF = "file long, number int, offset long, length long, page string, url string, hash binary"


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record: ``file, number, offset, length, page, url, hash`` and the ``record``."""
    schema = LEAF + (", record string" if payload else "")
    return _files(spark, path).mapInArrow(_record_batches(payload), schema)


# --- trees


def tree(leaves: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels above the leaves, files first and the root last: ``(node, first, last, hash)``.

    ``first`` and ``last`` bound a file's bytes, and above files the numbers of the files.
    """

    def level(children: DataFrame, at: int) -> DataFrame:
        child = F.concat_ws(":", "place", "first", "last", F.hex("hash"))
        return scratch.keep(
            children.groupBy("node").agg(
                F.min("first").alias("first"), F.max("last").alias("last"),
                F.unhex(F.sha2(F.array_join(F.sort_array(F.collect_list(child)), ","), 256)).alias("hash"),
            ),
            f"{name}-{at}",
        )

    levels = [
        level(
            leaves.select(
                F.col("file").alias("node"), F.lpad(F.col("number").cast("string"), 5, "0").alias("place"),
                F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), "hash",
            ),
            0,
        )
    ]
    while levels[-1].filter("node != 0").take(1):  # the root is node 0
        lower = levels[-1]
        children = lower.select(
            F.shiftright("node", FAN_BITS).alias("node"), F.lpad(F.col("node").cast("string"), 20, "0").alias("place"),
            (F.col("first") if len(levels) > 1 else F.col("node")).alias("first"),
            (F.col("last") if len(levels) > 1 else F.col("node")).alias("last"), "hash",
        )
        levels.append(level(children, len(levels)))
    return levels


def differing_files(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame | None:
    """``(file)`` of the files that differ, or None if the roots agree.

    Goes down from the root; at each level only the children of differing nodes are compared.
    """
    height = max(len(ours), len(theirs))
    wanted = None
    for at in range(height - 1, -1, -1):
        # A lower tree has the same single root on the levels that it lacks.
        a, b = (side[min(at, len(side) - 1)].select("node", F.col("hash").alias(h)) for side, h in ((ours, "a"), (theirs, "b")))
        if wanted is not None:
            parent = F.shiftright("node", FAN_BITS)
            a, b = (x.join(wanted, parent == F.col("parent"), "left_semi") for x in (a, b))
        differ = a.join(b, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if wanted is None and not differ.take(1):
            return None
        wanted = differ.select(F.col("node").alias("parent"))
    return wanted.select(F.col("parent").alias("file"))


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The records of two replicas that differ: ``page``, ``url``, ``file``, ``offset`` (ours, or
    theirs if we have none) and ``status``: ``corrupt``, ``missing`` (in theirs) or ``added``.

    ``ours`` and ``theirs`` are written leaves as of ``read_archive``. In a differing file records
    are matched by page and occurrence, so a lost record does not make its followers differ.
    """
    spark = ours.sparkSession
    scratch = Scratch(spark, "audit")
    files = differing_files(tree(ours, scratch, "ours"), tree(theirs, scratch, "theirs"))
    if files is None:
        files = spark.createDataFrame([], "file long")
    turn = F.row_number().over(Window.partitionBy("file", "page").orderBy("number"))  # within one file

    def side(leaves: DataFrame, s: str) -> DataFrame:
        return leaves.join(files, "file", "left_semi").select(
            "file", "page", turn.alias("turn"), *(F.col(c).alias(f"{c}_{s}") for c in ("url", "offset", "hash"))
        )

    both = side(ours, "a").join(side(theirs, "b"), ["file", "page", "turn"], "full")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "added").otherwise("corrupt")
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(
        "page", F.coalesce("url_a", "url_b").alias("url"), "file", "turn",
        F.coalesce("offset_a", "offset_b").alias("offset"), status.alias("status"),
    )
