"""Block streams: u32 size (with the 12-byte header), 4-byte type, i32 id, payload; TAIL/-1 ends.

A block's place depends on all sizes before it, so a file is one sequential
walk; files are independent rows. The walk is a short generator in an Arrow
task, and every later operator is a DataFrame expression over its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binary import mac_bytes, pack_u32
from ..functions.classify import BLOCK_TYPES

HEADER = 12
#: Bytes of rows that a scan hands on at once, bytes of a part of a written stream, and order values a cell of prefix sums.
BATCH_BYTES = 4 << 20
PART_BYTES = 16 << 20
CELL = 1 << 16
SCHEMA = (
    "file string, seq int, type string, id int, offset long, size long, payload_offset long, payload_bytes long, payload binary, status string"
)
ARROW = pa.schema(
    [("file", pa.string()), ("seq", pa.int32()), ("type", pa.string()), ("id", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()),
     ("payload_offset", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("status", pa.string())]
)


def walk(data: bytes, strict_tail: bool = False, payloads: bool = True, start: int = 0, first: int = 0) -> Iterator[tuple]:
    """(seq, type, id, offset, size, payload_offset, payload_bytes, payload, status) of each block.

    A damaged place is a last row with a null type and the error as its status.
    FREE blocks are skipped (null payload). strict_tail makes bytes after TAIL an error. ``start`` and
    ``first`` are the offset and number of the first block, where the bytes are a later part of a stream.
    """
    at, seq = 0, first
    while at < len(data):
        head = data[at : at + HEADER]
        if len(head) < HEADER:
            yield seq, None, None, start + at, None, None, None, None, "truncated header"
            return
        size = int.from_bytes(head[:4], "big")
        kind = head[4:8].decode("mac_roman")
        number = int.from_bytes(head[8:], "big", signed=True)
        body = at + HEADER
        if size < HEADER:
            yield seq, None, None, start + at, size, None, None, None, "invalid size"
            return
        if at + size > len(data):
            yield seq, None, None, start + at, size, None, None, None, "truncated payload"
            return
        last = kind == "TAIL" and number == -1
        status = "terminal" if last else "skipped" if kind == "FREE" else "ok"
        payload = data[body : at + size] if payloads and kind != "FREE" else None
        yield seq, kind, number, start + at, size, start + body, size - HEADER, payload, status
        at, seq = at + size, seq + 1
        if last:
            if strict_tail and at < len(data):
                yield seq, None, None, start + at, None, None, None, None, "bytes after the end"
            return


def scan_blocks(files: DataFrame, strict_tail: bool = False, payloads: bool = True) -> DataFrame:
    """Blocks of (file, content) rows, or of (file, content, start, first) parts of streams. Without payloads only the block table is made."""
    parts = "start" in files.columns and "first" in files.columns
    rows = files.select("file", "content", *([F.col("start"), F.col("first")] if parts else [F.lit(0).alias("start"), F.lit(0).alias("first")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, content, start, first = (c[i].as_py() for c in batch.columns)
                held, size = [], 0
                for row in walk(content or b"", strict_tail, payloads, start, first):
                    held.append((file, *row))
                    size += 200 + len(row[7] or b"")
                    if size > BATCH_BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return rows.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def read_blocks(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Blocks of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return scan_blocks(files.select(F.col("path").alias("file"), "content"), **options)


def block_bytes(kind, number, payload):
    """A block as bytes, from columns (type, id, payload)."""
    return F.concat(pack_u32(F.octet_length(payload) + HEADER), mac_bytes(F.rpad(kind, 4, " ")), pack_u32(number), payload)


def write_stream(rows: DataFrame, by: str, kind, number, payload, order: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(file, part, start, first, content): the blocks of each group in order, then TAIL.

    A stream comes in parts of about ``part_bytes``, each with the offset and number of its first block, as a
    group may be larger than a value can be. ``order`` is a column of whole numbers, nulls first; blocks of one order
    stand in order of their bytes, equal ones as often as they are there. The payloads are exchanged twice: by cell, to be placed, and by part.
    """
    blocks = rows.select(F.col(by).alias("file"), F.col(order).cast("long").alias("order"), block_bytes(kind, number, payload).alias("block"))
    sized = blocks.withColumn("size", F.octet_length("block").cast("long"))
    placed = offsets_from_sizes(sized, "file", "order", "size", number="first", ties=("block",))
    whole = placed.select("file", F.col("offset").alias("start"), "first", "block")
    ends = sized.groupBy("file").agg(F.sum("size").alias("start"), F.count("*").alias("first"))
    tails = ends.select("file", "start", "first", F.unhex(F.lit("0000000C5441494CFFFFFFFF")).alias("block"))
    return whole.unionByName(tails).groupBy("file", F.floor(F.col("start") / part_bytes).alias("part")).agg(
        F.min("start").alias("start"), F.min("first").alias("first"), F.expr("listagg(block) WITHIN GROUP (ORDER BY start)").alias("content")
    )


def block_map(blocks: DataFrame) -> DataFrame:
    """One row for each (file, type, id): the last block wins; FREE and the end are left out."""
    held = blocks.where("status = 'ok'")
    newest = F.max_by(F.struct("seq", "offset", "size", "payload"), "seq")
    return held.groupBy("file", "type", "id").agg(newest.alias("last")).select("file", "type", "id", "last.*")


def type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.where("type IS NOT NULL").groupBy("file", "type").agg(F.count("*").alias("n"))


def unknown_types(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("type").isNotNull() & ~F.col("type").isin(*BLOCK_TYPES))


def offsets_from_sizes(rows: DataFrame, by: str, order: str, size: str, number: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Where each block starts: the sizes before it, summed, as ``offset``; with ``number``, so named, the rows before it.

    Rows with one value of ``by`` are summed in cells of CELL consecutive values of ``order``, a column of
    whole numbers, and over the cells, so a large group is not one task. Nulls come first; rows of one order are told apart by the
    columns ``ties``.
    """
    nowhere = -(1 << 62)
    cells = rows.withColumn("_cell", F.coalesce(F.floor(F.col(order) / CELL), F.lit(nowhere)))
    totals = cells.groupBy(by, "_cell").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    place = [F.col(order).asc_nulls_first(), *ties]

    def before(column, partition: list[str], ordered: list):
        window = Window.partitionBy(*partition).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    starts = totals.select(F.col(by).alias("_by"), F.col("_cell").alias("_at"), before("_bytes", [by], ["_cell"]).alias("_start"), before("_rows", [by], ["_cell"]).alias("_first"))
    joined = cells.join(starts, cells[by].eqNullSafe(starts["_by"]) & (cells["_cell"] == starts["_at"]))
    placed = joined.withColumn("offset", F.col("_start") + before(size, [by, "_cell"], place))
    if number:
        placed = placed.withColumn(number, F.col("_first") + before(F.lit(1), [by, "_cell"], place))
    dropped = ["_cell", "_by", "_at", "_start", *([] if number == "_first" else ["_first"])]
    return placed.drop(*dropped)


def missing_references(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """(file, type, id, field) that a record names (id at least 0) and the file lacks."""
    return references.where("id >= 0").join(blocks.select("file", "type", "id"), ["file", "type", "id"], "left_anti")
