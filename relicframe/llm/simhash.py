"""SimHash near-duplicates with pigeonhole blocks.

A 64-bit fingerprint is cut into five blocks. Fingerprints that differ in three
bits or fewer agree on at least two of them, so each is filed under
its ten pairs of blocks (25 or 26 bits and the pair's number); only
fingerprints that share a file are compared, by Hamming distance. Documents with equal
fingerprints are one class from the start, so copies cost nothing here.

A file of any size is compared in tiles (see tiles.py). What a tile returns is a
spanning forest of its links, not its links: a star for each connected
part, found by expanding one member at a time against the unvisited rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact_columns, hold, materialize, release, small_side, text_batches
from .components import components
from .tiles import dealt, runs, tile

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BLOCKS = 5
TILE_ROWS = 4096


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text, as a signed long."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return exact_columns(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def _block_bits() -> list[int]:
    return [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]


def block_keys(fp: Column) -> Column:
    """The files of a fingerprint: one long for each pair of blocks."""
    widths = _block_bits()
    starts = [sum(widths[:i]) for i in range(BLOCKS)]
    blocks = [F.shiftrightunsigned(fp, s).bitwiseAND((1 << w) - 1) for s, w in zip(starts, widths, strict=True)]
    agree = BLOCKS - MAX_BITS
    keys = []
    for number, chosen in enumerate(combinations(range(BLOCKS), agree)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(blocks[i])
        keys.append(key)
    return F.array(*keys)


def spanning_stars(values: np.ndarray, own: np.ndarray | None, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (first, member) that connect what distances up to max_bits connect; with own, only across tiles."""
    links: list[tuple[int, int]] = []
    rest = np.arange(len(values))
    while rest.size > 1:
        first, rest = rest[0], rest[1:]
        frontier = [first]
        while frontier and rest.size:
            at = frontier.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= max_bits
            if own is not None:
                near &= own[rest] != own[at]
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(first, x) for x in found]
                frontier += list(found)
    return links


#: Block keys of a fingerprint, and rows of one task that compares those of one key, about.
BLOCK_KEYS, TASK_ROWS = 10, 1_000_000


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect the fingerprints ``fp`` as all pairs within MAX_BITS would."""
    files = classes.select("fp", F.explode(block_keys(F.col("fp"))).alias("run_key"))
    ready = dealt(tile(files, "fp", TILE_ROWS), -(-BLOCK_KEYS * classes.count() // TASK_ROWS)).select("run_key", "tile_a", "tile_b", "own", "fp")

    def columns(table: pa.Table) -> dict:
        return {"fp": table.column("fp").to_numpy().view(np.uint64), "own": table.column("own").to_numpy()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        held = 0
        for group, across in runs(batches, columns):
            found = spanning_stars(group["fp"], group["own"] if across else None)
            if found:
                pairs = group["fp"].view(np.int64)[np.array(found)]
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
                held += len(found)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return ready.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) a row: component_id is the smallest id that links reach, its own included.

    Null and empty texts have fingerprint 0 and link like any other. A null id
    never is a component's id unless all ids of the component are null. Repeated
    rows come out as often as they went in; long texts count whole; columns besides these two are not read, whatever their names; an empty table gives no rows.
    """
    return grouped(fingerprints(docs, id_col, text_col), id_col).select(id_col, "fp", "component_id")


def grouped(prints: DataFrame, id_col: str) -> DataFrame:
    """Rows with a fingerprint ``fp``, plus root (a fingerprint that stands for the component) and component_id."""
    prints = materialize(prints, "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    rooted = materialize(components(links(classes.select("fp"))).withColumnRenamed("node", "fp"), "roots")
    linked = classes.join(rooted, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "root", "component_id")
    # classes without a link keep their own smallest id; the linked ones are few
    alone = classes.join(rooted.select("fp"), "fp", "left_anti")
    alone = alone.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return prints.join(alone.unionByName(moved), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id.

    A null doc_id comes after all others; among different texts of one doc_id the one of
    the smaller hash stays, among repeated rows any one. A text that shares its doc_id with a dropped
    one stays if its own group has no smaller id. Null and empty texts are one group; long texts count whole. All columns come out as they were, whatever their names. An
    empty table gives no rows.
    """
    spark, columns = docs.sparkSession, docs.columns
    docs = hold(docs, ("doc_id", "text"), apart=True)
    text_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], names=["doc_id", "text_hash", "fp"])

    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = docs.select("doc_id", "text", text_hash.alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")
    rows = materialize(grouped(prints, "doc_id").select("doc_id", "text_hash", "root"), "near-duplicates")
    rank = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    # groups of one document need no verdict
    several = first.where("n > 1").select("root", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    several = materialize(several, "duplicate-groups")
    judged = rows.join(small_side(several, several.count()), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
    counted = judged.groupBy("doc_id", "text_hash", "stays").agg(F.count("*").alias("n"))
    # (doc_id, text) whose rows go, all of them or all but one
    gone = materialize(counted.where("NOT stays OR n > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "stays"), "duplicates")
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("gone_hash"))
    kept = docs.join(small_side(gone, gone.count()), same, "left_anti")
    repeated = gone.where("stays")
    n = repeated.count()
    if n:
        again = docs.join(small_side(repeated, n), same, "left_semi").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
        kept = kept.unionByName(again.dropDuplicates(["doc_id", "text_hash"]).select(*docs.columns))
    return kept.select(*release(columns, apart=("doc_id", "text")))
