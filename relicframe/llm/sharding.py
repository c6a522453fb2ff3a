"""Sharding by histogram sort: near-equal bytes in key order, one exchange.

The sort key of a document is its text's hash, then its id's hash, of 63 bits
each, so equal texts lie side by side and a group of copies can still be
cut. Each round counts, over all partitions, the exact bytes that lie below a
grid of candidate keys, and keeps for each splitter the one grid cell that its
target falls into; the next round probes only inside those cells, until every
splitter is within its tolerance. A splitter that falls among rows of one text and id is
cut by a third number, given to the rows of just these keys. Then every document
is sent once to its key range.

The driver searches the splitters between shards and no others: it sees a few counts of grid cells for each of
them, however large the table. The ranges within a shard, which
bound what a task sorts, are cells of a grid of key prefixes; texts and ids too large for their cell are cut
further by their next key. Their table and the ranges' counts are DataFrames, joined to the documents.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, materialize, release, small_side

KEY_BITS = 63
ROW_OVERHEAD = 16
#: Probes a splitter in a round after the first: 2**BITS, or 2**FEW_BITS where few cells are open.
BITS = 5
FEW_BITS, FEW_CELLS = 9, 256
#: Bytes that a splitter may lie off its target, as a part of a shard.
TOLERANCE = 0.0005
#: A key range within a shard holds about this many bytes at most.
RANGE_BYTES = 8 << 20

Key = tuple[int, ...]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _hash63(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND((1 << KEY_BITS) - 1)


@dataclass
class Search:
    """Splitters found, and those whose target lies in an open cell: (key prefix, cell start) -> (bytes below, splitters)."""

    targets: list[float]
    slack: list[float]
    found: dict[int, Key] = field(default_factory=dict)
    open_cells: dict[Key, tuple[int, list[int]]] = field(default_factory=dict)

    def refine(self, keyed: DataFrame, depth: int) -> None:
        """Search along column ``k<depth>`` until every splitter is found or sits on one value of it.

        Open cells are then the prefixes one value longer.
        """
        prefix = [f"k{i}" for i in range(depth)]
        column = F.col(f"k{depth}")
        width = KEY_BITS
        self.open_cells = {(*p, 0): x for p, x in self.open_cells.items()}
        while self.open_cells and width:
            later = FEW_BITS if len(self.open_cells) <= FEW_CELLS else BITS
            bits = later if width < KEY_BITS else max(FEW_BITS, math.ceil(math.log2(len(self.targets) + 1)) + 3)
            rest = max(width - bits, 0)
            level = keyed
            for i, name in enumerate(prefix):
                level = level.where(F.col(name).isin({k[i] for k in self.open_cells}))
            if width < KEY_BITS:
                level = level.where(F.shiftright(column, width).isin({k[depth] >> width for k in self.open_cells}))
            cells: dict[Key, list[tuple[int, int]]] = {}
            for row in level.groupBy(*prefix, F.shiftright(column, rest).alias("cell")).agg(F.sum("size").alias("bytes")).collect():
                at = row["cell"] << rest
                cells.setdefault((*row[:depth], at >> width << width), []).append((at, row["bytes"]))
            following: dict[Key, tuple[int, list[int]]] = {}
            for start, (below, wanted) in self.open_cells.items():
                self._place(start[:depth], sorted(cells.get(start, [])), below, wanted, 1 << rest, following)
            self.open_cells, width = following, rest

    def _place(self, prefix: Key, cells: list[tuple[int, int]], below: int, wanted: list[int], step: int, following: dict) -> None:
        ends = []
        for _, size in cells:
            ends.append((ends[-1] if ends else below) + size)
        for i in wanted:
            j = min(bisect.bisect_left(ends, self.targets[i]), len(cells) - 1)
            at, size = cells[j]
            if self.targets[i] - (ends[j] - size) <= self.slack[i]:
                self.found[i] = (*prefix, at)
            elif ends[j] - self.targets[i] <= self.slack[i]:
                self.found[i] = (*prefix, min(at + step, (1 << KEY_BITS) - 1))
            else:
                following.setdefault((*prefix, at), (ends[j] - size, []))[1].append(i)

    def settle(self) -> None:
        """Put the splitters still open before the key that they sit on."""
        for key, (_, wanted) in self.open_cells.items():
            self.found |= dict.fromkeys(wanted, key)

    def cuts(self) -> list[Key]:
        return [(*self.found[i], 0, 0)[:3] for i in range(len(self.targets))]


def range_of(cuts: list[Key]) -> Column:
    """Number of cuts at or below the key (k0, k1, k2): a binary search over constant arrays."""
    if not cuts:
        return F.lit(0)
    arrays = [F.split(F.lit(" ".join(str(c[i]) for c in cuts)), " ").cast("array<long>") for i in range(3)]

    def not_above(at: Column) -> Column:
        a, b, c = (F.get(x, at) for x in arrays)
        same = F.col("k0") == a
        return (F.col("k0") > a) | (same & (F.col("k1") > b)) | (same & (F.col("k1") == b) & (F.col("k2") >= c))

    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & F.coalesce(not_above(low + step - 1), F.lit(False)), low + step).otherwise(low)
    )


RANGE = ["shard", "cell", "part"]


def crowded(narrow: DataFrame, bits: int, limit: float) -> tuple[DataFrame, int]:
    """(cell, texts) of grid cells that hold a text of more than ``limit`` bytes in several rows, and their number.

    ``texts`` are such k0, how many parts they are cut into, and the ids (k1) of theirs that are too large by themselves. All by
    aggregations of counts: a cell has no more of them than it has bytes for.
    """
    cell = F.shiftright("k0", KEY_BITS - bits).alias("cell")

    def large(rows: DataFrame, *keys: str | Column) -> DataFrame:
        summed = rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > 2 * limit) & (F.col("n") > 1))
        return summed.withColumn("parts", F.ceil(F.col("bytes") / limit)).drop("bytes", "n")

    cells = materialize(large(narrow.withColumn("cell", cell), "cell"), "large-cells")
    if not (n := cells.count()):
        return cells, 0
    texts = materialize(large(narrow.withColumn("cell", cell).join(small_side(cells.drop("parts"), n), "cell", "left_semi"), "cell", "k0"), "large-texts")
    if not (n := texts.count()):
        return texts, 0
    ids = large(narrow.join(small_side(texts.select("k0"), n), "k0", "left_semi"), "k0", "k1")
    listed = ids.groupBy("k0").agg(F.sort_array(F.collect_list(F.struct("k1", "parts"))).alias("ids"))
    none = F.array().cast("array<struct<k1:bigint,parts:bigint>>")
    whole = texts.join(listed, "k0", "left").select("cell", F.struct("k0", "parts", F.coalesce("ids", none).alias("ids")).alias("text"))
    out = materialize(whole.groupBy("cell").agg(F.sort_array(F.collect_list("text")).alias("texts")), "crowded-cells")
    return out, out.count()


def part_of(texts: Column) -> Column:
    """Place of the key within its cell, as numbers in key order.

    Between and at the large texts, then the share of k1, then between and at the large ids, then the share of k2.
    """

    def among(large: Column, key: str) -> tuple[Column, Column]:
        """(2 * number of smaller ones, plus 1 at one of them; that one)"""
        below = F.size(F.filter(large, lambda x: x[key] < F.col(key)))
        own = F.get(F.filter(large, lambda x: x[key] == F.col(key)), F.lit(0))
        return 2 * below + F.when(own.isNotNull(), 1).otherwise(0), own

    def share(key: str, parts: Column) -> Column:
        return F.coalesce(F.floor(F.col(key) / float(1 << KEY_BITS) * parts), F.lit(0)).cast("int")

    at, text = among(texts, "k0")
    at_id, one = among(text["ids"], "k1")
    return F.array(at, share("k1", text["parts"]), F.coalesce(at_id, F.lit(0)), share("k2", one["parts"]))


def shard_documents(docs: DataFrame, shards: int = 40, ranges: int | None = None) -> DataFrame:
    """``docs`` plus size, shard and slot (gapless from 0, in key order).

    Shards hold near-equal bytes (UTF-8 bytes of the text plus 16 a row). A null
    text counts as no bytes and a null id has a hash of its own; repeated rows lie side by side and are cut
    where a shard ends, like any others; one very long text is one row of one shard; an empty table gives no rows. ``ranges`` is the least number of key ranges
    a shard is sorted in, by default as many as RANGE_BYTES asks for. Columns of the
    input named like an output column, in any case, are replaced, others of any name pass through.
    """
    outputs = ("size", "shard", "slot")
    # both keys and all that goes through in one struct, so that no name can clash
    keyed = hold(docs, ("doc_id", "text"), outputs).select(
        "held", _hash63(F.coalesce("text", F.lit(""))).alias("k0"), _hash63(F.col("doc_id"), F.lit(7)).alias("k1"),
        F.lit(0).cast("long").alias("k2"), (text_bytes(F.col("text")) + ROW_OVERHEAD).alias("size"),
    )
    narrow = materialize(keyed.select("k0", "k1", "k2", "size"), "shard-keys")
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = total / shards / ranges if ranges else RANGE_BYTES
    bits = max(1, math.ceil(math.log2(max(1.0, total / max(limit, 1)))))
    large, n_large = crowded(narrow, bits, limit)
    search = Search([i * total / shards for i in range(1, shards)], [total * TOLERANCE / shards] * (shards - 1))
    if total:
        search.open_cells = {(): (0, list(range(shards - 1)))}
        search.refine(narrow, 0)
        search.refine(narrow, 1)
        open_keys = list(search.open_cells)
        if open_keys or n_large:
            repeats = docs.sparkSession.createDataFrame(open_keys, "k0 long, k1 long")
            if n_large:
                ids = large.select(F.explode("texts").alias("t")).select(F.col("t.k0").alias("k0"), F.explode("t.ids.k1").alias("k1"))
                repeats = repeats.unionByName(ids).distinct()
            keyed, narrow, repeated = number_repeats(keyed, narrow, repeats)
            search.refine(repeated, 2)
        search.settle()
    else:
        search.found = {i: (0,) for i in range(shards - 1)}
    place = range_of(search.cuts())

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"shard": place.cast("int"), "cell": F.shiftright("k0", KEY_BITS - bits)})
        if not n_large:
            return rows.withColumn("part", F.array(F.lit(0)))
        joined = rows.join(small_side(large, n_large), "cell", "left")
        return joined.withColumn("part", F.when(F.col("texts").isNotNull(), part_of(F.col("texts"))).otherwise(F.array(*[F.lit(0)] * 4))).drop("texts")

    # a row a range: the rows of the ranges before it in its shard
    counts = placed(narrow).groupBy(*RANGE).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*RANGE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*RANGE).orderBy("k0", "k1", "k2")
    sent = placed(keyed).join(offsets, RANGE).withColumn("slot", F.col("offset") + F.row_number().over(within) - 1)
    return sent.select(*release(docs.columns, outputs), "size", "shard", "slot")


def number_repeats(keyed: DataFrame, narrow: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed, narrow, rows of ``keys`` alone) with a number k2 of their own for rows of these (k0, k1).

    The rows are written, numbers included, so that all later reads see the same ones. There are
    at most as many keys as splitters and as ids of a range's bytes and more.
    """
    keys = materialize(keys, "repeated-keys")
    wanted = small_side(keys, keys.count())
    numbers = _hash63(F.monotonically_increasing_id(), F.lit(3))
    repeated = materialize(keyed.join(wanted, ["k0", "k1"], "left_semi").withColumn("k2", numbers), "repeated-rows")
    few = repeated.select("k0", "k1", "k2", "size")
    return (
        keyed.join(wanted, ["k0", "k1"], "left_anti").unionByName(repeated),
        narrow.join(wanted, ["k0", "k1"], "left_anti").unionByName(few),
        few,
    )
