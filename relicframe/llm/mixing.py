"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. The
prefix sum of the expected copies, plus one random offset of the source,
crosses integer boundaries; a document is taken once for each that it crosses,
so its copies are the two integers around the expectation and a source
comes near its target. Documents are summed in order of size class, cell and
size, so that each size has its share.

The prefix sum is distributed: cells of (source, size class, hash) are counted,
the counts are summed over the cells of a size class and over the classes of a source, and
documents are numbered within their cell only. There are so many cells that one holds about
CELL_DOCS documents at most, whatever the size of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import exact_columns, hold, materialize, release

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (1, 2, 3)
#: A target stops at this many times its source's size.
MAX_REPEATS = 3
SIZE_CLASSES = 64
#: Hash cells of a size class, at least; the documents of a cell are numbered together.
CELLS = 64
#: Documents a cell if all were of one source and size class.
CELL_DOCS = 1 << 16
SEED = 20


def word_count(text: Column) -> Column:
    """Words of a text without splitting it into an array of strings."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of an MD5, the same in any SQL engine."""
    digest = F.md5(F.encode(F.concat_ws(":", F.lit(str(SEED)), *parts), "utf-8"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def group_key(source: Column) -> Column:
    """A key without nulls that sorts as the source does; null gets the empty key."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sources: DataFrame) -> DataFrame:
    """(mix_key, source_size) plus target: the whole shared by weight, capped, excess reshared.

    In order of cap over weight, the sources before the first that stays under
    its cap are the capped ones; what they leave is shared by weight. The table
    has a row a source, so its windows are small.
    """
    last = F.col("mix_key") == ""
    place = (F.row_number().over(Window.orderBy(last, "mix_key")) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place + 1).cast("int")).cast("long")
    weighed = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    ratio = F.col("cap") / F.col("weight")
    before = Window.orderBy(ratio, last, "mix_key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    tried = weighed.withColumn("level", left / weights)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(ratio.alias("ratio"), "level"))
    share = F.min(fits).over(everything)["level"]
    target = F.least(share * F.col("weight"), F.col("cap").cast("double"))
    return tried.withColumn("target", target).select("mix_key", "source_size", "target")


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken words.

    Size is the words of the whole text (null: 0). A null source is a source of its
    own; a source without words takes nothing; equal rows are numbered in any
    order, which gives equal rows; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    sized = materialize(exact_columns(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size")), "word-counts")
    return assign_copies(sized)


def assign_copies(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size) and any column ``held`` with source_size, target, copies and taken."""
    cells = F.lit(max(CELLS, -(-sized.count() // CELL_DOCS)))
    # the small addend keeps whole powers of two on their side of the edge whatever the logarithm's last digit
    classes = F.least(F.floor(F.log2(F.col("size") + 1) * 4 + 1e-9), F.lit(SIZE_CLASSES - 1)).cast("int")
    cell = F.floor(hash_unit(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) * cells).cast("int")
    keys = ["mix_key", "mix_class", "mix_cell"]
    celled = sized.withColumns({"mix_key": group_key(F.col("source")), "mix_class": classes, "mix_cell": cell})
    per_cell = materialize(celled.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("size")), "mix-cells")
    per_source = targets(per_cell.groupBy("mix_key").agg(F.sum("size").alias("source_size")))
    per_class = per_cell.groupBy("mix_key", "mix_class").agg(F.sum("n").alias("n"))

    def before(window) -> Column:
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    class_starts = per_class.select("mix_key", "mix_class", before(Window.partitionBy("mix_key").orderBy("mix_class")).alias("class_start"))
    in_class = before(Window.partitionBy("mix_key", "mix_class").orderBy("mix_cell"))
    starts = per_cell.select(*keys, in_class.alias("cell_start")).join(class_starts, ["mix_key", "mix_class"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = starts.join(per_source, "mix_key").select(
        *keys, (F.col("class_start") + F.col("cell_start")).alias("start"), "source_size", "target", rate.alias("rate"),
        hash_unit(F.col("mix_key"), F.lit("offset")).alias("offset"),
    )
    in_cell = Window.partitionBy(*keys).orderBy("size", "doc_id")
    joined = celled.withColumn("rank", F.row_number().over(in_cell)).join(plan, keys)
    place = F.col("start") + F.col("rank")
    crossed = F.floor(F.col("rate") * place + F.col("offset")) - F.floor(F.col("rate") * (place - 1) + F.col("offset"))
    copies = F.least(crossed, F.lit(MAX_REPEATS)).cast("long")
    return (
        joined.withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*keys, "start", "rate", "offset", "rank")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``, whatever their names.

    Null texts and texts without words are taken like others of their source, as their copies add no words. Rows that
    repeat an id are numbered in any order.
    """
    sized = hold(docs, ("doc_id", "source", "text")).select("doc_id", "source", word_count(F.col("text")).alias("size"), "held")
    taken = assign_copies(sized).where("copies > 0")
    repeats = taken.select("held", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("repeat"))
    return repeats.select(*release(docs.columns))
