"""Filter interaction audit: what each filter removes, in every order of the filters.

A document is reduced to a mask of the filters that it fails. Documents of one
part and mask are one cell with counts, and each cell is folded, by higher-order functions,
across a constant array of all orders: a fold along an order tells at which step
the cell goes and which filters it would have failed later. So a
cell makes orders x filters weighted structs, and the cells of a part are merged
by sums, element by element. The work after the cells depends on parts and masks only.

Whether a text repeats that of a smaller doc_id is decided by a join on (digest, doc_id)
with the smallest id of each digest: no group of copies meets in one task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact_columns, let, materialize, words_of

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = r"[#$%&*|]"
COPY = 1 << FILTERS.index("E")

MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""

    def of(x: Column) -> Column:
        words, t = x["words"], x["text"]
        n = F.size(words)
        capitals = F.regexp_count(t, F.lit("[A-Z]"))
        fails = (
            n < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
            100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(t).cast("long"),
            F.regexp_like(t, F.lit(SYMBOLS)),
        )
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))

    return let(F.struct(words_of(text).alias("words"), F.coalesce(text, F.lit("")).alias("text")), of)


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents by part and failed filters."""
    rows = materialize(
        exact_columns(docs, "doc_id", "text", "lang").select(
            "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
        ),
        "filter-masks",
    )
    marks = (
        exact_columns(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    # rows of one id, part and text are counted before they meet labels or other copies, so that no key is hot; null ids are never copies nor labelled
    told = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    marked = told.join(marks, "doc_id", "left").join(firsts, ["doc_id", "digest"], "left")
    no = F.lit(False)
    cells = marked.select(
        "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(COPY)).alias("mask"), "n",
        F.when(F.coalesce("good", no), F.col("n")).otherwise(0).alias("good"), F.when(F.coalesce("toxic", no), F.col("n")).otherwise(0).alias("toxic"),
    )
    nameless = rows.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return cells.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def order_steps(orders: Column) -> Column:
    """For one cell: a struct of weights for each order and step, in a row.

    Along an order the fold carries whether the cell has gone, and the structs so far.
    """
    none = F.lit(0).cast("long")
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])

    def along(order: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            letter = F.substring(order, i, F.lit(1))
            bit = F.get(bits, F.instr(F.lit(FILTERS), letter) - 1)
            fails, gone = F.col("mask").bitwiseAND(bit) != 0, acc["gone"]
            removed = fails & ~gone

            def weight(condition: Column, by: str) -> Column:
                return F.when(condition, F.col(by)).otherwise(none)

            struct = F.struct(
                order.alias("filter_order"), i.alias("step"), letter.alias("letter"),
                weight(~gone & ~fails, "n").alias("kept"), weight(removed, "n").alias("removed"), weight(fails & gone, "n").alias("redundant"),
                weight(F.col("mask") == bit, "n").alias("unique_fails"), weight(removed, "good").alias("good_lost"), weight(removed, "toxic").alias("toxic_lost"),
            )
            return F.struct((gone | fails).alias("gone"), F.concat(acc["steps"], F.array(struct)).alias("steps"))

        nothing = F.struct(F.lit(False).alias("gone"), F.from_json(F.lit("[]"), _STEPS).alias("steps"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), nothing, step, lambda acc: acc["steps"])

    return F.flatten(F.transform(orders, along))


_STEPS = f"array<struct<filter_order:string,step:int,letter:string,{','.join(f'{m}:bigint' for m in MEASURES)}>>"


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct(x["filter_order"].alias("filter_order"), x["step"].alias("step"), x["letter"].alias("letter"), *[(x[m] + y[m]).alias(m) for m in MEASURES])
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row a part, order of the filters and step, zeros included. A part is a value of ``lang``,
    null and the empty text being one part. A null text counts as empty, and long texts count whole. A null
    doc_id copies nothing and has no label; rows that repeat an id are documents of their own, none a
    copy of the other. A label of several rows counts if any has it; labels of other ids are not read. Columns of other names are not read; without documents there are no rows.
    """
    orders = F.split(F.lit(" ".join("".join(o) for o in permutations(FILTERS))), " ")
    folded = mask_cells(docs, labels).select("part", order_steps(orders).alias("steps"))
    # at most 32 cells a part meet here
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select(
        "part", F.aggregate(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), F.get("cells", F.lit(0)), _added).alias("steps")
    )
    shapley = F.transform(
        F.split(F.lit(" ".join(FILTERS)), " "),
        lambda f: F.aggregate("steps", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["letter"] == f, x["removed"]).otherwise(0)),
    )
    rows = merged.select("part", shapley.alias("by_filter"), F.explode("steps").alias("x"))
    return rows.select("part", "x.filter_order", "x.step", *[f"x.{m}" for m in MEASURES], F.get("by_filter", F.instr(F.lit(FILTERS), F.col("x.letter")) - 1).alias("shapley"))
