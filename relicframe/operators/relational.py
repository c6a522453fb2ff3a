"""Relational operators composed of DataFrame calls.

As-of and interval joins, islands, null-safe anti join, sorted string
aggregation, ordered first/last picks, upsert and entity-attribute-value statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, take: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with the latest right row at or before it (strict: before it), or nulls.

    ``by`` and ``at`` name columns of both sides; ``take`` those of the right to bring, of
    which ties at one time give the largest. One shuffle by ``by``, no join: both sides are sorted
    together and the last right row is carried forward, so no pairs arise.
    """
    picked = F.struct(*take)
    right_rows = right.select(*by, F.col(at), F.lit(0 if not strict else 1).alias("_side"), picked.alias("_right"), F.lit(None).alias("_left"))
    payload = F.struct(*[c for c in left.columns])
    left_rows = left.select(*by, F.col(at), F.lit(1 if not strict else 0).alias("_side"), F.lit(None).alias("_right"), payload.alias("_left"))
    both = left_rows.unionByName(right_rows)
    order = Window.partitionBy(*by).orderBy(F.col(at), "_side", F.col("_right").asc_nulls_first())
    carried = F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_found", carried).where("_left IS NOT NULL").select("_left.*", *[F.col("_found")[c].alias(c) for c in take])


#: Narrow rows that one side of a join may have to be sent to every task.
MOST_BROADCAST = 500_000


def sent_if_small(rows: DataFrame) -> DataFrame:
    """``rows``, a narrow side of a join, marked to be sent to every task if a count finds few; so few keys do not put the other side into few tasks."""
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rows


def interval_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Points with every span [start, end) that holds them (inner).

    Spans are filed under each cell of ``width`` that they touch and points under their own, so
    the join is by equality; the exact bounds are checked after. Choose
    ``width`` near the usual span length.
    """
    cell = F.floor(F.col(point) / width)
    cells = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    filed = spans.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(cells))
    joined = points.withColumn("_cell", cell).join(filed, [*by, "_cell"])
    return joined.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_cell")


def inside_any(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int, by: Sequence[str], flag: str) -> DataFrame:
    """``points`` plus whether any span holds them; ``points`` need distinct (by, point) no more than rows do."""
    keys = points.select(*by, point).distinct()
    hits = interval_join(keys, spans.select(*by, start, end), point, start, end, width, by).select(*by, point).distinct()
    return points.join(hits.withColumn(flag, F.lit(True)), [*by, point], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def islands(rows: DataFrame, by: Sequence[str], start: str, end: str, gap: int | Column, name: str = "island") -> DataFrame:
    """``rows`` plus an island number: a new one begins more than ``gap`` after all earlier ends."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col(start) > reached + gap), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def anti_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows whose keys no right row has, where null equals null."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
    test = None
    for k in keys:
        same = left[k].eqNullSafe(other[f"_r_{k}"])
        test = same if test is None else test & same
    return left.join(other, test, "left_anti")


def sorted_list(column: str | Column, separator: str = ",") -> Column:
    """Distinct non-null values in ascending order, joined: deterministic where GROUP_CONCAT is not."""
    return F.array_join(F.sort_array(F.collect_set(column)), separator)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key in the given order."""
    backwards = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*backwards)))
    return ranked.where("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``base`` with rows of ``changes`` put in or over; of several for a key, the last in ``order``."""
    every = base.withColumn("_late", F.lit(0)).unionByName(changes.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return latest(every, keys, ["_late", order]).drop("_late")


def two_step_lookup(left: DataFrame, right: DataFrame, full: Sequence[str], part: Sequence[str], value: str, order: str) -> DataFrame:
    """``left`` plus ``value`` of the last right row that matches on ``full`` keys, else on ``part`` keys."""

    def last_by(keys: Sequence[str], name: str) -> DataFrame:
        return right.groupBy(*keys).agg(F.max_by(value, order).alias(name))

    joined = left.join(last_by(full, "_full"), list(full), "left").join(last_by(part, "_part"), list(part), "left")
    return joined.withColumn(value, F.coalesce("_full", "_part")).drop("_full", "_part")


def unpivot(rows: DataFrame, keys: Sequence[str], metrics: dict[str, Column], detail: str = "") -> DataFrame:
    """(keys, metric, detail, value): one grouped pass for all metrics, then one row for each."""
    wide = rows.groupBy(*keys).agg(*[c.cast("long").alias(m) for m, c in metrics.items()])
    long = wide.unpivot(list(keys), list(metrics), "metric", "value")
    return long.withColumn("detail", F.lit(detail)).select(*keys, "metric", "detail", "value")


def grouped_counts(rows: DataFrame, keys: Sequence[str], metric: str, detail: Column) -> DataFrame:
    """(keys, metric, detail, value) with a row for each value of ``detail``; null and '' stay apart, both shown as ''."""
    counted = rows.groupBy(*keys, detail.alias("_detail")).agg(F.count("*").alias("value"))
    return counted.select(*keys, F.lit(metric).alias("metric"), F.coalesce("_detail", F.lit("")).alias("detail"), "value")


def capped(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group in a total order (a top-k report)."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_n") <= limit).drop("_n")


SEPARATOR = r"[^\p{L}\p{N}]+"


#: Needles (or short ones) up to which they are broadcast, after a count.
BROADCAST_NEEDLES = 100_000
GRAM = 3


def contains_join(lines: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """Lines with every needle that they contain.

    A word inside a needle, with separators on both sides, is a whole word of any
    line that contains the needle. So needles are filed under their longest inner word and
    lines under their distinct words, an equality join, and the whole needle is
    checked only there. Needles without an inner word are filed under their first
    GRAM characters in the same way, and those shorter than that under themselves, lines then under all their runs of so few
    characters. Kinds of needles that do not occur cost nothing. Few needles are broadcast to the lines; for many, hashes of
    the lines are joined first and the texts of the hits after.
    """
    words = F.split(F.col(needle), SEPARATOR)
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    kind = F.when(longest.isNotNull(), "word").when(F.length(needle) >= GRAM, "gram").otherwise("short")
    filed = needles.withColumns({"_kind": kind, "_key": F.coalesce(longest, F.left(needle, F.lit(GRAM)))})
    counts = {r["_kind"]: r["n"] for r in filed.groupBy("_kind").agg(F.count("*").alias("n")).collect()}

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n)))

    short = F.concat(F.array(F.lit("")), *[grams(n) for n in range(1, GRAM)])
    keys = {"word": F.split(F.col(text), SEPARATOR), "gram": grams(GRAM), "short": short}
    hit = F.contains(F.col(text), F.col(needle))
    found = lines.join(needles.where("false"), hit) if not counts else None
    for name, n in sorted(counts.items()):
        own = filed.where(F.col("_kind") == name).drop("_kind")
        if n <= BROADCAST_NEEDLES:
            part = lines.withColumn("_key", F.explode(F.array_distinct(keys[name]))).join(F.broadcast(own), "_key").where(hit).drop("_key")
        else:
            marks = {"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), F.col(text))}
            narrow = lines.select(*[x.alias(k) for k, x in marks.items()], F.explode(F.array_distinct(keys[name])).alias("_key")).distinct()
            near = narrow.join(own, "_key").drop("_key")
            part = lines.withColumns(marks).join(near, list(marks)).where(hit).drop(*marks)
        found = part if found is None else found.unionByName(part)
    return found
