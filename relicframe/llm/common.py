"""Helpers that several training-data operators share.

Scratch tables go to the shared folder that the cluster names in
``spark.checkpoint.dir``; each holds a cut of the lineage that survives the
loss of an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, scratch_path, write_once

#: A word is a longest run without ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Rows (of a few fixed-width columns) up to which a side may be broadcast.
BROADCAST_ROWS = 500_000

#: Arrow batches stay below this many rows, as single texts can be megabytes.
BATCH_ROWS = 500


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    write_once(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nobody reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        delete(df.sparkSession, path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a broadcast side if its counted rows are few, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def smallest_hashes(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The ``limit`` rows of the smallest hashes of ``columns``: a sample that any rerun repeats.

    The columns tell the rows apart: repeated rows would share a hash and fall on one side of the bound.
    Rows of large hashes are left out by a bound before the sort, so it takes about
    ``2 * limit`` rows however many there are.
    """
    n = df.count()
    mixed = F.xxhash64(*columns)
    if n > 4 * limit:
        df = df.where(mixed < -(1 << 63) + (1 << 64) * 2 * limit // n)
    return df.orderBy(mixed, *columns).limit(limit)


def exact_columns(df: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` alone, whatever else the table holds: names that differ in case only, or hold dots, do not matter."""
    return hold(df, names).drop("held")


def _picked(columns: list[str], names) -> dict[str, int]:
    """Place of each of ``names``: the column of just this name, or else one that differs in case."""
    at = {}
    for name in names:
        alike = [i for i, c in enumerate(columns) if c.lower() == name.lower()]
        if not alike:
            raise ValueError(f"no column {name}")
        at[name] = next((i for i in alike if columns[i] == name), alike[0])
    return at


def _through(columns: list[str], replaced, apart) -> list[int]:
    out, own = {r.lower() for r in replaced}, set(_picked(columns, apart).values())
    return [i for i, c in enumerate(columns) if c.lower() not in out and i not in own]


def hold(df: DataFrame, names, replaced=(), apart: bool = False) -> DataFrame:
    """The columns ``names`` of ``df``, and all others but those ``replaced`` in one struct ``held``, which release() takes apart.

    Names in the struct are numbers, so no name of the input can clash with what an operator adds. ``replaced``
    are left out in any case. The columns ``names`` are in the struct too, unless they are to be held ``apart``.
    """
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    through = [f"c{i}" for i in _through(df.columns, replaced, names if apart else ())]
    held = F.struct(*through) if through else F.lit(True)
    return numbered.select(held.alias("held"), *[F.col(f"c{i}").alias(name) for name, i in _picked(df.columns, names).items()])


def release(columns: list[str], replaced=(), apart=()) -> list[Column]:
    """The columns that hold() got, in their order and under their names in ``columns``; those held ``apart`` come from their own columns."""
    own = {i: name for name, i in _picked(columns, apart).items()}
    through = _through(columns, replaced, apart)
    gone = {r.lower() for r in replaced}
    every = [i for i, c in enumerate(columns) if i in through or i in own and c.lower() not in gone]
    return [(F.col(own[i]) if i in own else F.col("held")[f"c{i}"]).alias(columns[i]) for i in every]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, inside one expression."""
    return F.transform(F.array(value), body)[0]


def id_crc(column: str) -> Column:
    """CRC-32 of an id's decimal text."""
    return F.crc32(F.encode(F.col(column).cast("string"), "utf-8"))


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches for operators that take whole texts into Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
