"""Comparison inside groups of any size, without one task taking a whole group.

Rows are grouped by a key. A group above ``cap`` rows is dealt into tiles, and each
pair of tiles is a task-sized group of its own, so any two rows of a
group still meet exactly once. Consumers stream over sorted runs and hold one run
(at most ``2 * cap`` rows, give or take the hash's unevenness) at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

RUN = ["run_key", "tile_a", "tile_b"]


def tile(rows: DataFrame, member: str, cap: int) -> DataFrame:
    """``rows`` (with a long ``run_key``) plus tile_a, tile_b and the row's own tile.

    Within tile_a = tile_b all rows of the run are to be compared; otherwise
    only rows of different own tiles.
    """
    sizes = rows.groupBy("run_key").agg(F.count("*").alias("n")).where(F.col("n") > cap)
    hot = materialize(sizes.select("run_key", F.ceil(F.col("n") / cap).cast("int").alias("tiles")), "hot-groups")
    n = hot.count()
    if not n:
        zero = F.lit(0)
        return rows.withColumns({"tile_a": zero, "tile_b": zero, "own": zero})
    own = F.pmod(F.xxhash64(F.col(member), F.lit(11)), F.col("tiles")).cast("int")
    spread = (
        rows.join(small_side(hot, n), "run_key", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    )
    return spread.withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other")}).drop("tiles", "other")


def dealt(tiled: DataFrame, tasks: int = 0) -> DataFrame:
    """Each run in one partition, sorted. There are ``tasks`` partitions, which follow the rows, or as many as the session's exchanges have, if those are more."""
    parts = max(tasks, int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tiled.repartition(parts, *RUN).sortWithinPartitions(*RUN)


def runs(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.Table], dict]) -> Iterator[tuple[dict, bool]]:
    """(columns of a run, whether to compare across own tiles only) for runs of two rows or more."""
    carry: pa.Table | None = None

    def split(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], int]:
        keys = np.stack([table.column(c).to_numpy() for c in RUN])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        starts = np.concatenate([[0], edges])
        ends = np.concatenate([edges, [table.num_rows]])
        keep = len(starts) if last else len(starts) - 1
        long = np.flatnonzero(ends[:keep] - starts[:keep] > 1)
        return list(zip(starts[long], ends[long], strict=True)), int(starts[-1])

    def emit(table: pa.Table, last: bool) -> Iterator[tuple[dict, bool]]:
        spans, _ = split(table, last)
        if spans:
            whole = columns(table)
            a, b = table.column("tile_a").to_numpy(), table.column("tile_b").to_numpy()
            for s, e in spans:
                yield {k: v[s:e] for k, v in whole.items()}, bool(a[s] != b[s])

    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = pa.Table.from_batches([batch])
        table = pa.concat_tables([carry, fresh]) if carry is not None else fresh
        yield from emit(table, False)
        carry = table.slice(split(table, False)[1])
    if carry is not None:
        yield from emit(carry, True)
