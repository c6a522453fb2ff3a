"""Connected components of a link table, by alternating star operations.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): every
round re-hangs each node's larger neighbours on its smallest one, then its
smaller ones, until all links point at the smallest node of their component. Links,
nodes and labels stay in DataFrames; each round is a table in the shared folder,
so a lost executor costs one round's part and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least_neighbour(links: DataFrame, by: str, other: str, name: str) -> DataFrame:
    return links.groupBy(F.col(by).alias(name)).agg(F.min(other).alias(f"{name}_least"))


def _large_star(links: DataFrame) -> DataFrame:
    """links (hi, lo): hang hi on the smallest neighbour of lo, or lo itself."""
    both = links.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(
        links.select(F.col("lo").alias("x"), F.col("hi").alias("y"))
    )
    least = _least_neighbour(both, "x", "y", "n")
    joined = links.join(least, links.lo == least.n)
    return joined.select("hi", F.least("lo", "n_least").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node, on the smallest of them."""
    least = _least_neighbour(links, "hi", "lo", "n")
    joined = links.join(least, links.hi == least.n)
    moved = joined.where("lo != n_least").select(F.col("lo").alias("hi"), F.col("n_least").alias("lo"))
    return moved.unionByName(least.select(F.col("n").alias("hi"), F.col("n_least").alias("lo")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Self-links and repeated links are allowed; no links give no rows.
    """
    oriented = links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    state = materialize(oriented.distinct(), "links")
    mark = _mark(state)
    settled = not mark[0]
    while not settled:  # every round but the last moves some link to a smaller node
        following = materialize(_small_star(_large_star(state).distinct()).distinct(), "links")
        after = _mark(following)
        discard(state)
        state, settled, mark = following, after == mark, after
    roots = state.select(F.col("lo").alias("node")).distinct()
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _mark(links: DataFrame) -> tuple:
    """Count and order-free checksum of a link table."""
    mixed = F.xxhash64("hi", "lo")
    return tuple(links.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first())
