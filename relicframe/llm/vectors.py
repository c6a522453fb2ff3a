"""Near-duplicate vectors through a forest of random-projection trees.

Dasgupta and Freund, "Random projection trees" (2008), with spill: a level of a tree
draws a random direction, each node splits at the median of its sample, and vectors near
the split go to both sides. The trees are fitted on a bounded sample; every
vector is routed through all of them and compared within its leaves, exactly, in double
precision. Leaves that stay large, as those of one dense cluster do, are compared in
tiles (see tiles.py).

Depth and number of trees come from the count of vectors: leaves keep their size, and
there are so many trees that a pair just at the threshold shares a leaf in one of them with
probability RECALL. With little spill a vector has about as many copies as there are trees, which
grow with about the fifth root of the count. Trees are taken a few at a time, so
that the exchange of one step stays a small multiple of the input.

A pair may share several leaves. It is counted in the first one only: whoever holds two vectors and the
trees can route them again, and a bitset per row tells whether two rows met in an earlier leaf. So links are
counted where they are found and never emitted as pairs; what leaves a leaf is a
count for each vector and a spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, smallest_hashes
from .components import components
from .tiles import dealt, runs, tile

COSINE = 0.9
#: Part of the pairs at just the threshold that the forest is sized to find.
RECALL = 0.95
#: Vectors of a width that its trees are fitted on, at most, those of the smallest hashes.
SAMPLE_VECTORS = 20_000
#: Vectors a leaf.
LEAF = 512
TILE_ROWS = 1024
#: Half the overlap of two sides, in units of a typical projected distance of a linked pair.
SPILL = 0.1
#: Copies of the vectors that one step exchanges at most, unless a single tree has more.
STEP_COPIES = 2.6
#: Directions that a node tries, beyond its level's own, before it is left as one dense leaf.
RETRIES = 3
#: Rows of one task that compares leaves, about.
TASK_ROWS = 100_000
#: Sample vectors by which the copies of a tree are measured.
MEASURED = 2_000
#: Sample points that a node needs to be split at its own median.
LEAST_FIT = 16
NODE_BITS, PATH_BITS = 20, 30


@dataclass
class Tree:
    """Nodes as arrays: split point (nan: a leaf), children and the direction (``start``) that parts them.

    Where the sample runs out, a leaf is split ``deeper`` levels from direction ``start`` on, at the medians of the whole sample.
    """

    directions: np.ndarray
    medians: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    deeper: np.ndarray
    start: np.ndarray

    def route(self, unit: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that each row belongs to."""
        place = unit @ self.directions.T
        rows, nodes = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while rows.size:
            at = self.split[nodes]
            leaf = np.isnan(at)
            done.append((rows[leaf], nodes[leaf]))
            rows, nodes, at = rows[~leaf], nodes[~leaf], at[~leaf]
            if rows.size:
                here = place[rows, self.start[nodes]]
                low, high = here <= at + spill, here > at - spill
                nodes = np.concatenate([self.left[nodes[low]], self.right[nodes[high]]])
                rows = np.concatenate([rows[low], rows[high]])
        rows, codes = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        more = self.deeper[codes]
        for step in range(int(more.max(initial=0))):
            open_ = more > step
            node = codes[open_] & (1 << NODE_BITS) - 1
            level_of = self.start[node] + step
            here, at = place[rows[open_], level_of], self.medians[level_of]
            low, high = here <= at + spill, here > at - spill
            path = codes[open_] + (1 << NODE_BITS + step)
            codes = np.concatenate([codes[~open_], codes[open_][low], path[high]])
            more = np.concatenate([more[~open_], more[open_][low], more[open_][high]])
            rows = np.concatenate([rows[~open_], rows[open_][low], rows[open_][high]])
        return rows, codes


def grow(sample: np.ndarray, population: int, levels: int, spill: float, seed: int) -> Tree:
    """A tree whose leaves hold about LEAF vectors of the population that the sample stands for."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(levels, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    place = sample @ directions.T
    scale = population / len(sample)
    split, left, right, deeper, start = [], [], [], [], []
    todo = [(np.arange(len(sample)), 0)]
    at = 0
    while at < len(todo):
        own, level = todo[at]
        at += 1
        for column, value in ((split, np.nan), (left, -1), (right, -1), (deeper, 0), (start, level)):
            column.append(value)
        size = len(own) * scale
        if size <= LEAF or level >= levels:
            continue
        if len(own) < LEAST_FIT:
            deeper[-1] = min(math.ceil(math.log2(size / LEAF)), levels - level, PATH_BITS)
            continue
        for axis in range(level, min(level + 1 + RETRIES, levels)):
            middle = float(np.median(place[own, axis]))
            low, high = own[place[own, axis] <= middle + spill], own[place[own, axis] > middle - spill]
            if max(len(low), len(high)) <= 0.9 * len(own):
                split[-1], left[-1], right[-1], start[-1] = middle, len(todo), len(todo) + 1, axis
                todo += [(low, axis + 1), (high, axis + 1)]
                break
        # else no direction parts them: one dense cluster, which tiles take from here
    numbers = (np.array(x, np.int64) for x in (left, right, deeper, start))
    return Tree(directions, np.median(place, axis=0), np.array(split, float), *numbers)


@dataclass
class Forest:
    """The trees for vectors of one width, numbered from ``first`` on."""

    first: int
    spill: float
    trees: list[Tree]
    copies: list[float]

    def steps(self) -> list[range]:
        """The numbers of trees to be routed together: as many as have no more than STEP_COPIES copies a vector, one at least."""
        out, begun, held = [], 0, 0.0
        for i, n in enumerate(self.copies):
            if i > begun and held + n > STEP_COPIES:
                out.append(range(self.first + begun, self.first + i))
                begun, held = i, 0.0
            held += n
        return [*out, range(self.first + begun, self.first + len(self.copies))]


def plan_forest(sample: np.ndarray, population: int, cosine: float, first: int) -> Forest:
    """Trees of the depth and number that the population and the spread of the sample ask for.

    A level parts a pair whose projected difference is normal with ``spread`` (in units of the
    projections' own deviation) with probability ``parted`` and copies a vector with probability ``copied``.
    """
    width = sample.shape[1]
    apart = math.sqrt(max(2 - 2 * cosine, 1e-12) / width)
    deviation = max(float(sample.std(axis=0).mean()) if len(sample) > 1 else 0.0, apart / 4)
    x = 2 * SPILL
    above = math.exp(-x * x / 2) / math.sqrt(2 * math.pi) - x * math.erfc(x / math.sqrt(2)) / 2
    density = 2 / math.sqrt(2 * math.pi) * apart / deviation
    parted, copied = min(density * above, 0.5), min(density * SPILL, 0.5)
    depth = max(0.0, math.log2(population / LEAF)) * math.log(2) / math.log(2 / (1 + copied))
    together = (1 - parted) ** math.ceil(depth)
    count = 1 if depth == 0 else math.ceil(math.log(1 - RECALL) / math.log1p(-min(together, 0.999)))
    levels = math.ceil(1.5 * depth) + 2
    spill = SPILL * apart
    trees = [grow(sample, population, levels, spill, seed) for seed in range(count)]
    few = sample[:MEASURED]
    return Forest(first, spill, trees, [len(t.route(few, spill)[0]) / max(len(few), 1) for t in trees])


def is_usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Vectors:
    """A list column whose slices come out as matrices of unit vectors; the lists of a slice have one length."""

    def __init__(self, column: pa.ChunkedArray | pa.Array) -> None:
        self.lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    def __getitem__(self, at: slice) -> np.ndarray:
        part = self.lists[at]
        return _unit(part.flatten().to_numpy().reshape(len(part), -1))


def met_before(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """A bitset for each of n rows of the leaves (row, code) that more than one of them is in."""
    _, place, count = np.unique(codes, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = (count > 1)[place]
    place, rows = number[place[shared]], rows[shared]
    bits = np.zeros((n, max(1, -(-int((count > 1).sum()) // 64))), np.uint64)
    np.bitwise_or.at(bits, (rows, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return bits


def earlier_leaves(unit: np.ndarray, forest: Forest, run_key: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, run key) of all leaves of the vectors whose run key is smaller."""
    last = (run_key >> NODE_BITS + PATH_BITS) - forest.first
    found = [filed_under(unit, forest, t) for t in range(last + 1)]
    rows, keys = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    return rows[keys < run_key], keys[keys < run_key]


def filed_under(unit: np.ndarray, forest: Forest, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, run key) for every leaf of a tree that each row belongs to."""
    rows, leaves = forest.trees[tree].route(unit, forest.spill)
    return rows, leaves + (forest.first + tree << NODE_BITS + PATH_BITS)


def compare(group: dict, across: bool, cosine: float, forests: dict[int, Forest]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links newly found a row, counting multiplicities; spanning stars of all links) of a run."""
    unit, many, own = group["vector"], group["many"], group["own"]
    n = len(unit)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    bits: np.ndarray | None = None
    degree = np.zeros(n, np.int64)
    touched = np.zeros(n, bool)
    for at in range(0, n, 256):
        near = unit[at : at + 256] @ unit.T >= cosine
        near &= np.arange(n)[None, :] > np.arange(at, min(at + 256, n))[:, None]
        if across:
            near &= own[None, :] != own[at : at + 256, None]
        a, b = np.nonzero(near)
        if a.size and bits is None:
            bits = met_before(*earlier_leaves(unit, forests[unit.shape[1]], int(group["run_key"][0])), n)
        a += at
        touched[a] = touched[b] = True
        for s in range(0, len(a), 100_000):
            i, j = a[s : s + 100_000], b[s : s + 100_000]
            fresh = ~(bits[i] & bits[j]).any(axis=1)
            pairs.append((i[fresh], j[fresh]))
            for x, y in (pairs[-1], pairs[-1][::-1]):
                degree += np.bincount(x, many[y], n).astype(np.int64)
            pairs.clear()
    stars: list[tuple[int, int]] = []
    rest = np.flatnonzero(touched)
    while rest.size > 1:
        first, rest = rest[0], rest[1:]
        frontier = [first]
        while frontier and rest.size:
            x = frontier.pop()
            near = unit[rest] @ unit[x] >= cosine
            if across:
                near &= own[rest] != own[x]
            found = rest[near]
            rest = rest[~near]
            stars += [(first, y) for y in found]
            frontier += list(found)
    return degree, stars


def filed(classes: DataFrame, shared, trees: range) -> DataFrame:
    """A row of (run_key, cid, many, vector) for each leaf in the trees of these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).value_lengths().to_numpy()
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                forest = shared.value[int(width)]
                here = [t - forest.first for t in trees if 0 <= t - forest.first < len(forest.trees)]
                if not here:
                    continue
                unit = Vectors(batch.column(2).take(pa.array(at)))[:]
                found = [filed_under(unit, forest, t) for t in here]
                take = pa.array(at[np.concatenate([r for r, _ in found])])
                key = pa.array(np.concatenate([k for _, k in found]))
                yield pa.RecordBatch.from_arrays([key, *(batch.column(i).take(take) for i in range(3))], names=["run_key", "cid", "many", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("cid", "many", "vector").mapInArrow(run, f"run_key long, cid long, many long, vector {kind}")


def compared(rows: DataFrame, cosine: float, shared, count: float) -> DataFrame:
    """Of about ``count`` rows, (a, b, n): n new links of class a (b null), or a link of the spanning forest (n null)."""

    def columns(table: pa.Table) -> dict:
        return {c: table.column(c).to_numpy() for c in ("run_key", "own", "cid", "many")} | {"vector": Vectors(table.column("vector"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, across in runs(batches, columns):
            degree, stars = compare(group, across, cosine, shared.value)
            some = np.flatnonzero(degree)
            pairs = group["cid"][np.array(stars, np.int64).reshape(-1, 2)]
            a = pa.array(np.concatenate([group["cid"][some], pairs[:, 0]]))
            b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(pairs[:, 1])])
            n = pa.concat_arrays([pa.array(degree[some]), pa.nulls(len(stars), pa.int64())])
            if len(a):
                yield pa.RecordBatch.from_arrays([a, b, n], names=["a", "b", "n"])

    return dealt(tile(rows, "cid", TILE_ROWS), math.ceil(count / TASK_ROWS)).mapInArrow(run, "a long, b long, n long")


def forests_of(classes: DataFrame, cosine: float) -> dict[int, Forest]:
    """width -> forest, each fitted on at most SAMPLE_VECTORS vectors of that width."""
    forests: dict[int, Forest] = {}
    first = 0
    for row in classes.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect():
        taken = smallest_hashes(classes.where(F.size("vector") == row["width"]).select("vector"), ["vector"], SAMPLE_VECTORS).toArrow()
        forests[row["width"]] = plan_forest(Vectors(taken.column("vector"))[:], row["n"], cosine, first)
        first += len(forests[row["width"]].trees)
    return forests


def near_vectors(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) a row.

    Equal vectors are one class, found by grouping; each of its rows links to all others of
    it. Null, zero, and vectors with null or non-finite components link with
    nothing; vectors of different lengths do not link. A row
    that links with nothing is its own component. Null ids count as links, but are a
    component's id only if all its ids are null. Repeated rows come out as often as they went in, other
    columns of any name are not read, and an empty table gives no rows.
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    # two hashes stand for a vector where rows are joined with their class
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector"), "usable": is_usable(F.col("vector"))})
    usable, other = rows.where("usable"), rows.where("NOT usable")
    grouped = usable.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("many"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    alone = other.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    forests = forests_of(classes, cosine)
    if not forests:
        return _with_kept(alone, id_col)
    shared = table.sparkSession.sparkContext.broadcast(forests)  # at most about SAMPLE_VECTORS nodes a tree
    n = classes.count()
    tables = []
    for forest in forests.values():
        for trees in forest.steps():
            copies = sum(forest.copies[t - forest.first] for t in trees)
            tables.append(materialize(compared(filed(classes, shared, trees), cosine, shared, n * copies), "vector-links"))
    found = reduce(DataFrame.unionByName, tables)
    degrees = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    rooted = materialize(components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cid"), "vector-roots")
    narrow = classes.select("cid", "least", "many", "h1", "h2")
    least = narrow.join(rooted, "cid").groupBy("root").agg(F.min("least").alias("component"))
    told = (
        narrow.join(degrees, "cid", "left").join(rooted, "cid", "left").join(least, "root", "left").where("many > 1 OR root IS NOT NULL")
        .select(
            "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
            F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"),
        )
    )
    # only rows of classes that link are joined; the others are a class of their own
    linked = materialize(told, "linked-vectors")
    joined = usable.select("id", "h1", "h2").join(small_side(linked, linked.count()), ["h1", "h2"], "left")
    of_rows = joined.select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return _with_kept(of_rows.unionByName(alone), id_col)


def _with_kept(rows: DataFrame, id_col: str) -> DataFrame:
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return rows.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
