"""Nodes of JSON documents, to any depth, in one pass."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Nodes that are handed on at once.
BATCH_NODES = 20_000


def nodes(text: str | None) -> Iterator[tuple[list[int], int, str, str | None, int]]:
    """(path, depth, tag, attrs_json, text_size) of a document's nodes in pre-order; none for what is no JSON."""
    try:
        root = json.loads(text or "", parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return
    todo = [((), "$", root)]
    while todo:
        path, tag, value = todo.pop()
        if isinstance(value, dict | list):
            keyed = isinstance(value, dict)
            yield list(path), len(path), tag, json.dumps({"keys": sorted(value)} if keyed else {"items": len(value)}), 0
            members = value.items() if keyed else ((f"[{i}]", x) for i, x in enumerate(value))
            todo += reversed([((*path, i), name, x) for i, (name, x) in enumerate(members)])
        else:
            yield list(path), len(path), tag, "{}", 0 if value is None else len(str(value))


def walk(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, path, depth, tag, attrs_json, text_size) of each node; the order of ``path`` is pre-order.

    The root is tagged ``$``, members by their key and elements ``[i]``. attrs_json has the sorted keys of an object
    and the number of elements of an array. text_size counts the characters of a scalar; containers and null have 0. Texts that are no JSON give no nodes.
    """
    names = ["path", "depth", "tag", "attrs_json", "text_size"]
    types = [pa.list_(pa.int64()), pa.int32(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(len(keys))):
                held: list[tuple] = []
                for node in nodes(text.as_py()):
                    held.append(node)
                    if len(held) == BATCH_NODES:
                        yield made(batch, i, held)
                        held = []
                if held:
                    yield made(batch, i, held)

    def made(batch: pa.RecordBatch, i: int, held: list[tuple]) -> pa.RecordBatch:
        own = [batch.column(k).take(pa.array([i] * len(held))) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True))], names=[*keys, *names])

    picked = rows.select(*keys, column)
    fields = [f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys]
    return picked.mapInArrow(run, ", ".join([*fields, "path array<bigint>, depth int, tag string, attrs_json string, text_size bigint"]))
