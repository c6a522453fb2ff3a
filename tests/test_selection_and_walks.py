"""Rows that an order leaves open, and forks, layers and maps whose bytes are read and made many rows at a time."""

import duckdb
import numpy as np
import pyarrow as pa

from relicframe.functions import batches
from relicframe.plans import archive_queries, records, report_queries, reports, rom

SF = "/root/testdata/sf0.001"


def test_selection_keeps_the_same_rows_and_puts_nulls_last(spark):
    stacks = spark.createDataFrame([(10, "r1", "s", "i"), (20, "r1", None, "i")], "id long, run_id string, stack_name string, import_input string")
    files = spark.createDataFrame([(10, "m/1", "image", "bmap", 7, "h"), (20, "m/0", "image", "bmap", 1, "h")], "stack_id long, rel_path string, embedded_kind string, logical_kind string, logical_id long, sha256 string")
    files = files.selectExpr("stack_id + 1 AS id", "'r1' AS run_id", "stack_id", "stack_id + 1 AS output_file_id", "rel_path", "embedded_kind", "logical_kind", "logical_id", "sha256")
    for paths in (["p/2", "p/1", "p/3"], ["p/3", "p/2", "p/1"]):
        outputs = spark.createDataFrame([(11, p) for p in paths], "id long, path string").coalesce(1)
        found = reports.embedded_selection(reports.Warehouse(spark, tables={"stacks": stacks, "embedded_files": files, "output_files": outputs}), "r1", ["image"], 2)
        assert [(r.stack_name, r.source_path) for r in found.collect()] == [("s", "p/1"), ("s", "p/2")]


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def against_sql(spark, name, rows_of_batch):
    connection = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_batch)
    try:
        found, want = report_queries.QUERIES[name](spark, SF), connection.sql(report_queries.ORACLES[name])
        order = lambda columns: sorted(range(len(columns)), key=columns.__getitem__)
        shown = lambda rows, columns: sorted(tuple(str(r[i]) for i in order(columns)) for r in rows)
        assert shown(found.collect(), found.columns) == shown(want.fetchall(), want.columns)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_groups_stay_whole_across_batches():
    keys = [None, None, 1, 1, 1, 1, 1, 2, 3, 3, 4]
    for size in (1, 2, 3, 11):
        cut = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": list(range(11))})
        found = list(batches.whole_groups((cut.slice(i, size) for i in range(0, 11, size)), "key"))
        assert [n for b in found for n in b.column("n").to_pylist()] == list(range(11))
        held = [k for b in found for k in set(b.column("key").to_pylist())]
        assert len(held) == len(set(held))


def test_bytes_of_columns():
    column = pa.array([b"zz", b"\xff\xfe", None, b"", b"\0\1\2"], pa.binary())[1:]
    data, starts, sizes = batches.octets(column)
    zero = np.zeros(4, np.int64)
    assert sizes.tolist() == [2, 0, 0, 3]
    assert batches.signed(data, starts, sizes, zero, 2).tolist() == [-2, 0, 0, 1] and batches.unsigned(data, starts, sizes, zero + 1, 2).tolist() == [0, 0, 0, 258]
    assert batches.stretches(data, starts, sizes).to_pylist() == [b"\xff\xfe", b"", b"", b"\0\1\2"]
    assert list(batches.cuts(np.array([5, 1, 1, 9, 1]), 6)) == [slice(0, 2), slice(2, 3), slice(3, 4), slice(4, 5)]


def layer(kind, parts, contents, body):
    count = lambda n: n.to_bytes(2, "big")
    return bytes(24) + ((3).to_bytes(4, "big") if kind == "CARD" else b"") + count(parts) + bytes(6) + count(contents) + bytes(4) + body


def part(number, kind, name, script):
    body = number.to_bytes(2, "big") + bytes([kind]) + bytes(25) + name + b"\0\0" + script + b"\0"
    return (len(body) + 2 + len(body) % 2).to_bytes(2, "big") + body + bytes(len(body) % 2)


def test_parts_are_walked_many_layers_at_once(spark):
    many = b"".join(part(i % 9, 1, b"n", b"s\x8a") for i in range(5000))
    payloads = [
        ("CARD", 1, layer("CARD", 5000, 0, many)), ("BKGD", 2, layer("BKGD", 3, 0, part(7, 2, b"ab", b"") + part(8, 1, b"", b"t"))),
        ("CARD", 3, layer("CARD", 2, 0, part(1, 1, b"x", b"y") + b"\0\x40" + bytes(9))), ("CARD", 4, b"\0\1"), ("CARD", 5, None), ("STAK", 6, layer("CARD", 1, 0, part(1, 1, b"x", b"y"))),
    ]
    blocks = spark.createDataFrame([("f", k, i, p and bytearray(p)) for k, i, p in payloads], "file string, type string, id int, payload binary")
    found = records.parts(blocks, spark.createDataFrame([], "file string, font_id long, name string"))
    assert "aggregate(" not in plan(found)
    rows = sorted((r.layer_id, r.n, r.part_id, r.part_type, r.name, r.script) for r in found.collect())
    assert rows == [(1, i, i % 9, "button", "n", "sä") for i in range(5000)] + [(2, 0, 7, "field", "ab", ""), (2, 1, 8, "button", "", "t"), (3, 0, 1, "button", "x", "y")]


def test_layers_are_made_without_listing_aggregates(spark):
    assert "listagg" not in plan(archive_queries._layer_blocks(spark, SF))
    against_sql(spark, "a11_parts", 5)


def content(number, text, styles=b""):
    data = (styles and (32768 + 2 + len(styles)).to_bytes(2, "big") + styles) + text
    return (number % 65536).to_bytes(2, "big") + len(data).to_bytes(2, "big") + data + bytes(len(data) % 2)


def test_contents_are_walked_many_layers_at_once(spark):
    many = b"".join(content(-1 - i % 9, b"\0t") for i in range(5000))
    payloads = [
        ("BKGD", 3, layer("BKGD", 1, 0, part(4, 1, b"b", b""))), ("CARD", 1, layer("CARD", 0, 5000, many)),
        ("CARD", 2, layer("CARD", 1, 4, part(9, 2, b"p", b"") + content(4, b"\0" + b"1") + content(-4, b"ab\x8a") + content(5, b"st", b"\0\1\0\2") + b"\0\1\0\x09x")), ("CARD", 4, None),
    ]
    blocks = spark.createDataFrame([("f", k, i, p and bytearray(p)) for k, i, p in payloads], "file string, type string, id int, payload binary")
    found = records.contents(blocks)
    assert "aggregate(" not in plan(found)
    rows = [(r.layer_id, r.n, r.part_id, r.layer, r.text, r.highlight, [tuple(x) for x in r.style_runs]) for r in found.collect()]
    assert sorted(x[:4] for x in rows if x[0] == 1) == [(1, i, 1 + i % 9, "card") for i in range(5000)]
    assert sorted((x for x in rows if x[0] == 2), key=lambda x: x[1]) == [(2, 0, 4, "background", None, True, []), (2, 1, 4, "card", "abä", None, []), (2, 2, 5, "background", "st", None, [(1, 2)])]


def test_sizes_of_texts_need_no_walk_in_expressions(spark):
    found = records.text_bytes(records.contents(archive_queries._layer_blocks(spark, SF)))
    assert "aggregate(" not in plan(found) and "listagg" not in plan(found)
    against_sql(spark, "a36_text_bytes", 5)


def fork(data, name):
    listed = (0).to_bytes(2, "big") + b"ICON" + (0).to_bytes(2, "big") + (10).to_bytes(2, "big") + (5).to_bytes(2, "big") + bytes(10) + name
    numbers = (16, 16 + len(data), len(data), 28 + len(listed))
    return b"".join(x.to_bytes(4, "big") for x in numbers) + data + bytes(24) + (28).to_bytes(2, "big") + (28 + len(listed)).to_bytes(2, "big") + listed


def test_maps_are_found_in_all_images_of_a_batch(spark):
    small = fork(b"\0\0\0\1x", b"\1n")
    places = (0, 4, rom.MAP_WINDOW - 6, 2 * rom.MAP_WINDOW - 2, 2 * rom.MAP_WINDOW + 100)
    large = bytearray(b"\xff" * (2 * rom.MAP_WINDOW + 400))
    for at in places[2:]:
        large[at : at + len(small)] = small
    images = [("none", 0, None), ("odd", 0, b"\xff" + small), ("two", 8, b"\xff\xff" + small + b"\xff" * (len(small) % 2) + small), ("cut", 0, small[:-12]), ("short", 0, b"\0"), ("large", 100, large), ("", None, small)]
    rows = spark.createDataFrame([(r, b, c and bytearray(c)) for r, b, c in images], "rom_id string, base long, content binary").coalesce(1)
    found = rom.resource_maps(rows)
    assert "Generate" not in plan(found)
    second = 2 + len(small) + len(small) % 2
    assert sorted((r.rom_id, r.address or 0, r.map_length, r.n_resources) for r in found.collect()) == sorted(
        [("two", 10, 52, 1), ("two", 8 + second, 52, 1), ("", 0, 52, 1)] + [("large", 100 + at, 52, 1) for at in places[2:]]
    )
    assert [r.address for r in found.where("rom_id = ''").collect()] == [None]


def test_forks_are_made_without_windows_and_aggregates(spark):
    made = archive_queries._forks(spark, SF)
    assert "listagg" not in plan(made) and "Window" not in plan(made)
    against_sql(spark, "a30_resource_maps", 5)
