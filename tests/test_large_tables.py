"""What larger tables and odd rows showed: ties, halves, and work that lay in one task or was done more than once."""

import duckdb
from pyspark.sql import functions as F

from relicframe.functions.binary import c_string, nul_end
from relicframe.plans import archive_queries, records, report_queries, resources, rom, warehouse

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def against_sql(spark, name, folder, *tables):
    connection = duckdb.connect()
    for t in tables:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found, want = report_queries.QUERIES[name](spark, str(folder)), connection.sql(report_queries.ORACLES[name])
    order = lambda columns: sorted(range(len(columns)), key=columns.__getitem__)
    shown = lambda rows, columns: sorted(tuple(str(r[i]) for i in order(columns)) for r in rows)
    assert shown(found.collect(), found.columns) == shown(want.fetchall(), want.columns)


def test_what_the_type_says_needs_no_text(spark):
    rows = spark.createDataFrame([("f", "STR#", 1, "", bytearray(b"\0\1\1a"))], "file string, type string, id int, name string, data binary")
    found = resources.converted(rows, ("STR#",)).where("format = 'json'")
    filters = [line for line in plan(found).splitlines() if "Filter" in line]
    assert filters and not any("lambda" in line for line in filters)
    assert [r.text for r in found.collect()] == ['{"strings":["a"]}']


def test_a_walk_is_planned_once(spark):
    for kind in ("STR#", "DITL", "BNDL", "KCHR"):
        rows = spark.createDataFrame([("f", kind, 1, "", bytearray(300))], "file string, type string, id int, name string, data binary")
        assert plan(resources.converted(rows, (kind,)).select("text")).count("aggregate(") == 1


def test_menus_walk_no_further_than_their_bytes(spark):
    item = b"\1x" + bytes(4)
    menus = [(n, bytearray(bytes(14) + b"\0" + item * n + b"\0")) for n in (0, 1, 7, 128, 200)]
    rows = spark.createDataFrame(menus, "id int, data binary").selectExpr("'f' AS file", "'MENU' AS type", "id", "'' AS name", "data")
    found = resources.converted(rows, ("MENU",)).select("id", F.size(F.from_json("text", "items array<struct<name:string>>")["items"]).alias("n")).collect()
    assert {r.id: r.n for r in found} == {0: 0, 1: 1, 7: 7, 128: 128, 200: 128}


def test_blocks_of_one_id_are_dealt_out(spark):
    rows = spark.range(4000).selectExpr("id", "X'00' AS payload")
    made = archive_queries._block(rows, "STAK", F.col("id"), F.lit(-1), F.col("payload"))
    assert "RepartitionByExpression [file" in plan(made)


def test_ends_of_strings(spark):
    data = bytearray(b"ab\0\xe9c\0d")
    rows = spark.createDataFrame([(data, at) for at in (-2, -1, 0, 2, 3, 5, 6, 7, 9)], "d binary, at int")
    found = {r.at: (r.e, r.s) for r in rows.select("at", nul_end(F.col("d"), F.col("at")).alias("e"), c_string(F.col("d"), F.col("at")).alias("s")).collect()}
    assert {at: e for at, (e, _) in found.items()} == {-2: 7, -1: 7, 0: 2, 2: 2, 3: 5, 5: 5, 6: 7, 7: 7, 9: 7}
    assert found[0][1] == "ab" and found[3][1] == "Èc" and found[6][1] == "d" and found[9][1] == ""


def test_styles_of_one_id_stay_in_order_of_their_places(spark):
    rows = spark.createDataFrame([("f", 5, -1, ["plain"], size, "", n) for size, n in ((9, 1), (7, 2))], "file string, style_id int, font_id int, text_styles array<string>, font_size int, font_name string, n int")
    assert [r.css for r in records.stylesheet(rows).collect()] == [".style5 { font-size: 9pt; }\n.style5 { font-size: 7pt; }"]


def test_halves_round_to_even(spark, tmp_path):
    made = spark.read.parquet(f"{SF}/customer.parquet").limit(40).withColumn("c_acctbal", F.lit(5000.5)).withColumn("c_nationkey", F.lit(4).cast("bigint"))
    made.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "customer.parquet")
    against_sql(spark, "q21_conditional_classify", tmp_path, "customer")


def test_forks_are_made_without_arrays(spark):
    made = archive_queries._forks(spark, SF)
    assert "lambda" not in plan(made)


def test_places_of_maps_fall_out_by_their_bytes(spark):
    fork = b"".join(x.to_bytes(4, "big") for x in (16, 22, 6, 50)) + b"\0\0\0\2ab" + bytes(24) + b"\0\x1c\0\x32\0\0ICON\0\0\0\x0a" + bytes(12)
    images = spark.createDataFrame([("r", 0, bytearray(b"\xff" * 8 + fork)), ("s", 0, bytearray(b"\x7f" * 90))], "rom_id string, base long, content binary")
    found = rom.resource_maps(images)
    assert [(r.address, r.data_address, r.map_address, r.n_resources) for r in found.collect()] == [(8, 24, 30, 1)]
    assert "most#" in plan(found)


def test_few_images_and_runs_are_sent_to_all_tasks(spark):
    rows = spark.createDataFrame([("O", i, i, "jsr", "D0 /* 00000010 */") for i in range(20)], "rom_id string, line_index int, address long, mnemonic string, operands string")
    bounds = spark.createDataFrame([("O", 5, 900)], "rom_id string, base int, bytes int")
    found = rom.xrefs(rows, bounds)
    assert "hint=(strategy=broadcast)" in plan(found) or "ResolvedHint (strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString()
    assert found.count() == 20
    numbered = warehouse.dense_ids(spark.range(50).selectExpr("'r' AS run_id", "50 - id AS n"), ["n"])
    assert plan(numbered).count("strategy=broadcast") == 2
    assert {(r.n, r.id) for r in numbered.collect()} == {(i, i) for i in range(1, 51)}
