"""What grew faster than its tables: rows that were exchanged wide or twice, null keys in one task, large batches."""

from relicframe.plans import report_queries, reports

SF = "/root/testdata/sf0.001"


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_statistics_exchange_rows_without_their_metrics(spark):
    found = reports.stack_statistics(report_queries.driver_warehouse(spark, SF), report_queries.RUN)
    exchanges = [line for line in executed(found).splitlines() if "Exchange hashpartitioning" in line]
    # the narrow rows and the stacks' ids
    assert len(exchanges) == 2 and not any("metric" in line for line in exchanges)


def test_statistics_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "r1"), (2, "r1"), (3, "r2"), (None, "r1")], "id long, run_id string")
    sections = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, ""), (3, "a"), (9, "a"), (None, "a")], "stack_id long, tag string")
    found = reports.stack_statistics(reports.Warehouse(spark, tables={"stacks": rows, "json_sections": sections}), "r1").collect()
    assert len(found) == 2 * 18 + 3
    assert {(r.stack_id, r.value) for r in found if r.metric == "json_section_count"} == {(1, 4), (2, 0)}
    assert sorted((r.stack_id, r.detail, r.value) for r in found if r.metric == "json_tag") == [(1, "", 1), (1, "", 1), (1, "a", 2)]


def test_rows_without_a_key_are_dealt_out(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("json_sections", "output_files", "binary_chunks", "parsed_parts", "disassembly_summary"):
            found = executed(reports.REPORTS[name](report_queries.driver_warehouse(spark, SF), report_queries.RUN))
            outer = [line for line in found.splitlines() if "Join" in line and "LeftOuter" in line]
            assert outer and all("coalesce(" in line for line in outer), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_rows_of_listings_are_not_sorted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("json_sections", "output_files", "diagnostics", "classifications"):
            found = executed(reports.listing(report_queries.driver_warehouse(spark, SF), name, report_queries.RUN))
            assert "ShuffledHashJoin" in found and "SortMergeJoin" not in found, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pictures_are_held_by_their_bytes():
    from relicframe.plans import color_pictures

    # of equal values the first counts, and a value beyond the depth is never looked up
    table = b"".join(bytes(x) for x in ((0, 0, 1, 0, 2, 0, 3, 0), (0, 0, 9, 0, 9, 0, 9, 0), (1, 0, 7, 0, 7, 0, 7, 0)))
    found = color_pictures.gathered(2, 1, 1, 1, b"\x40", table, None, None, False)
    assert found.tolist() == [[[1, 2, 3, 255], [0, 0, 0, 255]]]
    assert color_pictures.BATCH_BYTES <= 8 << 20
