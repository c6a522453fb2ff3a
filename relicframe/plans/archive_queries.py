"""Record, stream and firmware operators as driver queries.

Blocks, resources and images are made of the driver's tables, byte by byte, and go
through the decoders; the SQL says from the same tables what must come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import groups, octets, whole_groups
from ..sources import blocks, resfork
from . import records, resources, rom
from .driver_queries import query, table


def _be(value: Column | int, size: int) -> Column:
    """Big-endian bytes of a number; negative ones wrap."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << (8 * size)))), 2 * size, "0"))


def _zero(size: int) -> Column:
    return F.lit(bytes(size))


def _joined(parts: Column) -> Column:
    """The bytes of an array of byte strings, one behind the other."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


_LINE_ORDER = "l_linenumber l_partkey"


def _listed(order: str, part: Column) -> Column:
    """Aggregate: the parts of a group in order of some columns, joined."""
    order = F.struct(*order.split())
    return _joined(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), part.alias("p")))), lambda x: x["p"]))


def _c(text: Column) -> Column:
    return F.concat(F.encode(text, "utf-8"), _zero(1))


def _even(data: Column) -> Column:
    return F.when(F.octet_length(data) % 2 == 1, F.concat(data, _zero(1))).otherwise(data)


def _block(frame: DataFrame, kind: str, file: Column, number: Column, payload: Column) -> DataFrame:
    made = frame.select(file.cast("string").alias("file"), F.lit(kind).alias("type"), number.cast("int").alias("id"), payload.alias("payload"), F.lit("ok").alias("status"))
    # dealt out, else the bytes are made afresh for every field that is read from them; by both keys, as many files hold one block of one id
    return made.repartition("file", "id")


# --- stacks ----------------------------------------------------------------------------------


def _stack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as the stack record of its own file."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    version = F.concat(_be(key % 10, 1), _be(customer % 10 * 16 + key % 3, 1), F.lit(b"\x40"), _be(customer % 4, 1))
    flags = F.when(F.col("o_orderstatus") == "F", 1 << 15).otherwise(0) + F.when(F.col("o_orderstatus") == "O", 1 << 13).otherwise(0) + F.when(key % 2 == 0, 1 << 10).otherwise(0)
    payload = F.concat(
        _zero(32), _be(customer, 4), _be(key, 4), _be(key % 5 - 1, 4), _zero(16), _be(key % 6, 2), _zero(2), _be(flags, 2), _zero(18), version, version, version, version,
        _zero(320), _be(customer % 3 - 1, 4), _be(-1, 4), _be(key % 2 * 300, 2), _be(key % 3 * 400, 2), _zero(1524 - 432), _c(F.col("o_orderpriority")),
    )
    return _block(table(spark, sf_dir, "orders"), "STAK", key, F.lit(-1), payload)


@query("a01_stack_records", """
    SELECT CAST(o_orderkey AS VARCHAR) AS file, -1 AS id, o_custkey AS card_count, o_orderkey AS first_card, o_orderkey % 5 - 1 AS list_id, o_orderkey % 6 AS user_level,
        o_orderstatus = 'F' AS cant_modify, o_orderstatus = 'O' AS private_access, o_orderkey % 2 = 0 AS cant_peek,
        'HyperCard ' || o_orderkey % 10 || '.' || o_custkey % 10 || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '.' || o_orderkey % 3 END || CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'a' || o_custkey % 4 END AS created_by_version,
        o_custkey % 3 - 1 AS font_table_id, -1 AS style_table_id, CASE WHEN o_orderkey % 2 = 0 THEN 342 ELSE 300 END AS card_height,
        CASE WHEN o_orderkey % 3 = 0 THEN 512 ELSE o_orderkey % 3 * 400 END AS card_width, 40 AS pattern_count, o_orderpriority AS script FROM orders""")
def stack_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.stacks(_stack_blocks(spark, sf_dir))
    return found.drop("cant_delete", "cant_abort", "last_compacted_version", "last_edited_version", "first_edited_version")


@query("a02_stack_references", """
    SELECT CAST(o_orderkey AS VARCHAR) AS file, 'LIST' AS type, CAST(o_orderkey % 5 - 1 AS INT) AS id, 'STAK.listBlockId' AS field FROM orders WHERE o_orderkey % 5 > 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'FTBL', CAST(o_custkey % 3 - 1 AS INT), 'STAK.fontTableBlockId' FROM orders WHERE o_custkey % 3 > 0""")
def stack_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that stacks name and their files lack (all of them here)."""
    made = _stack_blocks(spark, sf_dir)
    return blocks.missing_references(made, records.stack_references(made)).select("file", "type", "id", "field")


@query("a03_patterns", """
    WITH n AS (SELECT unnest(range(1, 41)) AS pattern)
    SELECT CAST(n_nationkey AS VARCHAR) AS file, CAST(pattern AS INT) AS pattern, repeat(lpad(to_hex((n_nationkey * 7 + pattern - 1) % 256), 2, '0'), 8) AS bits FROM nation, n""")
def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern table for each nation."""
    every = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.unhex(F.repeat(F.lpad(F.hex((F.col("n_nationkey") * 7 + k) % 256), 2, "0"), F.lit(8))))
    made = _block(table(spark, sf_dir, "nation"), "STAK", F.col("n_nationkey"), F.lit(-1), F.concat(_zero(692), _joined(every)))
    return records.patterns(made).select("file", F.col("pattern").cast("int").alias("pattern"), F.upper(F.hex("bits")).alias("bits"))


def _fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A font table for each region: its nations."""
    entry = _even(F.concat(_be(F.col("n_nationkey"), 2), _c(F.col("n_name"))))
    grouped = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.count("*").alias("n"), _listed("n_nationkey", entry).alias("e"))
    return _block(grouped, "FTBL", F.col("r"), F.lit(1), F.concat(_zero(6), _be(F.col("n"), 2), _zero(4), F.col("e")))


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style table for each region: the suppliers of its nations and of nation 99."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    font = F.when(key % 4 == 0, 99).when(key % 9 == 0, -1).otherwise(F.col("s_nationkey"))
    flags = F.when(key % 5 == 0, -1).otherwise(key % 3 * 256 + key % 2 * 1024)
    size = F.when(key % 6 == 0, -1).otherwise(9 + key % 15)
    entry = F.concat(_be(key % 30000, 2), _zero(8), _be(font, 2), _be(flags, 2), _be(size, 2), _zero(8))
    grouped = rows.groupBy(F.col("n_regionkey").alias("r")).agg(F.count("*").alias("n"), _listed("s_suppkey", entry).alias("e"))
    return _block(grouped, "STBL", F.col("r"), F.lit(2), F.concat(_zero(4), _be(F.col("n"), 4), _zero(6), F.col("e")))


@query("a04_font_tables", "SELECT CAST(n_regionkey AS VARCHAR) AS file, CAST(n_nationkey AS BIGINT) AS font_id, n_name AS name FROM nation")
def font_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.fonts(_fonts(spark, sf_dir))


_STYLES_SQL = """
    WITH s AS (SELECT n_regionkey AS r, s_suppkey % 30000 AS id, s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 99 WHEN s_suppkey % 9 = 0 THEN -1 ELSE s_nationkey END AS font_id,
                      CASE WHEN s_suppkey % 5 = 0 THEN [] WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN ['plain'] ELSE
                          [x FOR x IN [CASE WHEN s_suppkey % 2 = 1 THEN 'underline' END, CASE WHEN s_suppkey % 3 = 2 THEN 'italic' END, CASE WHEN s_suppkey % 3 = 1 THEN 'bold' END] IF x IS NOT NULL] END AS styles,
                      CASE WHEN s_suppkey % 6 = 0 THEN 12 ELSE 9 + s_suppkey % 15 END AS size FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    f AS (SELECT s.*, coalesce(n_name, '') AS font_name FROM s LEFT JOIN nation ON n_nationkey = font_id AND n_regionkey = r)"""


@query("a05_style_tables", _STYLES_SQL + """
    SELECT CAST(r AS VARCHAR) AS file, id AS style_id, CAST(font_id AS BIGINT) AS font_id, array_to_string(styles, ',') AS text_styles, size AS font_size, font_name FROM f""")
def style_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles with the names of their fonts; a font of another region is unknown."""
    found = records.styles(_styles(spark, sf_dir).unionByName(_fonts(spark, sf_dir)))
    return found.withColumn("text_styles", F.array_join("text_styles", ","))


@query("a06_stylesheets", _STYLES_SQL + """
    SELECT CAST(r AS VARCHAR) AS file, string_agg('.style' || id || ' { ' || CASE WHEN font_id <> -1 THEN 'font-family: "' || font_name || '"; ' ELSE '' END
        || CASE WHEN list_contains(styles, 'bold') THEN 'font-weight: bold; ' ELSE '' END || CASE WHEN list_contains(styles, 'italic') THEN 'font-style: italic; ' ELSE '' END
        || CASE WHEN list_contains(styles, 'underline') THEN 'text-decoration: underline; ' ELSE '' END || 'font-size: ' || size || 'pt; }', chr(10) ORDER BY id) AS css FROM f GROUP BY r""")
def stylesheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stylesheet(records.styles(_styles(spark, sf_dir).unionByName(_fonts(spark, sf_dir)), places=True))


@query("a07_master_entries", """
    SELECT CAST(c_nationkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, c_custkey * 32 AS file_offset, c_custkey % 256 AS id_low, c_custkey * 256 + c_custkey % 256 AS raw FROM customer QUALIFY c_custkey <> 0""")
def master_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of a nation as places in a master table."""
    key = F.col("c_custkey")
    grouped = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("f")).agg(_listed("c_custkey", _be(key * 256 + key % 256, 4)).alias("e"))
    found = records.master_entries(_block(grouped, "MAST", F.col("f"), F.lit(-1), F.concat(_zero(20), F.col("e"))))
    return found.withColumn("n", F.col("n").cast("long"))


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each nation, a page for each customer of it, missing for those in debt, a card for each order, missing for pending ones."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    counted = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), _listed("o_orderkey", F.concat(_be(F.col("o_orderkey") + 1, 4), _be(F.length("o_orderpriority"), 1), _zero(5))).alias("cards")
    )
    pages = customers.join(counted, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    entry = F.concat(_be(F.col("c_custkey"), 4), _be(F.col("n"), 2))
    lists = pages.groupBy("c_nationkey").agg(F.count("*").alias("pages"), _listed("c_custkey", entry).alias("e"))
    listed = _block(lists, "LIST", F.col("c_nationkey"), F.lit(7), F.concat(_zero(4), _be(F.col("pages"), 4), _zero(8), _be(10, 2), _zero(18), F.col("e"), _zero(6)))
    # what is in debt or pending has a number that no list and no page names
    paged = _block(pages, "PAGE", F.col("c_nationkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")), F.concat(_zero(12), F.coalesce("cards", _zero(0))))
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    card = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") + 1).otherwise(-F.col("o_orderkey") - 1)
    return listed.unionByName(paged).unionByName(_block(owned, "CARD", F.col("c_nationkey"), card, _zero(50)))


@query("a08_page_entries", """
    SELECT CAST(c_nationkey AS VARCHAR) AS file, 7 AS list_id, c_custkey AS page_id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS n, o_orderkey + 1 AS card_id, length(o_orderpriority) AS flags
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0""")
def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the pages that lists name."""
    return records.page_entries(_page_blocks(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


@query("a09_lookup_misses", """
    SELECT CAST(c_nationkey AS VARCHAR) AS file, 'PAGE' AS type, c_custkey AS id, 'listed page is missing' AS message FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'CARD', o_orderkey + 1, 'listed card is missing' FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0 AND o_orderstatus = 'P'""")
def lookup_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.lookup_misses(_page_blocks(spark, sf_dir))


# --- cards -----------------------------------------------------------------------------------


def _cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, payload) of orders, each followed by its lines: the counts and the bytes of the lines between an order's head and tail."""
    for batch in whole_groups(batches, "key"):
        places, line = groups(batch.column("key")), batch.column("line").to_numpy()
        held = [octets(batch.column(c)) for c in ("part", "content")]
        ends = [np.append(starts, starts[-1] + sizes[-1]) for _, starts, sizes in held]
        button = np.cumsum(np.append(0, batch.column("button").fill_null(False).to_numpy(zero_copy_only=False)))
        heads, tails, payloads = batch.column("head"), batch.column("tail"), []
        orders = np.flatnonzero(line == 0)
        group = np.searchsorted(places, orders, "right") - 1
        lines = np.cumsum(np.append(0, line))
        for order, first, last in zip(orders.tolist(), places[group].tolist(), places[group + 1].tolist()):
            head, tail = heads[order].as_py(), tails[order].as_py()
            counts = (int(lines[last] - lines[first]) % 65536).to_bytes(2, "big") + bytes(6) + (int(button[last] - button[first]) % 65536).to_bytes(2, "big") + bytes(4)
            listed = [data[end[first] : end[last]].tobytes() for (data, _, _), end in zip(held, ends)]
            payloads.append(None if head is None or tail is None else b"".join([head, counts, *listed, tail]))
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(orders)), pa.array(payloads, pa.binary())], ["id", "payload"])


def _layer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order a card of its customer's background; lines are parts and, those returned, contents too; each customer a background with one button."""
    lines, number = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    button = F.col("l_returnflag") == "R"
    body = F.concat(
        _be(number, 2), _be(F.when(button, 256).otherwise(512) + F.when(F.col("l_linestatus") == "F", 128).otherwise(0), 2), _be(number, 2), _be(F.col("l_quantity"), 2),
        _be(number + 50, 2), _be(F.col("l_quantity") + 9, 2), _be(F.when(button, number).otherwise(7) + number * 256, 2), _zero(4), _be(number % 4 - 2, 2), _be(F.col("l_suppkey") % 20, 2),
        _be(12, 2), _be(number % 2 * 256, 2), _be(16, 2), _c(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))), _zero(1), _c(F.col("l_returnflag")),
    )
    part = _even(F.concat(_be(F.octet_length(body) + 2 + (F.octet_length(body) % 2), 2), body))
    said = F.encode(F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")), "utf-8")
    content = F.concat(_be(F.when(F.col("l_linestatus") == "O", -number).otherwise(number), 2), _be(F.octet_length(said), 2), _even(said))
    made = lines.where("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("key"), F.lit(1).alias("line"), number.alias("number"), button.alias("button"), part.alias("part"), F.when(button, content).otherwise(_zero(0)).alias("content"))
    head = F.concat(_zero(4), _be(F.col("o_orderkey") % 3, 4), _be(F.when(F.col("o_orderstatus") == "F", 1 << 14).otherwise(1 << 13), 2), _zero(14), _be(F.col("o_custkey"), 4))
    tail = F.concat(_c(F.concat(F.lit("card "), F.col("o_orderkey").cast("string"))), _c(F.col("o_orderpriority")))
    # lines go to their order once, behind it; aggregates that list bytes fall back to sorts of their buffers
    cards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("line"), head.alias("head"), tail.alias("tail"))
    placed = cards.unionByName(made, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "line", "number", "part", "content")
    filled = placed.select("key", "line", "head", "tail", "button", "part", "content").mapInArrow(_cards, "id long, payload binary")
    made = filled.select(F.lit("f").alias("file"), F.lit("CARD").alias("type"), F.col("id").cast("int").alias("id"), "payload", F.lit("ok").alias("status"))
    name = F.encode(F.lit("ok"), "utf-8")
    one = F.concat(_be(36, 2), _be(1, 2), _be(256, 2), _zero(24), name, _zero(4))
    ground = F.concat(_zero(24), _be(1, 2), _zero(6), _be(0, 2), _zero(4), one, _c(F.col("c_name")), _c(F.lit("")))
    return made.unionByName(_block(table(spark, sf_dir, "customer"), "BKGD", F.lit("f"), F.col("c_custkey"), ground))


@query("a10_layers", """
    WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS m FROM lineitem GROUP BY l_orderkey)
    SELECT 'CARD' AS type, o_orderkey AS id, o_orderkey % 3 AS bitmap_id, o_custkey AS owner, o_orderstatus = 'F' AS cant_delete, o_orderstatus = 'F' AS show_picture,
        coalesce(n, 0) AS n_parts, coalesce(m, 0) AS n_contents, 'card ' || o_orderkey AS name, o_orderpriority AS script FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
    UNION ALL SELECT 'BKGD', c_custkey, 0, -1, false, true, 1, 0, c_name, '' FROM customer""")
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards and backgrounds with their counts, names and scripts."""
    return records.layers(_layer_blocks(spark, sf_dir)).drop("file", "flags")


@query("a11_parts", """
    WITH n AS (SELECT CASE WHEN n_nationkey < 15 THEN n_nationkey ELSE n_nationkey + 100 END AS k, n_name FROM nation)
    SELECT 'BKGD' AS layer_type, c_custkey AS layer_id, 1 AS part_id, 'button' AS part_type, true AS visible, 0 AS "top", 0 AS "left", 0 AS "right", 'transparent' AS style, 0 AS family, 'left' AS text_align, 0 AS font_id,
        'plain' AS text_styles, 'ok' AS name, '' AS script, (SELECT n_name FROM n WHERE k = 0) AS font_name FROM customer
    UNION ALL SELECT 'CARD', l_orderkey AS layer_id, l_linenumber AS part_id, CASE WHEN l_returnflag = 'R' THEN 'button' ELSE 'field' END AS part_type, l_linestatus <> 'F' AS visible,
        l_linenumber AS "top", CAST(l_quantity AS BIGINT) AS "left", CAST(l_quantity AS BIGINT) + 9 AS "right",
        CASE WHEN l_returnflag <> 'R' THEN 'scrolling' ELSE ['opaque', 'rectangle', 'roundrect', 'shadow', 'checkbox', 'radiobutton', 'unknown'][l_linenumber] END AS style, l_linenumber AS family,
        CASE l_linenumber % 4 WHEN 0 THEN 'forceLeft' WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE 'center' END AS text_align, l_suppkey % 20 AS font_id,
        CASE WHEN l_linenumber % 2 = 1 THEN 'bold' ELSE 'plain' END AS text_styles, 'p' || l_partkey AS name, l_returnflag AS script, coalesce(n_name, '') FROM lineitem LEFT JOIN n ON k = l_suppkey % 20""")
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buttons and fields of cards and backgrounds, with the names of their fonts."""
    made = _layer_blocks(spark, sf_dir)
    found = records.parts(made, font_names=_font_names(spark, sf_dir))
    return found.select(
        "layer_type", "layer_id", "part_id", "part_type", "visible", F.col("bounds.top").alias("top"), F.col("bounds.left").alias("left"), F.col("bounds.right").alias("right"), "style", "family",
        "text_align", "font_id", F.array_join("text_styles", ",").alias("text_styles"), "name", "script", "font_name",
    )


def _font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts named after nations; parts use some numbers that none has."""
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(F.lit("f").alias("file"), F.when(key < 15, key).otherwise(key + 100).alias("font_id"), F.col("n_name").alias("name"))


_CONTENTS_SQL = """WITH t AS (SELECT l_orderkey, l_linenumber, l_linestatus, 'q' || CAST(l_quantity AS INT) AS said, l_linestatus <> 'O' AND l_linenumber = 1 AS marks FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"""


@query("a35_contents", _CONTENTS_SQL + """
    SELECT l_orderkey AS layer_id, l_linenumber AS part_id, CASE WHEN l_linestatus = 'O' THEN 'card' ELSE 'background' END AS layer, CASE WHEN marks THEN false END AS highlight, CASE WHEN NOT marks THEN said END AS text FROM t""")
def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of cards; one for a button of the background is its highlight, and no text."""
    return records.contents(_layer_blocks(spark, sf_dir)).select("layer_id", "part_id", "layer", "highlight", "text")


@query("a36_text_bytes", _CONTENTS_SQL + """
    SELECT l_orderkey AS layer_id, CAST(coalesce(sum(CASE WHEN NOT marks THEN strlen(said) END), 0) AS BIGINT) AS text_bytes FROM t GROUP BY l_orderkey""")
def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.text_bytes(records.contents(_layer_blocks(spark, sf_dir))).select("layer_id", "text_bytes")


# --- print records ---------------------------------------------------------------------------


@query("a12_print_settings", """
    SELECT CAST(r_regionkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS n, CAST(n_nationkey AS BIGINT) AS report_id, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey""")
def print_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of a region as report templates that its print settings list."""
    item = F.concat(_be(F.col("n_nationkey"), 4), _be(F.length("n_name"), 1), F.encode(F.rpad("n_name", 31, " "), "utf-8"))
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), _listed("n_nationkey", item).alias("e"))
    payload = F.concat(_zero(0x24), _be(F.col("n_regionkey") + 40, 4), _zero(0x100), _be(F.col("n"), 2), F.col("e"))
    made = _block(grouped, "PRNT", F.col("n_regionkey"), F.lit(1), payload)
    return records.print_settings(made).drop("page_setup_id").withColumn("n", F.col("n").cast("long"))


@query("a13_page_setups", """
    SELECT CAST(s_suppkey AS VARCHAR) AS file, 3 AS id, s_nationkey AS "printerDriverVersion", s_suppkey % 100 AS "pageTop", -5 AS "pageH", s_suppkey % 7 AS port, 2 AS "feedType", 1 AS "firstPage",
        s_suppkey % 9 AS "lastPage", 4 AS "numCopies", CASE s_suppkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'deferred' ELSE 'unknown' END AS "printingMethod" FROM supplier""")
def page_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    payload = F.concat(
        _zero(4), _be(F.col("s_nationkey"), 2), _zero(6), _be(key % 100, 2), _zero(18), _be(-5, 2), _be(key % 7, 1), _be(2, 1), _zero(14), _zero(16), _be(1, 2), _be(key % 9, 2), _be(4, 2), _be(key % 3, 1), _zero(1)
    )
    made = _block(table(spark, sf_dir, "supplier"), "PRST", key, F.lit(3), payload)
    return records.page_setups(made).select("file", "id", "printerDriverVersion", "pageTop", "pageH", "port", "feedType", "firstPage", "lastPage", "numCopies", "printingMethod")


@query("a14_report_templates", """
    SELECT CAST(o_orderkey AS VARCHAR) AS file, ['centimeters', 'millimeters', 'inches', 'points', 'unknown'][o_orderkey % 5 + 1] AS units, 'h ' || o_orderstatus AS header, count(l_orderkey) AS n_items,
        string_agg('i' || l_partkey || ':' || CASE WHEN l_linenumber % 2 = 1 THEN 'Geneva' ELSE 'Monaco' END || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS items
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def report_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order a report template whose items are its lines, of different lengths."""
    number = F.col("l_linenumber")
    texts = F.concat(_c(F.concat(F.lit("i"), F.col("l_partkey").cast("string"))), _c(F.when(number % 2 == 1, "Geneva").otherwise("Monaco")))
    item = F.concat(_be(F.octet_length(texts) + 22, 2), _zero(8), _be(number, 2), _zero(10), texts)
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), _listed(_LINE_ORDER, _even(item)).alias("e"))
    joined = table(spark, sf_dir, "orders").join(grouped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat(F.lit("h "), "o_orderstatus")
    payload = F.concat(
        _zero(4), _be(F.col("o_orderkey") % 5, 1), _zero(19), _be(F.length(head), 1), F.encode(F.rpad(head, 255, " "), "utf-8"), _be(F.coalesce("n", F.lit(0)), 2), F.coalesce("e", _zero(0))
    )
    found = records.report_templates(_block(joined, "PRFT", F.col("o_orderkey"), F.lit(1), payload))
    items = F.transform("items", lambda x: F.concat_ws(":", x["contents"], x["font"], x["columns"].cast("string")))
    return found.select("file", "units", "header", F.size("items").cast("long").alias("n_items"), F.nullif(F.array_join(items, ","), F.lit("")).alias("items"))


# --- streams and forks -----------------------------------------------------------------------


@query("a15_block_maps", """
    WITH b AS (SELECT source AS file, CASE WHEN lang = 'en' THEN 'FREE' ELSE 'CARD' END AS type, n_chars % 10 AS id, strlen(text) + 12 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq FROM documents)
    SELECT file, type, CAST(id AS INT) AS id, max(seq) AS seq, max_by(size, seq) AS size FROM b WHERE type <> 'FREE' GROUP BY file, type, id""")
def block_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as blocks of few ids: the last of an id counts, free blocks do not."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "FREE").otherwise("CARD")
    found = blocks.scan_blocks(blocks.write_stream(docs, "source", kind, F.col("n_chars") % 10, F.encode("text", "utf-8"), "doc_id"))
    return blocks.block_map(found).select("file", "type", "id", F.col("seq").cast("long").alias("seq"), "size")


@query("a16_type_counts", """
    WITH b AS (SELECT source AS file, CASE WHEN lang = 'en' THEN 'CARD' ELSE lang || '??' END AS type FROM documents)
    SELECT file, type, count(*) AS n, type NOT IN ('CARD', 'TAIL') AS unknown FROM (SELECT * FROM b UNION ALL SELECT DISTINCT file, 'TAIL' FROM b) GROUP BY file, type""")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by type, and whether the type is unknown."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "CARD").otherwise(F.concat("lang", F.lit("??")))
    found = blocks.scan_blocks(blocks.write_stream(docs, "source", kind, F.lit(1), F.encode("text", "utf-8"), "doc_id"), payloads=False)
    unknown = blocks.unknown_types(found).select("file", "type").distinct().withColumn("unknown", F.lit(True))
    return blocks.type_counts(found).join(unknown, ["file", "type"], "left").withColumn("unknown", F.coalesce("unknown", F.lit(False)))


@query("a17_damaged_streams", """
    SELECT p_partkey AS part, ['TAIL', NULL, NULL, NULL, 'TAIL'][p_partkey % 5 + 1] AS type, CAST(12 + strlen(p_name) AS BIGINT) AS "offset",
        ['terminal', 'truncated header', 'invalid size', 'truncated payload', 'terminal'][p_partkey % 5 + 1] AS status FROM part
    UNION ALL SELECT p_partkey, NULL, 24 + strlen(p_name), 'bytes after the end' FROM part WHERE p_partkey % 5 = 4""")
def damaged_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of one block that end well or in four ways badly, read strictly."""
    key = F.col("p_partkey")
    good = F.concat(_be(12 + F.octet_length("p_name"), 4), F.lit(b"CARD"), _be(key, 4), F.encode("p_name", "utf-8"))
    tail = F.unhex(F.lit("0000000C5441494CFFFFFFFF"))
    ends = F.when(key % 5 == 0, tail).when(key % 5 == 1, F.lit(b"\0\0\0")).when(key % 5 == 2, _zero(12)).when(key % 5 == 3, F.concat(_be(99, 4), F.lit(b"CARD"), _zero(5))).otherwise(F.concat(tail, _zero(1)))
    files = table(spark, sf_dir, "part").select(key.cast("string").alias("file"), F.concat(good, ends).alias("content")).repartition("file")
    found = blocks.scan_blocks(files, strict_tail=True).where("coalesce(type, '') <> 'CARD'")
    return found.select(F.col("file").cast("long").alias("part"), "type", "offset", "status")


def _fork_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content) of sorted lines: an order's data, one behind the other, then the map: types, references by type, names."""
    be = lambda n, size: (n % (1 << (8 * size))).to_bytes(size, "big")
    for batch in whole_groups(batches, "key"):
        places = groups(batch.column("key"))
        group = np.repeat(np.arange(len(places) - 1), np.diff(places))
        (data, data_starts, data_sizes), (names, name_starts, name_sizes) = (octets(batch.column(c)) for c in ("data", "name"))
        # where a line's data and name stand: what the lines before it take
        data_at, name_at = data_starts - data_starts[places[group]], name_starts - name_starts[places[group]]
        icon, number = batch.column("icon").to_numpy(zero_copy_only=False), batch.column("id")
        numbers = number.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        entries = np.zeros((len(group), 12), np.uint8)
        for at, value in ((0, numbers >> 8), (1, numbers), (2, name_at >> 8), (3, name_at), (4, numbers), (5, data_at >> 16), (6, data_at >> 8), (7, data_at)):
            entries[:, at] = value & 255
        # a line without a number has no entry
        order = np.lexsort((~icon, group))
        known = number.is_valid().to_numpy(zero_copy_only=False)[order]
        refs, ref_ends = entries[order][known].tobytes(), 12 * np.cumsum(np.append(0, known))
        icons = np.cumsum(np.append(0, icon))
        data_ends, name_ends = np.append(data_starts, data_starts[-1] + data_sizes[-1]), np.append(name_starts, name_starts[-1] + name_sizes[-1])
        datas, labels, contents = data.tobytes(), names.tobytes(), []
        for first, last in zip(places[:-1].tolist(), places[1:].tolist()):
            n_icons = int(icons[last] - icons[first])
            n_strings = last - first - n_icons
            n_types = (n_icons > 0) + (n_strings > 0)
            typed = lambda kind, n, skipped: kind + be(n - 1, 2) + be(2 + 8 * n_types + 12 * skipped, 2) if n else b""
            listed = be(n_types - 1, 2) + typed(b"ICON", n_icons, 0) + typed(b"STR ", n_strings, n_icons) + refs[ref_ends[first] : ref_ends[last]]
            held, named = datas[data_ends[first] : data_ends[last]], labels[name_ends[first] : name_ends[last]]
            head = be(16, 4) + be(16 + len(held), 4) + be(len(held), 4) + be(len(listed) + len(named) + 28, 4)
            contents.append(b"".join([head, held, bytes(24), be(28, 2), be(28 + len(listed), 2), listed, named]))
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(places[:-1])), pa.array(contents, pa.binary())], ["key", "content"])


def _forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order a fork: lines are resources of two types, with their names and attributes."""
    named = F.encode(F.concat(F.lit("n"), F.col("l_partkey").cast("string")), "utf-8")
    data = F.encode(F.col("l_suppkey").cast("string"), "utf-8")
    icon = F.coalesce(F.col("l_linestatus") == "O", F.lit(False))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("id"), icon.alias("icon"), F.concat(_be(F.octet_length(data), 4), data).alias("data"), F.concat(_be(F.octet_length(named), 1), named).alias("name")
    )
    order = ("key", "id", ~F.col("icon"), F.octet_length("data"), F.octet_length("name"), "data", "name")
    made = lines.repartition("key").sortWithinPartitions(*order).mapInArrow(_fork_bytes, "key long, content binary")
    return made.select(F.col("key").cast("string").alias("file"), "content")


_FORK_SQL = """SELECT CAST(l_orderkey AS VARCHAR) AS file, CASE WHEN l_linestatus = 'O' THEN 'ICON' ELSE 'STR ' END AS type, l_linenumber AS id, 'n' || l_partkey AS name, l_linenumber AS attributes,
    array_to_string([x FOR x IN [CASE WHEN l_linenumber & 4 <> 0 THEN 'preload' END, CASE WHEN l_linenumber & 2 <> 0 THEN 'changed' END, CASE WHEN l_linenumber & 1 <> 0 THEN 'compressed' END] IF x IS NOT NULL], ',') AS attribute_names,
    CAST(strlen(CAST(l_suppkey AS VARCHAR)) AS BIGINT) AS payload_bytes, sha256(CAST(l_suppkey AS VARCHAR)) AS payload_sha256, 'ok' AS status FROM lineitem"""


@query("a18_forks", _FORK_SQL)
def forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource forks of several types and resources, read back."""
    found = resfork.read_forks(_forks(spark, sf_dir))
    return found.select("file", "type", "id", "name", "attributes", F.array_join("attribute_names", ",").alias("attribute_names"), "payload_bytes", "payload_sha256", "status")


@query("a19_resource_counts", f"SELECT file, type, count(*) AS n FROM ({_FORK_SQL}) GROUP BY file, type")
def resource_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resfork.resource_counts(resfork.read_forks(_forks(spark, sf_dir)))


# --- firmware images -------------------------------------------------------------------------

BASE = 0x40800000


def _images(frame: DataFrame, key: Column, content: Column) -> DataFrame:
    return frame.select(key.cast("string").alias("rom_id"), F.lit(BASE).cast("long").alias("base"), content.alias("content")).repartition("rom_id")


@query("a20_pointer_words", f"""
    WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT CAST(l_orderkey AS VARCHAR) AS rom_id, k * 4 AS "offset", {BASE} + l_partkey % 40 AS target FROM l WHERE l_partkey % 40 < 4 * n AND l_partkey % 2 = 0""")
def pointer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as words of its image; even ones that point into it are pointers."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_listed(_LINE_ORDER, _be(F.lit(BASE) + F.col("l_partkey") % 40, 4)).alias("c"))
    return rom.pointer_words(_images(grouped, F.col("l_orderkey"), F.col("c")))


@query("a21_pointer_tables", f"""
    WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY l_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS rom_id, {BASE} + 10 AS address, n AS entry_count, least(0.90, 0.62 + d / 64) AS confidence FROM l WHERE n >= 4 AND d >= 2""")
def pointer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of as many addresses as an order has lines, behind ten other bytes and before four."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_listed("l_linenumber", _be(F.lit(BASE) + 2 * F.col("l_linenumber"), 4)).alias("c"))
    images = _images(grouped, F.col("l_orderkey"), F.concat(F.lit(b"\x7f" * 10), F.col("c"), F.lit(b"\x7f" * 8)))
    return rom.pointer_tables(images).drop("targets")


@query("a22_rom_identity", """
    SELECT 'rom-' || substr(sha256(text), 1, 12) AS rom_id, CAST(strlen(text) AS BIGINT) AS bytes, upper(sha256(text)) AS sha256 FROM documents""")
def rom_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "documents").select(F.lit(BASE).cast("long").alias("base"), F.encode("text", "utf-8").alias("content"))
    return rom.identify(images).select("rom_id", "bytes", "sha256")


_PLACES = "['DRVR', 'CODE', 'STR#', 'MENU', 'xxxx']"


@query("a23_markers", f"""
    WITH m AS (SELECT p_partkey, {_PLACES}[p_size % 5 + 1] AS a, {_PLACES}[p_partkey % 5 + 1] AS b, strlen(p_name) AS n FROM part),
    p AS (SELECT p_partkey, a AS type, n AS place FROM m UNION ALL SELECT p_partkey, b, n + 6 FROM m),
    r AS (SELECT *, CASE type WHEN 'DRVR' THEN 1 WHEN 'CODE' THEN 5 WHEN 'STR#' THEN 7 ELSE 9 END AS rank FROM p WHERE type <> 'xxxx')
    SELECT CAST(p_partkey AS VARCHAR) AS rom_id, row_number() OVER (PARTITION BY p_partkey ORDER BY rank, place) - 1 AS marker_id, type, {BASE} + place AS address FROM r""")
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two type names, or none, behind a part's name."""
    names = F.array(*map(F.lit, ("DRVR", "CODE", "STR#", "MENU", "xxxx")))
    at = lambda c: F.element_at(names, (F.col(c) % 5 + 1).cast("int"))
    content = F.encode(F.concat("p_name", at("p_size"), F.lit(". "), at("p_partkey")), "utf-8")
    return rom.markers(_images(table(spark, sf_dir, "part"), F.col("p_partkey"), content)).drop("context").withColumn("marker_id", F.col("marker_id").cast("long"))


@query("a24_pascal_strings", f"""
    WITH t AS (SELECT p_partkey, p_name || p_brand AS t, strlen(p_type) + 3 AS place FROM part),
    c AS (SELECT *, length(t) AS n, len(regexp_extract_all(t, '[!-/:-@\\[-`{{-~]')) AS marks FROM t)
    SELECT CAST(p_partkey AS VARCHAR) AS rom_id, CAST(place AS BIGINT) AS "offset", {BASE} + place AS address, t AS text,
        (72 + CASE WHEN n >= 8 THEN 8 ELSE 0 END + CASE WHEN n >= 16 THEN 5 ELSE 0 END + CASE WHEN marks = 0 THEN 4 ELSE 0 END) / 100 AS confidence FROM c""")
def pascal_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counted name behind a type that is not counted."""
    name = F.concat("p_name", "p_brand")
    content = F.concat(F.encode("p_type", "utf-8"), _zero(3), _be(F.length(name), 1), F.encode(name, "utf-8"), _zero(2))
    return rom.pascal_strings(_images(table(spark, sf_dir, "part"), F.col("p_partkey"), content)).select("rom_id", "offset", "address", "text", "confidence")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rom_id, text): a disassembly for each customer, one line an order, the first of them named."""
    key = F.col("o_orderkey")
    word = F.when(F.col("o_orderstatus") == "F", "jsr").when(F.col("o_orderstatus") == "O", "bra").otherwise("syscall")
    opcode = F.when(F.col("o_orderstatus") == "P", F.lpad(F.hex(0xA000 + key % 3 * 0x0400 + key % 200), 4, "0")).otherwise("4eb9")
    target = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" D0 /* "), F.lpad(F.hex(BASE + key % 50 * 2), 8, "0"), F.lit(" */"))).otherwise("")
    line = F.concat(F.lpad(F.hex(BASE + key * 2), 8, "0"), F.lit("  "), opcode, F.lit("  "), word, target)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("rom_id")).agg(F.concat(F.lit("entry:\n"), F.array_join(lines, "\n"), F.lit("\n; end")).alias("text"))


_LINES_SQL = f"""
    WITH i AS (SELECT CAST(o_custkey AS VARCHAR) AS rom_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_index, {BASE} + o_orderkey * 2 AS address,
                      CASE WHEN o_orderstatus = 'P' THEN lpad(to_hex(40960 + o_orderkey % 3 * 1024 + o_orderkey % 200), 4, '0') ELSE '4eb9' END AS opcode,
                      CASE o_orderstatus WHEN 'F' THEN 'jsr' WHEN 'O' THEN 'bra' ELSE 'syscall' END AS mnemonic,
                      CASE WHEN o_orderstatus <> 'P' THEN {BASE} + o_orderkey % 50 * 2 END AS target FROM orders),
    x AS (SELECT rom_id, address AS source, target, CASE mnemonic WHEN 'jsr' THEN 'call' ELSE 'branch' END AS kind, mnemonic, line_index AS line FROM i WHERE target < {BASE} + 90)"""


@query("a25_instructions", _LINES_SQL + "SELECT rom_id, 'entry' AS label, address, upper(opcode) AS opcode, mnemonic, line_index FROM i")
def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of listings: address, opcode, mnemonic, the last name before and the number."""
    found = rom.instructions(_listing(spark, sf_dir))
    return found.select("rom_id", "label", "address", F.upper("opcode").alias("opcode"), "mnemonic", F.col("line_index").cast("long").alias("line_index"))


@query("a26_traps", _LINES_SQL + """, t AS (SELECT rom_id, address, CAST('0x' || opcode AS BIGINT) & 4095 AS w FROM i WHERE mnemonic = 'syscall')
    SELECT DISTINCT rom_id, address, CAST(CASE WHEN w >= 2048 THEN w & 3071 ELSE w & 255 END AS INT) AS trap_number, CASE WHEN w >= 2048 THEN 'Toolbox' ELSE 'OS' END AS space FROM t""")
def traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rom.traps(rom.instructions(_listing(spark, sf_dir))).drop("confidence")


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("rom_id"), F.lit(BASE).cast("long").alias("base"), F.lit(90).cast("long").alias("bytes"))


@query("a27_xrefs", _LINES_SQL + f"""
    SELECT rom_id, source, target, kind, mnemonic, CAST(line AS INT) AS line, CAST(0.85 AS DOUBLE) AS confidence, 'disassembly-comment-target' AS origin FROM x
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), {BASE} + c_custkey * 4 + 4 * k, {BASE} + 2 * k, 'table', 'dc.l', 0, CAST(0.7 AS DOUBLE), 'pointer-table' FROM customer, (SELECT unnest(range(4)) AS k)""")
def xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of listings and of pointer tables."""
    targets = F.array(*[F.lit(BASE + 2 * k).cast("long") for k in range(4)])
    tables = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("rom_id"), (F.lit(BASE) + F.col("c_custkey") * 4).alias("address"), F.lit(0.7).alias("confidence"), targets.alias("targets"))
    return rom.xrefs(rom.instructions(_listing(spark, sf_dir)), _bounds(spark, sf_dir), tables)


@query("a28_functions", _LINES_SQL + f"""
    , c AS (SELECT rom_id, target AS address, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'branch') AS jumps, count(DISTINCT source) AS refs FROM x GROUP BY rom_id, target),
    s AS (SELECT *, 3 * calls + jumps + least(refs, 8) AS score FROM c WHERE calls > 0 OR 3 * calls + jumps + least(refs, 8) >= 3),
    e AS (SELECT *, coalesce(lead(address) OVER (PARTITION BY rom_id ORDER BY address), {BASE} + 90) AS nxt, lead(address) OVER (PARTITION BY rom_id ORDER BY address) AS following FROM s),
    n AS (SELECT e.rom_id, e.address, count(DISTINCT i.address) AS n FROM e LEFT JOIN i ON i.rom_id = e.rom_id AND i.address >= e.address AND (e.following IS NULL OR i.address < e.following) GROUP BY e.rom_id, e.address)
    SELECT rom_id, address, CASE WHEN n > 0 THEN nxt END AS end_address, calls, jumps, refs AS "references", n AS instruction_count,
        CASE WHEN n > 0 THEN least(0.95, least(0.95, 0.30 + score / 20) + 0.05) ELSE least(0.95, 0.30 + score / 20) END AS confidence,
        CASE WHEN n > 0 THEN 'bounded_by_next_candidate' ELSE 'unknown' END AS boundary_status FROM e JOIN n USING (rom_id, address)""")
def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function candidates with ends and instruction counts."""
    rows, bounds = rom.instructions(_listing(spark, sf_dir)), _bounds(spark, sf_dir)
    return rom.functions(rows, rom.xrefs(rows, bounds), bounds).drop("label")


@query("a29_lower_in_data", _LINES_SQL + f""",
    r AS (SELECT CAST(c_custkey AS VARCHAR) AS rom_id, {BASE} + c_custkey % 7 * 10 AS s, {BASE} + c_custkey % 7 * 10 + 20 AS e FROM customer),
    m AS (SELECT x.*, source >= s AND source < e AS a, target >= s AND target < e AS b FROM x JOIN r USING (rom_id))
    SELECT rom_id, source, target, line, CAST(CASE WHEN a THEN 0.35 WHEN b THEN 0.50 ELSE 0.85 END AS DOUBLE) AS confidence,
        'disassembly-comment-target' || CASE WHEN a THEN ':probable-data-source' WHEN b THEN ':probable-data-target' ELSE '' END AS origin FROM m""")
def lower_in_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References into or out of a data region are less sure."""
    start = F.lit(BASE).cast("long") + F.col("c_custkey") % 7 * 10
    regions = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("rom_id"), start.alias("start"), (start + 20).alias("end"))
    refs = rom.xrefs(rom.instructions(_listing(spark, sf_dir)), _bounds(spark, sf_dir))
    return rom.lower_in_data(refs, regions).select("rom_id", "source", "target", F.col("line").cast("long").alias("line"), "confidence", "origin")


@query("a30_resource_maps", f"""
    WITH n AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus) AS t, sum(strlen(CAST(l_suppkey AS VARCHAR)) + 4) AS d, sum(strlen(CAST(l_partkey AS VARCHAR)) + 2) AS l FROM lineitem GROUP BY l_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS rom_id, {BASE} + 8 AS address, {BASE} + 24 AS data_address, CAST(d AS BIGINT) AS data_length, CAST({BASE} + 24 + d AS BIGINT) AS map_address,
        CAST(28 + 2 + 8 * t + 12 * n + l AS BIGINT) AS map_length, n AS n_resources FROM n""")
def resource_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks inside images, eight bytes behind their start."""
    forks_ = _forks(spark, sf_dir)
    # forks leave a task whole, so they need not be dealt out
    images = forks_.select(F.col("file").alias("rom_id"), F.lit(BASE).cast("long").alias("base"), F.concat(F.lit(b"\xff" * 8), F.col("content")).alias("content"))
    return rom.resource_maps(images).drop("types", "confidence")


@query("a31_rom_resources", f"""
    SELECT CAST(p_partkey AS VARCHAR) AS rom_id, 'clut' AS type, p_size AS id, 'nm' AS name, {BASE} + 20 AS map_address, {BASE} + 40 AS address, CAST(strlen(p_name) AS BIGINT) AS length, 'inline' AS wrapper, sha256(p_name) AS data FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'snd ', p_size, 'k', {BASE} + 50 + strlen(p_name), {BASE} + 79 + strlen(p_name), CAST(strlen(p_type) AS BIGINT), 'Kurt', sha256(p_type) FROM part""")
def rom_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inline resource and a wrapped one in each image."""
    name, kind = F.encode("p_name", "utf-8"), F.encode("p_type", "utf-8")
    head = F.concat(F.lit(b"\xff" * 4), F.lit(b"\x78" + bytes(7)), _zero(4), _be(40, 4))
    inline = F.concat(F.lit(b"clut"), _be(F.col("p_size"), 2), _be(2, 2), F.lit(b"nm"), _zero(2), _be(F.octet_length(name), 4), _zero(4), name)
    wrapped = F.concat(F.lit(b"\xff" * 10), F.lit(b"snd "), _be(F.col("p_size"), 2), _be(1, 2), F.lit(b"k"), F.lit(b"kckc"), F.lit(b"Kurt"), _zero(4), _be(F.octet_length(kind), 4), _be(9, 4), kind, _zero(3))
    images = _images(table(spark, sf_dir, "part"), F.col("p_partkey"), F.concat(head, inline, wrapped))
    found = rom.inline_resources(images).unionByName(rom.wrapped_resources(images))
    return found.select("rom_id", "type", "id", "name", "map_address", "address", "length", "wrapper", F.sha2("data", 256).alias("data"))


# --- resources -------------------------------------------------------------------------------


@query("a32_pictures", """
    SELECT 'ICON' AS type, p_partkey AS id, 0 AS variant, 32 AS width, 32 AS height, repeat(lpad(to_hex(p_size), 2, '0'), 128) AS bits, NULL AS mask FROM part
    UNION ALL SELECT 'CURS', p_partkey, 0, 16, 16, repeat(lpad(to_hex(p_size), 2, '0'), 32), repeat('0F', 32) FROM part
    UNION ALL SELECT 'SICN', p_partkey, v, 16, 16, repeat('0' || v, 32), NULL FROM part, (SELECT unnest(range(3)) AS v)
    UNION ALL SELECT 'PAT#', p_partkey, v, 8, 8, repeat('1' || v, 8), NULL FROM part, (SELECT unnest(range(4)) AS v)""")
def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-bit pictures of four types."""
    byte = F.lpad(F.hex("p_size"), 2, "0")
    many = lambda head, n, size: F.unhex(F.concat(*[F.repeat(F.lit(f"{head}{v}"), F.lit(size)) for v in range(n)]))
    payloads = F.array(*[F.struct(F.lit(t).alias("type"), d.alias("data")) for t, d in (
        ("ICON", F.unhex(F.repeat(byte, F.lit(128)))), ("CURS", F.concat(F.unhex(F.repeat(byte, F.lit(32))), F.lit(b"\x0f" * 32), _zero(4))),
        ("SICN", many("0", 3, 32)), ("PAT#", F.concat(_be(4, 2), many("1", 4, 8))),
    )])
    made = table(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("id"), F.inline(payloads))
    return resources.pictures(made).select("type", "id", "variant", "width", "height", F.hex("bits").alias("bits"), F.hex("mask").alias("mask"))


def _payloads() -> dict[str, Column]:
    """type -> bytes made of a part."""
    size, key, name = F.col("p_size"), F.col("p_partkey") % 30000, F.encode("p_name", "utf-8")
    pascal = F.concat(_be(F.octet_length(name), 1), name)
    rect = F.concat(_be(1, 2), _be(2, 2), _be(size, 2), _be(key, 2))
    return {
        "STR#": F.concat(_be(2, 2), pascal, pascal),
        "RECT": rect,
        "pltt": F.concat(_be(1, 2), _zero(14), _be(size, 2), _be(key, 2), _be(3, 2), _zero(10)),
        "clut": F.concat(_be(key, 4), _be(size, 2), _be(0, 2), _be(1, 2), _be(2, 2), _be(3, 2), _be(4, 2)),
        "finf": F.concat(_be(1, 2), _be(key, 2), _be(-size, 2), _be(9, 2)),
        "styl": F.concat(_be(1, 2), _be(key, 4), _be(size, 2), _be(3, 2), _be(4, 2), _be(5, 1), _zero(1), _be(6, 2), _be(7, 2), _be(8, 2), _be(9, 2)),
        "FREF": F.concat(F.lit(b"APPL"), _be(size, 2), pascal),
        "KBDN": pascal,
        "TOOL": F.concat(_be(1, 2), _be(2, 2), _be(size, 2), _be(key, 2)),
        "TxSt": F.concat(_be(4, 1), _zero(1), _be(size, 2), _be(1, 2), _be(2, 2), _be(3, 2), pascal),
        "decl": F.concat(name, _zero(2)),
        "ALRT": F.concat(rect, _be(key, 2), _be(size, 2)),
        "WIND": F.concat(rect, _be(key, 2), _be(1, 2), _be(0, 2), _be(size, 4), pascal),
        "DLOG": F.concat(rect, _be(key, 2), _be(1, 1), _zero(1), _be(0, 1), _zero(1), _be(size, 4), _be(5, 2), pascal),
        "CNTL": F.concat(rect, _be(key, 2), _be(1, 1), _zero(1), _be(9, 2), _be(0, 2), _be(7, 2), _be(size, 4), pascal),
        "vers": F.concat(F.lit(b"\x01"), _be(0x35, 1), _be(0x80, 1), _be(size, 1), _be(3, 2), pascal, pascal),
        "FOND": F.concat(_be(1, 2), _be(key, 2), _be(2, 2), _be(size, 2), _be(3, 2), _be(-4, 2), _be(5, 2), _be(6, 2), _be(7, 4), _be(99, 4), _be(0, 4), _be(2, 2)),
        "MENU": F.concat(_be(key, 2), _zero(4), _be(size, 2), _zero(2), _be(3, 4), pascal, pascal, _be(1, 1), _be(75, 1), _be(2, 1), _be(4, 1), _zero(1)),
        "HCbg": F.concat(_be(1, 1), _be(key, 2), _be(2, 2), _be(size, 2), _be(3, 2), _be(4, 2), _be(128 + 3, 1), rect, _be(5, 2), _be(6, 2), _be(7, 2), _be(size, 2)),
        "HCcd": F.concat(_be(4, 1), rect, _be(1, 1), pascal, _be(2, 1), _be(size, 2), _be(-1, 2), _be(8, 2), _be(9, 2), _be(key, 2), _be(5, 1), rect, _zero(2)),
        "DITL": F.concat(_be(1, 2), _zero(4), rect, _be(4, 1), _be(F.octet_length(name), 1), _even(name), _zero(4), rect, _be(128 + 32, 1), _be(2, 1), _be(size, 2)),
    }


_BOUNDS = """'{"top":1,"left":2,"bottom":' || p_size || ',"right":' || k || '}'"""
#: type -> the JSON that must come out.
_JSON_SQL = {
    "STR#": """'{"strings":["' || p_name || '","' || p_name || '"]}'""",
    "RECT": _BOUNDS,
    "pltt": """'{"entries":[{"red":' || p_size || ',"green":' || k || ',"blue":3}]}'""",
    "clut": """'{"seed":' || k || ',"flags":' || p_size || ',"entries":[{"value":1,"red":2,"green":3,"blue":4}]}'""",
    "finf": """'{"entries":[{"fontId":' || k || ',"styleFlags":-' || p_size || ',"size":9}]}'""",
    "styl": """'{"runs":[{"offset":' || k || ',"lineHeight":' || p_size || ',"fontAscent":3,"fontId":4,"styleFlags":5,"fontSize":6,"color":{"red":7,"green":8,"blue":9}}]}'""",
    "FREF": """'{"fileType":"APPL","localId":' || p_size || ',"fileName":"' || p_name || '"}'""",
    "KBDN": """'{"name":"' || p_name || '"}'""",
    "TOOL": """'{"toolsPerRow":1,"rowCount":2,"cursorIds":[' || p_size || ',' || k || ']}'""",
    "TxSt": """'{"fontStyle":4,"fontSize":' || p_size || ',"textColor":{"red":1,"green":2,"blue":3},"fontName":"' || p_name || '"}'""",
    "decl": """'{"byteLength":' || strlen(p_name) + 2 || ',"prefixHex":"' || left(upper(hex(encode(p_name))) || '0000', 64) || '"}'""",
    "ALRT": """'{"bounds":' || """ + _BOUNDS + """ || ',"itemListId":' || k || ',"stages":' || p_size || '}'""",
    "WIND": """'{"bounds":' || """ + _BOUNDS + """ || ',"procId":' || k || ',"visible":true,"goAway":false,"refCon":' || p_size || ',"title":"' || p_name || '"}'""",
    "DLOG": """'{"bounds":' || """ + _BOUNDS + """ || ',"procId":' || k || ',"visible":true,"goAway":false,"refCon":' || p_size || ',"itemListId":5,"title":"' || p_name || '"}'""",
    "CNTL": """'{"bounds":' || """ + _BOUNDS + """ || ',"value":' || k || ',"visible":true,"maximum":9,"minimum":0,"procId":7,"refCon":' || p_size || ',"title":"' || p_name || '"}'""",
    "vers": """'{"majorVersion":1,"minorVersionBcd":53,"developmentStage":128,"prereleaseVersion":' || p_size || ',"regionCode":3,"versionNumber":"' || p_name || '","versionMessage":"' || p_name || '"}'""",
    "FOND": """'{"flags":1,"familyId":' || k || ',"firstChar":2,"lastChar":' || p_size || ',"ascent":3,"descent":-4,"leading":5,"maxWidth":6,"widthTableOffset":7,"kerningTableOffset":99,"styleMappingTableOffset":0,'
                    || '"hasVersion":true,"version":2,"widthTableFitsResource":true,"kerningTableFitsResource":false,"styleMappingTableFitsResource":true}'""",
    "MENU": """'{"menuId":' || k || ',"procId":' || p_size || ',"enabledFlags":3,"enabled":true,"title":"' || p_name || '","items":[{"name":"' || p_name || '","iconNumber":1,"keyEquivalent":75,"markCharacter":2,"styleFlags":4,"enabled":true}]}'""",
    "HCbg": """'{"targetKind":"background","targetId":' || p_partkey || ',"objects":[{"type":"button","hidden":false,"partId":' || k || ',"bevel":2,"color":{"red":' || p_size || ',"green":3,"blue":4}},'
                    || '{"type":"rect","hidden":true,"bevel":5,"rect":' || """ + _BOUNDS + """ || ',"color":{"red":6,"green":7,"blue":' || p_size || '}}]}'""",
    "HCcd": """'{"targetKind":"card","targetId":' || p_partkey || ',"objects":[{"type":"pictResource","hidden":false,"rect":' || """ + _BOUNDS + """ || ',"transparent":true,"name":"' || p_name || '"},'
                    || '{"type":"field","hidden":false,"partId":' || p_size || ',"bevel":-1,"color":{"red":8,"green":9,"blue":' || k || '}},{"type":"pictFile","hidden":false,"rect":' || """ + _BOUNDS + """ || ',"transparent":false}]}'""",
    "DITL": """'{"items":[{"bounds":' || """ + _BOUNDS + """ || ',"enabled":true,"kind":"button","rawType":4,"info":"' || p_name || '"},{"bounds":' || """ + _BOUNDS + """ || ',"enabled":false,"kind":"icon","rawType":160,"resourceId":' || p_size || '}]}'""",
}


def _converted_sql() -> str:
    return "WITH p AS (SELECT *, p_partkey % 30000 AS k FROM part) " + " UNION ALL ".join(f"SELECT '{kind}' AS type, p_partkey AS id, {sql} AS text FROM p" for kind, sql in _JSON_SQL.items())


@query("a33_converted", _converted_sql())
def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of many types, made of parts, as JSON."""
    payloads = F.array(*[F.struct(F.lit(kind).alias("type"), data.alias("data")) for kind, data in _payloads().items()])
    made = table(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("id"), F.lit("").alias("name"), F.inline(payloads))
    # dealt out: the parts are few bytes and so few tasks, what is made of them is much work
    return resources.convert(made.repartition("id", "type"), _JSON_SQL).where("format = 'json'").select("type", "id", "text")


@query("a34_compact_pixmaps", """
    WITH p AS (SELECT p_partkey AS k, p_size % 256 AS a, p_partkey % 256 AS b, ['FFFFFF', 'FCF305', 'FF6402', 'DD0806', 'F20884', '4600A5', '0000D4', '02ABEA', '1FB714', '006411', '562C05', '90713A', 'C0C0C0', '808080', '404040', '000000'] AS c FROM part)
    SELECT 2 * k AS id, 4 AS width, 1 AS height, 4 AS depth, c[a // 16 + 1] || 'FF' || c[a % 16 + 1] || 'FF' || c[b // 16 + 1] || 'FF' || c[b % 16 + 1] || 'FF' AS rgba FROM p
    UNION ALL SELECT 2 * k + 1, 1, 2, 8, repeat(lpad(to_hex(a), 2, '0'), 3) || 'FF' || repeat(lpad(to_hex(b), 2, '0'), 3) || 'FF' FROM p""")
def compact_pixmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pixels of a told depth and two of a depth that follows from the row, for each part."""
    a, b = _be(F.col("p_size") % 256, 1), _be(F.col("p_partkey") % 256, 1)
    told = F.concat(_be(2, 2), _zero(4), _be(1, 2), _be(4, 2), _be(4, 2), a, b)
    inferred = F.concat(_be(0x8001, 2), _zero(4), _be(2, 2), _be(1, 2), a, b)
    both = F.array(*[F.struct((2 * F.col("p_partkey") + i).alias("id"), d.alias("data")) for i, d in enumerate((told, inferred))])
    made = table(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.lit("pixs").alias("type"), F.inline(both))
    return resources.compact_pixmaps(made).select("id", "width", "height", "depth", F.hex("rgba").alias("rgba"))
