"""Named queries over the driver's tables, one or more for each operator, with their SQL.

Each entry is a Spark query and the DuckDB SQL for the same rows. The tables
stand in for archive data: texts are payloads, orders are import attempts, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, classify, text
from ..operators import relational
from ..sources import blocks
from . import scripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("q01_block_roundtrip", """
    WITH b AS (SELECT coalesce(source, '') AS file, lang AS type, doc_id AS id, strlen(text) + 12 AS size,
                      row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq,
                      coalesce(sum(strlen(text) + 12) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
               FROM documents)
    SELECT file, CAST(seq AS BIGINT) AS seq, rpad(type, 4, ' ') AS type, CAST(id AS BIGINT) AS id, CAST(place AS BIGINT) AS "offset",
           CAST(size AS BIGINT) AS size, CAST(size - 12 AS BIGINT) AS payload_bytes FROM b""")
def block_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts become block streams, one a source, and are scanned back."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("file"), "lang", "doc_id", "text")
    files = blocks.write_stream(docs, "file", F.col("lang"), F.col("doc_id"), F.encode("text", "utf-8"), "doc_id")
    found = blocks.scan_blocks(files, payloads=False).where("status = 'ok'")
    return found.select("file", F.col("seq").cast("long"), "type", F.col("id").cast("long"), "offset", "size", "payload_bytes")


@query("q02_chunk_type_counts", """
    SELECT l_returnflag, count(*) AS chunk_count, count(DISTINCT l_orderkey) AS stack_count,
           CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS understood_count,
           CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS not_understood_count,
           CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS parsed_count,
           CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS skipped_count,
           CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discounted_count,
           CAST(sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS untaxed_count,
           CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS total_quantity,
           string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag""")
def chunk_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest report shape: join, counts, distinct and conditional counts, a sum and a sorted list."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_returnflag").agg(
        F.count("*").alias("chunk_count"), F.count_distinct("l_orderkey").alias("stack_count"),
        F.count_if(F.col("l_linestatus") == "O").alias("understood_count"), F.count_if(F.col("l_linestatus") == "F").alias("not_understood_count"),
        F.count_if(F.col("o_orderstatus") == "P").alias("parsed_count"), F.count_if(F.col("o_orderstatus") == "O").alias("skipped_count"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted_count"), F.count_if(F.col("l_tax") == 0).alias("untaxed_count"),
        F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("total_quantity"), relational.sorted_list("o_orderpriority").alias("priorities"),
    )


@query("q03_chunk_usage", """
    SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS stack_count,
           string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def chunk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count("*").alias("stack_count"), relational.sorted_list("o_orderpriority").alias("priorities")
    )


@query("q04_embedded_file_usage", """
    SELECT lang, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes, count(*) AS occurrence_count,
           string_agg(DISTINCT source, ',' ORDER BY source) AS sources
    FROM documents GROUP BY lang, text""")
def embedded_file_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal payloads: hashed first, so the shuffle carries digests and not texts."""
    docs = table(spark, sf_dir, "documents")
    hashed = docs.select("lang", F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), "source")
    return hashed.groupBy("lang", "sha256", "bytes").agg(F.count("*").alias("occurrence_count"), relational.sorted_list("source").alias("sources"))


@query("q05_external_usage", """
    SELECT p_brand, p_type, count(*) AS occurrence_count, count(DISTINCT p_name) AS distinct_names,
           CAST(sum(coalesce(p_size, 0)) AS BIGINT) AS total_size, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names
    FROM part GROUP BY p_brand, p_type""")
def external_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(
        F.count("*").alias("occurrence_count"), F.count_distinct("p_name").alias("distinct_names"),
        F.sum(F.coalesce("p_size", F.lit(0))).alias("total_size"), relational.sorted_list("p_name").alias("names"),
    )


@query("q06_summary_left_join", """
    SELECT c_custkey, c_name, c_mktsegment, o_orderkey, o_orderstatus, o_orderpriority
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def summary_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", "c_name", "c_mktsegment", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("q07_unindexed_anti", """
    SELECT doc_id, source, lang FROM documents d
    WHERE source ILIKE 'SRC1%' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unindexed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("source").ilike("SRC1%"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "lang")


LINES_SQL = r"""
    lines AS (SELECT doc_id, i AS line, trim(p[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
              FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
                    FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS p FROM documents)))"""
CONTROL_SQL = ", ".join(f"'{w}'" for w in text.CONTROL_WORDS)


@query("q08_script_calls", rf"""
    WITH {LINES_SQL},
    words AS (SELECT lower(regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*')) AS command FROM lines WHERE text != '' AND NOT starts_with(text, '--'))
    SELECT command, count(*) AS n FROM words WHERE command != '' AND command NOT IN ({CONTROL_SQL}) GROUP BY command""")
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls over all scripts, control words left out."""
    return scripts.call_counts(scripts.statements(table(spark, sf_dir, "documents"), ["doc_id"], "text"))


@query("q09_first_occurrence", rf"""
    WITH {LINES_SQL},
    words AS (SELECT doc_id, line, lower(regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*')) AS command FROM lines WHERE text != '' AND NOT starts_with(text, '--'))
    SELECT doc_id, command, CAST(min(line) AS BIGINT) AS line FROM words WHERE command != '' AND command NOT IN ({CONTROL_SQL}) GROUP BY doc_id, command""")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First call of each command in each script."""
    lines = scripts.statements(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    first = scripts.first_of(scripts.calls(lines), ["doc_id", "command"], ["line"])
    return first.select("doc_id", "command", F.col("line").cast("long").alias("line"))


_PHRASES = ("playQT the clip", "start using stack that", "look in stack this", "go card 3", "Go To Card last", "play sound boing", "htAddPict here", "show picture it", "put it into x", "answer it")
_ENDINGS = (".MOV", " moov", "", ".pict", "", "", "")


@query("q10_reference_kinds", f"""
    WITH t AS (SELECT lower({[*_PHRASES]}[p_size % 10 + 1]) AS html, lower(p_name || {[*_ENDINGS]}[p_partkey % 7 + 1]) AS url FROM part),
    k AS (SELECT CASE
        WHEN contains(html, 'playqt') OR contains(html, 'movie') OR contains(url, '.mov') OR contains(url, ' moov') OR contains(url, ' mov') THEN 'movie'
        WHEN contains(html, 'start using stack') OR contains(html, ' in stack ') THEN 'stack'
        WHEN contains(html, 'go card') OR contains(html, 'go to card') THEN 'card'
        WHEN contains(html, 'sound') THEN 'sound'
        WHEN contains(html, 'htaddpict') OR contains(html, 'htchangepict') OR contains(html, 'picture') THEN 'picture'
        ELSE 'none' END AS kind FROM t)
    SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script lines and literals made of parts, by what they refer to."""
    line = F.element_at(F.array(*map(F.lit, _PHRASES)), F.col("p_size") % 10 + 1)
    literal = F.concat("p_name", F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % 7 + 1).cast("int")))
    kind = text.reference_kind(text.ascii_lower(line), text.ascii_lower(literal))
    return table(spark, sf_dir, "part").select(F.coalesce(kind, F.lit("none")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("q11_asof_label", """
    WITH v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
    SELECT p.event_id, p.user_id, v.event_id AS view_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest view of its user at or before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return relational.asof_join(bought, viewed, ["user_id"], "ts", ["view_id"]).select("event_id", "user_id", "view_id")


@query("q12_interval_confidence", """
    WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS s FROM events),
    w AS (SELECT user_id, s AS w_start, s + 3600 AS w_end FROM e WHERE event_type = 'error')
    SELECT event_id, value, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.user_id = e.user_id AND e.s >= w_start AND e.s < w_end)
           THEN least(value, 5.0) ELSE value END AS capped FROM e""")
def interval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values inside an hour after an error of the same user are capped."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    spans = events.where("event_type = 'error'").select("user_id", F.col("s").alias("start"), (F.col("s") + 3600).alias("end"))
    marked = relational.inside_any(events, spans, "s", "start", "end", 3600, ["user_id"], "inside")
    capped = F.when(F.col("inside"), F.least("value", F.lit(5.0))).otherwise(F.col("value"))
    return marked.select("event_id", "value", capped.alias("capped"))


@query("q13_function_bounds", """
    WITH s AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders)
    SELECT o_custkey, o_orderkey, nxt AS next_order, count(l_orderkey) AS lines
    FROM s LEFT JOIN lineitem ON l_orderkey >= o_orderkey AND l_orderkey < least(coalesce(nxt, o_orderkey + 50), o_orderkey + 50)
    GROUP BY o_custkey, o_orderkey, nxt""")
def function_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next start of each customer bounds a range of keys; lines are counted inside (50 keys at most)."""
    from pyspark.sql import Window

    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    starts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", following.alias("next_order"))
    starts = starts.withColumn("end", F.least(F.coalesce("next_order", F.col("o_orderkey") + 50), F.col("o_orderkey") + 50))
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    hits = relational.interval_join(counted, starts.select("o_orderkey", "end"), "l_orderkey", "o_orderkey", "end", 50)
    lines = hits.groupBy("o_orderkey").agg(F.sum("n").alias("lines"))
    return starts.join(lines, "o_orderkey", "left").select("o_custkey", "o_orderkey", "next_order", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("q14_string_clusters", """
    WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value) AS BIGINT) AS t FROM events),
    f AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e),
    g AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached + 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, CAST(min(s) AS BIGINT) AS start_s, CAST(max(t) AS BIGINT) AS end_s, count(*) AS n FROM g GROUP BY user_id, island HAVING count(*) >= 3""")
def string_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three events of a user without a long pause."""
    events = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"), F.floor("value").cast("long").alias("v"))
    marked = relational.islands(events.withColumn("t", F.col("s") + F.col("v")), ["user_id"], "s", "t", 20000)
    return marked.groupBy("user_id", "island").agg(F.min("s").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("n")).where("n >= 3").drop("island")


@query("q15_source_overlay", """
    WITH h AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
    SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (ORDER BY item_id, doc_id) AS n FROM h) WHERE n <= 250""")
def source_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text, the first 250 (a top-k report)."""
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    hits = relational.contains_join(table(spark, sf_dir, "documents").select("doc_id", "text"), needles, "text", "needle")
    return hits.select("item_id", "doc_id").orderBy("item_id", "doc_id").limit(250)


@query("q16_function_scores", """
    WITH x AS (SELECT l_linestatus AS rom_id, l_partkey AS address, l_suppkey AS source, CASE WHEN l_linenumber = 7 THEN 'table' WHEN l_returnflag = 'R' THEN 'call' ELSE 'branch' END AS kind,
                      CASE l_returnflag WHEN 'R' THEN 'jsr' WHEN 'A' THEN 'bra' ELSE 'move' END AS mnemonic FROM lineitem),
    c AS (SELECT rom_id, address, count(*) FILTER (WHERE kind = 'call') AS calls, count(*) FILTER (WHERE kind <> 'call' AND mnemonic = 'bra') AS jumps,
                 count(DISTINCT source) AS refs FROM x WHERE kind <> 'table' GROUP BY rom_id, address)
    SELECT rom_id, address, calls, jumps, refs, 3 * calls + jumps + least(refs, 8) AS score,
           least(0.95, 0.30 + (3 * calls + jumps + least(refs, 8)) / 20) AS confidence
    FROM c WHERE calls > 0 OR 3 * calls + jumps + least(refs, 8) >= 3""")
def function_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as references from suppliers to parts."""
    from . import rom

    kind = F.when(F.col("l_linenumber") == 7, "table").when(F.col("l_returnflag") == "R", "call").otherwise("branch")
    mnemonic = F.when(F.col("l_returnflag") == "R", "jsr").when(F.col("l_returnflag") == "A", "bra").otherwise("move")
    refs = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("rom_id"), F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("source"), kind.alias("kind"), mnemonic.alias("mnemonic")
    )
    return rom.function_scores(refs)


@query("q17_xref_dedup", """
    WITH x AS (SELECT l_linestatus AS rom_id, l_orderkey AS source, l_partkey AS target, CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'branch' ELSE 'memory' END AS kind, l_linenumber AS line FROM lineitem),
    b AS (SELECT r_name AS rom_id, 2 AS base, 100 + r_regionkey AS bytes FROM region UNION ALL SELECT 'O', 5, 900 UNION ALL SELECT 'F', 0, 400)
    SELECT DISTINCT x.rom_id, source, target, kind, line, CAST(CASE WHEN kind = 'memory' THEN 0.60 ELSE 0.85 END AS DOUBLE) AS confidence, 'disassembly-comment-target' AS origin
    FROM x JOIN b ON b.rom_id = x.rom_id WHERE target >= base AND target < base + bytes""")
def xref_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as instructions that name a part as their target; those outside the image are no references."""
    from . import rom

    mnemonic = F.when(F.col("l_returnflag") == "R", "jsr").when(F.col("l_returnflag") == "A", "bne").otherwise("lea")
    noted = F.concat(F.lit("D0 /* "), F.lpad(F.hex("l_partkey"), 8, "0"), F.lit(" */"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("rom_id"), F.col("l_linenumber").alias("line_index"), F.col("l_orderkey").alias("address"), mnemonic.alias("mnemonic"), noted.alias("operands")
    )
    bounds = table(spark, sf_dir, "region").select(F.col("r_name").alias("rom_id"), F.lit(2).alias("base"), (100 + F.col("r_regionkey")).alias("bytes"))
    bounds = bounds.union(spark.createDataFrame([("O", 5, 900), ("F", 0, 400)], "rom_id string, base int, bytes int"))
    return rom.xrefs(rows, bounds).drop("mnemonic")


@query("q18_missing_references", """
    WITH b AS (SELECT CASE WHEN p_size < 25 THEN 'R' ELSE 'N' END AS file, 'PART' AS type, p_partkey AS id FROM part)
    SELECT l_returnflag AS file, 'PART' AS type, l_partkey - 3 AS id, 'line ' || l_linenumber AS field, count(*) AS n FROM lineitem l
    WHERE l_partkey - 3 >= 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.file = l_returnflag AND b.id = l_partkey - 3) GROUP BY ALL""")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name parts which the file of that name lacks."""
    held = table(spark, sf_dir, "part").select(F.when(F.col("p_size") < 25, "R").otherwise("N").alias("file"), F.lit("PART").alias("type"), F.col("p_partkey").alias("id"))
    named = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("file"), F.lit("PART").alias("type"), (F.col("l_partkey") - 3).alias("id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("field")
    )
    return blocks.missing_references(held, named).groupBy("file", "type", "id", "field").agg(F.count("*").alias("n"))


@query("q19_scalar_subquery_link", """
    SELECT c_custkey AS id, coalesce((SELECT 'media:' || o_orderpriority FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1),
        (SELECT o_orderpriority || ':' || o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1), c_mktsegment) AS referenced_by FROM customer""")
def scalar_subquery_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refers to a file first: pending orders stand for media, all orders for contents."""
    from . import warehouse

    outputs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("referenced_by"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("output_file_id"), "o_orderstatus", "o_orderpriority")
    # what is not pending refers to no file that there is
    file = F.when(F.col("o_orderstatus") == "P", F.col("output_file_id")).otherwise(-F.col("output_file_id"))
    media = orders.withColumn("output_file_id", file).withColumnRenamed("o_orderpriority", "rel_path")
    contents = orders.select("id", "output_file_id", F.col("o_orderpriority").alias("container_kind"), F.col("id").alias("container_id"))
    return warehouse.link_references(outputs, media, contents)


@query("q20_stack_statistics", """
    WITH w AS (SELECT c_nationkey, count(*) AS customers, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, CAST(sum(length(c_name)) AS BIGINT) AS name_chars
               FROM customer GROUP BY c_nationkey)
    SELECT c_nationkey, 'customers' AS metric, '' AS detail, customers AS value FROM w UNION ALL SELECT c_nationkey, 'in_debt', '', in_debt FROM w
    UNION ALL SELECT c_nationkey, 'name_chars', '', name_chars FROM w
    UNION ALL SELECT c_nationkey, 'segment', coalesce(c_mktsegment, ''), count(*) FROM customer GROUP BY c_nationkey, c_mktsegment""")
def stack_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    metrics = {"customers": F.count("*"), "in_debt": F.count_if(F.col("c_acctbal") < 0), "name_chars": F.sum(F.length("c_name"))}
    return relational.unpivot(rows, ["c_nationkey"], metrics).unionByName(relational.grouped_counts(rows, ["c_nationkey"], "segment", F.col("c_mktsegment")))


@query("q21_conditional_classify", """
    WITH f AS (SELECT c_custkey AS id, CASE c_nationkey % 5 WHEN 0 THEN 'STAK' WHEN 1 THEN 'APPL' WHEN 2 THEN 'MYag' ELSE '' END AS finder,
                      CASE WHEN c_nationkey > 12 THEN 'Myst Files/' ELSE 'x/' END || c_name || CASE c_custkey % 3 WHEN 0 THEN '.stak' WHEN 1 THEN '.Txt' ELSE '' END AS path,
                      CASE WHEN c_acctbal > 2000 THEN 'STAK' ELSE 'TEXT' END AS kind, CAST(c_acctbal AS BIGINT) AS held, CAST(5000 AS BIGINT) AS size FROM customer)
    SELECT id, CASE WHEN finder = 'STAK' OR finder = 'MYag' AND path LIKE 'Myst Files/%' THEN 'stack' WHEN finder IN ('APPL', 'MYag') THEN 'skip'
                    WHEN kind = 'STAK' AND held BETWEEN 12 AND size THEN 'stack' WHEN path LIKE '%.stak' THEN 'stack' ELSE 'skip' END AS decision,
           CASE WHEN finder = 'STAK' OR finder = 'MYag' AND path LIKE 'Myst Files/%' THEN 'finder_type_stack_like' WHEN finder = 'APPL' THEN 'finder_type_application'
                WHEN finder = 'MYag' THEN 'myst_resource_sidecar' WHEN kind = 'STAK' AND held BETWEEN 12 AND size THEN 'binary_stak_header' WHEN path LIKE '%.stak' THEN 'stack_extension'
                WHEN kind = 'STAK' THEN 'binary_stak_header_size_mismatch' ELSE 'unrecognized' END AS reason FROM f""")
def conditional_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, by the ordered rules for stacks."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    finder = F.when(nation % 5 == 0, "STAK").when(nation % 5 == 1, "APPL").when(nation % 5 == 2, "MYag").otherwise("")
    path = F.concat(F.when(nation > 12, "Myst Files/").otherwise("x/"), "c_name", F.when(key % 3 == 0, ".stak").when(key % 3 == 1, ".Txt").otherwise(""))
    kind = F.when(F.col("c_acctbal") > 2000, "STAK").otherwise("TEXT")
    said = classify.stack_decision(finder, path, kind, F.rint("c_acctbal").cast("long"), F.lit(5000).cast("long"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), said["decision"].alias("decision"), said["reason"].alias("reason"))


NULLABLE_SQL = "SELECT doc_id, NULLIF(lang, 'en') AS lang, source FROM documents"


@query("q22_null_safe_except", f"""
    WITH a AS ({NULLABLE_SQL}), b AS (SELECT lang, source FROM a JOIN labels USING (doc_id) WHERE quality = 0)
    SELECT doc_id, lang, source FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source)""")
def null_safe_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose (lang, source) no row of another set has, where null equals null."""
    left = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "source")
    right = left.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id").select("lang", "source")
    return relational.anti_null_safe(left, right, ["lang", "source"])


@query("q23_upsert_latest", """
    WITH u AS (SELECT c_custkey AS k, c_name AS v, 0 AS late, 0 AS seq FROM customer
               UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END, o_orderpriority, 1, o_orderkey FROM orders)
    SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY late DESC, seq DESC) AS n FROM u) WHERE n = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).cast("long").alias("seq"))
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    changes = table(spark, sf_dir, "orders").select(key.alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("seq"))
    return relational.upsert(base, changes, ["k"], "seq").select("k", "v")


@query("q24_json_sections", """
    SELECT event_id, 0 AS depth, '$' AS tag, CAST(0 AS BIGINT) AS text_size FROM events
    UNION ALL SELECT event_id, 1, key, CAST(length(json_extract_string(props, '$.' || key)) AS BIGINT)
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def json_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of JSON documents in pre-order: the root, then its members."""
    from .json_tree import walk

    nodes = walk(table(spark, sf_dir, "events").select("event_id", "props"), ["event_id"], "props")
    return nodes.select("event_id", "depth", "tag", "text_size")


@query("q25_union_gaps", """
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE n_chars < 500),
         b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
    SELECT source, 'short' AS kind, doc_id FROM a WHERE n <= 10 UNION ALL SELECT source, 'longest', doc_id FROM b WHERE n <= 10
    UNION ALL SELECT DISTINCT source, 'phase', CAST(-1 AS BIGINT) FROM documents""")
def union_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten short and the ten longest of each source, and a row for the source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    short = relational.capped(docs.where("n_chars < 500"), ["source"], ["doc_id"], 10).select("source", F.lit("short").alias("kind"), "doc_id")
    long = relational.capped(docs, ["source"], [F.desc("n_chars"), "doc_id"], 10).select("source", F.lit("longest").alias("kind"), "doc_id")
    phase = docs.select("source").distinct().select("source", F.lit("phase").alias("kind"), F.lit(-1).cast("long").alias("doc_id"))
    return short.unionByName(long).unionByName(phase)


@query("q26_hashes", "SELECT doc_id, upper(sha256(text)) AS sha256, substr(sha1(text), 1, 12) AS stem, 'rom-' || substr(sha256(text), 1, 12) AS rom_id, CASE WHEN doc_id < 4294967296 THEN upper(lpad(to_hex(doc_id), 8, '0')) END AS address FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "utf-8")
    return table(spark, sf_dir, "documents").select(
        "doc_id", binary.sha256_upper(data).alias("sha256"), binary.short_sha1(F.col("text")).alias("stem"), binary.rom_id(data).alias("rom_id"),
        binary.address(F.col("doc_id")).alias("address"),
    )


@query("q26_crc", """
    WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents)
    SELECT doc_id, upper(lpad(to_hex(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)), 8, '0')) AS crc32 FROM b, t""")
def crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 as hex; the SQL goes through its table of 256 remainders byte by byte."""
    return table(spark, sf_dir, "documents").select("doc_id", binary.crc32_hex(F.encode("text", "utf-8")).alias("crc32"))


@query("q27_ascii_strings", r"""
    WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\x20-\x7E]{6,}')) AS s FROM documents),
    c AS (SELECT doc_id, s, length(s) AS n, len(regexp_extract_all(s, '[A-Za-z]')) AS alpha, len(regexp_extract_all(s, '[A-Za-z0-9]')) AS alnum,
                 len(regexp_extract_all(s, '[!-/:-@\[-`{-~]')) AS marks FROM p)
    SELECT doc_id, count(*) AS n_strings, CAST(sum(n) AS BIGINT) AS chars,
           CAST(sum(65 + CASE WHEN n >= 8 THEN 8 ELSE 0 END + CASE WHEN n >= 16 THEN 5 ELSE 0 END + CASE WHEN marks = 0 THEN 4 ELSE 0 END) AS BIGINT) AS percent
    FROM c WHERE alnum > 0 GROUP BY doc_id""")
def ascii_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable runs of texts, judged for plausibility."""
    runs = F.regexp_extract_all("text", F.lit(r"[\x20-\x7E]{6,}"), F.lit(0))
    judged = F.transform(runs, lambda s: F.struct(F.length(s).cast("long").alias("n"), F.round(text.string_confidence(s, F.lit(False)) * 100).cast("long").alias("percent")))
    # a document's runs are summed in its own row
    kept = table(spark, sf_dir, "documents").select("doc_id", F.filter(judged, lambda x: x["percent"].isNotNull()).alias("kept")).where("size(kept) > 0")
    total = lambda name: F.aggregate(F.transform("kept", lambda x: x[name]), F.lit(0).cast("long"), lambda a, x: a + x)
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_strings"), total("n").alias("chars"), total("percent").alias("percent"))


@query("q28_call_audit", r"""
    WITH t AS (SELECT page_id, lang_of AS lang, lower(tag) AS mnemonic
               FROM (SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang_of, unnest(regexp_extract_all(html, '<([A-Za-z]+)', 1)) AS tag FROM pages)),
    k AS (SELECT *, CASE WHEN mnemonic IN ('a', 'link') THEN 'branch_link' WHEN mnemonic IN ('script', 'style') THEN 'system_call' ELSE 'control_transfer' END AS call_kind FROM t)
    SELECT lang, call_kind, mnemonic, count(*) AS occurrence_count, count(DISTINCT page_id) AS resource_count FROM k GROUP BY lang, call_kind, mnemonic""")
def call_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z]+)"), F.lit(1))).alias("tag")
    )
    mnemonic = F.lower("tag")
    kind = F.when(mnemonic.isin("a", "link"), "branch_link").when(mnemonic.isin("script", "style"), "system_call").otherwise("control_transfer")
    return tags.select("page_id", "lang", kind.alias("call_kind"), mnemonic.alias("mnemonic")).groupBy("lang", "call_kind", "mnemonic").agg(
        F.count("*").alias("occurrence_count"), F.count_distinct("page_id").alias("resource_count")
    )


@query("q29_two_key_fallback", """
    WITH s AS (SELECT l_orderkey AS a, CASE WHEN l_linenumber < 4 THEN l_partkey % 7 ELSE -1 - l_partkey % 7 END AS b, l_linenumber AS c, l_suppkey, l_orderkey * 10 + l_linenumber + l_suppkey / 1e6 AS o FROM lineitem),
    r AS (SELECT a, b, c, max_by(l_suppkey, o) AS v FROM s GROUP BY ALL), p AS (SELECT a, b, max_by(l_suppkey, o) AS v FROM s GROUP BY ALL)
    SELECT l_orderkey AS a, l_partkey % 7 AS b, l_linenumber AS c, coalesce(r.v, p.v) AS v FROM lineitem l
    LEFT JOIN r ON r.a = l_orderkey AND r.b = l_partkey % 7 AND r.c = l_linenumber LEFT JOIN p ON p.a = l_orderkey AND p.b = l_partkey % 7""")
def two_key_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match on three keys, else on two; the last of several counts."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") % 7).alias("b"), F.col("l_linenumber").alias("c"), F.col("l_suppkey").alias("v"))
    right = lines.withColumn("b", F.when(F.col("c") < 4, F.col("b")).otherwise(-1 - F.col("b"))).withColumn("at", F.col("a") * 10 + F.col("c") + F.col("v") / 1e6)
    return relational.two_step_lookup(lines.select("a", "b", "c"), right, ["a", "b", "c"], ["a", "b"], "v", "at").select("a", "b", "c", "v")


@query("q30_bit_flags", """
    SELECT p_partkey, array_to_string([x FOR x IN [CASE WHEN p_size & 64 != 0 THEN 'system_heap' END, CASE WHEN p_size & 32 != 0 THEN 'purgeable' END,
        CASE WHEN p_size & 16 != 0 THEN 'locked' END, CASE WHEN p_size & 8 != 0 THEN 'protected' END, CASE WHEN p_size & 4 != 0 THEN 'preload' END,
        CASE WHEN p_size & 2 != 0 THEN 'changed' END, CASE WHEN p_size & 1 != 0 THEN 'compressed' END] IF x IS NOT NULL], ',') AS attributes FROM part""")
def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = binary.set_bits(F.col("p_size"), binary.RESOURCE_ATTRIBUTES)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, ",").alias("attributes"))


@query("q31_macroman", f"""
    WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents)
    SELECT doc_id, array_to_string(list_transform(b, lambda x: CASE WHEN x < 128 THEN chr(CAST(x AS INT)) ELSE {[*binary.MAC_UPPER]}[x - 127] END), '') AS mac_text, true AS same FROM b""")
def macroman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 bytes read as Mac text and back."""
    data = F.encode("text", "utf-8")
    mac = binary.mac_text(data)
    return table(spark, sf_dir, "documents").select("doc_id", mac.alias("mac_text"), (binary.mac_bytes(mac) == data).alias("same"))


@query("q34_output_classes", """
    SELECT name, CASE WHEN name LIKE '%.json' THEN 'json' WHEN name LIKE '%.png' THEN 'image' WHEN name LIKE '%.wav' THEN 'sound' WHEN name LIKE '%.data' THEN 'raw' ELSE 'assembly' END AS kind,
           CASE WHEN name LIKE 'card%' THEN 'card' WHEN name LIKE 'x%' THEN 'externalcommand' ELSE 'bmap' END AS logical_kind, CAST(id AS BIGINT) AS logical_id
    FROM (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'card_' || doc_id || '.json' WHEN 1 THEN 'BMAP_' || doc_id || '.png' WHEN 2 THEN 'BMAP_' || doc_id || '.wav'
          WHEN 3 THEN 'BMAP_' || doc_id || '.data' ELSE 'x_XCMD_mac68k_' || doc_id || '_a.s' END AS name FROM documents)""")
def output_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package files classified by their names."""
    n = F.col("doc_id").cast("string")
    names = {0: ("card_", ".json"), 1: ("BMAP_", ".png"), 2: ("BMAP_", ".wav"), 3: ("BMAP_", ".data")}
    name = F.concat(F.lit("x_XCMD_mac68k_"), n, F.lit("_a.s"))
    for k, (head, tail) in names.items():
        name = F.when(F.col("doc_id") % 5 == k, F.concat(F.lit(head), n, F.lit(tail))).otherwise(name)
    rows = table(spark, sf_dir, "documents").select(name.alias("name"))
    what = classify.logical_file(F.col("name"))
    return rows.select("name", classify.output_kind(F.col("name")).alias("kind"), what["kind"].alias("logical_kind"), what["id"].alias("logical_id"))


@query("q32_resource_convert", """
    SELECT source AS file, 'TEXT' AS type, CAST(doc_id AS INT) AS id, 'text' AS format, md5(text) AS text FROM documents
    UNION ALL SELECT source, 'MBAR', CAST(doc_id AS INT), 'json', '{"menuIds":[' || doc_id % 100 || ',' || -(doc_id % 7) || ']}' FROM documents""")
def resource_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts and made menu bars as resources, converted."""
    from . import resources

    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id", "text", F.col("doc_id").cast("int").alias("id"), F.lit("").alias("name"))
    number = lambda c: F.unhex(F.lpad(F.hex(F.pmod(c, F.lit(65536))), 4, "0"))
    bar = F.concat(number(F.lit(2)), number(F.col("doc_id") % 100), number(-(F.col("doc_id") % 7)))
    payloads = F.array(
        F.struct(F.lit("TEXT").alias("type"), F.encode(F.md5(F.encode("text", "utf-8")), "utf-8").alias("data")), F.struct(F.lit("MBAR").alias("type"), bar.alias("data"))
    )
    made = docs.select("file", "id", "name", F.inline(payloads))
    return resources.convert(made, ("TEXT", "MBAR")).where("format != 'native'").select("file", "type", "id", "format", "text")


@query("q33_rom_scan", r"""
    WITH p AS (SELECT doc_id, text, string_split_regex(text, '[^\x20-\x7E]') AS p FROM documents),
    s AS (SELECT doc_id, text, i, p[i] AS t FROM (SELECT doc_id, text, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
    o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM s),
    c AS (SELECT *, len(regexp_extract_all(t, '[A-Za-z]')) AS alpha, len(regexp_extract_all(t, '[A-Za-z0-9]')) AS alnum, len(regexp_extract_all(t, '[!-/:-@\[-`{-~]')) AS marks FROM o WHERE length(t) >= 4)
    SELECT CAST(doc_id AS VARCHAR) AS rom_id, CAST(strlen(left(text, CAST(place AS BIGINT))) AS BIGINT) AS "offset", t AS text
    FROM c WHERE alnum > 0 AND NOT (length(t) < 6 AND alpha < 3) AND NOT (length(t) <= 5 AND marks > 1)""")
def rom_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as firmware images: printable strings with their byte offsets."""
    from . import rom

    base = F.lit(0x40800000).cast("long").alias("base")
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rom_id"), base, F.encode("text", "utf-8").alias("content"))
    return rom.ascii_strings(images).select("rom_id", "offset", "text")


@query("q35_fork_round_trip", """
    SELECT CAST(p_partkey AS VARCHAR) AS file, 'STR ' AS type, p_size AS id, p_name AS name, CAST(strlen(p_name) AS BIGINT) AS payload_bytes, 'ok' AS status FROM part""")
def fork_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a resource fork of one resource, read back; its name and size must return."""
    from ..sources import resfork

    name = F.encode("p_name", "utf-8")
    number = lambda c, n: F.unhex(F.lpad(F.hex(F.pmod(c.cast("long"), F.lit(1 << (4 * n)))), n, "0"))
    data = F.concat(number(F.octet_length(name), 8), name)
    types = F.concat(number(F.lit(0), 4), F.lit(b"STR "), number(F.lit(0), 4), number(F.lit(10), 4), number(F.col("p_size"), 4), number(F.lit(0), 4), number(F.lit(0), 8), number(F.lit(0), 8))
    label = F.concat(number(F.octet_length(name), 2), name)
    body = F.concat(F.lit(bytes(24)), number(F.lit(28), 4), number(F.lit(28) + F.octet_length(types), 4), types, label)
    fork = F.concat(number(F.lit(16), 8), number(F.lit(16) + F.octet_length(data), 8), number(F.octet_length(data), 8), number(F.octet_length(body), 8), data, body)
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), fork.alias("content")).repartition("file")
    return resfork.read_forks(files).select("file", "type", "id", "name", "payload_bytes", "status")
