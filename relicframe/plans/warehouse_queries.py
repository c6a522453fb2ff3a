"""Text, classifier, log and warehouse operators as driver queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, classify, text
from . import packages, rom, scripts, warehouse
from .driver_queries import query, table


def _pick(key: str, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


# --- text functions --------------------------------------------------------------------------


@query("w01_text_functions", r"""
    WITH t AS (SELECT p_partkey AS id, chr(9) || upper(p_name) || ' "a""b" x "' || p_brand || chr(10) AS t FROM part)
    SELECT id, lower(t) AS lower_text, trim(t, chr(9) || chr(10) || ' ') AS trimmed, regexp_extract(t, '[A-Za-z_][A-Za-z0-9_]*') AS word,
        'a"b' || chr(30) || regexp_extract(t, 'x "([^"]*)$', 1) AS literals, replace(replace(t, chr(9), ' '), chr(10), ' ') AS cell, CAST(1 AS BIGINT) AS lines, left(t, 9) AS sample,
        regexp_replace(t, '["\x00-\x1F]', '_', 'g') AS safe FROM t""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("\t"), F.upper("p_name"), F.lit(' "a""b" x "'), "p_brand", F.lit("\n"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), made.alias("t"))
    t = F.col("t")
    return rows.select(
        "id", text.ascii_lower(t).alias("lower_text"), text.trim_control(t).alias("trimmed"), text.first_word(t).alias("word"), F.array_join(text.quoted_literals(t), "\x1e").alias("literals"),
        text.tsv_cell(t).alias("cell"), text.line_count(t).cast("long").alias("lines"), text.sample_of(t, 9).alias("sample"), text.safe_name(t).alias("safe"),
    )


@query("w02_line_counts", r"""
    SELECT doc_id, CAST(len(regexp_extract_all(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e]')) + CASE WHEN regexp_matches(text, '[^\n\x0b\x0c\r\x1c-\x1e]\z') THEN 1 ELSE 0 END AS BIGINT) AS lines,
        left(text, 240) AS sample FROM documents""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).cast("long").alias("lines"), text.sample_of(F.col("text")).alias("sample"))


@query("w03_file_names", """
    WITH f AS (SELECT page_id, url || ['', '.sit.hqx', '.TXT', '/x.y.Mov', '/noext'][page_id % 5 + 1] AS path FROM pages)
    , n AS (SELECT *, list_extract(string_split(path, '/'), -1) AS name FROM f),
    s AS (SELECT *, CASE WHEN ends_with(lower(name), '.sit.hqx') THEN 'sit.hqx' ELSE regexp_extract(lower(name), '[^.]\\.([^.]*)$', 1) END AS suffix FROM n)
    SELECT page_id, name, suffix, CASE suffix WHEN 'txt' THEN 'text/plain' WHEN 'mov' THEN 'video/quicktime' ELSE 'application/octet-stream' END AS media_type FROM s""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", _pick("page_id", "", ".sit.hqx", ".TXT", "/x.y.Mov", "/noext"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    suffix = text.extension(F.col("path"))
    return rows.select("page_id", text.file_name(F.col("path")).alias("name"), suffix.alias("suffix"), classify.media_type(suffix).alias("media_type"))


@query("w04_terminal_text", """
    SELECT c_custkey, c_name || chr(10) || 'Status: ' || c_mktsegment || chr(10) || 'end' AS plain, c_name || '\\x1B[31m' AS escaped FROM customer""")
def terminal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours and line ends are taken out; bytes that are not printable are written as numbers."""
    coloured = F.concat("c_name", F.lit("\r\n\x1b[31mStatus:\x1b[0m "), "c_mktsegment", F.lit("\rend"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.strip_ansi(coloured).alias("plain"), binary.escaped_bytes(F.encode(F.concat("c_name", F.lit("\x1b[31m")), "utf-8")).alias("escaped")
    )


@query("w05_binary_fields", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS u16_value, -l_linenumber AS i16_value, -l_orderkey AS i32_value, 4294967296 - l_orderkey - 1 AS u32_value, l_returnflag || 'abc' AS code,
        CAST(ascii(l_returnflag) AS BIGINT) * 16777216 + 6382179 AS code_number, 'v' || l_linenumber AS counted, CAST(4 * l_linenumber + 8 AS BIGINT) AS aligned, 'z' || l_partkey AS ended, 0 AS outside FROM lineitem""")
def binary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, types and texts packed and read back; what lies outside reads as 0."""
    from .archive_queries import _be

    label = F.encode(F.concat(F.lit("v"), F.col("l_linenumber").cast("string")), "utf-8")
    data = F.concat(
        _be(F.col("l_suppkey"), 2), _be(-F.col("l_linenumber"), 2), binary.pack_u32(-F.col("l_orderkey")), binary.pack_u32(-F.col("l_orderkey") - 1),
        F.encode(F.concat("l_returnflag", F.lit("abc")), "utf-8"), _be(F.octet_length(label), 1), label, F.encode(F.concat(F.lit("z"), F.col("l_partkey").cast("string"), F.lit("\0tail")), "utf-8"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", data.alias("d"))
    d = F.col("d")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", binary.u16(d, 0).alias("u16_value"), binary.i16(d, 2).alias("i16_value"), binary.i32(d, 4).alias("i32_value"), binary.u32(d, 8).alias("u32_value"),
        binary.four_cc(d, 12).alias("code"), binary.type_code(binary.four_cc(d, 12)).alias("code_number"), binary.pascal_string(d, 16).alias("counted"),
        binary.even(F.col("l_linenumber").cast("long") * 4 + 7).alias("aligned"), binary.c_string(d, F.lit(17) + F.octet_length(binary.pascal_string(d, 16))).alias("ended"), binary.u32(d, 500).alias("outside"),
    )


# --- classifiers -----------------------------------------------------------------------------


@query("w06_external_kinds", """
    WITH f AS (SELECT c_custkey AS id, ['PICT', 'TEXT', 'APPL', 'MooV', 'MYag', 'snd ', 'Mcr0', 'CURS', ''][c_custkey % 9 + 1] AS finder,
                      ['pict', 'md', 'mov', 'aif', 'sit', 'pdf', 'x'][c_nationkey % 7 + 1] AS suffix, CASE WHEN c_acctbal > 0 THEN 'STAK' ELSE '' END AS kind FROM customer)
    SELECT id, CASE WHEN finder = 'PICT' OR suffix = 'pict' THEN 'picture' WHEN finder = 'TEXT' OR suffix = 'md' THEN 'text' WHEN finder = 'APPL' THEN 'application'
        WHEN finder = 'MooV' OR suffix = 'mov' THEN 'movie' WHEN finder = 'MYag' THEN 'myst_resource' WHEN finder = 'snd ' OR suffix = 'aif' THEN 'sound' WHEN finder = 'Mcr0' THEN 'macro'
        WHEN finder = 'CURS' THEN 'icon_or_cursor' WHEN kind = 'STAK' THEN 'stack_like_unimported' WHEN suffix = 'sit' THEN 'binary_container' WHEN suffix = 'pdf' THEN 'document' ELSE 'unknown_binary' END AS external_kind,
        CASE WHEN finder = 'APPL' AND kind = 'STAK' AND id % 2 = 0 THEN 'hypercard_standalone_application' WHEN finder = 'APPL' THEN 'classic_mac_application' WHEN finder = 'MYag' THEN 'hypercard_stack'
        WHEN kind = 'STAK' THEN 'hypercard_stack_data_fork' ELSE 'unknown' END AS source_class FROM f""")
def external_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    finder = _pick("c_custkey", "PICT", "TEXT", "APPL", "MooV", "MYag", "snd ", "Mcr0", "CURS", "")
    suffix = _pick("c_nationkey", "pict", "md", "mov", "aif", "sit", "pdf", "x")
    kind = F.when(F.col("c_acctbal") > 0, "STAK").otherwise("")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), classify.external_kind(finder, suffix, kind).alias("external_kind"),
        classify.source_class(finder, kind == "STAK", F.col("c_custkey") % 2 == 0).alias("source_class"),
    )


@query("w07_code_kinds", """
    WITH r AS (SELECT p_partkey AS id, ['XCMD', 'XFCN', 'xcmd', 'xfcn', 'cfrg'][p_partkey % 5 + 1] AS type, CASE WHEN p_size > 25 THEN 'Joy!' ELSE 'abcd' END AS head, p_size % 6 AS code FROM part)
    SELECT id, CASE WHEN type = 'cfrg' THEN 'code_fragment' WHEN lower(type) = 'xcmd' THEN 'externalcommand' ELSE 'externalfunction' END AS kind, CASE WHEN type = lower(type) THEN 'macppc' ELSE 'mac68k' END AS platform,
        CASE WHEN type = upper(type) THEN 'm68k' ELSE 'ppc32' END AS instruction,
        CASE WHEN type = 'cfrg' THEN 'cfm_code_fragment' WHEN type = upper(type) THEN 'classic_code_resource' WHEN head = 'Joy!' THEN 'pef' ELSE 'raw_code_resource' END AS container,
        ['import_library', 'application', 'drop_in_addition', 'stub_library', 'weak_stub_library', 'invalid'][code + 1] AS usage,
        ['memory', 'data_fork', 'resource', 'byte_stream', 'named_fragment', 'invalid'][code + 1] AS location FROM r""")
def code_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _pick("p_partkey", "XCMD", "XFCN", "xcmd", "xfcn", "cfrg")
    head = F.when(F.col("p_size") > 25, F.lit(b"Joy!...")).otherwise(F.lit(b"abcd"))
    said = classify.code_format(kind, head)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), classify.code_kind(kind).alias("kind"), classify.code_platform(kind).alias("platform"), said["instruction"].alias("instruction"), said["container"].alias("container"),
        classify.cfrg_usage(F.col("p_size") % 6).alias("usage"), classify.cfrg_location(F.col("p_size") % 6).alias("location"),
    )


# --- scripts ---------------------------------------------------------------------------------

_SCRIPT = """'on mouseUp ' || p_size || chr(10) || '  -- note' || chr(13) || 'xDo "' || p_brand || '.mov"' || chr(13) || chr(10) || 'Known ' || '"a" & "b"' || chr(10) || 'function f' || p_partkey || chr(10) || 'go card "' || p_name || '"'"""


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SCRIPT.replace("chr(", "char(")).alias("script"))


@query("w08_handlers", """
    SELECT p_partkey AS id, 'mouseUp' AS name, 'message' AS kind, 1 AS line FROM part UNION ALL SELECT p_partkey, 'f' || p_partkey, 'function', 5 FROM part""")
def handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.handlers(scripts.statements(_scripts(spark, sf_dir), ["id"]), ["id"])


@query("w09_external_calls", """
    SELECT p_partkey AS id, 3 AS line, 'xDo' AS word, false AS resource_backed FROM part UNION ALL SELECT p_partkey, 4, 'Known', true FROM part""")
def external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that look external or are the names of code resources."""
    names = spark.createDataFrame([("KNOWN",), ("",)], "name string")
    return scripts.external_calls(scripts.statements(_scripts(spark, sf_dir), ["id"]), ["id"], names).select("id", "line", "word", "resource_backed")


@query("w10_literals", """
    SELECT p_partkey AS id, 3 AS line, 0 AS place, p_brand || '.mov' AS literal, 'movie' AS kind FROM part UNION ALL SELECT p_partkey, 4, 0, 'a', NULL FROM part
    UNION ALL SELECT p_partkey, 4, 1, 'b', NULL FROM part UNION ALL SELECT p_partkey, 6, 0, p_name, 'card' FROM part""")
def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.literals(scripts.statements(_scripts(spark, sf_dir), ["id"]), ["id"])


@query("w11_references", """
    SELECT p_partkey AS id, 3 AS line, 'movie' AS kind, p_brand || '.mov' AS literal FROM part UNION ALL SELECT p_partkey, 6, 'card', p_name FROM part""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scripts.literals(scripts.statements(_scripts(spark, sf_dir), ["id"]), ["id"])
    return scripts.references(found, ["id"]).select("id", "line", "kind", "literal")


@query("w12_reference_counts", "SELECT 'movie' AS kind, count(*) AS n FROM part UNION ALL SELECT 'card', count(*) FROM part")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.reference_counts(scripts.literals(scripts.statements(_scripts(spark, sf_dir), ["id"]), ["id"]))


# --- logs ------------------------------------------------------------------------------------

_LOG = """string_agg(CASE l_linenumber % 6
    WHEN 0 THEN 'Status: Processing ''CARD'' #' || l_partkey || ' 1F (' || l_suppkey || ' bytes)' WHEN 1 THEN 'Status: Skipping ''FREE'' #-' || l_partkey || ' (' || l_suppkey || ' bytes)'
    WHEN 2 THEN 'Warning: Skipping block  abcd #' || l_partkey WHEN 3 THEN 'Error: Couldn''t parse ' || l_partkey WHEN 4 THEN l_partkey || ' blocks found' ELSE l_suppkey || ' resources, Segmentation fault. Warning: x' END,
    chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey)"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each order, a line for each of its lines."""
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    says = (
        (F.lit("Status: Processing 'CARD' #"), part, F.lit(" 1F ("), supplier, F.lit(" bytes)")), (F.lit("Status: Skipping 'FREE' #-"), part, F.lit(" ("), supplier, F.lit(" bytes)")),
        (F.lit("Warning: Skipping block  abcd #"), part), (F.lit("Error: Couldn't parse "), part), (part, F.lit(" blocks found")), (supplier, F.lit(" resources, Segmentation fault. Warning: x")),
    )
    line = F.element_at(F.array(*[F.concat(*s) for s in says]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("t")))), lambda x: x["t"])
    return table(spark, sf_dir, "lineitem").groupBy(F.lit("r").alias("run_id"), F.col("l_orderkey").alias("attempt_id")).agg(F.array_join(listed, "\n").alias("log"))


_LOG_LINES = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem) """


@query("w13_chunks_from_log", _LOG_LINES + """
    SELECT l_orderkey AS attempt_id, ['CARD', 'FREE', 'ABCD'][l_linenumber % 6 + 1] AS chunk_type, CASE WHEN l_linenumber % 6 = 1 THEN -l_partkey ELSE l_partkey END AS chunk_id,
        CASE WHEN l_linenumber % 6 < 2 THEN l_suppkey END AS chunk_bytes, ['parsed', 'skipped', 'unhandled'][l_linenumber % 6 + 1] AS status, CASE WHEN l_linenumber % 6 < 2 THEN 1 ELSE 0 END AS understood, line AS log_line
    FROM n WHERE l_linenumber % 6 < 3""")
def chunks_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.chunks_from_log(warehouse.log_lines(_logs(spark, sf_dir))).drop("run_id", "evidence")


@query("w14_diagnostics_from_log", _LOG_LINES + """
    SELECT l_orderkey AS attempt_id, CASE l_linenumber % 6 WHEN 3 THEN 'error' ELSE 'warning' END AS severity, line, CASE l_linenumber % 6 WHEN 2 THEN 'block' WHEN 3 THEN 'chunk' ELSE 'crash' END AS gap_kind
    FROM n WHERE l_linenumber % 6 IN (2, 3, 5)""")
def diagnostics_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.diagnostics_from_log(warehouse.log_lines(_logs(spark, sf_dir))).drop("run_id", "message")


@query("w15_attempt_counts", _LOG_LINES + """
    SELECT l_orderkey AS attempt_id, count(*) FILTER (l_linenumber % 6 IN (2, 5)) AS warnings, count(*) FILTER (l_linenumber % 6 = 3) AS errors, count(*) FILTER (l_linenumber % 6 < 2) AS status_lines,
        min_by(l_partkey, line) FILTER (l_linenumber % 6 = 4) AS blocks, min_by(l_suppkey, line) FILTER (l_linenumber % 6 = 5) AS resources FROM n GROUP BY l_orderkey""")
def attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.attempt_counts(warehouse.log_lines(_logs(spark, sf_dir))).drop("run_id")


# --- links and loaders -----------------------------------------------------------------------


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as output files of their order's stack."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("r").alias("run_id"), F.col("l_orderkey").alias("attempt_id"), F.col("l_orderkey").alias("stack_id"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")).alias("id"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string")).alias("rel_path"), _pick("l_suppkey", "card", "bmap", "background", "pat", "other").alias("logical_kind"), (F.col("l_partkey") % 4).alias("logical_id"),
        _pick("l_linenumber", "json", "image", "raw", "sound", "assembly").alias("kind"),
    )


_OUTPUTS = """WITH o AS (SELECT l_orderkey AS stack_id, ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS id, 'f' || l_partkey % 9 AS rel_path, ['card', 'bmap', 'background', 'pat', 'other'][l_suppkey % 5 + 1] AS logical_kind,
    l_partkey % 4 AS logical_id, ['json', 'image', 'raw', 'sound', 'assembly'][l_linenumber % 5 + 1] AS kind FROM lineitem),
    t AS (SELECT *, CASE logical_kind WHEN 'card' THEN 'CARD' WHEN 'bmap' THEN 'BMAP' WHEN 'background' THEN 'BKGD' ELSE upper(logical_kind) END AS chunk_type FROM o),
    c AS (SELECT o_orderkey AS stack_id, ['CARD', 'BMAP', 'PAT'][o_custkey % 3 + 1] AS chunk_type, NULLIF(o_custkey % 5, 4) AS chunk_id FROM orders)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stack_id"), _pick("o_custkey", "CARD", "BMAP", "PAT").alias("chunk_type"), F.nullif(F.col("o_custkey") % 5, F.lit(4)).alias("chunk_id"))


@query("w16_link_media", _OUTPUTS + """
    SELECT o_orderkey AS stack_id, 'f' || o_custkey % 9 AS rel_path, (SELECT min(id) FROM o WHERE o.stack_id = o_orderkey AND o.rel_path = 'f' || o_custkey % 9) AS output_file_id FROM orders""")
def link_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stack_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 9).cast("string")).alias("rel_path"))
    return warehouse.link_media(media, _outputs(spark, sf_dir))


@query("w17_link_chunks", _OUTPUTS + """
    SELECT c.*, (SELECT min(id) FROM t WHERE t.stack_id = c.stack_id AND t.chunk_type = c.chunk_type AND t.logical_id = c.chunk_id) AS output_file_id FROM c""")
def link_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.link_chunks(_chunks(spark, sf_dir), _outputs(spark, sf_dir))


@query("w18_derived_chunks", _OUTPUTS + """
    SELECT stack_id, id AS output_file_id, chunk_type, logical_id AS chunk_id, 'derived_from_output' AS status FROM t WHERE logical_kind IN ('card', 'bmap', 'background')
    AND NOT EXISTS (SELECT 1 FROM c WHERE c.stack_id = t.stack_id AND c.chunk_type = t.chunk_type AND c.chunk_id IS NOT DISTINCT FROM t.logical_id)""")
def derived_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.derived_chunks(_chunks(spark, sf_dir), _outputs(spark, sf_dir)).select("stack_id", "output_file_id", "chunk_type", "chunk_id", "status")


@query("w19_embedded_rows", _OUTPUTS + """,
    e AS (SELECT *, CASE kind WHEN 'image' THEN 'image' WHEN 'sound' THEN 'sound' WHEN 'raw' THEN 'raw_binary' ELSE CASE WHEN logical_kind IN ('pat', 'bmap') THEN 'bitmap' END END AS embedded_kind FROM t)
    SELECT row_number() OVER (ORDER BY id) AS id, id AS output_file_id, embedded_kind, chunk_type AS source_chunk_type, logical_id AS source_chunk_id FROM e WHERE embedded_kind IS NOT NULL""")
def embedded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media and raw outputs, numbered densely in order of the file."""
    return warehouse.embedded_rows(_outputs(spark, sf_dir)).select("id", "output_file_id", "embedded_kind", "source_chunk_type", "source_chunk_id")


@query("w20_output_rows", """
    WITH f AS (SELECT p_size AS attempt_id, CASE WHEN p_partkey % 2 = 0 THEN 'card_' || p_partkey || '.json' ELSE 'b/PAT_' || p_partkey || '.PBM' END AS rel_path, p_partkey, p_name FROM part)
    SELECT row_number() OVER (ORDER BY attempt_id, rel_path) AS id, attempt_id, rel_path, CAST(strlen(p_name) AS BIGINT) AS bytes, CASE WHEN p_partkey % 2 = 0 THEN 'json' ELSE 'pbm' END AS extension,
        CASE WHEN p_partkey % 2 = 0 THEN 'json' ELSE 'image' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'card' ELSE 'pat' END AS logical_kind, p_partkey AS logical_id, sha256(p_name) AS sha256 FROM f""")
def output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package files, classified, hashed and numbered densely."""
    key = F.col("p_partkey")
    path = F.when(key % 2 == 0, F.concat(F.lit("card_"), key.cast("string"), F.lit(".json"))).otherwise(F.concat(F.lit("b/PAT_"), key.cast("string"), F.lit(".PBM")))
    files = table(spark, sf_dir, "part").select(
        F.lit("r").alias("run_id"), F.col("p_size").alias("attempt_id"), F.col("p_size").alias("stack_id"), path.alias("rel_path"), F.encode("p_name", "utf-8").alias("content")
    )
    return warehouse.output_rows(files).select("id", "attempt_id", "rel_path", "bytes", "extension", "kind", "logical_kind", "logical_id", "sha256")


@query("w21_content_rows", """
    SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id, o_custkey AS stack_id, o_orderkey AS container_id, CAST(length(o_orderpriority) + 2 AS BIGINT) AS text_bytes, CAST(2 AS BIGINT) AS line_count,
        sha256(o_orderpriority || chr(10) || 'x') AS sha256, o_orderpriority || chr(10) || 'x' AS sample FROM orders""")
def content_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = table(spark, sf_dir, "orders").select(
        F.lit("r").alias("run_id"), F.col("o_custkey").alias("stack_id"), F.col("o_orderkey").alias("container_id"), F.lit(1).alias("part_id"), F.concat("o_orderpriority", F.lit("\nx")).alias("text")
    )
    return warehouse.content_rows(contents).select("id", "stack_id", "container_id", "text_bytes", "line_count", "sha256", "sample")


@query("w22_run_totals", """
    SELECT n_name AS run_id, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS sources, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS stacks,
        (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0) AS imported, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS failed FROM nation""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as runs, suppliers as sources, customers as attempts."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("run_id"))
    sources = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("run_id")
    tried = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("run_id", F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("exit_code"))
    return warehouse.run_totals(nations.select("run_id"), sources, tried)


@query("w23_conversions", """
    SELECT o_custkey AS embedded_file_id, o_orderstatus AS target_format, max_by(o_orderpriority, o_orderkey) AS status FROM orders GROUP BY 1, 2
    UNION ALL SELECT c_custkey, 'known', c_mktsegment FROM customer""")
def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conversions: the last of a file and format counts, known others stay."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("embedded_file_id"), F.lit("known").alias("target_format"), F.col("c_mktsegment").alias("status"), F.lit(0).cast("long").alias("converted_at"))
    fresh = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("embedded_file_id"), F.col("o_orderstatus").alias("target_format"), F.col("o_orderpriority").alias("status"), F.col("o_orderkey").alias("converted_at"))
    return warehouse.record_conversions(known, fresh).drop("converted_at")


@query("w24_conversion_counts", """
    SELECT o_orderpriority AS target_format, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'converted' ELSE 'skipped' END AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "converted").otherwise("skipped")
    return packages.conversion_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("target_format"), status.alias("status")))


# --- packages --------------------------------------------------------------------------------


def _package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, attempt_id, stack_id, output_file_id, rel_path, content): a card file for each order, a project file for each customer and a stack file for each nation."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("type"), F.col("l_shipdate").cast("date").cast("string").alias("script")))).alias("parts"),
    )
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    content = F.array(F.struct(F.lit("background").alias("layer"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("text")))
    fixed = (F.lit("r").alias("run_id"), F.lit(1).cast("long").alias("attempt_id"))
    cards = orders.select(
        *fixed, F.col("o_custkey").alias("stack_id"), F.col("o_orderkey").alias("output_file_id"), F.concat(F.lit("card_"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("rel_path"),
        F.to_json(F.struct(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("script"), "parts", content.alias("contents"))).alias("content"),
    )
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type")))).alias("blocks"),
        F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.lit("card").alias("kind"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file")))).alias("outputs"),
    )
    projects = listed.select(*fixed, F.col("o_custkey").alias("stack_id"), (-F.col("o_custkey") - 1).alias("output_file_id"), F.lit("project.json").alias("rel_path"), F.to_json(F.struct("blocks", "outputs")).alias("content"))
    layers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.lit("card").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("owner")))).alias("layers")
    )
    stacks = layers.select(
        *fixed, F.col("c_nationkey").cast("long").alias("stack_id"), (-F.col("c_nationkey") - 1_000_000).cast("long").alias("output_file_id"), F.lit("stack_-1.json").alias("rel_path"),
        F.to_json(F.struct(F.lit(-1).alias("id"), F.lit(7).alias("listBlockId"), F.lit(8).alias("fontTableBlockId"), F.lit(9).alias("styleTableBlockId"), "layers")).alias("content"),
    )
    return cards.unionByName(projects).unionByName(stacks)


@query("w25_package_objects", """
    SELECT o_custkey AS stack_id, 'card' AS object_kind, o_orderkey AS object_id, 'c' || o_orderkey AS name, NULL AS part_type, length(o_orderpriority) AS text_bytes, length(o_orderstatus) AS script_bytes FROM orders
    UNION ALL SELECT o_custkey, 'part', l_linenumber, CAST(l_partkey AS VARCHAR), l_returnflag, 0, 10 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT o_custkey, 'binary_chunk', o_orderkey, NULL, o_orderstatus, 0, 0 FROM orders
    UNION ALL SELECT c_nationkey, 'card_ref', c_custkey, c_name, NULL, 0, 0 FROM customer
    UNION ALL SELECT DISTINCT c_nationkey, k, v, NULL, NULL, 0, 0 FROM customer, (VALUES ('listBlockId', 7), ('fontTableBlockId', 8), ('styleTableBlockId', 9)) AS t(k, v)""")
def package_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.objects(_package(spark, sf_dir)).select("stack_id", "object_kind", "object_id", "name", "part_type", "text_bytes", "script_bytes")


@query("w26_package_parts", """
    SELECT o_custkey AS stack_id, l_orderkey AS container_id, 'card' AS container_kind, l_linenumber AS part_id, l_returnflag AS part_type, CAST(l_partkey AS VARCHAR) AS name, 10 AS script_bytes
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def package_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.parts(_package(spark, sf_dir)).select("stack_id", "container_id", "container_kind", "part_id", "part_type", "name", "script_bytes")


@query("w27_package_contents", """
    SELECT o_custkey AS stack_id, o_orderkey AS container_id, 'background' AS layer, o_custkey AS part_id, length(o_orderpriority) AS text_bytes, 1 AS line_count, sha256(o_orderpriority) AS sha256 FROM orders""")
def package_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.contents(_package(spark, sf_dir)).select("stack_id", "container_id", "layer", "part_id", "text_bytes", "line_count", "sha256")


@query("w28_package_media", "SELECT o_custkey AS stack_id, 'f' || o_orderkey AS rel_path, 'card' AS media_kind FROM orders")
def package_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.media(_package(spark, sf_dir)).select("stack_id", "rel_path", "media_kind")


@query("w29_code_resources", """
    WITH r AS (SELECT p_partkey, p_size, ['XCMD', 'XFCN', 'xcmd', 'cfrg', 'ICON'][p_partkey % 5 + 1] AS type, p_name FROM part),
    f AS (SELECT p_partkey AS id, p_size AS stack_id, 'resource-disassembly/a_' || ['XCMD', 'XFCN', 'xcmd', 'cfrg', 'ICON'][p_partkey % 5 + 1] || '_' || CASE WHEN p_retailprice < 1500 THEN p_partkey ELSE -p_partkey END || '.s' AS rel_path, p_retailprice FROM part),
    j AS (SELECT r.*, f.id, f.rel_path FROM r LEFT JOIN f ON f.id = p_partkey AND f.stack_id = p_size AND p_retailprice < 1500 WHERE type <> 'ICON')
    SELECT p_size AS stack_id, type AS resource_type, p_partkey AS resource_id, p_name AS resource_name, CASE WHEN type = 'cfrg' THEN 'code_fragment' WHEN lower(type) = 'xcmd' THEN 'externalcommand' ELSE 'externalfunction' END AS external_kind,
        CASE WHEN type = upper(type) THEN 'mac68k' ELSE 'macppc' END AS platform, CAST(strlen(p_name) AS BIGINT) AS payload_bytes, id AS output_file_id, coalesce(rel_path, '') AS disassembly_rel_path,
        CASE WHEN id IS NULL THEN 'missing' ELSE 'present' END AS disassembly_status FROM j""")
def code_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as resources; cheap ones have a listing, found by the type and number in its name."""
    kind, key = _pick("p_partkey", "XCMD", "XFCN", "xcmd", "cfrg", "ICON"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part")
    found = rows.select(
        F.lit("r").alias("run_id"), F.lit(1).alias("attempt_id"), F.col("p_size").alias("stack_id"), kind.alias("type"), key.alias("id"), F.col("p_name").alias("name"), F.encode("p_name", "utf-8").alias("data"), F.lit("").alias("disassembly_file")
    )
    # a dear part's listing bears a number that no resource has
    number = F.when(F.col("p_retailprice") < 1500, key).otherwise(-key)
    path = F.concat(F.lit("resource-disassembly/a_"), kind, F.lit("_"), number.cast("string"), F.lit(".s"))
    files = rows.select(key.alias("id"), F.col("p_size").alias("stack_id"), path.alias("rel_path"))
    made = packages.code_resources(found, files)
    return made.select("stack_id", "resource_type", "resource_id", "resource_name", "external_kind", "platform", "payload_bytes", "output_file_id", "disassembly_rel_path", "disassembly_status")


@query("w30_stack_propagation", "SELECT l_orderkey AS attempt_id, l_linenumber AS line, o_custkey AS stack_id FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def stack_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an attempt get the stack that it made."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("line"))
    stacks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("attempt_id"))
    return packages.with_stack(rows, stacks).select("attempt_id", "line", "stack_id")


@query("w31_project_files", """
    SELECT c_custkey AS stack_id, 'card_' || c_custkey AS name, count(o_orderkey) AS n_blocks, CAST(coalesce(sum(length(o_orderpriority)), 0) AS BIGINT) AS bytes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) > 0""")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project documents made of blocks, read back by their fields."""
    orders = table(spark, sf_dir, "orders")
    held = orders.select(
        F.col("o_custkey").cast("string").alias("file"), F.lit("CARD").alias("type"), F.col("o_orderkey").cast("int").alias("id"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("offset"),
        (F.octet_length("o_orderpriority") + 12).alias("size"), F.encode("o_orderpriority", "utf-8").alias("payload"), F.lit("ok").alias("status"),
    )
    stacks = orders.select(F.col("o_custkey").cast("string").alias("file")).distinct().select("file", F.lit("STAK").alias("type"), F.lit(-1).alias("id"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("offset"), F.lit(1536).alias("size"), F.lit(bytes(1524)).alias("payload"), F.lit("ok").alias("status"))
    made = packages.project_documents(held.unionByName(stacks))
    listed = F.from_json(F.get_json_object("project", "$.blocks"), "array<struct<type:string,id:int,size:bigint,understood:boolean>>")
    cards = F.filter(listed, lambda b: b["type"] == "CARD")
    return made.select(
        F.col("file").cast("long").alias("stack_id"), F.concat(F.lit("card_"), F.get_json_object("project", "$.sourceFileName")).alias("name"), F.size(cards).cast("long").alias("n_blocks"),
        F.aggregate(F.transform(cards, lambda b: b["size"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"),
    )


@query("w32_first_bytes", """
    SELECT p_partkey AS rom_id, CASE WHEN p_size < 10 THEN 'code' WHEN p_size < 30 THEN 'header' ELSE 'mixed' END AS hypothesis FROM part""")
def first_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first bytes of an image look like."""
    head = F.when(F.col("p_size") < 10, F.lit(b"\x4e\xf9\x00\x10")).when(F.col("p_size") < 30, F.lit(b"\x00\x00\x00\x10")).otherwise(F.lit(b"\x92\x34\x56\x78"))
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rom_id"), F.lit(0).alias("base"), F.concat(head, F.lit(bytes(40))).alias("content"))
    return rom.first_bytes(images).select("rom_id", "hypothesis")


@query("w33_rom_headers", """
    SELECT p_partkey AS rom_id, CASE WHEN p_size < 10 THEN '68K' WHEN p_size < 30 AND p_size % 2 = 0 THEN '68K' ELSE '' END AS machine_family, CASE WHEN p_size >= 40 THEN 'BOOT' END AS model FROM part""")
def rom_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset jump, an idle instruction at an even or an odd place, neither, or a name of other machines before one."""
    size = F.col("p_size")
    idle, odd = F.lit(b"\x00\x01" * 9 + b"\x4e\x71" + bytes(20)), F.lit(b"\x00" * 9 + b"\x4e\x71" + bytes(20))
    content = (
        F.when(size < 10, F.lit(b"\x4e\xf9\x00\x20" + bytes(30))).when((size < 30) & (size % 2 == 0), idle).when(size < 30, odd).when(size < 40, F.lit(bytes(40))).otherwise(F.concat(F.lit(b"BOOT"), idle))
    )
    return rom.headers(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rom_id"), F.lit(0).alias("base"), content.alias("content")))


@query("w34_asset_kinds", """
    WITH f AS (SELECT c_custkey AS id, ['MYag', 'MooV', 'PICT', 'snd ', 'TEXT', 'APPL', 'INIT', 'STAK', ''][c_custkey % 9 + 1] AS finder, ['', 'mov', 'pic', 'wav', 'md', 'stk', 'x'][c_nationkey % 7 + 1] AS suffix,
                      CASE WHEN c_acctbal < 0 THEN 0 ELSE 5 END AS size FROM customer),
    k AS (SELECT id, CASE WHEN size = 0 THEN 'empty_placeholder' WHEN finder = 'MYag' THEN 'myst_resource' WHEN finder = 'MooV' OR suffix = 'mov' THEN 'movie' WHEN finder = 'PICT' OR suffix = 'pic' THEN 'picture'
        WHEN finder = 'snd ' OR suffix = 'wav' THEN 'sound' WHEN finder = 'TEXT' OR suffix = 'md' THEN 'text' WHEN finder = 'APPL' THEN 'application' WHEN finder = 'INIT' THEN 'system_extension'
        WHEN finder = 'STAK' OR suffix = 'stk' THEN 'stack_like' ELSE 'unknown_binary' END AS kind FROM f)
    SELECT id, kind, CASE kind WHEN 'movie' THEN 'video/quicktime' WHEN 'picture' THEN 'image/x-pict' WHEN 'sound' THEN 'audio/x-mac-sound' WHEN 'text' THEN 'text/plain'
        WHEN 'application' THEN 'application/x-mac-application' ELSE 'application/octet-stream' END AS media_type FROM k""")
def asset_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    finder = _pick("c_custkey", "MYag", "MooV", "PICT", "snd ", "TEXT", "APPL", "INIT", "STAK", "")
    suffix = _pick("c_nationkey", "", "mov", "pic", "wav", "md", "stk", "x")
    kind = classify.asset_kind(finder, suffix, F.when(F.col("c_acctbal") < 0, 0).otherwise(5))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"), classify.asset_media_type(kind).alias("media_type"))
