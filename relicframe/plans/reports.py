"""Corpus reports over the warehouse.

A listing is a projection over equi-joins, given as data; the other reports
aggregate. All take a Warehouse and a run and return typed DataFrames; the order of
a report is part of its export, see ORDER and ``ordered``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..operators.relational import sorted_list
from .warehouse import Warehouse

#: Listings: base table, joins (table, key in base, how), columns. Columns are of the base unless marked table.column.
#: The columns of a report and its order below are fixed values.
LISTINGS: dict[str, tuple[str, list[tuple[str, str, str]], str]] = {
    "summary": ("import_attempts", [("stacks", "", "left")],
        "status exit_code warnings errors status_lines blocks resources stacks.stack_name stacks.card_count_declared "
        "stacks.card_width stacks.card_height archive_input import_input log_path output_package"),
    "diagnostics": ("diagnostics", [("import_attempts", "attempt_id", "inner")],
        "severity import_attempts.import_input line gap_kind message import_attempts.log_path"),
    "classifications": ("extracted_files", [("source_files", "source_id", "inner")],
        "source_files.rel_path=archive_input rel_path=extracted_input bytes extension finder_type binary_type binary_size decision reason"),
    "format_gaps": ("format_gaps", [], "kind detail subject log_path"),
    "output_files": ("output_files", [("import_attempts", "attempt_id", "inner"), ("stacks", "stack_id", "left")],
        "stacks.stack_name import_attempts.import_input rel_path bytes extension kind logical_kind logical_id referenced_by sha256"),
    "json_sections": ("json_sections", [("import_attempts", "attempt_id", "inner"), ("stacks", "stack_id", "left")],
        "stacks.stack_name import_attempts.import_input file_rel_path depth tag attrs_json text_size"),
    "stacks": ("stacks", [],
        "stack_name import_input card_count_declared card_width card_height project_user_level created_by_version "
        "last_compacted_version last_edited_version first_edited_version font_table_id style_table_id stack_script_bytes output_package"),
    "stack_statistics": ("stack_statistics", [("stacks", "stack_id", "inner")], "stacks.stack_name stacks.import_input metric detail value"),
    "parsed_parts": ("parsed_parts", [("stacks", "stack_id", "inner"), ("output_files", "output_file_id", "left")],
        "stacks.stack_name stacks.import_input output_files.rel_path=file_rel_path container_kind container_id part_id part_type name style "
        "visible enabled shared_text lock_text text_align font text_size text_style rect_left rect_top rect_right rect_bottom script_bytes"),
    "parsed_content": ("parsed_content", [("stacks", "stack_id", "inner"), ("output_files", "output_file_id", "left")],
        "stacks.stack_name stacks.import_input output_files.rel_path=file_rel_path container_kind container_id layer part_id text_bytes line_count sha256 sample"),
    "binary_chunks": ("binary_chunks",
        [("import_attempts", "attempt_id", "inner"), ("stacks", "stack_id", "left"), ("output_files", "output_file_id", "left")],
        "stacks.stack_name import_attempts.import_input chunk_type chunk_id chunk_bytes status understood output_files.rel_path=output_file evidence log_line"),
    "embedded_files": ("embedded_files", [("stacks", "stack_id", "inner")],
        "stacks.stack_name stacks.import_input rel_path embedded_kind logical_kind logical_id bytes sha256 referenced_by source_chunk_type source_chunk_id"),
    "external_code_resources": ("external_code_resources", [("stacks", "stack_id", "inner")],
        "stacks.stack_name stacks.import_input resource_type resource_id resource_name external_kind platform instruction_format "
        "container_format payload_bytes payload_sha256 disassembly_status disassembly_rel_path"),
    "missing_disassemblies": ("external_code_resources", [("stacks", "stack_id", "inner")],
        "stacks.stack_name stacks.import_input resource_type resource_id resource_name platform instruction_format container_format payload_bytes payload_sha256"),
    "external_binary_files": ("external_binary_files", [],
        "archive_input external_input external_kind bytes extension finder_type binary_type binary_size sha256 classification_reason path"),
}

#: Conditions of listings beyond the run.
CONDITIONS = {"missing_disassemblies": "disassembly_status != 'present'"}

#: Export order, nulls first.
ORDER = {
    "summary": "import_input", "diagnostics": "severity gap_kind message", "classifications": "archive_input extracted_input",
    "format_gaps": "kind detail subject", "output_files": "stack_name import_input rel_path", "json_sections": "stack_name import_input file_rel_path",
    "stacks": "stack_name import_input", "stack_statistics": "stack_name metric detail", "parsed_parts": "stack_name file_rel_path part_id",
    "parsed_content": "stack_name file_rel_path part_id", "binary_chunks": "stack_name chunk_type chunk_id", "embedded_files": "stack_name embedded_kind rel_path",
    "external_code_resources": "stack_name resource_type resource_id resource_name", "missing_disassemblies": "platform stack_name resource_type resource_id resource_name",
    "external_binary_files": "archive_input external_kind external_input", "chunk_usage": "understood chunk_type status", "chunk_type_counts": "chunk_type",
    "embedded_file_usage": "-occurrence_count embedded_kind logical_kind", "external_code_usage": "-occurrence_count platform external_kind",
    "disassembly_summary": "platform instruction_format disassembly_status", "disassembly_files_summary": "extension kind logical_kind",
    "unindexed_disassembly_files": "stack_name rel_path", "external_binary_usage": "-occurrence_count -total_bytes",
    "disassembly_call_usage": "platform call_kind -occurrence_count target", "format_gap_counts": "kind",
}

DISASSEMBLY = "resource-disassembly/%"


#: Tables of a row or two for many of others, of which listings take a column or two: kept in memory by key, so that the long rows need no sort.
PARENTS = ("source_files", "import_attempts", "stacks")


def _points_to(base: str, key: str, table: str, how: str) -> Column:
    """``key`` of ``base`` is the id of a row of ``table``. In a left join rows without a key are dealt out by their own id, else one task would read them all."""
    same = F.col(f"{base}.{key}") == F.col(f"{table}.id")
    return (F.coalesce(F.col(f"{base}.{key}"), F.col(f"{base}.id")) == F.col(f"{table}.id")) & same if how == "left" else same


def listing(warehouse: Warehouse, name: str, run: str) -> DataFrame:
    """A listing report."""
    base_name, joins, columns = LISTINGS[name]
    rows = warehouse[base_name].alias(base_name).where(F.col(f"{base_name}.run_id") == run)
    if name in CONDITIONS:
        rows = rows.where(CONDITIONS[name])
    for table, key, how in joins:
        other = warehouse[table].alias(table)
        if key:
            test = _points_to(base_name, key, table, how)
        else:
            test = F.col(f"{table}.attempt_id") == F.col(f"{base_name}.id")
        rows = rows.join(other.hint("shuffle_hash") if table in PARENTS else other, test, how)
    chosen = []
    for column in columns.split():
        path, _, alias = column.partition("=")
        path = path if "." in path else f"{base_name}.{path}"
        chosen.append(F.col(path).alias(alias or path.split(".")[1]))
    return rows.select(*chosen)


def _file_of_row() -> Column:
    """A row's output_file_id is file_id; rows without a file are dealt out as in listings."""
    return F.expr("coalesce(output_file_id, id) = file_id AND output_file_id = file_id")


def _of_stacks(warehouse: Warehouse, table: str, run: str) -> DataFrame:
    """Rows of a table with the name of their stack, for stacks of the run."""
    stacks = warehouse["stacks"].where(F.col("run_id") == run).select(F.col("id").alias("stack_id"), "stack_name", "import_input")
    return warehouse[table].drop("run_id").join(stacks, "stack_id")


def _of_run(warehouse: Warehouse, table: str, run: str) -> DataFrame:
    return warehouse[table].where(F.col("run_id") == run)


def chunk_usage(warehouse: Warehouse, run: str) -> DataFrame:
    """Chunks by type, status and understood. stack_count counts chunks, as it always has."""
    return _of_stacks(warehouse, "binary_chunks", run).groupBy("chunk_type", "status", "understood").agg(
        F.count("*").alias("stack_count"), sorted_list("stack_name").alias("stacks")
    )


def chunk_type_counts(warehouse: Warehouse, run: str) -> DataFrame:
    def having(test: Column, name: str) -> Column:
        return F.count_if(test).alias(name)

    return _of_stacks(warehouse, "binary_chunks", run).groupBy("chunk_type").agg(
        F.count("*").alias("chunk_count"),
        F.count_distinct("stack_id").alias("stack_count"),
        having(F.col("understood") == 1, "understood_count"),
        having(F.col("understood") == 0, "not_understood_count"),
        *[having(F.col("status") == s, f"{s}_count") for s in ("parsed", "derived_from_output", "skipped", "unhandled")],
        F.coalesce(F.sum("chunk_bytes"), F.lit(0)).alias("total_chunk_bytes"),
        sorted_list("stack_name").alias("stacks"),
    )


def embedded_file_usage(warehouse: Warehouse, run: str) -> DataFrame:
    """Equal embedded files and the stacks that hold them."""
    return _of_stacks(warehouse, "embedded_files", run).groupBy("embedded_kind", "logical_kind", "sha256", "bytes").agg(
        F.count("*").alias("occurrence_count"), sorted_list("stack_name").alias("stacks")
    )


def external_code_usage(warehouse: Warehouse, run: str) -> DataFrame:
    rows = _of_run(warehouse, "external_code_resources", run)
    return rows.groupBy("platform", "instruction_format", "container_format", "external_kind").agg(
        F.count("*").alias("occurrence_count"),
        F.count_distinct("payload_sha256").alias("distinct_hashes"),
        F.sum(F.coalesce("payload_bytes", F.lit(0))).alias("total_bytes"),
        sorted_list("resource_type").alias("resource_types"),
    )


def disassembly_summary(warehouse: Warehouse, run: str) -> DataFrame:
    files = warehouse["output_files"].select(F.col("id").alias("file_id"), F.col("bytes").alias("file_bytes"))
    rows = _of_run(warehouse, "external_code_resources", run).join(files, _file_of_row(), "left")
    path = F.when(F.col("disassembly_rel_path") != "", F.col("disassembly_rel_path"))
    return rows.groupBy("platform", "instruction_format", "disassembly_status").agg(
        F.count("*").alias("resource_count"),
        F.count_distinct("stack_id").alias("stack_count"),
        F.count_distinct("payload_sha256").alias("distinct_payload_count"),
        F.sum(F.coalesce("payload_bytes", F.lit(0))).alias("payload_bytes"),
        F.count_distinct(path).alias("disassembly_file_count"),
        F.sum(F.coalesce("file_bytes", F.lit(0))).alias("disassembly_bytes"),
    )


def disassembly_files_summary(warehouse: Warehouse, run: str) -> DataFrame:
    attempts = _of_run(warehouse, "import_attempts", run).select(F.col("id").alias("attempt_id"))
    rows = warehouse["output_files"].where(F.col("rel_path").ilike(DISASSEMBLY)).join(attempts, "attempt_id")
    return rows.groupBy("extension", "kind", "logical_kind").agg(
        F.count("*").alias("file_count"), F.count_distinct("sha256").alias("distinct_file_count"), F.sum("bytes").alias("disassembly_bytes")
    )


def unindexed_disassembly_files(warehouse: Warehouse, run: str) -> DataFrame:
    """Disassemblies that no code resource points to."""
    pointed = warehouse["external_code_resources"].select(F.col("output_file_id").alias("id"))
    rows = _of_stacks(warehouse, "output_files", run).where(F.col("rel_path").ilike(DISASSEMBLY)).join(pointed, "id", "left_anti")
    return rows.select("stack_name", "import_input", "rel_path", "bytes", "sha256", "logical_kind", "logical_id")


def external_binary_usage(warehouse: Warehouse, run: str) -> DataFrame:
    rows = _of_run(warehouse, "external_binary_files", run)
    return rows.groupBy("external_kind", "extension", "finder_type", "binary_type").agg(
        F.count("*").alias("occurrence_count"), F.count_distinct("sha256").alias("distinct_hashes"), F.sum("bytes").alias("total_bytes")
    )


def format_gap_counts(warehouse: Warehouse, run: str) -> DataFrame:
    return _of_run(warehouse, "format_gaps", run).groupBy("kind").agg(F.count("*").alias("count"))


# --- disassembly calls -------------------------------------------------------------------

ADDRESS_DIGITS = 8
#: A group of instruction bytes has so many hexadecimal digits.
GROUP_DIGITS = (4, 8)
#: What sets a tool's note off from the operands: a word with a colon.
NOTE = r" ; \w+:"


def _hexadecimal(token: Column, least: int, most: int) -> Column:
    return F.length(token).between(least, most) & (F.translate(F.lower(token), "0123456789abcdef", "") == "")


def listing_line(line: Column) -> Column:
    """struct(address, mnemonic, operands, annotation) of a line of a disassembly; null for other lines.

    A line is an address, groups of instruction bytes, a mnemonic and the rest. All leading groups of
    hexadecimal digits are bytes; where no mnemonic follows them, the last is the mnemonic if it begins with a letter.
    """
    worded = lambda t: F.coalesce(F.regexp_like(t, F.lit("^[A-Za-z.]")), F.lit(False))

    def fields(bare: Column, tokens: Column, groups: Column) -> Column:
        def parts(rest: Column) -> Column:
            mnemonic = F.regexp_extract(rest, "^[A-Za-z.]+", 0)
            noted = F.split(F.concat(F.lit(" "), F.trim(F.substring(rest, F.length(mnemonic) + 1, F.length(rest)))), NOTE, 2)
            return F.struct(
                F.upper(F.get(tokens, F.lit(0))).alias("address"), F.lower(mnemonic).alias("mnemonic"), F.trim(F.get(noted, F.lit(0))).alias("operands"),
                F.trim(F.coalesce(F.get(noted, F.lit(1)), F.lit(""))).alias("annotation"),
            )

        return F.when((groups > 0) & worded(F.get(tokens, groups + 1)), bind(F.element_at(F.split(bare, " +", groups + 2), groups + 2), parts))

    def grouped(bare: Column, tokens: Column) -> Column:
        other = F.array_position(F.transform(F.slice(tokens, F.lit(2), F.size(tokens)), lambda t: _hexadecimal(t, *GROUP_DIGITS)), False)
        run = F.when(other > 0, other - 1).otherwise(F.size(tokens) - 1).cast("int")
        groups = bind(run, lambda n: F.when(worded(F.get(tokens, n + 1)), n).otherwise(n - 1))
        addressed = _hexadecimal(F.get(tokens, F.lit(0)), ADDRESS_DIGITS, ADDRESS_DIGITS)
        return F.when(addressed, bind(groups, lambda n: fields(bare, tokens, n)))

    return bind(F.trim(F.regexp_replace(line, r"\s", " ")), lambda bare: bind(F.split(bare, " +"), lambda tokens: grouped(bare, tokens)))


def disassembly_calls(texts: DataFrame) -> DataFrame:
    """A row for each call, jump out or return in disassembly texts (any columns, platform, text)."""
    keep = [c for c in texts.columns if c != "text"]
    lines = texts.select(*keep, F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "instruction"))
    parsed = lines.withColumn("said", listing_line(F.col("instruction"))).where("said IS NOT NULL").select("*", (F.col("n") + 1).alias("line"), "said.*")
    m68k, ppc = F.col("platform") == "mac68k", F.col("platform") == "macppc"
    mnemonic, note, operands = F.col("mnemonic"), F.col("annotation"), F.col("operands")

    def said(kind: str | Column, target: str | Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        target = F.lit(target) if isinstance(target, str) else target
        return F.struct(kind.alias("call_kind"), target.alias("target"))

    trap = F.when(note.contains("Toolbox trap"), "toolbox_trap").otherwise("os_trap")
    leave = F.when(note.contains("possible extension exit"), "extension_exit").otherwise("control_transfer")
    call = (
        F.when(m68k & (mnemonic == "syscall"), said(trap, F.element_at(F.split(operands, r"\s+"), 1)))
        .when(m68k & mnemonic.isin("jsr", "jmp", "bsr"), said(leave, operands))
        .when(m68k & (mnemonic == "rts"), said("extension_return", "rts"))
        .when(ppc & mnemonic.isin("bl", "bla"), said("branch_link", operands))
        .when(ppc & mnemonic.isin("bctrl", "bcctrl", "bclrl", "blrl"), said("extension_exit", mnemonic))
        .when(ppc & (mnemonic == "blr"), said("extension_return", "blr"))
        .when(ppc & (mnemonic == "sc"), said("system_call", "sc"))
    )
    calls = parsed.withColumn("call", call).where("call IS NOT NULL")
    return calls.select(*keep, "address", "line", "call.*", "mnemonic", "operands", "annotation", F.trim("instruction").alias("instruction"))


def disassembly_call_audit(warehouse: Warehouse, run: str, texts: DataFrame) -> DataFrame:
    """Calls of all present disassemblies; ``texts`` (path, text) are the files read."""
    present = "disassembly_status = 'present' AND disassembly_rel_path != ''"
    code = _of_run(warehouse, "external_code_resources", run).where(present).drop("run_id")
    stacks = warehouse["stacks"].select(F.col("id").alias("stack_id"), "stack_name", "import_input", "output_package")
    files = warehouse["output_files"].select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    joined = code.join(stacks, "stack_id").join(files, _file_of_row(), "left")
    path = F.coalesce("file_path", F.concat("output_package", F.lit("/"), "disassembly_rel_path"))
    named = joined.withColumn("path", path).join(texts, "path").select(
        "stack_name", "import_input", "resource_type", "resource_id", "resource_name", "platform", "instruction_format", "disassembly_rel_path", "text"
    )
    return disassembly_calls(named)


def disassembly_call_usage(audit: DataFrame) -> DataFrame:
    """Calls by platform, format, kind, target and mnemonic, with distinct resources and stacks."""
    resource = F.concat_ws(":", "stack_name", "resource_type", F.col("resource_id").cast("string"), "resource_name")
    return audit.groupBy("platform", "instruction_format", "call_kind", "target", "mnemonic").agg(
        F.count("*").alias("occurrence_count"), F.count_distinct(resource).alias("resource_count"), F.count_distinct("stack_name").alias("stack_count")
    )


# --- statistics ----------------------------------------------------------------------------

#: table -> the number that its rows carry, if any.
NUMBERS = {"output_files": "bytes", "parsed_parts": "script_bytes", "parsed_content": "text_bytes", "binary_chunks": "understood", "embedded_files": "bytes"}
#: table -> metric -> the value that its rows are counted by; at most two, which are d1 and d2 below.
GROUPED: dict[str, dict[str, str]] = {
    "output_files": {"output_file_kind": "kind", "logical_file_kind": "logical_kind"},
    "parsed_objects": {"object_kind": "object_kind"},
    "parsed_parts": {"part_type": "part_type"},
    "json_sections": {"json_tag": "tag"},
    "binary_chunks": {"binary_chunk_type": "chunk_type", "binary_chunk_status": "status"},
    "embedded_files": {"embedded_file_kind": "embedded_kind"},
    "external_code_resources": {
        "external_code_platform": "platform || ':' || instruction_format || ':' || container_format", "external_code_kind": "external_kind",
    },
}
#: table -> metric -> what a row of number n and values d1 and d2 adds to it (nulls add nothing).
SCALARS: dict[str, dict[str, str]] = {
    "output_files": {
        "output_file_count": "1", "output_file_bytes": "n", "json_file_count": "int(d1 = 'json')", "image_file_count": "int(d1 = 'image')", "raw_file_count": "int(d1 = 'raw')",
    },
    "json_sections": {"json_section_count": "1"},
    "parsed_objects": {"parsed_object_count": "1"},
    "parsed_parts": {"part_count": "1", "part_script_bytes": "n"},
    "parsed_content": {"content_count": "1", "content_bytes": "n"},
    "media_refs": {"media_ref_count": "1"},
    "binary_chunks": {"binary_chunk_count": "1", "understood_chunk_count": "int(n = 1)", "not_understood_chunk_count": "int(n = 0)"},
    "embedded_files": {"embedded_file_count": "1", "embedded_file_bytes": "n"},
    "external_code_resources": {"external_code_resource_count": "1"},
}
#: Stacks a task: what it sums by metric and value stays in memory.
STACKS_A_TASK = 25_000


def stack_statistics(warehouse: Warehouse, run: str) -> DataFrame:
    """(stack_id, metric, detail, value) of every stack: one pass over each table, one exchange of narrow rows for all.

    A row goes to its stack's task with its number and values alone, and is spread to what it adds to each metric there, so
    no metric's name is exchanged or sorted. Every stack has all scalar metrics, at least with 0. A null detail and an empty one stay apart; both show as ''.
    """
    tables = list(SCALARS)

    def addition(metric: str, detail: Column, value: str) -> Column:
        return F.struct(F.lit(metric).alias("metric"), detail.alias("detail"), F.expr(value).cast("long").alias("value"))

    def carried(at: int, table: str) -> DataFrame:
        values = [F.expr(x) for x in GROUPED.get(table, {}).values()]
        values += [F.lit(None)] * (2 - len(values))
        number = F.expr(NUMBERS.get(table, "NULL")).cast("long")
        rows = warehouse[table].where("stack_id IS NOT NULL")
        return rows.select("stack_id", F.lit(at).alias("source"), number.alias("n"), *[x.cast("string").alias(f"d{i}") for i, x in enumerate(values, 1)])

    def additions(table: str) -> Column:
        scalars = [addition(m, F.lit(""), x) for m, x in SCALARS[table].items()]
        return F.array(*scalars, *[addition(m, F.col(f"d{i}"), "1") for i, m in enumerate(GROUPED.get(table, {}), 1)])

    stacks = _of_run(warehouse, "stacks", run).select(F.col("id").alias("stack_id"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("n", "long"), ("d1", "string"), ("d2", "string"))]
    every = stacks.select("stack_id", F.lit(-1).alias("source"), *none)
    for at, table in enumerate(tables):
        every = every.unionByName(carried(at, table))
    spread = F.when(F.col("source") == -1, F.array(*[addition(m, F.lit(""), "0") for metrics in SCALARS.values() for m in metrics]))
    for at, table in enumerate(tables):
        spread = spread.when(F.col("source") == at, additions(table))
    parts = max(warehouse.spark.sparkContext.defaultParallelism, -(-stacks.count() // STACKS_A_TASK))
    # an inner join with single ids: a semi join would go below the union, with an exchange for each table
    known = stacks.repartition(parts, "stack_id").distinct().hint("shuffle_hash")
    rows = every.repartition(parts, "stack_id").join(known, "stack_id").select("stack_id", F.inline(spread))
    summed = rows.groupBy("stack_id", "metric", "detail").agg(F.sum("value").alias("value"))
    return summed.withColumn("detail", F.coalesce("detail", F.lit("")))


# --- export ------------------------------------------------------------------------------

REPORTS: dict[str, Callable[[Warehouse, str], DataFrame]] = {
    **{name: lambda w, run, name=name: listing(w, name, run) for name in LISTINGS},
    "chunk_usage": chunk_usage, "chunk_type_counts": chunk_type_counts, "embedded_file_usage": embedded_file_usage,
    "external_code_usage": external_code_usage, "disassembly_summary": disassembly_summary, "disassembly_files_summary": disassembly_files_summary,
    "unindexed_disassembly_files": unindexed_disassembly_files, "external_binary_usage": external_binary_usage, "format_gap_counts": format_gap_counts,
}


def ordered(report: DataFrame, name: str) -> DataFrame:
    """A report in its export order; nulls come first."""
    keys = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_first() for c in ORDER[name].split()]
    return report.orderBy(*keys)


def embedded_selection(warehouse: Warehouse, run: str, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Embedded files to convert, of the given kinds, the first ``limit`` in order.

    Nulls come last, as in the SQL; rows that tie in the order are told apart by their other columns, so that the same rows are cut off in every run.
    """
    files = warehouse["output_files"].select(F.col("id").alias("file_id"), F.col("path").alias("source_path"))
    rows = _of_stacks(warehouse, "embedded_files", run).join(files, _file_of_row(), "left")
    if kinds:
        rows = rows.where(F.col("embedded_kind").isin(*kinds))
    rows = rows.select("id", "stack_name", "rel_path", "embedded_kind", "logical_kind", "logical_id", "sha256", "source_path")
    order = [F.col(c).asc_nulls_last() for c in ("stack_name", "embedded_kind", "rel_path", "id", "source_path", "logical_kind", "logical_id", "sha256")]
    return rows.orderBy(*order).limit(limit) if limit else rows
