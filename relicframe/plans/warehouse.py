"""The corpus warehouse: schemas, linking steps, upkeep.

Tables are Parquet, partitioned by run. Row ids are dense numbers over a
documented order, so a rerun of a run gives the same ids. What a row store would
update in place is recomputed as a column; a rerun overwrites its
own partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import bind, line_count, sample_of
from ..operators.relational import anti_null_safe, sent_if_small, upsert
from ..scratch import written

#: Bits that a row's number within its partition takes in monotonically_increasing_id.
ROW_BITS = 33

#: Columns of each table (fixed values of the data model); text unless a type is given.
TABLES = {
    "runs": "run_id, started_at, finished_at, input_root, output_root, importer, git_revision, sources bigint, stacks bigint, imported bigint, failed bigint",
    "source_files": "id bigint, run_id, path, rel_path, bytes bigint, extension, sha256, status",
    "extracted_files": "id bigint, source_id bigint, run_id, path, rel_path, bytes bigint, extension, finder_type, binary_type, binary_size bigint, decision, reason",
    "external_binary_files": "id bigint, run_id, source_id bigint, extracted_file_id bigint, archive_input, external_input, path, bytes bigint, extension, finder_type, binary_type, binary_size bigint, sha256, external_kind, classification_reason",
    "import_attempts": "id bigint, run_id, source_id bigint, archive_input, import_input, status, exit_code bigint, warnings bigint, errors bigint, status_lines bigint, blocks bigint, resources bigint, log_path, output_package",
    "stacks": "id bigint, run_id, attempt_id bigint, stack_name, import_input, output_package, card_count_declared bigint, card_width bigint, card_height bigint, project_user_level bigint, created_by_version, last_compacted_version, last_edited_version, first_edited_version, font_table_id bigint, style_table_id bigint, stack_script_bytes bigint",
    "diagnostics": "id bigint, run_id, attempt_id bigint, severity, line bigint, gap_kind, message",
    "status_messages": "id bigint, run_id, attempt_id bigint, line bigint, message",
    "output_files": "id bigint, run_id, attempt_id bigint, stack_id bigint, path, rel_path, bytes bigint, extension, kind, logical_kind, logical_id bigint, referenced_by, sha256",
    "json_sections": "id bigint, run_id, attempt_id bigint, stack_id bigint, file_rel_path, depth bigint, tag, attrs_json, text_size bigint",
    "parsed_objects": "id bigint, run_id, attempt_id bigint, stack_id bigint, output_file_id bigint, object_kind, object_id bigint, name",
    "parsed_parts": "id bigint, run_id, stack_id bigint, output_file_id bigint, container_kind, container_id bigint, part_id bigint, part_type, name, style, visible, enabled, shared_text, lock_text, text_align, font, text_size bigint, text_style, rect_left bigint, rect_top bigint, rect_right bigint, rect_bottom bigint, script_bytes bigint",
    "parsed_content": "id bigint, run_id, stack_id bigint, output_file_id bigint, container_kind, container_id bigint, layer, part_id bigint, text_bytes bigint, line_count bigint, sha256, sample",
    "media_refs": "id bigint, run_id, stack_id bigint, output_file_id bigint, rel_path, media_kind",
    "binary_chunks": "id bigint, run_id, attempt_id bigint, stack_id bigint, output_file_id bigint, chunk_type, chunk_id bigint, chunk_bytes bigint, status, understood bigint, evidence, log_line bigint",
    "embedded_files": "id bigint, run_id, attempt_id bigint, stack_id bigint, output_file_id bigint, rel_path, embedded_kind, logical_kind, logical_id bigint, bytes bigint, sha256, referenced_by, source_chunk_type, source_chunk_id bigint",
    "external_code_resources": "id bigint, run_id, attempt_id bigint, stack_id bigint, output_file_id bigint, resource_type, resource_id bigint, resource_name, external_kind, platform, instruction_format, container_format, payload_bytes bigint, payload_sha256, disassembly_status, disassembly_rel_path",
    "stack_statistics": "run_id, stack_id bigint, attempt_id bigint, metric, detail, value bigint",
    "format_gaps": "id bigint, run_id, attempt_id bigint, kind, detail, subject, log_path",
    "embedded_conversions": "run_id, embedded_file_id bigint, target_format, status, output_path, sha256, message, converted_at",
}


def schema(table: str) -> str:
    """DDL schema of a warehouse table."""
    fields = [f.strip() for f in TABLES[table].split(",")]
    return ", ".join(f if " " in f else f"{f} string" for f in fields)


class Warehouse:
    """The tables of one warehouse folder, or DataFrames (or functions that make them) given by name."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None) -> None:
        self.spark, self.folder, self.tables = spark, folder, dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            if self.folder is None:
                self.tables[name] = self.spark.createDataFrame([], schema(name))
            else:
                self.tables[name] = self.spark.read.schema(schema(name)).parquet(f"{self.folder}/{name}")
        if not isinstance(self.tables[name], DataFrame):
            self.tables[name] = self.tables[name]()
        return self.tables[name]

    def save(self, name: str, rows: DataFrame) -> None:
        """Write the rows of one or more runs, replacing those runs and no others."""
        columns = [f.split()[0].strip() for f in schema(name).split(", ")]
        writer = rows.select(*columns).write.mode("overwrite").partitionBy("run_id")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{name}")


def dense_ids(rows: DataFrame, order: list[str], by: list[str] | None = None, start: Column | int = 1) -> DataFrame:
    """``rows`` with ``id`` counting over the order within each of ``by`` (run_id by default).

    The order must be total: rows that tie in it may swap numbers between runs. Rows are sorted once into ranges of (by, order),
    written with their number within the range, and numbered by the counts of the
    ranges before; no task takes a whole run, and the driver sees one count a range.
    """
    by = by or ["run_id"]
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranges.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)}), "dense-ids")
    before, offsets = 0, []
    for r in placed.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(offsets, "_range int, _offset long")
    numbered = placed.join(F.broadcast(starts), "_range").withColumn("_number", F.col("_offset") + F.col("_row"))
    # few groups are sent to every task: joined by their keys, all rows of one run would be read by one task
    firsts = sent_if_small(written(numbered.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_number").alias("_first")), "first-ids"))
    same = F.lit(True)
    for c in by:
        same = same & numbered[c].eqNullSafe(firsts[f"_{c}"])
    joined = numbered.join(firsts, same)
    return joined.withColumn("id", F.col("_number") - F.col("_first") + start).select(*[c for c in rows.columns if c != "id"], "id")


# --- loaders ---------------------------------------------------------------------------

def log_lines(logs: DataFrame) -> DataFrame:
    """(run_id, attempt_id, line, message) of logs (run_id, attempt_id, log)."""
    lines = F.posexplode(F.split("log", "\n")).alias("n", "message")
    return logs.select("run_id", "attempt_id", lines).select("run_id", "attempt_id", (F.col("n") + 1).cast("long").alias("line"), "message")


def _only(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "") == ""


def _digits(text: Column) -> Column:
    """A whole number in decimal digits, perhaps negative; else null."""
    return bind(F.regexp_replace(text, "^-", ""), lambda bare: F.when((bare != "") & _only(bare, "0123456789"), text.try_cast("long")))


def _said(status: str, kind: Column, number: Column, size: Column, understood: int) -> Column:
    return F.struct(
        F.upper(F.trim(kind)).alias("chunk_type"), number.alias("chunk_id"), size.cast("long").alias("chunk_bytes"), F.lit(status).alias("status"), F.lit(understood).cast("long").alias("understood"),
    )


def _block_said(told: Column) -> Column:
    """What a status says of a block: a verb, the type in quotes, ``#`` and the number, perhaps a hexadecimal word, and the size in parentheses."""

    def rest(quoted: Column) -> Column:
        verb, kind = F.get(quoted, F.lit(0)), F.get(quoted, F.lit(1))
        marks = F.regexp_replace(F.get(quoted, F.lit(2)), "[^#()]", "")

        def fields(cut: Column) -> Column:
            words, size = F.split(F.get(cut, F.lit(1)), " "), F.split(F.get(cut, F.lit(2)), " ")
            number, n = _digits(F.get(words, F.lit(0))), _digits(F.get(size, F.lit(0)))
            word = F.trim(F.array_join(F.slice(words, 2, F.size(words)), " "))
            # a blank stands before "#" and before "("
            fits = F.startswith(marks, F.lit("#()")) & (F.get(cut, F.lit(0)) == " ") & (F.element_at(words, -1) == "") & (F.get(size, F.lit(1)) == "bytes") & (kind != "") & number.isNotNull() & (n >= 0)
            parsed = fits & (verb == "Processing ") & _only(F.lower(word), "0123456789abcdef")
            return F.when(parsed, _said("parsed", kind, number, n, 1)).when(fits & (verb == "Skipping ") & (word == ""), _said("skipped", kind, number, n, 1))

        return bind(F.split(F.get(quoted, F.lit(2)), "[#()]"), fields)

    return bind(F.split(told, "'", 3), rest)


def _block_left(left: Column) -> Column:
    """What a warning says of a block that nothing handles: blanks, four letters, digits or blanks, ``#`` and the number."""

    def fields(cut: Column) -> Column:
        head, tail = F.get(cut, F.lit(0)), F.get(cut, F.lit(1))
        bare, blank = F.right(head, F.lit(4)), F.left(head, F.length(head) - 4)
        number = _digits(F.get(F.split(tail, r"(?<=\d)(?!\d)", 2), F.lit(0)))
        fits = (F.length(head) > 4) & (F.trim(blank) == "") & _only(F.lower(bare), "abcdefghijklmnopqrstuvwxyz0123456789 ") & number.isNotNull()
        return F.when(fits, _said("unhandled", bare, number, F.lit(None), 0))

    return bind(F.split(left, " #", 2), fields)


def chunks_from_log(lines: DataFrame) -> DataFrame:
    """A row for each block that a log line tells of; the first status or warning of a line counts."""
    part = lambda mark: F.get(F.split("message", mark, 2), F.lit(1))
    message = F.col("message")
    found = F.coalesce(
        F.when(message.contains("Status: "), _block_said(part("Status: "))), F.when(message.contains("Warning: Skipping block"), _block_left(part("Warning: Skipping block")))
    )
    kept = lines.withColumn("found", found).where("found IS NOT NULL")
    return kept.select("run_id", "attempt_id", "found.*", F.col("message").alias("evidence"), F.col("line").alias("log_line"))


def diagnostics_from_log(lines: DataFrame) -> DataFrame:
    severity = F.when(F.col("message").contains("Error:"), "error").when(F.col("message").contains("Warning:"), "warning")
    kept = lines.withColumn("severity", severity).where("severity IS NOT NULL")
    return kept.select("run_id", "attempt_id", "severity", "line", classify.gap_kind(F.col("message")).alias("gap_kind"), "message")


def attempt_counts(lines: DataFrame) -> DataFrame:
    """Per attempt: warnings, errors, status lines, and the first numbers of blocks and resources."""

    def number(pattern: str) -> Column:
        return F.min_by(F.regexp_extract("message", pattern, 1).cast("long"), F.when(F.col("message").rlike(pattern), F.col("line")))

    return lines.groupBy("run_id", "attempt_id").agg(
        F.count_if(F.col("message").contains("Warning:")).alias("warnings"),
        F.count_if(F.col("message").contains("Error:")).alias("errors"),
        F.count_if(F.col("message").contains("Status:")).alias("status_lines"),
        number(r"(\d+) blocks").alias("blocks"),
        number(r"(\d+) resources").alias("resources"),
    )


def output_rows(files: DataFrame) -> DataFrame:
    """Package files (run_id, attempt_id, stack_id, rel_path, content) as output_files rows."""
    what = classify.logical_file(F.col("rel_path"))
    rows = files.withColumn("what", what).select(
        "run_id", "attempt_id", "stack_id", F.col("rel_path").alias("path"), "rel_path",
        F.octet_length("content").cast("long").alias("bytes"),
        F.regexp_extract(F.lower("rel_path"), r"\.([^./]+)$", 1).alias("extension"),
        classify.output_kind(F.col("rel_path")).alias("kind"),
        F.col("what.kind").alias("logical_kind"), F.col("what.id").alias("logical_id"),
        F.lit(None).cast("string").alias("referenced_by"), F.sha2("content", 256).alias("sha256"),
    )
    return dense_ids(rows, ["attempt_id", "rel_path", "sha256", "bytes"])


def content_rows(contents: DataFrame) -> DataFrame:
    """Text contents as parsed_content rows; text_bytes counts characters, as the warehouse always did."""
    rows = contents.withColumns({
        "text_bytes": F.length("text").cast("long"), "line_count": line_count(F.col("text")).cast("long"),
        "sha256": F.sha2(F.encode("text", "utf-8"), 256), "sample": sample_of(F.col("text")),
    })
    return dense_ids(rows.drop("text"), ["stack_id", "container_id", "part_id", "sha256"])


# --- linking ---------------------------------------------------------------------------

def link_media(media: DataFrame, outputs: DataFrame) -> DataFrame:
    """media_refs with output_file_id: the smallest id of the file of that name in the stack."""
    first = outputs.groupBy("stack_id", "rel_path").agg(F.min("id").alias("found"))
    return media.join(first, ["stack_id", "rel_path"], "left").withColumn("output_file_id", F.col("found")).drop("found")


def link_references(outputs: DataFrame, media: DataFrame, contents: DataFrame) -> DataFrame:
    """output_files with referenced_by: the first media ref, else the first content, else what it was."""
    by_media = media.groupBy("output_file_id").agg(F.min_by(F.concat(F.lit("media:"), F.col("rel_path")), "id").alias("m"))
    text = F.concat("container_kind", F.lit(":"), F.coalesce(F.col("container_id").cast("string"), F.lit("")))
    by_content = contents.groupBy("output_file_id").agg(F.min_by(text, "id").alias("c"))
    joined = outputs.join(by_media, outputs.id == by_media.output_file_id, "left").drop("output_file_id")
    joined = joined.join(by_content, outputs.id == by_content.output_file_id, "left").drop("output_file_id")
    return joined.withColumn("referenced_by", F.coalesce("m", "c", "referenced_by")).drop("m", "c")


def link_chunks(chunks: DataFrame, outputs: DataFrame) -> DataFrame:
    """binary_chunks with output_file_id of the file that a chunk of that type and id became."""
    typed = outputs.withColumn("chunk_type", classify.chunk_type(F.col("logical_kind"))).withColumnRenamed("logical_id", "chunk_id")
    first = typed.groupBy("stack_id", "chunk_type", "chunk_id").agg(F.min("id").alias("found"))
    return chunks.join(first, ["stack_id", "chunk_type", "chunk_id"], "left").withColumn("output_file_id", F.col("found")).drop("found")


def derived_chunks(chunks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Chunks that no log line told of but whose output is there; a null id equals a null id."""
    typed = outputs.where(F.col("logical_kind").isin(*classify.CHUNK_OF_LOGICAL)).select(
        "run_id", "attempt_id", "stack_id", F.col("id").alias("output_file_id"),
        classify.chunk_type(F.col("logical_kind")).alias("chunk_type"), F.col("logical_id").alias("chunk_id"),
    )
    fresh = anti_null_safe(typed, chunks, ["stack_id", "chunk_type", "chunk_id"])
    return fresh.withColumns({
        "chunk_bytes": F.lit(None).cast("long"), "status": F.lit("derived_from_output"), "understood": F.lit(1).cast("long"),
        "evidence": F.lit("output file"), "log_line": F.lit(None).cast("long"),
    })


def embedded_rows(outputs: DataFrame) -> DataFrame:
    """Media and raw outputs as embedded_files rows."""
    kept = outputs.where(F.col("kind").isin("image", "sound", "raw") | F.col("logical_kind").isin("pat", "bmap", "externalcommand", "externalfunction"))
    rows = kept.withColumns({
        "output_file_id": F.col("id"), "embedded_kind": classify.embedded_kind(F.col("kind"), F.col("logical_kind")),
        "source_chunk_type": classify.chunk_type(F.col("logical_kind")), "source_chunk_id": F.col("logical_id"),
    })
    return dense_ids(rows, ["output_file_id"])


def record_conversions(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """embedded_conversions with new results put in or over, one row for each file and format."""
    return upsert(known, fresh, ["embedded_file_id", "target_format"], "converted_at")


def run_totals(runs: DataFrame, sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """runs with counts of sources, attempts, imports and failures."""
    files = sources.groupBy("run_id").agg(F.count("*").alias("n_sources"))
    tried = attempts.groupBy("run_id").agg(
        F.count("*").alias("n_stacks"), F.count_if(F.col("exit_code") == 0).alias("n_imported"), F.count_if(F.col("exit_code") != 0).alias("n_failed")
    )
    joined = runs.join(files, "run_id", "left").join(tried, "run_id", "left")
    totals = {"sources": "n_sources", "stacks": "n_stacks", "imported": "n_imported", "failed": "n_failed"}
    return joined.withColumns({c: F.coalesce(n, F.lit(0)) for c, n in totals.items()}).drop(*totals.values())
