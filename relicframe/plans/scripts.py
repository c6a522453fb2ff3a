"""Index of scripts: handlers, calls, calls out, literals and references.

Lines are exploded once; everything after is filters, first-occurrence windows
within a script, and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, first_word, is_control_word, is_statement, looks_external, quoted_literals, reference_kind, script_lines, trim_control


def statements(scripts: DataFrame, keys: list[str], text: str = "script") -> DataFrame:
    """(keys, line, text, lower, word, command): lines that are neither empty nor comments."""
    lines = scripts.select(*keys, F.posexplode(script_lines(F.col(text))).alias("n", "raw"))
    trimmed = lines.select(*keys, (F.col("n") + 1).alias("line"), trim_control(F.col("raw")).alias("text")).where(is_statement(F.col("text")))
    trimmed = trimmed.withColumns({"lower": ascii_lower(F.col("text")), "word": first_word(F.col("text"))})
    return trimmed.withColumn("command", ascii_lower(F.col("word")))


def handlers(lines: DataFrame, keys: list[str]) -> DataFrame:
    function = F.col("lower").startswith("function ")
    rest = F.when(function, F.expr("substring(text, 10)")).otherwise(F.expr("substring(text, 4)"))
    found = lines.where(function | F.col("lower").startswith("on ")).select(
        *keys, first_word(rest).alias("name"), F.when(function, "function").otherwise("message").alias("kind"), "line"
    )
    return found.where("name != ''")


def calls(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("command") != "") & ~is_control_word(F.col("command")))


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each ``by``."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def call_counts(lines: DataFrame) -> DataFrame:
    """(command, n) over all scripts, every occurrence."""
    return calls(lines).groupBy("command").agg(F.count("*").alias("n"))


def external_calls(lines: DataFrame, keys: list[str], external_names: DataFrame) -> DataFrame:
    """First call of each command that leaves the script; external_names (name) are code resources."""
    known = external_names.where("name != ''").select(ascii_lower(F.col("name")).alias("command")).distinct().withColumn("resource_backed", F.lit(True))
    marked = calls(lines).join(known, "command", "left").withColumn("resource_backed", F.coalesce("resource_backed", F.lit(False)))
    return first_of(marked.where(looks_external(F.col("command"), F.col("resource_backed"))), [*keys, "command"], ["line"])


def literals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, place, literal, kind) of every quoted text."""
    found = lines.select(*keys, "line", "lower", F.posexplode(quoted_literals(F.col("text"))).alias("place", "literal"))
    return found.withColumn("kind", reference_kind(F.col("lower"), ascii_lower(F.col("literal")))).drop("lower")


def references(literal_rows: DataFrame, keys: list[str]) -> DataFrame:
    """First reference to each (kind, literal) of a script."""
    return first_of(literal_rows.where("kind IS NOT NULL"), [*keys, "kind", "literal"], ["line", "place"])


def reference_counts(literal_rows: DataFrame) -> DataFrame:
    return literal_rows.where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


def script_index(scripts: DataFrame, keys: list[str], external_names: DataFrame) -> DataFrame:
    """(keys, index): JSON with the handlers, calls, external calls, literals and references of each script."""
    lines = statements(scripts, keys)
    found = literals(lines, keys)
    pieces = {
        "handlers": handlers(lines, keys).select(*keys, F.struct("line", "name", "kind").alias("x")),
        "calls": first_of(calls(lines), [*keys, "command"], ["line"]).select(*keys, F.struct("line", F.col("word").alias("name")).alias("x")),
        "external_calls": external_calls(lines, keys, external_names).select(*keys, F.struct("line", F.col("word").alias("name"), "resource_backed").alias("x")),
        "string_literals": first_of(found, [*keys, "literal"], ["line", "place"]).select(*keys, F.struct("line", "place", F.col("literal").alias("value")).alias("x")),
        "references": references(found, keys).select(*keys, F.struct("line", "place", "kind", F.col("literal").alias("value")).alias("x")),
    }
    out = scripts.select(*keys)
    for name, rows in pieces.items():
        out = out.join(rows.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias(name)), keys, "left")
    return out.select(*keys, F.to_json(F.struct(*pieces)).alias("index"))
