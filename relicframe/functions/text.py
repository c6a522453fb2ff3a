"""Column expressions over text: script lines, words, literals, logs, names."""

from __future__ import annotations

from collections.abc import Callable

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that start a script statement without calling anything (fixed values).
CONTROL_WORDS = (
    "if", "else", "repeat", "end", "put", "set", "get", "global", "local", "return", "exit", "pass",
    "then", "case", "switch", "answer", "ask", "wait", "send", "do", "hide", "show", "on", "function",
)


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def trim_control(text: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def first_word(text: Column) -> Column:
    """The first run of ASCII letters, digits and underscores that starts with no digit; empty if none."""
    return F.regexp_extract(text, r"[A-Za-z_][A-Za-z0-9_]*", 0)


def script_lines(text: Column) -> Column:
    """Lines ended by CR, LF or CRLF; a trailing end makes an empty last line."""
    return F.split(text, "\r\n|\r|\n")


def quoted_literals(line: Column) -> Column:
    """Texts between double quotes; a doubled quote stands for one, and an open literal counts."""
    found = F.regexp_extract_all(line, F.lit(r'"((?:[^"]|"")*)("|$)'), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit('""'), F.lit('"')))


def is_statement(trimmed: Column) -> Column:
    """Neither empty nor a comment."""
    return (trimmed != "") & ~trimmed.startswith("--")


def is_control_word(lower_word: Column) -> Column:
    return lower_word.isin(*CONTROL_WORDS)


def looks_external(lower_word: Column, resource_backed: Column) -> Column:
    """Whether a call seems to leave the script: a known code resource, or a telling name."""
    return resource_backed | lower_word.startswith("x") | lower_word.startswith("ht") | (lower_word == "playqt")


def reference_kind(lower_line: Column, lower_literal: Column) -> Column:
    """What a literal in a script line refers to; null for nothing known. The first rule that holds counts."""

    def line(*parts: str) -> Column:
        return _any([lower_line.contains(p) for p in parts])

    def literal(*parts: str) -> Column:
        return _any([lower_literal.contains(p) for p in parts])

    return (
        F.when(line("playqt", "movie") | literal(".mov", " moov", " mov"), "movie")
        .when(line("start using stack", " in stack "), "stack")
        .when(line("go card", "go to card"), "card")
        .when(line("sound"), "sound")
        .when(line("htaddpict", "htchangepict", "picture"), "picture")
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ansi(text: Column) -> Column:
    """Without terminal colour sequences; line ends become LF."""
    return F.regexp_replace(F.regexp_replace(text, "\x1b\\[[0-?]*[ -/]*[@-~]", ""), "\r\n?", "\n")


def extension(path: Column) -> Column:
    """Lower-case suffix of a file name; sit.hqx is one suffix."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(name.endswith(".sit.hqx"), "sit.hqx").otherwise(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def safe_name(text: Column) -> Column:
    """A file name without separators and control characters."""
    return F.regexp_replace(text, r'[\x00-\x1F/\\:*?"<>|]', "_")


def tsv_cell(text: Column) -> Column:
    """A value on one line without tabs."""
    return F.translate(F.coalesce(text, F.lit("")), "\t\r\n", "   ")


def line_count(text: Column) -> Column:
    """Lines as Python's splitlines counts them: no empty line after a trailing end."""
    ends = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    closed = F.regexp_count(text, F.lit(ends))
    open_end = (F.length(text) > 0) & ~text.rlike(f"({ends})$(?![\\s\\S])")
    return closed + F.when(open_end, 1).otherwise(0)


def sample_of(text: Column, length: int = 240) -> Column:
    return F.left(text, F.lit(length))


def string_confidence(text: Column, pascal: Column) -> Column:
    """How likely a run of printable ASCII is a text; null for one that is not plausible."""
    n = F.length(text)
    letters, marks = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]"))
    wordy = F.regexp_count(text, F.lit("[A-Za-z0-9]"))
    odd = (n == 0) | (wordy == 0) | ((n < 6) & (letters < 3)) | ((n <= 5) & (marks > 1))
    sure = F.when(pascal, 72).otherwise(65) + F.when(n >= 8, 8).otherwise(0) + F.when(n >= 16, 5).otherwise(0) + F.when(marks == 0, 4).otherwise(0)
    return F.when(~odd, sure / 100)
