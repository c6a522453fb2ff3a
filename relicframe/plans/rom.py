"""Firmware analysis: strings, pointers, markers, instructions, functions, regions.

Input images are rows (rom_id, base, content); every result is keyed by rom_id,
so a corpus of images is one job. Addresses are absolute and regions half-open.
Only two scans need a walk inside an image, as where one hit ends decides where the
next may begin: the pointer tables and the resource maps.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import octets, unsigned
from ..functions.binary import address, field, i16, rom_id, sha256_upper, u8, u16, u32
from ..functions.text import string_confidence
from ..operators.relational import asof_join, contains_join, inside_any, islands, sent_if_small

#: Types whose names mark a resource (fixed values).
MARKERS = ("DRVR", "ndrv", "decl", "boot", "CODE", "PACK", "STR#", "STR ", "MENU", "ALRT", "DITL", "cfrg", "ptch", "rsrc")
MAX_MARKERS = 1000
MAX_OVERLAYS = 250
CLUSTER_GAP = 256
MIN_STRING = 4
#: Places that are tested for a resource map's header at once.
MAP_WINDOW = 1 << 20
PRINTABLE = re.compile(rb"[\x20-\x7E]{4}")
#: Types of a resource map with their counts and where their references begin.
MAP_TYPES = pa.list_(pa.struct([("type", pa.string()), ("n", pa.int64()), ("refs", pa.int64())]))


def identify(images: DataFrame) -> DataFrame:
    """(rom_id, base, content, bytes, crc32, sha256) of (base, content) rows."""
    c = F.col("content")
    return images.select(
        rom_id(c).alias("rom_id"), "base", "content", F.octet_length(c).cast("long").alias("bytes"),
        F.crc32(c).alias("crc32"), sha256_upper(c).alias("sha256"),
    )


def first_bytes(images: DataFrame) -> DataFrame:
    """(rom_id, start, end, hypothesis, confidence): what the first bytes of an image look like."""
    c, base = F.col("content"), F.col("base")
    calm = lambda i: (u8(c, i) == 0) | u8(c, i).between(32, 126)
    whole = F.octet_length(c) >= 4
    said = (
        F.when(whole & (u16(c, 0) == 0x4EF9), F.struct(F.lit("code").alias("hypothesis"), F.lit(0.80).alias("confidence")))
        .when(whole & calm(0) & calm(1), F.struct(F.lit("header").alias("hypothesis"), F.lit(0.45).alias("confidence")))
        .otherwise(F.struct(F.lit("mixed").alias("hypothesis"), F.lit(0.20).alias("confidence")))
    )
    return images.select("rom_id", base.alias("start"), (base + F.least(F.octet_length(c), F.lit(32))).alias("end"), said.alias("said")).select("rom_id", "start", "end", "said.*")


#: First words of images that are no 68K code: BOOT, JOLI, POWS; the word of an instruction without effect (fixed values).
OTHER_IMAGES = (0x424F4F54, 0x4A4F4C49, 0x504F5753)
IDLE_WORD = "4E71"


def headers(images: DataFrame) -> DataFrame:
    """(rom_id, machine_family, model): 68K by the reset jump or an idle instruction at an even place, and a printable first word."""
    c = F.col("content")
    jump = u32(c, 0) == 0x4EF90020
    idle = F.hex(c).rlike(f"^(?:.{{4}})*?{IDLE_WORD}") & ~u32(c, 0).isin(*OTHER_IMAGES)
    model = F.when(_latin(field(c, 0, 4)).rlike(r"^[\x20-\x7E]{4}$"), _latin(field(c, 0, 4)))
    return images.select("rom_id", F.when((F.octet_length(c) >= 32) & (jump | idle), "68K").otherwise("").alias("machine_family"), model.alias("model"))


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def ascii_strings(images: DataFrame, least: int = MIN_STRING) -> DataFrame:
    """Runs of printable ASCII with their offsets."""
    return _plausible(_found_texts(images, lambda data: ascii_runs(data, least)), False)


def ascii_runs(data: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    for m in re.finditer(rb"[\x20-\x7E]{%d,}" % least, data):
        yield m.start(), m.group()


def pascal_runs(data: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """Places whose byte counts printable bytes behind it, from left to right, each behind the one before."""
    code = np.frombuffer(data, np.uint8)
    # where the printable run that a byte is in ends; its own place for other bytes
    odd = np.flatnonzero((code < 0x20) | (code > 0x7E))
    ends = np.append(odd, len(code))[np.searchsorted(odd, np.arange(len(code)))]
    at = np.flatnonzero(code[:-1] >= least) if len(code) > 1 else np.zeros(0, np.int64)
    done = 0
    for i in at[at + 1 + code[at] <= ends[at + 1]].tolist():
        if i >= done:
            done = i + 1 + data[i]
            yield i, data[i + 1 : done]


def _found_texts(images: DataFrame, find: Callable[[bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(rom_id, base, offset, text) of what ``find`` yields for each image: one pass, nothing exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rom, base, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                hits = find(data.as_py() or b"")
                while part := list(islice(hits, 20_000)):
                    places, texts = zip(*part, strict=True)
                    fixed = [pa.array([x.as_py()] * len(part), x.type) for x in (rom, base)]
                    yield pa.RecordBatch.from_arrays(
                        [*fixed, pa.array(places, pa.int64()), pa.array([t.decode("ascii") for t in texts])], names=["rom_id", "base", "offset", "text"]
                    )

    return images.select("rom_id", F.col("base").cast("long").alias("base"), "content").mapInArrow(run, "rom_id string, base long, offset long, text string")


def pascal_strings(images: DataFrame, least: int = MIN_STRING) -> DataFrame:
    """Length-prefixed printable strings. One inside an earlier one is dropped, as scanning goes on behind a hit."""
    return _plausible(_found_texts(images, lambda data: pascal_runs(data, least)), True)


def _plausible(rows: DataFrame, pascal: bool) -> DataFrame:
    judged = rows.withColumn("confidence", string_confidence(F.col("text"), F.lit(pascal))).where("confidence IS NOT NULL")
    length = F.length("text").cast("long")
    return judged.select(
        "rom_id", "base", F.col("offset").cast("long").alias("offset"), (F.col("base") + F.col("offset")).alias("address"), "text", length.alias("length"),
        F.lit(pascal).alias("is_pascal"), "confidence",
    )


def strings(images: DataFrame, least: int = MIN_STRING) -> DataFrame:
    return ascii_strings(images, least).unionByName(pascal_strings(images, least))


def string_clusters(string_rows: DataFrame, least: int = 3) -> DataFrame:
    """Data regions where strings lie close together."""
    placed = string_rows.withColumn("end", F.col("address") + F.col("length"))
    grouped = islands(placed, ["rom_id"], "address", "end", CLUSTER_GAP)
    regions = grouped.groupBy("rom_id", "island").agg(F.min("address").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    return regions.where(F.col("n") >= least).select("rom_id", "start", "end", F.lit("string_cluster").alias("kind"), "n", F.lit(0.70).alias("confidence"))


def pointer_words(images: DataFrame) -> DataFrame:
    """Aligned words that are even addresses inside the image."""
    n = F.floor(F.octet_length("content") / 4)
    rows = images.where(n > 0).select("rom_id", "base", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    value = u32(F.col("content"), (F.col("k") * 4).cast("int"))
    inside = (F.col("target") >= F.col("base")) & (F.col("target") < F.col("base") + F.octet_length("content")) & (F.col("target") % 2 == 0)
    return rows.withColumn("target", value).where(inside).select("rom_id", (F.col("k") * 4).alias("offset"), "target")


def table_runs(data: bytes, base: int, least: int = 4) -> Iterator[tuple[int, list[int]]]:
    """(offset, targets) of runs of addresses; the walk restarts behind a run, else two bytes on."""
    end, at = base + len(data), 0
    while at + 4 * least <= len(data):
        targets = []
        for k in range(at, len(data) - 3, 4):
            value = int.from_bytes(data[k : k + 4], "big")
            if not base <= value < end or value % 2:
                break
            targets.append(value)
        if len(targets) >= least and len(set(targets)) >= 2:
            yield at, targets
            at += 4 * len(targets)
        else:
            at += 2


def pointer_tables(images: DataFrame, keep: int = 64) -> DataFrame:
    """(rom_id, address, entry_count, targets, confidence); at most ``keep`` targets are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rom, base, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [
                    {"rom_id": rom, "address": base + at, "entry_count": len(t), "targets": t[:keep], "confidence": min(0.90, 0.62 + len(set(t)) / 64)}
                    for at, t in table_runs(data, base)
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return images.select("rom_id", "base", "content").mapInArrow(run, "rom_id string, address long, entry_count long, targets array<long>, confidence double")


def offsets_of(images: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(rom_id, base, content, name, offset): where each pattern (over bytes) begins, overlaps included.

    The places come as one list an image, spread within its row, so images are neither copied nor exchanged.
    """
    compiled = [(name, re.compile(b"(?s)(?=%b)" % pattern.encode("latin-1"))) for name, pattern in patterns.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py() or b""
                hits = [{"name": name, "offset": m.start()} for name, p in compiled for m in p.finditer(data)]
                if hits:
                    found = pa.array([hits], pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), found], names=["rom_id", "base", "content", "found"])

    rows = images.select("rom_id", F.col("base").cast("long").alias("base"), "content")
    listed = rows.mapInArrow(run, "rom_id string, base long, content binary, found array<struct<name:string,offset:int>>")
    return listed.select("rom_id", "base", "content", F.inline("found"))


def markers(images: DataFrame, cap: int = MAX_MARKERS) -> DataFrame:
    """Places of resource type names, type by type, at most ``cap`` an image, with printable context."""
    rows = offsets_of(images, {t: re.escape(t) for t in MARKERS})
    first = F.greatest(F.col("offset") - 16, F.lit(0))
    context = F.regexp_replace(_latin(field(F.col("content"), first, F.col("offset") + 48 - first)), r"[^\x20-\x7E]", ".")
    place = F.array_position(F.array(*map(F.lit, MARKERS)), F.col("name"))
    rows = rows.select("rom_id", place.alias("place"), F.col("name").alias("type"), "offset", (F.col("base") + F.col("offset")).alias("address"), context.alias("context"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("rom_id").orderBy("place", "offset")))
    return ranked.where(F.col("n") <= cap).select("rom_id", (F.col("n") - 1).alias("marker_id"), "type", "address", "context")


MAX_INLINE_BYTES = 16 << 20
PLAIN_TYPE = r"[\x20-\x7E]{4}"


def inline_resources(images: DataFrame) -> DataFrame:
    """Resources that stand in an image behind a 16-byte prefix: (rom_id, type, id, name, flags, map_address, address, length, ...)."""
    rows = offsets_of(images, {"prefix": r"[\x08\x78]\x00{7}.{8}" + PLAIN_TYPE}).withColumn("at", F.col("offset") + 16)
    c, at = F.col("content"), F.col("at")
    rows = rows.withColumns({"previous": u32(c, F.col("offset") + 8), "payload_at": u32(c, F.col("offset") + 12), "named": u16(c, at + 6) % 256})
    rows = rows.where((F.col("payload_at") >= at + 8) & (F.col("payload_at") <= F.octet_length(c)) & (F.col("payload_at") - at <= 512))
    rows = rows.where(((F.col("previous") == 0) | (F.col("previous") < F.col("payload_at"))) & (F.col("named") <= 63) & (at + 8 + F.col("named") <= F.col("payload_at")))
    start = F.col("payload_at").try_cast("int")
    rows = rows.withColumn("length", u32(c, start - 8)).where(_latin(field(c, start, 4)) != "Kurt")
    rows = rows.where(F.col("length").between(1, MAX_INLINE_BYTES) & (F.col("payload_at") + F.col("length") <= F.octet_length(c)))
    return _found_resources(rows, at, start, "inline", 0.78)


def wrapped_resources(images: DataFrame) -> DataFrame:
    """Resources in a Kurt wrapper; their type, id and name stand up to 64 bytes before it, with k/c padding between."""
    rows = offsets_of(images, {"Kurt": "Kurt"}).where("offset >= 8")
    c, at = F.col("content"), F.col("offset")
    rows = rows.withColumns({"length": u32(c, at + 8), "unpacked": u32(c, at + 12)})
    rows = rows.where(F.col("length").between(1, MAX_INLINE_BYTES) & (F.col("unpacked") > 0) & (at + 16 + F.col("length") <= F.octet_length(c)))
    near = rows.withColumn("back", F.explode(F.sequence(F.lit(8), F.least(at, F.lit(64))))).withColumn("at", at - F.col("back"))
    near = near.withColumn("named", u16(c, F.col("at") + 6) % 256)
    padding = F.col("at") + 8 + F.col("named").try_cast("int")
    between = _latin(field(c, padding, F.col("offset") - padding))
    near = near.where(_latin(field(c, F.col("at"), 4)).rlike(f"^{PLAIN_TYPE}$") & (padding <= F.col("offset")) & between.rlike("^((kc)*k?|(ck)*c?)$"))
    nearest = near.withColumn("n", F.row_number().over(Window.partitionBy("rom_id", "offset").orderBy(F.desc("at")))).where("n = 1")
    return _found_resources(nearest, F.col("at"), F.col("offset") + 16, "Kurt", 0.82)


def _found_resources(rows: DataFrame, at: Column, start: Column, wrapper: str, confidence: float) -> DataFrame:
    c = F.col("content")
    return rows.select(
        "rom_id", _latin(field(c, at, 4)).alias("type"), i16(c, at + 4).try_cast("int").alias("id"), _latin(field(c, at + 8, F.col("named").try_cast("int"))).alias("name"),
        F.shiftright(u16(c, at + 6), 8).alias("flags"), (F.col("base") + at).alias("map_address"), (F.col("base") + start).alias("address"), "length",
        F.lit(wrapper).alias("wrapper"), F.lit(confidence).alias("confidence"), field(c, start, F.col("length").try_cast("int")).alias("data"),
    ).dropDuplicates(["rom_id", "type", "id", "address"])


def resource_spans(resource_rows: DataFrame) -> DataFrame:
    """The data region that the resources of each wrapper cover."""
    return resource_rows.groupBy("rom_id", "wrapper").agg(
        F.min("map_address").alias("start"), F.max(F.col("address") + F.col("length")).alias("end"), F.count("*").alias("n")
    ).select("rom_id", "start", "end", F.concat(F.lit("rom_"), F.lower("wrapper"), F.lit("_resources")).alias("kind"), "n", F.when(F.col("wrapper") == "Kurt", 0.72).otherwise(0.78).alias("confidence"))


# --- disassembly text ---------------------------------------------------------------------

LINE = r"^([0-9A-Fa-f]{8}) +((?:[0-9A-Fa-f]+\s+)*)(\S+)\s*(.*)$"


def instructions(listings: DataFrame) -> DataFrame:
    """(rom_id, line_index, address, opcode, mnemonic, operands, label) of disassembly (rom_id, text).

    A line that ends in a colon names what follows, up to the next name.
    """
    lines = listings.select("rom_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    label = F.when(F.col("raw").endswith(":"), F.expr("left(raw, length(raw) - 1)"))
    order = Window.partitionBy("rom_id").orderBy("n")
    carried = lines.withColumn("label", F.last(label, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hit = carried.where(F.col("raw").rlike(LINE)).select(
        "rom_id", "n", "label", F.conv(F.regexp_extract("raw", LINE, 1), 16, 10).cast("long").alias("address"),
        F.trim(F.regexp_extract("raw", LINE, 2)).alias("opcode"), F.lower(F.regexp_extract("raw", LINE, 3)).alias("mnemonic"),
        F.trim(F.regexp_extract("raw", LINE, 4)).alias("operands"),
    )
    return hit.withColumn("line_index", F.row_number().over(order)).drop("n")


def xref_kind(mnemonic: Column) -> Column:
    return F.when(mnemonic.isin("bsr", "jsr"), "call").when(mnemonic == "jmp", "jump").when(mnemonic.startswith("b") & (F.length(mnemonic) >= 2), "branch").otherwise("memory")


def xref_confidence(kind: Column) -> Column:
    return F.when(kind.isin("call", "jump", "branch"), 0.85).when(kind == "table", 0.75).otherwise(0.60)


def xrefs(instruction_rows: DataFrame, bounds: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(rom_id, source, target, kind, mnemonic, line, confidence, origin), each (source, target, kind, line) once.

    Targets stand in comments of the text and must lie inside the image; bounds is (rom_id,
    base, bytes). The entries of pointer tables are references too.
    """
    noted = F.regexp_extract("operands", r"/\* ([0-9A-Fa-f]{8})", 1)
    rows = instruction_rows.withColumn("target", F.conv(F.nullif(noted, F.lit("")), 16, 10).cast("long")).where("target IS NOT NULL")
    rows = rows.join(sent_if_small(bounds.select("rom_id", "base", "bytes")), "rom_id").where("target >= base AND target < base + bytes")
    kind = xref_kind(F.col("mnemonic"))
    found = rows.select(
        "rom_id", F.col("address").alias("source"), "target", kind.alias("kind"), "mnemonic", F.col("line_index").alias("line"),
        xref_confidence(kind).alias("confidence"), F.lit("disassembly-comment-target").alias("origin"),
    )
    if tables is not None:
        listed = tables.select("rom_id", "address", "confidence", F.posexplode("targets").alias("k", "target")).select(
            "rom_id", (F.col("address") + 4 * F.col("k")).alias("source"), "target", F.lit("table").alias("kind"), F.lit("dc.l").alias("mnemonic"),
            F.lit(0).alias("line"), "confidence", F.lit("pointer-table").alias("origin"),
        )
        found = found.unionByName(listed)
    return found.dropDuplicates(["rom_id", "source", "target", "kind", "line"])


def traps(instruction_rows: DataFrame) -> DataFrame:
    """System calls: (rom_id, address, trap_number, space, confidence), each once."""
    word = F.conv(F.substring(F.regexp_replace("opcode", " ", ""), 1, 4), 16, 10).cast("int")
    rows = instruction_rows.where("mnemonic = 'syscall'").withColumn("word", word).where(F.col("word").bitwiseAND(0xF000) == 0xA000)
    number = F.when(F.col("word").bitwiseAND(0x0800) != 0, F.col("word").bitwiseAND(0x0BFF)).otherwise(F.col("word").bitwiseAND(0x00FF))
    named = rows.select("rom_id", "address", number.alias("trap_number"))
    return named.select("*", F.when(F.col("trap_number") >= 0x0800, "Toolbox").otherwise("OS").alias("space"), F.lit(0.90).alias("confidence")).distinct()


def function_scores(xref_rows: DataFrame) -> DataFrame:
    """Targets that look like functions, with calls, jumps, references, score and confidence."""
    branch = F.col("mnemonic").isin("bra", "jmp") | F.col("mnemonic").startswith("b")
    call = F.col("kind") == "call"
    counts = xref_rows.where("kind != 'table'").groupBy("rom_id", F.col("target").alias("address")).agg(
        F.count_if(call).alias("calls"), F.count_if(branch & ~call).alias("jumps"), F.count_distinct("source").alias("refs")
    )
    score = 3 * F.col("calls") + F.col("jumps") + F.least("refs", F.lit(8))
    kept = counts.withColumn("score", score).where("calls > 0 OR score >= 3")
    return kept.withColumn("confidence", F.least(F.lit(0.95), 0.30 + F.col("score") / 20))


def functions(instruction_rows: DataFrame, xref_rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Function candidates with the nearest label, a provisional end, and instructions inside."""
    starts = function_scores(xref_rows).join(sent_if_small(bounds.select("rom_id", "base", "bytes")), "rom_id")
    following = F.lead("address").over(Window.partitionBy("rom_id").orderBy("address"))
    starts = starts.withColumn("next", F.coalesce(following, F.col("base") + F.col("bytes"))).drop("base", "bytes")
    labels = instruction_rows.where("label IS NOT NULL").groupBy("rom_id", "address").agg(F.min_by("label", "line_index").alias("label"))
    labelled = asof_join(starts, labels, ["rom_id"], "address", ["label"])
    # every instruction belongs to the last start at or before it
    owner = asof_join(
        instruction_rows.select("rom_id", "address").distinct(), starts.select("rom_id", "address", F.col("address").alias("start")), ["rom_id"], "address", ["start"]
    )
    inside = owner.where("start IS NOT NULL").groupBy("rom_id", F.col("start").alias("address")).agg(F.count("*").alias("instruction_count"))
    joined = labelled.join(inside, ["rom_id", "address"], "left").withColumn("instruction_count", F.coalesce("instruction_count", F.lit(0)))
    bounded = F.col("instruction_count") > 0
    return joined.select(
        "rom_id", "address", F.when(bounded, F.col("next")).alias("end_address"), "label", "calls", "jumps", F.col("refs").alias("references"),
        "instruction_count", F.when(bounded, F.least(F.lit(0.95), F.col("confidence") + 0.05)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(bounded, "bounded_by_next_candidate").otherwise("unknown").alias("boundary_status"),
    )


def by_importance(function_rows: DataFrame) -> DataFrame:
    score = 3 * F.col("calls") + F.col("jumps") + F.col("references")
    return function_rows.orderBy("rom_id", score.desc(), "address")


def lower_in_data(xref_rows: DataFrame, regions: DataFrame) -> DataFrame:
    """References from or to data regions [start, end), less sure of; the source counts first."""
    marked = inside_any(xref_rows, regions, "source", "start", "end", 4096, ["rom_id"], "from_data")
    marked = inside_any(marked, regions, "target", "start", "end", 4096, ["rom_id"], "to_data")
    cap = F.when(F.col("from_data"), 0.35).when(F.col("to_data"), 0.50).otherwise(1.0)
    note = F.when(F.col("from_data"), ":probable-data-source").when(F.col("to_data"), ":probable-data-target").otherwise("")
    return marked.withColumns({"confidence": F.least("confidence", cap), "origin": F.concat("origin", note)}).drop("from_data", "to_data")


def _map_heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, place, four numbers of the header) of the even places whose bytes may be a fork's header, window by window."""
    found, largest = [], int(most.max())
    for low in range(0, len(data), MAP_WINDOW):
        part = data[low : low + MAP_WINDOW + 15].astype(np.uint32)
        if len(part) < 16:
            break
        word = part[:-3] << 24 | part[1:-2] << 16 | part[2:-1] << 8 | part[3:]
        words = [word[k : len(word) - 12 + k] for k in (0, 4, 8, 12)]
        good = np.ones(len(words[0]), bool)
        for held, least in zip(words, (16, 16, 1, 30)):
            good &= (held >= least) & (held <= largest)
        places = np.flatnonzero(good)
        found.append((places + low, *(held[places].astype(np.int64) for held in words)))
    place, data_off, map_off, data_len, map_len = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 5))
    image = np.searchsorted(starts, place, "right") - 1
    at = place - starts[image]
    left = sizes[image] - at
    good = (left >= 32) & (at % 2 == 0) & (data_off + data_len <= left) & (map_off + map_len <= left)
    return tuple(x[good] for x in (image, at, data_off, map_off, data_len, map_len))


def resource_maps(images: DataFrame, max_types: int = 64, max_resources: int = 4096) -> DataFrame:
    """Resource forks inside images: (rom_id, address, data and map addresses and lengths, types, resources, confidence).

    Every even offset is tested by its header, all images of a batch at once; the types of what passes are unpacked and checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts, sizes = octets(batch.column("content"))
            image, at, data_off, map_off, data_len, map_len = _map_heads(data, starts, sizes, batch.column("most").fill_null(0).to_numpy(zero_copy_only=False))
            start, size, map_at = starts[image], sizes[image], at + map_off
            types_off = unsigned(data, start, size, map_at + 24, 2)
            n_types = unsigned(data, start, size, map_at + types_off, 2) + 1
            good = (types_off + 2 <= map_len) & (unsigned(data, start, size, map_at + 26, 2) <= map_len) & (n_types <= max_types) & (types_off + 2 + n_types * 8 <= map_len)
            kept, typed, counts = [], [], []
            for k in np.flatnonzero(good).tolist():
                first, types, n_resources = int(start[k] + map_at[k] + types_off[k]) + 2, [], 0
                for name, n, refs in struct.iter_unpack(">4sHH", data[first : first + 8 * int(n_types[k])].tobytes()):
                    if not PRINTABLE.fullmatch(name) or types_off[k] + refs + (n + 1) * 12 > map_len[k]:
                        break
                    types.append({"type": name.decode("ascii"), "n": n + 1, "refs": refs})
                    n_resources += n + 1
                else:
                    if n_resources <= max_resources:
                        kept.append(k)
                        typed.append(types)
                        counts.append(n_resources)
            rows = np.array(kept, np.int64)
            ids, base = (batch.column(c).take(pa.array(image[rows])) for c in ("rom_id", "base"))
            start_address, data_address, map_address = (pc.add(base, pa.array(at[rows] + x)) for x in (0, data_off[rows], map_off[rows]))
            yield pa.RecordBatch.from_arrays(
                [ids, start_address, data_address, pa.array(data_len[rows]), map_address, pa.array(map_len[rows]), pa.array(typed, MAP_TYPES), pa.array(counts, pa.int64())],
                ["rom_id", "address", "data_address", "data_length", "map_address", "map_length", "types", "n_resources"],
            )

    size = F.octet_length("content")
    rows = images.where(size >= 32).select("rom_id", F.col("base").cast("long").alias("base"), "content", size.cast("long").alias("most"))
    found = rows.mapInArrow(
        run, "rom_id string, address long, data_address long, data_length long, map_address long, map_length long, types array<struct<type: string, n: long, refs: long>>, n_resources long"
    )
    return found.withColumn("confidence", F.lit(0.90))


def map_regions(maps: DataFrame) -> DataFrame:
    """The data regions that resource maps cover."""
    parts = F.array(
        F.struct(F.col("address").alias("start"), (F.col("address") + 16).alias("end"), F.lit("resource_fork_header").alias("kind"), F.lit(1).cast("long").alias("n")),
        F.struct(F.col("data_address").alias("start"), (F.col("data_address") + F.col("data_length")).alias("end"), F.lit("resource_data").alias("kind"), F.col("n_resources").alias("n")),
        F.struct(F.col("map_address").alias("start"), (F.col("map_address") + F.col("map_length")).alias("end"), F.lit("resource_map").alias("kind"), F.col("n_resources").alias("n")),
    )
    return maps.select("rom_id", F.inline(parts), "confidence")


def source_overlay(string_rows: DataFrame, source_lines: DataFrame, cap: int = MAX_OVERLAYS) -> DataFrame:
    """Source lines (path, line, text) that hold a sure string, the first ``cap`` of an image in order of place."""
    sure = string_rows.where("length >= 6 AND confidence >= 0.70").select("rom_id", F.col("text").alias("value"), "address")
    hits = contains_join(source_lines, sure, "text", "value")
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("rom_id").orderBy("path", "line", "address", "value")))
    return ranked.where(F.col("n") <= cap).select("rom_id", (F.col("n") - 1).alias("overlay_id"), "address", "value", "path", "line")


def gap_rows(function_rows: DataFrame, marker_rows: DataFrame, cap: int = 100) -> DataFrame:
    """What an atlas leaves open: functions without an end and markers without a map, the first of each, and the phase."""
    def first(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
        ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("rom_id").orderBy(*order)))
        return ranked.where(F.col("n") <= cap).select("rom_id", F.lit(kind).alias("kind"), address(F.col("address")).alias("subject"))

    open_ends = first(function_rows.where("boundary_status = 'unknown'"), "function_boundary", ["address"])
    unparsed = first(marker_rows, "resource_marker", ["marker_id"])
    phase = function_rows.select("rom_id").union(marker_rows.select("rom_id")).distinct()
    return open_ends.unionByName(unparsed).unionByName(phase.select("rom_id", F.lit("phase").alias("kind"), F.lit("linear").alias("subject")))


ATLAS = ("strings", "clusters", "pointer_words", "pointer_tables", "markers", "instructions", "xrefs", "traps", "functions", "maps", "regions", "resources", "gaps", "images")


def analyze(images: DataFrame, listings: DataFrame) -> dict[str, DataFrame]:
    """All tables of an atlas by name, lazily; listings is (rom_id, text)."""
    bounds = images.select("rom_id", "base", F.octet_length("content").cast("long").alias("bytes"))
    rows = instructions(listings)
    tables, text = pointer_tables(images), strings(images)
    maps, clusters = resource_maps(images), string_clusters(text)
    inside = inline_resources(images).unionByName(wrapped_resources(images))
    regions = clusters.unionByName(map_regions(maps)).unionByName(resource_spans(inside))
    refs = lower_in_data(xrefs(rows, bounds, tables), regions)
    found, marked = functions(rows, refs, bounds), markers(images)
    return {
        "strings": text, "clusters": clusters, "pointer_words": pointer_words(images), "pointer_tables": tables, "markers": marked, "instructions": rows,
        "xrefs": refs, "traps": traps(rows), "functions": found, "maps": maps, "regions": regions, "resources": inside.drop("data"), "gaps": gap_rows(found, marked), "images": bounds,
    }


def write_atlas(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as tab-separated text with a header, and nested ones as JSON lines."""
    for name, rows in tables.items():
        nested = any(f.dataType.simpleString().startswith(("array", "struct", "map")) for f in rows.schema)
        writer = rows.write.mode("overwrite")
        writer.json(f"{folder}/{name}") if nested else writer.option("sep", "\t").option("header", True).csv(f"{folder}/{name}")
