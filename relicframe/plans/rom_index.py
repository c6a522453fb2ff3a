"""Analysis documents of firmware images, and a portable index of their resources, as files.

The tables of an atlas become one tagged union of (image, section, place, item), and one aggregation folds
it into the parts of documents; no table is joined to another, so nothing fans out. A section is cut into
parts of PART_ITEMS items, so no value grows with an image's references; the head of a document tells counts and parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import address
from . import artifacts

PART_ITEMS = 10_000
#: Confidence of what a whole-image listing and a bare type name say (fixed values).
CODE_CONFIDENCE, MARKER_CONFIDENCE = 0.95, 0.40


def regions(first: DataFrame, instruction_rows: DataFrame, bounds: DataFrame, data_regions: DataFrame) -> DataFrame:
    """(rom_id, id, start, end, kind, items, confidence, source): what first bytes, listings and scans say of an image, in one table.

    ``first`` are the rows of first_bytes(); an image with a listing is one region of code; ``data_regions`` are (rom_id, start, end, kind, n, confidence).
    """
    def shaped(rows: DataFrame, name: Column, kind: Column | str, items: Column, confidence: Column | float, source: str) -> DataFrame:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return rows.select("rom_id", name.alias("id"), "start", "end", as_column(kind).alias("kind"), items.cast("long").alias("items"), as_column(confidence).cast("double").alias("confidence"), F.lit(source).alias("source"))

    listed = instruction_rows.groupBy("rom_id").agg(F.count("*").alias("n")).join(bounds, "rom_id")
    listed = listed.select("rom_id", "n", F.col("base").alias("start"), (F.col("base") + F.col("bytes")).alias("end"))
    at = lambda prefix: F.concat(F.lit(prefix), address(F.col("start")))
    return (
        shaped(first, F.concat(F.lit("region-"), F.col("rom_id"), F.lit("-first-bytes")), F.col("hypothesis"), F.lit(1), F.col("confidence"), "identity:first-bytes")
        .unionByName(shaped(listed, at("region-"), "code", F.col("n"), CODE_CONFIDENCE, "disassembly"))
        .unionByName(shaped(data_regions, at("data-"), F.col("kind"), F.col("n"), F.col("confidence"), "scanner"))
    )


def resource_rows(marker_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Names of types and parsed resources in one table; what a marker does not tell is null."""
    marked = marker_rows.select(
        "rom_id", F.concat(F.lit("resmarker-"), address(F.col("address")), F.lit("-"), F.col("marker_id").cast("string")).alias("id"), "address", F.lit("marker").alias("kind"), F.col("type").alias("resource_type"),
        F.lit(MARKER_CONFIDENCE).alias("confidence"), F.concat(F.lit("marker-scan:"), F.col("context")).alias("source"),
    )
    parsed = found.select(
        "rom_id", F.concat(F.lit("res-"), address(F.col("address")), F.lit("-"), F.col("type"), F.lit("-"), F.col("id").cast("string")).alias("id"), "address", F.lit("parsed").alias("kind"), F.col("type").alias("resource_type"),
        F.col("id").alias("resource_id"), "name", "length", "wrapper", F.col("confidence").cast("double").alias("confidence"), F.lit("resource-scan").alias("source"),
    )
    return marked.unionByName(parsed, allowMissingColumns=True)


def _item(rows: DataFrame, section: str, place: Column, prefix: Column, **fields: Column) -> DataFrame:
    shown = F.to_json(F.struct(prefix.alias("id"), *[c.alias(n) for n, c in fields.items()]))
    return rows.select("rom_id", F.lit(section).alias("section"), place.cast("long").alias("place"), shown.alias("item"))


def items(tables: dict[str, DataFrame]) -> DataFrame:
    """(rom_id, section, place, item): every row of the tables that a document tells, as JSON; tables that are not given give none."""
    c, at = F.col, lambda name: address(F.col(name))
    joined = lambda *parts: F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    makers = {
        "regions": lambda t: _item(t, "regions", c("start"), c("id"), start=at("start"), end=at("end"), kind=c("kind"), item_count=c("items"), confidence=c("confidence"), source=c("source")),
        "functions": lambda t: _item(
            t, "functions", c("address"), joined("fn", at("address")), start=at("address"), end=F.when(c("end_address").isNotNull(), at("end_address")), boundary_status=c("boundary_status"),
            label=F.coalesce("label", F.concat(F.lit("sub_"), at("address"))), instruction_count=F.nullif("instruction_count", F.lit(0)), inbound_calls=c("calls"), outbound_calls=c("jumps"), references=c("references"), confidence=c("confidence"),
        ),
        "xrefs": lambda t: _item(t, "xrefs", c("source"), joined("xref", at("source"), at("target"), c("kind")), **{"from": at("source")}, to=at("target"), kind=c("kind"), mnemonic=c("mnemonic"), line=c("line"), confidence=c("confidence")),
        "pointer_tables": lambda t: _item(t, "pointer_tables", c("address"), joined("ptrtab", at("address")), address=at("address"), entry_count=c("entry_count"), targets=F.transform("targets", address), confidence=c("confidence")),
        "resources": lambda t: _item(t, "resources", c("address"), c("id"), **{n: (at(n) if n == "address" else c(n)) for n in t.columns if n not in ("rom_id", "id")}),
        "strings": lambda t: _item(t, "strings", c("address"), joined("str", at("address")), address=at("address"), kind=F.when(c("pascal"), "pascal").otherwise("ascii"), length=c("length"), text=c("text"), confidence=c("confidence")),
        "traps": lambda t: _item(t, "traps", c("address"), joined("trap", at("address")), **{n: (at(n) if n == "address" else c(n)) for n in t.columns if n != "rom_id"}),
        "source_overlays": lambda t: _item(t, "source_overlays", c("overlay_id"), joined("overlay", c("overlay_id").cast("string")), address=at("address"), symbol=c("value"), source_path=c("path"), source_line=c("line")),
        "source_gaps": lambda t: _item(t, "source_gaps", F.lit(0), joined("gap", c("kind"), c("subject")), kind=c("kind"), subject=c("subject")),
    }
    found = None
    for name, rows in tables.items():
        if name in makers:
            part = makers[name](rows)
            found = part if found is None else found.unionByName(part)
    if "functions" in tables:
        named = tables["functions"].select("rom_id", "address", F.coalesce("label", F.concat(F.lit("sub_"), address(F.col("address")))).alias("name"), "confidence")
        found = found.unionByName(_item(named, "labels", c("address"), joined("label", at("address")), address=at("address"), name=c("name"), kind=F.lit("function_candidate"), confidence=c("confidence")))
    return found


SECTIONS = ("regions", "functions", "xrefs", "pointer_tables", "resources", "labels", "strings", "traps", "source_overlays", "source_gaps")


def document_parts(item_rows: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """(rom_id, section, part, items, content): each section as JSON arrays of at most ``part_items`` items, in order of place."""
    number = F.row_number().over(Window.partitionBy("rom_id", "section").orderBy("place", "item"))
    cut = item_rows.withColumn("n", number).withColumn("part", F.floor((F.col("n") - 1) / part_items).cast("int"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda x: x["item"])
    return cut.groupBy("rom_id", "section", "part").agg(F.count("*").alias("items"), F.concat(F.lit("[\n"), F.array_join(listed, ",\n"), F.lit("\n]\n")).alias("content"))


def document_heads(images: DataFrame, parts: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """(rom_id, content): for each image (rom_id, base, bytes, and what else is known of it) the head of its document: identity, counts, phases, parts, warnings."""
    told = parts.groupBy("rom_id").agg(
        F.sort_array(F.collect_list(F.struct("section", "part", "items"))).alias("parts"), *[F.coalesce(F.sum(F.when(F.col("section") == s, F.col("items"))), F.lit(0)).alias(f"n_{s}") for s in SECTIONS]
    )
    joined = images.join(told, "rom_id", "left")
    count = {s: F.coalesce(f"n_{s}", F.lit(0)) for s in SECTIONS}
    identity = F.struct(*[(address(F.col(c)) if c == "base" else F.col(c)).alias(c) for c in images.columns if c not in ("content", "path")])
    phases = F.struct(
        F.lit("complete").alias("identity"), F.when(count["xrefs"] > 0, "partial_linear").otherwise("not_run").alias("xrefs"), F.when(count["regions"] > 0, "partial").otherwise("not_run").alias("regions"),
        F.when(count["source_overlays"] > 0, "partial_string_matches").otherwise("no_matches").alias("source_overlays"),
    )
    files = F.transform("parts", lambda p: F.struct(p["section"].alias("section"), p["part"].alias("part"), p["items"].alias("items"), _part_path(p["section"], p["part"]).alias("path")))
    warnings = F.array_compact(F.array(
        F.lit("a linear listing of a whole image is input to regions, not confirmed code"), F.when(count["source_overlays"] == 0, "no source line matched a string of the image"),
    ))
    head = F.struct(
        F.lit(1).alias("schema_version"), (generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("generated_at"), identity.alias("identity"),
        phases.alias("phase_status"), F.struct(*[n.alias(s) for s, n in count.items()]).alias("counts"), F.coalesce(files, F.array().cast("array<struct<section:string,part:int,items:bigint,path:string>>")).alias("parts"), warnings.alias("warnings"),
    )
    return joined.select("rom_id", F.to_json(head).alias("content"))


def _part_path(section: Column, part: Column) -> Column:
    return F.concat(F.lit("analysis/"), section, F.lit("-"), part.cast("string"), F.lit(".json"))


def analysis_files(images: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(file, path, content): the documents of all images, for the sink of artifacts; ``file`` is the image."""
    parts = artifacts.written(document_parts(items(tables)), "analysis-parts")
    heads = document_heads(images, parts).select(F.col("rom_id").alias("file"), F.lit("analysis.json").alias("path"), F.encode("content", "utf-8").alias("content"))
    return heads.unionByName(parts.select(F.col("rom_id").alias("file"), _part_path(F.col("section"), F.col("part")).alias("path"), F.encode("content", "utf-8").alias("content")))


def resource_index(found: DataFrame) -> DataFrame:
    """(file, path, content): each resource of an image as it is, what it converts to, and an index.json that tells their paths and digests.

    ``found`` are rows of inline_resources() and the like. An image has no more resources than it has bytes for.
    """
    rows = artifacts.written(found, "image-resources")
    stem = F.concat(artifacts.escaped(F.col("type")), F.lit("_"), F.col("id").cast("string"), F.lit("_"), address(F.col("address")))
    raw = rows.select(F.col("rom_id").alias("file"), F.concat(F.lit("resources/"), stem, F.lit(".bin")).alias("path"), F.col("data").alias("content"), "type", "id", "name", "address", "wrapper")
    made, _ = artifacts.conversions(rows.select(F.col("rom_id").alias("file"), "type", "id", "name", "data", F.col("address").alias("order")), F.col("file"))
    converted = artifacts.written(made.select("file", "type", "id", F.concat(F.lit("converted/"), F.col("path")).alias("path"), "format", "media_type", "content"), "image-artifacts")
    listed = converted.groupBy("file", "type", "id").agg(F.sort_array(F.collect_list(F.struct("path", "format", "media_type", F.sha2("content", 256).alias("sha256")))).alias("artifacts"))
    told = raw.join(listed, ["file", "type", "id"], "left").select(
        "file", "address", F.struct(
            address(F.col("address")).alias("address"), F.col("type").alias("resource_type"), F.col("id").alias("resource_id"), "name", F.col("wrapper").alias("wrapper_format"), F.octet_length("content").alias("length"),
            F.col("path").alias("raw_file"), F.sha2("content", 256).alias("raw_sha256"), F.coalesce("artifacts", F.array().cast(listed.schema["artifacts"].dataType)).alias("artifacts"),
        ).alias("entry"),
    )
    index = told.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("address", "entry"))).alias("all")).select(
        "file", F.lit("index.json").alias("path"), F.encode(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("file").alias("rom_id"), F.transform("all", lambda x: x["entry"]).alias("resources"))), "utf-8").alias("content")
    )
    return index.unionByName(raw.select("file", "path", "content")).unionByName(converted.select("file", "path", "content"))
