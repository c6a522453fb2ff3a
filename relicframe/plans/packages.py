"""Package documents: made from block records, and loaded back into warehouse rows.

The documents of a file are one JSON text each, built by column expressions; the loader reads a
document by a fixed schema, so a corpus of packages is one projection a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import line_count, sample_of
from ..sources.blocks import block_map
from . import records

#: Blocks that the decoders understand.
UNDERSTOOD = ("BKGD", "BMAP", "CARD", "FTBL", "LIST", "MAST", "PAGE", "PRFT", "PRNT", "PRST", "STAK", "STBL")

# --- documents -------------------------------------------------------------------------------


def _collected(rows: DataFrame, name: str, fields: list[str | Column], order: list[str]) -> DataFrame:
    """(file, name): the rows of each file as a list of structs in order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("_value"))))
    return rows.groupBy("file").agg(F.transform(listed, lambda x: x["_value"]).alias(name))


def project_documents(blocks: DataFrame) -> DataFrame:
    """(file, project): the project document of each stack: levels and versions, its blocks, fonts and styles."""
    stack, fonts = records.stacks(blocks), records.fonts(blocks)
    held = block_map(blocks).withColumns({"size": F.octet_length("payload").cast("long"), "understood": F.col("type").isin(*UNDERSTOOD)})
    flags = {8: "bold", 9: "italic", 10: "underline", 11: "outline", 12: "shadow", 13: "condense", 14: "extend", 15: "group"}
    styles = records.styles(blocks, fonts)
    parts = [
        _collected(held, "blocks", ["type", "id", "size", "understood"], ["type", "id"]),
        _collected(fonts, "fonts", [F.col("font_id").alias("id"), "name"], ["font_id"]),
        _collected(
            styles, "styles",
            [F.col("style_id").alias("id"), F.col("font_id").alias("fontId"), F.col("font_name").alias("fontName"), F.col("font_size").alias("fontSize"), *[F.array_contains("text_styles", n).alias(n) for n in flags.values()]],
            ["style_id"],
        ),
    ]
    for part in parts:
        stack = stack.join(part, "file", "left")
    document = F.struct(
        F.lit("project").alias("format"), F.col("file").alias("sourceFileName"), F.lit("stack_-1.json").alias("stackFile"), F.col("user_level").alias("userLevel"),
        F.col("private_access").alias("privateAccess"), F.col("cant_peek").alias("cantPeek"),
        *[F.col(f"{a}_version").alias(b) for a, b in (("created_by", "createdByVersion"), ("last_compacted", "lastCompactedVersion"), ("last_edited", "lastEditedVersion"), ("first_edited", "firstEditedVersion"))],
        F.col("pattern_count").alias("patternCount"), "blocks", "fonts", "styles",
    )
    return stack.select("file", F.to_json(document).alias("project"))


def stack_documents(blocks: DataFrame) -> DataFrame:
    """(file, stack): the stack document: counts, sizes, script, the pages with their cards, and all layers."""
    pages = records.page_entries(blocks).groupBy("file", "page_id").agg(F.sort_array(F.collect_list(F.struct("n", "card_id"))).alias("cards"))
    pages = pages.withColumn("cards", F.transform("cards", lambda x: x["card_id"]))
    sizes = records.text_bytes(records.contents(blocks))
    layers = records.layers(blocks).withColumnRenamed("type", "layer_type").withColumnRenamed("id", "layer_id").join(sizes, ["file", "layer_type", "layer_id"], "left")
    kind = F.when(F.col("layer_type") == "CARD", "card").otherwise("background")
    layer_fields = [
        kind.alias("kind"), F.col("layer_id").alias("id"), F.concat(kind, F.lit("_"), F.col("layer_id").cast("string"), F.lit(".json")).alias("file"), "name", F.col("n_parts").alias("partCount"),
        F.col("n_contents").alias("contentCount"), F.octet_length("script").alias("scriptBytes"), F.coalesce("text_bytes", F.lit(0)).alias("textBytes"), F.nullif("owner", F.lit(-1)).alias("owner"),
    ]
    stack = records.stacks(blocks)
    stack = stack.join(_collected(pages, "pages", [F.col("page_id").alias("id"), F.size("cards").alias("entryCount"), F.col("cards").alias("cardIds")], ["page_id"]), "file", "left")
    stack = stack.join(_collected(layers, "layers", layer_fields, ["layer_type", "layer_id"]), "file", "left")
    names = {
        "first_card": "firstCardId", "list_id": "listBlockId", "font_table_id": "fontTableBlockId", "style_table_id": "styleTableBlockId", "card_count": "cardCount", "card_width": "cardWidth",
        "card_height": "cardHeight", "pattern_count": "patternCount", "cant_modify": "cantModify", "cant_delete": "cantDelete", "cant_abort": "cantAbort", "script": "script",
    }
    document = F.struct(F.lit("stack").alias("format"), "id", F.col("file").alias("name"), *[F.col(a).alias(b) for a, b in names.items()], "pages", "layers")
    return stack.select("file", F.to_json(document).alias("stack"))


def layer_documents(blocks: DataFrame) -> DataFrame:
    """(file, type, id, document): a document for each card and background, with its parts and contents."""
    fonts = records.fonts(blocks)
    parts = records.parts(blocks, fonts)
    contents = records.contents(blocks, parts)

    def of(rows: DataFrame, name: str, fields: list[str | Column]) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct("n", F.struct(*fields).alias("_value"))))
        grouped = rows.groupBy("file", F.col("layer_type").alias("type"), F.col("layer_id").alias("id"))
        return grouped.agg(F.transform(listed, lambda x: x["_value"]).alias(name))

    part_fields = [
        F.col("part_id").alias("id"), F.col("part_type").alias("type"), "visible", F.col("bounds").alias("rect"), "style", "family", F.col("selected_lines").alias("selectedLines"), F.col("text_align").alias("textAlign"),
        F.col("font_name").alias("font"), F.col("text_size").alias("textSize"), F.col("text_styles").alias("textStyles"), F.col("text_height").alias("textHeight"), "name", "script",
    ]
    content_fields = ["layer", F.col("part_id").alias("id"), F.col("style_runs").alias("styleRuns"), "highlight", "text"]
    joined = records.layers(blocks).join(of(parts, "parts", part_fields), ["file", "type", "id"], "left").join(of(contents, "contents", content_fields), ["file", "type", "id"], "left")
    kind = F.when(F.col("type") == "CARD", "card").otherwise("background")
    document = F.struct(
        kind.alias("format"), "id", F.col("type").alias("blockType"), F.nullif("bitmap_id", F.lit(0)).alias("bitmapId"), F.col("cant_delete").alias("cantDelete"), F.col("show_picture").alias("showPict"),
        F.nullif("owner", F.lit(-1)).alias("owner"), F.col("n_parts").alias("partCount"), F.col("n_contents").alias("contentCount"), "parts", "contents", "name", "script",
    )
    return joined.select("file", "type", "id", F.to_json(document).alias("document"))


# --- loading ---------------------------------------------------------------------------------

_PART = (
    "struct<id:bigint,type:string,name:string,style:string,visible:boolean,enabled:boolean,sharedText:boolean,lockText:boolean,textAlign:string,font:string,textSize:bigint,"
    "textStyles:array<string>,rect:struct<left:bigint,top:bigint,right:bigint,bottom:bigint>,script:string>"
)
_CONTENT = "struct<id:bigint,layer:string,text:string>"
DOCUMENT = (
    f"struct<id:bigint,name:string,script:string,parts:array<{_PART}>,contents:array<{_CONTENT}>,blocks:array<struct<id:bigint,type:string>>,outputs:array<struct<id:bigint,kind:string,file:string>>,"
    "listBlockId:bigint,fontTableBlockId:bigint,styleTableBlockId:bigint,layers:array<struct<id:bigint,kind:string,name:string,file:string,owner:bigint>>>"
)
_KEYS = ["run_id", "attempt_id", "stack_id", "output_file_id"]
LAYER_KINDS = ("card", "background", "master")


def _read(files: DataFrame) -> DataFrame:
    """Documents of package files (run_id, attempt_id, stack_id, output_file_id, rel_path, content): keys, kind and id by the name, the fields."""
    what = classify.logical_file(F.col("rel_path"))
    rows = files.where(F.col("rel_path").endswith(".json")).select(*_KEYS, "rel_path", what.alias("what"), F.from_json("content", DOCUMENT).alias("d"))
    return rows.where("d IS NOT NULL").select(*_KEYS, "rel_path", F.col("what.kind").alias("kind"), F.col("what.id").alias("number"), "d")


def _layers(files: DataFrame) -> DataFrame:
    return _read(files).where(F.col("kind").isin(*LAYER_KINDS))


def objects(files: DataFrame) -> DataFrame:
    """parsed_objects rows: layers and their parts, blocks of projects, references and layers of stacks, each document read once."""
    texts = F.aggregate(F.coalesce("d.contents", F.array().cast(f"array<{_CONTENT}>")), F.lit(0), lambda a, c: a + F.coalesce(F.length(c["text"]), F.lit(0)))

    def one(kind: Column, number: Column, **more: Column) -> Column:
        empty = {"name": F.lit(None).cast("string"), "part_type": F.lit(None).cast("string"), "text_bytes": F.lit(0), "script_bytes": F.lit(0)}
        return F.struct(kind.alias("object_kind"), number.cast("long").alias("object_id"), *[(more.get(k, v)).alias(k) for k, v in empty.items()])

    script = lambda s: F.coalesce(F.length(s), F.lit(0))
    layer = F.array(one(F.col("kind"), F.col("number"), name=F.col("d.name"), text_bytes=texts, script_bytes=script(F.col("d.script"))))
    parts = F.transform("d.parts", lambda p: one(F.lit("part"), p["id"], name=p["name"], part_type=p["type"], script_bytes=script(p["script"])))
    chunks = F.transform("d.blocks", lambda b: one(F.lit("binary_chunk"), b["id"], part_type=b["type"]))
    named = [one(F.lit(k), F.col(f"d.{k}")) for k in ("listBlockId", "fontTableBlockId", "styleTableBlockId")]
    refs = F.filter(F.array(*named), lambda r: r["object_id"].isNotNull())
    layers = F.transform("d.layers", lambda x: one(F.coalesce(F.concat(x["kind"], F.lit("_ref")), F.lit("layer_ref")), x["id"], name=x["name"]))
    nothing = F.filter(layer, lambda x: F.lit(False))
    found = (
        F.when(F.col("kind").isin(*LAYER_KINDS), F.concat(layer, F.coalesce(parts, nothing)))
        .when(F.col("kind") == "project", F.coalesce(chunks, nothing))
        .when(F.col("kind") == "stack", F.concat(refs, F.coalesce(layers, nothing)))
    )
    return _read(files).select(*_KEYS, F.inline(found))


def _flag(value: Column) -> Column:
    """true, false or nothing, as text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def parts(files: DataFrame) -> DataFrame:
    """parsed_parts rows of cards and backgrounds."""
    rows = _layers(files).select(*_KEYS, F.col("kind").alias("container_kind"), F.col("number").alias("container_id"), F.explode("d.parts").alias("p"))
    p = F.col("p")
    return rows.select(
        *_KEYS, "container_kind", "container_id", p["id"].alias("part_id"), F.coalesce(p["type"], F.lit("unknown")).alias("part_type"), p["name"].alias("name"), p["style"].alias("style"),
        _flag(p["visible"]).alias("visible"), _flag(p["enabled"]).alias("enabled"), _flag(p["sharedText"]).alias("shared_text"), _flag(p["lockText"]).alias("lock_text"), p["textAlign"].alias("text_align"),
        p["font"].alias("font"), p["textSize"].alias("text_size"), F.coalesce(F.array_join(p["textStyles"], ","), F.lit("")).alias("text_style"),
        *[p["rect"][side].alias(f"rect_{side}") for side in ("left", "top", "right", "bottom")], F.coalesce(F.length(p["script"]), F.lit(0)).alias("script_bytes"),
    )


def contents(files: DataFrame) -> DataFrame:
    """parsed_content rows; text_bytes counts characters, as the warehouse always did."""
    rows = _layers(files).select(*_KEYS, F.col("kind").alias("container_kind"), F.col("number").alias("container_id"), F.explode("d.contents").alias("c"))
    text = F.coalesce(F.col("c.text"), F.lit(""))
    return rows.select(
        *_KEYS, "container_kind", "container_id", F.coalesce(F.col("c.layer"), F.col("container_kind")).alias("layer"), F.col("c.id").alias("part_id"), F.length(text).alias("text_bytes"),
        line_count(text).alias("line_count"), F.sha2(F.encode(text, "utf-8"), 256).alias("sha256"), sample_of(text).alias("sample"),
    )


def media(files: DataFrame) -> DataFrame:
    """media_refs rows: what the outputs of a project name."""
    rows = _read(files).where("kind = 'project'").select("run_id", "attempt_id", "stack_id", F.explode("d.outputs").alias("o"))
    return rows.where("o.file IS NOT NULL AND o.kind IS NOT NULL").select("run_id", "attempt_id", "stack_id", F.col("o.file").alias("rel_path"), F.col("o.kind").alias("media_kind"))


def code_resources(resources: DataFrame, outputs: DataFrame) -> DataFrame:
    """external_code_resources rows of (run_id, attempt_id, stack_id, type, id, name, data, disassembly_file) resources.

    A listing is the file that the manifest names, if the package has it, else the one whose name tells the type and number; of several the last.
    """
    code = resources.where(F.col("type").isin(*classify.CODE_TYPES))
    listings = outputs.where(F.lower("rel_path").startswith("resource-disassembly/")).select("stack_id", F.col("id").alias("file_id"), "rel_path")
    named = listings.select("stack_id", F.col("file_id").alias("named_id"), F.col("rel_path").alias("disassembly_file"))
    told = classify.listed_code(F.col("rel_path"))
    indexed = listings.select("stack_id", told["type"].alias("type"), told["number"].cast("long").alias("id"), "file_id", "rel_path").where("type IS NOT NULL")
    indexed = indexed.groupBy("stack_id", "type", "id").agg(F.max_by(F.struct("file_id", "rel_path"), "rel_path").alias("found"))
    joined = code.join(named, ["stack_id", "disassembly_file"], "left").join(indexed, ["stack_id", "type", "id"], "left")
    path = F.coalesce(F.when(F.col("named_id").isNotNull(), F.col("disassembly_file")), F.col("found.rel_path"), F.lit(""))
    kind, said = F.col("type"), classify.code_format(F.col("type"), F.col("data"))
    return joined.select(
        "run_id", "attempt_id", "stack_id", F.coalesce("named_id", F.col("found.file_id")).alias("output_file_id"), kind.alias("resource_type"), F.col("id").alias("resource_id"), F.col("name").alias("resource_name"),
        classify.code_kind(kind).alias("external_kind"), classify.code_platform(kind).alias("platform"), said["instruction"].alias("instruction_format"), said["container"].alias("container_format"),
        F.octet_length("data").cast("long").alias("payload_bytes"), F.sha2("data", 256).alias("payload_sha256"), F.when(path == "", "missing").otherwise("present").alias("disassembly_status"),
        path.alias("disassembly_rel_path"),
    )


def with_stack(rows: DataFrame, stacks: DataFrame) -> DataFrame:
    """``rows`` of attempts with the stack that their attempt made; null where it made none."""
    made = stacks.select("attempt_id", F.col("id").alias("stack_id"))
    return rows.drop("stack_id").join(made, "attempt_id", "left")


def conversion_counts(rows: DataFrame) -> DataFrame:
    """(target_format, status, n) of conversions."""
    return rows.groupBy("target_format", "status").agg(F.count("*").alias("n"))
