"""Typed records from block payloads, as column expressions.

Fixed layouts are projections; tables of equal entries explode a sequence of offsets; where an
entry's length decides the next one's place, ``aggregate`` walks the payload
inside one expression. Only parts and contents of layers leave the JVM: Arrow tasks walk
all payloads of a batch at once. Short payloads keep defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import bcd_version, c_string, even, field, has_bit, i16, i32, mac_text, nul_end, set_bits, u8, u16, u32
from ..functions.batches import cuts, octets, signed, stretches, unsigned
from ..functions.text import bind

TEXT_STYLES = {15: "group", 14: "extend", 13: "condense", 12: "shadow", 11: "outline", 10: "underline", 9: "italic", 8: "bold"}
BUTTON_STYLES = {0: "transparent", 1: "opaque", 2: "rectangle", 3: "roundrect", 4: "shadow", 5: "checkbox", 6: "radiobutton", 8: "standard", 9: "default", 10: "oval", 11: "popup"}
FIELD_STYLES = {0: "transparent", 1: "opaque", 2: "rectangle", 4: "shadow", 7: "scrolling"}
ALIGNMENTS = {0: "left", 1: "center", -1: "right", -2: "forceLeft"}


def _p() -> Column:
    return F.col("payload")


def _of(blocks: DataFrame, *types: str) -> DataFrame:
    return blocks.where(F.col("type").isin(*types))


def _numbers(count: Column) -> Column:
    """0 to count - 1; none for counts below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _named(code: Column, names: dict[int, str]) -> Column:
    out = None
    for key, name in names.items():
        out = F.when(code == key, name) if out is None else out.when(code == key, name)
    return out.otherwise("unknown")


def text_styles(flags: Column) -> Column:
    return F.when(flags == 0, F.array(F.lit("plain"))).otherwise(set_bits(flags, TEXT_STYLES))


def rect(data: Column, at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.struct(*[i16(data, at + 2 * i).alias(n) for i, n in enumerate(("top", "left", "bottom", "right"))])


def stacks(blocks: DataFrame) -> DataFrame:
    """STAK: one row a file."""
    size = F.octet_length(_p())
    flags = i16(_p(), 64)
    versions = {"created_by": 84, "last_compacted": 88, "last_edited": 92, "first_edited": 96}
    return _of(blocks, "STAK").select(
        "file", "id", i32(_p(), 32).alias("card_count"), i32(_p(), 36).alias("first_card"), i32(_p(), 40).alias("list_id"), i16(_p(), 60).alias("user_level"),
        *[has_bit(flags, bit).alias(name) for bit, name in {15: "cant_modify", 14: "cant_delete", 13: "private_access", 11: "cant_abort", 10: "cant_peek"}.items()],
        *[F.concat(F.lit("HyperCard "), bcd_version(_p(), at)).alias(f"{name}_version") for name, at in versions.items()],
        F.when(size >= 424, i32(_p(), 420)).otherwise(-1).alias("font_table_id"),
        F.when(size >= 428, i32(_p(), 424)).otherwise(-1).alias("style_table_id"),
        F.when(i16(_p(), 428) == 0, 342).otherwise(i16(_p(), 428)).alias("card_height"),
        F.when(i16(_p(), 430) == 0, 512).otherwise(i16(_p(), 430)).alias("card_width"),
        F.when(size >= 692 + 320, 40).otherwise(0).alias("pattern_count"),
        F.when(size > 1524, c_string(_p(), 1524)).otherwise("").alias("script"),
    )


def stack_references(blocks: DataFrame) -> DataFrame:
    """(file, type, id, field): blocks that the stack record names."""
    rows = stacks(blocks)
    refs = F.array(*[
        F.struct(F.lit(kind).alias("type"), F.col(column).cast("int").alias("id"), F.lit(name).alias("field"))
        for kind, column, name in (("LIST", "list_id", "STAK.listBlockId"), ("FTBL", "font_table_id", "STAK.fontTableBlockId"), ("STBL", "style_table_id", "STAK.styleTableBlockId"))
    ])
    return rows.select("file", F.inline(refs))


def patterns(blocks: DataFrame) -> DataFrame:
    """The forty 8 x 8 patterns of a complete pattern table."""
    rows = _of(blocks, "STAK").where(F.octet_length(_p()) >= 692 + 320)
    n = F.explode(F.sequence(F.lit(0), F.lit(39)))
    return rows.select("file", "payload", n.alias("n")).select("file", (F.col("n") + 1).alias("pattern"), field(_p(), 692 + F.col("n") * 8, 8).alias("bits"))


def fonts(blocks: DataFrame) -> DataFrame:
    """FTBL: (file, font_id, name). Entries follow each other, each evenly aligned; the last of an id counts."""
    start = F.struct(F.lit(12).cast("int").alias("at"), F.array().cast("array<struct<n:int,font_id:bigint,name:string>>").alias("found"))

    def step(acc: Column, n: Column) -> Column:
        end = nul_end(_p(), acc["at"] + 2)
        entry = F.struct(n.alias("n"), i16(_p(), acc["at"]).alias("font_id"), c_string(_p(), acc["at"] + 2).alias("name"))
        return F.struct(even(end + 1).cast("int").alias("at"), F.array_append(acc["found"], entry).alias("found"))

    walked = F.aggregate(_numbers(i16(_p(), 6)), start, step)["found"]
    rows = _of(blocks, "FTBL").where(F.octet_length(_p()) >= 8).select("file", "id", F.inline(walked))
    return rows.groupBy("file", "font_id").agg(F.max_by("name", F.struct("id", "n")).alias("name"))


def styles(blocks: DataFrame, font_names: DataFrame | None = None, places: bool = False) -> DataFrame:
    """STBL: entries of 24 bytes with the font's name; size 12 unless the entry has one. With ``places``, also ``n``, the entry's place in its table."""
    rows = _of(blocks, "STBL").where(F.octet_length(_p()) >= 12)
    # each entry takes its own bytes along, not the whole table's
    entry = F.transform(_numbers(i32(_p(), 4)), lambda n: F.struct(n.alias("n"), field(_p(), 14 + 24 * n, 24).alias("entry")))
    rows = rows.select("file", F.inline(entry)).where(F.octet_length("entry") > 0)
    flags, size = i16(F.col("entry"), 12), i16(F.col("entry"), 14)
    styled = rows.select(
        "file", i16(F.col("entry"), 0).alias("style_id"), i16(F.col("entry"), 10).alias("font_id"),
        F.when(flags == -1, F.array().cast("array<string>")).otherwise(text_styles(flags)).alias("text_styles"),
        F.when(size == -1, 12).otherwise(size).alias("font_size"), *(["n"] if places else []),
    )
    return with_fonts(styled, fonts(blocks) if font_names is None else font_names)


def with_fonts(rows: DataFrame, font_names: DataFrame) -> DataFrame:
    """``rows`` plus font_name, empty for unknown fonts."""
    named = font_names.select("file", "font_id", F.col("name").alias("font_name"))
    return rows.join(named, ["file", "font_id"], "left").withColumn("font_name", F.coalesce("font_name", F.lit("")))


def stylesheet(style_rows: DataFrame) -> DataFrame:
    """(file, css): a rule for each style in order of its id, those of one id in order of their place ``n`` where the rows tell it."""
    has = lambda name: F.array_contains("text_styles", name)
    lines = F.array_compact(F.array(
        F.when(F.col("font_id") != -1, F.concat(F.lit('font-family: "'), "font_name", F.lit('";'))),
        F.when(has("bold"), "font-weight: bold;"), F.when(has("italic"), "font-style: italic;"),
        F.when(has("underline"), "text-decoration: underline;"), F.concat(F.lit("font-size: "), F.col("font_size").cast("string"), F.lit("pt;")),
    ))
    rule = F.concat(F.lit(".style"), F.col("style_id").cast("string"), F.lit(" { "), F.array_join(lines, " "), F.lit(" }"))
    ruled = F.sort_array(F.collect_list(F.struct("style_id", *(["n"] if "n" in style_rows.columns else []), rule.alias("rule"))))
    return style_rows.groupBy("file").agg(F.array_join(F.transform(ruled, lambda x: x["rule"]), "\n").alias("css"))


def master_entries(blocks: DataFrame) -> DataFrame:
    """MAST: places of blocks as (file_offset, low byte of the id)."""
    rows = _of(blocks, "MAST").select("file", "payload", F.explode(_numbers(F.floor((F.octet_length(_p()) - 20) / 4))).alias("n"))
    entry = u32(_p(), 20 + F.col("n") * 4)
    return rows.withColumn("raw", entry).where("raw != 0").select(
        "file", "n", F.shiftleft(F.shiftright("raw", 8), 5).alias("file_offset"), (F.col("raw") % 256).alias("id_low"), "raw"
    )


def page_lists(blocks: DataFrame) -> DataFrame:
    """LIST: (file, list_id, n, page_id, entry_count, entry_size). Some lists have the short header; their counts tell."""
    rows = _of(blocks, "LIST").where(F.octet_length(_p()) >= 42)
    most = F.floor(F.octet_length(_p()) / 6)
    usual, short = i32(_p(), 4), i32(_p(), 0)
    compact = ((usual <= 0) | (usual > most)) & (short > 0) & (short <= most)
    size = F.when(compact, i16(_p(), 12)).otherwise(i16(_p(), 16))
    rows = rows.withColumns({"entry_size": F.when(size > 0, size).otherwise(-1), "compact": compact, "tables": F.when(compact, short).otherwise(usual)})
    rows = rows.select("file", F.col("id").alias("list_id"), "payload", "entry_size", "compact", F.explode(_numbers(F.col("tables"))).alias("n"))
    at = 36 + 6 * F.col("n")
    rows = rows.where(at + 4 <= F.octet_length(_p()))
    return rows.select("file", "list_id", "n", i32(_p(), at).cast("int").alias("page_id"), i16(_p(), at + 4).alias("entry_count"), "entry_size", "compact")


def page_entries(blocks: DataFrame) -> DataFrame:
    """PAGE: (file, page_id, n, card_id, flags) of listed pages, up to the first card 0."""
    lists = page_lists(blocks).where("entry_size > 0")
    pages = _of(blocks, "PAGE").select("file", F.col("id").alias("page_id"), "payload")
    rows = lists.join(pages, ["file", "page_id"])
    places = F.transform(_numbers(F.col("entry_count")), lambda n: 12 + n * F.col("entry_size"))
    inside = F.filter(places, lambda at: at + 4 <= F.octet_length(_p()))
    cards = F.transform(inside, lambda at: F.struct(i32(_p(), at).cast("int").alias("card_id"), u8(_p(), at + 4).alias("flags")))
    zero = F.array_position(F.transform(cards, lambda c: c["card_id"]), F.lit(0))
    kept = F.when(zero > 0, F.slice(cards, F.lit(1), (zero - 1).cast("int"))).otherwise(cards)
    return rows.select("file", "list_id", "page_id", F.posexplode(kept).alias("n", "c")).select("file", "list_id", "page_id", "n", "c.*")


def lookup_misses(blocks: DataFrame) -> DataFrame:
    """(file, type, id, message): listed pages and cards that the file lacks."""
    lists, cards = page_lists(blocks), page_entries(blocks)
    wanted = lists.select("file", F.lit("PAGE").alias("type"), F.col("page_id").alias("id"), F.lit("listed page is missing").alias("message")).unionByName(
        cards.select("file", F.lit("CARD").alias("type"), F.col("card_id").alias("id"), F.lit("listed card is missing").alias("message"))
    )
    return wanted.join(blocks.select("file", "type", "id"), ["file", "type", "id"], "left_anti")


PART = "struct<n:int,at:int,length:int>"


def _layers(blocks: DataFrame) -> DataFrame:
    """CARD and BKGD with places of parts and contents, and where the name starts."""
    rows = _of(blocks, "CARD", "BKGD")
    size = F.octet_length(_p())
    card = F.col("type") == "CARD"
    base = F.when(card, 28).otherwise(24)
    rows = rows.withColumns({"n_parts": F.greatest(i16(_p(), base), F.lit(0)), "n_contents": F.greatest(i16(_p(), base + 8), F.lit(0)), "body": base + 14})

    def walk(count: Column, first: Column, least: int, head: int, sized) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.lit(True).alias("go"), F.array().cast(f"array<{PART}>").alias("found"))

        def step(acc: Column, n: Column) -> Column:
            length = sized(acc["at"])
            good = acc["go"] & (size >= acc["at"] + least) & (length >= (least if not head else 0)) & (size >= acc["at"] + head + length)
            entry = F.struct(n.alias("n"), acc["at"].alias("at"), length.cast("int").alias("length"))
            after = even(acc["at"] + length) if not head else acc["at"] + head + length + length % 2
            return F.when(good, F.struct(after.cast("int").alias("at"), F.lit(True).alias("go"), F.array_append(acc["found"], entry).alias("found"))).otherwise(
                F.struct(acc["at"].alias("at"), F.lit(False).alias("go"), acc["found"].alias("found"))
            )

        return F.aggregate(_numbers(count), start, step)

    rows = rows.withColumn("parts", walk(F.col("n_parts"), F.col("body"), 30, 0, lambda at: i16(_p(), at)))
    return rows.withColumn("contents", walk(F.col("n_contents"), F.col("parts.at"), 4, 4, lambda at: i16(_p(), at + 2)))


def layers(blocks: DataFrame) -> DataFrame:
    """One row a card or background: owner, bitmap, flags, counts, name, script."""
    rows = _layers(blocks)
    at = F.col("contents.at")
    card = F.col("type") == "CARD"
    return rows.select(
        "file", "type", "id", i32(_p(), 4).alias("bitmap_id"), i16(_p(), 8).alias("flags"), F.when(card, i32(_p(), 24)).otherwise(-1).alias("owner"),
        has_bit(i16(_p(), 8), 14).alias("cant_delete"), (~has_bit(i16(_p(), 8), 13)).alias("show_picture"),
        "n_parts", "n_contents", c_string(_p(), at).alias("name"), c_string(_p(), nul_end(_p(), at) + 1).alias("script"),
    )


#: Fields of a part in order, two bytes each: its number comes behind the length.
PART_FIELDS = ("part_id", "flags", "top", "left", "bottom", "right", "more", "width", "icon", "align", "font_id", "text_size", "styles", "text_height")


def _walked(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, count: np.ndarray, at: np.ndarray, least: int, head: int, told: int) -> tuple[np.ndarray, ...]:
    """(row, n, at, length) of the entries of all rows, and where the walk of each row ends. An entry's length stands ``told`` bytes behind its start and counts all but ``head`` bytes."""
    at, row, n, found = at.copy(), np.flatnonzero(count > 0), 0, []
    while len(row):
        here, size = at[row], sizes[row]
        length = signed(data, starts[row], size, here + told, 2)
        good = (size >= here + least) & (length >= (0 if head else least)) & (size >= here + head + length)
        row, here, length = row[good], here[good], length[good]
        found.append((row, np.full(len(row), n), here, length))
        at[row] = here + head + length + (length if head else here + length) % 2
        n += 1
        row = row[count[row] > n]
    rows, ns, places, lengths = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 4))
    order = np.lexsort((ns, rows))
    return rows[order], ns[order], places[order], lengths[order], at


def _layer_parts(batch: pa.RecordBatch) -> tuple:
    """The bytes of a batch of layers, their counts of contents, and the walk over their parts."""
    data, starts, sizes = octets(batch.column("payload"))
    base = np.where(pc.equal(batch.column("type"), "CARD").to_numpy(zero_copy_only=False), 28, 24)
    walk = _walked(data, starts, sizes, signed(data, starts, sizes, base, 2), base + 14, 30, 0, 0)
    return data, starts, sizes, signed(data, starts, sizes, base + 8, 2), walk


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, starts, sizes, _, (row, n, at, _, _) = _layer_parts(batch)
        start, size = starts[row], sizes[row]
        zeros = np.flatnonzero(data == 0)

        def nul(place: np.ndarray, end: np.ndarray) -> np.ndarray:
            # zeros stand behind the last row, so there is always one
            return np.minimum(zeros[np.minimum(np.searchsorted(zeros, place), len(zeros) - 1)], end)

        name = start + at + 30
        name_end = nul(name, start + size)
        script = name_end + 2
        name_size, script_size = np.maximum(name_end - name, 0), np.maximum(nul(script, start + size) - script, 0)
        fields = [signed(data, start, size, at + 2 + 2 * i, 2) for i in range(len(PART_FIELDS))]
        for c in cuts(name_size + script_size + 64):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).take(pa.array(row[c])) for x in ("file", "type", "id")), pa.array(n[c], pa.int32()), *(pa.array(f[c]) for f in fields),
                 stretches(data, name[c], name_size[c]), stretches(data, script[c], script_size[c])],
                ["file", "layer_type", "layer_id", "n", *PART_FIELDS, "name", "script"],
            )


def _content_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, starts, sizes, count, walk = _layer_parts(batch)
        row, n, at, length, _ = _walked(data, starts, sizes, count, walk[-1], 4, 4, 2)
        card = pc.equal(batch.column("type"), "CARD").to_numpy(zero_copy_only=False)
        owner = np.where(card, signed(data, starts, sizes, np.full(len(starts), 24), 4), -1)[row]
        start, size = starts[row], sizes[row]
        raw, head = signed(data, start, size, at, 2), unsigned(data, start, size, at + 4, 2)
        for c in cuts(length + 64):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).take(pa.array(row[c])) for x in ("file", "type", "id")), pa.array(owner[c]), pa.array(n[c], pa.int32()), pa.array(raw[c]), pa.array(head[c]),
                 pa.array(length[c], pa.int32()), stretches(data, (start + at + 4)[c], length[c])],
                ["file", "layer_type", "layer_id", "owner", "n", "raw", "head", "length", "data"],
            )


def _part_rows(blocks: DataFrame) -> DataFrame:
    """Parts of layers with their fields as numbers, name and script as bytes."""
    rows = _of(blocks, "CARD", "BKGD").select("file", "type", "id", "payload")
    return rows.mapInArrow(
        _part_batches,
        f"file {rows.schema['file'].dataType.simpleString()}, layer_type string, layer_id {rows.schema['id'].dataType.simpleString()}, n int, " + "".join(f"{f} long, " for f in PART_FIELDS) + "name binary, script binary",
    )


def parts(blocks: DataFrame, font_names: DataFrame | None = None) -> DataFrame:
    """One row a button or field of a layer."""
    kind, more, icon, width = F.shiftright("flags", 8), F.col("more"), F.col("icon"), F.col("width")
    button = kind == 1
    low = more.bitwiseAND(15)
    last = F.when(width <= 0, icon).otherwise(width)
    selected = F.when(~button & (icon > 0) & (last >= icon), F.sequence(icon, last)).when(button & (low == 11) & (icon != 0), F.array(icon))
    made = _part_rows(blocks).select(
        "file", "layer_type", "layer_id", "n", "part_id", F.when(button, "button").otherwise("field").alias("part_type"),
        (~has_bit(F.col("flags"), 7)).alias("visible"), F.struct("top", "left", "bottom", "right").alias("bounds"),
        F.when(button, _named(low, BUTTON_STYLES)).otherwise(_named(low, FIELD_STYLES)).alias("style"),
        F.shiftright(more, 8).bitwiseAND(15).alias("family"), F.coalesce(selected, F.array().cast("array<bigint>")).alias("selected_lines"),
        _named(F.col("align"), ALIGNMENTS).alias("text_align"), "font_id", "text_size", text_styles(F.col("styles")).alias("text_styles"), "text_height",
        mac_text(F.col("name"), True).alias("name"), mac_text(F.col("script"), True).alias("script"),
    )
    return with_fonts(made, fonts(blocks) if font_names is None else font_names)


def background_buttons(part_rows: DataFrame) -> DataFrame:
    rows = part_rows.where("layer_type = 'BKGD' AND part_type = 'button'")
    return rows.select("file", F.col("layer_id").alias("owner"), "part_id").distinct()


def contents(blocks: DataFrame, part_rows: DataFrame | None = None) -> DataFrame:
    """One row a text of a layer. A card's text for a button of its background is its highlight."""
    layers_ = _of(blocks, "CARD", "BKGD").select("file", "type", "id", "payload")
    rows = layers_.mapInArrow(
        _content_batches,
        f"file {layers_.schema['file'].dataType.simpleString()}, layer_type string, layer_id {layers_.schema['id'].dataType.simpleString()}, owner long, n int, raw long, head long, length int, data binary",
    )
    raw, head, data = F.col("raw"), F.col("head"), F.col("data")
    styled = F.when(head > 32767, head - 32768).otherwise(0).cast("int")
    text = field(data, styled, F.col("length") - styled)
    runs = F.transform(_numbers(F.floor((styled - 2) / 4)), lambda k: F.struct(i16(data, 2 + 4 * k).alias("start"), i16(data, 4 + 4 * k).alias("style_id")))
    made = rows.where((styled <= F.col("length")) & ((head <= 32767) | (styled >= 2))).select(
        "file", "layer_type", "layer_id", "owner", "n", F.abs(raw).alias("part_id"), F.when(raw < 0, "card").otherwise("background").alias("layer"),
        runs.alias("style_runs"), mac_text(field(text, 0, nul_end(text, 0)), True).alias("text"), F.hex(text).alias("_raw"),
    )
    if part_rows is None:
        # backgrounds alone: the walk over cards would not be left out by a filter behind it
        part_rows = _part_rows(_of(blocks, "BKGD")).withColumn("part_type", F.when(F.shiftright("flags", 8) == 1, "button").otherwise("field"))
    buttons = background_buttons(part_rows).withColumn("_button", F.lit(True))
    joined = made.join(buttons, ["file", "owner", "part_id"], "left")
    is_button = F.coalesce(F.col("_button"), F.lit(False)) & (F.col("layer") == "background") & (F.col("owner") != -1)
    highlight = F.when(is_button, F.col("_raw") == "0031")
    return joined.withColumns({"highlight": highlight, "text": F.when(~is_button, F.col("text"))}).drop("_button", "_raw")


def text_bytes(content_rows: DataFrame) -> DataFrame:
    """UTF-8 bytes of text of each layer, highlights left out."""
    return content_rows.groupBy("file", "layer_type", "layer_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"))


def scripts(blocks: DataFrame) -> DataFrame:
    """Every non-empty script of stacks, layers and parts: (file, owner_kind, owner_id, name, script)."""
    every = (
        stacks(blocks).select("file", F.lit("stack").alias("owner_kind"), "id", F.lit("").alias("name"), "script")
        .unionByName(layers(blocks).select("file", F.when(F.col("type") == "CARD", "card").otherwise("background").alias("owner_kind"), "id", "name", "script"))
        .unionByName(parts(blocks).select("file", F.lit("part").alias("owner_kind"), F.col("part_id").alias("id"), "name", "script"))
    )
    return every.where("script != ''").withColumnRenamed("id", "owner_id")


def print_settings(blocks: DataFrame) -> DataFrame:
    """PRNT: (file, page_setup_id, n, report_id, name) of the report templates that it lists."""
    rows = _of(blocks, "PRNT").select("file", "payload", F.explode(_numbers(i16(_p(), 0x128))).alias("n"))
    at = 0x12A + 36 * F.col("n")
    rows = rows.where(at + 36 <= F.octet_length(_p()))
    length = F.least(u8(_p(), at + 4), F.lit(31)).cast("int")
    return rows.select("file", i32(_p(), 0x24).alias("page_setup_id"), "n", i32(_p(), at).alias("report_id"), mac_text(field(_p(), at + 5, length)).alias("name"))


#: Fields of a page setup in order, two bytes each (fixed values): before and after the two single bytes.
PAGE_FIELDS = (
    "printerDriverVersion", "iDev", "vertResol", "horizResol", "pageTop", "pageLeft", "pageBottom", "pageRight",
    "paperTop", "paperLeft", "paperBottom", "paperRight", "printerDeviceNumber", "pageV", "pageH",
)
PRINT_FIELDS = ("iDev2", "vertResol2", "horizResol2", "pageTop2", "pageLeft2", "pageBottom2", "pageRight2")
PRINTING_METHODS = {0: "draft", 1: "deferred"}
REPORT_UNITS = {0: "centimeters", 1: "millimeters", 2: "inches", 3: "points"}


def page_setups(blocks: DataFrame) -> DataFrame:
    """PRST: one row a page setup; fields that a short block lacks are null."""

    def given(at: int, size: int, value: Column) -> Column:
        return F.when(F.octet_length(_p()) >= at + size, value)

    first = [given(4 + 2 * i, 2, i16(_p(), 4 + 2 * i)).alias(n) for i, n in enumerate(PAGE_FIELDS)]
    single = 4 + 2 * len(PAGE_FIELDS)
    second = [given(single + 2 + 2 * i, 2, i16(_p(), single + 2 + 2 * i)).alias(n) for i, n in enumerate(PRINT_FIELDS)]
    last = single + 2 + 2 * len(PRINT_FIELDS) + 16
    return _of(blocks, "PRST").select(
        "file", "id", *first, given(single, 2, u8(_p(), single)).alias("port"), given(single, 2, u8(_p(), single + 1)).alias("feedType"), *second,
        *[given(last, 8, i16(_p(), last + 2 * i)).alias(n) for i, n in enumerate(("firstPage", "lastPage", "numCopies"))],
        given(last, 8, _named(u8(_p(), last + 6), PRINTING_METHODS)).alias("printingMethod"),
    )


REPORT_ITEM = "struct<at:int,size:int>"


def report_templates(blocks: DataFrame) -> DataFrame:
    """PRFT: (file, id, units, margins, spacing, cell_size, flags, header, items); an item's size says where the next begins."""
    size = F.octet_length(_p())
    start = F.struct(F.lit(0x11A).alias("at"), F.lit(True).alias("go"), F.array().cast(f"array<{REPORT_ITEM}>").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        length = i16(_p(), acc["at"]).cast("int")
        good = acc["go"] & (size >= acc["at"] + 22) & (length > 0) & (size >= acc["at"] + length)
        found = F.array_append(acc["found"], F.struct(acc["at"].alias("at"), length.alias("size")))
        return F.when(good, F.struct(even(acc["at"] + length).cast("int").alias("at"), F.lit(True).alias("go"), found.alias("found"))).otherwise(
            F.struct(acc["at"].alias("at"), F.lit(False).alias("go"), acc["found"].alias("found"))
        )

    def item(x: Column) -> Column:
        # where the font begins is worked out once
        return bind(nul_end(_p(), x["at"] + 22) + 1, lambda font: fields(x["at"], font))

    def fields(at: Column, font: Column) -> Column:
        flags = i16(_p(), at + 12)
        bits = {"change_height": 13, "change_style": 12, "change_size": 11, "change_font": 10, "invert": 4, "frame_top": 0, "frame_left": 1, "frame_bottom": 2, "frame_right": 3}
        return F.struct(
            rect(_p(), at + 2).alias("bounds"), i16(_p(), at + 10).alias("columns"), *[has_bit(flags, b).alias(n) for n, b in bits.items()],
            i16(_p(), at + 14).alias("text_size"), i16(_p(), at + 16).alias("text_height"), u8(_p(), at + 18).alias("text_style"), i16(_p(), at + 20).alias("text_align"),
            c_string(_p(), at + 22).alias("contents"), c_string(_p(), font).alias("font"),
        )

    count = F.when(size >= 0x11A, i16(_p(), 0x118)).otherwise(0)
    walked = _of(blocks, "PRFT").withColumn("places", F.aggregate(_numbers(count), start, step)["found"])
    known, flags = size >= 25, i16(_p(), 22)
    return walked.select(
        "file", "id", F.when(known, _named(u8(_p(), 4), REPORT_UNITS)).alias("units"), F.when(known, rect(_p(), 6)).alias("margins"),
        *[F.when(known, i16(_p(), at)).alias(n) for n, at in (("spacing_height", 14), ("spacing_width", 16), ("cell_height", 18), ("cell_width", 20))],
        F.when(known, has_bit(flags, 8)).alias("left_to_right"), F.when(known, has_bit(flags, 0)).alias("dynamic_height"),
        F.when(known, mac_text(field(_p(), 25, u8(_p(), 24).cast("int")))).alias("header"), F.transform("places", item).alias("items"),
    )


def source_manifest(blocks: DataFrame) -> DataFrame:
    """(file, manifest): JSON of the block table, type counts and missing references of each file."""
    from ..sources.blocks import missing_references, type_counts

    listed = F.sort_array(F.collect_list(F.struct("seq", "type", "id", "offset", "size", "payload_offset", "payload_bytes", "status")))
    table = blocks.where("type IS NOT NULL").groupBy("file").agg(listed.alias("blocks"))
    counts = type_counts(blocks).groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("block_type_counts"))
    missing = missing_references(blocks, stack_references(blocks)).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("field", "type", "id"))).alias("missing_blocks"))
    joined = table.join(counts, "file").join(missing, "file", "left")
    return joined.select("file", F.to_json(F.struct("block_type_counts", "missing_blocks", "blocks")).alias("manifest"))
