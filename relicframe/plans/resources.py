"""What resources hold: JSON, text, images and sound, by type.

A type's layout is an expression over ``data``, so converting a corpus is one projection
with the payload column pruned where it is not asked for. Types without a public
layout come out as native rows. Only PNG compression runs in an Arrow task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import field, four_cc, i16, i32, mac_text, pascal_string, type_code, u8, u16, u32
from ..functions.text import bind
from .color_pictures import JSON_FORMS, SYSTEM_16
from .records import rect

SIZE_FLAGS = {
    15: "saveScreen", 14: "acceptSuspendResumeEvents", 13: "disableOption", 12: "canBackground", 11: "doesActivateOnFGSwitch", 10: "backgroundAndForeground",
    9: "getFrontClicks", 8: "acceptAppDiedEvents", 7: "is32BitCompatible", 6: "highLevelEventAware", 5: "localAndRemoteHLEvents", 4: "stationeryAware", 3: "useTextEditServices",
}
SOUND_COMMANDS = {0: "null", 0x51: "bufferCmd", 0x8051: "bufferCmd", 0x50: "soundCmd", 0x8050: "soundCmd"}


def _data() -> Column:
    return F.col("data")


def _range(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _color(at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.struct(*[u16(_data(), at + 2 * i).alias(n) for i, n in enumerate(("red", "green", "blue"))])


def _pascal_list(count: Column, start: int) -> Column:
    """Pascal strings one behind another; null if the bytes end before the last does."""
    state = F.struct(F.lit(start).alias("at"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        text = pascal_string(_data(), acc["at"])
        return F.struct((acc["at"] + 1 + u8(_data(), acc["at"]).cast("int")).alias("at"), F.array_append(acc["found"], text).alias("found"))

    walked = F.aggregate(_range(count), state, step)["found"]
    return bind(walked, lambda found: F.when(~F.exists(found, lambda x: x.isNull()), found))


def _strings(start: int, count_at: int) -> Column:
    return bind(_pascal_list(u16(_data(), count_at), start), lambda found: F.when(found.isNotNull(), F.to_json(F.struct(found.alias("strings")))))


def _colors() -> Column:
    n = u16(_data(), 6) + 1
    entry = lambda k: F.struct(u16(_data(), 8 + 8 * k).alias("value"), *[u16(_data(), 10 + 2 * i + 8 * k).alias(c) for i, c in enumerate(("red", "green", "blue"))])
    entries = F.transform(_range(n), entry)
    return F.when(F.octet_length(_data()) >= 8 + 8 * n, F.to_json(F.struct(u32(_data(), 0).alias("seed"), u16(_data(), 4).alias("flags"), entries.alias("entries"))))


def _version() -> Column:
    short = pascal_string(_data(), 6)
    long = pascal_string(_data(), (F.lit(7) + u8(_data(), 6)).cast("int"))
    fields = F.struct(
        F.hex(field(_data(), 0, 1)).cast("int").alias("majorVersion"), u8(_data(), 1).alias("minorVersionBcd"), u8(_data(), 2).alias("developmentStage"),
        u8(_data(), 3).alias("prereleaseVersion"), u16(_data(), 4).alias("regionCode"), short.alias("versionNumber"), long.alias("versionMessage"),
    )
    return F.when(short.isNotNull() & long.isNotNull(), F.to_json(fields))


def _style_runs() -> Column:
    n = u16(_data(), 0)

    def run(k: Column) -> Column:
        at = 2 + 20 * k
        return F.struct(
            i32(_data(), at).alias("offset"), i16(_data(), at + 4).alias("lineHeight"), i16(_data(), at + 6).alias("fontAscent"), i16(_data(), at + 8).alias("fontId"),
            u8(_data(), at + 10).alias("styleFlags"), i16(_data(), at + 12).alias("fontSize"), _color(at + 14).alias("color"),
        )

    return F.when(F.octet_length(_data()) >= 2 + 20 * n, F.to_json(F.struct(F.transform(_range(n), run).alias("runs"))))


def _fonts_used() -> Column:
    n = i16(_data(), 0)
    entry = lambda k: F.struct(i16(_data(), 2 + 6 * k).alias("fontId"), i16(_data(), 4 + 6 * k).alias("styleFlags"), i16(_data(), 6 + 6 * k).alias("size"))
    return F.when(F.octet_length(_data()) >= 2 + 6 * n, F.to_json(F.struct(F.transform(_range(n), entry).alias("entries"))))


def _palette() -> Column:
    n = u16(_data(), 0)
    entries = F.transform(_range(n), lambda k: _color(16 + 16 * k))
    return F.when(F.octet_length(_data()) >= 16 + 16 * n, F.to_json(F.struct(entries.alias("entries"))))


def _size() -> Column:
    flags = u16(_data(), 0)
    decoded = F.struct(*[(flags.bitwiseAND(1 << b) != 0).alias(n) for b, n in SIZE_FLAGS.items()])
    return F.when(F.octet_length(_data()) >= 10, F.to_json(F.struct(flags.alias("flags"), u32(_data(), 2).alias("preferredSize"), u32(_data(), 6).alias("minimumSize"), decoded.alias("decodedFlags"))))


def _sound() -> Column:
    kind = u16(_data(), 0)
    first = F.when(kind == 1, 10).otherwise(4)
    n = F.least(u16(_data(), first), F.lit(32))

    def command(k: Column) -> Column:
        at = first + 2 + 8 * k
        code = u16(_data(), at)
        name = F.lit("unknown")
        for value, label in SOUND_COMMANDS.items():
            name = F.when(code == value, label).otherwise(name)
        return F.struct(k.alias("index"), code.alias("command"), name.alias("commandName"), u16(_data(), at + 2).alias("param1"), u32(_data(), at + 4).alias("param2"))

    known = kind.isin(1, 2)
    commands = F.when(known, F.transform(_range(n), command)).otherwise(F.transform(_range(F.lit(0)), command))
    status = F.when(~known, "notConverted").when(wav_bytes().isNull(), "notConverted").otherwise("converted")
    fields = F.struct(
        F.octet_length(_data()).alias("byteLength"), kind.alias("format"), known.alias("recognizedContainer"), status.alias("wavConversionStatus"),
        F.when(~known, "bad snd format").alias("error"), commands.alias("commands"), F.hex(field(_data(), 0, 32)).alias("firstBytesHex"),
    )
    return F.to_json(fields)


def _font_header() -> Column:
    """The 26 bytes before a bitmap font's strike, and what follows from them."""
    flags, first, last = u16(_data(), 0), u16(_data(), 2), u16(_data(), 4)
    bit = lambda mask: flags.bitwiseAND(mask) != 0
    strike = u16(_data(), 24) * 2 * u16(_data(), 14)
    fields = F.struct(
        flags.alias("typeFlags"), F.element_at(F.array(*[F.lit(d) for d in "1248"]), (flags.bitwiseAND(12) / 4).cast("int") + 1).alias("bitDepth"),
        *[bit(mask).alias(n) for n, mask in FONT_FLAGS.items()], first.alias("firstChar"), last.alias("lastChar"), F.when(last >= first, last - first + 2).otherwise(0).alias("glyphCountIncludingMissing"),
        u16(_data(), 6).alias("maxWidth"), i16(_data(), 8).alias("maxKerning"), i16(_data(), 10).alias("descentOrWidthOffsetHighWord"), u16(_data(), 12).alias("rectWidth"), u16(_data(), 14).alias("rectHeight"),
        (u16(_data(), 24) * 16).alias("bitmapWidth"), u16(_data(), 16).alias("widthOffsetTableOffset"), i16(_data(), 18).alias("maxAscent"), i16(_data(), 20).alias("maxDescent"), i16(_data(), 22).alias("leading"),
        u16(_data(), 24).alias("bitmapRowWidthWords"), strike.alias("bitmapByteCount"), (strike + 26 <= F.octet_length(_data())).alias("bitmapFitsResource"),
    )
    return F.when(F.octet_length(_data()) >= 26, F.to_json(fields))


#: Bits of a bitmap font's type (fixed values).
FONT_FLAGS = {
    "containsImageHeightTable": 0x0001, "containsGlyphWidthTable": 0x0002, "hasColorTable": 0x0080, "isDynamic": 0x0010, "hasNonBlackColors": 0x0020, "fixedWidth": 0x2000, "cannotExpand": 0x4000,
}


def _code_fragments() -> Column:
    """Entries have their own length; the count stands at 30 and the entries begin at 32."""
    kind = "struct<architecture:string,usage:bigint,location:bigint,offset:bigint,length:bigint,name:string>"
    state = F.struct(F.lit(32).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        entry = F.struct(
            four_cc(_data(), at).alias("architecture"), u8(_data(), at + 22).alias("usage"), u8(_data(), at + 23).alias("location"), u32(_data(), at + 24).alias("offset"),
            u32(_data(), at + 28).alias("length"), pascal_string(_data(), at + 42).alias("name"),
        )
        length = F.greatest(u16(_data(), at + 40), F.lit(43)).cast("int")
        return F.struct((at + length).alias("at"), F.array_append(acc["found"], entry.cast(kind)).alias("found"))

    count = F.least(u16(_data(), 30), F.floor(F.octet_length(_data()) / 43))
    entries = F.aggregate(_range(count), state, step)["found"]
    return F.to_json(F.struct(u16(_data(), 10).alias("version"), entries.alias("entries")))


def _font_family() -> Column:
    size = F.octet_length(_data())
    names = ("flags", "familyId", "firstChar", "lastChar", "ascent", "descent", "leading", "maxWidth")
    signed = {"familyId", "ascent", "descent", "leading"}
    head = [(i16 if n in signed else u16)(_data(), 2 * i).alias(n) for i, n in enumerate(names)]
    tables = {n: u32(_data(), 16 + 4 * i) for i, n in enumerate(("widthTable", "kerningTable", "styleMappingTable"))}
    fields = F.struct(
        *head, *[at.alias(f"{n}Offset") for n, at in tables.items()], (size >= 30).alias("hasVersion"), F.when(size >= 30, u16(_data(), 28)).alias("version"),
        *[((at == 0) | (at < size)).alias(f"{n}FitsResource") for n, at in tables.items()],
    )
    return F.when(size >= 28, F.to_json(fields))


def _walked(start: Column, count: Column | None, kind: str, more: Callable[[Column], Column], entry: Callable[[Column], Column], after: Callable[[Column], Column]) -> Column:
    return _walk(start, count, kind, more, entry, after)["found"]


def _walk(start: Column, count: Column | None, kind: str, more: Callable[[Column], Column], entry: Callable[[Column], Column], after: Callable[[Column], Column]) -> Column:
    """(at, found): entries one behind another from ``start``, while ``more`` holds at a place, and where they end; ``after`` says where the next begins."""
    state = F.struct(start.cast("int").alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
    steps = _range(F.octet_length(_data()) if count is None else count)

    def step(acc: Column, _: Column) -> Column:
        taken = F.struct(after(acc["at"]).cast("int").alias("at"), F.array_append(acc["found"], entry(acc["at"]).cast(kind)).alias("found"))
        return F.when(more(acc["at"]), taken).otherwise(acc)

    return F.aggregate(steps, state, step)


MENU_ITEM = "struct<name:string,iconNumber:bigint,keyEquivalent:bigint,markCharacter:bigint,styleFlags:bigint,enabled:boolean>"
MOST_ITEMS = 128


def _menu() -> Column:
    """A title and items up to an empty name; bit n + 1 of the flags enables item n, bit 0 the menu. Items past the 31st are enabled."""
    flags, first = u32(_data(), 10), F.lit(15) + u8(_data(), 14)
    size = F.octet_length(_data())
    name_bytes = lambda at: u8(_data(), at)

    def entry(at: Column) -> Column:
        marks = [u8(_data(), at + 1 + name_bytes(at) + i).alias(n) for i, n in enumerate(("iconNumber", "keyEquivalent", "markCharacter", "styleFlags"))]
        return F.struct(pascal_string(_data(), at).alias("name"), *marks, F.lit(True).alias("enabled"))

    # an item takes 6 bytes at least, so no more of them fit
    most = F.least(F.lit(MOST_ITEMS), F.floor(size / 6))
    found = _walked(first, most, MENU_ITEM, lambda at: (name_bytes(at) > 0) & (size >= at + 5 + name_bytes(at)), entry, lambda at: at + 5 + name_bytes(at))
    items = F.transform(found, lambda x, i: x.withField("enabled", (i >= 31) | (F.floor(flags / F.pow(F.lit(2), i + 1)) % 2 == 1)))
    title = pascal_string(_data(), 14)
    head = (u16(_data(), 0).alias("menuId"), u16(_data(), 6).alias("procId"), flags.alias("enabledFlags"), (flags % 2 == 1).alias("enabled"))
    return F.when(title.isNotNull(), F.to_json(F.struct(*head, title.alias("title"), items.alias("items"))))


#: Kinds of dialog items by their type without the disabled bit; they name a resource or hold a text (fixed values).
DIALOG_KINDS = {4: "button", 5: "checkbox", 6: "radioButton", 7: "resourceControl", 1: "helpBalloon", 8: "text", 16: "editText", 32: "icon", 64: "picture", 0: "custom"}
DIALOG_RESOURCES = (7, 32, 64)
DIALOG_ITEM = "struct<bounds:struct<top:bigint,left:bigint,bottom:bigint,right:bigint>,enabled:boolean,kind:string,rawType:bigint,resourceId:bigint,info:string>"


def _dialog_items() -> Column:
    def entry(at: Column) -> Column:
        raw, length = u8(_data(), at + 12), u8(_data(), at + 13)
        kind = raw % 128
        named = F.lit("unknown")
        for code, name in DIALOG_KINDS.items():
            named = F.when(kind == code, name).otherwise(named)
        resource = kind.isin(*DIALOG_RESOURCES)
        info = F.when(~resource & (length > 0), mac_text(field(_data(), at + 14, length.cast("int"))))
        return F.struct(
            rect(_data(), at + 4).alias("bounds"), (raw < 128).alias("enabled"), named.alias("kind"), raw.alias("rawType"),
            F.when(resource & (length >= 2), i16(_data(), at + 14)).alias("resourceId"), info.alias("info"),
        )

    count = F.least(i16(_data(), 0) + 1, F.lit(MOST_ITEMS))
    size = F.octet_length(_data())
    after = lambda at: at + 14 + u8(_data(), at + 13) + u8(_data(), at + 13) % 2
    found = _walked(F.lit(2), count, DIALOG_ITEM, lambda at: size >= at + 14 + u8(_data(), at + 13), entry, after)
    return bind(found, lambda items: F.when((size >= 2) & (F.size(items) == F.greatest(count, F.lit(0))), F.to_json(F.struct(items.alias("items")))))


#: Kinds of color overlay objects by their number (fixed values).
OVERLAY_KINDS = {1: "button", 2: "field", 3: "rect", 4: "pictResource", 5: "pictFile"}
OVERLAY_OBJECT = (
    "struct<type:string,hidden:boolean,partId:bigint,bevel:bigint,rect:struct<top:bigint,left:bigint,bottom:bigint,right:bigint>,"
    "color:struct<red:bigint,green:bigint,blue:bigint>,transparent:boolean,name:string>"
)


def _color_overlay() -> Column:
    """The objects of a card's or background's color overlay; null if one is unknown or cut off."""
    size = F.octet_length(_data())
    kind = lambda at: u8(_data(), at) % 128

    def length(at: Column) -> Column:
        return F.when(kind(at).isin(1, 2), 11).when(kind(at) == 3, 17).when(kind(at).isin(4, 5), 11 + u8(_data(), at + 10)).otherwise(F.lit(1 << 30))

    def entry(at: Column) -> Column:
        is_part, is_rect, is_picture = kind(at).isin(1, 2), kind(at) == 3, kind(at).isin(4, 5)
        named = F.lit("unknown")
        for code, name in OVERLAY_KINDS.items():
            named = F.when(kind(at) == code, name).otherwise(named)
        return F.struct(
            named.alias("type"), (u8(_data(), at) >= 128).alias("hidden"), F.when(is_part, i16(_data(), at + 1)).alias("partId"),
            F.when(is_part, i16(_data(), at + 3)).when(is_rect, i16(_data(), at + 9)).alias("bevel"), F.when(~is_part, rect(_data(), at + 1)).alias("rect"),
            F.when(is_part, _color(at + 5)).when(is_rect, _color(at + 11)).alias("color"), F.when(is_picture, u8(_data(), at + 9) != 0).alias("transparent"),
            F.when(is_picture, F.nullif(pascal_string(_data(), at + 10), F.lit(""))).alias("name"),
        )

    walked = _walk(F.lit(0), F.floor(size / 11), OVERLAY_OBJECT, lambda at: (at < size) & (at + length(at) <= size), entry, lambda at: at + length(at))
    target = F.when(F.col("type") == "HCbg", "background").otherwise("card")
    return F.transform(F.array(walked), lambda w: F.when(w["at"] == size, F.to_json(F.struct(target.alias("targetKind"), F.col("id").alias("targetId"), w["found"].alias("objects")))))[0]


BUNDLE_TYPE = "struct<type:string,ids:array<struct<localId:bigint,resourceId:bigint>>>"


def _bundle() -> Column:
    """The types that a bundle links, each with its local ids and the resources that these stand for."""
    size = F.octet_length(_data())
    n_ids = lambda at: (u16(_data(), at + 4) + 1).cast("int")
    pair = lambda at: lambda k: F.struct(i16(_data(), at + 6 + 4 * k).alias("localId"), i16(_data(), at + 8 + 4 * k).alias("resourceId"))
    entry = lambda at: F.struct(four_cc(_data(), at).alias("type"), F.transform(_range(n_ids(at)), pair(at)).alias("ids"))
    fits = lambda at: (size >= at + 6) & (size >= at + 6 + 4 * n_ids(at))
    count = F.least(u16(_data(), 6) + 1, F.lit(MOST_BUNDLE_TYPES + 1))
    walked = _walked(F.lit(8), count, BUNDLE_TYPE, fits, entry, lambda at: at + 6 + 4 * n_ids(at))
    fields = lambda types: F.struct(
        u32(_data(), 0).alias("ownerName"), four_cc(_data(), 0).alias("ownerNameString"), i16(_data(), 4).alias("ownerId"),
        F.transform(types, lambda t: F.struct(type_code(t["type"]).alias("type"), t["type"].alias("typeString"), t["ids"].alias("ids"))).alias("types"),
    )
    return bind(walked, lambda types: F.when((size >= 8) & (F.size(types) == count) & (count <= MOST_BUNDLE_TYPES), F.to_json(fields(types))))


#: Types that a bundle may link.
MOST_BUNDLE_TYPES = 64
PAIR = "struct<completionChar:bigint,substituteChar:bigint>"
DEAD_KEY = f"struct<tableIndex:bigint,virtualKeyCode:bigint,completions:array<{PAIR}>,noMatchCompletion:{PAIR}>"


def _key_map() -> Column:
    """A keyboard map: a table for each set of modifiers, then dead keys, each with the pairs that complete it."""
    size = F.octet_length(_data())
    n_tables = u16(_data(), 258).cast("int")
    keys_at = (F.lit(260) + 128 * n_tables).cast("int")
    n_pairs = lambda at: u16(_data(), at + 2).cast("int")
    pair = lambda at: F.struct(u8(_data(), at).alias("completionChar"), u8(_data(), at + 1).alias("substituteChar"))
    after = lambda at: at + 6 + 2 * n_pairs(at)

    def entry(at: Column) -> Column:
        pairs = F.transform(_range(n_pairs(at)), lambda k: pair(at + 4 + 2 * k))
        return F.struct(u8(_data(), at).alias("tableIndex"), u8(_data(), at + 1).alias("virtualKeyCode"), pairs.alias("completions"), pair(at + 4 + 2 * n_pairs(at)).alias("noMatchCompletion"))

    # a dead key takes 6 bytes at least, so no more of them fit
    n_keys = u16(_data(), keys_at)
    walked = _walked(keys_at + 2, F.least(n_keys, F.floor(size / 6)), DEAD_KEY, lambda at: (size >= at + 4) & (size >= after(at)), entry, after)
    tables = F.transform(_range(n_tables), lambda i: F.struct(i.alias("index"), F.hex(field(_data(), 260 + 128 * i, 128)).alias("charsHex")))
    fields = lambda dead: F.struct(F.transform(_range(F.lit(256)), lambda i: u8(_data(), 2 + i)).alias("modifierTableIndexes"), tables.alias("tables"), dead.alias("deadKeys"))
    return bind(walked, lambda dead: F.when((size >= 260) & (size >= keys_at + 2) & (F.size(dead) == n_keys), F.to_json(fields(dead))))


JSON_TYPES: dict[tuple[str, ...], Callable[[], Column]] = {
    ("STR#",): lambda: _strings(2, 0),
    ("TwCS",): lambda: F.when(u8(_data(), 2) == 0, _strings(4, 0)),
    ("clut", "CTBL", "actb", "cctb", "dctb", "fctb", "wctb"): _colors,
    ("pltt",): _palette,
    ("vers",): _version,
    ("styl",): _style_runs,
    ("TxSt",): lambda: F.to_json(F.struct(u8(_data(), 0).alias("fontStyle"), u16(_data(), 2).alias("fontSize"), _color(4).alias("textColor"), pascal_string(_data(), 10).alias("fontName"))),
    ("finf",): _fonts_used,
    ("SIZE",): _size,
    ("RECT",): lambda: F.when(F.octet_length(_data()) >= 8, F.to_json(rect(_data(), 0))),
    ("MBAR",): lambda: F.when(F.octet_length(_data()) >= 2 + 2 * u16(_data(), 0), F.to_json(F.struct(F.transform(_range(u16(_data(), 0)), lambda k: i16(_data(), 2 + 2 * k)).alias("menuIds")))),
    ("TOOL",): lambda: F.to_json(F.struct(u16(_data(), 0).alias("toolsPerRow"), u16(_data(), 2).alias("rowCount"), F.transform(_range(u16(_data(), 0) * u16(_data(), 2)), lambda k: u16(_data(), 4 + 2 * k)).alias("cursorIds"))),
    ("FREF",): lambda: F.to_json(F.struct(four_cc(_data(), 0).alias("fileType"), i16(_data(), 4).alias("localId"), pascal_string(_data(), 6).alias("fileName"))),
    ("KBDN",): lambda: F.to_json(F.struct(pascal_string(_data(), 0).alias("name"))),
    ("decl",): lambda: F.to_json(F.struct(F.octet_length(_data()).alias("byteLength"), F.hex(field(_data(), 0, 32)).alias("prefixHex"))),
    ("snd ",): lambda: _sound(),
    ("FONT", "NFNT"): _font_header,
    ("FOND",): _font_family,
    ("MENU",): _menu,
    ("DITL",): _dialog_items,
    ("HCbg", "HCcd"): _color_overlay,
    ("cfrg",): _code_fragments,
    ("BNDL",): _bundle,
    ("KCHR",): _key_map,
    **{(kind,): lambda form=form: form(_data()) for kind, form in JSON_FORMS.items()},
    ("WIND",): lambda: F.to_json(F.struct(rect(_data(), 0).alias("bounds"), i16(_data(), 8).alias("procId"), (u16(_data(), 10) != 0).alias("visible"), (u16(_data(), 12) != 0).alias("goAway"), i32(_data(), 14).alias("refCon"), pascal_string(_data(), 18).alias("title"))),
    ("DLOG",): lambda: F.to_json(F.struct(rect(_data(), 0).alias("bounds"), i16(_data(), 8).alias("procId"), (u8(_data(), 10) != 0).alias("visible"), (u8(_data(), 12) != 0).alias("goAway"), i32(_data(), 14).alias("refCon"), i16(_data(), 18).alias("itemListId"), pascal_string(_data(), 20).alias("title"))),
    ("CNTL",): lambda: F.to_json(F.struct(rect(_data(), 0).alias("bounds"), i16(_data(), 8).alias("value"), (u8(_data(), 10) != 0).alias("visible"), i16(_data(), 12).alias("maximum"), i16(_data(), 14).alias("minimum"), i16(_data(), 16).alias("procId"), i32(_data(), 18).alias("refCon"), pascal_string(_data(), 22).alias("title"))),
    ("ALRT",): lambda: F.to_json(F.struct(rect(_data(), 0).alias("bounds"), i16(_data(), 8).alias("itemListId"), u16(_data(), 10).alias("stages"))),
}
TEXT_TYPES = ("STR ", "TEXT")


def converted(resources: DataFrame, wants: Collection[str] | None = None) -> DataFrame:
    """(file, type, id, name, format, media_type, text, error) of each resource with a known JSON or text form.

    ``wants`` names the types asked for; others are neither read nor planned.
    """
    kind = F.col("type")
    asked = {types: make for types, make in JSON_TYPES.items() if wants is None or set(types) & set(wants)}
    kinds = [t for types in asked for t in types]
    texts = [t for t in TEXT_TYPES if wants is None or t in wants]
    text = F.when(kind == "STR ", pascal_string(_data(), 0)).when(kind == "TEXT", mac_text(_data()))
    for types, make in asked.items():
        text = text.when(kind.isin(*types), make())
    is_text = kind.isin(*texts)
    # the text is worked out once, inside a lambda, however often it is named; what the type alone says stands outside, so that a filter on it needs no text
    told = bind(text, lambda t: F.struct(t.alias("text"), F.when(t.isNull(), "unexpected end").alias("error")))
    known = kind.isin(*kinds, *texts) if kinds or texts else F.lit(False)
    form, media = F.when(is_text, "text").otherwise("json"), F.when(is_text, "text/plain").otherwise("application/json")
    return resources.where(known).select("file", "type", "id", "name", form.alias("format"), media.alias("media_type"), told.alias("told")).select("file", "type", "id", "name", "format", "media_type", "told.*")


def convert(resources: DataFrame, wants: Collection[str] | None = None) -> DataFrame:
    """The rows of converted(), and a native row for each resource."""
    if wants is not None:
        resources = resources.where(F.col("type").isin(*wants))
    native = resources.select("file", "type", "id", "name", F.lit("native").alias("format"), F.lit("application/octet-stream").alias("media_type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    return converted(resources, wants).unionByName(native)


# --- sound -----------------------------------------------------------------------------------


def _little(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def wav_bytes() -> Column:
    """WAV of an uncompressed 8-bit ``snd `` resource; null for other encodings."""
    kind = u16(_data(), 0)
    first = F.when(kind == 1, 10).otherwise(4)

    def header_at(commands: Column) -> Column:
        n = u16(_data(), commands)
        places = F.transform(_range(n), lambda k: F.when(u16(_data(), commands + 2 + 8 * k).isin(0x8050, 0x8051), u32(_data(), commands + 6 + 8 * k)))
        return F.coalesce(F.try_element_at(F.filter(places, lambda p: p.isNotNull() & (p != 0)), F.lit(1)), (commands + 2 + 8 * n)).try_cast("int")

    def made(at: Column, count: Column, rate: Column) -> Column:
        samples = field(_data(), at + 22, count.try_cast("int"))
        pad = F.when(count % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
        head = F.concat(
            F.lit(b"RIFF"), _little(36 + count + count % 2, 4), F.lit(b"WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(1), 2),
            _little(rate, 4), _little(rate, 4), _little(F.lit(1), 2), _little(F.lit(8), 2), F.lit(b"data"), _little(count, 4),
        )
        plain = kind.isin(1, 2) & (u8(_data(), at + 20) == 0) & (F.octet_length(_data()) >= at + 22 + count) & (count > 0)
        return F.when(plain, F.concat(head, samples, pad))

    return bind(bind(first, header_at), lambda at: bind(u32(_data(), at + 4), lambda count: bind(u16(_data(), at + 8), lambda rate: made(at, count, rate))))


def sounds(resources: DataFrame) -> DataFrame:
    """(file, id, name, wav) of ``snd `` resources."""
    return resources.where("type = 'snd '").select("file", "id", "name", wav_bytes().alias("wav"))


# --- images ------------------------------------------------------------------------------------

#: type -> (width, height, bytes of one picture, has a mask behind it)
ONE_BIT = {"ICON": (32, 32, 128, False), "ICN#": (32, 32, 128, True), "CURS": (16, 16, 32, True), "SICN": (16, 16, 32, False), "PAT ": (8, 8, 8, False), "PAT#": (8, 8, 8, False), "ics#": (16, 16, 32, True), "icm#": (16, 12, 24, True)}


def png(width: int, height: int, rows: list[bytes], depth: int = 1, kind: int = 0) -> bytes:
    """A PNG of packed rows."""

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def pictures(resources: DataFrame) -> DataFrame:
    """(file, type, id, variant, width, height, bits, mask): the one-bit pictures in resources."""
    rows = resources
    found = None
    for kind, (width, height, size, masked) in ONE_BIT.items():
        step = 2 * size if masked else size
        start = F.when((F.lit(kind) == "ICON") & (F.octet_length(_data()) == 140), 12).otherwise(0)
        if kind == "PAT#":  # counted
            start = F.lit(2)
        whole = F.floor((F.octet_length(_data()) - start) / step)
        n = whole if kind == "SICN" else F.least(u16(_data(), 0), whole) if kind == "PAT#" else F.when(F.octet_length(_data()) - start >= step, 1).otherwise(0)
        part = rows.where(F.col("type") == kind).select("file", "type", "id", "data", F.explode(_range(n)).alias("variant"), start.alias("start"))
        at = F.col("start") + step * F.col("variant")
        mask = field(_data(), at + size, size) if masked else F.lit(None).cast("binary")
        part = part.select("file", "type", "id", "variant", F.lit(width).alias("width"), F.lit(height).alias("height"), field(_data(), at, size).alias("bits"), mask.alias("mask"))
        found = part if found is None else found.unionByName(part)
    return found


def write_pngs(picture_rows: DataFrame) -> DataFrame:
    """``picture_rows`` with a grey-and-alpha PNG each: set bits are black, the mask is the alpha."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, bits, mask in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "bits", "mask")), strict=True):
                planes = [np.unpackbits(np.frombuffer(x, np.uint8)).reshape(h, -1)[:, :w] if x is not None else np.ones((h, w), np.uint8) for x in (bits, mask)]
                grey = np.stack([1 - planes[0], planes[1]], axis=-1) * np.uint8(255)
                out.append(png(w, h, [row.tobytes() for row in grey], 8, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "png"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picture_rows.schema)
    return picture_rows.mapInArrow(run, f"{fields}, png binary")


PIXMAP_DEPTHS = (8, 4, 2, 1)
PIXMAP_SIDE = 512


def _palette_of(depth: int) -> np.ndarray:
    """RGBA of each index: white to black, but the system's colors at 4 bits and black to white at 8."""
    if depth == 4:
        colors = SYSTEM_16
    else:
        greys = np.arange(256) if depth == 8 else np.linspace(255, 0, 1 << depth)
        colors = np.repeat(greys[:, None], 3, axis=1)
    return np.column_stack([colors, np.full(len(colors), 255)]).astype(np.uint8)


def compact_pixmaps(resources: DataFrame) -> DataFrame:
    """(file, id, width, height, depth, rgba) of ``pixs`` resources that hold a compact indexed picture.

    The depth stands before the pixels or follows from the bytes of a row. Other
    layouts give no row; rgba is null where rows are shorter than the width needs.
    """
    size, row_bytes = F.octet_length(_data()), u16(_data(), 0).bitwiseAND(0x3FFF)
    box = rect(_data(), 2)
    width, height = box["right"] - box["left"], box["bottom"] - box["top"]
    told = u16(_data(), 10).isin(*PIXMAP_DEPTHS) & (size >= 12 + row_bytes * height)
    depth = F.when(told, u16(_data(), 10))
    for d in PIXMAP_DEPTHS:
        spare = row_bytes - F.ceil(width * d / 8)
        depth = F.coalesce(depth, F.when((size >= 10 + row_bytes * height) & spare.between(0, 1), d))
    pixels = field(_data(), F.when(told, 12).otherwise(10), (row_bytes * height).cast("int"))
    whole = (F.col("type") == "pixs") & (size >= 10) & (row_bytes > 0) & width.between(1, PIXMAP_SIDE) & height.between(1, PIXMAP_SIDE)
    found = resources.where(whole).select("file", "id", *[x.cast("int").alias(n) for n, x in (("width", width), ("height", height), ("depth", depth))], pixels.alias("pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for w, h, d, data in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(h, -1, d)
                index = bits[:, :w] @ (1 << np.arange(d)[::-1])
                made.append(_palette_of(d)[index].tobytes() if bits.shape[1] >= w else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.binary())], names=["file", "id", "width", "height", "depth", "rgba"])

    kinds = dict(found.dtypes)
    return found.where("depth IS NOT NULL").mapInArrow(run, f"file {kinds['file']}, id {kinds['id']}, width int, height int, depth int, rgba binary")


def cursor_hotspots(resources: DataFrame) -> DataFrame:
    return resources.where("type = 'CURS'").select("file", "id", i16(_data(), 64).alias("hotspot_y"), i16(_data(), 66).alias("hotspot_x"))


def pbm_to_png(files: DataFrame) -> DataFrame:
    """(path, png, error) of P4 bitmaps (path, content); the first picture of a file counts."""

    def parse(data: bytes) -> bytes:
        tokens, at = [], 0
        while len(tokens) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            tokens.append(data[at:end])
            at = end
        if tokens[0] != b"P4":
            raise ValueError("no P4 bitmap")
        width, height, at = int(tokens[1]), int(tokens[2]), at + 1
        stride = (width + 7) // 8
        if len(data) < at + stride * height:
            raise ValueError("bitmap ends early")
        inverted = ~np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        return png(width, height, [row.tobytes() for row in inverted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    made.append(parse(content or b""))
                    errors.append(None)
                except (ValueError, IndexError) as e:
                    made.append(None)
                    errors.append(str(e) or "bad bitmap")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["path", "png", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, png binary, error string")


#: Types that hold code (fixed values).
CODE_TYPES = ("XCMD", "XFCN", "xcmd", "xfcn", "CODE", "DRVR", "dcmp", "PACK", "boot", "ptch")


def with_code_strings(resources: DataFrame) -> DataFrame:
    """Words of code resources as dc.w lines, for types whose instructions are not decoded here."""
    words = F.transform(_range(F.floor(F.octet_length(_data()) / 2)), lambda k: F.concat(F.lpad(F.hex(2 * k), 8, "0"), F.lit("  dc.w $"), F.hex(field(_data(), 2 * k, 2))))
    return resources.where(F.col("type").isin(*CODE_TYPES)).select("file", "type", "id", F.array_join(words, "\n").alias("listing"))
