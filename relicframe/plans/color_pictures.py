"""Color patterns, icons and cursors: pixel maps found by offsets inside a payload, with their own color tables.

Where things lie in a payload is said by column expressions, which also make the JSON
form; only the pixels go to Arrow tasks, which look a whole picture up in one numpy gather. A color
table lists colors by value; the highest value that the depth allows is black where the table
lacks it, and any other missing value is an error, as is a picture that its payload does not hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import field, i16, i32, u16, u32
from ..functions.text import bind
from .records import rect

PIXMAP_BYTES = 50
DEPTHS = (1, 2, 4, 8)
#: Pixels of the largest picture that is decoded.
MOST_PIXELS = 1 << 26
#: Rows that a task takes apart at a time, bytes of pictures that it gives back at a time, and what a row counts besides its pixels.
READ_ROWS, BATCH_BYTES, ROW_BYTES = 256, 4 << 20, 500
TILES = 8
PATTERN_SIDE, CURSOR_SIDE = 8, 16
PATTERN_KINDS = ("color", "color_tiled", "bitmap", "bitmap_tiled")



def pixel_map(data: Column, at: Column) -> Column:
    """The 50 bytes of a pixel map, from its row bytes on; the two flag bits of the row bytes are left out."""
    names = {
        "version": u16(data, at + 14), "packFormat": u16(data, at + 16), "packSize": u32(data, at + 18), "horizontalResolution": u32(data, at + 22), "verticalResolution": u32(data, at + 26),
        "pixelType": u16(data, at + 30), "pixelSize": u16(data, at + 32), "componentCount": u16(data, at + 34), "componentSize": u16(data, at + 36), "planeOffset": u32(data, at + 38),
        "colorTableOffset": u32(data, at + 42), "reserved": u32(data, at + 46),
    }
    return F.struct(u16(data, at + 4).bitwiseAND(0x3FFF).alias("rowBytes"), rect(data, at + 6).alias("bounds"), *[x.alias(n) for n, x in names.items()])


def bitmap_header(data: Column, at: int) -> Column:
    return F.struct(u16(data, at + 4).bitwiseAND(0x3FFF).alias("rowBytes"), rect(data, at + 6).alias("bounds"))


def color_table_bytes(data: Column, at: Column) -> Column:
    """The entries of a color table (value, red, green, blue: 8 bytes each) at ``at``; null if the bytes end before they do."""
    length = (8 * (u16(data, at + 6) + 1)).cast("int")
    return F.when((F.octet_length(data) >= at + 8) & (F.octet_length(data) >= at + 8 + length), field(data, at + 8, length))


def _int(value: Column) -> Column:
    """A place in a payload; null where it is beyond what a payload can hold."""
    return value.try_cast("int")


# --- patterns ------------------------------------------------------------------------------------

_PATTERN = 28


def pattern(data: Column) -> Column:
    """The head of a pixel pattern; pixelMap is null for the old kind without one."""
    has_map = lambda at: (u16(data, 0) == 1) & (F.octet_length(data) >= at + PIXMAP_BYTES)
    found = bind(_int(u32(data, 2)), lambda at: F.when(has_map(at), pixel_map(data, at)))
    return F.struct(
        u16(data, 0).alias("type"), u32(data, 2).alias("pixelMapOffset"), u32(data, 6).alias("pixelDataOffset"), u32(data, 10).alias("expandedData"), u16(data, 14).alias("expandedDepth"),
        u32(data, 16).alias("reserved"), F.hex(field(data, 20, 8)).alias("monochromePatternHex"), found.alias("pixelMap"),
    )


def pattern_is_whole(data: Column) -> Column:
    """A pattern's head is there, and its pixel map if it has one."""
    kind = u16(data, 0)
    return (F.octet_length(data) >= _PATTERN) & ((kind == 0) | (kind == 1) & (F.octet_length(data) >= _int(u32(data, 2)) + PIXMAP_BYTES))


def pattern_slices(data: Column) -> Column:
    """The patterns of a list: a count, their offsets, and each pattern up to the next one; null where an offset lies outside."""
    n, size = u16(data, 0).cast("int"), F.octet_length(data)
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    start = lambda i: _int(u32(data, 2 + 4 * i))
    end = lambda i: F.when(i + 1 < n, start(i + 1)).otherwise(size)
    places = F.transform(numbers, lambda i: F.struct(start(i).alias("start"), end(i).alias("end")))
    slices = F.transform(places, lambda p: F.struct(p["start"].alias("offset"), field(data, p["start"], p["end"] - p["start"]).alias("data"), (p["start"] < p["end"]).alias("fits")))
    inside = lambda all_: F.forall(all_, lambda s: F.coalesce(s["fits"] & (s["offset"] < size), F.lit(False)))
    return bind(slices, lambda all_: F.when((size >= 2 + 4 * n) & inside(all_), all_))


def pattern_json(data: Column) -> Column:
    return bind(data, lambda d: F.when(pattern_is_whole(d), F.to_json(pattern(d))))


def pattern_list_json(data: Column) -> Column:
    return bind(data, lambda d: bind(pattern_slices(d), _slices_json))


def _slices_json(slices: Column) -> Column:
    entries = F.transform(slices, lambda s: F.struct(s["offset"].alias("offset"), pattern(s["data"]).alias("p")))
    flat = F.transform(entries, lambda e: F.struct(e["offset"].alias("offset"), *[e["p"][n].alias(n) for n in ("type", "pixelMapOffset", "pixelDataOffset", "expandedData", "expandedDepth", "reserved", "monochromePatternHex", "pixelMap")]))
    return F.when(F.forall(slices, lambda s: pattern_is_whole(s["data"])), F.to_json(F.struct(flat.alias("patterns"))))


def _spot(data: Column, map_at: Column, pixels_at: Column, table_at: Column, mask: Column, mask_row_bytes: Column, alpha: bool) -> Column:
    """struct of what the task needs of a picture whose pixel map is at ``map_at``."""

    def measured(m: Column, at: Column) -> Column:
        box, row_bytes = m["box"], m["row_bytes"]
        width, height = box["right"] - box["left"], box["bottom"] - box["top"]
        whole = (width > 0) & (height > 0) & (width * height <= MOST_PIXELS) & (F.octet_length(data) >= at["pixels"] + row_bytes * height)
        return F.struct(
            _int(width).alias("width"), _int(height).alias("height"), _int(m["depth"]).alias("depth"), _int(row_bytes).alias("row_bytes"), F.when(whole, field(data, at["pixels"], _int(row_bytes * height))).alias("pixels"),
            color_table_bytes(data, at["table"]).alias("table"), mask.alias("mask"), _int(mask_row_bytes).alias("mask_row_bytes"), F.lit(alpha).alias("alpha"),
        )

    heads = lambda at: F.struct(rect(data, at["map"] + 6).alias("box"), u16(data, at["map"] + 4).bitwiseAND(0x3FFF).alias("row_bytes"), u16(data, at["map"] + 32).alias("depth"))
    places = F.struct(map_at.alias("map"), pixels_at.alias("pixels"), table_at.alias("table"))
    return bind(places, lambda at: bind(heads(at), lambda m: measured(m, at)))


def _pattern_spot(data: Column) -> Column:
    no_mask = F.lit(None).cast("binary"), F.lit(None).cast("int")
    spot = bind(_int(u32(data, 2)), lambda at: _spot(data, at, _int(u32(data, 6)), _int(u32(data, at + 42)), *no_mask, alpha=False))
    return F.when(u16(data, 0) == 1, spot)


# --- icons and cursors ---------------------------------------------------------------------------

_ICON_HEAD, _CURSOR_HEAD = 82, 96


def _with_icon_places(data: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of where an icon's mask, bitmap, color table and pixels begin; they lie one behind another."""
    rows = lambda at: u16(data, at + 4).bitwiseAND(0x3FFF) * (i16(data, at + 10) - i16(data, at + 6))
    first = F.struct(F.lit(_ICON_HEAD).alias("mask"), _int(F.lit(_ICON_HEAD) + rows(50)).alias("bitmap"), _int(F.lit(_ICON_HEAD) + rows(50) + rows(64)).alias("table"))
    pixels = lambda at: _int(at["table"] + 8 + 8 * (u16(data, at["table"] + 6) + 1))
    return bind(first, lambda at: bind(F.struct(at["mask"].alias("mask"), at["bitmap"].alias("bitmap"), at["table"].alias("table"), pixels(at).alias("pixels")), body))


def icon_json(data: Column) -> Column:
    def form(d: Column, at: Column) -> Column:
        fields = F.struct(
            u32(d, 0).alias("pixMapUnused"), pixel_map(d, F.lit(0)).alias("pixelMap"), u32(d, 50).alias("maskUnused"), bitmap_header(d, 50).alias("mask"),
            u32(d, 64).alias("bitmapUnused"), bitmap_header(d, 64).alias("bitmap"), u32(d, 78).alias("iconData"),
            at["mask"].alias("maskDataOffset"), at["bitmap"].alias("bitmapDataOffset"), at["table"].alias("colorTableOffset"),
        )
        return F.when((F.octet_length(d) >= _ICON_HEAD) & (at["table"] <= F.octet_length(d)), F.to_json(fields))

    return bind(data, lambda d: _with_icon_places(d, lambda at: form(d, at)))


def _icon_spot(data: Column) -> Column:
    mask_rows = u16(data, 54).bitwiseAND(0x3FFF)
    spot = lambda at: _spot(data, F.lit(0), at["pixels"], at["table"], field(data, at["mask"], at["bitmap"] - at["mask"]), mask_rows, alpha=True)
    return _with_icon_places(data, spot)


def cursor_json(data: Column) -> Column:
    def form(d: Column, at: Column) -> Column:
        fields = F.struct(
            u16(d, 0).alias("type"), u32(d, 2).alias("pixelMapOffset"), u32(d, 6).alias("pixelDataOffset"), u32(d, 10).alias("expandedData"), u16(d, 14).alias("expandedDepth"),
            u32(d, 16).alias("reserved"), u16(d, 84).alias("hotspotY"), u16(d, 86).alias("hotspotX"), u32(d, 88).alias("colorTableOffset"), i32(d, 92).alias("cursorId"), pixel_map(d, at).alias("pixelMap"),
        )
        return F.when((F.octet_length(d) >= _CURSOR_HEAD) & (F.octet_length(d) >= at + PIXMAP_BYTES), F.to_json(fields))

    return bind(data, lambda d: bind(_int(u32(d, 2)), lambda at: form(d, at)))


def _cursor_spot(data: Column) -> Column:
    return bind(_int(u32(data, 2)), lambda at: _spot(data, at, _int(u32(data, 6)), _int(u32(data, at + 42)), field(data, 52, 32), F.lit(2), alpha=True))


JSON_FORMS = {"ppat": pattern_json, "ppt#": pattern_list_json, "cicn": icon_json, "crsr": cursor_json}


# --- palettes of the system ------------------------------------------------------------------------

#: type -> (width, height, depth) of icons whose colors are those of the system.
INDEXED_ICONS = {"icl4": (32, 32, 4), "icl8": (32, 32, 8), "icm4": (16, 12, 4), "icm8": (16, 12, 8), "ics4": (16, 16, 4), "ics8": (16, 16, 8)}


def system_palette() -> np.ndarray:
    """The 256 colors of the system, by rule: a cube of six levels from white down without its black, ramps of red, green, blue and grey, and black."""
    levels = np.arange(5, -1, -1) * 0x33
    cube = np.stack(np.meshgrid(levels, levels, levels, indexing="ij"), axis=-1).reshape(-1, 3)[:-1]
    ramp = np.array([x * 0x11 for x in range(14, 0, -1) if x % 3])
    ramps = [np.outer(ramp, channels) for channels in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1))]
    return np.concatenate([cube, *ramps, [[0, 0, 0]]]).astype(np.uint8)


# --- pixels --------------------------------------------------------------------------------------


def indexes(pixels: bytes, row_bytes: int, width: int, height: int, depth: int) -> np.ndarray:
    """The value of each pixel of packed rows."""
    bits = np.unpackbits(np.frombuffer(pixels, np.uint8)).reshape(height, row_bytes * 8 // depth, depth)
    return bits[:, :width] @ (1 << np.arange(depth)[::-1])


def with_alpha(colors: np.ndarray, alpha: np.ndarray | int = 255) -> np.ndarray:
    """RGBA of RGB values."""
    out = np.empty((*colors.shape[:-1], 4), np.uint8)
    out[..., :3], out[..., 3] = colors, alpha
    return out


def gathered(width: int, height: int, depth: int, row_bytes: int, pixels: bytes | None, table: bytes | None, mask: bytes | None, mask_row_bytes: int | None, alpha: bool) -> np.ndarray:
    """RGBA of an indexed picture, height x width x 4; ValueError says what is wrong with it."""
    if width <= 0 or height <= 0:
        raise ValueError("empty bounds")
    if width * height > MOST_PIXELS:
        raise ValueError("image is too large")
    if depth not in DEPTHS:
        raise ValueError("unsupported depth")
    if pixels is None or table is None or row_bytes * 8 < width * depth:
        raise ValueError("unexpected end")
    entries = np.frombuffer(table, ">u2").reshape(-1, 4)
    # pixels reach no further than the depth does
    known, colors = np.zeros(1 << depth, bool), np.zeros((1 << depth, 3), np.uint8)
    # of equal values the first counts, so it is put in last
    entries = entries[entries[:, 0] < 1 << depth][::-1]
    known[entries[:, 0]], colors[entries[:, 0]] = True, entries[:, 1:] >> 8
    known[(1 << depth) - 1] = True
    index = indexes(pixels, row_bytes, width, height, depth)
    if not known[index].all():
        raise ValueError("color index not found")
    if not alpha or not mask_row_bytes:
        return with_alpha(colors[index])
    if mask_row_bytes * 8 < width or len(mask or b"") < mask_row_bytes * height:
        raise ValueError("unexpected end of mask")
    return with_alpha(colors[index], 255 * indexes(mask[: mask_row_bytes * height], mask_row_bytes, width, height, 1))


def one_bit(bits: bytes, side: int, mask: bytes | None = None) -> np.ndarray:
    """RGBA of a square one-bit picture: set bits are black, the mask is the alpha."""
    black = indexes(bits, side // 8, side, side, 1)
    alpha = 255 if mask is None else 255 * indexes(mask, side // 8, side, side, 1)
    return with_alpha(np.repeat(255 * (1 - black)[..., None], 3, axis=-1), alpha)


SPOT = "struct<width:int,height:int,depth:int,row_bytes:int,pixels:binary,table:binary,mask:binary,mask_row_bytes:int,alpha:boolean>"
PICTURES = "variant int, label string, width int, height int, rgba binary, hotspot_y int, hotspot_x int, error string"


def _tiled(picture: np.ndarray) -> np.ndarray:
    height, width, channels = picture.shape
    return np.broadcast_to(picture[None, :, None], (TILES, height, TILES, width, channels)).reshape(TILES * height, TILES * width, channels)


def _pattern_pictures(spot: dict | None, bits: bytes) -> list[tuple[str, np.ndarray]]:
    plain = one_bit(bits, PATTERN_SIDE)
    tiled = _tiled(plain)
    color, colors_tiled = plain, tiled
    if spot:
        color = gathered(**spot)
        colors_tiled = _tiled(color)
    return list(zip(PATTERN_KINDS, (color, colors_tiled, plain, tiled), strict=True))


#: Types of color tables, of bitmap fonts, and pixels of the largest strike that is drawn.
TABLES = ("clut", "CTBL", "actb", "cctb", "dctb", "fctb", "wctb")
FONTS = ("FONT", "NFNT")
MOST_STRIKE_PIXELS = 1 << 20
SWATCH = "swatch"
#: Sides of a swatch's tiles, and tiles a row.
TILE, TILES_A_ROW, MOST_COLORS = 16, 16, 256


def _strike(data: Column) -> Column:
    """The strike of a one-bit font; null for deeper, empty, cut and very large ones."""
    row_bytes, height = u16(data, 24) * 2, u16(data, 14)
    fits = (F.octet_length(data) >= 26) & (u16(data, 0).bitwiseAND(12) == 0) & (row_bytes > 0) & (height > 0) & (row_bytes * 8 * height <= MOST_STRIKE_PIXELS) & (F.octet_length(data) >= 26 + row_bytes * height)
    none = F.lit(None)
    spot = F.struct(
        _int(row_bytes * 8).alias("width"), _int(height).alias("height"), F.lit(1).alias("depth"), _int(row_bytes).alias("row_bytes"), field(data, 26, _int(row_bytes * height)).alias("pixels"),
        none.cast("binary").alias("table"), none.cast("binary").alias("mask"), none.cast("int").alias("mask_row_bytes"), F.lit(False).alias("alpha"),
    )
    return F.when(fits, spot)


def _swatch_picture(table: bytes) -> np.ndarray:
    """The colors of a table as tiles, sixteen a row, on white."""
    colors = (np.frombuffer(table, ">u2").reshape(-1, 4)[:MOST_COLORS, 1:] >> 8).astype(np.uint8)
    rows = max(1, -(-len(colors) // TILES_A_ROW))
    tiles = np.full((rows * TILES_A_ROW, 3), 255, np.uint8)
    tiles[: len(colors)] = colors
    return with_alpha(tiles.reshape(rows, TILES_A_ROW, 3).repeat(TILE, axis=0).repeat(TILE, axis=1))


def _strike_picture(spot: dict) -> np.ndarray:
    black = indexes(spot["pixels"], spot["row_bytes"], spot["width"], spot["height"], 1)
    return with_alpha(np.repeat(255 * (1 - black)[..., None], 3, axis=-1))


def _cursor_pictures(spot: dict, bits: bytes) -> list[tuple[str, np.ndarray]]:
    return [("", gathered(**spot)), ("bitmap", one_bit(bits[:32], CURSOR_SIDE, bits[32:]))]


def _indexed_pictures(kind: str, pixels: bytes) -> list[tuple[str, np.ndarray]]:
    width, height, depth = INDEXED_ICONS[kind]
    if len(pixels) < width * height * depth // 8:
        raise ValueError("unexpected end")
    palette = system_palette() if depth == 8 else SYSTEM_16
    return [("", with_alpha(palette[indexes(pixels[: width * height * depth // 8], width * depth // 8, width, height, depth)]))]


#: The 16 colors of the system (fixed values).
SYSTEM_COLORS = (
    "FFFFFF", "FCF305", "FF6402", "DD0806", "F20884", "4600A5", "0000D4", "02ABEA",
    "1FB714", "006411", "562C05", "90713A", "C0C0C0", "808080", "404040", "000000",
)
SYSTEM_16 = np.array([list(bytes.fromhex(c)) for c in SYSTEM_COLORS], np.uint8)


def color_pictures(resources: DataFrame) -> DataFrame:
    """(file, type, id, variant, label, width, height, rgba, hotspot_y, hotspot_x, error): the color pictures in resources.

    A pixel pattern gives four: its colors, these tiled 8 x 8, its one-bit pattern, and this tiled; a list gives four for each pattern, numbered on, and
    an icon one whose mask is the alpha. A cursor gives its colors and its one-bit picture, with the hot spot; a one-bit font its strike, a color table a swatch. A picture that cannot be decoded is one row with the error and no pixels; a
    resource without a payload, or of another type, gives no row.
    """
    data, kind = F.col("data"), F.col("type")
    none, zero = F.lit(None), F.lit(0)

    def work(what: str, order: Column, spot: Column, bits: Column, fits: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), order.alias("first"), F.when(fits, spot).alias("spot"), bits.alias("bits"), F.coalesce(fits, F.lit(False)).alias("fits"))

    nothing = none.cast("binary")
    one_pattern = lambda d: F.array(work("pattern", zero, _pattern_spot(d), field(d, 20, 8), pattern_is_whole(d)))
    bad_list = lambda d: F.array(work("pattern", zero, _pattern_spot(d), nothing, F.lit(False)))
    in_list = lambda s, i: work("pattern", (4 * i).cast("int"), _pattern_spot(s["data"]), field(s["data"], 20, 8), pattern_is_whole(s["data"]))
    many = lambda d: bind(pattern_slices(d), lambda all_: F.coalesce(F.transform(all_, in_list), bad_list(d)))
    icon = lambda d: F.array(work("icon", zero, _icon_spot(d), nothing, F.octet_length(d) >= _ICON_HEAD))
    cursor_fits = lambda d: (F.octet_length(d) >= _CURSOR_HEAD) & (F.octet_length(d) >= _int(u32(d, 2)) + PIXMAP_BYTES)
    cursor = lambda d: F.array(work("cursor", zero, _cursor_spot(d), field(d, 20, 64), cursor_fits(d)))
    indexed = lambda d: F.array(work("indexed", zero, none.cast(SPOT), d, F.lit(True)))
    strike = lambda d: bind(_strike(d), lambda s: F.filter(F.array(work("strike", zero, s, nothing, s.isNotNull())), lambda w: w["fits"]))
    swatch = lambda d: bind(color_table_bytes(d, zero), lambda t: F.array(work("swatch", zero, none.cast(SPOT), t, t.isNotNull())))
    # each type's expression runs on its own rows alone
    found = None
    for types, jobs in (
        (("ppat",), one_pattern), (("ppt#",), many), (("cicn",), icon), (("crsr",), cursor), (tuple(INDEXED_ICONS), indexed), (FONTS, strike), (TABLES, swatch),
    ):
        hot = kind == "crsr"
        part = resources.where(kind.isin(*types) & data.isNotNull()).select(
            "file", "type", "id", F.when(hot, _int(u16(data, 84))).alias("hotspot_y"), F.when(hot, _int(u16(data, 86))).alias("hotspot_x"), F.explode(bind(data, jobs)).alias("job")
        )
        found = part if found is None else found.unionByName(part)
    kinds = dict(found.dtypes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for r in chain.from_iterable(batch.slice(at, READ_ROWS).to_pylist() for at in range(0, batch.num_rows, READ_ROWS)):
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
                job, base = r["job"], {n: r[n] for n in ("file", "type", "id", "hotspot_y", "hotspot_x")}
                try:
                    if not job["fits"]:
                        raise ValueError("unexpected end")
                    if job["what"] == "pattern":
                        made = _pattern_pictures(job["spot"], job["bits"])
                    elif job["what"] == "icon":
                        made = [("", gathered(**job["spot"]))]
                    elif job["what"] == "cursor":
                        made = _cursor_pictures(job["spot"], job["bits"])
                    elif job["what"] == "strike":
                        made = [("", _strike_picture(job["spot"]))]
                    elif job["what"] == SWATCH:
                        made = [(SWATCH, _swatch_picture(job["bits"]))]
                    else:
                        made = _indexed_pictures(r["type"], job["bits"])
                except ValueError as e:
                    out.append({**base, "variant": job["first"], "error": str(e)})
                    held += ROW_BYTES
                    continue
                for i, (label, image) in enumerate(made):
                    out.append({**base, "variant": job["first"] + i, "label": label, "width": image.shape[1], "height": image.shape[0], "rgba": image.tobytes()})
                    held += image.nbytes + ROW_BYTES
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    arrow = {"file": batch_type(kinds["file"]), "type": pa.string(), "id": batch_type(kinds["id"])}
    schema = pa.schema([
        *arrow.items(), ("variant", pa.int32()), ("label", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()),
        ("hotspot_y", pa.int32()), ("hotspot_x", pa.int32()), ("error", pa.string()),
    ])
    return found.mapInArrow(decode, f"file {kinds['file']}, type string, id {kinds['id']}, {PICTURES}")


def batch_type(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[kind]
