"""One-bit card pictures (BMAP blocks): headers as columns, rows unpacked per picture.

A row of a packed picture may copy or shift the rows above it, so a picture is one
sequential step; pictures are independent rows of an Arrow task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import u32
from .records import rect

#: Data of the two passes follows a header of this many bytes.
HEADER = 52
#: Opcode 88 to 8F: the shifts that later packed rows use (fixed values).
SHIFTS = ((16, 0), (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 2), (8, 0))


def headers(blocks: DataFrame) -> DataFrame:
    """BMAP rows with their rectangles, the lengths of mask and picture data, and whether they are usable."""
    p = F.col("payload")
    rows = blocks.where("type = 'BMAP'").withColumns({
        "total": rect(p, 12), "mask_rect": rect(p, 20), "picture_rect": rect(p, 28), "mask_bytes": u32(p, 44), "picture_bytes": u32(p, 48),
    })
    size = F.octet_length("payload")

    def sane(r: str) -> Column:
        return (F.col(f"{r}.bottom") >= F.col(f"{r}.top")) & (F.col(f"{r}.right") >= F.col(f"{r}.left"))

    valid = (size >= HEADER) & sane("total") & sane("mask_rect") & sane("picture_rect") & (HEADER + F.col("mask_bytes") + F.col("picture_bytes") <= size)
    return rows.withColumn("valid", valid & (F.col("total.bottom") > F.col("total.top")) & (F.col("total.right") > F.col("total.left")))


def unpack(data: bytes, width: int, height: int) -> list[bytes]:
    """Rows of ``width`` bytes from opcodes; missing data leaves white rows."""
    rows: list[bytes] = []
    patterns = [0xAA if y % 2 == 0 else 0x55 for y in range(8)]
    dx = dy = at = 0
    repeat = 1
    line = bytearray()

    def take(n: int) -> bytes:
        nonlocal at
        part = data[at : at + n]
        at += n
        return part + bytes(n - len(part))

    def shifted(packed: bytes) -> bytes:
        value, bits = int.from_bytes(packed, "big"), 8 * width
        if dx:
            step = value
            for _ in range(bits // dx):
                step >>= dx
                value ^= step
        if dy and len(rows) >= dy:
            value ^= int.from_bytes(rows[len(rows) - dy], "big")
        return value.to_bytes(width, "big")

    while at < len(data) and len(rows) < height:
        code = take(1)[0]
        if 0xA0 <= code <= 0xBF:
            repeat = code & 0x1F
            continue
        times, repeat = repeat, 1
        if code < 0x80:
            piece = bytes(code & 0x0F) + take(code >> 4)
        elif 0xC0 <= code <= 0xDF:
            piece = take(8 * (code & 0x1F))
        elif code >= 0xE0:
            piece = bytes(16 * (code & 0x1F))
        else:
            piece = None
        if piece is not None:
            line += piece * times
            while len(line) >= width and len(rows) < height:
                rows.append(shifted(bytes(line[:width])))
                del line[:width]
            continue
        if 0x88 <= code <= 0x8F:
            dx, dy = SHIFTS[code - 0x88]
            continue
        line.clear()  # a whole row takes the place of a row that is partly filled
        given = take(width) if code == 0x80 else take(1) if code == 0x83 else b""
        for _ in range(times):
            y = len(rows)
            if y >= height:
                break
            if code == 0x80:
                rows.append(given)
            elif code == 0x83:
                patterns[y % 8] = given[0]
                rows.append(given * width)
            elif code == 0x84:
                rows.append(bytes([patterns[y % 8]]) * width)
            elif code in (0x85, 0x86, 0x87):
                back = code - 0x84
                rows.append(rows[y - back] if y >= back else bytes(width))
            else:
                rows.append((b"\xff" if code == 0x82 else b"\0") * width)
    return rows + [bytes(width)] * (height - len(rows))


def place(total: dict, box: dict, data: bytes, solid: bool) -> bytes:
    """The packed picture of ``box`` set into a white picture of the size of ``total``; solid fills the box."""
    width, height = total["right"] - total["left"], total["bottom"] - total["top"]
    stride = (width + 7) // 8
    left, right = box["left"] // 32 * 32, -(-box["right"] // 32) * 32
    bits = right - left
    rows = [b"\xff" * (bits // 8)] * (box["bottom"] - box["top"]) if solid else unpack(data, bits // 8, box["bottom"] - box["top"]) if bits > 0 else []
    out = [0] * height
    window = (1 << (box["right"] - box["left"])) - 1 if solid else None
    for k, row in enumerate(rows):
        y = box["top"] - total["top"] + k
        if 0 <= y < height:
            value = int.from_bytes(row, "big")
            if window is not None:
                value = window << (right - box["right"])
            # bits left of the picture are cut, and so are those right of it
            shift = width - (right - total["left"])
            value = value << shift if shift >= 0 else value >> -shift
            out[y] = value & ((1 << width) - 1)
    return b"".join((v << (8 * stride - width)).to_bytes(stride, "big") for v in out)


ARROW = pa.schema([("file", pa.string()), ("id", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.binary()), ("mask", pa.binary())])


def decode(blocks: DataFrame) -> DataFrame:
    """(file, id, width, height, bits, mask) of usable BMAP blocks. Without a mask the picture masks itself; an empty mask with a rectangle is solid."""
    rows = headers(blocks).where("valid").select("file", "id", "payload", "total", "mask_rect", "picture_rect", "mask_bytes", "picture_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data, cut = r["payload"][HEADER:], r["mask_bytes"]
                total, mask = r["total"], r["mask_rect"]
                bits = place(total, r["picture_rect"], data[cut : cut + r["picture_bytes"]], False)
                has_mask = mask["right"] > mask["left"] and mask["bottom"] > mask["top"]
                masked = place(total, mask, data[:cut], cut == 0) if has_mask else bits
                out.append({"file": r["file"], "id": r["id"], "width": total["right"] - total["left"], "height": total["bottom"] - total["top"], "bits": bits, "mask": masked})
            if out:
                yield pa.RecordBatch.from_pylist(out, ARROW)

    return rows.mapInArrow(run, "file string, id int, width long, height long, bits binary, mask binary")


def portable(pictures: DataFrame) -> DataFrame:
    """(file, id, content): P4 text of the bitmap, then of the mask."""
    head = F.encode(F.concat(F.lit("P4\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n")), "utf-8")
    return pictures.select("file", "id", F.concat(head, F.col("bits"), F.lit(b"\n"), head, F.col("mask")).alias("content"))
