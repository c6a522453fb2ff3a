"""Resource forks, conversions and the streaming folder on made fixtures."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from relicframe.plans import resources
from relicframe.sources import resfork
from relicframe.streaming import folder
from tests.test_archives import TAIL, block


def fork(items):
    """A resource fork of (type, id, name, data)."""
    data, names, refs, types = b"", b"", b"", {}
    for kind, number, name, body in items:
        at = -1 if not name else len(names)
        names += bytes([len(name)]) + name if name else b""
        types.setdefault(kind, []).append(struct.pack(">hhII", number, at, 0x20 << 24 | len(data), 0))
        data += struct.pack(">I", len(body)) + body
    table, offset = struct.pack(">H", len(types) - 1), 2 + 8 * len(types)
    for kind, entries in types.items():
        table += kind + struct.pack(">HH", len(entries) - 1, offset + len(refs))
        refs += b"".join(entries)
    body = bytes(24) + struct.pack(">HH", 28, 28 + len(table) + len(refs)) + table + refs + names
    return struct.pack(">4I", 16, 16 + len(data), len(data), len(body)) + data + body


def sound(samples=b"\x80\x81\x82\x83"):
    return struct.pack(">hhh", 2, 0, 2) + struct.pack(">HHI", 0, 0, 0) + struct.pack(">HHI", 0x8051, 0, 22) + struct.pack(">IIIIIBB", 0, len(samples), 22050 << 16, 0, 0, 0, 60) + samples


@pytest.fixture(scope="module")
def found(spark):
    colors = struct.pack(">IHH", 7, 0, 1) + struct.pack(">8H", 0, 1, 2, 3, 1, 4, 5, 6)
    items = [
        (b"STR ", 128, b"hi", b"\x05H\x8ello"), (b"STR ", 129, b"", b"\x05He"), (b"STR#", 1, b"", b"\0\2\3One\3Two"), (b"STR#", 2, b"", b"\0\2\3One"),
        (b"clut", 1, b"", colors), (b"vers", 1, b"", bytes.fromhex("012080000023") + b"\x031.2\0"), (b"snd ", 1, b"", sound()), (b"snd ", 2, b"", bytes(40)),
        (b"ICON", 1, b"", b"\xff" * 64 + bytes(64)), (b"ICN#", 1, b"", b"\xf0" * 128 + b"\xff" * 128), (b"SICN", 1, b"", bytes(64)), (b"MBAR", 1, b"", struct.pack(">Hhh", 2, 5, -1)),
        (b"RECT", 1, b"", struct.pack(">4h", 1, 2, 3, 4)), (b"TEXT", 1, b"", b"a\x8eb"), (b"XCMD", 9, b"Go", b"\x4e\x75"), (b"SIZE", 0, b"", struct.pack(">HII", 0x0080, 100, 50)),
    ]
    return resfork.read_forks(spark.createDataFrame([("f", bytearray(fork(items)))], "file string, content binary")).cache()


def test_fork_rows(spark, found):
    rows = {(r.type, r.id): r for r in found.collect()}
    assert len(rows) == 16 and rows[("STR ", 128)]["name"] == "hi" and rows[("XCMD", 9)]["name"] == "Go"
    assert rows[("STR ", 128)].attribute_names == ["purgeable"] and bytes(rows[("XCMD", 9)].data) == b"\x4e\x75"
    bad = spark.createDataFrame([("a", bytearray(b"")), ("b", bytearray(b"xx")), ("c", bytearray(struct.pack(">4I", 16, 99, 9, 99)))], "file string, content binary")
    assert {r.file: r.status for r in resfork.fork_headers(bad).collect()} == {"a": "missing_or_empty", "b": "too_short", "c": "invalid_header_bounds"}
    assert resfork.read_forks(bad).count() == 0
    assert {r.type: r.n for r in resfork.resource_counts(found).collect()}["STR "] == 2


def test_conversions(found):
    rows = {(r.type, r.id): r for r in resources.convert(found).where("format != 'native'").collect()}
    assert rows[("STR ", 128)].text == "Héllo" and rows[("STR ", 129)].error == "unexpected end" and rows[("TEXT", 1)].text == "aéb"
    assert json.loads(rows[("STR#", 1)].text) == {"strings": ["One", "Two"]} and rows[("STR#", 2)].error == "unexpected end"
    assert json.loads(rows[("clut", 1)].text)["entries"][1] == {"value": 1, "red": 4, "green": 5, "blue": 6}
    version = json.loads(rows[("vers", 1)].text)
    assert (version["majorVersion"], version["regionCode"], version["versionNumber"]) == (1, 35, "1.2")
    assert json.loads(rows[("MBAR", 1)].text) == {"menuIds": [5, -1]} and json.loads(rows[("RECT", 1)].text)["right"] == 4
    assert json.loads(rows[("SIZE", 0)].text)["decodedFlags"]["is32BitCompatible"]
    assert json.loads(rows[("snd ", 2)].text)["error"] == "bad snd format"
    assert resources.convert(found).where("format = 'native'").count() == 16


def test_sound_and_pictures(found):
    wavs = {r.id: r.wav for r in resources.sounds(found).collect()}
    assert len(wavs[1]) == 48 and bytes(wavs[1][44:]) == b"\x80\x81\x82\x83" and struct.unpack("<I", wavs[1][24:28]) == (22050,) and wavs[2] is None
    pictures = resources.write_pngs(resources.pictures(found)).collect()
    assert sorted((r.type, r.variant) for r in pictures) == [("ICN#", 0), ("ICON", 0), ("SICN", 0), ("SICN", 1)]
    icon = next(r for r in pictures if r.type == "ICON")
    data = bytes(icon.png)
    body = data[data.index(b"IDAT") + 4 :]
    pixels = zlib.decompress(body[: struct.unpack(">I", data[data.index(b"IDAT") - 4 : data.index(b"IDAT")])[0]])
    assert pixels[1:3] == b"\x00\xff" and pixels[-2:] == b"\xff\xff" and len(pixels) == 32 * 65


def test_bitmaps(spark):
    rows = spark.createDataFrame([("a", bytearray(b"P4\n# c\n9 2\n\xff\x80\x00\x00")), ("b", bytearray(b"P4 9 2\n\xff")), ("c", bytearray(b"P1 1 1 0"))], "path string, content binary")
    got = {r.path: r for r in resources.pbm_to_png(rows).collect()}
    assert bytes(got["a"].png[:4]) == b"\x89PNG" and got["b"].error == "bitmap ends early" and got["c"].error == "no P4 bitmap"


def test_streaming_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(block(b"STAK", -1, b"abc") + TAIL)
    for _ in range(2):
        folder.into_tables(folder.block_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", lambda b: b.drop("payload")).awaitTermination()
        (tmp_path / "in" / "b").write_bytes(block(b"CARD", 5, b"abc") + TAIL)
    assert sorted((r.type, r.n) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("type").agg(F.count("*").alias("n")).collect()) == [("CARD", 1), ("STAK", 1), ("TAIL", 2)]


def bmap(total, mask, picture, mask_data, picture_data):
    head = bytes(12) + struct.pack(">4h", *total) + struct.pack(">4h", *mask) + struct.pack(">4h", *picture) + bytes(8) + struct.pack(">II", len(mask_data), len(picture_data))
    return head + mask_data + picture_data


def test_card_pictures(spark):
    from relicframe.plans import bitmaps
    from tests.test_archives import scan

    box = (0, 0, 8, 32)
    data = bytes([0x80, 1, 2, 3, 4, 0x82, 0x85, 0x81, 0x83, 0xF0, 0xA2, 0x84, 0x20, 5, 6, 0x02])
    rows = scan(spark, block(b"BMAP", 1, bmap(box, (0, 0, 0, 0), box, b"", data)) + block(b"BMAP", 2, bmap(box, (2, 8, 4, 16), box, b"", b"")) + block(b"BMAP", 3, b"short") + TAIL)
    got = {r.id: r for r in bitmaps.decode(rows).collect()}
    assert set(got) == {1, 2}
    lines = [bytes(got[1].bits[i : i + 4]).hex() for i in range(0, 32, 4)]
    assert lines == ["01020304", "ffffffff", "ffffffff", "00000000", "f0f0f0f0", "55555555", "aaaaaaaa", "05060000"]
    assert got[1].mask == got[1].bits
    assert bytes(got[2].mask).hex() == "00" * 8 + "00ff0000" * 2 + "00" * 16
    assert bytes(bitmaps.portable(bitmaps.decode(rows)).where("id = 1").first().content).count(b"P4\n32 8\n") == 2


def test_card_picture_shifts():
    from relicframe.plans.bitmaps import unpack

    # 8C: every bit right of a set one flips on; 8A: a row is XORed with the one above
    assert [r.hex() for r in unpack(bytes([0x8C, 0x40, 0x80, 0, 0, 0, 0x8A, 0x40, 1, 0, 0, 0]), 4, 2)] == ["ffffffff", "feffffff"]


def test_color_overlays_and_compact_pixmaps(spark):
    whole = struct.pack(">B4hh3H", 3, 10, 20, 30, 40, 2, 0x1111, 0x2222, 0x3333)
    rows = [("HCbg", 77, whole), ("HCcd", 1, b""), ("HCcd", 2, whole[:-1]), ("HCcd", 3, whole + b"\x06"), ("HCcd", 4, struct.pack(">B4hBB", 0x84, 1, 2, 3, 4, 0, 3) + b"a\x8eb")]
    made = spark.createDataFrame([("f", t, i, "", bytearray(d)) for t, i, d in rows], "file string, type string, id long, name string, data binary")
    got = {r.id: r for r in resources.convert(made).where("format = 'json'").collect()}
    assert json.loads(got[77].text) == {
        "targetKind": "background", "targetId": 77,
        "objects": [{"type": "rect", "hidden": False, "bevel": 2, "rect": {"top": 10, "left": 20, "bottom": 30, "right": 40}, "color": {"red": 4369, "green": 8738, "blue": 13107}}],
    }
    assert json.loads(got[1].text) == {"targetKind": "card", "targetId": 1, "objects": []}
    assert got[2].error == got[3].error == "unexpected end"
    assert json.loads(got[4].text)["objects"][0] == {"type": "pictResource", "hidden": True, "rect": {"top": 1, "left": 2, "bottom": 3, "right": 4}, "transparent": False, "name": "aéb"}

    def pixs(row_bytes, height, width, body):
        return struct.pack(">H4h", row_bytes, 0, 0, height, width) + body

    rows = [pixs(1, 1, 9, bytes(2)), pixs(2, 1, 9, b"\x80\x80"), pixs(1, 1, 4, b"\x1b"), pixs(1, 1, 4, b"\0\4\x12"), pixs(0, 1, 1, b""), pixs(600, 1, 513, bytes(600)), b"short"]
    made = spark.createDataFrame([("f", "pixs", i, bytearray(d)) for i, d in enumerate(rows)], "file string, type string, id long, data binary")
    got = {r.id: r for r in resources.compact_pixmaps(made).collect()}
    assert set(got) == {1, 2, 3} and (got[1].depth, got[2].depth, got[3].depth) == (1, 2, 4)
    assert [p[0] for p in zip(*[iter(bytes(got[1].rgba))] * 4)] == [0, *[255] * 7, 0]
    assert [p[0] for p in zip(*[iter(bytes(got[2].rgba))] * 4)] == [255, 170, 85, 0]
    assert got[3].rgba is None
