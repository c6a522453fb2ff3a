"""Files of resources, color pictures, image documents, parsers of odd lines, dense ids, streams and short needles."""

import hashlib
import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from relicframe import __main__ as cli
from relicframe.functions.text import bind
from relicframe.operators import relational
from relicframe.plans import artifacts, color_pictures, reports, resources, rom_index, warehouse
from relicframe.sources import blocks

RESOURCE = "file string, type string, id int, name string, order int, data binary"


def pixel_map(width, height, row_bytes, depth, table_at=0):
    return struct.pack(">IHhhhhHHIIIHHHHIII", 0, 0x8000 | row_bytes, 0, 0, height, width, 0, 0, 0, 72 << 16, 72 << 16, 0, depth, 1, depth, 0, table_at, 0)


def color_table(*entries):
    return struct.pack(">IHH", 0, 0x8000, len(entries) - 1) + b"".join(struct.pack(">HHHH", v, *(c * 257 for c in rgb)) for v, rgb in entries)


def icon(width, height, depth, pixels, table, mask):
    row = len(pixels) // height
    head = pixel_map(width, height, row, depth) + (struct.pack(">IHhhhh", 0, len(mask) // height, 0, 0, height, width)) + struct.pack(">IHhhhh", 0, 0, 0, 0, height, width) + bytes(4)
    return head + mask + table + pixels


# --- pictures --------------------------------------------------------------------------------


def test_system_palette_is_the_usual_one():
    palette = color_pictures.system_palette()
    assert palette.shape == (256, 3) and palette[0].tolist() == [255] * 3 and palette[255].tolist() == [0] * 3
    assert palette[1].tolist() == [255, 255, 204] and palette[35].tolist() == [255, 0, 0] and palette[214].tolist() == [0, 0, 51]
    assert palette[215].tolist() == [238, 0, 0] and palette[224].tolist() == [17, 0, 0] and palette[225].tolist() == [0, 238, 0] and palette[254].tolist() == [17] * 3
    assert len({tuple(c) for c in palette.tolist()}) == 256


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_icons_of_all_depths_against_a_pixel_loop(spark, depth):
    rng = random.Random(depth)
    width, height, rows = 11, 5, []
    for i in range(20):
        row = (width * depth + 7) // 8 + rng.randrange(3)
        values = [v for v in range(1 << depth) if v != (1 << depth) - 1 or i % 2]
        table = [(v, tuple(rng.randrange(256) for _ in range(3))) for v in values]
        index = [[rng.randrange(1 << depth) for _ in range(width)] for _ in range(height)]
        packed = b"".join(int("".join(f"{x:0{depth}b}" for x in line).ljust(row * 8, "0"), 2).to_bytes(row, "big") for line in index)
        mask = rng.randbytes(2 * height)
        want = b"".join(bytes((*dict(table).get(x, (0, 0, 0)), 255 * (mask[2 * y + k // 8] >> (7 - k % 8) & 1))) for y, line in enumerate(index) for k, x in enumerate(line))
        rng.shuffle(table)
        rows.append((f"f{i}", "cicn", i, "", 0, icon(width, height, depth, packed, color_table(*table), mask), want))
    table = spark.createDataFrame(rows, RESOURCE + ", want binary")
    found = color_pictures.color_pictures(table.drop("want")).join(table.select("id", "want"), "id").collect()
    assert len(found) == 20 and all(r.error is None and bytes(r.rgba) == bytes(r.want) and (r.width, r.height) == (width, height) for r in found)


def test_damaged_pictures_say_what_is_wrong(spark):
    good = icon(2, 1, 8, b"\1\2", color_table((1, (1, 2, 3)), (2, (4, 5, 6))), b"\xc0")
    cases = {
        "short": b"\0" * 10, "cut pixels": good[:-1], "cut table": good[:90], "empty": b"", "no such color": good[:-1] + b"\7", "bad depth": good[:32] + struct.pack(">H", 16) + good[34:], "no area": good[:6] + bytes(8) + good[14:],
    }
    rows = [(name, "cicn", 1, "", 0, data) for name, data in cases.items()] + [("null", "cicn", 1, "", 0, None), ("other", "ICON", 1, "", 0, b"x"), ("list", "ppt#", 1, "", 0, struct.pack(">HI", 1, 99)), ("cursor", "crsr", 1, "", 0, bytes(40)), ("small", "icl8", 1, "", 0, bytes(9)), ("good", "cicn", 1, "", 0, good)]
    found = {r.file: r for r in color_pictures.color_pictures(spark.createDataFrame(rows, RESOURCE)).collect()}
    assert set(found) == {*cases, "list", "cursor", "small", "good"}
    assert found["good"].error is None and bytes(found["good"].rgba) == b"\1\2\3\xff\4\5\6\xff"
    assert found["no such color"].error == "color index not found" and found["bad depth"].error == "unsupported depth" and found["no area"].error == "empty bounds"
    assert all(found[n].error == "unexpected end" and found[n].rgba is None for n in ("short", "cut pixels", "cut table", "empty", "list", "cursor", "small"))


def test_patterns_are_tiled(spark):
    table = color_table((0, (9, 8, 7)), (1, (6, 5, 4)))
    new = struct.pack(">HIIIHI", 1, 28, 78 + len(table), 0, 0, 0) + bytes([0b10000000] * 8) + pixel_map(2, 2, 1, 1, 78) + table + bytes([0b01000000, 0b10000000])
    found = {r.label: r for r in color_pictures.color_pictures(spark.createDataFrame([("f", "ppat", 3, "", 0, new)], RESOURCE)).collect()}
    one = np.array([[[9, 8, 7, 255], [6, 5, 4, 255]], [[6, 5, 4, 255], [9, 8, 7, 255]]], np.uint8)
    assert bytes(found["color"].rgba) == one.tobytes() and bytes(found["color_tiled"].rgba) == np.tile(one, (8, 8, 1)).tobytes()
    bits = np.full((8, 8, 4), 255, np.uint8)
    bits[:, 0, :3] = 0
    assert bytes(found["bitmap"].rgba) == bits.tobytes() and bytes(found["bitmap_tiled"].rgba) == np.tile(bits, (8, 8, 1)).tobytes() and found["bitmap_tiled"].width == 64
    text = resources.converted(spark.createDataFrame([("f", "ppat", 3, "", 0, new)], RESOURCE), ("ppat",)).first().text
    assert json.loads(text)["pixelMap"]["bounds"] == {"top": 0, "left": 0, "bottom": 2, "right": 2} and json.loads(text)["monochromePatternHex"] == "80" * 8


def test_cut_bundles_and_key_maps_are_errors(spark):
    bundle = b"abcd" + struct.pack(">HH", 1, 0) + b"ICN#" + struct.pack(">HHH", 0, 5, 128)
    keys = bytes(258) + struct.pack(">H", 1) + bytes(128) + struct.pack(">H", 1) + bytes([0, 12]) + struct.pack(">H", 1) + b"`a\0`"
    rows = [("whole", "BNDL", 1, "", 0, bundle), ("cut", "BNDL", 1, "", 0, bundle[:-1]), ("whole", "KCHR", 1, "", 0, keys), ("cut", "KCHR", 1, "", 0, keys[:-1]), ("none", "KCHR", 1, "", 0, b"")]
    found = {(r.file, r.type): r for r in resources.converted(spark.createDataFrame(rows, RESOURCE), ("BNDL", "KCHR")).collect()}
    assert json.loads(found["whole", "BNDL"].text)["types"][0]["ids"] == [{"localId": 5, "resourceId": 128}]
    assert json.loads(found["whole", "KCHR"].text)["deadKeys"][0]["completions"] == [{"completionChar": 96, "substituteChar": 97}]
    assert all(found[k].text is None and found[k].error == "unexpected end" for k in (("cut", "BNDL"), ("cut", "KCHR"), ("none", "KCHR")))


# --- files -----------------------------------------------------------------------------------


def listed(folder):
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names}


def test_a_repeated_attempt_leaves_one_file(spark, tmp_path):
    rows = [(f"disk/f{i % 3}", f"a/{i}.txt", f"text {i}".encode()) for i in range(30)] + [("disk/f0", "null.bin", None)]
    table = spark.createDataFrame(rows, "file string, path string, content binary").repartition(4)
    folder = f"file://{tmp_path}/out"
    for _ in range(2):
        told, counts = artifacts.save(table, folder)
    assert counts == {"files": 31, "bytes": sum(len(c or b"") for _, _, c in rows)}
    found = told.collect()
    assert listed(tmp_path / "out") == {r.target for r in found} and len(found) == 31
    for r in found:
        with open(tmp_path / "out" / r.target, "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r.sha256
    # the same last part in two folders are two packages
    assert artifacts.save(spark.createDataFrame([("x/same", "p", b"1"), ("y/same", "p", b"2")], "file string, path string, content binary"), folder)[0].select("target").distinct().count() == 2
    assert artifacts.save(table.limit(0), folder)[1]["files"] == 0


def test_many_small_artifacts_are_few_archives(spark, tmp_path):
    rows = [(f"disk/f{i}", f"a/{i}.txt", f"text {i}".encode()) for i in range(300)] + [("disk/f0", "null.bin", None), ("disk/f1", "long.bin", bytes(artifacts.ARCHIVE_BYTES + 1))]
    table = spark.createDataFrame(rows, "file string, path string, content binary").repartition(3)
    folder = f"file://{tmp_path}/out"
    artifacts.save_archives(table.where("path = 'null.bin'"), folder, "art")
    artifacts.save_archives(table.where("path = 'null.bin'"), folder, "art-b")
    for n in (6, 3):
        told, counts = artifacts.save_archives(table.repartition(n), folder, "art")
        assert counts == {"files": 302, "bytes": sum(len(c or b"") for _, _, c in rows)}
        # archives of an earlier call are replaced, those of another name stay
        names = {r.archive for r in told.select("archive").distinct().collect()}
        assert listed(tmp_path / "out") == names | {x for x in listed(tmp_path / "out") if x.startswith("art-b-")} and len(listed(tmp_path / "out")) <= n + 2
    told_of = {(r.archive, r.target): (r.bytes, r.sha256) for r in told.collect()}
    read = {(r.archive, r.target): (len(r.content), hashlib.sha256(r.content).hexdigest()) for r in artifacts.archived(spark, folder).collect() if not r.archive.startswith("art-b-")}
    assert read == told_of and len(read) == 302
    # unpacked they are the files that save() writes
    assert {t for _, t in told_of} == {r.target for r in artifacts.save(table, f"file://{tmp_path}/files")[0].collect()}
    assert artifacts.save_archives(table.limit(0), f"file://{tmp_path}/none", "art")[1]["files"] == 0


def test_names_and_statuses_by_type(spark):
    rows = [
        ("d/My Stack", "ICON", -7, "", 0, bytes(128)), ("d/My Stack", "ICON", -7, "", 1, b"\xff" * 128), ("d/My Stack", "TEXT", 1, "n/é", 2, b"hi"), ("d/My Stack", "SICN", 2, "", 3, bytes(64)), ("d/My Stack", "vers", 3, "", 4, b"\1"),
        ("d/My Stack", "snd ", 4, "", 5, b"\0\0"), ("d/My Stack", "xcmd", 5, "", 6, b"\x4e\x75"), ("d/My Stack", "none", 6, "", 7, b""), ("d/My Stack", "cicn", 8, "", 8, icon(1, 1, 8, b"\1", color_table((1, (1, 2, 3))), b"\x80")),
        ("d/My Stack", "PAT ", 9, "", 9, bytes(8)), ("d/My Stack", "RECT", 10, "", 10, None),
    ]
    table = spark.createDataFrame(rows, RESOURCE)
    made, errors = artifacts.conversions(table)
    found = {r.type: r for r in artifacts.summaries(table, made, errors).collect()}
    paths = {k: [a.path for a in r.artifacts] for k, r in found.items()}
    assert paths == {
        "ICON": ["ICON_-7.png"], "TEXT": ["resource-text/My%20Stack_TEXT_1_n%2F%8E.txt"], "SICN": ["SICN_2_00.png", "SICN_2_01.png"], "vers": [], "snd ": [], "xcmd": ["resource-disassembly/My%20Stack_xcmd_macppc_5.s"],
        "none": [], "cicn": ["cicn_8.json", "cicn_8.png"], "PAT ": ["PAT_9.png"], "RECT": [],
    }
    assert {k: r.status for k, r in found.items()} == {
        "ICON": "exported", "TEXT": "exported", "SICN": "exported", "vers": "parse_failed", "snd ": "convert_failed", "xcmd": "disassembled", "none": "preserved", "cicn": "exported", "PAT ": "exported", "RECT": "parse_failed",
    }
    assert found["cicn"].output_file == "cicn_8.json" and found["xcmd"].output_file == ""
    # of two resources with one type and id the last is there
    icons = [r.content for r in made.where("type = 'ICON'").collect()]
    assert icons == [resources.png(32, 32, [b"\0\xff" * 32] * 32, 8, 4)]


# --- documents -------------------------------------------------------------------------------


def test_documents_without_items_and_in_parts(spark):
    images = spark.createDataFrame([("a", 16, 64), ("b", 0, 8)], "rom_id string, base long, bytes long")
    found = spark.createDataFrame([("a", f"r{i}", i, i + 1, "code", 1, 0.5, "s") for i in range(25)], "rom_id string, id string, start long, end long, kind string, items long, confidence double, source string")
    parts = rom_index.document_parts(rom_index.items({"regions": found}), 10).collect()
    assert sorted((p.part, p.items) for p in parts) == [(0, 10), (1, 10), (2, 5)]
    whole = [x for p in sorted(parts, key=lambda p: p.part) for x in json.loads(p.content)]
    assert [x["id"] for x in whole] == [f"r{i}" for i in range(25)] and whole[16]["start"] == "00000010"
    heads = {r.rom_id: json.loads(r.content) for r in rom_index.document_heads(images, rom_index.document_parts(rom_index.items({"regions": found}), 10)).collect()}
    assert heads["a"]["counts"]["regions"] == 25 and [p["path"] for p in heads["a"]["parts"]] == [f"analysis/regions-{i}.json" for i in range(3)]
    assert heads["b"]["counts"]["regions"] == 0 and heads["b"]["parts"] == [] and heads["b"]["phase_status"]["regions"] == "not_run"


# --- parsers ---------------------------------------------------------------------------------


def test_block_messages_of_all_kinds(spark):
    said = {
        "Status: Processing 'CARD' #12 1F (33 bytes)": ("CARD", 12, 33, "parsed", 1), "x Status: Processing 'STR#' #-5 (0 bytes) more": ("STR#", -5, 0, "parsed", 1), "Status: Skipping 'FREE' #3 (9 bytes)": ("FREE", 3, 9, "skipped", 1),
        "Warning: Skipping block  abcd #77": ("ABCD", 77, None, "unhandled", 0), "Warning: Skipping block PAT  #-7 end": ("PAT", -7, None, "unhandled", 0),
    }
    silent = [
        "Status: Skipping 'FREE' #3 AB (9 bytes)", "Status: Processing 'A' #--3 (9 bytes)", "Status: Processing 'A' #3 xyz (9 bytes)", "Status: Processing '' #3 (9 bytes)", "Status: Processing 'A' #3 (9 kb)", "Status: ", "",
        "Warning: Skipping block a_cd #7", "Warning: Skipping block ab #7", "Warning: Skipping block abcd", None,
    ]
    lines = [("r", 1, i, m) for i, m in enumerate([*said, *silent])]
    found = warehouse.chunks_from_log(spark.createDataFrame(lines, "run_id string, attempt_id int, line int, message string")).collect()
    assert {r.evidence: (r.chunk_type, r.chunk_id, r.chunk_bytes, r.status, r.understood) for r in found} == said


def test_listing_lines_of_all_kinds(spark):
    said = {
        "00000010  4EB9 0000 1234  jsr  $1234.l ; note: possible extension exit": ("00000010", "jsr", "$1234.l", "possible extension exit"), "  0000abcd\t4e75 RTS": ("0000ABCD", "rts", "", ""), "0000ABCD 4e75 addb": ("0000ABCD", "addb", "", ""),
        "0000ABCD 4e75 12345678 .word 5": ("0000ABCD", ".word", "5", ""), "0000abcd 48000001 bl  ->foo  bar": ("0000ABCD", "bl", "->foo  bar", ""),
    }
    silent = ["0000ABC 4e75 rts", "0000ABCD rts", "0000ABCD 4e75 9bad", "0000ABCD", "", None, "label:", "; a note"]
    table = spark.createDataFrame([(m,) for m in [*said, *silent]], "line string")
    found = {r.line: r.said for r in table.select("line", reports.listing_line(F.col("line")).alias("said")).collect()}
    assert {m: tuple(s) for m, s in found.items() if s is not None} == said


def test_bind_works_a_value_out_once(spark):
    assert spark.range(3).select(bind(F.col("id") * 2, lambda x: x + x).alias("y")).collect() == [(0,), (4,), (8,)]


# --- ids, streams, needles ---------------------------------------------------------------------


def test_dense_ids_over_a_unique_first_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i) for i in range(3000)] + [("a", None)]
    rng.shuffle(rows)
    found = warehouse.dense_ids(spark.createDataFrame(rows, "run_id string, k int").repartition(5), ["k"], start=10).collect()
    for run in ("a", "b", None):
        own = sorted((k for r, k in rows if r == run), key=lambda k: (k is not None, k))
        assert sorted((r.id, r.k) for r in found if r.run_id == run) == [(10 + i, k) for i, k in enumerate(own)]


def test_streams_with_repeated_and_null_orders(spark):
    rows = [("f", 1, 5, b"aa"), ("f", 1, 6, b"b"), ("f", None, 7, b"ccc"), ("f", 1, 6, b"b"), ("f", 70_000, 8, b""), ("g", None, 9, b"z")]
    table = spark.createDataFrame(rows, "file string, o int, id int, payload binary").repartition(3)
    for part_bytes in (1 << 20, 20):
        parts = blocks.write_stream(table, "file", F.lit("CARD"), F.col("id"), F.col("payload"), "o", part_bytes)
        found = blocks.scan_blocks(parts.select("file", "content", "start", "first"), strict_tail=True).collect()
        for file, want in (("f", [7, 5, 6, 6, 8]), ("g", [9])):
            own = sorted((r for r in found if r.file == file), key=lambda r: r.offset)
            assert sorted(r.id for r in own if r.type == "CARD") == sorted(want) and own[0].id == want[0] and own[-1].type == "TAIL" and [r.status for r in own[:-1]] == ["ok"] * len(want)
            assert [r.offset for r in own] == [sum(x.size for x in own[:i]) for i in range(len(own))] and [r.seq for r in own] == list(range(len(own)))


def test_many_short_needles(spark):
    lines = [(i, t) for i, t in enumerate(["abc", "ab", "b", "", "xyé", "a b"])]
    needles = [("",), ("a",), ("ab",), ("é",), ("b",), ("b",), ("zz",)]
    table, wanted = spark.createDataFrame(lines, "i int, line string"), spark.createDataFrame(needles, "n string")
    want = sorted((i, n) for i, t in lines for (n,) in needles if n in t)
    assert sorted((r.i, r.n) for r in relational.contains_join(table, wanted, "line", "n").collect()) == want
    many = wanted.unionByName(spark.range(110_000).select(F.concat(F.lit("§"), (F.col("id") % 10).cast("string")).alias("n")))
    assert sorted((r.i, r.n) for r in relational.contains_join(table, many, "line", "n").collect()) == want


# --- command line ------------------------------------------------------------------------------


def one_resource_fork(kind, number, data):
    area = struct.pack(">I", len(data)) + data
    body = bytes(24) + struct.pack(">HH", 28, 28 + 2 + 8 + 12) + struct.pack(">H", 0) + kind + struct.pack(">HH", 0, 10) + struct.pack(">hhII", number, -1, 0, 0)
    return struct.pack(">IIII", 16, 16 + len(area), len(area), len(body)) + area + body


def test_verbs_write_files_and_documents(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rsrc").write_bytes(one_resource_fork(b"TEXT", 7, b"hello"))
    cli.main(["resources", str(tmp_path / "in"), str(tmp_path / "out")])
    found = listed(tmp_path / "out" / "files")
    assert len(found) == 1 and found.pop().endswith("/resource-text/a.rsrc_TEXT_7.txt")
    assert spark.read.parquet(str(tmp_path / "out" / "summaries")).first().status == "exported"

    (tmp_path / "rom").mkdir()
    (tmp_path / "rom" / "r.bin").write_bytes(b"BootROM\0TableMap\0" + bytes(64) + b"DRVR")
    cli.main(["rom", str(tmp_path / "rom"), str(tmp_path / "atlas"), "--base", "0x40800000"])
    documents = {os.path.basename(p) for p in listed(tmp_path / "atlas" / "documents")}
    assert {"analysis.json", "regions-0.json"} <= documents and not any("_staging" in p for p in listed(tmp_path / "atlas" / "documents"))

    (tmp_path / "stack").mkdir()
    (tmp_path / "stack" / "s").write_bytes(b"".join(struct.pack(">I4si", 12, kind, n) for kind, n in ((b"STAK", -1), (b"CARD", 5), (b"TAIL", -1))))
    capsys.readouterr()
    cli.main(["scan", str(tmp_path / "stack")])
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert [(x[2], x[3]) for x in lines] == [("STAK", "-1"), ("CARD", "5"), ("TAIL", "-1")]
