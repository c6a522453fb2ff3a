"""Block streams, records, scripts, firmware and the warehouse on made fixtures."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from relicframe.functions import binary, classify, text
from relicframe.operators import relational
from relicframe.plans import json_tree, records, reports, rom, scripts, warehouse
from relicframe.sources import blocks, files


def block(kind, number, payload=b""):
    return struct.pack(">I4si", 12 + len(payload), kind, number) + payload


TAIL = block(b"TAIL", -1)


def one(spark, column, **values):
    """Evaluate a column over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("x")).first()["x"]


# --- functions ----------------------------------------------------------------------------------


def test_binary_fields(spark):
    data = F.lit(b"\xff\xfe\x00\x01\x80\x00\x00\x00")
    assert one(spark, binary.u16(data, 0)) == 0xFFFE and one(spark, binary.i16(data, 0)) == -2
    assert one(spark, binary.i32(data, 4)) == -(2**31) and one(spark, binary.u32(data, 4)) == 2**31
    assert one(spark, binary.u32(data, 6)) == 0  # outside
    assert one(spark, binary.crc32_hex(F.lit(b"123456789"))) == "CBF43926"
    assert one(spark, binary.address(F.lit(0x40800000))) == "40800000"
    assert bytes(one(spark, binary.pack_u32(F.lit(-1)))) == b"\xff\xff\xff\xff"
    assert one(spark, binary.escaped_bytes(F.lit(b"a\x00\\"))) == "a\\x00\\x5C"
    assert one(spark, binary.set_bits(F.lit(0x21), binary.RESOURCE_ATTRIBUTES)) == ["purgeable", "compressed"]


def test_mac_text(spark):
    every = bytes(range(256))
    assert one(spark, binary.mac_text(F.lit(every))) == every.decode("mac_roman")
    assert bytes(one(spark, binary.mac_bytes(binary.mac_text(F.lit(every))))) == every
    assert one(spark, binary.mac_text(F.lit(b"\x11"), command_key=True)) == "⌘"
    assert one(spark, binary.pascal_string(F.lit(b"\x05H\x8ello"))) == "Héllo"
    assert one(spark, binary.pascal_string(F.lit(b"\x05He"))) is None
    assert one(spark, binary.c_string(F.lit(b"xab\0cd"), 1)) == "ab"


@pytest.mark.parametrize("code, want", [("01208000", "1.2"), ("02412005", "2.4.1d5"), ("10006003", "10.0b3"), ("00000000", "0.0")])
def test_versions(spark, code, want):
    assert one(spark, binary.bcd_version(F.lit(bytes.fromhex(code)))) == want


def test_script_text(spark):
    assert one(spark, text.script_lines(F.lit("a\r\nb\rc\n"))) == ["a", "b", "c", ""]
    assert one(spark, text.quoted_literals(F.lit('put "a ""b""" & "open'))) == ['a "b"', "open"]
    assert one(spark, text.first_word(F.lit("  9 _go2 x"))) == "_go2"
    assert one(spark, text.ascii_lower(F.lit("ÀBc"))) == "Àbc"
    assert one(spark, text.trim_control(F.lit("\x01 a b\t"))) == "a b"
    for sample in ("", "a", "a\n", "a\r\nb", "a\x0bb\x85c ", "\n\n"):
        assert one(spark, text.line_count(F.lit(sample))) == len(sample.splitlines()), sample
    assert one(spark, text.extension(F.lit("x/My.SIT.hqx"))) == "sit.hqx" and one(spark, text.extension(F.lit("x.y/plain"))) == ""
    assert one(spark, text.string_confidence(F.lit(".T(h"), F.lit(False))) is None
    assert one(spark, text.string_confidence(F.lit("RealName"), F.lit(False))) == pytest.approx(0.77)


def test_classifiers(spark):
    def decide(finder, path, kind, size, length):
        row = one(spark, classify.stack_decision(F.lit(finder), F.lit(path), F.lit(kind), F.lit(size), F.lit(length)))
        return row["decision"], row["reason"]

    assert decide("STAK", "a", "", 0, 0) == ("stack", "finder_type_stack_like")
    assert decide("MYag", "x/Myst Files/a", "", 0, 0) == ("stack", "finder_type_stack_like")
    assert decide("MYag", "x/a", "STAK", 50, 100) == ("skip", "myst_resource_sidecar")
    assert decide("", "a", "STAK", 50, 100) == ("stack", "binary_stak_header")
    assert decide("", "a.stk", "STAK", 500, 100) == ("stack", "stack_extension")
    assert decide("", "a", "STAK", 500, 100) == ("skip", "binary_stak_header_size_mismatch")
    assert one(spark, classify.external_kind(F.lit(""), F.lit("mov"), F.lit(""))) == "movie"
    assert one(spark, classify.gap_kind(F.lit("Unknown type abc resource"))) == "resource"
    assert one(spark, classify.chunk_type(F.lit("pagesetup"))) == "PRST" and one(spark, classify.chunk_type(F.lit("odd"))) == "ODD"


# --- relational -----------------------------------------------------------------------------------


def test_asof_ties_and_strictness(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 9, "c")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 5, 50), (1, 1, 10), (1, 1, 11)], "k int, t int, w int")
    rows = {r.v: r.w for r in relational.asof_join(left, right, ["k"], "t", ["w"]).collect()}
    assert rows == {"a": 50, "b": 11, "c": None}
    rows = {r.v: r.w for r in relational.asof_join(left, right, ["k"], "t", ["w"], strict=True).collect()}
    assert rows == {"a": 11, "b": 11, "c": None}


def test_interval_join_is_half_open(spark):
    points = spark.createDataFrame([(x,) for x in range(30)], "p int")
    spans = spark.createDataFrame([(5, 9), (8, 8), (0, 25)], "s int, e int")
    got = {tuple(r) for r in relational.interval_join(points, spans, "p", "s", "e", 7).select("p", "s").collect()}
    assert got == {(p, s) for p in range(30) for s, e in ((5, 9), (8, 8), (0, 25)) if s <= p < e}


def test_contains_join_equals_nested_loop(spark):
    lines = ["the quick brown fox", "quick", "a brown-fox! jumps", "", "xthe quick browny"]
    needles = ["quick brown", "the quick brown", "own", "brown-fox! j", "fox", "k b"]
    left = spark.createDataFrame([(x,) for x in lines], "line string")
    right = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = sorted((r.line, r.needle) for r in relational.contains_join(left, right, "line", "needle").collect())
    assert got == sorted((x, n) for x in lines for n in needles if n in x)


def test_json_tree(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, "xyz"]}, "c": null}'), (2, "no json"), (3, '"s"')], "id int, j string")
    nodes = json_tree.walk(rows, ["id"], "j").orderBy("id", "path").collect()
    assert [(r.id, r.depth, r.tag, r.text_size) for r in nodes] == [
        (1, 0, "$", 0), (1, 1, "a", 0), (1, 2, "b", 0), (1, 3, "[0]", 1), (1, 3, "[1]", 3), (1, 1, "c", 0), (3, 0, "$", 1),
    ]


# --- blocks -----------------------------------------------------------------------------------------


def scan(spark, data, **options):
    return blocks.scan_blocks(spark.createDataFrame([("f", bytearray(data))], "file string, content binary"), **options)


def test_block_fixtures(spark):
    data = block(b"FREE", 0, b"xxxx") + block(b"STAK", -1, bytes(68)) + TAIL
    rows = scan(spark, data).orderBy("seq").collect()
    assert [(r.offset, r.status) for r in rows] == [(0, "skipped"), (16, "ok"), (96, "terminal")]
    assert rows[0].payload is None and len(rows[1].payload) == 68
    missing = blocks.missing_references(scan(spark, data), records.stack_references(scan(spark, data))).collect()
    assert [(r.type, r.field) for r in missing] == [("LIST", "STAK.listBlockId")]


@pytest.mark.parametrize(
    "data, status", [(b"\0\0", "truncated header"), (struct.pack(">I4si", 16, b"TEST", 1) + b"ab", "truncated payload"), (struct.pack(">I4si", 4, b"TEST", 1), "invalid size")]
)
def test_block_damage(spark, data, status):
    rows = scan(spark, data).collect()
    assert [(r.type, r.status) for r in rows] == [(None, status)]


def test_bytes_after_the_end(spark):
    assert scan(spark, TAIL + b"zz").count() == 1
    assert scan(spark, TAIL + b"zz", strict_tail=True).orderBy("seq").collect()[-1].status == "bytes after the end"


def test_block_map_and_offsets(spark):
    data = block(b"CARD", 1, b"a") + block(b"CARD", 1, b"b") + TAIL
    assert [bytes(r.payload) for r in blocks.block_map(scan(spark, data)).collect()] == [b"b"]
    rows = spark.createDataFrame([("f", 0, 12), ("f", 1, 20), ("f", 2, 5)], "file string, n int, size int")
    assert [r.offset for r in blocks.offsets_from_sizes(rows, "file", "n", "size").orderBy("n").collect()] == [0, 12, 32]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "Myst Files").mkdir(parents=True)
    (tmp_path / "in" / "a.stk").write_bytes(block(b"STAK", -1, bytes(68)) + TAIL)
    (tmp_path / "in" / "b.mov").write_bytes(b"moov")
    (tmp_path / "in" / "c.part").write_bytes(b"x")
    found = files.classify_files(files.read_files(spark, f"{tmp_path}/in"))
    assert {r.rel_path: (r.decision, r.reason) for r in found.collect()} == {"a.stk": ("stack", "binary_stak_header"), "b.mov": ("skip", "unrecognized")}
    assert [(r.external_kind, r.media_type) for r in files.external_files(found).collect()] == [("movie", "video/quicktime")]


# --- records ------------------------------------------------------------------------------------------


def part(number, kind, more, name, script=b"", font=3, icon=0, width=0, align=0, style=0):
    body = struct.pack(">hhhhhhhhhhhhhh", number, kind << 8, 1, 2, 3, 4, more, width, icon, align, font, 12, style, 16) + name + b"\0\0" + script + b"\0"
    body += b"" if len(body) % 2 == 0 else b"\0"
    return struct.pack(">h", 2 + len(body)) + body


def layer(card, parts, contents, name, script, owner=7):
    head = struct.pack(">iih14x", 0, 5, 0) + (struct.pack(">i", owner) if card else b"")
    head += struct.pack(">h6xh4x", len(parts), len(contents))
    body = b"".join(parts)
    for number, data in contents:
        body += struct.pack(">hh", number, len(data)) + data + b"\0" * (len(data) % 2)
    return head + body + name + b"\0" + script + b"\0"


@pytest.fixture(scope="module")
def stack(spark):
    fonts = bytes(6) + struct.pack(">h4x", 2) + struct.pack(">h", 3) + b"Geneva\0\0" + struct.pack(">h", 4) + b"Chicago\0"
    style = struct.pack(">4xi6x", 1) + struct.pack(">h8xhhh8x", 9, 3, 0x0300, 14)
    stak = bytearray(1600)
    struct.pack_into(">iii", stak, 32, 1, 20, 2)
    struct.pack_into(">h", stak, 64, -0x8000)
    stak[84:88] = bytes.fromhex("02412005")
    struct.pack_into(">iihh", stak, 420, 5, 6, 0, 640)
    stak[1524:1524 + 15] = b"on openStack\rgo"
    background = layer(False, [part(1, 1, 5, b"ok")], [], b"bg", b"")
    card = layer(
        True, [part(2, 2, 7, b"text", b"on mouseUp\r  play \"boing\"\rend mouseUp", icon=2, width=3, align=-1), part(3, 1, 11, b"menu", icon=4)],
        [(1, b"\x001"), (-2, b"plain te"), (2, struct.pack(">H", 0x8000 + 6) + struct.pack(">hh", 1, 9) + b"styled")], b"first", b"on openCard\r-- note\rvisit\rend openCard",
    )
    lst = bytearray(46)
    struct.pack_into(">i", lst, 4, 1)
    struct.pack_into(">h", lst, 16, 6)
    struct.pack_into(">ih", lst, 36, 3, 3)
    page = bytes(12) + struct.pack(">iBx", 20, 16) + struct.pack(">iBx", 99, 0) + struct.pack(">iBx", 0, 0)
    mast = bytes(20) + struct.pack(">III", 0, (7 << 8) | 3, 0)
    data = block(b"STAK", -1, bytes(stak)) + block(b"FTBL", 5, fonts) + block(b"STBL", 6, style) + block(b"LIST", 2, bytes(lst)) + block(b"PAGE", 3, page)
    data += block(b"BKGD", 7, background) + block(b"CARD", 20, card) + block(b"MAST", -1, mast) + TAIL
    return scan(spark, data).cache()


def test_stack_record(stack):
    r = records.stacks(stack).first()
    assert (r.card_count, r.first_card, r.list_id, r.card_height, r.card_width, r.pattern_count) == (1, 20, 2, 342, 640, 40)
    assert r.cant_modify and not r.cant_delete and r.created_by_version == "HyperCard 2.4.1d5" and r.script == "on openStack\rgo"
    assert records.patterns(stack).count() == 40


def test_fonts_styles_and_css(stack):
    assert {r.font_id: r["name"] for r in records.fonts(stack).collect()} == {3: "Geneva", 4: "Chicago"}
    s = records.styles(stack).first()
    assert (s.style_id, s.font_name, s.text_styles, s.font_size) == (9, "Geneva", ["italic", "bold"], 14)
    assert records.stylesheet(records.styles(stack)).first().css == '.style9 { font-family: "Geneva"; font-weight: bold; font-style: italic; font-size: 14pt; }'


def test_lists_pages_and_misses(stack):
    assert [(r.page_id, r.entry_count, r.entry_size) for r in records.page_lists(stack).collect()] == [(3, 3, 6)]
    assert [(r.card_id, r.flags) for r in records.page_entries(stack).orderBy("n").collect()] == [(20, 16), (99, 0)]
    assert [(r.type, r.id) for r in records.lookup_misses(stack).collect()] == [("CARD", 99)]
    assert [(r.file_offset, r.id_low) for r in records.master_entries(stack).collect()] == [(7 << 5, 3)]


def test_layers_parts_and_contents(stack):
    rows = {r.type: r for r in records.layers(stack).collect()}
    assert (rows["CARD"]["name"], rows["CARD"].owner, rows["BKGD"]["name"], rows["BKGD"].owner) == ("first", 7, "bg", -1)
    assert rows["CARD"].script == "on openCard\r-- note\rvisit\rend openCard"
    parts = {r.part_id: r for r in records.parts(stack).collect()}
    assert (parts[1].part_type, parts[1].style, parts[1].layer_type) == ("button", "checkbox", "BKGD")
    assert (parts[2].part_type, parts[2].style, parts[2].text_align, parts[2].selected_lines) == ("field", "scrolling", "right", [2, 3])
    assert (parts[3].style, parts[3].selected_lines, parts[3].font_name, parts[3]["name"]) == ("popup", [4], "Geneva", "menu")
    contents = {(r.part_id, r.layer): r for r in records.contents(stack).collect()}
    assert contents[(1, "background")].highlight and contents[(1, "background")].text is None
    assert contents[(2, "card")].text == "plain te"
    assert contents[(2, "background")].text == "styled" and [tuple(x) for x in contents[(2, "background")].style_runs] == [(1, 9)]
    assert records.text_bytes(records.contents(stack)).first().text_bytes == 14


def test_scripts_and_manifest(spark, stack):
    found = records.scripts(stack)
    assert {(r.owner_kind, r.owner_id) for r in found.collect()} == {("stack", -1), ("card", 20), ("part", 2)}
    lines = scripts.statements(found, ["owner_kind", "owner_id"])
    assert {r.command: r.n for r in scripts.call_counts(lines).collect()} == {"go": 1, "play": 1, "visit": 1}
    assert {(r["name"], r.kind) for r in scripts.handlers(lines, ["owner_kind"]).collect()} == {("openStack", "message"), ("mouseUp", "message"), ("openCard", "message")}
    external = scripts.external_calls(lines, ["owner_kind", "owner_id"], spark.createDataFrame([("Visit",)], "name string")).collect()
    assert [(r.command, r.resource_backed, r.line) for r in external] == [("visit", True, 3)]
    index = scripts.script_index(found, ["owner_kind", "owner_id"], spark.createDataFrame([("Visit",)], "name string"))
    assert index.where("owner_kind = 'card'").first()["index"].count('"resource_backed":true') == 1
    manifest = records.source_manifest(stack).first().manifest
    assert '"block_type_counts"' in manifest and '"CARD":1' in manifest


def test_reference_rules(spark):
    def kind(line, literal):
        return one(spark, text.reference_kind(F.lit(line), F.lit(literal)))

    assert [kind("playqt x", "a"), kind("x", "a.mov"), kind("go to card 1", "a"), kind("a sound", "b"), kind("htaddpict", "b"), kind("x", "y")] == ["movie", "movie", "card", "sound", "picture", None]


# --- firmware -------------------------------------------------------------------------------------------

BASE = 0x40800000


@pytest.fixture(scope="module")
def image(spark):
    data = bytearray(0x200)
    struct.pack_into(">4I", data, 0x20, BASE + 0x60, BASE + 0x64, BASE + 0x66, BASE + 0x68)
    data[0x60:0x67] = b"BootROM"
    data[0x70:0x76] = b"\x05Hello"
    data[0x80:0x88] = b"TableMap"
    data[0x90:0x98] = b"DRVRCODE"
    fork = struct.pack(">4I", 16, 32, 10, 50) + struct.pack(">I", 6) + b"\x05Hello" + bytes(6)
    fork += bytes(24) + struct.pack(">HH", 28, 50) + struct.pack(">H", 0) + b"STR " + struct.pack(">HH", 0, 10) + struct.pack(">hhII", 128, -1, 0, 0)
    data[0xC0 : 0xC0 + len(fork)] = fork
    return spark.createDataFrame([("r", BASE, data)], "rom_id string, base long, content binary").cache()


def test_rom_scans(image):
    found = {(r.text, r.is_pascal, r.offset) for r in rom.strings(image).collect()}
    assert found >= {("BootROM", False, 0x60), ("TableMap", False, 0x80), ("Hello", True, 0x70)}
    table = [r for r in rom.pointer_tables(image).collect() if r.address == BASE + 0x20][0]
    assert (table.entry_count, table.targets) == (4, [BASE + 0x60, BASE + 0x64, BASE + 0x66, BASE + 0x68])
    assert {r.offset for r in rom.pointer_words(image).collect()} >= {0x20, 0x24, 0x28, 0x2C}
    assert {(r.type, r.address - BASE) for r in rom.markers(image).collect()} == {("DRVR", 0x90), ("CODE", 0x94), ("STR ", 0xC0 + 62)}
    maps = rom.resource_maps(image).collect()
    assert [(r.address - BASE, r.n_resources, r.types[0]["type"]) for r in maps] == [(0xC0, 1, "STR ")]
    assert rom.string_clusters(rom.strings(image)).first().n >= 3
    row = rom.identify(image).first()
    assert row.crc32 == zlib.crc32(bytes(image.first().content)) and row.rom_id.startswith("rom-")


def test_resources_inside_images(spark):
    data = bytearray(0x100)
    data[0x10:0x1C] = struct.pack(">4shBB", b"clut", 129, 0x20, 4) + b"Test"
    data[0x1C:0x20] = b"kckc"
    data[0x20:0x36] = b"Kurt" + bytes(4) + struct.pack(">II", 6, 20) + b"packed"
    data[0x48:0x58] = b"\x78" + bytes(7) + struct.pack(">II", 0, 0x78)
    data[0x58:0x67] = struct.pack(">4shBB", b"PICT", 4, 1, 7) + b"4BitStd"
    data[0x70:0x74] = struct.pack(">I", 16)
    images = spark.createDataFrame([("r", BASE, data)], "rom_id string, base long, content binary")
    kurt = rom.wrapped_resources(images).collect()
    assert [(r.type, r.id, r["name"], r.address - BASE, bytes(r.data)) for r in kurt] == [("clut", 129, "Test", 0x30, b"packed")]
    inline = rom.inline_resources(images).collect()
    assert [(r.type, r.id, r["name"], r.flags, r.address - BASE, r.length) for r in inline] == [("PICT", 4, "4BitStd", 1, 0x78, 16)]
    spans = rom.resource_spans(rom.inline_resources(images)).first()
    assert (spans.start - BASE, spans.end - BASE, spans.kind) == (0x58, 0x88, "rom_inline_resources")


LISTING = """start:
40800020  4EB9 4080 0030  jsr /* 40800030 */
40800026  6000 0008  bra /* 40800030 */
4080002A  4EF9  jmp /* 40800040 */
4080002E  41FA  lea A0, /* 40800080 */
sub:
40800030  A9F0  syscall Trap
40800032  4E75  rts
40800034  6100  bsr /* 40800030 */
"""


def test_disassembly(spark, image):
    rows = rom.instructions(spark.createDataFrame([("r", LISTING)], "rom_id string, text string"))
    assert [(r.line_index, r.label) for r in rows.orderBy("line_index").collect()][4] == (5, "sub")
    bounds = image.select("rom_id", "base", F.octet_length("content").alias("bytes"))
    refs = rom.xrefs(rows, bounds)
    assert sorted(r.kind for r in refs.collect()) == ["branch", "call", "call", "jump", "memory"]
    assert [(r.trap_number, r.space) for r in rom.traps(rows).collect()] == [(0x9F0, "Toolbox")]
    f = {r.address: r for r in rom.functions(rows, refs, bounds).collect()}
    assert (f[BASE + 0x30].label, f[BASE + 0x30].calls, f[BASE + 0x30].instruction_count) == ("sub", 2, 3)
    lowered = rom.lower_in_data(refs, spark.createDataFrame([("r", BASE + 0x80, BASE + 0x90)], "rom_id string, start long, end long"))
    assert {r.target - BASE: r.confidence for r in lowered.where("kind = 'memory'").collect()} == {0x80: 0.5}


def test_atlas(spark, image, tmp_path):
    tables = rom.analyze(image, spark.createDataFrame([("r", LISTING)], "rom_id string, text string"))
    assert set(tables) == set(rom.ATLAS)
    rom.write_atlas({k: tables[k] for k in ("functions", "pointer_tables")}, str(tmp_path))
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/functions").count() == tables["functions"].count()
    source = spark.createDataFrame([("a.c", 3, "see TableMap here"), ("a.c", 4, "nothing")], "path string, line int, text string")
    assert [(r.value, r.line) for r in rom.source_overlay(tables["strings"], source).collect()] == [("TableMap", 3)]


# --- warehouse ---------------------------------------------------------------------------------------------


LOG = "Status: Processing 'card' #5 20 (100 bytes)\nWarning: Skipping block  ABCD #-1\nError: Couldn't parse x\nStatus: 12 blocks\nStatus: Skipping 'FREE' #0 (8 bytes)"


def test_log_rows(spark):
    lines = warehouse.log_lines(spark.createDataFrame([("r", 1, LOG)], "run_id string, attempt_id long, log string"))
    chunks = {r.chunk_type: r for r in warehouse.chunks_from_log(lines).collect()}
    assert (chunks["CARD"].chunk_bytes, chunks["ABCD"].understood, chunks["FREE"].status) == (100, 0, "skipped")
    counts = warehouse.attempt_counts(lines).first()
    assert (counts.warnings, counts.errors, counts.status_lines, counts.blocks, counts.resources) == (1, 1, 3, 12, None)
    assert {r.gap_kind for r in warehouse.diagnostics_from_log(lines).collect()} == {"block", "chunk"}


def test_linking(spark):
    outputs = spark.createDataFrame([(1, "r", 1, 10, "card_5.json", "card", 5), (2, "r", 1, 10, "card_6.json", "card", 6), (3, "r", 1, 10, "stack_-1.json", "stack", None)],
        "id long, run_id string, attempt_id long, stack_id long, rel_path string, logical_kind string, logical_id long")
    chunks = spark.createDataFrame([(10, "CARD", 5), (10, "STAK", None)], "stack_id long, chunk_type string, chunk_id long").withColumn("output_file_id", F.lit(None).cast("long"))
    assert {(r.chunk_type, r.output_file_id) for r in warehouse.link_chunks(chunks, outputs).collect()} == {("CARD", 1), ("STAK", None)}
    assert [r.output_file_id for r in warehouse.derived_chunks(chunks, outputs).collect()] == [2]
    media = spark.createDataFrame([(1, 10, "card_6.json"), (2, 10, "none")], "id long, stack_id long, rel_path string").withColumn("output_file_id", F.lit(None).cast("long"))
    linked = warehouse.link_media(media, outputs)
    assert {r.id: r.output_file_id for r in linked.collect()} == {1: 2, 2: None}


def test_rerun_overwrites_its_run_only(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path))
    rows = lambda run, n: spark.createDataFrame([(i, run, "k", "d", "s", "l") for i in range(n)], "id long, run_id string, kind string, detail string, subject string, log_path string").withColumn("attempt_id", F.lit(1).cast("long"))
    w.save("format_gaps", rows("a", 3))
    w.save("format_gaps", rows("b", 2))
    w.save("format_gaps", rows("a", 1))
    again = warehouse.Warehouse(spark, str(tmp_path))
    assert {(run, again["format_gaps"].where(F.col("run_id") == run).count()) for run in "ab"} == {("a", 1), ("b", 2)}
    assert reports.format_gap_counts(again, "b").first()["count"] == 2
    assert again["format_gaps"].count() == 3


def test_upsert_and_totals(spark):
    columns = "run_id string, embedded_file_id long, target_format string, status string, converted_at string"
    known = spark.createDataFrame([("r", 1, "png", "failed", "2020")], columns)
    fresh = spark.createDataFrame([("r", 1, "png", "done", "2021"), ("r", 2, "png", "done", "2021")], columns)
    assert {(r.embedded_file_id, r.status) for r in warehouse.record_conversions(known, fresh).collect()} == {(1, "done"), (2, "done")}


def test_all_empty_warehouse(spark):
    w = warehouse.Warehouse(spark)
    for name, report in reports.REPORTS.items():
        assert reports.ordered(report(w, "r"), name).count() == 0
