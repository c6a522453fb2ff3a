"""Column expressions over binary columns: big-endian fields, hashes, Mac text.

All run in the JVM. Offsets count from 0 and may be columns. A number that lies outside the
bytes reads as 0, as old record layouts grew over time and short records are valid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The upper half of Mac OS Roman, from the codec that Python has for it.
MAC_UPPER = bytes(range(128, 256)).decode("mac_roman")
LATIN_UPPER = bytes(range(128, 256)).decode("latin-1")


def _offset(offset: int | Column) -> Column:
    return F.lit(offset) if isinstance(offset, int) else offset


def field(data: Column, offset: int | Column, length: int | Column) -> Column:
    """Bytes ``[offset, offset + length)``."""
    return F.substring(data, _offset(offset) + 1, _offset(length))


def unsigned(data: Column, offset: int | Column, size: int) -> Column:
    """Big-endian unsigned number of 1 to 7 bytes, as a long."""
    at = _offset(offset)
    inside = (at >= 0) & (F.octet_length(data) >= at + size)
    return F.when(inside, F.conv(F.hex(field(data, at, size)), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def signed(data: Column, offset: int | Column, size: int) -> Column:
    """Big-endian two's complement number, as a long."""
    value = unsigned(data, offset, size)
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def u8(data: Column, offset: int | Column) -> Column:
    return unsigned(data, offset, 1)


def u16(data: Column, offset: int | Column) -> Column:
    return unsigned(data, offset, 2)


def u32(data: Column, offset: int | Column) -> Column:
    return unsigned(data, offset, 4)


def i16(data: Column, offset: int | Column) -> Column:
    return signed(data, offset, 2)


def i32(data: Column, offset: int | Column) -> Column:
    return signed(data, offset, 4)


def pack_u32(value: Column) -> Column:
    """Four big-endian bytes of a number; negative ones wrap."""
    return F.unhex(F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 32))), 8, "0"))


def has_bit(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(1 << bit) != 0


def set_bits(flags: Column, names: dict[int, str]) -> Column:
    """Names of the bits that are set, in the order of ``names``."""
    chosen = F.array(*[F.when(has_bit(flags, bit), F.lit(name)) for bit, name in names.items()])
    return F.array_compact(chosen)


#: Attribute bits of a resource map entry.
RESOURCE_ATTRIBUTES = {6: "system_heap", 5: "purgeable", 4: "locked", 3: "protected", 2: "preload", 1: "changed", 0: "compressed"}


def even(offset: Column) -> Column:
    return offset + offset % 2


def four_cc(data: Column, offset: int | Column = 0) -> Column:
    """Four bytes as Mac text."""
    return mac_text(field(data, offset, 4))


def type_code(text: Column) -> Column:
    """A four-character type as its unsigned 32-bit number."""
    return F.conv(F.hex(mac_bytes(text)), 16, 10).cast("long")


def mac_text(data: Column, command_key: bool = False) -> Column:
    """Mac OS Roman bytes as text. With command_key, 0x11 is the place-of-interest sign."""
    source, target = LATIN_UPPER, MAC_UPPER
    if command_key:
        source, target = source + "\x11", target + "⌘"
    return F.translate(F.decode(data, "ISO-8859-1"), source, target)


def mac_bytes(text: Column) -> Column:
    return F.encode(F.translate(text, MAC_UPPER, LATIN_UPPER), "ISO-8859-1")


def nul_end(data: Column, offset: int | Column = 0) -> Column:
    """Offset of the first NUL at or after ``offset``; the length if there is none."""
    at = _offset(offset)
    # only what follows is decoded
    found = F.position(F.lit("\0"), F.decode(F.substring(data, at + 1, F.octet_length(data)), "ISO-8859-1"))
    return F.when((at >= 0) & (found > 0), at + found - 1).otherwise(F.octet_length(data))


def c_string(data: Column, offset: int | Column = 0, command_key: bool = True) -> Column:
    """Mac text from ``offset`` up to a NUL."""
    at = _offset(offset)
    return mac_text(field(data, at, F.greatest(nul_end(data, at) - at, F.lit(0))), command_key)


def pascal_string(data: Column, offset: int | Column = 0) -> Column:
    """Mac text with its length in the first byte; null if the bytes end before it does."""
    at = _offset(offset)
    length = u8(data, at).cast("int")
    whole = (F.octet_length(data) > at) & (F.octet_length(data) >= at + 1 + length)
    return F.when(whole, mac_text(field(data, at + 1, length)))


def bcd_version(data: Column, offset: int | Column = 0) -> Column:
    """Four packed bytes as a version text: N.N or N.N.N, then a stage letter and build unless the build is 0."""
    at = _offset(offset)
    major = F.regexp_replace(F.lower(F.hex(field(data, at, 1))), "^0(?=.)", "")
    digits = F.lower(F.hex(field(data, at + 1, 1)))
    minor, fix = F.substring(digits, 1, 1), F.substring(digits, 2, 1)
    stage, build = u8(data, at + 2), u8(data, at + 3)
    letter = F.when(stage == 0x20, "d").when(stage == 0x40, "a").when(stage == 0x60, "b").otherwise("v")
    fixed = F.when(fix == "0", "").otherwise(F.concat(F.lit("."), fix))
    tail = F.when(build == 0, "").otherwise(F.concat(letter, build.cast("string")))
    return F.when(F.octet_length(data) >= at + 4, F.concat(major, F.lit("."), minor, fixed, tail))


def address(value: Column) -> Column:
    """A number as eight or more upper-case hex digits."""
    digits = F.hex(value)
    return F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)


def sha256_upper(data: Column) -> Column:
    return F.upper(F.sha2(data, 256))


def crc32_hex(data: Column) -> Column:
    return F.lpad(F.hex(F.crc32(data)), 8, "0")


def short_sha1(text: Column) -> Column:
    """The first 12 digits of a SHA-1, used in file stems."""
    return F.substring(F.sha1(F.encode(text, "utf-8")), 1, 12)


def rom_id(data: Column) -> Column:
    return F.concat(F.lit("rom-"), F.substring(F.sha2(data, 256), 1, 12))


def escaped_bytes(data: Column) -> Column:
    """Bytes as text where all but printable ASCII is written \\xNN."""
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        byte = F.substring(data, i, 1)
        code = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.when(code.between(32, 126) & (code != 92), F.decode(byte, "ISO-8859-1")).otherwise(F.concat(F.lit("\\x"), F.hex(byte)))

    return F.array_join(F.transform(places, one), "")
