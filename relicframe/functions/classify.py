"""Ordered classifiers: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension, file_name

# Types, suffixes and names as the data formats have them.
STACK_SUFFIXES = ("stak", "stack", "stk")
SUFFIX_KINDS = {
    "picture": ("pict", "pic"),
    "text": ("txt", "text", "md", "c", "h", "html", "htm"),
    "movie": ("mov", "moov", "movie"),
    "sound": ("snd", "aif", "aiff", "wav"),
    "binary_container": ("sit", "hqx", "bin", "data", "rsrc", "dfont"),
    "document": ("pdf",),
}
FINDER_KINDS = {
    "picture": ("PICT",),
    "text": ("TEXT",),
    "application": ("APPL",),
    "movie": ("MooV", "Moov", "MYqt"),
    "myst_resource": ("MYag",),
    "sound": ("snd ",),
    "macro": ("Mcr$", "Mcr0"),
    "icon_or_cursor": ("ICON", "ICN#", "cicn", "CURS"),
}
KIND_ORDER = ("picture", "text", "application", "movie", "myst_resource", "sound", "macro", "icon_or_cursor")
OUTPUT_KINDS = {
    "json": ("json",),
    "image": ("pbm", "png", "jpg", "jpeg", "gif"),
    "sound": ("aiff", "aif", "wav", "snd"),
    "raw": ("raw", "data"),
    "assembly": ("s", "asm"),
}
CHUNK_OF_LOGICAL = {
    "background": "BKGD", "card": "CARD", "bmap": "BMAP", "master": "MAST", "pagesetup": "PRST",
    "printsettings": "PRNT", "reporttemplate": "PRFT", "stack": "STAK",
}
CODE_TYPES = ("XCMD", "XFCN", "xcmd", "xfcn", "cfrg")
CODE_PLATFORMS = ("mac68k", "macppc")
LISTING_SUFFIXES = ("s", "asm", "txt")
NUMBERED_FILES = ("card", "background", "BMAP", "PAT", "stylesheet", "master", "pagesetup", "reporttemplate", "printsettings")
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "wav": "audio/wav",
    "aif": "audio/aiff", "aiff": "audio/aiff", "mov": "video/quicktime", "txt": "text/plain", "json": "application/json",
}
CFRG_USAGE = ("import_library", "application", "drop_in_addition", "stub_library", "weak_stub_library")
CFRG_LOCATION = ("memory", "data_fork", "resource", "byte_stream", "named_fragment")
BLOCK_TYPES = ("STAK", "CARD", "LIST", "PAGE", "BKGD", "BMAP", "FTBL", "STBL", "MAST", "PRNT", "PRST", "PRFT", "FREE", "TAIL")


def _lookup(key: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def stack_decision(finder_type: Column, rel_path: Column, binary_type: Column, binary_size: Column, size: Column) -> Column:
    """struct(decision, reason): whether a file is taken for a stack, and which rule said so."""
    parent = F.element_at(F.split(rel_path, "/"), -2)
    in_folder = (F.size(F.split(rel_path, "/")) >= 2) & (parent == "Myst Files")

    def said(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    header = binary_type == "STAK"
    return (
        F.when((finder_type == "STAK") | ((finder_type == "MYag") & in_folder), said("stack", "finder_type_stack_like"))
        .when(finder_type == "APPL", said("skip", "finder_type_application"))
        .when(finder_type == "MYag", said("skip", "myst_resource_sidecar"))
        .when(header & (binary_size >= 12) & (binary_size <= size), said("stack", "binary_stak_header"))
        .when(extension(rel_path).isin(*STACK_SUFFIXES), said("stack", "stack_extension"))
        .when(header, said("skip", "binary_stak_header_size_mismatch"))
        .otherwise(said("skip", "unrecognized"))
    )


def external_kind(finder_type: Column, suffix: Column, binary_type: Column) -> Column:
    """Kind of a file that is not imported."""
    out = None
    for kind in KIND_ORDER:
        test = finder_type.isin(*FINDER_KINDS[kind])
        if kind in SUFFIX_KINDS:
            test = test | suffix.isin(*SUFFIX_KINDS[kind])
        out = F.when(test, kind) if out is None else out.when(test, kind)
    out = out.when(binary_type == "STAK", "stack_like_unimported")
    for kind in ("binary_container", "document"):
        out = out.when(suffix.isin(*SUFFIX_KINDS[kind]), kind)
    return out.otherwise("unknown_binary")


#: Kinds of files beside a stack, by Finder type and suffix, in order (fixed values).
ASSET_KINDS = (
    ("myst_resource", ("MYag",), ()), ("movie", ("MYqt", "MooV", "Moov"), ("mov", "moov", "movie")), ("picture", ("PICT",), ("pict", "pic")),
    ("sound", ("snd ",), ("snd", "aif", "aiff", "wav")), ("text", ("TEXT",), ("txt", "text", "md")), ("application", ("APPL",), ()), ("system_extension", ("INIT",), ()),
    ("stack_like", ("STAK",), ("stak", "stack", "stk")),
)
ASSET_MEDIA = {"movie": "video/quicktime", "picture": "image/x-pict", "sound": "audio/x-mac-sound", "text": "text/plain", "application": "application/x-mac-application"}


def asset_kind(finder_type: Column, suffix: Column, size: Column) -> Column:
    """Kind of a file beside a stack."""
    out = F.when(size == 0, "empty_placeholder")
    for kind, types, suffixes in ASSET_KINDS:
        out = out.when(finder_type.isin(*types) | suffix.isin(*suffixes), kind)
    return out.otherwise("unknown_binary")


def asset_media_type(kind: Column) -> Column:
    return F.coalesce(_lookup(kind, ASSET_MEDIA), F.lit("application/octet-stream"))


def source_class(finder_type: Column, has_stack_data: Column, has_code: Column) -> Column:
    return (
        F.when((finder_type == "APPL") & has_stack_data & has_code, "hypercard_standalone_application")
        .when(finder_type == "APPL", "classic_mac_application")
        .when(finder_type.isin("STAK", "MYag"), "hypercard_stack")
        .when(has_stack_data, "hypercard_stack_data_fork")
        .otherwise("unknown")
    )


def output_kind(path: Column) -> Column:
    """Kind of a package file by its suffix."""
    suffix = extension(path)
    out = None
    for kind, suffixes in OUTPUT_KINDS.items():
        out = F.when(suffix.isin(*suffixes), kind) if out is None else out.when(suffix.isin(*suffixes), kind)
    return out.otherwise("other")


def listed_code(path: Column) -> Column:
    """struct(type, number) of the code resource that a listing is of, read from its name; null for other files."""
    name = file_name(path)
    words = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    # listings: a code type, perhaps a platform, then the number; the last such place counts
    places = F.when(F.size(words) > 2, F.sequence(F.lit(1), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    number_at = lambda i: F.when(F.get(words, i + 1).isin(*CODE_PLATFORMS), F.get(words, i + 2)).otherwise(F.get(words, i + 1))
    typed = F.transform(places, lambda i: F.struct(F.get(words, i).alias("type"), number_at(i).alias("number")))
    listed = F.try_element_at(F.filter(typed, lambda x: x["type"].isin(*CODE_TYPES) & x["number"].rlike(r"^-?\d+$")), F.lit(-1))
    return F.when(extension(path).isin(*LISTING_SUFFIXES), listed)


def logical_file(path: Column) -> Column:
    """struct(kind, id): what a package file holds, read from its name."""
    name, listed = file_name(path), listed_code(path)
    code_type = listed["type"]
    # package files: what they are, then the number
    whole = F.split(name, "_")
    plain_kind = F.when(F.get(whole, F.lit(0)).isin(*NUMBERED_FILES) & F.get(whole, F.lit(1)).rlike(r"^-?\d"), F.get(whole, F.lit(0)))
    plain_number = F.regexp_extract(F.get(whole, F.lit(1)), r"^-?\d+", 0)
    code_kind = F.when(code_type == "cfrg", "codefragment").when(F.lower(code_type) == "xcmd", "externalcommand").otherwise("externalfunction")

    def said(kind: Column | str, number: Column | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), (F.lit(None) if number is None else number).cast("long").alias("id"))

    return (
        F.when(name == "printsettings.json", said("printsettings"))
        .when(name == "source-manifest.json", said("source_manifest"))
        .when(code_type.isNotNull(), said(code_kind, listed["number"]))
        .when(plain_kind.isNotNull(), said(F.lower(plain_kind), plain_number))
        .when(name == "project.json", said("project"))
        .when(name == "stack_-1.json", said("stack", F.lit(-1)))
        .otherwise(said(output_kind(path)))
    )


def chunk_type(logical_kind: Column) -> Column:
    return F.coalesce(_lookup(logical_kind, CHUNK_OF_LOGICAL), F.upper(logical_kind))


def embedded_kind(kind: Column, logical_kind: Column) -> Column:
    return (
        F.when(kind == "image", "image")
        .when(kind == "sound", "sound")
        .when(kind == "raw", "raw_binary")
        .when(logical_kind.isin("pat", "bmap"), "bitmap")
        .when(logical_kind.isin("externalcommand", "externalfunction"), "code_resource")
        .otherwise("embedded_file")
    )


def gap_kind(message: Column) -> Column:
    """What a log message is about."""
    # fixed values: the texts that logs have
    return (
        F.when(message.contains("Skipping block"), "block")
        .when(message.contains("Skipping code resource") | message.rlike("Unknown type .* resource"), "resource")
        .when(message.contains("Premature end") | message.contains("Couldn't parse"), "chunk")
        .when(message.contains("Couldn't find stack block"), "file")
        .when(message.rlike("Assertion failed|Abort trap|Segmentation fault"), "crash")
        .otherwise("diagnostic")
    )


def code_kind(resource_type: Column) -> Column:
    return F.when(resource_type == "cfrg", "code_fragment").when(F.lower(resource_type) == "xcmd", "externalcommand").otherwise("externalfunction")


def code_platform(resource_type: Column) -> Column:
    return F.when(resource_type == F.lower(resource_type), "macppc").otherwise("mac68k")


def code_format(resource_type: Column, prefix: Column) -> Column:
    """struct(instruction, container) of a code resource, from its type and first bytes."""

    def said(instruction: str, container: str) -> Column:
        return F.struct(F.lit(instruction).alias("instruction"), F.lit(container).alias("container"))

    return (
        F.when(resource_type == "cfrg", said("ppc32", "cfm_code_fragment"))
        .when(resource_type.isin("XCMD", "XFCN"), said("m68k", "classic_code_resource"))
        .when(prefix.startswith(F.lit(b"Joy!")), said("ppc32", "pef"))
        .otherwise(said("ppc32", "raw_code_resource"))
    )


def media_type(suffix: Column) -> Column:
    return F.coalesce(_lookup(suffix, MEDIA_TYPES), F.lit("application/octet-stream"))


def cfrg_usage(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, CFRG_USAGE)), code.cast("int")), F.lit("invalid"))


def cfrg_location(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, CFRG_LOCATION)), code.cast("int")), F.lit("invalid"))
