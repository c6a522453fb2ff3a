"""Files made of resources: names and statuses by type, and a sink that leaves each file once.

A resource gives none, one or many artifacts, each a row with its path and bytes. Tasks write
the bytes of their rows below a staging folder of their own attempt and report digests; Spark
keeps the report of one attempt a task, and only what it names is then moved to its
place. So an attempt that is repeated, or runs twice at once, leaves nothing behind, and writing
again gives the same files. No bytes pass through the driver. Where artifacts are many and small,
a file and its folders take far more room than what is in it: save_archives() then writes them into ZIP archives.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import mac_bytes, short_sha1
from ..scratch import delete, written
from . import resources as forms
from .color_pictures import SWATCH, color_pictures

#: Types whose conversion error is one of parsing (fixed values).
PARSED = (
    "PLTE", "HCbg", "HCcd", "vers", "cfrg", "clut", "CTBL", "actb", "cctb", "dctb", "fctb", "wctb", "pltt", "ppat", "ppt#", "cicn", "crsr", "SIZE", "finf", "CNTL", "DLOG", "WIND", "MENU",
    "DITL", "MBAR", "ALRT", "FREF", "BNDL", "ROv#", "RSSC", "TxSt", "styl", "KCHR", "RECT", "TOOL", "PICK", "KBDN", "PAPA", "LAYO", "FONT", "NFNT", "FOND", "decl", "STR ", "STR#", "TwCS",
    "CODE", "DRVR", "dcmp", "TEXT",
)
CONVERTED = ("snd ", "PICT")
#: Types whose JSON form is a file.
JSON_FILES = (*(t for t in PARSED if t not in ("STR ", "TEXT")), "CURS")
POWER_PC = ("xcmd", "xfcn")
#: Bytes and members of an archive, after which a task begins another; it holds that much at once.
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 16 << 20, 10_000
#: One-bit pictures of which a resource may hold several, and so numbers them.
NUMBERED = ("PAT#", "SICN", "icm#", "ics#")

ARTIFACT = ("file", "type", "id", "name", "place", "path", "format", "media_type", "variant", "content")


def error_status(kind: Column) -> Column:
    """What a failed conversion makes of a resource; null for types that nothing converts."""
    return (
        F.when(kind.isin(*PARSED), "parse_failed").when(kind.isin(*CONVERTED), "convert_failed").when(kind.isin(*forms.CODE_TYPES), "disassembly_failed")
    )


def escaped(text: Column) -> Column:
    """A text in a file name: letters, digits, ``-``, ``_``, ``.`` and ``:`` stay, other bytes of Mac text are %XX; an empty one is ``unnamed``."""
    data = mac_bytes(text)
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        byte = F.decode(F.substring(data, i, 1), "ISO-8859-1")
        return F.when(byte.rlike("^[A-Za-z0-9_.:-]$"), byte).otherwise(F.concat(F.lit("%"), F.hex(F.substring(data, i, 1))))

    whole = F.array_join(F.transform(places, one), "")
    return F.when(whole == "", "unnamed").otherwise(whole)


def _named(stem: Column, kind: Column, suffix: str) -> Column:
    """A file name of stem, type, id and, where there is one, name."""
    name = F.when(F.col("name") != "", F.concat(F.lit("_"), escaped(F.col("name")))).otherwise("")
    return F.concat(escaped(stem), F.lit("_"), escaped(kind), F.lit("_"), F.col("id").cast("string"), name, F.lit(suffix))


def _plain(suffix: str | Column) -> Column:
    return F.concat("type", F.lit("_"), F.col("id").cast("string"), F.lit(suffix) if isinstance(suffix, str) else suffix)


def _two_digits(number: Column) -> Column:
    return F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string"))


def png_of_rgba(pictures: DataFrame) -> DataFrame:
    """``pictures`` (width, height, rgba, ...) with a PNG each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("width", "height", "rgba")]
            made = [forms.png(w, h, [row.tobytes() for row in np.frombuffer(data, np.uint8).reshape(h, 4 * w)], 8, 6) for w, h, data in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "png"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pictures.schema)
    return pictures.mapInArrow(run, f"{fields}, png binary")


def latest(resources: DataFrame) -> DataFrame:
    """Of resources with one (file, type, id), the last in order: files of the others would be replaced by its own."""
    keys = ["file", "type", "id"]
    several = resources.groupBy(*keys).agg(F.max("order").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = resources.join(several, keys, "left").where("last IS NULL OR order = last")
    return joined.drop("last")


def conversions(resources: DataFrame, stem: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(artifacts, errors) of resources (file, type, id, name, data, order): rows of ARTIFACT columns, and (file, type, id) of what failed.

    ``stem`` names the files that carry the stack's name; by default the last part of ``file``. ``place`` orders the
    artifacts of a resource: its JSON or text first, then its pictures, sound and listing.
    """
    # each is written once: many branches read them, and what makes them is long
    rows = written(latest(resources).select("file", "type", "id", "name", "data"), "resources")
    stem = F.element_at(F.split("file", "/"), -1) if stem is None else stem
    keys = ["file", "type", "id"]

    def shaped(found: DataFrame, place: Column | int, path: Column, kind: Column | str, media: Column | str, variant: Column | int, content: Column) -> DataFrame:
        as_column = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
        return found.select(
            *keys, "name", as_column(place).cast("int").alias("place"), path.alias("path"), as_column(kind).alias("format"), as_column(media).alias("media_type"),
            as_column(variant).cast("int").alias("variant"), content.alias("content"),
        )

    # only forms of types that are there are planned; at most as many as there are forms
    known = [*(t for types in forms.JSON_TYPES for t in types), *forms.TEXT_TYPES]
    present = [r["type"] for r in rows.where(F.col("type").isin(*known)).select("type").distinct().collect()]
    told = written(forms.converted(rows, present), "converted")
    is_text = F.col("format") == "text"
    text_path = F.when(is_text, F.concat(F.lit("resource-text/"), _named(stem, F.col("type"), ".txt"))).otherwise(_plain(".json"))
    texts = shaped(told.where(F.col("text").isNotNull() & (is_text | F.col("type").isin(*JSON_FILES))), 0, text_path, F.col("format"), F.when(is_text, "text/plain; charset=utf-8").otherwise("application/json"), 0, F.encode("text", "utf-8"))
    names = rows.select(*keys, "name")

    bits = forms.write_pngs(forms.pictures(rows)).join(names, keys)
    numbered = F.when(F.col("type").isin(*NUMBERED), F.concat(F.lit("_"), _two_digits(F.col("variant")))).otherwise("")
    one_bit = shaped(bits, 1 + F.col("variant"), F.when(F.col("type") == "PAT ", F.concat(F.lit("PAT_"), F.col("id").cast("string"), F.lit(".png"))).otherwise(_plain(F.concat(numbered, F.lit(".png")))), "png", "image/png", F.col("variant"), F.col("png"))

    colored = written(color_pictures(rows), "color-pictures")
    # swatches are previews and no files
    drawn = png_of_rgba(colored.where(F.col("rgba").isNotNull() & (F.col("label") != SWATCH)).select(*keys, "variant", "label", "width", "height", "rgba")).join(names, keys)
    label = F.when(F.col("label") != "", F.concat(F.lit("_"), F.col("label"))).otherwise("")
    in_list = F.when(F.col("type") == "ppt#", F.concat(F.lit("_"), _two_digits(F.floor(F.col("variant") / 4)))).otherwise("")
    color = shaped(drawn, 1 + F.col("variant"), _plain(F.concat(in_list, label, F.lit(".png"))), "png", "image/png", F.col("variant"), F.col("png"))

    heard = written(rows.where("type = 'snd '").select(*keys, "name", forms.wav_bytes().alias("wav")), "sounds")
    sounds = shaped(heard.where("wav IS NOT NULL"), 1, F.concat(F.lit("sounds/"), _named(stem, F.lit("snd"), ".wav")), "wav", "audio/wav", 0, F.col("wav"))

    listed = forms.with_code_strings(rows).join(names, keys)
    machine = F.concat("type", F.when(F.col("type").isin(*POWER_PC), "_macppc").otherwise("_mac68k"))
    listings = shaped(listed, 1, F.concat(F.lit("resource-disassembly/"), _named(stem, machine, ".s")), "assembly", "text/plain; charset=utf-8", 0, F.encode("listing", "utf-8"))

    artifacts = texts
    for more in (one_bit, color, sounds, listings):
        artifacts = artifacts.unionByName(more)
    errors = told.where("error IS NOT NULL").select(*keys).unionByName(colored.where("error IS NOT NULL").select(*keys)).unionByName(heard.where("wav IS NULL").select(*keys)).distinct()
    return artifacts, errors


def summaries(resources: DataFrame, artifacts: DataFrame, errors: DataFrame) -> DataFrame:
    """(file, type, id, name, bytes, status, output_file, artifacts): a row a resource.

    A listing makes its resource disassembled; else a failed conversion says how it failed, an artifact
    makes it exported, and without either it is preserved. The first artifact is the output file, a listing never.
    """
    keys = ["file", "type", "id"]
    listing = F.col("format") == "assembly"
    made = artifacts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("place", "path", "format", "media_type", "variant"))).alias("artifacts"), F.min(F.when(~listing, F.struct("place", "path"))).alias("first"), F.bool_or(listing).alias("listed")
    )
    joined = latest(resources).select(*keys, "name", F.octet_length("data").cast("long").alias("bytes")).join(made, keys, "left").join(errors.withColumn("failed", F.lit(True)), keys, "left")
    failed = F.when(F.col("failed"), error_status(F.col("type")))
    status = F.when(F.col("listed"), "disassembled").otherwise(F.coalesce(failed, F.when(F.col("artifacts").isNotNull(), "exported"), F.lit("preserved")))
    none = F.array().cast("array<struct<path:string,format:string,media_type:string,variant:int>>")
    shown = F.transform("artifacts", lambda a: F.struct(a["path"].alias("path"), a["format"].alias("format"), a["media_type"].alias("media_type"), a["variant"].alias("variant")))
    return joined.select(*keys, "name", "bytes", status.alias("status"), F.coalesce(F.col("first.path"), F.lit("")).alias("output_file"), F.coalesce(shown, none).alias("artifacts"))


# --- files that are not of resources ----------------------------------------------------------------


def raw_dumps(blocks: DataFrame) -> DataFrame:
    """(file, path, content) of blocks as they are, ``<type>_<id>.data``; of blocks with one type and id the last."""
    held = blocks.where("status = 'ok' AND payload IS NOT NULL")
    last = held.groupBy("file", "type", "id").agg(F.max("seq").alias("seq"))
    return held.join(last, ["file", "type", "id", "seq"]).select("file", F.concat(escaped(F.col("type")), F.lit("_"), F.col("id").cast("string"), F.lit(".data")).alias("path"), F.col("payload").alias("content"))


SOURCE_FIELDS = ("embedded_file_id", "run_id", "stack_id", "stack_name", "rel_path", "path", "bytes", "sha256", "embedded_kind", "logical_kind", "logical_id", "referenced_by", "source_chunk_type", "source_chunk_id")


def provenance(converted: DataFrame, converter: str, version: str) -> DataFrame:
    """(file, path, content): a side-car for each conversion, tying the digest of what was made to that of its source.

    ``converted`` holds the columns of SOURCE_FIELDS (those that it has are told) and file, target_path, target_sha256, status, message, converted_at. The
    side-car of a file stands beside it; a conversion without a file has one by the id of its source.
    """
    source = F.struct(*[c for c in SOURCE_FIELDS if c in converted.columns])
    fields = F.struct(
        F.struct(F.lit(converter).alias("name"), F.lit(version).alias("version"), F.col("converted_at").cast("string").alias("converted_at")).alias("converter"), source.alias("source"),
        F.struct(F.col("target_path").alias("path"), F.col("target_sha256").alias("sha256"), "status", "message").alias("target"),
    )
    stem = F.coalesce("target_path", F.concat(F.lit("embedded-"), F.col("embedded_file_id").cast("string")))
    return converted.select("file", F.concat(stem, F.lit(".provenance.json")).alias("path"), F.encode(F.to_json(fields, {"ignoreNullFields": "false"}), "utf-8").alias("content"))


# --- the sink ----------------------------------------------------------------------------------------


def package_of(file: Column) -> Column:
    """A folder name for a source file: its last part, and a digest of the whole, so that two sources never share one."""
    return F.concat(escaped(F.element_at(F.split(file, "/"), -1)), F.lit("-"), short_sha1(file))


def save(artifacts: DataFrame, folder: str) -> tuple[DataFrame, dict]:
    """Write (file, path, content) below ``folder``; returns a table (file, path, bytes, sha256, status) and its row counts.

    The folder is a URI that Arrow and Spark both reach. A path lies in its file's package. Rows with the same file and path should not occur; if
    they do, one of them stays. Counts (files, bytes) are taken by the write itself.
    """
    spark = artifacts.sparkSession
    staging = f"_staging-{uuid.uuid4().hex}"
    root = folder.rstrip("/")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        own = posixpath.join(base, staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        system.create_dir(own, recursive=True)
        n = 0
        for batch in batches:
            sizes, digests, places = [], [], []
            for content in batch.column("content").to_pylist():
                place = posixpath.join(own, str(n))
                with system.open_output_stream(place) as out:
                    out.write(content or b"")
                n += 1
                sizes.append(len(content or b""))
                digests.append(hashlib.sha256(content or b"").hexdigest())
                places.append(posixpath.relpath(place, base))
            columns = [batch.column("file"), batch.column("path"), batch.column("target"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(places, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "path", "target", "bytes", "sha256", "staged"])

    target = F.concat(package_of(F.col("file").cast("string")), F.lit("/"), "path")
    rows = artifacts.select(F.col("file").cast("string").alias("file"), "path", target.alias("target"), "content")
    staged = written(rows.mapInArrow(stage, "file string, path string, target string, bytes long, sha256 string, staged string"), "staged-artifacts")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for place, wanted in zip(batch.column("staged").to_pylist(), batch.column("target").to_pylist(), strict=True):
                source, goal = posixpath.join(base, place), posixpath.join(base, wanted)
                parent = posixpath.dirname(goal)
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                if system.get_file_info(source).type == fs.FileType.NotFound:
                    # an earlier attempt of this task has moved it
                    if system.get_file_info(goal).type == fs.FileType.NotFound:
                        raise OSError(f"{wanted} was neither staged nor published")
                else:
                    system.move(source, goal)
            status = pa.array(["exported"] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("file", "path", "target", "bytes", "sha256")], status], names=["file", "path", "target", "bytes", "sha256", "status"])

    counts = Observation("artifacts")
    published = staged.mapInArrow(publish, "file string, path string, target string, bytes long, sha256 string, status string")
    table = written(published.observe(counts, F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")), "artifacts")
    delete(spark, f"{root}/{staging}")
    return table, counts.get


def save_archives(artifacts: DataFrame, folder: str, name: str) -> tuple[DataFrame, dict]:
    """Write (file, path, content) into ZIP archives ``<name>-<task>-<number>.zip`` in ``folder``; returns as save() does, with the archive of each row.

    Unpacked, the archives give what save() writes. They are staged as files are, by attempts, and are moved to their places when all are written; archives of
    this ``name`` that an earlier call left are replaced. What the driver moves are archives, one for up to 10,000 rows of a task.
    """
    spark = artifacts.sparkSession
    staging = f"_staging-{uuid.uuid4().hex}"
    root = folder.rstrip("/")
    columns = ("file", "path", "target", "bytes", "sha256", "status", "archive", "staged")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        attempt = posixpath.join(staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        rows: list[tuple] = []
        held = io.BytesIO()
        archive = zipfile.ZipFile(held, "w")
        number = 0

        def closed() -> pa.RecordBatch:
            archive.close()
            own = f"{name}-{task.partitionId():06d}-{number:06d}.zip"
            system.create_dir(posixpath.join(base, attempt), recursive=True)
            with system.open_output_stream(posixpath.join(base, attempt, own)) as out:
                out.write(held.getbuffer())
            told = [*map(pa.array, zip(*rows, strict=True)), *(pa.array([x] * len(rows), pa.string()) for x in ("exported", own, posixpath.join(attempt, own)))]
            return pa.RecordBatch.from_arrays(told, names=columns)

        for batch in batches:
            for file, path, target, content in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "target", "content")), strict=True):
                content = content or b""
                archive.writestr(zipfile.ZipInfo(target), content)
                rows.append((file, path, target, len(content), hashlib.sha256(content).hexdigest()))
                if len(rows) >= ARCHIVE_MEMBERS or held.tell() >= ARCHIVE_BYTES:
                    yield closed()
                    rows, held, number = [], io.BytesIO(), number + 1
                    archive = zipfile.ZipFile(held, "w")
        if rows:
            yield closed()

    target = F.concat(package_of(F.col("file").cast("string")), F.lit("/"), "path")
    rows = artifacts.select(F.col("file").cast("string").alias("file"), "path", target.alias("target"), "content")
    counts = Observation("archives")
    staged = rows.mapInArrow(stage, "file string, path string, target string, bytes long, sha256 string, status string, archive string, staged string")
    table = written(staged.observe(counts, F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")), "archived-artifacts")

    system, base = fs.FileSystem.from_uri(root)
    system.create_dir(base, recursive=True)
    made = {r["archive"]: r["staged"] for r in table.select("archive", "staged").distinct().toLocalIterator()}
    for own, place in made.items():
        system.move(posixpath.join(base, place), posixpath.join(base, own))
    for info in system.get_file_info(fs.FileSelector(base)):
        stem = info.base_name.removesuffix(".zip").rsplit("-", 2)
        if info.type == fs.FileType.File and stem[0] == name and len(stem) == 3 and info.base_name not in made:
            system.delete_file(info.path)
    delete(spark, f"{root}/{staging}")
    return table.drop("staged"), counts.get


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, target, content): the members of all archives in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
                    rows: list[tuple[str, bytes]] = []
                    held = 0
                    for info in archive.infolist():
                        rows.append((info.filename, archive.read(info)))
                        held += info.file_size
                        if held >= ARCHIVE_BYTES // 4 or len(rows) >= ARCHIVE_MEMBERS:
                            yield told(path, rows)
                            rows, held = [], 0
                    if rows:
                        yield told(path, rows)

    def told(path: str, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        names, contents = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([posixpath.basename(path)] * len(rows)), pa.array(names), pa.array(contents, pa.binary())], names=["archive", "target", "content"])

    # tasks open the archives themselves: members are read one by one
    found = spark.read.format("binaryFile").load(folder).select("path")
    return found.mapInArrow(run, "archive string, target string, content binary")
