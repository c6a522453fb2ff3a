"""Folders of files as a DataFrame, without reading what later stages do not need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.binary import field, four_cc, u32
from ..functions.text import extension, file_name

IGNORED_FOLDERS = (".git", "__MACOSX")
IGNORED_NAMES = (".DS_Store", "Icon\r")
IGNORED_SUFFIXES = ("part", "xstk")


def read_files(spark: SparkSession, folder: str, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, rel_path, extension, length, modificationTime, content) of all files below a folder.

    ``max_bytes`` is pushed to the file listing, so larger files are not opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(folder)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    top = folder.rstrip("/").split("/")[-1]
    rel = F.substring_index(F.col("path"), f"/{top}/", -1)
    parts = F.split(rel, "/")
    ignored = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_FOLDERS))) | file_name(rel).isin(*IGNORED_NAMES)
    return (
        files.withColumns({"rel_path": rel, "extension": extension(rel)})
        .where(~ignored & ~F.col("extension").isin(*IGNORED_SUFFIXES))
        .select("path", "rel_path", "extension", "length", "modificationTime", "content")
    )


def classify_files(files: DataFrame, finder_types: DataFrame | None = None) -> DataFrame:
    """``files`` plus finder_type, binary_type, binary_size, decision and reason.

    ``finder_types`` (rel_path, finder_type) comes from a side-car list, where there is one.
    """
    if finder_types is None:
        files = files.withColumn("finder_type", F.lit(""))
    else:
        files = files.join(finder_types, "rel_path", "left").withColumn("finder_type", F.coalesce("finder_type", F.lit("")))
    head = field(F.col("content"), 0, 12)
    return (
        files.withColumn("binary_size", F.when(F.col("length") >= 4, u32(head, 0)))
        .withColumn("binary_type", F.when(F.col("length") >= 8, four_cc(head, 4)).otherwise(""))
        .withColumn("said", classify.stack_decision(F.col("finder_type"), F.col("rel_path"), F.col("binary_type"), F.col("binary_size"), F.col("length")))
        .select("*", "said.decision", "said.reason")
        .drop("said")
    )


def external_files(classified: DataFrame) -> DataFrame:
    """Files that are not stacks, with kind, media type and hash."""
    kind = classify.external_kind(F.col("finder_type"), F.col("extension"), F.col("binary_type"))
    return classified.where("decision = 'skip'").select(
        "rel_path", F.col("length").alias("bytes"), "extension", "finder_type", "binary_type", "binary_size",
        F.sha2("content", 256).alias("sha256"), kind.alias("external_kind"), F.col("reason").alias("classification_reason"),
        classify.media_type(F.col("extension")).alias("media_type"),
    )


def newest(spark: SparkSession, folder: str, names: Sequence[str] = ("run.parquet",)) -> DataFrame:
    """(path) of the last changed file of the given names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(file_name(F.col("path")).isin(*names)).agg(F.max_by("path", "modificationTime").alias("path"))
