"""Main jobs from a shell: scan, import, resources, rom, report."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import artifacts, records, reports, rom, rom_index, warehouse
from .sources import blocks, resfork


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="relicframe", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, text in (("scan", "print the block table of files"), ("import", "write the tables of block streams"), ("resources", "convert resource forks"), ("rom", "analyse firmware images")):
        sub = verbs.add_parser(verb, help=text)
        sub.add_argument("input")
        if verb != "scan":
            sub.add_argument("output")
        if verb == "rom":
            sub.add_argument("--base", type=lambda x: int(x, 0), default=0)
            sub.add_argument("--listings", help="folder of disassembly texts named after the images")
    report = verbs.add_parser("report", help="write a report of a warehouse")
    report.add_argument("warehouse")
    report.add_argument("run")
    report.add_argument("name", choices=sorted(reports.REPORTS))
    report.add_argument("output")
    args = parser.parse_args(argv)
    # files are written by tasks, which need a whole URI or an absolute path
    if ":" not in (output := getattr(args, "output", "") or ""):
        args.output = os.path.abspath(output)
    spark = SparkSession.builder.appName("relicframe").getOrCreate()

    def binary(folder: str):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)

    if args.verb == "scan":
        # a partition at a time, so every block is told however many there are
        for row in blocks.read_blocks(spark, args.input, payloads=False).drop("payload").orderBy("file", "seq").toLocalIterator():
            print(*("" if x is None else x for x in row), sep="\t")
    elif args.verb == "import":
        found = blocks.read_blocks(spark, args.input)
        tables = {"blocks": found.drop("payload"), "stacks": records.stacks(found), "fonts": records.fonts(found), "styles": records.styles(found), "layers": records.layers(found),
                  "parts": records.parts(found), "contents": records.contents(found), "scripts": records.scripts(found), "manifest": records.source_manifest(found)}
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{args.output}/{name}")
    elif args.verb == "resources":
        found = resfork.read_forks(binary(args.input).select(F.col("path").alias("file"), "content"))
        made, errors = artifacts.conversions(found)
        artifacts.save(made, f"{args.output}/files")
        artifacts.summaries(found, made, errors).write.mode("overwrite").parquet(f"{args.output}/summaries")
    elif args.verb == "rom":
        images = rom.identify(binary(args.input).select(F.lit(args.base).cast("long").alias("base"), "content"))
        texts = spark.createDataFrame([], "rom_id string, text string")
        if args.listings:
            texts = spark.read.text(args.listings, wholetext=True).withColumn("rom_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1)).select("rom_id", F.col("value").alias("text"))
        tables = rom.analyze(images.select("rom_id", "base", "content"), texts)
        rom.write_atlas(tables, args.output)
        bounds = tables["images"]
        regions = rom_index.regions(rom.first_bytes(images), tables["instructions"], bounds, tables["regions"].select("rom_id", "start", "end", "kind", "n", "confidence"))
        told = {**{n: tables[n] for n in ("functions", "xrefs", "traps")}, "regions": regions, "source_gaps": tables["gaps"]}
        artifacts.save(rom_index.analysis_files(images.select("rom_id", "base", "bytes", "crc32", "sha256"), told), f"{args.output}/documents")
    else:
        made = reports.REPORTS[args.name](warehouse.Warehouse(spark, args.warehouse), args.run)
        reports.ordered(made, args.name).write.mode("overwrite").option("header", True).csv(args.output)


if __name__ == "__main__":
    main()
