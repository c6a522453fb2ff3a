"""Resource forks as rows: one for each resource, by column expressions over the fork's bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import RESOURCE_ATTRIBUTES, field, four_cc, i16, pascal_string, set_bits, u16, u32


def fork_headers(forks: DataFrame) -> DataFrame:
    """(file, content) plus data_off, map_off, data_len, map_len and status of the header."""
    c = F.col("content")
    heads = forks.withColumns({"data_off": u32(c, 0), "map_off": u32(c, 4), "data_len": u32(c, 8), "map_len": u32(c, 12)})
    size = F.octet_length(c)
    inside = (F.col("data_off") + F.col("data_len") <= size) & (F.col("map_off") + F.col("map_len") <= size)
    status = (
        F.when(c.isNull() | (size == 0), "missing_or_empty").when(size < 16, "too_short").when(~inside, "invalid_header_bounds")
        .when(F.col("map_off") + 30 > size, "truncated_map").otherwise("ok")
    )
    return heads.withColumn("status", status)


def read_forks(forks: DataFrame) -> DataFrame:
    """Resources of (file, content) rows: type, id, name, attributes, place, size, sha256, status, data.

    A resource whose data lies outside the data area has status invalid_data_bounds and null data;
    forks with a bad header give no rows (see fork_headers).
    """
    c = F.col("content")
    heads = fork_headers(forks).where("status = 'ok'").drop("status")
    heads = heads.withColumns({"types_at": (F.col("map_off") + u16(c, (F.col("map_off") + 24).try_cast("int"))).try_cast("int"), "names_at": (F.col("map_off") + u16(c, (F.col("map_off") + 26).try_cast("int"))).try_cast("int")})
    n_types = ((u16(c, F.col("types_at")) + 1) % 65536).try_cast("int")
    typed = heads.where(n_types > 0).withColumn("t", F.explode(F.sequence(F.lit(0), n_types - 1)))
    typed = typed.withColumn("entry", F.col("types_at") + 2 + 8 * F.col("t")).where(F.col("entry") + 8 <= F.octet_length(c))
    typed = typed.withColumns({"type": four_cc(c, F.col("entry")), "n": u16(c, F.col("entry") + 4).try_cast("int") + 1, "refs_at": (F.col("types_at") + u16(c, F.col("entry") + 6)).try_cast("int")})
    refs = typed.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("ref", F.col("refs_at") + 12 * F.col("r"))
    refs = refs.where(F.col("ref") + 12 <= F.octet_length(c))
    word = u32(c, F.col("ref") + 4)
    name_at = i16(c, F.col("ref") + 2)
    refs = refs.withColumns({
        "id": i16(c, F.col("ref")).try_cast("int"), "attributes": F.shiftright(word, 24).try_cast("int"), "data_at": (F.col("data_off") + word % (1 << 24)).try_cast("int"),
        "name": F.when(name_at != -1, pascal_string(c, (F.col("names_at") + name_at).try_cast("int"))).otherwise(F.lit("")),
    })
    refs = refs.withColumn("bytes", u32(c, F.col("data_at")))
    good = (F.col("data_at") + 4 <= F.octet_length(c)) & (F.col("data_at") + 4 + F.col("bytes") <= F.col("data_off") + F.col("data_len"))
    data = F.when(good, field(c, F.col("data_at") + 4, F.col("bytes").try_cast("int")))
    return refs.select(
        "file", "type", "id", F.coalesce("name", F.lit("")).alias("name"), "attributes", set_bits(F.col("attributes"), RESOURCE_ATTRIBUTES).alias("attribute_names"),
        (F.col("data_at") + 4).alias("payload_offset"), F.when(good, F.col("bytes")).alias("payload_bytes"), F.sha2(data, 256).alias("payload_sha256"),
        F.when(good, "ok").otherwise("invalid_data_bounds").alias("status"), data.alias("data"), (F.col("t") * 65536 + F.col("r")).alias("order"),
    )


def resource_counts(resources: DataFrame) -> DataFrame:
    return resources.groupBy("file", "type").agg(F.count("*").alias("n"))


#: Where the fork of a file lies beside it (fixed values).
SIDE_CARS = ("/..namedfork/rsrc", ".rsrc")


def side_cars(files: DataFrame) -> DataFrame:
    """(file, content): of files (path, content), each that is no fork, with the bytes of its fork; null where it has none.

    Of several side-cars the one named first in SIDE_CARS counts. A fork without its file is left out.
    """
    path = F.col("path")
    of = F.lit(None).cast("string")
    rank = F.lit(None).cast("int")
    for i, suffix in enumerate(SIDE_CARS):
        ends = F.endswith(path, F.lit(suffix))
        of = F.coalesce(of, F.when(ends, F.left(path, F.length(path) - len(suffix))))
        rank = F.coalesce(rank, F.when(ends, i))
    named = files.select("path", "content", of.alias("of"), rank.alias("rank"))
    forks = named.where("of IS NOT NULL").select(F.col("of").alias("file"), "rank", "content")
    first = forks.groupBy("file").agg(F.min("rank").alias("rank"))
    chosen = forks.join(first, ["file", "rank"]).dropDuplicates(["file"]).drop("rank")
    return named.where("of IS NULL").select(F.col("path").alias("file")).join(chosen, "file", "left")


def fork_statuses(forks: DataFrame) -> DataFrame:
    """(file, status, fork_bytes, n_resources) of (file, content) rows, content being null where there is no fork.

    missing_or_empty without bytes, empty without a resource, parse_failed if the data of one lies outside, else ok.
    """
    found = read_forks(forks.where("content IS NOT NULL")).groupBy("file").agg(F.count("*").alias("n"), F.bool_or(F.col("status") != "ok").alias("bad"))
    joined = forks.select("file", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("fork_bytes")).join(found, "file", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    status = F.when(F.col("fork_bytes") == 0, "missing_or_empty").when(n == 0, "empty").when(F.col("bad"), "parse_failed").otherwise("ok")
    return joined.select("file", status.alias("status"), "fork_bytes", n.alias("n_resources"))
