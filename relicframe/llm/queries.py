"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, filters, language, mixing, packing, quality, sharding, simhash, token_counts, toxicity, vectors, warc
from .common import id_crc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), F.col("toxicity").alias("score"), F.col("is_toxic").cast("int").alias("predicted")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return told.select(
        "doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_accepted"
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return placed.select(
        "doc_id", "size",
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ("doc_id",))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_warc": op8_warc,
    "op9_near_vectors": op9_near_vectors,
    "op10_sharding": op10_sharding,
    "op11_decontamination": op11_decontamination,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroids": op13_centroids,
}

MIXING_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    c AS (SELECT *, least(CAST(floor(log2(size + 1) * 4 + 1e-9) AS INT), {mixing.SIZE_CLASSES - 1}) AS class,
                 CAST(floor(CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / {1 << 48}.0 * (SELECT greatest({mixing.CELLS}, ceil(count(*) / {mixing.CELL_DOCS}.0)) FROM documents)) AS INT) AS cell FROM d),
    s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY k = '', k) - 1) % {len(mixing.WEIGHTS)} + 1 AS weight FROM c GROUP BY k),
    t AS (SELECT *, source_size * {mixing.MAX_REPEATS} AS cap, source_size * {mixing.MAX_REPEATS} / weight AS ratio FROM s),
    v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, k = '', k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, k = '', k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM t),
    w AS (SELECT *, least((SELECT level FROM v WHERE level * weight <= cap ORDER BY ratio, level LIMIT 1) * weight, CAST(cap AS DOUBLE)) AS target,
                 CAST('0x' || substr(md5('{mixing.SEED}:' || k || ':offset'), 1, 12) AS BIGINT) / {1 << 48}.0 AS start FROM v),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY class, cell, size, doc_id) AS rank FROM c),
    j AS (SELECT n.*, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM n JOIN w USING (k))
    SELECT doc_id, size, source_size, target,
           CAST(least(floor(rate * rank + start) - floor(rate * (rank - 1) + start), {mixing.MAX_REPEATS}) * size AS BIGINT) AS taken FROM j"""

WARC_SQL = f"""
    WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, NULLIF(first, page_id) AS refers_to FROM f"""

VECTORS_SQL = f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= {vectors.COSINE}),
    r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
    c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
    i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark),
    p AS (SELECT DISTINCT item, list_aggregate(list_slice(w, s, s + {decontamination.WINDOW - 1}), 'string_agg', ' ') AS g, least(len(w), {decontamination.WINDOW}) AS n
          FROM (SELECT *, unnest(range(1, greatest(len(w) - {decontamination.WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    k AS (SELECT DISTINCT n FROM p),
    o AS (SELECT r, s, item, p.n FROM (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, k WHERE len(w) >= n) x
          JOIN p ON p.n = x.n AND p.g = list_aggregate(list_slice(w, s, s + x.n - 1), 'string_agg', ' ')),
    h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT r, s, n FROM o)) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""

_FAILS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate((
    f"n < {filters.MIN_WORDS}", f"100 * u < {filters.MIN_DISTINCT_PERCENT} * n", f"100 * c > {filters.MAX_CAPITAL_PERCENT} * length(t)",
    f"regexp_matches(t, '{filters.SYMBOLS}')", "doc_id > min(doc_id) OVER (PARTITION BY t)")))
FILTERS_SQL = f"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    q AS (SELECT *, len(w) AS n, len(list_distinct(w)) AS u, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS c FROM w),
    m AS (SELECT q.doc_id, part, {_FAILS} AS mask FROM q),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
    f AS (SELECT unnest(range(5)) AS b),
    o AS (SELECT a.b AS b1, b.b AS b2, c.b AS b3, d.b AS b4, 10 - a.b - b.b - c.b - d.b AS b5 FROM f a, f b, f c, f d
          WHERE a.b NOT IN (b.b, c.b, d.b) AND b.b NOT IN (c.b, d.b) AND c.b != d.b),
    s AS (SELECT chr(CAST(65 + b1 AS INT)) || chr(CAST(65 + b2 AS INT)) || chr(CAST(65 + b3 AS INT)) || chr(CAST(65 + b4 AS INT)) || chr(CAST(65 + b5 AS INT)) AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
    e AS (SELECT *, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
                 (SELECT CAST(coalesce(sum(1 << x), 0) AS INT) FROM (SELECT unnest([0, 1, 2, 3, 4]) AS x) y WHERE strpos(filter_order, chr(CAST(65 + x AS INT))) < step) AS before FROM s),
    r AS (SELECT part, filter_order, step, letter, CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
                 CAST(sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                 CAST(sum(CASE WHEN mask & before != 0 AND mask & bit != 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
                 CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                 CAST(sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                 CAST(sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
          FROM c, e GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""


def centroids_sql(clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    """Rounds of assignment and means, written out one after another."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(x * {centroids.SCALE}) AS BIGINT)) AS v FROM embeddings
             WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
        e AS MATERIALIZED (SELECT vec_id, unnest(range(1, {centroids.DIMENSIONS + 1})) AS j, unnest(v) AS x FROM v),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS c FROM v ORDER BY c LIMIT {clusters}),
        c0 AS MATERIALIZED (SELECT c, j, x FROM e JOIN s USING (vec_id))"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, [d, c]) AS c, min(d) AS d FROM (SELECT vec_id, c{i}.c, CAST(sum((e.x - c{i}.x) * (e.x - c{i}.x)) AS BIGINT) AS d FROM e JOIN c{i} USING (j) GROUP BY vec_id, c{i}.c) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, o.j, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN
                (SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT a{i}.c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{i} USING (vec_id) GROUP BY a{i}.c, j)) m ON m.c = o.c AND m.j = o.j)""")
    return f"""WITH {', '.join(steps)}, h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"""


ORACLES: dict[str, str] = {
    "op6_mixing": MIXING_SQL,
    "op8_warc": WARC_SQL,
    "op9_near_vectors": VECTORS_SQL,
    "op11_decontamination": CONTAMINATION_SQL,
    "op12_filter_audit": FILTERS_SQL,
    "op13_centroids": centroids_sql(),
}
