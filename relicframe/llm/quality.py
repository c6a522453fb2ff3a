"""Quality rules: counted base rules, then an n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into ``2**BUCKET_BITS``
buckets. One multinomial over the buckets is counted on all documents (the raw
corpus), one on the documents that ``labels.quality`` marks as good (the
trusted target). A document's score is the sum of
``log(p_target / p_raw)`` over its n-grams divided by their number, and every
document is held against one fixed threshold.

Everything is DataFrame expressions. The model is an array constant of
``2**BUCKET_BITS`` ratios, so scoring needs neither a join nor a shuffle of
texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact_columns, hold, let, release, small_side, words_of

BUCKET_BITS = 14
#: Counts added to every bucket, as a part of the mean count of a bucket.
SMOOTHING = 0.05
#: Documents whose mean log ratio is below this are rejected.
THRESHOLD = -0.06
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def base_counts(words: Column, text: Column) -> Column:
    """Struct of the counts that the base rules need, from the words of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]")) > 0)
    duplicate_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        duplicate_lines.cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
    )


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window which the text holds twice or more.

    Windows are compared by 64-bit hashes. The sort that finds the places of
    repeated windows runs only where some window repeats.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(rows: Column) -> Column:
            twice = F.filter(
                rows, lambda x, k: (F.get(rows, k - 1)["h"] == x["h"]) | F.coalesce(F.get(rows, k + 1)["h"] == x["h"], F.lit(False))
            )
            return F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))

        return F.size(F.array_distinct(let(placed, places)))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= 4, some).otherwise(F.lit(0))


def _bucket(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND((1 << BUCKET_BITS) - 1).cast("int")


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): words and word pairs of all rows of ``text``, hashed and counted."""
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    grams = texts.select(words_of(F.col("text")).alias("w")).select(F.inline(pairs).alias("a", "b"))
    buckets = F.array(_bucket(F.col("a")), F.when(F.col("b").isNotNull(), _bucket(F.col("a"), F.col("b"))))
    return grams.select(F.explode(buckets).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(p_target / p_raw) of every bucket, from all documents and all trusted ones.

    The driver gets two counts a bucket. Without trusted documents there
    is nothing to compare with and every ratio is 0.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = docs.join(small_side(good, good.count()), "doc_id", "left_semi")
    size = 1 << BUCKET_BITS
    counts = {}
    for name, texts in (("raw", docs), ("target", trusted)):
        counts[name] = [0] * size
        for row in bucket_counts(texts).collect():
            counts[name][row["bucket"]] = row["n"]
    sums = {name: sum(n) for name, n in counts.items()}
    if not sums["target"]:
        return [0.0] * size

    def share(name: str, bucket: int) -> float:
        extra = SMOOTHING * sums[name] / size
        return (counts[name][bucket] + extra) / (sums[name] + size * extra)

    return [math.log(share("target", b) / share("raw", b)) for b in range(size)]


def ratio_literal(ratios: list[float]) -> Column:
    """The model as one array constant (folded once, when the query is planned)."""
    return F.split(F.lit(" ".join(f"{r:.5f}" for r in ratios)), " ").cast("array<float>")


def score(words: Column, ratios: Column) -> Column:
    """Mean log ratio over the n-grams of a text; 0 for one without words."""
    last = F.size(words) - 1

    def step(acc: Column, i: Column) -> Column:
        word = F.get(words, i)
        pair = F.when(i < last, F.get(ratios, _bucket(word, F.get(words, i + 1)))).otherwise(F.lit(0.0))
        return acc + F.get(ratios, _bucket(word)) + pair

    total = F.aggregate(F.sequence(F.lit(0), last), F.lit(0.0), step)
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus the base counts, base_failed, score and kept.

    A null text counts as empty: no words, base_failed, not kept. Labels of
    absent or null ids count for nothing; a label repeated counts once. Long texts count whole; repeated
    rows come out as often as they went in. Input columns named like an output column, in any case, are replaced, others of any name
    pass through; an empty table gives no rows.
    """
    ratios = ratio_literal(log_ratios(exact_columns(docs, "doc_id", "text"), exact_columns(labels, "doc_id", "quality")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    outputs = (*counts, "base_failed", "score", "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = hold(docs, ("text",), outputs).select(
        "held",
        let(
            F.struct(words_of(F.col("text")).alias("w"), ratios.alias("r")),
            lambda x: F.struct(base_counts(x["w"], text).alias("base"), score(x["w"], x["r"]).alias("score")),
        ).alias("judged"),
    )
    n_words, repeated = F.col("judged.base.n_words"), F.col("judged.base.n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n_words)
    kept = ~failed & (F.col("judged.score") >= threshold)
    return judged.select(
        *release(docs.columns, outputs), *[F.col("judged.base")[c].alias(c) for c in counts], F.col("judged.score").alias("score"), failed.alias("base_failed"), kept.alias("kept")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that quality_rules() keeps, with all their columns as they were, whatever their names."""
    rows = hold(docs, ("doc_id", "text"), apart=True)
    return quality_rules(rows, labels, threshold).where("kept").select(*release(docs.columns, apart=("doc_id", "text")))
