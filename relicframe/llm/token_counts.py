"""Exact token totals for every context limit, from one length histogram.

Documents are encoded whole and counted by length. Sums over the histogram answer
all questions about lengths: documents and tokens in all, quantiles, and
how many tokens stay when texts are cut at a limit. The sums run within
blocks of lengths and then over the few block totals, so no task takes the
whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_batches
from .tokens import default_path, word_ids

#: Lengths a block: its window takes that many rows at most.
BLOCK = 128


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens): the encoded length of every whole text, a row a document.

    Null and empty texts have none; repeated rows count as often as they occur; other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for batch in batches:
            lengths = np.fromiter((len(found) // ids.width for found in ids.texts(batch.column(0))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(lengths)], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row for each length that occurs, with sums on either side of it.

    n_docs; docs_upto and tokens_upto (this length and shorter);
    docs_longer and tokens_longer; truncated_total, the tokens that stay when
    every text is cut at this length; quantile, the part of documents no longer
    than this. An empty table gives no rows.
    """
    counts = materialize(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-counts")
    counts = counts.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(below), F.lit(0)).alias("docs_below"),
        F.coalesce(F.sum("block_tokens").over(below), F.lit(0)).alias("tokens_below"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("all_tokens"),
    )
    upto = Window.partitionBy("block").orderBy("n_tokens")
    return (
        counts.join(blocks, "block")
        .withColumn("docs_upto", F.col("docs_below") + F.sum("n_docs").over(upto))
        .withColumn("tokens_upto", F.col("tokens_below") + F.sum("tokens").over(upto))
        .withColumn("docs_longer", F.col("all_docs") - F.col("docs_upto"))
        .withColumn("tokens_longer", F.col("all_tokens") - F.col("tokens_upto"))
        .withColumn("truncated_total", F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_longer"))
        .withColumn("quantile", F.col("docs_upto") / F.col("all_docs"))
        .select(
            "n_tokens", "n_docs", "docs_upto", "tokens_upto", "docs_longer", "tokens_longer", "truncated_total", "quantile"
        )
    )


def total_at(histogram: DataFrame, limit: int) -> DataFrame:
    """(n_docs, truncated_total) when every text is cut at any ``limit``, occurring or not."""
    kept = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return histogram.agg(F.sum("n_docs").alias("n_docs"), F.coalesce(F.sum(kept), F.lit(0)).alias("truncated_total"))
