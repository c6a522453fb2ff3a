"""Benchmark decontamination: an FM-index per training shard, searched for phrases of the benchmark.

A task gathers documents into shards of bounded size and indexes a shard's words
(``fmindex``): words of no phrase are breaks, and stretches between breaks that
are shorter than every phrase are left out, as no phrase fits in. All phrases are searched backward at once, occurrences
are located by sampled suffix positions, and overlapping ones are merged into spans to
remove. A document lies in one shard, so documents are neither shuffled nor joined.

Phrases reach the tasks in blocks of at most BLOCK_WORDS words of benchmark items. A benchmark
of one block is searched in one pass; each further block is another pass,
whose hits, keyed by a digest of the text, are merged by SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, materialize, release, small_side
from .fmindex import FmIndex

WINDOW = 10
#: A shard is closed at so many bytes of text; a longer text is a shard of its own.
SHARD_BYTES = 48 << 20
#: Words of benchmark items that one broadcast holds, and of one piece of an item.
BLOCK_WORDS, PIECE_WORDS = 500_000, 50_000
#: Phrases that are searched at once.
STEP = 100_000
#: Bytes between words: all ASCII but letters and digits. A-Z become a-z, and others stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A word, for SQL.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SPANS = "array<struct<start:long,end:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span of words (start, end)."""
    inside = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : starts[start]])
        at = ends[end - 1]
    return b"".join([*out, text[at:]])


def item_pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, words, n): the words of items, space-joined, in pieces that lose no window."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                for at in range(0, max(min(1, len(words)), len(words) - window + 1), PIECE_WORDS):
                    piece = words[at : at + PIECE_WORDS + window - 1]
                    rows.append({"item": item, "words": b" ".join(piece).decode("utf-8", "replace"), "n": len(piece)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.string()), ("words", pa.string()), ("n", pa.int64())]))

    rows = hold(benchmark, ("item_id", "text")).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(pieces, "item string, words string, n long").distinct()


class Phrases:
    """The distinct windows of some items: word ids in rows, lengths, and the items that hold each."""

    def __init__(self, pieces: list[tuple[str, str]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in pieces})
        numbers = {item: i for i, item in enumerate(self.items)}
        rows, lengths, owners = [], [], []
        for item, text in pieces:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.encode().split(b" ")], np.int32)
            own = np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else np.pad(ids, (0, window - len(ids)))[None]
            rows.append(own)
            lengths.append(np.full(len(own), min(window, len(ids)), np.int32))
            owners.append(np.full(len(own), numbers[item], np.int32))
        all_rows = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.rows, first, phrase = np.unique(all_rows, axis=0, return_index=True, return_inverse=True)
        self.lengths = np.concatenate(lengths)[first] if rows else np.zeros(0, np.int32)
        links = np.unique(np.stack([phrase.ravel(), np.concatenate(owners)]), axis=1) if rows else np.zeros((2, 0), np.int32)
        self.owners = links[1]
        self.first_owner = np.searchsorted(links[0], np.arange(len(self.rows) + 1))
        self.least = int(self.lengths.min()) if rows else 0


def _stretches(ids: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, places): stretches of ``least`` known words and more within a document, each ended by a 0, and their places in ``ids``."""
    known = ids > 0
    same = known[1:] & known[:-1]
    same[edges[(edges > 0) & (edges < len(ids))] - 1] = False
    begins = np.flatnonzero(known & np.concatenate([[True], ~same]))
    ends = np.flatnonzero(known & np.concatenate([~same, [True]])) + 1
    long = ends - begins >= least
    begins, ends = begins[long], ends[long]
    sizes = ends - begins + 1
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
    symbols = ids[np.minimum(places, len(ids) - 1)]
    symbols[np.cumsum(sizes) - 1] = 0
    return symbols, places


def shard_hits(documents: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """(spans, item numbers) of each document of a shard, given by its words' ids."""
    edges = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in documents]
    items: list[list[int]] = [[] for _ in documents]
    ids = np.concatenate(documents) if documents else np.zeros(0, np.int32)
    symbols, places = _stretches(ids, edges, phrases.least) if len(ids) and phrases.least else (np.zeros(0), None)
    if not len(symbols):
        return spans, items
    index = FmIndex(symbols, len(phrases.vocabulary) + 1)
    # document d's words are moved on by d, so that a word in no span lies between documents
    change, pairs, moved = np.zeros(len(ids) + len(documents) + 1, np.int32), [], edges + np.arange(len(edges))
    for at in range(0, len(phrases.rows), STEP):
        which, found = index.occurrences(phrases.rows[at : at + STEP], phrases.lengths[at : at + STEP])
        which, start = which + at, places[found]
        document = np.searchsorted(edges, start, "right") - 1
        np.add.at(change, start + document, 1)
        np.add.at(change, start + document + phrases.lengths[which], -1)
        pairs.append(np.unique(np.stack([document, which]), axis=1))
    inside = np.concatenate([[False], np.cumsum(change) > 0])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = turns[::2], turns[1::2]
    owner = np.searchsorted(moved, begins, "right") - 1
    for d, s, e in np.stack([owner, begins - moved[owner], ends - moved[owner]], axis=1).tolist():
        spans[d].append((s, e))
    document, which = np.concatenate(pairs, axis=1)
    counts = phrases.first_owner[which + 1] - phrases.first_owner[which]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owners = phrases.owners[np.repeat(phrases.first_owner[which], counts) + within]
    for d, item in np.unique(np.stack([np.repeat(document, counts), owners]), axis=1).T.tolist():
        items[d].append(item)
    return spans, items


def searcher(told, carried: tuple[str, ...], clean: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task that searches shards of the rows of ``text`` for the phrases broadcast in ``told``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = told.value
        number = phrases.vocabulary.get
        held: list[pa.RecordBatch] = []
        documents: list[np.ndarray] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            spans, items = shard_hits(documents, phrases)
            at = 0
            for batch in held:
                n = batch.num_rows
                own = {
                    "n_words": pa.array([len(d) for d in documents[at : at + n]], pa.int64()),
                    "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans[at : at + n]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "items": pa.array([[phrases.items[i] for i in x] for x in items[at : at + n]], pa.list_(pa.string())),
                }
                if clean:
                    texts = [None if not t.is_valid else cut_spans(t.as_buffer().to_pybytes(), s).decode("utf-8", "replace") for t, s in zip(batch.column("text"), spans[at : at + n], strict=True)]
                    own["clean_text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *own.values()], names=[*carried, *own])
                at += n
            held.clear()
            documents.clear()

        for batch in batches:
            texts = batch.column("text")
            kept = batch if clean else batch.select(list(carried))
            begun = 0
            for i, text in enumerate(texts):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                documents.append(np.fromiter(map(number, words, repeat(0)), np.int32, len(words)))
                size += len(text.as_buffer()) if text.is_valid else 0
                if size >= SHARD_BYTES:
                    held.append(kept.slice(begun, i + 1 - begun))
                    begun, size = i + 1, 0
                    yield from shard()
            if begun < batch.num_rows:
                held.append(kept.slice(begun))
        yield from shard()

    return search


def merged_spans(spans):
    """Overlapping and touching spans joined, as an expression."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(x["start"] <= last["end"], joined).otherwise(F.concat(acc, F.array(x)))

    ordered = F.array_sort(spans)
    return F.when(F.size(spans) == 0, spans).otherwise(F.aggregate(ordered, F.slice(ordered, 1, 1), step))


def find_contamination(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] | None = None, window: int = WINDOW, clean: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of ``docs`` (or those of ``columns``) plus n_words, n_hit, spans, items, contaminated.

    Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased.
    A phrase is a window of ``window`` words of an item, or the words of a shorter item. ``spans`` are the words to remove, as (start, end) numbers;
    ``items`` are the item_ids, as sorted texts, of which some phrase occurs. With ``clean`` there is clean_text too: the text without its spans.

    A null text has no words; an empty one neither. Null texts and texts without words of the benchmark give no phrase; a null item_id counts as an empty text, rows of one
    item_id as one item. Repeated rows come out as often as they went in; very long texts count whole, in a
    shard of their own; empty tables give no rows, or no hits. Input columns named like an output column are replaced, others of any name pass through.
    """
    outputs = ("n_words", "n_hit", "spans", "items", "contaminated", "clean_text")
    pieces = materialize(item_pieces(benchmark, window), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = 1 if total <= block_words else math.ceil(2 * total / block_words)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    names = [c for c in docs.columns if columns is None or c in columns]
    rows = hold(docs, ("text",), [*outputs, *(c for c in docs.columns if c not in names)])
    through = [*outputs, *(c for c in docs.columns if c not in names)]
    held_type = rows.schema["held"].dataType.simpleString()
    more = ", clean_text string" if clean else ""
    context = docs.sparkSession.sparkContext

    def searched(table: DataFrame, block: int, carried: dict[str, str], cleaned: bool) -> tuple[DataFrame, object]:
        found = dealt.where(F.col("block") == block).select("item", "words").collect()  # about block_words words at most
        told = context.broadcast(Phrases([tuple(r) for r in found], window))
        schema = ", ".join(f"{c} {kind}" for c, kind in carried.items()) + f", n_words long, spans {SPANS}, items array<string>" + (more if cleaned else "")
        return table.select(*carried, "text").mapInArrow(searcher(told, tuple(carried), cleaned), schema), told

    if blocks == 1:
        out, _ = searched(rows, 0, {"held": held_type}, clean)
    else:
        keyed = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
        hits = []
        for block in range(blocks):
            found, told = searched(keyed, block, {"digest": "string"}, False)
            hits.append(materialize(found.where(F.size("spans") > 0).select("digest", "spans", "items").dropDuplicates(["digest"]), "block-hits"))
            told.destroy()
        union = hits[0]
        for other in hits[1:]:
            union = union.unionByName(other)
        # a row a block and digest
        merged = materialize(union.groupBy("digest").agg(merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits")
        joined = keyed.join(small_side(merged, merged.count()), "digest", "left")
        spans = F.coalesce("spans", F.array().cast(SPANS))
        out = joined.select("held", "text", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        out = out.mapInArrow(cleaner, f"held {held_type}, n_words long, spans {SPANS}, items array<string>, clean_text string") if clean else out
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(
        *release(docs.columns, through), "n_words", n_hit.alias("n_hit"), "spans", F.array_sort("items").alias("items"), (F.size("spans") > 0).alias("contaminated"), *(["clean_text"] if clean else [])
    )


def cleaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task that cuts the spans out of texts."""
    for batch in batches:
        spans = [[(s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
        texts = [cut_spans(t.as_buffer().to_pybytes(), s).decode("utf-8", "replace") if t.is_valid else None for t, s in zip(batch.column("text"), spans, strict=True)]
        columns = ["held", "n_words", "spans", "items"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(texts, pa.string())], names=[*columns, "clean_text"])
