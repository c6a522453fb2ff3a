"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings, hashed into buckets. From a
bounded sample of labelled documents a second-order factorization machine (Rendle 2010)
learns a weight for each bucket of MIN_DOCS documents or more, and a weight for each
pair of them through short factors, so that terms which are harmless alone can
count together. A bucket's own weight is regularised by its evidence (likelihood
ratio against a bound for the number of buckets tried), the factors are not.
Texts are scored whole.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import exact_columns, hold, id_crc, materialize, release, smallest_hashes, text_batches

#: Labelled documents to learn from at most, those of the smallest id hashes.
SAMPLE_DOCS = 15_000
BUCKETS = 1 << 20
#: Sample documents that a bucket must be in to be learned from.
MIN_DOCS = 3
FACTORS = 4
EPOCHS = 25
#: Mean log loss of an epoch at which training ends.
ENOUGH = 0.01
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)
EDGES = b".,;:!?\"'()[]{}|*#$%&<>-_/"
WIDEST = 1 + len(PREFIXES)
CACHED_WORDS = 300_000
#: Bytes of the texts looked up together; a longer text is looked up alone.
PART_BYTES = 2_000_000


def word_terms(word: bytes) -> tuple[int, ...]:
    """Buckets of a lower-cased word: itself and its beginnings."""
    bare = word.strip(EDGES)
    if not bare:
        return ()
    text = None if bare.isascii() else bare.decode("utf-8", "replace")
    size = len(bare if text is None else text)
    terms, crc, at = [zlib.crc32(b"w" + bare) % BUCKETS], zlib.crc32(b"p"), 0
    for n in PREFIXES:
        if size <= n:
            break
        crc = zlib.crc32(bare[at:n] if text is None else text[at:n].encode(), crc)  # of the whole beginning
        terms.append(crc % BUCKETS)
        at = n
    return tuple(terms)


class Rows(dict):
    """word -> its row; the buckets of new words wait in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[int, ...]] = []

    def __missing__(self, word: bytes) -> int:
        terms = word_terms(word)
        self.new.append(terms + (BUCKETS,) * (WIDEST - len(terms)))
        self[word] = row = len(self)
        return row


class Terms:
    """The distinct terms of texts: their buckets, or the places that a model has for them. Remembers a bounded number of words."""

    def __init__(self, places: dict[int, int] | None = None) -> None:
        self.places = np.arange(BUCKETS + 1)
        self.places[BUCKETS] = -1
        if places is not None:
            self.places[:] = -1
            self.places[np.fromiter(places.keys(), np.int64, len(places))] = np.fromiter(places.values(), np.int64, len(places))
        self.forget()

    def forget(self) -> None:
        self.rows = Rows()
        self.table = np.empty((0, WIDEST), np.int64)

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The terms of all texts, one text behind the other, ascending in each; and how many each has."""
        found, lengths, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or b"") <= PART_BYTES):
                size += len(texts[end] or b"")
                end += 1
            for into, part in zip((found, lengths), self._part(texts[at:end]), strict=True):
                into.append(part)
            at = end
        return np.concatenate(found), np.concatenate(lengths)

    def _part(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) >= CACHED_WORDS:
            self.forget()
        ids, counts = [], []
        for text in texts:
            words = set((text or b"").lower().split())
            ids.extend(map(self.rows.__getitem__, words))
            counts.append(len(words))
        if self.rows.new:
            self.table = np.concatenate([self.table, self.places[np.array(self.rows.new)]])
            self.rows.new = []
        terms = self.table[np.array(ids, np.int64)]
        keys = (np.repeat(np.arange(len(texts)), counts)[:, None] * BUCKETS + terms)[terms >= 0]
        keys.sort()
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        return keys % BUCKETS, np.bincount(keys // BUCKETS, minlength=len(texts))


class FactorizationMachine:
    """Logistic FM, trained by AdaGrad in numpy.

    A term counts by its value with its own weight, and by one through the root
    of the text's number of terms in pairs.
    """

    def __init__(self, size: int, factors: int = FACTORS, seed: int = 3, values: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(seed)
        # place 0 stands for the constant that every text has
        self.weights = np.zeros(size + 1)
        self.values = np.concatenate([[1.0], np.ones(size) if values is None else values])
        self.vectors = rng.normal(0, 0.05, (size + 1, factors))

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.margins(self.table(), np.concatenate([np.empty(0, np.int64), *rows]), np.array([len(r) for r in rows], np.int64))

    def table(self) -> np.ndarray:
        """For each place what it adds by itself, the square of its factors, and its factors."""
        return np.column_stack([self.weights * self.values, (self.vectors**2).sum(axis=1), self.vectors])

    @staticmethod
    def margins(table: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of texts whose places, and their number, stand one behind another."""
        if not len(lengths):
            return np.zeros(0)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        terms = table[np.insert(flat + 1, starts, 0)]
        own, squares, *sums = (np.add.reduceat(x, starts + np.arange(len(starts))) for x in terms.T)
        return own + 0.5 * (sum(x * x for x in sums) - squares) / (lengths + 1)

    @staticmethod
    def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(r) + 1 for r in rows])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.concatenate([x for r in rows for x in ([-1], r)]).astype(np.int64) + 1
        return flat, starts, lengths

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4, enough: float = ENOUGH) -> None:
        """A step touches the weights of its batch's terms alone; ends early once an epoch's mean log loss is below ``enough``."""
        rng = np.random.default_rng(5)
        factors = self.vectors.T.copy()
        seen_w, seen_v = np.full_like(self.weights, 1e-6), np.full_like(factors, 1e-6)
        place = np.empty(len(self.weights), np.int32)
        for _ in range(epochs):
            order, loss = rng.permutation(len(rows)), 0.0
            for at in range(0, len(order), 256):
                part = order[at : at + 256]
                flat, starts, lengths = self._flat([rows[i] for i in part])
                marked = np.zeros(len(self.weights), bool)
                marked[flat] = True
                used = np.flatnonzero(marked)
                place[used] = np.arange(len(used), dtype=np.int32)
                inner = place[flat]

                def gather(x: np.ndarray, inner: np.ndarray = inner, starts: np.ndarray = starts) -> np.ndarray:
                    return np.add.reduceat(x[inner], starts)

                def spread(x: np.ndarray, inner: np.ndarray = inner, lengths: np.ndarray = lengths, n: int = len(used)) -> np.ndarray:
                    return np.bincount(inner, np.repeat(x, lengths), n)

                w, v, values, scale = self.weights[used], factors[:, used], self.values[used], 1 / np.sqrt(lengths)
                sums = np.stack([gather(x) for x in v]) * scale
                p = probability(gather(w * values) + 0.5 * ((sums * sums).sum(axis=0) - gather((v * v).sum(axis=0)) * scale**2))
                loss -= np.log(np.where(labels[part] == 1, p, 1 - p)).sum()
                error = (p - labels[part]) / len(part)
                grad_w = spread(error) * values + decay * w
                grad_v = np.stack([spread(error * scale * x) for x in sums]) - spread(error * scale**2) * v + decay * v
                seen_w[used] += grad_w**2
                seen_v[:, used] += grad_v**2
                self.weights[used] = w - rate * grad_w / np.sqrt(seen_w[used])
                factors[:, used] = v - rate * 0.25 * grad_v / np.sqrt(seen_v[:, used])
            if loss < enough * len(rows):
                break
        self.vectors = factors.T.copy()


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def learning_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of at most SAMPLE_DOCS labelled ids whose crc32 modulo 3 is not 1, written once."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(id_crc("doc_id") % 3 != 1)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = materialize(smallest_hashes(marked, ["doc_id"], SAMPLE_DOCS), "toxicity-sample-ids")
    # at most SAMPLE_DOCS rows of two numbers
    return materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y"), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, int], FactorizationMachine]:
    """(bucket -> place, model) from the learning sample; no labels give a model of scores near 0."""
    text_batches(docs.sparkSession)
    sample = learning_sample(docs, labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = Terms(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            flat, lengths = terms.texts(batch.column(0).cast(pa.binary()).to_pylist())
            toxic = np.repeat(batch.column(1).to_numpy() == 1, lengths)
            counts += [np.bincount(flat[toxic == y], minlength=BUCKETS) for y in (0, 1)]
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], names=["bucket", "pos", "neg"]
        )

    counted = sample.mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = min(max(positive / max(total, 1), 1e-6), 1 - 1e-6)
    n = F.col("pos") + F.col("neg")
    p = F.col("pos") / n

    def part(x, q: float):
        return F.when(x > 0, x * F.log(x / q)).otherwise(F.lit(0.0))

    gain = n * (part(p, base) + part(1 - p, 1 - base))
    counted = materialize(counted.withColumn("gain", gain), "toxicity-terms")
    tried = max(counted.count(), 1)
    # at most BUCKETS rows of two numbers
    kept = counted.where(n >= MIN_DOCS).select("bucket", "gain").toArrow().sort_by("bucket")
    places = {bucket: i for i, bucket in enumerate(kept["bucket"].to_pylist())}
    values = np.clip(kept["gain"].to_numpy() / (math.log(tried) + 2), 0, 1) ** 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(places)
        for batch in batches:
            flat, lengths = terms.texts(batch.column(0).cast(pa.binary()).to_pylist())
            found = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), found], names=["y", "places"])

    found = sample.mapInArrow(find, "y int, places array<int>").toArrow()
    lists, labels_of = found["places"].combine_chunks(), found["y"].to_numpy()
    rows = [lists[i].values.to_numpy() for i in range(len(lists))]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), labels_of[i]))
    model = FactorizationMachine(len(places), values=values)
    model.weights[0] = math.log(base / (1 - base))
    if total:
        model.fit([rows[i] for i in order], labels_of[order].astype(float))
    return places, model


_WARM: dict[str, tuple] = {}


def _warm(name: str, shared: Broadcast) -> tuple[Terms, np.ndarray, FactorizationMachine]:
    """What scoring needs of a model, made once in a worker process: later tasks find the words of earlier ones. Only the latest model is kept."""
    if name not in _WARM:
        places, model = shared.value
        _WARM.clear()
        _WARM[name] = Terms(places), model.table(), model
    return _WARM[name]


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus toxicity (0 to 1) and is_toxic (score at or above the threshold).

    Null and empty texts, having no terms, get the score of the constant alone. Long texts
    count whole; repeated rows come out as often as they went in, with one score. Columns named like an output column, in any case, are replaced, others of any name pass through; an empty table gives no rows.
    """
    spark, outputs, own = docs.sparkSession, ("toxicity", "is_toxic"), ("doc_id", "text")
    base = hold(docs, own, outputs, apart=True)
    places, model = train(base, exact_columns(labels, "doc_id", "toxic"))
    shared = spark.sparkContext.broadcast((places, model))  # at most BUCKETS rows
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, table, model = _warm(name, shared)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            scores = probability(model.margins(table, *terms.texts(texts)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array(scores >= threshold)], names=[*batch.schema.names, "toxicity", "is_toxic"]
            )

    scored = base.mapInArrow(run, StructType([*base.schema.fields]).add("toxicity", "double").add("is_toxic", "boolean"))
    return scored.select(*release(docs.columns, outputs, own), *outputs)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that toxicity_scores() does not call toxic, with all their columns as they were, whatever their names."""
    rows = hold(docs, ("doc_id", "text"), apart=True)
    return toxicity_scores(rows, labels, threshold).where("NOT is_toxic").select(*release(docs.columns, apart=("doc_id", "text")))
