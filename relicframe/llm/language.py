"""Language identification: averaged hashed subword embeddings and a linear softmax.

As in Joulin et al., "Bag of Tricks for Efficient Text Classification" (2016): a
text is the mean of its subwords' vectors. Training is stochastic gradient descent in
numpy on a bounded sample. Because mean and classifier are linear, scoring
needs only each bucket's class scores; every character of a text counts, also of texts
without white space. A temperature, fitted on held-back
sample rows, calibrates the probabilities, and a text whose best one is
under the rejection level is marked as not accepted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import exact_columns, hold, id_crc, materialize, release, small_side, text_batches

#: Documents of each language to learn from at most.
SAMPLE_PER_LANGUAGE = 1_500
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 4
#: Part of the right held-back texts that rejection may cost.
REJECTED_PART = 0.005
UNKNOWN = "und"
#: Characters that are hashed at once.
PIECE = 1 << 16
BLANKS = " \t\n\v\f\r"
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: What the characters of a whole word are multiplied by, by place.
POWERS = np.multiply.accumulate(np.full(4 * PIECE, 0x01000193, np.uint32), dtype=np.uint32)


def has_letter(text: str) -> bool:
    """Whether some character is a letter; numbers such as \u00bd or \u2167 are none."""
    return any(map(str.isalpha, text))


def pieces(text: str) -> Iterator[str]:
    """Slices of a text of at most PIECE characters, cut at white space, or within a run longer than that."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            blank = max(text.rfind(c, at + 1, end) for c in BLANKS)
            end = blank if blank > at else end
        yield text[at:end]
        at = end


def subwords(piece: str) -> np.ndarray:
    """Buckets of all words of a piece, for each the whole and its runs of 2 to 4 characters, ends marked."""
    codes = np.frombuffer(f" {piece.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (codes != 32) & ((codes < 9) | (codes > 13))
    codes = np.where(word, codes, np.uint32(1))  # the mark of both ends
    first, second, third, fourth = (codes * np.uint32(k) for k in MULTIPLIERS)
    pairs = first[:-1] + second[1:]
    triples = pairs[:-1] + third[2:]
    found = [
        pairs[word[:-1] | word[1:]],
        triples[word[1:-1]],
        (triples[:-1] + fourth[3:])[word[1:-2] & word[2:-1]],
    ]
    lengths = np.flatnonzero(word[:-1] & ~word[1:]) - np.flatnonzero(~word[:-1] & word[1:])
    if lengths.size:
        starts = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        found.append(np.add.reduceat(codes[word] * POWERS[place], starts, dtype=np.uint32))
    h = np.concatenate([f + np.uint32(i) for i, f in enumerate(found)])
    h = (h ^ (h >> 16)) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> 13)) * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> 16)) % BUCKETS).astype(np.int64)


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    counts = np.zeros(BUCKETS, np.int64)
    for piece in pieces(text):
        counts += np.bincount(subwords(piece), minlength=BUCKETS)
    return counts


class SubwordModel:
    """Class scores of a text: mean subword embedding times a linear layer."""

    def __init__(self, languages: list[str], seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
        self.linear = np.zeros((DIMENSIONS, len(languages)))
        self.temperature = 1.0
        self.level = 0.0

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float = 0.5) -> None:
        """Learn from (buckets, their counts) of each text."""
        rng = np.random.default_rng(2)
        held = np.arange(len(texts)) % 5 == 4
        learn = np.flatnonzero(~held) if len(texts) >= 50 else np.arange(len(texts))
        steps = EPOCHS * -(-len(learn) // 16)
        done = 0
        for _ in range(EPOCHS):
            order = rng.permutation(learn)
            for at in range(0, len(order), 16):
                part = order[at : at + 16]
                parts = np.zeros((len(part), BUCKETS))
                for row, i in enumerate(part):
                    parts[row, texts[i][0]] = texts[i][1] / texts[i][1].sum()
                mean = parts @ self.embedding
                error = _softmax(mean @ self.linear)
                error[np.arange(len(part)), labels[part]] -= 1
                pace = rate * (1 - done / steps)
                back = error @ self.linear.T
                self.linear -= pace * mean.T @ error
                self.embedding -= pace * (parts.T @ back)
                done += 1
        check = np.flatnonzero(held) if len(texts) >= 50 else learn
        means = np.stack([texts[i][1] @ self.embedding[texts[i][0]] / texts[i][1].sum() for i in check])
        self._calibrate(means @ self.linear, labels[check])

    def _calibrate(self, scores: np.ndarray, labels: np.ndarray) -> None:
        """The temperature of least log loss, then the level that few right answers fall under."""
        tried = np.geomspace(0.05, 20, 60)
        rows = np.arange(len(labels))
        loss = [-np.log(_softmax(scores / t)[rows, labels] + 1e-12).mean() for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])
        chance = _softmax(scores / self.temperature)
        right = chance.max(axis=1)[chance.argmax(axis=1) == labels]
        self.level = float(np.quantile(right, REJECTED_PART)) if right.size else 0.0

    def bucket_scores(self) -> np.ndarray:
        return self.embedding @ self.linear


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_scores(buckets: np.ndarray, text: str) -> np.ndarray:
    """Mean class scores of all subwords of a text."""
    sums, n = np.zeros(buckets.shape[1]), 0
    for piece in pieces(text):
        found = subwords(piece)
        n += len(found)
        if len(found) * 4 < BUCKETS:
            sums += buckets[found].sum(axis=0)
        else:
            sums += np.bincount(found, minlength=BUCKETS) @ buckets
    return sums / max(n, 1)


def learning_sample(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of each language's SAMPLE_PER_LANGUAGE smallest id hashes whose crc32 modulo 4 is not 2, written once."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(id_crc("doc_id") % 4 != 2)
    mixed = F.xxhash64("doc_id")
    # about twice the rows that are wanted pass a language's bound; the count may err by a few hundredths
    n = F.greatest(F.approx_count_distinct("doc_id"), F.lit(1))
    share = F.when(n > 4 * SAMPLE_PER_LANGUAGE, 2.0 * SAMPLE_PER_LANGUAGE / n).otherwise(1.0)
    bounds = materialize(known.groupBy("lang").agg(share.alias("share")), "language-bounds")
    near = known.select("doc_id", "lang").join(small_side(bounds, bounds.count()), "lang")
    near = near.where(mixed / F.lit(float(1 << 64)) + 0.5 <= F.col("share")).select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(mixed, "doc_id")
    ids = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_PER_LANGUAGE).select("doc_id", "lang")
    chosen = materialize(ids, "language-sample-ids")
    # at most SAMPLE_PER_LANGUAGE ids a language
    return materialize(known.select("doc_id", "lang", "text").join(small_side(chosen, chosen.count()), ["doc_id", "lang"]), "language-sample")


def train(docs: DataFrame) -> SubwordModel | None:
    """The model learned from the sample of ``docs``; None without a labelled text that has a word."""
    text_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch.column(2).to_pylist():
                n = subword_counts(text)
                found.append(np.flatnonzero(n))
                counts.append(n[found[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "lang", "found", "counts"],
            )

    sample = learning_sample(docs).select("doc_id", "lang", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(find, f"doc_id {kind}, lang string, found array<int>, counts array<int>").where("size(found) > 0").toArrow()
    if not rows.num_rows:
        return None
    order = sorted(range(rows.num_rows), key=lambda i: (zlib.crc32(str(rows["doc_id"][i].as_py()).encode()), str(rows["doc_id"][i])))
    langs = rows["lang"].to_pylist()
    languages = sorted(set(langs))
    found, counts = (rows[name].combine_chunks() for name in ("found", "counts"))
    model = SubwordModel(languages)
    place = {lang: i for i, lang in enumerate(languages)}
    model.fit([(found[i].values.to_numpy(), counts[i].values.to_numpy()) for i in order], np.array([place[langs[i]] for i in order]))
    return model


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` plus lang_pred, lang_score (calibrated probability) and lang_accepted.

    A text that is null or has no letter is ``und`` with score 0 and not
    accepted, as is every text if nothing could be learned. Long texts count whole; of equal
    chances the first language wins; repeated rows come out as often as they went in. Input columns
    named like an output column, in any case, are replaced, others of any name pass through; an empty table gives no rows.
    """
    spark, own, outputs = docs.sparkSession, ("doc_id", "text"), ("lang_pred", "lang_score", "lang_accepted")
    model = train(exact_columns(docs, "doc_id", "text", "lang"))
    compact = (model.bucket_scores(), model.languages, model.temperature, model.level) if model else None
    shared = spark.sparkContext.broadcast(compact)  # BUCKETS rows of a number a language
    base = hold(docs, own, outputs, apart=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, chances, accepted = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                if shared.value is None or text is None or not has_letter(text):
                    names.append(UNKNOWN)
                    chances.append(0.0)
                    accepted.append(False)
                    continue
                buckets, languages, temperature, level = shared.value
                chance = _softmax(text_scores(buckets, text)[None, :] / temperature)[0]
                best = int(chance.argmax())
                names.append(languages[best])
                chances.append(float(chance[best]))
                accepted.append(bool(chance[best] >= level))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(chances, pa.float64()), pa.array(accepted, pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "lang_score", "lang_accepted"],
            )

    told = base.mapInArrow(run, StructType([*base.schema.fields]).add("lang_pred", "string").add("lang_score", "double").add("lang_accepted", "boolean"))
    return told.select(*release(docs.columns, outputs, own), *outputs)
