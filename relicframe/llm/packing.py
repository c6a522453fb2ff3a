"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Documents become pieces of at most ``capacity`` ids. Pieces are dealt to
partitions by a hash and taken in hash order, a random order that any rerun repeats; the bytes of the texts alone
decide the number of partitions. Each partition
keeps a fixed number of open bins, filed by free space: a piece goes into the
bin with the least free space that takes it, found by one shift of a bitset
over free sizes; when too many bins are open, the fullest closes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_columns, text_batches
from .tokens import default_path, word_ids

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 256
#: Bytes of text a partition, and documents: its last bins leave little free against so many, and one task sorts them.
PARTITION_BYTES = 32 << 20
PARTITION_DOCS = 1 << 17
BATCH_BYTES = 4 << 20


class BestFit:
    """Bounded-space online best fit: place(length) -> (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.bins = 0

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def _narrow(data: bytes) -> bytes:
    """Ids in 16 bits each, where all of them fit."""
    ids = np.frombuffer(data, "<u4")
    return ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else data


def _widened(data: bytes, length: int) -> bytes:
    return np.frombuffer(data, "<u2").astype("<u4").tobytes() if len(data) == 2 * length else data


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, narrow: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian 32-bit, END_ID last in a document. With ``narrow``, a piece whose ids all fit has them in 16 bits."""
    text_batches(docs.sparkSession)
    path = tokenizer or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        end = np.asarray([END_ID], ids.kind).tobytes()
        step = ids.width * capacity

        def out(batch: pa.RecordBatch, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            at, number, data = zip(*rows, strict=True)
            number = np.asarray(number, np.int32)
            length = np.fromiter(map(len, data), np.int64, len(data)) // ids.width
            if ids.width == 2 and not narrow:
                data = list(map(_widened, data, length.tolist()))
            elif ids.width == 4 and narrow:
                data = list(map(_narrow, data))
            columns = [batch.column(0).take(pa.array(at)), pa.array(number), pa.array(number.astype(np.int64) * capacity)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(length), pa.array(data, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"]
            )

        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            held = 0
            for i, found in enumerate(ids.texts(batch.column(1))):
                data = found + end
                for number, at in enumerate(range(0, len(data), step)):
                    rows.append((i, number, data[at : at + step]))
                    held += step
                    if held >= BATCH_BYTES:
                        yield out(batch, rows)
                        rows, held = [], 0
            if rows:
                yield out(batch, rows)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """The pieces of all documents with sequence_id and offset, gapless in each sequence.

    A null or empty text is one piece of the end id. A long text gives as many pieces as it fills; of
    bins with equal free space the latest takes a piece. Repeated rows are packed as often as they occur and are
    interchangeable. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    docs = exact_columns(docs, "doc_id", "text")
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n_bytes // PARTITION_BYTES), -(-n_docs // PARTITION_DOCS))
    order = F.xxhash64("doc_id", "piece", "length")
    # narrow on their way: a task sorts its pieces with their ids
    cut = pieces(docs, tokenizer, capacity, narrow=True).withColumn("order", order)
    dealt = cut.repartition(parts, "order").sortWithinPartitions("order", "doc_id", "piece").drop("order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            placed = [fit.place(n) for n in lengths]
            bins, offsets = zip(*placed, strict=True) if placed else ((), ())
            at = batch.schema.get_field_index("ids")
            ids = pa.array(map(_widened, batch.column(at).to_pylist(), lengths), pa.binary())
            batch = batch.set_column(at, "ids", ids)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + x for x in bins], pa.int64()), pa.array(offsets, pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, pieces joined in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")
    )
