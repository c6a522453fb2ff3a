"""The registered queries themselves: the columns that they derive from what the operators return."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from relicframe.llm import queries
from relicframe.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1_fingerprints_are_hexadecimal(spark, texts):
    found = rows(spark, "op1_simhash")
    assert {r.doc_id for r in found} == set(texts) and all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 and r.fingerprint == r.fingerprint.lower() for r in found)
    by_id = {r.doc_id: int(r.fingerprint, 16) for r in found}
    for r in found:
        assert r.component_id <= r.doc_id and r.component_id in by_id


def test_op2_holds_out_by_crc(spark, texts):
    found = rows(spark, "op2_toxicity")
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op5_places_and_digests(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op5_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [ids[at : at + 2048] for at in range(0, len(ids), 2048)]
        got = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in got] == [(2048 * i, len(c), zlib.crc32(c.tobytes())) for i, c in enumerate(cut)]
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_op7_holds_out_by_crc(spark, texts):
    found = rows(spark, "op7_language")
    assert {r.doc_id for r in found} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)


def test_op10_obeys_its_law(spark, texts):
    found = rows(spark, "op10_sharding")
    assert {r.doc_id for r in found} == set(texts)
    slots, loads = defaultdict(list), defaultdict(int)
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(loads) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in found)
    assert max(loads.values()) - sum(loads.values()) / 40 <= largest


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql_equal_it(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, want = queries.QUERIES[name](spark, SF), connection.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)

    def listed(values, names):
        return sorted(tuple(repr(round(v[names.index(c)], 6)) if isinstance(v[names.index(c)], float) else str(v[names.index(c)]) for c in columns) for v in values)

    assert listed(found.collect(), found.columns) == listed(want.fetchall(), want.columns)
