"""What packing holds at once: ids are narrow on their way."""

import numpy as np

from relicframe.llm import packing


def test_ids_are_narrow_where_they_fit():
    few, wide = np.asarray([1, 65535, 0], "<u4").tobytes(), np.asarray([65536, 0], "<u4").tobytes()
    assert len(packing._narrow(few)) == 6 and packing._narrow(wide) == wide
    assert packing._widened(packing._narrow(few), 3) == few and packing._widened(wide, 2) == wide


def test_packed_ids_are_the_pieces(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate((0, 3, 2500, 40))] + [(9, None)], "doc_id long, text string")
    want = {(r.doc_id, r.piece): bytes(r.ids) for r in packing.pieces(docs).collect()}
    narrow = packing.pieces(docs, narrow=True).collect()
    assert all(len(r.ids) == 2 * r.length for r in narrow)
    assert {(r.doc_id, r.piece): bytes(r.ids) for r in packing.pack(docs).collect()} == want
