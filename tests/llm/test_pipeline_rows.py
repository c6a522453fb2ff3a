"""The stages on odd rows, and against brute force that shares no code with them but what was learned."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from relicframe.llm import quality, sharding, toxicity
from relicframe.llm.tokens import default_path

from .test_operators import DOCS, brute_base, brute_components, brute_fingerprint, brute_targets, odd_documents, real

STAGES = dict(corpus_pipeline.STAGES)
CLASHES = ["score", "SIZE", "a.b", "Kept", "held", "judged", "toxicity", "is_toxic", "fp", "root", "copies", "c0", "TEXT", "stays", "doc"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with the odd rows and labels for some of them."""
    out = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_documents(), DOCS).write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, int(i % 7 == 0)) for i in range(137)] + [(None, 1, 1), (3, None, None), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_stages_leave_columns_of_any_name_alone(spark, folder, name):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])
    found = STAGES[name](spark, docs, folder)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
    assert Counter((r[0], r[1]) for r in rows) == Counter((r[0], r[1]) for r in STAGES[name](spark, plain, folder).collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_without_rows(spark, folder, name):
    empty = spark.createDataFrame([], DOCS)
    assert STAGES[name](spark, empty, folder).count() == 0


def test_packing_stage_with_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["piece", "LENGTH", "ids", "DOC_ID", "a.b", "Text"]
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    with_names = docs.select("*", *[F.lit(n).alias(n) for n in names])
    assert Counter(map(key, STAGES["packing"](spark, with_names, folder).collect())) == Counter(map(key, STAGES["packing"](spark, docs, folder).collect()))


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = real(spark, "documents", "0.001"), real(spark, "labels", "0.001")
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    labels.write.parquet(f"{tmp_path}/in/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    marks = {r.doc_id: r for r in labels.collect()}
    sf_dir = f"{tmp_path}/in"

    def run(name, frame):
        STAGES[name](spark, frame, sf_dir).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    # quality: base rules, then the mean of log ratios of hashed words and pairs
    import xxhash

    size, grams = 1 << quality.BUCKET_BITS, {}
    for d, r in rows.items():
        w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in r.text.split()]
        grams[d] = [h % size for h in w + [xxhash.xxh64_intdigest(b.encode(), a) for a, b in zip(w, r.text.split()[1:], strict=False)]]
    raw = Counter(itertools.chain(*grams.values()))
    good = Counter(itertools.chain(*(g for d, g in grams.items() if d in marks and marks[d].quality == 1)))
    share = lambda c, g: (c[g] + quality.SMOOTHING * c.total() / size) / (c.total() * (1 + quality.SMOOTHING))
    kept = set()
    for d, r in rows.items():
        n_words, _, _, _, repeated = brute_base(r.text)
        score = sum(math.log(share(good, g) / share(raw, g)) for g in grams[d]) / max(1, len(grams[d]))
        if n_words >= 50 and 100 * repeated <= 50 * n_words and score >= quality.THRESHOLD:
            kept.add(d)
    after = run("quality", docs)
    assert {r.doc_id for r in after.collect()} == kept

    # toxicity: the machine's sum, pair by pair
    places, model = toxicity.train(after, labels)
    clean = set()
    for d in kept:
        terms = sorted({places[t] + 1 for w in rows[d].text.encode().lower().split() for t in toxicity.word_terms(w) if t in places} | {0})
        v = model.vectors[terms] / math.sqrt(len(terms))
        margin = sum(model.weights[t] * model.values[t] for t in terms) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        if 1 / (1 + math.exp(-max(-35, min(35, margin)))) < toxicity.THRESHOLD:
            clean.add(d)
    after = run("toxicity", after)
    assert {r.doc_id for r in after.collect()} == clean

    # near duplicates: all pairs of fingerprints
    ids = sorted(clean)
    prints = [brute_fingerprint(rows[d].text) for d in ids]
    groups = brute_components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    single = {min(ids[j] for j in g) for g in groups}
    after = run("near_duplicates", after)
    assert Counter(r.doc_id for r in after.collect()) == Counter(single)

    # mixing: each document about as often as its source's rate says
    sizes, counts = Counter(), Counter()
    for d in single:
        sizes[rows[d].source] += len(rows[d].text.split())
        counts[rows[d].source] += 1
    want = brute_targets(sizes)
    after = run("mixing", after)
    copies = Counter(r.doc_id for r in after.collect())
    for source, n in counts.items():
        rate = want[source] / max(sizes[source], 1)
        own = [copies[d] for d in single if rows[d].source == source]
        assert set(own) <= {math.floor(rate + 1e-9), math.ceil(rate - 1e-9)} and abs(sum(own) - rate * n) <= 1 + 1e-6

    # packing: every copy's ids once, sequences gapless and no longer than 2048
    tokenizer = Tokenizer.from_file(default_path())
    lengths = {d: len(tokenizer.encode(rows[d].text, add_special_tokens=False).ids) + 1 for d in copies}
    packed, pieces, places_of = run("packing", after).collect(), Counter(), defaultdict(list)
    for r in packed:
        pieces[(r.doc_id, r.start, r.length)] += 1
        places_of[r.sequence_id].append((r.offset, r.length))
    assert pieces == Counter({(d, at, min(2048, n - at)): copies[d] for d, n in lengths.items() for at in range(0, n, 2048)})
    for spots in places_of.values():
        ends = np.cumsum([n for _, n in sorted(spots)])
        assert [o for o, _ in sorted(spots)] == [0, *ends[:-1]] and ends[-1] <= 2048
    whole = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.start, r.length) for r in whole.collect()) == pieces


def test_sharding_with_very_many_ranges(spark):
    """40 shards of 5,000 ranges: the driver still searches 39 splitters, and counts and ranges are tables."""
    rng = np.random.default_rng(5)
    rows = [(int(i), f"t{x}") for i, x in enumerate(rng.integers(0, 20_000, 30_000))] + [(9, "hot " * 3)] * 900 + [(int(i), "warm " * 3) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"SIZE": F.lit("x"), "a.b": F.lit("y"), "cell": F.lit("z"), "part": F.lit("p")}).repartition(6)
    searches = []
    original = sharding.Search

    class Seen(original):
        def __init__(self, targets, slack):
            searches.append(len(targets))
            super().__init__(targets, slack)

    sharding.Search = Seen
    try:
        placed = sharding.shard_documents(table, 40, 5000).collect()
    finally:
        sharding.Search = original
    assert searches == [39] and Counter((r.doc_id, r.text) for r in placed) == Counter(rows) and all((r["a.b"], r.cell, r.part) == ("y", "z", "p") for r in placed)
    slots, loads, places = defaultdict(list), Counter(), defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        places[r.text].append((r.shard, r.slot))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal = sum(loads.values()) / 40
    assert all(abs(loads[s] - ideal) <= 0.002 * ideal + 2 * max(r.size for r in placed) for s in range(40))
    for spots in places.values():  # copies lie side by side
        spots.sort()
        assert all(b in ((a[0], a[1] + 1), (a[0] + 1, 0)) for a, b in itertools.pairwise(spots))
