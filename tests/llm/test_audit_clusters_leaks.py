"""Decontamination, filter audit and centroid clustering against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from relicframe.llm import centroids, decontamination, filters, fmindex, queries
from relicframe.llm.common import exact_columns, hold, release

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- columns ---------------------------------------------------------------------------------


def test_held_columns_come_back(spark):
    table = spark.createDataFrame([(1, "a", "A", 2.5)], "doc_id long, text string, `TEXT` string, `a.b` double")
    for apart in (False, True):
        rows = hold(table, ("text",), ("Doc_ID",), apart=apart)
        back = rows.select(*release(table.columns, ("doc_id",), ("text",) if apart else ()))
        assert back.columns == ["text", "TEXT", "a.b"] and tuple(back.first()) == ("a", "A", 2.5)
    assert exact_columns(table, "TEXT", "doc_id").first() == ("A", 1)
    with pytest.raises(ValueError):
        exact_columns(table, "lang")


# --- index -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_places(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)) for _ in range(9)] + [np.ones(70, int)] * 3
    runs += [runs[0]] * 3
    symbols = np.concatenate([np.append(r, 0) for r in runs])
    index = fmindex.FmIndex(symbols, 8)
    phrases, lengths = np.zeros((60, 10), int), rng.integers(1, 11, 60)
    for i, n in enumerate(lengths):
        run = runs[rng.integers(len(runs))]
        at = rng.integers(len(run))
        own = run[at : at + n] if i % 3 else rng.integers(0, 8, n)
        lengths[i] = len(own)
        phrases[i, : len(own)] = own
    which, places = index.occurrences(phrases, lengths)
    want = {(i, j) for i in range(60) for j in range(len(symbols) - lengths[i] + 1) if (symbols[j : j + lengths[i]] == phrases[i, : lengths[i]]).all() and (phrases[i, : lengths[i]] > 0).all()}
    assert len(which) == len(want) and set(zip(which.tolist(), places.tolist(), strict=True)) == want


def test_bits_ranks():
    bits = np.random.default_rng(1).random(1000) < 0.3
    packed = fmindex.Bits(bits)
    at = np.arange(1001)
    assert (packed.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all() and (packed.get(at[:-1]) == bits).all()


# --- decontamination -------------------------------------------------------------------------


def brute_hits(text, items, window):
    words, hit, found = fold(text), set(), set()
    for item, own in items:
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    spans, covered = [], sorted(hit)
    for i in covered:
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    return len(words), len(hit), sorted(found), [tuple(s) for s in spans]


def leaky_tables(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["ÄÖ", "naïve", "日本"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(12, 40)))) for i in range(25)]
    items += [(25, "Short item, of FIVE words"), (26, ""), (27, None), (None, "no id but ten words or more in this very item here"), (3, "another text of item three with some more words than ten of them"), (28, items[0][1]), (29, "one")]
    docs = []
    for i in range(150):
        words = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, max(0, len(own) - 5))
            words[rng.randint(0, len(words)) : 0] = own[at : at + rng.randint(5, 20)]
        docs.append((i, rng.choice([" ", ", ", "\n", "-"]).join(words).upper() if i % 2 else " ".join(words)))
    docs += [(200, None), (201, ""), (None, items[1][1]), (5, docs[5][1]), (5, docs[5][1]), (202, "filler " * 20000 + items[2][1] + " filler" * 20000), (203, "x" * 100000), (204, "one")]
    # a touching pair of documents: no span may run over the border
    docs += [(205, " ".join(items[4][1].split()[:5])), (206, " ".join(items[4][1].split()[5:]))]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("block_words", "shard_bytes"), [(500_000, 48 << 20), (60, 48 << 20), (500_000, 300)])
def test_contamination_equals_brute_force(spark, monkeypatch, block_words, shard_bytes):
    monkeypatch.setattr(decontamination, "SHARD_BYTES", shard_bytes)
    docs, items, docs_table, items_table = leaky_tables(spark)
    listed = [("" if i is None else str(i), fold(t)) for i, t in items]
    clashing = docs_table.withColumns({"Spans": F.lit("x"), "a.b": F.lit("y"), "held": F.lit("z"), "TEXT2": F.col("text")})
    found = decontamination.find_contamination(clashing, items_table, clean=True, block_words=block_words)
    assert found.columns == ["doc_id", "text", "a.b", "held", "TEXT2", "n_words", "n_hit", "spans", "items", "contaminated", "clean_text"]
    got = Counter((r.doc_id, r.text, r["a.b"], r.held, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans), r.contaminated) for r in found.collect())
    want = Counter()
    for doc_id, text in docs:
        n, hit, names, spans = brute_hits(text, listed, decontamination.WINDOW)
        want[(doc_id, text, "y", "z", n, hit, tuple(names), tuple(spans), hit > 0)] += 1
    assert got == want
    for r in found.collect():
        left = [w for i, w in enumerate(fold(r.text)) if not any(s.start <= i < s.end for s in r.spans)]
        assert (r.clean_text is None) == (r.text is None) and fold(r.clean_text) == left


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs, items).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = decontamination.find_contamination(one, items).first()
    assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (2, 0, [], False)


def test_long_items_are_cut_without_losing_a_window(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    words = [f"v{i}" for i in range(40)]
    pieces = decontamination.item_pieces(spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"), 10).collect()
    grams = {tuple(p.words.split()[i : i + 10]) for p in pieces for i in range(p.n - 9)}
    assert grams == {tuple(words[i : i + 10]) for i in range(31)} and max(p.n for p in pieces) == 16


# --- filter audit ----------------------------------------------------------------------------


def brute_audit(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > first[t],
        }
        rows.append((lang or "", {f for f, x in fails.items() if x}, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[(part, order, step)] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                shapley[(part, f)] += len(gone)
    return {k: (*v[:-1], shapley[(k[0], v[-1])]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(["a", "bb", "Word", "x#y", "LOUD", f"u{rng.randrange(500)}"]) for _ in range(rng.choice([5, 150, 220, 400])))
        docs.append((rng.randrange(60), text, rng.choice(["en", "de", "", None])))
    docs += [(i, docs[3][1], "en") for i in range(100, 130)] + [docs[0], docs[0], (None, docs[3][1], "fr"), (None, None, None), (7, None, "en"), (8, "", "en"), (9, "Ü" * 300, "de"), (10, "word " * 50000, "de")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 140, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"PART": F.lit(1), "mask": F.lit(2), "a.b": F.lit(3), "n": F.lit(4)}).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    rows = filters.audit(table, marks).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(rows) == len(got) and got == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert filters.audit(one, labels).count() == 600


# --- centroids -------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dimensions, scale, seed):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        centers = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if groups[c] else m for c, m in enumerate(centers)]
    placed = [(i, nearest(v), far(v, centers[nearest(v)])) for i, v in kept]
    inertia = Counter()
    for _, c, d in placed:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, c, d in placed)


@pytest.mark.parametrize(("n", "k"), [(300, 8), (5, 8), (1, 3)])
def test_clusters_equal_brute_force(spark, n, k):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 0.7, 6)]) for i in range(n)]
    rows += [(1000, None), (1001, [1.0] * 5), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, [None] + [0.0] * 5), (1005, [])]
    if n > 10:
        rows += [(None, [0.5] * 6), rows[0], rows[0], (2000, [-3.25] * 6), (2001, [-3.25] * 6), (2002, [0.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "V": F.lit("y"), "a.b": F.lit(1)}).repartition(3)
    got = Counter(tuple(r) for r in centroids.cluster_vectors(table, k, 10, 6).collect())
    assert got == brute_clusters(rows, k, 10, 6, 1024, 3)


def test_clusters_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(empty).count() == 0
    with pytest.raises(Exception, match="may not fit"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


# --- queries ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_filter_audit", "op13_centroids"])
def test_new_queries_equal_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, want = queries.QUERIES[name](spark, SF), connection.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    listed = lambda rows, names: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows)
    assert listed(found.collect(), found.columns) == listed(want.fetchall(), want.columns)
