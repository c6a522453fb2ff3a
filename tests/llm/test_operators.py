"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import io
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relicframe.llm import components, language, mixing, packing, quality, sharding, simhash, tiles, token_counts, tokens, toxicity, vectors, warc
from relicframe.llm.tokens import default_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", f"s{i % 3}", 0) for i in range(60)]
    base = prose(rng, 200).split()
    for i in range(60, 90):  # near copies: a word changed
        words = list(base)
        words[rng.randrange(200)] = rng.choice(WORDS)
        rows.append((i, " ".join(words), "en", "s0", 0))
    rows += [(i, rows[5][1], "de", "hot", 0) for i in range(90, 130)]
    rows += [(130, None, None, None, None), (131, "", "en", None, 0), (132, " \n\t", "en", "s1", 0), (None, "a b c d", "en", "s1", 0), (None, None, None, None, None)]
    rows += [(133, "x " * 30000, "en", "s2", 0), (134, "Ünïcode ß \U0001f600 İ", "de", "s2", 0), (135, "one", "en", "s1", 0), (136, "One  TWO", "en", "s1", 0)]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def real(spark, name, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return [groups[find(i)] for i in range(n)]


# --- shared parts ---------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, x) for x in range(501, 540)]
    groups = brute_components(600, links)
    found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {x: min(groups[x]) for pair in links if pair[0] != pair[1] for x in pair}


def test_components_without_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_meet_every_pair_once(spark):
    rows = spark.createDataFrame([(k, m) for k, n in ((1, 57), (2, 3), (3, 1)) for m in range(n)], "run_key long, member long")
    met = Counter()

    def run(batches):
        for group, across in tiles.runs(batches, lambda t: {c: t.column(c).to_numpy() for c in ("run_key", "member", "own")}):
            members, own = group["member"], group["own"]
            import pyarrow as pa

            pairs = [(int(group["run_key"][0]), int(min(x, y)), int(max(x, y))) for i, x in enumerate(members) for j, y in enumerate(members) if i < j and (not across or own[i] != own[j])]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], names=["k", "x", "y"])

    for row in tiles.dealt(tiles.tile(rows, "member", 10)).mapInArrow(run, "k long, x long, y long").collect():
        met[tuple(row)] += 1
    assert met == {(k, x, y): 1 for k, n in ((1, 57), (2, 3)) for x in range(n) for y in range(x + 1, n)}


# --- 1 SimHash --------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile_rows", [4096, 4])
def test_simhash_equals_brute_force(docs, monkeypatch, tile_rows):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile_rows)
    rows = odd_documents()
    prints = [brute_fingerprint(r[1]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    groups = brute_components(len(rows), linked)
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in groups[i] if rows[j][0] is not None]
        want[(r[0], prints[i], min(ids) if ids else None)] += 1
    got = Counter((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect())
    assert got == want


def test_simhash_random_bits_lose_no_link(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in range(0, 6)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    true = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 3]
    at = {p: i for i, p in enumerate(prints)}
    assert [set(g) for g in brute_components(len(prints), true)] == [set(g) for g in brute_components(len(prints), [(at[a], at[b]) for a, b in found])]


def test_keep_one_of_each_group(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, c), (None, c), (None, None), (None, ""), (None, "lone words here")]
    table = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = Counter((r.doc_id, r.text or "", r.fp or "") for r in simhash.keep_one(table).collect())
    # text b shares its id with a dropped copy of a, and stays once; null ids stay where their group has no other
    assert got == Counter((i, t, t) for i, t in [(1, a), (2, b), (3, c), (None, ""), (None, "lone words here")])


def test_simhash_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns


# --- 2 toxicity -------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    docs, labels = real(spark, "documents", "0.1"), real(spark, "labels", "0.1")
    scored = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").select("doc_id", "toxicity", "is_toxic", "toxic").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [r for r in held if r.toxic and r.is_toxic]
    assert len(right) > 0.7 * sum(r.toxic for r in held)  # few labels here; the rarer languages have too few
    assert sum(r.is_toxic and not r.toxic for r in held) < 0.01 * len(held)
    assert all(0 <= r.toxicity <= 1 for r in scored)


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([i for i, on in ((0, a), (1, b), (2, rng.integers(0, 2))) if on], np.int64))
        y.append(float(a and b))
    model = toxicity.FactorizationMachine(3)
    model.fit(rows, np.array(y), epochs=40)
    only_a, only_b, both = toxicity.probability(model.raw([np.array([0]), np.array([1]), np.array([0, 1])]))
    assert both > 0.9 and only_a < 0.1 and only_b < 0.1


def test_toxicity_learns_pairs_of_terms_without_a_signal(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(4500):
        a, b = rng.randrange(2), rng.randrange(2)
        docs.append((i, " ".join(["ab"[a], "cd"[b], *rng.sample(WORDS[:100], 4)])))
        labels.append((i, int(a == b)))
    scored = toxicity.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [r for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.toxicity > 0.5) == labels[r.doc_id][1] for r in held) > 0.9 * len(held)


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels = real(spark, "documents"), real(spark, "labels")
    places, model = toxicity.train(docs, labels)
    for r in toxicity.toxicity_scores(docs, labels).select("text", "toxicity").limit(200).collect():
        terms = {places[t] + 1 for w in r.text.encode().lower().split() for t in toxicity.word_terms(w) if t in places} | {0}
        root = 1 / math.sqrt(len(terms))
        margin = sum(model.weights[t] * model.values[t] for t in terms)
        if len(terms) <= 150:  # all pairs one by one
            margin += sum(float(model.vectors[s] @ model.vectors[t]) * root * root for s, t in itertools.combinations(sorted(terms), 2))
        else:  # the sum of all pairs is half of (square of the sum less the sum of the squares)
            v = model.vectors[sorted(terms)] * root
            margin += 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, margin)))), abs=1e-9)


def test_toxicity_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs.withColumn("toxicity", F.lit("clash")), labels).count() == docs.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r.toxicity < 0.7 for r in toxicity.toxicity_scores(docs, none).collect())
    assert toxicity.toxicity_scores(empty, labels).count() == 0


# --- 3 token counts -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_word_ids_equal_the_tokenizer_in_all_scripts(tokenizer):
    import unicodedata

    rng = random.Random(2)
    letters = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c))[0] in "LMN"]
    apart = [c for c in letters if len(unicodedata.normalize("NFC", c)) > 1 or len(c.lower()) > 1]
    marks = ".,;:!?\"'()[]{}|*#$%&<>-_/"
    ids = tokens.WordIds(default_path())
    texts = [c + m for c in apart for m in ".'"]
    for _ in range(20_000):
        script = rng.randrange(len(letters))
        pool = letters[max(0, script - 60) : script + 60] + rng.sample(apart, 3) + ["A", "z", "'s", "<|endoftext|>"]
        texts.append(" ".join("".join(rng.choices(pool, k=rng.randint(1, 6))) + "".join(rng.choices(marks, k=rng.randint(0, 3))) for _ in range(3)))
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids.text(text.encode()), "<u4").tolist() == want.ids, text


def test_token_histogram_equals_brute_force(docs, empty, tokenizer):
    lengths = sorted(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_documents())
    found = token_counts.length_histogram(token_counts.token_lengths(docs)).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.n_docs) for r in found] == sorted(Counter(lengths).items())
    for r in found:
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
        assert (r.docs_upto, r.docs_longer) == (sum(n <= r.n_tokens for n in lengths), sum(n > r.n_tokens for n in lengths))
        assert (r.tokens_upto, r.tokens_longer) == (sum(n for n in lengths if n <= r.n_tokens), sum(n for n in lengths if n > r.n_tokens))
    histogram = token_counts.length_histogram(token_counts.token_lengths(docs))
    assert token_counts.total_at(histogram, 77).first()["truncated_total"] == sum(min(n, 77) for n in lengths)
    assert token_counts.length_histogram(token_counts.token_lengths(empty)).count() == 0


# --- 4 quality rules ----------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in spaces:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(spaces)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    extra = [(200, "a b c a b c x\na b c a b c x\n\n \nz", "en", "s", 0), (201, "p q r p q r p q r s", "en", "s", 0), (202, "#$ a|b <x>\x0bq\x1cz", "en", "s", 0)]
    more = docs.unionByName(spark.createDataFrame(extra, DOCS)).withColumn("score", F.lit("clash"))
    found = quality.quality_rules(more, labels).collect()
    want = Counter((r[0], *brute_base(r[1])) for r in odd_documents() + extra)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_score_equals_brute_force(spark):
    docs, labels = real(spark, "documents", "0.001"), real(spark, "labels", "0.001")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    size = 1 << quality.BUCKET_BITS
    grams = {}
    for r in docs.collect():
        w = r.text.encode().split()
        # Spark hashes several values in turn, each seeding the next
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        two = [xxhash.xxh64_intdigest(b, a) for a, b in zip(one, w[1:], strict=False)]
        grams[r.doc_id] = [h % size for h in one + two]
    raw = Counter(g for gs in grams.values() for g in gs)
    target = Counter(g for d, gs in grams.items() if d in good for g in gs)

    def share(counts, g):
        total = sum(counts.values())
        return (counts[g] + quality.SMOOTHING * total / size) / (total + quality.SMOOTHING * total)

    ratio = {g: math.log(share(target, g) / share(raw, g)) for g in raw}
    for r in quality.quality_rules(docs.withColumns({"judged": F.lit(1), "doc": F.lit("x")}), labels).collect():
        gs = grams[r.doc_id]
        assert r.score == pytest.approx(sum(map(ratio.__getitem__, gs)) / max(len(gs), 1), abs=1e-4) and (r.judged, r.doc) == (1, "x")


def test_quality_keeps_clean_and_drops_junk(spark):
    docs, labels = real(spark, "documents", "0.1"), real(spark, "labels", "0.1")
    rows = quality.quality_rules(docs, labels).join(labels, "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.999 * len(clean) and sum(junk) <= 0.05 * len(junk)


def test_quality_empty_and_unlabelled(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(empty, labels).count() == 0
    assert all(r.score == 0 for r in quality.quality_rules(docs, labels).collect())


# --- 5 packing ------------------------------------------------------------------------------------


def test_packing_is_an_exact_round_trip(docs, tokenizer):
    rows = packing.pack(docs.withColumn("offset", F.lit("clash"))).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
        assert r.length == len(r.ids) // 4 and r.start == r.piece * packing.CAPACITY
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    texts = defaultdict(list)
    for r in odd_documents():
        texts[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0])
    for doc_id, want in texts.items():
        got = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert sum(len(w) for w in want) == sum(r.length for r in got)
        if len(want) == 1:
            assert np.frombuffer(b"".join(r.ids for r in got), "<u4").tolist() == want[0]
            assert all(r.length == packing.CAPACITY for r in got[:-1])


def test_packing_is_tight_and_repeats(spark):
    docs = real(spark, "documents")
    packed = packing.pack(docs).cache()
    total, used = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert used <= 1.04 * math.ceil(total / packing.CAPACITY)
    again = packing.pack(docs.repartition(5)).select("doc_id", "piece", "sequence_id", "offset")
    assert sorted(again.collect()) == sorted(packed.select("doc_id", "piece", "sequence_id", "offset").collect())
    whole = packing.sequences(packed).collect()
    assert len(whole) == used and sum(len(r.ids) for r in whole) == 4 * total


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, 2)
    for n in (8, 5, 4):  # the third needs a place: 8 is the fullest
        fit.place(n)
    assert fit.place(2) == (1, 5) or fit.place(2)[0] == 2


def brute_best_fit(lengths, capacity, most):
    """(bin, offset) by looking at all open bins; the latest of equal ones is taken."""
    bins, open_bins, out = [], [], []
    for n in lengths:
        fitting = [b for b in open_bins if capacity - bins[b] >= n]
        if fitting:
            b = max(fitting, key=lambda x: (bins[x], open_bins.index(x)))
            open_bins.remove(b)
        else:
            b = len(bins)
            bins.append(0)
        out.append((b, bins[b]))
        bins[b] += n
        if bins[b] < capacity:
            if len(open_bins) >= most:
                open_bins.remove(max(open_bins, key=lambda x: (bins[x], open_bins.index(x))))
            open_bins.append(b)
    return out


@pytest.mark.parametrize("most", [1, 3, 20])
def test_best_fit_equals_brute_force(most):
    rng = random.Random(most)
    lengths = [min(100, int(rng.expovariate(1 / 40)) + 1) for _ in range(1500)]
    fit = packing.BestFit(100, most)
    assert [fit.place(n) for n in lengths] == brute_best_fit(lengths, 100, most)
    assert fit.open <= most


def test_packing_closes_bins(spark):
    docs = real(spark, "documents")
    few, many = (packing.pack(docs, open_bins=n).agg(F.count_distinct("sequence_id"), F.sum("length")).first() for n in (4, packing.OPEN_BINS))
    assert many[0] < few[0] < 1.2 * many[0] and few[1] == many[1]


def test_packing_does_not_depend_on_session_settings(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_BYTES", 20_000)
    got = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(repr, packing.pack(docs).drop("ids").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and len({r.sequence_id >> 40 for r in packing.pack(docs).collect()}) > 2


def test_packing_empty_table(empty):
    assert packing.pack(empty).count() == 0


# --- 6 mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_targets_and_copies(docs):
    rows = mixing.mix(docs.withColumn("size", F.lit("clash"))).collect()
    assert len(rows) == len(odd_documents())
    sizes = Counter()
    for r in odd_documents():
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and r.copies in (math.floor(r.target / max(r.source_size, 1)), math.floor(r.target / max(r.source_size, 1)) + 1)
        assert r.copies <= 3
        taken[r.source] += r.taken
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))


def test_mixing_comes_near_on_many_documents(spark):
    rows = mixing.mix(real(spark, "documents", "0.1")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in rows)


def test_mixed_documents_with_clashing_columns(docs):
    names = ["doc", "size", "source_size", "target", "copies", "taken", "start", "rate", "offset", "rank", "repeat", "mix_key", "mix_class", "mix_cell", "n"]
    clash = docs.withColumns({c: F.lit(c) for c in names})
    rows = mixing.mixed_documents(clash).collect()
    assert len(rows) == mixing.mixed_documents(docs).count() and all(r[c] == c for r in rows for c in names)
    assert sorted(map(repr, mixing.mix(clash).collect())) == sorted(map(repr, mixing.mix(docs).collect()))


def test_mixing_cells_follow_the_table(docs, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_DOCS", 1)
    rows = mixing.mix(docs).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        rate = own[0].target / max(own[0].source_size, 1)
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 1


def test_mixed_documents_repeat(spark, docs, empty):
    planned = {(r.doc_id, r.size): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        planned[(r.doc_id, r.size)] += r.copies
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).count() == sum(planned.values())
    assert mixing.mix(empty).count() == 0


# --- 7 language --------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    told = language.identify(real(spark, "documents", "0.1")).select("doc_id", "lang", "lang_pred", "lang_score").collect()
    held = [r for r in told if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    assert all(0 <= r.lang_score <= 1 for r in told)


def test_language_scores_equal_brute_force(spark):
    docs = real(spark, "documents")
    model = language.train(docs)
    buckets = model.bucket_scores()

    def brute_hash(units):
        """Places of a string's characters, each times the multiplier of its place."""
        return sum(c * k for c, k in units) & 0xFFFFFFFF

    def mixed(h, kind):
        h = (h + kind) & 0xFFFFFFFF
        for shift, k in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> shift) * k & 0xFFFFFFFF
        return (h ^ h >> 16) % language.BUCKETS

    for r in language.identify(docs).select("text", "lang_pred", "lang_score").limit(60).collect():
        found = []
        for word in r.text.lower().encode().split():
            codes = [1, *map(ord, word.decode()), 1]
            for n in (2, 3, 4):
                found += [mixed(brute_hash(zip(codes[i : i + n], language.MULTIPLIERS)), n - 2) for i in range(len(codes) - n + 1)]
            powers = [pow(0x01000193, i + 1, 1 << 32) for i in range(len(codes) - 2)]
            found.append(mixed(brute_hash(zip(codes[1:-1], powers)), 3))
        scores = np.array(buckets)[found].sum(axis=0) / len(found) / model.temperature
        chance = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
        assert r.lang_pred == model.languages[int(chance.argmax())] and r.lang_score == pytest.approx(chance.max(), abs=1e-9)


@pytest.mark.parametrize("text", ["\u00bd \u00b2 \u2460", "\u2167 123", "\U0001f600 --", "_ 7"])
def test_language_of_texts_without_letters(text):
    assert not language.has_letter(text) and language.has_letter(text + "\u0434")


def test_language_odd_rows(docs, empty):
    rows = {r.text: r for r in language.identify(docs.withColumn("lang_pred", F.lit(1))).collect()}
    for text in (None, "", " \n\t"):
        assert rows[text].lang_pred == "und" and rows[text].lang_score == 0 and not rows[text].lang_accepted
    assert {r.lang_pred for r in rows.values()} <= {"und", "en", "de"}
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_counts_all_of_a_long_run(spark):
    rng = random.Random(7)
    letters = {"zh": [chr(c) for c in range(0x4E00, 0x4F00)], "ja": [chr(c) for c in range(0x3041, 0x3091)]}
    rows = [(i, "".join(rng.choices(letters[k], k=200)), k) for i, k in enumerate(["zh", "ja"] * 150)]
    rows += [(1000, "".join(rng.choices(letters["ja"], k=45) + rng.choices(letters["zh"], k=3000)), None)]
    rows += [(1001, "".join(rng.choices(letters["zh"], k=45) + rng.choices(letters["ja"], k=200_000)), None)]
    rows += [(1002, "\u3000".join("".join(rng.choices(letters[k], k=9)) for k in ["ja"] * 5 + ["zh"] * 200), None)]
    told = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [told[i] for i in (1000, 1001, 1002)] == ["zh", "ja", "zh"]


def test_language_sample_keeps_rare_languages(spark):
    lang = F.when(F.col("doc_id") % 4000 == 7, "xx").otherwise("en")
    table = spark.range(40_000).withColumnRenamed("id", "doc_id").select("doc_id", F.lit("a b").alias("text"), lang.alias("lang"))
    rare = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(7, 40_000, 4000))
    got = {r.lang: r["count"] for r in language.learning_sample(table).groupBy("lang").count().collect()}
    assert got == {"en": language.SAMPLE_PER_LANGUAGE, "xx": rare}


def test_language_learns_from_all_words(spark):
    words = sorted((f"w{i}" for i in range(1000)), key=lambda w: zlib.crc32(w.encode()))
    own = {k: ["".join(x) for x in itertools.product(letters, repeat=5)] for k, letters in (("aa", "жцщ"), ("bb", "qxz"))}
    own = {k: [w for w in found if zlib.crc32(w.encode()) > 3 << 30] for k, found in own.items()}
    rows = [(i, " ".join(words[:80] + own[k] * 10), k) for i, k in enumerate(["aa", "bb"] * 200)]  # the words that tell have large crc32
    told = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang == r.lang_pred for r in told)


# --- 8 WARC --------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def odd_pages():
    big = "<p>" + "é" * 90 + "</p>"
    rows = [(i, f"http://x/{i}\r\n%zz", big, ) for i in (9, 4, 7)] + [(1, None, None), (2, "u", ""), (3, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", big)]
    return rows + [(8, "u", "y" * 300_000), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30)]


def test_warc_round_trip(spark):
    rows = odd_pages()
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("size", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        data = (html or "").encode()
        r = got[page_id]
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same) if len(data) >= 100 and same else page_id
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(data), hashlib.sha256(data).hexdigest(), url)
        assert (r.record_type, r.refers_to) == (("response", None) if first == page_id else ("revisit", first))
        assert bytes(r.payload) == (data if r.record_type == "response" else b"")
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_reader_sees_damage():
    body = b"hello" * 50
    good = b"".join(warc.encode_record(i, "u", body, len(body), hashlib.sha256(body).hexdigest(), None) for i in range(3))
    assert [r["payload"] for r in warc.read_records(io.BytesIO(good))] == [body] * 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-5])))
    wrong = warc.encode_record(1, "u", body, len(body), "0" * 64, None)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(wrong)))


# --- 9 vectors --------------------------------------------------------------------------------------------


def brute_vectors(rows):
    usable = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.float32(rows[i][1]).astype(float) for i in usable}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    linked = [(i, j) for i in usable for j in usable if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    degree = Counter(x for pair in linked for x in pair)
    groups = brute_components(len(rows), linked)
    out = Counter()
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[i] if rows[j][0] is not None]
        component = min(ids) if ids else None
        out[(vec_id, degree[i], component, vec_id is not None and vec_id == component)] += 1
    return out


@pytest.mark.parametrize("tile_rows", [1024, 8])
def test_vectors_equal_brute_force(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(vectors, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array([1, 2, 3, 4]) + rng.normal(size=4) * 0.2).tolist()) for i in range(30)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(20)] + [(300, [2.0, 4.0, 6.0, 8.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(400, None), (401, [0.0] * 4), (402, [float("nan")] * 4), (403, [1.0, None, 1.0, 1.0]), (404, [float("inf")] * 4), (405, [1.0, 2.0]), (406, []), (None, None)]
    rows += [(410, [2.0, 4.0]), (411, [1.0, 2.0]), (412, [5.0, 0.0, 0.0]), (413, [5.0, 0.1, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit("clash"))
    assert Counter(map(tuple, vectors.near_vectors(table).collect())) == brute_vectors(rows)


def test_vectors_recall_with_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 16)
    monkeypatch.setattr(vectors, "SAMPLE_VECTORS", 400)
    table = real(spark, "embeddings", "0.1")
    rows = table.collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = dict(zip((r.vec_id for r in rows), near.sum(axis=1) - 1, strict=True))
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(table).collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def planted_vectors(n, pairs, seed):
    """n random unit vectors of 64 numbers, and for the first ``pairs`` of them a partner at cosine 0.9 to 0.95."""
    rng = np.random.default_rng(seed)
    unit = rng.normal(size=(n, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    aside = rng.normal(size=(pairs, 64))
    aside -= (aside * unit[:pairs]).sum(axis=1, keepdims=True) * unit[:pairs]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.95, (pairs, 1))
    return np.concatenate([unit, cosine * unit[:pairs] + np.sqrt(1 - cosine**2) * aside])


@pytest.mark.parametrize(("leaf", "sample"), [(64, 20_000), (16, 500)])
def test_vectors_recall_of_planted_pairs(spark, monkeypatch, tmp_path, leaf, sample):
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(vectors, "LEAF", leaf)
    monkeypatch.setattr(vectors, "SAMPLE_VECTORS", sample)
    unit = planted_vectors(6000, 2000, 5).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(unit)), "embedding": list(unit)}), tmp_path / "v.parquet")
    exact = unit.astype(float) / np.linalg.norm(unit.astype(float), axis=1, keepdims=True)
    want = (exact @ exact.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum() > 3000


def test_vectors_have_few_copies():
    unit = planted_vectors(20_000, 0, 6)
    for population in (2_000, 40_000, 800_000):
        forest = vectors.plan_forest(unit[: vectors.SAMPLE_VECTORS], population, 0.9, 0)
        copies = sum(len(t.route(unit[:4000], forest.spill)[0]) for t in forest.trees) / 4000
        leaves = [np.unique(t.route(unit, forest.spill)[1], return_counts=True)[1] for t in forest.trees]
        assert copies <= 5 * (population / 2_000) ** 0.25
        assert np.average(leaves[0], weights=leaves[0]) * population / len(unit) < 4 * vectors.LEAF


def test_vectors_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 10 sharding --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [None, 1, 3])
def test_sharding_is_even_and_gapless(spark, ranges):
    docs = real(spark, "documents", "0.1")
    hot = docs.limit(1).crossJoin(spark.range(3000)).withColumn("doc_id", F.col("id") + 10**6).drop("id")
    docs = docs.unionByName(hot).withColumn("shard", F.lit("clash"))
    rows = sharding.shard_documents(docs, 40, ranges).select("doc_id", "size", "shard", "slot", F.md5(F.encode("text", "utf-8")).alias("m")).collect()
    assert len(rows) == docs.count()
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    loads = [sum(r.size for r in shards[s]) for s in range(40)]
    largest = max(r.size for r in rows)
    ideal = sum(loads) / 40
    assert max(abs(x - ideal) for x in loads) <= 0.002 * ideal + largest
    for s in range(40):
        assert sorted(r.slot for r in shards[s]) == list(range(len(shards[s])))
    places = defaultdict(list)
    for r in rows:
        places[r.m].append((r.shard, r.slot))
    for p in places.values():  # copies lie side by side within a shard
        for s in {x for x, _ in p}:
            slots = sorted(y for x, y in p if x == s)
            assert slots[-1] - slots[0] == len(slots) - 1


@pytest.mark.parametrize("ranges", [1, 3])
def test_sharding_cuts_repeated_rows(spark, ranges):
    rows = [(7, "one text of some length" * 4)] * 2000 + [(i, f"text number {i} " * 6) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = ["key", "range", "k0", "k1", "k2", "doc", "size", "slot"]
    placed = sharding.shard_documents(table.withColumns({c: F.lit(c) for c in names}), 40, ranges).collect()
    assert all(r[c] == c for r in placed for c in names[:6])
    assert Counter((r.doc_id, r.text) for r in placed) == Counter(rows)
    loads, slots = Counter(), defaultdict(list)
    for r in placed:
        assert r.size == len(r.text.encode()) + 16
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    ideal = sum(loads.values()) / 40
    assert all(abs(loads[s] - ideal) <= 0.002 * ideal + 2 * 112 for s in range(40))
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in range(40))
    repeats = sorted((r.shard, r.slot) for r in placed if r.text.startswith("one"))
    assert all((b[0], b[1]) in ((a[0], a[1] + 1), (a[0] + 1, 0)) for a, b in itertools.pairwise(repeats))


def test_range_of_is_a_binary_search(spark):
    rng = random.Random(3)
    keys = [tuple(rng.randrange(4) for _ in range(3)) for _ in range(200)]
    for n in (0, 1, 2, 5, 16, 33):
        cuts = sorted(tuple(rng.randrange(5) for _ in range(3)) for _ in range(n))
        table = spark.createDataFrame(keys, "k0 long, k1 long, k2 long")
        got = [r[3] for r in table.select("*", sharding.range_of(cuts)).collect()]
        assert got == [sum(c <= k for c in cuts) for k in keys]


def test_sharding_odd_rows(docs, empty):
    rows = sharding.shard_documents(docs, 5).collect()
    assert sum(r.size for r in rows) == sum(len((r[1] or "").encode()) + 16 for r in odd_documents())
    assert all(0 <= r.shard < 5 for r in rows)
    assert sharding.shard_documents(empty).count() == 0
