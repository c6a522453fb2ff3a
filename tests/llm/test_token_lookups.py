"""Words are learned once, Latin ones by the tokenizer's merges alone, and the ids stay those of the tokenizer."""

import numpy as np
import pyarrow as pa

from relicframe.llm import tokens


def _ids_and_calls(monkeypatch, names):
    ids, calls = tokens.WordIds(tokens.default_path()), {name: [] for name in names}
    for name in names:
        encode = getattr(ids, name)
        monkeypatch.setattr(ids, name, lambda given, encode=encode, seen=calls[name], **more: (seen.append(given), encode(given, **more))[1], raising=False)
    return ids, calls


def _got(ids, texts):
    return [np.frombuffer(found, ids.kind).tolist() for found in ids.texts(pa.array(texts, pa.string()))]


def _want(texts):
    return [found.ids for found in tokens.WordIds(tokens.default_path()).encode.__self__.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_latin_words_go_past_normalizer_and_pattern(monkeypatch):
    ids, calls = _ids_and_calls(monkeypatch, ["encode", "encode_fast"])
    texts = ["Straße, ÉCOLE école! naïve", "Plain words; (again) words?", "ŁÓDŹ Œuvre", None]
    want = _want(texts)
    assert _got(ids, texts) == want
    assert not calls["encode_fast"] and {word for word in calls["encode"] if word.strip(tokens.END_MARKS.decode())} <= {"(again)"}


def test_every_latin_letter_in_either_case():
    letters = [chr(c) for c in range(0x41, 0x260) if chr(c).isalpha()]
    texts = [form for c in letters for form in (c, f"x{c}y", f"{c}{c.upper()}.", f"{c.lower()}'s, {c}9")] + ["".join(letters)]
    ids = tokens.WordIds(tokens.default_path())
    assert _got(ids, texts) == _want(texts)


def test_marks_that_join_lower_case_alone():
    texts = ["J\u030c", "j\u030c", "aT\u0308 at\u0308 H\u0331x. W\u030a Y\u030a y\u030a", "E\u0301cole e\u0301cole E\u0301COLE."]
    ids = tokens.WordIds(tokens.default_path())
    assert _got(ids, texts) == _want(texts) == _got(ids, texts[::-1])[::-1]


def test_words_in_use_outlive_the_limit(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 1)
    monkeypatch.setattr(tokens, "CACHED_CORES", 4)
    ids = tokens.WordIds(tokens.default_path())
    learned = []
    for name in ("encode_fast", "merge_fast"):
        encode = getattr(ids, name, None)
        if encode:
            setattr(ids, name, lambda given, encode=encode, **more: (learned.extend(given[0].split(" ")), encode(given, **more))[1])
    texts = [f"always {a}{b}" for a in "qwxyz" for b in "qwxyz"]
    assert _got(ids, texts) == _want(texts)
    assert learned.count("always") == 1 and len(ids.cores) <= 5 and len(ids.older) <= 5


def test_tails_of_slices():
    words = pa.array(["gone", "ab,.", "", "é!", "x"]).slice(1)
    heads = pa.array(["ab", "", "é", "x"])
    assert tokens._tails(words, heads).to_pylist() == [b",.", b"", b"!", b""]
