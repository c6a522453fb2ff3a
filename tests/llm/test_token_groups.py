"""New words are encoded many at a time, and the ids are those of the tokenizer."""

import numpy as np
import pyarrow as pa

from relicframe.llm import tokens


def _want(ids, texts):
    return [ids.encode(t or "", add_special_tokens=False).ids for t in texts]


def _got(ids, texts):
    return [np.frombuffer(found, ids.kind).tolist() for found in ids.texts(pa.array(texts, pa.string()))]


def test_new_words_are_encoded_together():
    ids = tokens.WordIds(tokens.default_path())
    texts = [None, "", " \t\n", "Zwq qwz, Zwq. naïve Äß!! don't 3rd", "x1 İstanbul éa Москва", "zwq " * 70, "q" * 100 + ". end"]
    want = _want(ids, texts)
    calls, encode = [], ids.encode
    ids.encode = lambda word, **more: (calls.append(word), encode(word, **more))[1]
    assert _got(ids, texts) == want
    # what is left to be encoded by itself is no run of letters, or longer than what is kept
    assert not {"zwq", "qwz", "naïve", "end", "москва"} & set(calls)


def test_groups_and_forgetting_change_nothing(monkeypatch):
    texts = [f"alpha{i} " + "beta gamma. " * (i % 5) + "d" * (i % 90 + 1) for i in range(300)] + [None, ""]
    want = _want(tokens.WordIds(tokens.default_path()), texts)
    for size, kept, joined in ((1, 3, 2), (200, 1, 1000), (1 << 20, 10, 7)):
        monkeypatch.setattr(tokens, "GROUP_BYTES", size)
        monkeypatch.setattr(tokens, "CACHED_CORES", kept)
        monkeypatch.setattr(tokens, "CACHED_WORDS", kept)
        monkeypatch.setattr(tokens, "JOINED_WORDS", joined)
        assert _got(tokens.WordIds(tokens.default_path()), texts) == want


def test_slices_of_texts_and_other_tokenizers():
    ids = tokens.WordIds(tokens.default_path())
    assert [len(x) for x in ids.texts(pa.array(["a b", "c", None, "d e f"]).slice(1))] == [2, 0, 6]
    # without marks of words' ends each word is encoded by itself
    ids.ends[:] = False
    assert _got(ids, ["new words here"]) == _want(ids, ["new words here"])
