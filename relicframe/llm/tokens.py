"""Token ids of whole texts in Python tasks.

The word tokenizer drops white space and never joins pieces across it, so a
text's ids are its words' ids in a row. Each worker keeps the ids of the words
it has seen; Arrow finds the distinct words of a group of texts, and each costs one lookup.
Words of letters that it has not seen are encoded many at a time, as one text; the marks of
words' ends part their ids. Lower-case Latin words need no more than the tokenizer's own
merges: its normalizer and pattern would leave each of them as it is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: What a worker remembers before it starts afresh with the next group: other words, and words of letters without their end marks,
#: of which as many again that were found before stay until then.
CACHED_WORDS = 50_000
CACHED_CORES = 200_000
CACHED_LENGTH = 64
#: Bytes of texts whose words are looked up together, each word once, and new words that are encoded together.
GROUP_BYTES = 4 << 20
JOINED_WORDS = 1000
#: Latin letters below the first stay one letter each in lower case, but for the second.
FIRST_UNSURE, TAKEN_APART = "\u0250", "\u0130"
#: Words of letters below this one can be handed to the merges as they are, in lower case.
FIRST_INDIRECT = "\u0180"
#: What the tokenizer puts at the end of a word's last piece.
WORD_END = "</w>"
#: ASCII marks that the tokenizer always cuts from letters before them (the apostrophe is not one).
END_MARKS = b".,;:!?\"()[]{}|*#$%&<>-_/"


def _merges_alone(tokenizer):
    """The tokenizer without normalizer and pattern, for lower-case Latin words between spaces; the tokenizer itself where those do more to such words."""
    from tokenizers import Tokenizer, pre_tokenizers

    letters = [c for c in map(chr, range(ord(FIRST_INDIRECT))) if c.isalpha() and c != TAKEN_APART]
    lower = [c.lower() for c in letters]
    probe = " ".join(["".join(lower), *lower])
    alone = Tokenizer(tokenizer.model)
    alone.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    same = tokenizer.normalizer.normalize_str(" ".join(["".join(letters), *letters])) == probe
    cut = [[piece for piece, _ in t.pre_tokenizer.pre_tokenize_str(probe)] for t in (tokenizer, alone) if t.pre_tokenizer]
    return alone if same and len(cut) == 2 and cut[0] == cut[1] else tokenizer


def _listed(values: pa.Array) -> list[bytes]:
    """As to_pylist(), without an Arrow scalar for each."""
    return values.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _tails(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows in each word after as many bytes as its head has."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + len(words) + 1]
    lengths = (pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    at = np.repeat(ends - starts[1:], lengths) + np.arange(starts[-1])
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at]
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(starts), pa.py_buffer(data)])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


class WordIds(dict):
    """word (bytes) -> its ids as little-endian numbers of ``kind``: 16 bits if all ids of the tokenizer fit, else 32.

    Words of letters, and the marks after them, are kept apart in ``cores`` and, for some time after their last use, ``older``.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.encode_fast, self.normalize = tokenizer.encode, tokenizer.encode_batch_fast, tokenizer.normalizer.normalize_str
        self.merge_fast = _merges_alone(tokenizer).encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        most = max(vocabulary.values(), default=0)
        self.kind = "<u2" if most < 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.ends = np.zeros(most + 1, bool)
        self.ends[[number for piece, number in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.cores: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, word: bytes) -> bytes:
        return np.asarray(self.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes()

    def _core(self, core: bytes) -> bytes:
        data = self.cores.get(core)
        if data is None:
            data = self._encoded(core)
            if len(core) <= CACHED_LENGTH:
                self.cores[core] = data
        return data

    def _plain(self, letters: bytes) -> bool:
        if not letters or letters.isascii():
            return letters.isalpha()
        text = letters.decode("utf-8", "replace")
        if text.isalpha() and max(text) < FIRST_UNSURE and TAKEN_APART not in text:
            return True
        # what the tokenizer makes of them decides: letters that it takes apart may end in a combining mark, which joins what follows,
        # and some marks join a letter in lower case alone, where it matters that the tokenizer composes first
        made = self.normalize(text)
        return made.isalpha() and made == self.normalize(letters.upper().decode("utf-8", "replace"))

    def __missing__(self, word: bytes) -> bytes:
        data = self._encoded(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = data
        return data

    def _joined(self, encode_fast, cores: list[bytes], texts: list[str]) -> None:
        """Keep the ids of words of letters, encoded as one text; if its pieces are not one a word, each is left to be encoded by itself."""
        [found] = encode_fast([" ".join(texts)], add_special_tokens=False)
        ids = np.asarray(found.ids, self.kind)
        last = (self.width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(last) == len(cores):
            data, at = ids.tobytes(), 0
            for core, to in zip(cores, last, strict=True):
                self.cores[core], at = data[at:to], to

    def _learn(self, cores: list[bytes]) -> None:
        """Keep the ids of new words of letters."""
        direct, other = ([], []), ([], [])
        for core in cores:
            if len(core) <= CACHED_LENGTH:
                text = core.decode("utf-8", "replace")
                kept, texts = direct if core.isascii() or max(text) < FIRST_INDIRECT else other
                kept.append(core)
                texts.append(text)
        for encode_fast, (kept, texts), lower in ((self.merge_fast, direct, True), (self.encode_fast, other, False)):
            for at in range(0, len(kept), JOINED_WORDS):
                part = texts[at : at + JOINED_WORDS]
                self._joined(encode_fast, kept[at : at + JOINED_WORDS], [x.lower() for x in part] if lower else part)

    def _of_cores(self, cores: list[bytes]) -> list[bytes | None]:
        """The ids of each word of letters, None for other words."""
        data = list(map(self.cores.get, cores))
        new = []
        for i, found in enumerate(data):
            if found is None:
                core = cores[i]
                data[i] = found = self.older.get(core)
                if found is not None:
                    self.cores[core] = found
                elif self._plain(core):
                    new.append(i)
        self._learn([cores[i] for i in new])
        for i in new:
            data[i] = self._core(cores[i])
        return data

    def _of_words(self, words: pa.Array) -> pa.Array:
        """The ids of each of these distinct words; those of new letters are kept."""
        # letters and the marks after them are pieces of their own; case does not count
        cores = pc.ascii_lower(pc.ascii_rtrim(words, characters=END_MARKS.decode()))
        marks = _tails(words, cores).dictionary_encode()
        cores = cores.dictionary_encode()
        letters = pa.array(self._of_cores(_listed(cores.dictionary)), pa.binary()).take(cores.indices)
        after = pa.array(list(map(self._core, _listed(marks.dictionary))), pa.binary()).take(marks.indices)
        found = pc.binary_join_element_wise(letters, after, b"")
        if found.null_count:
            other = found.is_null()
            found = pc.replace_with_mask(found, other, pa.array(list(map(self.__getitem__, _listed(words.filter(other)))), pa.binary()))
        return found

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """All ids of each of the texts, as numbers of ``kind``; none for null."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            upto = (ends[at - 1] if at else 0) + GROUP_BYTES
            to = max(at + 1, int(np.searchsorted(ends, upto, "right")))
            yield from self._ids(texts.slice(at, to - at))
            at = to

    def _ids(self, texts: pa.Array) -> Iterator[bytes]:
        # between groups alone: within one, what was just kept would go
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(self.cores) >= CACHED_CORES:
            self.cores, self.older = {}, self.cores
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found = self._of_words(coded.dictionary).take(coded.indices)
        _, starts, data = found.buffers()
        starts = np.frombuffer(starts, np.int32)[split.offsets.to_numpy()].tolist() if len(found) else [0] * (len(texts) + 1)
        ids = memoryview(data or b"")
        for start, end in zip(starts, starts[1:], strict=False):
            yield bytes(ids[start:end])

    def text(self, text: bytes | None) -> bytes:
        """All ids of a text in 32 bits each; none for null."""
        [ids] = self.texts(pa.array([text], pa.binary()))
        return np.frombuffer(ids, self.kind).astype("<u4").tobytes()


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The WordIds of this worker process, which later tasks find warm."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
