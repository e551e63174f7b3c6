"""Exact, fast tokenisation with the ``tokenizers`` library.

The word BPE splits at white space before it merges, and none of its
normalisers looks across white space, so the ids of a text are the ids of its
ASCII-white-space separated words in order. It lower-cases, and breaks words
between letters and other marks, so A-Z may be lowered and a space put before a
mark that ends a run of letters without a change of ids (an apostrophe, which
can begin a piece with letters, is left alone, and so is everything where a
special token might be spelt). That leaves far fewer distinct words: Arrow
splits and dictionary-encodes them, the library encodes each once per worker,
and numpy expands the ids. ``tests/llm`` holds this against whole-text encoding.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, slices

VOCABULARY = "word_bpe_49k.json"
#: Distinct words after which a worker starts a new memo; it looks words up in the one before, too.
MEMO_WORDS = 150_000
#: Bytes of text that are encoded together; more of them share their words.
STEP_BYTES = 4 << 20

_LETTER_THEN_MARK = r"([a-z])([.,!?;:|])"


def public_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts; ``path`` names a vocabulary whose words end at white space."""

    _loaded: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def at(cls, path: str) -> "WordTokenizer":
        """One tokenizer per worker and path."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _learn(self, words: list[str]) -> None:
        """Encode new words: those of letters alone many to a text, as each ends at its only word-end id."""
        plain = [w for w in words if w.isalpha()]
        texts = [" ".join(plain[i : i + 512]) for i in range(0, len(plain), 512)]
        ids = array("I")
        for got in self.library.encode_batch_fast(texts, add_special_tokens=False):
            ids.extend(got.ids)
        ends = np.flatnonzero(self.word_end[np.frombuffer(ids, np.uint32)]) + 1 if plain else np.empty(0, np.int64)
        if len(ends) != len(plain):  # a vocabulary without word ends
            plain, ends = [], ends[:0]
        data, at = ids.tobytes(), 0
        for word, end in zip(plain, (ends * 4).tolist(), strict=True):
            self.memo[word] = data[at:end]
            at = end
        rest = [w for w in words if w not in self.memo]
        for word, got in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.memo[word] = array("I", got.ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = []
        for w in words:
            if w not in memo:
                if w in older:
                    memo[w] = older[w]
                else:
                    new.append(w)
        for i in range(0, len(new), 1 << 16):
            self._learn(new[i : i + (1 << 16)])
        return [memo[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of a slice of texts: ids as uint32, ends[i] to ends[i+1] of row i."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no text can spell a special token
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_THEN_MARK, r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(lists.offsets, np.int64)
        coded = lists.values.dictionary_encode()
        known = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        if not len(coded):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table = np.frombuffer(b"".join(known), "<u4")
        codes = coded.indices.to_numpy()
        per_word = sizes[codes]
        ids = table[ragged((np.cumsum(sizes) - sizes)[codes], per_word)]
        return ids, np.concatenate([[0], np.cumsum(per_word)])[offsets]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ends) for bounded slices of a text column."""
        for at, part in slices(column, STEP_BYTES):
            ids, ends = self.encode(part)
            yield at, ids, ends
