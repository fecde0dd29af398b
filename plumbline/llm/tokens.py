"""A tokenizer file and a per-process memo of what its library gives for each word."""

from __future__ import annotations

import hashlib
import os

import numpy as np

#: Words that the memo of a Python worker holds; beyond that it starts anew.
MEMO_WORDS = 400_000
_open: dict[str, "WordTokenizer"] = {}


def tokenizer(path: str) -> "WordTokenizer":
    """The tokenizer of a file, loaded once for each Python worker."""
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]


class WordTokenizer:
    """Encodes text with the tokenizers library, one white-space delimited word at a time.

    The vocabulary drops white space and no token, normalisation or special string reaches over
    it, so the ids of a text are those of its words, one after another. Words are memoised: a
    corpus has far fewer distinct words than words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.strings = [self.library.id_to_token(i) or "" for i in range(size)]
        self.ids: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        missing = [w for w in words if w not in self.ids]
        if len(self.ids) + len(missing) > MEMO_WORDS:
            self.ids.clear()
            missing = list(words)
        for lo in range(0, len(missing), 4096):
            part = missing[lo : lo + 4096]
            for w, e in zip(part, self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.ids[w] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [t.split() for t in texts]  # bytes.split() cuts at ASCII white space alone
        self.learn(set().union(*split) if split else set())
        get = self.ids.__getitem__
        return [b"".join(map(get, w)) for w in split]

    def counts(self, texts: list[bytes]) -> list[int]:
        return [len(x) // 4 for x in self.encode(texts)]

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False) for a file without a decoder: tokens joined by blanks."""
        return " ".join([self.strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


def version_digest(path: str) -> str:
    """SHA-256 over the tokenizer file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
