"""Token ids of whole texts from the ``tokenizers`` library, through a cache of words bounded in bytes.

The vocabulary used here drops white space and never joins two sides of it, so the ids of a text are those of its
chunks between ASCII white space, one after the other; lower-casing A-Z first changes nothing either, as the tokenizer
lower-cases. A worker therefore asks the library only for chunks that it has not met lately. A chunk that ends in
punctuation after a letter or digit is its stem and that punctuation, whose pre-tokens are apart.

Strings that look like special tokens are matched before all this, in their own case and across any chunk; a text that
may hold one is given to the library as it stands.
"""

from __future__ import annotations

import os

import numpy as np

from leadweave.llm._shared import worker_cache

#: Bytes that a worker's cache takes, about: two generations of half as many.
CACHE_BYTES = 64 << 20
#: Bytes of an entry besides its chunk and ids: two object heads and its share of the table.
ENTRY_BYTES = 170
#: A longer chunk is encoded each time.
CHUNK_BYTES = 64
#: Punctuation that a chunk may end in: no pre-token holds a letter or a digit and one of these (not so an apostrophe).
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _ends_in_word(stem: bytes) -> bool:
    """The last character is a letter or digit that stays one when the library normalises the text."""
    if stem[-1:] < b"\x80":
        return stem[-1:].isalnum()
    last = stem.decode("utf-8", "replace")[-1]
    return last < "\u0180" and last.isalpha() and last != "\u0130"


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: First characters of special tokens: a text without them holds none.
        self.special = {t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.bytes = 0

    def _keep(self, w: bytes, ids: bytes) -> None:
        self.young[w] = ids
        self.bytes += ENTRY_BYTES + len(w) + len(ids)

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks from the library."""
        out = {}
        # words of plain letters are one pre-token each, so many of them make one text, whose tokens know their word
        plain, other = [], []
        for w in words:
            t = w.decode("utf-8", "replace")
            (plain if len(w) <= CHUNK_BYTES and t.isalpha() and max(t) < "\u0180" else other).append((w, t))
        for lo in range(0, len(plain), 1024):
            some = plain[lo : lo + 1024]
            e = self.tokenizer.encode(" ".join([t for _, t in some]), add_special_tokens=False)
            ids, word = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            if word[-1] != len(some) - 1:
                other += some
                continue
            at = np.searchsorted(word, np.arange(len(some) + 1)).tolist()
            for (w, _), x, y in zip(some, at, at[1:]):
                out[w] = ids[4 * x : 4 * y]
        for lo in range(0, len(other), 1024):
            some = other[lo : lo + 1024]
            for (w, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
                out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Bring words into the young generation; returns those that are too long to be kept."""
        extra, ask, made = {}, set(), []
        young, old = self.young, self.old
        for w in words:
            if (ids := old.get(w)) is not None:
                self._keep(w, ids)
            elif len(stem := w.rstrip(PUNCTUATION)) < len(w) and _ends_in_word(stem):
                made.append((w, stem, w[len(stem) :]))
            else:
                ask.add(w)
        parts = {}
        for _, stem, tail in made:
            for x in (stem, tail):
                if x not in young and x not in parts:
                    if (ids := old.get(x)) is not None:
                        parts[x] = ids
                    else:
                        ask.add(x)
        parts |= self._encode(list(ask))
        for w, ids in parts.items():
            if len(w) > CHUNK_BYTES:
                extra[w] = ids
            else:
                self._keep(w, ids)
        for w, stem, tail in made:
            ids = (parts[stem] if stem in parts else young[stem]) + (parts[tail] if tail in parts else young[tail])
            if len(w) > CHUNK_BYTES:
                extra[w] = ids
            else:
                self._keep(w, ids)
        return extra

    def ids(self, text: bytes | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        text = text or b""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        if 2 * self.bytes > CACHE_BYTES:
            self.old, self.young, self.bytes = self.young, {}, 0
        extra = self._learn(set(words).difference(self.young))
        if extra:
            return b"".join([extra[w] if w in extra else self.young[w] for w in words])
        return b"".join(map(self.young.__getitem__, words))


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept between tasks."""
    return worker_cache(("words", path), lambda: WordTokenizer(path))
