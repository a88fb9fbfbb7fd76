"""Token ids of whole texts, with a bounded cache of words in each Python worker.

The tokenizer works on words: white space only parts them.  So a text is cut at
blanks and line ends, each distinct piece is encoded once, and a text's ids are
gathered from the ids of its pieces, for a batch of texts at once.  Pieces are
known by a hash of 64 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from fieldrecon.llm.common import worker_cache
from fieldrecon.llm.shingles import runs

#: pieces kept in a worker's cache (about 40 bytes each)
CACHE = 600_000
#: words encoded in one call
JOINED = 2_000
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123]] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True
#: marks that are a token of their own behind a letter or a digit
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def _pieces(data: bytes) -> bytes:
    """`data` with a blank before every mark that closes a piece behind a letter or a digit."""
    b = np.frombuffer(data, np.uint8)
    closing = _MARK[b]
    closing[1:] &= _ALNUM[b[:-1]]
    closing[:1] = False
    closing[:-1] &= _BLANK[b[1:]]
    at = np.flatnonzero(closing)
    return np.insert(b, at, 32).tobytes() if at.size else data


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # for words of letters in lower case there is nothing to normalise or to look for
        self.simple = Tokenizer.from_file(path)
        self.simple.normalizer = normalizers.Sequence([])
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        """Empties the cache: hashes of known pieces, ascending, with their slots, and where a slot's ids lie in the pool."""
        self.known, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, "<u4"), 0

    def _odd(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only: joined, encoded in one call, and parted again at the tokens that end a word."""
        ids = np.array(self.simple.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        # no cut for each word: a letter that isn't one to the tokenizer
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else self._odd(words)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Stores the ids of new pieces; their slots."""
        # letters up to U+024F: lower case there is one letter for one letter
        plain = [p.isalpha() and (p.isascii() or max(p) < "ɐ" and "İ" not in p) for p in pieces]
        words = [p.lower() for p, ok in zip(pieces, plain, strict=True) if ok]
        odd = [p for p, ok in zip(pieces, plain, strict=True) if not ok]
        found = [self._words(words[lo : lo + JOINED]) for lo in range(0, len(words), JOINED)] + ([self._odd(odd)] if odd else [])
        new, size = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        n, m = len(self.known), len(size)
        while n + m > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(new)] = new
        self.start[n : n + m], self.length[n : n + m] = self.used + np.cumsum(size) - size, size
        self.used += len(new)
        slots = np.empty(m, np.int32)
        slots[np.argsort(~np.array(plain), kind="stable")] = np.arange(n, n + m)
        return slots

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens."""
        # upper case of A-Z makes no difference, but in the names of special tokens
        raw = [_pieces(t.encode() if "<|" in t else t.encode().lower()) for t in texts]
        data = b"\n".join(raw)
        hashes, starts, ends = runs(data, _BLANK)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            at = first[new]
            pieces = [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            slots = self._learn(pieces)
            self.known, self.slots = np.insert(self.known, place[new], distinct[new]), np.insert(self.slots, place[new], slots)
            place = np.searchsorted(self.known, distinct)
        slot = self.slots[place][inverse]
        size = self.length[slot]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.repeat(self.start[slot] - (upto - size), size) + np.arange(total)]
        # ids of a text: those of the pieces before its end
        pieces_before = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in raw]))
        cuts = (4 * np.concatenate([[0], upto])[pieces_before]).tolist()
        out = ids.tobytes()
        return [out[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    return Encoder(path)


worker_cache(encoder.cache_clear)
