"""Token ids of whole texts by a public word-level BPE file, with the ids of each word kept in the worker.

The file's rules split a text into words before any merge, so a text's ids are its words' ids in a row. Texts of ASCII
and Latin-1 letters without apostrophes (whose rule looks at what follows) are split here, all at once, and each distinct
word is encoded once per worker; words are told apart by 64-bit hashes. All other texts go through the library whole. The
word table is emptied when it would pass ``WORDS_KEPT`` words.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .hashing import prefix_hash, range_hash

WORDS_KEPT = 2_000_000
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]*")
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256)], np.uint8)
#: Kinds of the characters above: 0 white, 1 letter, 2 digit (a word each), 3 other.
_KIND = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if chr(c).isalpha() else 2 if 48 <= c <= 57 else 3 for c in range(256)], np.uint8)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids: list[list[int]] = []
        for a in range(0, len(words), 4096):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + 4096], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, np.fromiter((x for own in ids for x in own), np.uint32, int(n.sum()))])
        keys, at, n = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.n, n])
        order = np.argsort(keys)
        self.keys, self.at, self.n = keys[order], at[order], n[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids per text, as uint32."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain: list[int] = []
        for i, t in enumerate(texts):
            if "<|" in t or not _PLAIN.fullmatch(t):
                # one at a time: such a text may be long
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
        for i, x in zip(plain, self._encode_plain([texts[i] for i in plain]), strict=True):
            out[i] = x
        return out

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        data = _LOWER[np.frombuffer("\n".join(texts).encode("latin-1") + b"\n", np.uint8)]
        kind = _KIND[data]
        turn = np.ones(len(data), bool)
        turn[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge = np.flatnonzero(turn)
        ends = np.append(edge[1:], len(data))
        solid = kind[edge] != 0
        start, end = edge[solid], ends[solid]
        words, inverse = np.unique(range_hash(prefix_hash(data), start, end), return_inverse=True)
        where = np.searchsorted(self.keys, words)
        known = (where < len(self.keys)) & (self.keys[np.minimum(where, len(self.keys) - 1)] == words) if len(self.keys) else np.zeros(len(words), bool)
        if not known.all():
            if len(self.keys) + len(words) > WORDS_KEPT:
                self._clear()
                known[:] = False
            # a place where each new word stands
            one = np.empty(len(words), np.int64)
            one[inverse] = np.arange(len(inverse))
            one = one[~known]
            raw = data.tobytes()
            self._learn(words[~known], [raw[a:b].decode("latin-1") for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
            where = np.searchsorted(self.keys, words)
        at, n = self.at[where][inverse], self.n[where][inverse]
        upto = np.cumsum(n)
        ids = self.pool[np.repeat(at - upto + n, n) + np.arange(int(n.sum()))] if len(n) else np.zeros(0, np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        cuts = np.concatenate([[0], upto])[np.searchsorted(start, begin)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
