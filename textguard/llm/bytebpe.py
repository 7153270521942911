"""Byte-level BPE over many short segments: each distinct segment is encoded once per Python worker.

A segment is a run of white space and the run of other characters after it. The byte-level split
pattern never spans a change from other characters to white space and looks behind nowhere, so a
text's tokens are its segments' tokens in order (``whole`` holds the same for texts with added
tokens, as long as those take no white space along).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np

#: The white space of the byte-level split pattern (tests compare it with the library over all code points).
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Distinct segments that a worker remembers before it starts anew, and the longest one it remembers.
REMEMBER, LONGEST = 400_000, 64

#: Remembered ids, the longer segments' included, beyond which it starts anew.
REMEMBER_IDS = 8_000_000


def splits_at_space(spec: bytes) -> bool:
    """Whether a tokenizer file is byte-level BPE whose tokens never cross from other characters to white space."""
    j = json.loads(spec)
    pre = j.get("pre_tokenizer") or {}
    plain = all(not t.get(k) for t in j.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    inked = all(not re.search(f"[{SPACE}]", t["content"]) for t in j.get("added_tokens", []))
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and j.get("normalizer") is None
            and j.get("post_processor") is None and j["model"]["type"] == "BPE" and plain and inked)


def tokenizer(spec: bytes, plain: bool):
    """The library's tokenizer; ``plain``: the strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    t = Tokenizer.from_buffer(spec)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = plain
    return t


def byte_lengths(tok) -> np.ndarray:
    """Bytes of every id: an entry of the vocabulary stands for one byte a character, an added token for its text."""
    size = max(tok.get_vocab(True).values()) + 1
    out = np.zeros(size, np.int64)
    for s, i in tok.get_vocab(False).items():
        out[i] = len(s)
    for i, t in tok.get_added_tokens_decoder().items():
        out[i] = len(t.content.encode())
    return out


class Segments:
    """Token ids of segments, remembered in one growing array."""

    pattern = _SEGMENT

    def __init__(self, spec: bytes, plain: bool):
        self.tok = tokenizer(spec, plain)
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(1 << 16, np.int32)

    def look(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of each segment of the texts, number of segments of each text); valid until the next call."""
        if len(self.index) > REMEMBER or self.start[-1] > REMEMBER_IDS:
            self._clear()
        words = [self.pattern.findall(t) for t in texts]
        flat = list(chain.from_iterable(words))
        index, long = self.index, []
        try:
            at = [index[w] for w in flat]
        except KeyError:
            new = [w for w in dict.fromkeys(flat) if w not in index]
            # a text that is all one segment may be huge: such segments are encoded alone, not remembered after this call
            long = [w for w in new if len(w) > LONGEST]
            for a in range(0, len(new), 4096):
                part = new[a:a + 4096]
                self._add(part, self._encode(part))
            at = [index[w] for w in flat]
        for w in long:
            del index[w]
        return np.array(at, np.int64), np.fromiter(map(len, words), np.int64, len(words))

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _add(self, words: list[str], ids: list[list[int]]):
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        base = len(self.start) - 1
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        end = int(self.start[-1])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end - len(self.ids), len(self.ids)), np.int32)])
        self.ids[end - int(n.sum()):end] = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        self.index.update(zip(words, range(base, base + len(words))))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        at, each = self.look(texts)
        total = np.concatenate([[0], np.cumsum(self.start[at + 1] - self.start[at])])
        end = np.cumsum(each)
        return total[end] - total[end - each]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        return self.gathered(*self.look(texts))

    def gathered(self, at: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``tokens`` of texts that ``look`` gave as ``at`` and ``each``."""
        n = self.start[at + 1] - self.start[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])]
        end = np.cumsum(each)
        return ids, total[end] - total[end - each]


_kept: dict[tuple[str, bool], Segments] = {}


def segments(spec: bytes, plain: bool) -> Segments:
    """The worker's segments for this tokenizer file."""
    key = (hashlib.sha256(spec).hexdigest(), plain)
    if key not in _kept:
        _kept[key] = Segments(spec, plain)
    return _kept[key]
