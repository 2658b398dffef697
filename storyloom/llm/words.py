"""Words of a whole Arrow batch at once: byte ranges and 64-bit hashes as numpy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; in UTF-8 that is the same as the
code-point class ``[^\\x20\\x09-\\x0D]+``, for those bytes occur in no longer sequence.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

U = np.uint64
P = U(0x9E3779B97F4A7C15)
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint8(32), _BYTES).astype(np.uint8)
#: Also turns ASCII punctuation and control bytes into spaces.
PLAIN = np.where((LOWER >= 128) | ((LOWER >= 97) & (LOWER <= 122)) | ((LOWER >= 48) & (LOWER <= 57)), LOWER, np.uint8(32)).astype(np.uint8)


class Words:
    """buf: the batch's bytes; doc: start of each document's words in start/end/hash (one more at the end)."""

    def __init__(self, texts: pa.Array, translate: np.ndarray | None = None, hashes: bool = True):
        """translate: 256 bytes that replace the text's bytes first."""
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        texts = pa.compute.fill_null(texts, b"")
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        self.buf = buf = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.doc_bytes = ends - ends[0]
        if translate is not None:
            self.buf = buf = translate[buf]
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[:-1] = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        cut = np.zeros(len(buf) + 1, np.int8)
        cut[0] = 1
        cut[self.doc_bytes[:-1][self.doc_bytes[:-1] < len(buf)]] = 1  # a word never runs on into the next document
        before = np.concatenate([np.zeros(1, np.int8), inside[:-1]])
        first = (inside == 1) & ((before == 0) | (cut == 1))
        last = (before == 1) & ((inside == 0) | (cut == 1))
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last)
        self.doc = np.searchsorted(self.start, self.doc_bytes)
        self.n = np.diff(self.doc)
        self.hash = self._hashes() if hashes else None

    def _hashes(self) -> np.ndarray:
        """mix of a polynomial of the word's bytes, its length added; words over LONG bytes by a digest of theirs."""
        size = self.end - self.start
        order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int8), kind="stable")  # the longest first: step k takes a slice
        start, sizes = self.start[order], size[order]
        value = np.zeros(len(order), U)
        left = np.cumsum(np.bincount(np.minimum(size, LONG), minlength=LONG + 1)[::-1])[::-1]  # words of k bytes or more
        for k in range(LONG):
            n = int(left[k + 1])
            if not n:
                break
            value[:n] *= P
            value[:n] += self.buf[start[:n] + k]
        value = mix(value + sizes.astype(U) * U(0xD1B54A32D192ED03))
        for k in range(int((sizes > LONG).sum())):
            value[k] = int.from_bytes(blake2b(self.buf[start[k] : start[k] + sizes[k]].tobytes(), digest_size=8).digest())
        out = np.empty_like(value)
        out[order] = value
        return out

    def of(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)


def ngram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len - n + 1 values; positions near a document's end run over it)."""
    if len(word_hash) < n:
        return np.zeros(0, U)
    m = len(word_hash) - n + 1
    x = word_hash[:m].copy()
    for i in range(1, n):
        x *= P
        x += word_hash[i : i + m]
        x ^= x >> U(32)
    return mix(x)


def starts_with_room(doc: np.ndarray, n: int) -> np.ndarray:
    """Mask over all words: n words of the same document follow from here on, this one included."""
    counts = np.diff(doc)
    left = np.repeat(doc[1:], counts) - np.arange(doc[-1])
    return left >= n
