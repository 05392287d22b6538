"""Vectorised text kernel: tokens and their 64-bit hashes for a whole Arrow batch in numpy.

A token's hash is a polynomial over its code points, read from prefix sums: with
H[i] = sum(v[c_j] * P**j, j < i) mod 2**64, the token [s, e) has (H[e] - H[s]) * P**-s.
No Python object is made per token. Texts are handled whole: they are packed into blocks of about
BLOCK code points, and a longer text is cut only between tokens.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE, WORD, OTHER = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class (SPACE, WORD, OTHER), lower-cased code point, random value."""
    n = sys.maxunicode + 1
    kind = np.full(n, OTHER, np.uint8)
    lower = np.arange(n, dtype=np.uint32)
    for c in range(0x30000):
        s = chr(c)
        if s.isspace():
            kind[c] = SPACE
        elif s.isalnum() or s == "_" or unicodedata.category(s)[0] == "M":
            kind[c] = WORD
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return kind, lower, mix(np.arange(1, n + 1, dtype=np.uint64))


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i <= n."""
    if len(_POW[0]) <= n:
        size = max(n + 1, BLOCK + (BLOCK >> 3))
        for k, p in enumerate((_P, _PINV)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0], _POW[1]


def chunks(column: pa.Array, limit: int = CHUNK):
    """(from, to, texts) of consecutive rows with about `limit` bytes of text, so that what a task holds
    besides its Arrow batch doesn't depend on the batch's size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    which = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(column)]])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield low, high, column.slice(low, high - low).to_pylist()


class Tokens:
    """Tokens of a list of texts, in order: hash, doc (index of the text), start and end (code points in
    the text); counts: tokens by text."""

    __slots__ = ("hash", "doc", "start", "end", "counts", "prefix")

    def __init__(self, n: int, parts: list[tuple]) -> None:
        cat = lambda k, t: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t)
        self.hash, self.doc = cat(0, np.uint64), cat(1, np.int64)
        self.start, self.end = cat(2, np.int64), cat(3, np.int64)
        self.prefix = {k: np.concatenate([p[4][k] for p in parts]) for k in parts[0][4]} if parts else {}
        self.counts = np.bincount(self.doc, minlength=n)

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def _pieces(texts: list[str | None]):
    """(list of (text index, offset in the text, string)) of about BLOCK code points each."""
    block, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > BLOCK:
                end = at + BLOCK
                while end < len(t) and not t[end - 1].isspace():
                    end += 1
            block.append((i, at, t[at:end]))
            size += end - at
            at = end
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def code_points(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def tokenize(texts: list[str | None], punctuation: bool = False, lowered: bool = True, prefixes: tuple[int, ...] = ()) -> Tokens:
    """Words (runs of letters, marks, digits and underscores), lower-cased unless not lowered; with
    punctuation also the runs of other non-space characters. prefixes: lengths of word beginnings to
    hash as well (0 where the word is shorter). Null and empty texts have no tokens."""
    kind_of, lower, value = tables()
    parts = []
    for block in _pieces(texts):
        cps = code_points(["\n".join([*(s for _, _, s in block), ""])])
        kind = kind_of[cps]
        if not punctuation:
            kind = np.where(kind == WORD, kind, SPACE)
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        edge = np.concatenate([[0], edge, [len(cps)]])
        keep = kind[edge[:-1]] != SPACE
        start, end = edge[:-1][keep], edge[1:][keep]
        power, inverse = powers(len(cps))
        sums = np.empty(len(cps) + 1, np.uint64)
        sums[0] = 0
        v = value[lower[cps] if lowered else cps]
        v *= power[: len(cps)]
        np.cumsum(v, out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * inverse[start])
        more = {}
        for k in prefixes:
            stop = np.minimum(start + k, len(cps))
            more[k] = np.where(end - start >= k, mix((sums[stop] - sums[start]) * inverse[start]), np.uint64(0))
        lengths = np.fromiter((len(s) + 1 for _, _, s in block), np.int64, len(block))
        first = np.cumsum(lengths) - lengths
        which = np.searchsorted(first, start, side="right") - 1
        doc = np.fromiter((i for i, _, _ in block), np.int64, len(block))[which]
        shift = np.fromiter((a for _, a, _ in block), np.int64, len(block))[which] - first[which]
        parts.append((hashes, doc, start + shift, end + shift, more))
    return Tokens(len(texts), parts)


def word_hash(word: str) -> int:
    """The hash that tokenize gives the lower-cased word (or word beginning)."""
    _, lower, value = tables()
    cps = lower[code_points([word])]
    power, _ = powers(len(cps))
    with np.errstate(over="ignore"):
        return int(mix(np.array([(value[cps] * power[: len(cps)]).sum(dtype=np.uint64)]))[0])


def shingles(tokens: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-token shingles and their documents; the shingle at i begins with token i.
    A document with 1 to k - 1 tokens has one shingle, of all of them."""
    h, doc, n = tokens.hash, tokens.doc, len(tokens.hash)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    offsets = tokens.offsets
    left = offsets[doc + 1] - np.arange(n)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        c = np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1))
        m = n - j
        if m <= 0:
            break
        ok = left[:m] > j
        total[:m] += np.where(ok, h[j:] * c, np.uint64(0))
    first = np.arange(n) == offsets[doc]
    keep = (left >= k) | first
    return mix(total[keep]), doc[keep]
