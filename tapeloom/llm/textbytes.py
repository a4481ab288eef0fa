"""Words of whole texts as numpy arrays over UTF-8 bytes, a few megabytes at a time.

A word hash is a polynomial over the bytes of the word. With running sums of ``byte * R**i`` the
hash of any span costs one subtraction and one multiplication by ``R**-start`` (R is odd, so it
has an inverse modulo 2**64), so all words of many texts are hashed without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_BYTES = np.arange(256)
_ALNUM = ((_BYTES >= 48) & (_BYTES < 58)) | ((_BYTES >= 65) & (_BYTES < 91)) | ((_BYTES >= 97) & (_BYTES < 123)) | (_BYTES >= 128)
_SPACE = (_BYTES <= 32) | (_BYTES == 127)
#: 0 between tokens, 1 in a word, 2 in a run of punctuation.
_KIND = np.where(_ALNUM, 1, np.where(_SPACE, 0, 2)).astype(np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES < 91), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1)
_AS_IS = _BYTES.astype(np.uint64) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of each element."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        grown[0] = 1
        have = _powers[base] = np.cumprod(grown)
    return have[:n]


@dataclass
class Tokens:
    """Tokens of consecutive texts: per token its text (an index) and its hash; ``prefixes`` by length."""

    text: np.ndarray
    hash: np.ndarray
    prefixes: dict[int, np.ndarray]


def _tokens(data: np.ndarray, offsets: np.ndarray, lower: bool, punctuation: bool, prefix_bytes: tuple[int, ...]) -> Tokens:
    """offsets: where each text begins in data, and the end of the last."""
    n = len(data)
    kind = _KIND[data]
    if not punctuation:
        kind[kind == 2] = 0
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offsets] = True
    cuts = np.flatnonzero(change)
    keep = kind[cuts[:-1]] > 0
    start, end = cuts[:-1][keep], cuts[1:][keep]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _AS_IS)[data] * _powers_of(_R, n), out=sums[1:])
    back = _powers_of(_R_INVERSE, n + 1)[start]

    def hashed(to: np.ndarray) -> np.ndarray:
        return mix64((sums[to] - sums[start]) * back + (to - start).astype(np.uint64))

    text = np.searchsorted(offsets, start, side="right") - 1
    return Tokens(text, hashed(end), {k: hashed(np.minimum(end, start + k)) for k in prefix_bytes})


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text in pieces that end between tokens."""
    at = 0
    while len(data) - at > 2 * CHUNK_BYTES:
        gap = np.flatnonzero(_KIND[data[at + CHUNK_BYTES:]] == 0)
        if not len(gap):
            break
        to = at + CHUNK_BYTES + int(gap[0])
        yield data[at:to]
        at = to
    yield data[at:]


def token_chunks(texts: pa.Array, lower: bool = True, punctuation: bool = False, prefix_bytes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, Tokens]]:
    """(first text, one past the last, their tokens) for runs of about a megabyte; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        part = data[offsets[first]:offsets[last]]
        if last == first + 1 and len(part) > 2 * CHUNK_BYTES:
            found = [_tokens(x, np.array([0, len(x)]), lower, punctuation, prefix_bytes) for x in _pieces(part)]
            yield first, last, Tokens(*[np.concatenate([getattr(x, name) for x in found]) for name in ("text", "hash")], {
                k: np.concatenate([x.prefixes[k] for x in found]) for k in prefix_bytes})
        else:
            yield first, last, _tokens(part, offsets[first:last + 1] - offsets[first], lower, punctuation, prefix_bytes)
        first = last


def shingles(tokens: Tokens, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a text of fewer words gives one run of all its words."""
    text, words = tokens.text, tokens.hash
    count = np.bincount(text, minlength=n_texts)
    begin = np.concatenate(([0], np.cumsum(count)))
    long = len(words) - size + 1
    if long > 0:
        run = np.zeros(long, dtype=np.uint64)
        for i in range(size):
            run = mix64(run + words[i:i + long])
        inside = text[:long] == text[size - 1:]
        run, owner = run[inside], text[:long][inside]
    else:
        run, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=text.dtype)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for i in range(size - 1):
            more = count[short] > i
            whole[more] = mix64(whole[more] + words[begin[short[more]] + i])
        owner, run = np.concatenate([owner, short]), np.concatenate([run, whole])
    return owner, run
