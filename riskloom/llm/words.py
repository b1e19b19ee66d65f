"""Words of whole texts as arrays: byte ranges and 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# texts are worked off in pieces of about this many bytes, cut between words
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what each byte counts as."""

    inside: np.ndarray
    folded: np.ndarray


def alphabet(separators: str, lower: bool) -> Alphabet:
    inside = np.ones(256, bool)
    inside[np.frombuffer(separators.encode("latin-1"), np.uint8)] = False
    folded = np.arange(256, dtype=np.uint8)
    if lower:
        folded[65:91] += 32
    return Alphabet(inside, folded)


# words [^\x20\x09-\x0D]+, unchanged
UNCHANGED = alphabet(" \t\n\x0b\x0c\r", lower=False)
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z in lower case: bytes that are capitals count as inside
FOLDED = alphabet(
    "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])), lower=True
)
WHITE_FOLDED = alphabet(" \t\n\x0b\x0c\r", lower=True)


def finished(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < count:
            size = max(count, PIECE + 4096)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


@dataclass
class Words:
    """All words of consecutive texts. ``data`` holds the folded bytes, text t from ``offset[t]`` on; word w is
    data[start[w]:end[w]]; text t has the words first[t] to first[t + 1] - 1. ``affix[k]`` hashes the first k bytes
    of each word, or its last -k."""

    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashed: np.ndarray
    first: np.ndarray
    affix: dict[int, np.ndarray]

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        counts = np.diff(self.first)
        return np.repeat(self.first[1:], counts) - np.arange(len(self.hashed))

    def joined(self, begin: int, stop: int) -> bytes:
        raw, start, end = self.data, self.start, self.end
        return b" ".join(raw[start[w] : end[w]].tobytes() for w in range(begin, stop))

    def shingles(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on; meaningless where fewer are left."""
        total = self.hashed.copy()
        factor = 1
        for step in range(1, min(length, len(total))):
            factor = factor * STEP % 2**64
            total[: len(total) - step] += self.hashed[step:] * np.uint64(factor)
        return finished(total + np.uint64(length))


def ends_of_pieces(inside: np.ndarray, size: int) -> Iterator[int]:
    """Ends of pieces of about PIECE bytes; never inside a word."""
    at = 0
    while size - at > PIECE:
        at += PIECE
        while at < size and inside[at]:
            gap = np.flatnonzero(~inside[at : at + 65536])
            at = at + int(gap[0]) if len(gap) else min(size, at + 65536)
        yield at
    if at < size:
        yield size


def slices(texts: pa.Array, held: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes together, one row at least."""
    filled = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(texts) + 1]
    sizes = offsets + 32 * np.arange(len(texts) + 1)
    begin = 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + held, side="right")) - 1)
        yield begin, stop
        begin = stop


def words_of(texts: pa.Array, letters: Alphabet, affixes: tuple[int, ...] = ()) -> Words:
    """NULL and empty texts have no words."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data, inside = letters.folded[raw], letters.inside[raw]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:]
    border = offsets[(offsets > 0) & (offsets < len(raw))]
    starts_here[border] = inside[border]
    ends_here[border - 1] = inside[border - 1]
    start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    hashed = np.empty(len(start), np.uint64)
    affix = {k: np.empty(len(start), np.uint64) for k in affixes}
    begin, word = 0, 0
    for stop in ends_of_pieces(inside, len(raw)):
        until = int(np.searchsorted(start, stop))
        up, down = Powers.to(stop - begin + 1)
        total = np.zeros(stop - begin + 1, np.uint64)
        np.cumsum((data[begin:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - begin], out=total[1:])
        s, e = start[word:until] - begin, end[word:until] - begin
        hashed[word:until] = finished((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        for k, hashes in affix.items():
            low, high = (s, np.minimum(e, s + k)) if k > 0 else (np.maximum(s, e + k), e)
            hashes[word:until] = finished((total[high] - total[low]) * down[low] + np.uint64(k % 256 << 32))
        begin, word = stop, until
    return Words(data, offsets, start, end, hashed, np.searchsorted(start, offsets), affix)
