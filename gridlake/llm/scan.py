"""Vectorised word scanning of UTF-8 bytes: words, exact numbers of equal spans, hashes of spans and n-grams."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

#: The separators of words, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95))
_LONG = np.uint64(1 << 63)
#: Spans up to so many bytes are read eight bytes at a time, all spans together; longer ones one by one.
LANES = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, and n + 1 offsets of the texts' words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    # a text's first byte never continues the word before it
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # within a run of word bytes
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


class Spans:
    """Stretches of bytes. short_key tells spans of up to seven bytes apart exactly: their bytes and length."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
        self.data, self.starts, self.size = data, starts, ends - starts
        self.long = np.flatnonzero(self.size > 7)
        left = np.minimum(self.size, 7).astype(np.uint64)
        self.short_key = (self.lanes[starts] & ((np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))) | (left << np.uint64(56))

    def lane(self, which: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes from `at` of spans longer than that; bytes past a span's end are zero."""
        left = np.minimum(self.size[which] - at, 8).astype(np.uint64)
        return self.lanes[self.starts[which] + at] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))

    def of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.size[i]].tobytes()

    def keys(self, seed: int = 0) -> np.ndarray:
        """short_key, or a 63-bit hash below a set highest bit: of one-by-one mixed lanes, or BLAKE2 of a long span."""
        out = self.short_key
        if len(self.long):
            out = out.copy()
            which = self.long
            state = mix(self.size[which].astype(np.uint64) * _ODD + _SEEDS[seed])
            live = np.flatnonzero(self.size[which] <= LANES)
            at = 0
            while len(live):
                state[live] = mix((state[live] ^ self.lane(which[live], at)) * _ODD + _SEEDS[seed])
                at += 8
                live = live[self.size[which[live]] > at]
            for k in np.flatnonzero(self.size[which] > LANES).tolist():
                state[k] = int.from_bytes(hashlib.blake2b(self.data[self.starts[which[k]] : self.starts[which[k]] + self.size[which[k]]], digest_size=8, salt=bytes([seed])).digest(), "little")
            out[which] = state | _LONG
        return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes in any text and process.

    Spans of up to seven bytes never collide; for others nothing in their structure makes hashes meet.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(Spans(LOWER[data] if lower else data, starts, ends).keys(seed) ^ _SEEDS[seed])


def exact_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): spans have one code where their bytes are equal and only there; first: a span of each code.

    Codes come from keys, and every span is compared with the first one of its code byte by byte.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = Spans(LOWER[data] if lower else data, starts, ends)
    codes, found = pd.factorize(spans.keys() if keys is None else keys)
    codes = codes.astype(np.int64)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    which = spans.long if keys is None else np.arange(len(codes))
    twin = first[codes[which]]
    which, twin = which[which != twin], twin[which != twin]
    bad = spans.size[which] != spans.size[twin]
    check, at = np.flatnonzero(~bad), 0
    while len(check):
        differs = spans.lane(which[check], at) != spans.lane(twin[check], at)
        bad[check[differs]] = True
        at += 8
        check = check[~differs & (spans.size[which[check]] > at)]
        if at >= LANES:
            for k in check.tolist():
                bad[k] = spans.of(which[k]) != spans.of(twin[k])
            break
    if bad.any():  # spans that share a key by chance: told apart by their bytes
        own: dict[bytes, int] = {}
        more = []
        for i in which[bad].tolist():
            word = spans.of(i)
            if word not in own:
                own[word] = len(first) + len(more)
                more.append(i)
            codes[i] = own[word]
        first = np.concatenate([first, np.array(more, np.int64)])
    return codes, first


def paired(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> tuple[np.ndarray, int]:
    """One number for each pair of numbers below size_a and size_b, without collisions, and a bound above it."""
    if size_a * max(size_b, 1) >= 1 << 62:
        a, found = pd.factorize(a)
        a, size_a = a.astype(np.int64), len(found)
    return a * size_b + b, size_a * size_b


def exact_grams(codes: np.ndarray, n_codes: int, places: np.ndarray, n: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(key, bound, place, text) of all windows of n codes within each text: keys are equal where the windows are."""
    count = np.maximum(0, np.diff(places) - n + 1)
    offsets = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(offsets[-1]) + (places[:-1] - offsets[:-1])[text]
    key, bound = codes[place], n_codes
    for k in range(1, n):
        key, bound = paired(key, bound, codes[place + k], n_codes)
    return key, bound, place, text


def gram_hashes(hashes: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words that begin at the given words."""
    out = np.zeros(len(place), np.uint64)
    for k in range(n):
        out = mix(out * _ODD + hashes[place + k] + np.uint64(k + 1))
    return out
