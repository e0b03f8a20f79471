"""Pre-tokens of two public BPE tokenizers, as strings.

Texts of code points below 256 are split by an explicit pattern; all others, and none but those, are
normalised and split by the library itself, so both ways give the library's pre-tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
from tokenizers import Tokenizer

from gridlake.llm.common import sums
from gridlake.llm.scan import exact_codes

#: Letters, numbers and white space below code point 256.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_END = re.compile(rf"{_SHORT}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
BYTE_LEVEL = re.compile(
    rf"{_SHORT}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


_S, _L, _N, _P = range(4)
CLASS = np.full(256, _P, np.int8)
for _pattern, _class in ((f"[{_SPACES}]", _S), (f"[{_LETTERS}]", _L), (f"[{_NUMBERS}]", _N)):
    CLASS[[i for i in range(256) if re.match(_pattern, chr(i))]] = _class


def plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def spans(data: np.ndarray, offsets: np.ndarray, byte_level: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts in Latin-1, and the texts' offsets among them.

    The same pre-tokens as WORD_END.findall or BYTE_LEVEL.findall of each text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = CLASS[data]
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[offsets] = True
    edge = np.zeros(n + 4, bool)  # a text starts here
    edge[offsets] = True
    edge[n:] = True
    if byte_level:
        # the last white space before a word: a blank joins the word, another character stands alone
        last = np.flatnonzero((kind[:-1] == _S) & (kind[1:] != _S) & ~edge[1:n])
        start[last] = True
        start[last[data[last] == 32] + 1] = False
    else:
        start[:n] |= kind == _N
    mark = np.flatnonzero(data == 39)
    mark = mark[start[mark]]
    if len(mark):  # 's 't 'm 'd 're 've 'll where nothing before them takes the apostrophe
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = wide[mark + 1], wide[mark + 2]
        single = np.isin(one, [115, 116, 109, 100]) & ~edge[mark + 1]
        double = ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)) & ~edge[mark + 1] & ~edge[mark + 2]
        for at, size in ((mark[single], 2), (mark[double], 3)):
            start[at + 1] = False
            start[at + size - 1] = False
            start[at + size] = True
    places = np.flatnonzero(start)
    starts, ends = places[:-1], places[1:]
    if not byte_level:
        keep = kind[starts] != _S
        starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


class Splitter:
    """split(text) gives (pre-tokens, special ids) of one text.

    Strings of special tokens inside a text are cut out first, as the library does by default.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.lower = self.tokenizer.normalizer is not None
        self.pattern = WORD_END if self.lower else BYTE_LEVEL

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a stretch without special strings."""
        if plain(text):
            return self.pattern.findall(text.lower() if self.lower else text)
        if self.lower:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str | int]:
        """Pre-tokens, and the ids of special strings in their places."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.pieces(part)
        return out


class Encoder:
    """Token ids of whole texts: each distinct pre-token is merged once and then looked up.

    merge gives the ids of pre-tokens (as UTF-8). known: pre-tokens proven to be one token. Texts below
    code point 256 without special strings are split as arrays of bytes and looked up by their bytes;
    other texts go through Splitter. memo: distinct merged pre-tokens remembered at most.
    """

    def __init__(self, splitter: Splitter, merge: Callable[[list[bytes]], list], known: dict[str, int], memo: int):
        self.splitter, self.merge, self.known, self.most = splitter, merge, known, memo
        self.reset()

    def reset(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.size, self.rows = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.index: dict[bytes, int] = {}
        words = [w for w in self.known if plain(w)]
        self.add([w.encode("latin-1") for w in words], [(self.known[w],) for w in words])
        self.other: dict[str | int, tuple[int, ...]] = {w: (i,) for w, i in self.known.items()}
        self.other |= {i: (i,) for i in self.splitter.special.values()}

    def add(self, words: list[bytes], ids: list) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(ids) > len(self.size):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        to = slice(self.rows, self.rows + len(ids))
        self.size[to], self.first[to] = sizes, self.used + np.cumsum(sizes) - sizes
        self.index.update(zip(words, range(self.rows, self.rows + len(ids)), strict=True))
        self.rows += len(ids)
        self.used += len(flat)

    def lookup(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of Latin-1 texts: the table's row of each pre-token, and the texts' offsets."""
        joined = b"".join(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(joined, np.uint8)
        starts, ends, places = spans(data, offsets, not self.splitter.lower)
        codes, first = exact_codes(data, starts, ends)
        words = [joined[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        rest = np.flatnonzero(rows < 0)
        if len(rest):
            new = [words[i] for i in rest.tolist()]
            rows[rest] = np.arange(self.rows, self.rows + len(rest))
            self.add(new, self.merge([w if w.isascii() else w.decode("latin-1").encode() for w in new]))
        return rows[codes], places

    def slow(self, text: str) -> list[int]:
        parts = self.splitter.split(text)
        rest = [p for p in set(parts) if p not in self.other]
        if rest:
            self.other.update(zip(rest, self.merge([p.encode() for p in rest]), strict=True))
        return list(chain.from_iterable(map(self.other.__getitem__, parts)))

    def _fast(self, texts: list[str]) -> tuple[list[int], list[bytes]]:
        if self.rows + len(self.other) > self.most + 2 * len(self.known):
            self.reset()
        special, at, coded = list(self.splitter.special), [], []
        for i, t in enumerate(texts):
            if any(s in t for s in special):
                continue
            try:
                coded.append((t.lower() if self.splitter.lower else t).encode("latin-1"))
            except UnicodeEncodeError:
                continue
            at.append(i)
        return at, coded

    def counts(self, texts: list[str]) -> np.ndarray:
        at, coded = self._fast(texts)
        out = np.full(len(texts), -1, np.int64)
        rows, places = self.lookup(coded)
        out[at] = sums(self.size[rows], places)
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = len(self.slow(texts[i]))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        at, coded = self._fast(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        rows, places = self.lookup(coded)
        sizes = self.size[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(self.first[rows] - ends[:-1], sizes) + np.arange(ends[-1])]
        cut = ends[places].tolist()
        for k, i in enumerate(at):
            out[i] = flat[cut[k] : cut[k + 1]]
        return [np.array(self.slow(texts[i]), np.int32) if x is None else x for i, x in enumerate(out)]
