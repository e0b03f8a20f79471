"""BPE encoding and decoding with contiguous rank arrays.

A short word holds its part boundaries and the ranks of adjacent parts in one contiguous array; the
array is scanned for its minimum, the boundary there is deleted and the ranks beside it refreshed,
until no rank is left. All distinct words of a batch go through these steps together, a row of a
matrix each. Longer words hold the same parts in a linked list and the ranks in a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridlake.llm.common import slices, small_batches, tidy
from gridlake.llm.tokencount import MEMO, SLICE, _bytes_of_symbols
from gridlake.llm.wordpieces import Encoder, Splitter

#: Bytes of a word up to which the contiguous array is used; scanning longer ones costs their square.
SHORT = 64
NONE = np.int32(1 << 30)


class RankBPE:
    """Encode and decode as a byte-level BPE tokenizer file states."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbol = model["vocab"], _bytes_of_symbols()
        self.splitter = Splitter(path)
        top = max([*vocab.values(), *self.splitter.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(symbol[c] for c in token)
        for token, i in self.splitter.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in symbol.items():
            self.byte_id[b] = vocab[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.size = top
        keys = np.array([vocab[a] * top + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[by_key], by_key.astype(np.int32), made
        self.pairs = {k: (r, m) for r, (k, m) in reversed(list(enumerate(zip(keys.tolist(), made.tolist(), strict=True))))}
        self.encoder = Encoder(self.splitter, self.merge, {}, MEMO)
        self.text_of = [str(i) for i in range(top)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of merging left with right, NONE where no merge is known or a side is missing."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words of at most SHORT bytes."""
        out: list[tuple[int, ...]] = [()] * len(words)
        sizes = np.array([len(w) for w in words])
        step = 1
        while step <= SHORT:
            rows = np.flatnonzero((sizes > step // 2) & (sizes <= step))
            for a in range(0, len(rows), 50_000):
                part = rows[a : a + 50_000]
                for i, ids in zip(part.tolist(), self._merge_rows([words[i] for i in part], step), strict=True):
                    out[i] = ids
            step *= 2
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(words)
        size = np.array([len(w) for w in words])
        parts = np.full((n, width + 1), -1, np.int32)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), size)
        parts[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = self.byte_id[flat]
        done = parts.copy()
        live, rank = np.arange(n), self.ranks(parts[:, :-1], parts[:, 1:])
        column = np.arange(width)[None, :]
        while len(live):
            best = rank.argmin(1)
            here = np.arange(len(live))
            low = rank[here, best]
            stop = low >= NONE
            if stop.any():
                done[live[stop]] = parts[stop]
                go = ~stop
                live, parts, rank, best, low = live[go], parts[go], rank[go], best[go], low[go]
                here = np.arange(len(live))
                if not len(live):
                    break
            parts[here, best] = self.made[low]
            shift = column + (column > best[:, None])
            parts[:, :-1] = np.take_along_axis(parts, shift, 1)
            parts[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(column + (column >= best[:, None]), width - 1), 1)
            rank[:, -1] = NONE
            after = self.ranks(parts[here, best], parts[here, best + 1])
            rank[here, best] = after
            has = best > 0
            rank[here[has], best[has] - 1] = self.ranks(parts[here[has], best[has] - 1], parts[here[has], best[has]])
        return [tuple(r[:k]) for r, k in zip(done.tolist(), (done >= 0).sum(1).tolist(), strict=True)]

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word of any length in n log n steps: lowest rank first, then leftmost."""
        parts = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before, dead = [*range(1, n), -1], [-1, *range(n - 1)], [False] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and (found := self.pairs.get(parts[i] * self.size + parts[j])):
                heapq.heappush(heap, (found[0], i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], dead[j] = int(self.made[rank]), True
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return tuple(p for p, gone in zip(parts, dead, strict=True) if not gone)

    def merge(self, words: list[bytes]) -> list:
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for i, ids in zip(short, self.merge_short([words[i] for i in short]), strict=True):
            out[i] = ids
        return [self.merge_long(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.encoder.ids(texts)]

    def decode(self, ids: list[int]) -> str:
        """Special ids give their strings; bytes that are no UTF-8 give U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ids array<int>, decoded string. A null text is empty; no shuffle."""
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def make(codec: RankBPE, texts: list[str]) -> list[pa.Array]:
        ids = codec.encode(texts)
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())]

    return _mapped(docs, path, id_col, text_col, schema, make)


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but digests in place of ids and text: n_tokens, ids_sha256, decoded_sha256.

    Null: the empty text. Repeated rows repeat; other columns are not read; no rows give no rows.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make(codec: RankBPE, texts: list[str]) -> list[pa.Array]:
        name = codec.text_of.__getitem__
        counts, joined, back = [], [], []
        for ids in codec.encode(texts):
            counts.append(len(ids))
            joined.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(joined, pa.string()), pa.array(back, pa.string())]

    return _mapped(docs, path, id_col, text_col, schema, make)


def _mapped(docs, path, id_col, text_col, schema, make) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or RankBPE(path)
            ids, column = batch.column(0), batch.column(1).fill_null("")
            for a, b in slices(np.array(pa.compute.binary_length(column), np.int64), SLICE):
                yield pa.RecordBatch.from_arrays([ids[a:b], *make(codec, column[a:b].to_pylist())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
