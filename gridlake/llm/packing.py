"""Vector best-fit packing of token sequences.

Every piece asks for a vector of capacities: tokens, one document, and attention cost (its length
squared). A sequence has a residual of each. In descending length, each piece goes to the open sequence
that satisfies every constraint and is best by its residuals: least weighted norm of what would remain
("norm") or largest weighted dot product of request and residual ("dot"). A new sequence opens only
where none fits.

A piece's vector follows from its length, so pieces of one length are alike, and so are sequences with
equal residuals. The whole corpus is therefore packed exactly as one list from the histogram of
lengths, which has at most `capacity` rows. The plan is a list of runs: "the pieces numbered a to b of
this length go, k each, to sequences f, f + 1, ...". Only the histogram reaches the driver; pieces are
numbered within their length without gathering them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import rank_within, slices, small_batches, tidy, written
from gridlake.llm.tokencount import SLICE, prove_whole_tokens, word_encoder


@dataclass(frozen=True)
class Bins:
    """Capacities of a sequence, and the weights of the three residuals.

    The defaults let only tokens bind: a piece has a token at least, and the squares of lengths never
    sum up to more than the square of their sum.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        if not 0 < self.tokens < 1 << 31:
            raise ValueError("a sequence holds from 1 to 2**31 - 1 tokens")
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


@dataclass(frozen=True)
class Run:
    length: int
    first_rank: int
    last_rank: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], bins: Bins) -> list[Run]:
    """Runs that place count pieces of each length; at most as many steps as lengths and splits of runs."""
    limits, runs = bins.limits(), []
    weights = np.array(bins.weights) / limits.astype(float) ** 2
    lengths = sorted((n for n, c in histogram.items() if c > 0), reverse=True)
    if lengths and (lengths[0] > limits[0] or lengths[0] ** 2 > limits[2] or lengths[-1] < 1):
        raise ValueError("a piece is larger than a sequence")
    left = np.zeros((0, 3), np.int64)  # residuals of ranges of like sequences
    start, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened = 0
    for n in lengths:
        ask, count, rank = np.array([n, 1, n * n], np.int64), histogram[n], 0
        while count:
            fits = np.flatnonzero((left >= ask).all(1))
            if len(fits):
                if bins.rule == "norm":
                    best = fits[np.argmin((((left[fits] - ask) ** 2) * weights).sum(1))]
                else:
                    best = fits[np.argmax((left[fits] * ask * weights).sum(1))]
                room, at, size = left[best], int(start[best]), int(many[best])
            else:
                best, room, at, size = -1, limits, opened, count
            # once a sequence is new, or the best by norm, it stays so until the next piece doesn't fit
            each = int((room // ask).min()) if bins.rule == "norm" or best < 0 else 1
            each = min(each, count)
            size = min(size, count // each)
            runs.append(Run(n, rank, rank + each * size - 1, at, each, int(limits[0] - room[0])))
            if best < 0:
                opened += size
            elif size == many[best]:
                keep = np.arange(len(many)) != best
                left, start, many = left[keep], start[keep], many[keep]
            else:
                start[best] += size
                many[best] -= size
            rest = room - ask * each
            if rest[0] >= lengths[-1]:
                left, start, many = np.vstack([left, rest]), np.append(start, at), np.append(many, size)
            rank += each * size
            count -= each * size
    return runs


def cut_pieces(docs: DataFrame, path: str, capacity: int, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then the separator. Only documents above capacity are cut.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = spark.sparkContext.broadcast(prove_whole_tokens(path))
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = None, np.array([separator], "<u4").tobytes()
        for batch in batches:
            encoder = encoder or word_encoder(path, whole.value)
            ids, column = batch.column(0), batch.column(1).fill_null("")
            for a, b in slices(np.array(pa.compute.binary_length(column), np.int64), SLICE):
                row, piece, start, length, crc = [], [], [], [], []
                for i, found in enumerate(encoder.ids(column[a:b].to_pylist()), a):
                    packed = memoryview(found.astype("<u4").tobytes() + end)
                    total = len(packed) >> 2
                    for k, s in enumerate(range(0, total, capacity)):
                        size = min(capacity, total - s)
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(packed[4 * s : 4 * (s + size)]))
                arrays = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def place_pieces(pieces: DataFrame, bins: Bins, order: list[str]) -> DataFrame:
    """Add sequence_id and offset to pieces with a length; pieces is read twice, so pass a written table.

    Ranks and places don't depend on how rows are dealt; equal rows are interchangeable.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    runs = sorted(plan({r["length"]: r["n"] for r in counted}, bins), key=lambda r: (r.length, r.first_rank))
    table = np.array([(r.length, r.first_rank, r.sequence, r.each, r.offset) for r in runs], np.int64).reshape(-1, 5)
    lengths, first = np.unique(table[:, 0], return_index=True)
    many = np.array([r.last_rank + 1 for r in runs], np.int64)[np.append(first[1:], len(runs)) - 1] if runs else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(many)])  # pieces of shorter lengths: a piece's number among all is below their count
    held = spark.sparkContext.broadcast((table, lengths, before))
    ranked = rank_within(pieces, ["length"], order, "__rank").select(*pieces.columns, "__rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, lengths, before = held.value
        keys = before[np.searchsorted(lengths, runs[:, 0])] + runs[:, 1]
        for batch in batches:
            size, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "__rank"))
            found = runs[np.searchsorted(keys, before[np.searchsorted(lengths, size)] + rank, "right") - 1]
            past = rank - found[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found[:, 2] + past // found[:, 3]), pa.array(found[:, 4] + past % found[:, 3] * size)], names=schema.names)

    return ranked.mapInArrow(tidy(run), schema)


def pack_documents(docs: DataFrame, path: str, bins: Bins = Bins(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the separator alone. Repeated rows are packed each. Columns besides id and
    text are not read. An empty table gives no rows.
    """
    pieces = written(cut_pieces(docs, path, bins.tokens, id_col=id_col, text_col=text_col), "pieces")
    return place_pieces(pieces, bins, [id_col, "piece", "start", "ids_crc32"])
