"""Exact deduplication by Grace hashing: complete contents are compared, never only their hashes.

Records are partitioned by a hash of their content. A partition is one pass over an open-addressing table of
bounded size; a content that finds no room there is spilled, with all its copies, to files in the shared
folder, which are partitioned again by another hash, until every partition fits. Spark's exchange writes the
partitions and a Parquet table the spilled records, so a lost executor costs a task and nothing is local.

Before that each task of the scan runs its rows through such a table too, so a group with a third of all rows
sends one record a task and its rows refer to that record by a number: no key of the joins has more rows than
one task read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import small_batches, tidy, written

#: Bytes of content that a table holds before a scan's task starts a new one, and in a partition before it spills.
SCAN_BYTES = 16 << 20
TABLE_BYTES = 64 << 20
#: Rows whose numbers a task of the scan keeps while a table fills.
SCAN_ROWS = 200_000


class ContentTable:
    """Open addressing with linear probing over contents of bytes; equal means equal in every byte."""

    def __init__(self, most_bytes: int):
        self.most, self.held = most_bytes, 0
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, content: bytes) -> int:
        """The number of content, a new one where there is room, or else -1. The first content always has room."""
        code = hash(content)
        at = self._place(code, content)
        if self.slots[at] >= 0:
            return self.slots[at]
        if self.contents and self.held + len(content) > self.most:
            return -1
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
            at = self._place(code, content)
        self.slots[at] = len(self.contents)
        self.hashes.append(code)
        self.contents.append(content)
        self.held += len(content) + 64
        return self.slots[at]

    def _place(self, code: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = code & mask
        while (i := self.slots[at]) >= 0 and not (self.hashes[i] == code and self.contents[i] == content):
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for i, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _contents(column: pa.Array) -> list[bytes]:
    """Texts with A-Z in lower case, as UTF-8; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.ascii_lower(column.fill_null("")).cast(kind).to_pylist()


def _best(a, b):
    """Whether id a goes before b as the one that stays: larger, and any before null."""
    return a is not None and (b is None or a > b)


def _scanned(scan_bytes: int, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        given = 0
        table, ids, numbers, top = ContentTable(scan_bytes), [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal given, table, ids, numbers, top
            counts = [0] * len(table.contents)
            for k in numbers:
                counts[k] += 1
            stays = set(top)
            labels = [first + given + k for k in numbers]
            yield pa.record_batch([pa.array(labels, pa.int64()), pa.array(ids, schema.field(1).type), pa.array([i in stays for i in range(len(ids))]), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.int64())], schema=schema)
            n, start, held = len(table.contents), 0, 0
            for k in range(n + 1):  # a few MB of contents a batch
                if k == n or held > 4 << 20:
                    own = range(start, k)
                    if len(own):
                        yield pa.record_batch([pa.array([first + given + i for i in own], pa.int64()), pa.array([ids[top[i]] for i in own], schema.field(1).type), pa.nulls(len(own), pa.bool_()), pa.array(table.contents[start:k], pa.binary()), pa.array(counts[start:k], pa.int64())], schema=schema)
                    start, held = k, 0
                if k < n:
                    held += len(table.contents[k])
            given += n
            table, ids, numbers, top = ContentTable(scan_bytes), [], [], []

        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), _contents(batch.column(1)), strict=True):
                k = table.find(content)
                if k < 0 or len(ids) >= SCAN_ROWS:
                    yield from flush()
                    k = table.find(content)
                if k == len(top):
                    top.append(len(ids))
                elif _best(doc_id, ids[top[k]]):
                    top[k] = len(ids)
                ids.append(doc_id)
                numbers.append(k)
        if ids:
            yield from flush()

    return run


def _grouped(table_bytes: int, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(table_bytes)
        best: list[tuple] = []  # id and label of the row that stays
        sizes: list[int] = []
        labels: list[int] = []
        numbers: list[int] = []
        for batch in batches:
            spilled = []
            for row, (label, doc_id, content, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                k = table.find(content)
                if k < 0:
                    spilled.append(row)
                    continue
                if k == len(best):
                    best.append((doc_id, label))
                    sizes.append(0)
                elif _best(doc_id, best[k][0]) or (doc_id == best[k][0] and label < best[k][1]):
                    best[k] = (doc_id, label)
                sizes[k] += n
                labels.append(label)
                numbers.append(k)
            if spilled:
                rest = batch.take(pa.array(spilled))
                yield pa.record_batch([rest.column(0), rest.column(1), rest.column(2), rest.column(3), *(pa.nulls(len(spilled), f.type) for f in list(schema)[4:])], schema=schema)
        digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
        for start in range(0, len(labels), 20_000):
            own = numbers[start : start + 20_000]
            columns = [
                pa.array(labels[start : start + 20_000], pa.int64()),
                pa.array([best[k][0] for k in own], schema.field(1).type),
                pa.nulls(len(own), pa.binary()),
                pa.array([sizes[k] for k in own], pa.int64()),
                pa.array([best[k][1] for k in own], pa.int64()),
                pa.array([digests[k] for k in own], pa.string()),
            ]
            yield pa.record_batch(columns, schema=schema)

    return run


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan_bytes: int = SCAN_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256; texts are equal when they are after lower-casing A-Z.

    The row with the largest id of a group stays. Null texts are empty. Null ids come last: a group of null
    ids keeps one row, with keep_id null; of repeated rows with the largest id one stays. No rows give none;
    other columns are left behind. A text longer than a table's bytes stands in a table alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    scan = T.StructType([T.StructField("label", T.LongType()), T.StructField("id", id_type), T.StructField("top", T.BooleanType()), T.StructField("content", T.BinaryType()), T.StructField("n", T.LongType())])
    found = written(docs.select(id_col, text_col).mapInArrow(_scanned(scan_bytes, to_arrow_schema(scan)), scan), "exact-scan")
    rows = found.where("content IS NULL").select("label", F.col("id").alias("__id"), "top")
    spilled = found.where("content IS NOT NULL").select("label", "id", "content", "n")

    result = T.StructType([*(spilled.schema[c] for c in ("label", "id", "content", "n")), T.StructField("winner", T.LongType()), T.StructField("digest", T.StringType())])
    groups, level = None, 0
    while groups is None or not spilled.isEmpty():
        # each level deals by another hash; contents with one hash fit sooner or later, as each table takes some
        dealt = spilled.repartition(F.xxhash64(F.lit(level), "content"))
        done = written(dealt.mapInArrow(_grouped(table_bytes, to_arrow_schema(result)), result), f"exact-level-{level}")
        part = done.where("content IS NULL").select("label", "id", "n", "winner", "digest")
        groups = part if groups is None else groups.unionByName(part)
        spilled = done.where("content IS NOT NULL").select("label", "id", "content", "n")
        level += 1
    kept = F.col("top") & (F.col("label") == F.col("winner"))
    return rows.join(groups, "label").select(F.col("__id").alias(id_col), F.col("id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))
