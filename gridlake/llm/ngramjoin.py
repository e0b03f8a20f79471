"""Exact Jaccard self-join on word shingles by multiple-global-order filtering.

1. Texts with equal shingle sets form a class (two independent 64-bit sums of shingle hashes and the set's
   size); one text of each goes on. Sizes are exact: words and shingles of a text are compared by bytes.
2. Every shingle's document frequency is counted over all classes. Two sets with likeness t share at
   least t of either one's shingles, so a set of which less than t is found elsewhere drops out here.
3. A global token order, rare shingles first, makes the prefix filter: linked sets share one of their
   first n - ceil(t n) + 1 tokens. Shingles found once can't be shared, so the rest of a prefix is short.
   Three orders that break ties between frequencies by unlike hashes give three prefixes.
4. Sets with one most frequent prefix token ("home") lie in one block, or in several if they are many. Each
   block is joined within itself and, where a home has several, with its first. What is linked is contracted.
5. A set then goes to another block only if, under every one of the three orders, a prefix token of it
   is a prefix token there of a set in another component. Pairs that share a prefix token under all orders
   are intersected. So a rare token costs a row a pair, and a hot group that phase 4 connects none.

Shingles travel as packed arrays dealt by ranges of their hashes; those found in a large share of texts
need no count (any common order will do) and are dealt by text. No pair becomes a row unless it links two
components. Intersections count equal 64-bit hashes of shingles: two unlike ones meet with odds of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import discard, slices, small_batches, text_bytes, tidy, tidy_group, written
from gridlake.llm.components import components, forest
from gridlake.llm.scan import exact_codes, exact_grams, gram_hashes, mix, paired, span_hashes, words

SLICE = 1 << 20
ORDERS = 3
#: Tokens a range of hashes holds, tokens and sets a block holds.
RANGE_TOKENS = 1_000_000
BLOCK_TOKENS = 2_000_000
BLOCK_SETS = 1000
#: Sets that one step of a task joins at most, unless two blocks hold more.
BIN_SETS = 3000
DENSE = 32
#: A shingle is hot if the slices that report it hold it in a 64th of all rows; so at most 64 times the mean size are hot.
HOT_SHARE = 64
HOT_LEVEL = 200


def shingle_sets(column: pa.Array, n: int, seeds: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes (one array a seed) of the distinct shingles of each text, and the texts' offsets among them.

    With fewer than n words the whole sequence is the one shingle; without words there is none.
    """
    data, offsets = text_bytes(column)
    starts, ends, places = words(data, offsets)
    codes, own = exact_codes(data, starts, ends, lower=True)
    key, bound, place, text = exact_grams(codes, len(own), places, n)
    same, found = pd.factorize(paired(key, bound, text, len(places))[0])
    first = np.empty(len(found), np.int64)
    first[same[::-1]] = np.arange(len(same) - 1, -1, -1)  # ascending, so by text
    place, text = place[first], text[first]
    count = np.diff(places)
    short = np.flatnonzero((count > 0) & (count < n))
    out = []
    for seed in seeds:
        hashes = span_hashes(data, starts[own], ends[own], True, seed)[codes]
        grams = gram_hashes(hashes, place, n)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                word = hashes[np.minimum(places[:-1][short] + k, len(hashes) - 1)]
                whole = np.where(count[short] > k, mix(whole * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1000 + k)), whole)
            grams = np.concatenate([grams, whole])
        out.append(grams)
    text = np.concatenate([text, short])
    order = np.argsort(text, kind="stable")
    return [g[order] for g in out], np.searchsorted(text[order], np.arange(len(places)))


def fingerprints(grams: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """A 64-bit sum over each set for each seed; the size stands beside them."""
    out = []
    for g in grams:
        run = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(mix(g + np.uint64(0x51ED2701)), out=run[1:])
        out.append(mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return out


def _often(grams: np.ndarray, texts: int) -> tuple[list[int], list[int]]:
    """Shingles that a 32nd of a slice's texts hold, eight at least, and in how many they are."""
    least = max(8, texts // 32)
    if texts < least:
        return [], []
    codes, found = pd.factorize(grams)
    count = np.bincount(codes, minlength=len(found))
    hot = np.flatnonzero(count >= least)
    return found[hot].view(np.int64).tolist(), count[hot].tolist()


def _sets_of(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Of each row its set's size and sums; the first row of a slice also tells the slice's frequent shingles."""
    names = [id_col, "n", "key", "more", "often", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1).fill_null("")
            for a, b in slices(np.array(pa.compute.binary_length(column), np.int64), SLICE):
                grams, at = shingle_sets(column[a:b], n, (0, 1))
                key, more = fingerprints(grams, at)
                often, times = _often(grams[0], b - a)
                rest = [None] * (b - a - 1)
                lists = [pa.array([x, *rest], pa.list_(pa.int64())) for x in (often, times)]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(np.diff(at).astype(np.int64)), pa.array(key), pa.array(more), *lists], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"{id_col} {kind}, n long, key long, more long, often array<bigint>, times array<bigint>")


def range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, by its upper 32 bits; ranges is below 2**31."""
    return ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


PACKED = "range long, chunk long, keys binary, sizes binary, counts binary, low binary, high binary"


def _packed(reps: DataFrame, n: int, ranges: int, hot: np.ndarray, bins: int) -> DataFrame:
    """Rows (range, chunk, keys, sizes, counts, low, high): for each chunk of texts and each range of hashes
    the tokens in it, by text; keys and sizes of the chunk's sets stand in range 0 only. Hot tokens
    have ranges below 0, which follow from the chunk. A chunk has fewer than 2048 texts."""
    held = reps.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, chunk, hot = TaskContext.get().partitionId(), 0, held.value
        for batch in batches:
            column = batch.column(0).fill_null("")
            for a, b in slices(np.array(pa.compute.binary_length(column), np.int64), SLICE):
                (grams, second), at = shingle_sets(column[a:b], n, (0, 1))
                key = np.stack(fingerprints([grams, second], at))
                size = np.diff(at)
                text = np.repeat(np.arange(b - a), size)
                part = range_of(grams, ranges)
                if len(hot):
                    part[hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams] = ranges
                order = np.argsort(part, kind="stable")  # by text within a range
                grams, text, part = grams[order], text[order], part[order]
                found = np.union1d(part, [0])  # the ranges that the slice meets, and the first
                cut = np.append(np.searchsorted(part, found), len(part))
                low, high = (grams & np.uint64(0xFFFFFFFF)).astype("<u4"), (grams >> np.uint64(32)).astype("<u4")
                found = found.tolist()
                counts = [np.bincount(text[i:j], minlength=b - a).astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                arrays = [
                    pa.array([r if r < ranges else -1 - (31 * task + chunk) % bins for r in found], pa.int64()),
                    pa.array([task << 28 | chunk] * len(found), pa.int64()),
                    pa.array([key.tobytes() if r == 0 else b"" for r in found], pa.binary()),
                    pa.array([size.astype("<i8").tobytes() if r == 0 else b"" for r in found], pa.binary()),
                    pa.array(counts, pa.binary()),
                    pa.array([low[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([high[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["range", "chunk", "keys", "sizes", "counts", "low", "high"])
                chunk += 1

    return reps.select("text").mapInArrow(tidy(run), PACKED)


def _count(table: pa.Table) -> pa.Table:
    """Of one range: for each chunk its shared tokens (frequency 2 or more), their texts and levels of frequency.

    Hot tokens get the highest level without a count."""
    rows = table.to_pylist()
    tokens = [np.frombuffer(r["low"], "<u4").astype(np.uint64) | (np.frombuffer(r["high"], "<u4").astype(np.uint64) << np.uint64(32)) for r in rows]
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    level = np.full(len(flat), HOT_LEVEL, np.uint8)
    if rows and rows[0]["range"] >= 0:
        codes, found = pd.factorize(flat)
        count = np.bincount(codes, minlength=len(found))
        level = np.log2(count[codes]).astype(np.uint8) + (count[codes] > 1)  # 0: found once
    out, at = [], 0
    for r, t in zip(rows, tokens, strict=True):
        f = level[at : at + len(t)]
        at += len(t)
        counts = np.frombuffer(r["counts"], "<u4")
        text = np.repeat(np.arange(len(counts)), counts)
        keep = f > 0
        out.append((r["chunk"], r["keys"], r["sizes"], text[keep].astype("<u4").tobytes(), t[keep].tobytes(), f[keep].astype("u1").tobytes()))
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "keys", "sizes", "texts", "tokens", "levels"])


ACTIVE = "node long, key long, more long, n long, home long, prefix array<bigint>, marks array<int>, tokens binary, flags binary"


def _prefixes(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one chunk: sets that may have a link, with prefixes under each order and their shared tokens.

        A set's node is its chunk's number and its place there, so no two sets share one."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["keys"] or r["sizes"])
        keys, sizes = np.frombuffer(head["keys"], "<i8").reshape(2, -1), np.frombuffer(head["sizes"], "<i8")
        text = np.concatenate([np.frombuffer(r["texts"], "<u4") for r in rows]).astype(np.int64)
        token = np.concatenate([np.frombuffer(r["tokens"], "<u8") for r in rows])
        level = np.concatenate([np.frombuffer(r["levels"], "u1") for r in rows])
        shared = np.bincount(text, minlength=len(sizes))
        need = -(-threshold * sizes // 100)  # ceil
        active = (shared >= need) & (sizes > 0)
        prefix = np.maximum(0, sizes - need + 1 - (sizes - shared))  # what single tokens leave of a prefix
        keep = active[text]
        text, token, level = text[keep], token[keep], level[keep]
        flags, home = np.zeros(len(text), np.uint8), np.zeros(len(sizes), np.int64)
        for o in range(ORDERS):
            order = np.lexsort((mix(token + np.uint64((o + 1) * 0x632BE5AB)), level, text))
            t = text[order]
            start = np.searchsorted(t, np.arange(len(sizes)))
            inside = order[np.arange(len(t)) - start[t] < prefix[t]]
            flags[inside] |= 1 << o
            if o == 0:
                home[text[inside]] = token[inside].view(np.int64)  # the last one of a prefix stays
        by_text = np.argsort(text, kind="stable")
        text, token, flags = text[by_text], token[by_text], flags[by_text]
        cut = np.searchsorted(text, np.arange(len(sizes) + 1))
        at = np.flatnonzero(active)
        part = lambda x, i: x[cut[i] : cut[i + 1]]
        marked = flags > 0
        lists = [[part(x, i)[part(marked, i)].tolist() for i in at] for x in (token.view(np.int64), flags)]
        return pa.table(
            [
                pa.array((head["chunk"] << 11) + at, pa.int64()), pa.array(keys[0][at]), pa.array(keys[1][at]), pa.array(sizes[at]), pa.array(home[at]),
                pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int32())),
                pa.array([part(token, i).tobytes() for i in at], pa.binary()), pa.array([part(flags, i).tobytes() for i in at], pa.binary()),
            ],
            names=["node", "key", "more", "n", "home", "prefix", "marks", "tokens", "flags"],
        )

    return run


def links_within(sizes: np.ndarray, tokens: list[np.ndarray], flags: list[np.ndarray], threshold: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that pass the filter of every order and whose sets link; apart: pairs only of unlike numbers."""
    count = len(sizes)
    length = [len(t) for t in tokens]
    flat, flag = np.concatenate(tokens), np.concatenate(flags)
    row = np.repeat(np.arange(count), length)
    _, column = np.unique(flat, return_inverse=True)
    mask = np.ones((count, count), bool)
    mask[np.tril_indices(count)] = False
    ratio = 100 * np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes)
    mask &= ratio
    if apart is not None:
        mask &= np.not_equal.outer(apart, apart)
    for o in range(ORDERS):
        if mask.any():
            inside = (flag >> o & 1) > 0
            mask &= _overlaps(row[inside], column[inside], count) > 0
    if not mask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = _overlaps(row, column, count).astype(np.int64)
    mask &= 100 * shared >= threshold * (np.add.outer(sizes, sizes) - shared)
    return np.nonzero(mask)


def _overlaps(row: np.ndarray, column: np.ndarray, count: int) -> np.ndarray:
    """Sizes of all intersections: frequent columns as dense products, the others as pairs of their rows."""
    out = np.zeros((count, count), np.float32)
    if not len(row):
        return out
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    start = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    size = np.diff(np.append(start, len(column)))
    dense = np.flatnonzero(size >= DENSE)
    for a in range(0, len(dense), 1024):
        part = dense[a : a + 1024]
        held = np.zeros((count, len(part)), np.float32)
        for k, p in enumerate(part.tolist()):
            held[row[start[p] : start[p] + size[p]], k] = 1
        out += held @ held.T
    flat = np.zeros(count * count, np.float32) if len(dense) < len(size) else None
    for s in np.unique(size[(size > 1) & (size < DENSE)]).tolist():
        at = start[size == s]
        rows = row[at[:, None] + np.arange(s)[None, :]]  # ascending within a column
        i, j = np.triu_indices(s, 1)
        for a in range(0, len(rows), max(1, 2_000_000 // (s * s))):
            part = rows[a : a + max(1, 2_000_000 // (s * s))]
            pair = np.minimum(part[:, i], part[:, j]) * count + np.maximum(part[:, i], part[:, j])
            found, many = np.unique(pair, return_counts=True)
            flat[found] += many
    if flat is not None:
        square = flat.reshape(count, count)
        out += square + square.T
    return out


def _verify(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bin: a forest of the links between its sets of unlike components."""
        pair = np.asarray(table.column("pair"))
        node, size, comp = (np.asarray(table.column(c)) for c in ("node", "n", "comp"))
        tokens, flags = table.column("tokens"), table.column("flags")
        if len(np.unique(node)) <= BIN_SETS:
            parts = [np.unique(node, return_index=True)[1]]
        else:
            order = np.argsort(pair, kind="stable")
            parts = [at[np.unique(node[at], return_index=True)[1]] for at in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1)]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in parts:
            if len(at) > 1:
                x, y = links_within(size[at], [np.frombuffer(tokens[i].as_py(), "<u8") for i in at.tolist()], [np.frombuffer(flags[i].as_py(), "u1") for i in at.tolist()], threshold, comp[at])
                if len(x):
                    one, two = forest(node[at][x], node[at][y])
                    a.append(one)
                    b.append(two)
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _blocked(active: DataFrame, least: int) -> DataFrame:
    """Add block, pivot (the first block of the same home) and parts, the blocks that the home has.

    Homes with few sets share blocks by hash. Should two blocks get one number, they are one block."""
    every = active.agg(F.count(F.lit(1)), F.sum(F.length("tokens") / 8)).first()
    small = max(least, int(2 * max(every[0] / BLOCK_SETS, float(every[1] or 0) / BLOCK_TOKENS)) + 1)
    held = active.groupBy("home").agg(F.count(F.lit(1)).alias("__sets"), F.sum(F.length("tokens") / 8).alias("__held"))
    parts = F.ceil(F.greatest(F.col("__sets") / BLOCK_SETS, F.col("__held") / BLOCK_TOKENS)).cast("int")
    large = held.select("home", parts.alias("parts")).where("parts > 1")  # at most a home for each block's worth of sets
    df = active.join(large, "home", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("home"), F.lit(small))).otherwise(_large(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    return df.withColumn("block", own).withColumn("pivot", F.when(F.col("parts") > 1, _large(F.lit(0))).otherwise(own))


def _large(part) -> Column:
    return F.shiftrightunsigned(F.xxhash64("home", part), 2).bitwiseOR(F.lit(1 << 62))


def _links(active: DataFrame, threshold: int, least: int) -> DataFrame:
    """(node, label) of the sets whose component has a smaller node, with the smallest one as label."""
    edge, sets = "a long, b long", ["node", "n", "tokens", "flags"]
    blocked = written(_blocked(active, least), "blocks")
    first = blocked.where("parts > 1 AND block = pivot").withColumn("__part", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)))
    first = first.select(_large(F.col("__part")).alias("pair"), *sets)
    near = blocked.select(F.col("block").alias("pair"), *sets).unionByName(first).withColumn("comp", F.col("node"))
    joined = components(near.groupBy("pair").applyInArrow(tidy_group(_verify(threshold)), edge))
    joined = written(joined, "joined")
    # what is left: sets with prefix tokens under every order in a block where other components have them too
    named = blocked.join(joined, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    posting = named.select("node", "block", "comp", F.explode(F.arrays_zip("prefix", "marks")).alias("p")).select("node", "block", "comp", F.col("p.prefix").alias("token"), F.col("p.marks").alias("mark"))
    seen = [F.when(F.col("mark").bitwiseAND(1 << o) > 0, F.col("comp")) for o in range(ORDERS)]
    there = posting.groupBy("token", F.col("block").alias("other")).agg(*(f(seen[o]).alias(f"{f.__name__}{o}") for o in range(ORDERS) for f in (F.min, F.max)))
    unlike = [((F.col("mark").bitwiseAND(1 << o) > 0) & ((F.col(f"min{o}") != F.col("comp")) | (F.col(f"max{o}") != F.col("comp")))) for o in range(ORDERS)]
    bits = sum((F.when(unlike[o], 1 << o).otherwise(0) for o in range(ORDERS)), F.lit(0))
    wanted = posting.join(there, "token").where("block <> other").select("node", "block", "other", bits.alias("bits")).where("bits > 0")
    wanted = wanted.groupBy("node", "block", "other").agg(F.bit_or("bits").alias("bits")).where(f"bits = {(1 << ORDERS) - 1}")
    pair = F.xxhash64(F.least("block", "other"), F.greatest("block", "other"))
    wanted = written(wanted.select("node", pair.alias("pair")), "wanted")
    rows = wanted.count()
    if not rows:
        discard(blocked, wanted)
        return joined
    bins = max(least, rows * 2 // BIN_SETS)
    far = named.select(*sets, "comp").join(wanted, "node").withColumn("__bin", F.pmod("pair", F.lit(bins)))
    links = far.groupBy("__bin").applyInArrow(tidy_group(_verify(threshold)), edge)
    out = components(links.union(joined.select("node", "label")))
    discard(blocked, joined, wanted)
    return out


def link_documents(docs: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Two texts link when 100 * intersection >= threshold * union of their sets of distinct shingles of words
    [^\\x20\\x09-\\x0D]+, A-Z lower-cased. A null text, or one without words, has an empty set and links with
    nothing, so its component is its own id. Texts with equal sets link, repeated rows too. Rows with a null id
    take part as all others; ids come before null, so a component is null only if none of its rows has an id.
    Other columns are not read; no rows give no rows.
    """
    if docs.where(F.col(id_col).isNull()).isEmpty():
        return _linked(docs, shingle, threshold, id_col, text_col)
    marked = docs.select(_told_apart(id_col, text_col).alias(id_col), F.col(text_col).alias("text"))
    return _linked(marked, shingle, threshold, id_col, "text").select(F.col(f"{id_col}.id").alias(id_col), "n_shingles", F.col("component_id.id").alias("component_id"))


def _told_apart(id_col: str, text_col: str) -> Column:
    """An id that isn't null: rows without one are told apart by their text and come last."""
    mark = F.when(F.col(id_col).isNull(), F.sha2(F.coalesce(text_col, F.lit("")), 256))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), mark.alias("hash"))


def _linked(docs: DataFrame, shingle: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(_sets_of(docs, shingle, id_col, text_col), "sets")
    classes = written(rows.where("n > 0").groupBy("key", "more", "n").agg(F.min(id_col).alias("rep")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    often = rows.where("size(often) > 0").select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    often = often.groupBy(F.col("x.often").alias("token")).agg(F.sum("x.times").alias("times")).where(F.col("times") >= max(8, rows.count() // HOT_SHARE))
    told = often.toArrow()
    hot = np.sort(np.asarray(told.column("token")).view(np.uint64))
    ranges = max(parts, -(-total // RANGE_TOKENS))
    bins = max(parts, -(-sum(told.column("times").to_pylist()) // RANGE_TOKENS))
    one = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(classes.select("rep").distinct(), "rep", "left_semi")
    # chunks are numbered by the order of rows, so a task that runs again must see the same order
    one = one.sortWithinPartitions("rep", F.xxhash64("text"))
    shared = _packed(one, shingle, ranges, hot, bins).groupBy("range").applyInArrow(tidy_group(_count), "chunk long, keys binary, sizes binary, texts binary, tokens binary, levels binary")
    active = written(shared.groupBy("chunk").applyInArrow(tidy_group(_prefixes(threshold)), ACTIVE), "active")
    linked = active.select("node", "key", "more", "n").join(_links(active, threshold, parts), "node", "left")
    # read twice below; written, the last plan is half as large
    labels = written(linked.groupBy("key", "more", "n").agg(F.min(F.coalesce("label", "node")).alias("label")), "labels")
    # by class: the smallest representative in its component; labels are not negative
    alone = F.col("key").bitwiseOR(F.lit(-(1 << 63)))
    named = classes.join(labels, ["key", "more", "n"], "left").withColumn("label", F.coalesce("label", alone))
    lowest = named.where("label >= 0").groupBy("label").agg(F.min("rep").alias("__low"))
    named = named.join(lowest, "label", "left").select("key", "more", "n", F.coalesce("__low", "rep").alias("component_id"))
    out = rows.join(named, ["key", "more", "n"], "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component_id", id_col).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs without those whose doc_id isn't the smallest of its component.

    Rows that repeat the smallest id are all copies of one document; one of them stays. Rows without an id
    come after all ids and are told apart by their text: in a component without ids one row stays. Of rows
    without an id and without words, which link with nothing, all stay.
    """
    if docs.where("doc_id IS NULL").isEmpty():
        return _kept(docs, shingle, threshold)
    marked = docs.withColumn("__doc", F.col("doc_id")).withColumn("doc_id", _told_apart("doc_id", "text"))
    wordless = F.col("__doc").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = _kept(marked.where(~wordless), shingle, threshold).unionByName(marked.where(wordless))
    return kept.withColumn("doc_id", F.col("__doc")).select(*docs.columns)


def _kept(docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    found = _linked(docs, shingle, threshold, "doc_id", "text")
    keep = found.where("n_shingles = 0 OR doc_id = component_id").select("doc_id").distinct()
    one = docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    first = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(F.lit(1))
    return one.withColumn("__copy", F.row_number().over(first)).where("__copy = 1").drop("__copy")
