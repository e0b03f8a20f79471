"""Rolling exact medians and median absolute deviations by wavelet matrices over haloed chunks.

A chunk is one series in one stretch of time; it also gets the rows of the window before its start, its
halo, so every window of its rows lies inside it. Each chunk's values, as ranks in the order of time,
form a wavelet matrix in numpy. Batched quantile queries give all medians, and batched range counts
bisect the radius of all deviations at once.

A stretch is the window's length divided by a number of parts, which follows from the densest stretch (one
number on the driver). With one part a row goes to two chunks. With more, only the stretch that windows
leave keeps its times; the stretches between it and the chunk lie in each window whole, so they travel as
counts of equal values, and a chunk stays bounded by two stretches and the distinct values of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import tidy

#: Rows of a series in one stretch from which stretches get shorter, and rows that are worked on at a time.
STRETCH_ROWS = 100_000
BATCH_ROWS = 48_000
#: A window of fewer values has no median.
LEAST = 5


class WaveletMatrix:
    """Ranks in a fixed order; each level holds, for a bit, how many of the first i elements have a 0 there.

    With weights an element counts so many times; otherwise once.
    """

    def __init__(self, ranks: np.ndarray, weights: np.ndarray | None = None):
        self.bits = max(1, int(ranks.max(initial=0) + 1).bit_length())
        self.zeros: list[np.ndarray] = []
        self.mass: list[np.ndarray] = []
        self.total = None if weights is None else _prefix(weights, np.int64)
        for bit in range(self.bits - 1, -1, -1):
            zero = (ranks >> bit) & 1 == 0
            self.zeros.append(_prefix(zero, np.int32))
            if weights is not None:
                self.mass.append(_prefix(np.where(zero, weights, 0), np.int64))
                weights = np.concatenate([weights[zero], weights[~zero]])
            ranks = np.concatenate([ranks[zero], ranks[~zero]])
        if self.total is None:
            self.mass = self.zeros

    def size(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (hi - lo).astype(np.int64) if self.total is None else self.total[hi] - self.total[lo]

    def quantile(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest rank, from 0, of each range lo to hi; 0 <= k < its size."""
        found = np.zeros(len(lo), np.int64)
        k = k.copy()
        for zeros, mass in zip(self.zeros, self.mass, strict=True):
            below_lo, below_hi = zeros[lo], zeros[hi]
            n = (below_hi - below_lo) if mass is zeros else mass[hi] - mass[lo]
            one = k >= n
            k -= np.where(one, n, 0)
            lo = np.where(one, zeros[-1] + lo - below_lo, below_lo)
            hi = np.where(one, zeros[-1] + hi - below_hi, below_hi)
            found += found + one
        return found

    def below(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many elements of each range are less than rank, which is at most the largest rank plus one."""
        found = np.zeros(len(lo), np.int64)
        for level, (zeros, mass) in enumerate(zip(self.zeros, self.mass, strict=True)):
            below_lo, below_hi = zeros[lo], zeros[hi]
            one = (rank >> (self.bits - 1 - level)) & 1 == 1
            n = (below_hi - below_lo) if mass is zeros else mass[hi] - mass[lo]
            found += np.where(one, n, 0)
            lo = np.where(one, zeros[-1] + lo - below_lo, below_lo)
            hi = np.where(one, zeros[-1] + hi - below_hi, below_hi)
        return found


def _prefix(values: np.ndarray, kind) -> np.ndarray:
    out = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=out[1:])
    return out


def medians(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, median2, mad4) of each range of values, which stand in the order of time; both 0 where n < LEAST.

    Exact while values stay below 2^58: median2 is a sum of two values, mad4 one of two |2 * value - median2|.
    """
    distinct, ranks = np.unique(values, return_inverse=True)
    matrix = WaveletMatrix(ranks, weights)
    n = matrix.size(lo, hi)
    median2, mad4 = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    at = np.flatnonzero(n >= LEAST)
    if not len(at):
        return n, median2, mad4
    lo, hi, m = lo[at], hi[at], n[at]
    value = lambda k: distinct[matrix.quantile(lo, hi, k)]
    middle = value((m - 1) // 2)
    even = m % 2 == 0
    upper = middle.copy()
    upper[even] = distinct[matrix.quantile(lo[even], hi[even], m[even] // 2)]
    centre = middle + upper

    # of half the values around the middle, the nearer end bounds the radius from below and the farther one from above
    k = (m - 1) // 2
    first = (m - k) // 2
    left, right = centre - 2 * value(first), 2 * value(first + k) - centre
    # all |2 * value - centre| are of centre's parity, so the radius is odd + 2 * step
    odd = centre & 1
    least, most = (np.minimum(left, right) - odd) >> 1, (np.maximum(left, right) - odd) >> 1
    least = np.maximum(least, 0)

    def within(rows: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values below centre - radius, values up to centre + radius)."""
        radius = odd[rows] + 2 * step
        low, high = (centre[rows] - radius) >> 1, (centre[rows] + radius) >> 1
        ends = np.concatenate([np.searchsorted(distinct, low, "left"), np.searchsorted(distinct, high, "right")])
        both = matrix.below(np.tile(lo[rows], 2), np.tile(hi[rows], 2), ends)
        return both[: len(rows)], both[len(rows) :]

    open_ = np.flatnonzero(least < most)
    while len(open_):
        half = (least[open_] + most[open_]) >> 1
        under, up_to = within(open_, half)
        enough = up_to - under > k[open_]
        most[open_] = np.where(enough, half, most[open_])
        least[open_] = np.where(enough, least[open_], half + 1)
        open_ = open_[least[open_] < most[open_]]
    radius = odd + 2 * least
    second = radius.copy()
    rows = np.flatnonzero(even)
    under, up_to = within(rows, least[rows])
    short = up_to - under <= m[rows] // 2  # the next deviation is that of a neighbour outside
    rows, under, up_to = rows[short], under[short], up_to[short]
    far = np.iinfo(np.int64).max
    next_left, next_right = np.full(len(rows), far), np.full(len(rows), far)
    some = under > 0
    next_left[some] = centre[rows[some]] - 2 * distinct[matrix.quantile(lo[rows[some]], hi[rows[some]], under[some] - 1)]
    some = up_to < m[rows]
    next_right[some] = 2 * distinct[matrix.quantile(lo[rows[some]], hi[rows[some]], up_to[some])] - centre[rows[some]]
    second[rows] = np.minimum(next_left, next_right)
    median2[at], mad4[at] = centre, radius + second
    return n, median2, mad4


def micros(ts: Column, kind: T.DataType) -> Column:
    """Microseconds from 1970 on; a time without a zone is taken as it stands, whatever the session's zone."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(ts.cast("timestamp"))
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def hundredths(value: Column) -> Column:
    """floor(100 * value + 0.5); none for null, NaN and the infinities. Up to 10^15 all that follows is exact."""
    value = value.cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.floor(100 * value + 0.5))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole chunks of a partition sorted by series and chunk, as many together as make a batch, with their starts."""
    held: list[pa.Table] = []

    def cut(table: pa.Table) -> np.ndarray:
        series = table.column("__series").combine_chunks()
        series = series.combine_chunks() if isinstance(series, pa.ChunkedArray) else series
        codes = series.dictionary_encode("encode").indices.to_numpy()
        cell = table.column("__chunk").to_numpy()
        return np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (cell[1:] != cell[:-1])]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= BATCH_ROWS:
            table = pa.concat_tables(held)
            starts = cut(table)
            last = int(starts[-1])  # it may go on in the next batch
            if last:
                yield table.slice(0, last), starts[:-1]
            held = [table.slice(last)]
    if held:
        table = pa.concat_tables(held)
        yield table, cut(table)


def _rolled(window: int, width: int, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _chunks(batches):
            at = lambda name: table.column(name)
            own = at("__own").to_numpy()
            chunk_no = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            # all times of a chunk lie between its start minus the window and its end: a row of numbers without overlap
            time = at("__ts").to_numpy() - at("__chunk").to_numpy() * width + chunk_no * (2 * window + 2 * width) + window
            valued = ~at("__cents").is_null().to_numpy()
            cents = at("__cents").fill_null(0).to_numpy()
            line, values = time[valued], cents[valued]
            weights = at("__weight").to_numpy()[valued]
            when, back = np.unique(time[own], return_inverse=True)
            lo, hi = np.searchsorted(line, when - window, "left"), np.searchsorted(line, when, "right")
            n, median2, mad4 = (x[back] for x in medians(values, lo, hi, weights if (weights != 1).any() else None))
            few = n < LEAST
            far = 2 * np.abs(2 * cents[own] - median2) > 5 * mad4
            rows = table.filter(pa.array(own))
            columns = [rows.column("__id"), rows.column("__series"), pa.array(n), pa.array(median2, mask=few), pa.array(mad4, mask=few), pa.array(far, mask=few | ~valued[own])]
            yield from pa.table(columns, schema=schema).to_batches()

    return run


def rolling_medians(df: DataFrame, window_minutes: int = 360, parts: int | None = None, id_col: str = "click_id", time_col: str = "ts", series_col: str = "kind", value_col: str = "value") -> DataFrame:
    """Per row: id, series, n, median2, mad4, far, over the rows of its series in the window up to its time.

    An id counts once: of unlike rows of one id that with the least (time, series, value), nulls of time last;
    null ids are one id. Rows without a time are dropped. A null series is a series. A row without a value
    gets the window's figures but no far. Equal times see each other. With fewer than 5 values median2, mad4
    and far are null. No rows give none; other columns are left behind. Rows of one series and one microsecond
    aren't split.
    """
    window = window_minutes * 60_000_000
    ts = micros(F.col(time_col), df.schema[time_col].dataType)
    rows = df.select(F.col(id_col).alias("__id"), ts.alias("__ts"), F.col(series_col).alias("__series"), hundredths(F.col(value_col)).alias("__cents"))
    if parts is None:
        dense = rows.groupBy("__series", F.floor(F.col("__ts") / window)).count().agg(F.max("count")).first()[0] or 0
        parts = max(1, -(-dense // STRETCH_ROWS))
    parts = next(p for p in range(min(parts, window), window + 1) if window % p == 0)
    width = window // parts

    once = rows.groupBy("__id").agg(F.min(F.struct(F.col("__ts").isNull().alias("no_time"), "__ts", "__series", "__cents")).alias("r"))
    once = once.where("NOT r.no_time").select("__id", "r.__ts", "r.__series", "r.__cents").withColumn("__chunk", F.expr(f"CAST(__ts - pmod(__ts, {width}L) AS BIGINT) div {width}L"))
    place = lambda own, after: F.struct((F.col("__chunk") + after).alias("__chunk"), F.lit(own).alias("__own"))
    later = F.when(F.col("__cents").isNotNull(), place(False, parts))
    dealt = once.withColumn("__to", F.explode(F.array_compact(F.array(place(True, 0), later))))
    dealt = dealt.select("__series", "__to.__chunk", "__ts", F.when(F.col("__to.__own"), F.col("__id")).alias("__id"), "__cents", "__to.__own", F.lit(1).cast("long").alias("__weight"))
    if parts > 1:
        counted = once.where("__cents IS NOT NULL").groupBy("__series", "__chunk", "__cents").agg(F.count(F.lit(1)).alias("__weight"))
        spread = counted.withColumn("__chunk", F.explode(F.sequence(F.col("__chunk") + 1, F.col("__chunk") + parts - 1)))
        between = spread.groupBy("__series", "__chunk", "__cents").agg(F.sum("__weight").alias("__weight"))
        before = between.select("__series", "__chunk", (F.col("__chunk") * width - 1).alias("__ts"), F.lit(None).cast(df.schema[id_col].dataType).alias("__id"), "__cents", F.lit(False).alias("__own"), "__weight")
        dealt = dealt.unionByName(before)
    ordered = dealt.repartition("__series", "__chunk").sortWithinPartitions("__series", "__chunk", "__ts")
    kinds = [df.schema[id_col].dataType, df.schema[series_col].dataType, T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]
    out = T.StructType([T.StructField(c, t) for c, t in zip([id_col, series_col, "n", "median2", "mad4", "far"], kinds, strict=True)])
    from pyspark.sql.pandas.types import to_arrow_schema

    return ordered.mapInArrow(_rolled(window, width, to_arrow_schema(out)), out)
