"""Order MinHash fingerprints, with DataFrame functions only.

Units are the stretches of a text between white space; k-mers are pairs of neighbouring units, and the
last unit alone. Every k-mer carries its occurrence number, so that repeats count. The hash of (k-mer,
occurrence) deals k-mers over 64 buckets. In each bucket the two minimal ones are selected, put back in
text order, and hashed as a tuple: an entry (bucket, 16-bit signature). The fingerprint is the list of
entries; moving a passage changes it although the set of k-mers stays, so it follows edit distance.

A k-mer is one long: 40 bits of hash (the upper 6 are the bucket) and 24 bits of position, so one sort
of longs orders by bucket and hash. Positions past 2 ** 24 - 1 count as that one: two selected k-mers from
beyond it stand in order of their hashes. Only repeated k-mers need a number, and each finds its own by binary
search among the sorted repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids that bounds of ranges are taken from, where ids aren't numbers.
BOUND_IDS = 10_000
#: Bytes from which a unit without white space is cut into characters, and characters of one hash.
LONG_UNIT, GRAM = 96, 6
PLACE = 24
LOW = (1 << PLACE) - 1


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, 58)


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE)


def _same(x: Column, y: Column, above: int) -> Column:
    """Equal upper bits; null where y is."""
    return F.shiftrightunsigned(x.bitwiseXOR(y), above) == 0


def _least(name: str) -> Column:
    """The first two of each bucket in a sorted array."""
    return F.filter(name, lambda x, i: ~F.coalesce(_same(x, F.get(F.col(name), i - 2), 58), F.lit(False)))


def _earlier(name: str, x: Column, i: Column) -> Column:
    """How many elements right before element i of a sorted array have its hash, by binary search."""
    powers = F.transform(F.sequence(F.floor(F.log2(F.size(name))).cast("int"), F.lit(0), F.lit(-1)), lambda t: F.pow(F.lit(2.0), t).cast("int"))
    return F.when(
        _same(x, F.get(F.col(name), i - 1), PLACE),
        F.aggregate(powers, F.lit(0), lambda r, p: F.when(_same(x, F.get(F.col(name), i - r - p), PLACE), r + p).otherwise(r)),
    ).otherwise(F.lit(0))


def _unit_hashes(units: Column) -> Column:
    """A hash a unit; one of more than LONG_UNIT bytes gives one for each of its characters and the GRAM - 1 after it.

    So a text without white space, as in Chinese or Thai, has as many units as characters.
    """
    of = lambda c: F.transform(c, lambda x, i: F.xxhash64(x, *(F.get(c, i + k) for k in range(1, GRAM))))
    grams = lambda u: F.flatten(F.transform(F.array(F.split(u, "")), of))  # noqa: E731  split once: a lambda's own name for it
    long = lambda u: F.octet_length(u) > LONG_UNIT
    cut = F.flatten(F.transform(units, lambda u: F.when(long(u), grams(u)).otherwise(F.array(F.xxhash64(u)))))
    return F.when(F.exists(units, long), cut).otherwise(F.transform(units, lambda u: F.xxhash64(u)))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add out, array<bigint> of entries bucket * 65536 + signature, ascending by place in the sort.

    The text must not be null. An empty text has one empty unit, so two of them are alike.
    """
    hashes, kmers, many, part = (f"__{out}_{x}" for x in ("hashes", "kmers", "many", "part"))
    keep = df.columns
    blank = F.replace(F.replace(F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    df = df.withColumn(hashes, _unit_hashes(F.split(blank, " ")))
    # get() past the end is null, which leaves the last unit's own hash
    packed = F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(F.col(hashes), i + 1)).bitwiseAND(F.lit(~LOW)).bitwiseOR(F.least(i, F.lit(LOW)).cast("long")))
    df = df.withColumn(kmers, F.sort_array(packed)).drop(hashes)
    df = df.withColumn(many, F.filter(kmers, lambda x, i: _same(x, F.get(F.col(kmers), i - 1), PLACE)))
    place = lambda x: x.bitwiseAND(F.lit(LOW))
    numbered = F.transform(many, lambda x, i: F.xxhash64(_hash(x), _earlier(many, x, i) + 1).bitwiseAND(F.lit(~LOW)).bitwiseOR(place(x)))
    df = df.withColumn(kmers, F.when(F.size(many) == 0, F.col(kmers)).otherwise(F.array_except(kmers, many)))
    df = df.withColumn(part, _least(kmers)).drop(kmers)
    df = df.withColumn(part, F.when(F.size(many) == 0, F.col(part)).otherwise(F.sort_array(F.concat(part, numbered)))).drop(many)
    df = df.withColumn(part, _least(part))

    def entry(x: Column, i: Column) -> Column:
        after, before = F.get(F.col(part), i + 1), F.get(F.col(part), i - 1)
        last = after.isNull() | (_bucket(after) != _bucket(x))
        two = (i > 0) & (_bucket(before) == _bucket(x))
        tuple_hash = F.when(~two, F.xxhash64(_hash(x))).when(place(before) <= place(x), F.xxhash64(_hash(before), _hash(x))).otherwise(F.xxhash64(_hash(x), _hash(before)))
        return F.when(last, _bucket(x) * F.lit(65536) + tuple_hash.bitwiseAND(F.lit(65535)))

    return df.withColumn(out, F.filter(F.transform(part, entry), lambda e: e.isNotNull())).select(*keep, out)


def as_text(entries: Column) -> Column:
    """6 hex digits an entry: 2 of its bucket, 4 of its signature."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal entries over buckets that either has: 1 for equal fingerprints, near 0 for unrelated ones."""
    places = lambda x: F.transform(x, lambda e: F.shiftright(e, 16))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(places(a), places(b)))


def with_next(docs: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """Add the text of the row after each in ascending (id, text); the last row gets the first's.

    Rows are dealt by ranges of ids of any type that has an order. The bounds are quantiles of all ids, or of
    10,000 of them picked by hash where ids aren't numbers; they change the dealing only. Within a range a
    window finds the next row, and a row a range stitches the ranges together. One shuffle of the texts.
    """
    spark = docs.sparkSession
    ranges = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if isinstance(docs.schema[id_col].dataType, T.NumericType):
        cut = docs.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    else:
        some = sorted(r[0] for r in docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(BOUND_IDS).collect())
        cut = [some[len(some) * i // ranges] for i in range(1, ranges)] if some else []
    bounds = sorted(set(cut))
    group = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(id_col))) if bounds else F.lit(0)
    dealt = docs.withColumn("__range", F.coalesce(group, F.lit(-1))).repartition("__range")
    order = [F.col(id_col).asc_nulls_first(), F.col(text_col)]
    within = dealt.withColumn(out, F.lead(text_col).over(Window.partitionBy("__range").orderBy(*order)))
    first = dealt.groupBy("__range").agg(F.min(F.struct(id_col, text_col)).alias("__first"))
    # at most as many rows as ranges
    all_ranges = Window.orderBy("__range")
    follow = first.select("__range", F.coalesce(F.lead("__first").over(all_ranges), F.first("__first").over(all_ranges))[text_col].alias("__then"))
    return within.join(follow, "__range").withColumn(out, F.coalesce(out, "__then")).drop("__range", "__then")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the next document replaces the second half.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null
    text is empty. Rows with equal ids follow each other by text; a null id comes first. A table of one
    row is its own next. No rows give no rows.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = with_fingerprint(rows, "__text", "__print")
    packed = rows.select(id_col, F.struct("__text", "__print").alias("__own"))
    chained = with_next(packed, id_col, "__own", "__next")
    n = F.char_length("__own.__text")
    edited = F.concat(F.expr("left(__own.__text, char_length(__own.__text) - char_length(__own.__text) div 2)"), F.expr("left(__next.__text, cast(char_length(__own.__text) div 2 AS int))"))
    full = chained.select(id_col, n.cast("long").alias("n_chars"), F.col("__own.__print").alias("__a"), F.col("__next.__print").alias("__c"), edited.alias("__edited"))
    full = with_fingerprint(full, "__edited", "__b")
    a, b, c = F.col("__a"), F.col("__b"), F.col("__c")
    return full.select(
        id_col,
        "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"),
        as_text(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, c).alias("near_next"),
    )
