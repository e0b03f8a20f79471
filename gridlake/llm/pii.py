"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators of high recall propose spans of a text: the base patterns, and looser ones for addresses,
numbers and secrets (long runs of letters and digits). Boosted trees score each loose candidate by its
format and its context. Each group has its own trees, fitted on a bounded sample of the corpus and on
labelled examples made by rule. A corpus candidate gets a label only where there is evidence: a base span
overlaps it (its @ and its + are hidden from the features, so what looks alike without them is selected
too), a long number fails its check digit, an address has no dot, or a secret has or lacks a naming cue such
as token =. The examples show both labels of what a corpus leaves open: (at) and (dot), phones without +,
and paths, identifiers, hashes, UUIDs, dates and codes, which are none. Candidates above a threshold
calibrated on held-out ones are added to the base spans, which all stay.

Matches get their places from split() and regexp_extract_all() of one pattern: the stretches between
matches and the matches, in turn, make up the text. Patterns are possessive and anchored after the match
before, so that they take linear time and find what the plain greedy patterns find. Running sums go over
chunks of about the square root of the matches, and overlaps are found by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.llm import boosting
from gridlake.llm.pii_examples import examples

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the trees add come after the base ones.
ALL_KINDS = (*KINDS, "secret")
#: What the contract states, in forms that never go back: a run is entered at its start or right after a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to hold a match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    "number": r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}",
}
FEATURES = ("digits", "letters", "capitals", "dots", "groups", "longest", "parens", "chars", "before", "after", "cue", "distinct", "switches", "slashes", "dashes", "word", "blanks", "first", "form")
#: Candidates of a group that its trees are fitted on at most, how many of them one text may give, and of how many texts (about).
SAMPLE = 4_000
PER_TEXT = 8
TEXTS = 4_000
#: Held-out candidates that a threshold must select at least, and the share of them that must be right.
LEAST_SELECTED, PRECISION = 50, 0.98
CUE = r"(?i)(?:tel|phone|fon|call|mobile|fax|mail|contact|card|visa|iban|konto|account|ip|host|server)[^A-Za-z]{0,3}$"
#: Names that make a following run a secret.
NAMED = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential)s?[\"']?\s{0,2}[:=]{0,2}\s{0,2}[\"']?$"
CONTEXT = 24
BLOCK = 4096


def _chunked(items: str) -> Column:
    """An array column as an array of about as many chunks as a chunk has items."""
    n = F.size(items)
    each = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / each).cast("int"), F.lit(0))), lambda k: F.slice(items, k * each + 1, each))


def _running(df: DataFrame, items: str, out: str, step, join) -> DataFrame:
    """out: for each number of the array before which value stands, by step from 0: two levels of chunks.

    step(acc, x) must be associative with 0 as its neutral element; join adds what stands before a chunk.
    """
    none = lambda: F.expr("cast(array() as array<int>)")
    walk = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("at"), none().alias("out")), lambda acc, x: F.struct(step(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    df = df.withColumn("__walks", F.transform(_chunked(items), walk))
    df = df.withColumn("__heads", walk(F.transform("__walks", lambda w: w["at"]))["out"])
    return df.withColumn(out, F.flatten(F.zip_with("__walks", "__heads", lambda w, h: F.transform(w["out"], lambda v: join(h, v))))).drop("__walks", "__heads")


def with_located(df: DataFrame, text: Column, pattern: str, needed: Column, out: str) -> DataFrame:
    """Add all matches, left to right: code point start, end (exclusive), string, and up to 24 characters
    before it (back to the match before) and the one after it."""
    df = df.withColumn("__gaps", F.when(needed, F.split(text, pattern, -1)).otherwise(F.array(text)))
    df = df.withColumn("__hits", F.when(needed, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.expr("cast(array() as array<string>)")))
    df = df.withColumn("__wide", F.zip_with("__gaps", "__hits", lambda g, h: F.char_length(g) + F.coalesce(F.char_length(h), F.lit(0))))
    df = _running(df, "__wide", "__starts", lambda a, x: a + x, lambda h, v: h + v)

    def span(x: Column) -> Column:
        start = x["__starts"] + F.char_length(x["__gaps"])
        return F.struct(start.alias("s"), (start + F.char_length(x["__hits"])).alias("e"), x["__hits"].alias("t"), F.right(x["__gaps"], F.lit(CONTEXT)).alias("b"), F.left(x["next"], F.lit(1)).alias("a"))

    # arrays go in as arguments: a column that only a lambda names may be made anew for every item
    rows = F.arrays_zip("__hits", F.slice("__gaps", 1, F.size("__hits")).alias("__gaps"), F.slice("__starts", 1, F.size("__hits")).alias("__starts"), F.slice("__gaps", 2, F.size("__hits")).alias("next"))
    return df.withColumn(out, F.transform(rows, span)).drop("__gaps", "__hits", "__wide", "__starts")


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of t pass the Luhn check."""
    reversed_digits = F.filter(F.split(F.reverse(_digits(t)), ""), lambda c: c != "")
    weighed = F.transform(reversed_digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, t: Column) -> Column:
    n = F.length(_digits(t))
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(t, r"\."), lambda p: (F.length(plain(p)) < 3) | ((F.length(plain(p)) == 3) & (plain(p) <= "255")))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(t)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def with_base(df: DataFrame, text_col: str) -> DataFrame:
    """Add a column of spans for each kind, and __number, whether digits follow each other. The text must not be null."""
    text = F.col(text_col)
    df = df.withColumn("__number", text.rlike(r"[0-9][\x20().-]{0,2}[0-9]"))
    for kind in KINDS:
        needed = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        # digits of a phone may stand any number of separators apart
        df = with_located(df, text, PATTERNS[kind], needed if kind in ("email", "phone") else needed & F.col("__number"), "__all")
        df = df.withColumn(f"__{kind}", F.filter("__all", _keeper(kind))).drop("__all")
    return df


def _keeper(kind: str):
    return lambda x: _holds(kind, x["t"])


def with_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """Add __loose_email, __loose_number and __loose_secret: candidates with their features and label."""
    text = F.col(text_col)
    df = with_located(df, text, LOOSE["email"], text.contains("@") | text.rlike(r"[(\[]at[)\]]"), "__found_email")
    df = with_located(df, text, LOOSE["number"], F.col("__number"), "__found_number")
    df = with_located(df, text, LOOSE["secret"], text.rlike("[A-Za-z0-9_+/-]{16}"), "__found_secret")
    df = df.withColumn("__found_number", F.filter("__found_number", lambda x: F.length(_digits(x["t"])).between(7, 19)))
    for group in LOOSE:
        df = df.withColumn(f"__loose_{group}", F.transform(F.transform(f"__found_{group}", _shower(group)), _featurer(group))).drop(f"__found_{group}")
    return df


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def _shower(group: str):
    """Add v, what the features see: neither how an address says at nor the plus of a phone."""

    def shown(x: Column) -> Column:
        plain = {"email": F.regexp_replace(F.regexp_replace(x["t"], r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", "."), "number": F.regexp_replace(x["t"], r"^\+", "")}.get(group, x["t"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["b"].alias("b"), x["a"].alias("a"), plain.alias("v"), F.length(_digits(plain)).alias("d"))

    return shown


def _featurer(group: str):
    def featured(x: Column) -> Column:
        kind = F.when(x["d"] >= 13, "card").otherwise("phone") if group == "number" else F.lit(group)
        over = _overlaps_base(x)
        shown, n = x["v"], x["d"]
        named = x["b"].rlike(NAMED)
        none = {"email": F.size(F.regexp_extract_all(shown, F.lit(r"\."), F.lit(0))) == 0, "number": n >= 13}.get(group)
        # null where nothing tells what the candidate is
        label = named if group == "secret" else F.when(over, True).when(none, False)
        letters, capitals = F.length(F.regexp_replace(shown, "[^A-Za-z]", "")), F.length(F.regexp_replace(shown, "[^A-Z]", ""))
        runs = F.filter(F.split(shown, "[^0-9]+"), lambda g: g != "")
        features = {
            "digits": n,
            "letters": letters,
            "capitals": capitals,
            "dots": F.length(shown) - F.length(F.replace(shown, F.lit("."), F.lit(""))),
            "groups": F.size(runs),
            "longest": F.coalesce(F.array_max(F.transform(runs, lambda g: F.length(g))), F.lit(0)),
            "parens": F.contains(shown, F.lit("(")).cast("int"),
            "chars": F.length(shown),
            "before": _char_class(F.right(x["b"], F.lit(1))),
            "after": _char_class(x["a"]),
            "cue": (named if group == "secret" else x["b"].rlike(CUE)).cast("int"),
            "distinct": F.size(F.array_distinct(F.split(shown, ""))),
            "switches": F.size(F.regexp_extract_all(shown, F.lit("[0-9][A-Za-z]|[A-Za-z](?=[0-9])"), F.lit(0))),
            "slashes": F.length(shown) - F.length(F.replace(shown, F.lit("/"), F.lit(""))),
            "dashes": F.length(shown) - F.length(F.translate(shown, "-_", "")),
            "word": F.coalesce(F.array_max(F.transform(F.split(shown, "[^a-z]+"), lambda w: F.length(w))), F.lit(0)),
            "blanks": F.length(shown) - F.length(F.replace(shown, F.lit(" "), F.lit(""))),
            "first": F.length(F.regexp_extract(shown, "^[(]?([0-9]*)", 1)),
            # 1: a date, 2: a UUID, 3: hexadecimal digits only
            "form": F.when(shown.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[.-][0-9]{2}[.-][0-9]{4})"), 1).when(shown.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"), 2).when(shown.rlike("^[0-9a-fA-F]+$"), 3).otherwise(0),
        }
        return F.struct(kind.alias("k"), x["s"].alias("s"), x["e"].alias("e"), over.alias("over"), label.cast("int").alias("y"), *(features[f].cast("int").alias(f) for f in FEATURES))

    return featured


def _overlaps_base(x: Column) -> Column:
    """Whether a base span of any kind overlaps x: the last one that starts before x ends, by binary search."""
    found = F.lit(False)
    for kind in KINDS:
        spans = f"__{kind}"
        powers = F.transform(F.sequence(F.floor(F.log2(F.greatest(F.size(spans), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda t: F.pow(F.lit(2.0), t).cast("int"))
        before = F.aggregate(powers, F.lit(0), _stepper(spans, x))
        found = found | F.coalesce(F.get(spans, before - 1)["e"] > x["s"], F.lit(False))
    return found


def _stepper(spans: str, x: Column):
    return lambda r, p: F.when(F.get(spans, r + p - 1)["s"] < x["e"], r + p).otherwise(r)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, texts: int = TEXTS) -> dict[str, boosting.Boosted]:
    """Trees for each group, fitted on at most sample candidates of about texts distinct texts, and on the examples.

    Texts are picked by their hash, and each gives PER_TEXT candidates of a group at most, so the sample
    depends neither on how rows are dealt nor on copies. Candidates without a label are left out. Thresholds are
    calibrated on candidates that no base span overlaps, since only such are ever added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = min(1.0, texts / max(1, docs.count()))
    rows = docs.select(text.alias("__text")).withColumn("__h", F.xxhash64("__text"))
    rows = rows.where(F.pmod("__h", F.lit(1_000_003)) < F.lit(share * 1_000_003))
    found = with_candidates(with_base(rows, "__text"), "__text")
    pick = lambda g: F.slice(F.array_sort(F.transform(f"__loose_{g}", lambda x: F.struct(F.xxhash64(F.col("__h"), x["s"]).alias("h"), x.alias("x")))), 1, PER_TEXT)
    # no filter on candidates here: pushed below all projections, it would repeat their expressions in one another
    once = found.select("__h", *(pick(g).alias(g) for g in LOOSE)).groupBy("__h").agg(*(F.max(g).alias(g) for g in LOOSE))
    every = F.concat(*(F.transform(g, _tagged(g)) for g in LOOSE))
    taken = once.select(F.explode(every).alias("c")).select("c.*")
    place = F.row_number().over(Window.partitionBy("g").orderBy("h", "x"))
    table = taken.withColumn("__r", place).where(F.col("__r") <= sample).select("g", "h", *(F.col(f"x.{f}").alias(f) for f in FEATURES), F.col("x.over").cast("int").alias("over"), F.col("x.y").alias("y")).toArrow()
    table = pa.concat_tables([table, _labelled(docs.sparkSession).select(table.column_names)], promote_options="permissive")
    table = table.filter(table.column("y").is_valid())
    values = {c: np.asarray(table.column(c)) for c in table.column_names}
    order, out = np.argsort(values["h"], kind="stable"), {}
    for g in LOOSE:
        at = order[values["g"][order] == g]
        out[g] = boosting.fit({f: values[f][at].astype(float) for f in FEATURES}, values["y"][at].astype(float), rounds=20, precision=PRECISION, least=LEAST_SELECTED, judged=values["over"][at] == 0)
    return out


def _labelled(spark: SparkSession) -> pa.Table:
    """The candidates that the examples are about, with their labels."""
    made = spark.createDataFrame(pa.table(list(zip(*examples(), strict=True)), names=["__text", "g", "from", "to", "label"]))
    found = with_candidates(with_base(made, "__text"), "__text")
    one = lambda g: F.get(F.filter(f"__loose_{g}", lambda x: (x["s"] < F.col("to")) & (x["e"] > F.col("from"))), F.lit(0))
    own = F.coalesce(*(F.when(F.col("g") == g, one(g)) for g in LOOSE))
    kept = found.select("g", F.xxhash64("__text").alias("h"), F.col("label").cast("int").alias("y"), own.alias("x")).where("x IS NOT NULL AND NOT x.over")
    return kept.select("g", "h", *(F.col(f"x.{f}").alias(f) for f in FEATURES), F.lit(0).alias("over"), "y").toArrow()


def _tagged(group: str):
    return lambda c: F.struct(F.lit(group).alias("g"), c["h"].alias("h"), c["x"].alias("x"))


def find(docs: DataFrame, model: dict[str, boosting.Boosted], text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """Add two arrays of struct<k, s, e>, by kind as in ALL_KINDS and then start: base_col and spans_col.

    Spans are the base ones and the loose candidates that the trees select and no base span overlaps. A null
    text has none. Rows and columns stay as they are, but columns of these two names are replaced. No shuffle.
    Write the result before filtering by spans, else the filter repeats what makes them.
    """
    keep = [c for c in docs.columns if c not in (base_col, spans_col)]
    df = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    df = with_candidates(with_base(df, "__text"), "__text")
    plain = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    df = df.withColumn("__base", F.concat(*(F.transform(f"__{k}", _kinded(k)) for k in KINDS)))
    df = df.withColumn("__extra", F.concat(*(F.transform(F.filter(f"__loose_{g}", _chooser(model[g])), plain) for g in LOOSE)))
    rank = lambda x: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), x["k"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))
    both = F.transform(F.array_sort(F.transform(F.concat("__base", "__extra"), rank)), plain)
    return df.select(*keep, F.col("__base").alias(base_col), both.alias(spans_col))


def _kinded(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def _chooser(model: boosting.Boosted):
    if not np.isfinite(model.threshold):
        return lambda x: F.lit(False)
    # where evidence speaks against a candidate the trees aren't asked
    return lambda x: ~x["over"] & (F.coalesce(x["y"], F.lit(1)) == 1) & (model.margin_column(lambda f: x[f]) >= F.lit(model.threshold))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Replace each span by its kind in brackets; of overlapping spans the first one names the stretch.

    Columns stay, spans_col included. The text is cut into blocks once, and stretches are put together from
    blocks, so long texts take linear time. A null text stays null.
    """
    text, keep = F.col(text_col), found.columns
    df = found.withColumn("__by", F.array_sort(F.transform(spans_col, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k")))))
    df = df.withColumn("__ends", F.transform("__by", lambda x: -x["e"]))
    df = _running(df, "__ends", "__past", lambda a, x: F.greatest(a, x), lambda h, v: F.greatest(h, v))
    df = df.withColumn("__blocks", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def stretch(a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        block = lambda k: F.coalesce(F.get("__blocks", k), F.lit(""))
        long = F.concat(F.substring(block(i), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice("__blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(block(j), F.lit(1), b % BLOCK))
        return F.when(a >= b, "").when(i == j, F.substring(block(i), a % BLOCK + 1, b - a)).otherwise(long)

    def piece(x: Column, past: Column) -> Column:
        return F.when(x["s"] >= past, F.concat(stretch(past, x["s"]), F.lit("["), F.upper(x["k"]), F.lit("]"))).otherwise(F.lit(""))

    end = F.array_max("__ends")
    clean = F.concat(F.array_join(F.zip_with("__by", "__past", piece), ""), stretch(end, F.char_length(text)))
    return df.withColumn(text_col, F.when(F.size("__by") == 0, text).otherwise(clean)).select(*keep)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
