"""Questions: their class, the months, sheets and tabs they name, and the nearest snapshot day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import dates, text
from gridlake.operators.matching import contained_words


def question_class(q: Column, months: Column, words: dict[str, list[str]], long: int = 140) -> Column:
    """max, deep or fast. words: lists max, deep, refer; a reference, two months or a long text make it deep."""
    some = lambda k: F.exists(F.array(*map(F.lit, words.get(k) or ["\0"])), lambda w: F.contains(q, w))
    return F.when(some("max"), "max").when(some("refer") | (F.size(months) >= 2) | (F.char_length(q) > long) | some("deep"), "deep").otherwise("fast")


def follow_up(mode: Column, q: Column, has_history: Column, short: int = 25) -> Column:
    return F.when((mode == "fast") & has_history & (F.char_length(q) <= short), "deep").otherwise(mode)


def needs_live(q: Column, words: list[str]) -> Column:
    """Whether the question asks for the present state rather than the last snapshot."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w)) if words else F.lit(False)


def fresh(day: Column, modified: Column, now: Column, hours: float = 6) -> Column:
    """Whether a snapshot of today is recent enough to answer from."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(modified.cast("timestamp"))
    return F.coalesce((day == now.cast("date")) & (age <= hours * 3600), F.lit(False))


def match_sheets(questions: DataFrame, sheets: DataFrame, q: str, token: str) -> DataFrame:
    """Questions with the sheets they name: an alias is contained in the question.

    sheets: sheet, an alias in token (a row for each alias, any number of them) and is_scorecard. Questions that
    name none get every sheet that is a scorecard, or without scorecards every sheet. Texts are searched once for
    all aliases; the rest are joins by alias and by whether a question named any.
    """
    asked = questions.withColumn("__id", F.struct(*questions.columns))
    hits = contained_words(asked.select("__id", q), sheets.select(token), q, token).join(sheets.select(token, "sheet").distinct(), token)
    named = hits.select("__id", "sheet").distinct().groupBy("__id").agg(F.collect_list("sheet").alias("__named"))
    every = sheets.groupBy("sheet").agg(F.max("is_scorecard").alias("card"))
    default = every.groupBy(F.coalesce("card", F.lit(False)).alias("card")).agg(F.collect_list("sheet").alias("__default"))
    default = default.agg(F.max_by("__default", "card").alias("__default"), F.lit(False).alias("named"))  # one row: the configured defaults
    both = asked.join(named, "__id", "left").withColumn("named", F.col("__named").isNotNull()).join(F.broadcast(default), "named", "left")
    return both.withColumn("sheet", F.explode(F.coalesce("__named", "__default"))).drop("__id", "__named", "__default")


def nearest_day(days: DataFrame, target: Column, day: str = "day") -> DataFrame:
    """The day with least distance to target, the earlier of equals."""
    return days.agg(F.min_by(day, F.struct(F.abs(F.date_diff(F.col(day), target)), F.col(day))).alias(day))


#: Titles by which a tab is watched, and the word of tabs about managers.
MAIN, STAND_IN, MANAGERS = "main", "ishlash muddati", "managerlar"
#: Tabs of one month group, and of one workbook, for a question.
GROUP_TABS, WORKBOOK_TABS = 10, 14


def normal_question(c: Column, norm=text.norm) -> Column:
    """Normalised, with one kind of apostrophe."""
    return F.translate(norm(c), "’ʻ`", "'''")


def tab_index(tabs: DataFrame, norm=text.norm) -> DataFrame:
    """tabs (workbook, title, ord) with name (the title normalised), month and prefix; null where no word is a month."""
    found = text.month_word(F.col("name"), list(dates.ALIASES))
    number = F.create_map(*(F.lit(x) for pair in dates.ALIASES.items() for x in pair))
    named = tabs.withColumn("name", norm(F.col("title"))).withColumn("__m", found)
    return named.withColumn("month", number[F.regexp_extract("__m.rest", r"^([^( ]*)", 1)]).withColumn("prefix", F.col("__m.prefix")).drop("__m")


def match_tabs(asked: DataFrame, tabs: DataFrame, group_most: int = GROUP_TABS, most: int = WORKBOOK_TABS, keep: Callable[[DataFrame, str], DataFrame] = lambda df, tag: df) -> tuple[DataFrame, DataFrame]:
    """(chosen, notes) for many questions and workbooks at once.

    asked: a row for each question and workbook it is put to: id, workbook, q (normalised), months (numbers in
    order, may be empty), current (this month's number), carried (titles of earlier questions, may be null).
    tabs: as tab_index gives them; ord is the place in the workbook.

    chosen: id, workbook, title, stage, place. In order: watched tabs; tabs of the month groups that the question
    names by a word of their prefix, of the asked months or else this month or else the group's last; for asked
    months the last plain tab, the last tab about managers and, where no group is named, the last other tab; tabs
    with a word of five letters in the question, if their month is asked for and no group settles it; carried
    ones. A tab comes once, at its first place; a workbook gives `most` at the most.
    notes: id, workbook, prefix, kind, months, available, loaded (tabs taken of the group): "latest" (this month isn't there, the group's last
    was taken), "capped" (more than group_most, the last were taken) and "missing" (asked months aren't there).

    The words of titles and prefixes are an index: texts are searched once for all words, and hits meet tabs by
    equality of workbook and word. A group, like a workbook, is as long as its list of tabs. Workbooks that no
    question is put to drop out first. keep(df, tag) may write what is read many times (tabs, questions without
    their texts, hits) and read it back.
    """
    at, key = ["workbook"], ["id", "workbook"]
    tabs = keep(tabs.join(asked.select(*at).distinct(), at, "left_semi"), "tabs")
    texts = asked.select(*key, "q")
    asked = keep(asked.withColumn("test", F.contains("q", F.lit("test"))).drop("q"), "asked")
    many = F.size("months") > 0
    words = lambda c, least: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.char_length(w) >= least))
    by_prefix = tabs.where("month IS NOT NULL AND prefix <> ''").select(*at, "prefix", F.explode(words(F.col("prefix"), 3)).alias("word")).distinct()
    names = words(F.col("name"), 5)
    by_name = tabs.select(*at, "title", "ord", "month", F.explode(F.array_except(names, F.array(*map(F.lit, dates.MONTHS)))).alias("word"))
    told = by_prefix.select(*at, "word").union(by_name.select(*at, "word")).distinct()
    hits = contained_words(texts, told.select("word")).drop("q").join(told, [*at, "word"], "left_semi")
    pairs = keep(hits.select(*key, "word"), "hits")

    test_named = F.col("__test")
    tab = F.struct("ord", "month", "title", F.contains("name", F.lit("test")).alias("test"))
    groups = tabs.where("month IS NOT NULL AND prefix <> ''").groupBy(*at, "prefix").agg(F.array_sort(F.collect_list(tab)).alias("tabs"))
    named = pairs.join(by_prefix, [*at, "word"]).select(*key, "prefix").distinct().join(groups, [*at, "prefix"]).join(asked.withColumnRenamed("test", "__test"), key)
    named = named.withColumn("available", F.array_distinct(F.transform("tabs", lambda t: t["month"])))
    fallback = F.when(F.array_contains("available", F.col("current")), F.col("current")).otherwise(F.element_at("available", -1))
    wanted = F.when(many, F.array_intersect("months", "available")).otherwise(F.array(fallback))
    picked = F.filter("tabs", lambda t: F.array_contains(F.col("wanted"), t["month"]) & (test_named | ~t["test"]))
    named = named.withColumn("wanted", wanted).withColumn("picked", picked).withColumn("missing", F.array_except("months", "available"))
    taken = F.when(F.size("picked") > group_most, F.slice("picked", -group_most, group_most)).otherwise(F.col("picked"))
    note = lambda kind, when, months: F.when(when, F.struct(F.lit(kind).alias("kind"), months.alias("months")))
    notes = F.array_compact(
        F.array(
            note("latest", ~many & ~F.array_contains("available", F.col("current")), F.col("wanted")),
            note("capped", F.size("picked") > group_most, F.col("wanted")),
            note("missing", F.size("missing") > 0, F.col("missing")),
        )
    )
    told = named.withColumn("n", F.explode(notes)).select(*key, "prefix", "n.kind", "n.months", "available", F.size(taken).alias("loaded"))
    from_groups = named.select(*key, F.get("tabs", F.lit(0))["ord"].alias("group_ord"), F.explode(taken).alias("t"))

    by_group = named.select(*key).distinct().withColumn("by_group", F.lit(True))
    marked = asked.drop("test").join(by_group, key, "left").na.fill(False, ["by_group"])
    month_names = F.array(*(F.struct(F.lit(i).alias("month"), F.lit(m).alias("word")) for i, m in enumerate(dates.MONTHS, 1)))
    spelled = tabs.select(*at, "title", "name", "ord", F.explode(F.filter(month_names, lambda m: F.contains(F.col("name"), m["word"]))).alias("m"))
    plain, about = F.col("name") == F.col("m.word"), F.contains("name", F.lit(MANAGERS))
    last = lambda when: F.max_by(F.when(when, F.col("title")), F.when(when, F.col("ord")))
    lasts = spelled.groupBy(*at, F.col("m.month").alias("month")).agg(last(plain).alias("plain"), last(about).alias("about"), last(~plain & ~about).alias("other"))
    by_month = marked.select(*key, "by_group", F.posexplode("months").alias("nth", "month")).join(lasts, [*at, "month"])
    kinds = F.array("plain", "about", F.when(~F.col("by_group"), F.col("other")))
    by_month = by_month.select(*key, "nth", F.posexplode(kinds).alias("kind", "title")).where("title IS NOT NULL")

    found = pairs.join(by_name, [*at, "word"]).select(*key, "title", "ord", "month").distinct().join(marked, key)
    asked_for = F.when(many, F.array_contains("months", F.col("month"))).otherwise(F.col("month") == F.col("current"))
    by_word = found.where(F.col("month").isNull() | (~F.col("by_group") & asked_for))

    first = lambda when: F.min_by(F.when(when, F.col("title")), F.when(when, F.col("ord")))
    leads = tabs.groupBy(*at).agg(first(F.col("name") == MAIN).alias("main"), first(F.contains("name", F.lit(STAND_IN))).alias("stand_in"))
    lead = asked.select(*key).join(leads, at).select(*key, F.coalesce("main", "stand_in").alias("title")).where("title IS NOT NULL")
    this_month = asked.select(*key, F.col("current").alias("month")).join(lasts.select(*at, "month", F.col("plain").alias("title")), [*at, "month"]).where("title IS NOT NULL")
    carried = asked.select(*key, F.posexplode("carried").alias("nth", "title")).join(tabs.select(*at, "title").distinct(), [*at, "title"])

    zero = F.lit(0)
    stage = lambda df, n, a, b: df.select(*key, "title", F.struct(F.lit(n).alias("stage"), a.cast("long").alias("a"), b.cast("long").alias("b")).alias("o"))
    every = (
        stage(lead, 0, zero, zero)
        .union(stage(this_month, 0, F.lit(1), zero))
        .union(stage(from_groups.select("*", "t.title"), 1, F.col("group_ord"), F.col("t.ord")))
        .union(stage(by_month, 2, F.col("nth"), F.col("kind")))
        .union(stage(by_word, 3, F.col("ord"), zero))
        .union(stage(carried, 4, F.col("nth"), zero))
    )
    once = every.groupBy(*key, "title").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("o", "title"))
    return once.select(*key, "title", "o.stage", place.alias("place")).where(F.col("place") <= most), told
