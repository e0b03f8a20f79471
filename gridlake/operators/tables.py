"""From grids to typed rows, without a shuffle: a grid holds at most 78 x 1000 cells, so it is bound within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.dates import ALIASES, due_date
from gridlake.functions.text import money, norm, number, status, strip
from gridlake.operators import audit, scorecard
from gridlake.operators.grid import header_row, marker_row

#: Private-use characters that keep cells and rows apart while a whole grid is normalised in one call.
CELL, ROW = "\ue000", "\ue001"
#: Words of the titles that columns are bound by.
MAIN_COLUMNS = {"name": ["loyihalar", "loyiha nomi"], "rating": ["reyting"], "owner": ["manager"], "contract": ["shartnoma"], "ends": ["tugash"], "score": ["ball yeg", "ball yig"]}
MONTH_COLUMNS = {"name": ["proekt nomi", "proekt"], "plan": ["ideal"], "actual": ["proekt bali"]}
CARD_COLUMNS = {"plan": ["ideal"], "actual": ["proekt bali"], "delay": ["kechga qolgan", "kech"]}
RECEIVABLE_COLUMNS = {"project": ["nomi"], "owner": ["shaxs"], "outstanding": ["summa"], "collected": ["undirildi"], "prepaid": ["aktive"], "due": ["final"], "status": ["xolati"], "lost": ["lose summa", "lose"]}


def tab_of_range(name: Column) -> Column:
    """Tab of 'Tab''s'!A1:B2 or Tab!A1:B2."""
    quoted = F.regexp_extract(name, r"(?s)^'(.+)'![^']*$", 1)
    return F.when(quoted != "", F.replace(quoted, F.lit("''"), F.lit("'"))).otherwise(F.substring_index(name, "!", 1))


def range_of_tab(tab: Column, area: str = "A1:BZ1000") -> Column:
    return F.concat(F.lit("'"), F.replace(tab, F.lit("'"), F.lit("''")), F.lit(f"'!{area}"))


def normalised(grid: Column) -> Column:
    """The grid with every cell normalised; null cells are empty."""
    clean = lambda c: F.translate(F.coalesce(c, F.lit("")), CELL + ROW, "")
    text = F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(F.coalesce(r, F.array().cast("array<string>")), clean), CELL)), ROW)
    return F.transform(F.split(norm(text), ROW), lambda r: F.transform(F.split(r, CELL), lambda c: F.trim(c)))


def first_containing(titles: Column, words: list[str]) -> Column:
    """0-based place of the first title that contains any word; NULL without one."""
    return _place(titles, lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)))


def equal_then_containing(titles: Column, words: list[str]) -> Column:
    """Word by word: an equal title, then one that contains it."""
    return F.coalesce(*(_place(titles, test) for w in words for test in (_equals(w), _contains(w))))


def _equals(w: str):
    return lambda t: t == w


def _contains(w: str):
    return lambda t: F.contains(t, F.lit(w))


def _place(titles: Column, test) -> Column:
    return F.nullif(F.array_position(F.transform(titles, test), True), F.lit(0)).cast("int") - 1


def key_place(titles: Column, key: Column) -> Column:
    """0-based key column: a number counts from 1, a text is a title whatever its case, else the first column."""
    plain = F.transform(titles, lambda t: F.lower(strip(t)))
    named = F.nullif(F.array_position(plain, F.lower(strip(key))), F.lit(0)).cast("int") - 1
    return F.when(key.rlike(r"^[+-]?[0-9]{1,9}$"), F.greatest(F.lit(0), key.try_cast("int") - 1)).otherwise(F.coalesce(named, F.lit(0)))


def table_rows(grids: DataFrame, columns: dict[str, Column], stop) -> DataFrame:
    """Rows below the header and above the first row where stop(normalised row, row) holds.

    columns: name to place, expressions of __titles (normalised). grids: any columns, grid among them; the
    others are kept. Adds row, row_no (1-based), filled and, for each name, c_<name>, the place or NULL.
    """
    keep = [c for c in grids.columns if c != "grid"]
    df = grids.withColumn("__norm", normalised(F.col("grid"))).withColumn("__h", header_row(F.col("grid")))
    df = df.withColumn("__titles", F.coalesce(F.get("__norm", "__h"), F.array().cast("array<string>")))
    for name, place in columns.items():
        df = df.withColumn(f"c_{name}", place)
    ends = F.array_min(F.filter(F.transform("__norm", lambda r, i: F.when((i > F.col("__h")) & stop(r), i)), lambda i: i.isNotNull()))
    df = df.withColumn("__end", F.coalesce(ends, F.lit(2**31 - 1)))
    rows = df.select(*keep, *(f"c_{n}" for n in columns), "__h", "__end", F.posexplode("grid").alias("__r", "row"))
    rows = rows.where("__r > __h AND __r < __end").withColumn("row_no", F.col("__r") + 1).drop("__h", "__end", "__r")
    return rows.withColumn("filled", F.size(F.filter("row", lambda c: F.coalesce(strip(c), F.lit("")) != "")))


def cell(name: str) -> Column:
    """Stripped text of a bound column; '' where the row is short or the column absent."""
    return F.coalesce(strip(F.get("row", F.col(f"c_{name}"))), F.lit(""))


def _any_of(words: dict[str, list[str]]) -> dict[str, Column]:
    return {k: first_containing(F.col("__titles"), v) for k, v in words.items()}


def score_table_ends(row: Column) -> Column:
    """A wholly blank row or one with a marker ends a score table."""
    return F.forall(row, lambda c: c == "") | marker_row(row)


def month_scorecards(grids: DataFrame, last: bool = False) -> DataFrame:
    """grids: day, sheet_id, range, ordinal, grid. A scorecard a day and sheet from its month tabs.

    A tab is a month by any spelling. Of several month ranges the first counts (last: the last), by ordinal.
    """
    df = grids.withColumn("__tab", norm(tab_of_range(F.col("range")))).where(F.col("__tab").isin(*ALIASES))
    w = Window.partitionBy("day", "sheet_id").orderBy(F.desc("ordinal") if last else F.asc("ordinal"))
    df = df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__tab")
    rows = table_rows(df, _any_of(CARD_COLUMNS), score_table_ends)
    cards = scorecard.scorecard(rows, ["day", "sheet_id"], number(cell("plan")), number(cell("actual")), number(cell("delay")))
    empty = df.select("day", "sheet_id").join(cards.select("day", "sheet_id"), ["day", "sheet_id"], "left_anti")
    zero = empty.select("day", "sheet_id", F.lit(0).cast("long").alias("active"), *(F.lit(0.0).alias(c) for c in ("plan", "actual", "delay_days", "pct", "delay_pct")))
    return cards.unionByName(zero)


def audit_grids(grids: DataFrame, sheets: DataFrame, month: str) -> DataFrame:
    """Findings of main and month tabs: sheet_id, tab, row_no, key, level, detail.

    grids: sheet_id, range, ordinal, grid. sheets: sheet_id, is_scorecard, tabs (in order). The last tab
    named like the month counts. Structural findings have no row.
    """
    cards = sheets.where(F.coalesce("is_scorecard", F.lit(True))).select("sheet_id", F.coalesce("tabs", F.array().cast("array<string>")).alias("tabs"))
    named = cards.select("sheet_id", F.posexplode_outer("tabs").alias("pos", "tab")).withColumn("__n", norm(F.col("tab")))
    chosen = named.groupBy("sheet_id").agg(F.min_by("tab", F.when(F.col("__n") == "main", F.col("pos"))).alias("main"), F.max_by("tab", F.when(F.col("__n") == month, F.col("pos"))).alias("month"))
    missing = chosen.select("sheet_id", F.explode(F.array(F.when(F.col("main").isNull(), "main_tab_missing"), F.when(F.col("month").isNull(), "month_tab_missing"))).alias("key")).where("key IS NOT NULL")
    structural = missing.select("sheet_id", F.lit(None).cast("string").alias("tab"), F.lit(None).cast("int").alias("row_no"), "key", F.lit("critical").alias("level"), F.lit(None).cast("string").alias("detail"))
    of = grids.withColumn("tab", tab_of_range(F.col("range")))
    pick = lambda which: of.join(chosen.select("sheet_id", F.col(which).alias("tab")).where("tab IS NOT NULL"), ["sheet_id", "tab"])
    total = {"total": _place(F.col("__titles"), _equals("jami"))}
    main = table_rows(pick("main"), _any_of(MAIN_COLUMNS) | total, score_table_ends)
    monthly = table_rows(pick("month"), _any_of(MONTH_COLUMNS), score_table_ends)
    there = lambda *names: {n: F.col(f"c_{n}").isNotNull() for n in names}
    has = there("owner", "rating", "contract", "ends") | {"score": F.col("c_score").isNotNull() & F.col("c_total").isNotNull()}
    main_rules = audit.scorecard_rules(cell("name"), F.col("filled"), cell("owner"), cell("rating"), norm(cell("contract")), cell("ends"), cell("score"), cell("total"), has)
    month_rules = audit.month_rules(cell("name"), {"plan": cell("plan"), "actual": cell("actual")}, there("plan", "actual"))
    at = ["sheet_id", "tab", "row_no"]
    rows = audit.findings(main, main_rules, at).unionByName(audit.findings(monthly, month_rules, at))
    # names on one side only, for sheets that have both tabs' grids
    names = lambda df: df.select("sheet_id", norm(cell("name")).alias("name")).where("name <> ''").distinct()
    both = pick("main").select("sheet_id").join(pick("month").select("sheet_id"), "sheet_id", "left_semi").distinct()
    a, b = names(main), names(monthly)
    one_side = lambda x, y, key, level: x.join(y, ["sheet_id", "name"], "left_anti").join(both, "sheet_id", "left_semi").select("sheet_id", F.lit(None).cast("string").alias("tab"), F.lit(None).cast("int").alias("row_no"), F.lit(key).alias("key"), F.lit(level).alias("level"), F.col("name").alias("detail"))
    return structural.unionByName(rows).unionByName(one_side(b, a, "month_not_in_main", "critical")).unionByName(one_side(a, b, "main_not_in_month", "warning"))


def receivable_rows(grids: DataFrame, today: Column) -> DataFrame:
    """Typed receivables of each grid; grids lacking the name or the collected column give none.

    The table ends at a row whose first cell is jami or whose name starts with ehtimoli; rows without a name
    are skipped. An absent or blank owner is NULL.
    """
    places = {k: equal_then_containing(F.col("__titles"), v) for k, v in RECEIVABLE_COLUMNS.items()}
    ends = lambda r: (F.coalesce(F.get(r, F.lit(0)), F.lit("")) == "jami") | F.coalesce(F.startswith(F.get(r, F.col("c_project")), F.lit("ehtimoli")), F.lit(False))
    rows = table_rows(grids, places, ends).where("c_project IS NOT NULL AND c_collected IS NOT NULL").where(cell("project") != "")
    keep = [c for c in grids.columns if c != "grid"]
    left, got = money(cell("outstanding")), money(cell("collected"))
    return rows.select(
        *keep,
        "row_no",
        cell("project").alias("project"),
        norm(cell("project")).alias("name_key"),
        F.nullif(cell("owner"), F.lit("")).alias("owner"),
        (cell("owner") == "").alias("owner_missing"),
        F.col("c_owner").isNotNull().alias("owner_col_present"),
        left.alias("outstanding"),
        cell("outstanding").alias("outstanding_raw"),
        got.alias("collected"),
        money(cell("prepaid")).alias("prepaid"),
        (left + got).alias("agreed"),
        money(cell("lost")).alias("lost"),
        cell("lost").alias("lost_raw"),
        F.col("c_lost").isNotNull().alias("lost_col_present"),
        (cell("status") == "").alias("status_blank"),
        due_date(cell("due"), today).alias("due"),
        cell("due").alias("due_raw"),
        status(cell("status")).alias("status"),
    )


def watch_tabs(tabs: DataFrame, month: Column) -> DataFrame:
    """tabs: sheet_id, ordinal, title. Per sheet the main tab (or its stand-in) and the last tab of the month."""
    df = tabs.withColumn("__n", norm(F.col("title")))
    first = lambda test: F.min_by("title", F.when(test, F.col("ordinal")))
    return df.groupBy("sheet_id").agg(
        first(F.col("__n") == "main").alias("main"),
        first(F.contains("__n", F.lit("ishlash muddati"))).alias("__stand_in"),
        F.max_by("title", F.when(F.col("__n") == month, F.col("ordinal"))).alias("month"),
    ).select("sheet_id", F.coalesce("main", "__stand_in").alias("main"), F.col("main").isNull().alias("stands_in"), "month")


def key_columns(tabs: DataFrame, watched: DataFrame, keys: DataFrame, day: Column) -> DataFrame:
    """Key column of each tab: by its own title, else main's for the main tab, else month's for the month tab.

    keys: sheet_id, name, key_column; a name may hold the mark of the current month.
    """
    from gridlake.functions.dates import expand_month

    k = keys.select("sheet_id", norm(expand_month(F.col("name"), day)).alias("__name"), "key_column")
    df = tabs.withColumn("__n", norm(F.col("title"))).join(watched, "sheet_id", "left")
    role = F.when(F.col("title").eqNullSafe(F.col("main")), "main").when(F.col("title").eqNullSafe(F.col("month")), "month")
    df = df.withColumn("__role", role)
    own = k.select("sheet_id", F.col("__name").alias("__n"), F.col("key_column").alias("__own"))
    by_role = k.select("sheet_id", F.col("__name").alias("__role"), F.col("key_column").alias("__by_role"))
    return df.join(own, ["sheet_id", "__n"], "left").join(by_role, ["sheet_id", "__role"], "left").select("sheet_id", "ordinal", "title", F.coalesce("__own", "__by_role", F.lit("1")).alias("key_column"))


def fallback_month(tabs: DataFrame, prefix: str, today: Column) -> DataFrame:
    """The tab of the latest month up to now; months ahead count as last year's, other years are out."""
    from gridlake.functions.dates import tab_matches_month, years_in

    n = norm(F.col("title"))
    month = F.coalesce(*(F.when(tab_matches_month(n, prefix, m), F.lit(m)) for m in range(1, 13)))
    year_ok = (F.size(years_in(n)) == 0) | F.array_contains(years_in(n), F.year(today).cast("string"))
    df = tabs.where(year_ok).withColumn("__m", month).where("__m IS NOT NULL")
    index = F.when(F.col("__m") <= F.month(today), F.col("__m")).otherwise(F.col("__m") - 12)
    return df.agg(F.max_by("title", F.struct(index, -F.col("ordinal"))).alias("title"))


def best_month_tab(tabs: DataFrame, year: int, unpaid: str | None = None) -> DataFrame:
    """Of several tabs of a month one: that of the year, then most unpaid rows, or the longer title, then by title."""
    n = norm(F.col("title"))
    other = (~F.contains(n, F.lit(str(year)))).cast("int")
    order = F.struct(other, -F.col(unpaid), F.col("ordinal")) if unpaid else F.struct(other, -F.char_length(n), n)
    return tabs.agg(F.min_by("title", order).alias("title"))
