"""Due dates, months and their spellings. Today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.functions.text import strip

#: Month names as tabs spell them, and two other spellings.
MONTHS = ("yanvar", "fevral", "mart", "aprel", "may", "iyun", "iyul", "avgust", "sentyabr", "oktyabr", "noyabr", "dekabr")
ALIASES = {"sentabr": 9, "oktabr": 10} | {m: i for i, m in enumerate(MONTHS, 1)}
#: Serial day numbers taken for dates, and day 0.
SERIAL_RANGE = (33000, 80000)
SERIAL_EPOCH = "1899-12-30"
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def serial_date(n: Column) -> Column:
    day = F.rint(n).cast("int")
    return F.when(n.between(*map(float, SERIAL_RANGE)), F.date_add(F.lit(SERIAL_EPOCH).cast("date"), day))


def due_date(c: Column, today: Column) -> Column:
    """ISO, D.M.Y (two-digit years in 20xx), D.M of this year, or a serial number.

    The first form that matches decides, even where it names no day; commas are points, slashes too.
    """
    t = F.replace(strip(c), F.lit(","), F.lit("."))
    iso, full, short, serial = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[./](\d{1,2})[./](\d{2,4})$", r"^(\d{1,2})[./](\d{1,2})$", r"^\d+(\.\d+)?$"
    part = lambda p, i: F.regexp_extract(t, p, i)
    year = F.when(F.char_length(part(full, 3)) == 2, F.concat(F.lit("20"), part(full, 3))).otherwise(part(full, 3))
    return (
        F.when(t.rlike(iso), _date(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(full), _date(year, part(full, 2), part(full, 1)))
        .when(t.rlike(short), _date(F.year(today).cast("string"), part(short, 2), part(short, 1)))
        .when(t.rlike(serial), serial_date(t.try_cast("double")))
    )


def due_bucket(due: Column, today: Column, soon: int = 5) -> Column:
    days = F.date_diff(due, today)
    return F.when(due.isNull(), "nodate").when(days < 0, "overdue").when(days <= soon, "soon").otherwise("future")


def due_soon(due: Column, today: Column, days: int = 4) -> Column:
    return F.date_diff(due, today).between(0, days)


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))


def expand_month(title: Column, day: Column, mark: str = "<oy>") -> Column:
    return F.replace(title, F.lit(mark), month_name(day))


def tab_matches_month(title: Column, prefix: str, month: int) -> Column:
    """prefix and a spelling of the month, at the end or before a blank or bracket; title is normalised."""
    names = "|".join(a for a, i in ALIASES.items() if i == month)
    return title.rlike(rf"^{prefix} (?:{names})(?:$| |\()")


def years_in(title: Column) -> Column:
    return F.regexp_extract_all(title, F.lit(r"(20[0-9]{2})"), 1)


def months_in(question: Column) -> Column:
    """Month numbers by first place in a normalised question; exactly two mean the cyclic range between.

    "may" counts only where a word starts.
    """
    hits = []
    for alias, i in ALIASES.items():
        place = F.regexp_instr(question, F.lit(r"(?<![\p{L}\p{N}_])may" if alias == "may" else alias))
        hits.append(F.struct(place.alias("at"), F.lit(i).alias("m")))
    seen = F.array_sort(F.filter(F.array(*hits), lambda h: h["at"] > 0))
    order = F.array_distinct(F.transform(seen, lambda h: h["m"]))
    first, last = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    span = F.transform(F.sequence(F.lit(0), (last - first + 12) % 12), lambda k: (first + k - 1) % 12 + 1)
    return F.when(F.size(order) == 2, span).otherwise(order)


def human_date(day: Column) -> Column:
    return F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" ("), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1), F.lit(")"))
