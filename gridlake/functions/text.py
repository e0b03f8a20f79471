"""Text functions of grids, documents and answers, as columns; pandas only where Unicode tables are needed."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends. A run of blanks is entered at its start only: linear time."""
    return F.regexp_replace(c, rf"^{SPACES}++|(?<!{SPACES}){SPACES}++$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def _norm(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).lower().split()))


@F.pandas_udf(T.StringType())
def _norm_any(s: pd.Series) -> pd.Series:
    return _norm(s)


def norm(c: Column) -> Column:
    """NFKC, lower case, single blanks. Use norm_ascii where all text is known to be ASCII."""
    return _norm_any(c)


def norm_ascii(c: Column) -> Column:
    """The same for texts that NFKC leaves alone, without Python."""
    return F.regexp_replace(strip(F.lower(c)), rf"{SPACES}+", " ")


def number(c: Column) -> Column:
    """Number of a cell: blanks out, comma as point, trailing % dropped; NULL where it isn't finite."""
    bare = F.regexp_replace(F.regexp_replace(c, SPACES, ""), "%+$", "")
    value = F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def money(c: Column) -> Column:
    """First run of digits, signs, points and commas as an amount; 0 where that fails. A comma is a point."""
    run = F.regexp_extract(F.regexp_replace(c, SPACES, ""), r"[-0-9.,]+", 0)
    return F.coalesce(F.replace(run, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def numeric_text(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, "").rlike(r"^[+-]?[0-9.,]+%?$")


def has_nonzero(c: Column) -> Column:
    return c.rlike("[1-9]")


def year_less_date(c: Column) -> Column:
    return strip(c).rlike(r"^[0-9]{1,2}[./][0-9]{1,2}$")


def status(c: Column) -> Column:
    """paid before paused before churned; else pending."""
    # fixed values: words and signs of a payment status
    n = F.lower(c)
    return (
        F.when(n.contains("qilindi") | c.contains("✅"), "paid")
        .when(n.contains("pauza") | c.contains("⏸"), "paused")
        .when(n.contains("ketdi") | c.contains("⛔"), "churned")
        .otherwise("pending")
    )


def slot_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def column_letters(i: Column) -> Column:
    """0 is A, 25 Z, 26 AA: bijective base 26, up to four letters."""
    letter = lambda n: F.chr(F.lit(65) + n % 26)
    down = lambda n: F.floor(n / 26).cast("int") - 1
    out, rest = letter(i), down(i)
    for _ in range(3):
        out = F.when(rest >= 0, F.concat(letter(rest), out)).otherwise(out)
        rest = F.when(rest >= 0, down(rest)).otherwise(-1)
    return out


def usd(c: Column) -> Column:
    return F.concat(F.lit("$"), F.replace(F.format_number(c, 0), F.lit(","), F.lit(" ")))


def clip(c: Column, most: int = 8000, mark: str = "…") -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


#: Apostrophes that are stored and searched as '.
APOSTROPHES = "ʻʼ‘’`´ʹ′"


def apostrophes(c: Column) -> Column:
    return F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES))


def normalise_document(c: Column) -> Column:
    """LF line ends, one apostrophe, no blanks at line ends, at most two blank lines in a run, stripped."""
    lines = F.regexp_replace(F.replace(F.replace(apostrophes(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"(?md)(?<![\s\p{Z}&&[^\n]])[\s\p{Z}&&[^\n]]++$", "")
    return strip(F.regexp_replace(lines, r"\n{4,}", "\n\n\n"))


def uid(source: Column, origin: Column, content_hash: Column | None = None) -> Column:
    """First 16 hex digits of SHA-256 of source:origin, or source:origin:hash."""
    parts = [source, origin] + ([content_hash] if content_hash is not None else [])
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def query_terms(c: Column, least: int = 3, most: int = 8) -> Column:
    """Distinct word tokens of at least `least` letters in order; without any, the first three tokens."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    long = F.array_distinct(F.filter(found, lambda t: F.char_length(t) >= least))
    return F.when(F.size(long) > 0, F.slice(long, 1, most)).otherwise(F.slice(found, 1, 3))


def search_prefixes(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(apostrophes(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: F.char_length(t) >= 2))


def month_word(tab: Column, aliases: list[str]) -> Column:
    """struct<prefix, rest> of a tab's name at its first word that is a month's alias, or one with a bracket after it; null without."""
    words = F.filter(F.split(strip(tab), r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(words, lambda w: F.regexp_extract(F.lower(w), r"^([^(]*)", 1).isin(aliases)), True)
    return F.when(at > 0, F.struct(F.array_join(F.slice(words, 1, (at - 1).cast("int")), " ").alias("prefix"), F.array_join(F.slice(words, at.cast("int"), F.size(words)), " ").alias("rest")))


def light_metadata(text: Column, title: Column, path: Column, lang: str = "uz", most: int = 300) -> Column:
    """struct<title, lang, tags, summary> without a model: the title given, else the first heading, else the file's name."""
    blank_free = lambda c: F.nullif(strip(c), F.lit(""))
    name = F.coalesce(blank_free(title), first_heading(text), file_title(path))
    return _metadata(name, lang, F.array().cast("array<string>"), text, most)


#: Title and tag of a day's chat, and the title of a document without any.
CHAT_TITLE, CHAT_TAG, NO_TITLE = "Suhbat arxivi — ", "suhbat", "Hujjat"


def chat_metadata(text: Column, path: Column, lang: str = "uz", most: int = 300) -> Column:
    """The same of a day's chat, whose title stays the day in the file's name (or that name) while the text grows."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    day = F.coalesce(F.nullif(F.regexp_extract(file, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), F.lit(""))
    return _metadata(strip(F.concat(F.lit(CHAT_TITLE), day)), lang, F.array(F.lit(CHAT_TAG)), text, most)


def _metadata(title: Column, lang: str, tags: Column, text: Column, most: int) -> Column:
    return F.struct(F.substring(title, 1, 200).alias("title"), F.lit(lang).alias("lang"), tags.alias("tags"), F.substring(strip(text), 1, most).alias("summary"))


def file_title(path: Column) -> Column:
    """The file's name without its suffix, - and _ as blanks."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(stem, "[-_]+", " ")), 1, 120), F.lit("")), F.lit(NO_TITLE))


def first_heading(c: Column) -> Column:
    """The title of the first heading line that has one."""
    return F.nullif(strip(F.regexp_extract(c, r"(?m)^#{1,6}\s++(\S.*)$", 1)), F.lit(""))


def outer_json(c: Column, brackets: str = "{}") -> Column:
    """Text from the first opening to the last closing bracket; NULL without."""
    a, b = ("\\" + x for x in brackets)
    return F.nullif(F.regexp_extract(c, f"(?s){a}.*{b}", 0), F.lit(""))


def fenced_answer(c: Column) -> Column:
    """JSON of an answer: a ```json block, else the whole text if it is in braces; it must have summary or title."""
    block = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    text = F.coalesce(block, F.when(strip(c).rlike(r"(?s)^\{.*\}$"), strip(c)))
    named = F.get_json_object(text, "$.summary").isNotNull() | F.get_json_object(text, "$.title").isNotNull()
    return F.when(named, text)


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def markdown_to_html(c: Column) -> Column:
    """Headings and **bold** to <b>, `code` to <code>, list marks to bullets; everything else escaped."""
    out = escape_html(c)
    for pattern, to in ((r"(?m)^#{1,6}\s+(.+)$", "<b>$1</b>"), (r"\*\*(.+?)\*\*", "<b>$1</b>"), (r"`([^`\n]+)`", "<code>$1</code>"), (r"(?m)^\s*[-*]\s+", "• ")):
        out = F.regexp_replace(out, pattern, to)
    return out


def html_to_plain(c: Column) -> Column:
    bare = F.regexp_replace(c, r"<[^>]*>", "")
    return F.replace(F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def url_path(c: Column) -> Column:
    """Percent-encoded path: blanks as %20 and slashes kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def source_paths(c: Column, label: str = "Manba", most: int = 3) -> Column:
    """struct<paths, more>: file paths named on lines "label: a.md, b.md", the first few and how many more."""
    lines = F.regexp_extract_all(c, F.lit(rf"(?m)^\s*{label}:\s*(.+)$"), 1)
    paths = F.array_distinct(F.filter(F.transform(F.split(F.array_join(lines, ","), ","), strip), lambda p: p.rlike(r"\.[A-Za-z0-9]+$")))
    return F.struct(F.slice(paths, 1, most).alias("paths"), F.greatest(F.size(paths) - most, F.lit(0)).alias("more"))


def redact_tokens(c: Column, token: str | None = None) -> Column:
    out = F.regexp_replace(c, r"(https?://)[^/@\s]+@", "$1***@")
    return F.replace(out, F.lit(token), F.lit("***")) if token else out


def speech_summary(c: Column, most: int = 500) -> Column:
    """Without fenced code and Markdown marks; cut at the last sentence end (a mark and a blank) in the second half, else at `most`."""
    bare = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?(?:```|\z)", " "), r"[*_`#>|]", ""), r"\s+", " "))
    head = F.substring(bare, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.char_length(bare) <= most, bare).when(F.char_length(cut) > most // 2, cut).otherwise(head)


def row_text(header: Column, row: Column, cell: int = 60, most: int = 260) -> Column:
    """h=v; h=v of the cells that aren't blank, each and the whole cut with an ellipsis."""
    pairs = F.zip_with(header, row, lambda h, v: F.when(~blank(v), F.concat(F.coalesce(h, F.lit("")), F.lit("="), clip(strip(v), cell))))
    return clip(F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "; "), most)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def text_of_html(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.out)


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text of a page, a line a text node, without scripts and styles."""
    return s.map(text_of_html)


def rtf_text(c: Column) -> Column:
    """RTF by rule: paragraphs and lines broken, \\'hh escapes and control words out, braces out."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\\'[0-9a-fA-F]{2}", ""), r"\\(?:par|line)(?![a-zA-Z])-?[0-9]* ?", "\n")
    bare = F.regexp_replace(lines, r"\\[a-zA-Z]+-?[0-9]* ?", "")
    return strip(F.translate(bare, "{}", ""))


def _bare(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.ArrayType(T.StringType()))
def fts_tokens(s: pd.Series) -> pd.Series:
    """Letters and digits only, lower case, without diacritics."""
    import re

    word = re.compile(r"[^\W_]+")
    return s.map(lambda x: word.findall(_bare(x)) if x else [])


@F.pandas_udf(T.StringType())
def without_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _bare(x) if x else x)
