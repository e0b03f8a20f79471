"""Chat formatting by schema fingerprints.

A record is JSON in any of several layouts. Its fingerprint is the hash of its nested field paths (list
items share one path). A registry maps fingerprints, or sets of paths that a layout needs, to declarative
mappings, which say where turns, roles and texts are. The canonical turns then go through one template.

Template: each turn is <|im_start|>role<|im_sep|>text<|im_end|>. Control strings inside roles and texts
get a backslash after their first character, and a backslash a second one, so reading back is exact.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import small_batches, tidy

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates in use give a meaning to.
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


#: Levels of a record; one that is nested deeper is no chat. So deep a record is also safe to walk.
MOST_LEVELS = 100
#: Fingerprints that a task keeps at a time.
MOST_KNOWN = 10_000
#: A key of a prefix with its dot, and a whole prefix: keys of objects, no lists.
_PART = re.compile(r"((?:\\.|[^.\\])+)\.", re.S)
_PREFIX = re.compile(r"(?:(?:\\.|[^.\\\[\]])+\.)*", re.S)


def _part(key: str) -> str:
    """A key as part of a path: marks of its own are escaped, so unlike layouts have unlike paths."""
    return re.sub(r"([.\[\]\\\n])", r"\\\1", key)


def field_paths(value: object) -> set[str] | None:
    """Paths of all fields; items of a list are at path[]. An empty list still shows its path. None beyond MOST_LEVELS."""
    out: set[str] = set()
    left = [(value, "", 0)]
    while left:
        item, at, level = left.pop()
        if level > MOST_LEVELS:
            return None
        if isinstance(item, dict) and item:
            left += [(v, f"{at}.{_part(k)}" if at else _part(k), level + 1) for k, v in item.items()]
        elif isinstance(item, list) and item:
            left += [(v, f"{at}[]", level + 1) for v in item]
        else:
            out.add(f"{at}[]" if isinstance(item, list) else at)
    return out


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout holds its turns.

    turns: the list's path, with role and text fields of its items; roles renames them where a layout has
    names of its own. Or parts: (path, role) of single fields, of which needs must be there; parts of one
    role in a row are joined by a blank line, absent and empty ones left out.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    needs: frozenset[str] = frozenset()
    parts: tuple[tuple[str, str], ...] = ()


#: Roles as the from/value layout names them.
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

MAPPINGS = (
    Mapping("turns", "turns", "role", "text"),
    Mapping("messages", "messages", "role", "content"),
    Mapping("from_value", "conversations", "from", "value", SPEAKERS),
    Mapping("instruction", needs=frozenset({"instruction", "output"}), parts=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("prompt_completion", needs=frozenset({"prompt", "completion"}), parts=(("system", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt_response", needs=frozenset({"prompt", "response"}), parts=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("question_answer", needs=frozenset({"question", "answer"}), parts=(("context", "user"), ("question", "user"), ("answer", "assistant"))),
)


def place_of(mapping: Mapping, paths: set[str]) -> str | None:
    """The prefix below which paths hold the layout: "" or like "data.", the shortest one; None without."""
    if mapping.turns:
        role = f"{mapping.turns}[].{mapping.role}"
        starts = {p[: -len(role)] for p in paths if p.endswith(role)}
        text = f"{mapping.turns}[].{mapping.text}"
        found = [s for s in starts if any(p == s + text or p.startswith((f"{s}{text}[]", f"{s}{text}.")) for p in paths)]
        found += [p[: -len(f"{mapping.turns}[]")] for p in paths if p.endswith(f"{mapping.turns}[]")]  # no turns at all
    else:
        heads = {p.split("[]")[0] for p in paths}  # a field may hold a list or an object
        heads |= {h[:i] for h in heads for i, c in enumerate(h) if c == "."}
        first = min(mapping.needs)
        found = [p[: -len(first)] for p in heads if p.endswith(first)]
        found = [s for s in found if all(s + n in heads for n in mapping.needs)]
    found = [s for s in found if _PREFIX.fullmatch(s)]
    return min(found, key=lambda s: (len(s), s), default=None)


def _hollow(mapping: Mapping, prefix: str, paths: set[str]) -> bool:
    """Whether the layout's list of turns is empty."""
    return bool(mapping.turns) and f"{prefix}{mapping.turns}[].{mapping.role}" not in paths


class Registry:
    """Mapping and prefix of each fingerprint: looked up, or found by the paths that a layout needs.

    A layout with turns goes before one whose list is empty, then the one with the shorter prefix. Where keys
    are data, fingerprints are many; so only so many are kept.
    """

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings, self.known = mappings, {}

    def select(self, record: object) -> tuple[str | None, tuple[Mapping, str] | None]:
        paths = field_paths(record)
        if paths is None:
            return None, None
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            places = [(m, place_of(m, paths)) for m in self.mappings]
            self.known[key] = min(((m, p) for m, p in places if p is not None), key=lambda x: (_hollow(*x, paths), len(x[1])), default=None)
        return key, self.known[key]


def plain_text(value: object) -> str:
    """A string as it is, null as empty, a list as its items' texts by line, an object's text field, other values as JSON.

    A lone surrogate, which no UTF-8 text can hold, becomes U+FFFD.
    """
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n".join(map(plain_text, value))
    if isinstance(value, dict):
        return plain_text(value["text"]) if "text" in value else json.dumps(value, sort_keys=True)
    text = value if isinstance(value, str) else json.dumps(value)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def canonical_turns(record: dict, mapping: Mapping, prefix: str = "") -> list[tuple[str, str]] | None:
    """(role, text) in order, None where a turn is no object. Roles and texts are as plain_text makes them."""
    for key in _PART.findall(prefix):
        key = re.sub(r"\\(.)", r"\1", key, flags=re.S)
        record = record.get(key) if isinstance(record, dict) else None  # a list of objects holds no one layout
    if not isinstance(record, dict):
        return None
    if mapping.turns:
        found, roles = record.get(mapping.turns) or [], dict(mapping.roles)
        if not isinstance(found, list) or not all(isinstance(t, dict) for t in found):
            return None
        named = [(plain_text(t.get(mapping.role)), plain_text(t.get(mapping.text))) for t in found]
        return [(roles.get(r, r), t) for r, t in named]
    out: list[tuple[str, str]] = []
    for path, role in mapping.parts:
        text = plain_text(record.get(path))
        if text and out and out[-1][0] == role:
            out[-1] = (role, f"{out[-1][1]}\n\n{text}")
        elif text:
            out.append((role, text))
    return out


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the loss mask: code point spans of the assistant texts in it."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns from a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """Format JSON records: id, fingerprint, layout, formatted, mask array<struct<from,to>>.

    A layout may lie below other objects (data.messages). A record that is null, no JSON object, nested
    deeper than MOST_LEVELS, in no known layout or with a turn that is no object has layout and formatted null and an empty mask. Repeated rows repeat; no rows give no rows; other columns are not read.
    """
    small_batches(records.sparkSession)
    schema = f"{id_col} {records.schema[id_col].dataType.simpleString()}, fingerprint string, layout string, formatted string, mask array<struct<from:int,to:int>>"
    span = pa.struct([("from", pa.int32()), ("to", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry()
        for batch in batches:
            keys, layouts, texts, masks = [], [], [], []
            for raw in batch.column(1).to_pylist():
                try:
                    record = json.loads(raw) if raw else None
                except (ValueError, RecursionError):
                    record = None
                key, found = registry.select(record) if isinstance(record, dict) else (None, None)
                turns = canonical_turns(record, *found) if found else None
                text, mask = render(turns) if turns is not None else (None, [])
                keys.append(key)
                layouts.append(found[0].name if turns is not None else None)
                texts.append(text)
                masks.append([{"from": a, "to": b} for a, b in mask])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(span))], names=[id_col, "fingerprint", "layout", "formatted", "mask"])

    return records.select(id_col, record_col).mapInArrow(tidy(run), schema)


def records_from_rows(rows: DataFrame) -> DataFrame:
    """conversations (a row a turn) as JSON records, in layouts that a hash of conv_id picks.

    Layouts: turns; data.messages with lists of parts as content; conversations of from and value, where all
    roles are plain ones. Turns are in order of turn (nulls first), role, text; null texts are empty. A
    conversation is one record, so its rows meet in one task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    each = lambda f: F.transform("__turns", f)
    turns = F.struct(each(lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    parts = each(lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content")))
    spoken = each(lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value")))
    plain = F.forall("__turns", lambda t: t["role"].isin("user", "assistant", "system"))
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    record = F.when(pick == 1, F.to_json(F.struct(F.struct(parts.alias("messages")).alias("data")))).when((pick == 2) & plain, F.to_json(F.struct(spoken.alias("conversations")))).otherwise(F.to_json(turns))
    return whole.select("conv_id", record.alias("record"))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a reader of the formatted texts gets: turns and text under the mask, as digests."""
    schema = f"{id_col} {formatted.schema[id_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text or "")
                loss = "".join(unescape(text[m["from"] : m["to"]]) for m in mask)
                joined = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text or "")))
            n, turns_sha, chars, loss_sha, total = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(total, pa.int64()), batch.column(3), batch.column(4)], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout", "fingerprint"])

    return formatted.select(id_col, "formatted", "mask", "layout", "fingerprint").mapInArrow(tidy(run), schema)
