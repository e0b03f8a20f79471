"""Quality rules as a short-circuit cascade.

Each rule needs one measure of a text. On a sample the cost of each measure and the share of texts that
each rule rejects are estimated; the cascade then runs the rules by rejection per cost, and a rule sees
only the texts that all rules before it kept. The order changes what is measured, never what is kept.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import slices, small_batches, sums, text_bytes, tidy
from gridlake.llm.scan import SPACE, exact_codes, exact_grams, paired, words

SLICE = 1 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = ~SPACE & (np.arange(256) < 128)
MARK[[b for b in range(128) if chr(b).isalnum()]] = False
#: Measures that make the contract's columns; with audit they are made for every text.
COUNTED = ("words", "symbols", "lines", "repeats")


class Texts:
    """Measures of some texts, each made when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.data, self.offsets = text_bytes(column)
        self.made: dict[str, dict[str, np.ndarray]] = {}
        self._words = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, measure: str) -> dict[str, np.ndarray]:
        if measure not in self.made:
            self.made[measure] = getattr(self, f"_{measure}_")()
        return self.made[measure]

    def words(self):
        if self._words is None:
            self._words = words(self.data, self.offsets)
        return self._words

    def _words_(self) -> dict[str, np.ndarray]:
        in_words = ~SPACE[self.data] & ((self.data & 0xC0) != 0x80)  # first bytes of code points
        return {"n_words": np.diff(self.words()[2]), "word_chars": sums(in_words, self.offsets)}

    def _symbols_(self) -> dict[str, np.ndarray]:
        return {"n_symbols": sums(SYMBOL[self.data], self.offsets)}

    def _lines_(self) -> dict[str, np.ndarray]:
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        cut = np.sort(np.concatenate([self.offsets[1:], breaks]))
        text = np.searchsorted(self.offsets[1:], starts, "right")
        # a text that ends in \n starts its empty last line where the next text starts
        filled = np.concatenate([[0], np.cumsum(~SPACE[self.data])])
        keep = (starts < cut) & (filled[cut] > filled[np.minimum(starts, len(self.data))])
        starts, cut, text = starts[keep], cut[keep], text[keep]
        codes, own = exact_codes(self.data, starts, cut)
        first = np.zeros(len(codes), bool)
        first[np.unique(paired(text, len(self), codes, len(own))[0], return_index=True)[1]] = True
        n = len(self)
        lines = np.bincount(text, minlength=n)
        return {"n_lines": lines, "n_dup_lines": lines - np.bincount(text[first], minlength=n)}

    def _repeats_(self) -> dict[str, np.ndarray]:
        starts, ends, places = self.words()
        codes, own = exact_codes(self.data, starts, ends)
        grams, bound, place, text = exact_grams(codes, len(own), places, 3)
        same, found = pd.factorize(paired(grams, bound, text, len(self))[0])
        at = place[np.bincount(same, minlength=len(found))[same] > 1]
        covered = np.zeros(len(starts) + 3, bool)
        for k in range(3):
            covered[at + k] = True
        return {"n_repeat_words": sums(covered[: len(starts)], places)}

    def _packed_(self) -> dict[str, np.ndarray]:
        """Bytes of each text, and of it when compressed: the dearest measure."""
        cut, raw = self.offsets.tolist(), memoryview(np.ascontiguousarray(self.data))
        return {"n_bytes": np.diff(self.offsets), "n_packed": np.array([len(zlib.compress(raw[a:b], 1)) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)}

    def _marks_(self) -> dict[str, np.ndarray]:
        """Bytes that are ASCII and no letter, digit or space."""
        return {"n_marks": sums(MARK[self.data], self.offsets), "n_bytes": np.diff(self.offsets)}


@dataclass(frozen=True)
class Rule:
    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


#: Base rules of the contract first. The others leave a wide margin to ordinary prose.
BASE = (
    Rule("few_words", ("words",), lambda m: m["n_words"] < 50),
    Rule("repeated_words", ("words", "repeats"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
RULES = (
    *BASE,
    Rule("symbols", ("words", "symbols"), lambda m: 100 * m["n_symbols"] > 25 * m["n_words"]),
    Rule("repeated_lines", ("lines",), lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("marks", ("marks",), lambda m: 100 * m["n_marks"] > 40 * m["n_bytes"]),
    Rule("regular", ("packed",), lambda m: (m["n_bytes"] >= 500) & (100 * m["n_packed"] < 6 * m["n_bytes"])),
    Rule("word_length", ("words",), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
)


def _measured(texts: Texts, rule: Rule) -> np.ndarray:
    found: dict[str, np.ndarray] = {}
    for m in rule.measures:
        found |= texts.of(m)
    return rule.rejects(found)


def estimate_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, text_col: str = "text") -> list[str]:
    """Names of the rules by rejected texts per second, best first, from about sample_rows texts.

    Ties and rules that rejected nothing keep the given order, the cheaper first. An empty table gives
    the given order.
    """
    small_batches(docs.sparkSession)
    rows = docs.count()
    part = docs.select(text_col)
    if rows > sample_rows:
        part = part.sample(sample_rows / rows, 17)
    named = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seen, spent, gone = [], [], []
            for rule in named:
                texts, began = Texts(batch.column(0).fill_null("")), time.perf_counter()
                gone.append(int(_measured(texts, rule).sum()))
                spent.append(time.perf_counter() - began)
                seen.append(rule.name)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(gone, pa.int64()), pa.array(spent)], names=["rule", "gone", "spent"])

    found = {r["rule"]: r for r in part.mapInArrow(tidy(run), "rule string, gone long, spent double").groupBy("rule").agg(F.sum("gone").alias("gone"), F.sum("spent").alias("spent")).collect()}
    if not found:
        return [r.name for r in named]
    worth = {r.name: (-found[r.name]["gone"] / max(found[r.name]["spent"], 1e-9), found[r.name]["spent"]) for r in named}
    return sorted(worth, key=lambda name: worth[name])


def cascade(docs: DataFrame, order: list[str] | None = None, rules: tuple[Rule, ...] = RULES, audit: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict of the cascade for each document, in the order given or estimated.

    Columns: id, kept, failed_rule (the first that rejected, null if kept). With audit the measures of
    the contract are also made for every document and returned, with base_failed; those of other rules, and
    without audit all, are made only for texts that no rule before rejected. A null text has no words, so few_words rejects it. Repeated rows repeat; other columns are not
    read; no rows give no rows. No shuffle.
    """
    small_batches(docs.sparkSession)
    by_name = {r.name: r for r in rules}
    chain = [by_name[n] for n in (order or estimate_order(docs, rules, text_col=text_col))]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if audit else []
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in counts), *([T.StructField("base_failed", T.BooleanType())] * audit), T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1).fill_null("")
            for a, b in slices(np.array(pa.compute.binary_length(column), np.int64), SLICE):
                texts = all_texts = Texts(column[a:b])
                alive, failed = np.arange(b - a), np.full(b - a, None, object)
                for rule in chain:
                    if not len(alive):
                        break
                    if audit and set(rule.measures) <= set(COUNTED):
                        gone = _measured(all_texts, rule)[alive]
                    else:
                        if len(texts) > len(alive):
                            texts = Texts(column[a:b].take(pa.array(alive)))
                        gone = _measured(texts, rule)
                    failed[alive[gone]] = rule.name
                    alive = alive[~gone]
                more = []
                if audit:
                    found = {k: v for m in COUNTED for k, v in all_texts.of(m).items()}
                    base = np.zeros(b - a, bool)
                    for rule in BASE:
                        base |= rule.rejects(found)
                    more = [*(pa.array(found[c].astype(np.int64)) for c in counts), pa.array(base)]
                yield pa.RecordBatch.from_arrays([ids[a:b], *more, pa.array(failed == None), pa.array(failed, pa.string())], names=schema.names)  # noqa: E711

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of docs that the cascade keeps, with all their columns and no shuffle."""
    small_batches(docs.sparkSession)
    by_name = {r.name: r for r in RULES}
    chain = [by_name[n] for n in (order or estimate_order(docs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").fill_null("")
            for a, b in slices(np.array(pa.compute.binary_length(column), np.int64), SLICE):
                alive = np.arange(a, b)
                for rule in chain:
                    if len(alive):
                        alive = alive[~_measured(Texts(column.take(pa.array(alive))), rule)]
                yield batch.take(pa.array(alive, pa.int64()))

    return docs.mapInArrow(tidy(run), docs.schema)
