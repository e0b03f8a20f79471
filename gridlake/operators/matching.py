"""Which of many words a text contains, anywhere in it: one pass a text over a trie with failure links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of all words together up to which they are one automaton, built once a task; more are joined instead.
MOST_CHARACTERS = 4_000_000


class Automaton:
    """A trie of words; a failure link leads to the longest proper suffix that is in the trie, too."""

    def __init__(self, words: list[str]):
        self.words = words
        self.step: dict[int, int] = {}  # node and character to node
        self.ends = [-1]  # the word that ends in a node
        below: list[tuple[int, int, int]] = []  # depth, parent, character of the nodes from 1 on
        for i, word in enumerate(words):
            node = 0
            for depth, c in enumerate(map(ord, word)):
                key = node << 21 | c
                if key not in self.step:
                    self.step[key] = len(self.ends)
                    self.ends.append(-1)
                    below.append((depth, node, c))
                node = self.step[key]
            if node:
                self.ends[node] = i
        self.fail = [0] * len(self.ends)
        self.shorter = [0] * len(self.ends)  # the nearest node on the chain of failures where a word ends
        for node in sorted(range(1, len(self.ends)), key=lambda n: below[n - 1][0]):
            _, parent, c = below[node - 1]
            fail = self._next(self.fail[parent], c) if parent else 0
            self.fail[node] = fail
            self.shorter[node] = fail if self.ends[fail] >= 0 else self.shorter[fail]

    def _next(self, node: int, c: int) -> int:
        while (there := self.step.get(node << 21 | c)) is None and node:
            node = self.fail[node]
        return there or 0

    def found(self, text: str) -> list[str]:
        """The distinct words in text, by the place where they first end, longer ones first."""
        out: dict[int, None] = {}
        node = 0
        for c in map(ord, text):
            node = self._next(node, c)
            at = node
            while at and (self.ends[at] < 0 or self.ends[at] not in out):
                if self.ends[at] >= 0:
                    out[self.ends[at]] = None
                at = self.shorter[at]
        return [self.words[i] for i in out]


#: Tokens, and their longest length, whose words a task remembers.
TOLD_TOKENS, TOLD_LENGTH = 100_000, 64


class Searcher:
    """The words in texts. Words without a blank lie within a token, so each distinct token is searched once for them."""

    def __init__(self, words: list[str]):
        spaced = [w for w in words if " " in w]
        self.whole = Automaton(spaced) if spaced else None
        self.parts = Automaton([w for w in words if " " not in w])
        self.told: dict[str, list[str]] = {}

    def found(self, text: str) -> list[str]:
        """The distinct words in text, in any order."""
        out = dict.fromkeys(self.whole.found(text) if self.whole else [])
        for token in dict.fromkeys(text.split(" ")):
            known = self.told.get(token)
            if known is None:
                known = self.parts.found(token)
                if len(token) <= TOLD_LENGTH:
                    if len(self.told) >= TOLD_TOKENS:
                        self.told.clear()
                    self.told[token] = known
            out.update(dict.fromkeys(known))
        return list(out)


def contained_words(texts: DataFrame, words: DataFrame, text: str = "q", word: str = "word") -> DataFrame:
    """texts, once for each distinct word that occurs in text, with the word; null texts and words, and empty words, match nothing.

    The words' total length is checked: up to MOST_CHARACTERS they are broadcast as an automaton. Beyond that
    the pieces of each text, of the lengths that words have, are joined with the words.
    """
    listed = words.where(F.char_length(word) > 0).select(F.col(word).alias("__word")).distinct()
    sizes = listed.agg(F.sum(F.char_length("__word")).alias("all"), F.array_sort(F.collect_set(F.char_length("__word"))).alias("lengths")).first()
    if (sizes["all"] or 0) > MOST_CHARACTERS:
        pieces = lambda n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n))))
        every = F.array_distinct(F.flatten(F.array_compact(F.array(*map(pieces, sizes["lengths"])))))
        return texts.withColumn("__word", F.explode(every)).join(listed, "__word").withColumnRenamed("__word", word)
    shared = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in listed.collect()))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Searcher(shared.value)
        for batch in batches:
            yield batch.map(lambda t: known.found(t) if t else [])

    return texts.withColumn(word, F.explode(found(F.col(text))))
