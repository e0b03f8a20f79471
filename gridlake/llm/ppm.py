"""Language identification by prediction by partial matching.

Per language, a byte context tree of orders 0 to 3 counts which byte followed which context in the
training texts. With the statistics frozen, a text's code length under a language is exact: in the
longest context that was seen, a byte seen there costs -log2(count / (total + distinct)), another costs
the escape -log2(distinct / (total + distinct)) and then its price one order lower, down to a uniform
order -1. The language with the shortest code is predicted.

The price of a byte depends on it and the three bytes before it alone. Bytes are folded (letters A-Z,
digits, white space) and each folded byte is a symbol of its own. Held are the grams and contexts that
occur, by order, as sorted numbers with their prices and escapes; a gram that never occurred pays the
escape of its context, if that occurred, and is looked for one order lower. So the tables grow with the
distinct 4-grams of the training texts, and working memory by pieces of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import discard, slices, small_batches, text_bytes, tidy, written

UNKNOWN = "und"
#: Prices looked up at once, over all languages; it bounds the working memory.
STEP = 1 << 20
#: Prices that the tables of all languages may hold together (4 bytes each); what is broadcast stays below a GB.
MOST_PRICES = 100_000_000

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[ord("0") : ord("9") + 1] = ord("0")
FOLD[[*range(9, 14)]] = ord(" ")
_KINDS, SYMBOL = np.unique(FOLD, return_inverse=True)
SYMBOLS, SYMBOL = len(_KINDS), SYMBOL.astype(np.uint8)
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


@dataclass(frozen=True)
class Model:
    """languages in ascending order; symbol of each byte; by order: sorted grams with a row of prices in
    bits each, and sorted contexts with a row of escapes each, 0 where the language never had the context."""

    languages: tuple[str, ...]
    symbol: np.ndarray
    n_symbols: int
    grams: tuple[np.ndarray, ...]
    prices: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]


def contexts(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray, k: int) -> np.ndarray:
    """The 4-gram number of each byte; before a text stand three blanks."""
    blank = int(symbol[ord(" ")])
    code = symbol[data].astype(np.uint32)
    out = code.copy()
    starts = offsets[:-1][np.diff(offsets) > 0]
    scale = 1
    for back in (1, 2, 3):
        scale *= k
        before = np.empty_like(code)
        before[back:] = code[:-back] if len(code) > back else code[:0]
        before[:back] = blank
        for skip in range(back):  # bytes of a text nearer to its start than back
            at = starts + skip
            before[at[at < len(code)]] = blank
        # a text shorter than back has handed its blank on to the next one's start, which is blank too
        out += before * scale
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray, k: int, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, offsets of its texts in the piece, 4-gram numbers, bytes) for runs of texts of about step bytes.

    A longer text comes in pieces counted from its own start, so nothing depends on the texts beside it.
    """
    for a, b in slices(np.diff(offsets), step):
        lo, hi = int(offsets[a]), int(offsets[b])
        for at in range(lo, hi, step):
            end, back = min(at + step, hi), max(lo, at - 3)
            gram = contexts(data[back:end], np.clip(offsets[a : b + 1], back, end) - back, symbol, k)[at - back :]
            yield a, np.clip(offsets[a : b + 1], at, end) - at, gram, data[at:end]


def train(docs: DataFrame, is_training: Column, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Count the trees over all training rows with a text and a language.

    Counting is a partial count in each task and one aggregation; the driver gets a row for each 4-gram
    that occurs in a language. Their number is looked at first: a ValueError tells where grams times languages
    are more than MOST_PRICES, so no table of unknown size is collected or broadcast.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(is_training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return key, np.bincount(back, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for name in sorted(set(names.tolist())):
                parts = held.setdefault(name, [(np.zeros(1, np.uint32), np.zeros(1, np.int64))])  # names it even without a byte
                data, offsets = text_bytes(batch.column(1).filter(pa.array(names == name)))
                for _, _, gram, _ in pieces(data, offsets, SYMBOL, SYMBOLS, STEP):
                    parts.append(np.unique(gram, return_counts=True))
                    if len(parts) >= 8:
                        parts[:] = [folded(parts)]
        for name, parts in held.items():
            key, count = folded(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(count)], names=["lang", "gram", "n"])

    counted = written(rows.mapInArrow(tidy(grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    size = counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("languages"), F.sum("n").alias("grams")).first()
    if (size.grams or 0) * size.languages > MOST_PRICES:
        discard(counted)
        raise ValueError(f"{size.grams} grams of {size.languages} languages are more than {MOST_PRICES} prices; train on fewer texts or languages at a time")
    found = counted.toArrow()
    discard(counted)
    names = found.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    known = names.dictionary.to_pylist()
    languages = tuple(sorted(known))
    place = np.array([languages.index(x) for x in known], np.int64)
    lang = place[np.asarray(names.indices)] if len(known) else np.zeros(0, np.int64)
    gram, count = (np.asarray(found.column(c)) for c in ("gram", "n"))
    tables = price_tables(lang[count > 0], gram[count > 0], count[count > 0], len(languages), SYMBOLS)
    bits = lambda x: tuple(t.astype(np.float32) for t in x)
    return Model(languages, SYMBOL, SYMBOLS, tables[0], bits(tables[1]), tables[2], bits(tables[3]))


def price_tables(lang: np.ndarray, gram: np.ndarray, count: np.ndarray, n_languages: int, k: int) -> tuple[tuple[np.ndarray, ...], ...]:
    """Grams, prices, contexts and escapes of Model from counts of 4-grams (escape method C)."""
    out: list[tuple[np.ndarray, ...]] = []
    lower_keys, lower_prices = np.zeros(1, np.int64), np.full((1, n_languages), np.log2(k))
    for order in range(4):
        keys, at = np.unique(gram % k ** (order + 1), return_inverse=True)
        above, under = np.unique(keys // k, return_inverse=True)
        prices, escapes = np.empty((len(keys), n_languages)), np.empty((len(above), n_languages))
        lower = np.searchsorted(lower_keys, keys % k**order)
        for i in range(n_languages):
            seen = np.bincount(at[lang == i], count[lang == i], len(keys))
            total, distinct = np.bincount(under, seen, len(above)), np.bincount(under, seen > 0, len(above))
            with np.errstate(divide="ignore", invalid="ignore"):
                escapes[:, i] = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
                prices[:, i] = np.where(seen > 0, -np.log2(seen / (total + distinct)[under]), escapes[under, i] + lower_prices[lower, i])
        out.append((keys.astype(np.uint32), prices, above.astype(np.uint32), escapes))
        lower_keys, lower_prices = keys, prices
    return tuple(zip(*out, strict=True))


def look_up(model: Model, gram: np.ndarray) -> np.ndarray:
    """A row of prices, one a language, for each 4-gram number, seen or not."""
    out = np.zeros((len(gram), len(model.languages)), model.prices[0].dtype)
    left, key = np.arange(len(gram)), gram
    for order in (3, 2, 1, 0):
        key = key % np.uint32(model.n_symbols ** (order + 1)) if order < 3 else key
        at, hit = _find(model.grams[order], key)
        out[left[hit]] += model.prices[order][at[hit]]
        left, key = left[~hit], key[~hit]
        if not len(left):
            return out
        at, hit = _find(model.contexts[order], key // np.uint32(model.n_symbols))
        out[left[hit]] += model.escapes[order][at[hit]]
    out[left] += np.log2(model.n_symbols)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(counts: np.ndarray, k: int) -> np.ndarray:
    """Price in bits of each 4-gram's last symbol, from counts of all 4-grams of a small alphabet."""
    gram = np.flatnonzero(counts)
    model = Model(("",), np.zeros(256, np.uint8), k, *price_tables(np.zeros(len(gram), np.int64), gram, counts[gram], 1, k))
    return look_up(model, np.arange(k**4, dtype=np.uint32))[:, 0]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add lang_pred and score, or what pred_col and score_col name, to the columns keep (default: the id).

    score: the posterior of the prediction with equal priors, 1 / sum of 2 ** (shortest - each code).
    und with score 0 where the text is null or has no letter, or where nothing was learned. Equal code
    lengths: the first language in order. Repeated rows repeat; no rows give no rows. No shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    keep = keep or [id_col]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            best, score = classify(held.value, column)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def classify(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = text_bytes(column)
    n, names = len(offsets) - 1, np.array([*model.languages, UNKNOWN], object)
    if not len(model.languages):
        return [UNKNOWN] * n, np.zeros(n)
    bits = np.zeros((n, len(model.languages)))
    letters = np.zeros(n, bool)
    for a, places, gram, part in pieces(data, offsets, model.symbol, model.n_symbols, max(4096, STEP // len(model.languages))):
        full = np.flatnonzero(np.diff(places) > 0)
        at = places[full]
        bits[a + full] += np.add.reduceat(look_up(model, gram), at, axis=0, dtype=np.float64)
        letters[a + full] |= np.logical_or.reduceat(ASCII_LETTER[part], at)
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
        letters[i] = any(c.isalpha() for c in column[i].as_py() or "")
    best = bits.argmin(1)
    gap = np.minimum(bits - bits[np.arange(n), best][:, None], 1000)
    score = np.where(letters, 1 / np.exp2(-gap).sum(1), 0.0)
    return names[np.where(letters, best, len(model.languages))].tolist(), score
