"""Token counts by the whole-token shortcut.

prove_whole_tokens() finds, once and on the driver, which strings of the vocabulary encode alone as
exactly one token. The workers count pre-tokens found in that table directly; only the remaining
pre-tokens are merged, and each distinct one once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gridlake.llm.common import slices, small_batches, tidy
from gridlake.llm.wordpieces import Encoder, Splitter

#: Distinct merged pre-tokens a worker remembers; beyond it the memory is emptied.
MEMO = 500_000
SLICE = 1 << 20
SUFFIX = "</w>"


def prove_whole_tokens(path: str) -> dict[str, int]:
    """Strings that stand alone as one pre-token and encode as one token, with the id of that token.

    Proof by encoding: each vocabulary string with the word end goes through the whole tokenizer, and
    only those that give a single pre-token, unchanged, and a single id are kept. The table is never
    larger than the vocabulary.
    """
    splitter = Splitter(path)
    decode = _bytes_of_symbols()
    found: dict[str, int] = {}
    for symbols in splitter.tokenizer.get_vocab(with_added_tokens=False):
        if not symbols.endswith(SUFFIX):
            continue
        try:
            word = bytes(decode[c] for c in symbols[: -len(SUFFIX)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word and splitter.split(word) == [word]:
            found[word] = -1
    texts = list(found)
    for word, encoding in zip(texts, splitter.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        if len(encoding.ids) == 1:
            found[word] = encoding.ids[0]
        else:
            del found[word]
    return found


def _bytes_of_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def word_encoder(path: str, whole: dict[str, int]) -> Encoder:
    """Ids by the table of proven strings; the library's model merges the rest."""
    splitter = Splitter(path)
    symbol = {b: c for c, b in _bytes_of_symbols().items()}
    names = {b: symbol[b] for b in range(256)}
    model = splitter.tokenizer.model

    def merge(rest: list[bytes]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(w.decode("latin-1").translate(names))] for w in rest]

    return Encoder(splitter, merge, whole, MEMO)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text is an empty one (0 bytes, 0 tokens). Repeated rows give repeated rows; other columns
    are not read. An empty table gives an empty result. No shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = spark.sparkContext.broadcast(prove_whole_tokens(path))
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or word_encoder(path, whole.value)
            ids, column = batch.column(0), batch.column(1).fill_null("")
            sizes = np.array(pa.compute.binary_length(column), np.int64)
            counts = np.zeros(len(sizes), np.int64)
            for a, b in slices(sizes, SLICE):
                counts[a:b] = encoder.counts(column[a:b].to_pylist())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def reference_count(path: str, text: str | None) -> int:
    """The library's own count, for tests."""
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)
