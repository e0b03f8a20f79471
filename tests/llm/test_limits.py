"""Deep records, wide sequences, many ranges, re-ordered rows and texts without white space."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import chat, components, ngramjoin, ordermin, ppm
from gridlake.llm.common import written
from gridlake.llm.packing import Bins, place_pieces, plan
from tests.llm.test_corpus_ops import brute_components, near_copies, rows_of


def nested(levels, inner='"x"'):
    return '{"a": ' * levels + inner + "}" * levels


def test_deep_records_are_no_chats(spark):
    turns = [{"role": "user", "text": "hi"}]
    deep_content = json.dumps({"turns": [{"role": "user", "text": "@"}]}).replace('"@"', "[" * 600 + '"t"' + "]" * 600)
    records = [nested(1200), nested(100_000), deep_content, "[" * 100_000, json.dumps({"turns": turns}), json.dumps({"x": {"turns": turns}}), nested(50)]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string").repartition(2)
    got = {r.conv_id: r for r in chat.format_records(df).collect()}
    assert len(got) == len(records)
    assert {i: r.layout for i, r in got.items()} == {0: None, 1: None, 2: None, 3: None, 4: "turns", 5: "turns", 6: None}
    assert got[0].fingerprint is None and got[4].fingerprint and all(got[i].mask == [] for i in (0, 1, 2, 3, 6))


def test_unlike_layouts_have_unlike_fingerprints():
    key = lambda record: chat.fingerprint(chat.field_paths(record))
    records = [{"data.turns": 1}, {"data": {"turns": 1}}, {"a\nb": 1}, {"a": 1, "b": 2}, {"a[]": 1}, {"a": [1]}, {"a": []}, {"a\\": {"b": 1}}, {"a\\.b": 1}, {"a": {"": 1}}, {"a.": 1}]
    keys = [key(r) for r in records]
    assert len(set(keys)) == len(keys) - 1 and keys[5] == keys[6]  # an empty list shows the path of its items
    registry = chat.Registry()
    turns = [{"role": "user", "text": "t"}]
    assert registry.select({"data.turns": turns})[1] is None
    _, (mapping, prefix) = registry.select({"my.data": {"turns": turns}})
    assert chat.canonical_turns({"my.data": {"turns": turns}}, mapping, prefix) == [("user", "t")]
    _, (mapping, prefix) = registry.select({"prompt": "p", "completion": "c", "messages": []})
    assert mapping.name == "prompt_completion"
    assert registry.select({"messages": []})[1][0].name == "messages"


def test_registry_keeps_a_bounded_number(monkeypatch):
    monkeypatch.setattr(chat, "MOST_KNOWN", 5)
    registry = chat.Registry()
    for i in range(40):
        registry.select({f"k{i}": 1})
        assert len(registry.known) <= 5


@pytest.mark.parametrize("tokens", [1 << 19, 1 << 20, (1 << 31) - 1])
def test_wide_sequences(spark, tokens):
    rng = random.Random(tokens)
    lengths = [rng.randint(1, min(tokens, 1 << 24)) for _ in range(60)] + [tokens // 2] * 5 + [1, 1, 1, tokens]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = place_pieces(df, Bins(tokens), ["doc_id"]).collect()
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.doc_id for r in got) == list(range(len(lengths)))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= tokens
    assert len(held) == max(r.sequence + (r.last_rank - r.first_rank) // r.each + 1 for r in plan({n: lengths.count(n) for n in lengths}, Bins(tokens)))
    with pytest.raises(ValueError):
        Bins(1 << 31).limits()


def test_ranges_are_as_many_as_asked_for():
    grams = np.random.default_rng(0).integers(0, 2**64, 400_000, dtype=np.uint64)
    for ranges in (8, 200_000, 1_000_000):
        found = ngramjoin.range_of(grams, ranges)
        assert found.min() >= 0 and found.max() < ranges
        want = ranges * (1 - np.exp(-len(grams) / ranges))  # ranges met by chance
        assert abs(len(np.unique(found)) - want) < 0.02 * want
        order = np.argsort(grams)
        assert (np.diff(found[order]) >= 0).all()


def test_links_with_a_range_for_each_token(spark, monkeypatch):
    texts = dict(enumerate(near_copies(11, groups=3, most=8)))
    monkeypatch.setattr(ngramjoin, "RANGE_TOKENS", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.link_documents(rows_of(spark, texts.items()), 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_rows_in_another_order_give_the_same_chunks(spark):
    texts = list(enumerate(near_copies(5, groups=4)))
    hot = np.zeros(0, np.uint64)

    def packed(rows):
        one = spark.createDataFrame([(i, t) for i, t in rows if t], "rep long, text string").coalesce(1).sortWithinPartitions("rep", F.xxhash64("text"))
        return sorted((r.range, r.chunk, bytes(r.low), bytes(r.counts)) for r in ngramjoin._packed(one, 4, 50, hot, 3).collect())

    shuffled = texts[:]
    random.Random(1).shuffle(shuffled)
    assert packed(texts) == packed(shuffled)


def test_fingerprints_without_white_space(spark):
    rng = random.Random(2)
    han = [chr(0x4E00 + i) for i in range(2000)]
    rows = [(i, "".join(rng.choices(han, k=2000))) for i in range(4)] + [(9, "ab" * 30), (10, "word " * 5)]
    got = {r.doc_id: r for r in ordermin.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        # a third of the k-mers are in both texts; entries hold two of them
        assert 0.03 < got[i].near_edited < 0.4 and len(got[i].fingerprint) > 100
    assert max(got[i].near_next for i in range(3)) < 0.05
    one = rows[0][1]
    edits = [(0, one), (1, one[:700] + "一丁" + one[700:])]  # two characters more
    near = ordermin.fingerprint_documents(spark.createDataFrame(edits, "doc_id long, text string")).collect()
    assert all(r.near_next > 0.8 for r in near)


def test_tables_of_languages_have_a_stated_size(spark, monkeypatch):
    rows = spark.createDataFrame([("en", "the cat sat on the mat"), ("de", "die katze sitzt auf der matte")], "lang string, text string")
    assert ppm.train(rows, F.lit(True)).languages == ("de", "en")
    monkeypatch.setattr(ppm, "MOST_PRICES", 20)
    with pytest.raises(ValueError, match="2 languages"):
        ppm.train(rows, F.lit(True))


def test_few_edges_are_finished_by_one_task_and_many_by_stars(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1000 + i) for i in range(300)], "a long, b long").repartition(5)
    tables = []
    monkeypatch.setattr(components, "written", lambda df, tag: tables.append(tag) or written(df, tag))
    few, rounds = ({r.node: r.label for r in components.components(edges, at_once=n).collect()} for n in (components.MOST_AT_ONCE, 0))
    assert few == rounds and len(few) > 300
    tables.clear()
    components.components(edges)
    assert tables == ["edges"]
