"""Many questions against many aliases, month groups and titles."""

import random

import pytest
from pyspark.sql import functions as F

from gridlake.functions import text
from gridlake.operators import matching, routing

ASKED = "id int, workbook string, q string, months array<int>, current int, carried array<string>"


def test_automaton_equals_contains():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcé😀", k=rng.randint(1, 7))) for _ in range(800)} | {"a", "ab", "bab"})
    known = matching.Automaton(words)
    for _ in range(100):
        q = "".join(rng.choices("abcé😀 ", k=rng.randint(0, 60)))
        found = known.found(q)
        assert sorted(found) == [w for w in words if w in q] and len(found) == len(set(found))
    assert matching.Automaton([]).found("abc") == [] == matching.Automaton([""]).found("abc")


@pytest.mark.parametrize("most", [matching.MOST_CHARACTERS, 0])
def test_words_in_texts_by_automaton_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MOST_CHARACTERS", most)
    texts = spark.createDataFrame([(0, "undiruv qancha?"), (1, "smm undir"), (2, ""), (3, None), (4, "oʻzbek😀x")], "id int, q string")
    words = spark.createDataFrame([("undir",), ("undiruv",), ("smm",), ("",), (None,), ("m",), ("undir",), ("😀x",), ("a much longer word than any text",)], "word string")
    got = sorted((r.id, r.word) for r in matching.contained_words(texts, words).collect())
    assert got == [(0, "undir"), (0, "undiruv"), (1, "m"), (1, "smm"), (1, "undir"), (4, "😀x")]
    assert matching.contained_words(texts.where("false"), words).count() == 0 == matching.contained_words(texts, words.where("false")).count()


def test_a_hundred_thousand_aliases(spark):
    rng = random.Random(7)
    aliases = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(110_000)})[:100_000]
    questions = ["".join(rng.choices("abcdefghij ", k=80)) for _ in range(40)] + ["?", ""]
    sheets = spark.createDataFrame([(f"s{i % 5000}", a, i % 5000 == 3) for i, a in enumerate(aliases)], "sheet string, token string, is_scorecard boolean")
    asked = spark.createDataFrame(list(enumerate(questions)), "id int, q string")
    got = {(r.id, r.named, r.sheet) for r in routing.match_sheets(asked, sheets, "q", "token").collect()}
    want = set()
    for i, q in enumerate(questions):
        pieces = {q[a : a + n] for n in range(4, 10) for a in range(len(q))}
        hits = {f"s{k % 5000}" for k, a in enumerate(aliases) if a in pieces}
        want |= {(i, True, s) for s in hits} or {(i, False, "s3")}
    assert got == want


def test_questions_without_a_named_sheet(spark):
    sheets = spark.createDataFrame([("a", "aaa", False), ("b", "bbb", None)], "sheet string, token string, is_scorecard boolean")
    asked = spark.createDataFrame([(1, "nothing"), (2, "x bbb"), (3, None)], "id int, q string")
    got = sorted((r.id, r.named, r.sheet) for r in routing.match_sheets(asked, sheets, "q", "token").collect())
    assert got == [(1, False, "a"), (1, False, "b"), (2, True, "b"), (3, False, "a"), (3, False, "b")]


def tabs_of(spark, books):
    rows = [(b, t, i) for b, titles in books.items() for i, t in enumerate(titles)]
    return routing.tab_index(spark.createDataFrame(rows, "workbook string, title string, ord int"))


def answers(spark, books, questions):
    chosen, notes = routing.match_tabs(spark.createDataFrame(questions, ASKED), tabs_of(spark, books))
    out = {(q[0], q[1]): [] for q in questions}
    for r in sorted(chosen.collect(), key=lambda r: r.place):
        out[r.id, r.workbook].append(r.title)
    told = {(r.id, r.prefix, r.kind, tuple(r.months), tuple(r.available), r.loaded) for r in notes.collect()}
    return out, told


def test_months_and_prefixes_of_titles(spark):
    index = {r.title: (r.month, r.prefix) for r in tabs_of(spark, {"w": ["Hoji mini kpi may(Ball)", "Undiruv  Iyul", "Iyul ", "Sentabr x", "other", "mayoq"]}).collect()}
    assert index == {"Hoji mini kpi may(Ball)": (5, "hoji mini kpi"), "Undiruv  Iyul": (7, "undiruv"), "Iyul ": (7, ""), "Sentabr x": (9, ""), "other": (None, None), "mayoq": (None, None)}


def test_groups_of_months(spark):
    books = {"w": ["main", "sales mart", "sales aprel", "sales aprel(Ball)", "sales test aprel", "boshqa iyul"], "v": ["x ishlash muddati", "undiruv mart", "undiruv may", "iyul", "Iyul ", "main2"]}
    out, told = answers(
        spark,
        books,
        [
            (1, "w", "sales sentyabr", [9], 7, None),
            (2, "w", "sales aprel qanday", [4], 7, None),
            (3, "w", "sales test aprel", [4], 7, None),
            (4, "w", "sales qanday", [], 7, None),
            (5, "v", "undiruv may va iyun", [5, 6], 7, ["main2", "gone"]),
            (6, "v", "salom", [], 1, ["main2"]),
            (4, "v", "sales qanday", [], 7, None),
        ],
    )
    assert out[1, "w"] == ["main"]
    assert out[2, "w"] == ["main", "sales aprel", "sales aprel(Ball)"]
    assert out[3, "w"] == ["main", "sales aprel", "sales aprel(Ball)", "sales test aprel"]
    assert out[4, "w"] == ["main", "sales aprel", "sales aprel(Ball)"]
    assert out[5, "v"] == ["x ishlash muddati", "Iyul ", "undiruv may", "main2"]
    assert out[6, "v"] == ["x ishlash muddati", "main2"] and out[4, "v"] == ["x ishlash muddati", "Iyul "]
    assert told == {
        (1, "sales", "missing", (9,), (3, 4), 0),
        (1, "sales test", "missing", (9,), (4,), 0),
        (4, "sales", "latest", (4,), (3, 4), 2),
        (4, "sales test", "latest", (4,), (4,), 0),
        (5, "undiruv", "missing", (6,), (3, 5), 1),
    }


def test_plain_months_managers_and_words(spark):
    books = {"w": ["may", "may managerlar", "hoji may", "mijozlar bazasi", "mijozlar iyun", "mijozlar may"], "v": ["may", "iyun", "hisobot"]}
    out, told = answers(spark, books, [(1, "w", "may natijasi", [5], 7, None), (2, "w", "mijozlar qancha", [], 6, None), (3, "w", "bazasi", [], 7, None), (4, "v", "may iyun hisobot", [5, 6], 7, None), (5, "w", "bazasi iyun", [6], 7, None)])
    # of the month: the plain tab, the one about managers, the last other one
    assert out[1, "w"] == ["may", "may managerlar", "mijozlar may"]
    # a group settles its tabs, so the word adds only the tab without a month
    assert out[2, "w"] == ["mijozlar iyun", "mijozlar bazasi"]
    assert out[3, "w"] == ["mijozlar bazasi"]
    assert out[4, "v"] == ["may", "iyun", "hisobot"]
    assert out[5, "w"] == ["mijozlar iyun", "mijozlar bazasi"]
    assert told == set()


def test_limits_of_groups_and_workbooks(spark):
    books = {"w": ["main", *(f"kpi may(v{i:02})" for i in range(12)), *(f"alfabet {i}" for i in range(9))]}
    out, told = answers(spark, books, [(1, "w", "kpi alfabet may", [5], 7, None)])
    assert out[1, "w"] == ["main", *(f"kpi may(v{i:02})" for i in range(2, 12)), "alfabet 0", "alfabet 1", "alfabet 2"]
    assert told == {(1, "kpi", "capped", (5,), (5,), 10)}


def test_normal_questions(spark):
    q = spark.createDataFrame([("  Oʻzbek  ‘SMM’ `x` ",)], "q string").select(routing.normal_question(F.col("q")), routing.normal_question(F.col("q"), text.norm_ascii)).first()
    assert q[0] == "o'zbek ‘smm' 'x'" == q[1]


def test_a_token_is_searched_once_for_all_words_without_blanks(monkeypatch):
    rng = random.Random(11)
    words = sorted({"".join(rng.choices("abc ", k=rng.randint(1, 5))) for _ in range(300)})
    known, searched, plain = matching.Searcher(words), [], matching.Automaton.found
    monkeypatch.setattr(matching.Automaton, "found", lambda self, t: searched.append(t) or plain(self, t))
    for _ in range(100):
        q = "".join(rng.choices("abc  ", k=rng.randint(0, 60)))
        found = known.found(q)
        assert sorted(found) == [w for w in words if w in q] and len(found) == len(set(found))
    known = matching.Searcher(["ab", "cab"])
    searched.clear()
    assert [sorted(known.found("xcab ab cab")) for _ in range(50)] == [["ab", "cab"]] * 50
    assert sorted(searched) == ["ab", "cab", "xcab"]


def test_what_is_read_many_times_is_kept_without_texts_and_other_workbooks(spark):
    asked = spark.createDataFrame([(1, "b1", "smm va boshqalar iyul", [7], 7, []), (2, "b2", "savdo qancha", [], 7, None)], ASKED)
    tabs = tabs_of(spark, {"b1": ["SMM iyul", "Main"], "b2": ["Savdo iyun"], "b3": ["Savdo iyul", "smm x"]})
    kept = {}
    plain = routing.match_tabs(asked, tabs)
    chosen, notes = routing.match_tabs(asked, tabs, keep=lambda df, tag: kept.setdefault(tag, df))
    assert sorted(chosen.collect()) == sorted(plain[0].collect()) and sorted(map(str, notes.collect())) == sorted(map(str, plain[1].collect()))
    assert "q" not in kept["asked"].columns and {r.workbook for r in kept["tabs"].collect()} == {"b1", "b2"}
    assert {(r.id, r.workbook, r.word) for r in kept["hits"].collect()} == {(1, "b1", "smm"), (2, "b2", "savdo")}
