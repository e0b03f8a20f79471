"""Operators 4, 5 and 7 and the pipeline against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gridlake.llm import boosting, components, ngramjoin, ordermin, pii, registry
from tests.llm.test_text_ops import brute_quality, check_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, key int, n int, label int, s int"


def rows_of(spark, pairs):
    """With columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in pairs], SCHEMA).repartition(3)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, threshold):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            n, m = len(sets[a]), len(sets[b])
            if a < b and n and m and 100 * min(n, m) >= threshold * max(n, m):
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (n + m - both):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed, groups=6, most=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = rng.choices(words, k=30)
    texts = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 6, 40, 120])) + common * rng.choice([0, 1])
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    return texts + ["", "  \n", None, "one", "ONE", "one two", "a b c d", "x" * 30_000, "é É"]


@pytest.mark.parametrize("k,threshold", [(4, 85), (5, 80)])
def test_links(spark, k, threshold):
    texts = dict(enumerate(near_copies(k)))
    want = brute_components(texts, k, threshold)
    got = ngramjoin.link_documents(rows_of(spark, texts.items()), k, threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)


def test_links_of_documents(spark, tiny):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op4_ngram_jaccard(spark, tiny).collect()}
    assert got == brute_components(texts, 4, 85)


def test_links_of_repeated_and_no_rows(spark):
    docs = rows_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)])
    got = Counter((r.doc_id, r.component_id) for r in ngramjoin.link_documents(docs).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3)])
    assert ngramjoin.link_documents(docs.where("false")).count() == 0
    assert ngramjoin.keep_one(docs.where("doc_id IS NOT NULL")).count() == 2


def test_one_is_kept_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join(words), " ".join(words[:58] + ["x", "y"])
    texts = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "A b c d  e f"), (5, "p q r s t u"), (None, "p q r s t u"), (None, "p q r  s t u"), (None, near), (None, far), (9, near + " z"), (None, "alone with six words in it"), (None, None), (None, " "), (None, " "), (7, None)]
    kept = ngramjoin.keep_one(rows_of(spark, texts))
    assert kept.columns == rows_of(spark, texts).columns and dict(kept.dtypes)["doc_id"] == "bigint"
    got = Counter((r.doc_id, (r.text or "").lower().replace("  ", " ")) for r in kept.collect())
    assert got == Counter([(None, "a b c d e f"), (5, "p q r s t u"), (9, near + " z"), (None, "alone with six words in it"), (None, ""), (None, " "), (None, " "), (7, "")])
    no_ids = rows_of(spark, [(None, near), (None, far), (None, near)])
    assert ngramjoin.keep_one(no_ids).count() == 1


def test_blocks_find_the_links_of_one_task(spark, monkeypatch):
    texts = dict(enumerate(near_copies(9, groups=2, most=60)))
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.link_documents(rows_of(spark, texts.items()), 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1200)] + [(i, i + 1) for i in range(5000, 5200)] + [(9000, i) for i in range(9001, 9400)] + [(1, 1)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    want = {x: top(x) for x in parent if top(x) != x}
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert {k: v for k, v in got.items() if k != v} == want


def native_hashes(spark, words):
    from pyspark.sql import functions as F

    return {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}


def test_order_minhash_selects_and_orders_as_stated(spark):
    """Signatures rebuilt in Python from the same hash function, occurrence numbers and text order."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    texts = ["", "a", "a b", "a a a a b a b", " ".join(rng.choices("abcdefgh", k=400)), " ".join(f"u{i}" for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.p for r in ordermin.with_fingerprint(df, "text", "p").collect()}

    def xx(rows):  # hash of longs by Spark
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["i int", *(f"c{k} long" for k in range(len(rows[0])))]))
        return [r.h for r in frame.select("i", F.xxhash64(*(f"c{k}" for k in range(len(rows[0])))).alias("h")).orderBy("i").collect()]

    unsigned = lambda x: x % (1 << 64)
    for i, text in enumerate(texts):
        units = text.split(" ")
        known = native_hashes(spark, set(units))
        h = [known[u] for u in units]
        grams = xx([(h[j], h[j + 1]) for j in range(len(h) - 1)]) + xx([(h[-1],)]) if len(h) > 1 else xx([(h[0],)])
        seen, items = Counter(), []
        again = [(unsigned(g) >> 24, j) for j, g in enumerate(grams)]
        numbered = {}
        for g, j in again:
            seen[g] += 1
            numbered[j] = (g, seen[g] - 1)
        repeats = [(j, g, n) for j, (g, n) in numbered.items() if n]
        frame = spark.createDataFrame([(j, g, n) for j, g, n in repeats] or [(-1, 0, 0)], "j int, g long, n int").select("j", F.xxhash64("g", "n").alias("h"))
        new = {r.j: unsigned(r.h) >> 24 for r in frame.collect()}
        for j, (g, n) in numbered.items():
            items.append((new[j] if n else g, j))
        buckets = defaultdict(list)
        for g, j in items:
            buckets[g >> 34].append((g, j))
        want = set()
        for b, found in buckets.items():
            first = sorted(found, key=lambda x: (x[0], x[1]))[:2]
            ordered = [g for g, _ in sorted(first, key=lambda x: x[1])]
            want.add(b * 65536 + unsigned(xx([tuple(ordered)])[0]) % 65536)
        assert set(got[i]) == want and len(got[i]) == len(want)


def test_fingerprints(spark, tiny):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in registry.op5_order_minhash(spark, tiny).collect()}
    ids = sorted(texts)
    prints = {}
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    long = [i for i in ids if len(texts[i]) > 600]
    assert sum(got[i].near_edited > got[i].near_next for i in long) >= 0.98 * len(long)
    odd = rows_of(spark, [(1, None), (2, ""), (2, ""), (None, "x y"), (5, "a" * 50_000)])
    rows = ordermin.fingerprint_documents(odd).collect()
    assert sorted(((r.doc_id or 0), r.n_chars) for r in rows) == [(0, 3), (1, 0), (2, 0), (2, 0), (5, 50_000)]
    assert {r.near_next for r in rows if r.doc_id == 1} == {1.0}
    assert ordermin.fingerprint_documents(odd.where("false")).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


NOTHING = {g: boosting.Boosted(0.0, (), float("inf")) for g in pii.LOOSE}


def test_base_spans(spark, small):
    rng = random.Random(8)
    odd = [None, "", "a@b.c_d@e.f x@y.z@q.r", "é a.b@c.d 1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1", "4111 1111 1111 1111-4111111111111111", "+1 (555) 010-9999+44 20 7946 0958.", "9" * 30_000, "a" * 50_000 + "@x.y", "1-" * 9000, "日本 +7 999 123-45-67 x@y.zz"]
    odd += ["".join(rng.choice("a.@-_+ 0123456789()é") for _ in range(80)) for _ in range(300)]
    docs = rows_of(spark, enumerate(odd))
    model = NOTHING
    for r in pii.find(docs, model).select("doc_id", "base", "spans").collect():
        want = brute_base(odd[r.doc_id])
        assert [(x.k, x.s, x.e) for x in r.base] == want, odd[r.doc_id][:80]
        assert [(x.k, x.s, x.e) for x in r.spans] == want
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in registry.op7_pii(spark, small).collect():
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in PLAIN)
    assert pii.find(docs.where("false"), model).count() == 0


def test_trees_add_spans_like_the_base_ones_and_redact(spark):
    rng = random.Random(3)
    texts = []
    for i in range(900):
        number = f"({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        texts.append(f"tel +1 {number} end" if i % 2 else f"order {rng.randrange(10**8, 10**9)} of")
    docs = rows_of(spark, enumerate(texts))
    model = pii.fit(docs)
    assert model["number"].trees and np.isfinite(model["number"].threshold) and model["number"].precision >= 0.95
    extra = rows_of(spark, [(1, "tel +1 (555) 123-4567 and (555) 123-4567"), (2, "order 123456789 of")])
    found = {r.doc_id: r for r in pii.find(extra, model).collect()}
    assert [x.k for x in found[1].base] == ["phone"] and not found[2].spans
    assert [(x.k, x.s, x.e) for x in found[1].spans] == [("phone", 4, 21), ("phone", 26, 40)]
    clean = pii.redact(pii.find(rows_of(spark, [(1, "é x@y.zz and +1 (555) 123-4567!"), (2, "none"), (3, "4111 1111 1111 1111")]), NOTHING))
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "é [EMAIL] and [PHONE]!", 2: "none", 3: "[CARD]"}
    assert clean.columns == [*docs.columns, "base", "spans"]


def test_added_spans_of_labelled_texts(spark):
    """Precision and recall on texts labelled by hand: [[...]] marks what should be added."""
    rng = random.Random(4)
    hexes = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    texts = [f"ask {word(5)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com, +1 (555) 010-{rng.randrange(1000, 9999)} or {word(20)} and " + (f'token = "{hexes()}"' if i % 3 else f"the {word(24)}") for i in range(300)]
    model = pii.fit(rows_of(spark, enumerate(texts)))
    marked = [
        "write to [[john.doe (at) mail3 (dot) example (dot) com]] today", "mail [[anna.b[at]host.org]]", "é 日本 [[jane_k (at) uni.edu]]", "[[info[at]firma[dot]de]] for more", "ask [[m.mueller(at)web.de]]",
        "call [[(017) 555-7713]] or [[0171 555 7713]]", "tel [[017-555-7713]].", "phone: [[(998) 901-2345]] now", "my number is [[(555) 123-4567]] thanks", "fax [[030 123 4567]]",
        'token = "[[04dbebab91ab85687d33eeaaf9ac699e1188f962]]" x', "password: [[hUnter2hUnter2xyz99]]", "api_key=[[sk-abcdEFGH12345678901234]]", "Bearer [[eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9]]", "secret: '[[9f8e7d6c5b4a39281706f5e4d3c2b1a0]]'",
        "see https://example.com/org/a/very/long/path-with-many-segments/index", "class ThisIsALongCamelCaseIdentifierName123 here", "commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 by me", "id 550e8400-e29b-41d4-a716-446655440000", "/usr/local/lib/python3/site-packages/module",
        "snake_case_identifier_with_many_parts = 1", "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "----------------------------------------", "meet (at) noon", "user@host said", "on 2024-01-15 10:22:33", "from 1990-1999", "order 123456789", "ISBN 978-3-16-148410-0",
        "pi 3.14159265358", "no. 9807915762804490", "version 10.2.3.4.5", "1 2 3 4 5 6 7 8 9", "15.01.2024 and 16.01.2024", "total 1 234 567.89", "https://github.example/a/blob/4f2d9c0b7a6e5d4c3b2a1908f7e6d5c4b3a29180/src/main.py", "the kebab-case-identifier-of-a-page", "AVeryLongCONSTANTNameWithDigits2024Inside",
    ]
    plain = [m.replace("[[", "").replace("]]", "") if "[at]" not in m and "[dot]" not in m else re.sub(r"\[\[(.*)\]\]", r"\1", m) for m in marked]
    want = set()
    for i, m in enumerate(marked):
        at = 0
        for piece in re.findall(r"\[\[(.*?)\]\](?=[ .,;'\"]|$)", m):
            at = plain[i].index(piece, at)
            want.add((i, at, at + len(piece)))
            at += len(piece)
    got = {(r.doc_id, x.s, x.e) for r in pii.find(rows_of(spark, enumerate(plain)), model).collect() for x in r.spans if (x.k, x.s, x.e) not in {(b.k, b.s, b.e) for b in r.base}}
    right = len(got & want)
    assert right / len(got) >= 0.9 and right / len(want) >= 0.8


def test_secrets_of_documents_are_added(spark, small):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    spans = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("secret")] for r in registry.op7_pii(spark, small).collect()}
    want = {i: [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer('token = "([0-9a-f]{40})"', t)] for i, t in texts.items()}
    assert sum(map(len, want.values())) > 5 and spans == want


def test_columns_of_the_same_names_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "x@y.zz", "b", "s", 1), (None, None, None, None, None)], "doc_id long, text string, base string, spans string, score int")
    found = pii.find(docs, NOTHING, base_col="__b", spans_col="__s")
    assert found.columns == [*docs.columns, "__b", "__s"]
    clean = pii.redact(found, spans_col="__s").select(*docs.columns).collect()
    assert {tuple(r) for r in clean} == {(1, "[EMAIL]", "b", "s", 1), (None, None, None, None, None)}
    assert pii.find(docs, NOTHING).columns == ["doc_id", "text", "score", "base", "spans"]
    many = " ".join(f"+1 (555) 010-{i % 10000:04d} x" for i in range(50_000))
    began = time.perf_counter()
    row = pii.redact(pii.find(rows_of(spark, [(1, many)]), NOTHING)).first()
    assert len(row.spans) == 50_000 and row.text == " ".join(["[PHONE] x"] * 50_000)
    assert time.perf_counter() - began < 60


def test_phones_of_far_digits(spark):
    docs = rows_of(spark, [(1, "call +4 - 9 - 1 - 2 - 3 - 4 - 5 - 6."), (2, "+1 ... 2 ... 3"), (3, "1 - 2 - 3")])
    found = pii.find(docs, NOTHING)
    assert {r.doc_id: [(x.k, x.s, x.e) for x in r.base] for r in found.collect()} == {1: [("phone", 5, 35)], 2: [], 3: []}
    assert {r.doc_id: r.text for r in pii.redact(found).collect()}[1] == "call [PHONE]."


def test_tree_expressions_equal_numpy(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = {k: rng.integers(0, 9, 500).astype(float) for k in "abc"}
    model = boosting.fit(x, ((x["a"] > 4) ^ (x["b"] > 6)).astype(float), rounds=8)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values(), strict=True)], "a double, b double, c double")
    got = [r[0] for r in df.select(model.margin_column(lambda f: F.col(f))).collect()]
    assert np.allclose(got, model.margin(x)) and np.isfinite(model.threshold)


def test_pipeline(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, tiny)
        assert kept.columns == columns
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        seen.append((name, {r.doc_id: r.text for r in kept.collect()}))
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = dict(seen)
    assert after["language"] == {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    for i, t in after["language"].items():
        n, chars, symbols, dup, again = brute_quality(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        raw = t.encode()
        marks = sum(c < 128 and not chr(c).isalnum() and c != 32 and not 9 <= c <= 13 for c in raw)
        regular = len(raw) >= 500 and 100 * len(zlib.compress(raw, 1)) < 6 * len(raw)
        good = 100 * marks <= 40 * len(raw) and not regular and n >= 50 and 100 * again <= 50 * n and 100 * symbols <= 25 * n and 100 * dup <= 50 * lines and 2 * n <= chars <= 20 * n
        assert (i in after["quality"]) == good
    groups = brute_components(after["quality"], 5, 80)
    assert set(after["near_copies"]) == {i for i, (_, top) in groups.items() if i == top}
    for i, t in after["near_copies"].items():
        spans = brute_base(t)
        clean = after["personal_data"][i]
        assert clean != t if spans else clean == t or "[SECRET]" in clean
        assert not re.search('token = "[0-9a-f]{40}"', clean)
        assert not [s for s in brute_base(clean) if s[0] == "email"]
    rows = corpus_pipeline.run(spark, tiny).collect()
    used, total = check_packing(rows, after["personal_data"], 2048)
    assert used <= total / 2048 * 1.02 + 1
    assert zlib.crc32(b"") == 0


def test_stages_take_odd_tables(spark, tiny):
    """Null ids and texts, repeated rows, no rows, and columns with names that operators use."""
    prose = " ".join(f"word{i} and" for i in range(60))
    rows = [(None, prose, "en"), (1, None, "en"), (2, "", None), (3, prose, "en"), (3, prose, "en"), (4, f"{prose} x@y.zz", "fr"), (5, "~" * 3000, "en"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), 0.5, "p", "b", "sp", 1, 2, "k") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, base string, spans string, n int, key int, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.where("false"), tiny)
        assert empty.columns == docs.columns and empty.count() == 0
        kept = stage(spark, docs, tiny)
        assert kept.columns == docs.columns
        got = Counter((r.doc_id, (r.text or "")[-8:]) for r in kept.collect())
        tail = prose[-8:]
        if name in ("language", "quality"):
            assert got == Counter({(None, tail): 1, (3, tail): 2, (4, f"{prose} x@y.zz"[-8:]): 1})
        elif name == "near_copies":
            assert got == Counter({(1, ""): 1, (2, ""): 1, (3, tail): 1, (5, "~" * 8): 1, (None, ""): 1})  # 4 is a near copy of 3
        else:
            assert got[(4, " [EMAIL]")] == 1 and sum(got.values()) == len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert packed.count() == len(rows) and packed.select("sequence_id").distinct().count() == 1 + (packed.agg({"length": "sum"}).first()[0] - 1) // 2048


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_sets_of_texts_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(2048), thue_morse(2048, True)
    texts = {1: f"x {a} y z w", 2: f"x {b} y z w", 3: f"x {a} y z w", 4: a, 5: b, 6: f"{a} {b} {b} {a} {a} {b} {b} {a}"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.link_documents(rows_of(spark, texts.items()), 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_a_cloud_of_near_copies_over_blocks(spark, monkeypatch):
    """Copies of one text, each altered anew: a few pairs link, and chains of links run through many blocks."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    base = rng.choices(words, k=90)
    texts = {i: " ".join(rng.choice(words) if rng.random() < 0.02 else w for w in base) for i in range(150)}
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 10)
    monkeypatch.setattr(ngramjoin, "BIN_SETS", 25)
    want = brute_components(texts, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.link_documents(rows_of(spark, texts.items()), 4, 85).collect()}
    assert got == want and len({c for _, c in want.values()}) > 1


def test_ids_of_other_types(spark):
    texts = ["b one two", "", "c three", None, "a"]
    docs = spark.createDataFrame([(f"id{9 - i}", t) for i, t in enumerate(texts)] + [(None, "z")], "doc_id string, text string").repartition(3)
    rows = {r.doc_id: r for r in ordermin.fingerprint_documents(docs).collect()}
    ids = [None, *(f"id{i}" for i in range(5, 10))]
    by_id = {f"id{9 - i}": t or "" for i, t in enumerate(texts)} | {None: "z"}
    for i, here in enumerate(ids):
        t, after = by_id[here], by_id[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        assert rows[here].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    linked = {r.doc_id: r.component_id for r in ngramjoin.link_documents(docs.unionByName(docs.where("doc_id = 'id9'")), 2, 80).collect()}
    assert linked["id9"] == "id9" and linked[None] is None
