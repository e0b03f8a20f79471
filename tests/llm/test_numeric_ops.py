"""Operators 11, 12 and 13 against brute force, numpy's eigenvectors and SQL."""

import datetime
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import exact, registry, rolling, whitening
from tests.oracle import connect, differences

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_rolling_median"])
def test_against_sql(spark, small, con, name):
    assert not differences(registry.QUERIES[name](spark, small), con, registry.SQL[name])


# exact deduplication


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for j, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0))):
            out[i, keep, len(ids), j == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def odd_texts():
    rng = random.Random(5)
    texts = [rng.choice(["copy", "Copy", "COPY", "É", "é", "", None, " ", "x" * 50_000, "X" * 50_000, "İ", "K", "k"]) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "hot text") for i in range(200)] + [(2000 + i, f"alone {i}") for i in range(100)]
    return rows + [(5, "again"), (5, "again"), (5, "AGAIN"), (None, "no id"), (None, "No id"), (None, "hot text"), (-3, "hot text")]


@pytest.mark.parametrize("scan,table", [(exact.SCAN_BYTES, exact.TABLE_BYTES), (2000, 3000), (1, 1)])
def test_groups_however_often_they_spill(spark, scan, table):
    docs = spark.createDataFrame([(i, t, 1, True, "c") for i, t in odd_texts()], "doc_id long, text string, label int, top boolean, content string").repartition(4)
    got = exact.duplicate_groups(docs, scan_bytes=scan, table_bytes=table)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_groups(odd_texts())
    assert exact.duplicate_groups(docs.where("false")).count() == 0


def test_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "X"), (None, "x"), ("c", "y")], "name string, body string")
    got = {(r.name, r.keep_id, r.group_size, r.kept) for r in exact.duplicate_groups(docs, "name", "body").collect()}
    assert got == {("a", "b", 3, False), ("b", "b", 3, True), (None, "b", 3, False), ("c", "c", 1, True)}


def test_table_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(exact, "hash", lambda content: 7, raising=False)
    table = exact.ContentTable(1 << 20)
    contents = [str(i).encode() for i in range(600)]
    assert [table.find(c) for c in contents] == list(range(600)) == [table.find(c) for c in contents]
    full = exact.ContentTable(10)
    assert [full.find(b"long content"), full.find(b"other"), full.find(b"long content")] == [0, -1, 0]


# rolling medians


def brute_windows(rows, minutes):
    least = {}
    for click, ts, kind, value in rows:
        key = (ts is None, ts or datetime.datetime.min, kind is not None, kind or "", value is not None, value or 0)
        if click not in least or key < least[click][0]:
            least[click] = (key, ts, kind, value)
    series = defaultdict(list)
    cents = lambda v: None if v is None or not math.isfinite(v) else math.floor(100 * v + 0.5)
    for click, (_, ts, kind, value) in least.items():
        if ts is not None:
            series[kind].append((ts, click, cents(value)))
    middle = lambda v: v[(len(v) - 1) // 2] + v[len(v) // 2]
    out = set()
    for kind, found in series.items():
        for ts, click, c in found:
            v = sorted(x for t, _, x in found if x is not None and ts - datetime.timedelta(minutes=minutes) <= t <= ts)
            median2 = mad4 = far = None
            if len(v) >= 5:
                median2 = middle(v)
                mad4 = middle(sorted(abs(2 * x - median2) for x in v))
                far = None if c is None else 2 * abs(2 * c - median2) > 5 * mad4
            out.add((click, kind, len(v), median2, mad4, far))
    return out


def clicks(seed, n=700):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 3, 31, 0, 30)
    values = [None, 0.0, -0.005, 1.005, 2.675, 7.0, 7.0, 1e9, float("nan"), float("inf")]
    rows = []
    for i in range(n):
        kind = rng.choice(["a", "a", "a", "b", None, ""])
        ts = start + datetime.timedelta(minutes=rng.choice([0, 60, 120, 180, rng.randrange(400)]), microseconds=rng.choice([0, 0, 1, 999_999]))
        value = rng.choice(values) if rng.random() < 0.3 else round(rng.lognormvariate(3, 1), 2)
        rows.append((i, None if rng.random() < 0.02 else ts, kind, value))
    rows += rng.choices(rows, k=40) + [(3, start, "b", 4.0), (None, start, "a", 1.0), (None, start, "b", 2.0), (-1, datetime.datetime(1969, 12, 31, 23, 59, 59, 1), "a", 1.0)]
    return rows


@pytest.mark.parametrize("parts", [None, 1, 3, 24])
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_medians_of_windows(spark, parts, zone, monkeypatch):
    if parts == 3:
        monkeypatch.setattr(rolling, "BATCH_ROWS", 50)
    rows = clicks(parts or 9)
    df = spark.createDataFrame([(*r, 1, False, 5) for r in rows], "click_id long, ts timestamp_ntz, kind string, value double, n int, far boolean, __chunk int").repartition(3)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = rolling.rolling_medians(df, 60, parts).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {tuple(r) for r in got} == brute_windows(rows, 60) and len(got) == len({tuple(r) for r in got})


def test_parts_follow_the_densest_stretch(spark, monkeypatch):
    monkeypatch.setattr(rolling, "STRETCH_ROWS", 40)
    rows = clicks(4)
    df = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, kind string, value double")
    assert {tuple(r) for r in rolling.rolling_medians(df, 360).collect()} == brute_windows(rows, 360)
    assert rolling.rolling_medians(df.where("false")).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for weighted in (False, True):
        ranks = rng.integers(0, 37, 500)
        weights = rng.integers(1, 5, 500) if weighted else None
        matrix = rolling.WaveletMatrix(ranks, weights)
        lo = rng.integers(0, 400, 200)
        hi = lo + rng.integers(1, 100, 200)
        for a, b in zip(lo, hi, strict=True):
            spread = np.sort(np.repeat(ranks[a:b], 1 if weights is None else weights[a:b]))
            at = np.arange(len(spread))
            assert (matrix.quantile(np.full(len(at), a), np.full(len(at), b), at) == spread).all()
            bounds = np.arange(39)
            assert (matrix.below(np.full(39, a), np.full(39, b), np.minimum(bounds, ranks.max() + 1)) == np.searchsorted(spread, bounds)).all()


# whitening


def brute_whitening(vectors, most=4):
    whole = {i: v for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)}
    x = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in whole.items()}
    fitted = np.array(sorted(set(x.values())), np.float64)
    n, s = len(fitted), [sum(c) for c in zip(*set(x.values()))]
    centred = fitted - np.array(s) / n
    e, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, e[::-1][:most], vectors_[:, ::-1][:, :most].T, e.sum()


def check_whitening(rows, vectors, most=4):
    x, n, s, e, comps, trace = brute_whitening(vectors, most)
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, k) for i in x for k in range(1, len(e) + 1))
    signs = {}
    for r in rows:
        v = np.array(x[r.vec_id], np.float64) - np.array(s) / n
        want = float(v @ comps[r.component - 1]) / math.sqrt(e[r.component - 1])
        if abs(want) > 0.5:
            signs.setdefault(r.component, math.copysign(1, want * r.whitened))
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s, strict=True))
        assert abs(r.explained - e[r.component - 1] / trace) < 1e-10 and r.identity_error < 1e-9
    for r in rows:
        v = np.array(x[r.vec_id], np.float64) - np.array(s) / n
        assert abs(r.whitened * signs[r.component] - float(v @ comps[r.component - 1]) / math.sqrt(e[r.component - 1])) < 1e-8


def test_whitening_of_embeddings(spark, small):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_whitening(registry.op11_embedding_whitening(spark, small).collect(), vectors)


def test_whitening_of_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(300, 6)) * [3, 1, 0.7, 0.2, 0.1, 0.01]).astype(np.float32).tolist()
    vectors = list(enumerate(base)) + [(1000 + i, base[0]) for i in range(200)]
    broken = [(-1, None), (-2, []), (-3, [None] * 6), (-4, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (-5, [float("inf")] + [0.0] * 5), (-6, [1.0, 2.0])]
    monkeypatch.setattr(whitening, "STACK", 2)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + broken], "vec_id long, embedding array<float>, n int, component int").repartition(9)
    check_whitening(whitening.whiten(df).collect(), vectors)
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id >= 1000")).count() == 0
    two = whitening.whiten(df.where("vec_id IN (0, 1, 1000)")).collect()
    assert Counter(r.component for r in two) == {1: 3} and {abs(round(r.whitened, 9)) for r in two} == {1.0}
    assert whitening.whiten(df.where("vec_id < 50").withColumn("vec_id", F.lit(None).cast("long"))).count() == 200


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 33, 64):
        scale = 10.0 ** -np.linspace(0, 9, d)
        a = rng.normal(size=(3 * d + 2, d)) * scale
        components, sigma = whitening.jacobi(whitening.triangle(a))
        assert np.abs(components @ components.T - np.eye(d)).max() < 1e-12
        assert np.abs(np.linalg.norm(a @ components.T, axis=0) / sigma - 1).max() < 1e-6
        want = np.linalg.svd(a, compute_uv=False)
        assert np.abs(sigma[: d // 2 + 1] / want[: d // 2 + 1] - 1).max() < 1e-9
    assert whitening.deviation(np.array([[3, -4]]), 10, [5, 5]) == [25**2 + 45**2]
    assert whitening.deviation(np.array([[2**40, 0]]), 10, [0, 5]) == [None]
