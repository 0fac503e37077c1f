import numpy as np
from ledgermesh.llm import neighbours as nb
from pyspark.sql import functions as F


def brute(ids, x, top=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = (x[i] * x).sum(axis=1)
            order = [j for j in np.lexsort([ids, -s]) if j != i][:top]
            out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int").withColumn("tab", F.lit("c"))


def searched(df, **k):
    got = {}
    for r in nb.search(df, F.col("vec_id") % 20 == 0, **k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_rotation_keeps_inner_products():
    x = np.random.default_rng(0).normal(size=(9, 21))
    y = nb.rotated(x, 3)
    assert y.shape == (9, 32) and np.allclose(x @ x.T, y @ y.T)


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    for unit in (True, False):
        x = r.normal(size=(1500, 32))
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * r.uniform(0.5, 2, (1500, 1))
        x = x.astype(np.float32).astype(float)
        ids = np.arange(1500)
        want, got = brute(ids, x), searched(frame(spark, ids, x))
        assert set(got) == set(want)
        hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
        assert hit / (20 * len(want)) >= 0.9
        for q in got:
            for v, s in got[q]:
                assert abs(s - float((x[q] * x[v]).sum())) < 1e-12


def test_ties_hot_vectors_and_parts(spark, monkeypatch):
    monkeypatch.setattr(nb, "PART_ROWS", 50)
    monkeypatch.setattr(nb, "PART_QUERIES", 7)
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 16)).astype(np.float32).astype(float)
    x[100:300] = x[100]
    got = searched(frame(spark, np.arange(400), x))
    want = brute(np.arange(400), x)
    for q in (100, 120, 280):
        assert got[q] == want[q]


def test_small_and_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 0.0]), (120, [None, 1.0]), (140, [1.0]), (None, [1.0, 0.0]), (160, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert searched(df) == {0: [(3, 1.0), (20, 0.0)], 20: [(3, 2.0), (0, 0.0)]}
    assert searched(df.limit(0)) == {}


def test_codes_are_the_nearest_axes():
    x = np.random.default_rng(3).normal(size=(40, 20))
    bits = [6, 6, 2]
    found, cost = nb.codes(x, 1, bits, 9)
    assert (np.diff(cost, axis=1) >= 0).all() and (cost[:, 0] == 0).all()
    for k, b in enumerate(bits):
        y = nb._signed(x, 3 + k, b)
        assert ((found[:, 0] >> sum(bits[k + 1 :])) % (1 << b) == y.argmax(axis=1)).all()
    assert all(len(set(r)) == 9 for r in found.tolist())


def test_bits_and_visits_grow_slower_than_the_rows():
    assert [sum(nb.code_bits(n, 64)) for n in (1, 2_000, 50_000, 10**6, 10**11)] == [1, 9, 14, 18, 35]
    assert nb.probe_count(50_000 * 32) < 4 * nb.PROBES and nb.probe_count(10) >= 1


def test_few_of_all_pairs_are_scored():
    r = np.random.default_rng(6)
    centres = r.normal(size=(4000, 64))
    x = centres[r.integers(0, 4000, 50_000)] + 0.6 * r.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[::5000]
    bits, probes = nb.code_bits(len(x), 64), nb.probe_count(len(x))
    pairs, met = 0, np.zeros((len(q), len(x)), bool)
    for t in range(nb.TABLES):
        held = nb.codes(x, t, bits, 1)[0][:, 0]
        for i, wanted in enumerate(nb.codes(q, t, bits, probes)[0]):
            found = np.isin(held, wanted)
            pairs += int(found.sum())
            met[i] |= found
    s = q @ x.T
    s[np.arange(len(q)), np.arange(0, len(x), 5000)] = -2
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([met[i, best[i]].mean() for i in range(len(q))]) >= 0.95
    assert pairs < 0.2 * len(q) * len(x)


def test_hot_vector_is_one_entry(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(900, 8)).astype(np.float32).astype(float)
    x[300:600] = x[300]
    got, want = searched(frame(spark, np.arange(900), x)), brute(np.arange(900), x)
    assert set(got) == set(want)
    for q in range(300, 600, 20):
        assert got[q] == want[q]


def test_exact_scan_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nb, "SCAN_ROWS", 70)
    monkeypatch.setattr(nb, "SCAN_BLOCK", 9)
    x = np.random.default_rng(8).normal(size=(400, 16)).astype(np.float32).astype(float)
    rows = frame(spark, np.arange(400), x).withColumnRenamed("vec_id", "did")
    got = {}
    for r in nb.exact_search(rows, rows.where("did % 20 = 0"), 21).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for q, want in brute(np.arange(400), x).items():
        assert [v for _, v in sorted(got[q]) if v != q][:20] == [v for v, _ in want]


def test_queries_that_meet_too_few_are_scanned(spark):
    x = np.random.default_rng(9).normal(size=(60, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    got, want = searched(frame(spark, np.arange(60), x), tables=1, probes=0), brute(np.arange(60), x)
    assert {q: [v for v, _ in got[q]] for q in got} == {q: [v for v, _ in want[q]] for q in want}


def test_sifting_keeps_the_best_and_ties():
    r = np.random.default_rng(10)
    row = np.repeat(np.arange(30), r.integers(0, 60, 30))
    score = np.round(r.normal(size=len(row)), 1).astype(np.float32)
    kept = set(nb._best(row, score, None, 5).tolist())
    for q in range(30):
        own = np.flatnonzero(row == q)
        bar = np.sort(score[own])[::-1][:5]
        assert {i for i in own.tolist() if len(bar) and score[i] >= bar[-1]} == {i for i in own.tolist() if i in kept}
