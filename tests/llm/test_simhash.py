import random
import re

import xxhash
from ledgermesh.llm import simhash
from pyspark.sql import functions as F


def brute(docs):
    def fp(text):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            return 0
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = [d for d, _ in docs]
    fps = [fp(t) for _, t in docs]
    comp = list(range(len(docs)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, fps[i] if fps[i] < 1 << 63 else fps[i] - (1 << 64), least[find(i)]) for i, d in enumerate(ids))


def test_matches_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("alpha beta gamma delta eps Zeta eta Theta".split()) + str(r.randrange(40)) for _ in range(r.choice([1, 2, 3, 40, 300]))) for _ in range(60)]
    texts = list(base)
    for t in base:
        w = t.split()
        for _ in range(3):
            w = list(w)
            w[r.randrange(len(w))] = "changed"
            texts.append("  ".join(w))
    texts += [None, "", " \n\t", "É é\x0b x", base[0], base[0]]
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs.append(docs[5])
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(tuple(x) for x in simhash.near_duplicates(df).collect())
    assert got == brute(docs)


def test_links_within_radius_found(spark):
    r = random.Random(9)
    fps = {0}
    for _ in range(60):
        x = r.getrandbits(64)
        fps |= {x, x ^ 1 << r.randrange(64)}
        for k in (2, 3, 4):
            y = x
            for b in r.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    from ledgermesh.llm.components import connected_components

    got = dict(map(tuple, connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()))
    docs = [(f, f) for f in fps]
    comp = {f: f for f in fps}
    change = True
    while change:
        change = False
        for a, _ in docs:
            for b, _ in docs:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and comp[b] < comp[a]:
                    comp[a], change = comp[b], True
    assert all(got.get(f, f) == comp[f] for f in fps)


def test_large_run_is_exact():
    import numpy as np

    r = np.random.default_rng(1)
    f = np.unique((r.integers(0, 1 << 22, 700)).astype(np.uint64))
    a, b = simhash._links(np.zeros(len(f), np.int64), f, 3)
    seen = {x: x for x in f.tolist()}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        seen[y] = x
    comp = {x: x for x in f.tolist()}
    change = True
    while change:
        change = False
        for x in comp:
            near = f[np.bitwise_count(f ^ np.uint64(x)) <= 3].tolist()
            m = min(comp[y] for y in near)
            if m < comp[x]:
                comp[x], change = m, True
    assert comp == seen


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_runs_are_passed_on_and_split(spark):
    from ledgermesh.llm.components import connected_components

    r = random.Random(12)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 500:  # bits that differ lie in one block, so all meet on one key
        y = base
        for b in r.sample(range(22), r.randint(1, 9)):
            y ^= 1 << b
        fps.add(y)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comps = [dict(map(tuple, connected_components(simhash.links(df, most=m)).collect())) for m in (20, 10_000)]
    assert comps[0] == comps[1] and comps[0]


def test_fine_blocks_bound_a_run():
    assert sorted(b for block in simhash.FINE_BLOCKS for b in block) == list(range(64))
    assert 16 * 61 <= simhash.RUN_MOST


def test_very_long_text(spark):
    text = " ".join(str(i % 977) for i in range(400_000))
    assert sorted(tuple(x) for x in simhash.near_duplicates(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")).collect()) == brute([(1, text), (2, text + " end")])
