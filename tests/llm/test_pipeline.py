import random

import corpus_pipeline as cp
import numpy as np
from ledgermesh.llm import quality, simhash
from ledgermesh.llm.components import spanning_stars
from pyspark.sql import functions as F


def jaccard(a, b):
    def sets(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def families(seed=1, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    docs = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([6, 60, 120, 400]))]
        docs.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = word()
            docs.append(" ".join(w))
    r.shuffle(docs)
    return list(enumerate(docs))


def test_groups_match_brute_force(spark):
    docs = [*families(), (5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (5004, "x y z")]
    comp = {d: d for d, _ in docs}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, t) in enumerate(docs):
        for b, u in docs[:i]:
            if jaccard(t or "", u or "") >= 0.8:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*docs, (None, "a b c")], "doc_id long, text string").withColumn("fp", F.lit(1))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    want = {d: find(d) for d, _ in docs}
    wrong = [d for d in want if got.get(d, d) != want[d]]
    assert len(wrong) <= 1  # a pair just at 0.8 is missed one time in a thousand


def test_stages(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    passage = " ".join(word() for _ in range(60))
    for i in range(120):
        words = [word() for _ in range(r.randint(60, 150))]
        bad = i % 4 == 0
        text = " ".join(w + "***" for w in words) if bad else " ".join(words) + ". " + (passage if i % 5 == 1 else "")
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(200 + k, docs[k][1] + " end", "en", "s", 9) for k in (1, 2, 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out, rows = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        rows = spark.read.parquet(f"{tmp_path}/out{k}")
        out.append(rows)
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in out]
    assert ids[0] == {d for d, *_ in docs if d % 4 or d >= 200}
    assert ids[1] == ids[0] - {201, 202, 203} == ids[2] == ids[3]
    assert all(o.columns == ["doc_id", "text", "lang", "source", "n_chars"] for o in out[:3])
    texts = {r.doc_id: r.text for r in out[2].collect()}
    holders = [d for d in sorted(texts) if d % 5 == 1]
    assert passage in texts[holders[0]] and all(passage not in texts[d] and texts[d] for d in holders[1:])
    assert [r.asDict() for r in out[3].orderBy("sequence_id", "offset").collect()] == [r.asDict() for r in cp.run(spark, str(tmp_path)).orderBy("sequence_id", "offset").collect()]


def test_pairs_of_a_slice_belong_to_one_key():
    import numpy as np

    bits = 9
    values = np.random.default_rng(1).integers(0, 1 << bits, 60)
    rows = [(int(v) ^ (1 << f >> 1), i, f) for i, v in enumerate(values) for f in range(bits + 1)]
    held = {}
    for k, i, f in rows:
        held.setdefault(k, []).append((i, f))
    seen = {}
    for k, own in held.items():
        for n, (i, f) in enumerate(own):
            for j, g in own[:n]:
                if i != j and simhash._meets_here(np.int64(k), np.uint64(f), np.uint64(g)):
                    seen[(min(i, j), max(i, j))] = seen.get((min(i, j), max(i, j)), 0) + 1
    want = {(j, i) for i in range(60) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert set(seen) == want and set(seen.values()) == {1}


def run_candidates(key, ids, word, size=1000):
    import pyarrow as pa

    batches = (pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (key, ids, word.view("i8"))], names=["key", "id", "word"]) for i in range(0, len(key), size))
    out = [b for b in simhash._candidates(batches)]
    rows = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    return {r[:2] for r in rows if r[2] < 0}, {r for r in rows if r[2] >= 0}


def test_short_runs_give_all_pairs_and_long_ones_their_rows(monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    key = np.sort(np.concatenate([np.arange(100).repeat(3), np.full(400, 50)]))
    ids = r.permutation(len(key))
    word = (r.integers(0, 1 << 62, 8).astype(np.uint64)[r.integers(0, 8, len(key))] ^ (np.uint64(1) << r.integers(8, 63, len(key)).astype(np.uint64))) & ~np.uint64(63)
    for size in (7, 1000):
        pairs, rows = run_candidates(key, ids, word, size)
        for i in range(len(key)):
            for j in range(i):
                if key[i] == key[j] != 50 and int(word[i] ^ word[j]).bit_count() <= simhash.FIRST_WORD_BITS:
                    assert (min(ids[i], ids[j]), max(ids[i], ids[j])) in pairs
        assert {(k, i) for k, i, _ in rows} == {(50, int(i)) for i in ids[key == 50]}
        long = {p for p in pairs if set(p) <= set(ids[key == 50].tolist())}
        assert 380 <= len(long) <= 400  # each row with its leader, one for each of the eight kinds


def test_long_run_takes_time_in_proportion_to_its_rows():
    import time

    import numpy as np

    r = np.random.default_rng(4)
    took = []
    for n in (100_000, 400_000):
        word = (np.uint64(0x1234567890ABCDEF) ^ (np.uint64(1) << r.integers(8, 63, n).astype(np.uint64))) & ~np.uint64(63)
        began = time.perf_counter()
        pairs, rows = run_candidates(np.zeros(n, np.int64), np.arange(n), word, 10_000)
        took.append(time.perf_counter() - began)
        assert len(rows) == n and len(pairs) == n - 1
    assert took[1] < 12 * took[0]


def test_blocks_of_a_long_run_find_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN_ALL", 2)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 50)
    r = random.Random(17)
    words = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join([*words[(a := r.randint(0, 60)) : a + r.randint(80, 88)], *(f"o{i}x{k}" for k in range(r.randint(4, 12)))])) for i in range(300)]
    comp = {d: d for d, _ in docs}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, t) in enumerate(docs):
        for b, u in docs[:i]:
            if jaccard(t, u) >= 0.8:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got.get(d, d) != find(d) for d, _ in docs) <= 6  # a pair just at 0.8 may never meet under a key


def test_large_family_around_the_threshold_matches_brute_force(spark):
    import numpy as np

    r = random.Random(7)
    words = [f"w{i}" for i in range(304)]
    docs = []
    for i in range(1000):
        own = [f"o{i}x{k}" for k in range(r.randint(20, 45))]
        a, n = r.randint(0, 60), r.randint(220, 244)
        docs.append((i, " ".join([*words[a : a + n], *own])))
    hashes = [simhash.shingle_hashes(t.encode(), 5) for _, t in docs]
    at = {h: k for k, h in enumerate(sorted(set(np.concatenate(hashes).tolist())))}
    has = np.zeros((len(docs), len(at)), np.float32)
    for i, h in enumerate(hashes):
        has[i, [at[x] for x in h.tolist()]] = 1
    both, size = has @ has.T, has.sum(1)
    a, b = np.nonzero(np.triu(both >= 0.8 * (size[:, None] + size[None, :] - both), 1))
    root, member = spanning_stars(a, b)
    want = dict(zip(member.tolist(), root.tolist(), strict=True))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(df).collect()}
    wrong = [i for i, _ in docs if got.get(i, i) != want.get(i, i)]
    assert len(want) > 500 and len(wrong) <= 10  # a pair just at 0.8 may never meet under a key


def test_repeated_rows_and_null_ids(spark):
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, a, "en", "s", 0), (1, a, "en", "s", 0), (1, b, None, "s", 0), (None, c, "en", None, 0), (None, c, "en", None, 0), (2, c, "en", "s", 0), (3, None, None, None, None), (None, "short", "en", "s", 0), (4, d, "en", "s", 0)]
    df = spark.createDataFrame(rows, columns)
    key = lambda x: str(tuple(x))
    near = [tuple(x) for x in cp.near_copies(spark, df, "").collect()]
    assert sorted(near, key=key) == sorted([rows[i] for i in (0, 2, 3, 6, 7, 8)], key=key)
    cut = [tuple(x)[:2] for x in cp.repeated_passages(spark, df, "").collect()]
    assert sorted(cut, key=key) == sorted([(1, a), (1, ""), (1, b), (None, c), (None, ""), (2, ""), (3, ""), (None, "short"), (4, d)], key=key)


def test_stages_on_empty_tables_and_extra_columns(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    names = ["rid", "spans", "ids", "deal", "x", "quality", "score", "predicted", "number", "text_a", "key", "found"]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], columns)
    full = spark.createDataFrame([(1, "some words of one text " * 9, "en", "s", 3), (2, None, None, None, None), (None, "other words " * 20, "en", "s", 1)], columns)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
    for _, stage in cp.STAGES[:3]:
        plain = stage(spark, full, str(tmp_path))
        more = full
        for n in names:
            more = more.withColumn(n, F.lit("clash"))
        wide = stage(spark, more, str(tmp_path))
        assert wide.columns == more.columns
        assert sorted(map(str, wide.select(full.columns).collect())) == sorted(map(str, plain.collect()))
        assert {tuple(r) for r in wide.select(names).collect()} <= {("clash",) * len(names)}


def test_quality_stage_learns_from_all_labels(spark, tmp_path, monkeypatch):
    n = 27_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    learned = []

    def fit(rows, *rest):
        learned.append(rows.count())
        return quality.Model((0.0,) * 12, (0.0,) * 12, (1.0,) * 12, 0.0)

    monkeypatch.setattr(quality, "fit", fit)
    assert cp.quality_filter(spark, docs, str(tmp_path)).count() == n
    assert learned == [docs.where(~quality.held_out(F.col("doc_id"))).count()] and learned[0] > 16_000


def near_but_apart(n, seed=23):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(260)]
    return [(i, " ".join([*words[(a := r.randint(0, 12)) : a + 240], *(f"o{i}x{k}" for k in range(r.randint(34, 48)))])) for i in range(n)]


def test_texts_compared_grow_with_the_documents_not_with_their_square(spark, monkeypatch):
    verified, compared = simhash._verified, []

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    for n in (150, 600):
        compared.clear()
        docs = near_but_apart(n)
        assert max(jaccard(docs[i][1], docs[j][1]) for i in range(30) for j in range(i)) < 0.8
        assert simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).isEmpty()
        assert sum(compared) < 30 * n


def test_further_links_are_those_of_brute_force(spark, monkeypatch):
    import numpy as np

    r = random.Random(29)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words[(a := r.randint(0, 20)) : a + r.randint(20, 40)], *(f"o{r.randint(0, 40)}" for _ in range(r.randint(0, 4)))])) for i in range(200)]
    docs += [(200, None), (201, "one"), (202, "One"), (203, "one two")]
    comp = {d: d for d, _ in docs}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    near = [(b, a) for a, t in docs for b, u in docs[:a] if t and u and jaccard(t, u) >= 0.8]
    for i, j in near:
        x, y = find(i), find(j)
        comp[max(x, y)] = min(x, y)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    ids = rows.selectExpr("doc_id AS id")
    for rare, block, known in ((2, 7, []), (32, 2048, near[::9]), (10**6, 2048, [])):
        monkeypatch.setattr(simhash, "RARE", rare)
        monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
        links = spark.createDataFrame(known, "a long, b long")
        found = [*known, *((x.a, x.b) for x in simhash._further_links(ids, links, rows, 5, 0.8).collect())]
        root, member = spanning_stars(*(np.array(x) for x in zip(*found, strict=True)))
        assert dict(zip(member.tolist(), root.tolist(), strict=True)) == {d: find(d) for d in comp if find(d) != d}


def test_frequent_shingles_of_a_document_travel_once():
    import pyarrow as pa

    n = 5000
    shingle = pa.struct([("c", pa.int64()), ("s", pa.int64()), ("h", pa.int64())])
    lists = [[{"c": 40, "s": 7, "h": h} for h in range(n)], [{"c": 40, "s": h % 9, "h": h} for h in range(n)], [{"c": 2, "s": h, "h": h} for h in range(3)]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([n, n, 4]), pa.array([1, 2, 3]), pa.array(lists, pa.list_(shingle))], names=["id", "n", "component", "list"])
    rows = simhash._prefixes(0.8)(batch).to_pylist()
    assert [(r["id"], len(r["parts"])) for r in rows if r["parts"] is not None] == [(1, n), (2, n)]
    assert [r["key"] for r in rows if r["id"] == 1] == [None, 7]
    assert sorted(r["key"] for r in rows if r["id"] == 2 and r["key"] is not None) == list(range(9))
    assert [(r["key"], r["pos"]) for r in rows if r["id"] == 3] == []
