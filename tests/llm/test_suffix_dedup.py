import hashlib
import random

import numpy as np
import pytest
from ledgermesh.llm import suffix_dedup as sd
from pyspark.sql import functions as F


def brute(docs):
    """Rows of (doc_id, n_bytes, n_removed, n_spans, kept_sha256) for documents in order."""
    seen, out = set(), []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(s)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed, n=70):
    r = random.Random(seed)
    words = ["ab", "cde", "éà", "the", "of", "x", "zz", "日"]
    prose = lambda k: " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(k))
    shared = [prose(r.choice([8, 14, 16, 17, 18, 40, 200])) for _ in range(12)]
    docs = []
    for _ in range(n):
        parts = [prose(r.choice([0, 3, 30, 120])) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts)), r.choice(shared))
        t = r.choice(["\n", " ", ""]).join(parts)
        if docs and r.random() < 0.25:  # near copy
            base = r.choice(docs)[1] or ""
            k = r.randrange(len(base) + 1)
            t = base[:k] + r.choice(["", "!", "edit"]) + base[k + r.randrange(3) :]
        docs.append((len(docs) * 2, t))
    docs += [(900, None), (901, ""), (902, "a" * 450), (903, "a" * 99), (904, "a" * 100), (905, "ab" * 300), (906, "\x00" * 250), (907, "x" * 99 + "y"), (908, docs[3][1])]
    return docs


@pytest.mark.parametrize("seed, bits, hot", [(1, 64, None), (2, 64, 1), (3, 5, None), (4, 0, 20)])
def test_matches_brute_force(spark, seed, bits, hot, monkeypatch):
    docs = corpus(seed)
    if hot:  # anchors of a few surroundings are split
        monkeypatch.setattr(sd, "HOT", hot)
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(3).withColumn("spans", F.lit(1)).withColumn("rid", F.lit("x"))
    assert sorted(tuple(r) for r in sd.removal_digests(df, bits).collect()) == brute(docs)


def test_split_parts_cover_the_strings_of_a_unit():
    texts = [(t or "").encode() for _, t in corpus(7)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    at, key, left, right = sd.anchor_positions(raw, offsets)
    strings = lambda k, p, lo, hi: {(int(k_), int(x)) for k_, p_, l_, r_ in zip(k, p, lo, hi, strict=True) for x in range(p_ - l_, p_ + r_ - sd.LENGTH + 1)}
    for width in sd.SPLITS:
        unit, part, p, lo, hi = sd.split(raw, key, at, left, right, width)
        assert sorted(x for _, x in strings(unit, p, lo, hi)) == sorted(x for _, x in strings(np.arange(len(key)), at, left, right))
        home = {}
        for k, x in strings(part, p, lo, hi):  # equal strings have equal keys
            assert home.setdefault(bytes(raw[x : x + sd.LENGTH]), k) == k


def test_hot_passage_is_split(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 30)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    line = " ".join(word() for _ in range(15))
    docs = [(i, " ".join([*(word() for _ in range(r.randint(0, 40))), line[: r.choice([60, 96, 101, 200])], *(word() for _ in range(20))])) for i in range(250)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert len(sd.hot_anchors(df.select(F.col("doc_id").alias("rid"), "text"))) > 0
    assert sorted(tuple(x) for x in sd.removal_digests(df).collect()) == brute(docs)


def test_very_long_text(spark):
    r = random.Random(10)
    body = " ".join(str(r.randrange(10**6)) for _ in range(150_000))
    docs = [(1, body), (2, body[500_000:700_000] + "end"), (3, "short")]
    assert sorted(tuple(x) for x in sd.removal_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute(docs)


def test_repeated_and_null_ids(spark):
    t = "some passage that is long enough to count as a repeated string of a hundred bytes, which takes " + "x" * 40
    rows = [(None, t), (5, t + "b"), (5, t + "a"), (7, t), (7, t), (1, "short")]
    want = brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
    assert sorted((tuple(r) for r in sd.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == sorted(want, key=str)
    assert sd.removal_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_array_and_prefixes():
    r = random.Random(6)
    for t in [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"\x00\x00\x00", b"abababababababab\x00", *(bytes(r.choice(b"ab\x00") for _ in range(r.randrange(400))) for _ in range(60))]:
        text = np.frombuffer(t, np.uint8)
        sa, group = sd.suffix_array(text)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == want and all(group[p] == i for i, p in enumerate(want))
        for depth in (20, 30):
            cut, groups = sd.suffix_array(text, depth)
            assert [t[i : i + depth] for i in cut] == [t[i : i + depth] for i in want]
            own = sd.common_prefixes(text, cut, groups, 20).tolist()
            for k in range(1, len(t)):
                a, b = t[cut[k - 1] :][:20], t[cut[k] :][:20]
                assert own[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        lcp = sd.common_prefixes(text, sa, group, 20).tolist()
        for k in range(1, len(t)):
            a, b = t[want[k - 1] :], t[want[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 20)


def test_texts_stay_valid(spark):
    docs = corpus(8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sd.without_repeats(df).collect()}
    removed = {r[0]: r[2] for r in brute(docs)}
    assert set(got) == {d for d, _ in docs}
    assert all(len((t or "").encode()) - len(got[d].encode()) <= removed[d] and (removed[d] or got[d] == (t or "")) for d, t in docs)


def test_large_key_is_merged_across_shards(monkeypatch):
    monkeypatch.setattr(sd, "SHARD_BYTES", 1500)
    r = random.Random(4)
    base = bytes(r.randrange(256) for _ in range(168))
    texts = []
    for _ in range(60):
        t = bytearray(base)
        for _ in range(r.randrange(3)):
            t[r.choice([*range(60), *range(110, 168)])] = r.randrange(256)
        texts.append(bytes(t))
    rids, starts = np.arange(60), np.full(60, 7)
    found = sd.repeated(np.zeros(60, np.int64), rids, starts, texts)
    seen, want = set(), np.zeros((60, 168), bool)
    for i, t in enumerate(texts):
        for k in range(69):
            if t[k : k + 100] in seen:
                want[i, k : k + 100] = True
            seen.add(t[k : k + 100])
    got = np.zeros_like(want)
    for i, a, b in zip(*(x.tolist() for x in found), strict=True):
        got[i, a - 7 : b - 7] = True
    assert (got == want).all()


def test_segments_do_not_change_anchors(monkeypatch):
    texts = [(t or "").encode() for _, t in corpus(5)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = sd.anchor_positions(raw, offsets)
    monkeypatch.setattr(sd, "SEGMENT_BYTES", 513)
    for a, b in zip(whole, sd.anchor_positions(raw, offsets), strict=True):
        assert (a == b).all()
    at, _, left, right = whole
    covered = np.zeros(len(raw), int)  # every string of 100 bytes inside a document has just one anchor
    for p, lo, hi in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
        covered[p - lo : p + hi - 99] += 1
    want = np.zeros(len(raw), int)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        want[s : max(s, e - 99)] = 1
    assert (covered == want).all()
