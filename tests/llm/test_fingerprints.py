import hashlib
import re
import unicodedata

from ledgermesh.llm import fingerprints as fp
from pyspark.sql import functions as F

TEXTS = ["Ａｂ ﬁ  é", "ab fi é ", "AB FI É", None, "", "　 \n", "b" * 9000, "same", "same", "Same ", "x", "same", "odd\x1cy", "odd y"]


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").lower()).strip()


def test_edited_likeness(spark):
    docs = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("next_id", F.lit("z")).withColumn("half", F.lit(1))
    got = {r.doc_id: r for r in fp.edited_likeness(df).collect()}
    assert len(got) == len(docs)
    prints = {}
    for k, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_edited == float(canon(t) == canon(e)) and r.near_next == float(canon(t) == canon(nxt))
        for text, print_ in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            assert prints.setdefault(canon(text), print_) == print_
    assert len(set(prints.values())) == len(prints)


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fp, "wide_hash", lambda c: F.length(c).cast("string"))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB"), (4, "xyz"), (5, "ab"), (None, "ab")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.class_id) for r in fp.exact_duplicates(df).collect()}
    assert {d: c for d, (_, c) in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1, None: 1}
    assert got[1][0] == got[3][0] != got[2][0]
    near = {r.doc_id: r for r in fp.edited_likeness(df).collect()}
    assert near[1].near_next == 0.0 and near[5].near_next == 1.0 and near[1].fingerprint == near[5].fingerprint != near[2].fingerprint


def test_small_tables(spark):
    assert fp.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fp.edited_likeness(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_rows_that_share_an_id_or_have_none(spark, monkeypatch):
    # in the order of the ids, nulls first: rows of one id are edited each by its own length with the first row of the next id
    rows = [(None, "n"), (None, "nulls come first"), (5, "ab"), (5, "abcdefgh"), (9, "zz top"), (9, "zz top")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("clash"))
    nexts = {None: "ab", 5: "zz top", 9: "n"}
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(fp, "wide_hash", lambda c: F.lit("0"))
        got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fp.edited_likeness(df).collect()), key=str)
        want = []
        for d, t in rows:
            h = len(t) // 2
            e = t[: len(t) - h] + nexts[d][:h]
            want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(nexts[d]) == canon(t))))
        assert got == sorted(want, key=str)
