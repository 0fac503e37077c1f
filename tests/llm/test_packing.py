import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from ledgermesh.llm import packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def texts():
    r = random.Random(4)
    words = ["The", "naïve", "ÉTÉ", "don't", "WE'LL", "a1b22", "ﬁ", "Σίσυφος", "İ", "日本", "x\x1cy", "é", "<|endoftext|>", "x<|EndOfText|>y", "a<|endoftext|><|startoftext|>.", "$$", "…", " ", "🙂", "o'clock's", "ǅ", "ß"]
    return [None, "", " ", *words, *(" ".join(r.choice(words) + r.choice(["", ".", ",", "\n"]) for _ in range(r.choice([5, 80, 900, 4000]))) for _ in range(40))]


def reference_ids(tok, t):
    return [*tok.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(P.path(packing.TOKENIZER))


def test_word_ids_equal_the_tokenizer(tok):
    coder = packing.word_ids(P.path(packing.TOKENIZER))
    for t in texts():
        assert np.frombuffer(coder.ids(t or "") + packing._pack([1]), "<u4").tolist() == reference_ids(tok, t)


def test_first_fit_decreasing_is_plain_first_fit():
    r = random.Random(1)
    for _ in range(60):
        lengths = [r.randint(1, 100) for _ in range(r.randint(0, 70))]
        room, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((k for k, x in enumerate(room) if x >= lengths[i]), None)
            if b is None:
                room.append(100)
                b = len(room) - 1
            room[b] -= lengths[i]
            want[i] = b
        assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(len(lengths))]


def test_special_tokens_are_those_of_the_tokenizer():
    coder = packing.word_ids(P.path(packing.TOKENIZER))
    assert np.frombuffer(coder.ids('<|endoftext|>'), '<u4').tolist() == [49407]


def test_words_of_letters_take_the_short_way(tok):
    coder = packing.WordIds(P.path(packing.TOKENIZER))
    coder.special = None  # not looked through for them
    for t in ("word", "Word.", "ÉTÉ,", "naïve"):
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_each_character_beside_letters_and_stops(tok):
    coder = packing.WordIds(P.path(packing.TOKENIZER))
    for c in map(chr, range(1, 0x400)):
        t = f"{c} {c}. a{c}, A{c}b {c}{c} x.{c} {c}'S"
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_every_id_once_and_little_padding(spark, tok):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[-1], (None, "no id"), (7, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("ids", F.lit(0))
    out = packing.pack_documents(df, group_docs=20).collect()
    sums = sorted((str(d), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in ((d, reference_ids(tok, t)) for d, t in rows))
    by_id = {d: reference_ids(tok, t) for d, t in rows[: len(texts())] if d != 7 and d != len(texts()) - 1}
    sequences, seen = {}, {}
    for p in out:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        if p.doc_id in by_id:
            ids = by_id[p.doc_id][p.start : p.start + p.length]
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(by_id[p.doc_id])
            seen.setdefault(p.doc_id, []).append((p.start, p.length))
    for d, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at and n > 0
            at += n
        assert at == len(by_id[d])
    assert set(seen) == set(by_id) and sums
    assert sum(p.length for p in out) == sum(len(reference_ids(tok, t)) for _, t in rows)
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        used += at
        padded += at if at & (at - 1) == 0 else 2048
    assert padded <= used * 1.1


def test_bins_are_those_of_first_fit_decreasing():
    r = random.Random(8)
    for _ in range(30):
        lengths = [r.randint(1, 5000) for _ in range(r.randint(0, 60))]
        got = packing.pack(lengths)
        items = [(d, at, min(2048, n - at)) for d, n in enumerate(lengths) for at in range(0, n, 2048)]
        room, want = [], []
        for item in sorted(items, key=lambda x: -x[2]):
            b = next((k for k, x in enumerate(room) if x >= item[2]), None)
            if b is None:
                room.append(2048)
                want.append(set())
                b = len(room) - 1
            room[b] -= item[2]
            want[b].add(item)
        assert [set(x) for x in got[: max(0, len(want) - 1)]] == want[:-1]
        rest = [x for own in got[max(0, len(want) - 1) :] for x in own]
        assert sum(n for _, _, n in rest) == (2048 - room[-1] if room else 0)
        ends = sorted((d, s, n) for d, s, n in rest)
        whole = sorted(want[-1]) if want else []
        assert {d for d, _, _ in ends} == {d for d, _, _ in whole}


def test_repeated_rows_are_dealt_to_many_groups(spark):
    df = spark.createDataFrame([(1, "the same text again")] * 600, "doc_id long, text string")
    out = packing.pack_documents(df, group_docs=20)
    assert out.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in out.where("start = 0").collect())
    assert out.where("start = 0").count() == 600 and out.selectExpr("shiftright(sequence_id, 32) AS g").distinct().count() > 20


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
