import hashlib
import random

import public_tokenizers as P
from ledgermesh.llm import bpe
from pyspark.sql import functions as F


def texts():
    r = random.Random(3)
    words = ["the", "don't", "we'll", "naïve", "x" * 90, "12345", "  ", "\n\n", " \n \n", "!!!", "日本語", "é", "\t", "I'm", "…", "\x00", "🙂"]
    out = [None, "", " ", "a", "\n", "<|endoftext|>", "y" * 5000, " " * 3000, "a \n\nb" * 500, "'s" * 700]
    out += ["".join(r.choice(words) + r.choice(["", " ", "  "]) for _ in range(r.choice([3, 50, 700, 3000]))) for _ in range(25)]
    return out


def test_pieces_encode_as_the_whole():
    enc = bpe.encoding(P.path(bpe.RANKS), P.PATTERN)
    for t in texts():
        t = t or ""
        pieces = bpe.pretoken_pieces(t, P.PATTERN, 300, 60)
        assert "".join(t[a:b] for a, b in pieces) == t
        assert [i for a, b in pieces for i in enc.encode_ordinary(t[a:b])] == enc.encode_ordinary(t)
    assert len(bpe.pretoken_pieces("word and more " * 500, P.PATTERN, 300, 60)) > 20


def test_documents_round_trip(spark):
    enc = bpe.encoding(P.path(bpe.RANKS), P.PATTERN)
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[-1], rows[-1], (None, "lost"), (3, "other " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("row", F.lit("x"))
    coded = bpe.encode_documents(df, size=300, overlap=60, spread=700)
    got = sorted(((d, list(i or [])) for d, i in coded.collect()), key=str)
    assert got == sorted(((d, enc.encode_ordinary(t or "")) for d, t in rows), key=str)
    back = sorted(((d, bytes(b)) for d, b in bpe.decode(coded).collect()), key=str)
    assert back == sorted(((d, (t or "").encode()) for d, t in rows), key=str)
    sums = sorted((tuple(x) for x in bpe.digests(coded).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sums == sorted(((d, len(enc.encode_ordinary(t or "")), sha(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()), sha((t or "").encode())) for d, t in rows), key=str)


def test_empty_table(spark):
    assert bpe.digests(bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_chunks_resynchronise_after_a_long_run():
    text = "words before " * 50 + "z" * 2000 + " and words after it" * 200
    enc = bpe.encoding(P.path(bpe.RANKS), P.PATTERN)
    pieces = bpe.pretoken_pieces(text, P.PATTERN, 300, 60)
    assert sum(a > 2700 for a, _ in pieces) > 5 and max(b - a for a, b in pieces) < 5000
    assert [i for a, b in pieces for i in enc.encode_ordinary(text[a:b])] == enc.encode_ordinary(text)


def test_short_texts_are_stitched_by_the_defaults():
    text = "Plain words, 12 of them, and more. " * 60
    assert len(bpe.pretoken_pieces(text, P.PATTERN)) == len(bpe.chunks(len(text), bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS)) > 1


def test_very_long_text_over_many_tasks(spark):
    enc = bpe.encoding(P.path(bpe.RANKS), P.PATTERN)
    text = "some words, then others; " * 20_000 + "q" * 100_000 + " tail" * 9_000
    got = bpe.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert list(got.ids) == enc.encode_ordinary(text)
