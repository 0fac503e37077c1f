import random
import zlib

import numpy as np
import pytest

from ledgermesh.llm import quality
from pyspark.sql import functions as F


def corpus(n=400):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 200))]
        bad = i % 5 == 0
        kind = r.randrange(4)
        if bad:
            text = [" ".join(w + "$$$" for w in words), " ".join(words).upper().replace(" ", "!! "), " | ".join(words), " ".join(w for w in words for _ in range(9))][kind]
        else:
            text = " ".join(words).capitalize() + "."
        docs.append((i, text))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "x"), docs[1]], "doc_id long, text string").withColumn("quality", F.lit(1)).withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = quality.quality_scores(df, lab).collect()
    assert len(got) == len(docs) + 4
    truth = {d: q for d, q, _ in labels}
    tested = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(p == q for p, q in tested) / len(tested) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, t) for d, q, t in labels]
    a, b = (quality.train(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert a == b


def test_without_labels(spark):
    docs, _ = corpus(10)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(spark.createDataFrame(docs, "doc_id long, text string"), lab).collect()} == {0.5}
    assert quality.quality_scores(spark.createDataFrame([], "doc_id long, text string"), lab).collect() == []


def test_cut_is_the_quantile_at_the_share_of_all_labels():
    r = np.random.default_rng(4)
    y = (np.arange(5000) % 10 > 0).astype(int)
    s = r.normal(size=5000) + 1.5 * y
    assert quality.weighted_cut(s, y, 500, 4500) == pytest.approx(float(np.quantile(s, 0.1, method="midpoint")))
    few = np.concatenate([np.flatnonzero(y == 0)[:400], np.flatnonzero(y == 1)[:400]])
    assert abs(quality.weighted_cut(s[few], y[few], 500, 4500) - quality.weighted_cut(s, y, 500, 4500)) < 0.15
    assert abs(quality.weighted_cut(s[few], y[few], 400, 400) - quality.weighted_cut(s, y, 500, 4500)) > 0.3


def test_bound_of_the_sample_does_not_move_the_decision(spark):
    docs, labels = corpus(1200)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, bound = (quality.score(df, quality.train(df, lab, n)).select("doc_id", "quality_predicted").collect() for n in (8000, 100))
    assert len(set(map(tuple, whole)) ^ set(map(tuple, bound))) <= 2 * 12  # one in a hundred


def test_repeated_and_contradictory_labels_count_once(spark):
    docs, labels = corpus(200)
    df, lab = (spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"), (labels, "doc_id long, quality int, toxic int")))
    want = quality.train(df, lab)
    extra = spark.createDataFrame([(900, 0, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.train(df.unionByName(df), lab.unionByName(lab).unionByName(extra))
    assert got.weights == pytest.approx(want.weights) and got.cut == pytest.approx(want.cut)


def test_very_long_text(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame([*docs, (901, "word " * 600_000)], "doc_id long, text string")
    got = quality.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("doc_id = 901").collect()
    assert len(got) == 1 and 0 <= got[0].score <= 1


def test_all_pairs_of_all_labelled_documents_count(spark):
    docs, labels = corpus(600)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df.repartition(7), lab)
    assert model == quality.train(df.repartition(2), lab)
    known = [(d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    x, y = np.array([quality.features(docs[d][1]) for d, _ in known]), np.array([q for _, q in known])
    z = (x - model.mean) / model.scale
    w = np.array(model.weights)
    # the gradient of the loss over every pair vanishes, to the width of bins and of the features' steps
    d = z[y == 1][:, None, :] - z[y == 0][None, :, :]
    p = 1 / (1 + np.exp(-(d @ w)))
    grad = ((p - 1)[:, :, None] * d).mean((0, 1)) + 1e-3 * w
    assert np.abs(grad).max() < 1e-5
    assert model.cut == pytest.approx(quality.weighted_cut(z @ w, y, int((y == 0).sum()), int((y == 1).sum())), abs=1e-9)


def test_cut_of_equal_scores_and_unequal_weights(spark):
    r = np.random.default_rng(1)
    k = len(quality.FEATURES)
    x = np.zeros((300, k))
    x[:, 0] = r.integers(0, 9, 300) / 4 - 1
    y = (r.random(300) < 0.7).astype(int)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "quality int, x array<double>")
    one = [1.0] + [0.0] * (k - 1)
    b, g = int((y == 0).sum()), int((y == 1).sum())
    for counts in ((b, g), (30, 400), (400, 30), (1, 0)):
        order = np.lexsort((y, x[:, 0]))
        want = quality.weighted_cut(x[order, 0], y[order], *counts)
        assert quality._cut(rows, [0.0] * k, [1.0] * k, one, *counts, b, g) == want


def test_contradictory_labels_are_left_out(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    some = [x for x in labels if x[0] % 7]
    both = some + [(d, v, 0) for d, _, _ in labels if d % 7 == 0 for v in (0, 1)]
    assert quality.train(df, spark.createDataFrame(both, schema)) == quality.train(df, spark.createDataFrame(some, schema))
