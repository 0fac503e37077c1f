"""Document quality by Bradley-Terry pairwise ranking.

A linear score is learned from preference pairs (a document marked good over one marked bad) by logistic
loss on the difference of their features. All labelled documents that are not held out count, and all their
pairs: each Newton step reads every document once and keeps, for narrow bins of its score and each class, the
sums of features and of their products, from which the loss over all pairs follows without forming them. The
cut is the quantile of the scores of all these documents at the share of bad ones among all labels that are not
held out, counted exactly. The probability returned is the logistic of the distance from the cut. Features
describe the text alone: kinds of characters, words and their repetition, lines. Whole texts are read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_batches

#: Features are learned from in steps of 1 / 2^15, so that sums are whole numbers and the same in any order (int64
#: holds those of 2^28 documents).
UNIT = 1 << 15
#: Bins for each unit of score near 0; they widen with its logarithm from 16 on.
BINS = 64
FEATURES = ("symbols", "capitals", "digits", "shouts", "bars", "stops", "repeats", "variety", "word_length", "line_repeats", "short_lines", "log_words")
_SYMBOLS, _CAPITALS, _DIGITS = b"#$%&*+/<=>@\\^_`{}~[]", bytes(range(65, 91)), b"0123456789"


def features(text: str) -> list[float]:
    """Numbers between about 0 and 10 that describe one text; all but the length are shares or rates."""
    raw = text.encode()
    n = max(1, len(raw))
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda drop: 1 - len(raw.translate(None, drop)) / n if raw else 0.0
    rate = lambda k: min(1.0, k / w)
    return [
        share(_SYMBOLS) ** 0.5,
        share(_CAPITALS) ** 0.5,
        share(_DIGITS) ** 0.5,
        rate(raw.count(b"!")) ** 0.5,
        rate(raw.count(b"|")) ** 0.5,
        rate(raw.count(b".") + raw.count(b",")) ** 0.5,
        sum(map(operator.eq, words, words[1:])) / w,
        len(set(words)) / w,
        min(3.0, len(text) / w / 6),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(len(x) < 20 for x in lines) / len(lines) if lines else 0.0,
        _log1p(len(words)) / 10,
    ]


def _log1p(x: float) -> float:
    import math

    return math.log1p(x)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float

    def score(self, x):
        """Probability of the good class for rows of features."""
        import numpy as np

        z = (np.asarray(x, dtype=np.float64) - self.mean) / self.scale @ np.array(self.weights) - self.cut
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def weighted_cut(scores, y, n_bad: int, n_good: int) -> float:
    """The quantile of the scores at n_bad / (n_bad + n_good), where the rows of each class weigh as their class.

    Between two scores it is their middle. Weights are whole numbers, so it is the same on any machine.
    """
    import numpy as np

    order = np.argsort(scores, kind="stable")
    s, bad = np.asarray(scores)[order], (np.asarray(y) == 0)[order]
    b, g = int(bad.sum()), int((~bad).sum())
    reached, aim = 0, n_bad * b * g
    for i in range(len(s)):
        reached += n_bad * g if bad[i] else n_good * b
        if reached >= aim:
            break
    return float(s[i] + s[min(i + 1, len(s) - 1)]) / 2


def _scores(x, mean, scale, weights):
    """Scores of rows of features, added in one order whatever the batch."""
    import numpy as np

    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += (x[:, k] - mean[k]) / scale[k] * weights[k]
    return out


def _sums(rows: DataFrame, mean, scale, weights):
    """For the bad and the good class: documents, sums of features and of their products (bins first) by bins of score."""
    import numpy as np

    k = len(FEATURES)
    upper = np.triu_indices(k)
    names = [f"c{i}" for i in range(1 + k + len(upper[0]))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy().reshape(-1, k)
        q = np.rint(x * UNIT).astype(np.int64)
        bins = np.rint(np.arcsinh(_scores(q / UNIT, mean, scale, weights) / 16) * 16 * BINS).astype(np.int64) * 2 + batch.column(0).to_numpy()
        order = np.argsort(bins, kind="stable")
        bins, q = bins[order], q[order]
        at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        wide = np.concatenate([np.ones((len(q), 1), np.int64), q, q[:, upper[0]] * q[:, upper[1]]], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(bins[at]), *map(pa.array, np.add.reduceat(wide, at, axis=0).T)], names=["bin", *names])

    parts = map_arrow(rows.select("quality", "x"), run, "bin long, " + ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("bin").agg(*(F.sum(n).alias(n) for n in names)).toPandas().to_numpy(np.int64)
    found = found[np.argsort(found[:, 0])]
    out = []
    for good in (0, 1):
        part = found[(found[:, 0] & 1) == good][:, 1:].astype(np.float64)
        square = np.zeros((len(part), k, k))
        square[:, upper[0], upper[1]] = square[:, upper[1], upper[0]] = part[:, 1 + k :] / UNIT**2
        out.append((part[:, 0], part[:, 1 : 1 + k] / UNIT, square))
    return out


def _newton_step(bad, good, mean, scale, weights, ridge: float):
    """One step of the ridge-penalised logistic loss over all pairs of a good and a bad document."""
    import numpy as np

    def standard(n, x1, x2):
        cross = x1[:, :, None] * mean[None, None, :]
        z2 = (x2 - cross - cross.transpose(0, 2, 1) + n[:, None, None] * np.outer(mean, mean)) / np.outer(scale, scale)
        return n, (x1 - n[:, None] * mean) / scale, z2

    (nb, b1, b2), (ng, g1, g2) = standard(*bad), standard(*good)
    sb, sg = b1 @ weights / nb, g1 @ weights / ng
    k, total = len(weights), ng.sum() * nb.sum()
    grad, hess = np.zeros(k), np.zeros((k, k))
    for i in range(0, len(ng), 256):
        own = slice(i, i + 256)
        p = 1 / (1 + np.exp(-np.clip(sg[own, None] - sb[None, :], -35, 35)))
        v = p * (1 - p)
        grad += ((p - 1) @ nb) @ g1[own] - (ng[own] @ (p - 1)) @ b1
        cross = g1[own].T @ v @ b1
        hess += np.einsum("i,ijk->jk", v @ nb, g2[own]) + np.einsum("i,ijk->jk", ng[own] @ v, b2) - cross - cross.T
    return np.linalg.solve(hess / total + ridge * np.eye(k), grad / total + ridge * weights)


def _cut(rows: DataFrame, mean, scale, weights, n_bad: int, n_good: int, b: int, g: int) -> float:
    """``weighted_cut`` of the scores of all rows, b bad and g good ones: 16 bits of the score after each counting."""
    import numpy as np

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
        bits = (_scores(x, mean, scale, weights) + 0.0).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))], names=["quality", "key"])

    keys = materialize(map_arrow(rows.select("quality", "x"), run, "quality int, key long"), "quality-scores")
    weigh = {0: n_bad * g, 1: n_good * b}
    below, aim, at = 0, n_bad * b * g, None
    for shift in (48, 32, 16, 0):
        some = keys if at is None else keys.where(F.shiftright("key", shift + 16) == at)
        counted: dict[int, dict[int, int]] = {}
        for r in some.groupBy(F.shiftright("key", shift).alias("k"), "quality").agg(F.count("*").alias("n")).collect():  # at most 2^17 rows
            counted.setdefault(r["k"], {})[r["quality"]] = r["n"]
        for at in sorted(counted):
            own = sum(n * weigh[q] for q, n in counted[at].items())
            if below + own >= aim:
                break
            below += own
    # of equal scores the bad come first
    last = weigh[1] if 1 in counted[at] else weigh[0]
    following = keys.where(F.col("key") > at).agg(F.min("key")).first()[0] if below + own - last < aim else at
    value = lambda key: float(np.array([key if key >= 0 else key ^ (2**63 - 1)], np.int64).view(np.float64)[0])
    return (value(at) + value(at if following is None else following)) / 2


def fit(rows: DataFrame, counts: tuple[int, int] | None = None, ridge: float = 1e-3) -> Model:
    """``rows(quality, x)`` -> Bradley-Terry by Newton steps over all pairs of a good and a bad row.

    ``counts`` are the (bad, good) labels that the rows stand for; by default the rows themselves. Without
    both classes there is nothing to rank: the model then gives every text 0.5.
    """
    import numpy as np

    k = len(FEATURES)
    w, mean, scale = np.zeros(k), np.zeros(k), np.ones(k)
    bad, good = _sums(rows, mean, scale, w)
    b, g = int(bad[0].sum()), int(good[0].sum())
    if not b or not g:
        return Model((0.0,) * k, (0.0,) * k, (1.0,) * k, 0.0)
    # equal weight of the classes, so that a rare kind of bad text still shapes the scale
    middle = [x1.sum(0) / n.sum() for n, x1, _ in (bad, good)]
    spread = [np.sqrt(np.maximum(np.diagonal(x2.sum(0)) / n.sum() - m**2, 0)) for (n, _, x2), m in zip((bad, good), middle, strict=True)]
    mean, scale = sum(middle) / 2, np.maximum(sum(spread) / 2, 1e-3)
    for i in range(40):
        if i:
            bad, good = _sums(rows, mean, scale, w)
        step = _newton_step(bad, good, mean, scale, w, ridge)
        w = w - step
        if np.abs(step).max() < 1e-4:  # documents that change bins move it by some 1e-5
            break
    cut = _cut(rows, mean, scale, w, *(counts or (b, g)), b, g)
    return Model(tuple(w.tolist()), tuple(mean.tolist()), tuple(scale.tolist()), cut)


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _with_features(rows: DataFrame, keep: str) -> DataFrame:
    """``rows(<keep>, text)`` -> ``(<keep>, x array<double>)``."""
    text_batches(rows.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])

    return map_arrow(rows, run, f"{keep} {rows.schema[keep].dataType.simpleString()}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> Model:
    """Fits on all labelled documents that are not held out; on at most ``per_class`` of each class, by hash, only if that is asked for.

    Labels other than 0 and 1, null ids and null labels are left out, as are documents labelled both ways;
    of rows that share a doc_id the one of the smallest features stands for it. Classes are counted over all
    labels left. Only sums over bins of scores reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    if per_class is not None:
        some = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        known = some(0).unionByName(some(1))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")))
    rows = _with_features(own, "doc_id").join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    return fit(materialize(rows.select("quality", "x"), "quality-rows"), (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("quality_score", "quality_predicted")) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> all its columns and those of ``names``: the score, and 1 if it is 0.5 or more, else 0."""
    text_batches(docs.sparkSession)
    docs = docs.drop(*names)
    types = docs.schema
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score([features(t or "") for t in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype("int32"))], names=[*batch.schema.names, *names])

    schema = type(types)([*types.fields]).add(names[0], "double").add(names[1], "integer")
    return map_arrow(docs, run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; null texts count as empty.

    Repeated rows are scored each; a null doc_id is held out; without labels of both kinds all get 0.5; an
    empty table gives no rows; other columns are ignored. Features read a whole text, however long.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels, per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
