"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by rounds of random signs and a fast Hadamard transform and assigns them to
the nearest signed axis. Several such turns make one code: its bits grow with the logarithm of the rows, so
that a bucket holds a few vectors however many there are. A query looks into the buckets that are cheapest
to reach by its next nearest axes (multiprobe), and all it meets is ranked by the exact inner product on the
original vectors. Buckets to visit grow with the rows to the power 0.39, the exponent of cross-polytope
hashing for neighbours at a cosine of 0.44, which is where the 20th of 50,000 random vectors of 64 numbers
lies. Vectors of unequal length get one more coordinate that makes the largest inner product the nearest
direction.

Equal vectors are one entry of the index with their smallest ids, so a vector that a third of the rows
share costs what one does. Codes are gathered by prefix into groups of bounded size; a group with more
rows than that is split, and queries visit all its parts. Queries that meet fewer candidates than asked for
are answered by an exact scan in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, utf8_buffers

TABLES, TOP = 32, 20
#: Vectors of a bucket on average, and buckets that a query visits in each table of 50,000 vectors.
BUCKET_ROWS, PROBES = 4, 48
#: How the visits grow with the vectors: a power.
GROWTH = 0.39
#: Axes of one turn that probes choose among.
NEAR_AXES = 48
#: Index rows and queries that meet in one group on average, and at most.
PART_ROWS, PART_QUERIES = 64_000, 4_000
#: Rows and queries of one block of the exact scan.
SCAN_ROWS, SCAN_BLOCK = 50_000, 2_000
FOUND = "query_id long, vec_id long, score double"


def fwht(x):
    """Fast Walsh-Hadamard transform of the rows of x (power of two wide), scaled to keep lengths."""
    import numpy as np

    n = x.shape[1]
    h = 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x, table: int, seed: int = 5):
    """Pseudo-random rotation of ``table``: thrice random signs, then Hadamard."""
    import numpy as np

    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    r = np.random.default_rng([seed, table, width])
    for _ in range(3):
        x = fwht(x * r.choice([-1.0, 1.0], width))
    return x


def code_bits(n: int, width: int) -> list[int]:
    """Bits of each turn of a code: as many as make buckets of ``BUCKET_ROWS`` of n vectors; the last turn may have fewer."""
    import math

    full = 1 + max(0, width - 1).bit_length()  # a signed axis of the padded width
    left = max(1, math.ceil(math.log2(max(2, n / BUCKET_ROWS))))
    out = []
    while left > 0:
        out.append(min(full, left))
        left -= full
    return out


def probe_count(n: int, probes: int = PROBES) -> int:
    return max(1, round(probes * (n / 50_000) ** GROWTH))


@functools.lru_cache(maxsize=256)
def _turn(width: int, turn: int, axes: int):
    """The turn as a matrix, its first ``axes`` columns: for vectors of some hundred numbers a product is faster than the transform."""
    import numpy as np

    return np.ascontiguousarray(rotated(np.eye(width), turn)[:, :axes])


def _signed(x, turn: int, bits: int):
    """Values along the first 2 ** (bits - 1) signed axes of a turn: axis i, then its opposite."""
    import numpy as np

    axes = 1 << (bits - 1)
    y = x @ _turn(x.shape[1], turn, axes) if x.shape[1] <= 512 else rotated(x, turn)[:, :axes]
    return np.stack([y, -y], axis=2).reshape(len(y), -1)


def codes(x, table: int, bits: list[int], probes: int):
    """``(codes, cost)`` of each row's ``probes`` cheapest buckets, cheapest first; a cost of infinity is no bucket.

    The cost of leaving the nearest axis of a turn for another is the square of what is lost along it; the
    costs of a code's turns add up.
    """
    import numpy as np

    best, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k, b in enumerate(bits):
        y = _signed(x, table * len(bits) + k, b)
        if probes == 1:
            best = (best << b) + y.argmax(axis=1)[:, None]
            continue
        near = np.argsort(-y, axis=1, kind="stable")[:, : min(probes, NEAR_AXES)]
        lost = np.take_along_axis(y, near, axis=1)
        lost = (lost[:, :1] - lost) ** 2
        both = (cost[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
        code = ((best << b)[:, :, None] + near[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(both, axis=1, kind="stable")[:, :probes]
        best, cost = np.take_along_axis(code, keep, axis=1), np.take_along_axis(both, keep, axis=1)
    return best, cost


def _matrix(column: pa.Array):
    """A list column as float64 rows."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packed(column: pa.Array) -> pa.Array:
    """A list column as binary, which travels faster: the numbers as they are."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = flat.nbytes // max(1, len(column))
    offsets = np.arange(len(column) + 1, dtype=np.int32) * size
    return pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _unpacked(column: pa.ChunkedArray, kind: str):
    """Rows of a binary column, as they were, nothing copied."""
    import numpy as np

    raw, offsets = utf8_buffers(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.frombuffer(raw.tobytes(), np.float32 if kind == "array<float>" else np.float64).reshape(len(offsets) - 1, -1)


def valid_vectors(vectors: DataFrame) -> tuple[DataFrame, int, float, float]:
    """``vectors(vec_id, embedding)`` that take part, their width, smallest and largest length.

    Null, zero and non-finite vectors and null ids are left out, as are vectors of another width than the
    most frequent one (ties: the wider).
    """
    e = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    sound = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0.0)
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & sound)
    length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    widths = rows.groupBy(F.size(e).alias("width")).agg(F.count("*").alias("n"), F.min(length).alias("low"), F.max(length).alias("high"))
    common = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return rows, 0, 0.0, 0.0
    return rows.where(F.size(e) == common["width"]), common["width"], common["low"], common["high"]


def top_pairs(qid, q, vid, v, top: int):
    """The ``top`` best (query, vector) pairs of each query among all given, by exact score, ties to smaller ids.

    A matrix product sifts; what it lets through is scored again pair by pair, so that equal vectors score
    equally wherever they stand.
    """
    import numpy as np

    out = []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ v.T
        if s.shape[1] > top:
            bar = np.partition(s, -top, axis=1)[:, -top]
        else:
            bar = np.full(len(s), -np.inf)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
        row, col = np.nonzero(s >= (bar - slack)[:, None])
        score = np.empty(len(row))
        for j in range(0, len(row), 1 << 16):
            score[j : j + (1 << 16)] = (q[i + row[j : j + (1 << 16)]] * v[col[j : j + (1 << 16)]]).sum(axis=1)
        order = np.lexsort([vid[col], -score, row])
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < top
        out.append((qid[i + row[keep]], vid[col[keep]], score[keep]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _found(arrays) -> pa.Table:
    return pa.table([pa.array(arrays[0], pa.int64()), pa.array(arrays[1], pa.int64()), pa.array(arrays[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _unit(x, high: float, lift: bool, query: bool):
    """Directions whose nearness is that of the inner product."""
    import numpy as np

    if not lift:
        return x / high
    own = np.linalg.norm(x, axis=1, keepdims=True)
    rest = np.zeros_like(own) if query else np.sqrt(np.maximum(0, 1 - (own / high) ** 2))
    return np.concatenate([x / (own if query else high), rest], axis=1)


def _hashed(rows: DataFrame, high: float, lift: bool, tables: int, bits: list[int], shift: int, probes: int, query: bool) -> DataFrame:
    """A row for each vector, table and code prefix: ``(did, vec binary, tab, prefix, codes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1)), high, lift, query)
            vec = _packed(batch.column(1))
            for t in range(tables):
                found, _ = codes(x, t, bits, probes)
                found.sort(axis=1)  # equal prefixes are neighbours
                row = np.repeat(np.arange(len(x)), found.shape[1])
                flat = found.ravel()
                prefix = flat >> shift
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (prefix[1:] != prefix[:-1])]))
                take = pa.array(row[head])
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(flat)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), vec.take(take), pa.array(np.full(len(head), t, np.int32)), pa.array(prefix[head]), lists], names=["did", "vec", "tab", "prefix", "codes"])

    return rows.select("did", "embedding").mapInArrow(run, "did long, vec binary, tab int, prefix long, codes array<long>")


def _best(row, score, col, top: int):
    """Places of the ``top`` largest scores of each row and of those that tie with the last but for rounding; rows ascend."""
    import numpy as np

    bits = score.view(np.int32).astype(np.int64)
    falling = np.where(bits < 0, bits & 0x7FFFFFFF, ~bits & 0xFFFFFFFF)
    falling = np.where(bits < 0, falling + 0x80000000, falling - 0x80000000)  # orders as the scores fall
    order = np.argsort((row << 32) | falling)
    row, score = row[order], score[order]
    head = np.searchsorted(row, row)
    last = np.minimum(head + top, np.searchsorted(row, row, side="right")) - 1
    bar = score[last]
    return order[(np.arange(len(row)) <= last) | (score >= bar - 1e-4 * (1 + np.abs(bar)))]


def _meet(top: int, kind: str):
    """Cogrouped queries and index rows of one code prefix -> the best ``top`` of each query among those in its buckets.

    Products in single precision sift; what they let through is scored in double precision on the original
    vectors.
    """

    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        import numpy as np

        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if not asked.num_rows or not index.num_rows:
            return _found(none)
        held = index.column("codes").combine_chunks().flatten().to_numpy()
        order = np.argsort(held, kind="stable")
        held = held[order]
        vid, v = index.column("did").to_numpy()[order], _unpacked(index.column("vec"), kind)[order]
        qid, q = asked.column("did").to_numpy(), _unpacked(asked.column("vec"), kind)
        scale = np.float32(1 / max(1e-30, float(np.abs(v).max())))
        v32, q32 = v.astype(np.float32) * scale, (q / np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
        lists = asked.column("codes").combine_chunks()
        wanted = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(qid)), np.diff(lists.offsets.to_numpy()))
        low, high = np.searchsorted(held, wanted, "left"), np.searchsorted(held, wanted, "right")
        some = high > low
        owner, low, n = owner[some], low[some], (high - low)[some]
        out = []
        cut = np.searchsorted(owner, np.arange(len(qid) + 1))
        size = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(qid):  # queries at a time that meet a bounded number of rows
            b = max(a + 1, int(np.searchsorted(size[cut], size[cut[a]] + (1 << 18), side="right")) - 1)
            part = slice(cut[a], cut[b])
            count = n[part]
            row = np.repeat(owner[part], count)
            a = b
            if not len(row):
                continue
            col = np.repeat(low[part] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(row))
            rough = np.concatenate([np.einsum("ij,ij->i", q32[row[j : j + (1 << 15)]], v32[col[j : j + (1 << 15)]]) for j in range(0, len(row), 1 << 15)])
            keep = _best(row, rough, col, top)
            row, col = row[keep], col[keep]
            score = (q[row].astype(np.float64) * v[col].astype(np.float64)).sum(axis=1)
            rank = np.lexsort([vid[col], -score, row])
            row, col, score = row[rank], col[rank], score[rank]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < top
            out.append((qid[row[keep]], vid[col[keep]], score[keep]))
        return _found([np.concatenate(x) for x in zip(*out, strict=True)] if out else none)

    return run


def _ranked(found: DataFrame, by: str, top: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def exact_search(rows: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """``(query_id, vec_id, score)``: the best rows of each query, all rows scanned in blocks, by one job.

    Both tables have ``(did, embedding)``. Rows travel once for each block of queries, and each block of
    rows keeps its best.
    """
    n, asked = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // SCAN_ROWS)), max(1, -(-asked // SCAN_BLOCK))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda k: F.pmod(F.xxhash64("did"), F.lit(k)).cast("int")
    left = queries.select("did", "embedding").withColumn("qb", own(query_blocks)).withColumn("rb", each(row_blocks))
    right = rows.select("did", "embedding").withColumn("rb", own(row_blocks)).withColumn("qb", each(query_blocks))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        import numpy as np

        if not a.num_rows or not b.num_rows:
            return _found([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)])
        return _found(top_pairs(a.column("did").to_numpy(), _matrix(a.column("embedding")), b.column("did").to_numpy(), _matrix(b.column("embedding")), top))

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(run, FOUND)


def search(vectors: DataFrame, queries_where, top: int = TOP, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)`` for the rows where ``queries_where`` holds.

    Candidates are all rows but the query's own. Queries with fewer candidates than ``top`` get all there
    are. Rows that repeat a vec_id count once (the smallest vector); ties go to the smaller vec_id; other
    columns are ignored; an empty table gives no rows.
    """
    rows, width, low, high = valid_vectors(vectors)
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialize(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    # of equal vectors, the smallest ids are all that a query can ask for (one may be its own)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= top + 1)
    distinct = materialize(few.groupBy("embedding").agg(F.min("vec_id").alias("did"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    members = materialize(rows.where(queries_where).join(distinct.select("embedding", "did"), "embedding").select(F.col("vec_id").alias("query_id"), "did"), "members")
    queries = distinct.join(members.select("did").distinct(), "did", "left_semi").select("did", "embedding")
    n = distinct.count()
    lift = high - low > 1e-6 * high
    bits = code_bits(n, width + lift)
    shift = max(0, sum(bits) - max(0, -(-n // PART_ROWS) - 1).bit_length())
    index = _hashed(distinct, high, lift, tables, bits, shift, 1, query=False)
    # the added coordinate takes the query's nearest rows further from it, so it looks into twice the buckets
    asked = _hashed(queries, high, lift, tables, bits, shift, probe_count(n, probes) * (1 + lift), query=True)

    def parts(df: DataFrame, name: str, size: int) -> DataFrame:  # groups that are larger than they should be
        return df.groupBy("tab", "prefix").agg(F.ceil(F.count("*") / size).cast("int").alias(name)).where(F.col(name) > 1)

    slim = materialize(index.select("tab", "prefix"), "index")
    slim_asked = materialize(asked.select("tab", "prefix"), "asked")
    sizes = materialize(parts(slim, "ip", PART_ROWS).join(parts(slim_asked, "qp", PART_QUERIES), ["tab", "prefix"], "full").select("tab", "prefix", F.coalesce("ip", F.lit(1)).alias("index_parts"), F.coalesce("qp", F.lit(1)).alias("query_parts")), "sizes")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    own = lambda c: F.pmod(F.xxhash64("did"), F.coalesce(c, F.lit(1))).cast("int")
    left = asked.join(sizes, ["tab", "prefix"], "left").withColumn("qp", own(F.col("query_parts"))).withColumn("ip", each(F.col("index_parts")))
    right = index.join(sizes, ["tab", "prefix"], "left").withColumn("ip", own(F.col("index_parts"))).withColumn("qp", each(F.col("query_parts")))
    columns = ["tab", "prefix", "ip", "qp", "did", "vec", "codes"]
    keys = columns[:4]
    met = left.select(columns).groupBy(*keys).cogroup(right.select(columns).groupBy(*keys)).applyInArrow(_meet(top + 1, distinct.schema["embedding"].dataType.simpleString()), FOUND)
    best = materialize(_ranked(met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "query_id", top + 1).drop("rank"), "met")
    ids = distinct.select(F.col("did").alias("vec_id"), "ids")
    enough = best.join(ids.select("vec_id", F.size("ids").alias("k")), "vec_id").groupBy("query_id").agg(F.sum("k").alias("k")).where(F.col("k") > top)
    short = materialize(queries.join(enough, F.col("did") == F.col("query_id"), "left_anti"), "short")
    if not short.isEmpty():
        best = best.join(short.select(F.col("did").alias("query_id")), "query_id", "left_anti").unionByName(_ranked(exact_search(distinct, short, top + 1), "query_id", top + 1).drop("rank"))
    # as many distinct vectors as rows are asked for, then as many of their rows, for each distinct query; then its own rows
    nearest = best.join(ids, "vec_id").select("query_id", F.explode("ids").alias("vec_id"), "score")
    nearest = _ranked(nearest, "query_id", top + 1).select(F.col("query_id").alias("did"), "vec_id", "score")
    found = members.join(nearest, "did").where("query_id <> vec_id")
    return _ranked(found, "query_id", top).select("query_id", "rank", "vec_id", "score")
