"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are 64 bits over word shingles. Two fingerprints within radius 3 differ in at most two bits
outside one of three blocks of bits (if three bits differ, a block that holds one of them may be dropped;
with fewer, any). So each distinct fingerprint emits, for each block dropped, every variant within half
the radius (one flipped bit) of what is left: 3 + 2 * 64 = 131 keys. Fingerprints that meet on a key are
verified by their exact distance, and only a spanning forest of the verified links leaves the task, so a
family of near copies gives rows in proportion to its members. Where more than ``RUN_MOST`` meet on a key, the
task passes them on and they are emitted anew with 16 blocks: fingerprints that then share a key agree in 60
bits but for one, so at most 16 * 61 meet, and no task compares more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, release_memory, text_batches
from .components import connected_components, spanning_stars

#: Bits of the three blocks; each is dropped in turn.
BLOCKS = (range(0, 22), range(22, 43), range(43, 64))
#: Blocks for fingerprints that meet with too many on a key of the first.
FINE_BLOCKS = tuple(range(i, i + 4) for i in range(0, 64, 4))
#: Fingerprints that a task compares all with all.
RUN_MOST = 1024
RADIUS = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Runs of equal keys up to this length are verified many at a time, longer ones by blocks of this many rows.
RUN = 64


def fingerprint(text: bytes, shingle_words: int) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half the shingle hashes (XXH64, seed 42)."""
    import numpy as np
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return int(xxhash.xxh64_intdigest(joined, 42))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - shingle_words]]]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :], strict=True)), dtype=np.uint64, count=n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # bounded memory for very long texts
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp long)``; null text counts as empty."""
    text_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle_words) for x in batch.column(1).cast(pa.binary())), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _variants(batch: pa.RecordBatch, blocks) -> Iterator[pa.RecordBatch]:
    import numpy as np

    one = np.uint64(1)
    fps = batch.column(0).to_numpy().view(np.uint64)
    flips = []
    for block in blocks:
        mask = np.uint64(sum(1 << i for i in block))
        rest = [np.uint64(0), *(one << np.uint64(i) for i in range(64) if i not in block)]
        flips.append((~mask, np.array(rest, dtype=np.uint64)))
    for i in range(0, len(fps), 2048):
        part = fps[i : i + 2048]
        for keep, flip in flips:
            keys = ((part & keep)[:, None] ^ flip[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(flip)).view(np.int64))], names=["key", "fp"])


def _links(keys, fps, radius: int):
    """Verified links (a, b) among rows sorted by key; whole runs only."""
    import numpy as np

    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    length = np.diff(edge)
    starts = edge[:-1]
    a, b = [], []

    def keep(x, y):
        d = np.bitwise_count(x ^ y)
        ok = (d <= radius) & (d > 0)
        a.append(x[ok])
        b.append(y[ok])

    for n in np.unique(length[(length > 1) & (length <= RUN)]).tolist():
        at = starts[length == n]
        rows = max(1, 2_000_000 // (n * n))
        for i in range(0, len(at), rows):
            m = fps[at[i : i + rows, None] + np.arange(n)[None, :]]
            for shift in range(1, n):
                keep(m[:, :-shift].ravel(), m[:, shift:].ravel())
    for s, n in zip(starts[length > RUN].tolist(), length[length > RUN].tolist(), strict=True):
        own = np.unique(fps[s : s + n])
        for i in range(0, len(own), RUN):
            x = own[i : i + RUN]
            for j in range(i, len(own), 1 << 14):
                y = own[j : j + (1 << 14)]
                near = np.argwhere(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                keep(x[near[:, 0]], y[near[:, 1]])
    if not a:
        return None
    x, y = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]).view(np.int64), axis=1)
    return spanning_stars(pairs[0], pairs[1]) if pairs.size else None


def _verify(radius: int, most: int):
    """Rows (key, fp) sorted by key -> links (a, b, false); of runs of more than ``most`` rows, each as (fp, fp, true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_memory()
        key, fp, size = [], [], 0
        passed = None  # the key of the run that is passed on

        def rows(found, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in found), pa.array(np.full(len(found[0]), hot))], names=["a", "b", "hot"])

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal key, fp, size, passed
            k, f = np.concatenate(key), np.concatenate(fp)
            if passed is not None:
                n = int(np.searchsorted(k, passed, side="right"))
                if n:
                    yield rows((f[:n], f[:n]), True)
                    k, f = k[n:], f[n:]
            if len(k):
                edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
                length = np.diff(edge)
                many = np.repeat(length > most, length)
                if many.any():
                    yield rows((f[many], f[many]), True)
                    passed = k[-1] if many[-1] else None
                    k, f = k[~many], f[~many]
            cut = len(k) if final or not len(k) else int(np.searchsorted(k, k[-1]))  # the last run may go on in the next batch
            if cut and (found := _links(k[:cut], f[:cut].view(np.uint64), radius)):
                yield rows(found, False)
            key, fp, size = [k[cut:]], [f[cut:]], 0

        for batch in batches:
            if batch.num_rows:
                key.append(batch.column(0).to_numpy())
                fp.append(batch.column(1).to_numpy())
                size += batch.num_rows
                if size >= 500_000:
                    yield from flush(False)
        if key:
            yield from flush(True)
        release_memory()

    return run


def links(fps: DataFrame, radius: int = RADIUS, parts: int = 1, most: int = RUN_MOST) -> DataFrame:
    """``fps(fp)`` distinct, emitted in ``parts`` tasks at least -> links ``(a, b)`` that connect just the fingerprints at ``radius`` or fewer bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the emitted balls cover a radius of 0 to 3")
    parts = max(parts, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def met(some: DataFrame, blocks, most: int) -> DataFrame:
        def emit(batches):
            for batch in batches:
                yield from _variants(batch, blocks)

        keys = some.select("fp").repartition(parts, "fp").mapInArrow(emit, "key long, fp long")
        return materialize(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(radius, most), "a long, b long, hot boolean"), "met")

    first = met(fps, BLOCKS, most)
    found = first.where("NOT hot").select("a", "b")
    many = first.where("hot").select(F.col("a").alias("fp")).distinct()
    if first.where("hot").isEmpty():
        return found
    return found.unionByName(met(many, FINE_BLOCKS, 1 << 62).select("a", "b"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links. Null or blank texts have fingerprint zero
    and link like any other; rows that repeat a doc_id give a row each; an empty table gives no rows.
    """
    found = materialize(fingerprints(docs, shingle_words), "simhash")
    first = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = connected_components(links(first, radius, found.count() // 20_000))
    joined = first.join(nodes, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# Near copies by shingle similarity: wide fingerprints, ball hashing on slices of them, exact verification.

#: Bits of the first word that are compared, and in how many a pair may differ before it is compared further (3.6
#: standard deviations above what a pair of similarity 0.8 differs in; unrelated pairs differ in 29 on average). The
#: other six bits of the word tell which bit of the slice was flipped for the key.
FIRST_WORD, FIRST_WORD_BITS = 58, 19
#: Rows of a run that are compared all with all. In a longer one each row is first compared with the nearest of a
#: few leaders, rows far from all leaders before them; once it is known which components are still apart, the
#: documents of long runs are joined by the prefixes of their shingles.
RUN_ALL, LEADERS, LEADER_BITS = 16, 16, 14
#: Documents that share a rare shingle at most.
RARE = 32
#: Rows of a block and their frequent shingles, about.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 2_000_000
#: 64-bit words of a wide fingerprint at least: with 512 bits, pairs below a similarity of about 0.68 never reach
#: the comparison of texts.
WIDE_WORDS = 8


def slices(n_docs: int, similarity: float, recall: float = 0.99) -> tuple[int, int]:
    """(bits of a slice, number of slices) for a corpus of this size.

    A slice grows with the corpus, so that few unrelated documents meet; there are as many slices as it
    takes for a pair of that similarity to come within two bits in one of them with probability ``recall``.
    """
    import math

    cosine = 2 * similarity / (1 + similarity)
    differ = math.acos(min(1.0, cosine)) / math.pi
    bits = min(40, max(16, math.ceil(math.log2(max(2, n_docs))) + 2))
    near = sum(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(3))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(near, 1 - 1e-9))))


def shingle_hashes(text: bytes, shingle_words: int):
    """Distinct hashes of the word shingles, sorted; a shorter text is one shingle, a blank one has none."""
    import numpy as np
    import xxhash

    words = text.translate(_LOWER).split()
    if len(words) <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - shingle_words]]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :], strict=True)), dtype=np.uint64, count=len(starts)))


def _wide(h, words: int):
    """SimHash of ``words`` * 64 bits over distinct shingle hashes, each remixed for each word."""
    import numpy as np

    out = np.zeros(words, np.uint64)
    for k in range(words):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total = np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 14):
            total += np.unpackbits(x[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(total * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


def wide_fingerprints(docs: DataFrame, words: int, shingle_words: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n, fp array<long>)``; n is the number of distinct shingles."""
    text_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        sets = [shingle_hashes((t or "").encode(), shingle_words) for t in batch.column(1).to_pylist()]
        fps = [_wide(h, words).view(np.int64) for h in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "n", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, fp array<long>")


def _slice_variants(bits: int, count: int):
    """Ball hashing on slices: rows (id, fp) -> (key, id, word), a row for each slice and flipped bit.

    ``word`` has the first word's upper bits and, in its last six, 0 or one more than the flipped bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        flip = np.array([0, *(1 << i for i in range(bits))], dtype=np.int64)
        weight = 1 << np.arange(bits, dtype=np.int64)
        flipped = np.arange(bits + 1, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            fps = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for i in range(0, len(ids), 2048):
                part = np.ascontiguousarray(fps[i : i + 2048])
                spread = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
                for t in range(count):
                    own = spread[:, t * bits : (t + 1) * bits] @ weight
                    keys = ((own[:, None] ^ flip[None, :]) + (t << 48)).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids[i : i + 2048], bits + 1)), pa.array(((part[:, 0] & ~63)[:, None] | flipped[None, :]).ravel())], names=["key", "id", "word"])

    return run


def _distinct_pairs(pairs):
    import numpy as np

    if not pairs:
        return None
    x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
    found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y], axis=1)
    return found if found.size else None


def _meets_here(key, x, y):
    """Whether a pair is this run's to compare: two rows within two bits of each other meet under several keys of a slice.

    Rows of equal slices belong to the key that neither was flipped for, others to the smaller key of those
    under which they meet. x and y are words with the flipped bit in the last six.
    """
    import numpy as np

    fx, fy = (np.asarray(w & np.uint64(63)).astype(np.int64) for w in (x, y))
    bit = lambda f: np.where(f > 0, np.int64(1) << np.maximum(f - 1, 0), 0)
    return ((fx == 0) & (fy == 0)) | ((fx != fy) & (key < key ^ bit(fx) ^ bit(fy)))


def _differ(x, y):
    import numpy as np

    return np.bitwise_count((x ^ y) >> np.uint64(64 - FIRST_WORD))


def _run_pairs(key, ids, word):
    """Pairs (smaller id, larger id) of near first words within runs of equal keys, all with all."""
    import numpy as np

    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    length, starts = np.diff(edge), edge[:-1]
    pairs = []
    for n in np.unique(length[length > 1]).tolist():
        at = starts[length == n]
        for shift in range(1, n):
            x = (at[:, None] + np.arange(n - shift)[None, :]).ravel()
            y = x + shift
            x, y = (z[_differ(word[x], word[y]) <= FIRST_WORD_BITS] for z in (x, y))
            ok = _meets_here(key[x], word[x], word[y])
            pairs.append((ids[x[ok]], ids[y[ok]]))
    return _distinct_pairs(pairs)


class _LongRun:
    """A run of more than ``RUN_ALL`` rows, of which only leaders are kept."""

    def __init__(self, key: int):
        import numpy as np

        self.key, self.ids, self.words = key, np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def pairs(self, ids, word):
        """(leader, row) of each row whose nearest leader is near; rows far from all become leaders while there is room."""
        import numpy as np

        rest = np.arange(len(ids))
        out = []
        while len(rest):
            if len(self.ids):
                d = _differ(word[rest][:, None], self.words[None, :])
                near = d.argmin(axis=1)
                least = d[np.arange(len(rest)), near]
                settled = (least <= LEADER_BITS) | (len(self.ids) >= LEADERS)
                ok = settled & (least <= FIRST_WORD_BITS)
                i, j = rest[ok], near[ok]
                mine = _meets_here(np.int64(self.key), word[i], self.words[j]) & (ids[i] != self.ids[j])
                out.append((ids[i[mine]], self.ids[j[mine]]))
                rest = rest[~settled]
            if len(rest):
                self.ids, self.words = np.append(self.ids, ids[rest[0]]), np.append(self.words, word[rest[0]])
                rest = rest[1:]
        return _distinct_pairs(out)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, word) sorted by key -> pairs (a, b, -1); of long runs also each row that may have further pairs, as (key, id, flipped bit).

    A long run passes through in bounded memory and in time proportional to its rows. Runs whose rows were all
    flipped alike have no pairs of their own.
    """
    import numpy as np

    release_memory()
    held, size = [], 0
    long: _LongRun | None = None

    def rows(a, b, flip) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(flip.astype(np.int32))], names=["a", "b", "flip"])

    def of_long(k, i, w) -> Iterator[pa.RecordBatch]:
        if (found := long.pairs(i, w)) is not None:
            yield rows(found[0], found[1], np.full(found.shape[1], -1))
        yield rows(k, i, (w & np.uint64(63)).astype(np.int64))

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, long
        k, i, w = (np.concatenate(x) for x in zip(*held, strict=True))
        w = w.view(np.uint64)
        if long is not None:
            n = int(np.searchsorted(k, long.key, side="right"))
            if n:
                yield from of_long(k[:n], i[:n], w[:n])
                k, i, w = k[n:], i[n:], w[n:]
            if len(k):
                long = None
        if len(k):
            edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            length = np.diff(edge)
            many = np.repeat(length > RUN_ALL, length)
            for s, n in zip(edge[:-1][length > RUN_ALL].tolist(), length[length > RUN_ALL].tolist(), strict=True):
                long = _LongRun(int(k[s]))
                yield from of_long(k[s : s + n], i[s : s + n], w[s : s + n])
            if not many[-1]:
                long = None
            k, i, w = k[~many], i[~many], w[~many]
        end = len(k) if final or long is not None or not len(k) else int(np.searchsorted(k, k[-1]))
        held, size = [(k[end:], i[end:], w[end:].view(np.int64))], 0
        if end and (found := _run_pairs(k[:end], i[:end], w[:end])) is not None:
            yield rows(found[0], found[1], np.full(found.shape[1], -1))

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size >= 300_000:
                yield from flush(False)
    if held:
        yield from flush(True)
    release_memory()


def _prefixes(similarity: float):
    """Rows (id, n, component, list of (count, holders, shingle) in order) -> (key, id, pos, n, component, parts).

    A document's order begins with shingles that no other component has, which ``list`` leaves out. Each rare
    shingle of its prefix is a key, with its place in the whole order. A document that can be similar to others by
    frequent shingles alone has them once, as ``parts`` without a key; its keys are then the sets of holders of
    those in the prefix (many shingles have one), with the number of ``parts``, negative, as ``pos``.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        ids, n, comp = (batch.column(i).to_numpy() for i in range(3))
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts, holders, shingles = (x.to_numpy() for x in lists.flatten().flatten())
        out: list[list] = [[] for _ in range(6)]
        for i in range(batch.num_rows):
            c, s, h = (x[offsets[i] : offsets[i + 1]] for x in (counts, holders, shingles))
            first = int(n[i]) - len(h)
            least = _least(similarity * int(n[i]))
            k = min(len(h), int(n[i]) - least + 1 - first)  # a similar one shares its first common shingle up to here
            if k <= 0:
                continue
            rare = int(np.searchsorted(c, RARE, side="right"))
            few = min(k, rare)
            rows = [(int(x), first + j, None) for j, x in enumerate(h[:few])]
            if k > rare and len(h) - rare >= least:
                rows += [(None, None, h[rare:]), *((x, rare - len(h), None) for x in np.unique(s[rare:k]).tolist())]
            for key, pos, parts in rows:
                for column, value in zip(out, (key, ids[i], pos, n[i], comp[i], parts), strict=True):
                    column.append(value)
        types = (pa.int64(),) * 5 + (pa.list_(pa.int64()),)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["key", "id", "pos", "n", "component", "parts"])

    return run


def _least(x: float) -> int:
    """The least whole number that is not below x, but for rounding."""
    import math

    return math.ceil(x - 1e-6)


def _alike(similarity: float):
    """Two blocks of the documents that share a frequent shingle, rows (id, n, component, parts, side) -> pairs of components to join.

    ``side`` says which of the two blocks a row is of (both, if they are one). Shingles that two documents have in
    common are counted over ``parts``: all of them, or enough of them to join the two.
    """

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        n, comp, side = (table.column(c).to_numpy() for c in ("n", "component", "side"))
        parts = table.column("parts").combine_chunks()
        size = np.diff(parts.offsets.to_numpy())
        at = np.unique(parts.flatten().to_numpy(), return_inverse=True)[1]
        row = np.repeat(np.arange(len(n)), size)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        both = np.zeros((len(left), len(right)), np.float32)
        for v in range(0, int(at[-1]) + 1 if len(at) else 0, 2048):
            own = slice(*np.searchsorted(at, [v, v + 2048]))
            has = np.zeros((len(n), 2048), np.float32)
            has[row[own], at[own] - v] = 1
            both += has[left] @ has[right].T
        found = []
        for i in range(0, len(left), 256):
            mine = left[i : i + 256]
            common = both[i : i + 256].astype(np.float64)
            x, y = np.nonzero((common >= similarity * (n[mine][:, None] + n[right][None, :] - common)) & (comp[mine][:, None] != comp[right][None, :]))
            p, q = comp[mine[x]], comp[right[y]]
            found.append(np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1))
        a, b = spanning_stars(*np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _further_links(ids: DataFrame, links: DataFrame, rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Links that join different components of ``links(a, b)`` among the documents ``ids(id)``; none of that similarity is left out.

    An exact join by prefixes. Shingles are ordered: first those that only one component has, then the rarer
    ones; a pair of that similarity shares its first common shingle near the head of both orders. Where that one is
    in at most ``RARE`` of the documents, the pairs that share it are compared by their texts, so a document has
    that many for each shingle of its prefix at most. Else all that the two have in common are frequent shingles:
    only documents that mostly consist of such can be, and they are compared in blocks, of which only a spanning
    forest of components leaves a task.
    """
    comp = connected_components(links).select(F.col("node").alias("id"), "component")
    own = ids.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    texts = rows.withColumnRenamed("doc_id", "id").join(own, "id").select("id", "component", "text")

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        sets = [shingle_hashes((t or "").encode(), shingle_words).view(np.int64) for t in batch.column(2).to_pylist()]
        n = np.array([len(h) for h in sets], np.int64)
        held = [np.repeat(x, n) for x in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), n)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(sets), *held)], names=["h", "id", "component", "n"])

    held = materialize(map_arrow(texts, shingles, "h long, id long, component long, n long"), "shingles")
    open_ = held.groupBy("h").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("s"), F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("h", "c", "s")
    listed = held.join(open_, "h").groupBy("id", "n", "component").agg(F.sort_array(F.collect_list(F.struct("c", "s", "h"))).alias("list"))
    heads = materialize(map_arrow(listed, _prefixes(similarity), "key long, id long, pos long, n long, component long, parts array<long>"), "prefixes")
    few = heads.where("pos >= 0").drop("parts")
    a, b = few.alias("a"), few.alias("b")
    enough = F.least(F.expr("a.n - a.pos"), F.expr("b.n - b.pos")) >= F.expr("a.n + b.n") * (similarity / (1 + similarity)) - 1e-6
    pairs = a.join(b, F.expr("a.key = b.key AND a.id < b.id AND a.component <> b.component") & enough).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    rare = _verified(materialize(pairs.distinct(), "rare-pairs"), rows, shingle_words, similarity)
    many = heads.where("pos < 0").drop("parts")
    kinds = many.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("rows"), F.sum(-F.col("pos")).alias("parts"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("parts") / BLOCK_SHINGLES)).cast("int")
    placed = many.join(kinds.where("p < q").select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a row meets each block once: (own, other) as left or right, (own, own) as both
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    sets = heads.where("key IS NULL").select("id", "parts")
    dealt = other.join(sets, "id").select("key", "id", "n", "component", "parts", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    return rare.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(_alike(similarity), "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets have that Jaccard similarity; texts travel by document."""
    texts = docs.select("doc_id", "text")
    left = texts.join(pairs.withColumnRenamed("a", "doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"), F.col("b").alias("doc_id"))
    both = left.join(texts, "doc_id").select("a", F.col("doc_id").alias("b"), "text_a", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        ok = np.zeros(batch.num_rows, bool)
        last, held = object(), None
        for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            y = shingle_hashes((b or "").encode(), shingle_words) if b != last else held
            last, held = b, y
            x = shingle_hashes((a or "").encode(), shingle_words)
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = common >= similarity * (len(x) + len(y) - common)
        keep = np.flatnonzero(ok)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    return map_arrow(both, run, "a long, b long")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, recall: float = 0.99) -> DataFrame:
    """``docs(doc_id, text)`` with unique ids -> ``(doc_id, component_id)`` for documents in groups of near copies.

    Links are pairs whose sets of word shingles have that Jaccard similarity, found by ball hashing on
    slices of a wide SimHash and verified on the texts; a group's id is its smallest doc_id. Each document
    is first compared with its nearest candidate, then with those that this has not joined to it. Documents that
    meet in long runs are compared with a few leaders there and then joined by the prefixes of their shingles,
    which leaves no pair out: pairs of texts are in proportion to the documents, and only documents that mostly
    consist of shingles that many share are compared with each other, in blocks dealt to many tasks. Equal
    wide fingerprints (all blank texts, for one) count as copies. Null texts count as empty; documents in no
    group and null ids are absent; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    n = rows.count()
    bits, count = slices(n, similarity, recall)
    words = max(WIDE_WORDS, -(-bits * count // 64))
    fps = materialize(wide_fingerprints(rows, words, shingle_words), "wide")
    same = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("n").alias("n")), "wide-distinct")
    # emission multiplies rows: deal them out by number, not by their few bytes
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    keys = same.select("id", "fp").repartition(parts, "id").mapInArrow(_slice_variants(bits, count), "key long, id long, word long")
    found = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates, "a long, b long, flip int")
    # a row of a long run counts once, as (id, id)
    met = materialize(found.select(F.when(F.col("flip") < 0, F.col("a")).otherwise(F.col("b")).alias("a"), "b").distinct(), "met")
    pairs = materialize(_within(met.where("a <> b"), same, _most_bits(words * 64, similarity), similarity), "near")
    nearest = pairs.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("m.a", "b")
    first = materialize(_verified(nearest, rows, shingle_words, similarity), "links")
    joined = materialize(connected_components(first), "groups")
    ca = joined.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.join(nearest, ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    copies = fps.join(same.select("fp", "id"), "fp").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    near = materialize(first.unionByName(_verified(rest, rows, shingle_words, similarity)), "links")
    further = _further_links(met.where("a = b").select(F.col("a").alias("id")), near, rows, shingle_words, similarity)
    found = near.unionByName(materialize(further, "further-links")).unionByName(copies)
    return connected_components(found).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def _within(pairs: DataFrame, wide: DataFrame, limit: int, similarity: float) -> DataFrame:
    """``(a, b, d)``: pairs whose wide fingerprints differ in ``limit`` bits at most and whose set sizes allow the similarity."""
    differ = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    side = lambda k: wide.select(F.col("id").alias(k), F.col("fp").alias(f"f{k}"), F.col("n").alias(f"n{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * similarity)
    return both.select("a", "b", differ.alias("d")).where(F.col("d") <= limit)


def _most_bits(width: int, similarity: float) -> int:
    """Bits in which a pair of that similarity differs, plus three and a half standard deviations."""
    import math

    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(width * p + 3.5 * math.sqrt(width * p * (1 - p)))
