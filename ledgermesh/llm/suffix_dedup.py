"""Removal of repeated passages by per-shard suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller document, or
earlier in the same). Which strings can repeat at all is found first: every string of that length holds a
content-chosen anchor (the ``GRAM``-byte gram with the smallest hash), so equal strings hold equal anchors
at equal places. Anchors are shuffled by their hash; one whose gram occurs once in the corpus needs no
further look. Surroundings of an anchor (all strings around it) that are equal byte by byte are one text of
the shards: the first stands for all, and the others, whose strings all stood earlier, go as a whole. Hashes
only propose that surroundings are equal. Those of one Arrow batch are compared there; others are joined
along the document to segments, which travel to the document that holds the first and are compared with it.
Should a segment differ, all surroundings are compared by their shards instead.

The differing surroundings are gathered by anchor into shards; each shard gets a suffix array by
Larsson-Sadakane refinement and common prefixes by Kasai's recurrence, which give the classes of equal
strings. An anchor with more surroundings than one shard holds spans several, whose class lists, sorted by
their suffix arrays, are merged by binary search.

An anchor with very many surroundings is split before anything is shuffled: its strings are dealt by
blocks of eight places of the anchor in the string, and by the bytes that all strings of a block share, so
equal strings still meet. What is hot even so is dealt string by string. No task holds a hot passage, and no
way depends on how frequent it is but for this dealing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, materialize, numbered, release_memory, text_batches, utf8_buffers

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Bytes around an anchor: all strings of LENGTH bytes that hold it.
SPAN = LENGTH + WINDOW - 1
SEGMENT_BYTES = 1 << 19
SHARD_BYTES = 1 << 19
#: An anchor is split if it has more surroundings than this and than one in 2 ** 20 of all anchors, so that no more
#: than 2 ** 20 hot anchors (8 MB) are sent to the tasks.
HOT = 4096
#: Places of the anchor that the strings of a part have, when an anchor is split, and when a part is split again.
SPLITS = (8, 1)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def _words(raw):
    """Little-endian 8-byte words at every position of the bytes, zeros after their end."""
    import numpy as np

    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw),), dtype="<u8", buffer=padded, strides=(1,))


def _slide(x, width: int, fold):
    """fold (minimum or maximum) over every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = fold(x[:-have], x[have:])
        have *= 2
    return fold(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchor_positions(raw, offsets):
    """Anchors of all strings of LENGTH bytes inside one document: (position, gram hash, bytes left, bytes right).

    A string's anchor is the leftmost of its grams of smallest hash. The bytes from ``position - left`` to
    ``position + right`` are just the strings that an anchor stands for.
    """
    import numpy as np

    sizes = np.diff(offsets)
    starts = offsets[:-1][sizes >= LENGTH]
    ends = offsets[1:][sizes >= LENGTH] - LENGTH + 1
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    c = np.array(_ODD, dtype=np.uint64)
    found, keys = [], []
    for s in range(0, len(raw) - LENGTH + 1, SEGMENT_BYTES):
        part = raw[s : s + SEGMENT_BYTES + LENGTH - 1]
        w = _words(part)
        n = len(part) - GRAM + 1
        h = w[:n] * c[0]
        for k in range(1, 4):
            h += w[8 * k : 8 * k + n] * c[k]
        h ^= h >> np.uint64(29)
        h *= c[4]
        h ^= h >> np.uint64(32)
        h |= np.uint64(1)
        least = _slide(h, WINDOW, np.minimum)
        least[~valid[s : s + len(least)]] = 0
        pad = np.zeros(WINDOW - 1, np.uint64)
        chosen = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == h)
        found.append(chosen + s)
        keys.append(h[chosen])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    at, first = np.unique(np.concatenate(found), return_index=True)  # segments overlap
    h = np.concatenate(keys)[first]
    doc = np.searchsorted(offsets, at, side="right") - 1
    low = np.maximum(at - (WINDOW - 1), offsets[doc])  # first and last string that may have this anchor
    high = np.minimum(at, offsets[doc + 1] - LENGTH)
    for sign in (-1, 1):
        todo = np.arange(len(at))
        step = 0
        while len(todo):  # the next chosen gram on that side that takes strings away
            step += 1
            near = todo + sign * step
            inside = (near >= 0) & (near < len(at))
            todo, near = todo[inside], near[inside]
            inside = np.abs(at[near] - at[todo]) < WINDOW
            todo, near = todo[inside], near[inside]
            if sign < 0:
                stops = h[near] <= h[todo]
                low[todo[stops]] = np.maximum(low[todo[stops]], at[near[stops]] + 1)
            else:
                stops = h[near] < h[todo]
                high[todo[stops]] = np.minimum(high[todo[stops]], at[near[stops]] - WINDOW)
            todo = todo[~stops]
    own = low <= high
    at, h, low, high = at[own], h[own], low[own], high[own]
    return at, h, at - low, high + LENGTH - at


def surroundings_hash(raw, at, left, right):
    """64-bit hashes of the bytes from ``at - left`` to ``at + right``; left and right enter the hash."""
    import numpy as np

    r = np.random.default_rng(41)
    width = SPAN // 8 + 1
    odd = r.integers(0, 1 << 63, width + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint8), raw, np.zeros(8 * width, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(raw), 8 * width), (1, 1))
    out = np.empty(len(at), np.uint64)
    column = np.arange(8 * width)
    for i in range(0, len(at), 20_000):
        j = slice(i, i + 20_000)
        m = view[at[j]]
        low, high = WINDOW - 1 - left[j], WINDOW - 1 + right[j]
        m[(column < low[:, None]) | (column >= high[:, None])] = 0
        x = m.view("<u8") * np.uint64(_ODD[0])
        x ^= x >> np.uint64(31)
        h = (x * odd[:width]).sum(axis=1) + left[j].astype(np.uint64) * odd[width] + right[j].astype(np.uint64) * odd[width + 1]
        h ^= h >> np.uint64(30)
        out[j] = h * np.uint64(_ODD[4])
    return out


def split(raw, key, at, left, right, width: int):
    """Parts of units: of each, the strings whose anchor stands at ``width`` neighbouring places in them.

    A part's key is that of its unit with the block of places and the bytes that all strings of the block
    hold around the anchor. Returns (unit, key, at, left, right).
    """
    import numpy as np

    low, high = LENGTH - right, left  # the first and last place of the anchor in a string
    first = low // width
    n = high // width - first + 1
    unit = np.repeat(np.arange(len(key)), n)
    block = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n) + first[unit]
    lo, hi = np.maximum(low[unit], block * width), np.minimum(high[unit], block * width + width - 1)
    own = at[unit]
    core = surroundings_hash(raw, own, block * width, LENGTH - (block * width + width - 1))
    mixed = (key[unit] ^ (core * np.uint64(_ODD[1]))) * np.uint64(_ODD[0]) + np.uint64(width)
    mixed ^= mixed >> np.uint64(29)
    return unit, mixed * np.uint64(_ODD[4]) | np.uint64(1), own, hi, LENGTH - lo


def units(raw, offsets, hot: tuple = ()):
    """Anchors, hot ones split: (key, position, bytes left, bytes right). ``hot`` has an array of keys for each split."""
    import numpy as np

    at, key, left, right = anchor_positions(raw, offsets)
    for width, keys in zip(SPLITS, hot, strict=False):
        mine = np.isin(key, keys)
        if mine.any():
            _, *parts = split(raw, key[mine], at[mine], left[mine], right[mine], width)
            key, at, left, right = (np.concatenate([x[~mine], y]) for x, y in zip((key, at, left, right), parts, strict=True))
    return key, at, left, right


def _same_bytes(raw, a, b, size):
    """Whether the ``size`` bytes from a and from b are equal, pair by pair."""
    import numpy as np

    padded = np.concatenate([raw, np.zeros(SPAN, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(raw), SPAN), (1, 1))
    out = np.empty(len(a), bool)
    column = np.arange(SPAN)
    for i in range(0, len(a), 20_000):
        j = slice(i, i + 20_000)
        out[j] = ~((view[a[j]] != view[b[j]]) & (column < size[j][:, None])).any(axis=1)
    return out


def hot_anchors(texts: DataFrame) -> tuple:
    """Keys to split: for each of ``SPLITS`` an array, empty ones left out.

    A task tells of keys that it meets twice or more; others are in no task more than once.
    """
    import numpy as np

    found: tuple = ()
    total = None
    for _ in SPLITS:

        def run(batch: pa.RecordBatch, found=found) -> pa.RecordBatch | None:
            raw, offsets = utf8_buffers(batch.column(1))
            key, at, left, right = units(raw, offsets, found)
            if found:  # parts of the last split only
                plain = anchor_positions(raw, offsets)[1]
                key = key[~np.isin(key, plain)]
            kinds, n = np.unique(key, return_counts=True)
            several = n > 1
            kinds, n = np.append(kinds[several], np.uint64(0)), np.append(n[several], len(key))  # 0: all anchors
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], names=["key", "n"])

        counts = materialize(map_arrow(texts, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") > HOT) | (F.col("key") == 0)), "hot")
        if total is None:
            total = sum(r["n"] for r in counts.where("key = 0").collect())
        keys = counts.where((F.col("key") != 0) & (F.col("n") > max(HOT, total >> 20))).toPandas()["key"].to_numpy(np.int64)
        if not len(keys):
            break
        found = (*found, np.sort(keys).view(np.uint64))
    return found


ANCHORS = "key long, ctx long, rid long, place long, known boolean"


def _anchors(hot: tuple, bits: int):
    """A row for each unit; ``place`` is 256 * start + length of its surroundings in the document.

    Surroundings that stood earlier in the same batch, byte by byte, are known repeats already: they travel
    under a key of their own, so a hot passage is one row for each batch where it meets others. ``bits`` of
    the hashes are used.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        import numpy as np

        raw, offsets = utf8_buffers(batch.column(1))
        key, at, left, right = units(raw, offsets, hot)
        if not len(at):
            return None
        doc = np.searchsorted(offsets, at, side="right") - 1
        ctx = surroundings_hash(raw, at, left, right)
        if bits < 64:
            mask = np.uint64((1 << bits) - 1)
            key, ctx = key & mask, ctx & mask
        rid = batch.column(0).to_numpy()[doc]
        begin, size = at - left, left + right
        start = begin - offsets[doc]
        order = np.lexsort([start, rid, ctx, key])
        key, ctx, rid, start, begin, size = (x[order] for x in (key, ctx, rid, start, begin, size))
        known = np.concatenate([[False], (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & (size[1:] == size[:-1])])
        i = np.flatnonzero(known)
        known[i] = _same_bytes(raw, begin[i], begin[i - 1], size[i])
        key = np.where(known, surroundings_key(ctx, rid, start), key)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(rid), pa.array(start * 256 + size), pa.array(known)], names=["key", "ctx", "rid", "place", "known"])

    return run


def surroundings_key(ctx, rid, start):
    """A key that spreads rows which need no meeting."""
    import numpy as np

    return ctx ^ (rid.astype(np.uint64) * np.uint64(_ODD[1])) ^ (start.astype(np.uint64) * np.uint64(_ODD[2]))


KNOWN, FIRST, COPY = 0, 1, 2
MARKS = "rid long, place long, key long, kind int, to_rid long, to_place long"


def _marks(propose: bool):
    """From units sorted by key, surroundings, document and start: what each row is.

    KNOWN rows repeat as a whole. Of each kind of surroundings the first is compared by shards, if its key
    has several kinds, and the others are COPY rows that name it (without ``propose`` each row is a kind of
    its own). At most one row is held back between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(rid, place, key, kind: int, to_rid=None, to_place=None) -> pa.RecordBatch:
            to = [pa.array(x, pa.int64()) if x is not None else pa.nulls(len(rid), pa.int64()) for x in (to_rid, to_place)]
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(place), pa.array(key), pa.array(np.full(len(rid), kind, np.int32)), *to], names=["rid", "place", "key", "kind", "to_rid", "to_place"])

        last = None  # (key, surroundings, row, place) of the last first
        pending = None  # the last key's first, if it is the only one so far
        sent = None  # the last key, if its firsts have gone out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ctx, rid, place = (batch.column(i).to_numpy() for i in range(4))
            known = batch.column(4).to_numpy(zero_copy_only=False)
            if known.any():
                yield out(rid[known], place[known], key[known], KNOWN)
                key, ctx, rid, place = (x[~known] for x in (key, ctx, rid, place))
                if not len(key):
                    continue
            if propose:
                size = place & 255
                same = np.concatenate([[last is not None and last[:2] == (key[0], ctx[0]) and last[3] & 255 == size[0]], (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & (size[1:] == size[:-1])])
            else:
                same = np.zeros(len(key), bool)
            if same.any():
                head = np.maximum.accumulate(np.where(same, -1, np.arange(len(key))))
                before = (rid[0], place[0]) if last is None else last[2:]
                to_rid = np.where(head < 0, before[0], rid[head])
                to_place = np.where(head < 0, before[1], place[head])
                yield out(rid[same], place[same], key[same], COPY, to_rid[same], to_place[same])
            fresh = np.flatnonzero(~same)
            if not len(fresh):
                continue
            key, ctx, rid, place = (x[fresh] for x in (key, ctx, rid, place))
            last = (key[-1], ctx[-1], rid[-1], place[-1])
            if pending is not None:
                key, rid, place = (np.concatenate([[a], b]) for a, b in zip(pending, (key, rid, place), strict=True))
            start = np.concatenate([[True], key[1:] != key[:-1]])
            several = ~(start & np.concatenate([start[1:], [True]]))
            several |= key == sent if sent is not None else False
            if several.any():
                yield out(rid[several], place[several], key[several], FIRST)
            pending, sent = (None, key[-1]) if several[-1] else ((key[-1], rid[-1], place[-1]), None)

    return run


def _order(high, low, low_bits: int):
    """Stable order of pairs of numbers below 2 ** 20 and 2 ** low_bits: sorted packed with their place where that fits 63 bits."""
    import numpy as np

    bits = max(1, len(high) - 1).bit_length()
    if 20 + low_bits + bits <= 63 and (not len(high) or int(high.max()) < 1 << 20):
        packed = (high << (low_bits + bits)) | (low << bits) | np.arange(len(high))
        packed.sort()
        return packed & ((1 << bits) - 1)
    return np.lexsort([low, high])


def suffix_array(text, depth: int | None = None):
    """Suffix array of the bytes and the group of each suffix, by Larsson-Sadakane refinement.

    Groups of suffixes equal in their first h bytes are sorted by the group of what follows those h bytes;
    h doubles, and only groups that are still open are touched again. With ``depth`` this stops once that
    many bytes are sorted: suffixes that are equal so far then share a group.
    """
    import numpy as np

    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = 5
    first = (_words(text).byteswap() >> np.uint64(24)).astype(np.int64)  # five bytes, zeros after the end
    sa = _order(first >> 20, first & ((1 << 20) - 1), 20)
    k = first[sa]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    places = np.arange(n)
    group = np.empty(n, np.int64)
    group[sa] = np.maximum.accumulate(np.where(new, places, 0))
    open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(open_) and (depth is None or h < depth):
        at = sa[open_]
        after = at + h
        # beyond the end: the shorter suffix first
        follow = np.where(after < n, group[np.minimum(after, n - 1)] + h, n + h - 1 - after)
        own = group[at]
        order = _order(own, follow, max(1, n + h).bit_length())
        at, follow, own = at[order], follow[order], own[order]
        sa[open_] = at
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
        group[at] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return sa, group


LANE = 64


def common_prefixes(text, sa, group, limit: int):
    """Common prefix of each suffix with the one before it in ``sa``, up to ``limit``, by Kasai's recurrence.

    The recurrence (a suffix shares at least one byte less than the suffix one place to its left did) runs
    down many lanes of the text at once. Suffixes of one group share ``limit`` bytes or more; their order
    within the group says nothing of their neighbours' order, so the recurrence starts anew after them.
    """
    import numpy as np

    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    padded = np.concatenate([text, np.zeros(limit + 16, np.uint8)])
    w = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    lanes = np.arange(0, n, LANE)
    h = np.zeros(len(lanes), np.int64)
    one = np.uint64(1)
    for step in range(min(LANE, n)):
        i = lanes + step
        if i[-1] >= n:
            lanes, h, i = lanes[:-1], h[:-1], i[:-1]
        j = before[i]
        tied = (j >= 0) & (group[i] == group[j])
        h = np.where(tied, limit, np.where(j < 0, 0, np.maximum(h - 1, 0)))
        go = np.flatnonzero(~tied & (j >= 0) & (h < limit))
        while len(go):
            x = w[i[go] + h[go]] ^ w[j[go] + h[go]]
            same = x == 0
            h[go] += np.where(same, 8, np.bitwise_count((x & (~x + one)) - one).astype(np.int64) >> 3)
            go = go[same & (h[go] < limit)]
        h = np.minimum(h, np.minimum(limit, n - np.maximum(i, j)))
        out[place[i]] = h
        h = np.where(tied, 0, h)
    return out


class Shard:
    """Surroundings of anchors with the classes of equal strings of LENGTH bytes in them."""

    def __init__(self, texts: list[bytes], place):
        """``place[i]`` orders the strings: the number of text i's first byte, growing with document and start."""
        import numpy as np

        self.text = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes) - sizes
        sa, group = suffix_array(self.text, LENGTH)
        lcp = common_prefixes(self.text, sa, group, LENGTH)
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(len(self.text)) - begin[owner]
        whole = inside + LENGTH <= sizes[owner]
        label = np.cumsum(lcp < LENGTH)
        keep = whole[sa]
        self.at = sa[keep]  # strings that lie inside one text, in suffix order
        label = label[keep]
        self.owner, self.inside = owner[self.at], inside[self.at]
        self.number = place[self.owner] + self.inside
        self.heads = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(self.number, self.heads) if len(self.heads) else np.zeros(0, np.int64)

    def strings(self):
        """One string of each class, in sorted order."""
        import numpy as np

        view = np.lib.stride_tricks.as_strided(self.text, (max(0, len(self.text) - LENGTH + 1), LENGTH), (1, 1))
        return np.ascontiguousarray(view[self.at[self.heads]]).view(f"S{LENGTH}").ravel()

    def repeats(self):
        """(text, start in it) of the strings that are not the first of their class."""
        import numpy as np

        each = np.repeat(self.least, np.diff(np.append(self.heads, len(self.at))))
        later = self.number > each
        return self.owner[later], self.inside[later]


def merge(shards: list[Shard]) -> None:
    """Gives classes that several shards share their overall first, by binary search in sorted class lists."""
    import numpy as np

    known, least = shards[0].strings(), shards[0].least.copy()
    for s in shards[1:]:
        own = s.strings()
        at = np.searchsorted(known, own)
        hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own) if len(known) else np.zeros(len(own), bool)
        np.minimum.at(least, at[hit], s.least[hit])
        known, least = np.insert(known, at[~hit], own[~hit]), np.insert(least, at[~hit], s.least[~hit])
    for s in shards:
        s.least = least[np.searchsorted(known, s.strings())]


def repeated(keys, rids, starts, texts: list[bytes]):
    """Removed intervals (row, start, end) from surroundings sorted by anchor; whole anchors only.

    Anchors share shards as long as they fit; a larger anchor spans several, which are merged.
    """
    import numpy as np

    order = np.unique(rids, return_inverse=True)[1].astype(np.int64)
    place = (order << 36) + starts
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.cumsum([0, *(len(t) for t in texts)])
    out = []

    def take(shard: Shard, base: int) -> None:
        row, inside = shard.repeats()
        if len(row):
            row = row + base
            out.append(np.stack([rids[row], starts[row] + inside]))

    a = 0
    while a < len(edge) - 1:
        b = a + 1
        while b < len(edge) - 1 and size[edge[b + 1]] - size[edge[a]] <= SHARD_BYTES:
            b += 1
        lo, hi = edge[a], edge[b]
        if size[hi] - size[lo] <= SHARD_BYTES:
            take(Shard(texts[lo:hi], place[lo:hi]), lo)
        else:
            cuts = [lo]
            while cuts[-1] < hi:
                cuts.append(min(hi, max(cuts[-1] + 1, int(np.searchsorted(size, size[cuts[-1]] + SHARD_BYTES, side="right")) - 1)))
            shards = [Shard(texts[i:j], place[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            merge(shards)
            for s, i in zip(shards, cuts, strict=False):
                take(s, i)
        a = b
    if not out:
        return None
    rid, start = np.concatenate(out, axis=1)
    order = np.lexsort([start, rid])
    rid, start = rid[order], start[order]
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + LENGTH)])
    head = np.flatnonzero(new)
    return rid[head], start[head], start[np.append(head[1:], len(start)) - 1] + LENGTH


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings sorted by key -> removed intervals, a few shards at a time."""
    import numpy as np

    release_memory()
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(final: bool):
        nonlocal held, size
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("key").to_numpy()
        cut = len(key) if final else int(np.searchsorted(key, key[-1]))
        held = table.slice(cut).to_batches()
        size = sum(b.nbytes for b in held)
        if not cut:
            return None
        part = table.slice(0, cut)
        return repeated(key[:cut], part.column("rid").to_numpy(), part.column("start").to_numpy(), part.column("bytes").to_pylist())

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["rid", "a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= 8 * SHARD_BYTES and (found := flush(False)):
                yield rows(found)
    if held and (found := flush(True)):
        yield rows(found)
    release_memory()


CUT = "copy boolean, dest long, rid long, start long, to_start long, bytes binary"


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts with their marks -> surroundings of firsts, for their anchor, and segments of copies, for the first's document.

    Copies that follow each other on both sides join to one segment.
    """
    import numpy as np

    raw, offsets = utf8_buffers(batch.column(1))
    whole = raw.tobytes()
    found = batch.column(2)
    n = np.diff(found.offsets.to_numpy())
    marks = found.flatten()
    place, key, kind, to_rid, to_place = (marks.field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("place", "key", "kind", "to_rid", "to_place"))
    row = np.repeat(np.arange(len(n)), n)
    rid = batch.column(0).to_numpy()[row]
    start, end, to_start = place >> 8, (place >> 8) + (place & 255), to_place >> 8
    first = kind == FIRST
    order = np.flatnonzero(~first)
    order = order[np.lexsort([start[order], start[order] - to_start[order], to_rid[order], row[order]])]
    r, t, a, shift, e = row[order], to_rid[order], start[order], start[order] - to_start[order], end[order]
    heads = np.zeros(0, np.int64)
    if len(order):
        other = np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (shift[1:] != shift[:-1])])
        reach = np.maximum.accumulate(e + other.cumsum() * (1 << 40)) - other.cumsum() * (1 << 40)  # within a group
        heads = np.flatnonzero(other | np.concatenate([[True], a[1:] > reach[:-1]]))
    last = np.append(heads[1:], len(order)) - 1 if len(heads) else heads
    seg_end = reach[last] if len(heads) else heads
    begin = np.concatenate([start[first], a[heads]])
    stop = np.concatenate([end[first], seg_end])
    base = offsets[np.concatenate([row[first], r[heads]])]
    texts = [whole[i:j] for i, j in zip((base + begin).tolist(), (base + stop).tolist(), strict=True)]
    copy = np.concatenate([np.zeros(int(first.sum()), bool), np.ones(len(heads), bool)])
    dest = np.concatenate([key[first], t[heads]])
    to = np.concatenate([start[first], (a - shift)[heads]])
    rids = np.concatenate([rid[first], rid[order][heads]])
    return pa.RecordBatch.from_arrays([pa.array(copy), pa.array(dest), pa.array(rids), pa.array(begin), pa.array(to), pa.array(texts, pa.binary())], names=["copy", "dest", "rid", "start", "to_start", "bytes"])


def removed_spans(rows: DataFrame, bits: int = 64) -> DataFrame:
    """``rows(rid, text)`` -> ``(rid, spans array<struct<a, b>>)`` of bytes to remove, for rows that have any; spans may overlap.

    ``bits`` of the hashes are used; fewer make more to compare, not another result.
    """
    text_batches(rows.sparkSession)
    texts = rows.select("rid", "text")
    long = texts.where(F.octet_length("text") >= LENGTH)
    anchors = map_arrow(long, _anchors(hot_anchors(long), bits), ANCHORS)
    sorted_ = anchors.repartition("key").sortWithinPartitions("key", "ctx", "rid", "place")
    for propose in (True, False):
        marks = materialize(sorted_.mapInArrow(_marks(propose), MARKS), "marks")
        by_row = marks.where(F.col("kind") != KNOWN).groupBy("rid").agg(F.collect_list(F.struct("place", "key", "kind", "to_rid", "to_place")).alias("found"))
        cut = materialize(map_arrow(long.join(by_row, "rid"), _cut, CUT), "cut")
        b = (F.col("start") + F.octet_length("bytes")).alias("b")
        firsts = long.select(F.col("rid").alias("dest"), F.col("text").cast("binary").alias("held"))
        equal = F.expr("substring(held, cast(to_start + 1 AS int), octet_length(bytes))") == F.col("bytes")
        checked = materialize(cut.where("copy").join(firsts, "dest").select("rid", F.col("start").alias("a"), b, equal.alias("equal")), "checked")
        if checked.where("NOT equal").isEmpty():
            break  # else two different surroundings share a hash
    compared = cut.where("NOT copy").select(F.col("dest").alias("key"), "rid", "start", "bytes").repartition("key").sortWithinPartitions("key", "rid", "start").mapInArrow(_compare, "rid long, a long, b long")
    start = F.shiftright("place", 8)
    known = marks.where(F.col("kind") == KNOWN).select("rid", start.alias("a"), (start + F.col("place").bitwiseAND(255)).alias("b"))
    spans = compared.unionByName(known).unionByName(checked.select("rid", "a", "b")).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return materialize(spans, "spans")


def join_spans(spans) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, b = s["a"], s["b"]
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def removal_digests(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, a row for each input row.

    Null texts count as empty. Rows that repeat a doc_id, or have none, are documents of their own in the
    order of ``numbered``: of equal rows the first keeps its text. Texts are read whole, however long; other
    columns are ignored; an empty table gives no rows.
    """
    rows = numbered(docs.select("doc_id", "text")).fillna("", "text")
    spans = removed_spans(rows, bits)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, own = text.encode(), join_spans(found)
            out.append((len(raw), sum(b - a for a, b in own), len(own), hashlib.sha256(kept(raw, own)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in out], t) for j, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(spans, "rid", "left").select("doc_id", "text", "spans")
    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def inner(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters, so that what is kept stays text."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the same columns, repeated passages cut from the texts, a row for each input row.

    Rows that repeat a doc_id, or have none, are documents of their own in the order of ``numbered``: the
    first keeps its text, later ones lose what they repeat. Null texts become empty; other columns keep their
    names and values, whatever they are called; an empty table gives no rows.
    """
    number, found = (free_name(n, docs.columns) for n in ("rid", "spans"))
    rows = numbered(docs, number).fillna("", "text")
    spans = removed_spans(rows.select(F.col(number).alias("rid"), "text")).toDF(number, found)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            raw = text.encode()
            out.append(kept(raw, inner(raw, join_spans(found))).decode())
        columns = batch.columns[:-1]
        columns[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    joined = rows.join(spans, number, "left").select(*docs.columns, found)
    return map_arrow(joined, run, rows.select(docs.columns).schema)
