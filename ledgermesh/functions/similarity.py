"""String similarities that Spark does not ship, as Arrow-batched functions.

Indel ratio and its token and partial forms on a 0-100 scale, Jaro-Winkler on 0-1. Plain functions of two
strings define the scores; their batch forms run the same bit-parallel recurrence over all pairs of an Arrow
batch at once, a step for each character place, and score each distinct pair once.
"""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


#: Windows of a partial ratio that are compared before it is known which others could be better: every eighth.
STRIDE = 8


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if hit := row & where.get(c, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (|a| + |b|); two empty strings are equal."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs_length(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and each side's shared and own words; 0 if a side has no word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, x - y, y - x
    if both and (not left or not right):
        return 100.0
    join = lambda s: " ".join(sorted(s))
    common = join(both)
    one, two = (f"{common} {join(s)}".strip() for s in (left, right))
    best = indel_ratio(one, two)
    return max(best, indel_ratio(common, one), indel_ratio(common, two)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer, windows cut at both ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if m == 0:
        return 100.0 if n == 0 else 0.0
    if short in long:
        return 100.0
    best = 0.0
    held = set(short)
    for end in range(1, n + m):
        window = long[max(0, end - m) : end]
        if not (window[0] in held or window[-1] in held):
            continue  # a neighbouring window without that character is no worse
        if 200.0 * min(m, len(window)) / (m + len(window)) > best:
            best = max(best, indel_ratio(short, window))
    return best


def jaro_winkler(a: str, b: str, both_empty: float = 1.0) -> float:
    """Jaro similarity, above 0.7 raised for a common prefix of up to four characters (scale 0.1); rounded once, as DuckDB does."""
    n, m = len(a), len(b)
    if not n and not m:
        return both_empty
    if a == b:
        return 1.0
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    used = [False] * m
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    k = len(matched)
    if not k:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (b[j] for j in range(m) if used[j]), strict=True)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return math.fma(prefix * 0.1, 1 - jaro, jaro)


def _coded(texts: list[str]):
    """Texts as rows of character numbers, -1 after their end, and their lengths; equal characters have equal numbers."""
    import numpy as np

    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    _, codes = np.unique(points, return_inverse=True) if len(points) else (None, points)
    out = np.full((len(texts), int(lengths.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = codes
    return out, lengths


def _matches(rows, lengths, alphabet: int):
    """For each row and character, the places where it stands, as bits of 64-bit words: (row, character, word)."""
    import numpy as np

    words = max(1, -(-rows.shape[1] // 64))
    out = np.zeros((len(rows), alphabet + 1, words), np.uint64)  # the last character stands for "after the end"
    index = np.arange(len(rows))
    for i in range(rows.shape[1]):
        c = rows[:, i]
        live = c >= 0
        out[index[live], c[live], i >> 6] |= np.uint64(1 << (i & 63))
    return out


def lcs_lengths(pattern_lengths, matches, owner, other):
    """Lengths of the longest common subsequences of patterns and other rows, bit-parallel over a whole batch.

    ``owner[k]`` is the pattern that row k of ``other`` (character numbers, -1 after the end) is compared with.
    """
    import numpy as np

    words = matches.shape[2]
    last = matches.shape[1] - 1
    size = pattern_lengths[owner]
    if words == 1:
        flat = matches.reshape(-1)
        base = owner * matches.shape[1]
        out = np.zeros(len(owner), np.int64)
        for s in range(0, len(owner), 8192):  # rows whose arrays stay in the processor's cache
            rows = other[s : s + 8192].T
            place = np.where(rows >= 0, rows, last) + base[s : s + 8192]
            state = np.full(place.shape[1], ~np.uint64(0))
            u, total = np.empty_like(state), np.empty_like(state)
            for at in place:
                np.take(flat, at, out=u, mode="clip")
                u &= state
                np.add(state, u, out=total)
                state -= u
                state |= total
            bits = size[s : s + 8192]
            mask = np.where(bits >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
            out[s : s + 8192] = np.bitwise_count(~state & mask)
        return out
    full = np.full((len(owner), words), ~np.uint64(0))
    state = full.copy()
    for j in range(other.shape[1]):
        hit = matches[owner, np.where(other[:, j] >= 0, other[:, j], last)]
        u = state & hit
        total = state + u
        carry = total < state  # of each word into the next
        for w in range(1, words):
            more = carry[:, w - 1]
            raised = total[:, w] + more
            carry[:, w] |= raised < total[:, w]
            total[:, w] = raised
        state = total | (state - u)
    kept = ~state
    out = np.zeros(len(owner), np.int64)
    for w in range(words):
        bits = np.clip(size - 64 * w, 0, 64)
        mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(kept[:, w] & mask)
    return out


def indel_ratios(a: list[str], b: list[str]):
    """``indel_ratio`` of many pairs at once."""
    import numpy as np

    if not a:
        return np.zeros(0)
    n = len(a)
    # the shorter as the pattern: it more often fits a word of 64 bits
    codes, lengths = _coded([*(min(p, key=len) for p in zip(a, b, strict=True)), *(q if len(p) <= len(q) else p for p, q in zip(a, b, strict=True))])
    x, y, nx, ny = codes[:n], codes[n:], lengths[:n], lengths[n:]
    x, y = x[:, : max(1, int(nx.max(initial=0)))], y[:, : int(ny.max(initial=0))]
    found = lcs_lengths(nx, _matches(x, nx, int(codes.max(initial=0)) + 1), np.arange(n), y)
    total = nx + ny
    return np.where(total == 0, 100.0, 200.0 * found / np.maximum(total, 1))


def partial_ratios(a: list[str], b: list[str], most: int = 50_000):
    """``partial_ratio`` of many pairs at once, the windows of ``most`` characters' pairs at a time.

    A window's common subsequence differs by one at most from that of the next, so a window between two known
    ones is compared only if it could still be the best. The best is the same as over all windows.
    """
    import numpy as np

    out = np.zeros(len(a))
    pairs = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        if not short:
            out[i] = 100.0 if not long else 0.0
        elif short in long:
            out[i] = 100.0
        else:
            pairs.append((i, short, long))
    at = 0
    while at < len(pairs):
        size, end = 0, at
        while end < len(pairs) and (end == at or size + len(pairs[end][1]) + len(pairs[end][2]) <= most):
            size += len(pairs[end][1]) + len(pairs[end][2])
            end += 1
        part = pairs[at:end]
        at = end
        codes, lengths = _coded([p[1] for p in part] + [p[2] for p in part])
        n = len(part)
        short, m, n_long = codes[:n], lengths[:n], lengths[n:]
        short = short[:, : int(m.max())]
        matches = _matches(short, m, int(codes.max()) + 1)
        count = m + n_long - 1
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(n), count)
        place = np.arange(len(owner)) - first[owner]  # of a window in its pair
        begin = np.maximum(0, place + 1 - m[owner])
        width = np.minimum(place + 1, n_long[owner]) - begin
        padded = np.concatenate([codes[n:], np.full((n, 1), -1)], axis=1)
        ends = count[owner] - 1
        bound = np.minimum(width, m[owner])  # the most that a window can have in common
        score = np.zeros(len(owner))
        step, todo = STRIDE, np.flatnonzero((place % STRIDE == 0) | (place == ends))
        while True:
            for k in range(0, len(todo), most):
                some = todo[k : k + most]
                own = owner[some]
                at_char = begin[some][:, None] + np.arange(int(width[some].max()))[None, :]
                window = np.where(np.arange(at_char.shape[1])[None, :] < width[some][:, None], padded[own[:, None], np.minimum(at_char, padded.shape[1] - 1)], -1)
                bound[some] = lcs_lengths(m, matches, own, window)
            score[todo] = 200.0 * bound[todo] / (m[owner[todo]] + width[todo])
            best = np.maximum.reduceat(score, first)
            if step == 1:
                break
            half = step // 2
            new = np.flatnonzero((place % step == half) & (place != ends))
            after = np.minimum(half, ends[new] - place[new])
            bound[new] = np.minimum(bound[new], np.minimum(bound[new - half] + half, bound[new + after] + after))
            todo = new[200.0 * bound[new] / (m[owner[new]] + width[new]) > best[owner[new]]]
            step = half
        out[[p[0] for p in part]] = best
    return out


def token_sort_ratios(a: list[str], b: list[str]):
    order = lambda t: " ".join(sorted(t.split()))
    return indel_ratios(list(map(order, a)), list(map(order, b)))


def token_set_ratios(a: list[str], b: list[str]):
    """``token_set_ratio`` of many pairs at once: the three ratios of each pair are rows of one batch."""
    import numpy as np

    out = np.zeros(len(a))
    left, right, owner = [], [], []
    join = lambda s: " ".join(sorted(s))
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = set(p.split()), set(q.split())
        if not x or not y:
            continue
        both, own, other = x & y, x - y, y - x
        if both and (not own or not other):
            out[i] = 100.0
            continue
        common = join(both)
        one, two = (f"{common} {join(s)}".strip() for s in (own, other))
        for u, v in ((one, two), (common, one), (common, two))[: 3 if both else 1]:
            left.append(u)
            right.append(v)
            owner.append(i)
    np.maximum.at(out, np.array(owner, np.int64), indel_ratios(left, right))
    return out


def jaro_winklers(a: list[str], b: list[str], both_empty: float = 1.0):
    """``jaro_winkler`` of many pairs at once: a step for each character place of the first strings; those over 64 characters one by one."""
    import numpy as np

    out = np.empty(len(a))
    some = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not x or not y or x == y or max(len(x), len(y)) > 64:
            out[i] = jaro_winkler(x, y, both_empty)
        else:
            some.append(i)
    for s in range(0, len(some), 8192):
        part = some[s : s + 8192]
        codes, lengths = _coded([*(a[i] for i in part), *(b[i] for i in part)])
        n, pad = len(part), int(codes.max()) + 1
        matches = _matches(codes[n:], lengths[n:], pad)[:, :, 0]
        codes[codes < 0] = pad
        out[part] = _jaro_winkler_rows(codes[:n], codes[n:], lengths[:n], lengths[n:], matches, np.arange(n), pad)
    return out


def _jaro_winkler_rows(x, y, nx, ny, matches, owner, pad: int):
    """Scores of rows of character numbers, ``pad`` after their end; ``owner[k]`` is the row of ``matches`` that has the places of ``y[k]``."""
    import numpy as np

    one = np.uint64(1)
    reach = np.maximum(0, np.maximum(nx, ny) // 2 - 1)
    used = np.zeros(len(x), np.uint64)
    hits = []
    upto = lambda k: np.where(k >= 64, ~np.uint64(0), (one << np.clip(k, 0, 63).astype(np.uint64)) - one)  # noqa: E731  # the lowest k bits
    for i in range(int(nx.max())):
        at = x[:, i]
        free = matches[owner, at] & ~used & upto(i + reach + 1) & ~upto(i - reach)
        lowest = free & (~free + one)
        used |= lowest
        hits.append((at, lowest != 0))
    k = np.bitwise_count(used).astype(np.int64)
    left, swaps = used.copy(), np.zeros(len(x), np.int64)
    for at, hit in hits:
        lowest = np.where(hit, left & (~left + one), np.uint64(0))
        swaps += hit & ((matches[owner, at] & lowest) == 0)
        left ^= lowest
    swaps //= 2
    jaro = np.where(k > 0, (k / nx + k / ny + (k - swaps) / np.maximum(k, 1)) / 3, 0.0)
    width = min(4, x.shape[1], y.shape[1])
    same = (x[:, :width] == y[:, :width]) & (x[:, :width] != pad)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.array([math.fma(p * 0.1, 1 - j, j) if j > 0.7 else j for p, j in zip(prefix.tolist(), jaro.tolist(), strict=True)])


#: The longest texts whose scores are computed together: each character is a bit of a 64-bit word.
WORD = 64
#: Pairs, and windows of pairs, whose arrays stay in the processor's cache.
CHUNK = 8192


class _Texts:
    """Distinct texts of at most ``WORD`` characters as rows of character numbers with a word's length of padding
    on both sides, and for each text and character the places where it stands, as bits."""

    def __init__(self, texts: list[str], numbers, alphabet: int):
        import numpy as np

        self.texts, self.pad = texts, alphabet
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        inside = np.arange(WORD)[None, :] < self.lengths[:, None]
        codes = np.full((len(texts), WORD), alphabet, np.int16)
        codes[inside] = numbers[points]
        self.padded = np.full((len(texts), 3 * WORD), alphabet, np.int16)
        self.padded[:, WORD : 2 * WORD] = codes
        self.codes, self.matches = codes, _places(codes, self.lengths, alphabet)


def _places(codes, lengths, alphabet: int):
    """As ``_matches``, for rows of one word; padding has the number ``alphabet`` and stands nowhere."""
    import numpy as np

    out = np.zeros((len(codes), alphabet + 1), np.uint64)
    index = np.arange(len(codes))
    for i in range(int(lengths.max(initial=0))):
        out[index, codes[:, i]] |= np.uint64(1 << i)
    out[:, alphabet] = 0
    return out


def _common(matches, owner, flat, start, width):
    """Lengths of the longest common subsequences of pattern ``owner[k]`` and the ``width[k]`` numbers of ``flat`` from ``start[k]`` on."""
    import numpy as np

    out = np.zeros(len(owner), np.int64)
    order = np.argsort(-width, kind="stable")
    cells = matches.reshape(-1)
    for s in range(0, len(order), CHUNK):
        part = order[s : s + CHUNK]
        base, at, steps = owner[part] * matches.shape[1], start[part], width[part]
        state = np.full(len(part), ~np.uint64(0))
        code, u, total, place = np.empty(len(part), flat.dtype), np.empty_like(state), np.empty_like(state), np.empty_like(base)
        for n in np.searchsorted(-steps, -np.arange(int(steps[0])), side="left").tolist():  # the rows that go on, which are the first
            np.take(flat, at[:n], out=code[:n], mode="clip")
            np.add(base[:n], code[:n], out=place[:n])
            np.take(cells, place[:n], out=u[:n], mode="clip")
            np.bitwise_and(u[:n], state[:n], out=u[:n])
            np.add(state[:n], u[:n], out=total[:n])
            np.subtract(state[:n], u[:n], out=state[:n])
            np.bitwise_or(state[:n], total[:n], out=state[:n])
            at[:n] += 1
        # places after a pattern's end have no bits in its matches, so their state stays set
        out[part] = np.bitwise_count(~state)
    return out


def _common_of(texts: _Texts, a, b):
    """Lengths of the longest common subsequences of pairs of texts."""
    return _common(texts.matches, a, texts.codes.reshape(-1), b * WORD, texts.lengths[b])


def _ratios(found, total):
    import numpy as np

    return np.where(total == 0, 100.0, 200.0 * found / np.maximum(total, 1))


def _partial_of(texts: _Texts, a, b, found, windows: int = 1 << 19):
    """``partial_ratio`` of pairs of texts whose common subsequences have the lengths ``found``, as ``partial_ratios``."""
    import numpy as np

    swap = texts.lengths[a] > texts.lengths[b]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    m_all, n_all = texts.lengths[short], texts.lengths[long]
    out = np.where((m_all == 0) & (n_all == 0), 100.0, 0.0)
    for i in np.flatnonzero((m_all > 0) & (found == m_all)):
        if texts.texts[short[i]] in texts.texts[long[i]]:
            out[i] = 100.0
    rest = np.flatnonzero((m_all > 0) & (out == 0.0) & (found > 0))
    flat = texts.padded.reshape(-1)
    for s in range(0, len(rest), windows // (2 * WORD)):
        part = rest[s : s + windows // (2 * WORD)]
        m, n, most = m_all[part], n_all[part], found[part]
        count = m + n - 1
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(part)), count)
        place = np.arange(len(owner)) - first[owner]
        width = np.minimum(place + 1, n[owner]) - np.maximum(0, place + 1 - m[owner])
        size = m[owner]
        ends = (count - 1)[owner]
        bound = np.minimum(width, most[owner])  # the most that a window can have in common
        start = long[part][owner] * (3 * WORD) + WORD + place + 1 - size  # padding stands for the part cut off
        pattern, score = short[part][owner], np.zeros(len(owner))
        step, todo = STRIDE, np.flatnonzero((place % STRIDE == 0) | (place == ends))
        while True:
            bound[todo] = _common(texts.matches, pattern[todo], flat, start[todo], size[todo])
            score[todo] = 200.0 * bound[todo] / (size[todo] + width[todo])
            best = np.maximum.reduceat(score, first)
            if step == 1:
                break
            half = step // 2
            new = np.flatnonzero((place % step == half) & (place != ends))
            after = np.minimum(half, ends[new] - place[new])
            bound[new] = np.minimum(bound[new], np.minimum(bound[new - half] + half, bound[new + after] + after))
            todo = new[200.0 * bound[new] / (size[new] + width[new]) > best[owner[new]]]
            step = half
        out[part] = best
    return out


def _token_set_of(texts: _Texts, numbers, a, b):
    """``token_set_ratio`` of pairs of texts.

    The shared words are a prefix of both sides: its own ratios need no comparison, and of the two sides only the own words are compared.
    """
    import numpy as np

    lists = [sorted(set(t.split())) for t in texts.texts]
    vocabulary = sorted({w for words in lists for w in words})
    ids = {w: i for i, w in enumerate(vocabulary)}
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    held = np.full((len(lists), max(1, int(sizes.max(initial=0)))), -1, np.int64)
    held[np.arange(held.shape[1])[None, :] < sizes[:, None]] = [ids[w] for words in lists for w in words]
    chars = numbers[np.frombuffer("".join(vocabulary).encode("utf-32-le"), np.uint32)] if vocabulary else np.zeros(0, np.int64)
    length = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    begin = np.cumsum(length) - length
    space = numbers[ord(" ")]

    def joined(rows, chosen):
        """The chosen words of each row, joined by spaces: character numbers and lengths."""
        row, col = np.nonzero(chosen)
        w = rows[row, col]
        new = np.diff(row, prepend=-1) != 0
        cells = np.cumsum(length[w] + 1) - (length[w] + 1)
        at = cells - np.repeat(cells[new], np.diff(np.append(np.flatnonzero(new), len(row))))
        total = np.add.reduceat(length[w] + 1, np.flatnonzero(new)) - 1
        out = np.full((len(rows), WORD), texts.pad, np.int16)
        out[row[~new], at[~new] - 1] = space
        inner = np.arange(int(length[w].sum())) - np.repeat(np.cumsum(length[w]) - length[w], length[w])
        out[np.repeat(row, length[w]), np.repeat(at, length[w]) + inner] = chars[np.repeat(begin[w], length[w]) + inner]
        return out, total

    out = np.zeros(len(a))
    for s in range(0, len(a), CHUNK // 4):
        x, y = held[a[s : s + CHUNK // 4]], held[b[s : s + CHUNK // 4]]
        x, y = x[:, : max(1, int((x >= 0).sum(axis=1).max()))], y[:, : max(1, int((y >= 0).sum(axis=1).max()))]
        same = (x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]
        shared = same.any(axis=2)
        left, right = (x >= 0) & ~shared, (y >= 0) & ~same.any(axis=1)
        both, some_left, some_right = shared.any(axis=1), left.any(axis=1), right.any(axis=1)
        score = np.where(both & ~(some_left & some_right), 100.0, 0.0)
        k = np.flatnonzero(some_left & some_right)
        if len(k):
            p, np_ = joined(x[k], left[k])
            q, nq = joined(y[k], right[k])
            found = _common(_places(p, np_, texts.pad), np.arange(len(k)), q.reshape(-1), np.arange(len(k)) * WORD, nq)
            common = np.where(shared[k], length[np.maximum(x[k], 0)] + 1, 0).sum(axis=1)  # with a space after each
            best = 200.0 * (found + common) / (np_ + nq + 2 * common)
            prefix = common - 1
            for own in (np_, nq):
                best = np.where(common > 0, np.maximum(best, 200.0 * prefix / np.maximum(1, prefix + common + own)), best)
            score[k] = best
        out[s : s + CHUNK // 4] = score
    return out


#: The scores of ``pair_scores`` with their plain batch forms.
KINDS = {"ratio": indel_ratios, "token_set": token_set_ratios, "token_sort": token_sort_ratios, "partial": partial_ratios, "jaro_winkler": jaro_winklers}


def pair_scores(a, b, kinds: tuple[str, ...]):
    """Scores of many pairs by kind, as their batch forms give them.

    What depends on one text is computed once for each distinct text, and all scores share it; texts over
    ``WORD`` characters and batches of many different characters take the batch forms.
    """
    import numpy as np

    n = len(a)
    out = {kind: np.zeros(n) for kind in kinds}
    if not n:
        return out
    ids, texts = pd.factorize(np.concatenate([np.asarray(a, object), np.asarray(b, object)]))
    pairs, back = np.unique(ids[:n] * len(texts) + ids[n:], return_inverse=True)
    left, right = pairs // len(texts), pairs % len(texts)
    brief = np.fromiter((len(t) <= WORD for t in texts), bool, len(texts))
    points = np.frombuffer("".join(t for t, s in zip(texts, brief, strict=True) if s).encode("utf-32-le"), np.uint32)
    used = np.zeros(int(points.max(initial=ord(" "))) + 1, bool)
    used[points] = used[ord(" ")] = True
    numbers, alphabet = np.cumsum(used) - 1, int(used.sum())
    fast = brief[left] & brief[right] & (alphabet <= 4 * WORD)
    found = {kind: np.zeros(len(pairs)) for kind in kinds}
    slow = np.flatnonzero(~fast)
    slow = slow[np.argsort([len(texts[left[i]]) + len(texts[right[i]]) for i in slow], kind="stable")] if len(slow) else slow
    for s in range(0, len(slow), 4096):
        part = slow[s : s + 4096]
        x, y = [texts[i] for i in left[part]], [texts[i] for i in right[part]]
        for kind in kinds:
            found[kind][part] = KINDS[kind](x, y)
    if fast.any():
        new = np.cumsum(brief) - 1
        short = [t for t, s in zip(texts, brief, strict=True) if s]
        rows = _Texts(short, numbers, alphabet)
        x, y = new[left[fast]], new[right[fast]]
        total = rows.lengths[x] + rows.lengths[y]
        common = _common_of(rows, x, y) if {"ratio", "partial"} & set(kinds) else None
        scored = {
            "ratio": lambda: _ratios(common, total),
            "partial": lambda: _partial_of(rows, x, y, common),
            "token_set": lambda: _token_set_of(rows, numbers, x, y),
            "token_sort": lambda: _token_sort_of(short, numbers, alphabet, x, y),
            "jaro_winkler": lambda: _jaro_winkler_of(rows, x, y),
        }
        for kind in kinds:
            found[kind][fast] = scored[kind]()
    return {kind: found[kind][back] for kind in kinds}


def _token_sort_of(texts: list[str], numbers, alphabet: int, a, b):
    rows = _Texts([" ".join(sorted(t.split())) for t in texts], numbers, alphabet)
    return _ratios(_common_of(rows, a, b), rows.lengths[a] + rows.lengths[b])


def _jaro_winkler_of(texts: _Texts, a, b):
    import numpy as np

    out = np.ones(len(a))  # equal texts, two empty ones among them
    some = np.flatnonzero(a != b)
    out[some] = 0.0
    some = some[(texts.lengths[a[some]] > 0) & (texts.lengths[b[some]] > 0)]
    some = some[np.argsort(texts.lengths[a[some]], kind="stable")]
    for s in range(0, len(some), CHUNK):
        part = some[s : s + CHUNK]
        out[part] = _jaro_winkler_rows(texts.codes[a[part]], texts.codes[b[part]], texts.lengths[a[part]], texts.lengths[b[part]], texts.matches, b[part], texts.pad)
    return out


def pair_scorer(parts: dict[str, tuple[str, ...]]):
    """A column function of two columns for each part: a struct of the part's scores, ``<part>_<kind>``, NULL where a side is."""
    names = [f"{p}_{kind}" for p, kinds in parts.items() for kind in kinds]

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in names]))
    def score(*sides: pd.Series) -> pd.DataFrame:
        import numpy as np

        made = {}
        for (p, kinds), a, b in zip(parts.items(), sides[::2], sides[1::2], strict=True):
            known = (a.notna() & b.notna()).to_numpy()
            scores = pair_scores(a[known], b[known], kinds)
            for kind in kinds:
                column = np.full(len(a), np.nan)
                column[known] = scores[kind]
                made[f"{p}_{kind}"] = pd.Series(column).where(known)
        return pd.DataFrame(made)

    return score


def _scorer(many):
    """A column function of a batch scorer: distinct pairs are scored once, shorter ones first and some thousands at a time."""

    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        if known.any():
            pairs = list(zip(a[known], b[known], strict=True))
            distinct = sorted(set(pairs), key=lambda p: len(p[0]) + len(p[1]))
            found: dict[tuple[str, str], float] = {}
            for i in range(0, len(distinct), 4096):
                part = distinct[i : i + 4096]
                found.update(zip(part, many([p[0] for p in part], [p[1] for p in part]).tolist(), strict=True))
            out[known] = [found[p] for p in pairs]
        return pd.Series(out).where(known)

    return score


token_set = _scorer(token_set_ratios)
#: As SQL has it: two empty strings have nothing in common.
sql_jaro_winkler = _scorer(functools.partial(jaro_winklers, both_empty=0.0))
