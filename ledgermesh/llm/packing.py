"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt to randomised groups of about ``group_docs`` documents and each group is packed on its
own. A document longer than a sequence is cut into full sequences and a remainder. Within a group, pieces
go longest first into the leftmost bin that has room, found by descending the tree of capacities, and there
they stay. Only a group's last bin, the emptiest, is cut at powers of two, which need no padding. Ids travel
to their group once, as 16-bit numbers where the vocabulary allows it.
"""

from __future__ import annotations

import codecs
import functools
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_batches, worker_cache

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 2048
#: Bytes of text of an average group at most, so that groups of long documents fit a task.
GROUP_BYTES = 16 << 20
#: Words of a generation whose ids a worker keeps; when full, the generation before it goes and the words
#: still met move on.
CACHE_WORDS = 200_000
#: Characters below this take the fast path; others are left to the tokenizer as a whole.
_SIMPLE = "ɐ"


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space, so each run of other characters is encoded alone and its ids kept.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: whether words of letters, with a stop or without, may hold a special token
        self.plain_special = any(s.strip(".,").isalpha() or not s.strip(".,") for s in self.special)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.stops = {c: self.whole(c) for c in ".,"}
        self.odd = regex.compile("[\x1c-\x1f]").search
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.shown = "".join(shown[b] for b in range(256))

    def whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        letters = word.isalpha() or word[-1] in ".," and word[:-1].isalpha()
        if (self.plain_special or not letters) and any(s in word.lower() for s in self.special):
            return self.whole(word)  # special tokens in a text are what the tokenizer makes of them
        if not word.isascii():
            if max(word) >= _SIMPLE:
                return self.whole(word)
            word = unicodedata.normalize("NFC", word)
        word = word.lower()
        if word.isalpha():
            return _pack([t.id for t in self.model.tokenize(self.spelled(word))])
        if word[-1] in ".," and word[:-1].isalpha():  # the usual case: a word and a stop
            stem = word[:-1]
            return (self.words.get(stem) or self.older.get(stem) or self.word(stem)) + self.stops[word[-1]]
        return _pack([t.id for part in self.split(word) for t in self.model.tokenize(self.spelled(part))])

    def spelled(self, part: str) -> str:
        """The part as the tokenizer's vocabulary spells its bytes."""
        return part if part.isascii() and part.isprintable() else codecs.charmap_decode(part.encode(), "strict", self.shown)[0]

    def ids(self, text: str) -> bytes:
        if self.odd(text):  # Python splits at these, the tokenizer does not
            return self.whole(text)
        if len(self.words) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        words, older, parts = self.words, self.older, text.split()
        for w in set(parts).difference(words):
            words[w] = older.get(w) or self.word(w)
        return b"".join(map(words.__getitem__, parts))


def _pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


worker_cache(lambda: word_ids.cache_clear())


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids binary, deal long)``: unsigned ids with the end id, 16 bits each if all fit, else 32.

    A first byte gives the width. ``deal`` tells rows apart, also those that repeat each other: it hashes the
    row, the task and how often the row came before in it, which a task that runs again finds alike, in
    whatever order its rows arrive.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release_memory(keep_caches=True)
        coder = word_ids(path)
        end = _pack([END_ID])
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            ids, deal = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _narrow(coder.ids(t or "") + end)
                h = xxhash.xxh64_intdigest(own, hash(d) & (1 << 63) - 1)
                seen[h] = n = seen.get(h, 0) + 1
                ids.append(own)
                deal.append(xxhash.xxh64_intdigest(b"%d %d %d" % (h, part, n)) >> 1)
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(deal, pa.int64())], names=["doc_id", "ids", "deal"])
        release_memory(keep_caches=True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, deal long")


def _narrow(ids: bytes) -> bytes:
    import numpy as np

    wide = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\x04" + ids


def _wide(packed: bytes) -> bytes:
    import numpy as np

    return np.frombuffer(packed, dtype="<u2", offset=1).astype("<u4").tobytes() if packed[0] == 2 else packed[1:]


class Tournament:
    """Bins of one capacity under a tree whose nodes hold the largest room below them."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1
        while self.size < bins:
            self.size *= 2
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Takes ``length`` from the leftmost bin with room for it and returns its number."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < length:
                at += 1
        room[at] -= length
        found = at - self.size
        while at > 1:
            at //= 2
            largest = max(room[2 * at], room[2 * at + 1])
            if room[at] == largest:
                break
            room[at] = largest
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item; ties in the order given."""
    tree = Tournament(max(1, len(lengths)), capacity)
    bins = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins[i] = tree.place(lengths[i])
    return bins


def pack(lengths: list[int], sequence: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these token counts, cut as need be.

    All are bins of first-fit decreasing; the last one is cut into sequences of powers of two.
    """
    items = [(d, at, min(sequence, n - at)) for d, n in enumerate(lengths) for at in range(0, n, sequence)]
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for item, b in zip(items, first_fit_decreasing([x[2] for x in items], sequence), strict=True):
        bins.setdefault(b, []).append(item)
    out = [x for _, x in sorted(bins.items())]
    return out[:-1] + _powers(out[-1]) if out else []


def _powers(items: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of one bin laid end to end and cut into sequences of powers of two, longest first."""
    left, at, out = sum(x[2] for x in items), 0, []
    items = list(items)
    while left:
        size = 1 << (left.bit_length() - 1)
        own, left = [], left - size
        while size:
            d, start, n = items[at]
            take = min(n, size)
            own.append((d, start, take))
            size -= take
            if take == n:
                at += 1
            else:
                items[at] = (d, start + take, n - take)
        out.append(own)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A row for each piece; each id of each document is in exactly one. Ids are those that the tokenizer gives
    by default, special tokens in a text included. Null texts count as empty and hold just the end id. A text
    of any length is cut into pieces. Repeated rows and rows without an id are documents of their own; other
    columns are ignored; an empty table gives no pieces.
    """
    coded = token_ids(docs, path)
    held = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()
    groups = max(1, -(-held["n"] // group_docs), -(-(held["bytes"] or 0) // GROUP_BYTES))
    dealt = coded.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "deal"), F.lit(groups))).drop("deal")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        group, doc_ids, ids = key[0].as_py(), table.column("doc_id").to_pylist(), [_wide(x) for x in table.column("ids").to_pylist()]
        counts = [len(x) // 4 for x in ids]
        rows = []
        for number, own in enumerate(pack(counts, sequence)):
            offset = 0
            for d, start, length in own:
                rows.append((doc_ids[d], start, length, zlib.crc32(ids[d][4 * start : 4 * (start + length)]), counts[d], (group << 32) + number, offset))
                offset += length
        return pa.table([pa.array([r[j] for r in rows], pa.int64()) for j in range(7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return dealt.groupBy("group").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
