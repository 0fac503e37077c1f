"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap, each chunk is pre-tokenised on its own, and the chunks are
stitched where their pre-token boundaries resynchronise: from the first boundary on which both agree
inside the overlap, the left chunk's pre-tokens stop and the right chunk's take over. A pattern match
depends only on where it starts and on the characters that follow, so two scans that share a boundary
agree from there on, save for matches that touch the end of the left chunk; those are not trusted. Where
two chunks share no boundary, the left scan goes on through the right chunk until it meets one that a
later chunk has, too. The pieces between stitches are then encoded apart, and decoding concatenates the
tokens' raw bytes.

Every text goes this way. Chunks of texts of up to ``SPREAD_CHARS`` stay in their task; those of longer
ones are rows of their own, dealt out evenly, so scanning and encoding a huge document are spread over
many tasks, and one task at a time holds no more than one document, as any row does.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_batches

RANKS = "byte_bpe_50k.tiktoken"
CHUNK_CHARS, OVERLAP_CHARS = 1 << 10, 1 << 7
#: Characters of a text up to which its chunks stay in one task, and of a chunk that is dealt to another.
SPREAD_CHARS = 1 << 16


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text``."""
    found = regex.findall(pattern, text)
    ends = list(accumulate(map(len, found)))
    if ends and ends[-1] == len(text):
        return ends
    return [m.end() for m in regex.finditer(pattern, text)]  # a pattern that skips characters


def chunks(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans that cover n characters; each starts ``overlap`` before the last one's end."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            return out
        at += size - overlap


def edges(text: str, start: int, pattern: str, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk that starts at ``start`` in its first and its last overlap, as absolute positions.

    A pre-token that ends in white space is no place to cut: how a run of white space splits depends on the
    character after it. At the end of a chunk, a boundary counts only if two more matches follow it: what
    touches the chunk's end may go on beyond.
    """
    ends = boundaries(text, pattern)
    head = ends[: bisect_right(ends, overlap)]
    tail = ends[bisect_right(ends, len(text) - overlap) : max(0, len(ends) - 2)]
    return [start + e for e in head if not text[e - 1].isspace()], [start + e for e in tail if not text[e - 1].isspace()]


def stitch(heads: list[list[int]], tails: list[list[int]], rescan: Callable[[int, int], list[int]]) -> list[int]:
    """Where neighbouring chunks resynchronise: the first boundary that both have.

    Where two chunks share none (one pre-token fills the overlap), the right one is not known to be in step.
    ``rescan(a, k)``, the last boundaries of chunk k when scanned from the known boundary ``a``, then takes
    the place of its own ones. It is asked after 1, 2, 4, ... such chunks, so all scans together stay linear.
    """
    cuts, at, lost = [], 0, 0
    for k, head in enumerate(heads[1:]):
        if not lost:
            known = set(tails[k])
        elif lost & (lost - 1) == 0:
            known = set(rescan(at, k))
        else:
            known = set()
        found = next((e for e in head if e in known), None)
        lost = lost + 1 if found is None else 0
        if found is not None:
            cuts.append(found)
            at = found
    return cuts


def pretoken_pieces(text: str, pattern: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """Spans of ``text`` that can be encoded apart: chunk scans stitched where they resynchronise."""
    spans = chunks(len(text), size, overlap)
    if len(spans) == 1:
        return [(0, len(text))] if text else []
    made = [edges(text[a:b], a, pattern, overlap) for a, b in spans]
    cuts = stitch([h for h, _ in made], [t for _, t in made], lambda a, k: edges(text[a : spans[k][1]], a, pattern, overlap)[1])
    at = [0, *cuts, len(text)]
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if b > a]


def encode_text(text: str, enc, pattern: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Ids of a text, its pieces encoded one by one."""
    ids: list[int] = []
    for a, b in pretoken_pieces(text, pattern, size, overlap):
        ids += enc.encode_ordinary(text[a:b])
    return ids


def digest(ids: list[int], decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, spread: int = SPREAD_CHARS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids array<int>)``, a row for each input row.

    Null texts count as empty and have no ids; repeated rows and a null doc_id are kept; other columns are
    ignored; an empty table gives no rows. Texts may be of any length that a row holds.
    """
    if min(size, spread) <= 2 * overlap:
        raise ValueError("a chunk must be longer than two overlaps")
    path = path or public_tokenizers.path(RANKS)
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    inside = rows.where(F.length("text") <= spread)

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(path, pattern)
        ids = [encode_text(t, enc, pattern, size, overlap) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    direct = map_arrow(inside, whole, "doc_id long, ids array<int>")
    return direct.unionByName(_encode_spread(rows.where(F.length("text") > spread), path, pattern, size, overlap, spread))


def _encode_spread(rows: DataFrame, path: str, pattern: str, size: int, overlap: int, spread: int) -> DataFrame:
    """Long texts: chunks scanned in parallel, stitched by document, then the pieces encoded in parallel."""
    step = spread - overlap
    copies = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    numbered = copies.select("doc_id", F.xxhash64("text").alias("row"), "copies", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, (a, b) in enumerate(chunks(len(text), spread, overlap)):
                    keys = [pa.array([x], pa.int64()) for x in (doc_id, row, n, len(text), i)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([text[a:b]])], names=["doc_id", "row", "copies", "n", "i", "chunk"])

    parts = numbered.mapInArrow(cut, "doc_id long, row long, copies long, n long, i long, chunk string").repartition("doc_id", "row", "i")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [edges(text, i * step, pattern, overlap) for i, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        heads, tails = ([m[j] for m in made] for j in (0, 1))
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64())), batch.column(5)], names=["doc_id", "row", "copies", "n", "i", "heads", "tails", "chunk"])

    scanned = map_arrow(parts, scan, "doc_id long, row long, copies long, n long, i long, heads array<long>, tails array<long>, chunk string")

    def join(chunk_rows: pa.Table) -> pa.Table:
        """The pieces of one document: from each stitch to the next, taken from the chunks that cover them."""
        found = chunk_rows.sort_by("i")
        heads, tails, texts = (found.column(c).to_pylist() for c in ("heads", "tails", "chunk"))

        def between(a: int, b: int) -> str:
            k, out = a // step, []
            while a < b:
                stop = min(b, k * step + len(texts[k]))
                out.append(texts[k][a - k * step : stop - k * step])
                a, k = stop, k + 1
            return "".join(out)

        cuts = stitch(heads, tails, lambda a, k: edges(between(a, k * step + len(texts[k])), a, pattern, overlap)[1])
        at = [0, *cuts, found.column("n")[0].as_py()]
        pieces = [between(a, b) for a, b in zip(at, at[1:], strict=False)]
        keys = [pa.array([found.column(c)[0].as_py()] * len(pieces), pa.int64()) for c in ("doc_id", "row", "copies")]
        return pa.table([*keys, pa.array(range(len(pieces)), pa.int32()), pa.array(pieces)], names=["doc_id", "row", "copies", "k", "piece"])

    pieces = scanned.groupBy("doc_id", "row").applyInArrow(join, "doc_id long, row long, copies long, k int, piece string").repartition("doc_id", "row", "k")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(path, pattern)
        ids = [encode_text(t, enc, pattern, size, overlap) for t in batch.column(4).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "copies", "k", "ids"])

    done = map_arrow(pieces, encode, "doc_id long, row long, copies long, k int, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids")))
    whole = done.groupBy("doc_id", "row", "copies").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids")


def digests(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoded documents; decoding joins the tokens' bytes."""
    path = path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(path, pattern)
        out = [digest(ids, enc.decode_bytes(ids)) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, bytes binary)``: the tokens' bytes, concatenated."""
    path = path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode_bytes(i or []) for i in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")
