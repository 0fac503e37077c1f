"""Canonical exact digests of documents, in DataFrame operations only.

The canonical form is NFKC, lower case, white space runs folded to one space, trimmed. Its digest is 128
bits wide (two chained xxhash64). Documents that share a digest are then compared byte for byte: where a
digest holds more than one canonical text, each text gets its own suffix, so equal fingerprints mean equal
canonical texts. Nulls count as empty texts. Rows without a doc_id come first in the order, as one
document after which the smallest doc_id follows; rows that repeat a doc_id are kept, each edited by its own
length, and the smallest text stands for the id as somebody's next. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def canonical(text: Column) -> Column:
    """NFKC, lower case, folded white space; null counts as empty."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.trim(F.regexp_replace(F.lower(composed), _SPACE, " "))


def wide_hash(text: Column) -> Column:
    """128 bits as 32 hex digits: xxhash64 of the text, and of the text after a salt."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(0x5BD1E995), text)), 16, "0")))


def resolve(hashed: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Suffixes for digests that stand for several texts: ``(key, h, suffix)``, or None where there are none.

    ``hashed(key, h, ...)`` has a row for each text; ``fetch`` returns ``(key, h, c)`` with the canonical
    text of the rows it is given. Only texts in buckets of two or more rows are fetched; grouping by digest
    and text combines map-side, so a hot group of copies leaves each task as one row.
    """
    several = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    texts = fetch(hashed.join(several, "h", "left_semi"))
    held = texts.groupBy("h", "c").agg(F.count("*").alias("n"))
    mixed = materialize(held.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"), "mixed")
    if mixed.isEmpty():
        return None
    split = held.join(mixed, "h", "left_semi").withColumn("suffix", F.concat(F.lit("-"), F.dense_rank().over(Window.partitionBy("h").orderBy("c")).cast("string")))
    return texts.join(split, ["h", "c"]).select("key", "h", "suffix")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, class_id)``.

    class_id is the smallest doc_id among documents of one canonical text, null if none has one. A row for
    each input row; an empty table gives none.
    """
    rows = numbered(docs.select("doc_id", "text"))
    docs = rows.select(F.col("rid").alias("key"), "text")
    hashed = materialize(docs.select("key", canonical(F.col("text")).alias("c")).select("key", wide_hash(F.col("c")).alias("h")), "digest")
    marks = resolve(hashed, lambda some: docs.join(some.select("key").distinct(), "key").select("key", canonical(F.col("text")).alias("c")).withColumn("h", wide_hash(F.col("c"))))
    made = hashed.withColumn("suffix", F.lit("")) if marks is None else hashed.join(marks.distinct(), ["key", "h"], "left")
    made = made.select(F.col("key").alias("rid"), F.concat("h", F.coalesce("suffix", F.lit(""))).alias("fingerprint"))
    made = made.join(rows.select("rid", "doc_id"), "rid").select("doc_id", "fingerprint")
    least = made.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    return made.join(least, "fingerprint").select("doc_id", "fingerprint", "class_id")


def next_ids(ids: DataFrame) -> DataFrame:
    """``ids(doc_id)`` distinct -> ``(doc_id, next_id)``: the following doc_id; after the last, the first.

    Rows are range-partitioned and numbered by position, so no window spans the table; only one row for
    each partition meets in one place.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(ordered, "order").withColumn("part", F.shiftright("at", 33))
    firsts = placed.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    overall = Window.partitionBy(F.lit(0))
    after = firsts.withColumn("over_id", F.coalesce(F.lead("first_id").over(overall.orderBy("part")), F.min("first_id").over(overall)))
    following = placed.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("at")))
    return following.join(after, "part").select("doc_id", F.coalesce("next_id", "over_id").alias("next_id"))


def _order(rows: DataFrame) -> DataFrame:
    """``rows(rid, doc_id, ...)`` -> ``(rid, next_rid)``: the first row of the following doc_id."""
    if rows.where("rid <> doc_id OR doc_id IS NULL").isEmpty():
        return next_ids(rows.select(F.col("rid").alias("doc_id"))).toDF("rid", "next_rid")
    heads = materialize(rows.groupBy("doc_id").agg(F.min("rid").alias("head")), "heads")
    following = next_ids(heads.select(F.col("head").alias("doc_id"))).toDF("head", "next_rid")
    of_id = heads.select(F.col("doc_id").alias("of_id"), "head")
    own = rows.select("rid", "doc_id").join(of_id, F.col("doc_id").eqNullSafe(F.col("of_id")))
    return own.join(following, "head").select("rid", "next_rid")


def _edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """``docs(rid, text)`` and ``order(rid, doc_id, next_rid, half)`` -> the rows with ``text`` and ``edited``.

    Both joins are on the number that ``docs`` is dealt by and read the same columns of it, so its texts are
    shuffled once and the exchange is used twice; besides, only the heads that the edits need move.
    """
    asked = order.select(F.col("rid").alias("of"), "doc_id", F.col("next_rid").alias("rid"), "half")
    heads = asked.join(docs, "rid").select(F.col("of").alias("rid"), "doc_id", F.col("rid").alias("next_rid"), "half", F.expr("substring(text, 1, half)").alias("head"))
    return docs.join(heads, "rid").withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - half)"), "head"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints each document and its edited text, and compares them with the document's own.

    ``edited`` replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next
    document. An exact digest knows equal and different only, so likeness is 1 or 0. Returns ``(doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, a row for each input
    row; an empty table gives none.
    """
    rows = numbered(docs.select("doc_id", "text"))
    docs = rows.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.select("rid", "doc_id", F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int").alias("half"))
    order = materialize(_order(rows).join(sizes, "rid"), "next")
    made = _edited(docs, order).select("rid", "doc_id", "next_rid", F.length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"), F.sha2("edited", 256).alias("edited_sha256"))
    light = materialize(made.select("rid", "doc_id", "next_rid", "n_chars", "edited_sha256", wide_hash(F.col("c")).alias("fingerprint"), wide_hash(F.col("e")).alias("edited_fingerprint")), "prints")

    key = lambda which: F.struct(F.col("rid"), F.lit(which).alias("of"))
    hashed = light.select(key("text").alias("key"), F.col("fingerprint").alias("h")).unionByName(light.select(key("edited").alias("key"), F.col("edited_fingerprint").alias("h")))

    def fetch(some: DataFrame) -> DataFrame:
        ids = some.select("key.*").distinct()
        plain = docs.join(ids.where("of = 'text'").select("rid"), "rid").select(key("text").alias("key"), canonical(F.col("text")).alias("c"))
        changed = _edited(docs, order.join(ids.where("of = 'edited'").select("rid"), "rid"))
        return plain.unionByName(changed.select(key("edited").alias("key"), canonical(F.col("edited")).alias("c"))).withColumn("h", wide_hash(F.col("c")))

    if (marks := resolve(hashed, fetch)) is not None:
        marks = marks.select("key.*", "suffix")
        for of, name in (("text", "fingerprint"), ("edited", "edited_fingerprint")):
            light = light.join(marks.where(F.col("of") == of).select("rid", "suffix"), "rid", "left").withColumn(name, F.concat(F.col(name), F.coalesce("suffix", F.lit("")))).drop("suffix")
    following = light.select(F.col("rid").alias("next_rid"), F.col("fingerprint").alias("next_print"))
    same = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return light.join(following, "next_rid").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_print").alias("near_next"))
