"""Candidate pairs by capped blocking keys: one long key table, one join.

All keys of a record become rows (bit, country, key). Blocks are counted on the vendor side, those over
their blocker's cap vanish, and one equi-join with the reference side gives all pairs; the bits of a pair
are joined to a mask. The join emits at most cap rows for each reference key, so it cannot blow up with a
hot key; a hot key on the reference side is left to the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BITS, BLOCKERS, KEY_COLUMNS, LIST_KEYS
from ..functions.keys import normalised, tokenised, with_keys
from ..sources.staging import materialize
from .frequency import address_frequencies, name_frequencies, with_ranks


def keyed_records(records: DataFrame, frequencies_of: DataFrame | None = None, **limits) -> DataFrame:
    """Raw records -> keyed records. ``frequencies_of``: the records that rarity counts over (default: all of these).

    Tokens are written once: frequencies, ranking and keys all read them, and parsing is the costly part, so
    records are dealt out by number and not by their few bytes.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = lambda rows: tokenised(normalised(rows.repartition(parts, "entity_id")))
    tokens = materialize(parsed(records), "tokens")
    counted = tokens if frequencies_of is None else materialize(parsed(frequencies_of), "counted")
    return with_keys(with_ranks(tokens, name_frequencies(counted), address_frequencies(counted)), **limits)


def sampled(records: DataFrame, fraction: float) -> DataFrame:
    """Reference records of a sample by hash of their id, one that any engine has; vendors all stay."""
    keep = F.conv(F.left(F.md5("entity_id"), F.lit(8)), 16, 10).cast("long") % 10_000 < int(fraction * 10_000)
    return records.where((F.col("source") != 1) | keep)


def _tagged(keys: Column, bit: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(bit).alias("bit"), k.alias("key")))


def long_keys(keyed: DataFrame, blockers=None, use_country: bool = True) -> DataFrame:
    """``(entity_id, source, country, bit, key)``, a row for each key of each record."""
    parts = []
    for b in blockers or BLOCKERS:
        c = F.col(KEY_COLUMNS[b])
        items = c if KEY_COLUMNS[b] in LIST_KEYS else F.when(c.isNotNull(), F.array(c))
        parts.append(_tagged(F.coalesce(items, F.array().cast("array<string>")), BITS[b]))
    country = F.col("country") if use_country else F.lit("")
    return keyed.select("entity_id", "source", country.alias("country"), F.explode(F.concat(*parts)).alias("k")).select("entity_id", "source", "country", "k.bit", "k.key")


def cap_of(bit: Column, caps: dict[str, int] | None = None) -> Column:
    limits = BLOCKERS | (caps or {})
    return F.element_at(F.array(*(F.lit(limits[b]) for b in BLOCKERS)), bit + 1)


def block_sizes(keys: DataFrame) -> DataFrame:
    """Vendor records of each block: ``(bit, country, key, n)``."""
    return keys.where("source <> 1").groupBy("bit", "country", "key").agg(F.count("*").alias("n"))


def block_stats(keys: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Blocks and vendor records that each blocker keeps and drops."""
    over = F.col("n") > cap_of(F.col("bit"), caps)
    return block_sizes(keys).groupBy("bit").agg(
        F.count("*").alias("blocks"), F.count_if(over).alias("dropped_blocks"), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("dropped_vendor_records"), F.max("n").alias("largest")
    )


def key_matches(keys: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """``(s1_id, cand_id, source, bit)``: pairs that share a block within its cap, a row for each shared key."""
    blocks = block_sizes(keys).where(F.col("n") <= cap_of(F.col("bit"), caps)).drop("n")
    vendors = keys.where("source <> 1").join(blocks, ["bit", "country", "key"]).select("bit", "country", "key", F.col("entity_id").alias("cand_id"), "source")
    ours = keys.where("source = 1").select("bit", "country", "key", F.col("entity_id").alias("s1_id"))
    return ours.join(vendors, ["bit", "country", "key"]).select("s1_id", "cand_id", "source", "bit")


def candidates(keys: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """``(s1_id, cand_id, source, mask)``: each pair once, with a bit for each blocker that found it."""
    return key_matches(keys, caps).groupBy("s1_id", "cand_id").agg(F.max("source").alias("source"), F.bit_or(F.expr("shiftleft(1, bit)")).alias("mask"))


def blocker_pairs(keys: DataFrame, blocker: str, caps: dict[str, int] | None = None) -> DataFrame:
    """Distinct pairs of one blocker."""
    return key_matches(keys.where(F.col("bit") == BITS[blocker]), caps).select("s1_id", "cand_id", "source").distinct()


def grouped(reference: DataFrame, pairs: DataFrame, name: str = "candidate_entity_ids") -> DataFrame:
    """One row for each reference record: its candidates sorted and joined by commas, empty if none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))
    every = reference.select(F.col("entity_id").alias("source1_entity_id"))
    return every.join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select("source1_entity_id", F.coalesce("ids", F.lit("")).alias(name))
