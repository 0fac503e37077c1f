"""Vendor records that arrive as a stream, matched against a fixed reference key table.

Each micro-batch is keyed with given frequencies and joined to the reference keys: stateless, so there is
no watermark to wait for. Caps need whole-corpus block counts, which are given as a table, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import normalised, tokenised, with_keys
from ..operators.blocking import long_keys
from ..operators.frequency import with_ranks


def stream_matches(arrivals: DataFrame, reference_keys: DataFrame, allowed_blocks: DataFrame, names: DataFrame, addresses: DataFrame, write_batch, checkpoint: str):
    """Starts a query that calls ``write_batch(candidates, batch_id)`` for every micro-batch of raw vendor records.

    ``reference_keys`` are long keys of the reference records, ``allowed_blocks`` (bit, country, key) the
    blocks within their cap, ``names`` and ``addresses`` the frequency tables.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        keys = long_keys(with_keys(with_ranks(tokenised(normalised(batch)), names, addresses)))
        vendors = keys.join(allowed_blocks, ["bit", "country", "key"], "left_semi").select("bit", "country", "key", F.col("entity_id").alias("cand_id"), "source")
        ours = reference_keys.select("bit", "country", "key", F.col("entity_id").alias("s1_id"))
        found = ours.join(vendors, ["bit", "country", "key"]).groupBy("s1_id", "cand_id").agg(F.max("source").alias("source"), F.bit_or(F.expr("shiftleft(1, bit)")).alias("mask"))
        write_batch(found, batch_id)

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
