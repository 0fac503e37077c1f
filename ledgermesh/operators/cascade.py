"""Second stage: survivors of the first stage's probabilities with context and sibling features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import token_set
from .evaluate import labelled, percent
from .rules import ranked

CONTEXT = ("p1", "rk", "gap", "ratio", "best_p", "second_p", "n_surv", "sum_p", "n_hi", "n_blocked")
SIBLINGS = ("sib_support_n", "sib_support_a", "sib_top_n", "sib_top_a", "sib_max_n", "sib_n_close", "sib_top_p")


def survivors(predictions: DataFrame, k: int = 10, eps: float = 0.01) -> DataFrame:
    """Best ``k`` pairs of each reference record with p of ``eps`` or more.

    best_p, n_blocked and n_hi look at all candidates, the rest at survivors only. One exchange serves all windows.
    """
    group = Window.partitionBy("s1_id")
    all_ = ranked(predictions, "p").select(
        "s1_id", "cand_id", F.col("p").alias("p1"), "rk", F.max("p").over(group).alias("best_p"), F.count("*").over(group).cast("double").alias("n_blocked"),
        F.sum(F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)).over(group).alias("n_hi"),
    )
    kept = all_.where((F.col("rk") <= k) & (F.col("p1") >= eps))
    whole = group.orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return kept.select(
        "s1_id", "cand_id", "p1", F.col("rk").cast("double").alias("rk"), (F.col("best_p") - F.col("p1")).alias("gap"), (F.col("p1") / F.nullif(F.col("best_p"), F.lit(0.0))).alias("ratio"), "best_p",
        F.coalesce(F.nth_value("p1", 2).over(whole), F.lit(0.0)).alias("second_p"), F.count("*").over(group).cast("double").alias("n_surv"), F.sum("p1").over(group).alias("sum_p"), "n_hi", "n_blocked",
    )


def with_siblings(kept: DataFrame, vendors: DataFrame, close: float = 90.0) -> DataFrame:
    """Adds how a survivor resembles the other survivors of its reference record; null where it has none.

    The self join is on the reference id, so a record gives at most k * (k - 1) pairs.
    """
    texts = vendors.select(F.col("entity_id").alias("cand_id"), F.struct(F.coalesce("name_norm", F.lit("")).alias("name"), F.coalesce("address_norm", F.lit("")).alias("address")).alias("of"))
    members = kept.select("s1_id", "cand_id", F.col("p1").alias("chance"), "rk").join(texts, "cand_id")
    mine, theirs = members.select("s1_id", "cand_id", "of").alias("mine"), members.alias("theirs")
    met = mine.join(theirs, (F.col("mine.s1_id") == F.col("theirs.s1_id")) & (F.col("mine.cand_id") != F.col("theirs.cand_id")))
    addressed = (F.col("mine.of.address") != "") & (F.col("theirs.of.address") != "")
    likeness = met.select(
        "mine.s1_id", "mine.cand_id", "theirs.chance", F.struct("theirs.rk", "theirs.cand_id").alias("order"), addressed.alias("addressed"),
        token_set("mine.of.name", "theirs.of.name").alias("by_name"), token_set("mine.of.address", "theirs.of.address").alias("any_address"),
    ).withColumn("by_address", F.when(F.col("addressed"), F.col("any_address")))
    first = F.min_by(F.struct("by_name", "by_address", "chance"), "order")
    support = lambda score: F.max(F.col("chance") * score / 100)
    summed = likeness.groupBy("s1_id", "cand_id").agg(
        support(F.col("by_name")).alias("sib_support_n"), support(F.coalesce("by_address", F.lit(0.0))).alias("sib_support_a"), first.alias("first"), F.max("by_name").alias("sib_max_n"),
        F.sum((F.col("by_name") >= close).cast("double")).alias("sib_n_close"),
    )
    shown = summed.select("s1_id", "cand_id", "sib_support_n", "sib_support_a", F.col("first.by_name").alias("sib_top_n"), F.col("first.by_address").alias("sib_top_a"), "sib_max_n", "sib_n_close", F.col("first.chance").alias("sib_top_p"))
    return kept.join(shown, ["s1_id", "cand_id"], "left")


def evaluate_grid(predictions: DataFrame, truth: DataFrame, reference: DataFrame, ks=(3, 5, 8, 10, 15, 20, 30), epss=(0.0, 0.005, 0.02)) -> DataFrame:
    """A row for each (K, eps): pairs, pairs for each record, recall, recall lost, reduction; one aggregate counts all settings."""
    settings = [(k, e) for k in ks for e in epss]
    placed = labelled(ranked(predictions, "p"), truth).select("p", "rk", "y")
    within = lambda k, e: (F.col("rk") <= k) & (F.col("p") >= e)
    counts = [c for i, (k, e) in enumerate(settings) for c in (F.count_if(within(k, e)).alias(f"n{i}"), F.count_if(within(k, e) & F.col("y")).alias(f"tp{i}"))]
    one = placed.agg(F.count("*").alias("base"), F.count_if("y").alias("base_tp"), *counts).crossJoin(truth.agg(F.count("*").alias("n_gt"))).crossJoin(reference.agg(F.count("*").alias("n_s1")))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(e)).alias("eps"), F.col(f"n{i}").alias("pairs"), F.col(f"tp{i}").alias("tp")) for i, (k, e) in enumerate(settings)))
    out = one.select("base", "base_tp", "n_gt", "n_s1", F.inline(rows))
    return out.select(
        "k", "eps", "pairs", F.round(F.col("pairs") / F.col("n_s1"), 4).alias("per_s1"), percent(F.col("tp"), F.col("n_gt")).alias("recall"), percent(F.col("base_tp") - F.col("tp"), F.col("n_gt")).alias("lost"),
        F.round(F.col("base") / F.greatest("pairs", F.lit(1)), 1).alias("reduction"),
    )
