"""Rules over blocker bits, trimming by blocker weights, and one-owner resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BITS
from .evaluate import labelled, percent, score_groups


def has(*blockers: str) -> Column:
    """Whether any of the blockers found the pair."""
    return F.col("mask").bitwiseAND(sum(1 << BITS[b] for b in blockers)) != 0


def found_by(n: int) -> Column:
    return F.bit_count("mask") >= n


def rules() -> dict[str, Column]:
    """The seven rules, each a predicate over the mask."""
    strong = has("addrname", "postname", "postrare")
    same_name = strong | (has("compact") & has("numname", "apair", "addr"))
    return {
        "R1": has("addrname"),
        "R2": strong,
        "R3": same_name,
        "R4": same_name | (has("sorted") & has("nameaddr") & has("numname")),
        "R5": found_by(6),
        "R6": found_by(5),
        "R7": strong | found_by(6),
    }


def predict(pairs: DataFrame, rule: str, one_owner: bool = False) -> DataFrame:
    """``(s1_id, cand_id)`` of the pairs that the rule takes; with one owner, each vendor record goes to the pair of most blockers."""
    chosen = pairs.where(rules()[rule]).select("s1_id", "cand_id", F.bit_count("mask").alias("nb"))
    if one_owner:
        chosen = best_owner(chosen, F.desc("nb"))
    return chosen.select("s1_id", "cand_id")


def best_owner(pairs: DataFrame, first: Column) -> DataFrame:
    """One row for each vendor record: the first by the order given, ties to the smaller reference id."""
    place = F.row_number().over(Window.partitionBy("cand_id").orderBy(first, "s1_id"))
    return pairs.withColumn("place", place).where("place = 1").drop("place")


def rule_scores(pairs: DataFrame, truth: DataFrame, reference: DataFrame, one_owner: bool = False) -> DataFrame:
    """A row for each rule with its score; one pass over the pairs decides all rules."""
    taken = F.filter(F.array(*(F.when(e, F.lit(name)) for name, e in rules().items())), lambda r: r.isNotNull())
    chosen = pairs.select("s1_id", "cand_id", F.bit_count("mask").alias("nb"), F.explode(taken).alias("rule"))
    if one_owner:
        place = F.row_number().over(Window.partitionBy("rule", "cand_id").orderBy(F.desc("nb"), "s1_id"))
        chosen = chosen.withColumn("place", place).where("place = 1")
    names = pairs.sparkSession.createDataFrame([(r,) for r in rules()], "rule string")
    return score_groups(chosen.select("rule", "s1_id", "cand_id"), names, "rule", truth, reference).drop("pairs")


def trim_weights(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``(bit, blocker, tp, fp, weight)``: log odds that a pair of the blocker is true, plus 10."""
    marked = labelled(pairs, truth)
    sums = []
    for b, i in BITS.items():
        on = F.col("mask").bitwiseAND(1 << i) != 0
        sums += [F.count_if(on & F.col("y")).alias(f"tp_{b}"), F.count_if(on & ~F.col("y")).alias(f"fp_{b}")]
    rows = F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(b).alias("blocker"), F.col(f"tp_{b}").alias("tp"), F.col(f"fp_{b}").alias("fp")) for b, i in BITS.items()))
    weight = F.round(F.log((F.col("tp") + 1.0) / (F.col("fp") + 1.0)) + 10.0, 4)
    return marked.agg(*sums).select(F.inline(rows)).withColumn("weight", weight)


def trim_scores(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds ``score``: the sum of the weights of the pair's blockers, rounded to 4 digits."""
    one = weights.agg(F.map_from_entries(F.collect_list(F.struct("bit", "weight"))).alias("w"))  # one row of 14 numbers
    terms = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.element_at("w", F.lit(i))).otherwise(0.0) for i in BITS.values()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return pairs.crossJoin(F.broadcast(one)).withColumn("score", F.round(total, 4)).drop("w")


def ranked(pairs: DataFrame, by: str) -> DataFrame:
    """Adds ``rk``: place within the reference record, best first, ties to the smaller candidate id."""
    return pairs.withColumn("rk", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(by), "cand_id")))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    return ranked(scored, "score").where(F.col("rk") <= k)


def trim_curve(scored: DataFrame, truth: DataFrame, reference: DataFrame, ks=(20, 30, 40, 50, 60, 80, 100, 150)) -> DataFrame:
    """A row for each K: pairs kept, candidates for each reference record, recall and what it loses; one aggregate counts all K."""
    placed = labelled(ranked(scored, "score"), truth).select("y", "rk")
    counts = [c for k in ks for c in (F.count_if(F.col("rk") <= k).alias(f"n{k}"), F.count_if((F.col("rk") <= k) & F.col("y")).alias(f"tp{k}"))]
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("pairs"), F.col(f"tp{k}").alias("tp")) for k in ks))
    base = placed.agg(F.count_if("y").alias("base_tp"), *counts).select("base_tp", F.inline(rows)).where("pairs > 0").crossJoin(truth.agg(F.count("*").alias("n_gt"))).crossJoin(reference.agg(F.count("*").alias("n_s1")))
    return base.select("k", "pairs", F.round(F.col("pairs") / F.col("n_s1"), 4).alias("avg_per_s1"), percent(F.col("tp"), F.col("n_gt")).alias("recall"), percent(F.col("base_tp") - F.col("tp"), F.col("n_gt")).alias("lost"))
