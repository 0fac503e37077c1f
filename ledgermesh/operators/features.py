"""Pair features: name and address similarity, numbers, blocker evidence, context of the reference record.

Missing numbers stay NULL here (a model imputes them), so windows and sorts see no NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BITS, LEGAL_FEATURES
from ..functions.similarity import pair_scorer
from ..functions.text import words

SCORED = ("n_ratio", "n_tset", "n_tsort", "n_partial", "n_jw", "core_ratio", "core_tset", "core_partial", "a_tset", "a_ratio", "a_partial")
EXACT = (
    "compact_eq", "core_subset", "core_jacc", "first_tok_eq", "ntok1", "ntok2", "len_diff", "v_addr_empty", "hnum_eq", "hnum_conflict", "hnum_missing", "post_eq", "post_conflict", "num_jacc",
    *(f"blk_{b}" for b in BITS), "blk_count", "source",
)
CONTEXT = ("s1_ncand", "n_tset_gap", "n_tset_rank", "core_ratio_gap", "core_ratio_rank", "a_tset_gap", "a_tset_rank", "s1_n_strong")
FEATURES = (*SCORED[:8], *EXACT[:8], *SCORED[8:], *EXACT[8:], *CONTEXT)


def fetch(pairs: DataFrame, reference: DataFrame, vendors: DataFrame) -> DataFrame:
    """The pairs with both sides' text: names n, addresses a, house numbers h, postcodes p; empty where missing."""
    side = lambda df, i, key: df.select(F.col("entity_id").alias(key), *(F.coalesce(c, F.lit("")).alias(f"{s}{i}") for s, c in (("n", "name_norm"), ("a", "address_norm"), ("h", "hnum"), ("p", "postcode"))))
    return pairs.join(side(reference, 1, "s1_id"), "s1_id").join(side(vendors, 2, "cand_id"), "cand_id")


def core(name: Column) -> Column:
    """Words of a name without legal forms."""
    return F.filter(words(name), lambda t: ~t.isin(LEGAL_FEATURES))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _jaccard(a: Column, b: Column) -> Column:
    """Null if both sides are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))


def exact_features(rows: DataFrame) -> DataFrame:
    """Adds the features that need no similarity scorer, and ``c1``, ``c2``: the core names."""
    rows = rows.withColumn("w1", core(F.col("n1"))).withColumn("w2", core(F.col("n2")))
    rows = rows.withColumn("t1", F.array_distinct("w1")).withColumn("t2", F.array_distinct("w2"))
    numbers = lambda a: F.array_distinct(F.filter(words(a), lambda t: t.rlike("^[0-9]+$")))
    c1, c2 = F.array_join("w1", " "), F.array_join("w2", " ")
    both = lambda a, b: (F.col(a) != "") & (F.col(b) != "")
    inside = (F.size(F.array_except("t1", "t2")) == 0) | (F.size(F.array_except("t2", "t1")) == 0)
    made = rows.select(
        "*", c1.alias("c1"), c2.alias("c2"),
        _flag((F.array_join("w1", "") == F.array_join("w2", "")) & (F.size("w1") > 0)).alias("compact_eq"),
        _flag((F.size("t1") > 0) & (F.size("t2") > 0) & inside).alias("core_subset"),
        F.coalesce(_jaccard(F.col("t1"), F.col("t2")), F.lit(0.0)).alias("core_jacc"),
        _flag((F.size("w1") > 0) & (F.try_element_at("w1", F.lit(1)) == F.try_element_at("w2", F.lit(1)))).alias("first_tok_eq"),
        F.size("t1").cast("double").alias("ntok1"), F.size("t2").cast("double").alias("ntok2"),
        F.abs(F.length("n1") - F.length("n2")).cast("double").alias("len_diff"),
        _flag(F.col("a2") == "").alias("v_addr_empty"),
        _flag(both("h1", "h2") & (F.col("h1") == F.col("h2"))).alias("hnum_eq"), _flag(both("h1", "h2") & (F.col("h1") != F.col("h2"))).alias("hnum_conflict"), _flag(~both("h1", "h2")).alias("hnum_missing"),
        _flag(both("p1", "p2") & (F.col("p1") == F.col("p2"))).alias("post_eq"), _flag(both("p1", "p2") & (F.col("p1") != F.col("p2"))).alias("post_conflict"),
        _jaccard(numbers(F.col("a1")), numbers(F.col("a2"))).alias("num_jacc"),
        *(_flag(F.col("mask").bitwiseAND(1 << i) != 0).alias(f"blk_{b}") for b, i in BITS.items()),
        F.bit_count("mask").cast("double").alias("blk_count"),
    )
    return made.drop("w1", "w2", "t1", "t2")


_scores = pair_scorer({"n": ("ratio", "token_set", "token_sort", "partial", "jaro_winkler"), "core": ("ratio", "token_set", "partial"), "a": ("token_set", "ratio", "partial")})
_SHORT = {"token_set": "tset", "token_sort": "tsort", "jaro_winkler": "jw"}


def scored_features(rows: DataFrame) -> DataFrame:
    """Adds the similarity scores, all of a pair in one call; address scores are null where the vendor has no address."""
    made = rows.withColumn("_s", _scores("n1", "n2", "c1", "c2", F.when(F.col("a2") != "", F.col("a1")), "a2"))
    short = lambda name: "_".join((name.split("_", 1)[0], _SHORT.get(name.split("_", 1)[1], name.split("_", 1)[1])))
    return made.select("*", *(F.col(f"_s.{f.name}").alias(short(f.name)) for f in made.schema["_s"].dataType)).drop("_s")


def context_features(rows: DataFrame, strong: float = 90.0, scores: tuple[str, ...] = ("n_tset", "core_ratio", "a_tset")) -> DataFrame:
    """Adds each pair's place among the candidates of its reference record, by each of ``scores``.

    The first of them also counts strong candidates. All windows share one partitioning.
    """
    group = Window.partitionBy("s1_id")
    out = rows.withColumn("s1_ncand", F.count("*").over(group).cast("double")).withColumn("s1_n_strong", F.sum(F.when(F.col(scores[0]) >= strong, 1.0).otherwise(0.0)).over(group))
    for c in scores:
        v = F.coalesce(F.col(c), F.lit(-1.0))
        out = out.withColumn(f"{c}_gap", F.max(v).over(group) - v).withColumn(f"{c}_rank", F.rank().over(group.orderBy(v.desc())).cast("double"))
    return out


def build_features(pairs: DataFrame, reference: DataFrame, vendors: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, <49 features>)`` for every candidate pair.

    Scoring costs far more than its rows' bytes tell, so the pairs are dealt to a fixed number of tasks, by
    reference record, whose name is then met again.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fetch(pairs, reference, vendors).repartition(parts, "s1_id")
    return context_features(scored_features(exact_features(rows))).select("s1_id", "cand_id", *(F.col(f).cast("double").alias(f) for f in FEATURES))
