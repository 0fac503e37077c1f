"""Candidates and predictions against ground truth: recall, precision, coverage, macro F0.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BITS
from ..functions.similarity import token_set


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 where there is no whole."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0)), digits), F.lit(0.0))


def truth_pairs(truth: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """``(s1_id, cand_id)`` distinct and trimmed, of the reference records given (default: all)."""
    pairs = truth.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("m"))
    pairs = pairs.select("s1_id", F.trim("m").alias("cand_id")).where("cand_id <> ''").distinct()
    return pairs if reference is None else pairs.join(reference.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The pairs with ``y``: whether they are true."""
    return pairs.join(truth.select("s1_id", "cand_id", F.lit(True).alias("y")), ["s1_id", "cand_id"], "left").withColumn("y", F.coalesce("y", F.lit(False)))


def _totals(truth: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: number of true pairs, reference records, reference records with a true pair."""
    return truth.agg(F.count("*").alias("n_gt"), F.count_distinct("s1_id").alias("n_matched")).crossJoin(reference.agg(F.count("*").alias("n_s1")))


def blocker_report(pairs: DataFrame, truth: DataFrame, reference: DataFrame) -> DataFrame:
    """A row for each blocker, from one pass over the pairs."""
    marked = labelled(pairs, truth)
    sums = []
    for b, i in BITS.items():
        has = F.col("mask").bitwiseAND(1 << i) != 0
        sums += [F.count_if(has).alias(f"n_{b}"), F.count_if(has & F.col("y")).alias(f"tp_{b}"), F.count_if((F.col("mask") == 1 << i) & F.col("y")).alias(f"own_{b}")]
    one = marked.agg(*sums).crossJoin(_totals(truth, reference))
    rows = F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(b).alias("blocker"), F.col(f"n_{b}").alias("pairs"), F.col(f"tp_{b}").alias("tp"), F.col(f"own_{b}").alias("own")) for b, i in BITS.items()))
    out = one.select("n_gt", "n_s1", F.inline(rows))
    return out.select(
        "bit", "blocker", "pairs", percent(F.col("tp"), F.col("n_gt")).alias("pair_recall"), percent(F.col("own"), F.col("n_gt")).alias("unique_recall"),
        percent(F.col("tp"), F.col("pairs")).alias("precision"), (percent(F.col("pairs"), F.col("n_s1"), 4) / 100).alias("avg_cand_per_s1"),
    )


def candidate_counts(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """``(entity_id, country, n)`` for every reference record."""
    counts = pairs.groupBy(F.col("s1_id").alias("entity_id")).agg(F.count("*").alias("n"))
    return reference.select("entity_id", "country").join(counts, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def union_report(pairs: DataFrame, truth: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: recall, precision and the spread of candidates over reference records."""
    hits = labelled(pairs, truth).agg(F.count("*").alias("pairs"), F.count_if("y").alias("tp"))
    quantile = lambda p: F.round(F.percentile("n", p), 4)
    spread = candidate_counts(pairs, reference).agg(
        F.round(F.avg("n"), 4).alias("avg_cand_per_s1"), quantile(0.5).alias("p50"), quantile(0.9).alias("p90"), quantile(0.99).alias("p99"), F.max("n").alias("largest"),
        F.count_if(F.col("n") == 0).alias("s1_without_candidates"), F.count_if(F.col("n") > 200).alias("s1_over_200"),
    )
    cover = coverage(pairs, truth)
    one = hits.crossJoin(spread).crossJoin(cover).crossJoin(_totals(truth, reference))  # one row each
    return one.select(
        "pairs", percent(F.col("tp"), F.col("n_gt"), 3).alias("pair_recall"), percent(F.col("tp"), F.col("pairs")).alias("precision"), "avg_cand_per_s1", "p50", "p90", "p99", "largest",
        "s1_without_candidates", "s1_over_200", percent(F.col("fully_covered"), F.col("n_matched")).alias("all_match_coverage"), "never_hit",
    )


def coverage(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: reference records all or none of whose true matches are candidates."""
    found = truth.join(pairs.select("s1_id", "cand_id", F.lit(1).alias("hit")), ["s1_id", "cand_id"], "left")
    per = found.groupBy("s1_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_hit"))
    return per.agg(F.count_if(F.col("n_hit") == F.col("n_true")).alias("fully_covered"), F.count_if(F.col("n_hit") == 0).alias("never_hit"))


def recall_by_source(pairs: DataFrame, truth: DataFrame, vendors: DataFrame) -> DataFrame:
    found = truth.join(vendors.select(F.col("entity_id").alias("cand_id"), "source"), "cand_id").join(pairs.select("s1_id", "cand_id", F.lit(1).alias("hit")), ["s1_id", "cand_id"], "left")
    return found.groupBy("source").agg(F.count("*").alias("true_pairs"), F.count("hit").alias("hits")).withColumn("recall", percent(F.col("hits"), F.col("true_pairs")))


def recall_by_country(pairs: DataFrame, truth: DataFrame, reference: DataFrame) -> DataFrame:
    found = truth.join(reference.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id").join(pairs.select("s1_id", "cand_id", F.lit(1).alias("hit")), ["s1_id", "cand_id"], "left")
    recall = found.groupBy("country").agg(F.count("*").alias("true_pairs"), F.count("hit").alias("hits"))
    sizes = candidate_counts(pairs, reference).groupBy("country").agg(F.count("*").alias("n_s1"), F.sum("n").alias("n_cand"))
    out = sizes.join(recall, "country", "left")
    recall_ = F.when(F.col("true_pairs") > 0, percent(F.col("hits"), F.col("true_pairs")))  # none without true pairs
    return out.select("country", "true_pairs", "hits", recall_.alias("recall"), F.round(F.col("n_cand") / F.col("n_s1"), 1).alias("avg_cand_per_s1"))


def ground_truth_facts(truth: DataFrame, reference: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row: owners, cross-country pairs, missing vendor addresses, conflicting house numbers, unknown ids."""
    r = reference.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("c1"), F.col("hnum").alias("h1"))
    v = vendors.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("c2"), "address_norm", F.col("hnum").alias("h2"))
    facts = truth.join(r, "s1_id", "left").join(v, "cand_id", "left").agg(
        F.count("*").alias("true_pairs"),
        F.count_if(F.col("c1") != F.col("c2")).alias("cross_country"),
        F.count_if(F.coalesce(F.col("address_norm"), F.lit("")) == "").alias("vendor_address_missing"),
        F.count_if(F.col("h1").isNotNull() & F.col("h2").isNotNull() & (F.col("h1") != F.col("h2"))).alias("house_number_conflict"),
        F.count_if(F.col("c2").isNull()).alias("unknown_vendor"),
    )
    owners = truth.groupBy("cand_id").agg(F.count_distinct("s1_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_vendors"), F.max("n").alias("most_owners"))
    return facts.crossJoin(owners)


def missed_pairs(pairs: DataFrame, truth: DataFrame, reference: DataFrame, vendors: DataFrame) -> DataFrame:
    """True pairs that no blocker found, with both sides."""
    side = lambda df, p: df.select(F.col("entity_id").alias("s1_id" if p == "s1" else "cand_id"), *(F.col(c).alias(f"{p}_{n}") for c, n in (("country", "country"), ("name_norm", "name"), ("address_norm", "addr"), ("hnum", "hnum"))))
    missed = truth.join(pairs.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    return missed.join(side(reference, "s1"), "s1_id", "left").join(side(vendors, "v"), "cand_id", "left")


def missed_sample(missed: DataFrame, n: int = 3000, seed: int = 42) -> DataFrame:
    """``n`` missed pairs by hash order, with the token-set similarity of their names."""
    some = missed.orderBy(F.xxhash64(F.lit(seed), "s1_id", "cand_id"), "s1_id", "cand_id").limit(n)
    return some.withColumn("name_sim", token_set(F.coalesce("s1_name", F.lit("")), F.coalesce("v_name", F.lit(""))))


def missed_categories(sample: DataFrame) -> DataFrame:
    """One row: share of the sample in each (overlapping) category."""
    sim = F.col("name_sim")
    shares = {
        "cross_country": ~F.col("s1_country").eqNullSafe(F.col("v_country")),
        "vendor_addr_missing": F.coalesce("v_addr", F.lit("")) == "",
        "same_house_number": F.coalesce(F.col("s1_hnum") == F.col("v_hnum"), F.lit(False)),
        "name_sim_90": sim >= 90,
        "name_sim_70_90": (sim >= 70) & (sim < 90),
        "name_sim_50_70": (sim >= 50) & (sim < 70),
        "name_sim_below_50": sim < 50,
    }
    return sample.agg(F.count("*").alias("sample_size"), *(percent(F.count_if(c), F.count("*"), 1).alias(n) for n, c in shares.items()))


def per_reference(predicted: DataFrame, truth: DataFrame, reference: DataFrame) -> DataFrame:
    """``(entity_id, np, tp, nt)`` for every reference record, also those without any pair."""
    p = labelled(predicted, truth).groupBy("s1_id").agg(F.count("*").alias("np"), F.count_if("y").alias("tp"))
    t = truth.groupBy("s1_id").agg(F.count("*").alias("nt"))
    every = reference.select(F.col("entity_id").alias("s1_id")).join(p, "s1_id", "left").join(t, "s1_id", "left")
    return every.select(F.col("s1_id").alias("entity_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("np", "tp", "nt")))


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one reference record: 1 if nothing is true and nothing predicted, 0 if one of them or the overlap is nothing."""
    whole = n_pred.cast("double") + 0.25 * n_true
    return F.when(whole == 0, 1.0).otherwise(1.25 * tp / F.nullif(whole, F.lit(0.0)))


def score_groups(predicted: DataFrame, groups: DataFrame, key: str, truth: DataFrame, reference: DataFrame, digits: int | None = 6) -> DataFrame:
    """Scores of many predictions at once: ``predicted(key, s1_id, cand_id)``, a row out for each of ``groups(key)``.

    One pass over the pairs serves all groups. Records without any prediction score 1 or 0 in every group,
    so they enter by their number alone.
    """
    nt = truth.groupBy("s1_id").agg(F.count("*").alias("nt"))
    base = reference.select(F.col("entity_id").alias("s1_id")).join(nt, "s1_id", "left").select("s1_id", F.coalesce("nt", F.lit(0)).alias("nt"))
    totals = base.agg(F.count("*").alias("n_s1"), F.count_if(F.col("nt") == 0).alias("n_single"), F.sum("nt").alias("n_true"))
    per = labelled(predicted, truth).groupBy(key, "s1_id").agg(F.count("*").alias("np"), F.count_if("y").alias("tp")).join(base, "s1_id")
    per = per.withColumn("f", f05(F.col("tp"), F.col("np"), F.col("nt")))
    sums = per.groupBy(key).agg(F.sum("f").alias("f"), F.count_if(F.col("nt") == 0).alias("wrong"), F.count("*").alias("answered"), F.sum("np").alias("pairs"), F.sum("tp").alias("tp"))
    out = groups.join(sums, key, "left").fillna(0, ["f", "wrong", "answered", "pairs", "tp"]).crossJoin(totals)  # totals is one row
    plain = lambda x, y: x / F.nullif(y.cast("double"), F.lit(0.0))
    ratio = plain if digits is None else lambda x, y: F.round(plain(x, y), digits)
    return out.select(
        *groups.columns, "pairs", ratio(F.col("f") + F.col("n_single") - F.col("wrong"), F.col("n_s1")).alias("macro_f05"), ratio(F.col("tp"), F.col("pairs")).alias("pair_precision"),
        ratio(F.col("tp"), F.col("n_true")).alias("pair_recall"), ratio(F.col("n_s1") - F.col("answered"), F.col("n_s1")).alias("predicted_empty"),
    )


def score(predicted: DataFrame, truth: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: macro F0.5 over all reference records, pair precision and recall, share predicted empty."""
    one = predicted.sparkSession.range(1).select(F.lit(0).alias("k"))
    return score_groups(predicted.withColumn("k", F.lit(0)), one, "k", truth, reference).drop("k", "pairs")
