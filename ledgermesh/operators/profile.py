"""Profiles of source files and of the ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import sql_jaro_winkler
from ..functions.text import profile_norm, words
from .evaluate import percent, truth_pairs


def prepared(records: DataFrame) -> DataFrame:
    """Raw records with ``name_n`` and ``addr_n``."""
    return records.withColumn("name_n", profile_norm(F.col("business_name"))).withColumn("addr_n", profile_norm(F.col("business_address")))


def file_profile(rows: DataFrame) -> DataFrame:
    """A row for each source: counts, wrong prefixes, missing values, non-ASCII share, copies, length quantiles."""
    lengths = lambda c, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY length({c}))")
    main = rows.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_distinct("entity_id").alias("ids"), F.count_if(~F.col("entity_id").startswith(F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-")))).alias("bad_prefix"),
        F.count_if(F.col("name_n") == "").alias("name_missing"), F.count_if(F.col("addr_n") == "").alias("addr_missing"), F.count_if(F.trim(F.coalesce("country", F.lit(""))) == "").alias("country_missing"),
        percent(F.count_if(F.coalesce("business_name", F.lit("")).rlike(r"[^\x00-\x7F]")), F.count("*")).alias("non_ascii"),
        lengths("business_name", 0.5).cast("long").alias("name_p50"), lengths("business_name", 0.95).cast("long").alias("name_p95"), F.max(F.length("business_name")).cast("long").alias("name_max"),
        lengths("business_address", 0.5).cast("long").alias("addr_p50"), lengths("business_address", 0.95).cast("long").alias("addr_p95"), F.max(F.length("business_address")).cast("long").alias("addr_max"),
    )
    copies = rows.groupBy("source", "name_n", "addr_n", "country").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum(F.col("n") - 1).alias("copies"))
    return main.join(copies, "source")


def country_values(rows: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent raw country values of each source."""
    counts = rows.groupBy("source", F.coalesce("country", F.lit("<NULL>")).alias("country")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "country"))).where(F.col("place") <= top)


def truth_integrity(truth: DataFrame, reference: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row: rows and ids of the truth, what is missing or unknown on each side."""
    pairs = truth_pairs(truth)
    missing = reference.join(truth, F.col("entity_id") == F.col("source1_entity_id"), "left_anti").agg(F.count("*").alias("s1_missing"))
    unknown = truth.join(reference, F.col("entity_id") == F.col("source1_entity_id"), "left_anti").agg(F.count("*").alias("s1_unknown"))
    strange = pairs.join(vendors, F.col("entity_id") == F.col("cand_id"), "left_anti").agg(F.count("*").alias("vendor_unknown"))
    base = truth.agg(F.count("*").alias("truth_rows"), F.count_distinct("source1_entity_id").alias("truth_ids"))
    return base.crossJoin(missing).crossJoin(unknown).crossJoin(strange).crossJoin(pairs.agg(F.count("*").alias("true_pairs")))


def match_histogram(truth: DataFrame, most: int = 15) -> DataFrame:
    """Reference records by number of matches 0..most: in all, of source 2, of source 3; rows of zeros left out."""
    pairs = truth_pairs(truth)
    per = truth.select(F.trim("source1_entity_id").alias("s1_id")).join(pairs, "s1_id", "left").groupBy("s1_id").agg(
        F.count("cand_id").alias("n"), F.count_if(F.col("cand_id").startswith("S2-")).alias("n2"), F.count_if(F.col("cand_id").startswith("S3-")).alias("n3")
    )
    each = per.select(F.inline(F.array(*(F.struct(F.lit(i).alias("of"), F.col(c).alias("k")) for i, c in enumerate(("n", "n2", "n3"))))))
    counts = each.where(F.col("k") <= most).groupBy("k")
    return counts.agg(*(F.count_if(F.col("of") == i).alias(c) for i, c in enumerate(("s1_total", "s1_source2", "s1_source3"))))


def owners(truth: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row: matched vendor records, those of two owners or more, the most owners, and vendor records that match nothing."""
    per = truth_pairs(truth).groupBy("cand_id").agg(F.count_distinct("s1_id").alias("n"))
    out = per.agg(F.count("*").alias("matched"), F.count_if(F.col("n") > 1).alias("shared"), F.max("n").alias("most_owners")).crossJoin(vendors.agg(F.count("*").alias("vendors")))
    return out.withColumn("unmatched", F.col("vendors") - F.col("matched")).withColumn("unmatched_share", percent(F.col("unmatched"), F.col("vendors"), 1))


def _true_sides(truth: DataFrame, reference: DataFrame, vendors: DataFrame) -> DataFrame:
    side = lambda df, key, i: df.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{c}{i}") for c in ("name_n", "addr_n", "country", "business_name", "business_address")))
    return truth_pairs(truth).join(side(reference, "s1_id", 1), "s1_id").join(side(vendors, "cand_id", 2), "cand_id")


def difficulty(truth: DataFrame, reference: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row: how alike the two sides of true pairs are."""
    rows = _true_sides(truth, reference, vendors).withColumn("jw", sql_jaro_winkler("name_n1", "name_n2"))
    n1, n2 = F.col("name_n1"), F.col("name_n2")
    plain = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return rows.agg(
        F.count("*").alias("true_pairs"), F.count_if(F.col("country1") != F.col("country2")).alias("cross_country"), F.count_if(n1 == n2).alias("same_name"), F.count_if(plain(n1) == plain(n2)).alias("same_spaceless"),
        F.count_if((F.col("addr_n1") == F.col("addr_n2")) & (F.col("addr_n1") != "")).alias("same_address"), F.count_if(F.col("addr_n2") == "").alias("no_vendor_address"),
        F.count_if(F.col("jw") >= 0.9).alias("jw_high"), F.count_if(F.col("jw") < 0.7).alias("jw_low"),
    )


def one_sided_words(truth: DataFrame, reference: DataFrame, vendors: DataFrame, sample: int | None = None, top: int = 40) -> DataFrame:
    """Words that most often stand on one side of a true pair only; repeats within a side count."""
    rows = _true_sides(truth, reference, vendors)
    if sample is not None:
        rows = rows.orderBy(F.xxhash64("s1_id", "cand_id"), "s1_id", "cand_id").limit(sample)
    own = lambda a, b: F.filter(a, lambda t: ~F.array_contains(b, t))
    a, b = words(F.col("name_n1")), words(F.col("name_n2"))
    each = rows.select(F.explode(F.concat(own(a, b), own(b, a))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def example_pairs(truth: DataFrame, reference: DataFrame, vendors: DataFrame, each: int = 25) -> DataFrame:
    """Some true pairs of every country, by hash order."""
    rows = _true_sides(truth, reference, vendors)
    order = Window.partitionBy("country1").orderBy(F.md5(F.concat("s1_id", "cand_id")), "s1_id", "cand_id")
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/"))
    some = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    return some.select(F.col("country1").alias("country"), "place", *(clean(F.col(c)).alias(c) for c in ("business_name1", "business_name2", "business_address1", "business_address2")))


