"""Blocking keys of one record, given its tokens and their document frequencies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AFFIX_CHARS, RARE1_MAX_DF, RARE2_MAX_DF
from .address import address_numbers, address_tokens, address_words, parse_tokens, street_token
from .phonetic import metaphone_words
from .text import compact, dba_parts, name_tokens, norm_text, singular


def or_null(items: Column) -> Column:
    """An empty list as null."""
    return F.when(F.size(items) > 0, items)


def normalised(records: DataFrame) -> DataFrame:
    """Adds ``name_norm``, ``address_norm`` and the normalised ``country`` to raw records."""
    return records.select(
        "entity_id", F.col("source").cast("int").alias("source"), norm_text(F.col("country")).alias("country"), norm_text(F.col("business_name")).alias("name_norm"), norm_text(F.col("business_address")).alias("address_norm")
    )


def tokenised(norm: DataFrame) -> DataFrame:
    """Adds tokens, compact form, singular words, parsed address and street, in steps that are each computed once."""
    out = norm.withColumn("tokens", name_tokens(F.col("name_norm"))).withColumn("parsed", parse_tokens(address_tokens(F.col("address_norm"))))
    return out.select(
        "*",
        compact(F.col("tokens")).alias("compact"),
        F.transform("tokens", singular).alias("singulars"),
        F.transform(dba_parts(F.col("name_norm")), lambda p: compact(name_tokens(p))).alias("dba"),
        F.col("parsed.tokens").alias("address_tokens"),
        F.col("parsed.hnum").alias("hnum"),
        F.col("parsed.postcode").alias("postcode"),
        street_token(F.col("parsed.tokens"), F.col("parsed.hnum")).alias("street"),
        address_words(F.col("parsed.tokens")).alias("address_words"),
    ).drop("parsed")


def name_words(tok: Column) -> Column:
    """Words that name rarity ranks: distinct, three letters or more."""
    return F.array_distinct(F.filter(tok, lambda t: F.length(t) >= 3))


def _pairs(items: Column, n: int) -> Column:
    """Sorted 'a|b' of all pairs of the first n items, each pair in order."""
    made = [F.when(F.size(items) > j, F.array_join(F.array_sort(F.array(F.get(items, F.lit(i)), F.get(items, F.lit(j)))), "|")) for i, j in combinations(range(n), 2)]
    return or_null(F.array_sort(F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull()))))


def _products(left: Column, right: Column) -> Column:
    made = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit("|"), b))))
    return or_null(F.array_sort(F.array_distinct(made)))


def with_keys(rows: DataFrame, rare1_max_df: int = RARE1_MAX_DF, rare2_max_df: int = RARE2_MAX_DF, phonetic: bool = True) -> DataFrame:
    """``tokenised`` rows with ``ranked`` and ``address_ranked`` (arrays of (df, token), rarest first) -> the keyed record."""
    c, name = F.col("compact"), F.transform("ranked", lambda x: x["token"])
    place = F.transform("address_ranked", lambda x: x["token"])
    words = F.array_distinct("singulars")
    long_enough = F.length(c) >= AFFIX_CHARS + 2
    rarest = F.try_element_at("ranked", F.lit(1))
    common = F.slice(F.transform(F.filter("ranked", lambda x: x["df"] <= rare2_max_df), lambda x: x["token"]), 1, 3)
    at = F.concat_ws(" ", "hnum", "street")
    found = F.col("hnum").isNotNull() & F.col("street").isNotNull()
    alphabetic = F.array_join(F.filter("singulars", lambda t: t.rlike("^[a-z]+$")), " ")
    code = metaphone_words(alphabetic) if phonetic else F.lit(None).cast("string")
    keyed = rows.select(
        "entity_id", "source", "country", "name_norm", "address_norm",
        or_null(F.array_distinct(F.filter(F.concat(F.array(c), "dba"), lambda x: F.length(x) >= 3))).alias("k_compact"),
        F.when(F.size(words) >= 2, F.array_join(F.array_sort(words), " ")).alias("k_sorted"),
        F.when(long_enough, F.left(c, F.lit(AFFIX_CHARS))).alias("k_pre"),
        F.when(long_enough, F.right(c, F.lit(AFFIX_CHARS))).alias("k_suf"),
        code.alias("code"),
        F.when(rarest["df"] <= rare1_max_df, rarest["token"]).alias("k_rare1"),
        _pairs(common, 3).alias("k_rare2"),
        F.when(found, at).alias("k_addr"),
        F.when(found & (c != ""), F.concat_ws(" ", at, F.left(c, F.lit(2)))).alias("k_addrname"),
        F.when(F.col("postcode").isNotNull() & (F.length(c) >= 4), F.concat_ws(" ", "postcode", F.left(c, F.lit(4)))).alias("k_postname"),
        F.when(F.col("postcode").isNotNull() & rarest.isNotNull(), F.concat_ws(" ", F.col("postcode"), rarest["token"])).alias("k_postrare"),
        _pairs(F.slice(place, 1, 3), 3).alias("k_apair"),
        _products(F.slice(name, 1, 3), F.slice(place, 1, 2)).alias("k_nameaddr"),
        _products(address_numbers(F.col("address_tokens"), F.col("postcode")), F.slice(name, 1, 2)).alias("k_numname"),
        "hnum", "postcode",
    )
    return keyed.withColumn("k_phon", F.when(F.length("code") >= 3, F.col("code"))).drop("code")
