"""Document frequencies of name and address words, and the rarity ranking they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import name_words


def name_frequencies(tokens: DataFrame) -> DataFrame:
    """``(token, df)`` over the distinct singular name words of all records."""
    return tokens.select(F.explode(F.array_distinct("singulars")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def address_frequencies(tokens: DataFrame) -> DataFrame:
    """``(token, df)`` over the distinct address words of all records."""
    return tokens.select(F.explode("address_words").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def with_ranks(tokens: DataFrame, names: DataFrame, addresses: DataFrame) -> DataFrame:
    """Adds ``ranked`` and ``address_ranked``: arrays of (df, token), rarest first; unseen words count as df 1.

    Both kinds of words take one pass: they are exploded under a tag, joined to the tagged frequencies and
    collected again by record. Words repeat in few rows after that, and frequencies are one row a word.
    """
    tagged = names.withColumn("kind", F.lit("n")).unionByName(addresses.withColumn("kind", F.lit("a")))
    item = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token"))
    words = F.concat(F.transform(name_words(F.col("singulars")), item("n")), F.transform("address_words", item("a")))
    each = tokens.select("entity_id", F.explode(words).alias("w")).select("entity_id", "w.*")
    known = each.join(tagged, ["kind", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("df", "token"))))
    lists = known.groupBy("entity_id").agg(ranked("n").alias("ranked"), ranked("a").alias("address_ranked"))
    none = F.array().cast(lists.schema["ranked"].dataType)
    return tokens.join(lists, "entity_id", "left").withColumn("ranked", F.coalesce("ranked", none)).withColumn("address_ranked", F.coalesce("address_ranked", none))
