"""Business records derived from the star-schema test tables, and their true matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGITS, _LETTERS = "0123456789", "abdegiklmo"


def _pick(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in items)), (at + 1).cast("int"))


def _spelt(number: Column) -> Column:
    return F.translate(number.cast("string"), _DIGITS, _LETTERS)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each business: number, parts of its name and address, country."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    k = F.col("c_custkey")
    rows = read("customer").join(read("part").select("p_partkey", "p_name"), k == F.col("p_partkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(
        k.alias("k"), "p_name",
        F.concat(F.lit("zor"), _spelt((k * 7919) % 10007)).alias("stem"),
        _pick(["Inc", "LLC", "Private Limited", "Ltd", "SARL", "Corporation"], k % 6).alias("legal"),
        (100 + (k * 37) % 9000).alias("hn"),
        _pick(["Dobson", "Maple", "de la Paix", "Bastrop", "Sixth", "Mount Abu", "Griffin", "Saint Honore"], k % 8).alias("street"),
        _pick(["Road", "Street", "Avenue", "Blvd"], k % 4).alias("kind"),
        F.concat(_spelt(F.col("n_nationkey")), F.lit("ville")).alias("city"),
        (10000 + F.col("n_nationkey") * 1000 + k % 50).cast("string").alias("post"),
        F.col("r_name").alias("country"),
    )
    return rows.withColumn("name", F.concat_ws(" ", "stem", "p_name", "legal")).withColumn("addr", F.concat(F.concat_ws(" ", "hn", "street", "kind"), F.lit(", "), "city", F.lit(" "), "post"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity_id, source, business_name, business_address, country)``: reference records and two vendors' spellings."""
    b, k = base(spark, sf_dir), F.col("k")
    made = lambda rows, prefix, source, name, addr: rows.select(F.concat(F.lit(prefix), k.cast("string")).alias("entity_id"), F.lit(source).alias("source"), name.alias("business_name"), addr.alias("business_address"), "country")
    s1 = made(b, "S1-", 1, F.col("name"), F.col("addr"))
    second = (
        F.when(k % 8 == 1, F.concat_ws(" ", "stem", "p_name"))
        .when(k % 8 == 2, F.upper(F.concat("stem", F.lit(" "), "p_name", F.replace("legal", F.lit(" "), F.lit("")))))
        .when(k % 8 == 3, F.concat_ws(" ", F.replace("stem", F.lit("o"), F.lit("0")), "p_name", "legal"))
        .when(k % 8 == 4, F.concat_ws(" ", "legal", "p_name", "stem"))
        .when(k % 8 == 5, F.concat(F.lit("Sri "), "stem", F.lit(" "), "p_name", F.lit(" & Co")))
        .when(k % 8 == 6, F.concat("stem", F.lit(" DBA "), "p_name"))
        .otherwise(F.col("name"))
    )
    s2 = made(b.where(k % 10 != 0), "S2-", 2, second, F.when(k % 8 == 7, "").otherwise(F.col("addr")))
    third = (
        F.when(k % 7 == 0, F.col("stem"))
        .when(k % 7 == 3, F.concat(F.expr("left(stem, length(stem) - 1)"), F.lit(" "), "p_name"))
        .when(k % 7 == 5, F.replace("name", F.lit("e"), F.lit("é")))
        .when(k % 7 == 6, "urgent care clinic")
        .otherwise(F.col("name"))
    )
    tail = F.concat(F.lit(", "), "city", F.lit(" "))
    place = (
        F.when(k % 7 == 1, F.concat(F.lit("00"), F.concat_ws(" ", F.col("hn") + 2, "street", "kind"), tail, "post"))
        .when(k % 7 == 2, F.concat("hn", F.lit(" 6nd street null"), tail, "post"))
        .when(k % 7 == 4, F.concat(F.lit("Near SBI ATM"), tail, F.lit("411 0"), F.substring("post", 4, 2)))
        .when(k % 7 == 6, "")
        .otherwise(F.col("addr"))
    )
    s3 = made(b.where(k % 4 != 2), "S3-", 3, third, place)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    count = read("customer").agg(F.count("*").alias("n"))  # one row
    p = F.col("p_partkey")
    others = read("part").crossJoin(count).where(p >= F.col("n"))
    others = others.select(
        F.concat(F.lit("S3-"), (p + 1_000_000).cast("string")).alias("entity_id"), F.lit(3).alias("source"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" enterprises")).alias("business_name"),
        F.concat((p % 900 + 1).cast("string"), F.lit(" "), "p_brand", F.lit(" Rd")).alias("business_address"), F.lit("ASIA").alias("country"),
    )
    return s1.unionByName(s2).unionByName(s3).unionByName(others)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth as it is read from a file: ``(source1_entity_id, matched_entity_ids)``, ids joined by commas."""
    k = F.col("k")
    both = F.concat_ws(",", F.when(k % 10 != 0, F.concat(F.lit("S2-"), k.cast("string"))), F.when(k % 4 != 2, F.concat(F.lit("S3-"), k.cast("string"))))
    return base(spark, sf_dir).select(F.concat(F.lit("S1-"), k.cast("string")).alias("source1_entity_id"), both.alias("matched_entity_ids"))
