"""Readers and writers: tab-separated sources and outputs, Parquet, frequency cache, JSON side files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str | list[str], columns: tuple[str, ...], skip_malformed: bool = False) -> DataFrame:
    """Tab-separated text without quoting, all strings, empty fields as ''.

    Short rows are padded and long ones cut; with ``skip_malformed`` both are dropped.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    mode = "DROPMALFORMED" if skip_malformed else "PERMISSIVE"
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", mode=mode, enforceSchema=True)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def read_source(spark: SparkSession, path: str, source: int) -> DataFrame:
    """Business records of one source."""
    return read_tsv(spark, path, SOURCE_COLUMNS).withColumn("source", F.lit(source))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ("source1_entity_id", "matched_entity_ids"))


def write_tsv(rows: DataFrame, path: str, order_by: tuple[str, ...] = (), one_file: bool = False) -> None:
    """Tab-separated files with a header, no quotes, empty strings as nothing; a folder of parts, or one part."""
    if one_file:  # the plan runs as it is dealt; only its result meets in one task
        out = rows.repartition(1).sortWithinPartitions(*order_by) if order_by else rows.repartition(1)
    else:
        out = rows.orderBy(*order_by) if order_by else rows
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_parquet(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_missing_parts(rows: DataFrame, path: str, buckets: int, key: str = "s1_id") -> None:
    """Writes the buckets (by hash of the key) that are not there yet, so that a broken run can go on.

    Buckets are written beside the table and each is moved into it by one rename once the whole write has
    succeeded, so a bucket is there whole or not at all.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    missing = [b for b in range(buckets) if not files.exists(hadoop(f"{path}/bucket={b}"))]
    if not missing:
        return
    work = f"{path}/_work-{uuid.uuid4().hex}"
    marked = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).where(F.col("bucket").isin(missing))
    marked.write.option("compression", "zstd").partitionBy("bucket").parquet(work)
    for b in missing:
        if files.exists(hadoop(f"{work}/bucket={b}")):
            files.rename(hadoop(f"{work}/bucket={b}"), hadoop(f"{path}/bucket={b}"))
    files.delete(hadoop(work), True)


def frequency_cache(compute, path: str, spark: SparkSession) -> DataFrame:
    """The frequencies at ``path``, computed and written there first if they are not."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        write_parquet(compute(), path)
    return spark.read.parquet(path)


def write_json(value, path: str) -> None:
    """A small side file (statistics, weights) on the driver."""
    with open(path, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)


def read_json(path: str):
    with open(path) as f:
        return json.load(f)


def markdown_table(rows: DataFrame) -> str:
    """A report table of a result, all its rows."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.toLocalIterator()]
    return "\n".join(lines)


def register_views(**frames: DataFrame) -> None:
    """Names for SQL: ``register_views(s1=reference, cand=pairs)``, then ``spark.sql(text, args={...})``."""
    for name, rows in frames.items():
        rows.createOrReplaceTempView(name)


def save_table(rows: DataFrame, name: str, buckets: int = 0, key: str = "s1_id") -> None:
    """A catalogue table in the warehouse; bucketed by ``key``, later joins on it need no shuffle."""
    writer = rows.write.mode("overwrite").format("parquet").option("compression", "zstd")
    (writer.bucketBy(buckets, key).sortBy(key) if buckets else writer).saveAsTable(name)
