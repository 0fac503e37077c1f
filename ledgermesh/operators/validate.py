"""Checks of output tables: one row for each reference record, sound ids, matches among the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(table: DataFrame, column: str, keep_blank: bool = False) -> DataFrame:
    """``(s1_id, id)`` of a grouped table, repeats kept.

    ``keep_blank`` keeps blank items of a non-blank list (the strict reading); else they are dropped and ids trimmed.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    rows = table.where(F.trim(text) != "").select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split(text, ",")).alias("id"))
    return rows if keep_blank else rows.select("s1_id", F.trim("id").alias("id")).where("id <> ''")


def findings(table: DataFrame, column: str, reference: DataFrame, vendors: DataFrame | None = None, candidates: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``(check, n)``, a row for each check with the number of offenders; all zero if the table is sound.

    ``reference`` and ``vendors`` are (entity_id); ``candidates`` is (s1_id, cand_id). Unknown ids and
    candidates are checked where those tables are given.
    """
    ids = listed(table, column, keep_blank=strict)
    rows = table.select(F.col("source1_entity_id").alias("s1_id"))
    required = reference.select(F.col("entity_id").alias("s1_id")).distinct()
    distinct = ids.select("id").distinct()
    vendor_like = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    checks = {
        "duplicate_rows": rows.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").select("s1_id"),
        "duplicate_ids": ids.groupBy("s1_id", "id").agg(F.count("*").alias("n")).where("n > 1").select("s1_id").distinct(),
        "self_matches": distinct.where(F.col("id").startswith("S1-")),
        "wrong_prefix": distinct.where(~vendor_like & ~F.col("id").startswith("S1-")),
        "missing_rows": required.join(rows, "s1_id", "left_anti"),
        "extra_rows": rows.distinct().join(required, "s1_id", "left_anti"),
    }
    if vendors is not None:
        checks["unknown_ids"] = distinct.where(vendor_like).join(vendors.select(F.col("entity_id").alias("id")), "id", "left_anti")
    if candidates is not None:
        checks["not_candidates"] = ids.distinct().join(candidates.select("s1_id", F.col("cand_id").alias("id")), ["s1_id", "id"], "left_anti")
    out = None
    for name, offenders in checks.items():
        row = offenders.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def row_counts(table: DataFrame, column: str, reference: DataFrame, vendors: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts by rows and list items, not by distinct ids; for candidate tables ``one_row_each`` is what counts."""
    ids = listed(table, column)
    required = reference.select(F.col("entity_id").alias("s1_id")).distinct()
    rows = table.select(F.col("source1_entity_id").alias("s1_id"))
    number = lambda df, name: df.agg(F.count("*").alias(name))
    vendor = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    parts = [
        number(required, "required"), rows.agg(F.count("*").alias("rows"), F.count_distinct("s1_id").alias("kinds")), number(required.join(rows, "s1_id", "left_anti"), "missing_rows"),
        number(rows.join(required, "s1_id", "left_anti"), "extra_rows"), ids.agg(F.count("*").alias("ids"), F.count_if(~vendor).alias("wrong_prefix")),
        number(ids.groupBy("s1_id", "id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_ids"),
        number(ids.join(vendors.select(F.col("entity_id").alias("id")), "id", "left_anti"), "unknown_ids"),
        number(ids.join(candidates.select("s1_id", F.col("cand_id").alias("id")), ["s1_id", "id"], "left_anti"), "not_candidates"),
    ]
    one = parts[0]
    for part in parts[1:]:
        one = one.crossJoin(part)  # one row each
    return one.select(
        "required", "rows", (F.col("rows") - F.col("kinds")).alias("duplicate_rows"), "missing_rows", "extra_rows", "ids", "duplicate_ids", "wrong_prefix", "unknown_ids", "not_candidates",
        ((F.col("rows") == F.col("required")) & (F.col("kinds") == F.col("required"))).alias("one_row_each"),
    )


def malformed(lines: DataFrame) -> DataFrame:
    """``lines(value)`` of an output file -> the lines that are not blank and have no tab."""
    return lines.where(~F.contains("value", F.lit("\t")) & (F.trim("value") != ""))


def header_problem(line: str, column: str, exact: bool = True) -> str | None:
    """What is wrong with a header line, if anything; ``exact`` compares case, too."""
    want = f"source1_entity_id\t{column}"
    got = line.rstrip("\r\n")
    return None if got == want or (not exact and [c.strip().lower() for c in got.split("\t")] == want.split("\t")) else f"header is {got!r}, not {want!r}"


def verdict(found: DataFrame, warnings: tuple[str, ...] = ()) -> tuple[bool, list[str]]:
    """Whether all checks pass, and the messages; checks named as ``warnings`` never fail."""
    bad = [(r["check"], r["n"]) for r in found.where("n > 0").collect()]  # a row for each check
    return not [c for c, _ in bad if c not in warnings], [f"{c}: {n}" for c, n in sorted(bad)]
