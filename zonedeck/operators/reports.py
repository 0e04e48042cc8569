"""Comparison with recorded output, and reports over diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The section of a report that a diagnostic belongs to, by the beginning of its code.
SECTIONS = {"verb.rejected": "unsupported", "verb.blocked": "blocked", "procedure.": "review"}


def golden_differences(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows that only one side has, with multiplicity: side is 'unexpected' or 'missing'. Empty if they agree."""
    names = golden.columns
    more, less = actual.select(*names).exceptAll(golden), golden.exceptAll(actual.select(*names))
    return more.withColumn("side", F.lit("unexpected")).unionByName(less.withColumn("side", F.lit("missing")))


def sections(diagnostics: DataFrame) -> DataFrame:
    """(section, code, sources, n): how many sources have a diagnostic, and how often."""
    section = F.lit("other")
    for start, name in SECTIONS.items():
        section = F.when(F.col("code").startswith(start), name).otherwise(section)
    return diagnostics.groupBy(section.alias("section"), "code").agg(F.count_distinct("path").alias("sources"), F.sum("n").alias("n"))


def migration_report(sources: DataFrame, diagnostics: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, status, errors, warnings, includes, calls, report): a row a source, report as JSON."""
    found = diagnostics.groupBy("path").agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"), F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"),
        F.array_sort(F.collect_set(F.struct("code", "subject"))).alias("diagnostics"),
    )
    linked = edges.groupBy("path").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "copy", F.col("target")))).alias("includes"), F.count_if(F.col("kind") != "copy").alias("calls"))
    zero = F.lit(0).cast("long")
    rows = sources.select("path").join(found, "path", "left").join(linked, "path", "left")
    rows = rows.select("path", *[F.coalesce(c, zero).alias(c) for c in ("errors", "warnings", "calls")], F.coalesce("includes", F.array().cast("array<string>")).alias("includes"), "diagnostics")
    status = F.when(F.col("errors") > 0, "blocked").when(F.col("warnings") > 0, "review").otherwise("ok")
    rows = rows.withColumn("status", status)
    return rows.withColumn("report", F.to_json(F.struct("status", "errors", "warnings", "includes", "calls", "diagnostics"))).drop("diagnostics")
