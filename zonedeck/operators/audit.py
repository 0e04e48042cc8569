"""Audit, profile and verification of the long relation: aggregates by field, combined before any shuffle."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import Plan
from .decode import decode_long


def _negative_zero():
    return F.coalesce(F.col("value").try_cast("decimal(38,18)") == 0, F.lit(False)) & F.col("sign_nibble").isin("0xB", "0xD")


def _non_preferred():
    return F.col("sign_nibble").isin("0xA", "0xB", "0xE")


def _profile() -> list[Column]:
    """Aggregates of a profile: of a field, or of any part of its rows."""
    number = F.when(F.col("valid"), F.col("value").try_cast("decimal(38,18)"))
    some = F.when(number.isNotNull(), F.struct(number.alias("n"), F.col("value").alias("t")))
    return [
        F.count("*").alias("fields_seen"), F.count_if("valid").alias("fields_valid"), F.count_if(~F.col("valid")).alias("fields_invalid"), F.min(some).alias("least"), F.max(some).alias("most"),
        F.count_if(_negative_zero()).alias("negative_zero_count"), F.count_if(_non_preferred()).alias("non_preferred_sign_count"),
    ]


def field_profiles(rows: DataFrame) -> DataFrame:
    """By field: rows seen, valid, invalid, least and greatest value that reads as a number, negative zeros, non-preferred signs."""
    found = rows.groupBy("field").agg(*_profile())
    names = ["fields_seen", "fields_valid", "fields_invalid"]
    return found.select("field", *names, F.col("least.t").alias("min_value"), F.col("most.t").alias("max_value"), "negative_zero_count", "non_preferred_sign_count")


def sign_distribution(rows: DataFrame) -> DataFrame:
    return rows.filter("sign_nibble IS NOT NULL").groupBy("field", "sign_nibble").agg(F.count("*").alias("n"))


def error_distribution(rows: DataFrame) -> DataFrame:
    return rows.filter("error_code IS NOT NULL").groupBy("field", "error_code").agg(F.count("*").alias("n"))


def counters(rows: DataFrame) -> DataFrame:
    """One row: records and fields seen, valid and invalid. A record's rows come from one record, so no distinct is needed."""
    by_record = rows.groupBy("record_index").agg(F.count("*").alias("seen"), F.count_if("valid").alias("valid"))
    one = by_record.agg(
        F.count("*").alias("records_seen"), F.count_if(F.col("seen") == F.col("valid")).alias("records_valid"),
        F.count_if(F.col("seen") != F.col("valid")).alias("records_invalid"),
        F.coalesce(F.sum("seen"), F.lit(0)).alias("fields_seen"), F.coalesce(F.sum("valid"), F.lit(0)).alias("fields_valid"),
        F.coalesce(F.sum(F.col("seen") - F.col("valid")), F.lit(0)).alias("fields_invalid"),
    )
    return one.withColumn("status", F.when(F.col("records_seen") == 0, "empty").when(F.col("fields_invalid") == 0, "passed").otherwise("failed"))


def failure_samples(rows: DataFrame, limit: int = 25) -> DataFrame:
    """The first invalid rows in record order."""
    if not 0 <= limit <= 1000:
        raise ValueError("E_CONFIG: sample limit must be in 0..=1000")
    return rows.filter("NOT valid").orderBy("record_index", "pos").limit(limit)


def verdicts(plan: Plan, one: dict[str, Any]) -> dict[str, bool]:
    """Byte-for-byte: of fields; of records, which takes scope record and a layout that covers every byte once."""
    fields = one["fields_invalid"] == 0 and one["records_seen"] > 0
    cover = plan.coverage()
    records = fields and plan.scope == "record" and cover["full"]
    return {"field_byte_for_byte_verified": fields, "record_byte_for_byte_verified": records, "byte_for_byte_verified": records if plan.scope == "record" else fields}


def report(records: DataFrame, plan: Plan, verify: bool = True, samples: int = 25, max_records: int | None = None) -> dict[str, Any]:
    """The audit report. What reaches the driver is bounded by the schema's fields, the codes and the samples."""
    rows = decode_long(records, plan, verify, audit=True, max_records=max_records)
    one = counters(rows).first().asDict()
    counts = ("fields_seen", "fields_valid", "fields_invalid", "negative_zero_count", "non_preferred_sign_count")
    profiles: dict[str, dict[str, Any]] = {}
    totals: dict[str, dict[str, int]] = {"sign_distribution": {}, "error_distribution": {}}
    # One aggregation by field, sign and code; the rest is sums and extremes of its few rows.
    for r in rows.groupBy("field", "sign_nibble", "error_code").agg(*_profile()).collect():
        p = profiles.setdefault(r["field"], {"field": r["field"], **dict.fromkeys(counts, 0), "least": None, "most": None})
        for k in counts:
            p[k] += r[k]
        for k, better in (("least", min), ("most", max)):
            p[k] = better((x for x in (p[k], r[k]) if x is not None), default=None)
        for name, key in (("sign_distribution", "sign_nibble"), ("error_distribution", "error_code")):
            if r[key] is not None:
                for held in (p.setdefault(name, {}), totals[name]):
                    held[r[key]] = held.get(r[key], 0) + r["fields_seen"]
    for p in profiles.values():
        p["min_value"], p["max_value"] = (x and x["t"] for x in (p.pop("least"), p.pop("most")))
    one |= {name: dict(sorted(total.items())) for name, total in totals.items()}
    for k in ("negative_zero_count", "non_preferred_sign_count"):
        one[k] = sum(p[k] for p in profiles.values())
    return one | (verdicts(plan, one) if verify else {}) | {
        "schema_hash": plan.semantic_hash, "schema_file_sha256": plan.file_sha256, "record_coverage": plan.coverage(), "verification_scope": plan.scope,
        "field_profiles": dict(sorted(profiles.items())), "failure_samples": [r.asDict() for r in failure_samples(rows, samples).drop("pos").collect()],
    }


def file_hashes(spark, path: str) -> DataFrame:
    """(path, sha256) of whole input files."""
    return spark.read.format("binaryFile").load(path).select("path", F.upper(F.sha2("content", 256)).alias("sha256"))
