"""Rows without randomness, for golden vectors and benchmarks: physical rows made by Spark itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.plans.registry import schema


def numbered(spark: SparkSession, batches: int, rows: int) -> DataFrame:
    ids = spark.range(batches * rows)
    return ids.select(F.floor(F.col("id") / rows).alias("batch_id"), F.pmod("id", F.lit(rows)).alias("pos")).withColumn("i", F.col("pos"))


def _as_physical(df: DataFrame, module: str, values: dict) -> DataFrame:
    return df.select("batch_id", "pos", *[F.lit(values[f.column]).cast(f.spark_type).alias(f.column) for f in schema(module).fields])


def telemetry(spark: SparkSession, rows: int, batches: int = 1) -> DataFrame:
    i = F.col("i")
    even = i % 2 == 0
    return _as_physical(
        numbered(spark, batches, rows),
        "telemetry_v1",
        {
            "schema_version": 1,
            "device_ordinal": 0,
            "recorded_at_ms": F.lit(1_700_000_000_000) + i * 1000,
            "temperature_c": F.lit(20.0) + (i % 16) / 4,
            "battery_percent": F.when(even, F.lit(50.0)),
            "status_ordinal": i % 3 + 1,
            "tags_mask": F.lit(4) + F.when(even, 1).otherwise(2),
        },
    )


def measurement(spark: SparkSession, rows: int, batches: int = 1) -> DataFrame:
    i = F.col("i")
    at = F.lit(1_700_000_000_000) + i * 60_000
    base = F.lit(100.0) + (i % 10_000).cast("double") * 0.01
    values = {"schema_version": 1, "device_ordinal": 1, "interval_ordinal": 0, "started_at_ms": at - 60_000, "recorded_at_ms": at}
    steps = (base, base + 1, base - 1, base + 0.25, i + 1000, i + 100_000, i + 500, i % 20 - 10, i + 50_000, i - 1000)
    values |= {f"value_{c}": v for c, v in zip("abcdefghij", steps, strict=True)}
    values |= {"count_a": i, "count_b": i - 10, "average_value": base + 0.1, "sample_count": i + 1, "source_ordinal": 1, "process_ordinal": 2, "sites_expected_mask": 3, "sites_observed_mask": 1}
    values |= {f"{n}_at_ms": at + k for k, n in enumerate(("ingested", "target_ingested", "built", "committed", "harmonized", "recomputed"), 1)}
    values |= {"recomputed_reason_ordinal": 1, "covered_interval_count": 1, "expected_interval_count": 1, "coverage_ratio": 1.0}
    values |= {"inputs_source_counts_sensor": 1, "inputs_source_counts_api": 0, "inputs_source_counts_synthetic": 0, "inputs_source_counts_corrected": 0}
    values |= {"sensor_window_inputs_coverage_ratio": 1.0, "sensor_window_expected": 12, "sensor_window_synthetic_count": 0, "sensor_window_synthetic_ratio": 0.0}
    values |= {"sensor_window_observed_count": 12, "sensor_window_observed_ratio": 1.0, "age_ms": 100}
    return _as_physical(numbered(spark, batches, rows), "measurement_v1", values)


def compatibility(spark: SparkSession, rows: int, batches: int = 1, absent: bool = False) -> DataFrame:
    """Every kind of field; absent leaves every nullable field out."""
    i = F.col("i")
    number = {"i64": i, "i32": i, "u32": i, "f64": i + 0.5, "f32": i + 0.25}
    values = {"schema_version": 1, "tenant_ordinal": 0, "entity_ordinal": 0, "recorded_at_ms": F.lit(1_800_000_000_000) + i, "status_ordinal": 1, "optional_status_ordinal": 2, "sites_mask": 3}
    for kind, v in number.items():
        values |= {f"required_{kind}": v, f"optional_{kind}": v + 1}
        item = i + 0.5 if kind[0] == "f" else i
        values |= {f"required_{kind}_array": F.array(item) if kind[0] == "f" else F.array(item, item + 1), f"nullable_{kind}_array": F.array(item + (1 if kind[0] == "f" else 2))}
    values |= {"required_bool": i % 2 == 0, "optional_bool": i % 2 != 0, "required_text": F.concat(F.lit("required-"), i), "optional_text": F.concat(F.lit("optional-"), i)}
    values |= {"required_bytes": F.unhex(F.lpad(F.hex(i % 256), 2, "0")), "optional_bytes": F.unhex(F.lpad(F.hex((i + 2) % 256), 2, "0"))}
    values |= {"uuid_text": F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(i.cast("string"), 12, "0")), "jsonb_text": F.concat(F.lit('{"idx":'), i, F.lit("}"))}
    values |= {"timestamptz_text": "2026-01-01T00:00:00Z", "numeric_text": F.concat(i, F.lit(".125"))}
    if absent:
        values |= {f.column: F.lit(None) for f in schema("test_compatibility_v1").nullable}
    return _as_physical(numbered(spark, batches, rows), "test_compatibility_v1", values)
