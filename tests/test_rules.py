import pytest
from pyspark.sql import functions as F

from rowloom import fixtures
from rowloom.batch import Batch
from rowloom.functions import presence
from rowloom.operators import projection, sizes, validation
from rowloom.plans.proto import compile_schema
from rowloom.plans.registry import schema

from .notation import declaration

IDS = ("batch_id", "pos")


def stored(spark, module="telemetry_v1", n=3):
    make = {"telemetry_v1": fixtures.telemetry, "test_compatibility_v1": fixtures.compatibility}[module]
    return presence.stored(make(spark, n), schema(module), *IDS)


@pytest.mark.parametrize(
    ("column", "value", "code"),
    [
        ("schema_version", 2, "SchemaVersionMismatch"),
        ("device_ordinal", 99, "InvalidEnumOrdinal"),
        ("status_ordinal", 99, "InvalidEnumOrdinal"),
        ("status_ordinal", 0, "InvalidEnumOrdinal"),
        ("tags_mask", 8, "InvalidBitmask"),
        ("tags_mask", -1, "InvalidBitmask"),
        ("presence_bits", 2, "InvalidPresenceBits"),
        ("battery_percent", 1.0, "InvalidPresenceBits"),
        ("temperature_c", float("nan"), "NonFiniteNumeric"),
        ("temperature_c", float("-inf"), "NonFiniteNumeric"),
        ("battery_percent", float("inf"), "NonFiniteNumeric"),
    ],
)
def test_each_rule(spark, column, value, code):
    s, rows = schema("telemetry_v1"), stored(spark)
    bad = rows.withColumn(column, F.when(F.col("pos") == 1, F.lit(value)).otherwise(F.col(column)).cast(rows.schema[column].dataType))
    found = sorted((r.pos, r.error_code) for r in validation.report(bad, s).collect())
    assert found[0] == (1, code)
    assert found[1:] == ([(2, "InvalidTimeGrid")] if column == "device_ordinal" else [])  # the next key is lower
    with pytest.raises(Exception, match=code):
        validation.strict(bad, s).select("temperature_c", "batch_id").collect()
    assert validation.batch_report(bad, s).first().error_code == code


def test_good_rows_pass(spark):
    for module in ("telemetry_v1", "test_compatibility_v1"):
        assert validation.report(stored(spark, module), schema(module)).count() == 0
    assert validation.batch_report(stored(spark), schema("telemetry_v1")).first().error_code is None


def test_absent_negative_zero_passes(spark):
    rows = stored(spark).withColumn("battery_percent", F.when(F.col("pos") == 1, F.lit(-0.0)).otherwise(F.col("battery_percent")))
    assert validation.report(rows, schema("telemetry_v1")).count() == 0


def test_key_order(spark):
    s, rows = schema("telemetry_v1"), stored(spark)
    swapped = rows.withColumn("pos", F.when(F.col("pos") == 0, 1).when(F.col("pos") == 1, 0).otherwise(F.col("pos")).cast("long"))
    assert [(r.pos, r.error_code) for r in validation.report(swapped, s).collect()] == [(1, "InvalidTimeGrid")]
    equal = rows.withColumn("recorded_at_ms", F.lit(5).cast("long"))
    assert validation.report(equal, s).count() == 0
    with pytest.raises(Exception, match="InvalidTimeGrid"):
        Batch.from_stored(swapped, s).inspect().collect()
    assert Batch.from_stored(swapped, s).inspect(trusted=True).first().row_count == 3


def test_rules_of_lists(spark):
    s, rows = schema("test_compatibility_v1"), stored(spark, "test_compatibility_v1")
    nan = rows.withColumn("required_f32_array", F.array(F.lit(1.0), F.lit(float("nan"))).cast("array<float>"))
    assert {r.error_code for r in validation.report(nan, s).collect()} == {"NonFiniteNumeric"}
    hole = rows.withColumn("required_i64_array", F.array(F.lit(None).cast("long")))
    assert {r.error_code for r in validation.report(hole, s).collect()} == {"MalformedArchive"}
    held = rows.withColumn("presence_bits", F.lit(0).cast("long"))
    assert {(r.error_code, r.error_field) for r in validation.report(held, s).collect()} == {("InvalidPresenceBits", "optional_status")}


def many_nullable(n: int):
    lines = ["schema_version const 1", "at_ms i64 key 1", *(f"f{i} i64 bit {i}" for i in range(n))]
    return compile_schema(declaration("w.v1", 9, "w.v1", "RootV1", "RowV1", {}, {"RowV1": "\n".join(lines)}, []), "w_v1")


@pytest.mark.parametrize("n", [64, 65, 130])
def test_presence_beyond_one_word(spark, n):
    s = many_nullable(n)
    rows = spark.range(2).select(F.lit(0).alias("batch_id"), F.col("id").alias("pos"), F.lit(1).alias("schema_version"), F.col("id").alias("at_ms"), *[F.when(F.col("id") + i != 1, F.lit(7)).cast("long").alias(f"f{i}") for i in range(n)])
    kept = presence.stored(rows, s, *IDS)
    assert validation.report(kept, s).count() == 0
    assert presence.loaded(kept, s, *IDS).orderBy("pos").collect() == rows.orderBy("pos").collect()
    b = Batch(rows, s)
    assert Batch.access(b.encode(), s).rows.orderBy("pos").collect() == rows.orderBy("pos").collect()
    assert b.inspect().first().row_count == 2
    if n > 64:
        last = (n - 1) // 64
        beyond = kept.withColumn("presence_bits", F.transform("presence_bits", lambda w, i: F.when(i == last, w.bitwiseOR(F.lit(-(1 << 63)).cast("long"))).otherwise(w)))
        assert {r.error_code for r in validation.report(beyond, s).collect()} == {"InvalidPresenceWord"}


def test_projection_reads_only_its_columns(spark, tmp_path):
    s = schema("telemetry_v1")
    fixtures.telemetry(spark, 100, 3).write.parquet(str(tmp_path / "t"))
    kept = projection.project(spark.read.parquet(str(tmp_path / "t")), s, "temperature_only", *IDS)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "temperature_c" in plan and "battery_percent" not in plan


def test_columnar_size_matches_the_batches(spark):
    from rowloom.sources import columnar

    for module, make in (("telemetry_v1", fixtures.telemetry), ("measurement_v1", fixtures.measurement), ("test_compatibility_v1", fixtures.compatibility)):
        s, rows = schema(module), make(spark, 70)
        assert sizes.columnar_size(rows, s).first().columnar_bytes == columnar.batch_size(rows.orderBy("pos").toArrow(), s)


def test_empty_input(spark):
    s = schema("telemetry_v1")
    b = Batch(fixtures.telemetry(spark, 3).limit(0), s)
    for df in (b.encode(), b.inspect(), b.to_json(), b.to_csv(), b.to_protobuf(), b.to_ipc(), b.report(), b.batch_report(), b.columnar_size(), b.logical()):
        assert df.count() == 0
