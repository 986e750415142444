import pytest
from pyspark.sql import functions as F

from rowloom import fixtures
from rowloom.batch import Batch
from rowloom.plans.registry import schema
from rowloom.sources import datasource
from rowloom.streaming import micro

IDS = ("batch_id", "pos")


def test_data_source(spark, tmp_path):
    s = schema("telemetry_v1")
    spark.dataSource.register(datasource.RowBatchSource)
    b = Batch(fixtures.telemetry(spark, 20), s)
    folder = str(tmp_path / "files")
    rows = b.stored().withColumn("batch_id", F.lit("x")).coalesce(1).sortWithinPartitions("pos")
    rows.write.format("rowbatch").option("module", "telemetry_v1").mode("append").save(folder)
    back = datasource.read_source(spark, folder, "telemetry_v1")
    assert sorted(map(str, back.drop("batch_id").collect())) == sorted(map(str, b.rows.drop("batch_id").collect()))
    files = datasource.read_files(spark, folder, s)
    assert files.count() == 20 and files.select("batch_id").distinct().count() == 1
    rows.write.format("rowbatch").option("module", "telemetry_v1").mode("overwrite").save(folder)
    assert datasource.read_source(spark, folder, "telemetry_v1", trusted=True).count() == 20


def test_batches_of_a_task_are_files_of_their_own(spark, tmp_path):
    s = schema("telemetry_v1")
    folder = str(tmp_path / "files")
    rows = Batch(fixtures.telemetry(spark, 20, 3), s).stored()
    datasource.write_source(rows.coalesce(1).orderBy(F.rand(3)), folder, "telemetry_v1")
    back = datasource.read_source(spark, folder, "telemetry_v1")
    assert sorted(r["count"] for r in back.groupBy("batch_id").count().collect()) == [20, 20, 20]
    assert sorted(str(r) for r in back.drop("batch_id").collect()) == sorted(str(r) for r in Batch(fixtures.telemetry(spark, 20, 3), s).rows.drop("batch_id").collect())
    bad = rows.withColumn("temperature_c", F.when(F.col("pos") == 3, float("nan")).otherwise(F.col("temperature_c")))
    with pytest.raises(Exception, match="NonFiniteNumeric"):
        datasource.write_source(bad, folder, "telemetry_v1")
    datasource.write_source(bad, folder, "telemetry_v1", mode="overwrite", trusted=True)
    assert datasource.read_source(spark, folder, "telemetry_v1", trusted=True).count() == 60
    with pytest.raises(Exception, match="NonFiniteNumeric"):
        datasource.read_source(spark, folder, "telemetry_v1").collect()


def test_rows_without_a_batch_id_are_a_batch(spark):
    s = schema("telemetry_v1")
    rows = fixtures.telemetry(spark, 10, 2).withColumn("batch_id", F.when(F.col("batch_id") > 0, F.col("batch_id")))
    b = Batch(rows, s)
    for form in ("binary", "json", "csv", "protobuf", "arrow", "arrow_ipc", "parquet"):
        got = {r.batch_id for r in b.convert(form, trusted=True).select("batch_id").collect()}
        assert got == {r.batch_id for r in rows.select("batch_id").distinct().collect()} and None in got, form


def test_streams(spark, tmp_path):
    s = schema("telemetry_v1")
    source = str(tmp_path / "in")
    fixtures.telemetry(spark, 10, 6).write.parquet(source)
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    assert micro.project_stream(rows, s, "temperature_only").columns == [*IDS, "schema_version", "device_ordinal", "recorded_at_ms", "temperature_c"]
    out = str(tmp_path / "out")
    micro.each_batch(rows, s, micro.encode_to(out), str(tmp_path / "state")).awaitTermination(120)
    encoded = spark.read.parquet(out)
    assert encoded.count() == 6
    assert Batch.access(encoded.select("batch_id", "data"), s).rows.count() == 60
    shown = micro.logical_stream(rows, s).writeStream.format("memory").queryName("shown").trigger(availableNow=True).start()
    shown.awaitTermination(120)
    assert spark.table("shown").count() == 60
