import io
import json
import struct
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowloom import fixtures
from rowloom.batch import FORMS, Batch
from rowloom.functions import codes, text
from rowloom.operators.projection import project
from rowloom.plans.errors import BatchError
from rowloom.plans.registry import schema
from rowloom.plans.model import fnv1a64, text_hash
from rowloom.sources import columnar, compression, envelope, evidence, layout, rowtext, wire

U64 = (1 << 64) - 1
# Fingerprints of outputs for the rows of fixtures.telemetry: binary, JSON, protobuf, CSV, semantic, minimal.
TELEMETRY = {
    1: (13770749542948100129, 17292038541002676720, 10996110858210776457, 5987038029037110842, 8007607702969275663, 5675662842119849689),
    100: (17547337684702760264, 3701899216879617566, 7090143078046952150, 10242463504219838882, 6010472766094095941, 5676363273329706498),
    1000: (12753195877377810072, 11668410496576946886, 2492542168883482384, 6096404460398575440, 593905032859009530, 8017765724812527721),
}
MEASUREMENT = {1: (2539323850449312150, 7401674393045840330, 14554528419925650520), 100: (17632741541661655327, 9672582484910190148, 12711201419568319946)}
IDS = ("batch_id", "pos")


def one(df):
    return envelope.checksum(df).first().checksum & U64


@pytest.mark.parametrize("n", TELEMETRY)
def test_golden_telemetry(spark, n):
    s, rows = schema("telemetry_v1"), fixtures.telemetry(spark, n)
    found = envelope.inspect(rows, s).first()
    assert found.row_count == n
    assert (one(envelope.encode(rows, s)), one(rowtext.json_batches(rows, s)), one(wire.protobuf_batches(rows, s)), one(rowtext.csv_batches(rows, s)), found.semantic & U64, found.minimal & U64) == TELEMETRY[n]


@pytest.mark.parametrize("n", MEASUREMENT)
def test_golden_measurement(spark, n):
    s, rows = schema("measurement_v1"), fixtures.measurement(spark, n)
    got = [one(envelope.encode(rows, s)), *(one(envelope.encode(project(rows, s, k, *IDS), p)) for k, p in s.projections.items())]
    assert tuple(got) == MEASUREMENT[n]


def test_fingerprints_do_not_depend_on_partitioning(spark):
    s = schema("telemetry_v1")
    rows = fixtures.telemetry(spark, 50, 40)
    mixed = rows.repartition(7, F.rand(1))
    assert sorted(envelope.inspect(rows, s).collect()) == sorted(envelope.inspect(mixed, s).collect())
    assert {r.semantic for r in envelope.inspect(mixed, s).collect()} == {envelope.inspect(fixtures.telemetry(spark, 50), s).first().semantic}


def oracle(spark):
    """Three rows with an absent and a present zero, a time before 1970 and an empty mask."""
    rows = [(0, 0, 1, 0, 0, 21.5, None, 1, 5), (0, 1, 1, 0, 1000, 0.0, 0.0, 2, 6), (0, 2, 1, 1, -1000, -4.25, 50.0, 3, 0)]
    return spark.createDataFrame(rows, "batch_id long, pos long, schema_version int, device_ordinal int, recorded_at_ms long, temperature_c double, battery_percent double, status_ordinal int, tags_mask long")


# The rows as objects.
ORACLE = [
    {"schema_version": 1, "device": "sensor_a", "recorded_at_ms": 0, "recorded_at_utc": "1970-01-01T00:00:00Z", "temperature_c": 21.5, "status": "active", "tags": ["indoor", "test"]},
    {"schema_version": 1, "device": "sensor_a", "recorded_at_ms": 1000, "recorded_at_utc": "1970-01-01T00:00:01Z", "temperature_c": 0.0, "battery_percent": 0.0, "status": "idle", "tags": ["outdoor", "test"]},
    {"schema_version": 1, "device": "sensor_b", "recorded_at_ms": -1000, "recorded_at_utc": "1969-12-31T23:59:59Z", "temperature_c": -4.25, "battery_percent": 50.0, "status": "offline", "tags": []},
]


def test_oracle_rows_through_every_form(spark):
    b = Batch(oracle(spark), schema("telemetry_v1"))
    assert json.loads(b.to_json().first().data) == {"schema_version": 1, "rows": ORACLE}
    assert b.to_csv().first().data.splitlines()[1] == '1,"sensor_a",0,"1970-01-01T00:00:00Z",21.5,,"active","[""indoor"",""test""]"'
    assert b.to_csv().first().data.splitlines()[3].endswith(',-4.25,50,"offline","[]"')
    table = b.to_arrow()
    assert table.schema.equals(columnar.arrow_schema(b.schema), check_metadata=True)
    assert table.column("battery_percent").to_pylist() == [None, 0.0, 50.0] and table.column("tags").to_pylist() == [5, 6, 0]
    assert table.schema.field("device").metadata == {b"mbt.physical_name": b"device_ordinal", b"mbt.dictionary": b"device"}
    parquet = pq.read_table(io.BytesIO(b.to_parquet().first().data))
    assert parquet.column("tags").type == pa.uint64() and parquet.num_rows == 3
    again = Batch.from_ipc(b.to_ipc(), b.schema)
    assert again.rows.orderBy("pos").collect() == b.rows.orderBy("pos").collect()
    small = b.project("temperature_only")
    assert [set(x) for x in json.loads(small.to_json().first().data)["rows"]] == [{"schema_version", "device", "recorded_at_ms", "recorded_at_utc", "temperature_c"}] * 3
    assert set(FORMS) == {"binary", "json", "csv", "protobuf", "arrow", "arrow_ipc", "parquet"}


def parsed(data: bytes) -> list[tuple[int, object]]:
    """Fields of a protobuf message in wire order."""
    out, at = [], 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return n

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        elif key & 7 == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            width = 8 if key & 7 == 1 else 4
            value, at = struct.unpack("<d" if width == 8 else "<f", data[at : at + width])[0], at + width
        out.append((key >> 3, value))
    return out


def test_protobuf_fields(spark):
    s = schema("telemetry_v1")
    message = parsed(bytes(wire.protobuf_batches(oracle(spark), s).first().data))
    assert message[0] == (1, 1) and [n for n, _ in message[1:]] == [2, 2, 2]
    row = parsed(message[2][1])
    assert row == [(1, 1), (2, b"sensor_a"), (3, 1000), (4, b"1970-01-01T00:00:01Z"), (5, 0.0), (6, 0.0), (7, b"idle"), (8, b"outdoor"), (8, b"test")]
    assert parsed(message[3][1])[2] == (3, (1 << 64) - 1000)
    nested = parsed(parsed(bytes(wire.protobuf_batches(fixtures.measurement(spark, 1), schema("measurement_v1")).first().data))[1][1])
    assert 22 in dict(nested) and parsed(dict(nested)[22])[0] == (1, b"sensor")


@pytest.mark.parametrize("absent", [False, True])
def test_round_trips_over_all_kinds(spark, absent):
    s = schema("test_compatibility_v1")
    rows = fixtures.compatibility(spark, 4, 3, absent)
    want = sorted(map(str, rows.collect()))
    assert sorted(map(str, envelope.access(envelope.encode(rows, s), s).collect())) == want
    assert sorted(map(str, columnar.read_ipc(columnar.ipc_batches(rows, s), s).collect())) == want
    for name, p in s.projections.items():
        kept = project(rows, s, name, *IDS)
        assert sorted(map(str, envelope.access(envelope.encode(kept, p), p).collect())) == sorted(map(str, kept.collect()))


def test_absent_empty_and_zero_are_three_things(spark):
    s = schema("test_compatibility_v1")
    full = fixtures.compatibility(spark, 1)
    rows = [full, fixtures.compatibility(spark, 1, absent=True)]
    rows.append(rows[1].withColumns({f.column: F.array().cast(f.spark_type) for f in s.nullable if f.element}))
    got = [json.loads(rowtext.json_batches(r, s).first().data)["rows"][0] for r in rows]
    assert got[0]["nullable_i64_array"] == [2] and "nullable_i64_array" not in got[1] and got[2]["nullable_i64_array"] == []
    lines = [rowtext.csv_batches(r, s).first().data.splitlines()[1] for r in rows]
    assert lines[1].endswith(',"[0.5]",') and lines[2].endswith(',"[0.5]","[]"')
    # on the wire an empty list and an absent one look alike
    sent = [bytes(wire.protobuf_batches(r, s).first().data) for r in rows]
    assert sent[1] == sent[2] != sent[0]


def test_parquet_tables(spark, tmp_path):
    s = schema("test_compatibility_v1")
    b = Batch(fixtures.compatibility(spark, 3, 2), s)
    b.write_parquet(str(tmp_path / "own"))
    assert sorted(map(str, Batch.from_parquet(spark, str(tmp_path / "own"), s).rows.collect())) == sorted(map(str, b.rows.collect()))
    # a table with unsigned columns, as other writers make it
    one_batch = Batch(fixtures.telemetry(spark, 5), schema("telemetry_v1"))
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x.parquet").write_bytes(one_batch.to_parquet().first().data)
    back = columnar.read_parquet(spark, one_batch.schema, str(tmp_path / "foreign"))
    assert sorted(map(str, back.collect())) == sorted(map(str, one_batch.rows.drop(*IDS).collect()))


def test_caps_from_nothing_to_all(spark):
    b = Batch(oracle(spark), schema("telemetry_v1"))
    for form, whole in (("json", b.to_json()), ("csv", b.to_csv()), ("protobuf", b.to_protobuf()), ("binary", b.encode())):
        size = len(whole.first().data if not isinstance(whole.first().data, str) else whole.first().data.encode())
        for cap, fits in ((0, False), (1, False), (size - 1, False), (size, True), (size + 1, True)):
            row = b.convert(form, cap=cap).first()
            assert (row.error_code is None, row.data is not None) == (fits, fits), (form, cap)
    for form in ("arrow_ipc", "parquet"):
        assert b.convert(form, cap=10).first().error_code == "ResponseTooLarge"
        assert b.convert(form, cap=1 << 20).first().error_code is None


def test_header_rules(spark):
    s = schema("telemetry_v1")
    good = bytes(envelope.encode(oracle(spark), s).first().data)
    assert len(good) == 128 + 3 * 46 + 10 and len(envelope.open_batch(good, s)[0]) == 3

    def broken(at: int, value: bytes) -> str:
        with pytest.raises(BatchError) as e:
            envelope.open_batch(good[:at] + value + good[at + len(value) :], s)
        return e.value.code

    assert broken(0, b"X") == "CorruptMagic"
    assert broken(8, b"\x02") == "UnsupportedTransportVersion"
    assert broken(10, b"\x7f") == "InvalidHeaderLength"
    assert broken(12, b"\x02") == "UnsupportedEncodingKind"
    assert broken(14, b"\x01") == "InvalidFlags"
    assert broken(16, b"\x01") == "UnknownSchemaId"
    assert broken(20, b"\x09") == "SchemaVersionMismatch"
    assert broken(22, b"\x01") == "InvalidHeaderLength"
    assert broken(24, b"\x01") == "SchemaHashMismatch"
    assert broken(40, b"\x09") == "RowCountMismatch"
    assert broken(48, b"\x01") == "PayloadLengthMismatch"
    assert broken(100, b"\x01") == "InvalidHeaderLength"
    assert broken(140, b"\xff") == "PayloadChecksumMismatch"
    for size in (0, 8, 127):
        with pytest.raises(BatchError):
            envelope.open_batch(good[:size], s)
    with pytest.raises(BatchError):
        envelope.open_batch(good[:-1], s)
    changed = good[:140] + b"\xff" + good[141:]
    assert len(envelope.open_batch(changed, s, trusted=True)[0]) == 3
    with pytest.raises(BatchError) as e:
        envelope.open_batch(good, s.projections["temperature_only"])
    assert e.value.code == "SchemaHashMismatch"
    codes_ = envelope.check(spark.createDataFrame([(1, good), (2, changed), (3, b"")], "batch_id long, data binary"), s).orderBy("batch_id").collect()
    assert [r.error_code for r in codes_] == [None, "PayloadChecksumMismatch", "TruncatedPayload"]


def test_folds_agree_for_few_and_many():
    data = [bytes(range(i % 7)) * i for i in range(60)]
    many = layout.fold(data, layout.FNV_BASIS).tolist()
    assert many == [int(layout.fold([d], layout.FNV_BASIS)[0]) for d in data]
    assert many[0] == 0xCBF29CE484222325 and int(layout.fold([b"a"], layout.FNV_BASIS)[0]) == 0xAF63DC4C8601EC8C


def test_numbers_as_text(spark):
    doubles = [1.0, -0.0, 0.0, 0.1, 1e22, 1.5e-7, 123456.789, 5e-324, 1.7976931348623157e308, 2.0**53, -4.25, 1 / 3, 2e23, 1e23]

    def plain(x):
        t = format(Decimal(repr(x)), "f")
        return t.rstrip("0").rstrip(".") if "." in t else t

    got = spark.createDataFrame([(x,) for x in doubles], "x double").select("x", text.number(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got] == [(x, plain(x)) for x in doubles]
    got = spark.createDataFrame([(0.1,), (16777216.0,), (3.5e38 / 100,), (1.25,)], "x float").select(text.number(F.col("x"), True).alias("t")).collect()
    assert [r.t for r in got] == ["0.1", "16777216", "3500000000000000000000000000000000000", "1.25"]
    with pytest.raises(Exception, match="NonFiniteNumeric"):
        spark.createDataFrame([(float("nan"),)], "x double").select(text.number(F.col("x"))).collect()


def test_strings_as_text(spark):
    raw = 'a"b\\c\n\r\t\b\f\x01\x1f é'
    row = spark.createDataFrame([(raw, bytearray(b"\x00" * 100))], "s string, b binary").select(text.json_string(F.col("s")), text.csv_string(F.col("s")), text.csv_array_string(F.col("s")), text.base64(F.col("b"))).first()
    assert json.loads(row[0]) == raw and "\\u001f" in row[0] and "\\b" in row[0]
    assert row[1] == '"' + raw.replace('"', '""') + '"'
    assert row[2].startswith('""a\\""b') and "\\u0008" in row[2] and "\\u000a" in row[2]
    assert (text.json_literal(raw), text.json_literal(raw, False).replace('"', '""')) == (row[0], row[2])
    assert len(row[3]) == 136 and "\n" not in row[3]


def test_times_as_text(spark):
    ms = [0, 999, -1, 1999, 253402300800000, -62135596800001]
    got = spark.createDataFrame([(m,) for m in ms], "m long").select(text.utc(F.col("m")).alias("t")).collect()
    assert [r.t for r in got] == ["1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "1970-01-01T00:00:01Z", "10000-01-01T00:00:00Z", "0000-12-31T23:59:59Z"]


def test_codes(spark):
    values = [f"v{i}" for i in range(64)]
    df = spark.createDataFrame([(["v0", "v63"], "v2"), ([], None)], "t array<string>, s string")
    row = df.select(codes.mask_of(F.col("t"), values).alias("m"), codes.ordinal(F.col("s"), values, 0).alias("o")).select("m", codes.symbols_of(F.col("m"), values).alias("t"), codes.unsigned(F.col("m")).alias("u"), "o", codes.symbol(F.col("o"), values, 0).alias("s")).collect()
    assert (row[0].m, row[0].t, row[0].u, row[0].o, row[0].s) == (-(1 << 63) + 1, ["v0", "v63"], str((1 << 63) + 1), 2, "v2")
    assert (row[1].m, row[1].t, row[1].o, row[1].s) == (0, [], None, None)
    with pytest.raises(Exception, match="InvalidEnumOrdinal"):
        df.select(codes.ordinal(F.lit("zz"), values, 0)).collect()
    with pytest.raises(Exception, match="InvalidEnumOrdinal"):
        df.select(codes.symbol(F.lit(0), values, 1)).collect()


def test_zstd():
    data = b"abc" * 1000
    packed = compression.compress(data)
    assert compression.decompress(packed, len(data)) == data and len(packed) < 100
    for bad, cap in ((packed, len(data) - 1), (packed[:-3], None), (b"nothing", None), (b"", None)):
        with pytest.raises(BatchError):
            compression.decompress(bad, cap)
    with pytest.raises(BatchError):
        compression.compress(data, len(packed) - 1)


def test_ipc_takes_one_batch():
    sink = io.BytesIO()
    batch = pa.record_batch({"a": [1]})
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
        out.write_batch(batch)
    with pytest.raises(BatchError):
        columnar.single_batch(sink.getvalue())
    with pytest.raises(BatchError):
        columnar.single_batch(b"junk")


def test_column_checksums(spark):
    s = schema("telemetry_v1")
    rows = oracle(spark)
    sums = evidence.column_checksums(rows, s).first().checksums
    name = lambda n: struct.pack("<Q", len(n)) + n.encode()
    word = lambda n: struct.pack("<Q", n)
    want = {
        "schema_version": name("schema_version") + struct.pack("<H", 1) + word(3),
        "device": name("device") + word(3) + b"\0" + struct.pack("<3H", 0, 0, 1),
        "battery_percent": name("battery_percent") + word(3) + b"\1" + name("validity") + word(3) + word(1) + word(6) + struct.pack("<3d", 0, 0, 50),
    }
    for i, f in enumerate(s.fields):
        if f.path in want:
            assert sums[i] & U64 == fnv1a64(want[f.path])
    assert evidence.column_checksums(rows.repartition(3), s).first().checksums == sums
    every = schema("test_compatibility_v1")
    full, bare = (fixtures.compatibility(spark, 2, absent=a) for a in (False, True))
    a, b = evidence.column_checksums(full, every).first().checksums, evidence.column_checksums(bare, every).first().checksums
    assert [x != y for x, y in zip(a, b, strict=True)] == [f.bit is not None for f in every.fields]
    assert evidence.batch_checksums(full, every).first() != evidence.batch_checksums(bare, every).first()


def test_record_batch_checksum():
    batch = pa.record_batch([pa.array([7, None], pa.uint16())], schema=pa.schema([pa.field("a", pa.uint16())]))
    name = lambda n: struct.pack("<Q", len(n)) + n.encode()
    longs = lambda *n: struct.pack(f"<{len(n)}Q", *n)
    assert evidence.batch_bytes(batch) == name("arrow-record-batch") + longs(2, 1) + name("a") + name("UInt16") + longs(1) + longs(2, 0, 1) + struct.pack("<2H", 7, 0)


def test_line_ends_do_not_change_a_text_hash():
    assert text_hash(b"a\r\nb\rc") == text_hash(b"a\nb\nc") != text_hash(b"a\n\nb\nc")
