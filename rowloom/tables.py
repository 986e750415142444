"""The driver's tables as row batches: events as telemetry, line items as measurements."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import codes
from rowloom.plans.model import Schema
from rowloom.plans.proto import compile_schema

EVENT_BATCH = 500
TYPES, STATES, TAGS = ("click", "error", "purchase", "signup", "view"), ("active", "idle", "offline"), ("indoor", "outdoor", "test")
FLAGS, LINE_STATES = ("A", "N", "R"), ("F", "O")
ORDER_STATES, PRIORITIES = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

EVENTS = """\
syntax = "proto3";
package tables.events.v1;
option (o.dictionary_values) = { name: "device" value: "click" value: "error" value: "purchase" value: "signup" value: "view" };
option (o.dictionary_values) = { name: "status" value: "active" value: "idle" value: "offline" };
option (o.dictionary_values) = { name: "tag" value: "indoor" value: "outdoor" value: "test" };
message EventsV1 {
  option (o.schema_id) = 60001;
  option (o.schema_version) = 1;
  option (o.transport_name) = "tables.events.v1";
  option (o.payload_root) = true;
  option (o.projection) = { name: "temperature_only" rust_marker: "EventsV1TemperatureOnly" include_field: "temperature_c" };
  uint32 schema_version = 1 [(o.const_u16) = 1];
  repeated EventRowV1 rows = 2 [(o.repeated_payload) = true];
}
message EventRowV1 {
  uint32 schema_version = 1 [(o.const_u16) = 1];
  string device = 2 [(o.dictionary) = "device", (o.key_part) = true, (o.key_order) = 1];
  int64 recorded_at_ms = 3 [(o.key_part) = true, (o.key_order) = 2];
  string recorded_at_utc = 4 [(o.ignored) = true, (o.derived_utc_from) = "recorded_at_ms"];
  double temperature_c = 5;
  optional double battery_percent = 6 [(o.presence_bit) = 0];
  string status = 7 [(o.dictionary) = "status"];
  repeated string tags = 8 [(o.bitmask_dictionary) = "tag"];
}
"""

LINES = """\
syntax = "proto3";
package tables.lines.v1;
option (o.dictionary_values) = { name: "flag" value: "A" value: "N" value: "R" };
option (o.dictionary_values) = { name: "state" value: "F" value: "O" };
message LinesV1 {
  option (o.schema_id) = 60002;
  option (o.schema_version) = 1;
  option (o.transport_name) = "tables.lines.v1";
  option (o.payload_root) = true;
  option (o.projection) = { name: "without_details" rust_marker: "LinesV1WithoutDetails" exclude_group: "metadata" };
  option (o.projection) = { name: "values_only" rust_marker: "LinesV1ValuesOnly" include_field: "quantity" include_field: "price" };
  option (o.projection) = { name: "numeric_only" rust_marker: "LinesV1NumericOnly"
    include_field: "quantity"
    include_field: "price"
    include_field: "tax"
    include_field: "supplier_key"
    include_field: "line_number"
  };
  option (o.projection) = { name: "no_optional" rust_marker: "LinesV1NoOptional" exclude_group: "optional" exclude_field: "supplier_key" };
  uint32 schema_version = 1 [(o.const_u16) = 1];
  repeated LineRowV1 rows = 2 [(o.repeated_payload) = true];
}
message LineRowV1 {
  uint32 schema_version = 1 [(o.const_u16) = 1];
  string flag = 2 [(o.dictionary) = "flag", (o.key_part) = true, (o.key_order) = 1];
  string state = 3 [(o.dictionary) = "state", (o.key_part) = true, (o.key_order) = 2];
  int64 shipped_at_ms = 4 [(o.key_part) = true, (o.key_order) = 3];
  string shipped_at_utc = 5 [(o.ignored) = true, (o.derived_utc_from) = "shipped_at_ms"];
  double quantity = 6;
  double price = 7;
  optional double discount = 8 [(o.presence_bit) = 0, (o.projection_group) = "optional"];
  optional double tax = 9 [(o.presence_bit) = 1, (o.projection_group) = "optional"];
  LineKeysV1 metadata = 10 [(o.projection_group) = "metadata"];
  int32 line_number = 11;
}
message LineKeysV1 {
  int64 order_key = 1;
  int64 part_key = 2;
  optional int64 supplier_key = 3 [(o.presence_bit) = 2];
}
"""


NOTES = """\
syntax = "proto3";
package tables.notes.v1;
option (o.dictionary_values) = { name: "lang" value: "de" value: "en" value: "es" value: "fr" };
message NotesV1 {
  option (o.schema_id) = 60003;
  option (o.schema_version) = 1;
  option (o.transport_name) = "tables.notes.v1";
  option (o.payload_root) = true;
  uint32 schema_version = 1 [(o.const_u16) = 1];
  repeated NoteRowV1 rows = 2 [(o.repeated_payload) = true];
}
message NoteRowV1 {
  uint32 schema_version = 1 [(o.const_u16) = 1];
  string lang = 2 [(o.dictionary) = "lang", (o.key_part) = true, (o.key_order) = 1];
  int64 doc_id = 3 [(o.key_part) = true, (o.key_order) = 2];
  bool long = 4;
  optional bool even = 5 [(o.presence_bit) = 0];
  string source = 6 [(o.raw_string) = true];
  optional string note = 7 [(o.raw_string) = true, (o.presence_bit) = 1];
  bytes blob = 8;
  float ratio = 9;
  repeated int64 sizes = 10;
  repeated double halves = 11 [(o.presence_bit) = 2];
  optional string second_lang = 12 [(o.dictionary) = "lang", (o.presence_bit) = 3];
}
"""


@lru_cache(maxsize=None)
def notes_schema() -> Schema:
    return compile_schema(NOTES, "notes_v1")


LANGS = ("de", "en", "es", "fr")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical rows of notes_schema: what is known of a document, 100 documents a batch, in no key order."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, even, n = notes_schema().base("lang"), F.col("doc_id") % 2 == 0, F.col("n_chars").cast("long")
    return t.select(
        F.floor(F.col("doc_id") / 100).alias("batch_id"),
        F.pmod("doc_id", F.lit(100)).alias("pos"),
        F.lit(1).alias("schema_version"),
        codes.ordinal(F.col("lang"), LANGS, base).alias("lang_ordinal"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (n > 1000).alias("long"),
        F.when(F.col("doc_id") % 3 == 0, even).alias("even"),
        F.col("source").alias("source"),
        F.when(even, F.concat("source", F.lit('\t"x"'))).alias("note"),
        F.encode("source", "UTF-8").alias("blob"),
        (F.lit(0.5) + (n % 4) * 0.25).cast("float").alias("ratio"),
        F.when(even, F.array(n, F.col("doc_id").cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("sizes"),
        F.when(F.col("doc_id") % 5 == 0, F.array(n / 2, F.lit(0.25))).alias("halves"),
        F.when(even, codes.ordinal(F.col("lang"), LANGS, base)).cast("int").alias("second_lang_ordinal"),
    )


@lru_cache(maxsize=None)
def events_schema() -> Schema:
    return compile_schema(EVENTS, "events_v1")


@lru_cache(maxsize=None)
def lines_schema() -> Schema:
    return compile_schema(LINES, "lines_v1")


def millis(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical rows of events_schema, 500 events a batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    base = events_schema().base
    return e.select(
        F.floor(F.col("event_id") / EVENT_BATCH).alias("batch_id"),
        F.pmod("event_id", F.lit(EVENT_BATCH)).alias("pos"),
        F.lit(1).alias("schema_version"),
        codes.ordinal(F.col("event_type"), TYPES, base("device")).alias("device_ordinal"),
        millis(F.col("ts")).alias("recorded_at_ms"),
        F.col("value").alias("temperature_c"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("battery_percent"),
        (F.col("event_id") % 3 + base("status")).cast("int").alias("status_ordinal"),
        k.bitwiseAND(7).cast("long").alias("tags_mask"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical rows of lines_schema, an order a batch."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").cast("long").alias("pos"),
        F.lit(1).alias("schema_version"),
        codes.ordinal(F.col("l_returnflag"), FLAGS, 0).alias("flag_ordinal"),
        codes.ordinal(F.col("l_linestatus"), LINE_STATES, 0).alias("state_ordinal"),
        millis(F.col("l_shipdate")).alias("shipped_at_ms"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("part_key"),
        F.when(F.col("l_suppkey") % 2 == 1, F.col("l_suppkey")).alias("supplier_key"),
        F.col("l_linenumber").cast("int").alias("line_number"),
    )
