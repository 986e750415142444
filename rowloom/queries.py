"""One query for each operator over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.batch import Batch, convert
from rowloom.functions import codes, presence, text
from rowloom.operators import projection, sizes, validation
from rowloom.sources import columnar, compression, envelope, evidence, rowtext, wire
from rowloom.tables import LANGS, LINE_STATES, ORDER_STATES, PRIORITIES, STATES, TAGS, TYPES, events, events_schema, lines, lines_schema, notes, notes_schema

Query = Callable[[SparkSession, str], DataFrame]
IDS = ("batch_id", "pos")
CAP = 17_000

EV = """ev AS (SELECT event_id // 500 AS batch_id, event_id % 500 AS pos, 1 AS schema_version,
 list_position(['click','error','purchase','signup','view'], event_type) - 1 AS device_ordinal,
 epoch_us(ts) // 1000 AS recorded_at_ms, value AS temperature_c,
 CASE WHEN event_id % 2 = 0 THEN value END AS battery_percent,
 (event_id % 3 + 1)::INTEGER AS status_ordinal, ((props->>'$.k')::INTEGER & 7)::BIGINT AS tags_mask, event_id FROM events)"""
LI = """li AS (SELECT l_orderkey AS batch_id, l_linenumber::BIGINT AS pos, 1 AS schema_version,
 list_position(['A','N','R'], l_returnflag) - 1 AS flag_ordinal, list_position(['F','O'], l_linestatus) - 1 AS state_ordinal,
 epoch_us(l_shipdate) // 1000 AS shipped_at_ms, l_quantity AS quantity, l_extendedprice AS price,
 CASE WHEN l_discount > 0 THEN l_discount END AS discount, CASE WHEN l_tax > 0 THEN l_tax END AS tax,
 l_orderkey AS order_key, l_partkey AS part_key, CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey END AS supplier_key,
 l_linenumber::INTEGER AS line_number FROM lineitem)"""
EV_COLUMNS = "batch_id, pos, schema_version, device_ordinal, recorded_at_ms, temperature_c, battery_percent, status_ordinal, tags_mask"
LI_COLUMNS = "batch_id, pos, schema_version, flag_ordinal, state_ordinal, shipped_at_ms, quantity, price, discount, tax, order_key, part_key, supplier_key, line_number"
#: Text of a float that has no exponent, and of a time.
NUMBER = "regexp_replace({0}::VARCHAR, '\\.0$', '')"
UTC = "strftime(make_timestamp(({0} // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
DEVICE = "['click','error','purchase','signup','view'][device_ordinal + 1]"
STATUS = "['active','idle','offline'][status_ordinal]"
TAG_LIST = "list_filter([CASE WHEN tags_mask & 1 <> 0 THEN 'indoor' END, CASE WHEN tags_mask & 2 <> 0 THEN 'outdoor' END, CASE WHEN tags_mask & 4 <> 0 THEN 'test' END], lambda x: x IS NOT NULL)"
JSON_ROW = f"""'{{"schema_version":1,"device":"' || {DEVICE} || '","recorded_at_ms":' || recorded_at_ms || ',"recorded_at_utc":"' || {UTC.format("recorded_at_ms")}
 || '","temperature_c":' || {NUMBER.format("temperature_c")} || coalesce(',"battery_percent":' || {NUMBER.format("battery_percent")}, '')
 || ',"status":"' || {STATUS} || '","tags":[' || array_to_string(list_transform({TAG_LIST}, lambda x: '"' || x || '"'), ',') || ']}}'"""
CSV_ROW = f"""'1,"' || {DEVICE} || '",' || recorded_at_ms || ',"' || {UTC.format("recorded_at_ms")} || '",' || {NUMBER.format("temperature_c")} || ','
 || coalesce({NUMBER.format("battery_percent")}, '') || ',"' || {STATUS} || '","[' || array_to_string(list_transform({TAG_LIST}, lambda x: '""' || x || '""'), ',') || ']"'"""
CSV_HEAD = "schema_version,device,recorded_at_ms,recorded_at_utc,temperature_c,battery_percent,status,tags"

found: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        found[name] = (f, sql)
        return f

    return keep


# dictionaries, bitmasks, presence, text


@query("dict_encode", f"SELECT o_orderkey, list_position({list(ORDER_STATES)}, o_orderstatus) AS status_ordinal, list_position({list(PRIORITIES)}, o_orderpriority) AS priority_ordinal, list_position({list(PRIORITIES)}, o_orderpriority) - 1 AS priority_key FROM orders")
def dict_encode(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select("o_orderkey", codes.ordinal(status, ORDER_STATES, 1).alias("status_ordinal"), codes.ordinal(priority, PRIORITIES, 1).alias("priority_ordinal"), codes.ordinal(priority, PRIORITIES, 0).alias("priority_key"))


@query("dict_encode_unknown", "SELECT o_orderkey, coalesce(list_position(['F','O'], o_orderstatus), 65535) AS status_ordinal FROM orders")
def dict_encode_unknown(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", codes.ordinal(F.col("o_orderstatus"), LINE_STATES, 1, strict=False).alias("status_ordinal"))


@query("dict_decode", f"WITH {EV} SELECT batch_id, pos, {DEVICE} AS device, {STATUS} AS status FROM ev")
def dict_decode(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(*IDS, codes.symbol(F.col("device_ordinal"), TYPES, 0).alias("device"), codes.symbol(F.col("status_ordinal"), STATES, 1).alias("status"))


@query("bitmask_decode", f"WITH {EV} SELECT batch_id, pos, array_to_string({TAG_LIST}, ',') AS tags, len({TAG_LIST}) AS n_tags FROM ev")
def bitmask_decode(spark: SparkSession, d: str) -> DataFrame:
    tags = codes.symbols_of(F.col("tags_mask"), TAGS)
    return events(spark, d).select(*IDS, F.array_join(tags, ",").alias("tags"), F.size(tags).cast("long").alias("n_tags"))


@query("bitmask_encode", f"WITH {EV} SELECT batch_id, pos, tags_mask FROM ev")
def bitmask_encode(spark: SparkSession, d: str) -> DataFrame:
    named = events(spark, d).select(*IDS, codes.symbols_of(F.col("tags_mask"), TAGS).alias("tags"))
    return named.select(*IDS, codes.mask_of(F.col("tags"), TAGS).alias("tags_mask"))


BITS = "(CASE WHEN discount IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN tax IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN supplier_key IS NOT NULL THEN 4 ELSE 0 END)::BIGINT"


@query("presence_pack", f"WITH {LI} SELECT batch_id, pos, {BITS} AS presence_bits, coalesce(discount, 0) AS discount, coalesce(tax, 0) AS tax, coalesce(supplier_key, 0) AS supplier_key FROM li")
def presence_pack(spark: SparkSession, d: str) -> DataFrame:
    return presence.stored(lines(spark, d), lines_schema(), *IDS).select(*IDS, "presence_bits", "discount", "tax", "supplier_key")


@query("presence_unpack", f"WITH {LI} SELECT batch_id, pos, discount, tax, supplier_key FROM li")
def presence_unpack(spark: SparkSession, d: str) -> DataFrame:
    return presence.loaded(presence.stored(lines(spark, d), lines_schema(), *IDS), lines_schema(), *IDS).select(*IDS, "discount", "tax", "supplier_key")


@query("utc_derive", f"WITH {EV} SELECT batch_id, pos, {UTC.format('recorded_at_ms')} AS recorded_at_utc, 20::INTEGER AS utc_len FROM ev")
def utc_derive(spark: SparkSession, d: str) -> DataFrame:
    utc = text.utc(F.col("recorded_at_ms"))
    return events(spark, d).select(*IDS, utc.alias("recorded_at_utc"), F.length(utc).alias("utc_len"))


@query("number_text", f"SELECT l_orderkey, l_linenumber, {NUMBER.format('l_extendedprice')} AS price, {NUMBER.format('l_discount')} AS discount FROM lineitem")
def number_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.number(F.col("l_extendedprice")).alias("price"), text.number(F.col("l_discount")).alias("discount"))


@query("base64_bytes", "SELECT p_partkey, base64(encode(p_name)) AS name64, base64(encode(repeat(p_name, 5))) AS long64 FROM part")
def base64_bytes(spark: SparkSession, d: str) -> DataFrame:
    raw = lambda c: F.encode(c, "UTF-8")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.base64(raw(F.col("p_name"))).alias("name64"), text.base64(raw(F.repeat("p_name", 5))).alias("long64"))


@query("json_string", r"""SELECT conv_id, turn, '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS js FROM conversations""")
def json_string(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.json_string(F.col("text")).alias("js"))


@query("csv_string", """SELECT page_id, '"' || replace(html, '"', '""') || '"' AS cell FROM pages""")
def csv_string(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.csv_string(F.col("html")).alias("cell"))


# views and projections


@query("physical_view", f"WITH {EV} SELECT {EV_COLUMNS} FROM ev")
def physical_view(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d)


LOGICAL = f"schema_version, {DEVICE} AS device, recorded_at_ms, {UTC.format('recorded_at_ms')} AS recorded_at_utc, temperature_c, battery_percent, {STATUS} AS status, array_to_string({TAG_LIST}, ',') AS tags"


@query("logical_view", f"WITH {EV} SELECT batch_id, pos, {LOGICAL} FROM ev")
def logical_view(spark: SparkSession, d: str) -> DataFrame:
    return projection.logical(events(spark, d), events_schema(), *IDS).withColumn("tags", F.array_join("tags", ","))


@query("logical_to_physical", f"WITH {EV} SELECT {EV_COLUMNS} FROM ev")
def logical_to_physical(spark: SparkSession, d: str) -> DataFrame:
    return projection.physical(projection.logical(events(spark, d), events_schema(), *IDS), events_schema(), *IDS)


@query("project_temperature_only", f"WITH {EV} SELECT batch_id, pos, {DEVICE} AS device, schema_version, recorded_at_ms, {UTC.format('recorded_at_ms')} AS recorded_at_utc, temperature_c FROM ev")
def project_temperature_only(spark: SparkSession, d: str) -> DataFrame:
    """Checked rows, projected, as row formats show them."""
    s = events_schema()
    kept = projection.project(events(spark, d), s, "temperature_only", *IDS)
    small = s.projections["temperature_only"]
    return projection.logical(_field_checked(kept, small), small, *IDS)


def _field_checked(rows: DataFrame, schema) -> DataFrame:
    """Rows with every rule but key order, which events do not keep."""
    error = validation.row_error(schema, ordered=False)
    first, *rest = rows.columns
    failure = F.raise_error(F.concat_ws(" ", F.col("__e.code"), F.col("__e.field")))
    ready = rows.withColumn("presence_bits", presence.presence(schema)) if schema.words else rows
    return ready.withColumn("__e", error).select(F.when(F.col("__e").isNull(), F.col(first)).otherwise(failure.cast(rows.schema[first].dataType)).alias(first), *rest)


def _project_lines(name: str) -> None:
    fields = ", ".join(f.column for f in lines_schema().projections[name].fields)
    query(f"project_{name}", f"WITH {LI} SELECT batch_id, pos, {fields} FROM li")(lambda spark, d: projection.project(lines(spark, d), lines_schema(), name, *IDS))


for _name in ("without_details", "values_only", "numeric_only", "no_optional"):
    _project_lines(_name)


@query(
    "projection_presence_repack",
    f"WITH {LI} SELECT batch_id, pos, schema_version, flag_ordinal, state_ordinal, shipped_at_ms, quantity, price, coalesce(tax, 0) AS tax, coalesce(supplier_key, 0) AS supplier_key, line_number, (CASE WHEN tax IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN supplier_key IS NOT NULL THEN 2 ELSE 0 END)::BIGINT AS presence_bits FROM li",
)
def projection_presence_repack(spark: SparkSession, d: str) -> DataFrame:
    s = lines_schema()
    return projection.project_stored(presence.stored(lines(spark, d), s, *IDS), s, "numeric_only", *IDS)


# rules

BROKEN = """bad AS (SELECT batch_id, pos, CASE WHEN event_id % 97 = 0 THEN 2 ELSE schema_version END AS schema_version,
 CASE WHEN event_id % 89 = 0 THEN 99 ELSE device_ordinal END AS device_ordinal, recorded_at_ms,
 CASE WHEN event_id % 83 = 0 THEN 'nan'::DOUBLE ELSE temperature_c END AS temperature_c,
 CASE WHEN event_id % 79 = 0 THEN 1.0 ELSE coalesce(battery_percent, 0) END AS battery_percent,
 CASE WHEN event_id % 73 = 0 THEN 0 ELSE status_ordinal END AS status_ordinal,
 CASE WHEN event_id % 71 = 0 THEN 8 ELSE tags_mask END AS tags_mask,
 (CASE WHEN battery_percent IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN event_id % 67 = 0 THEN 2 ELSE 0 END)::BIGINT AS presence_bits FROM ev)"""
RULES = {
    "const": ("schema_version <> 1", "SchemaVersionMismatch", "schema_version"),
    "ordinal": ("device_ordinal NOT BETWEEN 0 AND 4", "InvalidEnumOrdinal", "device"),
    "finite": ("isnan(temperature_c) OR isinf(temperature_c)", "NonFiniteNumeric", "temperature_c"),
    "status": ("status_ordinal NOT BETWEEN 1 AND 3", "InvalidEnumOrdinal", "status"),
    "mask": ("tags_mask & ~7 <> 0", "InvalidBitmask", "tags"),
    "presence": ("presence_bits & ~1 <> 0", "InvalidPresenceBits", "presence_bits"),
    "absent": ("presence_bits & 1 = 0 AND battery_percent <> 0", "InvalidPresenceBits", "battery_percent"),
}
KEYS = "(device_ordinal < lag(device_ordinal) OVER w OR (device_ordinal = lag(device_ordinal) OVER w AND recorded_at_ms < lag(recorded_at_ms) OVER w))"
WINDOW = "WINDOW w AS (PARTITION BY batch_id ORDER BY pos)"


def broken(spark: SparkSession, d: str) -> DataFrame:
    """Stored events in which some rows break each rule."""
    rows = presence.stored(events(spark, d), events_schema(), *IDS)
    at = F.col("batch_id") * 500 + F.col("pos")

    def put(every: int, value, column: str):
        return F.when(at % every == 0, F.lit(value)).otherwise(F.col(column)).cast(rows.schema[column].dataType)

    return rows.withColumns({
        "schema_version": put(97, 2, "schema_version"), "device_ordinal": put(89, 99, "device_ordinal"), "temperature_c": put(83, float("nan"), "temperature_c"),
        "battery_percent": put(79, 1.0, "battery_percent"), "status_ordinal": put(73, 0, "status_ordinal"), "tags_mask": put(71, 8, "tags_mask"),
        "presence_bits": F.col("presence_bits") + F.when(at % 67 == 0, 2).otherwise(0),
    })


def _case(keys: bool, part: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[part]}'" for r in RULES.values()) + (f" WHEN {KEYS} THEN '{('', 'InvalidTimeGrid', 'key order regression')[part]}'" if keys else "") + " END"


@query("validate_report", f"WITH {EV}, {BROKEN}, e AS (SELECT batch_id, pos, {_case(True, 1)} AS error_code, {_case(True, 2)} AS error_field FROM bad {WINDOW}) SELECT * FROM e WHERE error_code IS NOT NULL")
def validate_report(spark: SparkSession, d: str) -> DataFrame:
    return validation.report(broken(spark, d), events_schema()).drop("error_value")


@query("validate_batches", f"WITH {EV}, {BROKEN}, e AS (SELECT batch_id, pos, {_case(True, 1)} AS c, {_case(True, 2)} AS f FROM bad {WINDOW}) SELECT batch_id, count(*) AS n_rows, min(CASE WHEN c IS NOT NULL THEN pos END) AS error_pos, arg_min(CASE WHEN c IS NOT NULL THEN c END, CASE WHEN c IS NOT NULL THEN pos END) AS error_code, arg_min(CASE WHEN c IS NOT NULL THEN f END, CASE WHEN c IS NOT NULL THEN pos END) AS error_field FROM e GROUP BY batch_id")
def validate_batches(spark: SparkSession, d: str) -> DataFrame:
    return validation.batch_report(broken(spark, d), events_schema())


@query("validate_key_order", f"WITH {EV}, e AS (SELECT batch_id, pos, {KEYS} AS bad FROM ev {WINDOW}) SELECT batch_id, pos FROM e WHERE bad")
def validate_key_order(spark: SparkSession, d: str) -> DataFrame:
    return validation.physical_error(events(spark, d), events_schema()).where("error_code = 'InvalidTimeGrid'").select(*IDS)


def _one_rule(name: str, columns: list[str]) -> None:
    condition, code, field = RULES[name]
    rules = {f.column: f for f in events_schema().fields}

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = events_schema()
        found_rules = [validation.field_rule(rules[c], s) for c in columns] if columns else validation.presence_rules(s)
        rows = broken(spark, d)
        error = F.coalesce(*[F.when(r["field"] == field, r) for r in found_rules])
        return rows.select(*IDS, error.alias("e")).where("e IS NOT NULL").select(*IDS, F.col("e.code").alias("error_code"), F.col("e.field").alias("error_field"))

    query(f"validate_{name}", f"WITH {EV}, {BROKEN} SELECT batch_id, pos, '{code}' AS error_code, '{field}' AS error_field FROM bad WHERE {condition}")(run)


for _name, _columns in (("const", ["schema_version"]), ("ordinal", ["device_ordinal"]), ("finite", ["temperature_c"]), ("status", ["status_ordinal"]), ("mask", ["tags_mask"]), ("presence", []), ("absent", [])):
    _one_rule(_name, _columns)


# sizes and caps

N = "count(*)"
COLUMNAR = f"(10 + {N} * 2 + {N} * 8 + {N} * 8 + {N} * 8 + ((({N} + 63) // 64) * 8) + {N} * 2 + {N} * 8)::BIGINT"


@query("batch_row_count", f"WITH {EV} SELECT batch_id, count(*) AS row_count FROM ev GROUP BY batch_id")
def batch_row_count(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("batch_id").agg(F.count("*").alias("row_count"))


@query("batch_columnar_size", f"WITH {EV} SELECT batch_id, {N} AS n_rows, {COLUMNAR} AS columnar_bytes FROM ev GROUP BY batch_id")
def batch_columnar_size(spark: SparkSession, d: str) -> DataFrame:
    return sizes.columnar_size(events(spark, d), events_schema())


LI_COLUMNAR = f"(10 + {N} * 4 + {N} * 8 * 7 + {N} * 4 + 3 * ((({N} + 63) // 64) * 8) + {N} * 8)::BIGINT"


@query("cap_check", f"WITH {LI} SELECT batch_id, {N} AS n_rows, {LI_COLUMNAR} AS columnar_bytes, CASE WHEN {LI_COLUMNAR} > 400 THEN 'ResponseTooLarge' END AS error_code FROM li GROUP BY batch_id")
def cap_check(spark: SparkSession, d: str) -> DataFrame:
    return sizes.capped(sizes.columnar_size(lines(spark, d), lines_schema()), "columnar_bytes", 400)


# rows with texts, bytes, flags, lists and small floats

NO = """no AS (SELECT doc_id // 100 AS batch_id, doc_id % 100 AS pos, lang, doc_id, n_chars > 1000 AS long, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS even,
 source, CASE WHEN doc_id % 2 = 0 THEN source || chr(9) || '"x"' END AS note, 0.5 + (n_chars % 4) * 0.25 AS ratio, n_chars FROM documents)"""
NOTE_ROW = """'{"schema_version":1,"lang":"' || lang || '","doc_id":' || doc_id || ',"long":' || long || coalesce(',"even":' || even, '') || ',"source":"' || source || '"'
 || CASE WHEN note IS NOT NULL THEN ',"note":"' || source || '\\t\\"x\\""' ELSE '' END || ',"blob":"' || to_base64(encode(source)) || '","ratio":' || ['0.5','0.75','1','1.25'][(n_chars % 4 + 1)::INTEGER]
 || ',"sizes":[' || CASE WHEN doc_id % 2 = 0 THEN n_chars || ',' || doc_id ELSE '' END || ']'
 || CASE WHEN doc_id % 5 = 0 THEN ',"halves":[' || (n_chars // 2) || CASE WHEN n_chars % 2 = 1 THEN '.5' ELSE '' END || ',0.25]' ELSE '' END
 || CASE WHEN doc_id % 2 = 0 THEN ',"second_lang":"' || lang || '"' ELSE '' END || '}'"""
NOTE_PARTS = """batch_id, pos, lang, doc_id, long::VARCHAR AS long, even::VARCHAR AS even, source, note, lower(hex(encode(source))) AS blob, ratio::DOUBLE AS ratio,
 CASE WHEN doc_id % 2 = 0 THEN n_chars || ',' || doc_id ELSE '' END AS sizes, CASE WHEN doc_id % 5 = 0 THEN n_chars / 2.0 + 0.25 END::DOUBLE AS halves"""


def _note_parts(rows: DataFrame) -> DataFrame:
    """Physical notes as plain values."""
    return rows.select(
        *IDS, codes.symbol(F.col("lang_ordinal"), LANGS, notes_schema().base("lang")).alias("lang"), "doc_id", F.col("long").cast("string").alias("long"), F.col("even").cast("string").alias("even"), "source", "note", F.lower(F.hex("blob")).alias("blob"),
        F.col("ratio").cast("double").alias("ratio"), F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"), (F.get("halves", F.lit(0)) + F.get("halves", F.lit(1))).alias("halves"),
    )


@query("notes_json_row", f"WITH {NO} SELECT batch_id, pos, {NOTE_ROW} AS line FROM no")
def notes_json_row(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select(*IDS, rowtext.json_row(notes_schema()).alias("line"))


@query("notes_ipc_roundtrip", f"WITH {NO} SELECT {NOTE_PARTS} FROM no")
def notes_ipc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _note_parts(columnar.read_ipc(columnar.ipc_batches(notes(spark, d), notes_schema()), notes_schema()))


@query("notes_envelope_roundtrip", f"WITH {NO} SELECT {NOTE_PARTS} FROM no")
def notes_envelope_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = notes_schema()
    return _note_parts(envelope.access(envelope.encode(notes(spark, d), s, trusted=True), s, trusted=True))


@query("notes_errors", f"""WITH {NO} SELECT batch_id, pos, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'NonFiniteNumeric' ELSE 'InvalidEnumOrdinal' END AS error_code,
 CASE WHEN doc_id % 11 = 0 THEN 'ratio' WHEN doc_id % 13 = 0 THEN 'halves' ELSE 'second_lang' END AS error_field FROM no WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0""")
def notes_errors(spark: SparkSession, d: str) -> DataFrame:
    """Small floats, elements of lists, and optional ordinals, of which zero is none, beyond what they may be."""
    at, s = F.col("doc_id"), notes_schema()
    bad = F.array(F.lit(1.0), F.lit(float("inf")))
    rows = notes(spark, d).withColumns({
        "ratio": F.when(at % 11 == 0, F.lit(float("nan")).cast("float")).otherwise(F.col("ratio")),
        "halves": F.when(at % 13 == 0, bad).otherwise(F.col("halves")),
        "second_lang_ordinal": F.when(at % 7 == 0, 99).otherwise(F.col("second_lang_ordinal")),
    })
    fields = [f for f in s.fields if f.column in ("ratio", "halves", "second_lang_ordinal")]
    error = F.coalesce(*[r for r in (validation.field_rule(f, s) for f in fields) if r is not None])
    return presence.stored(rows, s, *IDS).select(*IDS, error.alias("e")).where("e IS NOT NULL").select(*IDS, F.col("e.code").alias("error_code"), F.col("e.field").alias("error_field"))


@query("offset_overflow", f"WITH {NO}, s AS (SELECT batch_id, sum(strlen(source)) AS source, sum(strlen(note)) AS note, sum(strlen(source)) AS blob, 2 * count(*) FILTER (WHERE doc_id % 2 = 0) AS sizes, 2 * count(*) FILTER (WHERE doc_id % 5 = 0) AS halves FROM no GROUP BY batch_id) SELECT batch_id, field FROM (UNPIVOT s ON source, note, blob, sizes, halves INTO NAME field VALUE n) WHERE n > 90")
def offset_overflow(spark: SparkSession, d: str) -> DataFrame:
    """With a limit that some columns pass, where 31 bits would need gigabytes."""
    return sizes.offset_overflow(notes(spark, d), notes_schema(), 90)


# text formats


@query("json_row", f"WITH {EV} SELECT batch_id, pos, {JSON_ROW} AS line FROM ev")
def json_row(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(*IDS, rowtext.json_row(events_schema()).alias("line"))


@query("csv_row", f"WITH {EV} SELECT batch_id, pos, {CSV_ROW} AS line FROM ev")
def csv_row(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(*IDS, rowtext.csv_row(events_schema()).alias("line"))


@query("json_batch", f"""WITH {EV} SELECT batch_id, '{{"schema_version":1,"rows":[' || string_agg({JSON_ROW}, ',' ORDER BY pos) || ']}}' AS data FROM ev GROUP BY batch_id""")
def json_batch(spark: SparkSession, d: str) -> DataFrame:
    return rowtext.json_batches(events(spark, d), events_schema())


@query("csv_batch", f"WITH {EV} SELECT batch_id, '{CSV_HEAD}' || chr(10) || string_agg({CSV_ROW} || chr(10), '' ORDER BY pos) AS data FROM ev GROUP BY batch_id")
def csv_batch(spark: SparkSession, d: str) -> DataFrame:
    return rowtext.csv_batches(events(spark, d), events_schema())


@query(
    "csv_batch_capped",
    f"WITH {EV}, b AS (SELECT batch_id, '{CSV_HEAD}' || chr(10) || string_agg({CSV_ROW} || chr(10), '' ORDER BY pos) AS data FROM ev GROUP BY batch_id) SELECT batch_id, CASE WHEN strlen(data) <= 49000 THEN data END AS data, CASE WHEN strlen(data) > 49000 THEN 'ResponseTooLarge' END AS error_code FROM b",
)
def csv_batch_capped(spark: SparkSession, d: str) -> DataFrame:
    return rowtext.csv_batches(events(spark, d), events_schema(), cap=49_000)


# encoded batches; events are not in key order, so they are read and written by the trusted twins


def encoded(spark: SparkSession, d: str, cap: int | None = None) -> DataFrame:
    return envelope.encode(events(spark, d), events_schema(), cap, trusted=True)


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """Events in key order within their batches: checked writing and reading take them."""
    place = F.row_number().over(_by_key()).cast("long") - 1
    return events(spark, d).withColumn("pos", place)


def _by_key():
    from pyspark.sql.window import Window

    return Window.partitionBy("batch_id").orderBy("device_ordinal", "recorded_at_ms", "pos")


ORDERED = "ordered AS (SELECT * REPLACE (row_number() OVER (PARTITION BY batch_id ORDER BY device_ordinal, recorded_at_ms, pos) - 1 AS pos) FROM ev)"


@query("envelope_size", f"WITH {EV} SELECT batch_id, count(*) AS n_rows, 138 + 46 * count(*) AS n_bytes, CASE WHEN 138 + 46 * count(*) > 20000 THEN 'ResponseTooLarge' END AS error_code FROM ev GROUP BY batch_id")
def envelope_size(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark, d, cap=20_000).select("batch_id", "n_rows", "n_bytes", "error_code")


@query("envelope_roundtrip", f"WITH {EV}, {ORDERED} SELECT {EV_COLUMNS} FROM ordered")
def envelope_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return envelope.access(envelope.encode(ordered(spark, d), events_schema()), events_schema())


@query("envelope_roundtrip_trusted", f"WITH {EV} SELECT {EV_COLUMNS} FROM ev")
def envelope_roundtrip_trusted(spark: SparkSession, d: str) -> DataFrame:
    return envelope.access(encoded(spark, d), events_schema(), trusted=True)


@query("envelope_projection", f"WITH {EV} SELECT batch_id, pos, schema_version, device_ordinal, recorded_at_ms, temperature_c FROM ev")
def envelope_projection(spark: SparkSession, d: str) -> DataFrame:
    """Encoded, read, projected, encoded under the projection's identity, and read again."""
    s = events_schema()
    small = s.projections["temperature_only"]
    kept = projection.project(envelope.access(encoded(spark, d), s, trusted=True), s, "temperature_only", *IDS)
    return envelope.access(envelope.encode(kept, small, trusted=True), small, trusted=True)


@query("envelope_check", f"WITH {EV} SELECT DISTINCT batch_id, CASE WHEN batch_id % 2 = 1 THEN 'PayloadChecksumMismatch' END AS error_code FROM ev")
def envelope_check(spark: SparkSession, d: str) -> DataFrame:
    """Every second batch has a changed byte."""
    data = F.when(F.col("batch_id") % 2 == 1, F.concat(F.substring("data", 1, 140), F.unhex(F.lit("ff")), F.expr("substring(data, 142)"))).otherwise(F.col("data"))
    return envelope.check(encoded(spark, d).withColumn("data", data), events_schema())


@query("envelope_errors", f"WITH {EV}, {BROKEN}, e AS (SELECT batch_id, pos, {_case(True, 1)} AS error_code FROM bad {WINDOW}) SELECT * FROM e WHERE error_code IS NOT NULL")
def envelope_errors(spark: SparkSession, d: str) -> DataFrame:
    s = events_schema()
    return envelope.errors(envelope._encode_stored(broken(spark, d), s, None), s)


@query("ipc_roundtrip", f"WITH {EV} SELECT {EV_COLUMNS} FROM ev")
def ipc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return columnar.read_ipc(columnar.ipc_batches(events(spark, d), events_schema()), events_schema())


# checked conversions, of events in key order


@query("json_checked", f"""WITH {EV}, {ORDERED} SELECT batch_id, '{{"schema_version":1,"rows":[' || string_agg({JSON_ROW}, ',' ORDER BY pos) || ']}}' AS data FROM ordered GROUP BY batch_id""")
def json_checked(spark: SparkSession, d: str) -> DataFrame:
    return Batch(ordered(spark, d), events_schema()).to_json()


@query("csv_checked", f"WITH {EV}, {ORDERED} SELECT batch_id, '{CSV_HEAD}' || chr(10) || string_agg({CSV_ROW} || chr(10), '' ORDER BY pos) AS data FROM ordered GROUP BY batch_id")
def csv_checked(spark: SparkSession, d: str) -> DataFrame:
    return Batch(ordered(spark, d), events_schema()).to_csv()


@query("ipc_checked", f"WITH {EV}, {ORDERED} SELECT {EV_COLUMNS} FROM ordered")
def ipc_checked(spark: SparkSession, d: str) -> DataFrame:
    return columnar.read_ipc(Batch(ordered(spark, d), events_schema()).to_ipc(), events_schema())


@query("arrow_checked", f"WITH {EV}, {ORDERED} SELECT {EV_COLUMNS} FROM ordered")
def arrow_checked(spark: SparkSession, d: str) -> DataFrame:
    return columnar.read_record_batches(Batch(ordered(spark, d), events_schema()).convert("arrow"), events_schema())


@query("arrow_trusted", f"WITH {EV} SELECT {EV_COLUMNS} FROM ev")
def arrow_trusted(spark: SparkSession, d: str) -> DataFrame:
    return columnar.read_record_batches(Batch(events(spark, d), events_schema()).convert("arrow", trusted=True), events_schema())


@query("parquet_checked", f"WITH {EV}, {ORDERED} SELECT {EV_COLUMNS} FROM ordered")
def parquet_checked(spark: SparkSession, d: str) -> DataFrame:
    return columnar.read_parquet_batches(Batch(ordered(spark, d), events_schema()).to_parquet(), events_schema())


@query("parquet_trusted", f"WITH {EV} SELECT {EV_COLUMNS} FROM ev")
def parquet_trusted(spark: SparkSession, d: str) -> DataFrame:
    return columnar.read_parquet_batches(Batch(events(spark, d), events_schema()).to_parquet(trusted=True), events_schema())


@query(
    "convert_bytes",
    f"WITH {EV}, {ORDERED}, b AS (SELECT batch_id, '{CSV_HEAD}' || chr(10) || string_agg({CSV_ROW} || chr(10), '' ORDER BY pos) AS data FROM ordered GROUP BY batch_id) SELECT batch_id, CASE WHEN strlen(data) <= 49000 THEN data END AS data, CASE WHEN strlen(data) > 49000 THEN 'ResponseTooLarge' END AS error_code FROM b",
)
def convert_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Encoded batches, read and converted by the name of the form, under a cap."""
    s = events_schema()
    return convert(envelope.encode(ordered(spark, d), s).select("batch_id", "data"), s, "csv", cap=49_000)


@query("ipc_capped", f"WITH {EV} SELECT batch_id, CASE WHEN {COLUMNAR} > {CAP} THEN 'ResponseTooLarge' END AS error_code FROM ev GROUP BY batch_id HAVING {COLUMNAR} > {CAP}")
def ipc_capped(spark: SparkSession, d: str) -> DataFrame:
    capped = columnar.ipc_batches(events(spark, d), events_schema(), cap=CAP)
    return capped.where("error_code IS NOT NULL").select("batch_id", "error_code")


@query("zstd_roundtrip", f"WITH {EV} SELECT batch_id, 138 + 46 * count(*) AS n_bytes, true AS same FROM ev GROUP BY batch_id")
def zstd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    raw = encoded(spark, d).select("batch_id", "data")
    back = compression.decompressed(compression.compressed(raw)).select("batch_id", F.col("data").alias("back"))
    return raw.join(back, "batch_id").select("batch_id", F.octet_length("back").cast("long").alias("n_bytes"), (F.col("data") == F.col("back")).alias("same"))


# results that SQL does not express: held against golden vectors in tests


@query("fingerprint")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return envelope.inspect(events(spark, d), events_schema(), trusted=True)


@query("envelope_bytes")
def envelope_bytes(spark: SparkSession, d: str) -> DataFrame:
    return envelope.checksum(encoded(spark, d))


@query("protobuf_rows")
def protobuf_rows(spark: SparkSession, d: str) -> DataFrame:
    return wire.protobuf_rows(events(spark, d), events_schema()).select(*IDS, F.hex("data").alias("data"))


@query("protobuf_batch")
def protobuf_batch(spark: SparkSession, d: str) -> DataFrame:
    return envelope.checksum(wire.protobuf_batches(events(spark, d), events_schema()))


@query("ipc_stream")
def ipc_stream(spark: SparkSession, d: str) -> DataFrame:
    return columnar.ipc_batches(events(spark, d), events_schema()).select("batch_id", F.octet_length("data").alias("n_bytes"), "error_code")


@query("parquet_file")
def parquet_file(spark: SparkSession, d: str) -> DataFrame:
    return columnar.parquet_batches(events(spark, d), events_schema()).select("batch_id", F.substring(F.hex("data"), 1, 8).alias("magic"), "error_code")


@query("column_checksums")
def column_checksums(spark: SparkSession, d: str) -> DataFrame:
    sums = evidence.column_checksums(events(spark, d), events_schema())
    return sums.select("batch_id", F.posexplode("checksums").alias("field", "checksum"))


@query("record_batch_checksum")
def record_batch_checksum(spark: SparkSession, d: str) -> DataFrame:
    return evidence.batch_checksums(events(spark, d), events_schema())


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in found.items() if sql}
