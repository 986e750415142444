import pytest

from rowloom.plans.errors import SchemaError
from rowloom.plans.proto import compile_schema
from rowloom.plans.registry import schema

from .notation import declaration

# Identities of the schemas and their projections.
HASHES = {
    "telemetry_v1": (232196938863914698, {"temperature_only": 2197847999187611970}),
    "measurement_v1": (9409304714461393349, {"without_details": 13635597848336370983, "values_only": 2627786485738809661}),
    "test_compatibility_v1": (3345754805576751033, {"no_optional": 17088867874628620082, "numeric_only": 10470826900078389155}),
}
FIELDS = {"telemetry_v1": (7, 4), "measurement_v1": (44, 20, 10), "test_compatibility_v1": (37, 23, 24)}


@pytest.mark.parametrize("module", HASHES)
def test_identities(module):
    s = schema(module)
    assert (s.hash, {n: p.hash for n, p in s.projections.items()}) == HASHES[module]
    assert (len(s.fields), *(len(p.fields) for p in s.projections.values())) == FIELDS[module]


def test_projection_keeps_identity_parts_and_closes_bits():
    s = schema("test_compatibility_v1")
    p = s.projections["numeric_only"]
    assert (p.id, p.version, p.transport) == (s.id, s.version, s.transport + ".numeric_only")
    assert [f.bit for f in p.nullable] == list(range(len(p.nullable)))
    assert set(p.dictionaries) == {"tenant", "entity"}
    assert [f.path for f in p.keys] == ["tenant", "entity", "recorded_at_ms"]


def test_empty_messages_vanish_from_outputs():
    s = schema("measurement_v1")
    assert any(o.members for o in s.outputs)
    assert not any(o.members for o in s.projections["without_details"].outputs)
    assert "recorded_at_utc" in [o.path for o in s.projections["values_only"].flat_outputs]


def test_dictionary_bases_and_minimal_fields():
    s = schema("telemetry_v1")
    assert (s.base("device"), s.base("status"), s.base("tag")) == (0, 1, 1)
    assert [f.path for f in s.minimal] == ["schema_version", "device", "recorded_at_ms", "temperature_c"]
    assert "projection temperature_only" in s.describe()


ROW = """
    schema_version const 1
    device dict device key 1
    at_ms i64 key 2
    at_utc utc at_ms
    level f64 bit 0 group extra
    note text bit 1
"""


def build(row=ROW, projections=(), change=lambda t: t, dictionaries=None):
    text = declaration("t.v1", 7, "t.v1", "RootV1", "RowV1", dictionaries or {"device": "a b"}, {"RowV1": row}, list(projections))
    return compile_schema(change(text), "t_v1")


def test_formatting_and_aliases_do_not_change_identity():
    plain = build()
    assert build(change=lambda t: t.replace("\n", "\n\n// note\n")).hash == plain.hash
    assert build(change=lambda t: t.replace('value: "b"', 'value: "b" alias: { value: "b" alias: "x" }')).hash == plain.hash
    assert build(change=lambda t: t.replace('value: "a" value: "b"', 'value: "b" value: "a"')).hash != plain.hash
    assert build(change=lambda t: t.replace("at_ms = 3", "at_ms = 9")).hash == plain.hash


@pytest.mark.parametrize(
    ("kind", "change"),
    [
        ("invalid_schema", lambda t: t.replace("(o.raw_string) = true, ", "")),
        ("missing_option", lambda t: t.replace(" [(o.presence_bit) = 0, (o.projection_group) = \"extra\"]", "")),
        ("invalid_option", lambda t: t.replace("(o.presence_bit) = 1", "(o.presence_bit) = 0")),
        ("invalid_schema", lambda t: t.replace("(o.presence_bit) = 1", "(o.presence_bit) = 2")),
        ("invalid_option", lambda t: t.replace("(o.key_order) = 2", "(o.key_order) = 1")),
        ("invalid_schema", lambda t: t.replace("(o.key_order) = 2", "(o.key_order) = 3")),
        ("missing_option", lambda t: t.replace(", (o.key_order) = 2", "")),
        ("invalid_option", lambda t: t.replace('(o.dictionary) = "device"', '(o.dictionary) = "missing"')),
        ("invalid_option", lambda t: t.replace("= 1 [(o.const_u16) = 1];\n  string", "= 1 [(o.const_u16) = 70000];\n  string")),
        ("invalid_schema", lambda t: t.replace("int64 at_ms", "uint64 at_ms")),
        ("invalid_schema", lambda t: t.replace("int64 at_ms", "repeated bool at_ms").replace("(o.key_part) = true, (o.key_order) = 2", "(o.projection_group) = \"g\"")),
        ("invalid_schema", lambda t: t.replace("(o.ignored) = true, ", "")),
        ("invalid_option", lambda t: t.replace('(o.derived_utc_from) = "at_ms"', '(o.derived_utc_from) = "no_ms"')),
        ("invalid_option", lambda t: t.replace('(o.derived_utc_from) = "at_ms"', '(o.derived_utc_from) = "level"')),
        ("invalid_option", lambda t: t.replace("string at_utc", "int64 at_utc")),
        ("missing_option", lambda t: t.replace("  option (o.transport_name) = \"t.v1\";\n", "")),
        ("invalid_option", lambda t: t.replace("(o.schema_version) = 1", "(o.schema_version) = 65536")),
        ("invalid_schema", lambda t: t.replace("(o.repeated_payload) = true", "(o.repeated_payload) = false")),
        ("invalid_option", lambda t: t.replace('value: "b"', 'value: "a"')),
        ("invalid_option", lambda t: t.replace('value: "b"', 'value: ""')),
        ("syntax", lambda t: t[:-4]),
    ],
)
def test_declarations_that_are_rejected(kind, change):
    with pytest.raises(SchemaError) as e:
        build(change=change)
    assert e.value.kind == kind


def test_nullable_and_wide_bitmasks_are_rejected():
    with pytest.raises(SchemaError):
        build(ROW + "\n tags mask device bit 2")
    with pytest.raises(SchemaError):
        build(ROW + "\n tags mask many", dictionaries={"device": "a b", "many": " ".join(f"v{i}" for i in range(65))})
    assert build(ROW + "\n tags mask many", dictionaries={"device": "a b", "many": " ".join(f"v{i}" for i in range(64))})


@pytest.mark.parametrize(
    "p",
    [
        {"name": "Bad", "rust_marker": "TV1A"},
        {"name": "a__b", "rust_marker": "TV1A"},
        {"name": "a", "rust_marker": "lower"},
        {"name": "a", "rust_marker": "TV1A", "include_group": "nothing"},
        {"name": "a", "rust_marker": "TV1A", "include_field": "nothing"},
    ],
)
def test_projections_that_are_rejected(p):
    with pytest.raises(SchemaError):
        build(projections=[p])


def test_projection_selection():
    s = build(projections=[{"name": "a", "rust_marker": "TV1A", "exclude_group": "extra"}, {"name": "b", "rust_marker": "TV1B", "include_field": "note"}, {"name": "c", "rust_marker": "TV1C", "exclude_field": "device note"}])
    assert [f.path for f in s.projections["a"].fields] == ["schema_version", "device", "at_ms", "note"]
    assert [f.path for f in s.projections["b"].fields] == ["schema_version", "device", "at_ms", "note"]
    assert [f.path for f in s.projections["c"].fields] == ["schema_version", "device", "at_ms", "level"]
    assert s.projections["a"].by_column("note").bit == 0
    with pytest.raises(SchemaError):
        build(projections=[{"name": "a", "rust_marker": "TV1A"}, {"name": "a", "rust_marker": "TV1B"}])


def test_dictionaries_of_other_sources():
    text = declaration("t.v1", 7, "t.v1", "RootV1", "RowV1", {}, {"RowV1": ROW}, [])
    with pytest.raises(SchemaError):
        compile_schema(text, "t_v1")
    other = 'option (o.dictionary_values) = { name: "device" value: "a" value: "b" };'
    assert compile_schema(text, "t_v1", dictionary_sources=(other,)).hash == build().hash


def test_schema_files_and_command_line(tmp_path, capsys, spark):
    from rowloom.__main__ import main
    from rowloom.plans import files
    from rowloom.plans.registry import TELEMETRY

    (tmp_path / "telemetry_v1.proto").write_text(TELEMETRY)
    known = schema("telemetry_v1")
    for session in (None, spark):
        assert files.load("telemetry_v1.proto", proto_root=str(tmp_path), spark=session).hash == known.hash
    one = ["--proto-root", str(tmp_path), "--schema", "telemetry_v1.proto"]
    out = str(tmp_path / "model.txt")
    assert main(one) == 0 and capsys.readouterr().out == known.describe()
    assert main([*one, "--check", "--out", out]) == 1
    assert main([*one, "--write", "--out", out]) == 0 and main([*one, "--check", "--out", out]) == 0
    assert main(["--schema", "telemetry_v1", "--check", "--out", out]) == 0
    assert main(["--schema", "measurement_v1", "--check", "--out", out]) == 1
    (tmp_path / "telemetry_v1.proto").write_text(TELEMETRY.replace("payload_root", "payload_rood"))
    assert main(one) == 2 and main(["--schema", str(tmp_path / "none.proto")]) == 2
