"""Declarations of made-up schemas in a short notation, for tests.

A line declares a member: name, type, then marks. Members are numbered from 1 in the order of the lines.
Types: const N, dict NAME, mask NAME, utc SOURCE, i32 u32 i64 f32 f64 bool bytes text, each with [] for
a list, or the name of another message. Marks: key N, bit N (which makes it nullable), group NAME.
"""

from __future__ import annotations

TYPES = {"i32": "int32", "u32": "uint32", "i64": "int64", "f32": "float", "f64": "double", "bool": "bool", "bytes": "bytes", "text": "string"}


def member(line: str, number: int) -> str:
    """One line of the notation as a declaration."""
    name, kind, *rest = line.split()
    options, label = [], ""
    if kind == "const":
        proto, options = "uint32", [f"(o.const_u16) = {rest.pop(0)}"]
    elif kind == "dict":
        proto, options = "string", [f'(o.dictionary) = "{rest.pop(0)}"']
    elif kind == "mask":
        proto, label, options = "string", "repeated ", [f'(o.bitmask_dictionary) = "{rest.pop(0)}"']
    elif kind == "utc":
        proto, options = "string", ["(o.ignored) = true", f'(o.derived_utc_from) = "{rest.pop(0)}"']
    else:
        label, kind = ("repeated ", kind[:-2]) if kind.endswith("[]") else ("", kind)
        proto = TYPES.get(kind, kind)
        if kind == "text":
            options = ["(o.raw_string) = true"]
    marks = dict(zip(rest[::2], rest[1::2], strict=True))
    if "key" in marks:
        options += ["(o.key_part) = true", f"(o.key_order) = {marks['key']}"]
    if "bit" in marks:
        label = label or "optional "
        options.append(f"(o.presence_bit) = {marks['bit']}")
    if "group" in marks:
        options.append(f'(o.projection_group) = "{marks["group"]}"')
    return f"  {label}{proto} {name} = {number}" + (f" [{', '.join(options)}]" if options else "") + ";"


def declaration(package: str, id: int, transport: str, root: str, row: str, dictionaries: dict[str, str], messages: dict[str, str], projections: list[dict], version: int = 1) -> str:
    """A schema in the short notation as declaration text."""
    out = ['syntax = "proto3";', f"package {package};"]
    for name, values in dictionaries.items():
        out.append(f'option (o.dictionary_values) = {{ name: "{name}" ' + " ".join(f'value: "{v}"' for v in values.split()) + " };")
    out += [f"message {root} {{", f"  option (o.schema_id) = {id};", f"  option (o.schema_version) = {version};", f'  option (o.transport_name) = "{transport}";', "  option (o.payload_root) = true;"]
    for p in projections:
        fields = [f'{k}: "{v}"' for k, vs in p.items() for v in (vs.split() if k[:7] in ("include", "exclude") else [vs])]
        out.append(f"  option (o.projection) = {{ {' '.join(fields)} }};")
    out += [f"  uint32 schema_version = 1 [(o.const_u16) = {version}];", f"  repeated {row} rows = 2 [(o.repeated_payload) = true];", "}"]
    for name, lines in messages.items():
        members = [x for x in lines.strip().splitlines() if x.strip()]
        out += [f"message {name} {{", *(member(x, i) for i, x in enumerate(members, 1)), "}"]
    return "\n".join(out) + "\n"
