"""Schemas from annotated message declarations: the subset of the .proto language that schemas use.

Options are known by the last part of their name, so the package that declares them does not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import SchemaError
from .model import Field, Output, Projection, Schema, check_dictionaries, check_fields, check_projections

TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<string>"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|(?P<word>[A-Za-z_.][\w.]*|-?\d[\w.]*)|(?P<sign>[{}\[\]()=;:,<>])', re.S)
NUMBERS = {"int32": "I32", "uint32": "U32", "int64": "I64", "float": "F32", "double": "F64", "bool": "Bool", "bytes": "Bytes"}
SCALAR_TYPES = frozenset([*NUMBERS, "string", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64"])


@dataclass
class Member:
    label: str
    type: str
    name: str
    number: int
    options: dict[str, object]
    full: str


@dataclass
class Message:
    name: str
    full: str
    members: list[Member] = field(default_factory=list)
    options: dict[str, list] = field(default_factory=dict)


class Reader:
    """One declaration file."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SchemaError("syntax", f"at {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.at, self.package = 0, ""
        self.messages: dict[str, Message] = {}
        self.enums: set[str] = set()
        self.options: dict[str, list] = {}
        while self.at < len(self.tokens):
            self._statement()

    def _next(self, *wanted: str) -> str:
        if self.at >= len(self.tokens):
            raise SchemaError("syntax", "the declaration ends too early")
        self.at += 1
        found = self.tokens[self.at - 1][1]
        if wanted and found not in wanted:
            raise SchemaError("syntax", f"{found!r} in the place of {' or '.join(wanted)}")
        return found

    def _peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def _skip_block(self) -> None:
        depth = 1
        self._next("{")
        while depth:
            depth += {"{": 1, "}": -1}.get(self._next(), 0)

    def _option_name(self) -> str:
        name = self._next()
        if name == "(":
            name = self._next()
            self._next(")")
        return name.rpartition(".")[2]

    def _value(self) -> object:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if text == "{":
            self._next("{")
            out: dict[str, list] = {}
            while self._peek() != "}":
                name = self._next()
                if self._peek() == ":":
                    self._next(":")
                out.setdefault(name, []).append(self._value())
                if self._peek() in (",", ";"):
                    self._next()
            self._next("}")
            return out
        self._next()
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if text in ("true", "false"):
            return text == "true"
        return int(text) if re.fullmatch(r"-?\d+", text) else text

    def _option(self, into: dict[str, list]) -> None:
        name = self._option_name()
        self._next("=")
        into.setdefault(name, []).append(self._value())
        self._next(";")

    def _statement(self) -> None:
        word = self._next()
        if word == "syntax":
            self._next("=")
            self._next()
            self._next(";")
        elif word == "package":
            self.package = self._next()
            self._next(";")
        elif word == "import":
            while self._next() != ";":
                pass
        elif word == "option":
            self._option(self.options)
        elif word == "message":
            self._message(self.package)
        elif word == "enum":
            self.enums.add(self._next())
            self._skip_block()
        elif word != ";":
            raise SchemaError("syntax", f"unexpected {word!r}")

    def _message(self, scope: str) -> None:
        name = self._next()
        m = Message(name, f"{scope}.{name}" if scope else name)
        self.messages[m.full] = m
        self._next("{")
        while (word := self._next()) != "}":
            if word == "option":
                self._option(m.options)
            elif word == "message":
                self._message(m.full)
            elif word == "enum":
                self.enums.add(self._next())
                self._skip_block()
            elif word in ("reserved", "extensions"):
                while self._next() != ";":
                    pass
            elif word == "oneof":
                raise SchemaError("invalid_schema", f"{m.full}: oneof is not supported")
            elif word != ";":
                self._member(m, word)

    def _member(self, m: Message, word: str) -> None:
        label = ""
        if word in ("optional", "repeated", "required"):
            label, word = word, self._next()
        if word == "map":
            raise SchemaError("invalid_schema", f"{m.full}: map is not supported")
        name = self._next()
        self._next("=")
        number, options = int(self._next()), {}
        if self._peek() == "[":
            self._next("[")
            while True:
                option = self._option_name()
                self._next("=")
                options[option] = self._value()
                if self._next(",", "]") == "]":
                    break
        self._next(";")
        if any(x.number == number or x.name == name for x in m.members):
            raise SchemaError("invalid_schema", f"{m.full}: {name} = {number} is taken")
        m.members.append(Member(label, word, name, number, options, f"{m.full}.{name}"))

    def message(self, name: str, scope: str) -> Message | None:
        while True:
            found = self.messages.get(f"{scope}.{name}" if scope else name)
            if found or not scope:
                return found
            scope = scope.rpartition(".")[0]


def _text(m: Member, option: str) -> str | None:
    value = m.options.get(option)
    if value is not None and (not isinstance(value, str) or not value):
        raise SchemaError("invalid_option", f"{m.full}: {option}")
    return value


def _number(m: Member, option: str) -> int | None:
    value = m.options.get(option)
    if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < 0):
        raise SchemaError("invalid_option", f"{m.full}: {option}")
    return value


def _stored(m: Member, path: str, group: str | None, dictionaries: dict[str, tuple[str, ...]]) -> Field:
    words, mask, raw = _text(m, "dictionary"), _text(m, "bitmask_dictionary"), bool(m.options.get("raw_string"))
    bit, key, const = _number(m, "presence_bit"), _number(m, "key_order"), _number(m, "const_u16")
    many = m.label == "repeated"
    if raw and (words or mask or m.options.get("key_part") or key is not None or const is not None or many):
        raise SchemaError("invalid_schema", f"{m.full} mixes raw_string with another annotation")
    if m.label == "optional" and bit is None:
        raise SchemaError("missing_option", "presence_bit")
    if mask and bit is not None:
        raise SchemaError("invalid_schema", f"{m.full}: a bitmask cannot be nullable")
    if m.options.get("key_part") and key is None:
        raise SchemaError("missing_option", "key_order")
    for name in (words, mask):
        if name and m.type == "string" and name not in dictionaries:
            raise SchemaError("invalid_option", f"missing dictionary {name}")
    if m.type == "uint32" and const is not None:
        if const > 0xFFFF:
            raise SchemaError("invalid_option", f"{m.full}: const_u16 exceeds 16 bits")
        kind = "ConstU16"
    elif m.type == "string" and mask:
        if not many:
            raise SchemaError("invalid_schema", f"{m.full}: a bitmask takes a repeated string")
        if len(dictionaries[mask]) > 64:
            raise SchemaError("invalid_option", f"dictionary {mask} has more than 64 values")
        kind = "U64BitmaskDictionary"
    elif m.type == "string" and words:
        kind = "U16Dictionary"
    elif m.type == "string" and raw:
        kind = "RawString"
    elif m.type == "string":
        raise SchemaError("invalid_schema", f"{m.full} is an unannotated string")
    elif m.type in NUMBERS and not (many and m.type in ("bool", "bytes")):
        kind = NUMBERS[m.type] + ("Array" if many else "")
    else:
        raise SchemaError("invalid_schema", f"{m.full} has the unsupported type {m.label} {m.type}".replace("  ", " "))
    return Field(path, m.full, m.number, kind, words if kind == "U16Dictionary" else mask if kind == "U64BitmaskDictionary" else None, const if kind == "ConstU16" else None, bit, key, group)


def compile_schema(text: str, module: str, root: str | None = None, dictionary_sources: tuple[str, ...] = ()) -> Schema:
    """The schema whose payload root is the message `root` (or the only one that is marked as a root)."""
    reader = Reader(text)
    found = [(d.get("name", [""])[0], d.get("value", [])) for r in (*(Reader(t) for t in dictionary_sources), reader) for d in r.options.get("dictionary_values", [])]
    dictionaries = check_dictionaries(found)
    roots = [m for m in reader.messages.values() if (m.name == root if root else m.options.get("payload_root") == [True])]
    if len(roots) != 1:
        raise SchemaError("invalid_schema", f"{len(roots)} payload roots")
    top = roots[0]
    option: dict[str, object] = {}
    for name in ("schema_id", "schema_version", "transport_name", "payload_root"):
        if name not in top.options:
            raise SchemaError("missing_option", name)
        option[name] = top.options[name][-1]
    if not isinstance(option["schema_version"], int) or option["schema_version"] > 0xFFFF:
        raise SchemaError("invalid_option", "schema_version")
    payloads = [m for m in top.members if m.options.get("repeated_payload")]
    if len(payloads) != 1:
        raise SchemaError("invalid_schema", f"{len(payloads)} repeated_payload fields")
    payload = payloads[0]
    row = reader.message(payload.type, top.full)
    if payload.label != "repeated" or row is None:
        raise SchemaError("invalid_schema", f"{payload.full} must be a repeated message")
    versions = [m for m in top.members if "const_u16" in m.options]

    fields: list[Field] = []
    derived: list[tuple[Member, str]] = []

    def walk(m: Message, prefix: str, inherited: str | None, above: tuple[str, ...]) -> list[tuple]:
        if m.full in above:
            raise SchemaError("invalid_schema", f"{m.full} holds itself")
        nodes: list[tuple] = []
        for x in m.members:
            if x.options.get("repeated_payload"):
                raise SchemaError("invalid_schema", f"{x.full}: repeated_payload belongs on the root")
            source, path = _text(x, "derived_utc_from"), f"{prefix}.{x.name}" if prefix else x.name
            if source and not x.options.get("ignored"):
                raise SchemaError("invalid_schema", f"{x.full}: derived_utc_from needs ignored")
            if x.options.get("ignored"):
                if source:
                    if x.type != "string" or x.label == "repeated":
                        raise SchemaError("invalid_option", f"{x.full}: derived text is one string")
                    nodes.append((path, x.number, None, source if "." in source else f"{prefix}.{source}" if prefix else source, None, x))
                    derived.append((x, path))
                continue
            group = _text(x, "projection_group") or inherited
            child = None if x.type in SCALAR_TYPES else reader.message(x.type, m.full)
            if child and x.label != "repeated":
                if members := walk(child, path, group, (*above, m.full)):
                    nodes.append((path, x.number, None, None, members, x))
                continue
            f = _stored(x, path, group, dictionaries)
            fields.append(f)
            nodes.append((path, x.number, f, None, None, x))
        return nodes

    tree = walk(row, "", None, ())
    check_fields(fields)
    if not any(f.kind == "ConstU16" for f in fields):
        raise SchemaError("invalid_schema", "no const_u16 version field")
    by_path = {f.path: f for f in fields}

    def outputs(nodes: list[tuple]) -> tuple[Output, ...]:
        out = []
        for path, number, stored, source, members, x in nodes:
            if source:
                f = by_path.get(source)
                if f is None or f.kind != "I64":
                    raise SchemaError("invalid_option", f"{x.full}: {source} is no int64 field")
                out.append(Output(path, number, utc_of=f))
            else:
                out.append(Output(path, number, field=stored, members=outputs(members) if members else ()))
        return tuple(out)

    declared = []
    for p in top.options.get("projection", []):
        for need in ("name", "rust_marker"):
            if not p.get(need, [""])[0]:
                raise SchemaError("missing_option" if need not in p else "invalid_option", need)
        lists = [tuple(p.get(k, ())) for k in ("include_group", "exclude_group", "include_field", "exclude_field")]
        if any(not isinstance(v, str) or not v for vs in lists for v in vs):
            raise SchemaError("invalid_option", f"projection {p['name'][0]}")
        declared.append(Projection(p["name"][0], p["rust_marker"][0], *lists))
    check_projections(declared)
    schema = Schema(
        module, option["schema_id"], option["schema_version"], versions[0].options["const_u16"] if versions else option["schema_version"], option["transport_name"],
        row.name, payload.number, tuple(fields), outputs(tree), dictionaries, tuple(declared),
    )
    _ = schema.projections  # a wrong projection fails here
    return schema
