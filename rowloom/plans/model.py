"""Schemas of row batches: fields, closed dictionaries, keys, presence bits and named projections.

A schema is built once on the driver; everything that runs on rows is an expression made from it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import types as T

from .errors import SchemaError

FNV_BASIS, FNV_PRIME, U64 = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a64(data: bytes, state: int = FNV_BASIS) -> int:
    for b in data:
        state = ((state ^ b) * FNV_PRIME) & U64
    return state


def text_hash(data: bytes) -> int:
    """FNV-1a of a declaration's bytes with every line end as a line feed."""
    return fnv1a64(data.replace(b"\r\n", b"\n").replace(b"\r", b"\n"))


@dataclass(frozen=True)
class Storage:
    """How values of a kind are kept: Spark type, struct code of one value, Arrow type name."""

    spark: T.DataType
    code: str
    arrow: str
    floating: bool = False


LONG, INT = T.LongType(), T.IntegerType()
#: u16 fits an int and u32 a long; a u64 mask is a long with the same bits.
SCALARS = {
    "ConstU16": Storage(INT, "H", "uint16"),
    "U16Dictionary": Storage(INT, "H", "uint16"),
    "U64BitmaskDictionary": Storage(LONG, "Q", "uint64"),
    "I32": Storage(INT, "i", "int32"),
    "U32": Storage(LONG, "I", "uint32"),
    "I64": Storage(LONG, "q", "int64"),
    "F32": Storage(T.FloatType(), "f", "float32", True),
    "F64": Storage(T.DoubleType(), "d", "float64", True),
    "Bool": Storage(T.BooleanType(), "?", "bool"),
    "Bytes": Storage(T.BinaryType(), "", "binary"),
    "RawString": Storage(T.StringType(), "", "string"),
}
ELEMENTS = {f"{k}Array": k for k in ("I64", "I32", "U32", "F64", "F32")}
KINDS = frozenset(SCALARS) | frozenset(ELEMENTS)


@dataclass(frozen=True)
class Field:
    """A stored field. path is its dotted place in a row, full its declared name, number its wire number."""

    path: str
    full: str
    number: int
    kind: str
    dictionary: str | None = None
    const: int | None = None
    bit: int | None = None
    key: int | None = None
    group: str | None = None

    @property
    def leaf(self) -> str:
        return self.path.rpartition(".")[2]

    @property
    def column(self) -> str:
        return self.leaf + {"U16Dictionary": "_ordinal", "U64BitmaskDictionary": "_mask"}.get(self.kind, "")

    @property
    def element(self) -> str | None:
        return ELEMENTS.get(self.kind)

    @property
    def storage(self) -> Storage:
        return SCALARS[self.element or self.kind]

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(self.storage.spark) if self.element else self.storage.spark

    @property
    def fixed(self) -> bool:
        return not self.element and self.kind not in ("Bytes", "RawString")

    @property
    def mandatory(self) -> bool:
        return self.kind == "ConstU16" or self.key is not None

    @property
    def label(self) -> str:
        """The kind as identity texts spell it."""
        if self.kind == "ConstU16":
            return f"ConstU16({self.const})"
        if self.kind == "U16Dictionary":
            return f"U16Dictionary({self.dictionary},optional={'true' if self.bit is not None else 'false'})"
        if self.kind == "U64BitmaskDictionary":
            return f"U64BitmaskDictionary({self.dictionary})"
        return self.kind


@dataclass(frozen=True)
class Output:
    """A column of row formats: a stored field, or the UTC text of one, or a message of further outputs."""

    path: str
    number: int
    field: Field | None = None
    utc_of: Field | None = None
    members: tuple[Output, ...] = ()

    @property
    def source(self) -> Field | None:
        return self.field or self.utc_of


@dataclass(frozen=True)
class Projection:
    name: str
    marker: str
    include_groups: tuple[str, ...] = ()
    exclude_groups: tuple[str, ...] = ()
    include_fields: tuple[str, ...] = ()
    exclude_fields: tuple[str, ...] = ()


def _none(value: object) -> str:
    return "none" if value is None else str(value)


@dataclass(frozen=True)
class Schema:
    module: str
    id: int
    version: int
    version_value: int
    transport: str
    row_type: str
    row_number: int
    fields: tuple[Field, ...]
    outputs: tuple[Output, ...]
    dictionaries: dict[str, tuple[str, ...]]
    declared: tuple[Projection, ...] = ()
    projected_from: Schema | None = field(default=None, repr=False)
    projection: Projection | None = None

    def __hash__(self) -> int:
        return hash((self.transport, self.hash))

    # identity

    @property
    def marker(self) -> str:
        return self.projection.marker if self.projection else "".join(p[:1].upper() + p[1:] for p in self.module.split("_"))

    @cached_property
    def identity_text(self) -> str:
        if not self.projected_from:
            lines = [f"schema:{self.id}:{self.version}:{self.version_value}:{self.transport}:true:{self.row_type}"]
            lines += [":".join((f"dictionary:{name}", *values)) for name, values in self.dictionaries.items()]
            lines += [f"field:{f.full}:{f.column}:{f.label}:{_none(f.bit)}:{_none(f.key)}" for f in self.fields]
            return "\n".join(lines) + "\n"
        source, p = self.projected_from, self.projection
        heads = {
            "source_schema_hash": source.hash,
            "source_schema_id": source.id,
            "source_schema_version": source.version,
            "source_schema_version_value": source.version_value,
            "source_transport_name": source.transport,
            "projection_name": p.name,
            "projection_rust_marker": p.marker,
            "projected_transport_name": self.transport,
            "projected_row_type": self.row_type,
        }
        lines = ["projection_schema:", *(f"{k}:{v}" for k, v in heads.items())]
        for name, values in self.dictionaries.items():
            lines += [f"projection_dictionary:{name}", *(f"dictionary_value:{v}" for v in values)]
        for f in self.fields:
            place = ("none", "none", "none") if f.bit is None else (f.bit, f.bit // 64, 1 << f.bit % 64)
            lines.append(":".join(map(str, ("projection_field", f.full, f.path, f.leaf, f.column, f.label, _none(f.dictionary), *place, _none(f.key)))))
        return "\n".join(lines) + "\n"

    @cached_property
    def hash(self) -> int:
        return fnv1a64(self.identity_text.encode())

    # what fields there are

    @cached_property
    def nullable(self) -> tuple[Field, ...]:
        return tuple(sorted((f for f in self.fields if f.bit is not None), key=lambda f: f.bit))

    @property
    def words(self) -> int:
        """Words of presence bits; more than one only beyond 64 nullable fields."""
        return -(-len(self.nullable) // 64)

    @cached_property
    def keys(self) -> tuple[Field, ...]:
        return tuple(sorted((f for f in self.fields if f.key is not None), key=lambda f: f.key))

    @property
    def fixed(self) -> bool:
        return all(f.fixed for f in self.fields)

    @cached_property
    def key_dictionaries(self) -> frozenset[str]:
        return frozenset(f.dictionary for f in self.keys if f.dictionary)

    def base(self, dictionary: str) -> int:
        """Ordinal of a dictionary's first value: 0 if a key uses it, else 1 (0 is no value)."""
        return 0 if dictionary in self.key_dictionaries else 1

    def by_column(self, name: str) -> Field:
        return next(f for f in self.fields if f.column == name)

    def named(self, name: str) -> Field:
        """A field by path, leaf or column; each name must mean one field."""
        found = [f for f in self.fields if name in (f.path, f.leaf, f.column)]
        if len(found) != 1:
            raise SchemaError("invalid_option", f"{'ambiguous' if found else 'unknown'} projection field {name}")
        return found[0]

    @cached_property
    def flat_outputs(self) -> tuple[Output, ...]:
        def walk(outputs: tuple[Output, ...]):
            for o in outputs:
                yield from walk(o.members) if o.members else (o,)

        return tuple(walk(self.outputs))

    # projections

    @cached_property
    def projections(self) -> dict[str, Schema]:
        if self.projected_from:
            return {}
        return {p.name: self._project(p) for p in self.declared}

    def _selected(self, p: Projection) -> list[Field]:
        groups = {f.group for f in self.fields}
        for g in (*p.include_groups, *p.exclude_groups):
            if g not in groups:
                raise SchemaError("invalid_option", f"unknown projection group {g}")
        included = {self.named(n) for n in p.include_fields}
        excluded = {self.named(n) for n in p.exclude_fields}

        def keep(f: Field) -> bool:
            if f.mandatory:
                return True
            if f.group in p.exclude_groups or f in excluded:
                return False
            return not (p.include_groups or p.include_fields) or f.group in p.include_groups or f in included

        return [f for f in self.fields if keep(f)]

    def _project(self, p: Projection) -> Schema:
        kept = self._selected(p)
        bits = iter(range(len(kept)))
        fields = {f.path: replace(f, bit=next(bits)) if f.bit is not None else f for f in kept}
        if not any(f.kind == "ConstU16" for f in kept):
            raise SchemaError("invalid_schema", "a projection without a version field")
        if self.keys and not any(f.key is not None for f in kept):
            raise SchemaError("invalid_schema", "a projection without a key field")
        check_fields(list(fields.values()))

        def cut(outputs: tuple[Output, ...]):
            for o in outputs:
                if o.members:
                    if members := tuple(cut(o.members)):
                        yield replace(o, members=members)
                elif o.source.path in fields:
                    yield replace(o, field=o.field and fields[o.field.path], utc_of=o.utc_of and fields[o.utc_of.path])

        suffix = p.marker.removeprefix(self.marker) or p.marker
        used = {f.dictionary for f in kept}
        return replace(
            self,
            transport=f"{self.transport}.{p.name}",
            row_type=self.row_type + suffix,
            fields=tuple(fields.values()),
            outputs=tuple(cut(self.outputs)),
            dictionaries={k: v for k, v in self.dictionaries.items() if k in used},
            declared=(),
            projected_from=self,
            projection=p,
        )

    @cached_property
    def minimal(self) -> tuple[Field, ...]:
        """Fields of the projection with the fewest, the first of those; all fields without projections."""
        if not self.projections:
            return self.fields
        least = min(self.projections.values(), key=lambda s: len(s.fields))
        own = {f.path: f for f in self.fields}
        return tuple(own[f.path] for f in least.fields)

    # Spark types

    @property
    def physical(self) -> T.StructType:
        """Columns by which rows are kept: ordinals and masks, null where a field is absent."""
        return T.StructType([T.StructField(f.column, f.spark_type, f.bit is not None) for f in self.fields])

    @property
    def stored(self) -> T.StructType:
        """Columns as they are written: no nulls, zeros where absent, then presence bits."""
        out = T.StructType([T.StructField(f.column, f.spark_type, False) for f in self.fields])
        if self.words:
            out.add("presence_bits", T.ArrayType(LONG, False) if self.words > 1 else LONG, False)
        return out

    def describe(self) -> str:
        """The model as text, a fact a line."""
        lines = [f"schema {self.transport} id={self.id} version={self.version} hash={self.hash} fields={len(self.fields)}"]
        lines += [f"dictionary {n} base={self.base(n)} values={','.join(v)}" for n, v in self.dictionaries.items()]
        lines += [f"field {f.path} column={f.column} kind={f.label} presence={_none(f.bit)} key={_none(f.key)} group={_none(f.group)}" for f in self.fields]
        lines += [f"utc {o.path} from={o.utc_of.path}" for o in self.flat_outputs if o.utc_of]
        for s in self.projections.values():
            lines.append(f"projection {s.projection.name} marker={s.marker} hash={s.hash} fields={','.join(f.path for f in s.fields)}")
        return "\n".join(lines) + "\n"


def check_fields(fields: list[Field]) -> None:
    """Unique columns, presence bits dense from 0, key orders dense from 1."""
    if not fields:
        raise SchemaError("invalid_schema", "no physical fields")
    columns = [f.column for f in fields]
    if twice := {c for c in columns if columns.count(c) > 1}:
        raise SchemaError("invalid_schema", f"duplicate field {min(twice)}")
    for what, values, first in (("presence bit", [f.bit for f in fields if f.bit is not None], 0), ("key order", [f.key for f in fields if f.key is not None], 1)):
        if len(set(values)) < len(values):
            raise SchemaError("invalid_option", f"duplicate {what}")
        if sorted(values) != list(range(first, first + len(values))):
            raise SchemaError("invalid_schema", f"{what} gap")


def check_projections(declared: list[Projection]) -> None:
    for p in declared:
        if not re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", p.name):
            raise SchemaError("invalid_option", f"projection name {p.name!r}")
        if not re.fullmatch(r"[A-Z][A-Za-z0-9]*", p.marker):
            raise SchemaError("invalid_option", f"projection marker {p.marker!r}")
    part: Callable[[Projection], str]
    for part in (lambda p: p.name, lambda p: p.marker):
        if len({part(p) for p in declared}) < len(declared):
            raise SchemaError("invalid_option", "duplicate projection")


def check_dictionaries(dictionaries: list[tuple[str, list[str]]]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for name, values in dictionaries:
        if not name or "" in values:
            raise SchemaError("invalid_option", "an empty dictionary name or value")
        if name in out:
            raise SchemaError("invalid_option", f"duplicate dictionary {name}")
        if len(set(values)) < len(values):
            raise SchemaError("invalid_option", f"duplicate value in dictionary {name}")
        out[name] = tuple(values)
    return out
