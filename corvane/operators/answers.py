"""Schemas for what a quarantined model answers, and their check on VARIANT columns.

A schema is a JSON Schema document or a dict of names to Python types. It is read once,
on the driver, into a tree of nodes; the check of an answer, the typed row and the schema
that a model is handed are expressions or documents made from that tree, so rows never
leave the JVM. A document that the tree cannot express is refused while it is read.

Values are taken as a lenient reader takes them: an integer may be written with a zero
fraction or as a string, a boolean as 0, 1 or a usual word; a string must be one. Integers
beyond 64 bits, integral numbers with a fraction from 2**53 on and repeated keys are faults.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
PYTHON = {str: "string", int: "integer", float: "number", bool: "boolean"}
#: Keywords that say nothing about a value.
IGNORED = {"$schema", "$defs", "title", "examples", "default", "description"}
LIMITS = {
    "string": {"minLength", "maxLength", "pattern"},
    "integer": {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"},
    "number": {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"},
    "array": {"minItems", "maxItems"},
}
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")
EXACT = float(1 << 53)


class SchemaError(TypeError):
    """A schema that answers cannot be held against."""


@dataclass(frozen=True)
class Node:
    """What one value must be."""

    kind: str
    nullable: bool = False
    members: tuple = ()
    fields: dict[str, Node] = field(default_factory=dict)
    required: frozenset[str] = frozenset()
    closed: bool = False
    item: Node | None = None
    limits: dict = field(default_factory=dict)
    description: str | None = None
    default: object = None


def read(schema: Mapping) -> Node:
    """The tree of a JSON Schema document or of a dict of names to Python types."""
    if isinstance(schema.get("type"), str) or "$ref" in schema:
        node = _read(schema, schema.get("$defs", {}), ())
    else:
        node = _of_python(dict(schema))
    if node.kind != "object" or node.nullable:
        raise SchemaError("an answer must be an object")
    return node


def _of_python(kind) -> Node:
    if isinstance(kind, type) and kind in PYTHON:
        return Node(PYTHON[kind])
    if isinstance(kind, list) and len(kind) == 1:
        return Node("array", item=_of_python(kind[0]))
    if isinstance(kind, dict) and kind:
        return Node("object", fields={n: _of_python(k) for n, k in kind.items()}, required=frozenset(kind))
    raise SchemaError(f"a quarantine schema cannot carry {kind!r}")


def _read(part: object, defs: Mapping, within: tuple[str, ...]) -> Node:
    if not isinstance(part, Mapping):
        raise SchemaError(f"no schema: {part!r}")
    if (ref := part.get("$ref")) is not None:
        name = str(ref).removeprefix("#/$defs/")
        if name == ref or name not in defs:
            raise SchemaError(f"{ref!r} names no local definition")
        if name in within:
            raise SchemaError(f"{ref!r} is recursive: a row has no type for it")
        rest = {k: v for k, v in part.items() if k != "$ref"}
        return _read({**defs[name], **rest}, defs, (*within, name))
    for union in ("anyOf", "oneOf", "allOf"):
        if union in part:
            return _one_branch(union, part, defs, within)
    return _plain(part, defs, within)


def _one_branch(union: str, part: Mapping, defs: Mapping, within: tuple[str, ...]) -> Node:
    """The one branch besides null; more are a sum type, which a typed row cannot hold."""
    some = [b for b in part[union] if not (isinstance(b, Mapping) and b.get("type") == "null")]
    if len(some) != 1:
        raise SchemaError(f"a multi-branch {union}: only one type, or one type and null, can be expressed")
    if extra := set(part) - {union} - IGNORED:
        raise SchemaError(f"{', '.join(sorted(extra))} beside {union}")
    node = _read(some[0], defs, within)
    own = part.get("description")
    return replace(node, nullable=node.nullable or len(some) < len(part[union]), default=part.get("default", node.default), description=own if node.description is None else node.description)


def _plain(part: Mapping, defs: Mapping, within: tuple[str, ...]) -> Node:
    members = tuple(part["enum"]) if "enum" in part else (part["const"],) if "const" in part else ()
    kinds = {PYTHON.get(type(m)) for m in members}
    kind = part.get("type") or (kinds.pop() if len(kinds) == 1 else None)
    if "prefixItems" in part:
        raise SchemaError("a fixed-length tuple (prefixItems): name its fields instead")
    if isinstance(part.get("additionalProperties"), Mapping) or "patternProperties" in part:
        raise SchemaError("an open map: declare its fields instead")
    if kind not in SCALARS and kind not in ("object", "array"):
        raise SchemaError(f"no type for {dict(part)!r}")
    if members and kinds - {kind}:
        raise SchemaError("members of an enum must be scalars of its type")
    known = {"object": {"properties", "required", "additionalProperties"}, "array": {"items"}}.get(kind, {"enum", "const"})
    if odd := set(part) - known - IGNORED - LIMITS.get(kind, set()) - {"type"}:
        raise SchemaError(f"a {kind} cannot be held against {', '.join(sorted(odd))}")
    base = Node(kind, members=members, description=part.get("description"), default=part.get("default"), limits={k: part[k] for k in LIMITS.get(kind, ()) if k in part})
    if kind == "object":
        fields = {str(n): _read(p, defs, within) for n, p in (part.get("properties") or {}).items()}
        if not fields:
            raise SchemaError("an object must declare properties")
        return replace(base, fields=fields, required=frozenset(part.get("required", ())), closed=part.get("additionalProperties") is False)
    if kind == "array":
        if "items" not in part:
            raise SchemaError("an array must declare items")
        return replace(base, item=_read(part["items"], defs, within))
    return base


def document(node: Node) -> dict:
    """The schema to hand to a model: no references, titles, defaults or unions."""
    out: dict = {"type": node.kind}
    if node.description is not None:
        out["description"] = node.description
    if node.nullable:
        out["nullable"] = True
    if node.members:
        out["enum"] = list(node.members)
    if node.kind == "object":
        out["properties"] = {n: document(f) for n, f in node.fields.items()}
        if required := [n for n in node.fields if n in node.required]:
            out["required"] = required
    if node.kind == "array":
        out["items"] = document(node.item)
    return out


def row_type(node: Node) -> T.DataType:
    if node.kind == "object":
        return T.StructType([T.StructField(n, row_type(f), f.nullable or n not in node.required) for n, f in node.fields.items()])
    if node.kind == "array":
        return T.ArrayType(row_type(node.item), node.item.nullable)
    return SCALARS[node.kind]


def _step(name: str) -> str:
    if "'" in name and '"' in name:
        raise SchemaError(f"a field's name holds both kinds of quotes: {name!r}")
    return f'$["{name}"]' if "'" in name else f"$['{name}']"


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _child(v: Column, name: str) -> Column:
    return F.try_variant_get(v, _step(name), "variant")


def _items(v: Column) -> Column:
    return _get(v, "array<variant>")


def _scalar(v: Column, kind: str) -> Column:
    """The value as ``kind``, null where it is none."""
    shape, text = F.schema_of_variant(v), _get(v, "string")
    if kind == "string":
        return F.when(shape == "STRING", text)
    real = _get(v, "double")
    broken = shape.startswith("DECIMAL") | (shape == "DOUBLE")
    worded = F.lower(F.trim(text))
    if kind == "integer":
        short = F.regexp_extract(F.trim(text), r"^([+-]?[0-9]+)(?:\.0+)?$", 1)
        return (
            F.when(shape == "BIGINT", _get(v, "bigint"))
            .when(shape == "BOOLEAN", _get(v, "boolean").cast("long"))
            .when(broken & (real == F.floor(real)) & (F.abs(real) < EXACT), real.cast("long"))
            .when(shape == "STRING", short.try_cast("long"))
        )
    if kind == "number":
        number = F.when(F.trim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(text).try_cast("double"))
        return F.when((shape == "BIGINT") | broken, real).when(shape == "BOOLEAN", _get(v, "boolean").cast("double")).when(shape == "STRING", number)
    as_word = F.when(worded.isin(*TRUE), F.lit(True)).when(worded.isin(*FALSE), F.lit(False))
    return F.when(shape == "BOOLEAN", _get(v, "boolean")).when(((shape == "BIGINT") | broken) & real.isin(0.0, 1.0), real == 1.0).when(shape == "STRING", as_word)


def _beyond(got: Column, node: Node) -> Column:
    """Whether a value of the right kind breaks a limit."""
    size = F.size(got) if node.kind == "array" else F.length(got) if node.kind == "string" else got
    broken = F.lit(False)
    for key, limit in node.limits.items():
        bad = {
            "minLength": lambda: size < limit, "maxLength": lambda: size > limit, "pattern": lambda: ~got.rlike(limit),
            "minimum": lambda: size < limit, "maximum": lambda: size > limit,
            "exclusiveMinimum": lambda: size <= limit, "exclusiveMaximum": lambda: size >= limit,
            "minItems": lambda: size < limit, "maxItems": lambda: size > limit,
        }[key]()
        broken = broken | bad
    return broken


def _none() -> Column:
    return F.array().cast("array<string>")


def _fault(bad: Column, where: Column, what: str) -> Column:
    return F.when(bad, F.array(F.concat_ws(" ", where, F.lit(what)))).otherwise(_none())


def faults(v: Column, node: Node, where: Column | None = None) -> Column:
    """What is wrong with an answer: places and kinds of fault, never a part of the answer itself.

    ``v`` is a variant that is there; places are the schema's own names and positions in
    arrays, and a key that the schema lacks is not named.
    """
    where = F.lit("answer") if where is None else where
    shape = F.schema_of_variant(v)
    if node.kind == "object":
        found = F.concat(*[_field_faults(v, n, f, n in node.required, where) for n, f in node.fields.items()])
        if node.closed:
            extra = F.size(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, node.fields)))) > 0
            found = F.concat(found, _fault(extra, where, "has other fields"))
        checked = F.when(shape.startswith("OBJECT"), found).otherwise(F.array(F.concat_ws(" ", where, F.lit("is no object"))))
    elif node.kind == "array":
        each = F.flatten(F.transform(_items(v), lambda x, i: faults(x, node.item, F.concat_ws(".", where, i.cast("string")))))
        found = F.concat(each, _fault(_beyond(_items(v), node), where, "is out of limits"))
        checked = F.when(shape.startswith("ARRAY"), found).otherwise(F.array(F.concat_ws(" ", where, F.lit("is no array"))))
    else:
        got = _scalar(v, node.kind)
        bad = _fault(got.isNull(), where, f"is no {node.kind}")
        odd = ~got.isin(*node.members) if node.members else F.lit(False)
        checked = F.when(got.isNull(), bad).otherwise(F.concat(_fault(odd, where, "is no member"), _fault(_beyond(got, node), where, "is out of limits")))
    null = _none() if node.nullable else F.array(F.concat_ws(" ", where, F.lit("is null")))
    return F.when(F.is_variant_null(v), null).otherwise(checked)


def _field_faults(v: Column, name: str, node: Node, required: bool, where: Column) -> Column:
    child, place = _child(v, name), F.concat_ws(".", where, F.lit(name))
    missing = F.array(F.concat_ws(" ", place, F.lit("is missing"))) if required else _none()
    return F.when(child.isNull(), missing).otherwise(faults(child, node, place))


def typed(v: Column, node: Node) -> Column:
    """A faultless answer as a value of ``row_type``; a field left out takes its default."""
    if node.kind == "object":
        value = F.struct(*[_typed_field(_child(v, n), f).alias(n) for n, f in node.fields.items()])
    elif node.kind == "array":
        value = F.transform(_items(v), lambda x: typed(x, node.item))
    else:
        value = _scalar(v, node.kind)
    return F.when(~F.is_variant_null(v), value)


def _typed_field(child: Column, node: Node) -> Column:
    value = typed(child, node)
    if node.default is None or node.kind not in SCALARS:
        return F.when(child.isNotNull(), value)
    return F.when(child.isNull(), F.lit(node.default).cast(SCALARS[node.kind])).otherwise(value)
