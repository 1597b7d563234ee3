"""JSON Schema as column expressions: a schema is compiled once, and a document (a VARIANT) gives the array of its faults, each with its path.

Understood: type (one or several), enum, const, pattern, format date-time, minLength, maxLength, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, multipleOf, required, properties, additionalProperties (a boolean or a schema), propertyNames' pattern, minProperties,
maxProperties, items, minItems, maxItems, uniqueItems, allOf, anyOf, oneOf, not, if / then / else, and $ref into the schema itself. Annotations
(title, description, default, examples, $schema, $id, $defs, $comment) say nothing about a document. Any other keyword is an error, and so is a
$ref that leads back into itself, since a column expression has a fixed depth.

A column has no names for what it is made of: a value mentioned twice is computed twice, and what is below a condition or in a lambda is never shared.
So each value of the document, and its kind, is bound by `let` where it is first needed, and is computed once for each document.

A keyword is silent about values of kinds it does not speak of (`pattern` about a number), as in the standard. A fault is (path, rule): the path of
the value, or of the property that is missing or too many, and the keyword.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, functions as F

FAULTS = "array<struct<path:string,rule:string>>"
SILENT = {"title", "description", "default", "examples", "$schema", "$id", "$defs", "definitions", "$comment", "then", "else"}
#: RFC 3339.
DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"
_KINDS = {"string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "object": ["OBJECT"], "array": ["ARRAY"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Node:
    """A value of the document and its kind, both bound, its path, and what is asked about it."""

    def __init__(self, value: Column, kind: Column, path: Column):
        self.value, self.kind, self.path = value, kind, path

    @staticmethod
    def bound(value: Column, path: Column, body: Callable[["Node"], Column]) -> Column:
        """body(node) of a value that is bound already and is there."""
        return let(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), lambda kind: body(Node(value, kind, path)))

    def is_a(self, name: str) -> Column:
        if name == "integer":
            return self.is_a("number") & (self.number == F.floor(self.number))
        return self.kind.isin(_KINDS[name])

    @property
    def text(self) -> Column:
        return F.try_variant_get(self.value, "$", "string")

    @property
    def number(self) -> Column:
        return F.try_variant_get(self.value, "$", "double")

    @property
    def items(self) -> Column:
        return F.when(self.is_a("array"), F.try_variant_get(self.value, "$", "array<variant>"))

    @property
    def entries(self) -> Column:
        return F.when(self.is_a("object"), F.try_variant_get(self.value, "$", "map<string,variant>"))

    def child(self, name: str) -> Column:
        if "'" in name or "\\" in name:
            raise ValueError(f"no path can be written for property {name!r}")
        return F.variant_get(self.value, f"$['{name}']", "variant")

    def below(self, name: str) -> Column:
        return F.concat(self.path, F.lit("." + name))


def none() -> Column:
    return F.array().cast(FAULTS)


def fault(where: Column, path: Column, rule: str) -> Column:
    """One fault if `where` holds; NULL does not."""
    return F.when(F.coalesce(where, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(none())


def together(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none()


def equal(node: Node, want) -> Column:
    """Equality of JSON values; numbers as numbers."""
    if want is None:
        return node.is_a("null")
    if isinstance(want, bool):
        return node.is_a("boolean") & (node.text == ("true" if want else "false"))
    if isinstance(want, (int, float)):
        return node.is_a("number") & (node.number == float(want))
    if isinstance(want, str):
        return node.is_a("string") & (node.text == want)
    # Keys of a VARIANT are in order; so are those of this text.
    return F.to_json(node.value) == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def equal_any(node: Node, wants: list) -> Column:
    """Equality with one of some values; the text is compared with all strings at once."""
    texts = [x for x in wants if isinstance(x, str)]
    return _any([*([node.is_a("string") & node.text.isin(texts)] if texts else []), *(equal(node, x) for x in wants if not isinstance(x, str))])


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c, F.lit(False))
    return out


#: Keywords of one number: what they speak of, and when they are broken.
_BOUNDS: dict[str, tuple[str, Callable[[Node, float], Column]]] = {
    "minLength": ("string", lambda n, x: F.length(n.text) < x),
    "maxLength": ("string", lambda n, x: F.length(n.text) > x),
    "minimum": ("number", lambda n, x: n.number < x),
    "maximum": ("number", lambda n, x: n.number > x),
    "exclusiveMinimum": ("number", lambda n, x: n.number <= x),
    "exclusiveMaximum": ("number", lambda n, x: n.number >= x),
    "multipleOf": ("number", lambda n, x: n.number % F.lit(float(x)) != 0),
    "minItems": ("array", lambda n, x: F.size(n.items) < x),
    "maxItems": ("array", lambda n, x: F.size(n.items) > x),
    "minProperties": ("object", lambda n, x: F.size(n.entries) < x),
    "maxProperties": ("object", lambda n, x: F.size(n.entries) > x),
}


class Compiler:
    def __init__(self, root: dict):
        self.root = root

    def resolve(self, ref: str):
        if not ref.startswith("#"):
            raise ValueError(f"$ref {ref!r} leads out of the schema")
        at = self.root
        for part in ref[1:].split("/")[1:]:
            at = at[part.replace("~1", "/").replace("~0", "~")]
        return at

    def faults(self, schema, node: Node, refs: tuple[str, ...] = ()) -> Column:
        """Faults of a value that is there."""
        if schema is True:
            return none()
        if schema is False:
            return fault(F.lit(True), node.path, "false")
        out = []
        for key, want in schema.items():
            if key in SILENT:
                continue
            if key in _BOUNDS:
                kind, broken = _BOUNDS[key]
                out.append(fault(node.is_a(kind) & broken(node, want), node.path, key))
                continue
            rule = getattr(self, "_" + key.replace("$", ""), None)
            if rule is None:
                raise ValueError(f"keyword {key!r} is not understood")
            out.append(rule(want, node, schema, refs))
        return together(out)

    def _ref(self, want, node, schema, refs):
        if want in refs:
            raise ValueError(f"$ref {want!r} leads back into itself")
        return self.faults(self.resolve(want), node, (*refs, want))

    def _type(self, want, node, schema, refs):
        return fault(~_any([node.is_a(x) for x in ([want] if isinstance(want, str) else want)]), node.path, "type")

    def _enum(self, want, node, schema, refs):
        return fault(~equal_any(node, want), node.path, "enum")

    def _const(self, want, node, schema, refs):
        return fault(~_any([equal(node, want)]), node.path, "const")

    def _pattern(self, want, node, schema, refs):
        return fault(node.is_a("string") & ~F.rlike(node.text, F.lit(want)), node.path, "pattern")

    def _format(self, want, node, schema, refs):
        if want != "date-time":
            return none()  # an annotation only
        return fault(node.is_a("string") & ~F.rlike(node.text, F.lit(DATE_TIME)), node.path, "format")

    def _required(self, want, node, schema, refs):
        return together([fault(node.is_a("object") & node.child(x).isNull(), node.below(x), "required") for x in want])

    def _properties(self, want, node, schema, refs):
        def one(name, sub):
            there = lambda v: F.when(v.isNotNull(), Node.bound(v, node.below(name), lambda child: self.faults(sub, child, refs))).otherwise(none())
            return let(node.child(name), there)

        return together([one(name, sub) for name, sub in want.items()])

    def _more(self, node, schema, each: Callable[[Column, Column], Column]) -> Column:
        """Of an object's properties that the schema does not name, in order of name: the faults that `each` finds in a name and its value."""
        known = F.array(*[F.lit(x) for x in schema.get("properties", {})]).cast("array<string>")

        def found(entries):
            # By place, since a map is searched from its start for each key.
            places = F.transform(F.map_keys(entries), lambda k, i: F.struct(k.alias("k"), i.alias("i")))
            names = F.filter(F.array_sort(places), lambda x: ~F.array_contains(known, x["k"]))
            return F.flatten(F.transform(names, lambda x: each(x["k"], F.get(F.map_values(entries), x["i"]))))

        return F.coalesce(let(node.entries, found), none())

    def _additionalProperties(self, want, node, schema, refs):
        below = lambda k: F.concat(node.path, F.lit("."), k)
        if want is True:
            return none()
        if want is False:
            return self._more(node, schema, lambda k, v: fault(F.lit(True), below(k), "additionalProperties"))
        return self._more(node, schema, lambda k, v: let(v, lambda v: Node.bound(v, below(k), lambda child: self.faults(want, child, refs))))

    def _propertyNames(self, want, node, schema, refs):
        if set(want) - {"pattern"}:
            raise ValueError("propertyNames: only pattern is understood")
        names = F.filter(F.array_sort(F.map_keys(node.entries)), lambda k: ~F.rlike(k, F.lit(want["pattern"])))
        return F.coalesce(F.transform(names, lambda k: F.struct(F.concat(node.path, F.lit("."), k).alias("path"), F.lit("propertyNames").alias("rule"))), none())

    def _items(self, want, node, schema, refs):
        below = lambda i: F.concat(node.path, F.lit("["), i.cast("string"), F.lit("]"))
        return F.coalesce(F.flatten(F.transform(node.items, lambda x, i: Node.bound(x, below(i), lambda child: self.faults(want, child, refs)))), none())

    def _uniqueItems(self, want, node, schema, refs):
        told = F.transform(node.items, lambda x: F.to_json(x))
        return fault(F.lit(bool(want)) & (F.size(F.array_distinct(told)) < F.size(told)), node.path, "uniqueItems")

    def _fits(self, sub, node, refs) -> Column:
        return F.size(self.faults(sub, node, refs)) == 0

    def _allOf(self, want, node, schema, refs):
        return together([self.faults(x, node, refs) for x in want])

    def _anyOf(self, want, node, schema, refs):
        return fault(~_any([self._fits(x, node, refs) for x in want]), node.path, "anyOf")

    def _oneOf(self, want, node, schema, refs):
        return fault(sum((self._fits(x, node, refs).cast("int") for x in want), F.lit(0)) != 1, node.path, "oneOf")

    def _not(self, want, node, schema, refs):
        return fault(self._fits(want, node, refs), node.path, "not")

    def _if(self, want, node, schema, refs):
        of = lambda key: self.faults(schema[key], node, refs) if key in schema else none()
        return F.when(self._fits(want, node, refs), of("then")).otherwise(of("else"))


def _bound_faults(value: Column, schema: dict | bool) -> Column:
    compiler = Compiler(schema if isinstance(schema, dict) else {})
    return F.when(value.isNotNull(), Node.bound(value, F.lit("$"), lambda root: compiler.faults(schema, root)))


def faults(document: Column, schema: dict | bool) -> Column:
    """Faults of a document (a VARIANT) under a schema, in the order in which the schema names its rules; NULL if there is no document."""
    return let(document, lambda value: _bound_faults(value, schema))


def faults_of_text(document: Column, schema: dict | bool) -> Column:
    """The same of a JSON text; what is no JSON has the one fault `json`."""
    no_json = fault(F.lit(True), F.lit("$"), "json")
    return let(document, lambda text: F.when(text.isNotNull(), let(F.try_parse_json(text), lambda value: F.coalesce(_bound_faults(value, schema), no_json))))
