"""The compiler of schemas against hand-worked documents and against a plain validator of the same keywords."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from steploom.functions import schema as S


ABSENT = object()


def run(spark, schema, docs):
    df = spark.createDataFrame([(i, d.decode() if isinstance(d, bytes) else None if d is ABSENT else json.dumps(d)) for i, d in enumerate(docs)], "i int, d string")
    got = df.select("i", S.faults_of_text(F.col("d"), schema).alias("f")).orderBy("i").collect()
    return [None if r.f is None else [f"{x.path} {x.rule}" for x in r.f] for r in got]


STEP = {"type": "object", "additionalProperties": False, "required": ["id", "label"], "properties": {"id": {"type": "string", "pattern": "^s[0-9]+$"}, "label": {"enum": ["sound", "unsound", None]}, "error": {"type": ["string", "null"]}},
        "if": {"properties": {"label": {"const": "unsound"}}}, "then": {"required": ["error"], "properties": {"error": {"type": "string"}}}, "else": {"properties": {"error": {"type": "null"}}}}
REPORT = {"$schema": "x", "type": "object", "required": ["version", "arms"], "additionalProperties": False,
          "properties": {"version": {"const": "1.0"}, "at": {"type": "string", "format": "date-time"}, "arms": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/arm"}}, "pins": {"type": "object", "additionalProperties": {"type": ["string", "number"]}}},
          "$defs": {"arm": {"type": "object", "required": ["steps"], "properties": {"steps": {"type": "array", "items": {"$ref": "#/$defs/step"}}, "score": {"type": "number", "minimum": 0, "maximum": 1}}}, "step": STEP}}


def test_faults_of_reports_with_their_paths(spark):
    ok = {"version": "1.0", "at": "2026-01-02T03:04:05Z", "arms": [{"steps": [{"id": "s1", "label": "sound"}, {"id": "s2", "label": "unsound", "error": "logical"}], "score": 1}], "pins": {"a": "x", "b": 2.5}}
    bad = [
        {**ok, "extra": 1}, {**ok, "arms": []}, {**ok, "version": 1.0}, {"version": "1.0"}, {**ok, "at": "yesterday"}, {**ok, "pins": {"a": None, "z": [1]}},
        {**ok, "arms": [{"steps": [{"id": "1", "label": "sound", "error": "x"}]}, {"steps": 5, "score": 1.5}]}, {**ok, "arms": [{"steps": [{"id": "s1", "label": "unsound"}, {"label": None, "q": 1}]}]}, [], b"no json", ABSENT, {**ok, "arms": [None]},
    ]
    assert run(spark, REPORT, [ok, *bad]) == [
        [], ["$.extra additionalProperties"], ["$.arms minItems"], ["$.version const"], ["$.arms required"], ["$.at format"], ["$.pins.a type", "$.pins.z type"],
        ["$.arms[0].steps[0].id pattern", "$.arms[0].steps[0].error type", "$.arms[1].steps type", "$.arms[1].score maximum"], ["$.arms[0].steps[0].error required", "$.arms[0].steps[1].q additionalProperties", "$.arms[0].steps[1].id required"],
        ["$ type"], ["$ json"], None, ["$.arms[0] type"],
    ]


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else {str: "string", list: "array", dict: "object"}[type(v)]


def same(a, b):
    if kind(a) != kind(b):
        return False
    if kind(a) == "array":
        return len(a) == len(b) and all(map(same, a, b))
    return a == b if kind(a) != "object" else set(a) == set(b) and all(same(a[k], b[k]) for k in a)


def plain(s, v, path="$"):
    """The rules one by one over Python values."""
    if isinstance(s, bool):
        return [] if s else [f"{path} false"]
    out, k = [], kind(v)
    add = lambda bad, rule, p=path: out.append(f"{p} {rule}") if bad else None
    for key, want in s.items():
        if key == "type":
            add(not any(t == k or t == "integer" and k == "number" and v == math.floor(v) for t in ([want] if isinstance(want, str) else want)), key)
        elif key in ("enum", "const"):
            add(not any(same(v, x) for x in (want if key == "enum" else [want])), key)
        elif key == "pattern":
            add(k == "string" and not re.search(want, v), key)
        elif key in ("minLength", "maxLength"):
            add(k == "string" and (len(v) < want if key == "minLength" else len(v) > want), key)
        elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
            add(k == "number" and {"minimum": lambda: v < want, "maximum": lambda: v > want, "exclusiveMinimum": lambda: v <= want, "exclusiveMaximum": lambda: v >= want, "multipleOf": lambda: v % want != 0}[key](), key)
        elif key in ("minItems", "maxItems"):
            add(k == "array" and (len(v) < want if key == "minItems" else len(v) > want), key)
        elif key in ("minProperties", "maxProperties"):
            add(k == "object" and (len(v) < want if key == "minProperties" else len(v) > want), key)
        elif key == "uniqueItems":
            add(want and k == "array" and any(same(a, b) for i, a in enumerate(v) for b in v[:i]), key)
        elif key == "required" and k == "object":
            for x in want:
                add(x not in v, key, f"{path}.{x}")
        elif key == "properties" and k == "object":
            for x, sub in want.items():
                out += plain(sub, v[x], f"{path}.{x}") if x in v else []
        elif key == "additionalProperties" and k == "object":
            for x in sorted(set(v) - set(s.get("properties", {}))):
                out += ([f"{path}.{x} additionalProperties"] if not want else []) if isinstance(want, bool) else plain(want, v[x], f"{path}.{x}")
        elif key == "propertyNames" and k == "object":
            for x in sorted(v):
                add(not re.search(want["pattern"], x), key, f"{path}.{x}")
        elif key == "items" and k == "array":
            for i, x in enumerate(v):
                out += plain(want, x, f"{path}[{i}]")
        elif key == "allOf":
            for x in want:
                out += plain(x, v, path)
        elif key in ("anyOf", "oneOf", "not"):
            n = sum(not plain(x, v, path) for x in (want if key != "not" else [want]))
            add(n == 0 if key == "anyOf" else n != 1 if key == "oneOf" else n == 1, key)
        elif key == "if":
            out += plain(s.get("else" if plain(want, v, path) else "then", True), v, path)
    return out


def random_schema(rng, depth):
    keys = {
        "type": lambda: rng.choice(["string", "number", "integer", "object", "array", "null", ["boolean", "string"], ["object", "array"]]), "enum": lambda: rng.sample([None, True, "a", 1, 2.5, [1], {"a": "x"}], 3), "const": lambda: rng.choice([None, "ab", 3, False]),
        "pattern": lambda: rng.choice(["^a", "b$", "[0-9]"]), "minLength": lambda: 2, "maxLength": lambda: 2, "minimum": lambda: 1, "maximum": lambda: 2, "exclusiveMinimum": lambda: 2, "exclusiveMaximum": lambda: 2.5, "multipleOf": lambda: 0.5,
        "minItems": lambda: 2, "maxItems": lambda: 2, "uniqueItems": lambda: rng.random() < 0.8, "required": lambda: rng.sample(["a", "b", "c"], 2), "minProperties": lambda: 2, "maxProperties": lambda: 2, "propertyNames": lambda: {"pattern": "[ab]"},
    }
    out = {k: keys[k]() for k in rng.sample(list(keys), rng.randrange(0, 3))}
    if depth:
        sub = lambda: random_schema(rng, depth - 1)
        deep = {"properties": lambda: {"a": sub(), "b": sub()}, "additionalProperties": lambda: rng.choice([False, True, sub()]), "items": sub, "allOf": lambda: [sub(), sub()], "anyOf": lambda: [sub(), sub()], "oneOf": lambda: [sub(), sub()], "not": sub, "if": sub}
        out |= {k: deep[k]() for k in rng.sample(list(deep), rng.randrange(1, 3))}
        if "if" in out:
            out |= {k: sub() for k in rng.sample(["then", "else"], rng.randrange(3))}
    return out


def random_value(rng, depth):
    if depth and rng.random() < 0.6:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))] if rng.random() < 0.4 else {k: random_value(rng, depth - 1) for k in rng.sample(["a", "b", "c", "dé"], rng.randrange(4))}
    return rng.choice([None, True, False, "", "a", "ab", "b1", 0, 1, 2, 3, 2.5, 1.0, -1])


def test_random_schemas_by_a_plain_validator(spark):
    rng, n = random.Random(6), 0
    docs = [random_value(rng, 3) for _ in range(80)]
    for _ in range(12):
        schema = random_schema(rng, 2)
        want = [plain(schema, d) for d in docs]
        assert run(spark, schema, docs) == want, schema
        n += sum(map(len, want))
    assert n > 200


def test_what_is_not_understood_is_an_error(spark):
    for schema in ({"contains": {}}, {"$ref": "http://x"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"propertyNames": {"maxLength": 1}}):
        with pytest.raises(ValueError):
            S.faults(F.lit(1), schema)


def test_no_python_worker(spark):
    plan = spark.createDataFrame([("{}",)], "d string").select(S.faults_of_text(F.col("d"), REPORT).alias("f"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_document_is_made_and_parsed_once(spark):
    """However many rules ask about it: its text, the parse, and each value with its kind."""
    text = F.concat(F.lit('{"version": "'), F.col("d"), F.lit('"}'))
    plan = spark.createDataFrame([("1.0",)], "d string").repartition(1).select(S.faults_of_text(text, REPORT).alias("f"))._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    # Root, version, at, arms, an arm, steps, a step's id, label, error (asked in five places), score, pins, a pin.
    assert plan.count("parse_json") + plan.count("parseJson") == 1 and plan.count('{"version": "') == 1 and 10 < len(re.findall(r"schema_of_variant|schemaOfVariant", plan)) < 25


def test_many_properties_that_no_schema_names(spark):
    doc = {f"p{i}": i if i % 100 else "x" for i in range(3000)}
    assert run(spark, {"additionalProperties": {"type": "number"}}, [doc]) == [[f"$.p{i} type" for i in sorted(range(0, 3000, 100), key=str)]]
