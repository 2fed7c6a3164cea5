"""JSON: paths, objects and arrays built in a query, and values that carry JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomql.errors import InvalidReference
from loomql.plans.refs import fragment, parse


@dataclass(frozen=True)
class Projection:
    """A checked expression with its values."""

    sql: str
    values: tuple = ()


def projection(sql: str, *values) -> Projection:
    return Projection(fragment(sql), values)


def json_path(column: str, *path: str) -> str:
    """A key col->a->b for JSON updates."""
    if not path or any(not re.fullmatch(r"[\w-]+", p) for p in path):
        raise InvalidReference(f"not a JSON path: {path}")
    return "->".join([str(parse(column)), *path])


def build_object(fields: dict[str, str]) -> Projection:
    """JSON text of an object, keys in order, of expressions; nulls are kept."""
    if not fields:
        raise InvalidReference("an object without fields")
    parts = ", ".join(f"{fragment(e)} AS `{k}`" for k, e in sorted(fields.items()))
    return Projection(f"to_json(struct({parts}), map('ignoreNullFields', 'false'))")


def aggregate_array(expr: Projection | str, order_by: tuple[str, ...] = (), where: str | None = None) -> Projection:
    """JSON text of an array of a group's values, `[]` if none. order_by sorts
    within the group, and takes `expr desc`; where leaves rows out."""
    given = expr if isinstance(expr, Projection) else projection(expr)
    keys = []
    for i, o in enumerate(order_by):
        m = re.fullmatch(r"(.+?)(?:\s+(asc|desc))?", o.strip(), re.I | re.S)
        keys.append((fragment(m[1]), (m[2] or "asc").lower() == "desc", f"k{i}"))
    pack = ", ".join([*(f"{e} AS {n}" for e, _, n in keys), f"{given.sql} AS v"])
    kept = f" FILTER (WHERE {fragment(where)})" if where else ""
    items = f"collect_list(struct({pack})){kept}"
    if keys:
        steps = "ELSE 0 END"
        for e, down, n in reversed(keys):
            less, more = ("1", "-1") if down else ("-1", "1")
            steps = f"WHEN l.{n} < r.{n} THEN {less} WHEN l.{n} > r.{n} THEN {more} WHEN l.{n} IS NULL AND r.{n} IS NOT NULL THEN 1 WHEN l.{n} IS NOT NULL AND r.{n} IS NULL THEN -1 " + steps
        items = f"array_sort({items}, (l, r) -> CASE {steps})"
    return Projection(f"to_json(transform({items}, x -> x.v))", given.values)


def set_path(column: Column, path: tuple[str, ...], value) -> Column:
    """JSON text with a value put at a path; objects on the way are made. Null
    text counts as an empty object. Other keys keep their place."""

    def put(col: Column, keys: tuple[str, ...]) -> Column:
        parsed = F.from_json(F.coalesce(col, F.lit("{}")), "map<string,string>")
        if len(keys) == 1:
            new = F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2) if isinstance(value, Column) else F.lit(json.dumps(value))
        else:
            new = put(F.get_json_object(col, f"$.{keys[0]}"), keys[1:])
        names = F.coalesce(F.json_object_keys(F.coalesce(col, F.lit("{}"))), F.array())
        others = F.filter(names, lambda k: k != keys[0])
        # a string's own text isn't told from a number's in the map, so values are taken as they stand in the text
        old = F.transform(others, lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), _as_is(col, parsed[k], k)))
        mine = F.concat(F.lit(json.dumps(keys[0]) + ":"), new)
        return F.concat(F.lit("{"), F.array_join(F.concat(old, F.array(mine)), ","), F.lit("}"))

    return put(column, path)


def _as_is(col: Column, text: Column, key: Column) -> Column:
    quoted = F.to_json(F.array(text))
    bare = F.from_json(col, "map<string,variant>")[key]
    kind = F.schema_of_variant(bare)
    return F.when(text.isNull(), F.lit("null")).when(kind == "STRING", quoted.substr(F.lit(2), F.length(quoted) - 2)).otherwise(text)


def encode(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def decode(source, fallback=None):
    """The value of a JSON text; fallback for null and for an empty text."""
    if source is None or source in ("", b""):
        return fallback
    return json.loads(source)


@dataclass(frozen=True)
class JSONField:
    """A JSON value that may be null."""

    held: object = None
    valid: bool = False

    @classmethod
    def of(cls, value) -> "JSONField":
        return cls(value, True)

    @classmethod
    def null(cls) -> "JSONField":
        return cls()

    @classmethod
    def scan(cls, source) -> "JSONField":
        if source is None:
            return cls()
        if source in ("", b""):
            raise InvalidReference("an empty JSON text")
        return cls(json.loads(source), True)

    def value(self) -> str | None:
        return encode(self.held) if self.valid else None

    def or_default(self, default):
        return self.held if self.valid else default

    def validate(self, check: Callable[[object], None]) -> None:
        if self.valid:
            check(self.held)
