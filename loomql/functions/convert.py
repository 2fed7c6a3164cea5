"""Rows to objects and back, and the ways to read a boolean."""

from __future__ import annotations

import dataclasses
import decimal
import types
import typing

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomql.errors import InvalidReference
from loomql.plans.refs import snake

STRICT, COMPAT, LENIENT, LEGACY = "strict", "compat", "lenient", "legacy"
TRUE = {"true", "t", "1"}
FALSE = {"false", "f", "0"}
YES = {"yes", "y", "on"}
NO = {"no", "n", "off"}


def to_bool(value, policy: str = COMPAT) -> bool:
    """strict: booleans, 0 and 1, true and false. compat: yes, no, on and off
    too. lenient: any whole number. legacy: any number, and null is false."""
    if value is None:
        if policy == LEGACY:
            return False
        raise InvalidReference("null isn't a boolean")
    if isinstance(value, bool):
        return value
    if isinstance(value, bytes):
        value = value.decode()
    if isinstance(value, (int, float, decimal.Decimal)):
        if value in (0, 1) or policy in (LENIENT, LEGACY):
            return bool(value)
    else:
        text = str(value).strip().lower()
        if text in TRUE or policy in (COMPAT, LENIENT) and text in YES:
            return True
        if text in FALSE or policy in (COMPAT, LENIENT) and text in NO:
            return False
        if policy in (LENIENT, LEGACY) and text.lstrip("+-").isdigit():
            return int(text) != 0
    raise InvalidReference(f"{value!r} isn't a boolean ({policy})")


def bool_column(col: Column, policy: str = COMPAT) -> Column:
    """The same for a column; what isn't a boolean, null included, gives null
    (in legacy, null is false)."""
    text = F.lower(F.trim(col.cast("string")))
    more = policy in (COMPAT, LENIENT)
    out = F.when(text.isin(*TRUE, *(YES if more else ())), True).when(text.isin(*FALSE, *(NO if more else ())), False)
    if policy in (LENIENT, LEGACY):
        number = text.try_cast("decimal(38,0)") if hasattr(text, "try_cast") else text.cast("decimal(38,0)")
        out = out.when(text.rlike(r"^[+-]?\d+$"), number != 0)
    if policy == LEGACY:
        out = F.when(col.isNull(), False).otherwise(out)
    return out


def as_(kind: type, value, policy: str = COMPAT):
    """value as a kind; None for an optional kind."""
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        inner = [a for a in typing.get_args(kind) if a is not type(None)]
        return None if value is None else as_(inner[0], value, policy)
    if value is None:
        return {int: 0, float: 0.0, str: ""}.get(kind) if kind is not bool else to_bool(None, policy)
    if kind is bool:
        return to_bool(value, policy)
    if isinstance(value, bytes) and kind is str:
        return value.decode()
    if kind is int and isinstance(value, float) and value != int(value):
        raise InvalidReference(f"{value!r} isn't whole")
    if kind in (int, float, str, decimal.Decimal):
        return value if type(value) is kind else kind(str(value) if kind is decimal.Decimal else value)
    return value


def value_of(row: dict, key: str, kind: type, policy: str = COMPAT):
    if key not in row:
        raise InvalidReference(f"no column {key!r}")
    return as_(kind, row[key], policy)


def to_object(row: dict, kind: type, policy: str = COMPAT):
    """A dataclass from a row: by the field's column, its name, or its name
    without underscores. A field with a `prefix` takes the columns that begin so."""
    if kind is dict:
        return row
    hints = typing.get_type_hints(kind)
    plain = {k.replace("_", "").lower(): k for k in row}
    out = {}
    for f in dataclasses.fields(kind):
        name = f.metadata.get("column", snake(f.name))
        if name == "-":
            continue
        prefix = f.metadata.get("prefix")
        if prefix:
            inner = {k[len(prefix) :]: v for k, v in row.items() if k.startswith(prefix)}
            out[f.name] = to_object(inner, hints[f.name], policy)
            continue
        found = name if name in row else plain.get(name.replace("_", "").lower())
        if found is not None:
            out[f.name] = as_(hints[f.name], row[found], f.metadata.get("bools", policy))
    return kind(**out)


def to_objects(rows: list[dict], kind: type, policy: str = COMPAT) -> list:
    return [to_object(r, kind, policy) for r in rows]


def to_map(item) -> dict:
    """Columns and values of a dataclass; empty ones marked omitempty are left out."""
    out = {}
    for f in dataclasses.fields(item):
        value, name = getattr(item, f.name), f.metadata.get("column", snake(f.name))
        if name == "-" or f.metadata.get("omitempty") and value in (None, "", 0, False):
            continue
        out[name] = value
    return out


def null_string(value: str | None, empty: bool = False) -> str | None:
    """value; None for None, and for the empty text if `empty`."""
    return None if value is None or empty and value == "" else value


@dataclasses.dataclass(frozen=True)
class NumericString:
    """A decimal as its exact text."""

    text: str = ""
    valid: bool = False

    @classmethod
    def of(cls, value: str) -> "NumericString":
        return cls.scan(value)

    @classmethod
    def null(cls) -> "NumericString":
        return cls()

    @classmethod
    def scan(cls, value) -> "NumericString":
        if value is None:
            return cls()
        text = value.decode() if isinstance(value, bytes) else str(value)
        if not text.strip():
            raise InvalidReference("an empty number")
        decimal.Decimal(text)
        return cls(text, True)

    def value(self) -> str | None:
        return self.text if self.valid else None

    def or_default(self, default: str) -> str:
        return self.text if self.valid else default
