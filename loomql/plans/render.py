"""Dialects, and the text of a query in them. Spark runs the `spark` text with
named parameters; the other texts are for review and for those who port queries."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass

from loomql.errors import InvalidReference
from loomql.plans.refs import Name

SCALARS = (bool, int, float, str, bytes, decimal.Decimal, datetime.date, datetime.time, datetime.datetime)


@dataclass(frozen=True)
class Dialect:
    name: str
    quote: str
    nulls_first: bool  # where ascending order puts nulls

    def quoted(self, part: str) -> str:
        if "\0" in part:
            raise InvalidReference("a null byte in a name")
        return self.quote + part.replace(self.quote, self.quote * 2) + self.quote

    def placeholder(self, n: int) -> str:
        return {"spark": f":p{n}", "postgres": f"${n}"}.get(self.name, "?")

    def date_part(self, part: str, x: str) -> str:
        if self.name == "mysql":
            return f"{part.upper()}({x})"
        if self.name == "postgres":
            return {"date": f"({x})::date", "time": f"({x})::time"}.get(part, f"EXTRACT({part.upper()} FROM {x})")
        return {"date": f"to_date({x})", "time": f"date_format({x}, 'HH:mm:ss')", "day": f"dayofmonth({x})"}.get(part, f"{part}({x})")


SPARK = Dialect("spark", "`", False)
MYSQL = Dialect("mysql", "`", True)
POSTGRES = Dialect("postgres", '"', False)
DIALECTS: dict[str, Dialect] = {d.name: d for d in (SPARK, MYSQL, POSTGRES)}


def register_dialect(name: str, dialect: Dialect) -> None:
    DIALECTS[name] = dialect


def literal(value) -> str:
    """A value written out, for debugging."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, (datetime.date, datetime.time, datetime.datetime)):
        return f"'{value}'"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    return "'" + str(value).replace("'", "''") + "'"


class Renderer:
    """Collects the parameters of one text. source(name) gives the name under
    which a table is known, null order follows the dialect that is imitated."""

    def __init__(self, dialect: Dialect = SPARK, like: Dialect | None = None, source=None, inline: bool = False):
        self.dialect, self.like, self.source, self.inline = dialect, like or dialect, source, inline
        self.values: list = []
        self.outer: list = []  # names of the queries around the one at hand
        self.negated = False  # within a NOT

    def value(self, value) -> str:
        if isinstance(value, (list, tuple, set)):
            return "(" + ", ".join(map(self.value, value)) + ")"
        if value is not None and not isinstance(value, SCALARS):
            raise InvalidReference(f"a value of type {type(value).__name__}")
        if value is None and self.dialect.name == "spark" or self.inline:
            return literal(value)
        self.values.append(value)
        return self.dialect.placeholder(len(self.values))

    def name(self, name: Name) -> str:
        return ".".join(p if p == "*" else self.dialect.quoted(p) for p in name.parts)

    def table(self, name: Name) -> str:
        known = self.source(str(name)) if self.source else None
        label = name.alias or (name.last if known else None)
        text = self.dialect.quoted(known) if known else self.name(Name(name.parts))
        return f"{text} AS {self.dialect.quoted(label)}" if label else text

    def arguments(self) -> dict | list:
        return {f"p{i + 1}": v for i, v in enumerate(self.values)} if self.dialect.name == "spark" else self.values

    def order(self, text: str, down: bool) -> str:
        if self.dialect.name != "spark":
            return f"{text} {'DESC' if down else 'ASC'}"
        return f"{text} {'DESC' if down else 'ASC'} NULLS {'FIRST' if self.like.nulls_first != down else 'LAST'}"
