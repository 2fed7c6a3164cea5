"""Identifiers, operators and raw fragments: what a builder accepts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from loomql.errors import InvalidReference

OPERATORS = {"=", "!=", "<>", ">", ">=", "<", "<=", "LIKE", "NOT LIKE"}
PART = re.compile(r"\s*(?:`([^`]+)`|\"([^\"]+)\"|([^\W\d][\w$]*))\s*")
UNSAFE = re.compile(r"\b(?:insert|update|delete|merge|drop|alter|truncate|create|grant)\b", re.I)
EXPRESSION = re.compile(r"[()'+/%,;\s]|--|\|\|")


@dataclass(frozen=True)
class Name:
    """One to three parts, the last of which may be `*`, and an alias."""

    parts: tuple[str, ...]
    alias: str | None = None

    @property
    def last(self) -> str:
        return self.parts[-1]

    @property
    def qualifier(self) -> str | None:
        return self.parts[-2] if len(self.parts) > 1 else None

    @property
    def label(self) -> str:
        return self.alias or self.last

    def __str__(self) -> str:
        return ".".join(self.parts)


def parse(text: str, star: bool = False, alias: bool = False) -> Name:
    if not isinstance(text, str):
        raise InvalidReference(f"not a name: {text!r}")
    body, label = text.strip(), None
    if alias and (m := re.fullmatch(r"(.+?)\s+(?:as\s+)?([^\W\d]\w*)", body, re.I)):
        body, label = m[1], m[2]
    parts: list[str] = []
    at = 0
    while True:
        if star and body[at:].strip() == "*":
            parts.append("*")
            at = len(body)
        elif m := PART.match(body, at):
            parts.append(m[1] or m[2] or m[3])
            at = m.end()
        else:
            raise InvalidReference(f"not a name: {text!r}")
        if at == len(body):
            break
        if body[at] != "." or parts[-1] == "*":
            raise InvalidReference(f"not a name: {text!r}")
        at += 1
    if len(parts) > 3:
        raise InvalidReference(f"more than three parts: {text!r}")
    return Name(tuple(parts), label)


def operator(text: str) -> str:
    """The operator in capitals, if it's one of OPERATORS."""
    found = " ".join(str(text).upper().split())
    if found not in OPERATORS:
        raise InvalidReference(f"not an operator: {text!r}")
    return found


def fragment(raw: str) -> str:
    """A raw fragment without statement ends, comments or statements that write."""
    if not raw or not raw.strip():
        raise InvalidReference("an empty fragment")
    for mark in (";", "--", "/*", "*/", "\0"):
        if mark in raw:
            raise InvalidReference(f"{mark!r} isn't allowed in a raw fragment")
    if m := UNSAFE.search(raw):
        raise InvalidReference(f"{m[0]} isn't allowed in a raw fragment")
    return raw


def column(text: str) -> Name:
    """A select column: a name, perhaps with an alias, but no expression."""
    bare = re.sub(r"\s+as\s+[^\W\d]\w*$", "", str(text).strip(), flags=re.I)
    if EXPRESSION.search(re.sub(r"`[^`]*`|\"[^\"]*\"", "x", bare)):
        raise InvalidReference(f"an expression, not a column: {text!r}; use select_raw")
    return parse(text, star=True, alias=True)


QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def outside(sql: str, pattern: str, put) -> str:
    """sql with put(match) for matches outside quotes and comments."""
    joined = re.compile(f"(?P<_q>{QUOTED.pattern})|(?P<_p>{pattern})", re.S)
    return joined.sub(lambda m: m[0] if m["_q"] is not None else put(m), sql)


def pieces(sql: str) -> list[str]:
    """The parts between the commas that stand outside quotes and brackets."""
    depth, out = 0, [""]
    for token in re.findall(rf"{QUOTED.pattern}|.", sql, re.S):
        depth += (token in ("(", "[")) - (token in (")", "]"))
        if token == "," and not depth:
            out.append("")
        else:
            out[-1] += token
    return out


def positional(sql: str, values: tuple, put) -> str:
    """`?` outside quotes and comments, each with put(value)."""
    left = list(values)

    def one(m):
        if not left:
            raise InvalidReference("fewer values than placeholders")
        return put(left.pop(0))

    out = outside(sql, r"\?", one)
    if left:
        raise InvalidReference("more values than placeholders")
    return out


def named(sql: str, values: dict, put) -> str:
    """`:name` outside quotes, comments and `::` casts, each with put(value); an
    empty dict leaves the text alone."""
    if not values:
        return sql

    def one(m):
        name = m[0].lstrip(":")
        if m[0].startswith("::"):
            return m[0]
        if name not in values:
            raise InvalidReference(f"no value for :{name}")
        return put(values[name])

    return outside(sql, r"::\w+|:[^\W\d]\w*", one)


def like_escaped(term: str) -> str:
    return re.sub(r"([!%_])", r"!\1", term)


def snake(name: str) -> str:
    """HTTPSUrl -> https_url."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", spaced).lower()


def table_of(kind: type) -> str:
    """table_name() of a class, else its name in snake case with an s."""
    given = getattr(kind, "table_name", None)
    return given() if callable(given) else snake(kind.__name__) + "s"
