"""Predicates: nodes that render themselves, with what plans and policies ask of
them. A list of them is folded as SQL folds it: AND binds tighter than OR."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from loomql.errors import InvalidReference
from loomql.plans.refs import Name, fragment, like_escaped, named, operator, parse
from loomql.plans.render import Renderer


@dataclass(frozen=True)
class Predicate:
    kind: str
    text: Callable[[Renderer], str]
    columns: tuple[Name, ...] = ()
    operator: str = ""
    op: str = "AND"
    children: tuple["Predicate", ...] = ()
    negated: bool = False
    raw: str = ""
    subqueries: tuple = field(default=(), compare=False)


def fold(predicates: tuple[Predicate, ...], r: Renderer) -> str:
    out = ""
    for i, p in enumerate(predicates):
        text = p.text(r)
        out += f" {p.op} {text}" if i else text
    return out


def compare(col: str, *args) -> Predicate:
    """col = v, or col op v. A list with another operator than IN is a row."""
    if not 1 <= len(args) <= 2:
        raise InvalidReference("where takes a column and a value, or a column, an operator and a value")
    op, value = ("=", args[0]) if len(args) == 1 else (operator(args[0]), args[1])
    name = parse(col)
    return Predicate("compare", lambda r: f"{r.name(name)} {op} {r.value(value)}", (name,), op)


def raw(text: str, values: dict | None = None) -> Predicate:
    fragment(text)
    named(text, values or {}, lambda v: "")
    return Predicate("raw", lambda r: named(text, values or {}, r.value), raw=text)


def group(children: tuple[Predicate, ...], negated: bool = False) -> Predicate:
    if not children:
        raise InvalidReference("an empty group")

    def text(r):
        r.negated ^= negated
        held = fold(children, r)
        r.negated ^= negated
        return f"{'NOT ' * negated}({held})"

    return Predicate("group", text, children=children, negated=negated)


def among(col: str, values, negated: bool = False) -> Predicate:
    """col IN values; no values: IN holds for no row, NOT IN for all."""
    name, held = parse(col), list(values)

    def text(r):
        if not held:
            return "TRUE" if negated else "FALSE"
        return f"{r.name(name)} {'NOT ' * negated}IN {r.value(held)}"

    return Predicate("in", text, (name,), "NOT IN" if negated else "IN")


def among_query(col: str, sub, negated: bool = False) -> Predicate:
    """NOT IN is null-aware, as SQL has it. Spark compares each row with each for
    it, or sends all of the subquery to every task; so it gets the equality, which
    it can join by, and the nulls of both sides apart."""
    name = parse(col)

    def text(r):
        x, rows = r.name(name), sub.nested(r)
        if r.dialect.name != "spark" or negated == r.negated:
            return f"{x} {'NOT ' * negated}IN ({rows})"
        nulls = f"SELECT 1 FROM ({rows}) AS `_loomql_in`(`_loomql_value`) WHERE `_loomql_value` IS NULL"
        unknown = f"EXISTS ({nulls}) OR {x} IS NULL AND EXISTS ({rows})"
        apart = f"(NOT coalesce({x} IN ({rows}), FALSE) AND CASE WHEN {unknown} THEN NULL ELSE TRUE END)"
        return apart if negated else f"NOT {apart}"

    return Predicate("in_query", text, (name,), "NOT IN" if negated else "IN", subqueries=(sub,))


def exists(sub, negated: bool = False) -> Predicate:
    return Predicate("exists", lambda r: f"{'NOT ' * negated}EXISTS ({sub.nested(r)})", operator="EXISTS", negated=negated, subqueries=(sub,))


def scalar_query(col: str, op: str, sub) -> Predicate:
    name, op = parse(col), operator(op)
    return Predicate("scalar_query", lambda r: f"{r.name(name)} {op} ({sub.nested(r)})", (name,), op, subqueries=(sub,))


def several(cols, op: str, value, all_of: bool) -> Predicate:
    if not cols:
        raise InvalidReference("no columns")
    each = [compare(c, op, value) for c in cols]
    word = "AND" if all_of else "OR"
    return group(tuple(replace(p, op=word) for p in each))


def comparison(*args: str) -> tuple[str, str, str]:
    if len(args) == 2:
        return args[0], "=", args[1]
    if len(args) == 3:
        return args[0], operator(args[1]), args[2]
    raise InvalidReference("a column comparison has two or three parts")


def column(*args: str) -> Predicate:
    a, op, b = comparison(*args)
    left, right = parse(a), parse(b)
    return Predicate("column", lambda r: f"{r.name(left)} {op} {r.name(right)}", (left, right), op)


def null(col: str, negated: bool = False) -> Predicate:
    name = parse(col)
    return Predicate("null", lambda r: f"{r.name(name)} IS {'NOT ' * negated}NULL", (name,), "IS NOT NULL" if negated else "IS NULL")


def between(col: str, low, high, negated: bool = False) -> Predicate:
    name = parse(col)
    return Predicate("between", lambda r: f"{r.name(name)} {'NOT ' * negated}BETWEEN {r.value(low)} AND {r.value(high)}", (name,), "BETWEEN")


def between_columns(col: str, low: str, high: str, negated: bool = False) -> Predicate:
    name, a, b = parse(col), parse(low), parse(high)
    return Predicate("between_columns", lambda r: f"{r.name(name)} {'NOT ' * negated}BETWEEN {r.name(a)} AND {r.name(b)}", (name, a, b), "BETWEEN")


def date_part(part: str, col: str, op: str, value) -> Predicate:
    """Days, months and years are compared as numbers, and must be such."""
    name, op = parse(col), operator(op)
    if part in ("day", "month", "year"):
        if not re.fullmatch(r"\s*-?\d+\s*", str(value)):
            raise InvalidReference(f"{part} {value!r} isn't a number")
        value = int(value)
    elif part == "date":
        value = str(datetime.date.fromisoformat(str(value)[:10]))
    else:
        value = str(value)
    cast = lambda r, v: f"to_date({v})" if part == "date" and r.dialect.name == "spark" else v
    return Predicate(part, lambda r: f"{r.dialect.date_part(part, r.name(name))} {op} {cast(r, r.value(value))}", (name,), op)


def text_search(cols, term: str) -> Predicate:
    """Any of the columns holds the term: without case where the imitated dialect
    is Postgres. A blank term is an error; the pattern keeps its spaces."""
    if not cols or not term or not term.strip():
        raise InvalidReference("text search needs columns and a term")
    names = [parse(c) for c in cols]
    pattern = f"%{like_escaped(term)}%"

    def text(r):
        word = "ILIKE" if r.like.name == "postgres" else "LIKE"
        return "(" + " OR ".join(f"{r.name(n)} {word} {r.value(pattern)} ESCAPE '!'" for n in names) + ")"

    return Predicate("text_search", text, tuple(names), "LIKE")


def full_text(cols, search: str, opts: dict | None = None) -> Predicate:
    """Words of the columns taken together, without case. mode: natural (any
    word), boolean (+must -not, else any), plain (all words), phrase, websearch
    ("a phrase", or, -not). There is no stemming, ranking or expansion; in the
    other dialects' text the database's own search is named."""
    opts = opts or {}
    names = [parse(c) for c in cols]
    mode = str(opts.get("mode") or opts.get("type") or ("plain")).lower()
    mode = {"plainto": "plain", "phraseto": "phrase", "natural language": "natural"}.get(mode, mode)
    word = lambda w: r"(?i)(?<!\w)" + r"\W+".join(map(re.escape, re.findall(r"\w+", w))) + r"(?!\w)"
    if mode not in ("natural", "boolean", "plain", "phrase", "websearch"):
        raise InvalidReference(f"full text mode {mode!r}")

    def text(r):
        if r.dialect.name == "mysql":
            return f"MATCH ({', '.join(map(r.name, names))}) AGAINST ({r.value(search)}{' IN BOOLEAN MODE' if mode == 'boolean' else ' IN NATURAL LANGUAGE MODE'}{' WITH QUERY EXPANSION' if opts.get('expanded') else ''})"
        if r.dialect.name == "postgres":
            lang = str(opts.get("language", "english"))
            fn = {"phrase": "phraseto_tsquery", "websearch": "websearch_to_tsquery"}.get(mode, "plainto_tsquery")
            vector = " || ".join(f"to_tsvector({r.value(lang)}, {r.name(n)})" for n in names)
            return f"({vector}) @@ {fn}({r.value(lang)}, {r.value(search)})"
        whole = f"concat_ws(' ', {', '.join(map(r.name, names))})"
        has = lambda w: f"{whole} RLIKE {r.value(word(w))}"
        if mode in ("natural", "plain"):
            found = re.findall(r"\w+", search)
            return "(" + (" AND " if mode == "plain" else " OR ").join(map(has, found)) + ")" if found else "FALSE"
        if mode == "phrase":
            return has(search) if re.search(r"\w", search) else "FALSE"
        tokens = [(sign, quoted or plain) for sign, quoted, plain in re.findall(r'([+-]?)(?:"([^"]*)"|([^\s"]+))', search) if re.search(r"\w", quoted or plain)]
        if mode == "boolean":
            must, out, may = ([w for s, w in tokens if s == sign] for sign in ("+", "-", ""))
            parts = [has(w) for w in must] + [f"NOT {has(w)}" for w in out]
            if may and not must:
                parts.append("(" + " OR ".join(map(has, may)) + ")")
            return "(" + " AND ".join(parts) + ")" if must or may else "FALSE"
        either: list[list[str]] = [[]]
        for sign, w in tokens:
            if w.lower() == "or" and not sign:
                either.append([])
            else:
                either[-1].append(f"NOT {has(w)}" if sign == "-" else has(w))
        return "(" + " OR ".join("(" + " AND ".join(e) + ")" for e in either if e) + ")" if any(either) else "FALSE"

    return Predicate("full_text", text, tuple(names), "MATCH")


def json_path(col: str) -> tuple[Name, tuple[str, ...]]:
    """col->a->b: the column and the keys below it."""
    base, *keys = str(col).split("->")
    keys = [k.lstrip(">").strip().strip("'\"") for k in keys]
    if any(not re.fullmatch(r"[\w-]+", k) for k in keys):
        raise InvalidReference(f"not a JSON path: {col!r}")
    return parse(base), tuple(keys)


def _get(r: Renderer, name: Name, keys: tuple[str, ...]) -> str:
    if r.dialect.name == "mysql":
        return f"JSON_UNQUOTE(JSON_EXTRACT({r.name(name)}, '$.{'.'.join(keys)}'))"
    if r.dialect.name == "postgres":
        return f"{r.name(name)} #>> '{{{','.join(keys)}}}'"
    return f"get_json_object({r.name(name)}, '${''.join(f'.{k}' if not k.isdigit() else f'[{k}]' for k in keys)}')"


def json_text(col: str, key: str, value) -> Predicate:
    name, keys = json_path(col)
    keys = (*keys, *json_path(f"x->{key}")[1])
    given = None if value is None else value if isinstance(value, str) else json.dumps(value)
    return Predicate("json_text", lambda r: f"{_get(r, name, keys)} = {r.value(given)}", (name,), "=")


def json_key(col: str, key: str, negated: bool = False) -> Predicate:
    """The object at a path has a key. Null where there is no object."""
    name, keys = json_path(col)

    def text(r):
        if r.dialect.name == "postgres":
            return f"{'NOT ' * negated}({r.name(name)} ? {r.value(key)})"
        if r.dialect.name == "mysql":
            return f"{'NOT ' * negated}JSON_CONTAINS_PATH({r.name(name)}, 'one', {r.value('$.' + key)})"
        at = _get(r, name, keys) if keys else r.name(name)
        return f"{'NOT ' * negated}array_contains(json_object_keys({at}), {r.value(key)})"

    return Predicate("json_key", text, (name,), "?")


def json_contains(col: str, value) -> Predicate:
    """Containment: of an object each key's value, of a list each member, of a
    scalar itself or a list that holds it."""
    name, keys = json_path(col)
    json.dumps(value)

    def holds(r, path, v):
        if isinstance(v, dict):
            return "(" + " AND ".join(holds(r, (*path, k), x) for k, x in v.items()) + ")" if v else f"json_object_keys({_get(r, name, path)}) IS NOT NULL"
        if isinstance(v, (list, tuple)):
            return "(" + " AND ".join(holds(r, path, x) for x in v) + ")" if v else f"json_array_length({_get(r, name, path)}) IS NOT NULL"
        text = "null" if v is None else v if isinstance(v, str) else json.dumps(v)
        at = _get(r, name, path)
        return f"coalesce({at} = {r.value(text)} OR array_contains(from_json({at}, 'array<string>'), {r.value(text)}), FALSE)"

    def text(r):
        if r.dialect.name == "mysql":
            return f"JSON_CONTAINS({r.name(name)}, {r.value(json.dumps(value))}{', ' + repr('$.' + '.'.join(keys)) if keys else ''})"
        if r.dialect.name == "postgres":
            return f"({r.name(name)}{''.join(f'->{k!r}' for k in keys)})::jsonb @> {r.value(json.dumps(value))}::jsonb"
        return holds(r, keys, value)

    return Predicate("json_contains", text, (name,), "@>")


def json_length(col: str, *args) -> Predicate:
    op, n = ("=", args[0]) if len(args) == 1 else (operator(args[0]), args[1])
    name, keys = json_path(col)

    def text(r):
        if r.dialect.name == "mysql":
            return f"JSON_LENGTH({r.name(name)}{', ' + repr('$.' + '.'.join(keys)) if keys else ''}) {op} {r.value(int(n))}"
        if r.dialect.name == "postgres":
            return f"jsonb_array_length({r.name(name)}{''.join(f'->{k!r}' for k in keys)}) {op} {r.value(int(n))}"
        return f"json_array_length({_get(r, name, keys) if keys else r.name(name)}) {op} {r.value(int(n))}"

    return Predicate("json_length", text, (name,), op)


@dataclass(frozen=True)
class Cursor:
    expr: str
    down: bool = False
    raw: bool = False

    def text(self, r: Renderer) -> str:
        return self.expr if self.raw else r.name(parse(self.expr))


def cursor_asc(name: str) -> Cursor:
    return Cursor(str(parse(name)))


def cursor_desc(name: str) -> Cursor:
    return Cursor(str(parse(name)), True)


def cursor_asc_expr(expr: str) -> Cursor:
    return Cursor(fragment(expr), raw=True)


def cursor_desc_expr(expr: str) -> Cursor:
    return Cursor(fragment(expr), True, True)


cursor_asc_alias, cursor_desc_alias = cursor_asc, cursor_desc


def cursor(columns, values, before: bool = False) -> Predicate:
    """Rows after (or before) a keyset: the first column lies beyond, or is equal
    and the second lies beyond, and so on. The first column is compared on its
    own as well, so that a scan can use it."""
    columns, values = list(columns), list(values)
    if not columns or len(columns) != len(values):
        raise InvalidReference("a cursor needs as many values as columns")
    if any(v is None for v in values):
        raise InvalidReference("a cursor value is null")

    def text(r):
        beyond = lambda c, v, eq="": f"{c.text(r)} {('<' if c.down != before else '>')}{eq} {r.value(v)}"
        ways = []
        for i, (c, v) in enumerate(zip(columns, values)):
            ways.append(" AND ".join([*(f"{p.text(r)} = {r.value(w)}" for p, w in zip(columns[:i], values[:i])), beyond(c, v)]))
        either = " OR ".join(f"({w})" for w in ways)
        return f"({beyond(columns[0], values[0], '=')} AND ({either}))" if len(ways) > 1 else f"({either})"

    return Predicate("cursor", text, tuple(parse(c.expr) for c in columns if not c.raw), "CURSOR")
