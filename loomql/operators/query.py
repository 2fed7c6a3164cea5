"""The fluent builder. A Query never changes: each method gives another. It
compiles to one statement that Spark analyses with named parameters, so Catalyst
sees filters, joins, subqueries and limits as it would in hand-written code."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, replace
from functools import partial, wraps

from pyspark.sql import DataFrame, Row

from loomql.errors import InvalidReference, NotFound
from loomql.plans import predicates as P
from loomql.plans.plan import QueryPlan, Required, RiskEngine, ensure_executable, finalize
from loomql.plans.policy import Suppression, policy_for, suppression
from loomql.plans.predicates import Predicate, fold
from loomql.plans.refs import Name, column, fragment, operator, outside, parse, pieces, positional
from loomql.plans.render import DIALECTS, Renderer


@dataclass(frozen=True)
class Item:
    """A select item: a column, an aggregate of one, or a raw expression."""

    name: Name | None = None
    function: str = ""
    distinct: bool = False
    raw: str = ""
    values: tuple = ()
    alias: str | None = None

    def value(self, r: Renderer) -> str:
        if self.raw:
            return positional(self.raw, self.values, r.value)
        out = r.name(self.name) if self.name else "*"
        return f"{self.function}({'DISTINCT ' * self.distinct}{out})" if self.function else out

    def text(self, r: Renderer) -> str:
        out = self.value(r)
        alias = self.alias or (self.name.alias if self.name else None)
        return f"{out} AS {r.dialect.quoted(alias)}" if alias else out

    @property
    def label(self) -> str | None:
        """The name by which ORDER BY knows it."""
        return self.alias or (self.name.label if self.name and (self.name.alias or not self.function) else None)

    @property
    def aggregate(self) -> bool:
        return bool(self.function)


@dataclass(frozen=True)
class Term:
    """A term of ON: column with column, or column with value."""

    left: Name
    op: str
    right: Name | None
    value: object = None
    word: str = "AND"

    def text(self, r: Renderer) -> str:
        return f"{r.name(self.left)} {self.op} {r.name(self.right) if self.right else r.value(self.value)}"


@dataclass(frozen=True)
class JoinClause:
    terms: tuple[Term, ...] = ()

    def _add(self, left, op, right, value, word) -> "JoinClause":
        return JoinClause((*self.terms, Term(parse(left), operator(op), parse(right) if right is not None else None, value, word)))

    def on(self, mine: str, condition: str, target: str) -> "JoinClause":
        return self._add(mine, condition, target, None, "AND")

    def or_on(self, mine: str, condition: str, target: str) -> "JoinClause":
        return self._add(mine, condition, target, None, "OR")

    def where(self, col: str, condition: str, value) -> "JoinClause":
        return self._add(col, condition, None, value, "AND")

    def or_where(self, col: str, condition: str, value) -> "JoinClause":
        return self._add(col, condition, None, value, "OR")


@dataclass(frozen=True)
class Join:
    kind: str  # INNER, LEFT, RIGHT, CROSS, LATERAL, LEFT LATERAL
    table: Name | None = None
    sub: "Query | None" = None
    alias: str | None = None
    clause: JoinClause = JoinClause()

    @property
    def label(self) -> str:
        return self.alias or self.table.label

    def text(self, r: Renderer) -> str:
        what = f"({self.sub.nested(r)}) AS {r.dialect.quoted(self.alias)}" if self.sub is not None else r.table(self.table)
        if self.kind == "LATERAL":
            return f" CROSS JOIN LATERAL {what}"
        if self.kind == "LEFT LATERAL":
            return f" LEFT JOIN LATERAL {what} ON TRUE"
        terms = sorted(self.clause.terms, key=lambda t: t.right is None)  # columns before values
        on = "".join(f" {t.word} {t.text(r)}" if i else t.text(r) for i, t in enumerate(terms))
        return f" {self.kind} JOIN {what}" + (f" ON {on}" if on else "")


class Unvalued(Renderer):
    """For a text that is only analysed."""

    def value(self, value) -> str:
        return "(" + ", ".join(map(self.value, value)) + ")" if isinstance(value, (list, tuple, set)) else "NULL"


#: Methods that come in an AND and an OR form, and what makes their predicate.
PAIRS = {
    "where": P.compare,
    "where_raw": P.raw,
    "where_raw_no_args": P.raw,
    "where_in": lambda col, vals: P.among_query(col, vals) if isinstance(vals, Query) else P.among(col, vals),
    "where_not_in": lambda col, vals: P.among_query(col, vals, True) if isinstance(vals, Query) else P.among(col, vals, True),
    "where_in_subquery": P.among_query,
    "where_not_in_subquery": partial(P.among_query, negated=True),
    "where_exists": P.exists,
    "where_not_exists": partial(P.exists, negated=True),
    "where_subquery": P.scalar_query,
    "where_any": partial(P.several, all_of=False),
    "where_all": partial(P.several, all_of=True),
    "where_column": P.column,
    "where_null": P.null,
    "where_not_null": partial(P.null, negated=True),
    "where_between": P.between,
    "where_not_between": partial(P.between, negated=True),
    "where_between_columns": P.between_columns,
    "where_not_between_columns": partial(P.between_columns, negated=True),
    "where_full_text": P.full_text,
    "where_text_search": P.text_search,
    "where_json_text": P.json_text,
    "where_json_has_key": P.json_key,
    "where_json_not_has_key": partial(P.json_key, negated=True),
    "where_json_contains": P.json_contains,
    "where_json_length": P.json_length,
    "where_date": partial(P.date_part, "date"),
    "where_time": partial(P.date_part, "time"),
    "where_day": partial(P.date_part, "day"),
    "where_month": partial(P.date_part, "month"),
    "where_year": partial(P.date_part, "year"),
    "where_cursor_after": P.cursor,
    "where_cursor_before": partial(P.cursor, before=True),
}


@dataclass(frozen=True)
class Query:
    engine: object
    table: Name
    items: tuple[Item, ...] = ()
    unique: bool = False
    where_: tuple[Predicate, ...] = ()
    joins: tuple[Join, ...] = ()
    groups: tuple[Name, ...] = ()
    havings: tuple[tuple[str, Predicate], ...] = ()
    orders: tuple[tuple[str, bool, bool], ...] = ()  # text, down, raw
    limit_: int = 0
    offset_: int = 0
    unions: tuple[tuple["Query", bool], ...] = ()
    lock: str = ""
    approval: str = ""
    suppressions: tuple[Suppression, ...] = ()
    required: tuple[Required, ...] = ()
    reason: str = ""
    deleted: str = ""
    key: tuple[str, ...] = ("id",)
    tag: str = ""
    metadata: tuple[dict, ...] = ()

    # -- projections -------------------------------------------------------
    def select(self, *cols: str) -> "Query":
        return replace(self, items=(*self.items, *(Item(column(c)) for c in cols)))

    def select_raw(self, raw: str, *values, alias: str | None = None) -> "Query":
        positional(fragment(raw), values, lambda v: "")
        return replace(self, items=(*self.items, Item(raw=raw, values=values, alias=alias)))

    def distinct(self, *cols: str) -> "Query":
        """Distinct rows of the columns selected, these among them; columns that
        are counted are counted distinct."""
        names = [column(c) for c in cols]
        items = tuple(replace(i, distinct=True) if i.function == "COUNT" and i.name in names else i for i in self.items)
        counted = {i.name for i in items if i.distinct}
        new = [Item(n) for n in names if n not in counted and n not in {i.name for i in items if not i.function}]
        return replace(self, items=(*items, *new), unique=self.unique or not counted)

    def _aggregate(self, function: str, col: str | None, alias: str | None, distinct: bool = False) -> "Query":
        return replace(self, items=(*self.items, Item(parse(col, star=True) if col else None, function, distinct, alias=alias)))

    def max(self, col: str, alias: str | None = None) -> "Query":
        return self._aggregate("MAX", col, alias)

    def min(self, col: str, alias: str | None = None) -> "Query":
        return self._aggregate("MIN", col, alias)

    def sum(self, col: str, alias: str | None = None) -> "Query":
        return self._aggregate("SUM", col, alias)

    def avg(self, col: str, alias: str | None = None) -> "Query":
        return self._aggregate("AVG", col, alias)

    def select_count(self, col: str | None = None, alias: str | None = None, distinct: bool = False) -> "Query":
        return self._aggregate("COUNT", col, alias, distinct)

    # -- predicates that hold others ----------------------------------------
    def _where(self, p: Predicate, op: str) -> "Query":
        return replace(self, where_=(*self.where_, replace(p, op=op)))

    def _group(self, fn, negated: bool, op: str) -> "Query":
        inner = fn(replace(self, where_=()))
        return self._where(P.group(inner.where_, negated), op)

    def where_group(self, fn) -> "Query":
        return self._group(fn, False, "AND")

    def or_where_group(self, fn) -> "Query":
        return self._group(fn, False, "OR")

    def where_not(self, fn) -> "Query":
        return self._group(fn, True, "AND")

    def or_where_not(self, fn) -> "Query":
        return self._group(fn, True, "OR")

    def where_columns(self, columns) -> "Query":
        return replace(self, where_=(*self.where_, *(P.column(*c) for c in columns)))

    def or_where_columns(self, columns) -> "Query":
        return replace(self, where_=(*self.where_, *(replace(P.column(*c), op="OR") for c in columns)))

    def safe_where_raw(self, raw: str, values: dict) -> "Query":
        return self._where(P.raw(raw, dict(values)), "AND")

    def safe_or_where_raw(self, raw: str, values: dict) -> "Query":
        return self._where(P.raw(raw, dict(values)), "OR")

    # -- joins ----------------------------------------------------------------
    def _join(self, kind: str, table: str, mine=None, cond=None, target=None, fn=None) -> "Query":
        clause = fn(JoinClause()) if fn else JoinClause().on(mine, cond, target) if mine is not None else JoinClause()
        if kind != "CROSS" and not clause.terms:
            raise InvalidReference("a join needs a condition")
        return replace(self, joins=(*self.joins, Join(kind, parse(table, alias=True), clause=clause)))

    def join(self, table: str, local: str, cond: str, target: str) -> "Query":
        return self._join("INNER", table, local, cond, target)

    def left_join(self, table: str, local: str, cond: str, target: str) -> "Query":
        return self._join("LEFT", table, local, cond, target)

    def right_join(self, table: str, local: str, cond: str, target: str) -> "Query":
        return self._join("RIGHT", table, local, cond, target)

    def cross_join(self, table: str) -> "Query":
        return self._join("CROSS", table)

    def join_query(self, table: str, fn) -> "Query":
        return self._join("INNER", table, fn=fn)

    def left_join_query(self, table: str, fn) -> "Query":
        return self._join("LEFT", table, fn=fn)

    def right_join_query(self, table: str, fn) -> "Query":
        return self._join("RIGHT", table, fn=fn)

    def _join_sub(self, kind: str, sub: "Query", alias: str, *on) -> "Query":
        clause = JoinClause().on(*on) if on else JoinClause()
        return replace(self, joins=(*self.joins, Join(kind, sub=sub, alias=parse(alias).last, clause=clause)))

    def join_subquery(self, sub: "Query", alias: str, mine: str, condition: str, target: str) -> "Query":
        return self._join_sub("INNER", sub, alias, mine, condition, target)

    def left_join_subquery(self, sub: "Query", alias: str, mine: str, condition: str, target: str) -> "Query":
        return self._join_sub("LEFT", sub, alias, mine, condition, target)

    def right_join_subquery(self, sub: "Query", alias: str, mine: str, condition: str, target: str) -> "Query":
        return self._join_sub("RIGHT", sub, alias, mine, condition, target)

    def join_lateral(self, sub: "Query", alias: str) -> "Query":
        return self._join_sub("LATERAL", sub, alias)

    def left_join_lateral(self, sub: "Query", alias: str) -> "Query":
        return self._join_sub("LEFT LATERAL", sub, alias)

    # -- groups, order, pages, sets --------------------------------------------
    def group_by(self, *cols: str) -> "Query":
        return replace(self, groups=tuple(parse(c) for c in cols), havings=())

    def _having(self, p: Predicate, op: str) -> "Query":
        if not self.groups:
            raise InvalidReference("having needs group_by first")
        return replace(self, havings=(*self.havings, (op, p)))

    def having(self, col: str, cond: str, value) -> "Query":
        return self if value == "" else self._having(P.compare(col, cond, value), "AND")

    def or_having(self, col: str, cond: str, value) -> "Query":
        return self if value == "" else self._having(P.compare(col, cond, value), "OR")

    def having_raw(self, raw: str, values: dict | None = None) -> "Query":
        return self._having(P.raw(raw, values), "AND")

    def or_having_raw(self, raw: str, values: dict | None = None) -> "Query":
        return self._having(P.raw(raw, values), "OR")

    def order_by(self, col: str, direction: str = "asc") -> "Query":
        way = (direction or "asc").strip().lower()
        if way not in ("asc", "desc"):
            raise InvalidReference(f"order {direction!r}")
        parse(col)
        return replace(self, orders=(*self.orders, (col, way == "desc", False)))

    def order_by_raw(self, raw: str) -> "Query":
        return replace(self, orders=(*self.orders, (fragment(raw), False, True)))

    def re_order(self) -> "Query":
        return replace(self, orders=())

    def limit(self, n: int) -> "Query":
        """0 is no limit."""
        if n < 0:
            raise InvalidReference("a negative limit")
        return replace(self, limit_=n)

    def offset(self, n: int) -> "Query":
        if n < 0:
            raise InvalidReference("a negative offset")
        return replace(self, offset_=n)

    take, skip = limit, offset

    def shared_lock(self) -> "Query":
        """In the text of other dialects only: Spark reads snapshots."""
        return replace(self, lock="LOCK IN SHARE MODE")

    def lock_for_update(self) -> "Query":
        return replace(self, lock="FOR UPDATE")

    def union(self, sub: "Query") -> "Query":
        return replace(self, unions=(*self.unions, (sub, False)))

    def union_all(self, sub: "Query") -> "Query":
        return replace(self, unions=(*self.unions, (sub, True)))

    # -- governance --------------------------------------------------------------
    def require_approval(self, reason: str) -> "Query":
        if not reason.strip():
            raise InvalidReference("an approval needs a reason")
        return replace(self, approval=reason)

    def suppress_warning(self, code: str, reason: str, **more) -> "Query":
        return replace(self, suppressions=(*self.suppressions, suppression(code, reason, **more)))

    def require_predicates(self, *required: Required) -> "Query":
        return replace(self, required=(*self.required, *required))

    def access_reason(self, reason: str) -> "Query":
        return replace(self, reason=reason)

    def with_deleted(self) -> "Query":
        return replace(self, deleted="with")

    def only_deleted(self) -> "Query":
        return replace(self, deleted="only")

    def primary_key(self, *cols: str) -> "Query":
        return replace(self, key=cols)

    def with_context(self, tag: str) -> "Query":
        """Runs under a job tag, which SparkSession.interruptTag(tag) cancels."""
        return replace(self, tag=tag)

    def with_metadata(self, *metadata: dict) -> "Query":
        return replace(self, metadata=(*self.metadata, *metadata))

    # -- compilation ----------------------------------------------------------------
    def scoped(self) -> "Query":
        """With the soft-delete filter of the table's policy. What the caller
        asked for is put in brackets first, so an OR can't get around it."""
        policy = policy_for(str(self.table))
        if not policy or not policy.soft_delete or self.deleted == "with":
            return self
        filter_ = P.null(f"{self.table.label}.{policy.soft_delete}", negated=self.deleted == "only")
        mine = (P.group(self.where_),) if self.where_ else ()
        return replace(self, where_=(*mine, filter_))

    def selected(self) -> tuple[Item, ...]:
        """The items, or all columns where none is named."""
        if self.items or not self.joins:
            return self.items or (Item(),)
        labels = [j.label for j in sorted(self.joins, key=lambda j: "LATERAL" not in j.kind)] + [self.table.label]
        return tuple(Item(Name((x, "*"))) for x in dict.fromkeys(labels))

    def render(self, r: Renderer) -> str:
        q = self.scoped()
        items = [i.text(r) for i in q.selected()]
        sql = f"SELECT {'DISTINCT ' * q.unique}{', '.join(items)} FROM {r.table(q.table)}" + "".join(j.text(r) for j in q.joins)
        if q.where_:
            sql += f" WHERE {fold(q.where_, r)}"
        if q.groups:
            sql += f" GROUP BY {', '.join(map(r.name, q.groups))}"
            for i, (op, p) in enumerate(q.havings):
                sql += f" {op if i else 'HAVING'} {p.text(r)}"
        if q.unions:  # arguments come first, the receiver last, and its order and limit hold for all
            for sub, every in reversed(q.unions):
                sql = f"{_branch(sub, r)} UNION {'ALL ' * every}{sql}"
        if q.orders:
            sql += " ORDER BY " + ", ".join(t if raw else r.order(r.name(parse(t)), down) for t, down, raw in q.orders)
        if q.limit_:
            sql += f" LIMIT {q.limit_}"
        if q.offset_:
            sql += f" OFFSET {q.offset_}"
        if q.lock and r.dialect.name != "spark":
            sql += f" {q.lock}"
        return sql

    def nested(self, r: Renderer) -> str:
        """The text as a part of another query. Where Spark takes a page out of a
        correlated query, it may lose the order, or take one page for all outer
        rows; there the rows are numbered."""
        paged = r.dialect.name == "spark" and (self.limit_ or self.offset_)
        one = not self.groups and self.items and all(i.aggregate for i in self.items)
        around, r.negated = r.negated, False
        text = self._numbered(r) if paged and not one and self._correlated(r) else self.render(r)
        r.negated = around
        return text

    def _correlated(self, r: Renderer) -> bool:
        """It has a name that Spark doesn't find within it."""
        state = self.engine.spark._jsparkSession.sessionState()
        text = self.render(Unvalued(r.dialect, r.like, r.source))
        return not state.analyzer().execute(state.sqlParser().parsePlan(text)).resolved()

    def _numbered(self, r: Renderer) -> str:
        whole = replace(self, orders=(), limit_=0, offset_=0, lock="")
        named = {i.label.lower(): i for i in self.selected() if i.label and i.label != "*"}
        united = self.unique or self.unions  # numbered from outside, by the names of their columns

        def value(item: Item) -> str:
            return r.dialect.quoted(item.label) if united and item.label else item.value(r)

        def by_name(name: Name) -> str:
            if not name.qualifier and name.last.lower() in named:
                return value(named[name.last.lower()])
            if united:
                same = [i for i in self.items if i.name and not i.function and i.name.parts[-len(name.parts) :] == name.parts[-len(i.name.parts) :]]
                return value(same[0]) if same else r.dialect.quoted(name.last)
            return r.name(name)

        def by_text(raw: str) -> str:
            place = re.match(r"\s*(\d+)(?=\s*$|\s+(?:asc|desc|nulls)\b)", raw, re.I)
            if place and 0 < int(place[1]) <= len(self.items):
                return value(self.items[int(place[1]) - 1]) + raw[place.end() :]
            if united or not named:
                return raw
            words = "|".join(map(re.escape, named))
            return outside(raw, rf"(?i:(?<![\w.])(?:{words})(?![\w.(]))", lambda m: f"({value(named[m[0].lower()])})")

        order = [", ".join(map(by_text, pieces(t))) if raw else r.order(by_name(parse(t)), down) for t, down, raw in self.orders]
        place = r.dialect.quoted("_loomql_place")
        number = f"row_number() OVER (ORDER BY {', '.join(order) or 'NULL'})"
        if united:
            rows = f"SELECT *, {number} AS {place} FROM ({whole.render(r)})"
        else:
            rows = replace(whole, items=(*self.selected(), Item(raw=number, alias="_loomql_place"))).render(r)
        bounds = [f"{place} > {self.offset_}"] * bool(self.offset_) + [f"{place} <= {self.offset_ + self.limit_}"] * bool(self.limit_)
        return f"SELECT * EXCEPT ({place}) FROM ({rows}) WHERE {' AND '.join(bounds)}"

    def build(self, dialect: str | None = None) -> tuple[str, object]:
        """Text and arguments, in Spark's SQL or another dialect's."""
        r = self.engine.renderer(dialect)
        return self.render(r), r.arguments()

    dump = build

    def raw_sql(self, dialect: str | None = None) -> str:
        r = self.engine.renderer(dialect)
        r.inline = True
        return self.render(r)

    def plan(self, operation: str = "select") -> QueryPlan:
        q = self.scoped()
        sql, params = self.build()
        tables = [{"name": str(q.table), "alias": q.table.alias}] + [{"name": str(j.table), "alias": j.table.alias} for j in q.joins if j.table]
        found: list[dict] = []

        def gather(ps, top):
            for p in ps:
                single = top and len({x.op for x in ps[1:]} - {"AND"}) == 0
                for n in p.columns or (None,):
                    if p.kind != "group":
                        found.append({"column": n.last if n else None, "qualifier": n.qualifier if n else None, "operator": p.operator, "kind": p.kind, "raw": p.raw, "top": single})
                gather(p.children, single and not p.negated)
                for s in p.subqueries:
                    tables.append({"name": str(s.table), "alias": s.table.alias})

        gather(q.where_, True)
        for j in q.joins:
            for t in j.clause.terms:
                if t.right is None:
                    found.append({"column": t.left.last, "qualifier": t.left.qualifier, "operator": t.op, "kind": "join", "raw": "", "top": False})
        columns = [str(i.name) if i.name else i.raw for i in q.items if not i.function]
        only = bool(q.items) and all(i.aggregate for i in q.items)
        plan = QueryPlan(operation, sql, params, tables, columns, [{"kind": j.kind, "table": j.label} for j in q.joins], found, q.limit_ or None, only, q.deleted, q.required, list(q.metadata), q.approval, q.reason)
        return finalize(plan, q.suppressions, self.engine.risk or RiskEngine())

    def df(self) -> DataFrame:
        """The rows, lazily, once the plan has passed the gate."""
        ensure_executable(self.plan())
        return self.engine.run(*self.build(), tag=self.tag)

    # -- terminal operations ------------------------------------------------------------
    def relation(self) -> "Query":
        """Without its columns, order and page: what a count counts."""
        return replace(self, items=(), orders=(), limit_=0, offset_=0, lock="")

    def count(self, *cols: str) -> int:
        """Rows, or rows where each of the columns isn't null; of a grouped,
        distinct or united query, the rows that it gives."""
        ensure_executable(replace(self, items=(Item(function="COUNT"),)).plan())
        q = self.relation()
        for c in cols:
            q = replace(q, where_=(*((P.group(q.where_),) if q.where_ else ()), P.null(c, negated=True)))
        if self.groups or self.unique or self.unions:
            return self.engine.run(*replace(self, orders=(), lock="").build(), tag=self.tag).count()
        return int(self.engine.run(*replace(q, items=(Item(function="COUNT", alias="n"),)).build(), tag=self.tag).first()["n"])

    def first(self, kind: type | None = None):
        """The first row, as an object of `kind` or a dict. One row is read."""
        rows = self.df().limit(1).collect()
        if not rows:
            raise NotFound(f"no row in {self.table}")
        return self.engine.mapped(rows[0], kind)

    first_map = first

    def get(self, kind: type | None = None) -> list:
        """All rows on the driver: for results that fit there; df() has no such bound."""
        return [self.engine.mapped(row, kind) for row in self.df().collect()]

    get_maps = get

    def rows(self) -> list[Row]:
        return self.df().collect()


def _branch(sub: Query, r: Renderer) -> str:
    text = sub.nested(r)
    return f"({text})" if sub.orders or sub.limit_ or sub.offset_ or sub.unions else text


def _pair(make, op):
    @wraps(make if not isinstance(make, partial) else make.func)
    def method(self, *args, **more):
        return self._where(make(*args, **more), op)

    return method


for _name, _make in PAIRS.items():
    setattr(Query, _name, _pair(_make, "AND"))
    setattr(Query, f"or_{_name}", _pair(_make, "OR"))


def fields_of(item) -> dict:
    """Columns and values of a dict or dataclass."""
    if isinstance(item, dict):
        return dict(item)
    if dataclasses.is_dataclass(item):
        return {f.metadata.get("column", f.name): getattr(item, f.name) for f in dataclasses.fields(item) if f.metadata.get("column") != "-"}
    raise InvalidReference(f"neither a dict nor a dataclass: {item!r}")
