"""Reusable pieces of queries, and plans and runs of scoped queries."""

from __future__ import annotations

from collections.abc import Callable

from loomql.operators.query import Query
from loomql.plans.plan import QueryPlan, Required

Scope = Callable[[Query], Query]


def apply_scopes(q: Query, *scopes: Scope | None) -> Query:
    for s in scopes:
        q = s(q) if s is not None else q
    return q


def compose(*scopes: Scope | None) -> Scope:
    return lambda q: apply_scopes(q, *scopes)


def tenant_scope(tenant, column: str = "tenant_id") -> Scope:
    return lambda q: q.where(column, tenant)


def require_predicates(*required: Required) -> Scope:
    return lambda q: q.require_predicates(*required)


def require_tenant_scope(table: str, column: str = "tenant_id") -> Scope:
    return require_predicates(Required(table, column))


def require_predicate(table: str, column: str) -> Required:
    return Required(table, column)


def cursor_after(columns, *values) -> Scope:
    return lambda q: q.where_cursor_after(columns, values)


def cursor_before(columns, *values) -> Scope:
    return lambda q: q.where_cursor_before(columns, values)


def text_search(columns, term: str) -> Scope:
    return lambda q: q.where_text_search(columns, term)


def plan_select_by(base: Query, *scopes: Scope | None) -> QueryPlan:
    return apply_scopes(base, *scopes).plan()


def select_one_by(base: Query, *scopes: Scope | None, kind: type | None = None):
    return apply_scopes(base, *scopes).first(kind)


def select_all_by(base: Query, *scopes: Scope | None, kind: type | None = None) -> list:
    return apply_scopes(base, *scopes).get(kind)


def plan_update_by(base: Query, data, *scopes: Scope | None) -> QueryPlan:
    from loomql.operators import write

    return write.plan_update(apply_scopes(base, *scopes), data)


def update_by(base: Query, data, *scopes: Scope | None):
    from loomql.operators import write

    return write.update(apply_scopes(base, *scopes), data)


def update_by_returning(base: Query, data, *scopes: Scope | None, kind: type | None = None, options: tuple = ()):
    """The one row that an update changes."""
    from loomql.operators import write

    change = write.update(apply_scopes(base, *scopes), data)
    return write.returned(base.engine, change, kind, options)


def plan_delete_by(base: Query, *scopes: Scope | None) -> QueryPlan:
    return apply_scopes(base, *scopes).plan("delete")


def delete_by(base: Query, *scopes: Scope | None):
    from loomql.operators import write

    return write.delete(apply_scopes(base, *scopes))
