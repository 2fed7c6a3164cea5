"""Plans: what a query is about to do, its risks, and the gate before it runs."""

from __future__ import annotations

import dataclasses
import datetime
import json
import re
from dataclasses import dataclass, field

from loomql.errors import ApprovalRequired, Blocked
from loomql.plans.policy import Suppression, TablePolicy, Warning, apply_suppressions, mode_level, policy_for, rank


@dataclass(frozen=True)
class Required:
    """A predicate that a query must have."""

    table: str
    column: str


@dataclass
class QueryPlan:
    operation: str
    sql: str = ""
    params: object = ()
    tables: list[dict] = field(default_factory=list)  # name, alias
    columns: list[str] = field(default_factory=list)
    joins: list[dict] = field(default_factory=list)
    predicates: list[dict] = field(default_factory=list)  # column, qualifier, operator, kind, raw
    limit: int | None = None
    aggregate_only: bool = False
    deleted: str = ""  # with, only: how the soft-delete filter is turned
    required: tuple[Required, ...] = ()
    metadata: list[dict] = field(default_factory=list)  # table, primary_key, unique
    approval_reason: str = ""
    access_reason: str = ""
    warnings: list[Warning] = field(default_factory=list)
    suppressed: list[Warning] = field(default_factory=list)
    risk_level: str = "low"
    precision: str = "precise"
    touched: list[str] = field(default_factory=list)
    estimated_rows: int | None = None

    @property
    def requires_approval(self) -> bool:
        return rank("high") <= rank(self.risk_level) < rank("blocked")

    @property
    def blocked(self) -> bool:
        return self.risk_level == "blocked"

    def to_json(self) -> str:
        body = dataclasses.asdict(self) | {"requires_approval": self.requires_approval, "blocked": self.blocked}
        return json.dumps(body, indent=2, sort_keys=True, default=str)

    def __str__(self) -> str:
        codes = ", ".join(f"{w.code} ({w.level})" for w in self.warnings) or "no warnings"
        return f"{self.operation} on {', '.join(t['name'] for t in self.tables) or 'unknown tables'}: {self.risk_level}; {codes}"


def has_predicate(plan: QueryPlan, table: str, column: str) -> bool:
    """Whether a predicate names the column of that table. An unqualified name
    counts unless another touched table's policy has a column of that name."""
    names = {t["name"].lower(): {t["name"].lower(), t["name"].lower().rpartition(".")[2], (t["alias"] or "").lower()} for t in plan.tables}
    own = names.get(table.lower(), {table.lower()})
    others = [policy_for(t) for t in names if t != table.lower()]
    shared = any(p and column.lower() in {c.lower() for c in (p.tenant, p.soft_delete, *p.required, *p.pii)} for p in others)
    for p in plan.predicates:
        if (p["column"] or "").lower() != column.lower():
            continue
        if p["qualifier"] and p["qualifier"].lower() in own or not p["qualifier"] and not shared:
            return True
    return False


def missing_required(plan: QueryPlan, required) -> list[Required]:
    return [r for r in required if not has_predicate(plan, r.table, r.column)]


def attach_metadata(plan: QueryPlan, metadata: list[dict]) -> None:
    plan.metadata = [*plan.metadata, *metadata]


def by_key(plan: QueryPlan) -> bool:
    """Whether equality predicates hold one row: id, or a whole known key."""
    equal = {p["column"].lower() for p in plan.predicates if p["column"] and p["operator"] in ("=", "IN") and p["kind"] in ("compare", "in") and p["top"]}
    keys = [k for m in plan.metadata for k in (m.get("primary_key") or (), *(m.get("unique") or ())) if k]
    return "id" in equal or any({c.lower() for c in k} <= equal for k in keys)


class RiskEngine:
    """The rules. overrides: code -> level, or None to switch a rule off."""

    def __init__(self, overrides: dict[str, str | None] | None = None):
        self.overrides = overrides or {}

    def check(self, plan: QueryPlan) -> list[Warning]:
        out: list[Warning] = []

        def warn(code, level, message, suppressible=True, **more):
            level = self.overrides.get(code, level)
            if level is not None:
                out.append(Warning(code, level, message, suppressible=suppressible, **more))

        if plan.operation == "select":
            if not plan.aggregate_only and (not plan.columns or any(c == "*" or c.endswith(".*") for c in plan.columns)):
                warn("SELECT_STAR_USED", "medium", "all columns are selected")
            if plan.limit is None and not plan.aggregate_only:
                warn("LIMIT_MISSING", "medium", "no limit")
        if plan.operation in ("update", "delete"):
            word = plan.operation.upper()
            if not plan.predicates:
                warn(f"{word}_WITHOUT_WHERE", "blocked", f"{plan.operation} of all rows", suppressible=False)
            elif not by_key(plan):
                warn(f"BULK_{word}_DETECTED", "medium", f"{plan.operation} of rows that no key names")
        if plan.operation == "raw":
            warn("RAW_SQL_USED", "high", "raw SQL isn't analysed")
        if re.search(r"\b(?:drop|truncate|alter)\b", plan.sql, re.I) and plan.operation in ("raw", "migration"):
            warn("DESTRUCTIVE_SQL_DETECTED", "destructive", "DROP, TRUNCATE or ALTER", suppressible=False)
        for p in plan.predicates:
            if re.sub(r"\s+", "", (p["raw"] or "").lower()) in ("1=1", "(1=1)", "where1=1"):
                warn("WEAK_PREDICATE", "high", "a predicate that always holds")
                break
        if plan.operation == "raw" and "where1=1" in re.sub(r"\s+", "", plan.sql.lower()):
            warn("WEAK_PREDICATE", "high", "a predicate that always holds")
        for r in missing_required(plan, plan.required):
            warn("REQUIRED_PREDICATE_MISSING", "blocked", f"no predicate on {r.table}.{r.column}", suppressible=False, table=r.table, column=r.column)
        return out


def check_policies(plan: QueryPlan, extra: tuple[TablePolicy, ...] = ()) -> list[Warning]:
    out: list[Warning] = []
    for t in plan.tables:
        name = t["name"]
        p = next((x for x in extra if x.table.lower() == name.lower()), None) or policy_for(name)
        if p is None:
            continue
        lacks = lambda c: c and plan.operation != "insert" and not has_predicate(plan, name, c)
        if lacks(p.tenant):
            out.append(Warning("TENANT_FILTER_MISSING", mode_level(p.tenant_mode, "high"), f"no predicate on {name}.{p.tenant}", table=name, column=p.tenant))
        for c in p.required:
            if lacks(c):
                out.append(Warning("REQUIRED_FILTER_MISSING", mode_level(p.required_mode, "high"), f"no predicate on {name}.{c}", table=name, column=c))
        if lacks(p.soft_delete) and plan.deleted != "with":
            out.append(Warning("SOFT_DELETE_FILTER_MISSING", mode_level(p.soft_delete_mode, "medium"), f"no predicate on {name}.{p.soft_delete}", table=name, column=p.soft_delete))
        if p.pii and plan.operation == "select" and not plan.aggregate_only:
            bare = [c.rpartition(".")[2].lower() for c in plan.columns]
            hit = sorted(c for c in p.pii if not bare or "*" in bare or c.lower() in bare)
            if hit:
                out.append(Warning("PII_COLUMN_SELECTED", mode_level(p.pii_mode, "medium"), f"{', '.join(hit)} of {name}" + (f": {plan.access_reason}" if plan.access_reason else ""), table=name, column=", ".join(hit)))
    return out


def finalize(plan: QueryPlan, suppressions: tuple[Suppression, ...] = (), engine: RiskEngine | None = None, now: datetime.datetime | None = None, extra: tuple[TablePolicy, ...] = ()) -> QueryPlan:
    found = (engine or RiskEngine()).check(plan) + check_policies(plan, extra)
    plan.warnings, plan.suppressed = apply_suppressions(found, suppressions, now or datetime.datetime.now())
    plan.risk_level = max((w.level for w in plan.warnings), key=rank, default="low")
    return plan


def ensure_executable(plan: QueryPlan) -> None:
    if plan.blocked:
        raise Blocked("; ".join(f"{w.code}: {w.message}" for w in plan.warnings if w.level == "blocked"))
    if plan.requires_approval and not plan.approval_reason.strip():
        raise ApprovalRequired("; ".join(f"{w.code}: {w.message}" for w in plan.warnings if rank(w.level) >= rank("high")))


def raw_plan(sql: str, params: object = (), approval: str = "", touched: list[str] | None = None, tables: list[str] | None = None) -> QueryPlan:
    plan = QueryPlan("raw", sql, params, precision="unknown", approval_reason=approval)
    plan.tables = [{"name": t, "alias": None} for t in tables or []]
    finalize(plan)
    plan.touched = list(dict.fromkeys(touched or []))
    return plan
