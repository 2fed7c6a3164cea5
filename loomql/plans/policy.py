"""Table policies: tenant scope, soft delete, personal data and filters that a
query must have; and suppressions of warnings."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field, replace

from loomql.errors import InvalidReference
from loomql.plans.refs import parse, table_of

LEVELS = ["low", "medium", "high", "destructive", "blocked"]
MODES = ("warn", "enforce", "block")


def rank(level: str) -> int:
    return LEVELS.index(level)


def parse_level(text: str) -> str:
    found = str(text).strip().lower()
    if found not in LEVELS:
        raise InvalidReference(f"not a risk level: {text!r}")
    return found


def mode_level(mode: str, fallback: str) -> str:
    """warn leaves a level, enforce raises it to high at least, block blocks."""
    if mode == "block":
        return "blocked"
    return fallback if mode == "warn" or rank(fallback) >= rank("high") else "high"


@dataclass(frozen=True)
class Warning:
    code: str
    level: str
    message: str
    hint: str = ""
    suppressible: bool = True
    table: str = ""
    column: str = ""


@dataclass(frozen=True)
class Suppression:
    code: str
    reason: str
    owner: str = ""
    expires_at: datetime.datetime | None = None


def suppression(code: str, reason: str, owner: str = "", expires_at: datetime.datetime | None = None) -> Suppression:
    if not re.fullmatch(r"[A-Z][A-Z0-9_]*", code.strip()):
        raise InvalidReference(f"not a warning code: {code!r}")
    if not reason.strip():
        raise InvalidReference("a suppression needs a reason")
    return Suppression(code.strip(), reason.strip(), owner, expires_at)


def parse_inline(comment: str) -> Suppression | None:
    """`# loomql:suppress CODE reason="..." owner=... expires=2030-01-01`, or None
    for a comment that isn't one."""
    m = re.match(r"\s*(?:#|//|--)\s*loomql:suppress\b(.*)$", comment)
    if not m:
        return None
    body = m[1].strip()
    code, _, rest = body.partition(" ")
    given = {k: q if q is not None else v for k, q, v in ((k, q or None, v) for k, q, v in re.findall(r'(\w+)=(?:"([^"]*)"|(\S+))', rest))}
    reason = given.get("reason") or re.sub(r'\w+=(?:"[^"]*"|\S+)', "", rest).strip()
    expires = datetime.datetime.fromisoformat(given["expires"]) if given.get("expires") else None
    return suppression(code, reason or "", given.get("owner") or "", expires)


def apply_suppressions(warnings: list[Warning], given: tuple[Suppression, ...], now: datetime.datetime) -> tuple[list[Warning], list[Warning]]:
    """Warnings that stay, with those that bad suppressions add, and the rest."""
    kept, gone = [], []
    naive = lambda t: t.replace(tzinfo=None)
    for w in warnings:
        match = [s for s in given if s.code == w.code]
        live = [s for s in match if s.expires_at is None or naive(s.expires_at) > naive(now)]
        if live and w.suppressible and w.level != "blocked":
            gone.append(w)
            continue
        kept.append(w)
        if live:
            kept.append(Warning("SUPPRESSION_NOT_ALLOWED", "medium", f"{w.code} can't be suppressed", table=w.table))
        elif match:
            kept.append(Warning("SUPPRESSION_EXPIRED", "medium", f"the suppression of {w.code} has expired", table=w.table))
    return kept, gone


@dataclass(frozen=True)
class TablePolicy:
    table: str
    tenant: str = ""
    tenant_mode: str = "enforce"
    soft_delete: str = ""
    soft_delete_mode: str = "enforce"
    pii: tuple[str, ...] = ()
    pii_mode: str = "warn"
    required: tuple[str, ...] = ()
    required_mode: str = "enforce"


REGISTRY: dict[str, TablePolicy] = {}


def key_of(table: str) -> str:
    return str(parse(table, alias=True)).lower()


def register(policy: TablePolicy) -> None:
    for mode in (policy.tenant_mode, policy.soft_delete_mode, policy.pii_mode, policy.required_mode):
        if mode not in MODES:
            raise InvalidReference(f"policy mode {mode!r}")
    REGISTRY[key_of(policy.table)] = policy


def policy_for(table: str) -> TablePolicy | None:
    return REGISTRY.get(key_of(table))


def registered() -> list[TablePolicy]:
    return [REGISTRY[k] for k in sorted(REGISTRY)]


def reset() -> None:
    REGISTRY.clear()


@dataclass(frozen=True)
class PolicyBuilder:
    """Fluent: model(User).tenant_scoped("tenant_id").soft_delete("deleted_at").register()"""

    policy: TablePolicy = field(default_factory=lambda: TablePolicy(""))

    def _set(self, **values) -> "PolicyBuilder":
        return PolicyBuilder(replace(self.policy, **values))

    def table(self, name: str) -> "PolicyBuilder":
        return self._set(table=name)

    def tenant_scoped(self, column: str, mode: str = "enforce") -> "PolicyBuilder":
        return self._set(tenant=column, tenant_mode=mode)

    def soft_delete(self, column: str, mode: str = "enforce") -> "PolicyBuilder":
        return self._set(soft_delete=column, soft_delete_mode=mode)

    def pii(self, *columns: str) -> "PolicyBuilder":
        return self._set(pii=(*self.policy.pii, *columns))

    def required_filter(self, *columns: str) -> "PolicyBuilder":
        return self._set(required=(*self.policy.required, *columns))

    def policy_mode(self, mode: str) -> "PolicyBuilder":
        return self._set(tenant_mode=mode, soft_delete_mode=mode, pii_mode=mode, required_mode=mode)

    def register(self) -> TablePolicy:
        register(self.policy)
        return self.policy


def model(kind: type) -> PolicyBuilder:
    return PolicyBuilder(TablePolicy(table_of(kind)))
