"""Manifests: a schema and its policies as one document with fingerprints."""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path

from loomql.errors import InvalidReference
from loomql.plans.policy import TablePolicy, policy_for
from loomql.plans.refs import snake

VERSION = 1


def fingerprint(part) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(part, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _policy(p: TablePolicy | None) -> dict:
    if p is None:
        return {}
    out = {}
    if p.tenant:
        out["tenant"] = {"column": p.tenant, "mode": p.tenant_mode}
    if p.soft_delete:
        out["soft_delete"] = {"column": p.soft_delete, "mode": p.soft_delete_mode}
    if p.pii:
        out["pii"] = {"columns": sorted(p.pii), "mode": p.pii_mode}
    if p.required:
        out["required_filters"] = {"columns": sorted(p.required), "mode": p.required_mode}
    return out


def generate(engine=None, schema: list[dict] | None = None, indexes: dict[str, list[dict]] | None = None, relations: list[dict] | None = None, policies: list[TablePolicy] | None = None, dialect: str = "") -> dict:
    """From an engine's catalog, or from schema rows (table, column, type, nullable)."""
    rows = schema if schema is not None else engine.read_schema()
    given = {p.table.lower(): p for p in policies or []}
    tables: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["table"], r.get("position", 0))):
        t = tables.setdefault(r["table"], {"name": r["table"], "model": "".join(w.capitalize() for w in r["table"].split("_")), "columns": [], "indexes": sorted((indexes or {}).get(r["table"], []), key=lambda i: i.get("name", ""))})
        p = given.get(r["table"].lower()) or policy_for(r["table"])
        c = {"name": r["column"], "type": r["type"], "nullable": bool(r.get("nullable", True)), "primary": bool(r.get("primary", False))}
        if p:
            marks = {"pii": r["column"] in p.pii, "tenant": r["column"] == p.tenant, "soft_delete": r["column"] == p.soft_delete, "required_filter": r["column"] in p.required}
            c |= {k: True for k, v in marks.items() if v}
        if r.get("forbidden"):
            c["forbidden"] = True
        t["columns"].append(c)
        t["policy"] = _policy(p)
    held = {"version": VERSION, "dialect": dialect or getattr(engine, "dialect", ""), "tables": [tables[k] for k in sorted(tables)], "relations": sorted(relations or [], key=lambda r: json.dumps(r, sort_keys=True))}
    held["fingerprints"] = {"schema": fingerprint([{k: v for k, v in t.items() if k != "policy"} for t in held["tables"]]), "policy": fingerprint([t.get("policy") for t in held["tables"]]), "manifest": fingerprint({k: held[k] for k in ("version", "tables", "relations")})}
    return held


def validate(m: dict) -> None:
    if not isinstance(m, dict) or m.get("version") != VERSION:
        raise InvalidReference("not a manifest of this version")
    names = [t.get("name") for t in m.get("tables", [])]
    if any(not n for n in names) or len(set(names)) < len(names):
        raise InvalidReference("tables without a name, or two of one name")
    for t in m["tables"]:
        cols = [c.get("name") for c in t.get("columns", [])]
        if not cols or any(not c for c in cols) or len(set(cols)) < len(cols):
            raise InvalidReference(f"columns of {t['name']}")
        named = [c for k in ("tenant", "soft_delete") if (c := t.get("policy", {}).get(k, {}).get("column"))]
        for k in ("pii", "required_filters"):
            named += t.get("policy", {}).get(k, {}).get("columns", [])
        if set(named) - set(cols):
            raise InvalidReference(f"the policy of {t['name']} names columns that it lacks: {sorted(set(named) - set(cols))}")


def load(path: str) -> dict:
    m = json.loads(Path(path).read_text())
    validate(m)
    return m


def verify(stored: dict, current: dict | None, checked_at: str = "") -> dict:
    """ok or stale for each fingerprint; skipped where there is nothing to compare."""
    if current is None:
        return {"status": "skipped", "checked_at": checked_at, "checks": []}
    checks = []
    for k in ("schema", "policy"):
        a, b = stored.get("fingerprints", {}).get(k), current.get("fingerprints", {}).get(k)
        checks.append({"name": k, "status": "ok" if a == b else "stale", "stored": a, "current": b})
    return {"status": "ok" if all(c["status"] == "ok" for c in checks) else "stale", "checked_at": checked_at, "checks": checks}


def attach(m: dict, verification: dict) -> dict:
    return copy.deepcopy(m) | {"verification": verification}


def pretty(m: dict) -> str:
    lines = [f"manifest {m['version']} ({m.get('dialect') or 'any dialect'}): {len(m['tables'])} tables"]
    for t in m["tables"]:
        lines.append(f"  {t['name']}: {len(t['columns'])} columns" + "".join(f"; {k}: {v.get('column') or ', '.join(v.get('columns', []))} ({v['mode']})" for k, v in t.get("policy", {}).items()))
    if "verification" in m:
        lines.append(f"  freshness: {m['verification']['status']}")
    return "\n".join(lines) + "\n"


def json_schema() -> dict:
    text, flag = {"type": "string"}, {"type": "boolean"}
    column = {"type": "object", "required": ["name", "type"], "properties": {"name": text, "type": text} | dict.fromkeys(("nullable", "primary", "pii", "tenant", "soft_delete", "required_filter", "forbidden"), flag)}
    table = {"type": "object", "required": ["name", "columns"], "properties": {"name": text, "model": text, "columns": {"type": "array", "items": column}, "indexes": {"type": "array"}, "policy": {"type": "object"}}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["version", "tables", "fingerprints"], "properties": {"version": {"const": VERSION}, "dialect": text, "tables": {"type": "array", "items": table}, "relations": {"type": "array"}, "fingerprints": {"type": "object"}}}


KINDS = (("bigint", "int"), ("int", "int"), ("small", "int"), ("double", "float"), ("float", "float"), ("decimal", "Decimal"), ("numeric", "Decimal"), ("bool", "bool"), ("timestamp", "datetime"), ("date", "date"), ("binary", "bytes"))


def repository_skeleton(m: dict, tables: list[str] | None = None) -> str:
    """Python source: a dataclass for each table, and a function that finds a row
    by key with the filters that the policy requires."""
    validate(m)
    out = ["from __future__ import annotations", "", "from dataclasses import dataclass, field", "from datetime import date, datetime", "from decimal import Decimal", ""]
    for t in m["tables"]:
        if tables and t["name"] not in tables:
            continue
        keys = [c["name"] for c in t["columns"] if c.get("primary")] or [t["columns"][0]["name"]]
        out += ["", "@dataclass", f"class {t.get('model') or t['name'].title()}:"]
        for c in t["columns"]:
            kind = next((k for p, k in KINDS if c["type"].lower().startswith(p)), "str")
            out.append(f"    {snake(c['name'])}: {kind}{' | None' if c.get('nullable') else ''} = field(metadata={{'column': {c['name']!r}{', ' + repr('pk') + ': True' if c['name'] in keys else ''}}})")
        out += ["    @staticmethod", "    def table_name() -> str:", f"        return {t['name']!r}", ""]
        p = t.get("policy", {})
        need = list(dict.fromkeys([c for c in [p.get("tenant", {}).get("column")] if c] + p.get("required_filters", {}).get("columns", [])))
        args = list(dict.fromkeys(keys + need))
        shown = ", ".join(repr(c["name"]) for c in t["columns"] if not c.get("pii") and not c.get("forbidden"))
        out += ["", f"def find_{snake(t['name'])}(engine, {', '.join(args)}):", f"    q = engine.table({t['name']!r}).select({shown}).limit(1)"]
        out += [f"    q = q.where({a!r}, {a})" for a in args] + ["    return q.first()", ""]
    return "\n".join(out)
