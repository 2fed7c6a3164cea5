"""A strict JSON form of a read-only select, checked against a manifest, that
compiles to a query."""

from __future__ import annotations

import json

from loomql.errors import InvalidReference
from loomql.governance.manifest import validate as validate_manifest
from loomql.operators.query import Query
from loomql.plans.plan import QueryPlan
from loomql.plans.policy import Warning

OPS = {"eq": "=", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="} | {o: o for o in ("=", "!=", "<>", ">", ">=", "<", "<=", "like", "in", "is_null", "is_not_null")}
SPEC = {"operation", "model", "select", "filters", "order_by", "limit", "offset", "access_reason"}
FILTER, ORDER = {"field", "op", "value", "value_ref"}, {"field", "direction"}
MOST = 1000


def parse(text: str | bytes | dict) -> dict:
    """The spec, without unknown fields or repeated keys."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise InvalidReference("a key is given twice")
        return dict(pairs)

    spec = text if isinstance(text, dict) else json.loads(text, object_pairs_hook=once)
    if not isinstance(spec, dict):
        raise InvalidReference("not an object")
    for what, given, known in (("spec", spec, SPEC), *(("filter", f, FILTER) for f in spec.get("filters", [])), *(("order", o, ORDER) for o in spec.get("order_by", []))):
        if set(given) - known:
            raise InvalidReference(f"unknown fields of a {what}: {sorted(set(given) - known)}")
    return spec


def _table(spec: dict, manifest: dict) -> dict:
    found = [t for t in manifest["tables"] if spec.get("model") in (t["name"], t.get("model"))]
    if not found:
        raise InvalidReference(f"no model {spec.get('model')!r}")
    return found[0]


def validate(spec: dict, manifest: dict, values: dict | None = None, freshness: dict | None = None, most: int = MOST) -> list[Warning]:
    """In order: manifest, operation, model, columns named, freshness, columns,
    filters, order, required filters, limit."""
    validate_manifest(manifest)
    if spec.get("operation") != "select":
        raise InvalidReference("only select is an operation")
    table = _table(spec, manifest)
    if not spec.get("select") or "*" in spec["select"]:
        raise InvalidReference("columns must be named")
    warnings: list[Warning] = []
    if freshness and freshness.get("status") == "stale":
        warnings.append(Warning("MANIFEST_STALE", "high", "the manifest is older than the schema"))
    elif freshness is None:
        warnings.append(Warning("MANIFEST_UNVERIFIED", "low", "the manifest's freshness wasn't checked"))
    columns = {c["name"]: c for c in table["columns"]}
    policy = table.get("policy", {})

    def known(name):
        if name not in columns:
            raise InvalidReference(f"no column {name!r} of {table['name']}")
        if columns[name].get("forbidden"):
            raise InvalidReference(f"the column {name!r} of {table['name']} is forbidden")

    for c in spec["select"]:
        known(c)
        if columns[c].get("pii"):
            mode = policy.get("pii", {}).get("mode", "warn")
            if mode == "block" or mode == "enforce" and not spec.get("access_reason"):
                raise InvalidReference(f"the column {c!r} holds personal data")
            warnings.append(Warning("PII_COLUMN_SELECTED", "medium", f"{c} of {table['name']}", table=table["name"], column=c))
    for f in spec.get("filters", []):
        known(f.get("field"))
        if f.get("op") not in OPS:
            raise InvalidReference(f"no filter operator {f.get('op')!r}")
        bare = OPS[f["op"]] in ("is_null", "is_not_null")
        if bare and ("value" in f or "value_ref" in f) or not bare and ("value" in f) == ("value_ref" in f):
            raise InvalidReference(f"a filter on {f['field']} needs one of value and value_ref" if not bare else f"a filter on {f['field']} takes no value")
        if "value_ref" in f and f["value_ref"] not in (values or {}):
            raise InvalidReference(f"no value {f['value_ref']!r}")
        if OPS[f["op"]] == "in" and not isinstance(_value(f, values), list):
            raise InvalidReference(f"the filter on {f['field']} needs a list")
    for o in spec.get("order_by", []):
        known(o.get("field"))
        if o.get("direction", "asc") not in ("asc", "desc"):
            raise InvalidReference(f"order {o.get('direction')!r}")
    held = {f["field"] for f in spec.get("filters", []) if OPS[f["op"]] in ("=", "in")}
    tenant = policy.get("tenant", {})
    for c, mode in [(tenant.get("column"), tenant.get("mode")), *((c, policy["required_filters"]["mode"]) for c in policy.get("required_filters", {}).get("columns", []))]:
        if c and c not in held:
            if mode != "warn":
                raise InvalidReference(f"no filter on {table['name']}.{c}")
            warnings.append(Warning("REQUIRED_FILTER_MISSING", "high", f"no filter on {table['name']}.{c}", table=table["name"], column=c))
    limit = spec.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or not 0 < limit <= most):
        raise InvalidReference(f"a limit is from 1 to {most}")
    return warnings


def _value(f: dict, values: dict | None):
    return f["value"] if "value" in f else (values or {})[f["value_ref"]]


def apply_filter(q: Query, f: dict, values: dict | None = None) -> Query:
    op = OPS[f["op"]]
    if op == "is_null":
        return q.where_null(f["field"])
    if op == "is_not_null":
        return q.where_not_null(f["field"])
    value = _value(f, values)
    return q.where_in(f["field"], value) if op == "in" else q.where(f["field"], op, value)


def compile_spec(engine, spec, manifest: dict, values: dict | None = None, freshness: dict | None = None, most: int = MOST) -> Query:
    spec = parse(spec)
    validate(spec, manifest, values, freshness, most)
    table = _table(spec, manifest)
    q = engine.table(table["name"]).select(*spec["select"])
    for f in spec.get("filters", []):
        q = apply_filter(q, f, values)
    deleted = table.get("policy", {}).get("soft_delete", {}).get("column")
    if deleted and not any(f["field"] == deleted for f in spec.get("filters", [])):
        q = q.where_null(deleted)
    for o in spec.get("order_by", []):
        q = q.order_by(o["field"], o.get("direction", "asc"))
    return q.limit(spec.get("limit", 0)).offset(spec.get("offset", 0)).access_reason(spec.get("access_reason", ""))


def plan_spec(engine, spec, manifest: dict, **more) -> QueryPlan:
    """The plan, with the warnings of both; it isn't run."""
    spec = parse(spec)
    extra = validate(spec, manifest, more.get("values"), more.get("freshness"), more.get("most", MOST))
    plan = compile_spec(engine, spec, manifest, **more).plan()
    have = {(w.code, w.table, w.column) for w in plan.warnings}
    plan.warnings += [w for w in extra if (w.code, w.table, w.column) not in have]
    return plan


def json_schema() -> dict:
    text = {"type": "string"}
    filter_ = {"type": "object", "additionalProperties": False, "required": ["field", "op"], "properties": {"field": text, "op": {"enum": sorted(OPS)}, "value": {}, "value_ref": text}}
    order = {"type": "object", "additionalProperties": False, "required": ["field"], "properties": {"field": text, "direction": {"enum": ["asc", "desc"]}}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False, "required": ["operation", "model", "select"], "properties": {"operation": {"const": "select"}, "model": text, "select": {"type": "array", "minItems": 1, "items": text}, "filters": {"type": "array", "items": filter_}, "order_by": {"type": "array", "items": order}, "limit": {"type": "integer", "minimum": 1}, "offset": {"type": "integer", "minimum": 0}, "access_reason": text}}
