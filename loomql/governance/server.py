"""A read-only tool server: JSON-RPC, one message a line, over two streams."""

from __future__ import annotations

import json
from dataclasses import asdict

from loomql.errors import LoomError
from loomql.governance import manifest as M
from loomql.governance import migration, operation, review
from loomql.plans.plan import raw_plan
from loomql.plans.policy import LEVELS, registered

RULES = {"SELECT_STAR_USED": "medium", "LIMIT_MISSING": "medium", "UPDATE_WITHOUT_WHERE": "blocked", "BULK_UPDATE_DETECTED": "medium", "DELETE_WITHOUT_WHERE": "blocked", "BULK_DELETE_DETECTED": "medium", "RAW_SQL_USED": "high", "DESTRUCTIVE_SQL_DETECTED": "destructive", "WEAK_PREDICATE": "high", "REQUIRED_PREDICATE_MISSING": "blocked", "TENANT_FILTER_MISSING": "high", "REQUIRED_FILTER_MISSING": "high", "SOFT_DELETE_FILTER_MISSING": "medium", "PII_COLUMN_SELECTED": "medium"}
PROMPTS = {
    "write_query": ("Write a query for a task with the builder, within the manifest.", ["task"]),
    "review_change": ("Review a change for risks, rule by rule.", ["change"]),
    "plan_migration": ("Plan a schema change in steps that can be undone.", ["goal"]),
    "explain_plan": ("Explain a plan's warnings and how to mend them.", ["plan"]),
    "draft_spec": ("Draft an operation spec for a question.", ["question"]),
}


class Server:
    def __init__(self, manifest: dict, engine=None, config: review.Config = review.Config()):
        M.validate(manifest)
        self.manifest, self.engine, self.config = manifest, engine, config
        self.tools = {
            "list_tables": lambda: [t["name"] for t in manifest["tables"]],
            "describe_table": self._table,
            "table_policy": lambda table: self._table(table).get("policy", {}),
            "relations": lambda: manifest.get("relations", []),
            "validate_spec": lambda spec, values=None: [asdict(w) for w in operation.validate(operation.parse(spec), manifest, values)],
            "plan_spec": self._plan,
            "plan_raw_sql": lambda sql: json.loads(raw_plan(sql).to_json()),
            "plan_migration": lambda sql: json.loads(migration.plan_sql(sql).to_json()),
            "review_paths": lambda paths: json.loads(review.run(paths, config, manifest).to_json()),
            "verify_manifest": lambda current: M.verify(manifest, current),
        }
        self.held = {
            "loomql://manifest": lambda: manifest,
            "loomql://manifest/pretty": lambda: M.pretty(manifest),
            "loomql://manifest/schema": M.json_schema,
            "loomql://tables": lambda: manifest["tables"],
            "loomql://policies": lambda: [asdict(p) for p in registered()],
            "loomql://relations": lambda: manifest.get("relations", []),
            "loomql://rules": lambda: RULES,
            "loomql://levels": lambda: LEVELS,
            "loomql://spec/schema": operation.json_schema,
        }

    def _table(self, table: str) -> dict:
        found = next((t for t in self.manifest["tables"] if t["name"] == table), None)
        if found is None:
            raise LoomError(f"no table {table!r}")
        return found

    def _plan(self, spec, values=None) -> dict:
        if self.engine is None:
            raise LoomError("no engine")
        return json.loads(operation.plan_spec(self.engine, spec, self.manifest, values=values).to_json())

    def resources(self) -> list[dict]:
        return [{"uri": u, "name": u.removeprefix("loomql://"), "mimeType": "text/plain" if u.endswith("pretty") else "application/json"} for u in self.held]

    def read_resource(self, uri: str) -> tuple[str, str]:
        if uri not in self.held:
            raise LoomError(f"no resource {uri!r}")
        body = self.held[uri]()
        return (body, "text/plain") if isinstance(body, str) else (json.dumps(body, sort_keys=True), "application/json")

    def call_tool(self, name: str, args: dict | None = None) -> dict:
        """A tool's failure is a result that says so."""
        if name not in self.tools:
            raise LoomError(f"no tool {name!r}")
        try:
            return {"content": [{"type": "text", "text": json.dumps(self.tools[name](**(args or {})), sort_keys=True, default=str)}], "isError": False}
        except (LoomError, TypeError, KeyError, ValueError) as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}

    def prompts(self) -> list[dict]:
        return [{"name": n, "description": d, "arguments": [{"name": a, "required": True} for a in args]} for n, (d, args) in PROMPTS.items()]

    def get_prompt(self, name: str, args: dict | None = None) -> list[dict]:
        if name not in PROMPTS:
            raise LoomError(f"no prompt {name!r}")
        text, needs = PROMPTS[name]
        missing = [a for a in needs if a not in (args or {})]
        if missing:
            raise LoomError(f"missing: {', '.join(missing)}")
        return [{"role": "user", "content": {"type": "text", "text": "\n".join([text, *(f"{a}: {args[a]}" for a in needs), f"tables: {', '.join(t['name'] for t in self.manifest['tables'])}"])}}]

    def handle(self, message: dict) -> dict | None:
        method, params, at = message.get("method"), message.get("params") or {}, message.get("id")
        calls = {
            "initialize": lambda: {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "loomql", "version": "1"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}},
            "ping": dict,
            "tools/list": lambda: {"tools": [{"name": n, "inputSchema": {"type": "object"}, "annotations": {"readOnlyHint": True}} for n in self.tools]},
            "tools/call": lambda: self.call_tool(params.get("name"), params.get("arguments")),
            "resources/list": lambda: {"resources": self.resources()},
            "resources/read": lambda: {"contents": [dict(zip(("text", "mimeType"), self.read_resource(params.get("uri")))) | {"uri": params.get("uri")}]},
            "prompts/list": lambda: {"prompts": self.prompts()},
            "prompts/get": lambda: {"messages": self.get_prompt(params.get("name"), params.get("arguments"))},
        }
        if at is None:
            return None
        if method not in calls:
            return {"jsonrpc": "2.0", "id": at, "error": {"code": -32601, "message": f"no method {method!r}"}}
        try:
            return {"jsonrpc": "2.0", "id": at, "result": calls[method]()}
        except LoomError as e:
            return {"jsonrpc": "2.0", "id": at, "error": {"code": -32602, "message": str(e)}}

    def serve(self, source, sink) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if answer is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()
