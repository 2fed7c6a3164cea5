"""Static review of Python, SQL and JSON files: builder chains read from the
syntax tree, statements planned, specs validated."""

from __future__ import annotations

import ast
import datetime
import fnmatch
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from loomql.errors import LoomError
from loomql.governance import migration, operation
from loomql.plans.policy import Suppression, parse_inline, parse_level, policy_for, rank, suppression

PRECISIONS = ["unknown", "partial", "precise"]


@dataclass(frozen=True)
class Finding:
    path: str
    line: int
    code: str
    level: str
    message: str
    precision: str = "precise"
    suppressed: bool = False
    reason: str = ""


@dataclass
class Report:
    findings: list[Finding] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    stale: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    def pretty(self) -> str:
        live = [f for f in self.findings if not f.suppressed]
        return "\n".join([f"{len(self.files)} files, {len(live)} findings", *(f"{f.path}:{f.line}: [{f.level}] {f.code}: {f.message}" for f in live)]) + "\n"

    def github(self) -> str:
        kind = lambda f: "error" if rank(f.level) >= rank("high") else "warning"
        return "".join(f"::{kind(f)} file={f.path},line={f.line},title={f.code}::{f.message}\n" for f in self.findings if not f.suppressed)


@dataclass(frozen=True)
class ConfigSuppression:
    rule: Suppression
    paths: tuple[str, ...] = ("*",)


@dataclass(frozen=True)
class Config:
    fail_on: str = "high"
    suppressions: tuple[ConfigSuppression, ...] = ()
    exclude: tuple[str, ...] = ()


def load_config(path: str) -> Config:
    body = json.loads(Path(path).read_text())
    if set(body) - {"fail_on", "suppressions", "exclude"}:
        raise LoomError(f"unknown settings: {sorted(set(body) - {'fail_on', 'suppressions', 'exclude'})}")
    rules = []
    for s in body.get("suppressions", []):
        expires = datetime.datetime.fromisoformat(s["expires"]) if s.get("expires") else None
        rules.append(ConfigSuppression(suppression(s["code"], s["reason"], s.get("owner", ""), expires), tuple(s.get("paths", ["*"]))))
    return Config(parse_level(body.get("fail_on", "high")), tuple(rules), tuple(body.get("exclude", [])))


def chain_of(node: ast.AST) -> list[ast.Call]:
    """The calls of x.a(..).b(..), first to last."""
    out = []
    while isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        out.append(node)
        node = node.func.value
    return out[::-1]


RUNS = {"df", "get", "get_maps", "first", "first_map", "rows"}


def review_python(path: str, text: str) -> list[Finding]:
    out: list[Finding] = []
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        return [Finding(path, e.lineno or 1, "SOURCE_UNREADABLE", "medium", str(e.msg), "unknown")]
    inner = {id(n.func.value) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call) or id(node) in inner:
            continue
        calls = chain_of(node)
        names = [c.func.attr for c in calls]
        raw = [c for c in calls if c.func.attr in ("raw", "execute", "select_one", "select_all", "raw_row")]
        text_of = lambda c: c.args[0].value if c.args and isinstance(c.args[0], ast.Constant) and isinstance(c.args[0].value, str) else None
        for c in raw:
            sql = text_of(c)
            if sql and re.match(r"\s*(?:select|with|insert|update|delete|drop|alter|truncate|create)\b", sql, re.I) and "require_raw_approval" not in names:
                out.append(Finding(path, c.lineno, "RAW_SQL_USED", "high", "raw SQL without an approval"))
                if re.search(r"\b(?:drop|truncate|alter)\b", sql, re.I):
                    out.append(Finding(path, c.lineno, "DESTRUCTIVE_SQL_DETECTED", "destructive", "DROP, TRUNCATE or ALTER"))
        start = next((i for i, n in enumerate(names) if n in ("table", "model", "table_path")), None)
        if start is None:
            continue
        say = lambda code, level, message, precision="precise": out.append(Finding(path, calls[-1].end_lineno or calls[-1].lineno, code, level, message, precision))  # noqa: E731, B023
        wheres = [c for c in calls if "where" in c.func.attr]
        if names[-1] in RUNS:
            if not any(n.startswith("select") or n in ("distinct", "max", "min", "sum", "avg") for n in names):
                say("SELECT_STAR_USED", "medium", "all columns are selected")
            aggregates = any(n in ("max", "min", "sum", "avg", "select_count") for n in names)
            if not any(n in ("limit", "take") for n in names) and not aggregates and names[-1] not in ("first", "first_map"):
                say("LIMIT_MISSING", "medium", "no limit")
        if names[-1] in ("update", "delete"):
            word = names[-1].upper()
            columns = {text_of(c) for c in wheres}
            if not wheres:
                say(f"{word}_WITHOUT_WHERE", "blocked", f"{names[-1]} of all rows", "precise" if start == len(names) - 2 else "partial")
            elif not columns & {"id"} and "with_metadata" not in names:
                say(f"BULK_{word}_DETECTED", "medium", f"{names[-1]} of rows that no key names")
        for c in wheres:
            if "raw" in c.func.attr:
                sql = text_of(c)
                if sql is None:
                    say("RAW_FRAGMENT_DYNAMIC", "high", "a raw fragment that isn't a constant", "partial")
                elif re.sub(r"\s+", "", sql) in ("1=1", "(1=1)"):
                    say("WEAK_PREDICATE", "high", "a predicate that always holds")
        table = text_of(calls[start])
        policy = policy_for(table) if table and re.fullmatch(r"[\w.]+", table) else None
        if policy and names[-1] in RUNS | {"update", "delete", "count"}:
            have = {(text_of(c) or "").rpartition(".")[2] for c in wheres}
            for col, code in [(policy.tenant, "TENANT_FILTER_MISSING"), *((c, "REQUIRED_FILTER_MISSING") for c in policy.required)]:
                if col and col not in have and "tenant_scope" not in text:
                    say(code, "high", f"no predicate on {table}.{col}", "partial" if None in {text_of(c) for c in wheres} else "precise")
    return out


def review_sql(path: str, text: str) -> list[Finding]:
    out, at = [], 0
    for s in migration.split(text):
        line = text[: text.find(s, at)].count("\n") + 1
        at = max(at, text.find(s, at))
        bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", s, flags=re.S).strip()
        word = bare.split(None, 1)[0].lower()
        if word in ("update", "delete"):
            if not re.search(r"\bwhere\b", bare, re.I):
                out.append(Finding(path, line, f"{word.upper()}_WITHOUT_WHERE", "blocked", f"{word} of all rows"))
            elif re.search(r"\bwhere\s*\(?\s*1\s*=\s*1", bare, re.I):
                out.append(Finding(path, line, "WEAK_PREDICATE", "high", "a predicate that always holds"))
        elif word in ("select", "with", "insert"):
            if re.search(r"\bselect\s+\*", bare, re.I):
                out.append(Finding(path, line, "SELECT_STAR_USED", "medium", "all columns are selected"))
        else:
            for step in migration.plan_steps(migration.read_statement(s)).steps:
                if step.risk != "low":
                    out.append(Finding(path, line, step.code, step.risk, step.message or step.kind))
    return out


def review_json(path: str, text: str, manifest: dict | None) -> list[Finding]:
    try:
        body = json.loads(text)
    except ValueError as e:
        return [Finding(path, getattr(e, "lineno", 1), "JSON_UNREADABLE", "medium", str(e), "unknown")]
    if not isinstance(body, dict) or "operation" not in body:
        return []
    if manifest is None:
        return [Finding(path, 1, "MANIFEST_MISSING", "medium", "a spec can't be checked without a manifest", "partial")]
    try:
        refs = {f["value_ref"]: [0] for f in body.get("filters", []) if "value_ref" in f}
        return [Finding(path, 1, w.code, w.level, w.message) for w in operation.validate(operation.parse(body), manifest, refs)]
    except (LoomError, KeyError, TypeError) as e:
        return [Finding(path, 1, "SPEC_INVALID", "high", str(e))]


def _inline(text: str) -> tuple[dict[int, list[Suppression]], list[tuple[int, str]]]:
    by: dict[int, list[Suppression]] = {}
    bad = []
    for i, line in enumerate(text.split("\n"), 1):
        if m := re.search(r"(?:#|//|--)\s*loomql:suppress\b.*$", line):
            try:
                by.setdefault(i, []).append(parse_inline(m[0]))
            except LoomError as e:
                bad.append((i, str(e)))
    return by, bad


def run(paths: list[str], config: Config = Config(), manifest: dict | None = None, freshness: dict | None = None, now: datetime.datetime | None = None) -> Report:
    now = (now or datetime.datetime.now()).replace(tzinfo=None)
    report = Report(stale=bool(freshness and freshness.get("status") == "stale"))
    files = []
    for p in map(Path, paths):
        files += sorted(x for x in p.rglob("*") if x.suffix in (".py", ".sql", ".json")) if p.is_dir() else [p]
    used: set[int] = set()
    for f in files:
        if any(fnmatch.fnmatch(str(f), e) for e in config.exclude):
            continue
        report.files.append(str(f))
        text = f.read_text(errors="replace")
        found = review_python(str(f), text) if f.suffix == ".py" else review_sql(str(f), text) if f.suffix == ".sql" else review_json(str(f), text, manifest)
        inline, bad = _inline(text)
        found += [Finding(str(f), i, "SUPPRESSION_INVALID", "medium", m) for i, m in bad]
        for x in found:
            rules = [s for i in (x.line, x.line - 1) for s in inline.get(i, [])]
            for k, c in enumerate(config.suppressions):
                if c.rule.code == x.code and any(fnmatch.fnmatch(str(f), p) for p in c.paths):
                    rules.append(c.rule)
                    used.add(k)
            live = [s for s in rules if s.code == x.code and (s.expires_at is None or s.expires_at.replace(tzinfo=None) > now)]
            if live and x.level not in ("blocked", "destructive"):
                x = Finding(**asdict(x) | {"suppressed": True, "reason": live[0].reason})
            report.findings.append(x)
    report.findings += lint(config, used, report.files)
    return report


def lint(config: Config, used: set[int], files: list[str]) -> list[Finding]:
    """Suppressions of a configuration that nothing needs, that hold everywhere or
    that say little."""
    out = []
    for k, c in enumerate(config.suppressions):
        if k not in used:
            out.append(Finding("config", 0, "SUPPRESSION_UNUSED", "low", f"{c.rule.code} suppresses nothing"))
        if set(c.paths) & {"*", "**", "**/*"}:
            out.append(Finding("config", 0, "SUPPRESSION_OVERBROAD", "medium", f"{c.rule.code} is suppressed everywhere"))
        if len(c.rule.reason.split()) < 3 or not c.rule.owner:
            out.append(Finding("config", 0, "SUPPRESSION_WEAK", "low", f"{c.rule.code} needs an owner and a fuller reason"))
    return out


def at_or_above(report: Report, level: str) -> bool:
    return any(not f.suppressed and rank(f.level) >= rank(level) for f in report.findings)


def at_or_above_precision(report: Report, precision: str) -> bool:
    return any(not f.suppressed and PRECISIONS.index(f.precision) >= PRECISIONS.index(precision) for f in report.findings)
