"""Commands: review, migrate, manifest, operation, doctor, serve. `python -m
loomql.cli --help`. Exit codes: 0, 1 findings or a failed check, 2 usage, 3 stale."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from loomql.errors import LoomError
from loomql.governance import manifest as M
from loomql.governance import migration, operation, review
from loomql.governance.server import Server
from loomql.plans.policy import parse_level


def _engine(folder: str):
    from pyspark.sql import SparkSession

    from loomql.sources.engine import open_engine

    return open_engine(SparkSession.builder.getOrCreate(), folder)


def _schema(args) -> dict:
    return migration.schema_of(json.loads(Path(args.schema).read_text()) if args.schema else _engine(args.tables).read_schema())


def run_review(args, out) -> int:
    config = review.load_config(args.config) if args.config else review.Config()
    stored = M.load(args.manifest) if args.manifest else None
    fresh = M.verify(stored, M.load(args.current)) if stored and args.current else None
    report = review.run(args.paths, config, stored, fresh)
    out.write({"json": report.to_json, "github": report.github, "pretty": report.pretty}[args.format]())
    if report.stale:
        return 3
    return int(review.at_or_above(report, parse_level(args.fail_on or config.fail_on)))


def run_migrate(args, out) -> int:
    if args.action == "status":
        s = migration.status(_engine(args.tables), args.files, args.status_table)
        out.write(json.dumps(s) + "\n" if args.format == "json" else migration.status_pretty(s))
        return int(s["dirty"])
    if args.action == "schema":
        out.write(json.dumps(_schema(args), indent=2, sort_keys=True) + "\n")
        return 0
    if args.action == "drift":
        report = migration.drift(migration.schema_of(json.loads(Path(args.desired).read_text())), _schema(args))
        out.write(json.dumps(report) + "\n" if args.format == "json" else migration.drift_pretty(report))
        return int(report["status"] != "ok")
    m = migration.Migrator("\n;\n".join(Path(f).read_text() for f in args.files), mode=args.mode).require_approval(args.approve or "")
    if args.action == "apply":
        engine = _engine(args.tables)
        plan, after = m.apply(engine)
        for name in {s.table for s in plan.steps if s.table in after.tables}:
            from loomql.operators.write import Change, publish

            publish(Change(name, after.frame(name), after.frame(name)), args.to)
    else:
        plan = m.dry_run() if args.action == "dry-run" else m.plan()
    out.write(plan.to_json() + "\n" if args.format == "json" else plan.pretty())
    return int(plan.blocked or plan.requires_approval and not plan.approval_reason)


def run_manifest(args, out) -> int:
    rows = json.loads(Path(args.schema).read_text()) if args.schema else None
    made = M.generate(_engine(args.tables) if rows is None else None, rows)
    if args.action == "generate":
        out.write(json.dumps(made, indent=2, sort_keys=True) + "\n")
        return 0
    if args.action == "skeleton":
        out.write(M.repository_skeleton(made))
        return 0
    result = M.verify(M.load(args.manifest), made)
    out.write(json.dumps(result, indent=2) + "\n")
    return 0 if result["status"] == "ok" else 3


def run_operation(args, out) -> int:
    spec, values = json.loads(Path(args.spec).read_text()), json.loads(Path(args.values).read_text()) if args.values else None
    m = M.load(args.manifest)
    if args.tables:
        out.write(operation.plan_spec(_engine(args.tables), spec, m, values=values).to_json() + "\n")
    else:
        out.write(json.dumps([w.__dict__ for w in operation.validate(operation.parse(spec), m, values)], indent=2) + "\n")
    return 0


def run_doctor(args, out) -> int:
    ok = True
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out.write(f"{name} {__import__(name).__version__}\n")
        except ImportError as e:
            ok = False
            out.write(f"{name} missing: {e}\n")
    if args.manifest:
        try:
            M.load(args.manifest)
            out.write("manifest ok\n")
        except (LoomError, OSError, ValueError) as e:
            ok = False
            out.write(f"manifest: {e}\n")
    return int(not ok)


def run_serve(args, out, source=None) -> int:
    Server(M.load(args.manifest), _engine(args.tables) if args.tables else None).serve(source or sys.stdin, out)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("loomql")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, fn, *options):
        p = sub.add_parser(name)
        for flags, more in options:
            p.add_argument(*flags, **more)
        p.set_defaults(fn=fn)

    pretty = (["--format"], {"choices": ["pretty", "json", "github"], "default": "pretty"})
    opt = lambda *names: [([f"--{n}"], {}) for n in names]
    add("review", run_review, (["paths"], {"nargs": "+"}), pretty, *opt("config", "manifest", "current", "fail-on"))
    add("migrate", run_migrate, (["action"], {"choices": ["plan", "dry-run", "apply", "status", "schema", "drift"]}), (["files"], {"nargs": "*"}), pretty, (["--mode"], {"default": "standard"}), (["--status-table"], {"default": "schema_migrations"}), *opt("approve", "tables", "to", "schema", "desired"))
    add("manifest", run_manifest, (["action"], {"choices": ["generate", "verify", "skeleton"]}), *opt("tables", "schema", "manifest"))
    add("operation", run_operation, (["action"], {"choices": ["compile"]}), (["spec"], {}), *opt("manifest", "values", "tables"))
    add("doctor", run_doctor, *opt("manifest"))
    add("serve", run_serve, *opt("manifest", "tables"))
    return top


def main(argv: list[str] | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        return args.fn(args, out)
    except (LoomError, OSError, ValueError) as e:
        out.write(f"error: {e}\n")
        return 2 if isinstance(e, (OSError, ValueError)) else 1


if __name__ == "__main__":
    sys.exit(main())
