import io
import json

import pytest

from loomql import cli
from loomql.errors import ApprovalRequired, Blocked, InvalidReference
from loomql.governance import manifest as M
from loomql.governance import migration as G
from loomql.governance import operation as O
from loomql.governance import review as R
from loomql.governance.server import Server
from loomql.plans import policy
from loomql.sources.engine import Engine

ROWS = [{"table": "users", "column": c, "type": t, "nullable": n, "primary": c == "id"} for c, t, n in (("id", "bigint", False), ("tenant_id", "bigint", False), ("email", "string", True), ("deleted_at", "timestamp", True))]
POLICY = policy.TablePolicy("users", tenant="tenant_id", soft_delete="deleted_at", pii=("email",))
SPEC = {"operation": "select", "model": "Users", "select": ["id"], "filters": [{"field": "tenant_id", "op": "eq", "value_ref": "t"}], "order_by": [{"field": "id"}], "limit": 10}


@pytest.fixture()
def manifest():
    return M.generate(schema=ROWS, policies=[POLICY], dialect="postgres")


def test_manifest(manifest, tmp_path):
    M.validate(manifest)
    again = M.generate(schema=list(reversed(ROWS)), policies=[POLICY], dialect="postgres")
    assert M.verify(manifest, M.generate(schema=ROWS, policies=[POLICY]))["status"] == "ok" and M.verify(manifest, None)["status"] == "skipped"
    other = M.generate(schema=ROWS[:3], policies=[])
    assert {c["name"]: c["status"] for c in M.verify(manifest, other)["checks"]} == {"schema": "stale", "policy": "stale"}
    assert again["tables"][0]["name"] == "users" and M.attach(manifest, {"status": "ok"})["verification"]["status"] == "ok" and "verification" not in manifest
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert M.load(str(tmp_path / "m.json")) == manifest and "users: 4 columns; tenant: tenant_id (enforce)" in M.pretty(manifest)
    for bad in ({}, {"version": 1, "tables": [{"name": "a", "columns": []}]}, {"version": 1, "tables": [{"name": "a", "columns": [{"name": "b"}], "policy": {"tenant": {"column": "z"}}}]}):
        with pytest.raises(InvalidReference):
            M.validate(bad)
    source = M.repository_skeleton(manifest)
    compile(source, "s", "exec")
    assert "def find_users(engine, id, tenant_id)" in source and "select('id', 'tenant_id', 'deleted_at')" in source
    assert M.json_schema()["required"] == ["version", "tables", "fingerprints"]


def test_spec(manifest, spark):
    e = Engine(spark, {"users": spark.createDataFrame([(1, 7, "a", None), (2, 7, "b", "x"), (3, 8, "c", None)], "id long, tenant_id long, email string, deleted_at string")})
    q = O.compile_spec(e, json.dumps(SPEC), manifest, {"t": 7})
    assert [r["id"] for r in q.df().collect()] == [1]
    plan = O.plan_spec(e, SPEC | {"select": ["id", "email"]}, manifest, values={"t": 7})
    assert {w.code for w in plan.warnings} == {"PII_COLUMN_SELECTED", "MANIFEST_UNVERIFIED"}
    bad = [SPEC | {"x": 1}, SPEC | {"operation": "delete"}, SPEC | {"model": "none"}, SPEC | {"select": ["*"]}, SPEC | {"select": ["none"]}, SPEC | {"filters": []}, SPEC | {"limit": 0}, SPEC | {"limit": 5000}, SPEC | {"order_by": [{"field": "id", "direction": "up"}]}, SPEC | {"filters": [{"field": "tenant_id", "op": "~", "value": 1}]}, SPEC | {"filters": [{"field": "tenant_id", "op": "in", "value": 1}]}, SPEC | {"filters": [{"field": "tenant_id", "op": "is_null", "value": 1}]}]
    for s in bad:
        with pytest.raises(InvalidReference):
            O.compile_spec(e, s, manifest, {"t": 7})
    with pytest.raises(InvalidReference):
        O.compile_spec(e, SPEC, manifest, {})
    with pytest.raises(InvalidReference):
        O.parse('{"operation": "select", "operation": "select"}')
    stale = O.validate(O.parse(SPEC), manifest, {"t": 7}, {"status": "stale"})
    assert [w.code for w in stale] == ["MANIFEST_STALE"] and O.json_schema()["additionalProperties"] is False


STATEMENTS = {
    "CREATE TABLE a (id BIGINT PRIMARY KEY, n VARCHAR(10) NOT NULL DEFAULT 'x;y', CONSTRAINT u UNIQUE (n))": ("add_table", "low"),
    "DROP TABLE IF EXISTS a": ("drop_table", "destructive"),
    "ALTER TABLE a ADD COLUMN b INT": ("add_column", "low"),
    "ALTER TABLE a ADD COLUMN b INT NOT NULL": ("add_column", "high"),
    "ALTER TABLE a ADD b INT NOT NULL DEFAULT 0": ("add_column", "medium"),
    "ALTER TABLE a DROP COLUMN b": ("drop_column", "destructive"),
    "ALTER TABLE a RENAME COLUMN b TO c": ("rename_column", "high"),
    "ALTER TABLE a ALTER COLUMN b TYPE BIGINT": ("alter_type", "high"),
    "ALTER TABLE a ALTER COLUMN b SET NOT NULL": ("alter_nullability", "high"),
    "ALTER TABLE a ALTER COLUMN b DROP NOT NULL": ("alter_nullability", "low"),
    "CREATE INDEX i ON a (b, c)": ("add_index", "medium"),
    "CREATE UNIQUE INDEX CONCURRENTLY i ON a (b)": ("add_index", "low"),
    "DROP INDEX i": ("drop_index", "medium"),
    "VACUUM a": ("unsupported", "blocked"),
}


@pytest.mark.parametrize("sql", STATEMENTS)
def test_statements(sql):
    plan = G.plan_sql(sql + ";")
    assert [(s.kind, s.risk) for s in plan.steps] == [STATEMENTS[sql]] and plan.risk_level == STATEMENTS[sql][1]


def test_split_and_types():
    assert G.split("a 'x;y'; -- c;\n b /* ; */ c; $f$ d; $f$;") == ["a 'x;y'", "-- c;\n b /* ; */ c", "$f$ d; $f$"]
    level = lambda a, b: G.type_change(a, b)[0]
    assert [level("int", "bigint"), level("bigint", "int"), level("varchar(10)", "varchar(20)"), level("varchar(20)", "varchar(10)"), level("varchar(9)", "text"), level("text", "varchar(9)"), level("decimal(10,2)", "decimal(12,2)"), level("decimal(10,2)", "decimal(10,4)"), level("int", "date")] == ["medium", "destructive", "medium", "destructive", "medium", "destructive", "medium", "destructive", "high"]


def test_migrate(spark):
    e = Engine(spark, {"a": spark.createDataFrame([(1, 2)], "id long, n int")})
    m = G.Migrator("ALTER TABLE a ADD COLUMN s VARCHAR(5) DEFAULT 'q', DROP COLUMN n; CREATE TABLE b (x INT)")
    assert m.plan().requires_approval and m.require_approval(" ").approval == ""
    with pytest.raises(ApprovalRequired):
        m.apply(e)
    plan, after = m.require_approval("agreed").apply(e)
    assert after.frame("a").collect()[0].asDict() == {"id": 1, "s": "q"} and after.frame("b").columns == ["x"] and e.frame("a").columns == ["id", "n"]
    assert len(plan.steps) == 3 and '"risk_level": "destructive"' in plan.to_json() and "[destructive] drop_column a.n" in plan.pretty()
    with pytest.raises(Blocked):
        G.Migrator("VACUUM a").require_approval("x").dry_run()
    plan = G.review_mode(G.plan_sql("ALTER TABLE a RENAME n TO m"), "expand_contract")
    assert "BACKFILL_NEEDED" in {w.code for w in plan.warnings}
    with pytest.raises(InvalidReference):
        G.Migrator("ALTER TABLE a ADD COLUMN z INT NOT NULL").require_approval("x").apply(e)


def test_schemas(spark):
    now = G.schema_of([{"table": "a", "column": "x", "type": "int"}, {"table": "a", "column": "y", "type": "int"}, {"table": "b", "column": "q", "type": "int"}])
    want = G.schema_of([{"table": "a", "column": "x", "type": "bigint", "nullable": False}, {"table": "c", "column": "q", "type": "int"}], {"a": [{"name": "i", "columns": ["x"]}]})
    assert [(s.kind, s.risk) for s in G.diff_schemas(now, want).steps] == [("alter_type", "medium"), ("alter_nullability", "high"), ("drop_column", "destructive"), ("add_index", "medium"), ("add_table", "low"), ("drop_table", "destructive")]
    report = G.drift(want, now)
    assert report["status"] == "drift" and "unexpected_column a.y" in G.drift_pretty(report) and G.drift(now, now)["status"] == "ok"
    e = Engine(spark, {"schema_migrations": spark.createDataFrame([("1", False), ("2", True), ("9", False)], "version string, dirty boolean")})
    s = G.status(e, ["001_a.sql", "002_b.sql", "003_c.sql"])
    assert [m["state"] for m in s["migrations"]] == ["applied", "dirty", "pending", "unknown"] and s["dirty"] and "1 pending, dirty" in G.status_pretty(s)


SOURCE = '''
def f(engine, x):
    engine.table("users").get()
    engine.table("users").select("id").where("id", 1).limit(1).df()
    engine.table("users").delete()
    engine.table("users").where("id", 1).where_raw("1=1").update({"a": 1})
    engine.table("users").where_raw(x).delete()
    engine.raw("DROP TABLE users")
    engine.require_raw_approval("ok").raw("SELECT 1")
    # loomql:suppress LIMIT_MISSING reason="three rows only" owner=me
    engine.table("kinds").select("id").df()
'''


def test_review(tmp_path, manifest):
    (tmp_path / "a.py").write_text(SOURCE)
    (tmp_path / "b.sql").write_text("SELECT * FROM a;\nDELETE FROM a;\nUPDATE a SET x = 1 WHERE 1=1;\nDROP TABLE a;")
    (tmp_path / "c.json").write_text(json.dumps(SPEC | {"select": ["none"]}))
    (tmp_path / "d.json").write_text("{")
    report = R.run([str(tmp_path)], R.Config(), manifest)
    found = {(f.path[-4:], f.line, f.code, f.suppressed) for f in report.findings}
    assert {("a.py", 3, "SELECT_STAR_USED", False), ("a.py", 3, "LIMIT_MISSING", False), ("a.py", 5, "DELETE_WITHOUT_WHERE", False), ("a.py", 6, "WEAK_PREDICATE", False), ("a.py", 7, "RAW_FRAGMENT_DYNAMIC", False), ("a.py", 8, "RAW_SQL_USED", False), ("a.py", 8, "DESTRUCTIVE_SQL_DETECTED", False), ("a.py", 11, "LIMIT_MISSING", True)} <= found
    assert not any(p == "a.py" and line in (4, 9) for p, line, _, _ in found)
    assert {(line, c) for p, line, c, _ in found if p == ".sql" or p == "b.sql"[-4:]} == {(1, "SELECT_STAR_USED"), (2, "DELETE_WITHOUT_WHERE"), (3, "WEAK_PREDICATE"), (4, "TABLE_DROPPED")}
    assert {c for p, _, c, _ in found if p == "json"} == {"SPEC_INVALID", "JSON_UNREADABLE"}
    assert R.at_or_above(report, "blocked") and R.at_or_above_precision(report, "precise") and "::error file=" in report.github() and "findings" in report.pretty()
    (tmp_path / "config.txt").write_text(json.dumps({"fail_on": "medium", "suppressions": [{"code": "WEAK_PREDICATE", "reason": "for a test only", "owner": "me", "paths": ["*a.py"]}, {"code": "NONE_SUCH", "reason": "why"}]}))
    config = R.load_config(str(tmp_path / "config.txt"))
    codes = {f.code for f in R.run([str(tmp_path / "a.py")], config).findings if f.path == "config"}
    assert config.fail_on == "medium" and codes == {"SUPPRESSION_UNUSED", "SUPPRESSION_OVERBROAD", "SUPPRESSION_WEAK"}
    assert policy.parse_level("HIGH") == "high"


def test_server(manifest, spark):
    s = Server(manifest, Engine(spark, {"users": spark.createDataFrame([], "id long, tenant_id long, email string, deleted_at string")}))
    assert len(s.resources()) == 9 and len(s.tools) == 10 and len(s.prompts()) == 5
    ask = lambda method, **params: s.handle({"id": 1, "method": method, "params": params})
    assert json.loads(ask("tools/call", name="list_tables")["result"]["content"][0]["text"]) == ["users"]
    assert not ask("tools/call", name="plan_spec", arguments={"spec": SPEC, "values": {"t": 1}})["result"]["isError"]
    assert ask("tools/call", name="describe_table", arguments={"table": "none"})["result"]["isError"]
    assert ask("tools/call", name="none")["error"]["code"] == -32602 and ask("none")["error"]["code"] == -32601
    for r in s.resources():
        assert ask("resources/read", uri=r["uri"])["result"]["contents"][0]["text"]
    assert "users" in s.get_prompt("write_query", {"task": "x"})[0]["content"]["text"] and ask("prompts/get", name="write_query")["error"]
    out = io.StringIO()
    s.serve(io.StringIO('{"id": 1, "method": "ping"}\n\n{"method": "note"}\nnot json\n'), out)
    assert [json.loads(x).get("result", "error") for x in out.getvalue().splitlines()] == [{}, "error"]


def test_cli(tmp_path, manifest, spark):
    def run(*args):
        out = io.StringIO()
        return cli.main(list(args), out), out.getvalue()

    (tmp_path / "m.json").write_text(json.dumps(manifest))
    (tmp_path / "schema.json").write_text(json.dumps(ROWS))
    (tmp_path / "a.sql").write_text("DROP TABLE a")
    (tmp_path / "spec.json").write_text(json.dumps(SPEC))
    (tmp_path / "v.json").write_text('{"t": 1}')
    assert run("review", str(tmp_path / "a.sql"))[0] == 1 and run("review", str(tmp_path / "a.sql"), "--fail-on", "blocked")[0] == 0
    assert run("migrate", "plan", str(tmp_path / "a.sql"))[0] == 1 and run("migrate", "dry-run", str(tmp_path / "a.sql"), "--approve", "yes")[0] == 0
    assert run("migrate", "drift", "--desired", str(tmp_path / "schema.json"), "--schema", str(tmp_path / "schema.json")) == (0, "schema: ok\n")
    assert "users" in run("migrate", "schema", "--schema", str(tmp_path / "schema.json"))[1]
    assert run("manifest", "verify", "--schema", str(tmp_path / "schema.json"), "--manifest", str(tmp_path / "m.json"))[0] == 3
    assert '"version": 1' in run("manifest", "generate", "--schema", str(tmp_path / "schema.json"))[1]
    assert run("operation", "compile", str(tmp_path / "spec.json"), "--manifest", str(tmp_path / "m.json"), "--values", str(tmp_path / "v.json"))[0] == 0
    assert run("doctor", "--manifest", str(tmp_path / "m.json"))[0] == 0 and run("nonsense")[0] == 2
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "t" / "n.parquet"))
    (tmp_path / "b.sql").write_text("ALTER TABLE n ADD COLUMN y INT")
    assert run("migrate", "apply", str(tmp_path / "b.sql"), "--tables", str(tmp_path / "t"), "--to", f"file://{tmp_path}/out")[0] == 0
