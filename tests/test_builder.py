import random
import re
from dataclasses import dataclass, field, replace

import duckdb
import pytest

from loomql.errors import ApprovalRequired, Blocked, InvalidReference, NotFound
from loomql.operators import project, scopes
from loomql.operators.query import Query
from loomql.plans import policy, refs
from loomql.plans.plan import Required, RiskEngine
from loomql.plans.predicates import cursor_asc, cursor_asc_expr, cursor_desc
from loomql.plans.render import MYSQL, POSTGRES, Dialect, register_dialect
from loomql.sources.engine import Engine, driver, open_engine, register_driver

ROWS = [(1, 5, None, "a_b", '{"k": 1, "t": ["x", "y"], "o": {"z": "q"}}'), (2, None, 2.0, "A%B", '{"k": "1"}'), (3, 7, 3.5, None, None), (4, 5, None, "the cat sat", "[1, 2]"), (5, 1, -1.0, "The dog", '{"t": []}')]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, {"t": spark.createDataFrame(ROWS, "id long, a int, b double, s string, j string"), "u": spark.createDataFrame([(1, 9), (3, None)], "t_id long, v int")})


@pytest.fixture(autouse=True)
def clean():
    policy.reset()
    yield
    policy.reset()


def ids(q: Query) -> list[int]:
    return sorted(r["id"] for r in q.select("id").df().collect())


def test_nulls_match_nothing(engine):
    t = engine.table("t")
    assert ids(t.where("a", None)) == []
    assert ids(t.where_not(lambda g: g.where("a", 5))) == [3, 5]
    assert ids(t.where_not_in("a", [5])) == [3, 5]
    assert ids(t.where_in("a", [])) == [] and ids(t.where_not_in("a", [])) == [1, 2, 3, 4, 5]
    assert ids(t.where_not_in_subquery("id", engine.table("u").select("v"))) == []  # a null in the subquery
    assert ids(t.where_not_exists(engine.table("u").where_column("u.t_id", "t.id"))) == [2, 4, 5]
    assert ids(t.where_between("b", 0, 3)) == [2] and ids(t.where_not_between("b", 0, 3)) == [3, 5]


def test_json(engine):
    t = engine.table("t")
    assert ids(t.where_json_text("j", "k", 1)) == [1, 2]
    assert ids(t.where_json_text("j->o", "z", "q")) == [1]
    assert ids(t.where_json_has_key("j", "t")) == [1, 5]
    assert ids(t.where_json_not_has_key("j", "t")) == [2]
    assert ids(t.where_json_contains("j", {"t": ["y"], "o": {"z": "q"}})) == [1]
    assert ids(t.where_json_contains("j->t", "x")) == [1]
    assert ids(t.where_json_length("j->t", ">=", 0)) == [1, 5] and ids(t.where_json_length("j->t", 2)) == [1]


def test_text(engine, spark):
    t = engine.table("t")
    assert ids(t.where_text_search(["s"], "a_b")) == [1] and ids(t.where_text_search(["s"], "a%b")) == [2]
    mysql = replace(engine, dialect="mysql", views={})
    assert ids(mysql.table("t").where_text_search(["s"], "a%b")) == []
    for bad in ("", "  "):
        with pytest.raises(InvalidReference):
            t.where_text_search(["s"], bad)
    assert ids(t.where_full_text(["s"], "the")) == [4, 5]
    assert ids(t.where_full_text(["s"], "cat sat", {"mode": "phrase"})) == [4]
    assert ids(t.where_full_text(["s"], "+the -dog", {"mode": "boolean"})) == [4]
    assert ids(t.where_full_text(["s"], '"the dog" or cat', {"mode": "websearch"})) == [4, 5]
    assert ids(t.where_full_text(["s"], "dog cat", {"mode": "natural"})) == [4, 5]


def test_order_of_nulls_follows_the_dialect(engine):
    order = lambda e, way: [r["a"] for r in e.table("t").select("a").order_by("a", way).df().collect()]
    assert order(engine, "asc") == [1, 5, 5, 7, None] and order(engine, "desc") == [None, 7, 5, 5, 1]
    mysql = replace(engine, dialect="mysql", views={})
    assert order(mysql, "asc") == [None, 1, 5, 5, 7] and order(mysql, "desc") == [7, 5, 5, 1, None]


def test_random_predicates_against_sql(engine, spark):
    con = duckdb.connect()
    con.sql("create table t(id bigint, a int, b double)")
    con.executemany("insert into t values (?, ?, ?)", [r[:3] for r in ROWS])
    rng = random.Random(3)

    def leaf(q, op):
        prefix = "or_" if op else ""
        col, v = rng.choice([("a", rng.randint(0, 8)), ("b", rng.choice([-1.0, 2.0, 3.5])), ("id", rng.randint(1, 5))])
        kind = rng.randrange(4)
        if kind == 0:
            o = rng.choice(["=", "<>", "<", ">="])
            return getattr(q, f"{prefix}where")(col, o, v), f"{col} {o} {v}"
        if kind == 1:
            return getattr(q, f"{prefix}where_null")(col), f"{col} IS NULL"
        if kind == 2:
            return getattr(q, f"{prefix}where_not_in")(col, [v, 5]), f"{col} NOT IN ({v}, 5)"
        return getattr(q, f"{prefix}where_between_columns")("a", "id", "b"), "a BETWEEN id AND b"

    def tree(q, depth):
        text = ""
        for i in range(rng.randint(1, 3)):
            op = bool(i and rng.random() < 0.5)
            word = (" OR " if op else " AND ") if i else ""
            if depth and rng.random() < 0.4:
                negated, held = rng.random() < 0.5, []

                def inner(g, held=held):
                    g, s = tree(g, depth - 1)
                    held.append(s)
                    return g

                q = getattr(q, ("or_" if op else "") + ("where_not" if negated else "where_group"))(inner)
                text += word + ("NOT " if negated else "") + f"({held[0]})"
            else:
                q, s = leaf(q, op)
                text += word + s
        return q, text

    for _ in range(60):
        q, text = tree(engine.table("t"), 2)
        assert ids(q) == [r[0] for r in con.sql(f"select id from t where {text} order by id").fetchall()], text


def test_texts_of_other_dialects(engine):
    q = engine.table("users as u").select("u.name").where("u.age", ">", 3).or_where_in("u.id", [1, 2]).order_by("name", "desc").limit(5).lock_for_update()
    assert q.build("mysql") == ("SELECT `u`.`name` FROM `users` AS `u` WHERE `u`.`age` > ? OR `u`.`id` IN (?, ?) ORDER BY `name` DESC LIMIT 5 FOR UPDATE", [3, 1, 2])
    assert q.build("postgres") == ('SELECT "u"."name" FROM "users" AS "u" WHERE "u"."age" > $1 OR "u"."id" IN ($2, $3) ORDER BY "name" DESC LIMIT 5 FOR UPDATE', [3, 1, 2])
    assert q.raw_sql("mysql").startswith("SELECT `u`.`name` FROM `users` AS `u` WHERE `u`.`age` > 3 OR")
    assert MYSQL.placeholder(4) == "?" and POSTGRES.placeholder(4) == "$4" and MYSQL.quoted("a`b") == "`a``b`" and POSTGRES.quoted('a"b') == '"a""b"'
    m = engine.table("t").where_json_contains("j->t", 1).where_month("d", "=", "3").where_full_text(["s"], "x")
    assert "JSON_CONTAINS" in m.build("mysql")[0] and "MONTH(" in m.build("mysql")[0] and "MATCH (" in m.build("mysql")[0]
    assert "@>" in m.build("postgres")[0] and "EXTRACT(MONTH" in m.build("postgres")[0] and "plainto_tsquery" in m.build("postgres")[0]
    register_dialect("other", Dialect("other", '"', True))
    assert engine.table("t").where("a", 1).build("other") == ('SELECT * FROM "t" WHERE "a" = ?', [1])
    with pytest.raises(InvalidReference):
        engine.table("t").build("none")


def test_what_is_refused(engine):
    t = engine.table("t")
    for call in (lambda: t.select("count(a)"), lambda: t.where("a", "~", 1), lambda: t.where_raw("a = 1; drop table t"), lambda: t.where_raw("a -- x"), lambda: t.order_by("a", "up"), lambda: t.limit(-1), lambda: t.where("a.b.c.d", 1), lambda: t.select_raw("a + ?"), lambda: t.where_raw("a = :x", {"y": 1}), lambda: t.where_month("a", "=", "x"), lambda: t.having("a", "=", 1), lambda: t.where_cursor_after([cursor_asc("a")], [None]), lambda: t.where_cursor_after([], []), lambda: t.where("a", object()).df(), lambda: t.join("u", "a", "like x", "b"), lambda: engine.table("1 or 1")):
        with pytest.raises(InvalidReference):
            call()
    assert ids(t.where("s", "a.id")) == []  # a value is never a column


def test_placeholders():
    put = lambda v: f"<{v}>"
    assert refs.named("a = :x and b = ':x' and c::int = :y -- :x", {"x": 1, "y": 2}, put) == "a = <1> and b = ':x' and c::int = <2> -- :x"
    assert refs.named(":x", {}, put) == ":x" and refs.positional("a = ? and '?'", (1,), put) == "a = <1> and '?'"
    assert refs.snake("HTTPSUrl") == "https_url" and refs.snake("userID") == "user_id"


def test_count_first_get(engine):
    t = engine.table("t")
    assert t.count() == 5 and t.count("a") == 4 and t.where("a", 5).limit(1).count() == 2
    assert t.distinct("a").count() == 4 and t.group_by("a").select("a").count() == 4
    assert t.select("a").union_all(t.select("a")).count() == 10
    with pytest.raises(NotFound):
        t.where("id", 99).first()
    assert t.select("id", "a").where("id", 3).first_map() == {"id": 3, "a": 7}

    @dataclass
    class T:
        id: int
        a: int | None

    assert t.select("id", "a").order_by("id").get(T)[:2] == [T(1, 5), T(2, None)]
    assert engine.model(T).table.last == "ts"


def test_keyset_pages_meet(engine):
    cols = [cursor_desc("a"), cursor_asc("id")]
    rows = sorted(((r[1], r[0]) for r in ROWS if r[1] is not None), key=lambda r: (-r[0], r[1]))
    for i, (a, id_) in enumerate(rows):
        assert ids(engine.table("t").where_cursor_after(cols, [a, id_])) == sorted(r[1] for r in rows[i + 1 :])
        assert ids(engine.table("t").where_cursor_before(cols, [a, id_])) == sorted(r[1] for r in rows[:i])
    assert ids(engine.table("t").where_cursor_after([cursor_asc_expr("id + 1")], [5])) == [5]


def test_joins_default_columns_and_self_join(engine):
    q = engine.table("t").left_join("u", "t.id", "=", "u.t_id")
    assert q.df().columns == ["t_id", "v", "id", "a", "b", "s", "j"]
    assert engine.table("t as x").join("t as y", "x.a", "=", "y.a").select("x.id as l", "y.id as r").df().count() == 6
    sub = engine.table("u").select("t_id").where_not_null("v")
    assert ids(engine.table("t").right_join_subquery(sub, "w", "t.id", "=", "w.t_id")) == [1]
    assert ids(engine.table("t").join_subquery(sub, "w", "t.id", "=", "w.t_id")) == [1]


def test_risks_and_gate(engine):
    t = engine.table("t")
    codes = lambda p: {w.code: w.level for w in p.warnings}
    assert codes(t.plan()) == {"SELECT_STAR_USED": "medium", "LIMIT_MISSING": "medium"}
    assert codes(t.select("id").limit(1).plan()) == {} and codes(t.max("a").plan()) == {}
    assert codes(t.plan("delete")) == {"DELETE_WITHOUT_WHERE": "blocked"}
    assert codes(t.where("a", 1).plan("update")) == {"BULK_UPDATE_DETECTED": "medium"} and codes(t.where("id", 1).plan("update")) == {}
    assert codes(t.where("a", 1).with_metadata({"table": "t", "unique": [("a",)]}).plan("delete")) == {}
    assert codes(t.where("id", 1).or_where("a", 2).plan("delete")) == {"BULK_DELETE_DETECTED": "medium"}
    weak = t.select("id").limit(1).where_raw_no_args("(1 = 1)")
    assert codes(weak.plan()) == {"WEAK_PREDICATE": "high"} and weak.plan().requires_approval
    with pytest.raises(ApprovalRequired):
        weak.df()
    assert weak.require_approval("a test").df().count() == 1
    with pytest.raises(Blocked):
        t.require_predicates(Required("t", "a")).df()
    assert ids(scopes.apply_scopes(t, scopes.compose(scopes.require_tenant_scope("t", "a"), None, scopes.tenant_scope(5, "a")))) == [1, 4]
    off = replace(engine, risk=RiskEngine({"LIMIT_MISSING": None, "SELECT_STAR_USED": "low"}), views={})
    assert codes(off.table("t").plan()) == {"SELECT_STAR_USED": "low"}
    assert '"risk_level": "medium"' in t.plan().to_json() and "medium" in str(t.plan())


def test_suppressions(engine):
    import datetime

    q = engine.table("t").select("id")
    assert q.suppress_warning("LIMIT_MISSING", "small table").plan().warnings == []
    old = datetime.datetime(2020, 1, 1)
    assert {w.code for w in q.suppress_warning("LIMIT_MISSING", "was small", expires_at=old).plan().warnings} == {"LIMIT_MISSING", "SUPPRESSION_EXPIRED"}
    d = engine.table("t").suppress_warning("DELETE_WITHOUT_WHERE", "no")
    assert {w.code for w in d.plan("delete").warnings} == {"DELETE_WITHOUT_WHERE", "SUPPRESSION_NOT_ALLOWED"}
    s = policy.parse_inline('# loomql:suppress LIMIT_MISSING reason="tiny table" owner=me expires=2030-01-01')
    assert (s.code, s.reason, s.owner, s.expires_at.year) == ("LIMIT_MISSING", "tiny table", "me", 2030)
    assert policy.parse_inline("# a comment") is None
    with pytest.raises(InvalidReference):
        policy.parse_inline("# loomql:suppress LIMIT_MISSING")


def test_policies(engine):
    @dataclass
    class T:
        id: int

        @staticmethod
        def table_name():
            return "t"

    policy.model(T).tenant_scoped("a").pii("s").required_filter("b").policy_mode("enforce").register()
    codes = lambda q: {w.code: w.level for w in q.plan().warnings}
    t = engine.table("t").limit(1)
    assert codes(t.select("id", "s")) == {"TENANT_FILTER_MISSING": "high", "REQUIRED_FILTER_MISSING": "high", "PII_COLUMN_SELECTED": "high"}
    assert codes(t.select("id").where("a", 1).where("t.b", 1)) == {} and codes(t.select("id").where("u.a", 1).where("b", 1)) == {"TENANT_FILTER_MISSING": "high"}
    policy.model(T).tenant_scoped("a", "block").register()
    with pytest.raises(Blocked):
        t.select("id").df()
    policy.model(T).tenant_scoped("a", "warn").register()
    assert codes(t.select("id"))["TENANT_FILTER_MISSING"] == "high"
    policy.model(T).soft_delete("b").register()
    assert ids(engine.table("t").where("id", 1).or_where("id", 2)) == [1]  # b is the time of deletion
    assert ids(engine.table("t").only_deleted()) == [2, 3, 5] and len(ids(engine.table("t").with_deleted())) == 5
    assert [p.table for p in policy.registered()] == ["t"] and policy.policy_for("T").soft_delete == "b"
    assert policy.mode_level("warn", "medium") == "medium" and policy.mode_level("enforce", "medium") == "high" and policy.mode_level("block", "low") == "blocked"


def test_raw(engine):
    with pytest.raises(ApprovalRequired):
        engine.raw("SELECT 1")
    e = engine.require_raw_approval("a report").touched_tables("x", "X", "y")
    assert e.select_one("SELECT id FROM {t} WHERE id = ?", 3) == {"id": 3} and len(e.select_all("SELECT * FROM {t}")) == 5
    plan = e.raw_plan("DROP TABLE t")
    assert plan.risk_level == "destructive" and plan.touched == ["X", "y"]
    assert [t["name"] for t in e.raw_plan("SELECT * FROM a.b JOIN c ON true").tables] == ["a.b", "c"]
    with pytest.raises(NotFound):
        e.raw_row("SELECT * FROM {t} WHERE id = 99")


def test_engine(spark, engine, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "n.parquet"))
    assert open_engine(spark, str(tmp_path)).table("n").count() == 3
    register_driver("own", lambda s, a: {a: s.range(2)}, "mysql")
    e = open_engine(spark, "w", "own")
    assert driver("own") and e.dialect == "mysql" and e.table("w").where("id", 1).count() == 1
    with pytest.raises(InvalidReference):
        open_engine(spark, "w", "none")
    assert engine.read_schema("u") == [{"table": "u", "column": "t_id", "type": "bigint", "nullable": True, "position": 1}, {"table": "u", "column": "v", "type": "int", "nullable": True, "position": 2}]
    assert engine.table("t").with_context("job").count() == 5
    e.close()


def test_projection_refuses_unknown_columns(engine):
    @dataclass
    class P:
        id: int
        note: str = field(default="", metadata={"column": "s"})

    assert project.apply_projection(engine.table("t"), P, {"id": "id"}).df().columns == ["id", "s"]
    with pytest.raises(InvalidReference):
        project.apply_projection(engine.table("t"), P, {"x": "id"})
    with pytest.raises(Exception, match="two aggregate rows"):
        project.hydrate(engine.frame("u"), engine.frame("u").union(engine.frame("u")), ["t_id"]).collect()
    assert project.hydrate_rows([{"k": 1}, {"k": 2}], [{"k": 1, "n": 3}], lambda r: r["k"]) == [{"k": 1, "n": 3}, {"k": 2}]


def test_pages_of_correlated_queries(spark):
    """Spark loses the order by columns that aren't selected, and takes one page for
    all outer rows where a correlated column is cast."""
    con = duckdb.connect()
    con.sql("create table c as select * from (values (1, 6), (2, 19), (3, 30), (NULL, 40)) t(k, m)")
    con.sql("create table o as select CASE WHEN id % 7 = 0 THEN NULL ELSE id % 3 + 1 END AS g, id AS v, CASE WHEN id % 5 = 0 THEN NULL ELSE id * 7 % 11 END AS p from range(40) t(id)")
    o = spark.sql("select if(id % 7 = 0, NULL, id % 3 + 1) AS g, id AS v, if(id % 5 = 0, NULL, id * 7 % 11) AS p from range(0, 40, 1, 4)")
    e = Engine(spark, {"c": spark.createDataFrame([(1, 6), (2, 19), (3, 30), (None, 40)], "k int, m long"), "o": o})
    all_, rows = e.table("o").where_column("o.g", "c.k"), e.table("o").select("v").where_column("o.g", "c.k")
    down, sql = rows.order_by("p", "desc").order_by("v"), "select v from o where g = k"
    for sub, text in (
        (down.limit(2), f"{sql} order by p desc nulls first, v limit 2"),
        (rows.order_by("o.p").order_by("v").limit(2).offset(3), f"{sql} order by p nulls last, v limit 2 offset 3"),
        (rows.order_by("v").offset(5), f"{sql} order by v offset 5"),
        (rows.limit(50), sql),
        (all_.order_by("o.v", "desc").limit(1), "select * from o where g = k order by v desc limit 1"),
        (all_.distinct("p").order_by("o.p").limit(2), "select distinct p from o where g = k order by p nulls last limit 2"),
        (all_.select("g as p", "v").order_by_raw("coalesce(p, 0), -v").limit(2), "select * from (select g as p, v from o where g = k) order by coalesce(p, 0), -v limit 2"),
        (all_.select("p", "v").order_by_raw("1 desc nulls last, v").limit(2), "select p, v from o where g = k order by 1 desc nulls last, v limit 2"),
        (all_.select("p").select_count(alias="n").group_by("p").having("p", ">=", 0).order_by("n", "desc").order_by_raw("max(v) desc").limit(2), "select p, count(*) as n from o where g = k group by p having p >= 0 order by n desc, max(v) desc limit 2"),
        (rows.union_all(all_.select("p as v").order_by("p").limit(1)).order_by("v", "desc").limit(3), f"(select p as v from o where g = k order by p limit 1) union all {sql} order by v desc nulls first limit 3"),
        (e.table("o").select("v").where_column("o.g", "<", "c.k").order_by("p").order_by("v").limit(3), "select v from o where g < k order by p nulls last, v limit 3"),
        (e.table("o").select("v").order_by("p").order_by("v").limit(2), "select v from o order by p nulls last, v limit 2"),
    ):
        for q, join in ((e.table("c").join_lateral(sub, "x"), "cross join lateral"), (e.table("c").left_join_lateral(sub, "x"), "left join lateral")):
            want = con.sql(f"select m, x.* from c {join} ({text}) x{' on true' * ('left' in join)}").fetchall()
            assert sorted(repr(tuple(r)) for r in q.select("m", "x.*").rows()) == sorted(map(repr, want)), (join, text)
    m = lambda q: sorted(r["m"] for r in q.select("m").rows())
    assert m(e.table("c").where_subquery("m", "=", rows.order_by("p").order_by("v").offset(1).limit(1))) == [19] == [r[0] for r in con.sql(f"select m from c where m = ({sql} order by p nulls last, v limit 1 offset 1)").fetchall()]
    assert m(e.table("c").where_in_subquery("m", rows.order_by("v").limit(3))) == [6] == [r[0] for r in con.sql(f"select m from c where m in ({sql} order by v limit 3)").fetchall()]
    assert "TakeOrderedAndProject" in e.table("c").join_subquery(e.table("o").select("v").order_by("p").limit(2), "x", "k", "=", "x.v").df()._jdf.queryExecution().toString()
    plan = e.table("c").join_lateral(down.limit(2), "x").select("m", "x.v").df()._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\([^\n]*\bp#\d+L DESC NULLS FIRST, v#", plan) and "Sort" not in plan


def test_not_in_queries_join_by_equality(spark):
    """Over nulls on both sides, in all places, as SQL has it; and no plan compares
    each row with each, or sends a whole subquery to every task."""
    con = duckdb.connect()
    con.sql("create table x as select id, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 10 END AS a from range(40) t(id)")
    con.sql("create table y as select id AS n, CASE WHEN id % 6 = 5 THEN NULL ELSE id % 7 END AS v from range(30) t(id)")
    e = Engine(spark, {"x": spark.sql("select id, if(id % 4 = 0, NULL, id % 10) AS a from range(40)"), "y": spark.sql("select id AS n, if(id % 6 = 5, NULL, id % 7) AS v from range(30)")})
    y = e.table("y").select("v")
    subs = [(y, "select v from y"), (y.where("n", "<", 5), "select v from y where n < 5"), (y.where("n", "<", 0), "select v from y where n < 0"), (y.where_null("v"), "select v from y where v is null"), (y.where_column("n", "<", "x.id"), "select v from y where n < x.id"), (y.where("n", "<", 5).where_not_in("v", y.where("n", 2)), "select v from y where n < 5 and v not in (select v from y where n = 2)"), (y.where_column("n", "<", "x.id").order_by("n").limit(3), "select v from y where n < x.id order by n limit 3")]
    x = e.table("x")
    nots = lambda q, p: q.where_not(lambda g: g.where("id", "<", 3).or_where_in_subquery("a", p))
    for sub, text in subs:
        for q, sql in (
            (x.where_not_in_subquery("a", sub), f"a not in ({text})"),
            (x.where("id", "<", 3).or_where_not_in_subquery("a", sub), f"id < 3 or a not in ({text})"),
            (x.where_not(lambda g: g.where_in("a", sub)), f"not (a in ({text}))"),
            (x.where_not(lambda g: g.where_not_in("a", sub).where("id", ">", 3)), f"not (a not in ({text}) and id > 3)"),
            (nots(x, sub).or_where("id", 39), f"not (id < 3 or a in ({text})) or id = 39"),
            (x.where_not(lambda g: nots(g, sub).or_where("id", 39)), f"not (not (id < 3 or a in ({text})) or id = 39)"),
            (x.where_null("a").or_where_not(lambda g: g.where_not(lambda h: h.where_not_in("a", sub))), f"a is null or not (not (a not in ({text})))"),
        ):
            want = [r[0] for r in con.sql(f"select id from x where {sql} order by id").fetchall()]
            assert ids(q) == want, sql
            if "x.id" not in text:
                plan = q.select("id").df()._jdf.queryExecution().executedPlan().toString()
                assert "NestedLoop" not in plan and "Cartesian" not in plan and "LeftAnti" not in plan, sql
    left = lambda q: sorted(r["id"] for r in q.delete().state.collect())
    assert left(x.where_not_in("a", subs[1][0])) == [r[0] for r in con.sql(f"select id from x where (a not in ({subs[1][1]})) is not true order by id").fetchall()]
    assert "NOT IN (SELECT" in x.where_not_in("a", y).build("postgres")[0]
