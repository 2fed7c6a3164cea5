from dataclasses import dataclass, field

import pytest

from loomql.errors import ApprovalRequired, Blocked, Conflict, InvalidReference, NotFound, RowsAffected, is_conflict, is_not_found
from loomql.operators import scopes, write as W
from loomql.operators.write import Expr
from loomql.sources.engine import Engine

ROWS = [(1, "a", 10, None), (2, "b", None, '{"x": 1, "y": {"z": "q"}}'), (3, None, 30, "{}")]
SCHEMA = "id long, name string, n int, doc string"


@dataclass
class Thing:
    id: int = field(metadata={"pk": True})
    name: str | None = None
    n: int | None = None
    seen: str = field(default="x", metadata={"column": "-"})

    @staticmethod
    def table_name():
        return "things"


@pytest.fixture()
def engine(spark):
    return Engine(spark, {"things": spark.createDataFrame(ROWS, SCHEMA)})


def state(change):
    return sorted((tuple(r) for r in change.state.collect()), key=repr)


def test_insert(engine):
    t = engine.table("things")
    c = t.insert_batch([{"id": 4, "n": 1}, {"id": 5, "name": "e"}])
    assert c.affected == 2 and set(state(c)) == {*ROWS, (4, None, 1, None), (5, "e", None, None)}
    c, new = t.insert_get_id({"name": "z"})
    assert new == 4 and (4, "z", None, None) in state(c)
    with pytest.raises(InvalidReference):
        t.insert({"none": 1})
    with pytest.raises(InvalidReference):
        t.insert_batch([])
    assert t.plan_insert({"id": 1}).operation == "insert"


def test_ignore_and_upsert(engine):
    t = engine.table("things")
    c = t.insert_or_ignore([{"id": 1, "name": "no"}, {"id": 7, "name": "first"}, {"id": 7, "name": "second"}, {"id": None}, {"id": None}])
    assert c.affected == 3 and (7, "first", None, None) in state(c) and (1, "a", 10, None) in state(c)
    c = t.upsert([{"id": 1, "name": "x"}, {"id": 1, "name": "last"}, {"id": 9, "name": "new"}], ["id"])
    assert (1, "last", 10, None) in state(c) and (9, "new", None, None) in state(c) and len(state(c)) == 4 and c.affected == 2
    c = t.upsert([{"id": 1, "name": "x", "n": 5}], ["id"], ["n"])
    assert (1, "a", 5, None) in state(c)
    c = t.upsert([{"id": 1, "name": "x"}], ["id"], ["name"], where="n > 100")
    assert (1, "a", 10, None) in state(c) and (1, "x", None, None) in state(c)
    c = t.update_or_insert({"id": 3}, {"name": "three"})
    assert (3, "three", 30, "{}") in state(c)


def test_update_and_delete(engine):
    t = engine.table("things")
    with pytest.raises(Blocked):
        t.update({"n": 1})
    with pytest.raises(Blocked):
        t.delete()
    c = t.where("n", ">", 5).update({"n": Expr("n + ?", (1,)), "name": "up"})
    assert set(state(c)) == {(1, "up", 11, None), ROWS[1], (3, "up", 31, "{}")} and c.affected == 2
    c = t.where("n", ">", 15).delete()
    assert set(state(c)) == {ROWS[0], ROWS[1]} and c.affected == 1  # a null predicate keeps its row
    c = t.where("id", ">", 0).order_by("id", "desc").limit(1).delete()
    assert set(state(c)) == set(ROWS[:2])
    assert t.where("id", 1).plan_update({"n": 1}).columns == ["n"] and t.plan_delete().blocked
    with pytest.raises(ApprovalRequired):
        t.where_raw_no_args("1=1").update({"n": 1})


def test_json_paths_are_set_in_place(engine):
    import json

    c = engine.table("things").where("id", ">", 0).update({"doc->y->z": "new", "doc->k": 5})
    got = {r["id"]: json.loads(r["doc"]) for r in c.state.collect()}
    assert got == {1: {"y": {"z": "new"}, "k": 5}, 2: {"x": 1, "y": {"z": "new"}, "k": 5}, 3: {"y": {"z": "new"}, "k": 5}}


def test_joined_update_hits_a_row_once(engine, spark):
    e = engine.register("more", spark.createDataFrame([(1, "m"), (1, "k"), (2, "z")], "t_id long, v string"))
    q = e.table("things").join("more", "things.id", "=", "more.t_id")
    c = q.where("more.v", "<>", "z").update({"name": Expr("more.v")})
    assert (1, "k", 10, None) in state(c) and len(state(c)) == 3 and c.affected == 1
    assert set(state(q.where("more.v", "z").delete())) == {ROWS[0], ROWS[2]}


def test_typed(engine):
    c, row = W.insert_returning(engine, Thing(4, "d", 1), kind=Thing)
    assert row == Thing(4, "d", 1) and len(state(c)) == 4
    with pytest.raises(InvalidReference):
        W.update_row(engine, Thing(1, "new"))
    c, row = W.update_returning(engine, Thing(1, "new"), W.where_pk(), W.columns("name"))
    assert (1, "new", 10, None) in state(c) and row["name"] == "new"
    c = W.update_row(engine, Thing(1), W.where_pk(), W.columns("id"), W.increment("n", 5), W.set_column("name", "doc"))
    assert (1, None, 15, None) in state(c)
    with pytest.raises(RowsAffected, match="expected 1 rows, 0"):
        W.update_row(engine, Thing(99, "x"), W.where_pk(), W.expect_affected(1))
    with pytest.raises(NotFound):
        W.update_row(engine, Thing(99, "x"), W.where_pk(), W.no_rows_as(NotFound("gone")))
    c = W.upsert_row(engine, Thing(1, "up", 2), W.update_columns("n"))
    assert (1, "a", 2, None) in state(c)
    c = W.upsert_row(engine, Thing(1, "up", 2), W.conflict_do_nothing())
    assert set(state(c)) == set(ROWS)
    c = W.upsert_row(engine, Thing(1, "up", 2), W.update_columns(), W.set_expr("n", "n * ?", 3))
    assert (1, "a", 30, None) in state(c)
    c, rows = W.upsert_many_returning(engine, [Thing(1, "p"), Thing(8, "q")], W.omit("n"), W.returning("id", "name"))
    assert sorted(r["id"] for r in rows) == [1, 8] and set(rows[0]) == {"id", "name"}
    with pytest.raises(InvalidReference):
        W.upsert_row(engine, {"id": 1}, W.table("things"))
    c = W.upsert_row(engine, {"id": 1, "n": 4}, W.table("things"), W.conflict_target_raw("(id) WHERE n > 5"))
    assert (1, "a", 4, None) in state(c)
    _, row, new = W.insert_once_returning(engine, Thing(1, "again"))
    assert not new and row["name"] == "a"
    _, row, new = W.insert_once_returning(engine, Thing(6, "six"))
    assert new and row["name"] == "six"
    c, rows = W.insert_many_returning(engine, [Thing(7), Thing(8)])
    assert len(rows) == 2


def test_scoped_writes(engine):
    t = engine.table("things")
    _, row = scopes.update_by_returning(t, {"n": 9}, lambda q: q.where("id", 2))
    assert row["n"] == 9
    with pytest.raises(RowsAffected):
        scopes.update_by_returning(t, {"n": 9}, lambda q: q.where("id", "<", 3))
    assert scopes.delete_by(t, lambda q: q.where("id", 2)).affected == 1 and scopes.plan_delete_by(t).blocked
    assert scopes.plan_update_by(t, {"n": 1}, lambda q: q.where("id", 1)).risk_level == "low"
    assert scopes.select_one_by(t, lambda q: q.where("id", 1))["name"] == "a" and len(scopes.select_all_by(t)) == 3


def test_transactions(engine, spark):
    def body(tx):
        tx.apply(tx.table("things").where("id", 1).delete())
        return tx.table("things").count()

    n, after = engine.transaction(body)
    assert n == 2 and after.table("things").count() == 2 and engine.table("things").count() == 3

    def fails(tx):
        tx.apply(tx.table("things").where("id", 1).delete())
        raise Conflict("no")

    with pytest.raises(Conflict):
        engine.transaction(fails)
    tx = engine.begin()
    tx.apply(tx.table("things").where("id", 1).delete())
    assert tx.rollback().table("things").count() == 3
    with pytest.raises(InvalidReference):
        tx.apply(None)
    result, after = W.with_hooks(engine, lambda tx: "done", [W.insert_hook("log", Thing(11)), W.insert_many_hook("more", [Thing(12), Thing(13)])])
    assert result == "done" and after.table("things").count() == 6
    found, replayed, _ = W.idempotent(engine, lambda e: "had", lambda tx: "new")
    assert (found, replayed) == ("had", True)
    seen = iter([None, "later"])
    assert W.idempotent(engine, lambda e: next(seen), fails)[:2] == ("later", True)
    assert is_conflict(Conflict()) and is_not_found(NotFound())


def test_nested(spark):
    e = Engine(spark, {"p": spark.createDataFrame([(1, "old")], "id long, title string"), "c": spark.createDataFrame([(1, 1, "k", 0), (2, 2, "z", 0)], "id long, p_id long, k string, at int"), "g": spark.createDataFrame([(1, 1, "v"), (2, 2, "w")], "id long, c_id long, v string")})
    spec = W.Nested("p", "c", ("id",), {"p_id": "id"}, ("id",), "at", "g", {"c_id": "id"})
    _, after = W.replace_nested_alone(e, spec, {"id": 1, "title": "new"}, [({"id": 5, "k": "x"}, [{"id": 9, "v": "n"}]), ({"id": 6, "k": "y"}, [])])
    rows = lambda t: sorted(tuple(r) for r in after.frame(t).collect())
    assert rows("p") == [(1, "new")] and rows("c") == [(2, 2, "z", 0), (5, 1, "x", 0), (6, 1, "y", 1)] and rows("g") == [(2, 2, "w"), (9, 5, "n")]


def test_publish(engine, tmp_path):
    e = engine.publish(engine.table("things").where("id", 1).delete(), f"file://{tmp_path}")
    assert e.table("things").count() == 2
    e = e.publish(e.table("things").where("id", 2).delete(), f"file://{tmp_path}")
    assert W.published(engine.spark, f"file://{tmp_path}", "things").count() == 1
