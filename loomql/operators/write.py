"""Writes as functions of state: a Change holds the table's new state and the rows
that it touches, both lazy. Nothing is overwritten: an engine takes a change as
its new state (Transaction.apply, Engine.register), and publish() writes it as a
new version beside the old, with a pointer file that readers follow."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.errors import Conflict, InvalidReference, NotFound, RowsAffected
from loomql.functions.convert import to_map
from loomql.functions.jsonfn import set_path
from loomql.operators.query import Query, fields_of
from loomql.plans.plan import QueryPlan, RiskEngine, ensure_executable, finalize
from loomql.plans.predicates import fold, json_path
from loomql.plans.render import literal
from loomql.plans.refs import fragment, parse, positional, table_of


@dataclass(frozen=True)
class Change:
    table: str
    state: DataFrame
    touched: DataFrame

    @property
    def affected(self) -> int:
        return self.touched.count()


# -- plans --------------------------------------------------------------------
def plan_insert(q: Query, data) -> QueryPlan:
    rows = data if isinstance(data, list) else [data]
    columns = sorted({c for r in rows for c in fields_of(r)})
    sql = f"INSERT INTO {q.table} ({', '.join(columns)}) VALUES {len(rows)} rows"
    return finalize(QueryPlan("insert", sql, (), [{"name": str(q.table), "alias": None}], columns, approval_reason=q.approval), q.suppressions, q.engine.risk or RiskEngine())


plan_insert_batch = plan_insert


def plan_update(q: Query, data) -> QueryPlan:
    plan = q.plan("update")
    plan.columns = sorted(fields_of(data))
    plan.sql = f"UPDATE {q.table} SET {', '.join(plan.columns)}" + plan.sql[plan.sql.find(" WHERE ") :] if " WHERE " in plan.sql else f"UPDATE {q.table} SET {', '.join(plan.columns)}"
    return plan


def plan_delete(q: Query) -> QueryPlan:
    return q.plan("delete")


# -- helpers --------------------------------------------------------------------
def _incoming(q: Query, rows: list[dict]) -> DataFrame:
    """The rows as a frame of the table's types: all its columns, nulls where a
    row lacks one. They come from the caller, so they fit the driver."""
    schema = q.engine.frame(str(q.table)).schema
    unknown = {c for r in rows for c in r} - set(schema.names)
    if unknown:
        raise InvalidReference(f"no such columns: {', '.join(sorted(unknown))}")
    open_ = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField("_at", T.LongType())])
    return q.engine.spark.createDataFrame([tuple(r.get(c) for c in schema.names) + (i,) for i, r in enumerate(rows)], open_)


def _gate(plan: QueryPlan) -> None:
    ensure_executable(plan)


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key; rows with a null in the key all stay."""
    loose = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"))
    return rows.withColumn("_n", F.when(loose, 1).otherwise(F.row_number().over(w))).where("_n = 1").drop("_n")


# -- inserts ----------------------------------------------------------------------
def insert(q: Query, data) -> Change:
    return insert_batch(q, [data])


def insert_batch(q: Query, data: list) -> Change:
    if not data:
        raise InvalidReference("no rows")
    rows = [fields_of(r) for r in data]
    _gate(plan_insert(q, rows))
    new = _incoming(q, rows).drop("_at")
    return Change(str(q.table), q.engine.frame(str(q.table)).unionByName(new), new)


def insert_get_id(q: Query, data) -> tuple[Change, int]:
    """The key of the new row: the one given, else one more than the greatest."""
    row, key = dict(fields_of(data)), q.key[0]
    if row.get(key) is None:
        row[key] = int(q.engine.frame(str(q.table)).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]) + 1
    return insert(q, row), row[key]


def insert_or_ignore(q: Query, data: list, unique: list[str] | None = None) -> Change:
    """Rows whose key isn't there; of rows with one key the first. Nulls conflict
    with nothing."""
    keys = list(unique or q.key)
    base, rows = q.engine.frame(str(q.table)), [fields_of(r) for r in data]
    _gate(plan_insert(q, rows))
    new = _incoming(q, rows).withColumn("_at", -F.col("_at"))
    new = _last(new, keys).drop("_at").join(base.select(*keys), keys, "left_anti").select(*base.columns)
    return Change(str(q.table), base.unionByName(new), new)


def insert_using(q: Query, columns: list[str], sub: Query) -> Change:
    base = q.engine.frame(str(q.table))
    _gate(plan_insert(q, dict.fromkeys(columns)))
    got = sub.df()
    if len(got.columns) != len(columns):
        raise InvalidReference(f"{len(got.columns)} columns for {len(columns)}")
    got = got.toDF(*columns)
    kinds = {f.name: f.dataType for f in base.schema.fields}
    new = got.select(*[(F.col(c) if c in columns else F.lit(None)).cast(kinds[c]).alias(c) for c in base.columns])
    return Change(str(q.table), base.unionByName(new), new)


def upsert(q: Query, data: list, unique: list[str], update: list[str] | None = None, where: str | None = None, sets: dict[str, Column] | None = None) -> Change:
    """Rows whose key is there change its `update` columns (default: all that a
    row gives but the key), others are inserted; of rows with one key the last
    counts. where: only rows of the table that hold it can conflict."""
    base, rows = q.engine.frame(str(q.table)), [fields_of(r) for r in data]
    _gate(plan_insert(q, rows))
    given = sorted({c for r in rows for c in r})
    update = [c for c in given if c not in unique] if update is None else list(update)
    new = _last(_incoming(q, rows), unique).drop("_at")
    there = new.select(*[F.col(c).alias(f"_new_{c}") for c in new.columns], F.lit(True).alias("_met"))
    met = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_new_{k}") for k in unique))
    if where:
        met &= F.expr(fragment(where))
    both = base.join(there, met, "left")
    sets = sets or {}
    changed = [F.when(F.col("_met"), sets[c] if c in sets else F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update or c in sets else F.col(c) for c in base.columns]
    state = both.select(*changed)
    seen = base.where(fragment(where)) if where else base
    fresh = new.join(seen.select(*unique), unique, "left_anti").select(*base.columns)
    return Change(str(q.table), state.unionByName(fresh), both.where("_met").select(*changed).unionByName(fresh))


def update_or_insert(q: Query, cond: dict, values: dict) -> Change:
    return upsert(q, [cond | values], list(cond), list(values))


# -- updates and deletes ------------------------------------------------------------
def _marked(q: Query, values: dict[str, str], params: list) -> DataFrame:
    """The table's rows with `_hit`, and `_v0`, `_v1` ... of the assignments. A
    predicate that is null doesn't hit. With joins, order or limit, the rows hit
    are found by key first, one for each key."""
    q = q.scoped()
    r = q.engine.renderer()
    sets = [positional(text, tuple(p), r.value) for text, p in zip(values.values(), params)]
    columns = q.engine.frame(str(q.table)).columns
    label = r.dialect.quoted(q.table.label)
    mine = ", ".join(f"{label}.{r.dialect.quoted(c)}" for c in columns)
    if not q.joins and not q.orders and not q.limit_:
        hit = f"coalesce(({fold(q.where_, r)}), FALSE)" if q.where_ else "TRUE"
        made = "".join(f", {s} AS `_v{i}`" for i, s in enumerate(sets))
        return q.engine.run(f"SELECT {mine}, {hit} AS `_hit`{made} FROM {r.table(q.table)}", r.arguments())
    keys = ", ".join(f"{label}.{r.dialect.quoted(k)}" for k in q.key)
    made = "".join(f", {s} AS `_v{i}`" for i, s in enumerate(sets))
    text = f"SELECT {keys}{made} FROM {r.table(q.table)}" + "".join(j.text(r) for j in q.joins) + (f" WHERE {fold(q.where_, r)}" if q.where_ else "")
    if q.orders:
        text += " ORDER BY " + ", ".join(t if raw else r.order(r.name(parse(t)), down) for t, down, raw in q.orders)
    if q.limit_:
        text += f" LIMIT {q.limit_}"
    found = q.engine.run(text, r.arguments())
    values_ = [c for c in found.columns if c not in q.key]
    one = found.groupBy(*q.key).agg(*([F.min(F.struct(*values_)).alias("_m")] if values_ else []), F.lit(True).alias("_hit"))
    one = one.select(*q.key, "_hit", *([f"_m.{c}" for c in values_] if values_ else []))
    return q.engine.frame(str(q.table)).join(one, list(q.key), "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).select(*columns, "_hit", *values_)


@dataclass(frozen=True)
class Expr:
    """A raw assignment with its values."""

    sql: str
    values: tuple = ()


def update(q: Query, data, guard: bool = True) -> Change:
    """Rows that the query holds, with the values of data; an Expr is an
    expression over the row (and joined rows), col->key sets JSON."""
    given = data if isinstance(data, dict) else fields_of(data)
    if not given:
        raise InvalidReference("nothing to set")
    if guard:
        _gate(plan_update(q, {str(k): v for k, v in given.items()}))
    columns = q.engine.frame(str(q.table)).columns
    exprs = {k: v for k, v in given.items() if isinstance(v, Expr)}
    marked = _marked(q, {k: fragment(v.sql) for k, v in exprs.items()}, [v.values for v in exprs.values()])
    kinds = {f.name: f.dataType for f in q.engine.frame(str(q.table)).schema.fields}
    new: dict[str, Column] = {}
    for k, v in given.items():
        name, path = (k, ()) if "->" not in k else (json_path(k)[0].last, json_path(k)[1])
        if name not in columns:
            raise InvalidReference(f"no such column: {name}")
        value = F.col(f"_v{list(exprs).index(k)}") if isinstance(v, Expr) else v
        if path:
            new[name] = set_path(new.get(name, F.col(name)), path, value)
        else:
            new[name] = (value if isinstance(value, Column) else F.lit(value)).cast(kinds[name])
    out = [F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns]
    return Change(str(q.table), marked.select(*out), marked.where("_hit").select(*out))


def delete(q: Query, guard: bool = True) -> Change:
    """Without the rows that the query holds; those for which its predicate is
    null stay."""
    if guard:
        _gate(plan_delete(q))
    marked = _marked(q, {}, [])
    return Change(str(q.table), marked.where("NOT _hit").drop("_hit"), marked.where("_hit").drop("_hit"))


def returned(engine, change: Change, kind: type | None = None, options: tuple = ()):
    o = _options(options)
    rows = change.touched.limit(2).collect()
    if not rows:
        raise o.no_rows or NotFound(f"no row of {change.table} is affected")
    if len(rows) > 1:
        raise RowsAffected(1, change.affected)
    return change, engine.mapped(rows[0], kind)


# -- typed writes ----------------------------------------------------------------------
@dataclass(frozen=True)
class Options:
    columns: tuple[str, ...] = ()
    omit: tuple[str, ...] = ()
    where_pk: bool = False
    pk: tuple[str, ...] = ()
    returning: tuple[str, ...] = ()
    conflict: tuple[str, ...] = ()
    conflict_where: str | None = None
    conflict_name: str = ""
    update: tuple[str, ...] | None = None
    nothing: bool = False
    sets: dict = field(default_factory=dict)
    expect: int | None = None
    no_rows: Exception | None = None
    table: str = ""
    schema: str = ""


Opt = Callable[[Options], Options]


def _options(opts: tuple[Opt, ...]) -> Options:
    return reduce(lambda o, f: f(o), opts, Options())


def columns(*cols: str) -> Opt:
    return lambda o: replace(o, columns=(*o.columns, *cols))


def omit(*cols: str) -> Opt:
    return lambda o: replace(o, omit=(*o.omit, *cols))


def where_pk() -> Opt:
    return lambda o: replace(o, where_pk=True)


def pk(*cols: str) -> Opt:
    return lambda o: replace(o, pk=cols)


def returning(*cols: str) -> Opt:
    return lambda o: replace(o, returning=cols)


def conflict_columns(*cols: str) -> Opt:
    return lambda o: replace(o, conflict=cols)


def conflict_where(predicate: str) -> Opt:
    return lambda o: replace(o, conflict_where=fragment(predicate))


def conflict_constraint(name: str) -> Opt:
    """A constraint's name: its columns are those that the engine's metadata
    states for it (Options.conflict_name -> conflict_columns by the caller)."""
    return lambda o: replace(o, conflict_name=name)


def conflict_target_raw(target: str) -> Opt:
    """(a, b) WHERE predicate"""
    body, _, where = fragment(target).partition(" WHERE ")
    cols = tuple(str(parse(c)) for c in body.strip().strip("()").split(","))
    return lambda o: replace(o, conflict=cols, conflict_where=where or None)


def update_columns(*cols: str) -> Opt:
    return lambda o: replace(o, update=cols)


def conflict_do_nothing() -> Opt:
    return lambda o: replace(o, nothing=True)


def set_raw(column: str, expression: str) -> Opt:
    return set_expr(column, expression)


def set_expr(column: str, expression: str, *values) -> Opt:
    return lambda o: replace(o, sets=o.sets | {str(parse(column)): Expr(fragment(expression), values)})


def set_column(column: str, source: str) -> Opt:
    return set_expr(column, f"`{parse(source)}`")


def increment(column: str, delta) -> Opt:
    return set_expr(column, f"`{parse(column)}` + ?", delta)


def expect_affected(n: int) -> Opt:
    return lambda o: replace(o, expect=n)


def no_rows_as(error: Exception) -> Opt:
    return lambda o: replace(o, no_rows=error)


def table(name: str) -> Opt:
    return lambda o: replace(o, table=name)


def table_path(*parts: str) -> Opt:
    return table(".".join(parts))


def schema_name(name: str) -> Opt:
    return lambda o: replace(o, schema=name)


def _target(engine, item, o: Options) -> tuple[Query, dict, tuple[str, ...]]:
    """Query on the table, the values to write, and the key."""
    if isinstance(item, dict):
        if not o.table:
            raise InvalidReference("a dict needs table()")
        name, values, keys, readonly = o.table, dict(item), o.pk, set()
    else:
        name, values = o.table or table_of(type(item)), to_map(item)
        marked = [(f.metadata.get("column", f.name), f.metadata) for f in dataclasses.fields(item)]
        keys = o.pk or tuple(c for c, m in marked if m.get("pk"))
        readonly = {c for c, m in marked if m.get("readonly")}
    name = f"{o.schema}.{name}" if o.schema else name
    safe = {*keys, *o.conflict}
    values = {c: v for c, v in values.items() if c not in readonly and (c in safe or (not o.columns or c in o.columns) and c not in o.omit)}
    return engine.table(name).primary_key(*(keys or ("id",))), values, keys


def _checked(change: Change, o: Options) -> Change:
    if o.expect is not None and (n := change.affected) != o.expect:
        if n == 0 and o.no_rows:
            raise o.no_rows
        raise RowsAffected(o.expect, n)
    if o.no_rows and change.touched.isEmpty():
        raise o.no_rows
    return change


def _sets(o: Options) -> dict[str, Column]:
    out = {}
    for c, e in o.sets.items():
        out[c] = F.expr(positional(e.sql, e.values, literal))
    return out


def insert_row(engine, item, *opts: Opt) -> Change:
    return insert_many(engine, [item], *opts)


def insert_many(engine, items: list, *opts: Opt) -> Change:
    o = _options(opts)
    targets = [_target(engine, i, o) for i in items]
    return _checked(insert_batch(targets[0][0], [v for _, v, _ in targets]), o)


def update_row(engine, item, *opts: Opt) -> Change:
    o = _options(opts)
    q, values, keys = _target(engine, item, o)
    if not o.where_pk or not keys:
        raise InvalidReference("an update needs where_pk() and a key")
    for k in keys:
        if values.get(k) is None:
            raise InvalidReference(f"no value for the key {k}")
        q = q.where(k, values[k])
    q = q.with_metadata({"table": str(q.table), "primary_key": keys})
    return _checked(update(q, {k: v for k, v in values.items() if k not in keys} | o.sets), o)


def upsert_row(engine, item, *opts: Opt) -> Change:
    return upsert_many(engine, [item], *opts)


def upsert_many(engine, items: list, *opts: Opt) -> Change:
    o = _options(opts)
    targets = [_target(engine, i, o) for i in items]
    q, _, keys = targets[0]
    unique = list(o.conflict or keys)
    if not unique:
        raise InvalidReference("an upsert needs a key or conflict columns")
    rows = [v for _, v, _ in targets]
    update_ = list(o.update) if o.update is not None else sorted({c for r in rows for c in r} - set(unique))
    if o.nothing or not update_ and not o.sets:
        return _checked(insert_or_ignore(q, rows, unique), o)
    return _checked(upsert(q, rows, unique, update_, o.conflict_where, _sets(o)), o)


def _returning(engine, change: Change, o: Options, kind: type | None) -> list:
    df = change.touched.select(*o.returning) if o.returning else change.touched
    return [engine.mapped(r, kind) for r in df.collect()]  # rows that the caller gave


def _one(engine, change, opts, kind):
    got = _returning(engine, change, _options(opts), kind)
    if not got:
        raise NotFound("no row is affected")
    return change, got[0]


def insert_returning(engine, item, *opts: Opt, kind: type | None = None):
    return _one(engine, insert_row(engine, item, *opts), opts, kind)


def insert_many_returning(engine, items: list, *opts: Opt, kind: type | None = None):
    change = insert_many(engine, items, *opts)
    return change, _returning(engine, change, _options(opts), kind)


def update_returning(engine, item, *opts: Opt, kind: type | None = None):
    return _one(engine, update_row(engine, item, *opts), opts, kind)


def upsert_returning(engine, item, *opts: Opt, kind: type | None = None):
    return _one(engine, upsert_row(engine, item, *opts), opts, kind)


def upsert_many_returning(engine, items: list, *opts: Opt, kind: type | None = None):
    change = upsert_many(engine, items, *opts)
    return change, _returning(engine, change, _options(opts), kind)


def insert_once_returning(engine, item, *opts: Opt, kind: type | None = None):
    """(change, row, inserted): the new row, or the one that has its key."""
    o = _options(opts)
    q, values, keys = _target(engine, item, o)
    unique = list(o.conflict or keys)
    change = insert_or_ignore(q, [values], unique)
    got = change.touched.limit(1).collect()
    if got:
        return change, engine.mapped(got[0], kind), True
    for k in unique:
        q = q.where(k, values[k])
    return change, q.suppress_warning("SELECT_STAR_USED", "the row itself").first(kind), False


# -- several tables -----------------------------------------------------------------------
@dataclass(frozen=True)
class Nested:
    """A parent with ordered children and grandchildren that replace those that
    are there. key: columns that tie a child to its parent; order: a column for
    a child's place."""

    parent_table: str
    child_table: str
    parent_key: tuple[str, ...]
    child_parent: dict[str, str]  # column of the child -> column of the parent
    child_key: tuple[str, ...]
    order: str = ""
    grandchild_table: str = ""
    grandchild_child: dict[str, str] = field(default_factory=dict)


def replace_nested(tx, spec: Nested, parent: dict, children: list[tuple[dict, list[dict]]]) -> dict[str, Change]:
    """Within a transaction: upsert the parent, drop its children and theirs, and
    insert the new ones, with their places from 0."""
    out = {}
    q = tx.table(spec.parent_table).primary_key(*spec.parent_key)
    out[spec.parent_table] = tx.apply(upsert(q, [parent], list(spec.parent_key)))
    tied = {c: parent[p] for c, p in spec.child_parent.items()}
    children_of = tx.table(spec.child_table)
    for c, v in tied.items():
        children_of = children_of.where(c, v)
    if spec.grandchild_table:
        below = tx.table(spec.grandchild_table)
        for g, c in spec.grandchild_child.items():
            below = below.where_in(g, children_of.relation().select(c))
        out[spec.grandchild_table] = tx.apply(delete(below))
    out[spec.child_table] = tx.apply(delete(children_of))
    rows = [child | tied | ({spec.order: i} if spec.order else {}) for i, (child, _) in enumerate(children)]
    if rows:
        out[spec.child_table] = tx.apply(insert_batch(tx.table(spec.child_table), rows))
    if spec.grandchild_table:
        more = [g | {k: row[c] for k, c in spec.grandchild_child.items()} for row, (_, gs) in zip(rows, children) for g in gs]
        if more:
            out[spec.grandchild_table] = tx.apply(insert_batch(tx.table(spec.grandchild_table), more))
    return out


def replace_nested_alone(engine, spec: Nested, parent: dict, children: list) -> tuple[dict[str, Change], object]:
    """The same in a transaction of its own, with the engine afterwards."""
    return engine.transaction(lambda tx: replace_nested(tx, spec, parent, children))


def idempotent(engine, lookup: Callable, apply: Callable):
    """(result, replayed, engine): what lookup finds, else what apply does in a
    transaction; on a conflict, lookup once more."""
    found = lookup(engine)
    if found is not None:
        return found, True, engine
    try:
        result, after = engine.transaction(apply)
        return result, False, after
    except Conflict:
        found = lookup(engine)
        if found is None:
            raise
        return found, True, engine


@dataclass(frozen=True)
class Hook:
    name: str
    run: Callable


def insert_hook(name: str, item, *opts: Opt) -> Hook:
    return Hook(name, lambda tx: tx.apply(insert_row(tx.engine, item, *opts)))


def insert_many_hook(name: str, items: list, *opts: Opt) -> Hook:
    return Hook(name, lambda tx: tx.apply(insert_many(tx.engine, items, *opts)))


def with_hooks(engine, body: Callable, hooks: list[Hook]):
    """body, then the hooks in order, all in one transaction."""

    def run(tx):
        result = body(tx)
        for h in hooks:
            try:
                h.run(tx)
            except Exception as e:
                e.add_note(f"in the hook {h.name!r}")
                raise
        return result

    return engine.transaction(run)


# -- publishing --------------------------------------------------------------------------
def publish(change: Change, folder: str) -> DataFrame:
    """Write the state as a new version below folder/table and point to it. The
    pointer is put last and by rename, so readers see the old version or the
    new. Tables are published one by one: there is no atomicity over several."""
    spark = change.state.sparkSession
    version = uuid.uuid4().hex
    at = f"{folder.rstrip('/')}/{change.table}"
    change.state.write.parquet(f"{at}/{version}")
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(at).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(path(f"{at}/current.{version}"), True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    fs.delete(path(f"{at}/current"), False)
    fs.rename(path(f"{at}/current.{version}"), path(f"{at}/current"))
    return published(spark, folder, change.table)


def published(spark, folder: str, table: str) -> DataFrame:
    at = f"{folder.rstrip('/')}/{table}"
    pointer = spark.read.text(f"{at}/current").first()[0]
    return spark.read.parquet(f"{at}/{json.loads(pointer)['version']}")


def _bind() -> None:
    """Writes as methods of a query."""
    for name, fn in {"insert": insert, "insert_batch": insert_batch, "insert_get_id": insert_get_id, "insert_or_ignore": insert_or_ignore, "insert_using": insert_using, "upsert": upsert, "update_or_insert": update_or_insert, "update": update, "delete": delete, "plan_insert": plan_insert, "plan_insert_batch": plan_insert_batch, "plan_update": plan_update, "plan_delete": plan_delete}.items():
        setattr(Query, name, fn)


_bind()
