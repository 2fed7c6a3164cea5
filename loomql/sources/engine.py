"""The engine: a catalog of DataFrames over a Spark session, a dialect whose order
of nulls and text search it imitates, and a gate before raw SQL."""

from __future__ import annotations

import dataclasses
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomql.errors import InvalidReference, NotFound
from loomql.functions.convert import COMPAT, to_object
from loomql.operators import write
from loomql.operators.query import Query
from loomql.plans.plan import QueryPlan, RiskEngine, ensure_executable, raw_plan
from loomql.plans.refs import parse, table_of
from loomql.plans.render import DIALECTS, SPARK, Dialect, Renderer

DRIVERS: dict[str, tuple[Callable[[SparkSession, str], dict[str, DataFrame]], str]] = {}


def register_driver(name: str, connect: Callable[[SparkSession, str], dict[str, DataFrame]], dialect: str = "postgres") -> None:
    """connect(spark, address) gives the tables of an address by name."""
    DRIVERS[name] = connect, dialect


def driver(name: str):
    return DRIVERS.get(name)


def parquet_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every <name>.parquet of a folder that the driver can list."""
    return {p.name.removesuffix(".parquet"): spark.read.parquet(str(p)) for p in sorted(Path(folder).glob("*.parquet"))}


def jdbc_table(spark: SparkSession, url: str, table: str, partition: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A database table, read in `parts` ranges of a numeric column; filters and
    columns are pushed down to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        reader = reader.option("partitionColumn", partition).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


register_driver("parquet", parquet_tables)


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    dialect: str = "postgres"
    risk: RiskEngine | None = None
    approval: str = ""
    touched: tuple[str, ...] = ()
    bools: str = COMPAT
    views: dict[str, str] = field(default_factory=dict, compare=False)

    # -- tables ---------------------------------------------------------------
    def table(self, name: str) -> Query:
        return Query(self, parse(name, alias=True))

    query = table

    def table_path(self, *parts: str) -> Query:
        return self.table(".".join(parts))

    def model(self, kind) -> Query:
        kind = kind if isinstance(kind, type) else type(kind)
        keys = tuple(f.metadata.get("column", f.name) for f in dataclasses.fields(kind) if f.metadata.get("pk")) if dataclasses.is_dataclass(kind) else ()
        return replace(self.table(table_of(kind)), key=keys or ("id",))

    def register(self, name: str, df: DataFrame) -> "Engine":
        """The engine with another state of a table."""
        return replace(self, tables=self.tables | {str(parse(name)): df}, views={k: v for k, v in self.views.items() if k != name})

    def view(self, name: str) -> str | None:
        df = self.tables.get(name)
        if df is None:
            return None
        if name not in self.views:
            self.views[name] = f"loomql_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(self.views[name])
        return self.views[name]

    def frame(self, name: str) -> DataFrame:
        found = self.tables.get(str(parse(name)))
        return found if found is not None else self.spark.table(name)

    def read_schema(self, *names: str) -> list[dict]:
        """Table, column, type, nullable, position, as a schema query gives them."""
        out = []
        for n in names or sorted(self.tables):
            for i, f in enumerate(self.frame(n).schema.fields):
                out.append({"table": n, "column": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "position": i + 1})
        return out

    # -- running ----------------------------------------------------------------
    def renderer(self, dialect: str | None = None) -> Renderer:
        like = DIALECTS[self.dialect]
        if dialect in (None, "spark"):
            return Renderer(SPARK, like, self.view)
        if dialect not in DIALECTS:
            raise InvalidReference(f"no dialect {dialect!r}")
        return Renderer(DIALECTS[dialect], DIALECTS[dialect])

    def run(self, sql: str, args=None, tag: str = "") -> DataFrame:
        if tag:
            self.spark.addTag(tag)
        try:
            return self.spark.sql(sql, args=args or None)
        finally:
            if tag:
                self.spark.removeTag(tag)

    def mapped(self, row, kind: type | None = None):
        return row.asDict() if kind is None else to_object(row.asDict(), kind, self.bools)

    # -- raw SQL ------------------------------------------------------------------
    def require_raw_approval(self, reason: str) -> "Engine":
        if not reason.strip():
            raise InvalidReference("an approval needs a reason")
        return replace(self, approval=reason)

    def touched_tables(self, *names: str) -> "Engine":
        found = {n.lower(): n for n in (*self.touched, *names)}
        return replace(self, touched=tuple(found.values()))

    def raw_plan(self, sql: str, *args) -> QueryPlan:
        """The plan of a raw statement, with the tables that Spark's parser finds."""
        try:
            logical = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
            found = sorted(set(_relations(logical.toString())))
            precision = "precise"
        except Exception:  # a text that doesn't parse has no known tables
            found, precision = [], "unknown"
        plan = raw_plan(sql, args, self.approval, list(self.touched), found)
        plan.precision = precision
        return plan

    def raw(self, sql: str, *args) -> DataFrame:
        """Rows of a raw statement; {name} stands for a table of the catalog."""
        ensure_executable(self.raw_plan(sql, *args))
        named = {k: v for k, v in self.tables.items() if "{" + k + "}" in sql}
        return self.spark.sql(sql, args=list(args) or None, **named)

    execute = raw

    def raw_row(self, sql: str, *args) -> dict:
        rows = self.raw(sql, *args).limit(1).collect()
        if not rows:
            raise NotFound("no row")
        return rows[0].asDict()

    def select_one(self, sql: str, *args, kind: type | None = None):
        rows = self.raw(sql, *args).limit(1).collect()
        if not rows:
            raise NotFound("no row")
        return self.mapped(rows[0], kind)

    def select_all(self, sql: str, *args, kind: type | None = None) -> list:
        return [self.mapped(r, kind) for r in self.raw(sql, *args).collect()]

    select_map = select_struct = select_one
    select_maps = select_structs = select_all

    def with_bool_policy(self, policy: str) -> "Engine":
        return replace(self, bools=policy)

    def close(self) -> None:
        for v in self.views.values():
            self.spark.catalog.dropTempView(v)
        self.views.clear()

    def publish(self, change, folder: str) -> "Engine":
        """With a change written as a new version below folder, and read from there."""
        return self.register(change.table, write.publish(change, folder))

    # -- transactions ------------------------------------------------------------------
    def transaction(self, fn: Callable[["Transaction"], object]):
        """fn's changes all together: it gets a Transaction; where it raises,
        nothing is published. Gives fn's result and the engine afterwards."""
        tx = Transaction(self)
        result = fn(tx)
        return result, tx.commit()

    def begin(self) -> "Transaction":
        return Transaction(self)


class Transaction:
    """Changes stacked on an engine's state. Tables are DataFrames, so nothing
    happens to the old state; commit gives the new engine, rollback the old."""

    def __init__(self, engine: Engine):
        self.before, self.engine, self.done = engine, engine, False

    def table(self, name: str) -> Query:
        return self.engine.table(name)

    def apply(self, change) -> object:
        if self.done:
            raise InvalidReference("the transaction has ended")
        self.engine = self.engine.register(change.table, change.state)
        return change

    def commit(self) -> Engine:
        self.done = True
        return self.engine

    def rollback(self) -> Engine:
        self.done = True
        return self.before


def _relations(text: str) -> Iterable[str]:
    return (m.replace(", ", ".").strip("[]") for m in re.findall(r"'UnresolvedRelation (\[[^\]]*\])", text))


def open_engine(spark: SparkSession, address: str, name: str = "parquet", **more) -> Engine:
    """An engine over the tables that a registered driver finds at an address."""
    if name not in DRIVERS:
        raise InvalidReference(f"no driver {name!r}")
    connect, dialect = DRIVERS[name]
    return Engine(spark, connect(spark, address), **({"dialect": dialect} | more))
