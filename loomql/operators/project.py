"""Projections onto types, and rows folded into parents, children and groups."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomql.errors import Conflict, InvalidReference
from loomql.functions.jsonfn import Projection
from loomql.operators.query import Query
from loomql.plans.refs import snake

TYPES = {int: "BIGINT", float: "DOUBLE", str: "STRING", bool: "BOOLEAN", decimal.Decimal: "DECIMAL(38,18)", datetime.date: "DATE", datetime.datetime: "TIMESTAMP_NTZ", bytes: "BINARY"}


def apply_projection(q: Query, kind: type, expressions: dict[str, Projection | str]) -> Query:
    """q with one column for each column of kind: its expression, or null of its
    type, so that branches of a union line up."""
    hints, left = typing.get_type_hints(kind), dict(expressions)
    for f in dataclasses.fields(kind):
        name = f.metadata.get("column", snake(f.name))
        if name == "-":
            continue
        given = left.pop(name, None)
        if given is None:
            hint = hints[f.name]
            if typing.get_origin(hint) in (typing.Union, types.UnionType):
                hint = next(a for a in typing.get_args(hint) if a is not type(None))
            q = q.select_raw(f"CAST(NULL AS {TYPES.get(hint, 'STRING')})", alias=name)
        elif isinstance(given, Projection):
            q = q.select_raw(given.sql, *given.values, alias=name)
        else:
            q = q.select_raw(given, alias=name)
    if left:
        raise InvalidReference(f"no such columns: {', '.join(sorted(left))}")
    return q


def parent_children(rows: DataFrame, parent: list[str], child: list[str], order: list[Column], first: Column, name: str = "children") -> DataFrame:
    """One row for each parent, with an array of its children in order; a row
    without a child (all its columns null) adds none. Parents carry `position`,
    their rank by the least `first` of their rows. A parent's children are one
    array, so they must fit in a row."""
    keys = [f"k{i}" for i in range(len(order))]
    there = F.lit(False)
    for c in child:
        there |= F.col(c).isNotNull()
    packed = F.struct(*[o.alias(k) for o, k in zip(order, keys)], F.struct(*child).alias("v"))
    held = rows.groupBy(*parent).agg(F.min(first).alias("position"), F.array_sort(F.collect_list(F.when(there, packed))).alias("c"))
    return held.select(*parent, F.transform("c", lambda x: x["v"]).alias(name), "position")


def hydrate(parents: DataFrame, aggregates: DataFrame, on: list[str]) -> DataFrame:
    """Each parent with its aggregate row, or nulls; two rows of a key raise when
    the result is read. Joined by the key: neither side is gathered."""
    counted = aggregates.withColumn("_n", F.count("*").over(Window.partitionBy(*on)))
    checked = counted.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("two aggregate rows of one key")).cast("long")).otherwise(F.col("_n")))
    joined = parents.join(checked, on, "left")
    return joined.where("_n IS NULL OR _n = 1").drop("_n")


def hydrate_rows(parents: list[dict], aggregates: list[dict], key) -> list[dict]:
    """The same for rows on the driver."""
    by: dict = {}
    for a in aggregates:
        if key(a) in by:
            raise Conflict(f"two aggregate rows of {key(a)!r}")
        by[key(a)] = a
    return [p | by.get(key(p), {}) for p in parents]


def representatives(rows: DataFrame, key: list[str], order: list[Column], count: str = "n") -> DataFrame:
    """The first row of each key by `order`, which should be total, and the rows
    of the key: one grouped aggregation, no window over whole groups."""
    others = [c for c in rows.columns if c not in key]
    keys = [f"k{i}" for i in range(len(order))]
    packed = F.struct(*[o.alias(k) for o, k in zip(order, keys)], F.struct(*others).alias("v"))
    got = rows.groupBy(*key).agg(F.min(packed).alias("m"), F.count("*").alias(count))
    return got.select(*key, "m.v.*", count)
