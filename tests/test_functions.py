import decimal
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from loomql.errors import InvalidReference
from loomql.functions import convert as C
from loomql.functions import jsonfn as J


def test_booleans(spark):
    yes = {C.STRICT: [1, "true", "T", True], C.COMPAT: ["yes", "ON", b"1"], C.LENIENT: ["7", -3], C.LEGACY: [5]}
    for policy, values in yes.items():
        assert all(C.to_bool(v, policy) for v in values)
    for policy, bad in ((C.STRICT, "yes"), (C.STRICT, 2), (C.COMPAT, 2), (C.LENIENT, "x"), (C.COMPAT, None), (C.LEGACY, "yes")):
        with pytest.raises(InvalidReference):
            C.to_bool(bad, policy)
    assert C.to_bool(None, C.LEGACY) is False and C.to_bool("off") is False
    df = spark.createDataFrame([("yes",), ("0",), ("7",), (None,), ("zz",)], "v string")
    get = lambda p: [r[0] for r in df.select(C.bool_column(F.col("v"), p)).collect()]
    assert get(C.STRICT) == [None, False, None, None, None] and get(C.COMPAT) == [True, False, None, None, None]
    assert get(C.LENIENT) == [True, False, True, None, None] and get(C.LEGACY) == [None, False, True, False, None]


@dataclass
class Address:
    city: str
    zip: str | None = None


@dataclass
class User:
    userId: int
    name: str = field(metadata={"column": "full_name"}, default="")
    address: Address | None = field(default=None, metadata={"prefix": "addr_"})
    note: str = field(default="", metadata={"omitempty": True})
    hidden: int = field(default=3, metadata={"column": "-"})


User.__annotations__["address"] = Address


def test_objects():
    u = C.to_object({"user_id": 4, "FULLNAME": "x", "addr_city": "Z", "hidden": 9}, User)
    assert u == User(4, "x", Address("Z"), "", 3)
    assert C.to_map(User(4, "x")) == {"user_id": 4, "full_name": "x", "address": None}
    assert len(C.to_objects([{"user_id": 1, "addr_city": "a"}] * 2, User)) == 2
    assert C.value_of({"a": "3"}, "a", int) == 3 and C.as_(decimal.Decimal, "1.10") == decimal.Decimal("1.10")
    assert C.as_(str, b"x") == "x" and C.as_(int | None, None) is None
    with pytest.raises(InvalidReference):
        C.as_(int, 1.5)
    with pytest.raises(InvalidReference):
        C.value_of({}, "a", int)


def test_values():
    n = C.NumericString.scan("1.10")
    assert n.value() == "1.10" and C.NumericString.null().or_default("0") == "0" and C.NumericString.scan(None).value() is None
    with pytest.raises(InvalidReference):
        C.NumericString.of("")
    assert C.null_string("") == "" and C.null_string("", empty=True) is None and C.null_string(None) is None
    f = J.JSONField.scan('{"a": 1}')
    assert f.value() == '{"a":1}' and J.JSONField.null().value() is None and J.JSONField.null().or_default(2) == 2
    with pytest.raises(InvalidReference):
        J.JSONField.scan("")
    with pytest.raises(ZeroDivisionError):
        J.JSONField.of(0).validate(lambda v: 1 / v)
    assert J.encode({"a": "é"}) == '{"a":"é"}' and J.decode("", 5) == 5 and J.decode("[1]") == [1]
    assert J.json_path("c", "a", "b") == "c->a->b"
    with pytest.raises(InvalidReference):
        J.json_path("c", "a'b")


def test_aggregate_array(spark):
    df = spark.createDataFrame([(1, "x", 3), (1, "y", None), (1, None, 1), (2, "z", 0)], "g int, v string, o int")
    p = J.aggregate_array("v", order_by=("o desc",), where="o > 0 or o is null")
    assert {r[0]: r[1] for r in df.groupBy("g").agg(F.expr(p.sql).alias("a")).collect()} == {1: '["x",null,"y"]', 2: "[]"}
