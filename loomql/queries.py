"""One query for each kind of operator, over whole tables, with the SQL that gives
the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.functions.jsonfn import aggregate_array, build_object, projection
from loomql.governance.operation import compile_spec
from loomql.governance.manifest import generate
from loomql.operators import project, scopes, write
from loomql.operators.query import Query
from loomql.operators.write import Expr
from loomql.plans import policy
from loomql.plans.predicates import cursor_asc, cursor_desc
from loomql.sources.engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *names: str, **more) -> Engine:
    return Engine(spark, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}, **more)


def query(*tables: str, sql: str):
    """Register fn(engine) -> Query or DataFrame."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = fn(engine(spark, sf_dir, *tables))
            return got.df() if isinstance(got, Query) else got

        QUERIES[fn.__name__], SQL[fn.__name__] = run, sql
        return fn

    return add


@query("customer", "orders", sql="SELECT c_mktsegment, round(SUM(o_totalprice), 2) AS revenue, CAST(COUNT(*) AS BIGINT) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY revenue DESC LIMIT 5")
def segment_revenue(e):
    q = e.table("orders").join("customer", "orders.o_custkey", "=", "customer.c_custkey").select("c_mktsegment")
    return q.select_raw("round(SUM(o_totalprice), 2)", alias="revenue").select_count(alias="orders").group_by("c_mktsegment").order_by("revenue", "desc").limit(5)


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def select_where_limit(e):
    return e.table("orders").select("o_orderkey", "o_totalprice").where("o_totalprice", ">", 100000).order_by("o_totalprice", "desc").order_by("o_orderkey").take(20).skip(5)


@query("orders", sql="SELECT o_orderkey, round(o_totalprice * 2, 2) AS raised FROM orders WHERE o_orderkey <> 7")
def select_raw_values(e):
    return e.table("orders").select("o_orderkey").select_raw("round(o_totalprice * ?, ?)", 2, 2, alias="raised").where("o_orderkey", "<>", 7)


@query("orders", sql="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_columns(e):
    return e.table("orders").distinct("o_orderstatus", "o_orderpriority")


@query("customer", sql="SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3 AND c_acctbal > 0")
def where_precedence(e):
    return e.table("customer").select("c_custkey").where("c_mktsegment", "BUILDING").or_where("c_nationkey", 3).where("c_acctbal", ">", 0)


@query("customer", sql="SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_nationkey = 3) AND c_acctbal > 0 OR (c_custkey < 10 AND c_name LIKE '%1%')")
def where_group(e):
    q = e.table("customer").select("c_custkey").where_group(lambda g: g.where("c_mktsegment", "BUILDING").or_where("c_nationkey", 3)).where("c_acctbal", ">", 0)
    return q.or_where_group(lambda g: g.where("c_custkey", "<", 10).where("c_name", "LIKE", "%1%"))


@query("customer", sql="SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey IN (1, 2)) OR NOT (c_custkey > 20)")
def where_not(e):
    q = e.table("customer").select("c_custkey").where_not(lambda g: g.where("c_acctbal", "<", 0).or_where_in("c_nationkey", [1, 2]))
    return q.or_where_not(lambda g: g.where("c_custkey", ">", 20))


@query("customer", sql="SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 1 AND c_acctbal > 10 OR c_custkey < 5 OR c_name = 'x'")
def where_raw(e):
    q = e.table("customer").select("c_custkey").where_raw("c_nationkey % :m = :r", {"m": 2, "r": 1}).safe_where_raw("c_acctbal > :low", {"low": 10})
    return q.or_where_raw_no_args("c_custkey < 5").safe_or_where_raw("c_name = :n", {"n": "x"})


@query("part", sql="SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12') OR p_size IN (50) OR p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey > 3)")
def where_in_lists(e):
    q = e.table("part").select("p_partkey").where_in("p_size", [1, 5, 9]).where_not_in("p_brand", ["Brand#11", "Brand#12"]).or_where_in("p_size", [50])
    return q.or_where_not_in("p_partkey", e.table("part").select("p_partkey").where("p_partkey", ">", 3))


@query("part", sql="SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1000 OR p_size BETWEEN 1 AND 1 OR p_partkey NOT BETWEEN 2 AND 100000000")
def where_between(e):
    q = e.table("part").select("p_partkey", "p_size").where_between("p_size", 10, 20).where_not_between("p_retailprice", 950, 1000)
    return q.or_where_between("p_size", 1, 1).or_where_not_between("p_partkey", 2, 100000000)


@query("lineitem", sql="SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem WHERE l_linenumber BETWEEN l_suppkey AND l_partkey OR l_quantity NOT BETWEEN l_suppkey AND l_partkey AND l_suppkey NOT BETWEEN l_linenumber AND l_partkey OR l_partkey BETWEEN l_linenumber AND l_suppkey")
def between_columns(e):
    q = e.table("lineitem").select_count(alias="n").where_between_columns("l_linenumber", "l_suppkey", "l_partkey").or_where_not_between_columns("l_quantity", "l_suppkey", "l_partkey")
    return q.where_not_between_columns("l_suppkey", "l_linenumber", "l_partkey").or_where_between_columns("l_partkey", "l_linenumber", "l_suppkey")


@query("part", sql="SELECT p_partkey FROM part WHERE (p_name LIKE '%green%' OR p_type LIKE '%green%') AND (p_size >= 3 AND p_partkey >= 3) OR (p_size = 7 OR p_partkey = 7)")
def where_any_all(e):
    q = e.table("part").select("p_partkey").where_any(["p_name", "p_type"], "LIKE", "%green%").where_all(["p_size", "p_partkey"], ">=", 3)
    return q.or_where_any(["p_size", "p_partkey"], "=", 7)


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey = l_suppkey AND l_linenumber <= l_quantity OR l_orderkey = l_partkey OR l_suppkey > l_partkey AND l_orderkey < l_suppkey")
def where_columns(e):
    q = e.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").where_column("l_partkey", "l_suppkey").where_columns([["l_linenumber", "<=", "l_quantity"]])
    return q.or_where_columns([["l_orderkey", "l_partkey"]]).or_where_column("l_suppkey", ">", "l_partkey").where_column("l_orderkey", "<", "l_suppkey")


@query("events", sql="SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events WHERE (CASE WHEN event_type = 'error' THEN NULL ELSE value END) IS NULL OR (CASE WHEN event_type = 'error' THEN NULL ELSE value END) IS NOT NULL AND event_id < 50")
def where_null(e):
    e = e.register("e", e.frame("events").select("event_id", F.expr("CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v")))
    return e.table("e").select("event_id", "v").where_null("v").or_where_not_null("v").where("event_id", "<", 50)


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey < 40)")
def in_subquery(e):
    orders = e.table("orders").select("o_custkey")
    q = e.table("customer").select("c_custkey").where_in_subquery("c_custkey", orders.where("o_totalprice", ">", 150000)).where_not_in_subquery("c_custkey", orders.where("o_orderstatus", "P"))
    return q.or_where_in_subquery("c_custkey", orders.where("o_orderkey", "<", 40))


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 20000)")
def exists(e):
    own = e.table("orders").select("o_orderkey").where_column("orders.o_custkey", "customer.c_custkey")
    q = e.table("customer").select("c_custkey").where_exists(own.where("o_totalprice", ">", 200000)).where_not_exists(own.where("o_orderstatus", "P"))
    return q.or_where_not_exists(own.where("o_totalprice", ">", 20000))


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer) OR c_custkey = (SELECT MIN(o_custkey) FROM orders)")
def scalar_subquery(e):
    q = e.table("customer").select("c_custkey").where_subquery("c_acctbal", ">", e.table("customer").avg("c_acctbal"))
    return q.or_where_subquery("c_custkey", "=", e.table("orders").min("o_custkey"))


@query("customer", "nation", "region", sql="SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner(e):
    return e.table("customer").join("nation", "customer.c_nationkey", "=", "nation.n_nationkey").join("region", "nation.n_regionkey", "=", "region.r_regionkey").select("c_custkey", "n_name", "r_name")


@query("customer", "orders", sql="SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders o ON c_custkey = o.o_custkey AND o.o_totalprice > 180000")
def join_left_values(e):
    return e.table("customer").left_join_query("orders as o", lambda j: j.on("customer.c_custkey", "=", "o.o_custkey").where("o.o_totalprice", ">", 180000)).select("c_custkey", "o.o_orderkey")


@query("orders", "customer", sql="SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderkey < 500")
def join_right(e):
    return e.table("orders").right_join_query("customer", lambda j: j.on("orders.o_custkey", "=", "customer.c_custkey").where("orders.o_orderkey", "<", 500)).select("o_orderkey", "c_custkey")


@query("orders", "customer", sql="SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right_plain(e):
    return e.table("orders").right_join("customer", "orders.o_custkey", "=", "customer.c_custkey").select("o_orderkey", "c_custkey")


@query("nation", "region", sql="SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(e):
    return e.table("nation").cross_join("region").select("n_name", "r_name")


@query("nation", sql="SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def join_theta(e):
    return e.table("nation as a").join("nation as b", "a.n_nationkey", "<", "b.n_nationkey").select("a.n_name as low", "b.n_name as high")


@query("customer", "nation", sql="SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey OR c_custkey = n_nationkey AND n_regionkey = 1")
def join_or_terms(e):
    return e.table("customer").join_query("nation", lambda j: j.on("c_nationkey", "=", "n_nationkey").or_on("c_custkey", "=", "n_nationkey").where("n_regionkey", "=", 1)).select("c_custkey", "n_name")


@query("customer", "orders", sql="SELECT c_custkey, t.total FROM customer LEFT JOIN (SELECT o_custkey, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) t ON c_custkey = t.o_custkey")
def join_subquery(e):
    sub = e.table("orders").select("o_custkey").select_raw("round(SUM(o_totalprice), 2)", alias="total").group_by("o_custkey")
    return e.table("customer").left_join_subquery(sub, "t", "c_custkey", "=", "t.o_custkey").select("c_custkey", "t.total")


@query("customer", "orders", sql="SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x")
def lateral_top(e):
    sub = e.table("orders").select("o_orderkey").where_column("orders.o_custkey", "customer.c_custkey").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(2)
    return e.table("customer").join_lateral(sub, "x").select("c_custkey", "x.o_orderkey")


@query("customer", "orders", sql="SELECT c_custkey, x.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 190000 ORDER BY o_orderkey LIMIT 1) x ON TRUE")
def left_lateral_top(e):
    sub = e.table("orders").select("o_orderkey").where_column("orders.o_custkey", "customer.c_custkey").where("o_totalprice", ">", 190000).order_by("o_orderkey").limit(1)
    return e.table("customer").left_join_lateral(sub, "x").select("c_custkey", "x.o_orderkey")


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS qty, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING SUM(l_quantity) > 1000 OR l_returnflag = 'N' AND COUNT(*) > 1")
def group_having(e):
    q = e.table("lineitem").select("l_returnflag", "l_linestatus").select_raw("round(SUM(l_quantity), 2)", alias="qty").select_count(alias="n").group_by("l_returnflag", "l_linestatus")
    return q.having_raw("SUM(l_quantity) > :q", {"q": 1000}).or_having("l_returnflag", "=", "N").having_raw("COUNT(*) > 1")


@query("lineitem", sql="SELECT CAST(COUNT(DISTINCT l_suppkey) AS BIGINT) AS suppliers, MIN(l_shipdate) AS first, MAX(l_quantity) AS most, round(AVG(l_discount), 6) AS discount FROM lineitem")
def aggregates(e):
    return e.table("lineitem").select_count("l_suppkey", alias="suppliers").distinct("l_suppkey").min("l_shipdate", alias="first").max("l_quantity", alias="most").select_raw("round(AVG(l_discount), 6)", alias="discount")


@query("lineitem", sql="SELECT l_returnflag, round(SUM(l_tax), 2) AS tax FROM lineitem GROUP BY l_returnflag")
def sum_by_flag(e):
    return e.table("lineitem").select("l_returnflag").select_raw("round(SUM(l_tax), 2)", alias="tax").group_by("l_returnflag")


@query("customer", "supplier", sql="SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000")
def union(e):
    return e.table("customer").select("c_nationkey as k").where("c_acctbal", ">", 5000).union(e.table("supplier").select("s_nationkey as k"))


@query("customer", "supplier", sql="SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey AS k FROM customer")
def union_all(e):
    return e.table("customer").select("c_nationkey as k").union_all(e.table("supplier").select("s_nationkey as k"))


@dataclass
class Party:
    id: int
    name: str
    segment: str


@query("customer", "supplier", sql="SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_projection_fill(e):
    suppliers = project.apply_projection(e.table("supplier"), Party, {"id": projection("s_suppkey"), "name": projection("s_name")})
    customers = project.apply_projection(e.table("customer"), Party, {"id": "c_custkey", "name": "c_name", "segment": "c_mktsegment"})
    return customers.union_all(suppliers)


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR o_totalprice = 150000 AND o_orderkey > 100 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def keyset_after(e):
    q = e.table("orders").select("o_orderkey", "o_totalprice").where_cursor_after([cursor_desc("o_totalprice"), cursor_asc("o_orderkey")], [150000.0, 100])
    return q.order_by("o_totalprice", "desc").order_by("o_orderkey").limit(50)


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 OR o_totalprice = 150000 AND o_orderkey < 100")
def keyset_before(e):
    return scopes.apply_scopes(e.table("orders").select("o_orderkey", "o_totalprice"), scopes.cursor_before([cursor_desc("o_totalprice"), cursor_asc("o_orderkey")], 150000.0, 100))


@query("orders", sql="SELECT o_orderkey FROM orders WHERE month(o_orderdate) = 3 AND year(o_orderdate) >= 1995 OR day(o_orderdate) = 1 OR CAST(o_orderdate AS DATE) = DATE '1996-01-02'")
def date_parts(e):
    return e.table("orders").select("o_orderkey").where_month("o_orderdate", "=", "3").where_year("o_orderdate", ">=", "1995").or_where_day("o_orderdate", "=", "1").or_where_date("o_orderdate", "=", "1996-01-02")


@query("events", sql="SELECT event_id FROM events WHERE CAST(ts AS TIME) >= TIME '12:30:00' AND CAST(ts AS DATE) < DATE '2024-01-10'")
def time_of_day(e):
    return e.table("events").select("event_id").where_time("ts", ">=", "12:30:00").where_date("ts", "<", "2024-01-10")


@query("events", sql="SELECT event_id, props ->> '$.k' AS k FROM events WHERE props ->> '$.k' = '7' OR json_extract(props, '$.zz') IS NOT NULL")
def json_text(e):
    return e.table("events").select("event_id").select_raw("get_json_object(props, '$.k')", alias="k").where_json_text("props", "k", 7).or_where_json_has_key("props", "zz")


@query("events", sql="SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND NOT (json_extract(props, '$.q') IS NOT NULL) AND CAST(props ->> '$.k' AS INTEGER) = 3")
def json_keys(e):
    return e.table("events").select("event_id").where_json_has_key("props", "k").where_json_not_has_key("props", "q").where_json_contains("props", {"k": 3})


@query("nation", sql="SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS body FROM nation")
def json_build(e):
    p = build_object({"name": "n_name", "key": "n_nationkey"})
    return e.table("nation").select("n_nationkey").select_raw(p.sql, alias="body")


@query("nation", "region", sql="SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey DESC) FILTER (WHERE n_nationkey > 1) || ']' AS names FROM nation GROUP BY n_regionkey")
def json_agg(e):
    p = aggregate_array("n_name", order_by=("n_nationkey desc",), where="n_nationkey > 1")
    return e.table("nation").select("n_regionkey").select_raw(p.sql, alias="names").group_by("n_regionkey")


@query("part", sql="SELECT p_partkey FROM part WHERE p_name ILIKE '%blue%' OR p_type ILIKE '%blue%' OR (p_brand ILIKE '%d#1%')")
def text_search(e):
    return scopes.apply_scopes(e.table("part").select("p_partkey"), scopes.text_search(["p_name", "p_type"], "BLUE")).or_where_text_search(["p_brand"], "D#1")


@query("documents", sql="SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^a-zA-Z0-9_à-ÿÀ-ß])(?i:the)([^a-zA-Z0-9_à-ÿÀ-ß]|$)') AND regexp_matches(text, '(^|[^a-zA-Z0-9_à-ÿÀ-ß])(?i:was)([^a-zA-Z0-9_à-ÿÀ-ß]|$)')")
def full_text(e):
    return e.table("documents").select("doc_id").where_full_text(["text"], "the was")


@query("customer", "orders", sql="SELECT c_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def parent_children(e):
    rows = e.table("customer").left_join("orders", "c_custkey", "=", "o_custkey").select("c_custkey", "o_orderkey", "o_orderdate").df()
    got = project.parent_children(rows, ["c_custkey"], ["o_orderkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("c_custkey"))
    return got.where("size(children) > 0").select("c_custkey", F.array_join(F.transform("children", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("customer", "orders", sql="SELECT c_custkey, c_name, n, total FROM customer LEFT JOIN (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON c_custkey = o_custkey")
def hydrate_aggregates(e):
    sums = e.table("orders").select("o_custkey as c_custkey").select_count(alias="n").select_raw("round(SUM(o_totalprice), 2)", alias="total").where("o_orderstatus", "P").group_by("o_custkey")
    return project.hydrate(e.table("customer").select("c_custkey", "c_name").df(), sums.df(), ["c_custkey"])


@query("orders", sql="SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def representative_rows(e):
    return project.representatives(e.table("orders").select("o_custkey", "o_orderkey", "o_orderdate").df(), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


NEW = "SELECT 1 AS c_custkey, 'one' AS c_name, 2 AS c_nationkey, 1.5 AS c_acctbal, 'X' AS c_mktsegment UNION ALL SELECT 900001, 'new', 3, 2.5, 'Y'"
ROWS = [{"c_custkey": 1, "c_name": "one", "c_nationkey": 2, "c_acctbal": 1.5, "c_mktsegment": "X"}, {"c_custkey": 900001, "c_name": "new", "c_nationkey": 3, "c_acctbal": 2.5, "c_mktsegment": "Y"}]


@query("customer", sql=f"WITH n AS ({NEW}) SELECT c.c_custkey, coalesce(n.c_name, c.c_name) AS c_name, c.c_nationkey, CAST(coalesce(n.c_acctbal, c.c_acctbal) AS DOUBLE) AS c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN n USING (c_custkey) UNION ALL SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DOUBLE), c_mktsegment FROM n WHERE c_custkey > 900000")
def upsert_state(e):
    return e.table("customer").upsert(ROWS, ["c_custkey"], ["c_name", "c_acctbal"]).state


@query("customer", sql=f"SELECT * FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DOUBLE), c_mktsegment FROM ({NEW}) WHERE c_custkey > 900000")
def insert_ignore(e):
    return e.table("customer").primary_key("c_custkey").insert_or_ignore(ROWS).state


@query("customer", sql="SELECT * FROM customer UNION ALL SELECT 900002, 'solo', NULL, NULL, NULL")
def insert_row(e):
    return e.table("customer").insert({"c_custkey": 900002, "c_name": "solo"}).state


@query("customer", "supplier", sql="SELECT * FROM customer UNION ALL SELECT s_suppkey + 0, s_name, NULL, NULL, NULL FROM supplier WHERE s_acctbal > 0")
def insert_using(e):
    return e.table("customer").insert_using(["c_custkey", "c_name"], e.table("supplier").select("s_suppkey", "s_name").where("s_acctbal", ">", 0)).state


@query("customer", sql="SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 AND c_acctbal < 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 AND c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_when(e):
    return e.table("customer").where("c_nationkey", 3).where("c_acctbal", "<", 0).update({"c_mktsegment": "DEBT", "c_acctbal": Expr("c_acctbal + ?", (100.0,))}).state


@query("customer", "nation", sql="SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def update_join(e):
    q = e.table("customer").primary_key("c_custkey").join("nation", "customer.c_nationkey", "=", "nation.n_nationkey").where("nation.n_regionkey", 1)
    return q.update({"c_name": Expr("nation.n_name")}).state


@query("events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CASE WHEN event_type = 'error' THEN 'bad' END AS s FROM events")
def update_json(e):
    new = e.table("events").where("event_type", "error").update({"props->flags->s": "bad"}).state
    return new.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.flags.s").alias("s"))


@query("orders", sql="SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def delete_where(e):
    return e.table("orders").where("o_orderstatus", "F").where("o_totalprice", "<", 100000).delete().state


@query("orders", "customer", sql="SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def delete_join(e):
    q = e.table("orders").primary_key("o_orderkey").join("customer", "orders.o_custkey", "=", "customer.c_custkey").where("customer.c_acctbal", "<", 0)
    return q.delete().state


@query("orders", sql="SELECT * FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 10")
def delete_ordered(e):
    return e.table("orders").primary_key("o_orderkey").where("o_orderkey", ">", 0).order_by("o_totalprice").order_by("o_orderkey").limit(10).delete().state


def _governed(e: Engine) -> Engine:
    """Events as a table with a nullable deletion time."""
    deleted = F.expr("CASE WHEN event_type = 'error' THEN ts END AS deleted_at")
    return e.register("governed_events", e.frame("events").select("event_id", "user_id", "event_type", deleted))


POLICY = policy.TablePolicy("governed_events", tenant="user_id", soft_delete="deleted_at")


@query("events", sql="SELECT event_id FROM events WHERE (user_id = 5 OR user_id < 3) AND event_type <> 'error'")
def soft_delete_scope(e):
    policy.register(POLICY)
    return scopes.apply_scopes(_governed(e).table("governed_events").select("event_id"), scopes.tenant_scope(5, "user_id")).or_where("user_id", "<", 3)


@query("events", sql="SELECT event_id FROM events WHERE user_id < 30 AND event_type = 'error'")
def only_deleted(e):
    policy.register(POLICY)
    return _governed(e).table("governed_events").select("event_id").where("user_id", "<", 30).only_deleted()


@query("events", sql="SELECT event_id FROM events WHERE user_id < 30")
def with_deleted(e):
    policy.register(POLICY)
    return _governed(e).table("governed_events").select("event_id").where("user_id", "<", 30).with_deleted()


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000 ORDER BY o_orderkey DESC LIMIT 30")
def op_spec_select(e):
    spec = {"operation": "select", "model": "orders", "select": ["o_orderkey", "o_totalprice"], "filters": [{"field": "o_orderstatus", "op": "in", "value_ref": "statuses"}, {"field": "o_totalprice", "op": ">=", "value": 100000}], "order_by": [{"field": "o_orderkey", "direction": "desc"}], "limit": 30}
    return compile_spec(e, spec, generate(e), {"statuses": ["F", "O"]})


@query("orders", sql="SELECT * FROM (VALUES ('SELECT_STAR_USED', 'medium'), ('LIMIT_MISSING', 'medium'), ('WEAK_PREDICATE', 'high'), ('REQUIRED_PREDICATE_MISSING', 'blocked')) t(code, level)")
def risk_warnings(e):
    plan = scopes.plan_select_by(e.table("orders").where_raw_no_args("1 = 1"), scopes.require_tenant_scope("orders", "o_custkey"))
    return e.spark.createDataFrame([(w.code, w.level) for w in plan.warnings], "code string, level string")


@query("orders", "customer", sql="SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def raw_statement(e):
    return e.require_raw_approval("a report").raw("SELECT o_custkey, COUNT(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey")


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["segment_revenue"](spark, "/root/testdata/sf0.001")
