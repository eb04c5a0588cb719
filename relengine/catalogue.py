"""Queries over the driver's tables, one for each operator and verb, with the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .database import Database
from .dsl import query, relexp
from .errors import UnsupportedExpression
from .functions import pyudf
from .operators import Difference, Empty, Full, Intersect, Join, Mono, Product, Project, Relation, Select, Singleton, Union, Visitor, dependencies
from .sources import Tuples, read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """A database over the tables of a folder; a relation is attached when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.db, self._n = spark, sf_dir, Database(spark), 0

    def frame(self, table: str, *columns: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.dir}/{table}.parquet", *columns)

    def relation(self, table: str, *columns: str, unique: bool = False) -> Relation:
        """A table, or some of its columns; a single one is a scalar ``value``."""
        df = self.frame(table, *columns)
        if len(columns) == 1:
            df = df.toDF("value")
        self._n += 1
        return self.db.attach(f"{table}_{self._n}", df, unique=unique)

    def growing(self, table: str, *columns: str) -> tuple[Relation, Callable[[int], None]]:
        """An empty relation of a table's columns, and a function that inserts the half of its rows whose hash is even or odd."""
        df = self.frame(table, *columns)
        df = df.toDF("value") if len(columns) == 1 else df
        self._n += 1
        r = self.db.add_relation(f"{table}_{self._n}", df.schema)
        half = F.pmod(F.hash(*df.columns), F.lit(2))
        return r, lambda i: self.db.insert(r, df.where(half == i))


def register(sql: str | None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@register("SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM nation")
def relation_scan(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("nation"))


@register("SELECT CAST(42 AS INTEGER) AS value")
def singleton(t: Tables) -> DataFrame:
    return t.db.evaluate(Singleton(42, "int"))


@register("SELECT n_nationkey AS value FROM nation WHERE FALSE")
def empty(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("nation", "n_nationkey").builder().intersect(Empty("int")))


FILTERED = "SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"


def big_finished(r: Relation):
    return r.builder().select(lambda o: (o.o_orderstatus == "F") & (o.o_totalprice > 100000)).project(lambda o: {"o_orderkey": o.o_orderkey, "o_custkey": o.o_custkey})


@register(FILTERED)
def select_filter(t: Tables) -> DataFrame:
    return t.db.evaluate(big_finished(t.relation("orders", unique=True)))


@register("SELECT DISTINCT p_partkey, p_size FROM part WHERE p_size > 2 AND p_size % 2 = 0")
def select_chain(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("part", "p_partkey", "p_size").builder().select(lambda p: p.p_size > 2).select(lambda p: p.p_size % 2 == 0))


@register("SELECT DISTINCT c_mktsegment FROM customer")
def project_dedup(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("customer").builder().project(lambda c: {"c_mktsegment": c.c_mktsegment}))


@register("SELECT DISTINCT l_linenumber * 10 + 1 AS value FROM lineitem")
def project_arith(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("lineitem").builder().project(lambda x: x.l_linenumber * 10 + 1))


@register("SELECT DISTINCT lower(r_name) AS value FROM region")
def project_lower(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("region").builder().project(lambda r: F.lower(r.r_name)))


UNION = "SELECT c_nationkey AS value FROM customer UNION SELECT s_nationkey FROM supplier"
INTERSECT = "SELECT c_nationkey AS value FROM customer INTERSECT SELECT s_nationkey FROM supplier"


@register(UNION)
def union_dedup(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("customer", "c_nationkey").builder().union(t.relation("supplier", "s_nationkey")))


@register(f"{UNION} UNION SELECT n_regionkey FROM nation")
def union_chain(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("customer", "c_nationkey").builder().union(t.relation("supplier", "s_nationkey")).union(t.relation("nation", "n_regionkey")))


@register(INTERSECT)
def intersect_basic(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("customer", "c_nationkey").builder().intersect(t.relation("supplier", "s_nationkey")))


@register("SELECT user_id AS value FROM events INTERSECT SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_chain(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("events", "user_id").builder().intersect(t.relation("customer", "c_custkey")).intersect(t.relation("orders", "o_custkey")))


@register("SELECT o_orderkey AS value FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def difference_basic(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("orders", "o_orderkey").builder().difference(t.relation("lineitem", "l_orderkey")))


@register("SELECT c_custkey AS value FROM customer EXCEPT SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def difference_chain(t: Tables) -> DataFrame:
    finished = t.relation("orders").builder().select(lambda o: o.o_orderstatus == "F").project(lambda o: o.o_custkey)
    return t.db.evaluate(t.relation("customer", "c_custkey").builder().difference(t.relation("events", "user_id")).difference(finished))


@register("SELECT n_nationkey AS value FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def difference_select(t: Tables) -> DataFrame:
    poor = t.relation("supplier").builder().select(lambda s: s.s_acctbal < 0).project(lambda s: s.s_nationkey)
    return t.db.evaluate(t.relation("nation", "n_nationkey").builder().difference(poor).select(lambda v: v % 3 == 1))


PRODUCT = "SELECT DISTINCT l.n_nationkey + r.r_regionkey AS value FROM nation l CROSS JOIN region r"


@register(PRODUCT)
def product_map(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("nation", "n_nationkey").builder().product(t.relation("region", "r_regionkey")).on(lambda a, b: a + b))


@register("SELECT DISTINCT l.n_nationkey + r.r_regionkey + s.s_nationkey AS value FROM nation l CROSS JOIN region r CROSS JOIN supplier s")
def product_chain(t: Tables) -> DataFrame:
    first = t.relation("nation", "n_nationkey").builder().product(t.relation("region", "r_regionkey")).on(lambda a, b: a + b)
    return t.db.evaluate(first.product(t.relation("supplier", "s_nationkey").builder().project(lambda s: s)).on(lambda a, b: a + b))


@register("SELECT DISTINCT c.c_name, o.o_orderpriority FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def join_equi(t: Tables) -> DataFrame:
    c, o = t.relation("customer").builder(), t.relation("orders").builder()
    return t.db.evaluate(c.with_key(lambda x: x.c_custkey).join(o.with_key(lambda x: x.o_custkey)).on(lambda _, x, y: {"c_name": x.c_name, "o_orderpriority": y.o_orderpriority}))


CHAIN = "SELECT DISTINCT c.c_mktsegment, l.l_suppkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey"


def chain(c, o, items):
    placed = c.builder().with_key(lambda x: x.c_custkey).join(o.builder().with_key(lambda x: x.o_custkey)).on(lambda _, x, y: {"segment": x.c_mktsegment, "orderkey": y.o_orderkey})
    return placed.with_key(lambda x: x.orderkey).join(items.builder().with_key(lambda x: x.l_orderkey)).on(lambda _, x, y: {"c_mktsegment": x.segment, "l_suppkey": y.l_suppkey})


@register(CHAIN)
def join_chain(t: Tables) -> DataFrame:
    return t.db.evaluate(chain(t.relation("customer", "c_custkey", "c_mktsegment"), t.relation("orders", "o_orderkey", "o_custkey"), t.relation("lineitem", "l_orderkey", "l_suppkey")))


@register("SELECT DISTINCT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_nationkey % 5 = r.r_regionkey")
def join_computed_key(t: Tables) -> DataFrame:
    n, r = t.relation("nation").builder(), t.relation("region").builder()
    return t.db.evaluate(n.with_key(lambda x: x.n_nationkey % 5).join(r.with_key(lambda x: x.r_regionkey)).on(lambda _, x, y: {"n_name": x.n_name, "r_name": y.r_name}))


@register("SELECT DISTINCT a.n_name AS l_name, b.s_suppkey FROM nation a JOIN supplier b ON NULLIF(a.n_nationkey, 0) IS NOT DISTINCT FROM NULLIF(b.s_nationkey, 0)")
def join_null_key(t: Tables) -> DataFrame:
    n, s = t.relation("nation").builder(), t.relation("supplier").builder()
    return t.db.evaluate(n.with_key(lambda x: F.nullif(x.n_nationkey, F.lit(0))).join(s.with_key(lambda x: F.nullif(x.s_nationkey, F.lit(0)))).on(lambda _, x, y: {"l_name": x.n_name, "s_suppkey": y.s_suppkey}))


@register("SELECT DISTINCT o.o_orderkey, o.o_custkey FROM orders o JOIN events e ON o.o_custkey = e.user_id AND o.o_orderkey % 10 = e.event_id % 10")
def join_composite_key(t: Tables) -> DataFrame:
    o, e = t.relation("orders").builder(), t.relation("events").builder()
    return t.db.evaluate(o.with_key(lambda x: (x.o_custkey, x.o_orderkey % 10)).join(e.with_key(lambda x: (x.user_id, x.event_id % 10))).on(lambda _, x, y: {"o_orderkey": x.o_orderkey, "o_custkey": x.o_custkey}))


@register("SELECT DISTINCT s.s_name FROM supplier s JOIN lineitem l ON s.s_suppkey = l.l_suppkey")
def join_left_only(t: Tables) -> DataFrame:
    s, x = t.relation("supplier").builder(), t.relation("lineitem", "l_suppkey").builder()
    return t.db.evaluate(s.with_key(lambda v: v.s_suppkey).join(x.with_key(lambda v: v)).on(lambda _, a, b: {"s_name": a.s_name}))


@register("SELECT DISTINCT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(t: Tables) -> DataFrame:
    n = t.relation("nation").builder().with_key(lambda x: x.n_regionkey)
    return t.db.evaluate(n.join(n).on(lambda _, a, b: {"a_name": a.n_name, "b_name": b.n_name}))


@register("SELECT DISTINCT s.s_name AS value FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_3'")
def join_select_project(t: Tables) -> DataFrame:
    s, n = t.relation("supplier").builder(), t.relation("nation").builder()
    pairs = s.with_key(lambda x: x.s_nationkey).join(n.with_key(lambda x: x.n_nationkey)).on(lambda _, x, y: (x.s_name, y.n_name))
    return t.db.evaluate(pairs.select(lambda p: p._2 == "NATION_3").project(lambda p: p._1))


def named(t: Tables, keys):
    return keys.with_key(lambda v: v).join(t.relation("nation").builder().with_key(lambda n: n.n_nationkey)).on(lambda _, v, n: {"n_name": n.n_name})


@register(f"SELECT DISTINCT n.n_name FROM ({UNION}) u JOIN nation n ON u.value = n.n_nationkey")
def union_then_join(t: Tables) -> DataFrame:
    return t.db.evaluate(named(t, t.relation("customer", "c_nationkey").builder().union(t.relation("supplier", "s_nationkey"))))


NAMED = f"SELECT DISTINCT n.n_name FROM ({INTERSECT}) u JOIN nation n ON u.value = n.n_nationkey"


@register(NAMED)
def intersect_then_join(t: Tables) -> DataFrame:
    return t.db.evaluate(named(t, t.relation("customer", "c_nationkey").builder().intersect(t.relation("supplier", "s_nationkey"))))


@register("SELECT DISTINCT o.o_custkey, o.o_totalprice FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem) d JOIN orders o ON d.k = o.o_orderkey")
def difference_then_join(t: Tables) -> DataFrame:
    d = t.relation("orders", "o_orderkey").builder().difference(t.relation("lineitem", "l_orderkey"))
    o = t.relation("orders").builder()
    return t.db.evaluate(d.with_key(lambda v: v).join(o.with_key(lambda x: x.o_orderkey)).on(lambda _, v, x: {"o_custkey": x.o_custkey, "o_totalprice": x.o_totalprice}))


@register("SELECT len(embedding)::INTEGER AS width, list_sum(list_transform(embedding, lambda x: floor(1000 * x)))::BIGINT AS total FROM (SELECT embedding FROM embeddings EXCEPT SELECT embedding FROM embeddings WHERE label = 0)")
def difference_arrays(t: Tables) -> DataFrame:
    zero = t.relation("embeddings").builder().select(lambda e: e.label == 0).project(lambda e: e.embedding)
    d = t.db.evaluate(t.relation("embeddings", "embedding").builder().difference(zero))
    return d.select(F.array_size("value").alias("width"), thousandths("value", d.schema["value"].dataType.elementType).alias("total"))


def thousandths(vector: str, kind: DataType) -> Column:
    """The sum of floor(1000 * x) over a vector, as SQL has it: products are of the components' own type and added up as doubles.

    Nulls are left out; a vector without numbers has none.  F.floor would clip products beyond a long; a total beyond it, or NaN, raises.
    """

    def floor(x: Column) -> Column:
        product = F.lit(1000).cast(kind) * x
        nearest = F.rint(product)
        return nearest - (nearest > product).cast("double")

    known = F.filter(vector, lambda x: x.isNotNull())
    return F.when(F.array_size(known) > 0, F.aggregate(F.transform(known, floor), F.lit(0.0), lambda a, x: a + x).cast("long"))


@register("SELECT DISTINCT ts, user_id FROM events WHERE event_type = 'error'")
def events_timestamp(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("events").builder().select(lambda e: e.event_type == "error").project(lambda e: {"ts": e.ts, "user_id": e.user_id}))


@register("SELECT DISTINCT r_name AS value FROM region WHERE contains(r_name, 'A') OR contains(r_name, '1')")
def select_contains(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("region", "r_name").builder().select(lambda v: v.contains("A") | v.contains("1")))


@register("SELECT DISTINCT concat(n_name, CAST(n_nationkey // 2 AS VARCHAR)) AS value FROM nation")
def project_concat_div(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("nation").builder().project(lambda n: F.concat(n.n_name, F.expr("n_nationkey div 2").cast("string"))))


@register(f"SELECT DISTINCT value * 10 AS value FROM ({INTERSECT}) t WHERE value % 2 = 1")
def mono_int(t: Tables) -> DataFrame:
    tree = t.relation("customer", "c_nationkey").builder().intersect(t.relation("supplier", "s_nationkey")).select(lambda v: v % 2 == 1).project(lambda v: v * 10)
    return t.db.evaluate(Mono.of(tree))


def grown(t: Tables, view, *inserts) -> DataFrame:
    """A view after two rounds of inserts, read in between, so that the second is incremental."""
    for half in (0, 1):
        for insert in inserts:
            insert(half)
        if half == 0:
            t.db.evaluate(view)
    return t.db.evaluate(view)


@register(FILTERED)
def view_select(t: Tables) -> DataFrame:
    r, insert = t.growing("orders")
    return grown(t, t.db.store_view(big_finished(r)), insert)


@register(UNION)
def view_union(t: Tables) -> DataFrame:
    (c, more_c), (s, more_s) = t.growing("customer", "c_nationkey"), t.growing("supplier", "s_nationkey")
    return grown(t, t.db.store_view(c.builder().union(s)), more_c, more_s)


@register(NAMED)
def view_intersect_join(t: Tables) -> DataFrame:
    (c, more_c), (s, more_s) = t.growing("customer", "c_nationkey"), t.growing("supplier", "s_nationkey")
    return grown(t, t.db.store_view(named(t, c.builder().intersect(s))), more_c, more_s)


@register(CHAIN)
def view_join_chain(t: Tables) -> DataFrame:
    parts = t.growing("customer", "c_custkey", "c_mktsegment"), t.growing("orders", "o_orderkey", "o_custkey"), t.growing("lineitem", "l_orderkey", "l_suppkey")
    return grown(t, t.db.store_view(chain(*(r for r, _ in parts))), *(f for _, f in parts))


@register(PRODUCT)
def view_product(t: Tables) -> DataFrame:
    (n, more_n), (r, more_r) = t.growing("nation", "n_nationkey"), t.growing("region", "r_regionkey")
    return grown(t, t.db.store_view(n.builder().product(r).on(lambda a, b: a + b)), more_n, more_r)


@register("SELECT DISTINCT c_nationkey * 2 AS value FROM customer WHERE c_nationkey > 5")
def view_over_view(t: Tables) -> DataFrame:
    c, more = t.growing("customer", "c_nationkey")
    first = t.db.store_view(c.builder().select(lambda v: v > 5))
    return grown(t, t.db.store_view(first.builder().project(lambda v: v * 2)), more)


@register("SELECT DISTINCT c_nationkey + c_nationkey AS value FROM customer")
def view_diamond(t: Tables) -> DataFrame:
    r, more = t.growing("customer", "c_nationkey")
    v1 = t.db.store_view(r)
    v2 = t.db.store_view(r.builder().with_key(lambda v: v).join(v1.builder().with_key(lambda v: v)).on(lambda _, a, b: a + b))
    t.db.store_view(r)
    return grown(t, v2, more)


@register("SELECT n_nationkey AS value FROM nation UNION SELECT n_nationkey FROM nation WHERE FALSE")
def clone_snapshot(t: Tables) -> DataFrame:
    n = t.relation("nation", "n_nationkey")
    snapshot = t.db.clone()
    t.db.insert(n, [1000, 1001])
    t.db.evaluate(n)
    return snapshot.evaluate(n)


@register("SELECT DISTINCT p_partkey, p_size FROM part WHERE p_size > 2")
def dsl_select(t: Tables) -> DataFrame:
    return query(t.db, "select [p_partkey as p_partkey, p_size as p_size] from (part) where [p_size > 2]", part=t.relation("part"))


@register("SELECT DISTINCT c.c_name, o.o_orderpriority FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def dsl_join(t: Tables) -> DataFrame:
    e = relexp("(c) join (o) on [c_custkey; o_custkey] with [l.c_name as c_name, r.o_orderpriority as o_orderpriority]", c=t.relation("customer"), o=t.relation("orders"))
    return t.db.evaluate(e)


@register("SELECT o_orderkey AS value FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def dsl_minus(t: Tables) -> DataFrame:
    return query(t.db, "(o) minus (l)", o=t.relation("orders", "o_orderkey"), l=t.relation("lineitem", "l_orderkey"))


@register("SELECT DISTINCT n.n_nationkey * 10 + r.r_regionkey AS code, n.n_name FROM nation n CROSS JOIN region r")
def dsl_cross(t: Tables) -> DataFrame:
    return query(t.db, "(n) cross (r) on [l.n_nationkey * 10 + r.r_regionkey as code, l.n_name as n_name]", n=t.relation("nation"), r=t.relation("region"))


@register(f"SELECT value FROM ({UNION}) u WHERE value > 3")
def dsl_union(t: Tables) -> DataFrame:
    return query(t.db, "select * from ((c) union (s)) where [value > 3]", c=t.relation("customer", "c_nationkey"), s=t.relation("supplier", "s_nationkey"))


@register(INTERSECT)
def dsl_intersect(t: Tables) -> DataFrame:
    return query(t.db, "(c) intersect (s)", c=t.relation("customer", "c_nationkey"), s=t.relation("supplier", "s_nationkey"))


@register("SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) o WHERE o_orderstatus = 'O'")
def dsl_select_all(t: Tables) -> DataFrame:
    return query(t.db, "select * from (o) where [o_orderstatus = 'O']", o=t.relation("orders", "o_orderkey", "o_custkey", "o_orderstatus"))


@register("SELECT 7 AS a, 'seven' AS b")
def dsl_singleton(t: Tables) -> DataFrame:
    return query(t.db, "[struct(7 as a, 'seven' as b)]").select(F.col("value.a").alias("a"), F.col("value.b").alias("b"))


@register("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (5, 'five')) t(n, word)")
def dsl_create_relation_insert(t: Tables) -> DataFrame:
    r = query(t.db, 'create relation "words" : <n int, word string>')
    query(t.db, "insert into (r) values [struct(1, 'one'), struct(2, 'two'), struct(2, 'two')]", r=r)
    query(t.db, "insert into (r) values [struct(5, 'five'), struct(1, 'one')]", r=r)
    return query(t.db, "r", r=r)


@register("SELECT DISTINCT o_custkey AS value FROM orders WHERE o_orderstatus = 'F'")
def dsl_create_view(t: Tables) -> DataFrame:
    r, insert = t.growing("orders", "o_custkey", "o_orderstatus")
    return grown(t, query(t.db, "create view as (select [o_custkey] from (r) where [o_orderstatus = 'F'])", r=r), insert)


@register("SELECT DISTINCT n_name FROM nation WHERE list_contains(string_split(n_name, '_'), '3') OR list_contains(string_split(n_name, '_'), '11')")
def select_array_contains(t: Tables) -> DataFrame:
    parts = t.relation("nation").builder().project(lambda n: {"n_name": n.n_name, "parts": F.split(n.n_name, "_")})
    return t.db.evaluate(parts.select(lambda x: F.array_contains(x.parts, "3") | F.array_contains(x.parts, "11")).project(lambda x: {"n_name": x.n_name}))


@register("SELECT DISTINCT reverse(n_name) AS value FROM nation WHERE length(n_name) % 2 = 0")
def closure_in_python(t: Tables) -> DataFrame:
    even = pyudf(lambda s: len(s) % 2 == 0, "boolean")
    return t.db.evaluate(t.relation("nation", "n_name").builder().select(even).project(pyudf(lambda s: s[::-1], "string")))


@register("SELECT DISTINCT c_custkey % 7 AS value FROM customer WHERE c_custkey % 2 = 0")
def built_expression(t: Tables) -> DataFrame:
    return t.db.evaluate(t.relation("customer", "c_custkey").builder().select(lambda v: v % 2 == 0).project(lambda v: v % 7).build())


@register("SELECT r_name AS value FROM region UNION SELECT 'ATLANTIS' UNION SELECT 'MU'")
def tuples_round_trip(t: Tables) -> DataFrame:
    names = t.db.tuples(t.relation("region", "r_name"))
    r = t.db.add_relation("names", "string")
    t.db.insert(r, Tuples(["MU", *names, "ATLANTIS"]).merge(["MU"]))
    return t.db.evaluate(r)


@register("SELECT n_regionkey AS value FROM nation UNION SELECT 99")
def view_singleton(t: Tables) -> DataFrame:
    r, insert = t.growing("nation", "n_regionkey")
    return grown(t, t.db.store_view(r.builder().union(Singleton(99, "bigint" if dict(t.frame("nation").dtypes)["n_regionkey"] == "bigint" else "int"))), insert)


@register("SELECT DISTINCT n_regionkey AS value FROM nation")
def view_empty(t: Tables) -> DataFrame:
    r, insert = t.growing("nation", "n_regionkey")
    return grown(t, t.db.store_view(Union(Select(Empty(r.schema), lambda v: v > 0), r)), insert)


@register("SELECT DISTINCT n_nationkey + 1 AS value FROM nation")
def view_of_old_tuples(t: Tables) -> DataFrame:
    r, insert = t.growing("nation", "n_nationkey")
    insert(0)
    t.db.evaluate(r).count()  # the relation has taken them in before there is a view
    view = t.db.store_view(r.builder().project(lambda v: v + 1))
    insert(1)
    return t.db.evaluate(view)


def refused(t: Tables, *attempts: Callable) -> DataFrame:
    """What each attempt raises: the expression's name and the operation."""
    rows = []
    for attempt in attempts:
        try:
            attempt()
        except UnsupportedExpression as e:
            rows.append((e.name, e.operation))
    return t.spark.createDataFrame(rows, "name string, operation string")


@register("SELECT * FROM (VALUES ('Full', 'Evaluate'), ('Full', 'Evaluate')) t(name, operation)")
def full_is_refused(t: Tables) -> DataFrame:
    full = Full("int")
    return refused(t, lambda: t.db.evaluate(full), lambda: t.db.evaluate(Product(t.relation("nation", "n_nationkey"), full, lambda a, b: a)), lambda: t.db.evaluate(Empty("int")))


@register("SELECT * FROM (VALUES ('Difference', 'Create View'), ('Difference', 'Create View'), ('Full', 'Evaluate')) t(name, operation)")
def views_are_validated(t: Tables) -> DataFrame:
    r = t.relation("nation", "n_nationkey")
    inside = r.builder().union(r.builder().difference(r)).select(lambda v: v > 0)
    return refused(t, lambda: t.db.store_view(r.builder().difference(r)), lambda: t.db.store_view(inside), lambda: t.db.store_view(Union(r, Full(r.schema))), lambda: t.db.store_view(r))


class Outline(Visitor):
    """Names of nodes in the order of a walk, with their depth."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, str]] = []
        self.depth = 0

    def walk(self, e) -> None:
        self.rows.append((len(self.rows), self.depth, type(e).__name__))
        self.depth += 1
        super().walk(e)
        self.depth -= 1


def outlined(t: Tables):
    n, r, s = t.relation("nation", "n_nationkey"), t.relation("region", "r_regionkey"), t.relation("supplier", "s_nationkey")
    view = t.db.store_view(s)
    pairs = Product(Union(n, r), Select(view, lambda v: v > 1), lambda a, b: a + b)
    return Project(Join(pairs, Difference(n, r), lambda v: v, lambda v: v, lambda k, a, b: a), lambda v: v * 2), (n, r, s), view


@register("SELECT * FROM (VALUES (0, 0, 'Project'), (1, 1, 'Join'), (2, 2, 'Product'), (3, 3, 'Union'), (4, 4, 'Relation'), (5, 4, 'Relation'), (6, 3, 'Select'), (7, 4, 'View'), (8, 2, 'Difference'), (9, 3, 'Relation'), (10, 3, 'Relation')) t(place, depth, node)")
def visitor_walk(t: Tables) -> DataFrame:
    seen = Outline()
    outlined(t)[0].visit(seen)
    return t.spark.createDataFrame(seen.rows, "place int, depth int, node string")


@register("SELECT * FROM (VALUES ('nation_1', FALSE), ('region_2', FALSE), ('the view', TRUE)) t(name, is_view)")
def dependencies_of_a_tree(t: Tables) -> DataFrame:
    e, _, view = outlined(t)
    relations, views = dependencies(e)
    rows = [(n, False) for n in relations] + [("the view", True) for v in views if v is view]
    return t.spark.createDataFrame(rows, "name string, is_view boolean")


@register("SELECT * FROM (VALUES ('of the projection', 'Join'), ('left of the join', 'Product'), ('right of the join', 'Difference'), ('left of the product', 'Union'), ('of the selection', 'View')) t(place, node)")
def parts_of_a_tree(t: Tables) -> DataFrame:
    e = outlined(t)[0]
    j = e.expression
    found = {"of the projection": j, "left of the join": j.left, "right of the join": j.right, "left of the product": j.left.left, "of the selection": j.left.right.expression}
    return t.spark.createDataFrame([(k, type(v).__name__) for k, v in found.items()], "place string, node string")


@register("SELECT DISTINCT n_nationkey AS value FROM nation WHERE n_nationkey > 0 AND n_nationkey % 2 = 0")
def nodes_without_builders(t: Tables) -> DataFrame:
    """Nodes take expressions and builders that aren't built alike."""
    n = t.relation("nation", "n_nationkey")
    return t.db.evaluate(Intersect(n.builder().select(lambda v: v > 0), Select(n, lambda v: v % 2 == 0)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders and their priorities: a null-safe join, a selection and a projection."""
    t = Tables(spark, sf_dir)
    c, o = t.relation("customer").builder(), t.relation("orders").builder().select(lambda x: x.o_orderstatus == "F")
    return t.db.evaluate(c.with_key(lambda x: x.c_custkey).join(o.with_key(lambda x: x.o_custkey)).on(lambda _, x, y: {"c_name": x.c_name, "o_orderpriority": y.o_orderpriority}))
