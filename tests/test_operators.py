import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType

from relengine import Difference, Empty, Full, InstanceExists, InstanceNotFound, Intersect, Join, Mono, Product, Project, Relation, Select, Singleton, Union, UnsupportedExpression, Visitor, pyudf
from relengine.operators import dependencies


def ints(db, name, values):
    r = db.add_relation(name, "int")
    db.insert(r, values)
    return r


def pairs(db, name, values):
    r = db.add_relation(name, "_1 int, _2 int")
    db.insert(r, values)
    return r


def test_leaves(db):
    assert db.tuples(Singleton(42, "int")) == [42]
    assert db.tuples(Singleton((1, "a"))) == [(1, "a")]
    assert db.tuples(Empty("int")) == []
    assert db.tuples(ints(db, "r", [3, 1, 2, 1])) == [1, 2, 3]
    assert db.tuples(db.add_relation("none", "string")) == []
    for e in (Full("int"), Select(Full("int"), lambda v: v > 0), Product(Empty("int"), Full("int"), lambda a, b: a)):
        with pytest.raises(UnsupportedExpression) as err:
            db.evaluate(e)
        assert (err.value.name, err.value.operation) == ("Full", "Evaluate")


def test_unknown_and_repeated_relations(db, spark):
    r = ints(db, "r", [1])
    with pytest.raises(InstanceExists):
        db.add_relation("r", "int")
    for bad in (Relation("s", "int"), Relation("r", "string")):
        with pytest.raises(InstanceNotFound):
            db.evaluate(bad)
        with pytest.raises(InstanceNotFound):
            db.insert(bad, [1])
        with pytest.raises(InstanceNotFound):
            db.store_view(r.builder().product(bad).on(lambda a, b: a))
    assert db.tuples(Relation("r", "int")) == [1]
    with pytest.raises(TypeError):
        db.add_relation("m", MapType(StringType(), IntegerType()))


def test_select_and_project(db):
    r = ints(db, "r", range(1, 7))
    assert db.tuples(r.builder().select(lambda v: v % 2 == 0)) == [2, 4, 6]
    assert db.tuples(r.builder().select(lambda v: v % 2 == 0).select(lambda v: v > 3)) == [4, 6]
    assert db.tuples(r.builder().project(lambda v: v % 3)) == [0, 1, 2]
    assert db.tuples(r.builder().project(lambda v: (v, v * 2)).select(lambda t: t[1] > 8).project(lambda t: t._1)) == [5, 6]
    assert db.tuples(r.builder().project(lambda v: True)) == [True]
    towns = db.add_relation("towns", "string")
    db.insert(towns, ["Oslo", "ULM", "graz"])
    assert db.tuples(towns.builder().project(F.lower)) == ["graz", "oslo", "ulm"]
    assert db.tuples(towns.builder().select(lambda s: s.contains("l"))) == ["Oslo"]
    assert db.tuples(towns.builder().project(pyudf(lambda s: s[::-1], "string"))) == ["MLU", "olsO", "zarg"]


def test_union_intersect_difference(db):
    sets = {"low": set(range(0, 14)), "thirds": set(range(0, 40, 3)), "squares": {v * v for v in range(7)}}
    r, s, t = (ints(db, n, sorted(v, reverse=True) * 2) for n, v in sets.items())
    a, b, c = sets.values()
    assert set(db.tuples(r.builder().union(s).union(t))) == a | b | c
    assert set(db.tuples(r.builder().intersect(s).intersect(t))) == a & b & c
    assert set(db.tuples(s.builder().difference(r).difference(t))) == b - a - c
    assert set(db.tuples(s.builder().difference(r.builder().difference(t)))) == b - (a - c)
    assert db.tuples(t.builder().difference(t)) == [] and set(db.tuples(t.builder().difference(Empty("int")))) == c
    assert db.tuples(Union(Empty("int"), Singleton(-3, "int"))) == [-3]
    with pytest.raises(TypeError):
        Union(r, Singleton("a"))
    arrays = [db.add_relation(n, ArrayType(IntegerType())) for n in ("x", "y")]
    db.insert(arrays[0], [[9, 8], [7], [9, None], [7]])
    db.insert(arrays[1], [[7]])
    assert db.tuples(Difference(*arrays)) == [[9, None], [9, 8]]


def test_selection_goes_to_both_sides_of_set_operations(db):
    r, s = ints(db, "r", range(10)), ints(db, "s", range(5, 15))
    for node, want in ((Intersect, {6, 8}), (Difference, {0, 2, 4})):
        assert set(db.tuples(Select(node(r, s), lambda v: v % 2 == 0))) == want


def test_product(db):
    heights, offsets = {3, 50, 51, 700}, {-2, 0, 9}
    r, s = ints(db, "heights", heights), ints(db, "offsets", offsets)
    assert set(db.tuples(r.builder().product(s).on(lambda a, b: a * 2 - b))) == {a * 2 - b for a in heights for b in offsets}
    nested = Product(s, Product(r, s, lambda a, b: a * 1000 + b), lambda a, b: (a, b))
    assert set(db.tuples(nested)) == {(x, a * 1000 + b) for x in offsets for a in heights for b in offsets}
    assert db.tuples(Product(r, Empty("int"), lambda a, b: a)) == []


def test_join(db):
    trains = [(7, 70), (8, 81), (7, 72), (9, 90), (8, 81)]
    crews = [(8, 3), (7, 1), (10, 4), (8, 5)]
    depots = [(70, 11), (72, 12), (81, 13), (99, 14)]
    r, s, t = pairs(db, "trains", trains), pairs(db, "crews", crews), pairs(db, "depots", depots)
    key = lambda x: x._1
    manned = r.builder().with_key(key).join(s.builder().with_key(key)).on(lambda _, a, b: (a._2, b._2))
    want = {(a[1], b[1]) for a in trains for b in crews if a[0] == b[0]}
    assert set(db.tuples(manned)) == want
    placed = manned.with_key(key).join(t.builder().with_key(key)).on(lambda k, a, b: (k, a._2 + b._2))
    assert set(db.tuples(placed)) == {(a[0], a[1] + b[1]) for a in want for b in depots if a[0] == b[0]}
    assert db.tuples(Join(Singleton((20, 4)), Singleton((25, 6)), lambda x: x._1, lambda x: x._1 - 5, lambda k, a, b: (b._2, k, a._2))) == [(6, 20, 4)]
    gates, numbers = db.add_relation("gates", "_1 int, _2 string"), ints(db, "numbers", [4, 6, 31])
    db.insert(gates, [(4, "north"), (5, "east"), (6, "west")])
    assert db.tuples(Join(gates, numbers, lambda x: x._1, lambda v: v, lambda k, a, v: F.concat(a._2, F.lit("-"), (k * v).cast("string")))) == ["north-16", "west-36"]
    with pytest.raises(TypeError):
        db.evaluate(Join(gates, numbers, lambda x: x._2, lambda v: v, lambda k, a, v: v))


def test_keys_are_null_safe(db):
    r, s = db.add_relation("r", "k int, v string"), db.add_relation("s", "k int, w string")
    db.insert(r, [(None, "a"), (1, "b"), (None, "a")])
    db.insert(s, [(None, "x"), (1, "y"), (2, "z")])
    e = Join(r, s, lambda x: x.k, lambda x: x.k, lambda k, a, b: (k, a.v, b.w))
    assert db.tuples(e) == [(None, "a", "x"), (1, "b", "y")]
    assert db.tuples(Join(r, s, lambda x: (x.k, 1), lambda x: (x.k, 1), lambda k, a, b: a.v)) == ["a", "b"]
    assert db.tuples(Intersect(Project(r, lambda x: x.k), Project(s, lambda x: x.k))) == [None, 1]
    assert db.tuples(Difference(Project(s, lambda x: x.k), Project(r, lambda x: x.k))) == [2]


def test_what_a_join_reads_is_found_by_resolution(db):
    """A text that looks like the other side's column doesn't count, and a key alone needs no side's tuples."""
    r, s = pairs(db, "r", [(1, 2), (3, 4)]), pairs(db, "s", [(1, 5), (1, 6)])
    e = Join(r, s, lambda x: x._1, lambda x: x._1, lambda k, a, b: (F.lit("r._2"), a._2))
    assert db.tuples(e) == [("r._2", 2)] and "LeftSemi" in plan_of(db.evaluate(e))
    assert db.tuples(Join(r, s, lambda x: x._1, lambda x: x._1, lambda k, a, b: k)) == [1]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans(db, spark):
    r, s = db.add_relation("r", "k int not null, v string"), db.add_relation("s", "k int, w string")
    db.insert(r, [(1, "b")])
    db.insert(s, [(1, "y")])
    both = Join(r, s, lambda x: x.k, lambda x: x.k, lambda k, a, b: (a.v, b.w))
    assert "<=>" not in plan_of(db.evaluate(both))  # one key can't be null
    left = Join(s, r, lambda x: x.k, lambda x: x.k, lambda k, a, b: a.w)
    assert "LeftSemi" in plan_of(db.evaluate(left)) and db.tuples(left) == ["y"]
    right = Join(s, r, lambda x: x.k, lambda x: x.k, lambda k, a, b: (k, b.v))
    assert "LeftSemi" in plan_of(db.evaluate(right)) and db.tuples(right) == [(1, "b")]
    u = db.attach("u", spark.range(3).toDF("value"), unique=True)
    assert "Aggregate" not in plan_of(db.evaluate(u.builder().select(lambda v: v > 1)))
    assert plan_of(db.evaluate(u.builder().intersect(Empty("long")))).count("Range") == 0


def test_declared_not_null_is_enforced(db, spark):
    r = db.add_relation("r", "k int not null")
    with pytest.raises(Exception):
        db.insert(r, [None])
        db.tuples(r)
    db2 = type(db)(spark)
    r2 = db2.add_relation("r", "k int not null")
    db2.insert(r2, spark.sql("select cast(nullif(id, 0) as int) k from range(2)"))
    with pytest.raises(Exception, match="null in k"):
        db2.tuples(r2)


def test_mono_and_visitors(db):
    r, s = ints(db, "r", [1, 2, 3]), ints(db, "s", [2, 3, 4])
    tree = Mono.of(r.builder().intersect(s).project(lambda v: v * 10))
    assert db.tuples(tree) == [20, 30] and Mono.of(tree) is tree
    with pytest.raises(TypeError):
        Mono.of(r.builder().project(lambda v: (v, v)))
    view = db.store_view(r)
    e = view.builder().union(s).select(lambda v: v > 0).build()
    assert dependencies(e) == ({"s"}, {view}) and e.relations == {"s"} and e.views == {view}

    class Names(Visitor):
        def __init__(self):
            self.seen = []

        def visit_relation(self, e):
            self.seen.append(e.name)

        def visit_union(self, e):
            self.seen.append("union")
            self.walk(e)

    v = Names()
    e.visit(v)
    assert v.seen == ["union", "s"]
