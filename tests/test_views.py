import random

import pytest
from pyspark.sql import functions as F

from relengine import Database, Difference, Full, InstanceNotFound, Intersect, Join, Product, Project, Select, Singleton, Union, UnsupportedExpression


def rel(db, name, schema, values=()):
    r = db.add_relation(name, schema)
    db.insert(r, values)
    return r


def test_inserts_that_change_nothing(db):
    r = rel(db, "r", "int")
    assert db.tuples(r) == []
    db.insert(r, [1, 2, 2])
    db.insert(r, [])
    db.insert(r, [2, 3])
    assert db.tuples(r) == [1, 2, 3]
    db.insert(r, [1, 3])
    assert db.tuples(r) == [1, 2, 3]
    assert len(db._relations["r"].epochs) == 1


def test_selection_follows_many_batches(db):
    rng, held = random.Random(11), set()
    r = rel(db, "r", "bigint")
    view = db.store_view(r.builder().select(lambda v: v % 7 < 3))
    for n in (40, 0, 1, 25):
        batch = [rng.randrange(300) for _ in range(n)]
        db.insert(r, batch)
        held |= set(batch)
        assert db.tuples(view) == sorted(v for v in held if v % 7 < 3)


def test_product_with_either_side_or_both_growing(db):
    rng, held = random.Random(12), ([], [])
    sides = [rel(db, n, "int") for n in ("dividend", "divisor")]
    view = db.store_view(sides[0].builder().product(sides[1]).on(lambda x, y: {"x": x, "y": y}).project(lambda t: (F.expr("x div y"), t.x % t.y)))
    for grows in ((0, 1), (0,), (1,), (0, 1)):
        for i in grows:
            batch = [rng.randrange(1, 500) for _ in range(5)]
            db.insert(sides[i], batch)
            held[i].extend(batch)
        assert set(db.tuples(view)) == {(x // y, x % y) for x in held[0] for y in held[1]}


def three(db, rng):
    """Relations of pairs with few keys, some of them null, and their Python sets."""
    made = {}
    for name, width in (("ports", 9), ("ships", 5), ("cargo", 30)):
        values = [(rng.choice([None, *range(width)]), rng.randrange(width)) for _ in range(12)]
        made[name] = (rel(db, name, "key int, payload int", values), set(values))
    return made


def joined(x, y, f):
    return {f(a, b) for a in x for b in y if a[0] == b[0]}


def test_joins_over_joins_with_any_input_growing(db):
    rng = random.Random(13)
    made = three(db, rng)
    key = lambda x: x[0]
    (p, _), (s, _), (c, _) = made.values()
    inner = p.builder().with_key(key).join(s.builder().with_key(key)).on(lambda _, a, b: (b.payload, a.payload))
    deep = db.store_view(inner.with_key(key).join(c.builder().with_key(key)).on(lambda k, a, b: (k, a[1] + b.payload)))
    wide = db.store_view(p.builder().union(s).with_key(key).join(c.builder().with_key(key)).on(lambda _, a, b: a.payload * 100 + b.payload))
    inner_view = db.store_view(inner)
    for grows in ((), ("cargo",), ("ports", "ships"), ("ships",), ("ports", "cargo")):
        for name in grows:
            batch = [(rng.choice([None, *range(9)]), rng.randrange(30)) for _ in range(4)]
            db.insert(made[name][0], batch)
            made[name][1].update(batch)
        ports, ships, cargo = (v for _, v in made.values())
        pairs = joined(ports, ships, lambda a, b: (b[1], a[1]))
        assert set(db.tuples(inner_view)) == pairs
        assert set(db.tuples(deep)) == joined(pairs, cargo, lambda a, b: (a[0], a[1] + b[1]))
        assert set(db.tuples(wide)) == joined(ports | ships, cargo, lambda a, b: a[1] * 100 + b[1])


def test_a_refresh_does_not_shuffle_what_is_stored(db, spark, monkeypatch):
    big = spark.range(20_000).selectExpr("id as k", "id % 97 as v")
    r, s = db.attach("r", big, unique=True), rel(db, "s", "k bigint, w string", [(i, "x") for i in range(50)])
    view = db.store_view(r.builder().with_key(lambda x: x.k).join(s.builder().with_key(lambda x: x.k)).on(lambda k, a, b: (k, a.v, b.w)))
    assert len(db.tuples(view)) == 50
    kept = []
    keep = db._store.keep
    monkeypatch.setattr(db._store, "keep", lambda df: (kept.append(df), keep(df))[1])
    db.insert(s, [(i, "y") for i in range(100, 130)] + [(3, "x")])
    assert len(db.tuples(view)) == 80
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in kept]
    assert any("LeftAnti" in p for p in plans) and not any("SortMergeJoin" in p for p in plans)
    assert all("Range" not in p.split("Exchange hashpartitioning")[-1] or "BroadcastHashJoin" in p.split("Exchange hashpartitioning")[-1] for p in plans)


def test_rejected_views_leave_nothing(db):
    r = rel(db, "r", "int", [1])
    for e in (r.builder().difference(r), r.builder().union(Difference(r, r)).select(lambda v: v > 0)):
        with pytest.raises(UnsupportedExpression) as err:
            db.store_view(e)
        assert (err.value.name, err.value.operation) == ("Difference", "Create View")
    with pytest.raises(UnsupportedExpression):
        db.store_view(r.builder().union(Full("int")))
    assert db._views == {} and db.tuples(r) == [1]


def test_views_on_views_made_late(db):
    r = rel(db, "r", "int", [5, 11])
    assert db.tuples(r) == [5, 11]
    base = db.store_view(r)
    doubled = db.store_view(base.builder().with_key(lambda v: v).join(r.builder().with_key(lambda v: v)).on(lambda k, a, b: k + a + b))
    large = db.store_view(doubled.builder().select(lambda v: v > 20))
    extra = db.store_view(Union(large, Singleton(-1, "int")))
    stack = [(base, lambda h: h), (doubled, lambda h: {3 * v for v in h}), (large, lambda h: {3 * v for v in h if v > 6}), (extra, lambda h: {-1} | {3 * v for v in h if v > 6})]
    held = {5, 11}
    for new in ((), (2, 30), (30,)):
        db.insert(r, new)
        held |= set(new)
        for view, want in reversed(stack):
            assert set(db.tuples(view)) == want(held)
    other = Database(db.spark)
    rel(other, "r", "int")
    with pytest.raises(InstanceNotFound):
        other.evaluate(other.store_view(r) and base)


def test_a_copy_and_its_origin_go_apart(db):
    words = rel(db, "words", "string", ["ash", "birch", "cedar"])
    sizes = db.store_view(words.builder().project(lambda w: (F.length(w), w)))
    copy = db.clone()
    want = lambda *more: sorted((len(w), w) for w in {"ash", "birch", "cedar", *more})
    db.insert(words, ["oak", "ash"])
    assert (db.tuples(sizes), copy.tuples(sizes)) == (want("oak"), want())
    copy.insert(words, ["elm", "yew"])
    assert (db.tuples(sizes), copy.tuples(sizes)) == (want("oak"), want("elm", "yew"))
    late, other = db.store_view(words), copy.store_view(words)
    with pytest.raises(InstanceNotFound):
        copy.evaluate(late)
    assert copy.tuples(other) == ["ash", "birch", "cedar", "elm", "yew"]


def test_epochs_are_compacted(db):
    r = rel(db, "r", "int")
    v = db.store_view(r.builder().select(lambda x: x % 2 == 0))
    for i in range(12):
        db.insert(r, [i])
        assert db.tuples(v) == list(range(0, i + 1, 2))
    assert len(db._relations["r"].epochs) <= 10
    assert db.tuples(r) == list(range(12))


def random_tree(rng, leaves, depth, monotone=True):
    """A tree over sets of ints and the same as a function of Python sets."""
    if depth == 0 or rng.random() < 0.15:
        i = rng.randrange(len(leaves) + 1)
        if i == len(leaves):
            c = rng.randrange(10)
            return Singleton(c, "int"), lambda s: {c}
        return leaves[i], lambda s: set(s[i])
    kind = rng.randrange(6 if monotone else 7)
    e, f = random_tree(rng, leaves, depth - 1, monotone)
    if kind == 0:
        m = rng.randrange(2, 4)
        return Select(e, lambda v: v % m != 0), lambda s: {x for x in f(s) if x % m}
    if kind == 1:
        m = rng.randrange(1, 4)
        return Project(e, lambda v: (v * m) % 10), lambda s: {x * m % 10 for x in f(s)}
    d, g = random_tree(rng, leaves, depth - 1, monotone)
    if kind == 2:
        return Union(e, d), lambda s: f(s) | g(s)
    if kind == 3:
        return Intersect(e, d), lambda s: f(s) & g(s)
    if kind == 4:
        return Product(e, d, lambda a, b: (a + b) % 10), lambda s: {(a + b) % 10 for a in f(s) for b in g(s)}
    if kind == 5:
        return Join(e, d, lambda v: v % 3, lambda v: v % 3, lambda k, a, b: (a * 2 + b + k) % 10), lambda s: {(a * 2 + b + a % 3) % 10 for a in f(s) for b in g(s) if a % 3 == b % 3}
    return Difference(e, d), lambda s: f(s) - g(s)


@pytest.mark.parametrize("seed", range(3))
def test_random_trees_equal_python_sets(spark, seed):
    rng = random.Random(seed)
    db = Database(spark)
    leaves, held = [db.add_relation(f"r{i}", "int") for i in range(2)], [set(), set()]
    views = [(db.store_view(e), f) for e, f in (random_tree(rng, leaves, 2) for _ in range(2))]
    for _ in range(2):
        for i, r in enumerate(leaves):
            new = [rng.randrange(10) for _ in range(rng.randrange(4))]
            db.insert(r, new)
            held[i] |= set(new)
        for v, f in views:
            assert set(db.tuples(v)) == f(held)
        e, f = random_tree(rng, leaves, 2, monotone=False)
        assert set(db.tuples(e)) == f(held)
