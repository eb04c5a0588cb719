import pytest
from pyspark.sql import functions as F

import __spark_entry__
from relengine import Database, Empty, query, relexp
from relengine.streaming import ingest


def test_text_form(db):
    r = query(db, 'create relation "r":<_1 int, _2 string>')
    s = query(db, 'create relation "s":<_1 int, _2 string>')
    query(db, "insert into (r) values [struct(1, 'a'), struct(2, 'b'), struct(1, 'a'), struct(4, 'b'),]", r=r)
    query(db, "insert into (s) values [struct(1, 'x'), struct(2, 'y')]", s=s)
    query(db, "insert into (s) values []", s=s)
    run = lambda text, **env: db.tuples(relexp(text, **env))
    assert run("(r) join (s) on [_1; _1] with [concat(l._2, r._2)]", r=r, s=s) == ["ax", "by"]
    assert run("select [_2] from (r) where [_1 > 1 and _2 <> ')']", r=r) == ["b"]
    assert run("select * from ((r) union (s)) where [_1 = 1]", r=r, s=s) == [(1, "a"), (1, "x")]
    assert run("select [_1] from (r)", r=r) == [1, 2, 4]
    assert run("(select [_1] from (r)) minus (select [_1] from (s))", r=r, s=s) == [4]
    assert run("(select [_1] from (r)) intersect (select [_1] from (s))", r=r, s=s) == [1, 2]
    assert run("([1]) cross ([2]) on [l.value + r.value, l.value]") == [(3, 1)]
    assert run("[struct(1 as a, 'x' as b)]") == [(1, "x")]
    assert run("(a) union (select * from (([7]) union ([8])))", a=Empty("int")) == [7, 8]
    v = query(db, "create view as (select [_1] from (r) where [_2 = 'b'])", r=r)
    query(db, "insert into (r) values [struct(9, 'b')]", r=r)
    assert db.tuples(v) == [2, 4, 9]
    assert sorted(x.value for x in query(db, "v", v=v).collect()) == [2, 4, 9]
    for bad in ("select [a] from r", "(r) join (s) on [_1] with [l._1]", "(r) union", "r r"):
        with pytest.raises(SyntaxError):
            relexp(bad, r=r, s=s)
    with pytest.raises(NameError):
        relexp("(nothing)")


GUITAR, PIANO, KEYBOARD, DRUMS, VOCALS = range(5)


def test_bands_end_to_end(db):
    musician = db.add_relation("musician", "name string not null, band string, instruments array<int> not null")
    band = db.add_relation("band", "name string not null, genre string not null")
    db.insert(musician, [("Ann", "North", [GUITAR]), ("Bo", None, [VOCALS]), ("Cy", "South", [DRUMS]), ("Di", "North", [KEYBOARD, PIANO]), ("Ed", "East", [VOCALS, GUITAR])])
    db.insert(band, [("North", "rock"), ("South", "metal")])
    guitarists = musician.builder().select(lambda m: F.array_contains(m.instruments, GUITAR)).project(lambda m: m.name)
    assert db.tuples(guitarists) == ["Ann", "Ed"]
    members = musician.builder().with_key(lambda m: m.band).join(band.builder().with_key(lambda b: b.name)).on(lambda _, m, b: (m.name, b.name)).select(lambda p: p._2 == "North").project(lambda p: p._1)
    assert db.tuples(members) == ["Ann", "Di"]
    view, drummers = db.store_view(members), db.store_view(musician.builder().select(lambda m: F.array_contains(m.instruments, DRUMS)))
    db.insert(musician, [("Flo", "North", [GUITAR]), ("Gus", "North", [DRUMS])])
    assert db.tuples(view) == ["Ann", "Di", "Flo", "Gus"]
    assert db.tuples(drummers) == [("Cy", "South", [DRUMS]), ("Gus", "North", [DRUMS])]


def test_streams_feed_relations(spark, tmp_path):
    db = Database(spark)
    r = db.add_relation("r", "bigint")
    view = db.store_view(r.builder().select(lambda v: v >= 3))
    for i in (1, 2):
        spark.range(i * 3).toDF("value").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("value bigint").parquet(str(tmp_path / "in"))
        ingest(db, r, stream, str(tmp_path / "state")).awaitTermination(60)
        assert db.tuples(r) == list(range(i * 3))
    assert db.tuples(view) == [3, 4, 5]


def test_entry(spark):
    names = __spark_entry__.queries().keys()
    assert {"relation_scan", "join_chain", "view_diamond", "dsl_minus"} <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() == 366
