from enum import Enum

from relengine import Tuples, either, left, right


class Instrument(Enum):
    GUITAR = "z"
    DRUMS = "a"


def test_tuples_are_sorted_sets():
    t = Tuples([3, None, 1, 3, 2, None])
    assert t == [None, 1, 2, 3] and len(t) == 4 and t[1] == 1 and list(t) == list(t.items())
    assert t.merge([0, 3]).into_tuples() == [None, 0, 1, 2, 3]
    assert Tuples([(2, "a"), (1, None), (1, "b"), (2, "a")]) == [(1, None), (1, "b"), (2, "a")]
    assert Tuples([[1, 0], [1], [1, None], [0, 5]]) == [[0, 5], [1], [1, None], [1, 0]]
    assert Tuples() == []


def test_enumerations_and_either(db):
    r = db.add_relation("r", "name string, plays array<int>")
    db.insert(r, [("x", [Instrument.DRUMS, Instrument.GUITAR]), ("y", [Instrument.GUITAR])])
    assert db.tuples(r) == [("x", [1, 0]), ("y", [0])]
    s = db.add_relation("s", either("string", "int"))
    db.insert(s, Tuples([right(1), left("b"), left("a"), right(1)]))
    assert db.tuples(s) == [left("a"), left("b"), right(1)]
    assert db.tuples(s.builder().select(lambda e: e.tag == 0).project(lambda e: e.left)) == ["a", "b"]
