"""Small sets of Python values in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any


def order(v: Any) -> tuple:
    """A sort key of the natural order: None first, then by fields and items, shorter prefixes first."""
    if v is None:
        return (0,)
    if isinstance(v, (list, tuple)):
        return (1, tuple(map(order, v)))
    return (1, v)


class Tuples(Sequence):
    """A sorted list of distinct values, as :meth:`Database.tuples` gives and :meth:`Database.insert` takes.  It can't be changed."""

    def __init__(self, values: Iterable[Any] = ()):
        self._items: list[Any] = []
        for v in sorted(values, key=order):
            if not self._items or order(self._items[-1]) != order(v):
                self._items.append(v)

    def merge(self, other: Iterable[Any]) -> Tuples:
        """All values of both."""
        return Tuples([*self._items, *other])

    def items(self) -> tuple:
        return tuple(self._items)

    def into_tuples(self) -> list:
        return list(self._items)

    def __getitem__(self, i: Any) -> Any:
        return self._items[i]

    def __len__(self) -> int:
        return len(self._items)

    def __iter__(self) -> Iterator[Any]:
        return iter(self._items)

    def __eq__(self, other: object) -> bool:
        return self._items == list(other) if isinstance(other, (Tuples, list, tuple)) else NotImplemented

    def __hash__(self) -> int:
        return hash(len(self._items))

    def __repr__(self) -> str:
        return f"Tuples({self._items!r})"
