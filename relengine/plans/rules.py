"""Rewrites that Catalyst can't make on its own plans, made on our tree before."""

from __future__ import annotations

from ..operators.nodes import Difference, Empty, Expression, Intersect, Join, Mono, Product, Project, Select, Union


def rewrite(e: Expression) -> Expression:
    """The same set, by a tree that plans better.

    * An Empty input decides its parents: E ∪ ∅ = E, E − ∅ = E, and the others with ∅ are ∅.
    * A selection over ∩ or − goes to both sides; Catalyst pushes it to the left one alone.
    """
    if isinstance(e, Mono):
        return rewrite(e.expression)
    if isinstance(e, Select):
        x = rewrite(e.expression)
        if isinstance(x, Empty):
            return x
        if isinstance(x, (Intersect, Difference)):
            return rewrite(type(x)(Select(x.left, e.predicate), Select(x.right, e.predicate)))
        return Select(x, e.predicate)
    if isinstance(e, Project):
        x = rewrite(e.expression)
        return Empty(e.schema) if isinstance(x, Empty) else Project(x, e.mapper)
    if isinstance(e, (Union, Intersect, Difference, Product, Join)):
        left, right = rewrite(e.left), rewrite(e.right)
        none = isinstance(left, Empty), isinstance(right, Empty)
        if isinstance(e, Union) and any(none):
            return right if none[0] else left
        if isinstance(e, Difference) and any(none):
            return left
        if any(none):
            return Empty(e.schema)
        if isinstance(e, Join):
            return Join(left, right, e.left_key, e.right_key, e.mapper)
        return Product(left, right, e.mapper) if isinstance(e, Product) else type(e)(left, right)
    return e
