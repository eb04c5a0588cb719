"""The fluent way to write expressions."""

from __future__ import annotations

from collections.abc import Callable

from .nodes import Difference, Expression, Intersect, Join, Product, Project, Select, Union, to_expression


class Builder:
    """Wraps an expression; every method gives a new builder, :meth:`build` the expression."""

    def __init__(self, expression: Expression):
        self._expression = to_expression(expression)

    def build(self) -> Expression:
        return self._expression

    def select(self, predicate: Callable) -> Builder:
        return Builder(Select(self._expression, predicate))

    def project(self, mapper: Callable) -> Builder:
        return Builder(Project(self._expression, mapper))

    def union(self, other: Expression | Builder) -> Builder:
        return Builder(Union(self._expression, other))

    def intersect(self, other: Expression | Builder) -> Builder:
        return Builder(Intersect(self._expression, other))

    def difference(self, other: Expression | Builder) -> Builder:
        return Builder(Difference(self._expression, other))

    def product(self, other: Expression | Builder) -> ProductBuilder:
        return ProductBuilder(self._expression, to_expression(other))

    def with_key(self, key: Callable) -> WithKeyBuilder:
        return WithKeyBuilder(self._expression, key)


class ProductBuilder:
    def __init__(self, left: Expression, right: Expression):
        self._left, self._right = left, right

    def on(self, mapper: Callable) -> Builder:
        return Builder(Product(self._left, self._right, mapper))


class WithKeyBuilder:
    def __init__(self, expression: Expression, key: Callable):
        self._expression, self._key = expression, key

    def join(self, other: WithKeyBuilder) -> JoinBuilder:
        return JoinBuilder(self, other)


class JoinBuilder:
    def __init__(self, left: WithKeyBuilder, right: WithKeyBuilder):
        self._left, self._right = left, right

    def on(self, mapper: Callable) -> Builder:
        return Builder(Join(self._left._expression, self._right._expression, self._left._key, self._right._key, mapper))
