"""Relational expressions: their nodes, the fluent builder and visitors."""

from .builder import Builder
from .nodes import Difference, Empty, Expression, Full, Intersect, Join, Mono, Product, Project, Relation, Select, Singleton, Union, View, to_expression
from .visitor import DependencyVisitor, Visitor, dependencies

__all__ = [
    "Builder", "DependencyVisitor", "Difference", "Empty", "Expression", "Full", "Intersect", "Join", "Mono", "Product", "Project", "Relation",
    "Select", "Singleton", "Union", "View", "Visitor", "dependencies", "to_expression",
]
