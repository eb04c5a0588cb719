"""Relational algebra with set semantics and incrementally maintained views, on Spark DataFrames."""

from .database import Database
from .dsl import query, relexp
from .errors import InstanceExists, InstanceNotFound, RelationalError, UnsupportedExpression
from .functions import pyudf
from .schema import either, left, right
from .sources import Tuples
from .operators import Builder, Difference, Empty, Expression, Full, Intersect, Join, Mono, Product, Project, Relation, Select, Singleton, Union, View, Visitor

__all__ = [
    "Builder", "Database", "Difference", "Empty", "Expression", "Full", "InstanceExists", "InstanceNotFound", "Intersect", "Join", "Mono", "Product", "Project",
    "Relation", "RelationalError", "Select", "Singleton", "Tuples", "Union", "UnsupportedExpression", "View", "Visitor", "either", "left", "pyudf", "query", "relexp", "right",
]
