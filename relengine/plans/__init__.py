"""From expressions to DataFrames: rewrites on the tree, full evaluation, and changes since a view was last refreshed."""

from .compile import Change, changes, evaluate
from .rules import rewrite

__all__ = ["Change", "changes", "evaluate", "rewrite"]
