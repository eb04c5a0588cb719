"""Errors of the engine."""

from __future__ import annotations


class RelationalError(Exception):
    """Base of the engine's errors."""


class UnsupportedExpression(RelationalError):
    """An expression that an operation can't take, such as Full in an evaluation."""

    def __init__(self, name: str, operation: str):
        super().__init__(f"unsupported expression `{name}` for operation `{operation}`")
        self.name, self.operation = name, operation


class InstanceNotFound(RelationalError):
    """No relation or view of that name and type."""

    def __init__(self, name: str):
        super().__init__(f"no instance `{name}`")
        self.name = name


class InstanceExists(RelationalError):
    """A relation of that name is already there."""

    def __init__(self, name: str):
        super().__init__(f"instance `{name}` exists")
        self.name = name
