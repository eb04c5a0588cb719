"""Functions over tuples: proxies that closures receive, and Python functions as columns."""

from .closures import TupleProxy, columns_of, proxy, pyudf

__all__ = ["TupleProxy", "columns_of", "proxy", "pyudf"]
