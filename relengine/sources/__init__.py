"""Where tuples come from, and where what views hold is kept."""

from .tables import checked, read_parquet, rows
from .storage import Store
from .tuples import Tuples

__all__ = ["Store", "Tuples", "checked", "read_parquet", "rows"]
