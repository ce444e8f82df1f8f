"""Column-level building blocks: hash draws and column classes."""
from .columns import categorical_columns, nan_to_null, numeric_columns
from .draws import Draws

__all__ = ["Draws", "categorical_columns", "nan_to_null", "numeric_columns"]
