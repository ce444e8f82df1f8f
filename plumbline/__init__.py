"""plumbline: data-quality rates of large tables on Spark, exact or estimated from samples."""
from .functions.draws import Draws
from .operators.profile import profile, profile_long, profile_table, relative_error, row_flags
from .operators.table import AuditTable, FdRule, audit
from .plans.progressive import progressive_curve
from .plans.registry import METHODS, draw_sample

__all__ = ["AuditTable", "Draws", "FdRule", "METHODS", "audit", "draw_sample", "profile", "profile_long",
           "profile_table", "progressive_curve", "relative_error", "row_flags"]
