"""All queries over the driver's tables, and their SQL equivalents."""

from . import decision_queries, finding_queries, license_queries, more_queries, report_queries, scan_queries, tree_queries, workflow_queries  # noqa: F401  register themselves
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
