"""Every registered query and its SQL."""

from sidelines.plans import detection, metres, review, sheets, timing  # noqa: F401  (they register their queries)
from sidelines.plans.oracles import ORACLE_SQL
from sidelines.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
