from .queries import QUERIES, ORACLE_SQL, flagship

__all__ = ["QUERIES", "ORACLE_SQL", "flagship"]

from . import bagging, checked, distribution, models, weighted  # noqa: E402,F401  (register their queries)
