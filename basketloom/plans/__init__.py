"""Query catalogue: every operator applied to the fixture tables, with SQL beside it."""

from . import models, stores  # noqa: F401  they register their queries
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
