"""Named queries over the driver's tables, each with the SQL that it must agree with.

The tables stand in for the statistics domain: a customer is a player, a nation a team, a region a league, a year of orders a
season, an order's status the kind of season, orders and events are game logs, line items shots.
"""

from . import answers, checks, metrics, names, quality, relations, retrieval  # noqa: F401  (they register their queries)
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
