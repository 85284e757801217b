"""Named queries over a table folder, each with its check in SQL where SQL can say it."""

from postflock.catalog import aggregates, composites, filters, joins, learned, ranks, scalars, storage, streams, weights
from postflock.catalog.registry import QUERIES, SQL

__all__ = [
    "QUERIES", "SQL", "aggregates", "composites", "filters", "joins", "learned", "ranks",
    "scalars", "storage", "streams", "weights",
]
