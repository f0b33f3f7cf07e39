"""Dates in seven layouts, tried in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each layout with the shape that a strict reader asks for.
LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{2,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
)


def parse_date(c: Column) -> Column:
    """Timestamp of the first layout that fits, else null."""
    return F.coalesce(*(F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(layout))) for shape, layout in LAYOUTS))
