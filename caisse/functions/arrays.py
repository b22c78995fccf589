"""Safe array access for ANSI mode.

With ANSI on, ``element_at`` / ``arr[i]`` raise on an index out of bounds, and
a ``CASE`` guard does not reliably keep Spark from evaluating the access
(common-subexpression elimination may hoist it). ``at`` returns null instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(arr: Column, index: int | Column) -> Column:
    """1-based element (negative counts from the end); null when out of bounds."""
    return F.try_element_at(arr, index if isinstance(index, Column) else F.lit(index))
