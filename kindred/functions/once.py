"""A value that is used several times and made once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value): value is a lambda's variable there, so it is computed once, however often it stands in use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
