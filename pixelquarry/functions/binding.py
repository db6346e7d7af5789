"""Names for parts of an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of ``values`` as fields of a struct: each is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), F.lit(0))
