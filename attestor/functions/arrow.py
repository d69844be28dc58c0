"""Arrow UDFs that are built when first called, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        @cache
        def built():
            return F.pandas_udf(f, ddl)

        @wraps(f)
        def call(*columns: Column) -> Column:
            return built()(*columns)

        call.plain = f
        return call

    return wrap
