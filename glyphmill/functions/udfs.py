"""Arrow UDFs that are made when first used, as making one needs a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def make(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__ = f.__doc__
        return call

    return make
