"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return add


def rounded(df, digits: int = 6):
    """Doubles to so many digits: sums come in another order elsewhere."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
