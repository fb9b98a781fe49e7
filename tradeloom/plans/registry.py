"""How the query modules name their queries and keep the SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


class Registry:
    def __init__(self, prologue: str = ""):
        self.prologue, self.found, self.sql = prologue, {}, {}

    def __call__(self, name: str, sql: str | None = None, doubles: str = "") -> Callable:
        """Registers a query under name. sql gives the same rows after the prologue; without it there is none.

        The columns named in doubles are rounded to six decimals on both sides, as their sums depend on the order of rows.
        """
        columns = doubles.split()

        def keep(f: Callable) -> Callable:
            def run(spark, d):
                df = f(spark, d)
                return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns}) if columns else df

            self.found[name] = run
            if sql:
                replaced = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)
                self.sql[name] = self.prologue + (f"SELECT * REPLACE ({replaced}) FROM ({sql})" if columns else sql)
            return f

        return keep
