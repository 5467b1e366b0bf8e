"""One pass over a table for several operators that each aggregate it to one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.ordered import cut


class Pass:
    """Stands for a frame towards operators that read its schema and call ``agg`` alone.

    The first time round it takes down what they aggregate; once ``run`` has
    worked all of it out in one job, it hands each its own part of that row.
    """

    def __init__(self, df: DataFrame):
        self.df, self.schema, self.columns = df, df.schema, df.columns
        self.parts: list[tuple[list[str], list[Column]]] = []
        self.row: DataFrame | None = None
        self.turn = 0

    def agg(self, *aggs: Column) -> DataFrame:
        if self.row is None:
            plain = self.df.agg(*aggs)
            self.parts.append((plain.columns, list(aggs)))
            return plain
        names = self.parts[self.turn][0]
        own = self.row.select(*[F.col(f"p{self.turn}_{i}").alias(n) for i, n in enumerate(names)])
        self.turn += 1
        return own

    def run(self) -> None:
        self.row = cut(self.df.agg(*[c.alias(f"p{k}_{i}") for k, (_, aggs) in enumerate(self.parts) for i, c in enumerate(aggs)]))


def in_one_pass(df: DataFrame, operators: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """The results of operators that aggregate a table to one row each, from a single scan made now."""
    shared = Pass(df)
    for operator in operators.values():
        operator(shared)
    shared.run()
    return {name: operator(shared) for name, operator in operators.items()}
