"""Dense tiles: matrices of any size as rows of packed blocks.

A row has the positions of its rows and columns and the values between them, row by row.  Positions may be any longs and
need not be adjacent, so a tile also holds the product of two groups of positions that a hash has picked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiles:
    """``df`` has the key columns ``by``, ``rows`` and ``columns`` (arrays of longs) and ``x`` (an array of doubles)."""

    df: DataFrame
    by: tuple[str, ...] = ()

    def lines(self, row: str = "i", at: str = "columns", values: str = "x") -> DataFrame:
        """One line of a tile as a row: ``by, row, columns, x``.  No value is a row."""
        n = F.size("columns")
        each = self.df.select(*self.by, F.posexplode("rows").alias("_p", row), "columns", "x")
        return each.select(*self.by, row, F.col("columns").alias(at), F.slice("x", F.col("_p") * n + 1, n).alias(values))

    def cells(self, row: str = "i", column: str = "j", value: str = "v") -> DataFrame:
        """Every value as a row: ``by, row, column, value``."""
        each = self.lines(row).select(*self.by, row, F.explode(F.arrays_zip("columns", "x")).alias("_c"))
        return each.select(*self.by, row, F.col("_c.columns").alias(column), F.col("_c.x").alias(value))

    def row_sums(self, row: str, **sums) -> DataFrame:
        """Sums along the rows, ``by, row`` and one column for each ``name=f`` of ``sums``: a function of column position and
        value.  Each line is folded within its row, then the lines of a row meet."""

        def folded(fn) -> Column:
            each = F.transform(F.arrays_zip("columns", "x"), lambda c: fn(c["columns"], c["x"]).cast("double"))
            return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)

        lines = self.lines(row).select(*self.by, row, *(folded(fn).alias(name) for name, fn in sums.items()))
        return lines.groupBy(*self.by, row).agg(*(F.sum(name).alias(name) for name in sums))
