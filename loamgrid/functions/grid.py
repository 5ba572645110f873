"""Regular grids: cell of a coordinate, cells that a box touches, cells that a query needs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import check_box


@dataclass(frozen=True)
class Grid:
    origin: tuple[float, ...]
    size: tuple[float, ...]
    shape: tuple[int, ...]

    @property
    def rank(self) -> int:
        return len(self.shape)

    @classmethod
    def over(cls, lower: Sequence[float], upper: Sequence[float], size: float | Sequence[float]) -> Grid:
        """The smallest grid from ``lower`` that covers ``upper``, with a cell at least."""
        sizes = sizes_of(size, len(lower))
        return cls(tuple(map(float, lower)), sizes, tuple(max(1, math.ceil((b - a) / s)) for a, b, s in zip(lower, upper, sizes)))

    @property
    def upper(self) -> tuple[float, ...]:
        return tuple(o + n * s for o, n, s in zip(self.origin, self.shape, self.size))

    def index(self, x: Column, d: int) -> Column:
        """Cell of a coordinate, by floor; may lie outside the grid."""
        return F.floor((x - self.origin[d]) / self.size[d])

    def touched(self, low: Column, high: Column, d: int) -> tuple[Column, Column]:
        """First and last cell that a closed range touches; a shared face belongs to both neighbours."""
        first = F.greatest(F.ceil((low - self.origin[d]) / self.size[d]) - 1, F.lit(0))
        last = F.least(F.floor((high - self.origin[d]) / self.size[d]), F.lit(self.shape[d] - 1))
        return first.cast("bigint"), last.cast("bigint")

    def cell_box(self, cell: Sequence[int]) -> tuple[list[float], list[float]]:
        low = [o + c * s for o, c, s in zip(self.origin, cell, self.size)]
        return low, [a + s for a, s in zip(low, self.size)]

    def query_range(self, lower: Sequence[float], upper: Sequence[float]) -> list[tuple[int, int]]:
        """Per dimension the cells that a query box needs, clipped to the grid."""
        lower, upper = check_box(lower, upper, self.rank)
        clip = lambda x, n: min(max(x, 0), n - 1)
        return [(clip(math.floor((a - o) / s), n), clip(math.floor((b - o) / s), n)) for a, b, o, s, n in zip(lower, upper, self.origin, self.size, self.shape)]

    def query_cells(self, lower: Sequence[float], upper: Sequence[float]):
        """Those cells one by one, the last dimension fastest."""
        return itertools.product(*[range(a, b + 1) for a, b in self.query_range(lower, upper)])

    def enumerate(self, spark: SparkSession, lower: Sequence[float], upper: Sequence[float]) -> DataFrame:
        """The same as a table ``c0, c1, ..., key``, made on the executors."""
        out = spark.range(1)
        for d, (a, b) in enumerate(self.query_range(lower, upper)):
            out = out.withColumn(f"c{d}", F.explode(F.sequence(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))))
        cells = [f"c{d}" for d in range(self.rank)]
        return out.select(*cells, F.concat_ws("_", *cells).alias("key"))

    def explode(self, df: DataFrame, low: Sequence[Column], high: Sequence[Column], within: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        """A row per touched cell (``c0, c1, ...``), of those ``within`` the given ranges if any.

        A box outside the grid has its first cell after its last; it is dropped before sequences are
        made, since those would count down."""
        bounds = [self.touched(a, b, d) for d, (a, b) in enumerate(zip(low, high))]
        if within is not None:
            bounds = [(F.greatest(a, F.lit(p)), F.least(b, F.lit(q))) for (a, b), (p, q) in zip(bounds, within)]
        columns = df.columns
        out = df.select("*", *[x.alias(f"_{n}{d}") for d, pair in enumerate(bounds) for n, x in zip("ft", pair)])
        for d in range(self.rank):
            out = out.where(F.col(f"_f{d}") <= F.col(f"_t{d}"))
        for d in range(self.rank):
            out = out.withColumn(f"c{d}", F.explode(F.sequence(f"_f{d}", f"_t{d}")))
        return out.select(*columns, *[f"c{d}" for d in range(self.rank)])


def sizes_of(size: float | Sequence[float], rank: int) -> tuple[float, ...]:
    """Cell sizes per dimension; one number stands for all."""
    sizes = (float(size),) * rank if isinstance(size, (int, float)) else tuple(map(float, size))
    if len(sizes) != rank:
        raise ValueError(f"{rank} cell sizes expected, got {len(sizes)}")
    if min(sizes) <= 0:
        raise ValueError("cell sizes must be positive")
    return sizes


def plain_index(x: Column, size: float) -> Column:
    """Cell of a coordinate in a grid from zero."""
    return F.floor(x / size)
