"""A set of annotations as DataFrames, and every query on it.

One table holds the annotations, with their bounding boxes as plain double columns (``lo_0``,
``hi_0``, ...) so that box queries reach Parquet statistics. Links to related objects and the cells of
the spatial levels are derived from it, or read where they have been written. All queries are lazy:
filters, semi-joins and projections that Catalyst prunes; nothing is collected but what a caller
asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loamgrid.functions import geometry, morton
from loamgrid.functions.grid import Grid
from loamgrid.plans.metadata import Info, Level
from loamgrid.plans.schema import AnnotationSchema

#: Default cap of reads that a caller collects.
MAX_ANNOTATIONS = 1_000_000
#: Ids that a lookup may list before it becomes a join.
ID_LIST = 1_000
LAST_ID = (1 << 63) - 1


@dataclass
class AnnotationSet:
    schema: AnnotationSchema
    table: DataFrame
    info: Info | None = None
    #: written index tables, where there are any
    link_table: DataFrame | None = None
    cell_table: DataFrame | None = None
    chunk_size: float | Sequence[float] = 256
    _bounds: tuple[list[float], list[float]] | None = field(default=None, repr=False)

    # -- columns ------------------------------------------------------------------------------------
    def _low_high(self) -> tuple[list[Column], list[Column]]:
        if "lo_0" in self.table.columns:
            return [F.col(f"lo_{d}") for d in range(self.schema.rank)], [F.col(f"hi_{d}") for d in range(self.schema.rank)]
        return geometry.box_bounds(self.schema)

    def _columns(self, with_relationships: bool = True) -> list[str]:
        out = self.schema.columns()
        return out if with_relationships else [c for c in out if c not in self.schema.relationships]

    def with_bounds(self) -> DataFrame:
        low, high = self._low_high()
        return self.table.select(*self._columns(), *[c.alias(f"lo_{d}") for d, c in enumerate(low)], *[c.alias(f"hi_{d}") for d, c in enumerate(high)])

    # -- scans and lookups ----------------------------------------------------------------------------
    def scan(self, max_annotations: int | None = None, with_relationships: bool = True) -> DataFrame:
        """All annotations; with a cap, ``ValueError`` if there are more."""
        if max_annotations is not None and self.table.select("id").limit(max_annotations + 1).count() > max_annotations:
            raise ValueError(f"the set holds more than {max_annotations} annotations")
        return self.table.select(*self._columns(with_relationships))

    def ids(self) -> DataFrame:
        return self.table.select("id")

    def by_id(self, annotation_id: int) -> DataFrame:
        """The annotation of an id, as a table of one row or none."""
        return self._by_key([int(annotation_id)])

    def _by_key(self, ids: Sequence[int]) -> DataFrame:
        """Annotations of a short list of ids."""
        same = F.col("id") == F.lit(ids[0]) if len(ids) == 1 else F.col("id").isin(list(ids))
        return self.scan().where(same)

    def get(self, annotation_id: int) -> Row:
        rows = self.by_id(annotation_id).take(1)
        if not rows:
            raise KeyError(annotation_id)
        return rows[0]

    def by_ids(self, ids: Sequence[int] | DataFrame, on_missing: str = "error") -> DataFrame:
        """The annotations of the ids in their order, repeats included, with the place as ``pos``.

        ``on_missing``: "error" fails the query, "skip" leaves such places out, "null" keeps them
        empty. Ids may also come as a DataFrame ``(pos, id)`` of any length, which is joined."""
        if on_missing not in ("error", "skip", "null"):
            raise ValueError(f"unknown on_missing {on_missing!r}")
        if isinstance(ids, DataFrame):
            wanted, found = ids.select(F.col("pos"), F.col("id")), self.scan()
        else:
            ids = [int(i) for i in ids]
            spark = self.table.sparkSession
            wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, id bigint")
            # a short list is pushed to the scan, a long one is left to the join
            found = self._by_key(sorted(set(ids))) if 0 < len(ids) <= ID_LIST else self.scan()
            wanted = F.broadcast(wanted) if len(ids) <= 100 * ID_LIST else wanted
        marked = found.withColumn("_found", F.lit(True))
        out = marked.join(wanted, "id", "inner" if on_missing == "skip" else "right")
        if on_missing == "error":
            missing = F.raise_error(F.concat(F.lit("no annotation of id "), F.col("id").cast("string"))).cast("bigint")
            out = out.withColumn("id", F.when(F.col("_found"), F.col("id")).otherwise(missing))
        return out.select("pos", *self._columns()).orderBy("pos")

    def id_range(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Annotations of ids from ``start`` up to, not including, ``end``; without it, all the rest."""
        if start > LAST_ID:
            return self.scan().limit(0)
        rows = self.scan().where(F.col("id") >= start)
        return rows if end is None or end > LAST_ID else rows.where(F.col("id") < end)

    def iterate(self, start: int = 0, end: int | None = None, prefetch: bool = True) -> Iterator[Row]:
        """Rows of an id range, a partition at a time."""
        return self.id_range(start, end).toLocalIterator(prefetchPartitions=prefetch)

    # -- relationships ---------------------------------------------------------------------------------
    def links(self) -> DataFrame:
        """``relationship, related_id, id, pos``: every link once per mention."""
        if self.link_table is not None:
            return self.link_table
        out = None
        for r in self.schema.relationships:
            own = self.table.select(F.lit(r).alias("relationship"), F.posexplode(r).alias("pos", "related_id"), "id").select("relationship", "related_id", "id", "pos")
            out = own if out is None else out.unionAll(own)
        if out is None:
            return self.table.sparkSession.createDataFrame([], "relationship string, related_id bigint, id bigint, pos int")
        return out

    def _check_relationship(self, relationship: str) -> None:
        if relationship not in self.schema.relationships:
            raise ValueError(f"unknown relationship {relationship!r}; known: {list(self.schema.relationships)}")

    def by_relationship(self, relationship: str, related_id: int, with_relationships: bool = False) -> DataFrame:
        """Annotations linked to an object."""
        self._check_relationship(relationship)
        rows = self.scan(with_relationships=with_relationships)
        if self.link_table is None:
            return self.table.where(F.array_contains(relationship, F.lit(related_id).cast("bigint"))).select(*rows.columns)
        hits = self.link_table.where((F.col("relationship") == relationship) & (F.col("related_id") == related_id)).select("id")
        return rows.join(hits, "id", "left_semi").select(*rows.columns)

    def relationship_index(self, relationship: str | None = None) -> DataFrame:
        """Per object: number of links, smallest and largest annotation id."""
        links = self.links() if relationship is None else self.links().where(F.col("relationship") == relationship)
        return links.groupBy("relationship", "related_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))

    def relationships_long(self) -> DataFrame:
        return self.links().select("id", "relationship", "pos", "related_id")

    # -- space ---------------------------------------------------------------------------------------
    def bounds(self) -> tuple[list[float], list[float]]:
        """Smallest and largest coordinates of all bounding boxes; zeros for an empty set."""
        if self._bounds is None:
            if self.info is not None:
                self._bounds = list(self.info.lower_bound), list(self.info.upper_bound)
            else:
                row = self.bounds_frame().first()
                r = self.schema.rank
                self._bounds = [row[f"lo_{d}"] or 0.0 for d in range(r)], [row[f"hi_{d}"] or 0.0 for d in range(r)]
        return self._bounds

    def bounds_frame(self) -> DataFrame:
        low, high = self._low_high()
        return self.table.agg(*[F.min(c).alias(f"lo_{d}") for d, c in enumerate(low)], *[F.max(c).alias(f"hi_{d}") for d, c in enumerate(high)])

    def levels(self) -> list[Level]:
        """The levels of the spatial index, coarse to fine; one grid over the bounds if none is given."""
        if self.info is not None and self.info.levels:
            return list(self.info.levels)
        grid = Grid.over(*self.bounds(), self.chunk_size)
        return [Level("spatial0", grid.size, grid.shape)]

    def with_levels(self, sizes: Sequence[float | Sequence[float]], lower: Sequence[float] | None = None, upper: Sequence[float] | None = None) -> AnnotationSet:
        """The same set with a grid of each given cell size over its bounds or the given ones."""
        own = self.bounds()
        lower, upper = list(lower or own[0]), list(upper or own[1])
        grids = [Grid.over(lower, upper, s) for s in sizes]
        levels = tuple(Level(f"spatial{i}", g.size, g.shape) for i, g in enumerate(grids))
        info = Info(self.schema, tuple(lower), tuple(upper), levels)
        return replace(self, info=info, cell_table=None, _bounds=None)

    def level(self, level: int | str) -> tuple[int, Grid]:
        found = [(i, x) for i, x in enumerate(self.levels()) if level in (i, x.key)]
        if not found:
            raise ValueError(f"unknown spatial level {level!r}; known: {[x.key for x in self.levels()]}")
        i, x = found[0]
        return i, Grid(tuple(self.bounds()[0]), x.chunk_size, x.grid_shape)

    def cells(self, level: int | str = 0) -> DataFrame:
        """``c0, c1, ..., morton, id``: membership in the cells of a level (a row per touched cell)."""
        i, grid = self.level(level)
        names = [f"c{d}" for d in range(self.schema.rank)]
        if self.cell_table is not None:
            return self.cell_table.where(F.col("level") == i).select(*names, "morton", "id")
        low, high = self._low_high()
        out = grid.explode(self.table.select("id", *[c.alias(f"lo_{d}") for d, c in enumerate(low)], *[c.alias(f"hi_{d}") for d, c in enumerate(high)]), [F.col(f"lo_{d}") for d in range(grid.rank)], [F.col(f"hi_{d}") for d in range(grid.rank)])
        return out.select(*names, morton.encode([F.col(c) for c in names], grid.shape).alias("morton"), "id")

    def cell_counts(self, level: int | str = 0) -> DataFrame:
        names = [f"c{d}" for d in range(self.schema.rank)]
        return self.cells(level).groupBy(*names).agg(F.count("*").alias("n"))

    def in_cell(self, level: int | str, cell: Sequence[int], with_relationships: bool = False) -> DataFrame:
        """Content of one grid cell."""
        if len(cell) != self.schema.rank:
            raise ValueError(f"a cell needs {self.schema.rank} indices, got {len(cell)}")
        return self._in_cells(level, [(int(c), int(c)) for c in cell], with_relationships).drop(*[f"c{d}" for d in range(self.schema.rank)])

    def candidates(self, level: int | str, lower: Sequence[float], upper: Sequence[float], with_relationships: bool = False) -> DataFrame:
        """Content of every cell that the box needs, once per cell, with the cell's indices."""
        _, grid = self.level(level)
        return self._in_cells(level, grid.query_range(lower, upper), with_relationships)

    def _in_cells(self, level: int | str, ranges: list[tuple[int, int]], with_relationships: bool) -> DataFrame:
        _, grid = self.level(level)
        names = [f"c{d}" for d in range(grid.rank)]
        columns = self._columns(with_relationships)
        if self.cell_table is not None:
            hits = self.cells(level)
            for n, (a, b) in zip(names, ranges):
                hits = hits.where(F.col(n).between(a, b))
            return self.scan(with_relationships=with_relationships).join(hits.drop("morton"), "id").select(*columns, *names)
        # without a written index membership is arithmetic on the bounding box: one pruned scan, no join
        low, high = self._low_high()
        rows = self.with_bounds()
        for d, (a, b) in enumerate(ranges):
            rows = rows.where((high[d] >= grid.origin[d] + a * grid.size[d]) & (low[d] <= grid.origin[d] + (b + 1) * grid.size[d]))
        r = range(grid.rank)
        return grid.explode(rows, [F.col(f"lo_{d}") for d in r], [F.col(f"hi_{d}") for d in r], ranges).select(*columns, *names)

    def in_bounds(self, lower: Sequence[float], upper: Sequence[float], limit: int | None = None, exact: bool = False, dedupe: bool = True, with_relationships: bool = False) -> DataFrame:
        """Annotations in a box.

        ``exact`` asks for true intersection instead of the plain predicate of the type. With
        ``dedupe=False`` an annotation comes once for every cell of every level that the box needs.
        ``limit`` holds after the predicate, by id."""
        box = geometry.check_box(lower, upper, self.schema.rank)
        hit = geometry.intersects(self.schema, box) if exact else geometry.in_box(self.schema, box)
        if dedupe:
            low, high = self._low_high()
            rows = self.table
            for d in range(self.schema.rank):  # implied by the predicate, and what the scan can skip by
                rows = rows.where((high[d] >= box[0][d]) & (low[d] <= box[1][d]))
            out = rows.where(hit).select(*self._columns(with_relationships))
        else:
            out = None
            for x in self.levels():
                own = self.candidates(x.key, *box, with_relationships).where(hit).select(*self._columns(with_relationships))
                out = own if out is None else out.unionAll(own)
        return out if limit is None else out.orderBy("id").limit(limit)

    # -- values ----------------------------------------------------------------------------------------
    def decode_enums(self, df: DataFrame | None = None, strict: bool = False) -> DataFrame:
        """Numbers of enumerated properties by their labels; others as text, or an error if ``strict``."""
        df = self.scan() if df is None else df
        for p in self.schema.properties:
            if p.enum_values and p.id in df.columns:
                value, text = F.col(p.id), F.col(p.id).cast("string")
                rest = F.when(value.isNotNull(), F.raise_error(F.concat(F.lit(f"no label of {p.id} for "), text))) if strict else text
                chosen = None
                for number, label in p.enum().items():
                    same = value == F.lit(number).cast(p.spark_type())
                    chosen = F.when(same, label) if chosen is None else chosen.when(same, label)
                df = df.withColumn(p.id, chosen.otherwise(rest))
        return df

    # -- catalog ---------------------------------------------------------------------------------------
    def property_names(self) -> list[str]:
        return [p.id for p in self.schema.properties]

    def relationships(self) -> list[str]:
        return list(self.schema.relationships)

    def relationship_keys(self) -> list[str]:
        keys = self.info.relation_keys if self.info else {}
        return [keys.get(r, f"rel_{r}") for r in self.schema.relationships]

    def catalog(self) -> DataFrame:
        """``kind, pos, name, type``: dimensions, geometry, properties in stored order, relationships."""
        rows = [("dimension", i, n, u) for i, (n, u) in enumerate(zip(self.schema.space.names, self.schema.space.units))]
        rows += [("geometry", i, p, f"float32[{self.schema.rank}]") for i, p in enumerate(self.schema.parts)]
        rows += [("property", i, p.id, p.type) for i, p in enumerate(self.schema.stored_properties())]
        rows += [("relationship", i, r, "uint64[]") for i, r in enumerate(self.schema.relationships)]
        return self.table.sparkSession.createDataFrame(rows, "kind string, pos int, name string, type string")

    def register(self, name: str) -> None:
        """Temporary views ``name``, ``name_links`` and ``name_cells`` for SQL."""
        self.table.createOrReplaceTempView(name)
        self.links().createOrReplaceTempView(f"{name}_links")
        self.cells().createOrReplaceTempView(f"{name}_cells")
