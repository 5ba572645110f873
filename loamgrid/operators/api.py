"""Reader and writer objects for those who think in calls rather than DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from numbers import Integral

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions.grid import sizes_of
from loamgrid.plans.schema import AnnotationSchema, CoordinateSpace, PropertySpec

from .annotation_set import MAX_ANNOTATIONS, AnnotationSet
from .builder import build


class Reader:
    """Every read of a set; results are DataFrames unless a call says otherwise."""

    def __init__(self, data: AnnotationSet):
        self.data = data

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Reader:
        from loamgrid.sources.store import open_set

        return cls(open_set(spark, path))

    # metadata
    @property
    def coordinate_space(self) -> CoordinateSpace:
        return self.data.schema.space

    @property
    def properties(self) -> list[PropertySpec]:
        return list(self.data.schema.properties)

    @property
    def info(self) -> dict:
        from loamgrid.sources.store import full_info

        return (self.data.info or full_info(self.data)).to_json()

    @property
    def lower_bound(self) -> list[float]:
        return self.data.bounds()[0]

    @property
    def upper_bound(self) -> list[float]:
        return self.data.bounds()[1]

    def get_property_names(self) -> list[str]:
        return self.data.property_names()

    def get_relationships(self) -> list[str]:
        return self.data.relationships()

    def get_relationship_keys(self) -> list[str]:
        return self.data.relationship_keys()

    def get_annotation_type(self) -> str:
        return self.data.schema.annotation_type

    def get_dimensions(self) -> dict:
        return self.data.schema.space.to_json()

    def get_properties(self) -> list[PropertySpec]:
        return self.properties

    # reads
    def get_all_annotation_ids(self) -> DataFrame:
        return self.data.ids()

    def get_all_annotations(self, max_annotations: int = MAX_ANNOTATIONS) -> DataFrame:
        return self.data.decode_enums(self.data.scan(max_annotations))

    def iter_all_ann(self, chunk_size: int = MAX_ANNOTATIONS, min_key: int = 0, max_key: int | None = None) -> Iterator[dict]:
        """Dicts of an id range (without ``max_key``, to the largest id), fetched in ranges of
        ``chunk_size`` ids; ranges without any are passed over."""
        start = min_key
        while (least := self.data.id_range(start, max_key).agg(F.min("id")).first()[0]) is not None:
            start = least + chunk_size
            yield from (r.asDict() for r in self.data.iterate(least, start if max_key is None else min(start, max_key)))

    def get_by_id(self, annotation_id: int) -> dict:
        """One annotation as a dict; ``KeyError`` if there is none."""
        rows = self.data.decode_enums(self.data.by_id(annotation_id), strict=True).take(1)
        if not rows:
            raise KeyError(annotation_id)
        return rows[0].asDict()

    def get_by_ids(self, ids: Sequence[int], on_missing: str = "error") -> DataFrame:
        return self.data.decode_enums(self.data.by_ids(ids, on_missing))

    def get_by_relationship(self, relationship: str | None = None, related_id: int | None = None, get_relationships: bool = False, **named: int) -> DataFrame:
        """By name and id, or as a keyword: ``get_by_relationship(segment=7)``."""
        if relationship is None:
            if len(named) != 1:
                raise ValueError("one relationship is asked for at a time")
            ((relationship, related_id),) = named.items()
        return self.data.decode_enums(self.data.by_relationship(relationship, related_id, get_relationships))

    def read_annotations_in_chunk(self, spatial_key: str, chunk_index: Sequence[int], get_relationships: bool = False) -> DataFrame:
        return self.data.decode_enums(self.data.in_cell(spatial_key, chunk_index, get_relationships))

    def query_spatial_index_in_bounds(self, spatial_key: str, lower_bound: Sequence[float], upper_bound: Sequence[float]) -> DataFrame:
        cells = [f"c{d}" for d in range(self.data.schema.rank)]
        return self.data.decode_enums(self.data.candidates(spatial_key, lower_bound, upper_bound)).drop(*cells)

    def get_annotations_in_bounds(self, lower_bound: Sequence[float], upper_bound: Sequence[float], max_annotations: int | None = MAX_ANNOTATIONS, **options) -> DataFrame:
        """Annotations in a box; beyond ``max_annotations`` a warning says that the rest is left out."""
        if max_annotations is not None and self.data.in_bounds(lower_bound, upper_bound, **options).limit(max_annotations + 1).count() > max_annotations:
            warnings.warn(f"more than {max_annotations} annotations in the box: the first by id are returned", stacklevel=2)
        return self.data.decode_enums(self.data.in_bounds(lower_bound, upper_bound, max_annotations, **options))

    get_by_bounding_box = get_annotations_in_bounds


class Writer:
    """Collects annotations one by one, for small sets; ``build`` takes DataFrames of any size."""

    def __init__(
        self, spark: SparkSession, annotation_type: str, names: Sequence[str] = ("x", "y", "z"), scales: Sequence[float] | None = None, units: str | Sequence[str] = "nm",
        relationships: Sequence[str] = (), properties: Sequence[PropertySpec] = (), chunk_size: float | Sequence[float] = 256,
    ):
        self.spark = spark
        self.schema = AnnotationSchema(annotation_type, CoordinateSpace.of(names, scales, units), tuple(properties), tuple(relationships))
        self.chunk_size = sizes_of(chunk_size, self.schema.rank)
        self.rows: list[tuple] = []

    def _add(self, kind: str, vectors: Sequence[Sequence[float]], id: int | None, values: dict) -> None:
        if kind != self.schema.annotation_type:
            raise ValueError(f"the set holds {self.schema.annotation_type} annotations, not {kind}")
        if any(len(v) != self.schema.rank for v in vectors):
            raise ValueError(f"a point needs {self.schema.rank} coordinates")
        known = {p.id: p for p in self.schema.properties}
        if extra := set(values) - set(known) - set(self.schema.relationships):
            raise ValueError(f"no property or relationship of name {sorted(extra)}")
        row = [len(self.rows) if id is None else int(id), *[[float(x) for x in v] for v in vectors]]
        for name, p in known.items():
            value = values.get(name)
            one = float if p.type == "float32" else int
            row.append([int(x) for x in value or [0] * p.components] if p.components > 1 else one(value or 0))
        for name in self.schema.relationships:
            value = values.get(name)
            row.append([] if value is None else [int(value)] if isinstance(value, Integral) else [int(x) for x in value])
        self.rows.append(tuple(row))

    def add_point(self, point: Sequence[float], id: int | None = None, **values) -> None:
        self._add("point", [point], id, values)

    def add_line(self, point_a: Sequence[float], point_b: Sequence[float], id: int | None = None, **values) -> None:
        self._add("line", [point_a, point_b], id, values)

    def add_axis_aligned_bounding_box(self, point_a: Sequence[float], point_b: Sequence[float], id: int | None = None, **values) -> None:
        self._add("axis_aligned_bounding_box", [point_a, point_b], id, values)

    def add_ellipsoid(self, center: Sequence[float], radii: Sequence[float], id: int | None = None, **values) -> None:
        self._add("ellipsoid", [center, radii], id, values)

    def get_chunk_index(self, coords: Sequence[float]) -> tuple[int, ...]:
        """Cell of a point in the grid from zero."""
        return tuple(int(c // s) for c, s in zip(coords, self.chunk_size))

    def build(self) -> AnnotationSet:
        table = self.spark.createDataFrame(self.rows, self.schema.struct_type())
        return build(table, self.schema, {p: p for p in self.schema.parts}, "id", chunk_size=self.chunk_size)

    def write(self, path: str, write_sharded: bool = True, format: str = "interchange") -> None:
        """Write the set as "interchange" or as native "parquet"."""
        from loamgrid.sources import interchange, store

        if format not in ("interchange", "parquet"):
            raise ValueError(f"unknown format {format!r}")
        data = self.build()
        interchange.write(data, path, write_sharded) if format == "interchange" else store.write(data, path)
