"""What a set of annotations looks like: coordinate space, geometry, properties, relationships."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

# Fixed values of the interchange format: name -> (numpy code, components, bytes of one component).
PROPERTY_TYPES = {
    "uint8": ("<u1", 1, 1),
    "uint16": ("<u2", 1, 2),
    "uint32": ("<u4", 1, 4),
    "int8": ("<i1", 1, 1),
    "int16": ("<i2", 1, 2),
    "int32": ("<i4", 1, 4),
    "float32": ("<f4", 1, 4),
    "rgb": ("<u1", 3, 1),
    "rgba": ("<u1", 4, 1),
}
#: Columns of each annotation type, in the order in which they are stored.
GEOMETRY = {
    "point": ("point",),
    "line": ("point_a", "point_b"),
    "axis_aligned_bounding_box": ("point_a", "point_b"),
    "ellipsoid": ("center", "radii"),
}
_WIDE = {"<u1": T.ShortType(), "<u2": T.IntegerType(), "<u4": T.LongType(), "<i1": T.ByteType(), "<i2": T.ShortType(), "<i4": T.IntegerType(), "<f4": T.FloatType()}


@dataclass(frozen=True)
class CoordinateSpace:
    names: tuple[str, ...] = ("x", "y", "z")
    scales: tuple[float, ...] = (1.0, 1.0, 1.0)
    units: tuple[str, ...] = ("nm", "nm", "nm")

    @classmethod
    def of(cls, names: Sequence[str] = ("x", "y", "z"), scales: Sequence[float] | None = None, units: str | Sequence[str] = "nm") -> CoordinateSpace:
        """One unit may stand for all dimensions; lengths must agree."""
        scales = (1.0,) * len(names) if scales is None else tuple(map(float, scales))
        units = (units,) * len(names) if isinstance(units, str) else tuple(units)
        if not len(names) == len(scales) == len(units):
            raise ValueError(f"{len(names)} names, {len(scales)} scales and {len(units)} units: the numbers must agree")
        return cls(tuple(names), scales, units)

    @property
    def rank(self) -> int:
        return len(self.names)

    def to_json(self) -> dict:
        return {n: [s, u] for n, s, u in zip(self.names, self.scales, self.units)}

    @classmethod
    def from_json(cls, doc: dict) -> CoordinateSpace:
        return cls(tuple(doc), tuple(float(v[0]) for v in doc.values()), tuple(v[1] for v in doc.values()))


@dataclass(frozen=True)
class PropertySpec:
    id: str
    type: str
    description: str | None = None
    enum_values: tuple[float, ...] = ()
    enum_labels: tuple[str, ...] = ()

    def __post_init__(self):
        if self.type not in PROPERTY_TYPES:
            raise ValueError(f"property {self.id!r} has unknown type {self.type!r}")
        if len(self.enum_values) != len(self.enum_labels):
            raise ValueError(f"property {self.id!r} needs as many labels as values")

    @property
    def components(self) -> int:
        return PROPERTY_TYPES[self.type][1]

    @property
    def size(self) -> int:
        return PROPERTY_TYPES[self.type][1] * PROPERTY_TYPES[self.type][2]

    def spark_type(self) -> T.DataType:
        own = _WIDE[PROPERTY_TYPES[self.type][0]]
        return own if self.components == 1 else T.ArrayType(own)

    def enum(self) -> dict:
        """Stored value -> label; values are brought to the stored type first, so that they compare equal."""
        code = np.dtype(PROPERTY_TYPES[self.type][0])
        return {code.type(v).item(): label for v, label in zip(self.enum_values, self.enum_labels)}

    def to_json(self) -> dict:
        doc: dict = {"id": self.id, "type": self.type}
        if self.description is not None:
            doc["description"] = self.description
        if self.enum_values:
            doc |= {"enum_values": list(self.enum_values), "enum_labels": list(self.enum_labels)}
        return doc

    @classmethod
    def from_json(cls, doc: dict) -> PropertySpec:
        return cls(doc["id"], doc["type"], doc.get("description"), tuple(doc.get("enum_values", ())), tuple(doc.get("enum_labels", ())))


@dataclass(frozen=True)
class AnnotationSchema:
    annotation_type: str
    space: CoordinateSpace = field(default_factory=CoordinateSpace)
    properties: tuple[PropertySpec, ...] = ()
    relationships: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "annotation_type", self.annotation_type.lower())
        if self.annotation_type not in GEOMETRY:
            raise ValueError(f"unknown annotation type {self.annotation_type!r}")
        names = [*self.parts, *(p.id for p in self.properties), *self.relationships, "id"]
        if len(set(names)) != len(names):
            raise ValueError(f"column names must differ: {names}")
        # columns that stored tables and query results have beside these
        own = {"pos", "morton", "_found", *(f"{n}{d}" for n in ("lo_", "hi_", "c", "_f", "_t") for d in range(self.rank))}
        if taken := own & set(names):
            raise ValueError(f"reserved names: {sorted(taken)}")

    @property
    def rank(self) -> int:
        return self.space.rank

    @property
    def parts(self) -> tuple[str, ...]:
        return GEOMETRY[self.annotation_type]

    def stored_properties(self) -> list[PropertySpec]:
        """Properties as a writer lists them: wide components first, otherwise as given."""
        return sorted(self.properties, key=lambda p: -PROPERTY_TYPES[p.type][2])

    def columns(self) -> list[str]:
        return ["id", *self.parts, *(p.id for p in self.properties), *self.relationships]

    def struct_type(self) -> T.StructType:
        fields = [T.StructField("id", T.LongType())]
        fields += [T.StructField(p, T.ArrayType(T.FloatType())) for p in self.parts]
        fields += [T.StructField(p.id, p.spark_type()) for p in self.properties]
        fields += [T.StructField(r, T.ArrayType(T.LongType())) for r in self.relationships]
        return T.StructType(fields)
