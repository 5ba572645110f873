"""Metadata documents: the ``info`` of a set, and checks of this and related document kinds."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

from .schema import GEOMETRY, PROPERTY_TYPES, AnnotationSchema, CoordinateSpace, PropertySpec

# Fixed values of the interchange format: the "@type" of each kind of document, and closed value lists.
ANNOTATION_KIND = "neuroglancer_annotations_v1"
SHARDING_KIND = "neuroglancer_uint64_sharded_v1"
VOLUME_KIND = "neuroglancer_multiscale_volume"
SEGMENT_PROPERTIES_KIND = "neuroglancer_segment_properties"
SKELETON_KIND = "neuroglancer_skeletons"
MULTIRESOLUTION_MESH_KIND = "neuroglancer_multilod_draco"
LEGACY_MESH_KIND = "neuroglancer_legacy_mesh"
SHARD_HASHES = ("identity", "murmurhash3_x86_128")
VOLUME_TYPES = ("image", "segmentation")
VOLUME_DATA_TYPES = ("uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "float32")
VOLUME_ENCODINGS = ("raw", "jpeg", "compressed_segmentation", "png", "compresso", "jxl")
SEGMENT_PROPERTY_TYPES = ("label", "description", "string", "tags", "number")


# -- a small JSON Schema checker -------------------------------------------------------------------
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number") and isinstance(value, bool):
        return False
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES[kind])


def problems(doc, schema: dict, registry: dict[str, dict], at: str = "$") -> list[str]:
    """What is wrong with ``doc``; the keywords that metadata schemas use are known."""
    if "$ref" in schema:
        if (target := find_schema(schema["$ref"], registry)) is None:
            return [f"{at}: unknown reference {schema['$ref']!r}"]
        return problems(doc, target, registry, at)
    found: list[str] = []
    if "type" in schema and not _is(doc, schema["type"]):
        return [f"{at}: {schema['type']} expected, got {type(doc).__name__}"]
    if "const" in schema and doc != schema["const"]:
        found.append(f"{at}: {schema['const']!r} expected, got {doc!r}")
    if "enum" in schema and doc not in schema["enum"]:
        found.append(f"{at}: {doc!r} is none of {schema['enum']}")
    if "oneOf" in schema and (n := sum(not problems(doc, s, registry, at) for s in schema["oneOf"])) != 1:
        found.append(f"{at}: exactly one alternative must hold, {n} do")
    if isinstance(doc, str) and "pattern" in schema:
        pattern = schema["pattern"]
        if "(?i)" in pattern:  # newer Python wants such a flag in front
            pattern = "(?i)" + pattern.replace("(?i)", "")
        if not re.search(pattern, doc):
            found.append(f"{at}: {doc!r} does not match {schema['pattern']!r}")
    if _is(doc, "number"):
        if "minimum" in schema and doc < schema["minimum"]:
            found.append(f"{at}: {doc} is below {schema['minimum']}")
        if "maximum" in schema and doc > schema["maximum"]:
            found.append(f"{at}: {doc} is above {schema['maximum']}")
    if isinstance(doc, list):
        if len(doc) < schema.get("minItems", 0) or len(doc) > schema.get("maxItems", len(doc)):
            found.append(f"{at}: {len(doc)} items are too few or too many")
        each = schema.get("items")
        pairs = zip(doc, each) if isinstance(each, list) else ((x, each) for x in doc if each is not None)
        for i, (x, s) in enumerate(pairs):
            found += problems(x, s, registry, f"{at}[{i}]")
    if isinstance(doc, dict):
        found += [f"{at}: {k!r} is missing" for k in schema.get("required", ()) if k not in doc]
        for k, s in schema.get("properties", {}).items():
            if k in doc:
                found += problems(doc[k], s, registry, f"{at}.{k}")
        if "values" in schema:  # own keyword: every value of an open map
            for k, v in doc.items():
                found += problems(v, schema["values"], registry, f"{at}.{k}")
    for check in schema.get("checks", ()):
        found += [f"{at}: {m}" for m in check(doc)] if not found else []
    return found


def _plain(name: str) -> str:
    return re.sub(r"[^a-z]", "", name.lower())


def find_schema(schema_id: str, registry: dict[str, dict]) -> dict | None:
    """By id, or by the kind that an id of other spelling ends with (``...Sharding``)."""
    if schema_id in registry:
        return registry[schema_id]
    ends = [k for k in registry if _plain(schema_id).endswith(_plain(k))]
    return registry[max(ends, key=len)] if ends else None


def validate_json(doc, schema_id: str, schemas: dict[str, dict] | None = None) -> None:
    """Raise ``ValueError`` if the document breaks the schema or the schema is unknown."""
    schemas = load_schemas() if schemas is None else schemas
    schema = find_schema(schema_id, schemas)
    if schema is None:
        raise ValueError(f"unknown schema {schema_id!r}; known: {sorted(schemas)}")
    if found := problems(doc, schema, schemas):
        raise ValueError("; ".join(found))


# -- document kinds --------------------------------------------------------------------------------
def _object(required: str = "", **fields) -> dict:
    return {"type": "object", "properties": {k.replace("at_type", "@type"): v for k, v in fields.items()}, "required": [r.replace("at_type", "@type") for r in required.split()]}


def _list(of: dict, size: int | None = None, least: int = 0) -> dict:
    return {"type": "array", "items": of, "minItems": size or least} | ({"maxItems": size} if size else {})


def _integer(low: int | None = None, high: int | None = None) -> dict:
    return {"type": "integer"} | ({} if low is None else {"minimum": low}) | ({} if high is None else {"maximum": high})


_TEXT, _NUMBER = {"type": "string"}, {"type": "number"}
_SHARDED = {"$ref": "sharding"}


def _one_of(*values: str) -> dict:
    return {"enum": list(values)}


def _enum_pairs(doc: dict) -> list[str]:
    if len(doc.get("enum_values", ())) != len(doc.get("enum_labels", ())):
        return ["enum_values and enum_labels must be of one length"]
    return []


def _same_rank(doc: dict) -> list[str]:
    rank = len(doc["dimensions"])
    return [f"{k} must have {rank} entries" for k in ("lower_bound", "upper_bound") if len(doc[k]) != rank]


def load_schemas() -> dict[str, dict]:
    """The built-in document kinds by id.

    Where the published description is at odds with itself the reading that makes its own examples
    valid is taken: a volume's scales need ``chunk_sizes``, a skeleton needs its kind only, values of
    ``dimensions`` are checked whatever their names.
    """
    numeric = [t for t in PROPERTY_TYPES if t not in ("rgb", "rgba")]
    prop = _object("id type", id=_TEXT, type=_one_of(*PROPERTY_TYPES), description=_TEXT, enum_values=_list(_NUMBER), enum_labels=_list(_TEXT)) | {"checks": [_enum_pairs]}
    level = _object("key limit", key=_TEXT, grid_shape=_list(_integer()), chunk_shape=_list(_integer()), chunk_size=_list(_NUMBER), limit=_integer(1), sharding=_SHARDED)
    level["oneOf"] = [{"required": ["grid_shape"]}, {"required": ["chunk_shape"]}]
    scale = _object(
        "key size chunk_sizes resolution encoding", key=_TEXT, size=_list(_integer(0), 3), voxel_offset=_list(_integer(), 3), chunk_sizes=_list(_list(_integer(1), 3), least=1), resolution=_list(_NUMBER, 3),
        encoding=_one_of(*VOLUME_ENCODINGS), jpeg_quality=_integer(0, 100), png_level=_integer(0, 9), compressed_segmentation_block_size=_list(_NUMBER | {"minimum": 1}, 3), sharding=_SHARDED, hidden={"type": "boolean"},
    )
    inline_property = _object("id type values", id=_TEXT, type=_one_of(*SEGMENT_PROPERTY_TYPES), description=_TEXT, tags=_list(_TEXT), tag_descriptions=_list(_TEXT), data_type=_one_of(*numeric), values={"type": "array"})
    transform = _list(_NUMBER, 12)
    return {
        "annotation": _object(
            "at_type dimensions lower_bound upper_bound annotation_type properties", at_type={"const": ANNOTATION_KIND}, dimensions={"type": "object", "values": {"type": "array", "items": [_NUMBER, _TEXT], "minItems": 2, "maxItems": 2}},
            lower_bound=_list(_NUMBER), upper_bound=_list(_NUMBER), annotation_type={"type": "string", "pattern": f"^(?i)({'|'.join(GEOMETRY)})$"}, properties=_list(prop),
            relationships=_list(_object("id key", id=_TEXT, key=_TEXT, sharding=_SHARDED)), by_id=_object("key", key=_TEXT, sharding=_SHARDED), spatial=_list(level), segment_properties=_TEXT,
        ) | {"checks": [_same_rank]},
        "sharding": _object("at_type preshift_bits hash minishard_bits shard_bits minishard_index_encoding data_encoding", at_type={"const": SHARDING_KIND}, preshift_bits=_integer(0, 64), hash=_one_of(*SHARD_HASHES), minishard_bits=_integer(0, 64), shard_bits=_integer(0, 64), minishard_index_encoding=_one_of("raw", "gzip"), data_encoding=_one_of("raw", "gzip")),
        "volume": _object("type data_type num_channels", at_type={"const": VOLUME_KIND}, type=_one_of(*VOLUME_TYPES), data_type=_one_of(*VOLUME_DATA_TYPES), num_channels=_integer(1), scales=_list(scale, least=1), mesh=_TEXT, skeletons=_TEXT, segment_properties=_TEXT),
        "segment_properties": _object("at_type", at_type={"const": SEGMENT_PROPERTIES_KIND}, inline=_object("ids properties", ids=_list(_TEXT), properties=_list(inline_property))),
        "skeleton": _object("at_type", at_type={"const": SKELETON_KIND}, transform=transform, vertex_attributes=_list(_object("id data_type num_components", id=_TEXT, data_type=_one_of(*numeric), num_components=_integer(1))), sharding=_SHARDED, segment_properties=_TEXT),
        "multiresolution_mesh": _object("at_type vertex_quantization_bits transform lod_scale_multiplier", at_type={"const": MULTIRESOLUTION_MESH_KIND}, vertex_quantization_bits={"enum": [10, 16]}, transform=transform, lod_scale_multiplier=_NUMBER, sharding=_SHARDED, segment_properties=_TEXT),
        "legacy_mesh": _object("at_type", at_type={"const": LEGACY_MESH_KIND}, segment_properties=_TEXT),
        "legacy_mesh_manifest": _object("fragments", fragments=_list(_TEXT)),
    }


# -- the info document -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Level:
    """A level of the spatial index: a regular grid from the set's lower bound."""

    key: str
    chunk_size: tuple[float, ...]
    grid_shape: tuple[int, ...]
    limit: int = 1
    sharding: dict | None = None


@dataclass(frozen=True)
class Info:
    schema: AnnotationSchema
    lower_bound: tuple[float, ...]
    upper_bound: tuple[float, ...]
    levels: tuple[Level, ...] = ()
    relation_keys: dict[str, str] = field(default_factory=dict)
    relation_sharding: dict[str, dict | None] = field(default_factory=dict)
    by_id_key: str | None = "by_id"
    by_id_sharding: dict | None = None

    def to_json(self) -> dict:
        doc = {
            "@type": ANNOTATION_KIND,
            "dimensions": self.schema.space.to_json(),
            "lower_bound": list(self.lower_bound),
            "upper_bound": list(self.upper_bound),
            "annotation_type": self.schema.annotation_type,
            "properties": [p.to_json() for p in self.schema.properties],
            "relationships": [_with_sharding({"id": r, "key": self.relation_keys.get(r, f"rel_{r}")}, self.relation_sharding.get(r)) for r in self.schema.relationships],
            "spatial": [_with_sharding({"key": x.key, "grid_shape": list(x.grid_shape), "chunk_size": list(x.chunk_size), "limit": max(1, x.limit)}, x.sharding) for x in self.levels],
        }
        if self.by_id_key is not None:
            doc["by_id"] = _with_sharding({"key": self.by_id_key}, self.by_id_sharding)
        return doc

    @classmethod
    def from_json(cls, doc: dict) -> Info:
        validate_json(doc, "annotation")
        relations = doc.get("relationships", [])
        schema = AnnotationSchema(doc["annotation_type"], CoordinateSpace.from_json(doc["dimensions"]), tuple(PropertySpec.from_json(p) for p in doc["properties"]), tuple(r["id"] for r in relations))
        lower, upper = doc["lower_bound"], doc["upper_bound"]
        levels = []
        for x in doc.get("spatial", []):
            shape = x.get("grid_shape") or x.get("chunk_shape")
            size = x.get("chunk_size") or [(b - a) / n for a, b, n in zip(lower, upper, shape)]
            levels.append(Level(x["key"], tuple(map(float, size)), tuple(map(int, shape)), x["limit"], x.get("sharding")))
        by_id = doc.get("by_id", {})
        return cls(schema, tuple(map(float, lower)), tuple(map(float, upper)), tuple(levels), {r["id"]: r["key"] for r in relations}, {r["id"]: r.get("sharding") for r in relations}, by_id.get("key"), by_id.get("sharding"))

    def dumps(self) -> str:
        return json.dumps(self.to_json(), default=plain_value)


def plain_value(x):
    """Numbers and arrays of numpy as JSON knows them."""
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, Path):
        return str(x)
    raise TypeError(f"{type(x).__name__} has no JSON form")


def _with_sharding(doc: dict, sharding: dict | None) -> dict:
    return doc | {"sharding": sharding} if sharding else doc
