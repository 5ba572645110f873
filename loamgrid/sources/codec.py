"""The packed record form: layout, encoding and decoding with numpy, a batch at a time.

A record is the geometry as 32-bit floats, the properties in listed order without gaps, and zeros up
to a multiple of four bytes. A by-id value is a record and, per relationship, a 32-bit count and so
many 64-bit ids. A multi value is a 64-bit count, the records, and the 64-bit annotation ids. All
numbers are little-endian; keys of sharded stores are big-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamgrid.plans.schema import PROPERTY_TYPES, AnnotationSchema

#: Rows of a group that are handed on at once.
ROWS = 1 << 16


class RecordLayout:
    """Offsets and sizes of a schema's record, with properties as the schema lists them."""

    def __init__(self, schema: AnnotationSchema):
        self.schema = schema
        fields: list[tuple] = [(p, "<f4", (schema.rank,)) for p in schema.parts]
        for p in schema.properties:
            code, components, _ = PROPERTY_TYPES[p.type]
            fields.append((p.id, code) if components == 1 else (p.id, code, (components,)))
        size = sum(np.dtype(f[1:] if len(f) == 3 else f[1]).itemsize for f in fields)
        if pad := -size % 4:
            fields.append((f"padding{size}", "V1" if pad == 1 else f"V{pad}"))
        self.dtype = np.dtype(fields)
        self.size = self.dtype.itemsize

    # -- batches of columns <-> records ---------------------------------------------------------------
    def pack(self, batch: pa.RecordBatch) -> np.ndarray:
        """Structured records of a batch with the schema's columns."""
        out = np.zeros(batch.num_rows, self.dtype)
        for name, width in [(p, self.schema.rank) for p in self.schema.parts] + [(p.id, p.components) for p in self.schema.properties]:
            column = batch.column(name)
            if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
                if any(n != width for n in set(column.value_lengths().to_pylist())):
                    raise ValueError(f"{name} must hold {width} values in every row")
                values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            else:
                values = column.to_numpy(zero_copy_only=False)
            kind = self.dtype[name].base
            if kind.kind != "f" and len(values):
                low, high = np.iinfo(kind).min, np.iinfo(kind).max
                if values.min() < low or values.max() > high:
                    raise ValueError(f"{name} does not fit {kind.name}")
            out[name] = values
        return out

    def columns(self, records: np.ndarray) -> dict[str, pa.Array]:
        """Arrow columns of geometry and properties, widened to Spark's types."""
        found = {}
        types = {f.name: f.type for f in to_arrow_schema(self.schema.struct_type())}
        for name in [*self.schema.parts, *(p.id for p in self.schema.properties)]:
            values = records[name]
            if values.ndim == 2:
                flat = pa.array(np.ascontiguousarray(values).ravel()).cast(types[name].value_type)
                found[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)
            else:
                found[name] = pa.array(np.ascontiguousarray(values)).cast(types[name])
        return found

    # -- values -------------------------------------------------------------------------------------------
    def encode_by_id(self, batch: pa.RecordBatch) -> list[bytes]:
        raw, size = self.pack(batch).tobytes(), self.size
        out = [raw[i : i + size] for i in range(0, len(raw), size)]
        for r in self.schema.relationships:
            for i, related in enumerate(batch.column(r).to_pylist()):
                out[i] += struct.pack(f"<I{len(related or ())}Q", len(related or ()), *(related or ()))
        return out

    def encode_multi(self, records: bytes, ids: np.ndarray) -> bytes:
        return struct.pack("<Q", len(ids)) + records + ids.astype("<u8").tobytes()

    def decode_by_id(self, ids: list[int], values: list[bytes]) -> pa.RecordBatch:
        """Rows of by-id values, relationships included."""
        records = np.frombuffer(b"".join(v[: self.size] for v in values), self.dtype)
        columns = {"id": pa.array(ids, pa.int64()), **self.columns(records)}
        lists: dict[str, list] = {r: [] for r in self.schema.relationships}
        for v in values:
            at = self.size
            for r in self.schema.relationships:
                (n,) = struct.unpack_from("<I", v, at)
                lists[r].append(list(struct.unpack_from(f"<{n}Q", v, at + 4)))
                at += 4 + 8 * n
            if at != len(v):
                raise ValueError(f"{len(v)} bytes where the record needs {at}")
        columns |= {r: pa.array(x, pa.list_(pa.int64())) for r, x in lists.items()}
        return pa.RecordBatch.from_pydict(columns)

    def decode_ids(self, value: bytes) -> np.ndarray:
        """Annotation ids of a multi value; the records are skipped."""
        if not value:
            return np.zeros(0, np.int64)
        (n,) = struct.unpack_from("<Q", value)
        ids = np.frombuffer(value, "<u8", n, 8 + n * self.size).astype(np.int64)
        if len(ids) and ids.min() < 0:
            raise ValueError("ids from 2^63 on are not supported")
        return ids

    def decode_multi(self, value: bytes) -> pa.RecordBatch:
        """Rows of a multi value, without relationships; an empty value holds none."""
        (n,) = struct.unpack_from("<Q", value) if value else (0,)
        if value and len(value) != 8 + n * (self.size + 8):
            raise ValueError(f"{len(value)} bytes do not hold {n} records of {self.size} bytes")
        records = np.frombuffer(value, self.dtype, n, 8) if n else np.zeros(0, self.dtype)
        return pa.RecordBatch.from_pydict({"id": pa.array(self.decode_ids(value)), **self.columns(records)})


def row_type(schema: AnnotationSchema, with_relationships: bool) -> T.StructType:
    full = schema.struct_type()
    return full if with_relationships else T.StructType([f for f in full if f.name not in schema.relationships])


def encode_by_id(df: DataFrame, schema: AnnotationSchema) -> DataFrame:
    """``id, value``: the by-id value of every annotation."""
    layout = RecordLayout(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(layout.encode_by_id(batch), pa.binary())], ["id", "value"])

    return df.select(*schema.columns()).mapInArrow(run, "id bigint, value binary")


def decode_by_id(df: DataFrame, schema: AnnotationSchema) -> DataFrame:
    """Annotations of ``id, value``."""
    layout = RecordLayout(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield layout.decode_by_id(batch.column("id").to_pylist(), batch.column("value").to_pylist())

    return df.select("id", "value").mapInArrow(run, schema.struct_type())


def encode_groups(df: DataFrame, schema: AnnotationSchema, key: str) -> DataFrame:
    """``key, value``: the multi value of each group, in id order.

    Rows are dealt and sorted by key, then encoded as they stream by; only the packed records of the
    open group are held."""
    layout = RecordLayout(schema)
    columns = [c for c in schema.columns() if c not in schema.relationships]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, parts, ids = None, [], []

        def value() -> tuple[str, bytes]:
            return key_now, layout.encode_multi(b"".join(parts), np.concatenate(ids))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column("_key").to_pylist(), object)
            packed, own = layout.pack(batch), batch.column("id").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                if parts and keys[a] != key_now:
                    done.append(value())
                    parts, ids = [], []
                key_now = keys[a]
                parts.append(packed[a:b].tobytes())
                ids.append(own[a:b])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([v for _, v in done], pa.binary())], ["key", "value"])
        if parts:
            k, v = value()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([v], pa.binary())], ["key", "value"])

    rows = df.selectExpr(f"cast({key} as string) as _key", *[f"`{c}`" for c in columns])
    return rows.repartition("_key").sortWithinPartitions("_key", "id").mapInArrow(run, "key string, value binary")


def decode_groups(df: DataFrame, schema: AnnotationSchema) -> DataFrame:
    """Annotations of ``key, value``, each with the key of its group."""
    layout = RecordLayout(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, v in zip(batch.column("key").to_pylist(), batch.column("value")):
                whole = layout.decode_multi(v.as_py())
                for rows in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * rows.num_rows, pa.string()), *rows.columns], ["key", *rows.schema.names])

    fields = row_type(schema, False).fields
    return df.select("key", "value").mapInArrow(run, T.StructType([T.StructField("key", T.StringType()), *fields]))
