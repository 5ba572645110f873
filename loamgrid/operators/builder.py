"""Building annotation sets from DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.functions.grid import sizes_of
from loamgrid.plans.schema import AnnotationSchema
from loamgrid.session import settle

from .annotation_set import AnnotationSet


def auto_id(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``id`` = number of rows before, in the given order.

    Rows are sorted over all tasks and written once with their place in their task, so that the
    counts and the ranks come from one deal; no task holds more than its range."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    columns = df.columns
    placed = settle(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row per partition
    return placed.join(F.broadcast(before), part == F.col("_p")).select((F.col("_before") + place).cast("bigint").alias("id"), *columns)


def _vector(value: Column | str | Sequence[Column | str], rank: int) -> Column:
    if isinstance(value, (list, tuple)):
        if len(value) != rank:
            raise ValueError(f"a point needs {rank} coordinates, got {len(value)}")
        return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("float") for c in value])
    return (F.col(value) if isinstance(value, str) else value).cast("array<float>")


def build(
    df: DataFrame, schema: AnnotationSchema, geometry: Mapping[str, Column | str | Sequence[Column | str]], id: Column | str | None = None, order: Sequence[str | Column] = (),
    values: Mapping[str, Column | str] | None = None, chunk_size: float | Sequence[float] = 256,
) -> AnnotationSet:
    """A set from the rows of ``df``.

    ``geometry`` names a vector column or a list of coordinates for each part of the type; ``values``
    the columns of properties and relationships where they differ from the names. Unset properties
    are zero, unset relationships empty; a relationship may be one id, a list or null. Without ``id``
    rows are numbered in ``order``. Coordinates become floats before anything is derived from them."""
    unknown = set(geometry) - set(schema.parts)
    if unknown or set(schema.parts) - set(geometry):
        raise ValueError(f"{schema.annotation_type} has the parts {schema.parts}, got {tuple(geometry)}")
    values = dict(values or {})
    if extra := set(values) - {p.id for p in schema.properties} - set(schema.relationships):
        raise ValueError(f"no property or relationship of name {sorted(extra)}")
    sizes_of(chunk_size, schema.rank)
    if id is None:
        if not order:
            raise ValueError("rows need an id or an order to number them in")
        df, id = auto_id(df, order), "id"
    columns = [(F.col(id) if isinstance(id, str) else id).cast("bigint").alias("id")]
    columns += [_vector(geometry[p], schema.rank).alias(p) for p in schema.parts]
    known = dict(df.dtypes)
    for p in schema.properties:
        given = values.get(p.id, p.id if p.id in known else None)
        zero = F.lit(0).cast(p.spark_type()) if p.components == 1 else F.array(*[F.lit(0)] * p.components).cast(p.spark_type())
        value = zero if given is None else F.coalesce((F.col(given) if isinstance(given, str) else given).cast(p.spark_type()), zero)
        columns.append(value.alias(p.id))
    empty = F.array().cast("array<bigint>")
    for r in schema.relationships:
        given = values.get(r, r if r in known else None)
        if given is None:
            columns.append(empty.alias(r))
            continue
        value = F.col(given) if isinstance(given, str) else given
        kind = df.select(value.alias("v")).schema["v"].dataType
        listed = value.cast("array<bigint>") if isinstance(kind, T.ArrayType) else F.when(value.isNotNull(), F.array(value.cast("bigint")))
        columns.append(F.coalesce(listed, empty).alias(r))
    return AnnotationSet(schema, df.select(*columns), chunk_size=chunk_size)


def check_ids(table: DataFrame) -> None:
    """``ValueError`` if an id is null, negative or given twice."""
    bad = table.select("id").where(F.col("id").isNull() | (F.col("id") < 0)).limit(1).count()
    twice = table.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if bad or twice:
        raise ValueError(f"ids must be set, not negative and unique{f': {twice[0].id} is not' if twice else ''}")
