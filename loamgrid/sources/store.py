"""Native storage: three Parquet tables and the metadata document, written last as the commit mark.

``annotations`` is dealt and sorted by the Morton code of each bounding box's first cell, so that row
groups are tight in space and box queries skip by the ``lo_*``/``hi_*`` statistics; a Bloom filter on
``id`` serves lookups. ``links`` is split by relationship and sorted by object, ``cells`` is split by
level and sorted by Morton code.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.functions import morton
from loamgrid.functions.grid import Grid
from loamgrid.operators.annotation_set import AnnotationSet
from loamgrid.operators.builder import check_ids
from loamgrid.plans.metadata import Info, Level
from loamgrid.session import exists, read_text, write_text


def full_info(data: AnnotationSet) -> Info:
    """The set's metadata with its levels, their upper bound aligned to the first grid."""
    levels = data.levels()
    lower = data.bounds()[0]
    upper = Grid(tuple(lower), levels[0].chunk_size, levels[0].grid_shape).upper
    return Info(data.schema, tuple(lower), tuple(upper), tuple(levels))


def write(data: AnnotationSet, path: str, unique_ids: bool = True) -> Info:
    """Write the set below ``path``, which must not hold one yet."""
    spark = data.table.sparkSession
    if unique_ids:
        check_ids(data.table)
    info = full_info(data)
    r = range(data.schema.rank)
    first = Grid(tuple(info.lower_bound), info.levels[-1].chunk_size, info.levels[-1].grid_shape)
    rows = data.with_bounds()
    cell = [F.least(F.greatest(first.index(F.col(f"lo_{d}"), d), F.lit(0)), F.lit(first.shape[d] - 1)).cast("bigint") for d in r]
    rows = rows.withColumn("morton", morton.encode(cell, first.shape))
    placed = rows.repartitionByRange("morton", "id").sortWithinPartitions("morton", "id")
    placed.write.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{path}/annotations")
    if data.schema.relationships:
        data.links().repartitionByRange("relationship", "related_id", "id").sortWithinPartitions("relationship", "related_id", "id").write.partitionBy("relationship").parquet(f"{path}/links")
    cells = None
    for i, x in enumerate(info.levels):
        own = data.cells(x.key).select(F.lit(i).alias("level"), "*")
        cells = own if cells is None else cells.unionAll(own)
    cells.repartitionByRange("level", "morton", "id").sortWithinPartitions("level", "morton", "id").write.partitionBy("level").parquet(f"{path}/cells")
    counts = {row["level"]: row["n"] for row in spark.read.schema(_cells_schema(data.schema.rank)).parquet(f"{path}/cells").groupBy("level", "morton").count().groupBy("level").agg(F.max("count").alias("n")).collect()}
    levels = tuple(Level(x.key, x.chunk_size, x.grid_shape, max(1, counts.get(i, 1)), x.sharding) for i, x in enumerate(info.levels))
    info = Info(info.schema, info.lower_bound, info.upper_bound, levels)
    write_text(spark, f"{path}/info", info.dumps())
    return info


def read(spark: SparkSession, path: str) -> AnnotationSet:
    """Open a written set; tables are read as queries need them."""
    info = Info.from_json(json.loads(read_text(spark, f"{path}/info")))
    r = range(info.schema.rank)
    rows = T.StructType([*info.schema.struct_type(), *[T.StructField(f"{n}_{d}", T.DoubleType()) for n in ("lo", "hi") for d in r], T.StructField("morton", T.LongType())])
    # schemas are given, so that empty tables and folders of a stream's batches open alike
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    links = table("links", "related_id bigint, id bigint, pos int, relationship string").select("relationship", "related_id", "id", "pos") if info.schema.relationships else None
    return AnnotationSet(info.schema, table("annotations", rows), info, links, table("cells", _cells_schema(info.schema.rank)))


def _cells_schema(rank: int) -> str:
    return ", ".join(f"c{d} bigint" for d in range(rank)) + ", morton bigint, id bigint, level int"


def is_native(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/annotations")


def open_set(spark: SparkSession, path: str) -> AnnotationSet:
    """Open a set of either layout."""
    from . import interchange

    return read(spark, path) if is_native(spark, path) else interchange.read(spark, path)


def pruned(df: DataFrame) -> str:
    """The formatted plan, for checks of pushed filters."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
