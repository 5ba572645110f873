"""Incremental ingest: a stream of rows appended to a native set, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamgrid.functions import morton
from loamgrid.functions.grid import Grid
from loamgrid.operators.annotation_set import AnnotationSet
from loamgrid.plans.metadata import Info
from loamgrid.session import exists, write_text


def ingest(stream: DataFrame, make: Callable[[DataFrame], AnnotationSet], info: Info, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every batch of ``stream`` to the set at ``path``.

    ``make`` turns a batch into an annotation set of ``info``'s schema. The grid is fixed by ``info``
    from the start; annotations outside it stay queryable by box, id and relationship. Every batch
    writes its own ``batch=<n>`` folders anew, so a batch that is run again after a failure replaces
    what it left."""
    schema, r = info.schema, range(info.schema.rank)

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        data = make(batch)
        if data.schema != schema:
            raise ValueError("the batch is of another schema")
        rows = AnnotationSet(schema, data.table, info)
        last = Grid(tuple(info.lower_bound), info.levels[-1].chunk_size, info.levels[-1].grid_shape)
        cell = [F.least(F.greatest(last.index(F.col(f"lo_{d}"), d), F.lit(0)), F.lit(last.shape[d] - 1)).cast("bigint") for d in r]
        out = rows.with_bounds().withColumn("morton", morton.encode(cell, last.shape))
        out.sortWithinPartitions("morton").write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{path}/annotations/batch={number}")
        for name in schema.relationships:
            own = rows.links().where(F.col("relationship") == name).drop("relationship")
            own.sortWithinPartitions("related_id").write.mode("overwrite").parquet(f"{path}/links/relationship={name}/batch={number}")
        for i, level in enumerate(info.levels):
            rows.cells(level.key).sortWithinPartitions("morton").write.mode("overwrite").parquet(f"{path}/cells/level={i}/batch={number}")
        if not exists(spark, f"{path}/info"):
            write_text(spark, f"{path}/info", info.dumps())

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
