"""The packed interchange layout: one store by id, one per relationship, one per spatial level.

A plain store has a file per key, named by the decimal id or by the cell's indices joined with
``_``. A sharded store has files of many keys: a head of 16 bytes per minishard with the range of its
index, the values, and the minishard indexes (keys and offsets as differences, then sizes; all ranges
count from the end of the head). Writing goes through the file systems that pyarrow knows. Reading does
as well: a folder is listed in a task, its files (of shards: pieces of them) are dealt and read there, so
that neither the driver nor a task holds a whole store or shard. What pyarrow doesn't know is listed and
read by Spark, so any file system serves for reading.

Lookups name the files that hold their keys and read no other: one per key of a plain store, one
shard per key of a sharded one, of which only the minishards and values asked for are read.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import itertools
import json
import math
import os
import shutil
import struct
import tempfile
import uuid
from array import array
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import geometry, morton
from loamgrid.functions.sharding import ShardSpec, choose_spec, shard_and_minishard, shard_column
from loamgrid.operators.annotation_set import ID_LIST, AnnotationSet
from loamgrid.operators.builder import check_ids
from loamgrid.plans.metadata import Info, Level
from loamgrid.session import delete, exists, make_folder, read_text, ship, write_text

from . import codec
from .store import full_info

#: Bytes of values that are read, or handed on, at once; a single value may be longer.
PIECE_BYTES = 8 << 20
#: Values that are handed on at once, and names of files.
PIECE_ROWS = 4096
#: Level of gzip for values: on groups of boxes 9 took six times as long (2.2 for 13.9 MB a second) for 1.7 % less.
VALUE_LEVEL = 6
#: Tasks per core that the files of a store are dealt to.
DEAL = 4


# -- shard files -----------------------------------------------------------------------------------
class ShardBuilder:
    """A shard file as its entries come, sorted by minishard and key: the values go to ``body`` at once,
    only keys and sizes are held."""

    def __init__(self, spec: ShardSpec, body: BinaryIO):
        self.spec, self.body, self.at, self.minishard = spec, body, 0, None
        self.indexes: dict[int, bytes] = {}

    def add(self, minishard: int, key: int, value: bytes) -> None:
        """Append an entry, its value encoded as the parameters say."""
        if minishard != self.minishard:
            self._close()
            self.minishard, self.start, self.keys, self.sizes = minishard, self.at, array("Q"), array("Q")
        self.keys.append(key)
        self.sizes.append(len(value))
        self.body.write(value)
        self.at += len(value)

    def _close(self) -> None:
        if self.minishard is None:
            return
        keys, sizes = np.array(self.keys, np.uint64), np.array(self.sizes, np.uint64)
        gaps = np.zeros(len(keys), np.uint64)
        gaps[0] = self.start  # values follow each other without gaps
        index = np.stack([np.diff(keys, prepend=np.uint64(0)), gaps, sizes]).astype("<u8").tobytes()
        self.indexes[self.minishard] = gzip.compress(index, mtime=0) if self.spec.minishard_index_encoding == "gzip" else index

    def finish(self) -> bytes:
        """Append the indexes; returns the head, which stands before the body."""
        self._close()
        head = []
        for m in range(1 << self.spec.minishard_bits):
            index = self.indexes.get(m, b"")
            self.body.write(index)
            head.append(struct.pack("<QQ", self.at, self.at + len(index)))
            self.at += len(index)
        return b"".join(head)


def _encoder(spec: ShardSpec) -> Callable[[bytes], bytes]:
    return (lambda value: gzip.compress(value, VALUE_LEVEL, mtime=0)) if spec.data_encoding == "gzip" else bytes


def build_shard(entries: list[tuple[int, int, bytes]], spec: ShardSpec) -> bytes:
    """File of ``(minishard, key, value)`` entries, sorted by both."""
    body, encode = io.BytesIO(), _encoder(spec)
    shard = ShardBuilder(spec, body)
    for minishard, key, value in entries:
        shard.add(minishard, key, encode(value))
    return shard.finish() + body.getvalue()


def _minishards(wanted: Collection[int] | None, spec: ShardSpec) -> Sequence[int]:
    return range(1 << spec.minishard_bits) if wanted is None else sorted(set(shard_and_minishard(np.array(list(wanted), np.int64), spec)[1].tolist()))


def _parse_index(index: bytes, spec: ShardSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and sizes of a minishard's entries; starts count from the end of the head."""
    index = gzip.decompress(index) if spec.minishard_index_encoding == "gzip" else index
    keys, gaps, sizes = np.frombuffer(index, "<u8").reshape(3, -1)
    starts = np.cumsum(gaps, dtype=np.uint64) + np.concatenate([[np.uint64(0)], np.cumsum(sizes, dtype=np.uint64)[:-1]])
    return np.cumsum(keys, dtype=np.uint64), starts, sizes


def parse_shard(data: bytes, spec: ShardSpec, wanted: Collection[int] | None = None) -> Iterator[tuple[int, bytes]]:
    """``(key, value)`` of every entry of a shard file, or of the ``wanted`` keys in it."""
    base = 16 << spec.minishard_bits
    for m in _minishards(wanted, spec):
        a, b = struct.unpack_from("<QQ", data, 16 * m)
        if a == b:
            continue
        for key, start, size in zip(*(x.tolist() for x in _parse_index(data[base + a : base + b], spec))):
            if wanted is not None and key not in wanted:
                continue
            value = data[base + start : base + start + size]
            yield key, gzip.decompress(value) if spec.data_encoding == "gzip" else value


def shard_name(shard: int, spec: ShardSpec) -> str:
    return f"{shard:0{max(1, -(-spec.shard_bits // 4))}x}.shard" if spec.shard_bits else "0.shard"


# -- stores ----------------------------------------------------------------------------------------
def _write_store(values: DataFrame, folder: str, spec: ShardSpec | None) -> int:
    """Write ``key, value`` (key: string; of sharded stores a number) into files; returns their number."""
    make_folder(values.sparkSession, folder)

    def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        # a task that is run again or twice leaves whole files only
        own = f"{base}/.{uuid.uuid4().hex}"
        files.create_dir(own, recursive=True)
        n = 0

        def put(name: str, head: bytes, body: BinaryIO | None = None) -> None:
            nonlocal n
            with files.open_output_stream(f"{own}/file", compression=None) as out:
                out.write(head)
                if body is not None:
                    body.seek(0)
                    shutil.copyfileobj(body, out, 1 << 20)
            files.move(f"{own}/file", f"{base}/{name}")
            n += 1

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        if spec is None:
            for row in rows:
                put(*row)
        else:
            for number, entries in itertools.groupby(rows, lambda row: row[0]):
                with tempfile.TemporaryFile() as body:
                    shard = ShardBuilder(spec, body)
                    for _, *entry in entries:
                        shard.add(*entry)
                    put(shard_name(number, spec), shard.finish(), body)
        files.delete_dir(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(spec)
        for batch in batches:
            shard, minishard = shard_and_minishard(batch.column(0).to_numpy(), spec)
            coded = pa.array([encode(v) for v in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(minishard), batch.column(0), coded], ["shard", "minishard", "key", "value"])

    if spec is None:
        rows = values.select("key", "value")
    else:
        # values are encoded where they are; the task that makes a shard only puts them in a row
        rows = values.select(F.col("key").cast("bigint").alias("key"), "value").mapInArrow(place, "shard bigint, minishard bigint, key bigint, value binary")
        rows = rows.repartition("shard").sortWithinPartitions("shard", "minishard", "key")
    return rows.mapInArrow(files_of, "n bigint").agg(F.sum("n")).first()[0] or 0


def _known(spark: SparkSession, folder: str) -> bool:
    """Whether pyarrow knows the file system of a folder."""
    from pyarrow import fs

    if ":" not in folder and not (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        return False
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError):
        return False
    return True


def _names(spark: SparkSession, sharding: dict | None, keys: Sequence[int | str]) -> list[str]:
    """The names of the files of a store that may hold the keys."""
    if sharding is None:
        return sorted({str(k) for k in keys})
    spec = ShardSpec.from_json(sharding)
    return sorted({shard_name(s, spec) for s in shard_and_minishard(np.array(keys, np.int64), spec)[0].tolist()})


def _batches(pairs: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """``key, value`` in batches of bounded size."""
    keys, values, size = [], [], 0
    for key, value in pairs:
        keys.append(key)
        values.append(value)
        size += len(value)
        if size > PIECE_BYTES or len(keys) >= PIECE_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], ["key", "value"])
            keys, values, size = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], ["key", "value"])


def _list(folder: str, suffix: str) -> Iterator[str]:
    """The names of a folder's files, hidden ones left out."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(base) as found:
            yield from (x.name for x in found if x.name[0] not in "._" and x.name.endswith(suffix) and x.is_file())
    else:
        yield from (x.base_name for x in files.get_file_info(fs.FileSelector(base)) if x.base_name[0] not in "._" and x.base_name.endswith(suffix) and x.type == fs.FileType.File)


def _pieces(file: BinaryIO, spec: ShardSpec, wanted: Collection[int] | None) -> Iterator[np.ndarray]:
    """Keys, starts (from that of the file) and sizes of a shard's entries, or of the ``wanted``, some at a time."""
    base = 16 << spec.minishard_bits
    file.seek(0)
    head = np.frombuffer(file.read(base), "<u8").reshape(-1, 2)
    for m in _minishards(wanted, spec):
        a, b = head[m].tolist()
        if a == b:
            continue
        file.seek(base + a)
        keys, starts, sizes = _parse_index(file.read(b - a), spec)
        found = np.stack([keys, starts + np.uint64(base), sizes]).astype("<u8")
        if wanted is not None:
            found = found[:, np.isin(keys, np.array(list(wanted), np.int64).astype(np.uint64))]
        part = np.cumsum(found[2]) // np.uint64(PIECE_BYTES)
        part = np.flatnonzero((part[1:] != part[:-1]) | (np.arange(1, len(part)) % PIECE_ROWS == 0)) + 1
        yield from (x for x in np.split(found, part, axis=1) if x.shape[1])


def _values(file: BinaryIO, piece: np.ndarray, spec: ShardSpec) -> Iterator[tuple[str, bytes]]:
    """Keys and values of the entries of a piece."""
    decode = gzip.decompress if spec.data_encoding == "gzip" else bytes
    starts, ends = piece[1], piece[1] + piece[2]
    low, high = int(starts.min()), int(ends.max())
    block = None
    if high - low <= 2 * int(piece[2].sum()):  # near each other: read at once
        file.seek(low)
        block = file.read(high - low)
    for key, start, end in zip(piece[0].tolist(), starts.tolist(), ends.tolist()):
        if block is None:
            file.seek(start)
        yield str(key), decode(file.read(end - start) if block is None else block[start - low : end - low])


def _read_store(spark: SparkSession, folder: str, sharding: dict | None, keys: Sequence[int | str] | None = None) -> DataFrame:
    """``key, value`` of a store or of some of its keys (a short list); keys as text."""
    names = None if keys is None else _names(spark, sharding, keys)
    if names == []:
        return spark.createDataFrame([], "key string, value binary")
    spec, wanted = None if sharding is None else ShardSpec.from_json(sharding), None if keys is None else frozenset(keys)
    if not _known(spark, folder):
        return _read_by_spark(spark, folder, spec, names, wanted)
    suffix = ".shard" if spec else ""

    def list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _list(folder, suffix) if names is None else (names[i] for i in batch.column(0).to_pylist())
            while own := list(itertools.islice(found, PIECE_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["name"])

    def opened(name: str):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        try:
            return files.open_input_file(f"{base}/{name}")
        except FileNotFoundError:
            if names is None:
                raise
            return contextlib.nullcontext()  # no key of the list is there

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    for piece in _pieces(file, spec, wanted) if file else ():
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(piece[1, 0])], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["name", "start", "piece"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            if spec is None:
                for name in batch.column(0).to_pylist():
                    with opened(name) as file:
                        if file:
                            yield name, file.read()
                continue
            for name, same in itertools.groupby(zip(batch.column(0).to_pylist(), batch.column(2)), lambda row: row[0]):
                with opened(name) as file:
                    for _, piece in same:
                        yield from _values(file, np.frombuffer(piece.as_py(), "<u8").reshape(3, -1), spec)

    many = DEAL * spark.sparkContext.defaultParallelism
    count = 1 if names is None else len(names)
    files = spark.range(0, count, 1, min(count, many)).mapInArrow(list_files, "name string")
    if spec:
        files = files.repartition(many, "name") if names is None else files
        files = files.mapInArrow(cut, "name string, start bigint, piece binary")
    if names is None:
        files = files.repartition(many, *files.columns[:2])
        files = files.sortWithinPartitions("name", "start") if spec else files
    return files.mapInArrow(lambda batches: _batches(entries(batches)), "key string, value binary")


def _read_by_spark(spark: SparkSession, folder: str, spec: ShardSpec | None, names: list[str] | None, wanted: Collection[int] | None) -> DataFrame:
    """The same where Spark alone can list and open files; shards are read as a whole."""
    files = spark.read.format("binaryFile")
    if names is not None:
        paths = [f for f in (f"{folder}/{n}" for n in names) if exists(spark, f)]
        if not paths:
            return spark.createDataFrame([], "key string, value binary")
        files = files.load(paths)
    elif spec is None:
        files = files.load(folder)
    else:
        files = files.option("pathGlobFilter", "*.shard").load(folder)
    if spec is None:
        return files.select(F.element_at(F.split("path", "/"), -1).alias("key"), F.col("content").alias("value"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from _batches((str(k), v) for k, v in parse_shard(data.as_py(), spec, wanted))

    return files.select("content").mapInArrow(parse, "key string, value binary")


# -- sets ----------------------------------------------------------------------------------------------
def write(data: AnnotationSet, path: str, sharded: bool = True, unique_ids: bool = True) -> Info:
    """Write all stores of the set below ``path``, the metadata last.

    The annotations are derived once, into Parquet beside the stores that goes at the end."""
    spark = data.table.sparkSession
    ship(spark)
    rows = f"{path}/rows-{uuid.uuid4().hex}"
    try:
        data.table.repartition(DEAL * spark.sparkContext.defaultParallelism, "id").write.parquet(rows)
        return _write(replace(data, table=spark.read.schema(data.table.schema).parquet(rows)), path, sharded, unique_ids)
    finally:
        delete(spark, rows)


def _write(data: AnnotationSet, path: str, sharded: bool, unique_ids: bool) -> Info:
    spark = data.table.sparkSession
    if unique_ids:
        check_ids(data.table)
    base = full_info(data)
    schema = type(data.schema)(data.schema.annotation_type, data.schema.space, tuple(data.schema.stored_properties()), data.schema.relationships)
    table, size = data.scan(), codec.RecordLayout(schema).size
    count = table.count()
    spec = lambda n, size: choose_spec(n, size) if sharded and n else None
    json_of = lambda s: s.to_json() if s else None

    levels = []
    for x in base.levels:
        stats = data.cells(x.key).groupBy("morton").count().agg(F.count("*").alias("cells"), F.sum("count").alias("rows"), F.max("count").alias("most")).first()
        own = spec(stats.cells, (stats.rows or 0) * (size + 8) + 8 * stats.cells)
        names = [f"c{d}" for d in range(data.schema.rank)]
        if data.cell_table is None:
            grid, r = data.level(x.key)[1], range(data.schema.rank)
            members = grid.explode(data.with_bounds(), [F.col(f"lo_{d}") for d in r], [F.col(f"hi_{d}") for d in r])
        else:
            members = data.cells(x.key).join(table, "id")
        key = morton.encode([F.col(c) for c in names], x.grid_shape).cast("string") if own else F.concat_ws("_", *names)
        keyed = members.withColumn("_cell", key)
        _write_store(codec.encode_groups(keyed, schema, "_cell"), f"{path}/{x.key}", own)
        levels.append(Level(x.key, x.chunk_size, x.grid_shape, stats.most or 1, json_of(own)))

    by_id = spec(count, count * size)
    _write_store(codec.encode_by_id(table, schema).withColumn("key", F.col("id").cast("string")), f"{path}/by_id", by_id)

    sharding = {}
    for r in schema.relationships:
        if data.link_table is None:
            linked = table.withColumn("_related", F.explode(r))
        else:
            linked = data.links().where(F.col("relationship") == r).select(F.col("related_id").alias("_related"), "id").join(table, "id")
        own = None
        if sharded:
            stats = linked.groupBy("_related").count().agg(F.count("*").alias("objects"), F.sum("count").alias("rows")).first()
            own = spec(stats.objects, (stats.rows or 0) * (size + 8) + 8 * stats.objects)
        _write_store(codec.encode_groups(linked, schema, "_related"), f"{path}/rel_{r}", own)
        sharding[r] = json_of(own)
    info = Info(schema, base.lower_bound, base.upper_bound, tuple(levels), {r: f"rel_{r}" for r in schema.relationships}, sharding, "by_id", json_of(by_id))
    write_text(spark, f"{path}/info", info.dumps())
    return info


@dataclass
class StoredSet(AnnotationSet):
    """A set in the interchange layout: lookups by id, object and cell go to the files of their keys.

    A box is answered from the cells of every level that it needs, so it finds what the writer put
    there (ours puts an annotation into every cell that its bounding box touches). Where a lookup
    needs more than ``ID_LIST`` keys, and where other levels than the written ones are asked for, the
    stores are read as a whole."""

    path: str = ""
    written: Info | None = None

    def _by_key(self, ids: Sequence[int]) -> DataFrame:
        spark = self.table.sparkSession
        values = _read_store(spark, f"{self.path}/{self.written.by_id_key}", self.written.by_id_sharding, list(ids))
        return codec.decode_by_id(values.select(F.col("key").cast("bigint").alias("id"), "value"), self.schema)

    def _with_links(self, hits: DataFrame) -> DataFrame:
        """Whole annotations of the ids of ``hits``."""
        ids = [r.id for r in hits.select("id").limit(ID_LIST + 1).collect()]
        if len(ids) <= ID_LIST:
            return self._by_key(sorted(set(ids))).select(*self._columns())
        return self.scan().join(hits.select("id").distinct(), "id", "left_semi").select(*self._columns())

    def by_relationship(self, relationship: str, related_id: int, with_relationships: bool = False) -> DataFrame:
        self._check_relationship(relationship)
        hits = read_relationship(self.table.sparkSession, self.path, self.written, relationship, [int(related_id)]).dropDuplicates(["id"])
        return self._with_links(hits) if with_relationships else hits.select(*self._columns(False))

    def _in_cells(self, level: int | str, ranges: list[tuple[int, int]], with_relationships: bool) -> DataFrame:
        count = math.prod(b - a + 1 for a, b in ranges)
        if self.info is not self.written or count > ID_LIST:
            return super()._in_cells(level, ranges, with_relationships)
        own = self.written.levels[self.level(level)[0]]
        rank = self.schema.rank
        cells = list(itertools.product(*[range(a, b + 1) for a, b in ranges]))
        keys = ["_".join(map(str, c)) for c in cells] if own.sharding is None else [morton.encode_cell(c, own.grid_shape) for c in cells]
        rows = codec.decode_groups(_read_store(self.table.sparkSession, f"{self.path}/{own.key}", own.sharding, keys), self.schema)
        found = rows.select("*", *[c.alias(f"c{d}") for d, c in enumerate(_cell_of(own, rank))]).drop("key")
        if not with_relationships or not self.schema.relationships:
            return found.select(*self._columns(with_relationships), *[f"c{d}" for d in range(rank)])
        names = [f"c{d}" for d in range(rank)]
        return self._with_links(found).join(found.select("id", *names), "id").select(*self._columns(), *names)

    def in_bounds(self, lower: Sequence[float], upper: Sequence[float], limit: int | None = None, exact: bool = False, dedupe: bool = True, with_relationships: bool = False) -> DataFrame:
        box = geometry.check_box(lower, upper, self.schema.rank)
        needed = [math.prod(b - a + 1 for a, b in self.level(x.key)[1].query_range(*box)) for x in self.levels()]
        if not dedupe or self.info is not self.written or not needed or max(needed) > ID_LIST:
            return super().in_bounds(lower, upper, limit, exact, dedupe, with_relationships)
        hits = super().in_bounds(lower, upper, None, exact, False, False).dropDuplicates(["id"])
        hits = hits if limit is None else hits.orderBy("id").limit(limit)
        if not with_relationships or not self.schema.relationships:
            return hits
        return self._with_links(hits).orderBy("id") if limit is not None else self._with_links(hits)


def read(spark: SparkSession, path: str) -> StoredSet:
    """Open an interchange set. Scans read the store by id; lookups read the files of their keys."""
    ship(spark)
    info = Info.from_json(json.loads(read_text(spark, f"{path}/info")))
    schema = info.schema
    if info.by_id_key is None:
        raise ValueError("the set has no store by id")
    values = _read_store(spark, f"{path}/{info.by_id_key}", info.by_id_sharding)
    table = codec.decode_by_id(values.select(F.col("key").cast("bigint").alias("id"), "value"), schema)
    cells = None
    for i, x in enumerate(info.levels):
        own = read_cells(spark, path, info, x.key).select(F.lit(i).alias("level"), "*")
        cells = own if cells is None else cells.unionAll(own)
    return StoredSet(schema, table, info, None, cells, path=path, written=info)


def _cell_of(level: Level, rank: int) -> list[Column]:
    """The cell's indices from the column ``key`` of a level's store."""
    if level.sharding is None:
        part = F.split("key", "_")
        return [F.get(part, F.lit(d)).cast("bigint") for d in range(rank)]
    return morton.decode(F.col("key").cast("bigint"), level.grid_shape)


def read_cells(spark: SparkSession, path: str, info: Info, key: str) -> DataFrame:
    """``c0, c1, ..., morton, id`` of a level; records are skipped."""
    level = next(x for x in info.levels if x.key == key)
    layout = codec.RecordLayout(info.schema)
    rank = info.schema.rank

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in zip(batch.column("key").to_pylist(), batch.column("value")):
                found = layout.decode_ids(v.as_py())
                for own in np.split(found, range(codec.ROWS, len(found), codec.ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.string()), pa.array(own)], ["key", "id"])

    rows = _read_store(spark, f"{path}/{key}", level.sharding).mapInArrow(ids, "key string, id bigint")
    cell = _cell_of(level, rank)
    code = morton.encode(cell, level.grid_shape) if level.sharding is None else F.col("key").cast("bigint")
    return rows.select(*[c.alias(f"c{d}") for d, c in enumerate(cell)], code.alias("morton"), "id")


def read_relationship(spark: SparkSession, path: str, info: Info, relationship: str, objects: Sequence[int] | None = None) -> DataFrame:
    """``related_id`` and the annotations stored under it (or under some objects, a short list), without
    relationship lists."""
    if relationship not in info.schema.relationships:
        raise ValueError(f"unknown relationship {relationship!r}")
    values = _read_store(spark, f"{path}/{info.relation_keys[relationship]}", info.relation_sharding.get(relationship), objects)
    rows = codec.decode_groups(values, info.schema)
    return rows.select(F.col("key").cast("bigint").alias("related_id"), *rows.columns[1:])
