import json
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators.annotation_set import AnnotationSet
from loamgrid.operators.api import Reader, Writer
from loamgrid.operators.builder import auto_id, build, check_ids
from loamgrid.plans.metadata import Info, Level, load_schemas, validate_json
from loamgrid.plans.schema import PROPERTY_TYPES, AnnotationSchema, CoordinateSpace, PropertySpec
from loamgrid.sources import codec, interchange, store
from loamgrid.streaming.ingest import ingest

KINDS = ("point", "line", "axis_aligned_bounding_box", "ellipsoid")
VALUES = {"uint8": 250, "uint16": 65_000, "uint32": 4_000_000_000, "int8": -100, "int16": -30_000, "int32": -2_000_000_000, "float32": 0.5, "rgb": [1, 2, 255], "rgba": [0, 9, 8, 255]}


def small(spark, kind="point", n=30, seed=1):
    rnd = random.Random(seed)
    props = tuple(PropertySpec(f"p_{t}", t) for t in PROPERTY_TYPES)
    w = Writer(spark, kind, relationships=("a", "b"), properties=props, chunk_size=10)
    add = {"point": w.add_point, "line": w.add_line, "axis_aligned_bounding_box": w.add_axis_aligned_bounding_box, "ellipsoid": w.add_ellipsoid}[kind]
    for i in range(n):
        vectors = [[rnd.randint(0, 40) for _ in range(3)] for _ in range(1 if kind == "point" else 2)]
        links = {"a": [None, 5, [5, 6, 7]][i % 3], "b": None if i % 2 else [i]}
        add(*vectors, id=100 + i, **{p.id: VALUES[p.type] for p in props}, **links)
    return w.build()


def same(a, b, key="id"):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda d: sorted((tuple(r) for r in d.select(*columns).collect()), key=repr)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("kind", KINDS)
def test_codec_round_trip(spark, kind):
    data = small(spark, kind)
    schema = AnnotationSchema(kind, data.schema.space, tuple(data.schema.stored_properties()), data.schema.relationships)
    same(data.scan().select(*schema.columns()), codec.decode_by_id(codec.encode_by_id(data.scan(), schema), schema))
    grouped = codec.encode_groups(data.scan().withColumn("g", F.col("id") % 4), schema, "g")
    same(data.scan(with_relationships=False), codec.decode_groups(grouped, schema).drop("key"))


def test_record_sizes(spark):
    schema = AnnotationSchema("point", properties=(PropertySpec("f", "float32"), PropertySpec("u", "uint8")), relationships=("r",))
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0.5, 7, [8, 9])], schema.struct_type())
    assert codec.RecordLayout(schema).size == 20
    assert len(codec.encode_by_id(df, schema).first().value) == 40
    two = df.unionAll(df.withColumn("id", F.lit(2).cast("bigint")))
    assert len(codec.encode_groups(two.withColumn("k", F.lit(0)), schema, "k").first().value) == 64


@pytest.mark.parametrize("sharded", [False, True])
@pytest.mark.parametrize("kind", ["point", "axis_aligned_bounding_box"])
def test_interchange_round_trip(spark, tmp_path, kind, sharded):
    data = small(spark, kind, n=40)
    path = str(tmp_path / "set")
    info = interchange.write(data, path, sharded)
    assert (info.by_id_sharding is not None) == sharded
    back = interchange.read(spark, path)
    same(data.scan(), back.scan().select(*data.scan().columns))
    cells = ["c0", "c1", "c2", "morton", "id"]
    same(data.cells(0).select(*cells), back.cells(0).select(*cells))
    linked = interchange.read_relationship(spark, path, info, "a")
    assert sorted((r.related_id, r.id) for r in linked.collect()) == sorted((r.related_id, r.id) for r in data.links().where("relationship = 'a'").collect())
    validate_json(json.loads((tmp_path / "set" / "info").read_text()), "annotation")
    # lookups give what the set in memory gives
    same(data.by_ids([105, 101, 105, 7], "skip"), back.by_ids([105, 101, 105, 7], "skip"))
    assert back.get(139).id == 139 and set(back.by_id(7).columns) == set(data.by_id(7).columns) and back.by_id(7).count() == 0
    for full in (False, True):
        same(data.by_relationship("a", 6, full), back.by_relationship("a", 6, full))
        assert back.by_relationship("a", 999, full).count() == 0
        same(data.in_cell(0, (1, 2, 1), full), back.in_cell(0, (1, 2, 1), full))
        for box in (([5, 5, 5], [19, 9, 39]), ([-9, 41, 0], [-5, 90, 1])):
            same(data.in_bounds(*box, with_relationships=full), back.in_bounds(*box, with_relationships=full))
            same(data.in_bounds(*box, dedupe=False, with_relationships=full), back.in_bounds(*box, dedupe=False, with_relationships=full))
    assert [r.id for r in back.in_bounds([0] * 3, [40] * 3, limit=7, with_relationships=True).collect()] == list(range(100, 107))
    fine = [data.with_levels([3.0]), back.with_levels([3.0])]  # levels that were not written
    same(*[x.in_cell(0, (1, 2, 1)) for x in fine])
    same(*[x.in_bounds([5, 5, 5], [19, 9, 39]) for x in fine])


@pytest.mark.parametrize("sharded", [False, True])
def test_interchange_lookups_read_their_files_alone(spark, tmp_path, sharded, monkeypatch):
    data = small(spark, "axis_aligned_bounding_box", n=60)
    # small shards, so that there are several
    many = interchange.ShardSpec(0, "murmurhash3_x86_128", 1, 3)
    monkeypatch.setattr(interchange, "choose_spec", lambda n, size: many)
    path = tmp_path / "set"
    info = interchange.write(data, str(path), sharded)
    back = interchange.read(spark, str(path))

    def spoil(folder, *keys):
        """Leave the files of the keys alone and make all others unreadable."""
        spec = many if sharded else None
        kept = {interchange.shard_name(int(s), spec) for s in interchange.shard_and_minishard(np.array(keys), spec)[0]} if sharded else {str(k) for k in keys}
        others = [f for f in (path / folder).iterdir() if not f.name.startswith(".") and f.name not in kept]
        assert others
        for f in others:
            f.write_bytes(b"broken")

    spoil("by_id", 110, 111)
    same(data.by_ids([111, 110]), back.by_ids([111, 110]))
    spoil("rel_b", 104)
    same(data.by_relationship("b", 104), back.by_relationship("b", 104))
    if sharded:
        cell = interchange.morton.encode_cell((1, 1, 1), info.levels[0].grid_shape)
        spoil(info.levels[0].key, cell)
    else:
        spoil(info.levels[0].key, "1_1_1")
    same(data.in_cell(0, (1, 1, 1)), back.in_cell(0, (1, 1, 1)))
    same(data.in_bounds([12] * 3, [18] * 3), back.in_bounds([12] * 3, [18] * 3))


def test_shard_file_layout():
    from loamgrid.functions.sharding import ShardSpec

    for coding in ("raw", "gzip"):
        spec = ShardSpec(0, "identity", 2, 0, coding, coding)
        entries = [(0, 4, b"four"), (0, 8, b""), (3, 7, b"x" * 99)]
        assert sorted(interchange.parse_shard(interchange.build_shard(entries, spec), spec)) == sorted((k, v) for _, k, v in entries)


def test_plain_scan_deals_files_to_few_tasks(spark, tmp_path):
    """The tasks of a scan are a number per core, whatever the number of files; the driver lists none."""
    data = small(spark, n=90)
    interchange.write(data, str(tmp_path / "set"), sharded=False)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304")
    try:
        rows = interchange.read(spark, str(tmp_path / "set")).scan()
        assert rows.rdd.getNumPartitions() <= interchange.DEAL * spark.sparkContext.defaultParallelism < 90
        assert not rows.inputFiles()
        same(data.scan(), rows.select(*data.scan().columns))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("sharded", [False, True])
def test_interchange_write_derives_the_set_once(spark, tmp_path, sharded):
    from dataclasses import replace

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    data = small(spark, n=50)
    data.bounds()  # kept in the set
    interchange.write(replace(data, table=data.table.mapInArrow(count, data.table.schema)), str(tmp_path / "set"), sharded)
    assert seen.value == 50
    assert not list((tmp_path / "set").glob("rows-*"))


def test_shard_is_written_and_read_in_pieces():
    import io
    import tracemalloc

    class Sink(io.RawIOBase):
        size = 0

        def write(self, data):
            self.size += len(data)
            return len(data)

    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            self.most = max(self.most, n)
            return super().read(n)

    spec = interchange.ShardSpec(0, "identity", 1, 0, "gzip", "raw")
    sink = Sink()
    tracemalloc.start()
    shard = interchange.ShardBuilder(spec, sink)
    for i in range(200):
        shard.add(i // 100, 2 * (i % 100) + i // 100, bytes(1 << 20))
    shard.finish()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sink.size > 200 << 20 and peak < 16 << 20
    entries = [(i % 2, i, bytes([i % 250]) * (3 << 20)) for m in (0, 1) for i in range(m, 14, 2)]
    file = Counted(interchange.build_shard(entries, spec))
    pieces = list(interchange._pieces(file, spec, None))
    assert sorted((k, v) for p in pieces for k, v in interchange._values(file, p, spec)) == sorted((str(k), v) for _, k, v in entries)
    assert len(pieces) > 2 and file.most <= interchange.PIECE_BYTES + (3 << 20)
    file.most = 0
    assert [(k, len(v)) for p in interchange._pieces(file, spec, {6, 400}) for k, v in interchange._values(file, p, spec)] == [("6", 3 << 20)]
    assert file.most == 3 << 20


def test_files_that_spark_alone_can_open(spark, tmp_path, monkeypatch):
    data = small(spark, n=20)
    monkeypatch.setattr(interchange, "_known", lambda spark, folder: False)
    for sharded in (False, True):
        path = str(tmp_path / f"set{sharded}")
        interchange.write(data, path, sharded)
        back = interchange.read(spark, path)
        same(data.scan(), back.scan().select(*data.scan().columns))
        same(data.by_ids([105, 101, 7], "skip"), back.by_ids([105, 101, 7], "skip"))


def test_native_store(spark, tmp_path):
    data = small(spark, "axis_aligned_bounding_box", n=200)
    path = str(tmp_path / "native")
    store.write(data, path)
    back = store.open_set(spark, path)
    same(data.scan(), back.scan())
    for box in (([5, 5, 5], [9, 9, 9]), ([0, 0, 0], [40, 40, 40])):
        for exact in (False, True):
            same(data.in_bounds(*box, exact=exact).select("id"), back.in_bounds(*box, exact=exact).select("id"))
        same(data.with_levels([10.0]).candidates(0, *box).select("id", "c0", "c1", "c2"), back.candidates(0, *box).select("id", "c0", "c1", "c2"))
    same(data.by_relationship("a", 6, True), back.by_relationship("a", 6, True))
    plan = store.pruned(back.in_bounds([5, 5, 5], [9, 9, 9]))
    assert "GreaterThanOrEqual(hi_0,5.0)" in plan and "LessThanOrEqual(lo_2,9.0)" in plan and "Exchange" not in plan
    assert "EqualTo(id,100)" in store.pruned(back.by_id(100))
    assert "EqualTo(related_id,6)" in store.pruned(back.by_relationship("a", 6))


def test_bounds_equal_full_scan(spark):
    rnd = random.Random(3)
    for kind in KINDS:
        data = small(spark, kind, n=150, seed=9).with_levels([7.0, 20.0])
        for _ in range(2):
            low = [rnd.randint(0, 30) for _ in range(3)]
            box = (low, [x + rnd.randint(0, 15) for x in low])
            once = data.in_bounds(*box).select("id")
            same(once, data.in_bounds(*box, dedupe=False).select("id").distinct())
            truth = {r.id for r in data.in_bounds(*box, exact=True).select("id").collect()}
            assert {r.id for r in once.collect()} <= truth or kind == "ellipsoid"
        same(data.cells(0).select("id").distinct(), data.ids())


def test_duplicates_and_limit(spark):
    w = Writer(spark, "point", chunk_size=10)
    w.add_point((10, 0, 0))
    w.add_point((25, 0, 0))
    w.add_point((0, 0, 0))
    data = w.build()
    hits = data.in_bounds([9, 0, 0], [10, 0, 0], dedupe=False)
    assert [r.id for r in hits.collect()] == [0, 0]
    assert data.in_bounds([9, 0, 0], [10, 0, 0]).count() == 1
    # the limit counts hits, not candidates
    assert data.in_bounds([20, 0, 0], [30, 0, 0], limit=1).count() == 1
    assert data.in_cell("spatial0", (0, 0, 0)).count() == 2
    with pytest.raises(ValueError):
        data.in_cell("spatial0", (0, 0))
    with pytest.raises(ValueError):
        data.in_cell("nowhere", (0, 0, 0))


def test_lookups(spark):
    data = small(spark)
    assert [r.id for r in data.by_ids([105, 101, 105]).collect()] == [105, 101, 105]
    with pytest.raises(Exception, match="no annotation of id 7"):
        data.by_ids([101, 7]).collect()
    assert [r.id for r in data.by_ids([101, 7], "skip").collect()] == [101]
    assert [r.pos for r in data.by_ids([101, 7], "null").collect()] == [0, 1]
    pairs = spark.createDataFrame([(0, 103), (1, 102)], "pos int, id bigint")
    assert [r.id for r in data.by_ids(pairs).collect()] == [103, 102]
    assert {r.id for r in data.id_range(110, 113).collect()} == {110, 111, 112}
    assert [r.id for r in data.iterate(110, 113)] == [110, 111, 112]
    with pytest.raises(ValueError):
        data.scan(max_annotations=5)
    with pytest.raises(ValueError):
        data.by_relationship("c", 1)
    assert data.by_relationship("a", 999).count() == 0
    assert data.by_relationship("a", 999).columns == data.by_relationship("a", 5).columns
    with pytest.raises(KeyError):
        data.get(1)


def test_reader_names(spark, tmp_path):
    kind = PropertySpec("kind", "uint8", None, (0, 1), ("no", "yes"))
    share = PropertySpec("share", "float32", None, (0.1,), ("tenth",))
    w = Writer(spark, "LINE", names=("u", "v"), units="um", relationships=("seg",), properties=(share, kind), chunk_size=(4, 4))
    w.add_line((1, 1), (2, 9), kind=1, share=0.1, seg=7)
    w.add_line((3, 3), (8, 2), kind=9, seg=[7, 8])
    with pytest.raises(ValueError):
        w.add_point((1, 1))
    with pytest.raises(ValueError):
        w.add_line((1, 1), (2, 2), colour=3)
    with pytest.raises(ValueError):
        w.add_line((1, 1, 1), (2, 2, 2))
    assert w.get_chunk_index((9, -1)) == (2, -1)
    w.write(str(tmp_path / "s"), write_sharded=False)
    r = Reader.open(spark, str(tmp_path / "s"))
    assert r.get_relationships() == ["seg"] and r.get_relationship_keys() == ["rel_seg"]
    assert r.get_property_names() == ["share", "kind"] and r.get_annotation_type() == "line" and r.get_dimensions() == {"u": [1.0, "um"], "v": [1.0, "um"]}
    one = r.get_by_id(0)
    assert one["kind"] == "yes" and one["share"] == "tenth" and one["seg"] == [7] and one["point_b"] == [2.0, 9.0]
    with pytest.raises(Exception, match="no label"):
        r.get_by_id(1)
    assert [x.kind for x in r.get_by_ids([1, 0]).collect()] == ["9", "yes"]
    assert r.get_by_relationship(seg=8).count() == 1 and r.get_by_relationship("seg", 7, get_relationships=True).count() == 2
    assert "seg" not in r.get_by_relationship("seg", 7).columns
    assert r.get_all_annotation_ids().count() == 2 and r.get_all_annotations().count() == 2
    assert [x["id"] for x in r.iter_all_ann(chunk_size=1, max_key=5)] == [0, 1]
    assert r.get_by_bounding_box([0, 0], [2, 2]).count() == 1
    assert r.read_annotations_in_chunk("spatial0", (0, 0)).count() == 2
    assert r.query_spatial_index_in_bounds("spatial0", [0, 0], [9, 9]).count() >= 2
    assert r.info["annotation_type"] == "line" and r.lower_bound == [1.0, 1.0]
    assert not any("padding" in c for c in r.get_all_annotations().columns)


def test_builder(spark):
    schema = AnnotationSchema("point", CoordinateSpace.of(["x"]), (PropertySpec("p", "int16"), PropertySpec("c", "rgb")), ("r",))
    df = spark.createDataFrame([(3.3, 5), (1.1, None)], "v double, r bigint")
    data = build(df, schema, {"point": ["v"]}, order=["v"])
    rows = {r.id: r for r in data.scan().collect()}
    assert rows[0].r == [] and rows[1].r == [5] and rows[0].p == 0 and rows[0].c == [0, 0, 0]
    assert data.bounds()[1] == [pytest.approx(3.3, abs=1e-6)] and data.bounds()[1] != [3.3]  # floats before bounds
    for bad in ({"point_a": ["v"]}, {"point": ["v", "v"]}):
        with pytest.raises(ValueError):
            build(df, schema, bad, order=["v"])
    with pytest.raises(ValueError):
        build(df, schema, {"point": ["v"]})
    with pytest.raises(ValueError):
        check_ids(data.table.unionAll(data.table))
    numbered = auto_id(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"]).collect()
    assert all(r.id == r.k for r in numbered) and len(numbered) == 1000
    with pytest.raises(ValueError):
        CoordinateSpace.of(["x", "y"], [1.0])
    with pytest.raises(ValueError):
        PropertySpec("p", "uint64")
    with pytest.raises(ValueError):
        AnnotationSchema("circle")


def test_empty_set(spark, tmp_path):
    data = Writer(spark, "point", relationships=("r",)).build()
    assert data.bounds() == ([0.0] * 3, [0.0] * 3) and data.levels()[0].grid_shape == (1, 1, 1)
    store.write(data, str(tmp_path / "e"))
    info = json.loads((tmp_path / "e" / "info").read_text())
    assert info["spatial"][0]["limit"] == 1
    back = store.read(spark, str(tmp_path / "e"))
    assert back.in_bounds([0, 0, 0], [1, 1, 1]).columns == ["id", "point"]


def test_metadata_kinds():
    assert set(load_schemas()) == {"annotation", "sharding", "volume", "segment_properties", "skeleton", "multiresolution_mesh", "legacy_mesh", "legacy_mesh_manifest"}
    validate_json({"fragments": ["a"]}, "SomeLegacyMeshManifest")
    scale = {"key": "8", "size": [1, 2, 3], "chunk_sizes": [[64, 64, 64]], "resolution": [8, 8, 8], "encoding": "raw"}
    volume = {"type": "image", "data_type": "uint8", "num_channels": 1, "scales": [scale]}
    validate_json(volume, "volume")
    for bad in (volume | {"scales": []}, volume | {"data_type": "x"}, volume | {"scales": [scale | {"size": [1, 2]}]}, volume | {"num_channels": True}):
        with pytest.raises(ValueError):
            validate_json(bad, "volume")
    with pytest.raises(ValueError):
        validate_json({}, "nothing")
    good = Info(AnnotationSchema("point"), (0.0,) * 3, (1.0,) * 3, (Level("s", (1.0,) * 3, (1, 1, 1)),)).to_json()
    validate_json(good, "annotation")
    assert Info.from_json(json.loads(json.dumps(good))).to_json() == good
    assert Info.from_json(good | {"annotation_type": "POINT"}).schema.annotation_type == "point"
    level = {k: v for k, v in good["spatial"][0].items() if k != "grid_shape"}
    for bad in ({"dimensions": {"x": [1]}}, {"lower_bound": [0.0]}, {"spatial": [level]}, {"spatial": [good["spatial"][0] | {"chunk_shape": [1, 1, 1]}]}, {"properties": [{"id": "a", "type": "uint64"}]}, {"annotation_type": "circle"}):
        with pytest.raises(ValueError):
            validate_json(good | bad, "annotation")


def test_stream_ingest(spark, tmp_path):
    schema = AnnotationSchema("point", CoordinateSpace.of(["x", "y"]), relationships=("r",))
    info = Info(schema, (0.0, 0.0), (100.0, 100.0), (Level("spatial0", (10.0, 10.0), (10, 10)),))
    make = lambda df: build(df, schema, {"point": ["x", "y"]}, "k", values={"r": F.col("k") % 3})
    source = tmp_path / "in"
    for n in range(2):
        spark.range(50 * n, 50 * n + 50).selectExpr("id as k", "cast(id as double) as x", "cast(id as double) as y").coalesce(1).write.mode("append").parquet(str(source))
        query = ingest(spark.readStream.schema("k bigint, x double, y double").parquet(str(source)), make, info, str(tmp_path / "set"), str(tmp_path / "check"))
        query.awaitTermination(120)
    data = store.read(spark, str(tmp_path / "set"))
    assert data.ids().count() == 100
    assert {r.id for r in data.in_bounds([40, 40], [60, 60]).collect()} == set(range(40, 61))
    assert data.by_relationship("r", 1).count() == 33
    assert {r.id for r in data.in_cell(0, (0, 0)).collect()} == set(range(0, 11))


def test_sql_views(spark):
    data = small(spark)
    data.register("shapes")
    assert spark.sql("select count(*) from shapes_links l join shapes s on l.id = s.id where related_id = 5").first()[0] == data.by_relationship("a", 5).count()
    assert isinstance(data, AnnotationSet)


def test_large_ids_and_iteration(spark):
    w = Writer(spark, "point", relationships=("r",))
    for k in (3, 5_000_000_000, (1 << 63) - 1):
        w.add_point((1, 2, 3), id=k, r=np.int64(k))
    r = Reader(w.build())
    assert [x["id"] for x in r.iter_all_ann()] == [3, 5_000_000_000, (1 << 63) - 1]
    assert [x["id"] for x in r.iter_all_ann(chunk_size=1, max_key=6_000_000_000)] == [3, 5_000_000_000]
    assert r.data.id_range().count() == 3 and r.get_by_id(5_000_000_000)["r"] == [5_000_000_000]
    layout = codec.RecordLayout(r.data.schema)
    with pytest.raises(ValueError):
        layout.decode_ids(layout.encode_multi(bytes(layout.size), np.array([1 << 63], np.uint64)))


def test_truncation_warns(spark):
    r = Reader(small(spark))
    with pytest.warns(UserWarning, match="more than 4 "):
        assert r.get_annotations_in_bounds([0, 0, 0], [40, 40, 40], max_annotations=4).count() == 4
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert r.get_annotations_in_bounds([0, 0, 0], [40, 40, 40], max_annotations=30).count() == 30


def test_reserved_names():
    for name in ("lo_0", "hi_2", "c1", "pos", "morton", "_found"):
        with pytest.raises(ValueError, match="reserved"):
            AnnotationSchema("point", properties=(PropertySpec(name, "uint8"),))
    AnnotationSchema("point", properties=(PropertySpec("lo_3", "uint8"), PropertySpec("level", "uint8")))
