import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geometry, morton
from loamgrid.functions.grid import Grid
from loamgrid.functions.sharding import ShardSpec, choose_spec, plain_hash, shard_and_minishard, shard_column
from loamgrid.plans.schema import AnnotationSchema


def test_morton_vectors():
    assert morton.encode_cell((3, 0, 5), (5, 1, 9)) == 39
    assert morton.encode_cell((0, 0, 0), (5, 1, 9)) == 0
    assert morton.encode_cell((4, 0, 8), (5, 1, 9)) == 80
    for shape in ((5, 1, 9), (4,), (3, 3), (2, 3, 4, 5)):
        codes = {morton.encode_cell(c, shape): c for c in itertools.product(*map(range, shape))}
        assert len(codes) == np.prod(shape)
        assert all(morton.decode_cell(k, shape) == c for k, c in codes.items())
    with pytest.raises(ValueError):
        morton.encode_cell((5, 0, 0), (5, 1, 9))
    with pytest.raises(ValueError):
        morton.decode_cell(16 + 1 + 4, (5, 1, 9))
    with pytest.raises(ValueError):
        morton.bit_plan((1 << 40, 1 << 40))


def test_morton_columns(spark):
    shape = (5, 2, 9)
    cells = spark.createDataFrame(list(itertools.product(*map(range, shape))), "a bigint, b bigint, c bigint")
    rows = cells.withColumn("m", morton.encode([F.col("a"), F.col("b"), F.col("c")], shape)).select("*", *[c.alias(f"d{i}") for i, c in enumerate(morton.decode(F.col("m"), shape))]).collect()
    assert all(r.m == morton.encode_cell((r.a, r.b, r.c), shape) and (r.d0, r.d1, r.d2) == (r.a, r.b, r.c) for r in rows)
    assert spark.createDataFrame([(9, 0, 0)], "a bigint, b bigint, c bigint").select(morton.encode([F.col("a"), F.col("b"), F.col("c")], shape)).first()[0] is None


@pytest.mark.parametrize("x,cells", [(0.0, [0]), (5.0, [0]), (10.0, [0, 1]), (30.0, [2]), (31.0, []), (-1.0, [])])
def test_closed_cells(spark, x, cells):
    grid = Grid((0.0,), (10.0,), (3,))
    df = spark.createDataFrame([(x, x)], "lo double, hi double")
    assert sorted(r.c0 for r in grid.explode(df, [F.col("lo")], [F.col("hi")]).collect()) == cells


def test_query_cells():
    grid = Grid((0.0, 0.0), (10.0, 5.0), (3, 2))
    assert list(grid.query_cells([-5, 2], [100, 4])) == [(0, 0), (1, 0), (2, 0)]
    assert Grid.over([0, 0], [25, 0], 10) == Grid((0.0, 0.0), (10.0, 10.0), (3, 1))
    with pytest.raises(ValueError):
        grid.query_range([5, 5], [0, 0])
    with pytest.raises(ValueError):
        Grid.over([0, 0], [1, 1], [1, 2, 3])


def test_shard_spec():
    assert choose_spec(1, 99) is None
    assert [(s.minishard_bits, s.shard_bits, s.preshift_bits) for s in (choose_spec(0, 0), choose_spec(1001, 1), choose_spec(2_000_000, 48_000_000), choose_spec(2_000_000, 200_000_000))] == [(0, 0, 10), (1, 0, 10), (11, 0, 10), (9, 2, 10)]
    assert plain_hash("identity_hash") == "identity"
    with pytest.raises(ValueError):
        choose_spec(5, 5, hash="md5")
    assert ShardSpec.from_json(choose_spec(5000, 10**9).to_json()) == choose_spec(5000, 10**9)


def test_identity_shards(spark):
    spec = ShardSpec(2, "identity", 1, 2)
    shard, mini = shard_and_minishard(np.arange(64), spec)
    assert (mini == np.arange(64) >> 2 & 1).all() and (shard == np.arange(64) >> 3 & 3).all()
    own = ShardSpec(0, "murmurhash3_x86_128", 4, 4)
    rows = spark.range(200).select("id", shard_column(F.col("id"), own).alias("s")).select("id", "s.*").collect()
    a, b = shard_and_minishard(np.array([r.id for r in rows]), own)
    assert [r.shard for r in rows] == a.tolist() and [r.minishard for r in rows] == b.tolist()
    assert len({(r.shard, r.minishard) for r in rows}) > 100


def _hits(spark, kind, a, b, box):
    schema = AnnotationSchema(kind)
    names = schema.parts
    row = [a] if len(names) == 1 else [a, b]
    df = spark.createDataFrame([tuple(map(lambda v: [float(x) for x in v], row))], ", ".join(f"{n} array<float>" for n in names))
    box = geometry.check_box(*box, 3)
    return tuple(df.select(geometry.in_box(schema, box), geometry.intersects(schema, box)).first())


def test_predicates(spark):
    q = ((4, 4, 4), (6, 6, 6))
    assert _hits(spark, "axis_aligned_bounding_box", (0, 0, 0), (10, 10, 10), q) == (True, True)
    assert _hits(spark, "axis_aligned_bounding_box", (10, 0, 0), (0, 10, 10), q) == (False, True)
    assert _hits(spark, "axis_aligned_bounding_box", (0, 0, 0), (10, 10, 10), ((5, -1, -1), (6, 11, 11))) == (False, True)
    assert _hits(spark, "line", (0, 0, 0), (10, 0, 0), ((4, -1, -1), (6, 1, 1))) == (False, True)
    assert _hits(spark, "line", (0, 5, 0), (10, 5, 0), ((4, -1, -1), (6, 1, 1))) == (False, False)
    assert _hits(spark, "point", (4, 6, 5), None, q) == (True, True)
    assert _hits(spark, "ellipsoid", (3, 5, 5), (2, 1, 1), q) == (False, True)
    assert _hits(spark, "ellipsoid", (3, 5, 5), (0, 1, 1), q) == (False, False)
    for bad in (((0, 0), (1, 1)), ((1, 0, 0), (0, 1, 1)), ((0, 0, float("nan")), (1, 1, 1))):
        with pytest.raises(ValueError):
            geometry.check_box(*bad, 3)


def test_line_slabs_against_sampling(spark):
    rnd = random.Random(4)
    rows, box = [], ((2.0, 2.0, 2.0), (4.0, 5.0, 6.0))
    for _ in range(300):
        rows.append(([rnd.randint(0, 8) for _ in range(3)], [rnd.randint(0, 8) for _ in range(3)]))
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b]) for a, b in rows], "point_a array<float>, point_b array<float>")
    got = [r[0] for r in df.select(geometry.intersects(AnnotationSchema("line"), box)).collect()]
    t = np.linspace(0, 1, 841)[:, None]
    for (a, b), hit in zip(rows, got):
        p = np.array(a) + t * (np.array(b) - np.array(a))
        touched = bool(((p >= np.array(box[0]) - 1e-9) & (p <= np.array(box[1]) + 1e-9)).all(axis=1).any())
        assert hit == touched, (a, b)
