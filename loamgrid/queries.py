"""One query per operator over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import geometry, grid, morton
from loamgrid.functions.sharding import ShardSpec, choose_spec, shard_column
from loamgrid.operators.annotation_set import AnnotationSet
from loamgrid.operators.builder import auto_id, build
from loamgrid.plans.schema import AnnotationSchema, PropertySpec
from loamgrid.session import exists, shared_path, ship
from loamgrid.sources import codec, interchange, store

EVENT_TYPES = ("signup", "purchase", "error", "view", "click")
WIDE = ([10.0, 920.0, 20.0], [30.0, 960.0, 60.0])
TINY = ([35.0, 921.0, 29.0], [36.0, 922.0, 30.0])
POINTS = ([100.0, 10.0, 5.0], [300.0, 60.0, 40.0])
GRID = grid.Grid((-11.0, 890.0, -10.0), (16.0, 32.0, 32.0), (5, 4, 4))


# -- sets ---------------------------------------------------------------------------------------------
def points(spark: SparkSession, sf_dir: str) -> AnnotationSet:
    ship(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.lit(0)
    for i, name in enumerate(EVENT_TYPES):
        code = F.when(F.col("event_type") == name, i).otherwise(code)
    kind = PropertySpec("kind", "uint8", "event type", (0, 1, 2), EVENT_TYPES[:3])
    schema = AnnotationSchema("point", properties=(kind,), relationships=("user",))
    return build(events, schema, {"point": [F.dayofmonth("ts") * 24 + F.hour("ts"), "value", "user_id"]}, "event_id", values={"kind": code, "user": "user_id"}, chunk_size=(128, 64, 32))


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    links = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("bigint").alias("s"))
    suppliers = links.groupBy("p_partkey").agg(F.sort_array(F.collect_set("s")).alias("supplier"))
    return part.join(suppliers, "p_partkey", "left")


def _corners() -> tuple[list, list]:
    k, s, q = F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, -1).otherwise(1), F.when(F.col("p_partkey") % 5 == 0, -1).otherwise(1)
    a = [F.col("p_size"), F.col("p_retailprice"), k % 97]
    return a, [F.col("p_size") + s * (k % 13), F.col("p_retailprice") + s * (k % 7), k % 97 + s * q * (k % 11)]


def boxes(spark: SparkSession, sf_dir: str) -> AnnotationSet:
    a, b = _corners()
    schema = AnnotationSchema("axis_aligned_bounding_box", properties=(PropertySpec("size", "uint8"),), relationships=("supplier",))
    return build(_part(spark, sf_dir), schema, {"point_a": a, "point_b": b}, "p_partkey", values={"size": "p_size"}, chunk_size=(16, 32, 32)).with_levels([GRID.size], GRID.origin, GRID.upper)


def lines(spark: SparkSession, sf_dir: str) -> AnnotationSet:
    a, b = _corners()
    schema = AnnotationSchema("line", properties=(PropertySpec("price", "float32"),), relationships=("supplier",))
    return build(_part(spark, sf_dir), schema, {"point_a": a, "point_b": b}, "p_partkey", values={"price": "p_retailprice"}, chunk_size=(16, 32, 32)).with_levels([GRID.size], GRID.origin, GRID.upper)


def ellipsoids(spark: SparkSession, sf_dir: str) -> AnnotationSet:
    a, _ = _corners()
    k = F.col("p_partkey")
    schema = AnnotationSchema("ellipsoid", relationships=("supplier",))
    return build(_part(spark, sf_dir), schema, {"center": a, "radii": [1 + k % 5, 1 + k % 3, 1 + k % 7]}, "p_partkey", chunk_size=(16, 32, 32))


def _flat(df: DataFrame, *extra: str, **parts: str) -> DataFrame:
    """``id``, ``extra`` and scalar columns: ``point="xyz"`` gives x, y, z; others ``a_x`` and so on."""
    out = [F.col("id"), *map(F.col, extra)]
    for part, names in parts.items():
        out += [geometry.entry(part, d).alias(n) for d, n in enumerate(names.split())]
    return df.select(*out)


_AB = {"point_a": "ax ay az", "point_b": "bx by_ bz"}
_CR = {"center": "ax ay az", "radii": "rx ry rz"}


# -- queries -----------------------------------------------------------------------------------------------
def q01(s, d):
    return _flat(points(s, d).scan().withColumn("user_id", F.get("user", F.lit(0))).withColumn("kind", F.col("kind").cast("int")), "kind", "user_id", point="x y z")


def q02(s, d):
    return _flat(points(s, d).by_id(17), point="x y z")


def q03(s, d):
    return _flat(points(s, d).by_ids([41, 7, 99, 7], on_missing="skip"), "pos", point="x y z")


def q04(s, d):
    return points(s, d).ids()


def q05(s, d):
    return _flat(boxes(s, d).by_relationship("supplier", 3), **_AB)


def q06(s, d):
    rows = boxes(s, d).by_relationship("supplier", 3, with_relationships=True)
    return rows.select("id", F.col("size").cast("int").alias("size"), F.explode("supplier").alias("supplier"))


def q07(s, d):
    return boxes(s, d).relationship_index("supplier").drop("relationship")


def q08(s, d):
    return _flat(points(s, d).id_range(20, 200), point="x y z")


def q09(s, d):
    return points(s, d).decode_enums().select("id", "kind")


def q10(s, d):
    data = lines(s, d)
    flat = data.scan().select("id", geometry.flatten(data.schema).alias("flat"))
    parts = geometry.split(F.col("flat"), data.schema)
    return _flat(flat.select("id", *[c.alias(n) for n, c in parts.items()]), **_AB)


def q11(s, d):
    return _flat(points(s, d).in_bounds(*POINTS), point="x y z")


def q12(s, d):
    return _flat(lines(s, d).in_bounds(*WIDE), **_AB)


def q12_exact(s, d):
    return lines(s, d).in_bounds(*WIDE, exact=True).select("id")


def q13(s, d):
    return _flat(boxes(s, d).in_bounds(*TINY), **_AB)


def q13_exact(s, d):
    return _flat(boxes(s, d).in_bounds(*TINY, exact=True), **_AB)


def q14(s, d):
    return _flat(ellipsoids(s, d).in_bounds(*WIDE), **_CR)


def q14_exact(s, d):
    return ellipsoids(s, d).in_bounds(*WIDE, exact=True).select("id")


def q15(s, d):
    x = geometry.entry("point", 0)
    own = grid.Grid((24.0, 0.0, 0.0), (128.0, 64.0, 32.0), (6, 8, 5))
    return points(s, d).scan().select("id", grid.plain_index(x, 128.0).alias("plain"), *[own.index(geometry.entry("point", i), i).alias(f"c{i}") for i in range(3)])


def q16(s, d):
    return boxes(s, d).cells(0).drop("morton")


def q16_counts(s, d):
    return boxes(s, d).cell_counts(0)


def q17(s, d):
    return _flat(boxes(s, d).in_cell("spatial0", (1, 1, 1)), **_AB)


def q18(s, d):
    return boxes(s, d).candidates("spatial0", *WIDE).select("id", "c0", "c1", "c2")


def q18_bag(s, d):
    return boxes(s, d).in_bounds(*WIDE, dedupe=False).groupBy("id").agg(F.count("*").alias("copies"))


def q19(s, d):
    return GRID.enumerate(s, [-50.0, 900.0, 25.0], [20.0, 970.0, 500.0])


def q20(s, d):
    out = None
    for name, data in (("box", boxes(s, d)), ("ellipsoid", ellipsoids(s, d)), ("point", points(s, d))):
        own = data.bounds_frame().select(F.lit(name).alias("kind"), "*")
        out = own if out is None else out.unionAll(own)
    return out


def q21(s, d):
    own = grid.Grid.over(*points(s, d).bounds(), (128.0, 64.0, 32.0))
    return s.createDataFrame([(*own.shape, *own.upper)], "n0 bigint, n1 bigint, n2 bigint, up0 double, up1 double, up2 double")


def q22(s, d):
    return boxes(s, d).cells(0).select("c0", "c1", "c2", "morton").distinct()


def q23(s, d):
    code = s.range(1 << 7).select(F.col("id").alias("code"))
    return code.select("code", *[c.alias(f"c{i}") for i, c in enumerate(morton.decode(F.col("code"), GRID.shape))]).where("c0 is not null")


def q24(s, d):
    data = boxes(s, d)
    back = codec.decode_by_id(codec.encode_by_id(data.scan(), data.schema), data.schema)
    return _flat(back.withColumns({"size": F.col("size").cast("int"), "suppliers": F.size("supplier"), "first": F.get("supplier", F.lit(0))}), "size", "suppliers", "first", **_AB)


def q25(s, d):
    data = boxes(s, d)
    keyed = data.candidates(0, GRID.origin, GRID.upper).withColumn("cell", F.concat_ws("_", "c0", "c1", "c2"))
    back = codec.decode_groups(codec.encode_groups(keyed, data.schema, "cell"), data.schema)
    return _flat(back.withColumn("size", F.col("size").cast("int")), "key", "size", **_AB)


_SIZES = [(0, 0), (1, 10), (1000, 50_000_000), (1001, 1), (2_000_000, 48_000_000), (2_000_000, 200_000_000), (77_777_777, 9_999_999_999)]


def q26(s, d):
    rows = [(n, size, spec.preshift_bits, spec.minishard_bits, spec.shard_bits) if (spec := choose_spec(n, size)) else (n, size, None, None, None) for n, size in _SIZES]
    return s.createDataFrame(rows, "n bigint, size bigint, preshift_bits int, minishard_bits int, shard_bits int")


def q27(s, d):
    ship(s)
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderdate", "o_orderkey")
    return auto_id(orders, ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")


def q28(s, d):
    data = points(s, d).with_levels([(512, 512, 128), (128, 64, 32)], (24.0, 0.0, 0.0), (792.0, 512.0, 160.0))
    return data.in_bounds(*POINTS, dedupe=False).groupBy("id").agg(F.count("*").alias("copies"))


def q29(s, d):
    return _flat(points(s, d).in_bounds(*POINTS, limit=25), point="x y z")


def q30(s, d):
    return points(s, d).catalog()


def q31(s, d):
    return boxes(s, d).relationships_long()


def q32(s, d):
    spec = ShardSpec(10, "murmurhash3_x86_128", 3, 4)
    return points(s, d).ids().select("id", shard_column(F.col("id") * 1024, spec).alias("s")).select("id", "s.shard", "s.minishard")


# -- queries over written sets -----------------------------------------------------------------------------
_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(s: SparkSession, d: str, layout: str) -> AnnotationSet:
    """The boxes, written once per application in a layout ("native", "packed" or "plain") and opened again."""
    at = (s.sparkContext.applicationId, d, layout)
    if at not in _WRITTEN or not exists(s, f"{_WRITTEN[at]}/info"):
        path = shared_path(s, f"boxes-{layout}")
        if layout == "native":
            store.write(boxes(s, d), path)
        else:
            interchange.write(boxes(s, d), path, sharded=layout == "packed")
        _WRITTEN[at] = path
    return store.open_set(s, _WRITTEN[at])


def _stored(layout: str) -> dict:
    def scan(s, d):
        rows = written(s, d, layout).scan()
        return _flat(rows.withColumns({"size": F.col("size").cast("int"), "suppliers": F.size("supplier"), "first": F.get("supplier", F.lit(0))}), "size", "suppliers", "first", **_AB)

    def by_ids(s, d):
        return _flat(written(s, d, layout).by_ids([41, 7, 99, 7, 1 << 40], on_missing="skip"), "pos", **_AB)

    def related(s, d):
        return _flat(written(s, d, layout).by_relationship("supplier", 3), **_AB)

    def related_full(s, d):
        rows = written(s, d, layout).by_relationship("supplier", 3, with_relationships=True)
        return rows.select("id", F.col("size").cast("int").alias("size"), F.explode("supplier").alias("supplier"))

    def nobody(s, d):
        return _flat(written(s, d, layout).by_relationship("supplier", 1 << 40), **_AB)

    def cell(s, d):
        return _flat(written(s, d, layout).in_cell("spatial0", (1, 1, 1)), **_AB)

    def bounds(s, d):
        return _flat(written(s, d, layout).in_bounds(*WIDE), **_AB)

    def bounds_limit(s, d):
        return _flat(written(s, d, layout).in_bounds(*WIDE, limit=5), **_AB)

    def cells(s, d):
        return written(s, d, layout).cells(0).select("id", "c0", "c1", "c2")

    def level(s, d):
        x = written(s, d, layout).levels()[0]
        return s.createDataFrame([(x.key, *x.grid_shape, *x.chunk_size, x.limit)], "key string, n0 bigint, n1 bigint, n2 bigint, s0 double, s1 double, s2 double, most bigint")

    return {f"{name}_{layout}": f for name, f in (("q33_scan", scan), ("q34_by_ids", by_ids), ("q35_related", related), ("q36_related_full", related_full), ("q37_related_none", nobody), ("q38_cell", cell), ("q39_bounds", bounds), ("q40_bounds_limit", bounds_limit), ("q41_cells", cells), ("q42_level", level))}


def q43(s, d):
    data = boxes(s, d)
    return codec.encode_by_id(data.scan(), data.schema).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("bytes"))


def q44(s, d):
    data = points(s, d)
    return data.decode_enums(data.in_bounds(*POINTS).where("kind < 3"), strict=True).select("id", "kind")


QUERIES = {
    "q01_full_scan": q01, "q02_get_by_id": q02, "q03_get_by_ids": q03, "q04_list_ids": q04, "q05_by_relationship": q05, "q06_by_relationship_full": q06, "q07_rel_index": q07,
    "q08_key_range": q08, "q09_enum_decode": q09, "q10_geometry_split": q10, "q11_bounds_point": q11, "q12_bounds_line": q12, "q12_bounds_line_exact": q12_exact, "q13_bounds_box": q13,
    "q13_bounds_box_exact": q13_exact, "q14_bounds_ellipsoid": q14, "q14_bounds_ellipsoid_exact": q14_exact, "q15_cell_index": q15, "q16_cell_assign": q16, "q16_cell_counts": q16_counts,
    "q17_cell_scan": q17, "q18_candidates": q18, "q18_bounds_bag": q18_bag, "q19_cell_enumeration": q19, "q20_global_bounds": q20, "q21_grid_shape": q21, "q22_morton": q22,
    "q23_morton_inverse": q23, "q24_roundtrip_by_id": q24, "q25_roundtrip_cell": q25, "q26_shard_spec": q26, "q27_auto_id": q27, "q28_multi_level": q28, "q29_bounds_limit": q29,
    "q30_catalog": q30, "q31_relationships_long": q31, "q32_shard_assignment": q32,
    "q43_by_id_bytes": q43, "q44_enum_strict": q44, **_stored("native"), **_stored("packed"), **_stored("plain"),
}


# -- the same in DuckDB SQL --------------------------------------------------------------------------------
_PTS = """pts as (select event_id as id, cast(cast(day(ts) * 24 + hour(ts) as float) as double) as x, cast(cast(value as float) as double) as y,
  cast(cast(user_id as float) as double) as z, user_id, event_type from events)"""
_BOX = """base as (select p_partkey as k, p_size, p_retailprice, case when p_partkey % 3 = 0 then -1 else 1 end as s, case when p_partkey % 5 = 0 then -1 else 1 end as q from part),
box as (select k as id, p_size, p_retailprice, cast(cast(p_size as float) as double) as ax, cast(cast(p_retailprice as float) as double) as ay, cast(cast(k % 97 as float) as double) as az,
  cast(cast(p_size + s * (k % 13) as float) as double) as bx, cast(cast(p_retailprice + s * (k % 7) as float) as double) as by_, cast(cast(k % 97 + s * q * (k % 11) as float) as double) as bz,
  cast(1 + k % 5 as double) as rx, cast(1 + k % 3 as double) as ry, cast(1 + k % 7 as double) as rz from base),
link as (select distinct l_partkey as id, l_suppkey as supplier from lineitem where l_partkey in (select p_partkey from part))"""
_CELLS = f"""{_BOX},
span as (select id, ax, ay, az, bx, by_, bz, p_size,
  cast(greatest(ceil((least(ax, bx) + 11) / 16) - 1, 0) as bigint) as f0, cast(least(floor((greatest(ax, bx) + 11) / 16), 4) as bigint) as t0,
  cast(greatest(ceil((least(ay, by_) - 890) / 32) - 1, 0) as bigint) as f1, cast(least(floor((greatest(ay, by_) - 890) / 32), 3) as bigint) as t1,
  cast(greatest(ceil((least(az, bz) + 10) / 32) - 1, 0) as bigint) as f2, cast(least(floor((greatest(az, bz) + 10) / 32), 3) as bigint) as t2 from box),
cell as (select id, ax, ay, az, bx, by_, bz, p_size, c0, c1, c2 from span, unnest(generate_series(f0, t0)) as u0(c0), unnest(generate_series(f1, t1)) as u1(c1), unnest(generate_series(f2, t2)) as u2(c2))"""
_IN = lambda p, lo, hi: " and ".join(f"{c} between {a} and {b}" for c, a, b in zip(p.split(), lo, hi))
_A, _B = "ax ay az", "bx by_ bz"
_LINE = lambda box: f"(({_IN(_A, *box)}) or ({_IN(_B, *box)}))"
_AROUND = lambda a, b, box: " and ".join(f"{x} <= {lo} and {y} >= {hi}" for x, y, lo, hi in zip(a.split(), b.split(), *box))
_BOXES = lambda box: f"({_LINE(box)} or ({_AROUND(_A, _B, box)}) or ({_AROUND(_B, _A, box)}))"
_ALL = f"id, {', '.join((_A + ' ' + _B).split())}"


def _slabs(box) -> str:
    enter, leave, apart = ["0.0"], ["1.0"], []
    for a, b, lo, hi in zip(_A.split(), _B.split(), *box):
        t, u = f"({lo} - {a}) / nullif({b} - {a}, 0)", f"({hi} - {a}) / nullif({b} - {a}, 0)"
        enter.append(f"case when {a} = {b} then 0.0 else least({t}, {u}) end")
        leave.append(f"case when {a} = {b} then 1.0 else greatest({t}, {u}) end")
        apart.append(f"({a} <> {b} or {a} between {lo} and {hi})")
    return f"{' and '.join(apart)} and greatest({', '.join(enter)}) <= least({', '.join(leave)})"


def _nearest(box) -> str:
    terms = [f"power(greatest({lo} - {c}, {c} - {hi}, 0.0) / {r}, 2)" for c, r, lo, hi in zip(_A.split(), "rx ry rz".split(), *box)]
    return f"{' + '.join(terms)} <= 1"


_CODE = "(c0 & 1) | ((c1 & 1) << 1) | ((c2 & 1) << 2) | (((c0 >> 1) & 1) << 3) | (((c1 >> 1) & 1) << 4) | (((c2 >> 1) & 1) << 5) | (((c0 >> 2) & 1) << 6)"
_LEVEL = lambda sizes: ", ".join(f"greatest(cast(ceil(({c} - {o}) / {s}.0) as bigint) - 1, 0) as f{i}, least(cast(floor(({c} - {o}) / {s}.0) as bigint), {n - 1}) as t{i}" for i, (c, o, (s, n)) in enumerate(zip("xyz", (24, 0, 0), sizes)))


def _copies(sizes, box) -> str:
    low = [(24, 0, 0)[i] for i in range(3)]
    parts = []
    for i, (s, n) in enumerate(sizes):
        a, b = (min(max(int((v[i] - low[i]) // s), 0), n - 1) for v in box)
        parts.append(f"(least(t{i}, {b}) - greatest(f{i}, {a}) + 1)")
    return " * ".join(parts)


_FINE, _COARSE = ((128, 6), (64, 8), (32, 5)), ((512, 2), (512, 1), (128, 2))


def _murmur() -> str:
    mul = lambda a, b: f"((({a}) * {b & 0xFFFF} + (((({a}) * {b >> 16}) & 65535) << 16)) & 4294967295)"
    turn = lambda a, n: f"((({a} << {n}) | ({a} >> {32 - n})) & 4294967295)"
    steps = [
        "k0 as (select id, id & 4294967295 as k1, id >> 32 as k2 from x)",
        f"k1 as (select id, {mul('k1', 0x239B961B)} as k1, {mul('k2', 0xAB0E9789)} as k2 from k0)",
        f"k2 as (select id, {turn('k1', 15)} as k1, {turn('k2', 16)} as k2 from k1)",
        f"k3 as (select id, xor({mul('k1', 0xAB0E9789)}, 8) as h1, xor({mul('k2', 0x38B34AE5)}, 8) as h2, 8 as h3, 8 as h4 from k2)",
        "k4 as (select id, (h1 + h2 + h3 + h4) & 4294967295 as h1, h2, h3, h4 from k3)",
        "k5 as (select id, h1, (h2 + h1) & 4294967295 as h2, (h3 + h1) & 4294967295 as h3, (h4 + h1) & 4294967295 as h4 from k4)",
    ]
    for n, (shift, by) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None))):
        cells = [f"xor(h{i}, h{i} >> {shift})" for i in range(1, 5)]
        steps.append(f"k{6 + n} as (select id, {', '.join(f'{mul(c, by) if by else c} as h{i}' for i, c in enumerate(cells, 1))} from k{5 + n})")
    steps.append("k9 as (select id, (h1 + h2 + h3 + h4) & 4294967295 as h1 from k8)")
    return ", ".join(steps)


ORACLE_SQL = {
    "q01_full_scan": f"with {_PTS} select id, case event_type when 'purchase' then 1 when 'error' then 2 when 'view' then 3 when 'click' then 4 else 0 end as kind, cast(user_id as bigint) as user_id, x, y, z from pts",
    "q02_get_by_id": f"with {_PTS} select id, x, y, z from pts where id = 17",
    "q03_get_by_ids": f"with {_PTS} select id, pos, x, y, z from (values (0, 41), (1, 7), (2, 99), (3, 7)) as v(pos, k) join pts on id = k",
    "q04_list_ids": "select event_id as id from events",
    "q05_by_relationship": f"with {_BOX} select {_ALL} from box where id in (select id from link where supplier = 3)",
    "q06_by_relationship_full": f"with {_BOX} select box.id, cast(p_size as int) as size, cast(link.supplier as bigint) as supplier from box join link on box.id = link.id where box.id in (select id from link where supplier = 3)",
    "q07_rel_index": f"with {_BOX} select cast(supplier as bigint) as related_id, count(*) as n, min(id) as first_id, max(id) as last_id from link group by supplier",
    "q08_key_range": f"with {_PTS} select id, x, y, z from pts where id >= 20 and id < 200",
    "q09_enum_decode": f"with {_PTS} select id, case event_type when 'view' then '3' when 'click' then '4' else event_type end as kind from pts",
    "q10_geometry_split": f"with {_BOX} select {_ALL} from box",
    "q11_bounds_point": f"with {_PTS} select id, x, y, z from pts where {_IN('x y z', *POINTS)}",
    "q12_bounds_line": f"with {_BOX} select {_ALL} from box where {_LINE(WIDE)}",
    "q12_bounds_line_exact": f"with {_BOX} select id from box where {_slabs(WIDE)}",
    "q13_bounds_box": f"with {_BOX} select {_ALL} from box where {_BOXES(TINY)}",
    "q13_bounds_box_exact": f"with {_BOX} select {_ALL} from box where " + " and ".join(f"greatest({a}, {b}) >= {lo} and least({a}, {b}) <= {hi}" for a, b, lo, hi in zip(_A.split(), _B.split(), *TINY)),
    "q14_bounds_ellipsoid": f"with {_BOX} select id, ax, ay, az, rx, ry, rz from box where {_IN(_A, *WIDE)}",
    "q14_bounds_ellipsoid_exact": f"with {_BOX} select id from box where {_nearest(WIDE)}",
    "q15_cell_index": f"with {_PTS} select id, cast(floor(x / 128) as bigint) as plain, cast(floor((x - 24) / 128) as bigint) as c0, cast(floor(y / 64) as bigint) as c1, cast(floor(z / 32) as bigint) as c2 from pts",
    "q16_cell_assign": f"with {_CELLS} select id, c0, c1, c2 from cell",
    "q16_cell_counts": f"with {_CELLS} select c0, c1, c2, count(*) as n from cell group by c0, c1, c2",
    "q17_cell_scan": f"with {_CELLS} select {_ALL} from cell where c0 = 1 and c1 = 1 and c2 = 1",
    "q18_candidates": f"with {_CELLS} select id, c0, c1, c2 from cell where c0 between 1 and 2 and c1 between 0 and 2 and c2 between 0 and 2",
    "q18_bounds_bag": f"with {_CELLS} select id, count(*) as copies from cell where c0 between 1 and 2 and c1 between 0 and 2 and c2 between 0 and 2 and {_BOXES(WIDE)} group by id",
    "q19_cell_enumeration": "select c0, c1, c2, c0 || '_' || c1 || '_' || c2 as key from generate_series(0, 1) as a(c0), generate_series(0, 2) as b(c1), generate_series(1, 3) as c(c2)",
    "q20_global_bounds": f"with {_BOX}, {_PTS} select 'box' as kind, min(least(ax, bx)) as lo_0, min(least(ay, by_)) as lo_1, min(least(az, bz)) as lo_2, max(greatest(ax, bx)) as hi_0, max(greatest(ay, by_)) as hi_1, max(greatest(az, bz)) as hi_2 from box "
    "union all select 'ellipsoid', min(ax - rx), min(ay - ry), min(az - rz), max(ax + rx), max(ay + ry), max(az + rz) from box union all select 'point', min(x), min(y), min(z), max(x), max(y), max(z) from pts",
    "q21_grid_shape": f"with {_PTS}, n as (select min(x) as l0, min(y) as l1, min(z) as l2, " + ", ".join(f"greatest(cast(ceil((max({c}) - min({c})) / {s}) as bigint), 1) as n{i}" for i, (c, s) in enumerate(zip("xyz", (128, 64, 32)))) + " from pts) select n0, n1, n2, l0 + n0 * 128 as up0, l1 + n1 * 64 as up1, l2 + n2 * 32 as up2 from n",
    "q22_morton": f"with {_CELLS} select distinct c0, c1, c2, {_CODE} as morton from cell",
    "q23_morton_inverse": f"select {_CODE} as code, c0, c1, c2 from generate_series(0, 4) as a(c0), generate_series(0, 3) as b(c1), generate_series(0, 3) as c(c2)",
    "q24_roundtrip_by_id": f"with {_BOX} select box.id, cast(p_size as int) as size, count(supplier)::int as suppliers, cast(min(supplier) as bigint) as first, {', '.join((_A + ' ' + _B).split())} from box left join link on box.id = link.id group by box.id, p_size, {', '.join((_A + ' ' + _B).split())}",
    "q25_roundtrip_cell": f"with {_CELLS} select c0 || '_' || c1 || '_' || c2 as key, cast(p_size as int) as size, {_ALL} from cell",
    "q26_shard_spec": "with v as (select * from (values " + ", ".join(f"({n}, {b})" for n, b in _SIZES) + ") as t(n, size)), b as (select cast(n as bigint) as n, cast(size as bigint) as size, (select min(i) from generate_series(0, 62) as g(i) where (cast(n as bigint) >> i) <= 1000) as total, (select min(i) from generate_series(0, 62) as g(i) where (cast(size as bigint) >> i) <= 50000000) as shard from v) "
    "select n, size, case when n <> 1 then 10 end as preshift_bits, case when n <> 1 then cast(total - least(total, shard) as int) end as minishard_bits, case when n <> 1 then cast(shard as int) end as shard_bits from b",
    "q27_auto_id": "select row_number() over (order by o_orderdate, o_orderkey) - 1 as id, o_orderkey from orders",
    "q28_multi_level": f"with {_PTS}, hit as (select * from pts where {_IN('x y z', *POINTS)}), a as (select id, {_LEVEL(_COARSE)} from hit), b as (select id, {_LEVEL(_FINE)} from hit) "
    f"select id, cast(sum(n) as bigint) as copies from (select id, {_copies(_COARSE, POINTS)} as n from a union all select id, {_copies(_FINE, POINTS)} from b) group by id having sum(n) > 0",
    "q29_bounds_limit": f"with {_PTS} select id, x, y, z from pts where {_IN('x y z', *POINTS)} order by id limit 25",
    "q30_catalog": "select * from (values ('dimension', 0, 'x', 'nm'), ('dimension', 1, 'y', 'nm'), ('dimension', 2, 'z', 'nm'), ('geometry', 0, 'point', 'float32[3]'), ('property', 0, 'kind', 'uint8'), ('relationship', 0, 'user', 'uint64[]')) as t(kind, pos, name, type)",
    "q31_relationships_long": f"with {_BOX} select id, 'supplier' as relationship, cast(row_number() over (partition by id order by supplier) - 1 as int) as pos, cast(supplier as bigint) as related_id from link",
    "q32_shard_assignment": f"with x as (select event_id as id from events), {_murmur()} select id, (h1 >> 3) & 15 as shard, h1 & 7 as minishard from k9",
}
ORACLE_SQL |= {
    "q43_by_id_bytes": f"with {_BOX}, one as (select box.id, 28 + 4 + 8 * count(supplier) as b from box left join link on box.id = link.id group by box.id) select count(*) as n, cast(sum(b) as bigint) as bytes from one",
    "q44_enum_strict": f"with {_PTS} select id, case when event_type in ('purchase', 'error') then event_type else 'signup' end as kind from pts where event_type not in ('view', 'click') and {_IN('x y z', *POINTS)}",
}
for _layout in ("native", "packed", "plain"):
    for _name, _like in (("q33_scan", "q24_roundtrip_by_id"), ("q35_related", "q05_by_relationship"), ("q36_related_full", "q06_by_relationship_full"), ("q38_cell", "q17_cell_scan"), ("q41_cells", "q16_cell_assign")):
        ORACLE_SQL[f"{_name}_{_layout}"] = ORACLE_SQL[_like]
    ORACLE_SQL |= {
        f"q34_by_ids_{_layout}": f"with {_BOX} select pos, {_ALL} from (values (0, 41), (1, 7), (2, 99), (3, 7)) as v(pos, k) join box on id = k",
        f"q37_related_none_{_layout}": f"with {_BOX} select {_ALL} from box where false",
        f"q39_bounds_{_layout}": f"with {_BOX} select {_ALL} from box where {_BOXES(WIDE)}",
        f"q40_bounds_limit_{_layout}": f"with {_BOX} select {_ALL} from box where {_BOXES(WIDE)} order by id limit 5",
        f"q42_level_{_layout}": f"with {_CELLS} select 'spatial0' as key, 5::bigint as n0, 4::bigint as n1, 4::bigint as n2, 16::double as s0, 32::double as s1, 32::double as s2, (select max(n) from (select count(*) as n from cell group by c0, c1, c2)) as most",
    }
