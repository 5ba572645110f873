"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are fitted on a bounded sample of the distinct vectors: every node splits its sample at the
median of a projection onto the difference of two of its points. Below the depth that the sample
supports, all nodes of a level share one random direction, and each cuts it at the mean of its sampled
ancestor's points, so that the size of the forest doesn't grow with the table. All vectors are
indexed, each in one leaf of each tree.

A query first looks into a few leaves of one tree; the distance to the last neighbour found there
bounds the walk: one priority queue over the nodes of all trees, smallest margin first, until the margin
exceeds what a neighbour at that distance is likely to lie beyond a plane. So the leaves that a query visits
depend on how close its neighbours are, not on the size of the table. Leaf by leaf the candidates
are then ranked exactly.

Equal vectors are one class from the start (with the few smallest ids that a result can show), so a
vector that very many rows share is indexed and searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

TREES, LEAF, SEED = 4, 512, 5
#: A direction at random holds 1 / sqrt(dimensions) of a distance; leaves are visited up to this many times that.
REACH = 0.8
#: Leaves of the first tree that give a query its distance.
FIRST = 4
#: Vectors that the trees are fitted on, at most; a node of the fitted part has 8 of them or more.
SAMPLE, NODE = 20_000, 8
#: Bytes of the fitted part, at most.
FOREST_BYTES = 64 << 20
QUERY_STEP, NEIGHBOURS = 50, 5


@dataclass
class Forest:
    planes: np.ndarray  # trees x nodes of the fitted part x dimensions
    cuts: np.ndarray  # trees x nodes of the fitted part
    shared: np.ndarray  # trees x levels below it x dimensions
    centres: np.ndarray  # trees x fitted leaves x levels below: where they cut

    @property
    def fitted(self) -> int:
        return (self.planes.shape[1] + 1).bit_length() - 1

    @property
    def depth(self) -> int:
        return self.fitted + self.shared.shape[1]

    def leaves(self, unit: np.ndarray, tree: int) -> np.ndarray:
        """Leaf of each row of unit vectors."""
        node = np.zeros(len(unit), np.int64)
        for _ in range(self.fitted):
            side = np.einsum("ij,ij->i", unit, self.planes[tree, node]) > self.cuts[tree, node]
            node = 2 * node + 1 + side
        leaf = top = node - (2**self.fitted - 1)
        for level, w in enumerate(self.shared[tree]):
            leaf = 2 * leaf + (unit @ w > self.centres[tree, top, level])
        return leaf

    def search(self, unit: np.ndarray, wanted: int | None = None, within: float = np.inf, trees: int | None = None) -> list[tuple[int, int]]:
        """``(tree, leaf)`` by margin over all trees (or the first ones), smallest first: every one up
        to ``within`` and the first of each tree, or ``wanted`` of them."""
        depth, fitted = self.depth, self.fitted
        trees = trees or len(self.planes)
        margins, below = self.planes[:trees] @ unit - self.cuts[:trees], self.shared[:trees] @ unit
        queue = [(0.0, t, 0, 0) for t in range(trees)]  # margin, tree, level, place in the level
        found = []
        while queue and (wanted is None or len(found) < wanted):
            margin, t, level, at = heapq.heappop(queue)
            while level < depth:
                if level < fitted:
                    d = margins[t, 2**level - 1 + at]
                else:
                    d = below[t, level - fitted] - self.centres[t, at >> (level - fitted), level - fitted]
                level, at = level + 1, 2 * at + (d > 0)
                if (far := max(margin, abs(d))) <= within:
                    heapq.heappush(queue, (far, t, level, at ^ 1))
            found.append((t, int(at)))
        return found


def fit(sample: np.ndarray, count: int, dims: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """Trees for ``count`` vectors. Where a node has no two different sample points, its plane is random
    through the origin."""
    depth = max(0, int(np.ceil(np.log2(max(1, count) / leaf))))
    room = min(len(sample) / NODE, FOREST_BYTES / (16 * trees * dims))
    fitted = min(depth, int(np.log2(max(1, room))))
    rng = np.random.default_rng(seed)
    planes, cuts = np.zeros((trees, 2**fitted - 1, dims)), np.zeros((trees, 2**fitted - 1))
    shared = rng.normal(size=(trees, depth - fitted, dims))
    shared /= np.linalg.norm(shared, axis=2, keepdims=True)
    centres = np.zeros((trees, 2**fitted, depth - fitted))
    for t in range(trees):
        own = {0: np.arange(len(sample))}
        for node in range(2**fitted - 1):
            rows = own.pop(node, np.zeros(0, int))
            w = np.zeros(dims)
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                w = sample[a] - sample[b]
            if not w.any():
                planes[t, node] = (x := rng.normal(size=dims)) / np.linalg.norm(x)
                side = sample[rows] @ planes[t, node] > 0
            else:
                planes[t, node] = w / np.linalg.norm(w)
                p = sample[rows] @ planes[t, node]
                cuts[t, node] = np.median(p)
                side = p > cuts[t, node]
            own[2 * node + 1], own[2 * node + 2] = rows[~side], rows[side]
        for node, rows in own.items():
            if len(rows):
                centres[t, node - (2**fitted - 1)] = shared[t] @ sample[rows].mean(axis=0)
    return Forest(planes, cuts, shared, centres)


def _vectors(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    data = [np.frombuffer(x.as_buffer(), "<f8") for x in batch.column(name)]
    return np.stack(data) if data else np.zeros((0, 0))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finite vectors of a positive norm as bytes of doubles, with their dimension."""
    for batch in batches:
        ids, dims, vecs = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
            x = v.as_py()
            if i is None or not x or None in x:
                continue
            x = np.array(x, "<f8") + 0.0  # no negative zero
            if np.isfinite(x).all() and np.isfinite(norm := np.linalg.norm(x)) and norm > 0:
                ids.append(i)
                dims.append(len(x))
                vecs.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "dims", "vec"])


def _classes(keep: int):
    """Per task: each vector once, with its ``keep`` smallest ids; flushed when many are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["vec", "ids"])
            held.clear()
            return batch

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist()):
                ids = held.setdefault(v, [])
                ids.append(i)
                if len(ids) > 8 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if len(held) > 20_000:
                yield out()
        if held:
            yield out()

    return run


def _ranked(keep: int):
    """Rows sorted by tree, leaf, kind: a leaf's vectors (kind 0), then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, matrix, norms = None, None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, leaf, kind, own = (batch.column(n).to_numpy() for n in ("tree", "leaf", "kind", "id"))
            vec = _vectors(batch)
            cuts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (leaf[1:] != leaf[:-1]) | (kind[1:] != kind[:-1])])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(kind)]):
                if kind[a] == 0:
                    if place != (tree[a], leaf[a]):
                        place, ids, parts, matrix = (tree[a], leaf[a]), [], [], None
                    ids.append(own[a:b])
                    parts.append(vec[a:b])
                elif place == (tree[a], leaf[a]):
                    if matrix is None:
                        matrix, ids = np.concatenate(parts), np.concatenate(ids)
                        norms = np.linalg.norm(matrix, axis=1)
                    for at in range(a, b, 1024):
                        q = vec[at : min(b, at + 1024)]
                        score = (q @ matrix.T) / (np.linalg.norm(q, axis=1)[:, None] * norms)
                        n = min(keep, len(ids))
                        # by score, then by class id, whole ties included
                        best = np.argsort(ids)[np.argsort(-score[:, np.argsort(ids)], axis=1, kind="stable")[:, :n]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[at : at + len(q)], n)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], ["q", "c", "score"])

    return run


def nearest(table: DataFrame, id_col: str, vector_col: str, query_step: int = QUERY_STEP, k: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, reach: float = REACH) -> DataFrame:
    """For every row whose id is divisible by ``query_step``, its ``k`` nearest other rows by cosine.

    Returns ``query_id, rank, vec_id, score``; fewer than ``k`` rows where there are fewer
    candidates; ties go to the smaller id. Null ids, null, empty and zero vectors and those with null
    or non-finite components take no part, nor do vectors of another than the most frequent
    dimension. Repeated rows of one id count once; an empty table gives no rows; other columns are
    ignored.
    """
    keep = k + 2  # the query itself and its own class may drop out
    rows = settle(table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_valid, "id bigint, dims int, vec binary"), "vectors")
    common = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    dims = common[0].dims if common else 1
    rows = rows.where(F.col("dims") == dims).select("id", "vec")
    merged = rows.mapInArrow(_classes(keep), "vec binary, ids array<bigint>").groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    classes = settle(merged.select(F.get("ids", F.lit(0)).alias("c"), "ids", "vec"), "vector-classes")
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("vec").collect()
    forest = fit(_unit(np.stack([np.frombuffer(r.vec, "<f8") for r in sample])) if sample else np.zeros((0, dims)), count, dims, trees, leaf)

    def index(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    unit = _unit(_vectors(batch))
                    for t in range(count):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(forest.leaves(unit, t)), pa.array(np.zeros(len(unit), np.int32)), batch.column("c"), batch.column("vec")], ["tree", "leaf", "kind", "id", "vec"])

        return run

    def probes(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bounds = [None] * batch.num_rows if first else batch.column("within").to_pylist()
                for c, vec, within, unit in zip(batch.column("c").to_pylist(), batch.column("vec").to_pylist(), bounds, _unit(_vectors(batch)) if batch.num_rows else []):
                    found = forest.search(unit, FIRST, trees=1) if first else forest.search(unit, within=within)
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int64()), pa.array([1] * len(found), pa.int32()), pa.array([c] * len(found), pa.int64()), pa.array([vec] * len(found), pa.binary())], ["tree", "leaf", "kind", "id", "vec"])

        return run

    def candidates(indexed: DataFrame, asking: DataFrame, width: int) -> DataFrame:
        met = indexed.unionAll(asking).repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "kind")
        found = met.mapInArrow(_ranked(width), "q bigint, c bigint, score double").groupBy("q", "c").agg(F.max("score").alias("score"))
        return found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("n") <= width)

    schema = "tree int, leaf bigint, kind int, id bigint, vec binary"
    asked = settle(rows.where(F.col("id") % query_step == 0).distinct().join(classes.select("c", "vec"), "vec").select("id", "c"), "queries")
    vectors = classes.select("c", "vec")
    queries = vectors.join(asked.select("c").distinct(), "c", "left_semi")
    # the query's own class is found too, hence one more than k
    near = candidates(vectors.mapInArrow(index(1), schema), queries.mapInArrow(probes(True), schema), k + 1).where(F.col("n") == k + 1)
    radius = near.select(F.col("q").alias("c"), (F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))) * reach / dims**0.5 + 1e-12).alias("within"))
    bounded = settle(queries.join(radius, "c", "left").select("c", "vec", F.coalesce("within", F.lit(float("inf"))).alias("within")), "bounded-queries")
    best = candidates(vectors.mapInArrow(index(trees), schema), bounded.mapInArrow(probes(False), schema), keep)
    members = best.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    out = asked.withColumnsRenamed({"id": "query_id", "c": "q"}).join(members, "q").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
