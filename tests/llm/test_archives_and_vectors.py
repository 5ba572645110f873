"""WARC archives (6) and nearest neighbours (9)."""

import base64
import hashlib
import io

import numpy as np
import pytest

from loamgrid.llm import rp_forest, warc_zstd
from loamgrid.llm.common import Cache


def check_pages(rows, got, least=0):
    first: dict = {}
    for i, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, h in rows:
        b = (h or "").encode()
        target = first.get(h) if len(b) >= least else None
        revisit = target is not None and target != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", target if revisit else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_archives(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    check_pages([(r.page_id, r.html) for r in pages.collect()], warc_zstd.archive_and_read(pages).collect())
    rows = [(3, "u", "same"), (1, None, "same"), (1, "v", "same"), (None, "w", "same"), (5, "a\nb", ""), (6, "x", ""), (7, "y", "\r\n\r\nWARC/1.1"), (8, "z", "ü" * 300_000), (None, None, "alone"), (9, "q", "t")]
    odd = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id bigint, url string, html string, sha1 string, payload int")
    for least in (0, 2):
        check_pages([(r[0], r[2]) for r in rows], warc_zstd.archive_and_read(odd, least).collect(), least)
    nulls = spark.createDataFrame([(1, None, None)], "page_id bigint, url string, html string")
    check_pages([(1, "")], warc_zstd.archive_and_read(nulls).collect())
    assert warc_zstd.archive_and_read(odd.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zstd, "ARCHIVE_BYTES", 60_000)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    manifest = warc_zstd.write_archives(pages, f"file://{tmp_path}/w")
    rows = {r.page_id: r for r in warc_zstd.read_archives(manifest).collect()}
    assert len(manifest.collect()) > 2
    for r in pages.collect():
        if rows[r.page_id].record_type == "response":
            assert rows[r.page_id].payload.decode() == r.html and rows[r.page_id].url == r.url


def test_archive_layout():
    for records in ([b"tiny"], [b"record %d " % i * 50 for i in range(3000)]):
        sink = io.BytesIO()
        writer = warc_zstd.ArchiveWriter(sink)
        for raw in records:
            writer.add(raw)
        writer.close()
        data = sink.getvalue()
        assert data[:4] == b"\x5d\x2a\x4d\x18"  # a skippable frame leads
        assert list(warc_zstd.read_records(io.BytesIO(data), chunk=700)) == records
    with pytest.raises(ValueError):
        list(warc_zstd.read_records(io.BytesIO(data[:-5])))


def brute(ids, vectors, step=50, k=5):
    v = np.array(vectors, float)
    norm = np.linalg.norm(v, axis=1)
    out = {}
    for i in np.flatnonzero(np.array(ids) % step == 0):
        s = v @ v[i] / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], s[j]) for j in order]
    return out


def ranked(got):
    out: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def check_recall(table, id_col, vector_col, least):
    """Production parameters against brute force; the scores are exact."""
    rows = table.select(id_col, vector_col).collect()
    want = brute([r[0] for r in rows], [r[1] for r in rows])
    got = ranked(rp_forest.nearest(table, id_col, vector_col).collect())
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    scores = {q: dict(x) for q, x in want.items()}
    hits = [v in scores[q] for q, x in got.items() for v, _ in x]
    assert np.mean(hits) >= least
    assert all(s == pytest.approx(scores[q][v], abs=1e-12) for q, x in got.items() for v, s in x if v in scores[q])


def test_recall(spark):
    check_recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding", 0.9)


def test_recall_without_and_with_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32))
    for x in (rng.normal(size=(12_000, 32)), centres[rng.integers(0, 60, 12_000)] + 0.3 * rng.normal(size=(12_000, 32))):
        check_recall(spark.createDataFrame(list(enumerate(x.tolist())), "id bigint, v array<double>"), "id", "v", 0.9)


def test_leaves_follow_the_data():
    """Below the fitted part nodes share directions; near neighbours keep the walk short."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 32))
    x = centres[rng.integers(0, 300, 60_000)] + 0.3 * rng.normal(size=(60_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    small = rp_forest.fit(x[:512], 60_000, 32, leaf=100)
    assert small.fitted == 6 and small.depth == 10 and small.shared.shape == (4, 4, 32)
    sizes = np.bincount(small.leaves(x, 0), minlength=1024)
    assert sizes.sum() == 60_000 and len(sizes) == 1024 and (sizes > 0).mean() > 0.9
    for forest in (small, rp_forest.fit(x[:20_000], 60_000, 32)):
        own = [forest.leaves(x, t) for t in range(4)]
        read, found, all_ = [], [], len(x)
        for i in range(0, 60_000, 1000):
            s = x @ x[i]
            near = np.argsort(-s)[1:6]
            first = np.isin(own[0], [leaf for _, leaf in forest.search(x[i], rp_forest.FIRST, trees=1)])
            within = rp_forest.REACH * np.sqrt(max(0.0, 2 - 2 * np.sort(s[first])[-6])) / 32**0.5
            walk = forest.search(x[i], within=within)
            assert {(t, int(own[t][i])) for t in range(4)} <= set(walk) and len(set(walk)) == len(walk)
            seen = np.zeros(all_, bool)
            for t in range(4):
                seen |= np.isin(own[t], [leaf for tree, leaf in walk if tree == t])
            read.append(seen.mean())
            found.append(seen[near].mean())
        assert np.mean(found) >= 0.9 and np.mean(read) < 0.25


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    hot = [1.0, 2.0, 0.5]
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(300)]
    odd = [(301, None), (302, []), (303, [0.0, 0.0, 0.0]), (304, [1.0, None, 2.0]), (305, [float("nan"), 1.0, 1.0]), (306, [float("inf"), 1.0, 1.0]), (307, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (350, None)]
    table = spark.createDataFrame([(*r, "k", 0.5) for r in rows + odd + rows[:5]], "id bigint, v array<double>, vec string, score double")
    got = ranked(rp_forest.nearest(table, "id", "v").collect())
    want = brute([r[0] for r in rows], [r[1] for r in rows])
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert [v for v, _ in got[0]] == [3, 6, 9, 12, 15] and [v for v, _ in got[150]] == [0, 3, 6, 9, 12]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5])], "id bigint, v array<double>")
    assert [(r.query_id, r.vec_id) for r in rp_forest.nearest(few, "id", "v").collect()] == [(0, 7)]
    assert rp_forest.nearest(few.limit(0), "id", "v").count() == 0


def test_forest_indexes_every_row_and_finds_it():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = rp_forest.fit(x[:500], 3000, 8, trees=3, leaf=100)
    assert forest.depth == 5
    for t in range(3):
        leaves = forest.leaves(x, t)
        assert leaves.min() >= 0 and leaves.max() < 32 and np.bincount(leaves, minlength=32).max() < 300
    found = forest.search(x[0], 3 * 32)
    assert len(set(found)) == 96
    assert {(t, int(forest.leaves(x[:1], t)[0])) for t in range(3)} <= set(forest.search(x[0], 3))


def test_cache_keeps_what_is_asked_for():
    cache = Cache(10)
    for i in range(100):
        assert cache.get("often") == (1 if i else None)
        cache.put("often", 1) if not i else None
        cache.put(i, i)
        assert len(cache.new) <= 5 and len(cache.old) <= 5
