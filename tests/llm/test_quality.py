"""Quality rules (1) and quality classifier (4)."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from loamgrid.llm import quality_classifier, quality_rules


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_statistics(docs, edge_docs, edge_rows):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for given, frame in ((rows, docs), ([r[:2] for r in edge_rows], edge_docs)):
        got = quality_rules.quality_rules(frame).collect()
        want = []
        for d, t in given:
            n, chars, symbols, dup, repeat = slow_statistics(t)
            want.append((d, n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n))
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality_rules(edge_docs.limit(0)).count() == 0


def test_keep_good_leaves_columns(edge_docs):
    got = quality_rules.keep_good(edge_docs)
    assert got.columns == edge_docs.columns
    assert {r.doc_id for r in got.collect()} == {None, 1, 2, 3, 7, 12}


def numpy_mcd(x):
    """The same estimate for one group, by loops over plain arrays."""
    p = x.shape[1]
    floor = np.array([quality_rules.FLOOR[f] for f in quality_rules.FEATURES])

    def solve(rows, factor):
        m = rows.mean(axis=0)
        cov = factor * ((rows - m).T @ (rows - m)) / len(rows) + np.diag(floor**2)
        return m, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def distance(m, inv):
        return np.einsum("ij,jk,ik->i", x - m, inv, x - m)

    step = floor / 16
    bins = np.floor(x / step)
    at = lambda q: np.array([(np.sort(bins[:, i])[int(np.ceil(q * len(x))) - 1] + 0.5) * step[i] for i in range(p)])
    scale = (at(0.75) - at(0.25)) / 1.349
    starts = [(at(0.5), np.diag(1 / (scale**2 + floor**2))), solve(x, 1.0)[:2]]
    ends = []
    for m, inv in starts:
        det = np.inf
        while True:
            b = np.floor(quality_rules.BINS * np.log2(distance(m, inv) + 2.0**-20))
            values, counts = np.unique(b, return_counts=True)
            before = np.cumsum(counts) - counts
            new = solve(x[np.isin(b, values[before < quality_rules.SUPPORT * len(x)])], quality_rules.consistency(quality_rules.SUPPORT))
            if not new[2] < det - quality_rules.SETTLED:
                break
            m, inv, det = new
        ends.append((det, m, inv))
    det, m, inv = min(ends, key=lambda e: e[0])
    near = x[distance(m, inv) <= quality_rules.chi2_quantile(1 - quality_rules.REWEIGHT, p)]
    m, inv, _ = solve(near, quality_rules.consistency(quality_rules.REWEIGHT))
    return distance(m, inv)


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(3)
    parts = []
    for g, n in (("a", 400), ("b", 250)):
        x = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) + rng.normal(size=5)
        x[: n // 8] += 15 * rng.choice([-1, 1], size=(n // 8, 5))
        parts.append((g, x))
    rows = [(g, *map(float, r)) for g, x in parts for r in x]
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double, x4 double").selectExpr("*", "xxhash64(x0, x1) as id")
    fitted = {r.g: r for r in quality_rules.fit(df).collect()}
    for g, x in parts:
        m, inv = np.array(fitted[g].m), np.array(fitted[g].inv).reshape(5, 5)
        got = np.einsum("ij,jk,ik->i", x - m, inv, x - m)
        np.testing.assert_allclose(got, numpy_mcd(x), rtol=1e-6)
        n = len(x) // 8
        assert np.median(got[:n]) > 10 * np.median(got[n:])


def test_mcd_finds_the_least_determinant(spark):
    """Against all subsets of a small group: outliers are none of those that the estimate rests on."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(16, 5))
    x[:4] += 40
    floor = np.diag([quality_rules.FLOOR[f] ** 2 for f in quality_rules.FEATURES])
    least = min(combinations(range(16), 12), key=lambda c: np.linalg.det(np.cov(x[list(c)].T, bias=True) + floor))
    assert least == tuple(range(4, 16))
    df = spark.createDataFrame([("a", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double, x4 double").selectExpr("*", "xxhash64(x0, x1) as id")
    (got,) = quality_rules.fit(df).collect()
    d = x - np.array(got.m)
    distance = np.einsum("ij,jk,ik->i", d, np.array(got.inv).reshape(5, 5), d)
    assert distance[:4].min() > quality_rules.chi2_quantile(quality_rules.TAIL, 5) > distance[4:].max()
    np.testing.assert_allclose(got.m, x[4:].mean(axis=0), atol=0.5)


def test_groups_of_language_and_source(spark):
    """Pairs of sixty rows have an estimate of their own, smaller ones borrow, and ``fitted`` says so."""
    text = lambda i: " ".join(f"w{(i * 7 + j * j) % 997}" for j in range(60 + i % 40))
    sizes = {("en", "a"): 60, ("en", "b"): 59, ("en", "c"): 30, ("de", "a"): 40, ("fr", "a"): 20, (None, None): 70}
    rows = [(1000 * g + i, text(i), *pair) for g, (pair, n) in enumerate(sizes.items()) for i in range(n)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert Counter((r.doc_id // 1000, r.fitted) for r in got) == {(0, "own"): 60, (1, "lang"): 59, (2, "lang"): 30, (3, "all"): 40, (4, "all"): 20, (5, "own"): 70}
    assert all(r.kept and not r.base_failed for r in got)


def test_chi2():
    assert quality_rules.chi2_quantile(0.05, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.2, 7), 7) == pytest.approx(0.8)
    assert quality_rules.consistency(0.999999) == pytest.approx(1, abs=1e-3)


def test_rules_reject_junk_and_keep_the_rest(big_docs, labels):
    kept = {r.doc_id: r for r in quality_rules.quality_rules(big_docs).collect()}
    good = [kept[r.doc_id] for r in labels.collect() if r.quality == 1 and not kept[r.doc_id].base_failed]
    bad = [kept[r.doc_id] for r in labels.collect() if r.quality == 0]
    assert np.mean([r.kept for r in good]) >= 0.99 and np.mean([r.kept for r in bad]) <= 0.05


def test_joins_beyond_the_broadcast_bound(big_docs, monkeypatch):
    want = {r.doc_id: (r.kept, r.distance) for r in quality_rules.quality_rules(big_docs).collect()}
    plain = quality_rules.join_small
    monkeypatch.setattr(quality_rules, "join_small", lambda *a, **k: plain(*a, **k, limit=0))
    got = {r.doc_id: (r.kept, r.distance) for r in quality_rules.quality_rules(big_docs).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in got)
    assert all(got[k][1] == pytest.approx(want[k][1], rel=1e-6, abs=1e-9) for k in got if want[k][1] is not None)


def test_classifier_on_held_out_rows(big_docs, labels):
    got = {r.doc_id: r for r in quality_classifier.classify(big_docs, labels).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 40
    scores = sorted((g.score, q) for q, g in held)
    ones, zeros = [s for s, q in scores if q], [s for s, q in scores if not q]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > 0.97 and np.mean([g.predicted == q for q, g in held]) > 0.93
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got.values())


def test_held_out_labels_do_not_matter(spark, big_docs, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality_classifier.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality_classifier.classify(big_docs, x).collect()} for x in (labels, flipped))
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_ridge_and_isotonic_against_numpy(spark, big_docs, labels):
    feats = big_docs.select("doc_id", quality_classifier.features("text").alias("f"))
    model = quality_classifier.fit(feats, labels)
    import zlib

    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = [(np.array(r.f), y[r.doc_id]) for r in feats.collect() if r.doc_id in y]
    x, t = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    np.testing.assert_allclose(model.mean, x.mean(axis=0))
    z = model.waves(x)
    beta = np.linalg.solve(z.T @ z / len(x) + quality_classifier.RIDGE / quality_classifier.WAVES * np.eye(z.shape[1]), z.T @ t / len(x))
    np.testing.assert_allclose(model.beta, beta, rtol=1e-5, atol=1e-8)
    assert (np.diff(model.values) >= 0).all() and (np.diff(model.knots) >= 0).all()
    knots, values = quality_classifier._isotonic(np.arange(6.0), np.array([1, 1, 2, 1, 1, 4]), np.array([0, 1, 0, 1, 0, 4.0]))
    assert values.tolist() == pytest.approx([0, 0, 1 / 3, 1 / 3, 0.5, 0.5, 1, 1]) and knots.tolist() == [0, 0, 1, 2, 3, 4, 5, 5]


def test_classifier_edges(spark, edge_docs, edge_rows, labels):
    known = spark.createDataFrame([(1, 1), (3, 1), (12, 1), (9, 0), (11, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    got = quality_classifier.classify(edge_docs, known).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    one = known.where("quality = 1")
    assert all(r.score == pytest.approx(1, abs=2e-3) for r in quality_classifier.classify(edge_docs, one).collect())
    none = quality_classifier.classify(edge_docs, known.limit(0)).collect()
    assert all(r.score == pytest.approx(0.5, abs=2e-3) for r in none)
    assert quality_classifier.classify(edge_docs.limit(0), known).count() == 0
    kept = quality_classifier.keep_good(edge_docs, edge_docs, known)
    assert kept.columns == edge_docs.columns
