"""SimHash near-duplicates (3) and repeated passages (7), with components."""

import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loamgrid.llm import passages, simhash
from loamgrid.llm.components import components
from tests.llm.conftest import CLASH, prose


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, distance=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least: dict = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def check(rows, got):
    fps = [slow_fingerprint(t) for _, t in rows]
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, slow_components(fps, [d for d, _ in rows]))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got)


def test_spark_hash_is_xxh64(spark):
    from pyspark.sql import functions as F

    value = spark.range(1).select(F.xxhash64(F.lit("a b ç d"))).first()[0]
    assert value % (1 << 64) == xxhash.xxh64_intdigest("a b ç d".encode(), 42)


def test_near_duplicates(docs, edge_docs, edge_rows):
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.near_duplicates(docs).collect())
    check([r[:2] for r in edge_rows], simhash.near_duplicates(edge_docs).collect())
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0


def test_every_link_is_found(spark):
    """Fingerprints around few centers, up to 8 bits apart: components as by brute force."""
    rnd = random.Random(8)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        center = rnd.getrandbits(64)
        for _ in range(30):
            fps.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 8))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    pairs = links.collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4 for r in pairs)
    root = {r.node: r.root for r in components(links).collect()}
    got = [root.get(x, x) for x in signed]
    want = slow_components(fps, list(range(len(fps))))
    groups = lambda ls: sorted(map(sorted, ({i for i, x in enumerate(ls) if x == y} for y in set(ls))))
    assert groups(got) == groups(want)


def test_ring_budgets():
    ring = simhash.Ring(4)
    assert ring.budgets == [0, 1, 2, 3, 4] and sum(ring.widths) == 64 and len(ring.tables) == 64
    rnd = random.Random(3)
    for _ in range(300):
        x = np.array([sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))], np.uint64)
        starts = [i for i in range(5) if all(np.bitwise_count(x & np.uint64(ring.chain_mask(i, n)))[0] <= ring.budgets[n - 1] for n in range(1, 6))]
        assert starts
        assert all(ring.passing(i, x)[0] for i in starts)
    with pytest.raises(ValueError):
        simhash.Ring(4, segments=4)


def test_large_bucket_of_unlike_members():
    """Cutting a bucket connects what comparing all its pairs connects, and unlike members cost no square."""
    ring, rng = simhash.Ring(4), np.random.default_rng(7)

    def parts(fps, links):
        up = {int(f): int(f) for f in fps}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in links:
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
        return [root(int(f)) for f in fps]

    for start in range(ring.m):
        first = np.uint64(ring.chain_mask(start, 2))
        free = np.array([b for b in range(64) if not int(first) >> b & 1], np.uint64)
        fps = rng.integers(0, 1 << 64, 1500, dtype=np.uint64) & ~first | np.uint64(0x0123456789ABCDEF) & first
        near = fps[rng.integers(0, len(fps), 1500)]
        for _ in range(4):
            near = near ^ np.uint64(1) << rng.choice(free, len(near))
        dense = fps[0] ^ (np.uint64(1) << free[:, None] | np.uint64(1) << free[None, :]).ravel()
        fps = rng.permutation(np.unique(np.concatenate([fps, near, dense])))
        x = fps[:, None] ^ fps[None, :]
        a, b = np.nonzero(np.triu(np.bitwise_count(x) <= 4, 1))
        ok = ring.passing(start, x[a, b])
        want = parts(fps, [(fps[a[ok]], fps[b[ok]])])
        assert parts(fps, ring.cut(start, fps)) == want
        assert parts(fps, ring.forest(start, fps)) == want
        assert sum(len(a) for a, _ in ring.cut(start, fps)) < 20 * len(fps)
    many = rng.integers(0, 1 << 64, 200_000, dtype=np.uint64) & ~first
    began = time.time()
    ring.forest(ring.m - 1, np.unique(many))
    assert time.time() - began < 60


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    some = [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    edges = chain + star + some + [(7, 7), (5, 200)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if x != 7}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_one(edge_docs):
    got = simhash.keep_one(edge_docs)
    assert got.columns == edge_docs.columns
    ids = sorted((r.doc_id for r in got.collect() if r.doc_id is not None))
    assert ids == sorted({r.component_id for r in simhash.near_duplicates(edge_docs).collect()} - {None})
    assert sum(r.doc_id is None for r in got.collect()) == 2


def test_unlike_texts_under_one_id_are_documents_of_their_own(spark):
    """Groups are of texts, whatever order rows come in: no unlike text goes, no duplicate stays."""
    rnd = random.Random(41)
    a, u, v = (prose(rnd, 120, 10**6) for _ in range(3))
    near = a.split()
    near[60] = "changed"
    cases = [
        ([(3, a), (5, u), (5, a)], [(3, a), (5, u)]),
        ([(5, u), (5, a), (7, a), (9, u)], [(5, a), (5, u)]),
        ([(5, u), (5, a), (5, v), (4, v), (6, u), (7, u)], [(4, v), (5, a), (5, u)]),
        ([(1, None), (1, ""), (2, None), (1, a), (1, a)], None),
    ]
    for rows, want in cases:
        for _ in range(2):
            rnd.shuffle(rows)
            df = spark.createDataFrame(rows, "doc_id bigint, text string")
            check(rows, simhash.near_duplicates(df).collect())
            got = sorted((r.doc_id, r.text or "") for r in simhash.keep_one(df).collect())
            assert got == (want or sorted([(1, ""), (1, a)]))


@pytest.fixture(scope="module")
def planted():
    """(rows, {doc_id: words that must be covered}): passages repeated exactly and nearly."""
    rnd = random.Random(11)
    passage, other = prose(rnd, 60, 10**6).split(), prose(rnd, 55, 10**6).split()
    near = list(passage)
    near[30] = "edited"
    rows, must = [], {}

    def add(doc, *parts):
        words = [w for p in parts for w in p]
        rows.append((doc, " ".join(words)))
        return len(words)

    fill = lambda n: prose(rnd, n, 10**6).split()
    add(1, fill(80), passage, fill(70))
    for doc in range(2, 30):
        k = rnd.randint(0, 90)
        add(doc, fill(k), passage, fill(rnd.randint(0, 60)))
        must[doc] = (k, k + 60)
    add(40, fill(20), near, fill(20))
    must[40] = (20, 80)
    add(41, other, fill(30))
    add(42, fill(200), other)
    must[42] = (200, 255)
    for doc in range(50, 90):
        add(doc, fill(rnd.randint(1, 300)))  # clean
    add(91, fill(60), passage[:40], fill(60))  # too short
    line = fill(12)
    for doc in range(100, 130):
        add(doc, fill(40), line, fill(60))  # a common short line
    return rows, must


def test_repeated_passages(spark, planted):
    rows, must = planted
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = passages.repeated_passages(df).collect()
    words = {d: t.split() for d, t in rows}
    covered: dict = {}
    for r in got:
        assert r.of_doc_id < r.doc_id
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        a, b = words[r.doc_id][r.start_word : r.end_word], words[r.of_doc_id][r.of_start_word : r.of_end_word]
        assert len(a) >= 50
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.8
    assert set(covered) == set(must)
    assert all(set(range(*must[d])) <= covered[d] for d in must)
    cut = {r.doc_id: r.text.split() for r in passages.cut_repeats(df).collect()}
    for d, w in words.items():
        assert cut[d] == [x for i, x in enumerate(w) if i not in covered.get(d, ())]


def test_passages_against_windows_of_fifty(big_docs):
    """Every fifty words that a smaller id holds are covered; every span is as similar as it says."""
    texts = {r.doc_id: r.text.split() for r in big_docs.collect()}
    first, need = {}, {}
    for d in sorted(texts):
        w = texts[d]
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), d) != d:
                need.setdefault(d, set()).update(range(k, k + 50))
    covered: dict = {}
    for r in passages.repeated_passages(big_docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert set(need) <= set(covered)
    assert sum(len(need[d] - covered[d]) for d in need) <= 0.002 * sum(map(len, need.values()))


def test_passages_of_edge_rows(edge_docs, edge_rows):
    got = passages.repeated_passages(edge_docs).collect()
    assert {(r.doc_id, r.of_doc_id) for r in got} == {(2, 1), (3, 1)}
    assert all((r.start_word, r.end_word) == (0, 120) for r in got)
    cut = passages.cut_repeats(edge_docs)
    assert cut.columns == edge_docs.columns and len(CLASH) == len(cut.columns) - 5
    left = sorted(str(r.doc_id) for r in cut.collect())
    assert left == sorted(str(r[0]) for r in edge_rows if r[0] not in (2, 3))
    assert passages.repeated_passages(edge_docs.limit(0)).count() == 0 and passages.cut_repeats(edge_docs.limit(0)).count() == 0


def test_compact_windows():
    rnd = np.random.default_rng(2)
    for n, width in ((1, 1), (40, 5), (200, 46), (10, 20)):
        values = rnd.integers(0, 10**9, n).astype(np.uint64)
        found = list(zip(*passages.compact_windows(values, width)))
        want = {(a, b): a + int(values[a : b + 1].argmin()) for a in range(n) for b in range(a + width - 1, n)}
        for (a, b), c in want.items():
            assert sum(left <= a and b <= right and a <= m <= b for m, left, right in found) == 1
            assert any(m == c and left <= a and b <= right for m, left, right in found)


def test_matching_spans():
    a = np.arange(100, dtype=np.uint64) + np.uint64(1000)
    b = np.concatenate([np.arange(7), a, np.arange(5)]).astype(np.uint64)
    assert passages.matching_spans(a, b, 46, 0.8) == [(0, 100, 7, 107, 1.0)]
    assert passages.matching_spans(a[:30], b, 46, 0.8) == []
    again = np.concatenate([a[:50], np.arange(20, dtype=np.uint64), a[:50]])
    assert {s[:2] for s in passages.matching_spans(again, a, 46, 0.8)} == {(0, 50), (70, 120)}


def test_a_changed_word_anywhere_in_a_passage():
    """Passages of 50, 60 and 100 words with one word changed, at every place, inside other text."""
    rnd = random.Random(21)
    fill = lambda n: prose(rnd, n, 10**6).split()
    for n in (50, 60, 65, 100):
        for k in range(n):
            words = fill(n)
            near = [*words[:k], "edited", *words[k + 1 :]]
            texts = [*fill(70), *words, *fill(70)], [*fill(90), *near, *fill(70)]
            a, b = (passages.tokens(" ".join(t).encode()) for t in texts)
            (a0, a1, b0, b1, rate), *more = passages.matching_spans(a, b, 46, 0.8)
            assert not more and a1 - a0 >= 46 and b1 - b0 >= 46 and rate >= 0.8
            same = [i for i in range(n - 4) if not k - 4 <= i <= k]  # tokens without the changed word
            assert a0 <= 70 + same[0] and a1 > 70 + same[-1] and b0 <= 90 + same[0] and b1 > 90 + same[-1]
            left, right = texts[0][a0 : a1 + 4], texts[1][b0 : b1 + 4]
            grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            assert len(grams(left) & grams(right)) / len(grams(left) | grams(right)) == rate


def test_passages_behind_a_first_document_that_holds_their_tokens(spark):
    """A document of smallest id holds pieces of a passage, too short to repeat it: the later ones still meet."""
    rnd = random.Random(22)
    fill = lambda n: prose(rnd, n, 10**6).split()
    rows, must = [], []
    for k in range(12):
        words = fill(60)
        scattered = [w for i in range(0, 60, 10) for w in [*words[i : i + 14], *fill(60)]]  # every token of it
        near = [*words[:20], "edited", *words[21:]]
        for i, part in enumerate((scattered, [*fill(50), *words, *fill(50)], [*fill(70), *near, *fill(30)])):
            rows.append((1000 * i + k, " ".join(part)))
        must.append((2000 + k, 1000 + k))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = passages.repeated_passages(df).collect()
    assert sorted({(r.doc_id, r.of_doc_id) for r in got}) == must
    assert all(r.start_word <= 70 and r.end_word >= 130 and r.similarity >= 0.8 for r in got)


def test_passages_behind_a_first_document_that_holds_most_of_them(spark):
    """The first document has 30 to 49 of 60 words that two later ones share: all of those meet."""
    rnd = random.Random(23)
    fill = lambda n: prose(rnd, n, 10**6).split()
    for held in (30, 45, 48, 49):
        rows = []
        for k in range(30):
            words = fill(60)
            part = words[:held] if k % 2 else words[-held:]
            for i, own in enumerate((part, words, words)):
                rows.append((1000 * i + k, " ".join([*fill(rnd.randint(0, 80)), *own, *fill(rnd.randint(0, 80))])))
        got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        whole = {(r.doc_id, r.of_doc_id) for r in got if r.end_word - r.start_word >= 60}
        assert whole == {(2000 + k, 1000 + k) for k in range(30)}


def test_passages_that_earlier_documents_hold_in_parts(spark):
    """Earlier documents hold every gram of a passage in overlapping parts of 34 words: the two that
    share all of it meet, in the spans and in the cut of the pipeline."""
    rnd = random.Random(26)
    fill = lambda n: prose(rnd, n, 10**6).split()
    rows, must = [], set()
    for k in range(20):
        n = (50, 55, 60, 90)[k % 4]
        words = fill(n)
        parts = [words[i : i + 34] for i in range(0, n - 27, 6)]
        for i, own in enumerate([*parts, words, words]):
            rows.append((1000 * i + k, " ".join([*fill(rnd.randint(0, 80)), *own, *fill(rnd.randint(0, 80))])))
        must.add((1000 * (len(parts) + 1) + k, 1000 * len(parts) + k, n))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.of_doc_id): r for r in passages.repeated_passages(df).collect()}
    assert all((d, of) in got and got[d, of].end_word - got[d, of].start_word >= n for d, of, n in must)
    assert {of for _, of in got} == {of for _, of, _ in must}
    cut = {r.doc_id: r.text for r in passages.cut_repeats(df).collect()}
    texts = dict(rows)
    assert all(len(cut.get(d, "").split()) <= len(texts[d].split()) - n for d, _, n in must)


@pytest.mark.parametrize("size, step, middle", [(34, 4, True), (28, 3, False), (40, 5, False)])
def test_near_copies_that_earlier_documents_hold_in_parts(spark, size, step, middle):
    """Earlier documents hold all parts of a passage and of its copy with a word changed, doubled or left
    out, none long enough to repeat them: the passage and its copy meet all the same."""
    rnd = random.Random(27)
    fill = lambda n: prose(rnd, n, 10**6).split()
    rows, must = [], set()
    for k in range(24):
        n = (50, 55, 60, 80)[k % 4]
        words, at = fill(n), n // 2 if middle else rnd.randrange(n)
        near = [*words[:at], *(["edited"], ["edited", words[at]], [])[k % 3], *words[at + 1 :]]
        parts = [t[i : i + size] for t in (words, near) for i in range(0, len(t) - size + step, step)]
        for i, own in enumerate([*parts, words, near]):
            rows.append((1000 * i + k, " ".join([*fill(rnd.randint(0, 80)), *own, *fill(rnd.randint(0, 80))])))
        must.add((1000 * (len(parts) + 1) + k, 1000 * len(parts) + k))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.of_doc_id) for r in got} == must and all(r.similarity >= 0.8 for r in got)


def test_windows_are_taken_where_all_their_grams_are_asked():
    """Windows of a shared passage are taken whole, those around a lone shared gram are not."""
    rnd = random.Random(28)
    token = passages.tokens(prose(rnd, 160, 10**6).encode())
    text = prose(random.Random(28), 160, 10**6).encode()
    at, _ = passages.sampled_grams(token, 46)

    def taken(starts):
        batch = pa.RecordBatch.from_pylist([{"doc_id": 7, "text": text, "asked": [{"starts": [int(x)], "held": None} for x in starts]}])
        return sorted(c for b in passages._windows_around(46)(iter([batch])) for c in b.column("c").to_pylist())

    assert taken(at[len(at) // 2 :][:1]) == []
    for first, end in ((40, 100), (0, 46), (100, 156)):  # passages: what is sampled of them alone
        own, _ = passages.sampled_grams(token[first:end], 46)
        got = taken(first + own)
        assert set(range(first, end - 45)) <= set(got) and got[0] > first - 8 and got[-1] < end - 45 + 8


def test_documents_that_part_for_good_make_no_windows_with_a_hole(spark):
    """Documents share thirty words and go on differently: rows are made for near copies alone."""
    rnd = random.Random(29)
    fill = lambda n: prose(rnd, n, 10**6).split()
    shared, tail, words = fill(30), fill(40), fill(60)
    near = [*words[:30], "edited", *words[31:]]
    parts = {1: [*shared, *fill(60)], 2: [*shared, *tail], 3: [*shared, *tail], 4: [*shared, *fill(60)], 5: words, 6: near, 7: words[:40] + fill(9), 8: fill(9) + near[20:]}
    rows = [(d, " ".join([*fill(50), *w, *fill(50)]).encode()) for d, w in parts.items()]
    asked = [(d, passages.sampled_grams(passages.tokens(t), 46)[0].tolist()) for d, t in rows]
    source = spark.createDataFrame(rows, "doc_id bigint, text binary")
    held = spark.createDataFrame([], "doc_id bigint, of bigint, held array<struct<start_word: int, end_word: int>>")
    got = passages._holed_windows(source, spark.createDataFrame(asked, "doc_id bigint, starts array<int>"), held, 46, 0.8).collect()
    of_key: dict = {}
    for r in got:
        of_key.setdefault(r.key, set()).add(r.doc_id)
    assert {5, 6} in of_key.values()
    assert not {r.doc_id for r in got} & {1, 4}


def test_tables_that_nothing_reads_are_dropped(spark, planted):
    """Of the tables in between only those are left that the result reads."""
    df = spark.createDataFrame(planted[0], "doc_id bigint, text string")
    root = Path(passages.common.shared_root(spark).removeprefix("file:"))
    before = {p.name for p in root.iterdir()}
    passages.repeated_passages(df)
    left = {p.name.split("-", 1)[0] for p in root.iterdir() if p.name not in before and any(p.rglob("*.parquet"))}
    assert "passages" in left and not left & {"window", "grams", "wanted", "runs", "parted", "hole"}
    assert spark.conf.get(passages._CLEANUP) == "false"


def test_long_repetitive_texts_compare_in_linear_time():
    rnd = random.Random(24)
    line = prose(rnd, 10, 10**6)
    tokens = passages.tokens(" ".join([line] * 20_000).encode())
    start = time.process_time()
    spans = passages.matching_spans(tokens, tokens[7:], 46, 0.8)
    assert time.process_time() - start < 20
    assert set().union(*(range(s[0], s[1]) for s in spans)) == set(range(len(tokens)))


def test_every_equal_gram_is_covered():
    """Sentences dealt anew: whatever 46 tokens of one text the other holds lie in a span."""
    rnd = random.Random(25)
    for _ in range(20):
        sentences = [prose(rnd, rnd.randint(8, 70), 10**6) for _ in range(12)]
        a, b = (passages.tokens(" ".join(rnd.choice(sentences) for _ in range(60)).encode()) for _ in range(2))
        covered = np.zeros(len(a), bool)
        for first, end, of_first, of_end, rate in passages.matching_spans(a, b, 46, 0.8):
            covered[first:end] = True
            assert rate < 1 or (a[first:end] == b[of_first:of_end]).all()
        held = {b[i : i + 46].tobytes() for i in range(len(b) - 45)}
        assert all(covered[i : i + 46].all() for i in range(len(a) - 45) if a[i : i + 46].tobytes() in held)


def test_sampled_grams():
    rnd = np.random.default_rng(3)
    for n in (46, 47, 300):
        token = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        at, key = passages.sampled_grams(token, 46)
        h = [passages.sampled_grams(token[i : i + 46], 46) for i in range(n - 45)]
        assert set(at.tolist()) == {i + int(x) for i, (own, _) in enumerate(h) for x in own} and len(set(key.tolist())) == len(at)
        assert all(any(i <= x < i + 12 for x in at) for i in range(n - 34))
    same = np.full(60, 7, np.uint64)
    assert len(set(passages.sampled_grams(same, 46)[1].tolist())) == 1


@pytest.mark.parametrize("rows, ids", [(0, 0), (0, 10**6), (10**6, 10**6)])
def test_cut_repeats_by_any_join(spark, monkeypatch, rows, ids):
    """Spans reach their texts by a broadcast, by broadcast ids or by a plain join, with one result."""
    monkeypatch.setattr(passages, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(passages, "ID_ROWS", ids)
    words = prose(random.Random(5), 400)
    words = words.split() if isinstance(words, str) else list(words)
    shared = " ".join(words[:70])
    table = [(1, f"{shared} first"), (2, f"{' '.join(words[100:130])} {shared} second"), (3, " ".join(words[200:300])), (4, None), (None, shared)]
    got = passages.cut_repeats(spark.createDataFrame(table, "doc_id bigint, text string"))
    kept = {r.doc_id: r.text for r in got.collect()}
    assert len(kept) == 5 and kept[1] == table[0][1] and kept[3] == table[2][1] and kept[4] is None and kept[None] == shared
    assert kept[2] == f"{' '.join(words[100:130])} second"
