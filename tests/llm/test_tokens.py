"""Token operators: prefix counts (2), training order (5), BPE codec (8), packing (10)."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loamgrid.llm import bpe_codec, packing, prefix_tokens, training_order
from loamgrid.llm.word_ids import WordIds

PIECE, WORD, RANKS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
ODD = [
    "", " ", "  ", "a  b", "   x  ", "trail ", "\n\n a\n", "\t\ttab \t", "▁▁x▁ y", "日本語 テスト １２３ ½", "<s> </s> <unk> <0x0A>", "🙂🙂!!", "x" * 700, "\x00a\x01 b", "é é", "\r\n  \r\n", "aaaaaaaa" * 20 + " " * 40 + "z", "#" * 500,
    "a\x1cb !\x1d! x", "<|endoftext|>hi<|startoftext|>", "<|end", "İstanbul ΑΣ Σ", "it's we'll I'D 'S a'sb", " 　a\x85b\xa0c", "a​b﻿", "𝔘𝔫𝔦", "ﬁ Ⅷ ǅ", "don't.can't", "x²y ¾ ª º µ ÀÖØÞß",
]


@pytest.fixture(scope="module")
def texts(docs):
    return ODD + [r.text for r in docs.collect()[:120]]


def test_prefix_counts_equal_the_library(texts):
    own, library = prefix_tokens.PrefixCounter(PIECE, cache_entries=2000), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for t in texts:
        assert own.count(t, 10**9)[0] == len(library.encode(t)), t[:80]
    rnd = random.Random(2)
    for t in ODD + [x[:200] for x in rnd.sample(texts, 15)]:
        counts = own.prefix_counts(t)
        assert counts.tolist() == [len(library.encode(t[:i])) for i in range(1, len(t) + 1)]
        for budget in (0, 1, 7, 40):
            assert own.count(t, budget)[1] == max([0, *(i + 1 for i, c in enumerate(counts) if c <= budget)])


def test_prefix_counts_of_edge_rows(spark, edge_docs, edge_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = prefix_tokens.count_tokens(edge_docs, PIECE, prefixes=True).collect()
    assert len(got) == len(edge_rows)
    for (doc, text, *_), r in zip(edge_rows, got):
        n = len(library.encode(text or ""))
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (doc, len((text or "").encode()), n, n > 4096)
        assert (r.prefix_tokens[-1] if text else 0) == n and len(r.prefix_tokens) == len(text or "")
    assert prefix_tokens.count_tokens(edge_docs.limit(0), PIECE).count() == 0


def test_codec_equals_the_library(texts):
    own, library = bpe_codec.WordBpe(WORD, cache_entries=500), Tokenizer.from_file(WORD)
    fast = WordIds(WORD, cache_entries=500)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t[:80]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(fast.text(t), "<u4").tolist() == ids, t[:80]


def test_long_and_short_words_merge_alike():
    own, rnd = bpe_codec.WordBpe(WORD), random.Random(1)
    for n in (1, 2, 5, 60, 199):
        raw = bytes(rnd.choice(b"aeinrst!") for _ in range(n))
        start = [own.inner[b] for b in raw[:-1]] + [own.final[raw[-1]]]
        ids, bounds = own.merge_ranks(list(start))
        assert ids == own.merge_long(list(start)) and bounds[0] == 0 and sorted(set(bounds)) == bounds and len(bounds) == len(ids)


def test_codec_of_edge_rows(edge_docs, edge_rows):
    library = Tokenizer.from_file(WORD)
    got = bpe_codec.encode_texts(edge_docs, WORD, ids=True).collect()
    for (doc, text, *_), r in zip(edge_rows, got, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (doc, len(ids), ids, back)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe_codec.encode_texts(edge_docs.limit(0), WORD).count() == 0


def test_best_fit():
    rnd = random.Random(6)
    for capacity in (1, 10, 100):
        sizes = [rnd.randint(1, capacity) for _ in range(300)]
        bins = packing.best_fit(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
        # best-fit decreasing by plain search
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms[rooms.index(min(fits))] -= s
            else:
                rooms.append(capacity - s)
        assert len(rooms) == len(bins)


def check_packing(rows, got, capacity):
    library = Tokenizer.from_file(WORD)
    want = []
    for doc, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in got) // capacity)


def test_packing(docs, edge_docs, edge_rows):
    n, least = check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack_documents(docs, WORD).collect(), 2048)
    assert n <= least + 1
    check_packing([r[:2] for r in edge_rows], packing.pack_documents(edge_docs, WORD, capacity=50).collect(), 50)
    assert packing.pack_documents(edge_docs.limit(0), WORD).count() == 0


def test_packing_up_the_tree(docs, monkeypatch):
    dealt = docs.repartition(20)
    n, least = check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack_documents(dealt, WORD).collect(), 2048)
    assert n <= 1.02 * least + 2
    monkeypatch.setattr(packing, "CHUNK_ITEMS", 30)  # many small packing calls
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack_documents(dealt, WORD).collect(), 2048)


def test_permutation():
    for n in (1, 2, 3, 10, 255, 256, 257, 5000):
        p = training_order.Permutation(n, key=n)
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.number(slots) == np.arange(n)).all()
    a, b = (training_order.Permutation(1000, k).slot(np.arange(1000)) for k in (1, 2))
    assert (a != b).mean() > 0.9


def test_training_order(spark, edge_docs, edge_rows, tmp_path):
    encoder, end = training_order.encoder(RANKS, public_tokenizers.PATTERN)
    folder = f"file://{tmp_path}/shards"
    manifest = training_order.write_shards(edge_docs, folder, RANKS, public_tokenizers.PATTERN, length=64, shard_slots=100)
    got = training_order.read_shards(manifest).collect()
    want = []
    for doc, text, *_ in edge_rows:
        ids = np.array(encoder.encode_ordinary(text or "") + [end], "<u2")
        want += [(doc, k // 64, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.length, r.ids_crc32)) for r in got)
    assert sorted(r.slot for r in got) == list(range(len(want)))
    assert {r.records for r in manifest.collect()} <= {100, len(want) % 100}
    # a reader resumes inside a shard, and slots follow from the key alone
    path = sorted(r.path for r in manifest.collect())[1]
    at, rows = next(iter(training_order.read_shard(path, start=37)))
    by_slot = {r.slot: r for r in got}
    assert at == 137 and [by_slot[at + i].piece for i in range(5)] == rows["piece"][:5].tolist()
    assert training_order.training_order(edge_docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


RUNS = ["\n\n\n a  b\n", "a\n b \nc", "x\u3000y \u2028z", " lead", "a \x1c b \x1fc", "\x1c", " \x1d", "it's  they'll\t'd ", "\n" * 300 + "a" + " " * 90 + "\n" * 70 + "b c", "tail  ", "w" * 100 + "\n" * 100 + "v w", "a\u200bb \u180e c", "\r\n \r\nq"]


@pytest.mark.parametrize("spaced", [True, False])
def test_rank_ids_equal_the_library(texts, spaced, monkeypatch):
    if not spaced:
        monkeypatch.setattr(training_order, "SPACED_PATTERN", "another")
    own = training_order.RankIds(RANKS, public_tokenizers.PATTERN)
    assert own.spaced == spaced
    rnd = random.Random(31)
    mixed = ["".join(rnd.choice(["a", "Bc", "9", "'s", ",", " ", "  ", "\n", "\t", "\x1e", "\xa0", "\u3000", "é日"]) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for t in [*texts, *RUNS, *mixed]:
        ids = own.library.encode_ordinary(t)
        assert own.text(t).tolist() == ids and own.by_chunks(t).tolist() == ids, t[:80]


def test_rank_ids_of_endless_runs():
    """A million of one sign in a row: white space beyond what the library's pattern bears, and others."""
    own = training_order.RankIds(RANKS, public_tokenizers.PATTERN)
    for sign in " \n\u3000a9#":
        text = f"b {sign * 1_000_000}c"
        ids = own.text(text).tolist()
        assert own.library.decode(ids) == text
    n = 100_000  # what the library still bears
    assert own.text("b" + " " * n + "c").tolist() == own.library.encode_ordinary("b" + " " * n + "c")


def test_slots_follow_from_task_place_and_key(spark, tmp_path):
    """Every sequence lies at the slot that the permutation gives its number: tasks in turn, rows in turn."""
    docs = spark.createDataFrame([(i, " ".join(["word"] * (i % 40))) for i in range(400)], "doc_id bigint, text string").repartition(5).cache()
    encoder, end = training_order.encoder(RANKS, public_tokenizers.PATTERN)
    numbered = []
    for part in docs.rdd.glom().collect():
        for r in part:
            n = len(encoder.encode_ordinary(r.text)) + 1
            numbered += [(r.doc_id, k) for k in range(-(-n // 8))]
    manifest = training_order.write_shards(docs, f"file://{tmp_path}/s", RANKS, public_tokenizers.PATTERN, length=8, shard_slots=64, key=99)
    got = {(r.doc_id, r.piece): r.slot for r in training_order.read_shards(manifest).collect()}
    slots = training_order.Permutation(len(numbered), 99).slot(np.arange(len(numbered)))
    assert got == dict(zip(numbered, slots.tolist()))
    assert [r.first_slot for r in manifest.orderBy("path").collect()] == list(range(0, len(numbered), 64))
    docs.unpersist()


def test_budgets_from_the_stored_table(spark, edge_docs, edge_rows):
    """Any budget is answered from the written counts, without the text."""
    table = prefix_tokens.prefix_table(edge_docs, PIECE).cache()
    assert "text" not in table.columns
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for limit in (0, 1, 30, 200):
        for (_, text, *_), r in zip(edge_rows, prefix_tokens.fit_budget(table, limit).collect(), strict=True):
            text = text or ""
            counts = prefix_tokens.counts_of(r.steps)
            assert len(counts) == len(text) == r.n_chars and r.over_limit == (r.n_tokens > limit)
            assert r.fit_chars == max([0, *(i + 1 for i, c in enumerate(counts) if c <= limit)])
            assert len(library.encode(text[: r.fit_chars])) <= limit
    table.unpersist()


def test_memos_of_prefix_counts_fit_beside_an_executor(docs):
    """All memos of a worker, full: under 350 MB, by what an entry takes on words of the test table."""
    own = prefix_tokens.PrefixCounter(PIECE)
    texts = [r.text or "" for r in docs.collect()]
    tracemalloc.start()
    for t in texts:
        own.text_steps(t)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    entries = sum(len(c.new) + len(c.old) for c in (own.states, own.totals)) + len(own.pairs)
    assert held / entries * (2 * (own.states.limit + own.totals.limit) + prefix_tokens.PAIR_ENTRIES) < 350e6


def test_prefixes_of_a_unit_are_walked_once(monkeypatch):
    own, calls = prefix_tokens.PrefixCounter(PIECE), []
    want = own.unit("▁incontrovertible")
    state = own._state
    monkeypatch.setattr(own, "_state", lambda *x: calls.append(x) or state(*x))
    assert own.unit("▁incontrovertible") == want and len(calls) == 1


def test_packing_takes_one_worker_a_task(docs, monkeypatch):
    """Cutting and packing share a worker: each worker keeps the tables of the encoder for good."""
    plans, settle = [], packing.settle
    monkeypatch.setattr(packing, "settle", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, name))
    packing.pack_documents(docs, WORD)
    assert plans[0].count("MapInArrow") == 1
