"""Byte-level BPE against the tiktoken library; packing against all choices of boundaries."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hiremill.llm import bpe, packing
from tests.llm.samples import documents, rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_is_the_librarys(ranks, library):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    pool = "".join(map(chr, range(1, 0x250))) + " 　\x85\x1c日本語😀é"
    texts = ["".join(rng.choice(pool if i % 2 else "aab'ts  \n\t1l") for _ in range(rng.randint(0, 60))) for i in range(600)]
    texts += ["a" * 5000, "ab" * 3000, " " * 3000, "don't've 'tis", "".join(rng.choice("abc") for _ in range(200)), None, ""]
    for text, packed in zip(texts, codec.encode_all(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text or "")
        assert codec.decode(packed) == (text or "").encode()


def test_both_trees_agree(ranks):
    pairs = bpe.PairRanks(ranks)
    rng = random.Random(5)
    for size in (2, 4, 8, 16, 32, 64):
        pieces = ["".join(rng.choice("theraionég ") for _ in range(rng.randint(1, size))).encode()[:size] for _ in range(200)]
        pieces = [p for p in pieces if len(p) > 1]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_pieces(pieces, size, pairs)] == [bpe.merge_piece(p, ranks) for p in pieces]


def test_small_store_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "TOGETHER_CHARS", 40)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = [r[1] for r in rows()]
    for text, packed in zip(texts, codec.encode_all(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text or "")


def test_digests_and_round_trip(spark, library):
    docs = documents(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for r in rows():
        ids = np.asarray(library.encode_ordinary(r[1] or ""), "<u4")
        want.append((r[0] is None, r[0] or 0, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == [*[c for c in docs.columns if c != "ids"], "ids"]
    back = bpe.decode_ids(encoded.withColumnRenamed("text", "was"), PATH)
    assert back.where("coalesce(was, '') <> text").count() == 0 and back.count() == len(rows())
    assert bpe.token_digests(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        lengths, counts = rng.choice(40, n, replace=False) + 1, rng.integers(1, 6, n)
        cost = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts))  # noqa: B023, E731
        top = int(max(lengths))
        others = [int(x) for x in lengths if x != top]
        best = min(cost([*chosen, top]) for size in range(min(k, n)) for chosen in itertools.combinations(others, size))
        plan = packing.plan_buckets(lengths, counts, k)
        assert plan.padding == best == cost(plan.bounds) and len(plan.bounds) <= k and sum(plan.rows) == counts.sum()


def test_pack_places_every_row_once(spark):
    docs = documents(spark)
    got = packing.pack(docs, packing.word_length(), buckets=4, batch_tokens=300, slice_rows=5).collect()
    assert len(got) == len(rows())
    assert len({(r.batch_id, r.position) for r in got}) == len(got)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        batches.setdefault(r.batch_id, []).append(r)
    for members in batches.values():
        assert len({m.bucket for m in members}) == 1
        assert len(members) == 1 or sum(m.bucket_tokens for m in members) <= 300
    words = {r[0]: len((r[1] or "").split()) for r in rows() if r[0] is not None}
    assert all(r.n_tokens == words[r.doc_id] for r in got if r.doc_id is not None)
    assert packing.pack(documents(spark, []), packing.word_length()).count() == 0


def test_pack_is_optimal_over_more_than_2048_lengths(spark):
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.choice(20_000, 2_500, replace=False)) + 1
    rows = [(i, int(n)) for i, n in enumerate(np.repeat(lengths, rng.integers(1, 8, len(lengths))))]
    x, c = np.unique([n for _, n in rows], return_counts=True)
    count, total = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(c * x))
    cost = x[None, :] * (count[None, 1:] - count[:-1, None]) - (total[None, 1:] - total[:-1, None])
    cost[np.tril_indices(len(x), -1)] = 1 << 60
    best = cost[0]
    for _ in range(15):
        best = np.minimum(best, (np.append(0, best[:-1])[:, None] + cost).min(0))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), packing.F.col("n")).collect()
    assert len(got) == len(rows) and len({r.bucket for r in got}) == 16
    assert sum(r.bucket_tokens - r.n_tokens for r in got) == best[-1]
    plan = packing.plan_buckets(x, c, 16)
    assert plan.padding == best[-1] and sum(plan.rows) == len(rows)
