import numpy as np
import pytest

from tidemark.llm import mixing
from tidemark.llm.bpe import encoder
from tidemark.llm.encoding import vocabulary

DOCS = "doc_id bigint, text string, source string, tokens string, repeats int"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 257, 5000])
def test_permutations(size):
    for key in (0, 7, 123456):
        assert sorted(mixing.permuted(np.arange(size), size, key)) == list(range(size))
        assert mixing.permuted(mixing.permuted(np.arange(size), size, key), size, key, back=True).tolist() == list(range(size))
    if size > 9:
        assert mixing.permuted(np.arange(size), size, 1).tolist() != mixing.permuted(np.arange(size), size, 2).tolist()


def test_shards_keep_totals():
    slots = [5000, 300, 0, 17]
    counts = mixing.shard_counts(0, slots)
    assert counts.sum(axis=0).tolist() == slots and counts.min() >= 0
    assert set(counts.sum(axis=1)[:-1]) == {mixing.SHARD_SLOTS}
    big = np.array(list(mixing.draws([3_000_000_000, 1_000_000_001], mixing.SHARD_SLOTS * mixing.GROUP, 1)))
    assert big.sum(axis=0).tolist() == [3_000_000_000, 1_000_000_001]


def test_large_totals_are_drawn_at_random():
    slots = [3_000_000_000, 1_000_000_000, 0, 500_000_000]
    counts = np.concatenate([mixing.shard_counts(k, g.tolist()) for k, g in zip(range(32), mixing.draws(slots, mixing.SHARD_SLOTS * mixing.GROUP, 1))])
    assert counts.min() >= 0 and len(counts) == 2048
    size, share = counts[0].sum(), np.array(slots) / sum(slots)
    for i in (0, 1, 3):
        # the spread of the draws over the first shards is that of binomials
        assert counts[:, i].std() == pytest.approx(np.sqrt(size * share[i] * (1 - share[i])), rel=0.1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shares_hold_for_any_seed(spark, monkeypatch, seed):
    """Shares come out to within a block or the longest document, also where documents are longer than blocks."""
    monkeypatch.setattr(mixing, "BINS", 4)
    docs = corpus(spark, {"a": (300, 40), "b": (60, 300), "c": (500, 5)})
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, 4)], TARGETS)
    out = mixing.mix(docs, targets, total=20_000, block=64, seed=seed)
    shares = {r.source: r for r in out.shares.collect()}
    for s, longest in (("a", 45), ("b", 310), ("c", 10)):
        assert abs(shares[s].tokens - shares[s].wanted_tokens) <= 64 + longest and shares[s].most_repeats <= shares[s].max_repeats
    assert shares["c"].most_repeats > 1 and all(r.repeats <= 4 for r in out.chosen.collect())


def corpus(spark, sizes):
    rows, k = [], 0
    for source, (n, words) in sizes.items():
        for i in range(n):
            rows.append((k, " ".join(["word"] * (words + i % 5)), source, "x", 0))
            k += 1
    rows += [(k, None, "a", "x", 0), (k + 1, "", "a", "x", 0), (k + 2, "some words", None, "x", 0), (k + 3, "other words", "zz", "x", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    docs = corpus(spark, {"a": (400, 60), "b": (200, 60), "c": (20, 30)})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("none", 0.05, 2)], TARGETS)
    out = mixing.mix(docs, targets, total=30_000, block=128)
    chosen = out.chosen.collect()
    shares = {r.source: r for r in out.shares.collect()}
    coder = encoder(vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({r.doc_id for r in chosen}) == len(chosen)
    for r in chosen:
        assert r.repeats <= {"a": 1, "b": 2, "c": 3}[r.source]
        assert r.tokens == len(coder.piece(b"word")) * len(texts[r.doc_id].split())
    for s in shares.values():
        own = [r for r in chosen if r.source == s.source]
        assert s.tokens == sum(r.tokens * r.repeats for r in own) and s.documents == len(own)
    total = sum(s.tokens for s in shares.values())
    assert all(s.actual_share == pytest.approx(s.tokens / total) for s in shares.values())
    assert shares["a"].tokens == pytest.approx(15_000, rel=0.05) and shares["b"].tokens == pytest.approx(9_000, rel=0.07)
    assert not shares["c"].met and shares["c"].tokens == 3 * shares["c"].available_tokens and shares["c"].most_repeats == 3
    assert not shares["none"].met and shares["none"].tokens == 0
    placed = out.placed.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in placed} == {r.doc_id: r.repeats for r in chosen}
    again = mixing.mix(docs.repartition(3), targets, total=30_000, block=128).chosen.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))


def test_nothing(spark):
    docs = corpus(spark, {})
    targets = spark.createDataFrame([("q", 1.0, 1)], TARGETS)
    out = mixing.mix(docs.limit(0), targets)
    assert out.chosen.count() == 0 and out.shares.first().actual_share == 0.0
    assert mixing.mix(docs, targets.limit(0)).shares.count() == 0
