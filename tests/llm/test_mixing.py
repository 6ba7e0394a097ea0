import numpy as np
from pyspark.sql import functions as F

from quern.llm import bpe, mixing


def test_fill():
    assert mixing.fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 1000}, 100) == {"a": 10, "b": 90}
    assert mixing.fill({"a": 0.5, "b": 0.0}, {"a": 10, "b": 1000}, 100) == {"a": 10, "b": 0.0}
    assert mixing.fill({}, {}, 5) == {}
    got = mixing.fill({"a": 1, "b": 2, "c": 1}, {"a": 1000, "b": 1000, "c": 1000}, 100)
    assert got == {"a": 25, "b": 50, "c": 25}


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))


def test_draws_are_exact_in_all_and_random_in_each():
    """At sizes on both sides of 900 million slots: totals come out, shards are full, seeds differ, ordinals follow each other."""
    for counts, size in (([10, 0, 90], 7), ([3 * 10**5, 10**6, 7], 4096), ([10**9, 4 * 10**9, 0, 12_345], 500_000_001), ([2**61, 2**60], 2**59)):
        counts = np.array(counts, np.int64)
        shards = -(-int(counts.sum()) // size)
        rows = [mixing.dealt(counts, size, 3, k) for k in range(shards)]
        assert np.array_equal(sum(c for c, _ in rows), counts) and all(int(c.sum()) == size for c, _ in rows[:-1])
        assert np.array_equal(np.cumsum([c for c, _ in rows], axis=0)[:-1], [b for _, b in rows[1:]]) or shards == 1
        assert any(not np.array_equal(mixing.dealt(counts, size, 4, k)[0], c) for k, (c, _) in enumerate(rows))
        expected = counts / counts.sum() * size
        assert all(np.all(np.abs(c - expected) <= 8 * np.sqrt(expected) + 8) for c, _ in rows[:-1])


def mixture(spark, **kw):
    rows = [(i, f"word{i} " * (3 + i % 40), " Big " if i % 3 else "small") for i in range(300)] + [(900, "x y z", None), (901, None, "big"), (902, "", "big"), (903, "no weight", "other"), (904, "never", "zero")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("ids", F.lit(1)).withColumn("n", F.lit(1))
    w = spark.createDataFrame([("big", 0.5, 3), ("Small ", 0.4, 2), ("none", 0.1, 4), ("zero", 0.5, 0), (None, 1.0, 1)], "source string, target_share double, max_repeats int")
    return docs, mixing.Mixture(docs, w, length=32, shard=16, bucket=1500, **kw)


def test_blocks_hold_every_token_once(spark):
    docs, m = mixture(spark)
    for s in ("big", "small"):
        want = sorted(x for r in m.docs.where(F.col("source") == s).collect() for x in r.ids)
        blocks = m.blocks().where(F.col("source") == s).collect()
        assert sorted(x for b in blocks for x in b.ids) == want
        assert sorted(b.block for b in blocks) == list(range(m.n_blocks[s]))
        assert all(len(b.ids) == b.n_tokens <= 32 for b in blocks)


def test_shares_and_caps(spark):
    _, m = mixture(spark, total=4000)
    rows = m.rows().collect()
    assert len(rows) == len({(r.shard, r.slot) for r in rows}) == sum(m.slots_of.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, m.rows().collect()))
    shares = {r.source: r for r in m.shares().collect()}
    assert set(shares) == {"big", "small", "none", "zero"}
    assert abs(shares["big"].actual_share - 0.5 / 0.9) < 0.02 and shares["zero"].used_tokens == 0
    _, m = mixture(spark, total=10**9)
    shares = {r.source: r for r in m.shares().collect()}
    assert shares["big"].used_tokens == 3 * shares["big"].source_tokens and shares["small"].most_used == 2


def test_exact(spark):
    _, m = mixture(spark, total="exact")
    got = {r.source: r.actual_share for r in m.shares().collect()}
    assert abs(got["big"] - 0.5 / 0.9) < 0.01 and abs(got["small"] - 0.4 / 0.9) < 0.01


def test_empty(spark):
    docs, m = mixture(spark)
    w = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.Mixture(docs, w).rows().count() == 0 and mixing.Mixture(docs, w).shares().count() == 0
    w = spark.createDataFrame([("big", 0.5, 3)], "source string, target_share double, max_repeats int")
    e = mixing.Mixture(docs.limit(0), w)
    assert e.rows().count() == 0 and e.shares().first().actual_share == 0
