"""Mixing sources to target weights.

Tokens of a source are packed into blocks of fixed length. The slots of the
output shards are drawn for the sources by multinomial draws, every slot is
mapped to a block by a pseudorandom permutation of the source's block
numbers, and slots and blocks are joined by number. The draws go down a tree
over the shards: at each node the left half draws its counts in proportion to
what the node has, the right half has the rest. So the totals of the sources
come out exactly, neither a share nor a cap is missed by chance, and every
shard finds its counts and its first ordinals by itself, by as many draws as
the tree is deep, at every size alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.session import durable, width

#: The weights are collected: a row of them is a source that someone weighted by hand. More of them raise an error.
MOST_SOURCES = 1_000_000
SLOTS = "shard bigint, slot int, source string, epoch int, block bigint"
BLOCKS = "source string, block bigint, n_tokens int, ids array<int>"


def source_name(c):
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def weights_of(weights: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, most repeats). Repeated sources: the greatest row counts; null, negative and NaN shares and repeats are 0."""
    rows = weights.select(source_name(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("m")).where(F.col("s").isNotNull()).groupBy("s").agg(F.max(F.struct("w", "m")).alias("x")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    clean = lambda v: 0 if v is None or v != v or v < 0 else v
    return {r.s: (float(clean(r.x.w)), int(clean(r.x.m))) for r in sorted(rows, key=lambda r: r.s)}


def fill(shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Parts of ``total`` in proportion to ``shares``, none over its cap; what a capped source can't give goes to the others in proportion."""
    out, free = {s: 0.0 for s in shares}, {s for s in shares if shares[s] > 0 and caps.get(s, 0) > 0}
    left = min(total, sum(caps[s] for s in free))
    while free and left > 1e-9:
        unit = left / sum(shares[s] for s in free)
        full = {s for s in free if shares[s] * unit >= caps[s]}
        if not full:
            return out | {s: shares[s] * unit for s in free}
        for s in full:
            out[s] = caps[s]
            left -= caps[s]
        free -= full
    return out


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), applied to ``x``: a Feistel network, walked until it falls below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), x.astype(np.uint64)
    keys = np.random.default_rng(seed).integers(0, 2**63, 4, dtype=np.uint64) | np.uint64(1)

    def once(v):
        a, b = v >> np.uint64(half), v & mask
        for k in keys:
            h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * k
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        return a << np.uint64(half) | b

    x = once(x)
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def draw(counts: np.ndarray, n: int, seed) -> np.ndarray:
    """``n`` of the slots in ``counts``, multinomial in their proportions; what exceeds a count is drawn again among the others."""
    rng, out, room = np.random.default_rng(seed), np.zeros_like(counts), counts.copy()
    while n > 0:
        p = room / room.sum()
        got = np.minimum(rng.multinomial(n, p / max(1.0, p.sum())), room)
        if not got.any():  # what is left is less than the draws can tell apart
            got[np.argmax(room)] = min(n, room.max())
        out, room, n = out + got, room - got, n - int(got.sum())
    return out


def dealt(counts: np.ndarray, size: int, seed: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the shard, slots of each source in the shards before), of shards of ``size`` slots."""
    total = int(counts.sum())
    low, high, before = 0, -(-total // size), np.zeros_like(counts)
    while high - low > 1:
        middle = (low + high) // 2
        left = draw(counts, (middle - low) * size, [seed, low, high])
        if shard < middle:
            counts, high = left, middle
        else:
            counts, before, low = counts - left, before + left, middle
    return counts, before


class Mixture:
    """``documents`` (text, source, doc_id) mixed to ``weights`` (source, target_share, max_repeats).

    length: tokens of a block (the last block of a bucket of a source may be
    shorter); total: tokens wanted, by default as many as the usable sources
    hold, "exact" for the most at which no source with documents falls short of
    its share of them; shard: slots of an output shard. Sources are matched without outer
    blanks and case. Documents whose source is null or not listed, and sources
    with share or repeats of 0, are not used; null and empty texts have no
    tokens. A block is used at most max_repeats times. If no source can be
    used, the mixture is empty. Needs: a source's tokens are split into
    buckets of about ``bucket`` tokens, so no source, however large, is packed
    by one task.
    """

    def __init__(self, documents: DataFrame, weights: DataFrame, length: int = 256, total: int | str | None = None, shard: int = 4096, bucket: int = 1_000_000, seed: int = 7, path: str = bpe.VOCABULARY):
        self.spark, self.length, self.shard, self.seed = documents.sparkSession, length, shard, seed
        self.weights = weights_of(weights)
        usable = [(s,) for s, (w, m) in self.weights.items() if w > 0 and m > 0]
        listed = self.spark.createDataFrame(usable, "source string")
        rows = documents.select("doc_id", "text", source_name(F.col("source")).alias("source")).where(F.length("text") > 0).join(F.broadcast(listed), "source", "left_semi")  # at most MOST_SOURCES names
        self.docs = durable(bpe.encode(rows, path=path, keep=("doc_id", "source")).withColumn("n", F.size("ids")))
        self.tokens = {r.source: r.n for r in self.docs.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # no more rows than weights
        buckets = self.spark.createDataFrame([(s, max(1, n // bucket)) for s, n in self.tokens.items()], "source string, __buckets bigint")
        self.placed = self.docs.join(F.broadcast(buckets), "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "ids"), F.col("__buckets"))).drop("__buckets")
        sums = durable(self.placed.groupBy("source", "bucket").agg(F.sum("n").alias("n"), F.ceil(F.sum("n") / length).alias("blocks")))
        from pyspark.sql import Window

        self.first = sums.withColumn("first", F.sum("blocks").over(Window.partitionBy("source").orderBy("bucket")) - F.col("blocks")).select("source", "bucket", "first")
        self.n_blocks = {r.source: r.b for r in sums.groupBy("source").agg(F.sum("blocks").alias("b")).collect()}
        usable_share = sum(self.weights[s][0] for s in self.n_blocks)
        if total == "exact":
            wanted = min((self.tokens[s] * self.weights[s][1] / self.weights[s][0] * usable_share for s in self.n_blocks), default=0)
        else:
            wanted = sum(self.tokens.values()) if total is None else total
        mean = {s: self.tokens[s] / self.n_blocks[s] for s in self.n_blocks}
        share = {s: self.weights[s][0] for s in self.n_blocks}
        parts = fill(share, {s: self.tokens[s] * self.weights[s][1] for s in self.n_blocks}, wanted)
        self.slots_of = {s: min(self.n_blocks[s] * self.weights[s][1], round(parts[s] / mean[s])) for s in sorted(parts)}

    def blocks(self) -> DataFrame:
        length = self.length

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, number, held = None, 0, np.empty(0, np.int32)
            out: list = []

            def cut(last: bool):
                nonlocal held, number
                k = 0
                while len(held) - k >= length or (last and k < len(held)):
                    out.append((at[0], number, held[k : k + length]))
                    number, k = number + 1, k + length
                held = held[k:]

            def flush():
                ids = [x[2] for x in out]
                batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([len(x) for x in ids], pa.int32()), bpe.lists([x.tobytes() for x in ids])], ["source", "block", "n_tokens", "ids"])
                out.clear()
                return batch

            for b in batches:
                sources, buckets, firsts, ids = b.column("source").to_pylist(), b.column("bucket").to_pylist(), b.column("first").to_pylist(), b.column("ids")
                values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                waiting = []
                for i, key in enumerate(zip(sources, buckets)):
                    if key != at:
                        held = np.concatenate([held, *waiting])
                        waiting = []
                        if at is not None:
                            cut(True)
                        at, number = key, firsts[i]
                    waiting.append(values[offsets[i] : offsets[i + 1]])
                held = np.concatenate([held, *waiting])
                cut(False)
                if out:
                    yield flush()
            if at is not None:
                cut(True)
            if out:
                yield flush()

        rows = self.placed.join(self.first, ["source", "bucket"]).select("source", "bucket", "first", "doc_id", "ids")
        return rows.repartition(width(self.spark), "source", "bucket").sortWithinPartitions("source", "bucket", "doc_id", F.xxhash64("ids")).drop("doc_id").mapInArrow(pack, BLOCKS)

    def slots(self) -> DataFrame:
        names = [s for s, n in self.slots_of.items() if n > 0]
        counts = np.array([self.slots_of[s] for s in names], np.int64)
        if not names:
            return self.spark.createDataFrame([], SLOTS)
        shard, seed, n_blocks = self.shard, self.seed, [self.n_blocks[s] for s in names]

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for k in map(int, f["id"]):
                    mine, begin = dealt(counts, shard, seed, k)
                    which = np.repeat(np.arange(len(names)), mine)
                    ordinal = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(mine) - mine, mine)
                    block, epoch = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
                    ends = np.cumsum(mine)
                    for s in np.flatnonzero(mine):
                        here = slice(ends[s] - mine[s], ends[s])
                        epoch[here] = ordinal[here] // n_blocks[s]
                        for e in np.unique(epoch[here]):
                            at = np.flatnonzero(epoch[here] == e) + here.start
                            block[at] = permute(ordinal[at] % n_blocks[s], n_blocks[s], seed * 1_000_003 + int(s) * 1009 + int(e))
                    order = np.random.default_rng([seed, k]).permutation(len(which))
                    yield pd.DataFrame({"shard": k, "slot": np.arange(len(which), dtype=np.int32), "source": np.array(names, object)[which[order]], "epoch": epoch[order].astype(np.int32), "block": block[order]})

        return self.spark.range(0, -(-int(counts.sum()) // shard), 1, width(self.spark)).mapInPandas(deal, SLOTS)

    def rows(self) -> DataFrame:
        """shard, slot, source, epoch, block, n_tokens, ids: the mixture itself."""
        return self.slots().hint("merge").join(self.blocks(), ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "n_tokens", "ids")

    def shares(self, mixed: DataFrame | None = None) -> DataFrame:
        """Of every listed source: target_share, max_repeats, tokens it has and gives, actual_share, most_used (how often a block is used at most)."""
        if mixed is None:
            mixed = self.slots().hint("merge").join(self.blocks().drop("ids"), ["source", "block"])
        used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), (F.max("epoch") + 1).alias("most_used"))
        listed = self.spark.createDataFrame([(s, w, m, int(self.tokens.get(s, 0))) for s, (w, m) in self.weights.items()], "source string, target_share double, max_repeats int, source_tokens bigint")
        joined = listed.join(used, "source", "left").na.fill(0, ["used_tokens", "most_used"])
        total = used.agg(F.sum("used_tokens").alias("total"))
        return joined.join(F.broadcast(total)).withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0))).drop("total")
