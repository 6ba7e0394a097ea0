"""Near-duplicate contents by a token-group matrix.

The tokens of a document are its distinct runs of ``k`` words. Documents that
agree in their least hash form a group (split when it gets large). All
documents order their tokens alike, rare ones first, so that of two documents
that are alike enough the first tokens of the one and of the other must meet.
The matrix holds, for each group, the union of its members' first tokens; a
query document meets a group if one of its own first tokens is in that union.
Only groups that are met are opened: there the whole union of the members'
tokens bounds the overlap once more, and members are compared only if that
bound is reached. All pairs are found, none by chance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bitmap import maybe, split_join
from quern.llm.components import components
from quern.session import durable, spread, width

WORDS = re.compile(r"[A-Za-z0-9_]+").findall
#: Places of the table of token counts that sets the order: 4 MB, whatever the input.
ORDER_BITS = 20
BLOCK = 1 << 14
#: Bytes of token rows that a task should get.
TASK_BYTES = 12_000_000
REMEMBER = 500_000
A = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """word -> hash; forgets all when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = Hashes()


def shingles(text: str, k: int, least: int) -> np.ndarray | None:
    """Hashes of all runs of ``k`` words, repeats included; None for a text of fewer than ``least`` words."""
    words = WORDS(text)
    if len(words) < max(least, k):
        return None
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    s = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        s = (s ^ (s >> np.uint64(31))) * A + h[j : len(h) - k + 1 + j]
    return s ^ (s >> np.uint64(29))


def needed(n: int, t: float) -> int:
    return math.ceil(t * n - 1e-9)


def _count(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        mask, held, size = np.uint64((1 << ORDER_BITS) - 1), [], 0

        def add():
            if held:
                counts[:] += np.bincount((np.concatenate(held) & mask).astype(np.int64), minlength=1 << ORDER_BITS)

        for b in batches:
            for t in b.column(0).to_pylist():
                if (s := shingles(t, k, least)) is not None:
                    held.append(s)
                    size += len(s)
                    if size > 1 << ORDER_BITS:
                        add()
                        held, size = [], 0
        add()
        counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
        at = range(0, 1 << ORDER_BITS, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([x // BLOCK for x in at], pa.int32()), pa.array([counts[x : x + BLOCK].tobytes() for x in at], pa.binary())], ["block", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums.setdefault(block, np.zeros(BLOCK, np.uint64))
            sums[block] += np.frombuffer(c, np.uint32)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])


def order_table(texts: DataFrame, k: int, least: int) -> np.ndarray:
    """How often each place of the table is hit by the tokens of all texts."""
    rows = texts.mapInArrow(_count(k, least), "block int, counts binary").repartition(16, "block").mapInArrow(_add, "block int, counts binary").collect()  # 4 MB
    out = np.zeros(1 << ORDER_BITS, np.uint32)
    for r in rows:
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint32)
    return out


SETS = "id bigint, other bigint, n int, least bigint, first array<bigint>, index int"


def _sets(k: int, least: int, t: float, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        mask = np.uint64((1 << ORDER_BITS) - 1)
        seen = set()
        for b in batches:
            ids, others, n, low, first, index = [], [], [], [], [], []
            for i, doc, text in zip(*(b.column(c).to_pylist() for c in ("id", "doc", "text"))):
                if doc in seen:  # a copy
                    continue
                seen.add(doc)
                s = shingles(text, k, least)
                if s is None:
                    continue
                u = np.unique(s)
                by = np.lexsort((u, counts[(u & mask).astype(np.int64)]))
                ids.append(i)
                others.append(xxhash.xxh64_intdigest(doc) - (1 << 63))
                n.append(len(u))
                low.append(int(((u ^ (u >> np.uint64(33))) * A).min().view(np.int64)))
                first.append(u[by[: len(u) - needed(len(u), t) + 1]].view(np.int64))
                index.append(len(u) - needed(len(u), 2 * t / (1 + t)) + 1)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32))
            flat = pa.array(np.concatenate(first) if first else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(n, pa.int32()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(index, pa.int32())], ["id", "other", "n", "least", "first", "index"])

    return run


PAIRS = "hash_a string, hash_b string, overlap int, similarity double"


def _open(k: int, least: int, t: float):
    """Rows of one group stand together, members first. A query is compared with members that are no larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, union = None, [], None
        for b in batches:
            out = []
            for g, query, doc, text in zip(*(b.column(c).to_pylist() for c in ("group", "query", "doc", "text"))):
                if g != group:
                    group, members, union = g, [], None
                if (u := shingles(text, k, least)) is None:  # too short, but with another's id
                    continue
                u = np.unique(u)
                if not query:
                    members.append((len(u), doc, u))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([m[2] for m in members])) if members else np.empty(0, np.uint64)
                if len(union) == 0 or meeting(u, union) < needed(len(u), t):
                    continue
                for n, other, v in members:
                    if (n, other) < (len(u), doc) and n >= needed(len(u), t):
                        both = meeting(u, v)
                        if both >= t * (n + len(u) - both) - 1e-9:
                            out.append((min(doc, other), max(doc, other), both, both / (n + len(u) - both)))
            part = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(part, [pa.string(), pa.string(), pa.int32(), pa.float64()])], ["hash_a", "hash_b", "overlap", "similarity"])

    return run


def meeting(u: np.ndarray, v: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    at = np.searchsorted(v, u)
    at[at == len(v)] = len(v) - 1
    return int((v[at] == u).sum())


def contents(files: DataFrame) -> DataFrame:
    """doc (lower-case hex SHA-256) and text of text files; equal contents are repeated."""
    return files.where((F.col("content_type") == "text") & F.col("content").isNotNull()).select(F.sha2(F.col("content"), 256).alias("doc"), F.col("content").alias("text"))


def near_pairs(texts: DataFrame, threshold: float = 0.7, k: int = 5, least: int = 40, group_size: int = 64) -> DataFrame:
    """hash_a < hash_b, overlap and similarity of all pairs of different docs that are alike.

    ``texts`` has doc and text; rows with one doc have one text, so copies
    count once. Tokens are the longest runs of ASCII letters, digits and
    ``_``; texts of fewer than ``least`` of them (or of k) and null texts are
    left out. A pair is alike if the intersection of the sets of distinct
    runs of k tokens is at least ``threshold`` of their union.
    """
    spark = texts.sparkSession
    texts = spread(texts.select("doc", "text").where(F.col("text").isNotNull()))
    order = spark.sparkContext.broadcast(order_table(texts.select("text"), k, least))
    # Within, a doc is named by 64 bits of a hash. Docs that have them in common are told by 64 other bits and opened together, so that none is lost.
    texts = texts.withColumn("id", F.xxhash64("doc"))
    # copies are left out within a task; those of other tasks repeat rows, which changes nothing
    sets = durable(texts.select("id", "doc", "text").mapInArrow(_sets(k, least, threshold, order), SETS))
    narrow = sets.select("id", "other", "n", "least").distinct()
    sizes = narrow.groupBy("least").agg(F.count("*").alias("c")).where(F.col("c") > group_size)
    grouped = durable(narrow.join(sizes, "least", "left").select("id", "other", "n", F.xxhash64("least", F.coalesce(F.pmod("id", F.ceil(F.col("c") / group_size)), F.lit(0))).alias("group")))
    # rows (token, id): a token past ``index`` is first for queries only
    wide = width(spark, 12 + (sets.agg(F.sum(F.size("first"))).first()[0] or 0) * 24 // TASK_BYTES)
    rows = sets.select("id", "n", F.col("index"), F.posexplode("first").alias("i", "token")).select("token", "id", "n", "i", (F.col("i") < F.col("index")).alias("indexed")).repartition(wide, "token")
    shared = rows.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("indexed").alias("x")).where("a <> b AND x").select("token")
    met = durable(rows.join(shared, "token"))
    matrix = met.where("indexed").join(grouped.select("id", "group"), "id").groupBy("token", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("i").alias("j"), F.min("id").alias("only"), F.max("id").alias("last"))
    # The query is the larger document: a member needs at least threshold of its size. At the first
    # token two documents share, what is left of both must reach the overlap they need.
    smaller = F.greatest(F.col("low"), F.ceil(F.col("n") * threshold - 1e-6))
    left = F.least(F.col("n") - F.col("i"), F.least(F.col("high"), F.col("n")) - F.col("j"))
    enough = left >= (F.col("n") + smaller) * (threshold / (1 + threshold)) - 1e-6
    queries = met.select("token", "id", "n", "i")
    candidates = queries.join(matrix, "token").where((F.col("low") <= F.col("n")) & (F.col("high") >= F.col("n") * threshold - 1e-6) & enough & ((F.col("only") != F.col("id")) | (F.col("last") != F.col("id")))).select("id", "group").distinct()
    alike = grouped.groupBy("id").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").select("id")
    candidates = durable(candidates.unionByName(grouped.join(alike, "id", "left_semi").select("id", "group")).distinct())
    opened = candidates.select("group").distinct()
    members = grouped.join(opened, "group").select("group", "id", F.lit(False).alias("query"))
    parts = durable(members.unionByName(candidates.select("group", "id", F.lit(True).alias("query"))))
    ids = parts.select("id").distinct()
    wanted = maybe(texts, ids, "id").join(ids, "id", "left_semi").dropDuplicates(["id", "doc"])
    pairs = wanted.join(parts, "id").repartition(width(spark), "group").sortWithinPartitions("group", "query").select("group", "query", "doc", "text").mapInArrow(_open(k, least, threshold), PAIRS)
    return pairs.distinct()


def near_groups(files: DataFrame, threshold: float = 0.7, k: int = 5, least: int = 40, group_size: int = 64) -> DataFrame:
    """repo_name, file_path, hash, group and links of every text file: the groups of contents that are alike, directly or through others.

    ``group`` is the least hash among its contents; a content that is like no
    other is its own group, and copies share one. ``links``: to how many other
    contents it is alike, 0 also for contents too short to be compared. Repeated
    rows come once. Pairs are not expanded to copies.
    """
    pairs = durable(near_pairs(contents(files), threshold, k, least, group_size).select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b")))
    links = pairs.select(F.explode(F.array("a", "b")).alias("hash")).groupBy("hash").agg(F.count("*").alias("links"))
    known = components(pairs).select(F.col("node").alias("hash"), F.col("component").alias("group")).join(links, "hash")
    own = files.where((F.col("content_type") == "text") & F.col("content").isNotNull()).select("repo_name", "file_path", F.sha2("content", 256).alias("hash")).distinct()
    every = own.select("hash").distinct().join(known, "hash", "left").select("hash", F.coalesce("group", "hash").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    return split_join(own, every, "hash").select("repo_name", "file_path", "hash", "group", "links")  # a content that very many files hold is split
