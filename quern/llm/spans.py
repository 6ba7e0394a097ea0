"""Long exact spans shared between records.

Tokens are character 48-grams at positions chosen by their content: of every
152 consecutive positions the one with the least hash of its 24-gram. So
every stretch of 200 characters chooses one of its own grams, and equal
stretches choose alike. A gram is an edge of a De Bruijn graph, the grams
chosen next to it in a document are its neighbours:

1. Grams are counted by key, with their neighbours. Only keys of two or more
   texts go on.
2. Compaction: a gram with one and the same successor in all documents, which
   occurs no more often, merges with it. Joining the counts back to the
   documents gives the maximal nonbranching paths. A path of 200 or more
   characters is shared as it stands, once the digest of its characters at
   the source coordinates (BLAKE2, 128 bits) is found in two documents; a path
   that merged by a collision of hashes fails there, and its windows are
   compared one by one.
3. What such paths don't decide - stretches reaching over the ends of a path -
   is compared at its source coordinates: windows of 200 characters with
   those of the other documents that chose the same gram, by hash first, then
   character by character.

Texts that are equal as a whole are put into classes first, so that copies
cost nothing after step 0. A key of very many texts is not handled in one
task: its windows are counted as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.bitmap import maybe
from quern.session import durable, spread, width

GRAM, CHOOSE, CHUNK = 48, 24, 500_000
A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a, b):
    x = (a ^ (a >> np.uint64(29))) * A + (b ^ (b >> np.uint64(32))) * B
    return x ^ (x >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(c: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of all stretches of 1, 2, 4, ... ``upto`` characters."""
    out = {1: (c.astype(np.uint64) + np.uint64(1)) * B}
    k = 1
    while k < upto:
        g = out[k]
        out[2 * k] = mix(g[:-k], g[k:]) if len(g) > k else g[:0]
        k *= 2
    return out


def stretch(g: dict[int, np.ndarray], length: int) -> np.ndarray:
    """Hashes of all stretches of ``length`` characters, out of those of powers of two."""
    x, at, k = None, 0, max(g)
    while at < length:
        while at + k > length:
            k //= 2
        y = g[k][at:]
        x = y if x is None else mix(x[: len(y)], y[: len(x)])
        at += k
    return x[: max(0, len(g[1]) - length + 1)]


def least(x: np.ndarray, w: int) -> np.ndarray:
    """For each start, where the last least value of the next ``w`` lies."""
    arg, k = np.arange(len(x), dtype=np.int32), 1

    def join(a, b):
        return np.where(x[b] <= x[a], b, a)

    while 2 * k <= w:
        arg = join(arg[:-k], arg[k:])
        k *= 2
    return join(arg[: len(x) - w + 1], arg[w - k : len(x) - k + 1]) if k < w else arg


def gram_at(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the grams at some places only."""
    out = np.empty(len(at), np.uint64)
    for k in range(0, len(at), 20_000):
        g = {1: (c[at[k : k + 20_000, None] + np.arange(GRAM)].astype(np.uint64) + np.uint64(1)) * B}
        n = 1
        while n < 32:
            g[2 * n] = mix(g[n][:, :-n], g[n][:, n:])
            n *= 2
        out[k : k + 20_000] = mix(g[32][:, 0], g[16][:, 32])
    return out


def long_anchors(text: str, length: int, chunk: int):
    """``anchors`` of one long text, ``chunk`` windows at a time, so that memory stays a few bytes a character."""
    w, parts = length - GRAM, []
    for s in range(0, len(text) - length + 1, chunk):
        e = min(len(text) - length + 1, s + chunk)
        g = grams(codes(text[s : e - 1 + length]), 32)
        own = least(stretch(g, CHOOSE), w)[: e - s].astype(np.int64)
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        new[0] = not parts or parts[-1][0][-1] != own[0] + s
        parts.append((own[new] + s, np.arange(s, e)[new], stretch(g, GRAM)[own[new]]))
        if not len(parts[-1][0]):
            parts.pop()
    at, low, keys = (np.concatenate(x) for x in zip(*parts))
    ways = np.zeros(len(at), np.int32)
    if len(at) > 1:
        c, a, b = codes(text), at[:-1], at[1:]
        h = mix(keys[:-1], keys[1:])
        for k in range(GRAM, w, GRAM):
            h = mix(h, gram_at(c, np.minimum(a + k, b)))
        ways[:-1] = way(h, b - a)
    return [at], [low], [keys.view(np.int64)], [ways]


def way(h: np.ndarray, gap: np.ndarray) -> np.ndarray:
    return (mix(h, gap.astype(np.uint64)) >> np.uint64(33)).astype(np.int32) | 1


def anchors(texts: list[str], length: int, chunk: int = 4 * CHUNK):
    """Of each text: the positions of its grams, the first window each owns, their keys, the hashes of the ways to the next one."""
    if len(texts) == 1 and len(texts[0]) > chunk:
        return long_anchors(texts[0], length, chunk)
    cs = [codes(t) for t in texts]
    c, ends = np.concatenate(cs), np.cumsum([len(x) for x in cs])
    g = grams(c, 32)
    gram = stretch(g, GRAM)
    w = length - GRAM
    arg = least(stretch(g, CHOOSE), w)
    starts = np.concatenate([np.arange(e - len(x), e - length + 1) for x, e in zip(cs, ends)])
    doc = np.repeat(np.arange(len(cs)), [max(0, len(x) - length + 1) for x in cs])
    own = arg[starts]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    at, low, doc = own[new].astype(np.int64), starts[new], doc[new]
    keys = gram[at]
    n = len(at)
    ways = np.zeros(n, np.int32)
    if n > 1:
        a, b = at[:-1], at[1:]
        h = mix(keys[:-1], keys[1:])
        for k in range(GRAM, w, GRAM):
            h = mix(h, gram[np.minimum(a + k, b).clip(0, len(gram) - 1)])
        ways[:-1] = np.where(doc[1:] == doc[:-1], way(h, b - a), 0)
    begin = np.array([e - len(x) for x, e in zip(cs, ends)], np.int64)
    cuts = np.searchsorted(doc, np.arange(1, len(cs)))
    split = lambda x: np.split(x, cuts)
    return split(at - begin[doc]), split(low - begin[doc]), split(keys.view(np.int64)), split(ways)


FOUND = "doc_id bigint, n int, pos array<int>, low array<int>, keys array<bigint>, ways array<int>"


def _anchors(length: int):
    def block(held: list) -> pa.RecordBatch:
        found = anchors([t for _, t in held], length)
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        lists = []
        for parts, kind in zip(found, types):
            flat = np.concatenate(parts).astype(kind.to_pandas_dtype())
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(flat, kind)))
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array([len(t) for _, t in held], pa.int32()), *lists], ["doc_id", "n", "pos", "low", "keys", "ways"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for d, t, last in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [False] * (b.num_rows - 1) + [True]):
                if len(t) > CHUNK and held:  # a long text goes alone
                    yield block(held)
                    held, size = [], 0
                held.append((d, t))
                size += len(t)
                if size > CHUNK or last:
                    yield block(held)
                    held, size = [], 0

    return run


PIECES = "kind string, key bigint, digest binary, doc_id bigint, start int, stop int, text string"
_PIECES = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())])


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _windows(length: int):
    """(doc_id, start, stop, text) of a stretch -> a row for each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, start, stop, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "stop", "text"))):
                for s in range(start, stop - length + 1, 20_000):
                    rows = [("window", 0, digest(text[k : k + length]), d, k, k + length, None) for k in range(s, min(s + 20_000, stop - length + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PIECES.types)], _PIECES.names)

    return run


def _pieces(length: int, hot: int):
    """Of each document with repeated grams: its shared paths, and what is to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            cols = {c: b.column(c) for c in b.schema.names}
            for i in range(b.num_rows):
                d, n, text = cols["doc_id"][i].as_py(), cols["n"][i].as_py(), cols["text"][i].as_py()
                pos, low = cols["pos"][i].values.to_numpy(zero_copy_only=False), cols["low"][i].values.to_numpy(zero_copy_only=False)
                flags = sorted((f["i"], f["key"], f["out"], f["times"]) for f in cols["flags"][i].as_py())
                k = 0
                while k < len(flags):
                    e = k  # a path: k..e
                    while e + 1 < len(flags) and flags[e + 1][0] == flags[e][0] + 1 and flags[e][2] and flags[e + 1][3] == flags[e][3]:
                        e += 1  # all of this gram go on to the next, which has no more: all of those come from here
                    begin, end = int(pos[flags[k][0]]), int(pos[flags[e][0]]) + GRAM
                    if end - begin >= length:
                        rows.append(("span", 0, digest(text[begin:end]), d, begin, end, None))
                    for j in range(k, e + 1):
                        a, key, _, times = flags[j]
                        lo, hi = int(low[a]), int(low[a + 1]) - 1 if a + 1 < len(low) else n - length
                        for lo, hi in ((lo, min(hi, begin - 1)), (max(lo, begin, end - length + 1), hi)) if end - begin >= length else ((lo, hi),):
                            if lo > hi:
                                continue
                            if times > hot:
                                rows += [("window", 0, digest(text[s : s + length]), d, s, s + length, None) for s in range(lo, hi + 1)]
                            else:
                                rows.append(("compare", key, None, d, lo, hi, text[lo : hi + length]))
                    k = e + 1
            for at in range(0, len(rows), 20_000):
                part = list(zip(*rows[at : at + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, _PIECES.types)], _PIECES.names)

    return run


def equal_windows(c: np.ndarray, at: np.ndarray, other: np.ndarray, length: int) -> bool:
    """Whether the window at every place of ``at`` has the characters of that at ``other``. Windows that follow each other are compared as one stretch."""
    order = np.argsort(at)
    at, other = at[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(other) != 1)]))
    for a, b, n in zip(at[first], other[first], np.diff(np.concatenate([first, [len(at)]]))):
        if a != b and not np.array_equal(c[a : a + n - 1 + length], c[b : b + n - 1 + length]):
            return False
    return True


def _compare(length: int):
    """Rows sorted by key: of each, the windows that another document has as well."""

    def shared(keys, docs, least_, greatest, starts, texts):
        cs = [codes(t) for t in texts]
        ends, c = np.cumsum([len(x) for x in cs]), np.concatenate(cs)
        h = stretch(grams(c, 128), length)
        at = np.concatenate([np.arange(e - len(x), e - length + 1) for x, e in zip(cs, ends)])
        row = np.repeat(np.arange(len(cs)), [len(x) - length + 1 for x in cs])
        h = mix(h[at], np.array(keys, np.int64).view(np.uint64)[row])
        order = np.argsort(h, kind="stable")
        h, row, at = h[order], row[order], at[order]
        low, high = np.array(least_, np.int64)[row], np.array(greatest, np.int64)[row]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([first, [len(h)]]))
        many = np.repeat(np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first), size)
        if not many.any():
            return None
        if not equal_windows(c, at[many], np.repeat(at[first], size)[many], length):
            # different windows with one hash: by their characters alone
            met: dict[tuple, set] = {}
            same = [(key, c[a : a + length].tobytes()) for key, a in zip(np.array(keys)[row], at)]
            for x, a, b in zip(same, low, high):
                met.setdefault(x, set()).update((a, b))
            many = np.array([len(met[x]) > 1 for x in same])
        row, at = row[many], at[many]
        if not len(row):
            return None
        s = at - (ends - np.array([len(x) for x in cs]))[row] + np.array(starts)[row]
        lo, hi = np.full(len(cs), np.iinfo(np.int64).max), np.full(len(cs), -1)
        np.minimum.at(lo, row, s)
        np.maximum.at(hi, row, s)
        hit = np.flatnonzero(hi >= 0)
        return pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[hit]), pa.array(lo[hit].astype(np.int32)), pa.array((hi[hit] + length).astype(np.int32))], ["doc_id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ([], [], [], [], [], [])
        size = 0
        for b in batches:
            for key, d, low, high, s, t in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "a", "b", "start", "text"))):
                if size > CHUNK and held[0][-1] != key:
                    if (out := shared(*held)) is not None:
                        yield out
                    held, size = ([], [], [], [], [], []), 0
                for x, v in zip(held, (key, d, low, high, s, t)):
                    x.append(v)
                size += len(t)
        if size and (out := shared(*held)) is not None:
            yield out

    return run


def merged(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(start, stop) intervals of each key united where they touch or overlap."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(key, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def shared_spans(documents: DataFrame, length: int = 200, hot: int = 5_000) -> DataFrame:
    """doc_id, span_start, span_end (end exclusive, in code points) of the stretches that other documents have as well.

    Every character of a span lies in some stretch of at least ``length``
    (100 or more) characters that occurs, exactly equal, in a document with
    another doc_id. Spans don't touch. Documents with a null id or text, or a
    text shorter than ``length``, have none. Repeated rows count once. Several
    texts under one doc_id are texts of one document: each has its own spans,
    which other documents must have as well.
    """
    if length < GRAM + CHOOSE + 12:
        raise ValueError("length is too small for the grams")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    hashed = F.unhex(F.sha2("text", 256))
    texts = rows.select("doc_id", hashed.alias("t"), F.length("text").alias("n"))
    owners = None
    if not texts.groupBy("doc_id").agg(F.min("t").alias("t"), F.max("t").alias("u")).where("t <> u").isEmpty():
        # every text gets a number of its own and takes the place of its document, whose id stays in ``owners``
        owners = durable(texts.distinct().withColumnRenamed("doc_id", "owner").withColumn("doc_id", F.monotonically_increasing_id()))
        numbered = rows.withColumnRenamed("doc_id", "owner").withColumn("t", hashed).join(owners.select("owner", "t", "doc_id"), ["owner", "t"])
        rows, texts = durable(numbered.select("doc_id", "text")), owners.select("doc_id", "t", "n")
    classes = durable(texts.groupBy("t", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")))
    copied = classes.where("rep <> other")
    whole = texts.join(copied.select("t", "n"), ["t", "n"]).select("doc_id", F.lit(0).alias("start"), F.col("n").alias("stop")).distinct()
    # a, b: the least and the greatest document that has a row's text; for all classes but those of several texts a document the row itself
    both = lambda df: df.withColumns({"a": F.col("doc_id"), "b": F.col("doc_id")})
    if owners is not None:
        held = durable(owners.groupBy("t", "n").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.min("doc_id").alias("rep")).join(owners.select("t", "n", "doc_id"), ["t", "n"]).select("doc_id", "a", "b"))
        both = lambda df: df.join(held, "doc_id")
    # step 1: one text of each class
    extra = texts.join(copied, ["t", "n"]).where("doc_id <> rep").select("doc_id").distinct()
    found = durable(spread(rows).mapInArrow(_anchors(length), FOUND))
    one = found.join(extra, "doc_id", "left_anti")
    chosen = one.select("doc_id", F.posexplode(F.arrays_zip("keys", "ways")).alias("i", "x")).select("doc_id", "i", F.col("x.keys").alias("key"), F.col("x.ways").alias("way"))
    onward = (F.min("way") == F.max("way")) & (F.min("way") != 0)
    graph = both(chosen).groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), onward.alias("out"), F.count("*").alias("times")).where("a <> b").drop("a", "b")
    # step 2: back to the documents, whose rows it decides
    flags = chosen.select("doc_id", "i", "key").join(graph, "key").groupBy("doc_id").agg(F.collect_set(F.struct("i", "key", "out", "times")).alias("flags"))
    flags = durable(flags)
    few = lambda df: maybe(df, flags, "doc_id")
    known = flags.join(few(found.select("doc_id", "n", "pos", "low")), "doc_id").join(few(rows), "doc_id")
    pieces = durable(known.mapInArrow(_pieces(length, hot), PIECES))
    # step 3
    compare = both(pieces.where("kind = 'compare'").select("key", "doc_id", "start", "text")).repartition(width(documents.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_compare(length), "doc_id bigint, start int, stop int")
    exact = pieces.where("kind <> 'compare'").select("kind", "digest", "doc_id", "start", "stop")
    seen = lambda df: both(df).groupBy("digest").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    counted = durable(seen(exact))
    failed = exact.where("kind = 'span'").join(counted.where("a = b"), "digest", "left_semi")
    if not failed.isEmpty():  # merged by a collision
        again = durable(failed.join(rows, "doc_id").select("doc_id", "start", "stop", "text").mapInArrow(_windows(length), PIECES)).select("kind", "digest", "doc_id", "start", "stop")
        exact = exact.unionByName(again)
        counted = durable(seen(exact))
    spans = exact.join(counted.where("a <> b"), "digest", "left_semi").select("doc_id", "start", "stop").unionByName(compare)
    # other documents' parts of a text with copies don't matter: it is shared as a whole
    alone = spans.join(copied.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    spans = merged(alone.unionByName(whole))
    if owners is not None:
        spans = spans.join(owners.select("doc_id", "owner"), "doc_id").select(F.col("owner").alias("doc_id"), "start", "stop").distinct()
    return spans.select("doc_id", F.col("start").alias("span_start"), F.col("stop").alias("span_end"))


def shared_part(documents: DataFrame, length: int = 200) -> DataFrame:
    """Of every document: n_chars, shared_chars, shared_part (0 for a null or empty text)."""
    spans = shared_spans(documents, length).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("s"))
    n = F.coalesce(F.length("text"), F.lit(0))
    return documents.select("doc_id", n.alias("n_chars")).join(spans, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("s", F.lit(0)).alias("shared_chars"), F.when(F.col("n_chars") > 0, F.coalesce("s", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("shared_part"))
