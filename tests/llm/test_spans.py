import random

import numpy as np

from quern.llm import spans


def brute(docs, length):
    """All windows of all documents in one dict."""
    seen = {}
    for d, t in docs:
        for s in range(len(t or "") - length + 1):
            seen.setdefault(t[s : s + length], set()).add(d)
    out = set()
    for d, t in docs:
        hit = np.zeros(len(t or "") + 2, bool)
        for s in range(len(t or "") - length + 1):
            if len(seen[t[s : s + length]]) > 1:
                hit[s + 1 : s + length + 1] = True
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        out |= {(d, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    text = lambda k, abc="abcdefghij é😀\n": "".join(r.choice(abc) for _ in range(k))
    passages = [text(r.randrange(150, 900)) for _ in range(8)] + ["ab" * 300, "-" * 500, text(200), text(199)]
    docs = []
    for i in range(n):
        t = text(r.randrange(0, 400))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a = r.choice([0, 0, r.randrange(0, 60)])
            b = r.choice([0, 0, r.randrange(0, 60)])
            p = p[a : len(p) - b]
            if r.random() < 0.3:
                k = r.randrange(len(p))
                p = p[:k] + "X" + p[k + 1 :]
            t += p + text(r.randrange(0, 300))
        docs.append((i, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "x" * 250), (105, "x" * 260), (106, docs[5][1] + "tail"), (107, docs[8][1][:200]), (107, docs[8][1][:200])]
    return docs


def test_against_all_windows(spark):
    for seed in range(3):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as start", "2 as n", "3 as key")
        want = brute(docs, 200)
        for hot in (3, 5000):
            got = [tuple(x) for x in spans.shared_spans(df, hot=hot).collect()]
            assert len(got) == len(set(got))
            assert set(got) == want, (seed, hot, sorted(set(got) - want)[:5], sorted(want - set(got))[:5])


def test_paths_are_counted_by_their_characters(spark):
    """Two documents with the same grams and other characters between them share the stretches around alone; the windows of a path that fails are those of its stretch."""
    r = random.Random(5)
    text = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    a, b, c = text(150), text(160), text(400)
    docs = [(1, a + text(90) + b + c), (2, a + text(90) + b + c), (3, c)]
    assert {tuple(x) for x in spans.shared_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == brute(docs, 200)
    run = spans._windows(200)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([3], pa.int32()), pa.array([240], pa.int32()), pa.array(["x" * 3 + c[:237]])], ["doc_id", "start", "stop", "text"])
    (out,) = run(iter([batch]))
    assert out.column("start").to_pylist() == list(range(3, 41)) and out.column("digest")[0].as_py() == spans.digest(c[:200])


def test_windows_are_compared_by_their_characters(monkeypatch):
    """One hash for all windows of one key, and still only equal ones are found."""
    import pyarrow as pa

    monkeypatch.setattr(spans, "stretch", lambda g, n: np.zeros(len(g[1]) - n + 1, np.uint64))
    r = random.Random(6)
    text = lambda k: "".join(r.choice("abcd") for _ in range(k))
    same = text(230)
    rows = [(5, 1, 1, 1, 0, same), (5, 2, 2, 2, 10, "x" + same), (5, 3, 3, 3, 0, text(250)), (6, 4, 4, 4, 0, same)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.int32(), pa.string()])], ["key", "doc_id", "a", "b", "start", "text"])
    (out,) = spans._compare(200)(iter([batch]))
    assert sorted(zip(*(out.column(c).to_pylist() for c in ("doc_id", "start", "stop")))) == [(1, 0, 230), (2, 11, 241)]


def test_several_texts_of_one_document(spark):
    """What two texts of one document share isn't shared; what each shares with others is, also through a copy."""
    r = random.Random(11)
    text = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    p, q, w, z = text(300), text(250), text(260), text(400)
    docs = [(1, "x" + p + "y" + w), (1, "u" + w + "v" + q), (2, "k" + p + "l"), (3, "m" + q + "n"), (3, "m" + q + "n"), (4, z + "1"), (4, z), (5, z), (6, text(500))]
    got = {tuple(x) for hot in (3, 5000) for x in spans.shared_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), hot=hot).collect()}
    assert got == {(1, 1, 301), (2, 1, 301), (1, 262, 512), (3, 1, 251), (4, 0, 400), (5, 0, 400)}


def test_part_and_empty(spark):
    df = spark.createDataFrame(corpus(1), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in spans.shared_part(df).collect()}
    assert rows[100].shared_part == 1 and rows[102].shared_part == 0 and rows[102].n_chars == 0
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_long_texts_in_pieces_give_the_same_grams():
    r = random.Random(9)
    for abc in ("abcdefgh \n", "ab", "a"):
        text = "".join(r.choice(abc) for _ in range(9000))
        whole = spans.anchors([text], 200)
        for chunk in (200, 777, 4000, 8801):
            cut = spans.anchors([text], 200, chunk)
            assert all(np.array_equal(x[0], y[0]) for x, y in zip(whole, cut)), chunk


def test_a_very_long_text(spark):
    r = random.Random(3)
    text = "".join(r.choice("abcdefghij klmnop") for _ in range(3_000_000))
    df = spark.createDataFrame([(1, text), (2, "x" * 300 + text[1_999_900:2_000_200] + "y"), (3, "z" * 100)], "doc_id bigint, text string")
    got = {tuple(x) for x in spans.shared_spans(df).collect()}
    assert got == {(1, 1_999_900, 2_000_200), (2, 300, 600)}
