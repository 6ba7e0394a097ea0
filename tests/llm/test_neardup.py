import hashlib
import random
import re

from quern.llm import neardup


def brute(texts, t, k, least):
    sets = {}
    for x in texts:
        w = re.findall(r"[A-Za-z0-9_]+", x or "")
        if len(w) >= least:
            sets[hashlib.sha256(x.encode()).hexdigest()] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def corpus(seed):
    r = random.Random(seed)
    header = "license text that stands at the head of each and every file of the project".split()
    out = []
    for _ in range(25):
        w = header + [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 200))]
        for _ in range(r.randrange(1, 7)):
            v = list(w)
            for _ in range(r.randrange(0, 12)):
                at = r.randrange(len(v))
                if r.random() < 0.5:
                    v[at] = f"e{r.randrange(99)}"
                else:
                    v[at:at] = v[-3:]
            out.append(" ".join(v) + r.choice(["", "\n", " é"]))
    return out + [" ".join(["same"] * 50), " ".join(["same"] * 60), "short text", "", None, " ".join(f"x{i}" for i in range(40)), " ".join(f"x{i}" for i in range(39))]


def test_against_all_pairs(spark):
    for seed in range(2):
        c = corpus(seed)
        df = spark.createDataFrame([(x, "text", 1) for x in c + c[:20]] + [(c[0] + "!", "binary", 1)], "content string, content_type string, doc int")
        for size in (2, 64):
            got = [(r.hash_a, r.hash_b) for r in neardup.near_pairs(neardup.contents(df), group_size=size).collect()]
            want = brute(c, 0.7, 5, 40)
            assert len(got) == len(set(got)) and set(got) == want and len(want) > 10, (len(got), len(want))


def test_groups(spark):
    c = corpus(4)
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = spark.createDataFrame([(f"r{i % 3}", f"f{i}", x, "text") for i, x in enumerate(c + c[:9])] * 2 + [(None, None, c[0], "text"), ("b", "b", c[0], "binary")], "repo_name string, file_path string, content string, content_type string")
    pairs, group = brute(c, 0.7, 5, 40), {}
    for x in {h(t) for t in c if t is not None}:
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            new = {b if a == y else a for a, b in pairs if y in (a, b)} - seen
            seen |= new
            todo += new
        group[x] = min(seen)
    rows = neardup.near_groups(df).collect()
    assert len(rows) == len({(r.repo_name, r.file_path) for r in rows}) == sum(x is not None for x in c + c[:9]) + 1
    assert all(r.group == group[r.hash] and r.links == sum(r.hash in p for p in pairs) for r in rows)


def test_docs_with_one_short_hash_are_not_lost(spark, monkeypatch):
    """With internal names of one bit every doc collides, and still all pairs are found."""
    from pyspark.sql import functions as F

    c = corpus(2)[:40]
    hashed = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *x: F.pmod(hashed(*x), F.lit(2)) if x == ("doc",) else hashed(*x))
    df = spark.createDataFrame([(x, "text") for x in c], "content string, content_type string")
    assert {(r.hash_a, r.hash_b) for r in neardup.near_pairs(neardup.contents(df)).collect()} == brute(c, 0.7, 5, 40)


def test_empty(spark):
    df = spark.createDataFrame([], "content string, content_type string")
    assert neardup.near_pairs(neardup.contents(df)).count() == 0
