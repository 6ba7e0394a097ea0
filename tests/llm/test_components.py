import random

from quern.llm.components import components


def brute(edges):
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    return {x: root(x) for x in list(group)}


def test_against_union_find(spark):
    r = random.Random(1)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)]
    star = [("hub", f"s{i}") for i in range(60)]
    loose = [(f"n{r.randrange(200)}", f"n{r.randrange(200)}") for _ in range(120)]
    edges = chain + star + loose + [("x", "x"), ("b", "a"), ("a", "b")]
    r.shuffle(edges)
    df = spark.createDataFrame(edges + [(None, "z"), ("y", None)], "a string, b string")
    got = {row.node: row.component for row in components(df).collect()}
    assert got == brute(edges) | {"z": "z", "y": "y"}
    assert components(df.limit(0)).count() == 0
