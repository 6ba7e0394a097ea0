import json

from quern.operators import nested
from quern.session import table


def brute(dumps, infos):
    """The rows by plain recursion."""
    out = set()

    def seq(x):
        if isinstance(x, str) and x[:1] in ("[", "{"):
            x = json.loads(x)
        return x if isinstance(x, list) else [] if x is None else [x]

    def name(x):
        return isinstance(x, str) and x != ""

    for repo, text in dumps:
        try:
            j = json.loads(text)
        except (TypeError, ValueError):
            continue
        for c in j["commits"] if isinstance(j, dict) else j:
            c = c if "sha" in c else next(v for v in c.values() if isinstance(v, dict) and "sha" in v)
            sha, a = c["sha"], c.get("author")
            if isinstance(a, str):
                a = a.split("<")[1].rstrip(">") if "<" in a else a
            elif isinstance(a, dict):
                a = a.get("email") or a.get("name")
            if name(a):
                out.add(("author", repo, sha, 0, a))
            out |= {("parent", repo, sha, i, p) for i, p in enumerate(seq(c.get("parents"))) if name(p)}
            for i, f in enumerate(seq(c.get("files_changed"))):
                if not isinstance(f, dict):
                    continue
                p = f.get("path")
                p = p.get("new") if isinstance(p, dict) else p
                if name(p):
                    out.add(("file_change", repo, sha, i, p))
                out |= {("hunk", repo, f"{sha}:{i}", k, h["header"]) for k, h in enumerate(seq(f.get("hunks"))) if name(h.get("header"))}
    for repo, text in infos:
        try:
            j = json.loads(text)
            j = json.loads(j) if isinstance(j, str) else j
        except (TypeError, ValueError):
            continue
        for i, t in enumerate(seq(j.get("topics"))):
            t = t.get("name") if isinstance(t, dict) else t
            if name(t):
                out.add(("topic", repo, repo, i, t))
        for r in seq(j.get("releases")):
            for i, a in enumerate(seq(r.get("assets"))):
                if name(a.get("name")) and name(r.get("tag_name")):
                    out.add(("asset", repo, r["tag_name"], i, a["name"]))
    return out


def test_against_recursion(spark):
    d = "/root/testdata/sf0.01"
    dumps, repos = table(spark, d, "commit_dumps"), table(spark, d, "repos")
    got = [tuple(r) for r in nested.found(dumps, repos).collect()]
    want = brute(dumps.select("repo_name", "commits_data").collect(), repos.select("repo_name", "repo_info").collect())
    assert len(got) == len(set(got)) and set(got) == want and len({g[0] for g in got}) == 6


def test_edges(spark):
    rows = [("a_b", None), ("a_b", ""), ("a_b", "  "), ("a_b", '{"sha": "1"'), ("a_b", "3"), (None, '[{"sha": "x", "parents": "y"}]'), ("é_r", json.dumps({"commits": json.dumps([{"node": {"sha": "s", "author": "No Mail", "files_changed": json.dumps({"path": {"old": "o", "new": "n"}, "hunks": {"header": "@@"}}), "parents": [None, "p"]}}])}))]
    df = spark.createDataFrame(rows * 2, "repo_name string, commits_data string").selectExpr("*", "1 as child", "2 as hash", "3 as kind")
    got = {tuple(r) for r in nested.commit_children(df)[0].collect()}
    assert got == {("parent", None, "x", 0, "y"), ("author", "é_r", "s", 0, "No Mail"), ("parent", "é_r", "s", 1, "p"), ("file_change", "é_r", "s", 0, "n"), ("hunk", "é_r", "s:0", 0, "@@")}
    assert nested.commit_children(df.limit(0))[0].count() == 0


def test_stored_once(spark):
    same = {"sha": "s", "author": {"name": "n", "email": "e"}}
    turned = {"author": {"email": "e", "name": "n"}, "sha": "s"}
    df = spark.createDataFrame([(1, "a", json.dumps([same])), (2, "a", json.dumps([same])), (3, "b", json.dumps([turned, same]))] * 2, "record_id int, r string, j string")
    m = nested.Merkle(df, "r", "j", nested.COMMIT, whole=True)
    nodes = {r.hash: (json.loads(r.body), r.bridges) for r in m.nodes.collect()}
    assert len(nodes) == 4 and m.roots.count() == 3  # two lists, the commit, its author
    (commit,) = (b for b, _ in nodes.values() if isinstance(b, dict) and "sha" in b)
    assert nodes[bytes.fromhex(commit["author"][""])][0] == same["author"]
    assert nested.bridges(m.nodes).where("member = ''").count() == 3 and m.about().count() == 2
    read = nested.Merkle(df, "r", "j", nested.COMMIT)
    assert [(r.body, [(b.member, b.ordinal, b.child, b.name) for b in r.bridges]) for r in read.nodes.collect()] == [(None, [("author", 0, None, "e")])]


def given_back(nodes: dict, h: bytes):
    """The value of a stored hash, by its body."""

    def whole(v):
        return given_back(nodes, bytes.fromhex(v[""])) if isinstance(v, dict) else [whole(x) for x in v] if isinstance(v, list) else v

    body = json.loads(nodes[h])
    return [whole(x) for x in body] if isinstance(body, list) else {k: whole(v) for k, v in body.items()}


def test_the_store_gives_every_record_back(spark, sf):
    """Texts that are JSON stay texts, whatever stands in them."""
    made = [(1, "a", json.dumps({"sha": "s", "message": '{"a": 1}', "files_changed": '[{"path": "p"}]', "": {"": ["[]", [[1.0, 1, True, None, {}]], "\ud800"]}})), (2, "b", json.dumps([{"topics": ["[1]", "{}"]}]))]
    df = table(spark, sf, "commit_dumps").select("record_id", "repo_name", "commits_data").union(spark.createDataFrame(made, "record_id bigint, repo_name string, commits_data string"))
    m = nested.Merkle(df, "repo_name", "commits_data", nested.COMMIT, whole=True)
    nodes = {r.hash: r.body for r in m.nodes.collect()}
    want = {(r[0], r[1], json.dumps(v, sort_keys=True)) for r in df.collect() if isinstance(v := nested.parse(r[2]), (dict, list))}
    assert {(r.record_id, r.record, json.dumps(given_back(nodes, r.hash), sort_keys=True)) for r in m.roots.collect()} == want


def test_names_that_look_like_json_and_any_depth(spark):
    info = spark.createDataFrame([("r", json.dumps({"topics": ["[1]", "{}", {"name": "n"}, "\ud800"]}))], "repo_name string, repo_info string")
    assert {(r.pos, r.name) for r in nested.repo_children(info)[0].collect()} == {(0, "[1]"), (1, "{}"), (2, "n"), (3, "?")}
    n = 30_000
    deep = [(1, "d", '{"a":' * n + '[{"sha": "x", "parents": ["p"]}]' + "}" * n), (2, "e", "[" * n + '{"sha": "y", "author": "m"}' + "]" * n)]
    df = spark.createDataFrame(deep, "record_id bigint, repo_name string, commits_data string")
    assert {tuple(r) for r in nested.commit_children(df)[0].collect()} == {("parent", "d", "x", 0, "p"), ("author", "e", "y", 0, "m")}
    assert {(r.repo_name, r.sha) for r in nested.commit_rows(df).collect()} == {("d", "x"), ("e", "y")}


def test_commits_of_all_shapes(spark, sf):
    """commit_dedup against plain recursion over the tables, and on hand-made dumps."""
    from quern.plans import repositories

    want: dict = {}
    dumps = table(spark, sf, "commit_dumps").select("record_id", "repo_name", "commits_data").distinct().collect()
    for record, repo, text in dumps:
        try:
            j = json.loads(text)
        except (TypeError, ValueError):
            continue
        for i, c in enumerate(j["commits"] if isinstance(j, dict) else j):
            c = c if "sha" in c else next(v for v in c.values() if isinstance(v, dict) and "sha" in v)
            want.setdefault((repo, c["sha"]), []).append((record, i, c["branch_or_tag"]))
    got = {(r.repo_name, r.sha): r for r in repositories.commit_dedup(spark, sf).collect()}
    assert set(got) == set(want)
    for k, mentions in want.items():
        assert (got[k].record_id, got[k].ord, got[k].branch_or_tag, got[k].dumps) == (*min(mentions), len({m[0] for m in mentions}))
    made = [(1, "a_b", '{"repo": "a/b", "commits": [{"sha": "x"}, {"sha": "y"}]}'), (2, "a_b", '[{"node": {"sha": "z", "branch_or_tag": "m"}}, null, {"sha": "x"}]'), (3, "a_b", json.dumps(json.dumps([{"sha": "w"}]))), (4, "a_b", '{"commits": [{"sha": "cut"'), (5, "a_b", None), (6, "a_b", " 3 ")]
    rows = nested.commit_rows(spark.createDataFrame(made, "record_id bigint, repo_name string, commits_data string")).collect()
    assert {(r.record_id, r.ord, r.sha, r.branch_or_tag) for r in rows} == {(1, 0, "x", None), (1, 1, "y", None), (2, 0, "z", "m"), (2, 2, "x", None), (3, 0, "w", None)}


def test_totals_of_all_shapes(spark, tmp_path):
    """commit_totals: changed files as a list, one object, or either as JSON text; lists, objects and wrapped commits."""
    from quern.plans import repositories

    one = {"path": "a", "insertions": 3, "deletions": "2"}
    dump = lambda *xs: json.dumps([{"sha": f"{i}", "files_changed": x} for i, x in enumerate(xs)])
    made = [
        (1, "list_r", dump([one, one])), (2, "object_r", dump(one)), (3, "text_r", dump(json.dumps(one), json.dumps([one]), [json.dumps(one)])), (4, "none_r", dump(None, [], "", [None])),
        (5, "root_r", json.dumps({"commits": json.loads(dump(one))})), (6, "node_r", json.dumps([{"node": c} for c in json.loads(dump([one]))])), (7, "twice_r", dump([])), (8, "twice_r", dump([one])),
    ]
    spark.createDataFrame(made, "record_id bigint, repo_name string, commits_data string").write.parquet(f"{tmp_path}/commit_dumps.parquet")
    got = {r.repo_name: (r.commits, r.files, r.insertions, r.deletions) for r in repositories.commit_totals(spark, str(tmp_path)).collect()}
    assert got == {"list_r": (1, 2, 6, 4), "object_r": (1, 1, 3, 2), "text_r": (3, 3, 9, 6), "root_r": (1, 1, 3, 2), "node_r": (1, 1, 3, 2), "twice_r": (1, 1, 3, 2)}
