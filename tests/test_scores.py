from pyspark.sql import functions as F

from quern import dims
from quern.operators import keywords as kw
from quern.operators import labels as lb
from quern.operators import languages as lg


def files(spark, *texts, path="src/a{}.py"):
    return spark.createDataFrame([("r", path.format(i), t, "text") for i, t in enumerate(texts)], "repo_name string, file_path string, content string, content_type string")


def weights(spark, t):
    return {r.token: r.weight for r in kw.found_keywords(kw.features(files(spark, t))).collect()}


def test_contexts_requires_and_excludes(spark):
    assert weights(spark, "backdoor = 1") == {"backdoor": 90.0}
    assert weights(spark, "def backdoor(): 1")["backdoor"] == 180.0
    assert weights(spark, "def Backdoor(): 1")["backdoor"] == 90.0  # names keep their case, tokens don't
    assert abs(weights(spark, "x = 1 # backdoor\nbackdoor()")["backdoor"] - 36.0) < 1e-9
    assert abs(weights(spark, "payload = 1")["payload"] - 56.25 * 0.3) < 1e-9
    assert weights(spark, "payload = inject")["payload"] == 84.375
    assert "exploit" not in weights(spark, "exploit = test")
    assert weights(spark, "mybackdoor = 1") == {"mybackdoor": 45.0}
    assert weights(spark, "door = 1") == {"door": 45.0}
    assert weights(spark, "zzz = qqq") == {}


def test_partial_is_the_first_of_all_63(spark):
    f = kw.features(files(spark, "are ctreate write read zork shell x_password yyy"))
    got = {r.token: r.keyword for r in kw.partial_matches(f).collect()}
    tokens = ["are", "ctreate", "write", "read", "zork", "shell", "x_password", "yyy"]
    want = {}
    for t in tokens:
        k = next((k["keyword"] for k in dims.keywords() if t in k["keyword"] or k["keyword"] in t), None)
        if k and t not in {k["keyword"] for k in dims.keywords()}:
            want[t] = k
    assert got == want and "are" in got


def test_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (19.99, 20.0, 39.99, 40.0, 59.99, 60.0, 80.0)], "s double")
    assert [r[0] for r in df.select(kw.level(F.col("s"))).collect()] == ["BENIGN", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL"]
    v = spark.createDataFrame([(2, 2), (3, 0), (2, 3), (0, 5)], "m int, s int").select(lb.verdict("m", "s")).collect()
    assert [r[0] for r in v] == [False, True, True, True]


def test_file_score_by_hand(spark):
    r = kw.file_scores(kw.features(files(spark, "keylogger backdoor", path="x/hack{}.sh"))).first()
    assert r.keyword_score == 100 * 1.5 + 90 and r.context_score == 70 and r.total_score == 310 and abs(r.normalized_score - 62) < 1e-9
    assert r.severity_level == "HIGH" and r.is_malicious and sorted(r.critical) == ["backdoor", "keylogger"]


def test_repo_score_and_empty(spark):
    f = kw.features(files(spark, "download = 1", "execute = payload", "pass"))
    r = kw.repo_scores(f).first()
    assert r.cross_file_score == 23.0 and r.analyzed_files == 3 and r.critical_count == 0
    assert kw.repo_scores(kw.features(files(spark, "x").limit(0))).count() == 0


def test_plans(spark):
    """No Python workers, no cross joins, no shuffle before the repositories' aggregation but the removal of repeats."""
    plan = kw.file_scores(kw.features(spark.read.parquet("/root/testdata/sf0.001/files.parquet")), scan=True)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan and "Join" not in plan
    assert plan.count("Exchange") <= 1 and "PushedFilters: [IsNotNull(content_type), EqualTo(content_type,text)" in plan


def test_languages(spark):
    f = spark.createDataFrame([("a", "x.h"), ("a", "y.py"), ("b", "go.mod"), ("b", "a.py"), ("c", "x.zzz")], "repo_name string, file_path string")
    assert {(r[0], r[1]) for r in lg.extension_language(f).collect()} == {("a", "Python"), ("b", "Python"), ("c", None)}
    assert {r.repo_name: (r.language, r.votes) for r in lg.language_votes(f).collect()} == {"a": ("python", 1), "b": ("go", 10), "c": ("unknown", 0)}
    info = spark.createDataFrame([(x,) for x in ('{"language": " Go "}', '{"language": null}', '{"language": ""}', "{}", "{", None, '"{\\"language\\": \\"C\\"}"', '{"language": 3}', "[]")], "i string")
    assert [r[0] for r in info.select(lg.info_language(F.col("i"))).collect()] == ["Go", None, None, None, None, None, "C", None, None]


def test_replies(spark):
    texts = ['{"score": 7, "reasoning": "x"}', '```json\n{"score": "2.5"}\n```', "no json", None, "[1]", '{"reasoning": "y"}']
    s, r = lb.parsed_reply(F.col("t"))
    got = [tuple(x) for x in spark.createDataFrame([(t,) for t in texts], "t string").select(s, r).collect()]
    assert got == [(7.0, "x"), (2.5, ""), (0.0, "no json"), (0.0, "Analysis failed"), (0.0, "[1]"), (0.0, "y")]


def test_latest_and_insert_ignore(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), (None, 1, "n")], "k string, v int, c string")
    assert {tuple(r) for r in lb.latest(df, ["k"], "v", ["c"]).collect()} == {("a", 2, "z"), ("b", None, "q"), (None, 1, "n")}
    old = spark.createDataFrame([("a", 0)], "k string, v int")
    new = spark.createDataFrame([("a", 5), ("b", 3), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in lb.insert_ignore(old, new, "k").collect()} == {("a", 0), ("b", 2)}


def test_nested_conditions_and_guards(spark):
    word, pattern = lambda v: {"type": "keyword", "value": v}, lambda v: {"type": "pattern", "value": v}
    rule = {"rule": "own", "all_of": [], "n": 0, "n_of": [], "any_of": [], "patterns": [{"type": "or", "conditions": [{"type": "and", "conditions": [word("a"), pattern("p(")]}, word("b")]}], "file_extensions": [".py"], "max_file_size": 10}
    df = spark.createDataFrame([(["a"], ["p("], ".py", 5), (["a"], [], ".py", 5), (["b"], None, ".py", 5), (["b"], [], ".js", 5), (["b"], [], ".py", 11), (None, [], ".py", 5)], "found array<string>, patterns array<string>, ext string, size int")
    assert [r[0] for r in df.select(kw.rule_matches(F.col("found"), rule, F.col("patterns"), F.col("ext"), F.col("size"))).collect()] == [True, False, True, False, False, False]
    none = {"rule": "none", "all_of": [], "n": 0, "n_of": [], "any_of": []}
    assert not any(r[0] for r in df.select(kw.rule_matches(F.col("found"), none)).collect())
    assert not any(r[0] for r in df.select(kw.condition({"type": "other"}, F.col("found"), F.col("patterns"))).collect())


def test_first_values(spark):
    from quern.operators.topn import first_values

    df = spark.createDataFrame([("a", x) for x in "dcbacba"] + [("b", None), (None, "z")], "g string, v string")
    assert {r.g: r.first for r in first_values(df, "g", "v", 2).collect()} == {"a": ["a", "b"], None: ["z"]}


def test_repeated_rows_and_other_content_under_one_key(spark):
    """A file's row counts once, however often it stands; two contents under one key are two rows."""
    one = files(spark, "backdoor = 1")
    both = one.union(one).union(one.selectExpr("repo_name", "file_path", "'keylogger = 1' as content", "content_type"))
    assert kw.repo_scores(kw.features(both)).first().analyzed_files == 2
    assert sorted(r.token for r in kw.found_keywords(kw.features(both)).collect()) == ["backdoor", "keylogger"]
