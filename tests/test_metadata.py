import json

from quern.plans import repositories


def test_metadata_from_the_text(spark, tmp_path):
    info = {"language": " Go ", "stargazers_count": 7, "forks": "3", "size": {"kb": 1}, "created_at": "2020-01-01T00:00:00Z", "topics": ["a", {"name": "b"}, None, ""]}
    rows = [
        ("null_r", json.dumps(info), None, None, None, None, None, None), ("empty_r", json.dumps(json.dumps(info)), "", 1, 2, 3, "", "x"), ("own_r", json.dumps(info), "C", 1, 2, 3, "c", "u"),
        ("cut_r", json.dumps(info)[:-3], None, None, None, None, None, None), ("one_r", json.dumps({"topics": "t", "language": None}), None, None, None, None, None, None), ("text_r", json.dumps({"topics": json.dumps(["t", "u"])}), None, None, None, None, None, None), ("no_r", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "repo_name string, repo_info string, language string, stars bigint, forks bigint, size bigint, repo_created_at string, repo_updated_at string")
    df.selectExpr("*", "timestamp'2024-01-01' as created_at").write.parquet(f"{tmp_path}/repos.parquet")
    got = {r.repo_name: tuple(r)[1:] for r in repositories.repo_metadata(spark, str(tmp_path)).collect()}
    day, none = "2020-01-01T00:00:00Z", (None,) * 6
    assert got == {
        "null_r": ("Go", 7, 3, None, day, None, ["a", "b"]), "empty_r": ("Go", 1, 2, 3, day, "x", ["a", "b"]), "own_r": ("C", 1, 2, 3, "c", "u", ["a", "b"]),
        "cut_r": (*none, []), "one_r": (*none, ["t"]), "text_r": (*none, ["t", "u"]), "no_r": (*none, []),
    }
