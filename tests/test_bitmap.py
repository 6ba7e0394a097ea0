from quern.functions.bitmap import maybe, split_join


def test_keeps_all_wanted_and_few_others(spark):
    df = spark.range(100_000).selectExpr("id", "id as p")
    wanted = spark.range(0, 100_000, 50)
    got = {r.id for r in maybe(df, wanted, "id").collect()}
    assert set(range(0, 100_000, 50)) <= got and len(got) < 2100
    assert maybe(df, wanted.limit(0), "id").count() == 0


def test_hot_keys_are_split(spark):
    many = spark.range(5_000).selectExpr("if(id % 3 = 0, -1, id % 40) as k", "id")
    one = spark.range(-1, 30).selectExpr("id as k", "id * 2 as v")
    rows = lambda df: sorted(map(tuple, df.select("k", "id", "v").collect()))
    assert rows(split_join(many, one, "k", heavy=200, pieces=5)) == rows(many.join(one, "k")) == rows(split_join(many, one, "k"))
