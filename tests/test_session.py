from tracewright.session import cut_lineage, fresh_path, scratch_root


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch_root(spark) == named
    assert fresh_path(spark, "a").startswith(named) and fresh_path(spark, "a") != fresh_path(spark, "a")
    df = cut_lineage(spark.range(5).selectExpr("id", "array(id * 0.5D) AS v"))
    assert df.count() == 5 and named in df.inputFiles()[0]


def test_empty_tables_keep_their_schema(spark):
    df = cut_lineage(spark.range(0).selectExpr("id", "'x' AS name"))
    assert df.columns == ["id", "name"] and df.count() == 0
