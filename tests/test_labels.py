import pytest
from pyspark.sql import functions as F

from tracewright.operators import curation as C, labels as L


@pytest.fixture
def data(spark):
    w = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 0), ("e", None)], "qid string, correct int")
    s = spark.createDataFrame(
        [("a", 1, "m"), ("a", 1, "m"), ("a", 0, "m"), ("b", 1, "m"), ("b", 0, "m"), ("c", 0, "m"), ("e", 1, "n")],
        "qid string, correct int, model string")
    return w, s


def labels_of(df):
    return {r["qid"]: r["label"] for r in df.collect()}


def test_label_rules(data):
    w, s = data
    stats = L.pass_stats(s)
    assert labels_of(L.label_outcomes(w, stats)) == {"a": 0, "b": 1, "d": 1}
    assert labels_of(L.label_outcomes(w, stats, "salvageable")) == {"a": 0, "b": 1, "d": 0}
    assert labels_of(L.label_outcomes(w, stats, "drop")) == {"a": 0, "b": 1}
    assert labels_of(L.label_outcomes(w, stats, null_policy="wrong")) == {"a": 0, "b": 1, "d": 1, "e": 0}
    with pytest.raises(Exception, match="without strong-model samples"):
        L.label_outcomes(w, stats, "error").collect()
    assert [r["qid"] for r in L.missing_strong_questions(w, stats).collect()] == ["d"]
    with pytest.raises(ValueError):
        L.label_outcomes(w, stats, "maybe")


def test_one_model(data):
    _, s = data
    assert L.one_model(s, "n").count() == 1
    assert L.one_model(s.where("model = 'm'"), "other").count() == 6
    with pytest.raises(ValueError, match="'m', 'n'"):
        L.one_model(s, "z")
    with pytest.raises(ValueError):
        L.one_model(s, None, require_name=True)


@pytest.mark.parametrize("labels,status", [
    ([], "too_few_rows"), ([1] * 40, "one_class"), ([1] * 35 + [0] * 5, "small_cell"), ([1] * 20 + [0] * 20, "ok")])
def test_gates(spark, labels, status):
    df = spark.createDataFrame([(v,) for v in labels], "label int")
    assert L.sample_gates(df).first()["status"] == status


def test_curation(spark):
    raw = spark.createDataFrame([(3, "p3", "12"), (1, "p1", "x"), (2, "p2", " 7 "), (4, "p4", "1.5")],
                                "id int, problem string, answer string")
    assert [tuple(r) for r in C.curate_raw_questions(raw, limit=3).orderBy("qid").collect()] == [
        ("aime_2", "p2", "7"), ("aime_3", "p3", "12")]
    with pytest.raises(ValueError, match="answer"):
        C.curate_raw_questions(raw.drop("answer"))


def test_work_and_shards(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(23)], "qid string")
    done = spark.createDataFrame([("q1", 0), ("q1", 1), ("q9", 2)], "qid string, sample_idx int")
    assert C.pending_work(q, 3, done).count() == 23 * 3 - 3
    assert C.work_grid(q, 0).count() == 0
    sizes = [r["n"] for r in C.shard(q, ["qid"], 4).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [5, 6, 6, 6]
    parts = [set(r["qid"] for r in C.shard(q, ["qid"], 4, i).collect()) for i in range(4)]
    assert len(set().union(*parts)) == 23
    with pytest.raises(ValueError):
        C.shard(q, ["qid"], 4, 4)


def test_pass_at_k_of_unscored_questions(spark):
    from tracewright.operators import difficulty as DI
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("b", None)], "qid string, correct int")
    got = {r["qid"]: (r["total_samples"], r["pass_at_1"], r["difficulty"]) for r in DI.pass_at_k(rows).collect()}
    assert got == {"a": (0, 0.0, 1.0), "b": (1, 1.0, 0.0)}
