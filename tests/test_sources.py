import json

import pytest

from tracewright import schemas
from tracewright.operators import curation as C
from tracewright.plans.registry import QUERIES
from tracewright.sources import blobs, sinks, tables
from tracewright.streaming import incremental as I


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"records": records}))


def record(i, score, **more):
    return {"index": f"q{i}", "prompt": f"p{i}", "ground_truth": "1", "score": score} | more


def test_blobs(spark, tmp_path):
    ds = tmp_path / "results" / "bench" / "aime"
    write(ds / "m one" / "20240101.json", [record(1, 0.0)])
    write(ds / "m one" / "20250101.json", [record(1, 1.0), record(2, 0.5, prompt="", origin_query="orig"), record(3, None)])
    write(ds / "m2+b" / "20240101.json", [record(1, 0.6, prompt="other")])
    (ds / "empty").mkdir()
    where = blobs.find_dataset_dir(spark, str(tmp_path), "aime")
    dirs = blobs.find_model_dirs(spark, where)
    assert [d.rsplit("/", 1)[1] for d in dirs] == ["m one", "m2+b"]
    pool = C.pool_records(blobs.read_latest_records(spark, dirs))
    got = {(r["model"], r["qid"], r["query"], r["correct"]) for r in pool.collect()}
    assert got == {("m one", "q1", "p1", 1), ("m one", "q2", "orig", 0), ("m2+b", "q1", "other", 1)}
    assert {r["qid"]: r["query"] for r in C.pool_questions(pool).collect()} == {"q1": "p1", "q2": "orig"}
    with pytest.raises(FileNotFoundError, match="aime"):
        blobs.find_dataset_dir(spark, str(tmp_path), "nope")


def test_splits(spark, tmp_path):
    for split in ("test", "valid"):
        write(tmp_path / "ds" / split / "m" / "1.json", [record(1, 1.0)])
    where = blobs.find_dataset_dir(spark, str(tmp_path), "ds")
    assert [d.split("/")[-2:] for d in blobs.find_model_dirs(spark, where, "valid")] == [["valid", "m"]]
    with pytest.raises(ValueError, match="several splits"):
        blobs.find_model_dirs(spark, where)
    with pytest.raises(ValueError, match="'none' not found"):
        blobs.find_model_dirs(spark, where, "none")


def test_key_list_and_questions(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("q1\n\n q2 \nq1\n")
    assert sorted(r["qid"] for r in tables.read_key_list(spark, str(tmp_path / "keys.txt")).collect()) == ["q1", "q2"]
    q = spark.createDataFrame([("q1", "été 日本", "5")], schemas.QUESTIONS)
    sinks.write_questions(q, str(tmp_path / "q.jsonl"))
    assert "été 日本" in "".join(p.read_text() for p in (tmp_path / "q.jsonl").glob("part-*"))
    assert [tuple(r) for r in tables.read_questions(spark, str(tmp_path / "q.jsonl")).collect()] == [("q1", "été 日本", "5")]


def test_tables_and_documents(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.append_table(spark.createDataFrame([("a", 1)], "qid string, correct int"), out)
    sinks.append_table(spark.createDataFrame([("b", 0)], "qid string, correct int"), out)
    assert tables.done_keys(spark, out, ["qid"]).count() == 2
    other = str(tmp_path / "u")
    sinks.append_table(spark.createDataFrame([("a", 0, 3)], "qid string, correct int, extra int"), other)
    both = tables.read_traces(spark, out, other)
    last = {r["qid"]: (r["correct"], r["extra"]) for r in tables.last_per_key(both, ["qid"]).collect()}
    assert last == {"a": (0, 3), "b": (0, None)}
    doc = sinks.result_document(spark.createDataFrame([(1, 0.5, "x")], "layer int, auc double, probe string"), "sweep", ["probe"])
    assert json.loads(doc.first()["document"]) == {"layer": 1, "auc": 0.5}
    sinks.write_result(doc, str(tmp_path / "doc"))
    states = spark.createDataFrame([("q", 0, k, 0, 0, 1, 1, [1.0]) for k in range(3)], schemas.STATES)
    sinks.write_states(states, str(tmp_path / "states"), "decode")
    sinks.write_states(states, str(tmp_path / "states"), "prefill")
    assert tables.read_states(spark, str(tmp_path / "states"), "decode", [1, 2]).count() == 2
    plan = spark.read.parquet(str(tmp_path / "states")).where("layer = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan
    assert tables.model_path("traces_{model}.parquet", "w") == "traces_w.parquet"


def test_mixed_layout_is_named(spark, tmp_path):
    """Folders with files directly inside are models; the others of a mixed level are named in a warning."""
    for folder in ("m1", "m2", "split/m3"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.json").write_text("{}")
    with pytest.warns(UserWarning, match="not \\['split'\\]"):
        assert [m.rsplit("/", 1)[1] for m in blobs.find_model_dirs(spark, str(tmp_path))] == ["m1", "m2"]


def test_blobs_are_read_once(spark, tmp_path):
    """Scores of every kind, and no seek in the file for each of them."""
    kinds = {0.25: 0.25, "0.75": 0.75, True: 1.0, None: None, 12: 12.0, "x": None, 1e-7: 1e-7}
    odd = [*kinds, {"a": 1}, [0.5]]
    file = tmp_path / "pool" / "m" / "1.json"
    write(file, [record(i, odd[i % len(odd)]) for i in range(4500)])

    def bytes_read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = bytes_read()
    rows = blobs.read_latest_records(spark, [str(tmp_path / "pool" / "m")])
    assert rows.schema["score"].dataType.simpleString() == "string"
    got = {r["index"]: r["s"] for r in rows.select("index", C.as_score(rows["score"]).alias("s")).collect()}
    assert bytes_read() - before < 4 * file.stat().st_size
    assert got == {f"q{i}": kinds[odd[i % len(odd)]] if i % len(odd) < len(kinds) else None for i in range(4500)}


def answers(spark, path, rows):
    body = lambda t: json.dumps({"choices": [{"message": {"content": t}, "finish_reason": "stop"}]})
    df = spark.createDataFrame([(q, s, "m", st, body(t)) for q, s, st, t in rows],
                               "qid string, sample_idx int, model string, status int, body string")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_resumable_scoring(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    questions = spark.createDataFrame([(f"q{i}", "", "B") for i in range(3)], schemas.QUESTIONS)
    first = [(f"q{i}", s, 200 if (i + s) % 2 == 0 else 503, "(B)") for i in range(3) for s in range(2)]
    schema = answers(spark, src, first + first[:1])

    def run(checkpoint):
        stream = I.response_stream(spark, src, schema, files_per_trigger=1)
        I.scored_stream(stream, questions, out, str(tmp_path / checkpoint)).awaitTermination()
        rows = spark.read.parquet(out).collect()
        return rows, spark.read.schema(schemas.ERRORS).json(I.side_car(out)).count()

    rows, errors = run("c1")
    assert len(rows) == 3 and errors == 3 and all(r["correct"] == 1 for r in rows)
    assert run("c1")[0].__len__() == 3
    # a fresh checkpoint sees everything again and still adds nothing to the results
    rows, _ = run("c2")
    assert len(rows) == 3
    # failed keys are open: a second answer fills one of them
    answers(spark, src, [("q0", 1, 200, "(C)"), ("q0", 0, 200, "(C)")])
    rows, _ = run("c1")
    assert {(r["qid"], r["sample_idx"]): r["correct"] for r in rows} == {
        ("q0", 0): 1, ("q1", 1): 1, ("q2", 0): 1, ("q0", 1): 0}


def test_repeated_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    schema_path = str(tmp_path / "in")
    answers(spark, schema_path, [("q0", 0, 200, "(B)"), ("q0", 1, 500, "")])
    questions = spark.createDataFrame([("q0", "", "B")], schemas.QUESTIONS)
    for _ in range(2):
        I.score_batch(spark.read.parquet(schema_path), questions, out, "r", 0)
    assert spark.read.parquet(out).count() == 1
    assert spark.read.json(I.side_car(out)).count() == 1


def test_usable_answer_wins_within_a_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    answers(spark, src, [("q0", 0, 503, ""), ("q0", 0, 200, "(B)"), ("q0", 0, 200, "(C)"), ("q1", 0, 503, "")])
    questions = spark.createDataFrame([("q0", "", "B"), ("q1", "", "B")], schemas.QUESTIONS)
    I.score_batch(spark.read.parquet(src), questions, out, "r", 0)
    assert [(r["qid"], r["correct"]) for r in spark.read.parquet(out).collect()] == [("q0", 1)]
    assert [r["qid"] for r in spark.read.json(I.side_car(out)).collect()] == ["q1"]


def test_state_knows_what_is_done(spark, tmp_path):
    """Twenty batches; the query that goes on from them has another, empty output, and still repeats nothing."""
    src, state = str(tmp_path / "in"), str(tmp_path / "c")
    questions = spark.createDataFrame([(f"q{i}", "", "B") for i in range(4)], schemas.QUESTIONS)
    for k in range(20):
        schema = answers(spark, src, [(f"q{k % 4}", k // 8, 200 if k % 3 else 503, "(B)"), ("q0", 0, 200, "(B)")])

    def run(out):
        stream = I.response_stream(spark, src, schema, files_per_trigger=1)
        query = I.scored_stream(stream, questions, str(tmp_path / out), state)
        query.awaitTermination()
        return query
    first = run("a")
    assert first.lastProgress["batchId"] >= 19
    done = {(r["qid"], r["sample_idx"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert done == {(f"q{k % 4}", k // 8) for k in range(20) if k % 3} | {("q0", 0)}
    assert spark.read.parquet(str(tmp_path / "a")).count() == len(done)
    answers(spark, src, [("q1", 0, 200, "(B)"), ("q2", 2, 200, "(B)"), ("new", 0, 200, "(B)"), ("q0", 0, 503, "")])
    run("b")
    added = {(r["qid"], r["sample_idx"]) for r in spark.read.parquet(str(tmp_path / "b")).collect()}
    assert added == {("q2", 2), ("new", 0)} - done
    assert spark.read.schema(schemas.ERRORS).json(I.side_car(str(tmp_path / "b"))).count() == 0
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "HDFS" in provider  # as it was before


def test_snapshots_of_counters(spark, tmp_path, monkeypatch):
    """One snapshot and a tail are read, also after a failure between a snapshot and its manifest."""
    path = str(tmp_path / "counts")

    def put(n):
        rows = [("all", n + 1, n), (f"m{n % 3}", n, 0)]
        spark.createDataFrame(rows, "model string, n long, n_correct long").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={n}")

    def now():
        return {r["model"]: (r["n"], r["n_correct"]) for r in I.current_counts(spark, path).collect()}
    for n in range(12):
        put(n)
        if n % 4 == 3:
            I.compact(spark, path, n)
    want = {"all": (12, 11), "m0": (9, 0), "m1": (10, 0), "m2": (11, 0)}
    assert now() == want
    assert I._numbers(spark, path, "batch_id=") == [8, 9, 10, 11] and I._numbers(spark, f"{path}/_manifest", "upto=") == [7, 11]
    assert len(I._stored_counts(spark, path).inputFiles()) == len(spark.read.parquet(f"{path}/_snapshot/upto=11").inputFiles())
    put(12)

    def fail(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(I, "_commit", fail)
        with pytest.raises(OSError):
            I.compact(spark, path, 12)
    want |= {"all": (13, 12), "m0": (12, 0)}
    assert now() == want and I._numbers(spark, f"{path}/_manifest", "upto=") == [7, 11]
    I.compact(spark, path, 12)
    I.compact(spark, path, 12)
    put(12)  # a repeated batch after its snapshot
    assert now() == want and I._numbers(spark, f"{path}/_manifest", "upto=") == [11, 12]


def test_late_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select 'q' qid, 0 sample_idx, timestamp'2024-01-01 00:00:00' ts union all "
              "select 'q', 0, timestamp'2024-01-01 00:10:00' union all select 'q', 1, timestamp'2024-01-01 00:00:00'"
              ).write.parquet(src)
    stream = I.response_stream(spark, src, spark.read.parquet(src).schema)
    q = I.first_arrivals(stream, "ts").writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrivals").count() == 2


def test_running_rates(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "model string, correct int"
    for rows in ([("a", 1), ("b", 0)], [("a", 0), ("a", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = I.response_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    I.update_counts(I.running_pass_rates(stream), str(tmp_path / "o"), str(tmp_path / "c"), every=1).awaitTermination()
    got = {r["model"]: (r["n"], r["n_correct"]) for r in I.current_counts(spark, str(tmp_path / "o")).collect()}
    assert got == {"a": (3, 2), "b": (1, 0)}


def test_scores_of_every_kind(spark, tmp_path):
    folder = tmp_path / "d" / "mA" / "run1"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text(json.dumps({"records": [
        record(1, True), record(2, "1.0"), record(3, 0.2), record(4, False), record(5, "good"), record(6, None), {"index": None, "score": 1}]}))
    dirs = blobs.find_model_dirs(spark, str(tmp_path / "d"), layout="models")
    rows = blobs.read_latest_records(spark, dirs)
    assert {r["qid"]: r["correct"] for r in C.pool_records(rows).collect()} == {"q1": 1, "q2": 1, "q3": 0, "q4": 0}
    assert C.unusable_records(rows).first().asDict() == {"model": "mA", "n": 7, "no_qid": 1, "no_query": 1, "no_score": 2}
    with pytest.raises(ValueError):
        blobs.find_model_dirs(spark, str(tmp_path / "d"), layout="flat")


def test_last_file_of_repeated_keys(spark):
    rows = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0]), ("a", 1, [2.0]), ("b", 0, [3.0])], "qid string, file_rank int, v array<double>")
    assert {r["qid"]: r["v"] for r in tables.last_per_key(rows, ["qid"]).collect()} == {"a": [2.0], "b": [3.0]}


def test_streams_of_tables_in_part_files(spark, tmp_path):
    """A table may be one file or a folder of files; both arrive whole."""
    few = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 12")
    few.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    want = few.where("turn % 4 = 0 and role in ('assistant', 'user') and trim(text) <> ''").count()
    got = QUERIES["stream_scored"](spark, str(tmp_path))
    assert want > 0 and got.count() == want == got.select("qid", "sample_idx").distinct().count()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["stream_pass_rate"](spark, str(tmp_path)).agg({"n": "sum"}).first()[0] == events.count()
