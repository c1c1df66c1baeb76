import datetime as dt
import io
import json
import os
import urllib.error

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audit
from corpusmill.plans import flows
from corpusmill.sources import readers, writers
from corpusmill.streaming import streams
from corpusmill.tasks.registry import TASKS, get_task, register


def test_jsonl(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"id": "a", "error": "x", "other": 1}\n\n{"id": "a", "choices": [{"content": "c"}], "usage": {"prompt_tokens": 3}}\n')
    assert readers.read_jsonl(spark, str(path), "generations").count() == 2
    assert {r.id for r in readers.done_ids(spark, str(path)).collect()} == {"a"}
    path.write_text('{"id": "a", "choices": [{"content": "c"}]}\n{"id": "b", "choi')
    assert {r.id for r in readers.done_ids(spark, str(path)).collect()} == {"a"}
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(path), "generations").collect()
    assert [r.line for r in readers.bad_lines(spark, str(path), "generations").collect()] == ['{"id": "b", "choi']
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("b", None), ("a", "x")], "id string, pred_answer string")
    writers.write_jsonl(rows, out, ["id"])
    lines = [json.loads(x) for f in sorted(os.listdir(out)) if f.endswith(".json") for x in open(os.path.join(out, f))]
    assert lines == [{"id": "a", "pred_answer": "x"}, {"id": "b", "pred_answer": None}]
    writers.write_jsonl(rows, out, append=True, nulls=False)
    assert spark.read.json(out).count() == 4
    manifest = writers.write_manifest(str(tmp_path / "m" / "m.json"), rows.agg(F.count(F.lit(1)).alias("n")), {"seed": 1}, writers.file_digests(spark, str(path)))
    assert manifest["counts"] == {"n": 2} and len(manifest["files"]["g.jsonl"]) == 64
    report = writers.write_report(str(tmp_path / "r" / "r.json"), {"one": rows.limit(1), "all": rows.orderBy("id")}, {"seed": 1})
    assert len(report["all"]) == 2 and json.load(open(tmp_path / "r" / "r.json"))["arguments"] == {"seed": 1} and "## all" in open(tmp_path / "r" / "r.md").read()
    with pytest.raises(ValueError, match="no report"):
        writers.write_report(str(tmp_path / "r.json"), {"all": rows}, most_rows=1)
    assert "| a | n/a |" in writers.markdown(spark.createDataFrame([("a", None)], "x string, y double"))


def test_questions(spark, tmp_path):
    (tmp_path / "sql.json").write_text(json.dumps([{"question_id": 7, "db_id": "d", "question": "q", "SQL": "SELECT 1"}, {"db_id": "e", "question": "r", "SQL": "SELECT 2", "evidence": "h"}]))
    assert [r.id for r in readers.sql_questions(spark, str(tmp_path / "sql.json"), "dev", True).orderBy("id").collect()][-1] == "dev-7"
    assert {(r.id, r.evidence) for r in readers.sql_questions(spark, str(tmp_path / "sql.json"), "train", False).collect()} == {("train-0", ""), ("train-1", "h")}
    (tmp_path / "qa.json").write_text(json.dumps([{"id": "s", "filename": "A/2000/page_1.pdf", "pre_text": ["x"], "post_text": None, "table": [["a"]], "qa": {"question": " a \n b ", "exe_ans": 1.5}}, {"filename": "B", "table": [], "qa": {"question": "c", "exe_ans": "yes"}}]))
    got = {r.id: r for r in readers.qa_questions(spark, str(tmp_path / "qa.json"), "test").collect()}
    assert (got["test-0"].question, got["test-0"].gold_num, got["test-0"].post_text) == ("a b", 1.5, []) and got["test-1"].gold_text == "yes"
    for bad in (True, "NaN", None):
        (tmp_path / "bad.json").write_text(json.dumps([{"qa": {"question": "c", "exe_ans": bad}}]))
        with pytest.raises(Exception, match="no gold answer"):
            readers.qa_questions(spark, str(tmp_path / "bad.json"), "test").collect()


def test_logs_and_lists(spark, tmp_path):
    (tmp_path / "run.log").write_text("elapsed=3s\nx elapsed=12s y\n")
    assert readers.elapsed(spark, str(tmp_path / "run.log")).first().seconds == 12.0
    (tmp_path / "other.log").write_text("nothing\n")
    with pytest.raises(Exception, match="no elapsed time"):
        readers.elapsed(spark, str(tmp_path / "*.log")).collect()
    (tmp_path / "ping.log").write_text("2025-01-01T00:00:00Z 200 ok\n2025-01-01T00:05:00Z 503 no\nstarted up\n\n")
    assert [(r.ts, r.ok) for r in readers.pings(spark, str(tmp_path / "ping.log")).orderBy("ts").collect()] == [(dt.datetime(2025, 1, 1), True), (dt.datetime(2025, 1, 1, 0, 5), False)]
    (tmp_path / "ids.json").write_text('{"tasks": ["a", 2]}')
    assert readers.eval_ids(str(tmp_path / "ids.json")) == ["a", "2"]
    (tmp_path / "groups").write_text("b\n\na\n")
    (tmp_path / "m.json").write_text('{"dbs": ["c"]}')
    assert readers.group_list(f"@{tmp_path}/groups") == ["a", "b"] and readers.group_list(f"@{tmp_path}/m.json") == ["c"] and readers.group_list("x,y") == ["x", "y"]
    for spec in ("", ",", "a b"):
        with pytest.raises(ValueError):
            readers.group_list(spec, valid="^[a-z]+$")
    assert readers.name_paths(["a=b=c"]) == [("a", "b=c")]
    assert spark.createDataFrame([("d",)], "db_id string").select(readers.database_path("/r/", "dev")).first()[0] == "/r/dev_databases/d/d.sqlite"


def test_tasks():
    assert get_task("sql").prediction_key == "pred_sql" and set(TASKS) >= {"sql", "qa"}
    with pytest.raises(ValueError, match="unknown"):
        get_task("none")
    with pytest.raises(ValueError, match="already"):
        register(get_task("qa"))


def test_checks(spark):
    p = "id string, split string, db_id string, messages array<struct<role: string, content: string>>"
    good = [("train-1", "train", "d", [("user", "q")])]
    flows.check_prompts(spark.createDataFrame(good, p), ["e"], "db_id")
    for row, what in ((("dev-1", "train", "d", [("user", "q")]), "start with"), (("train-2", "dev", "d", [("user", "q")]), "another split"), (("train-2", None, "e", [("user", "q")]), "forbidden"), (("train-2", None, "d", [("system", "q")]), "user message"), (("train-1", None, "d", [("user", "q")]), "repeated"), (("train-2", None, None, []), "without a group")):
        with pytest.raises(ValueError, match=what):
            flows.check_prompts(spark.createDataFrame([*good, row], p), ["e"], "db_id")
    with pytest.raises(ValueError, match="empty"):
        flows.check_prompts(spark.createDataFrame(good, p), [], "db_id")
    g = "id string, sample int, correct boolean, pred_sql string"
    prompts = spark.createDataFrame(good, p)
    made = spark.createDataFrame([("train-1", "m", 1.0, [("```sql\nSELECT 1\n```", None, "stop")])], "id string, served_model string, started_at double, choices array<struct<content: string, reasoning_content: string, finish_reason: string>>")
    ok = spark.createDataFrame([("train-1", 0, True, "SELECT 1")], g)
    flows.check_graded(ok, prompts, made)
    flows.check_predictions(ok, made, get_task("sql"))
    for rows, what in ((ok.union(ok), "repeat"), (spark.createDataFrame([("train-2", 0, True, "x")], g), "without a prompt"), (spark.createDataFrame([("train-1", 1, True, "x")], g), "generated choice")):
        with pytest.raises(ValueError, match=what):
            flows.check_graded(rows, prompts, made)
    with pytest.raises(ValueError, match="differ"):
        flows.check_predictions(spark.createDataFrame([("train-1", 0, True, "SELECT 2")], g), made, get_task("sql"))
    rows = ok.withColumns({"pred_answer": F.lit(None).cast("string"), "db_id": F.lit("d"), "report": F.lit(None).cast("string"), "error": F.lit("")})
    records, counts = flows.build_supervised(rows, made, prompts, task=get_task("sql"), forbidden=["e"], cap=None, n=1)
    first = counts.first()
    assert [r.id for r in records.collect()] == ["train-1#s0"] and (first.candidates, first.dropped_excluded, first.written) == (1, 0, 1)
    none, counts = flows.build_supervised(rows, made, prompts, task=get_task("sql"), forbidden=["e"], exclude=["d"])
    assert none.count() == 0 and (counts.first().dropped_excluded, counts.first().written) == (1, 0)
    broken = [(dict(forbidden=[]), "empty"), (dict(forbidden=["d"]), "forbidden"), (dict(graded=rows.union(rows)), "repeat"), (dict(generations=made.union(made)), "more than one"), (dict(graded=rows.withColumn("pred_sql", F.lit("x"))), "differ"), (dict(graded=rows.withColumn("sample", F.lit(7))), "choice"), (dict(prompts=prompts.limit(0)), "without a prompt")]
    for change, what in broken:
        given = dict(graded=rows, generations=made, prompts=prompts, task=get_task("sql"), forbidden=["e"]) | change
        with pytest.raises(ValueError, match=what):
            flows.build_supervised(**given)
        with pytest.raises(ValueError, match=what):
            flows.build_rollouts(**given, samples=1)
    assert flows.build_rollouts(rows, made, prompts, task=get_task("sql"), forbidden=["e"], samples=1).count() == 0


def test_grade_and_audit(spark, tmp_path):
    made = spark.createDataFrame([("test-1", "m", 1.0, [("Answer: 5", None, "stop"), ("Answer: x", None, "stop")])], "id string, served_model string, started_at double, choices array<struct<content: string, reasoning_content: string, finish_reason: string>>")
    items = spark.createDataFrame([("test-1", "test", 5.0, None), ("test-2", "test", 1.0, None)], "id string, split string, gold_num double, gold_text string")
    got = {(r.id, r.sample): (r.correct, r.error) for r in flows.grade_numeric(made, items, get_task("qa")).collect()}
    named = spark.createDataFrame([("q", 0, True, ""), ("q", 1, False, "no_sql"), ("r", 0, False, "no_sql")], "id string, sample int, correct boolean, error string").withColumn("row_id", F.monotonically_increasing_id())
    report = flows.grade_report(named, spark.createDataFrame([("q", "easy"), ("r", None)], "id string, difficulty string"), str(tmp_path / "grades.json"))
    assert report["summary"]["questions"] == 2 and report["failures"]["kind"] == "no_sql" and len(report["difficulty"]) == 2
    runs = spark.createDataFrame([("recipe", "d", 2.0, 1e12, 2e12)], "role string, device string, hours double, model_ops double, hardware_ops double")
    assert flows.compute_report(runs, str(tmp_path / "compute.json"))["roles"]["runs"] == 1
    assert got == {("test-1", 0): (True, ""), ("test-1", 1): (False, "no_answer"), ("test-2", 0): (False, "no_answer")}
    records = spark.createDataFrame([("train-1#s0", "t", None, [("user", "Q: what now?")], "x")], "id string, db_id string, report string, messages array<struct<role: string, content: string>>, response string")
    schema = "id string, split string, kind string, group_key string, question string, evidence string, gold_sql string, gold_num double, gold_text string"
    questions = spark.createDataFrame([("train-1", "train", "sql", "t", "What now?", None, "SELECT 1", None, None), ("dev-1", "dev", "sql", "e", "else", None, None, None, None)], schema)
    report, clean = flows.audit_records(records, questions, str(tmp_path / "audit"))
    assert clean and report["records"] == 1 and os.path.exists(tmp_path / "audit" / "audit.json")
    leaked = questions.union(spark.createDataFrame([("dev-2", "dev", "sql", "e", "what now", None, None, None, None)], questions.schema))
    assert not flows.audit_records(records, leaked)[1] and audit.rule_counts(audit.record_flags(records, leaked)).first().exact == 1


def test_guard_stream(spark, tmp_path):
    folder = tmp_path / "metrics"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"event": "optimizer_step", "step": 1, "kl": 0.1}\n{"event": "optimizer_step", "step": 2, "kl": NaN}\nnot json\n{"event": "other", "step": 3, "kl": 9}\n{"event": "optimizer_step", "step": 4}\n{"event": "optimizer_step", "step": 5, "kl": Infinity}\n{"event": "optimizer_step", "step": 6, "kl": 0.5}\n')
    stream = streams.read_metrics(spark, str(folder), "event string, step int, kl double")
    streams.run_once(streams.guard(stream), str(tmp_path / "rows"), str(tmp_path / "state"))
    assert sorted(r.step for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [2, 5, 6]
    stopped = []
    streams.stop_on_divergence(stream, lambda row: stopped.append(row.step), str(tmp_path / "state2"), once=True).awaitTermination()
    assert stopped == [2]


def test_late_and_repeated_rows(spark, tmp_path):
    rows = [("a", dt.datetime(2025, 1, 1, 10), True), ("a", dt.datetime(2025, 1, 1, 10), True), ("b", dt.datetime(2025, 1, 1, 9), None), ("c", dt.datetime(2025, 1, 5), True)]
    spark.createDataFrame(rows, "id string, loaded_at timestamp, correct boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, loaded_at timestamp, correct boolean").parquet(str(tmp_path / "in"))
    streams.run_once(streams.unseen(stream, "id", "loaded_at", "1 day"), str(tmp_path / "u"), str(tmp_path / "us"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "u")).collect()) == ["a", "b", "c"]
    streams.run_once(streams.windowed_accuracy(stream, delay="1 day"), str(tmp_path / "w"), str(tmp_path / "ws"))
    first = spark.read.parquet(str(tmp_path / "w")).orderBy("started").first()
    assert (first.rows, first.correct) == (3, 2)


def test_uptime_stream(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [("x", at(0), True), ("x", at(5), True), ("x", at(7), False), ("x", at(9), True), ("x", at(60), True), ("y", at(1), False)]
    spark.createDataFrame(rows, "endpoint string, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("endpoint string, ts timestamp, ok boolean").parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    streams.run_once(streams.uptime_stream(stream), str(tmp_path / "out"), str(tmp_path / "st"))
    got = sorted((r.endpoint, r.pings, r.seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("x", 1, 300.0), ("x", 2, 600.0)]


def test_entry_and_queries(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    named, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(named)
    got = named["grade_summary"](spark, sf).first()
    assert got.questions > 0
    assert named["kl_guard"](spark, sf).count() > 0


def test_chat_source(spark):
    from corpusmill.sources import chat

    class Reply:
        def __init__(self, body):
            self.body = body

        def read(self, *_):
            return self.body

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    calls, waits = [], []

    def opener(request, timeout):
        calls.append((request.full_url, request.get_header("Authorization")))
        if len(calls) < 3:
            raise TimeoutError("slow")
        return Reply(b'{"choices": []}')

    asked = chat.Endpoint("http://x/v1/", key="k", send=opener, pause=waits.append)
    assert asked.complete({}) == {"choices": []} and waits == [5.0, 10.0] and calls[0] == ("http://x/v1/chat/completions", "Bearer k")

    def never(request, timeout):
        raise TimeoutError("slow")

    with pytest.raises(chat.ChatError, match="tried 2 times"):
        chat.Endpoint("http://x", send=never, pause=waits.append, policy=chat.RetryPolicy(tries=2)).complete({})

    def refuse(code, text, then=()):
        replies = [urllib.error.HTTPError("http://x", code, "no", {}, io.BytesIO(text)), *then]

        def send(request, timeout):
            reply = replies.pop(0) if len(replies) > 1 else replies[0]
            if isinstance(reply, Exception):
                raise reply
            return reply

        return send

    # an endpoint that starts up says so under any status; another refusal is final at once
    assert chat.Endpoint("http://x", send=refuse(400, b"Model not yet ready", (Reply(b"{}"),)), pause=waits.append).complete({}) == {}
    with pytest.raises(chat.ChatError, match="status 400") as refused:
        chat.Endpoint("http://x", send=refuse(400, b"bad"), pause=waits.append).complete({})
    assert refused.value.tries == 1
    policy = chat.RetryPolicy()
    assert policy.allows(429, "") and policy.allows(None, "") and policy.allows(403, "in Scale-Up") and not policy.allows(425, "") and not policy.allows(400, "bad")
    assert policy.pauses()[:3] == [5.0, 10.0, 20.0] and max(policy.pauses()) == 300.0 and len(policy.pauses()) == 15

    class Served:
        def __init__(self, address):
            self.address = address

        def complete(self, body):
            if body["messages"][0]["content"] == "bad":
                raise ValueError("no")
            return {"model": "m", "choices": [{"message": {"content": self.address}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": body["n"]}}

    prompts = spark.createDataFrame([("a", [("user", "x")]), ("b", [("user", "bad")])] + [(f"c{i}", [("user", "x")]) for i in range(30)], "id string, messages array<struct<role: string, content: string>>").coalesce(1)
    got = chat.generate(prompts, ["http://1", "http://2"], {"n": 4}, under_way=3, rows_a_batch=7, connect=Served).collect()
    rows = {r.id: r for r in got}
    assert rows["a"].choices[0].finish_reason == "stop" and rows["a"].usage.completion_tokens == 4 and rows["b"].error == "ValueError: no" and rows["b"].choices is None
    assert [r.id for r in got] == ["a", "b"] + [f"c{i}" for i in range(30)] and [r.endpoint for r in got[:3]] == ["http://1", "http://2", "http://1"]
    with pytest.raises(ValueError, match="endpoints"):
        chat.generate(prompts, [], {})
