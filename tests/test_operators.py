import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import accounting, advantage, audit, batching, grading, metrics, prompts, ranking, selection

GRADED = "row_id bigint, id string, sample int, correct boolean, error string, gold_error string, pred_sql string, pred_answer string, db_id string, report string, n int"


def graded(spark, rows):
    """(id, sample, correct, error, pred_sql) rows; with an extra column whose name operators use themselves."""
    return spark.createDataFrame([(i, q, s, c, e, None, p, None, "d", None, 7) for i, (q, s, c, e, p) in enumerate(rows)], GRADED)


@pytest.fixture(scope="module")
def some(spark):
    return graded(spark, [("a", 0, True, "", "x"), ("a", 1, False, "wrong: 1", "y"), ("b", 1, None, "timeout: 30", "z"), ("b", 0, False, None, "z"), ("c", 0, True, "", "x"), ("c", 0, False, "", "x")])


def test_grouped_rank_is_exact(spark):
    rows = spark.createDataFrame([(f"g{i % 3}" if i % 5 else None, f"k{i}", i % 7) for i in range(500)], "g string, k string, w int")
    out = ranking.grouped_rank(rows, ["g"], F.col("k"), weight="w", buckets=8).collect()
    import hashlib

    for g in {r.g for r in out}:
        own = sorted((r for r in out if r.g == g), key=lambda r: hashlib.md5(r.k.encode()).hexdigest())
        assert [r["rank"] for r in own] == list(range(len(own)))
        total = 0
        for r in own:
            assert r.before == total
            total += r.w
    placed = ranking.grouped_rank(rows.withColumn("p", F.col("w") / 7), [], F.col("k"), position=F.col("p"), buckets=4).orderBy("rank").collect()
    assert [r.w for r in placed] == sorted(r.w for r in placed) and len(placed) == 500
    assert ranking.grouped_rank(rows.limit(0), ["g"], F.col("k")).count() == 0


def test_metrics(spark, some):
    once = metrics.once(some)
    assert once.count() == 5
    got = metrics.summary(once).first()
    assert (got.questions, got.rows, got.accuracy_first) == (3, 5, round(200 / 3, 6))
    assert got.accuracy_mean == round((0.5 + 0 + 1) / 3 * 100, 6)
    assert {(r.kind, r.questions) for r in metrics.failures(once).collect()} == {("wrong_result", 1)}
    k = metrics.pass_at_k(once).first()
    assert (k.pass_k, k.mixed, k.all_correct, k.all_wrong, k.sample_counts) == (round(200 / 3, 6), round(100 / 3, 6), round(100 / 3, 6), round(100 / 3, 6), [1, 2])
    empty = metrics.summary(some.limit(0)).first()
    assert (empty.questions, empty.rows, empty.accuracy_first) == (0, 0, None)
    items = spark.createDataFrame([("a", "hard"), ("b", "")], "id string, difficulty string")
    assert {(r.difficulty, r.questions) for r in metrics.by_group(once, items, "difficulty").collect()} == {("hard", 1), ("all", 2)}


def test_paired(spark):
    a = spark.createDataFrame([(str(i), 1.0 if i < 20 else 0.0) for i in range(200)], "id string, score double")
    b = spark.createDataFrame([(str(i), 0.0) for i in range(200)], "id string, score double")
    pairs = metrics.paired(a, b)
    got = metrics.paired_summary(pairs).first()
    assert (got.delta, got.wins, got.losses) == (10.0, 20, 0)
    ci = metrics.bootstrap(pairs).first()
    assert ci.low < 10 < ci.high and 5 < ci.low and ci.high < 15
    assert metrics.bootstrap(pairs).first() == ci
    same = metrics.bootstrap(metrics.paired(b, b)).first()
    assert (same.low, same.high) == (0.0, 0.0)
    with pytest.raises(ValueError, match="same questions"):
        metrics.paired(a, b.filter("id <> '3'"))
    assert metrics.bootstrap(pairs.limit(0)).first().low is None


def test_nearest_rank(spark):
    rng = random.Random(4)
    data = [(g, float(rng.choice([1, 2, 3, rng.random() * 100]))) for g in "ab" for _ in range(301)] + [("c", 5.0)] * 4 + [("d", None), ("e", 1.0), ("e", 2.0), ("e", 3.0), ("e", 4.0)]
    rows = spark.createDataFrame(data, "g string, v double")
    got = {(r.g, r.quantile): r.v for r in metrics.nearest_rank(rows, ["g"], "v", [0.5, 0.9, 0.99], buckets=16).collect()}
    for g in "abce":
        s = sorted(v for k, v in data if k == g)
        for q in (0.5, 0.9, 0.99):
            assert got[g, q] == s[min(len(s) - 1, round(q * (len(s) - 1)))]
    assert got["e", 0.5] == 3.0 and len(got) == 12


def generation(spark, rows):
    schema = "id string, served_model string, error string, started_at double, choices array<struct<content: string, reasoning_content: string, finish_reason: string>>, usage struct<prompt_tokens: bigint, completion_tokens: bigint>"
    return spark.createDataFrame([(i, "m", None if c else "failed", t, [(x, None, f) for x, f in c], None) for i, t, c in rows], schema)


def test_selection(spark):
    # a, a, b, c, c, b with a cap of 2: kept a and b; a repeat of a and of b; c is over the cap
    sql = ["A", "a ;", "b", "c", "c", "B"]
    rows = graded(spark, [("q", k, True, "", s) for k, s in enumerate(sql)] + [("r", 0, True, "", "x"), ("s", 0, True, "", "x"), ("t", 0, True, "", "x"), ("u", 0, None, "", "x")])
    made = generation(spark, [("q", 1.0, []), ("q", 2.0, [(s, "stop") for s in sql]), ("r", 1.0, [("x", "length")]), ("s", 1.0, [("<think>a</think>x", "stop")]), ("t", 1.0, [("<think>\n</think>\n x", None)])])
    once = selection.generations_once(made)
    kept = {(r.id, r.sample): r.response for r in selection.candidates(rows, once).collect()}
    assert kept == {("q", 0): "A", ("q", 2): "b", ("t", 0): "x"}
    c = selection.selection_counts(rows, once).first()
    assert (c.graded_rows, c.correct_rows, c.dropped_truncated, c.normalized_prefix, c.dropped_markup, c.dropped_duplicate, c.dropped_over_cap, c.candidates) == (10, 9, 1, 1, 1, 2, 2, 3)
    chosen = selection.candidates(rows, once)
    assert selection.exact_sample(chosen, 2, seed=1).count() == 2
    assert {r.id for r in selection.exact_sample(chosen.repartition(7), 2, seed=1).collect()} == {r.id for r in selection.exact_sample(chosen, 2, seed=1).collect()}
    with pytest.raises(ValueError, match="fewer than"):
        selection.exact_sample(chosen, 9)
    asked = spark.createDataFrame([("q", [("user", "?")]), ("t", [("user", "!")])], "id string, messages array<struct<role: string, content: string>>")
    assert {r.id for r in selection.training_records(chosen, asked).collect()} == {"q#s0", "q#s2", "t#s0"}
    with pytest.raises(ValueError, match="without a prompt"):
        selection.training_records(chosen, asked.filter("id = 'q'"))
    assert selection.candidates(rows.limit(0), once.limit(0)).count() == 0


def test_groups(spark):
    rows = graded(spark, [(q, k, c, "", "x") for q, right in (("mixed", [1, 0, 0, 1]), ("right", [1, 1, 1, 1]), ("small", [1, 0])) for k, c in enumerate(map(bool, right))] + [("gap", k, k == 0, "", "x") for k in (0, 1, 2, 4)] + [("cut", k, k == 3, "", "x") for k in range(4)])
    full = [("x", "stop")] * 4
    made = generation(spark, [("mixed", 1.0, full), ("right", 1.0, full), ("small", 1.0, full[:2]), ("gap", 1.0, full), ("cut", 1.0, [*full[:3], ("x", "length")])])
    assert [(r.id, r.members, r.reward_mean) for r in selection.mixed_groups(rows, made).collect()] == [("mixed", 4, 0.5)]
    c = selection.group_counts(rows, made).first()
    assert (c.groups, c.groups_sized, c.groups_mixed, c.records) == (5, 3, 1, 4)
    assert {r.id: r.sample for r in selection.first_failed(rows).collect()} == {"mixed": 1, "small": 1, "gap": 1, "cut": 0}
    items = spark.createDataFrame([("mixed", "dev"), ("new", "dev"), ("other", "train"), (None, "dev")], "id string, split string").withColumn("kind", F.lit("sql"))
    added = selection.covered(rows, items).filter("id = 'new'").collect()
    assert [(r.sample, r.correct, r.error) for r in added] == [(0, False, "no_sql")]
    assert {r.id for r in selection.to_do(items, made).collect()} == {"new", "other"}


def test_advantages(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 0.1), ("b", 0.0), ("b", 1.0), ("c", 1.0), ("c", 1.0), ("d", 1.0), ("e", None)], "group_id string, reward double")
    std = sorted((r.group_id, round(r.advantage, 9)) for r in advantage.advantages(rows).collect())
    assert std == [("a", -1.0), ("a", 1.0), ("b", -1.0), ("b", 1.0)]
    assert sorted(round(r.advantage, 9) for r in advantage.advantages(rows, "mean").collect()) == [-0.5, -0.05, 0.05, 0.5]
    s = advantage.advantage_stats(rows).first()
    assert (s.samples, s.groups_equal, s.used, s.adv_min, s.adv_max) == (7, 2, 4, -1.0, 1.0)
    with pytest.raises(ValueError, match="norm"):
        advantage.advantages(rows, "none")
    import math

    terms = advantage.policy_terms(F.col("lp"), F.lit(0.0), F.col("ref"), F.col("a"), epsilon=0.2, beta=0.1, kl_clamp=10.0, dual_clip=3.0)
    cases = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, math.log(2), 0.0, 1.0), (2, math.log(0.1), 0.0, -1.0), (3, math.log(10), math.log(10), -1.0), (4, -5.0, 0.0, 1.0)], "i int, lp double, ref double, a double")
    got = [(round(r.policy, 9), round(r.kl, 6), r.clipped) for r in cases.select("i", *[c.alias(k) for k, c in terms.items()]).orderBy("i").collect()]
    assert [g[0] for g in got[:4]] == [-1.0, -1.2, 0.8, 3.0] and got[4][1] == 10.0 and [g[2] for g in got] == [False, True, True, False, False]
    masked = advantage.policy_terms(F.col("lp"), F.lit(0.0), F.lit(0.0), F.lit(1.0), weight=F.col("w"))
    tokens = spark.createDataFrame([("k", 900.0, 0.0), ("k", 0.0, 2.0)], "k string, lp double, w double").select("k", "w", *[masked[c].alias(c) for c in ("ratio", "loss", "kl")])
    assert [tuple(r) for r in advantage.weighted_metrics(tokens, ["k"], "w", ["ratio", "loss", "kl"]).collect()] == [("k", 2.0, 1.0, -1.0, 0.0)]
    assert {r.group_id for r in advantage.equal_groups(rows).collect()} == {"c", "d"}


def test_uptime(spark):
    t0 = dt.datetime(2025, 1, 1)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    rows = spark.createDataFrame([(at(0), True), (at(5), True), (at(10), True), (at(115), True)], "ts timestamp, ok boolean")
    total = accounting.uptime_total(accounting.uptime_windows(rows)).first()
    assert (total.windows, total.seconds) == (2, 20 * 60.0)
    broken = rows.union(spark.createDataFrame([(at(5), False), (None, True)], "ts timestamp, ok boolean"))
    assert accounting.uptime_total(accounting.uptime_windows(broken)).first().windows == 3
    edge = spark.createDataFrame([("x", dt.datetime(2025, 1, 1, 23, 55), True), ("x", dt.datetime(2025, 1, 2, 0, 5), True), ("x", dt.datetime(2025, 1, 2, 0, 15, 0, 1), True), ("y", dt.datetime(2025, 1, 2, 0, 1), True)], "e string, ts timestamp, ok boolean")
    got = sorted((r.e, r.pings) for r in accounting.uptime_windows(edge, ["e"]).collect())
    assert got == [("x", 1), ("x", 2), ("y", 1)]
    assert accounting.uptime_windows(rows.limit(0)).count() == 0
    rng = random.Random(2)
    series = sorted((at(rng.random() * 6000), rng.random() > 0.2) for _ in range(800))
    want, current = [], None
    for t, ok in series:
        if ok and current and (t - current[1]).total_seconds() <= 600:
            current[1] = t
            continue
        if current:
            want.append(tuple(current))
        current = [t, t] if ok else None
    if current:
        want.append(tuple(current))
    found = accounting.uptime_windows(spark.createDataFrame(series, "ts timestamp, ok boolean"), slice_s=3600).select(F.unix_micros("started"), F.unix_micros("ended")).collect()
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000 + 0.5)
    got_set = sorted((r[0] - found[0][0], r[1] - r[0]) for r in found)
    base = micros(want[0][0])
    first = min(r[0] for r in found)
    assert sorted((r[0] - first, r[1] - r[0]) for r in found) == sorted((micros(a) - base, micros(b) - micros(a)) for a, b in want), got_set[:3]


def test_serving(spark):
    rows = spark.createDataFrame([("l1", float(i), float(i), "boom" if i == 3 else None, 30, 10, "length" if i == 1 else "stop") for i in range(1, 9)], "level string, started_at double, latency_s double, error string, prompt_tokens bigint, completion_tokens bigint, finish_reason string")
    s = accounting.serving_levels(rows, "level").first()
    assert (s.requests, s.ok, s.errors, s.finish_length, s.wall_s) == (8, 7, 1, 1, 15.0) and s.prompt_tok_per_s == 14.0 and s.p50 <= s.p90 <= s.p99 == 8.0
    levels = spark.createDataFrame([("a", 1, 12.0), ("b", 0, 10.0), ("c", 0, 10.0)], "level string, errors bigint, req_per_s double")
    assert accounting.best_level(levels, "level").first().level == "b"
    assert accounting.best_level(levels.filter("errors > 0"), "level").count() == 0


def test_result_sets(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.5), (2, "y", 1.5)], "p int, q string, r double")
    b = spark.createDataFrame([(2.0, "y", 1.5), (1.0, "x", None)], "u double, v string, w double")
    assert grading.same_rows(a, b)
    assert not grading.same_rows(a, b.filter("u = 2"))
    assert not grading.same_rows(a.select("p"), a.select(F.col("p").cast("string")))
    assert not grading.same_rows(a, a.select("p", "q"))
    assert grading.same_rows(a.limit(0), b.limit(0))


def test_execution(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "shop.sqlite")
    with sqlite3.connect(path) as c:
        c.executescript("CREATE TABLE customer (id INTEGER, name TEXT, city TEXT); INSERT INTO customer VALUES (1, 'a', 'x'), (2, 'b', 'x'), (3, 'c', NULL);")
    gold = "SELECT id FROM customer WHERE city = 'x'"
    preds = ["SELECT id FROM customer WHERE city = 'x' ORDER BY id DESC", "SELECT id FROM customer", "SELECT nope FROM customer", None, "DELETE FROM customer", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT count(*) FROM r"]
    rows = spark.createDataFrame([("q", k, path, gold, p) for k, p in enumerate(preds)] + [("bad", 0, path, "SELECT x FROM nothing", "SELECT 1")], "id string, sample int, path string, gold_sql string, pred_sql string")
    got = {(r.id, r.sample): (r.correct, r.error) for r in grading.execute_grades(rows, timeout_s=0.5).collect()}
    assert got["q", 0] == (True, "") and got["q", 1] == (False, "") and got["q", 3] == (False, "no_sql") and got["bad", 0] == (False, "gold_failed")
    assert got["q", 2][1].startswith("OperationalError") and "readonly" in got["q", 4][1] and got["q", 5][1].startswith("timeout")
    golds = spark.createDataFrame([("a", "d", path, gold), ("b", "d", path, "SELECT 1 + 0 FROM customer WHERE id = 1"), ("c", "d", path, "SELECT id FROM customer WHERE id IN (1, 2)")], "id string, db_id string, path string, gold_sql string")
    assert all(r.correct for r in grading.executed_gold_control(golds).collect())
    shuffled = grading.executed_shuffled_control(golds)
    assert {r.id: r.correct for r in shuffled.collect()} == {r.id: {r.gold, r.other} == {gold, "SELECT id FROM customer WHERE id IN (1, 2)"} for r in shuffled.collect()} and grading.control_rate(shuffled).first()["items"] == 3
    runner = grading.SqliteRunner(max_rows=2, most_open=1)
    assert runner.run(path, "SELECT id FROM customer").error == "more than 2 rows" and runner.run(None, "SELECT 1").error == "no database" and runner.run(path + "x", "SELECT 1").error.startswith("OperationalError")
    assert runner.run(path, "SELECT id, id FROM customer WHERE id < 3").rows == {(1, 1), (2, 2)} and runner.run(path, "SELECT char(55296) || x'ff'").count == 1
    assert "no query" in runner.report(path, None) and "nothing" in runner.report(path, "SELECT 1 WHERE 0") and "no such column" in runner.report(path, "SELECT nope FROM customer")
    assert runner.report(path, "SELECT city, 'a b' FROM customer WHERE id = 3").endswith("\nNULL\ta b") and "Rows: 1" in runner.report(path, "SELECT 1")
    runner.close()
    answers = spark.createDataFrame([("a", 0, path, "SELECT 1"), ("a", 1, path, None)], "id string, sample int, path string, pred_sql string")
    assert {r.sample: "Rows: 1" in r.feedback for r in grading.feedback_batches(answers).collect()} == {0: True, 1: False}
    from corpusmill.sources.readers import catalog, schema_texts

    with sqlite3.connect(path) as c:
        c.executescript("CREATE TABLE \"odd \"\"name\" (a TEXT); CREATE VIRTUAL TABLE search USING fts5(x);")
        c.execute("PRAGMA writable_schema = 1")
        c.execute("UPDATE sqlite_master SET sql = 'CREATE VIRTUAL TABLE search USING absent_module(x)' WHERE name = 'search'")
    databases = spark.createDataFrame([("shop", path)] * 2 + [("none", str(tmp_path / "none.sqlite"))], "db_id string, path string")
    sqlite3.connect(str(tmp_path / "none.sqlite")).execute("PRAGMA user_version = 1").close()
    found = {r.name: r for r in catalog(databases).collect()}
    assert found["customer"].samples[2] == ["3", "c", None] and found["odd \"name"].samples == [] and found["search"].samples == [] and "absent_module" in found["search"].ddl
    texts = {r.db_id: r.schema_text for r in schema_texts(databases).collect()}
    assert texts["shop"].startswith("CREATE TABLE customer") and "3 | c | NULL" in texts["shop"] and "USING absent_module(x)" in texts["shop"] and texts["none"] == ""


def test_controls(spark):
    items = spark.createDataFrame([("a", "d", "SELECT 1"), ("b", "d", "SELECT 2"), ("c", "d", "SELECT 2"), ("e", "f", "SELECT 3"), ("g", None, None)], "id string, db_id string, gold_sql string")
    got = {r.id: (r.gold, r.other) for r in grading.shuffled_control(items, "db_id", "gold_sql").collect()}
    assert got == {"a": ("SELECT 1", "SELECT 2"), "b": ("SELECT 2", "SELECT 1"), "c": ("SELECT 2", "SELECT 1")}
    qa = spark.createDataFrame([("a", 1.5, None), ("b", None, "yes"), ("c", -1e-6, None)], "id string, gold_num double, gold_text string")
    assert all(r.correct for r in grading.gold_control(qa).collect())
    more = qa.union(spark.createDataFrame([("d", 150.0, None), ("e", 1.5, None), ("f", None, "no")], qa.schema)).withColumn("split", F.lit("dev")).union(spark.createDataFrame([("z", 3.0, None, "test")], "id string, gold_num double, gold_text string, split string"))
    control = grading.numeric_shuffled_control(more)
    rows = {r.id: r for r in control.collect()}
    assert set(rows) == set("abcdef") and all(r.gold != r.other for r in rows.values()) and rows["a"].other == rows["e"].other
    rate = grading.control_rate(control).first()
    assert rate["items"] == 6 and rate.passed == sum({r.gold, r.other} == {"1.500000000e+00", "1.500000000e+02"} for r in rows.values())


def test_audit_of_financial_records(spark):
    """Report page, question and score, as for an item of its own page; the item's page counts as well."""
    schema = "id string, split string, kind string, group_key string, question string, evidence string, gold_sql string, gold_num double, gold_text string"
    items = spark.createDataFrame([("train-1", "train", "qa", "A/2001/page_1.pdf", "what rose?", None, None, 5.0, None), ("train-2", "train", "qa", "B/2001/page_1.pdf", "what fell?", None, None, None, "yes"), ("test-1", "test", "qa", "B/2001/page_1.pdf", "what else?", None, None, 1.0, None)], schema)
    rows = [("train-1#s0", "A/2001/page_1.pdf", "what rose?", "Answer: 5.01"), ("train-1#s1", "A/2001/page_1.pdf", "what rose?", "Answer: 6"), ("train-2#s0", "C/2001/page_1.pdf", "what fell?", "Answer: yes"), ("train-7#s0", "A/2001/page_1.pdf", "WHAT else", "Answer: 1")]
    records = spark.createDataFrame([(i, None, r, [("user", f"Report page:\n1\n\nQuestion: {q}\n\nShort.")], a) for i, r, q, a in rows], "id string, db_id string, report string, messages array<struct<role: string, content: string>>, response string")
    got = {r.id: tuple(r[x] for x in audit.RULES) for r in audit.record_flags(records, items).collect()}
    assert got == {"train-1#s0": (False,) * 5, "train-1#s1": (False, False, False, False, True), "train-2#s0": (True, True, False, False, False), "train-7#s0": (True, False, True, False, True)}


def test_audit(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(13))
    items = spark.createDataFrame([("dev-1", "dev", "e1", f"start {long} end", None), ("dev-2", "dev", "e2", "Short one?", None), ("train-1", "train", "t1", "Short  ONE", None), ("train-2", "train", "t2", f"other {long} text", ""), ("train-3", "train", "e1", "fine question", long), ("train-4", "train", None, None, None)], "id string, split string, db_id string, question string, evidence string").withColumn("group_key", F.col("db_id")).withColumn("kind", F.lit("sql")).withColumn("gold_sql", F.lit("SELECT 1")).withColumn("gold_num", F.lit(None).cast("double")).withColumn("gold_text", F.lit(None).cast("string"))
    train, evals = items.filter("split = 'train'"), items.filter("split = 'dev'")
    assert {r.id for r in audit.repeating(train, evals).collect()} == {"train-1"}
    assert {r.id: r.shared for r in audit.sharing(train, evals).collect()} == {"train-2": 1, "train-3": 1}
    kept = audit.clean_rows(train, evals)
    assert {r.id for r in kept.collect()} == {"train-4"}
    assert audit.repeating(kept, evals).count() == 0 and audit.sharing(kept, evals).count() == 0
    c = audit.removed_counts(train, evals).first()
    assert (c.rows, c.exact, c.ngram_only, c.kept) == (4, 1, 2, 1)
    message = lambda q, e="none": [("system", "s"), ("user", f"Schema\nQuestion: {q}\nHint: {e}")]
    answer = "```sql\nSELECT {}\n```"
    records = spark.createDataFrame([("train-1#s0", "t1", None, message("Short ONE"), answer.format(1)), ("train-9#s1", "e2", None, message("new"), "x"), ("train-3#s0", "t3", None, message("fine question", long), answer.format(2))], "id string, db_id string, report string, messages array<struct<role: string, content: string>>, response string")
    counts = audit.rule_counts(audit.record_flags(records, items)).first()
    # train-3 is of another group than its item, and its evidence shares an n-gram
    assert (counts.records, counts.not_a_train_item, counts.eval_group, counts.exact, counts.ngram, counts.reverify_failed) == (3, 2, 1, 1, 1, 0)
    assert {(r.rule, r.id) for r in audit.rule_examples(audit.record_flags(records, items)).collect()} == {("not_a_train_item", "train-9#s1"), ("not_a_train_item", "train-3#s0"), ("eval_group", "train-9#s1"), ("exact", "train-1#s0"), ("ngram", "train-3#s0")}
    import sqlite3

    sqlite3.connect(str(tmp_path / "t.sqlite")).execute("CREATE TABLE x (a)").close()
    databases = spark.createDataFrame([("t1", str(tmp_path / "t.sqlite")), ("t3", str(tmp_path / "t.sqlite"))], "db_id string, path string")
    assert {r.id: r.reverify_failed for r in audit.record_flags(records, items, databases=databases).collect()} == {"train-1#s0": False, "train-3#s0": True, "train-9#s1": None}
    empty = audit.rule_counts(audit.record_flags(records.limit(0), items)).first()
    assert empty.records == 0 and audit.rule_counts(audit.record_flags(records, items.limit(0))).first().not_a_train_item == 3
    assert audit.leaked_ids(records, evals).count() == 0 and audit.leaked_ids(records, spark.createDataFrame([("train-1",)], "id string")).count() == 1
    assert {(r.kind, r.split_a, r.split_b, r.groups) for r in audit.shared_groups(items).collect()} == {("sql", "dev", "train", 1)}
    docs = spark.createDataFrame([(1, "A b!"), (2, "a  B"), (3, ""), (4, "..."), (5, None), (6, "c")], "doc_id bigint, text string")
    assert {(r.first_id, r.copies) for r in audit.same_text(docs).collect()} == {(1, 2), (3, 2)}


def test_prompts(spark):
    items = spark.createDataFrame([("a", "d", "dev", "easy", "how?", ""), ("b", None, "dev", None, "why?", None)], "id string, db_id string, split string, difficulty string, question string, evidence string")
    got = {r.id: r.messages[-1].content for r in prompts.sql_prompts(items, spark.createDataFrame([("d", "CREATE x")], "db_id string, schema_text string")).collect()}
    assert "CREATE x" in got["a"] and "Hint: none" in got["a"] and "Question: why?" in got["b"]
    qa = spark.createDataFrame([("a", "r", "dev", "s", "q?", [" x ", "", " "], [["", "1"], [" a ", "2"]], None)], "id string, report string, split string, source_id string, question string, pre_text array<string>, table_rows array<array<string>>, post_text array<string>")
    body = prompts.qa_prompts(qa).first().messages[1].content
    assert body.startswith("Report page:\nx\n\n | 1\na | 2\n\n(none)\n\nQuestion: q?")
    assert prompts.in_groups(items, "db_id", only=["d"]).count() == 1 and prompts.in_groups(items, "db_id", exclude=["d"]).count() == 1 and prompts.in_groups(items, "db_id").count() == 2
    failed = spark.createDataFrame([("a", 0)], "id string, sample int")
    answers = spark.createDataFrame([("a", 0, "SELECT gold", "The query ran and gave nothing.")], "id string, sample int, content string, feedback string")
    fixed = prompts.correction_prompts(failed, prompts.sql_prompts(items), answers)
    assert "\n\nThe query ran and gave nothing.\n\n" in fixed.first().messages[-1].content
    assert prompts.gold_leaks(fixed, spark.createDataFrame([("a", "SELECT gold")], "id string, gold string")).count() == 0
    assert prompts.gold_leaks(fixed, spark.createDataFrame([("a", "how?")], "id string, gold string")).count() == 1


def test_batches(spark):
    rows = spark.createDataFrame([(f"r{i}", n) for i, n in enumerate([3, 9, 4, 12, 5, 8, 7])], "id string, n int")
    plan = batching.batch_plan(rows, "n", 4, 2, epochs=2, seed=1, buckets=[4, 8, 12, 16])
    got = plan.collect()
    assert len(got) == 8 and {(r.epoch, r.global_batch) for r in got} == {(0, 0), (1, 0)}
    for r in got:
        own = [x.length for x in got if (x.epoch, x.micro_batch) == (r.epoch, r.micro_batch)]
        assert r.width == min(b for b in (4, 8, 12, 16) if b >= max(own)) and len(own) == 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, batching.batch_plan(rows.repartition(5), "n", 4, 2, epochs=2, seed=1, buckets=[4, 8, 12, 16]).collect()))
    one = spark.range(1)
    assert one.select(batching.bucket(F.lit(9), [16, 4, 8, 12])).first()[0] == 12 and one.select(batching.bucket(F.lit(99), [4], 64)).first()[0] == 64
    with pytest.raises(Exception, match="no bucket holds 99"):
        one.select(batching.bucket(F.lit(99), [4])).collect()
    assert one.select(batching.row_scale(F.lit(2), 3)).first()[0] == [1.0, 1.0, 0.0]
    assert one.select(batching.shifted(F.array(F.lit(0.0).cast("float"), F.lit(1.0).cast("float")))).first()[0] == [1.0, 0.0]
    assert batching.warmup_steps(10, 0.1, None) == 1 and batching.warmup_steps(3, None, 9) == 2


def test_records(spark):
    m = "array<struct<role: string, content: string>>"
    rows = spark.createDataFrame([("a", "x", [("user", "q")], 1.0, "g"), ("", "x", [("user", "q")], None, None), ("c", None, [("user", "q")], None, None), ("d", "x", [], None, None), ("e", "x", [("assistant", "q"), ("user", "q")], None, None), ("f", "x", [("user", "q"), ("system", "s")], None, None), ("g", "x", None, None, None)], f"id string, response string, messages {m}, reward double, group_id string")
    assert {r.rule: r.records for r in batching.rule_counts(rows).collect()} == {"valid": 1, "no_id": 1, "no_response": 1, "no_messages": 2, "bad_message": 1, "last_not_user": 1}
    assert batching.valid_records(rows, "required").count() == 1 and batching.valid_records(rows, "refused").count() == 0
    chars = lambda text: [(ord(c), i, i + 1) for i, c in enumerate(text)]
    done = batching.rendered(rows.filter("id = 'a'"), chars, 256).first()
    text = "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert done.n_real == len(text) and done.n_trained == len("x<|im_end|>") and done.loss_weight[text.rindex("x<")] == 1.0 and done.loss_weight[0] == 0.0
    counts = batching.render_counts(batching.rendered(rows.filter("id in ('a', 'g')"), chars, 256)).first()
    assert (counts.n_kept, counts.n_unmatched, counts.template_refused) == (1, 1, True)
    padded = batching.rendered(rows.filter("id = 'a'"), chars, 256, pad=7)
    batching.check_masks(padded, padded=True)
    one = padded.first()
    assert len(one.input_ids) == 256 == len(one.loss_weight) and one.input_ids[-1] == 7 and one.n_real == len(text) and sum(one.loss_weight) == one.n_trained
    for wrong in (F.transform("loss_weight", lambda w: F.lit(0.5).cast("float")), F.concat(F.slice("loss_weight", 1, 255), F.array(F.lit(1.0).cast("float"))), F.slice("loss_weight", 1, 9)):
        with pytest.raises(ValueError, match="loss weights"):
            batching.check_masks(padded.withColumn("loss_weight", wrong), padded=True)
    thought = rows.filter("id = 'a'").withColumn("response", F.lit("<think>so</think>yes"))
    again = lambda messages: "".join(f"[{m['role']}]" + m["content"].replace("<think>so</think>yes", "<think>\nso\n</think>\n\nyes") + "<|im_end|>" for m in messages)
    found = batching.rendered(thought, chars, 256, render=again).first()
    assert found.status == "kept" and found.n_trained == len("so\n</think>\n\nyes<|im_end|>")
    assert batching.rendered(thought, chars, 256, render=lambda m: "other").first().status == "unmatched"
    long = rows.filter("id = 'a'").withColumn("response", F.lit("x" * 400))
    assert batching.rendered(long, chars, 256).first().status == "overlong" and batching.rendered(long, chars, 256, overlong="truncate").first().status == "truncated"
    batching.check_records(rows.filter("id = 'a'"), rollouts=True)
    for bad, what in ((rows, "broken"), (rows.filter("id = 'a'").union(rows.filter("id = 'a'")), "repeat"), (rows.filter("id = 'a'").withColumn("reward", F.lit(None).cast("double")), "reward")):
        with pytest.raises(ValueError, match=what):
            batching.check_records(bad, rollouts=True)
    with pytest.raises(ValueError, match="multiple"):
        batching.rendered(rows, chars, 100)


def test_evictions(spark):
    entries = spark.createDataFrame([("a", 10, 3.0), ("b", 20, 1.0), ("c", 30, 2.0), ("k", 50, 0.0)], "path string, size bigint, last_use double")
    assert {r.path for r in batching.evictions(entries, free=5, need=10, reserve=20, keep=["k"]).collect()} == {"b", "c"}
    assert batching.evictions(entries, free=100, need=10, reserve=20).count() == 0
    assert batching.enough(entries, 5, 10, 20, ["k"]) and not batching.enough(entries, 5, 100, 20, ["k"])


def test_sequences_and_stats(spark):
    import math

    chars = lambda text: [(ord(c), i, i + 1) for i, c in enumerate(text)]
    rows = spark.createDataFrame([("a#s0", "a", 1.0, [("user", "q")], "x"), ("a#s1", "a", 0.0, [("user", "q")], "y"), ("b#s0", "b", 1.0, [("user", "q")], "z")], "id string, group_id string, reward double, messages array<struct<role: string, content: string>>, response string")
    got = {r.id: r.advantage for r in batching.rollout_sequences(rows, chars, 256).collect()}
    assert got == {"a#s0": 1.0, "a#s1": -1.0}
    sequences = batching.rollout_sequences(rows.withColumn("response", F.when(F.col("response") == "y", "y" * 900).otherwise(F.col("response"))), chars, 256, overlong="truncate", pad=0)
    assert batching.trainable(sequences).count() == 2
    c = batching.rollout_counts(rows, sequences).first()
    assert (c.n_rollouts, c.n_equal_rewards, c.n_sequences, c.n_truncated, c.n_overlong, c.n_untrained, c.n_unmatched) == (3, 1, 2, 1, 0, 0, 0)
    batching.check_minibatches(4, 4, True)
    with pytest.raises(ValueError, match="fewer"):
        batching.check_minibatches(3, 4, True)
    logp, entropy = advantage.token_stats(F.array(*[F.lit(x) for x in (1000.0, 1000.0)]), F.lit(0))
    r = spark.range(1).select(logp.alias("l"), entropy.alias("e")).first()
    assert abs(r.l + math.log(2)) < 1e-9 and abs(r.e - math.log(2)) < 1e-9
    p = [math.log(0.5), math.log(0.25)]
    positions = spark.createDataFrame([("x", 1, 1, p, p, -1.0, -1.5), ("x", 1, 2, p, p[::-1], -1.0, -1.0)], "k string, top_a int, top_b int, p_logs array<double>, q_logs array<double>, logp_a double, logp_b double")
    s = advantage.parity(positions, ["k"]).first()
    assert (s.positions, s.top1_agreement, s.max_token_gap) == (2, 0.5, 0.5) and abs(s.max_kl - 0.25 * math.log(2)) < 1e-9
    top = spark.createDataFrame([({1: -1.0, 2: -0.5, 3: -1.0},)], "m map<int,double>").select(advantage.top_ranked(F.col("m"), 2).alias("t")).first().t
    assert [(t.id, t.logp) for t in top] == [(2, -0.5), (1, -1.0)]
    weighted = advantage.weighted_metrics(spark.createDataFrame([("k", 1.0, 2.0), ("k", 3.0, 4.0), ("z", 0.0, 1.0)], "k string, w double, v double"), ["k"], "w", ["v"])
    assert {(r.k, r.v) for r in weighted.collect()} == {("k", 3.5), ("z", None)}
    assert {(r.db_id, r.chars) for r in prompts.schema_sizes(spark.createDataFrame([("d", "abc")], "db_id string, schema_text string")).collect()} == {("d", 3)}
    prompts.check_splits(["dev"], "train")
    for bad in (["train"], ["none"]):
        with pytest.raises(ValueError, match="split"):
            prompts.check_splits(bad, "train")


def test_rendering_holds_few_tokens(spark):
    """A worker's memory doesn't grow with the tokens of an Arrow batch; the tokens tell it."""

    def encode(text):
        with open("/proc/self/statm") as f:
            mb = int(f.read().split()[1]) // 256
        return [(mb, i, i + 1) for i in range(4096)]

    rows = spark.range(3000).selectExpr("cast(id as string) id", "array(named_struct('role', 'user', 'content', 'q')) messages", "'x' response").coalesce(1)
    got = batching.rendered(rows, encode, 4096).agg(F.count("id"), F.min("n_real"), F.min(F.col("input_ids")[0]), F.max(F.col("input_ids")[0])).first()
    assert got[:2] == (3000, 4096) and got[3] - got[2] < 150, got
