"""Queries of the core operators over the driver's tables, each with the same in SQL for an independent engine where SQL can state it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers, text
from .operators import accounting, advantage, audit, batching, grading, metrics, prompts, selection
from .session import cut_lineage, ensure_checkpoint_dir, table
from .streaming import streams
from .tasks.registry import get_task

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return metrics.once(table(spark, d, "graded").filter("id is not null and sample is not null"))


def _generations(spark: SparkSession, d: str) -> DataFrame:
    return selection.generations_once(table(spark, d, "generations"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Distinct text-to-SQL items: of an id that comes twice the row loaded last."""
    rows = table(spark, d, "sql_items").filter("id is not null")
    keep = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*keep), "loaded_at").alias("r")).select("id", "r.*")


def _qa(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_items").filter("id is not null")
    keep = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*keep), "loaded_at").alias("r")).select("id", "r.*")


G = "g AS (SELECT * FROM graded WHERE id IS NOT NULL AND sample IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, sample ORDER BY row_id) = 1)"
Q = f"""{G},
q AS (SELECT id, count(*) AS n, sum((correct IS TRUE)::INT) AS n_correct, arg_min(correct IS TRUE, sample) AS first_correct, arg_min(coalesce(error, ''), sample) AS first_error FROM g GROUP BY id)"""
GEN = "gen AS (SELECT * FROM generations WHERE len(choices) > 0 AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(started_at, 0)) = 1)"
CHOICES = f"""{GEN},
ch AS (SELECT id, served_model, len(choices) AS n_choices, i - 1 AS sample, choices[i].content AS content, choices[i].finish_reason AS finish_reason FROM (SELECT *, unnest(range(1, len(choices) + 1)) AS i FROM gen))"""
ITEMS = "items AS (SELECT * FROM sql_items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
QA = "qa AS (SELECT * FROM qa_items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
NORM = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
NUMBER = r"'^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$'"
NORM_SQL = r"regexp_replace(" + STRIP.format(r"lower(regexp_replace(pred_sql, '[\s\p{Z}]+', ' ', 'g'))").replace("{{", "{").replace("}}", "}") + r", '(\s*;)+$', '')"
_A = STRIP.format("pred_answer").replace("{{", "{").replace("}}", "}")
KEY = f"CASE WHEN pred_sql IS NOT NULL THEN {NORM_SQL} WHEN regexp_matches({_A}, {NUMBER}) THEN printf('%.9e', ({_A})::DOUBLE + 0.0) ELSE coalesce(lower({_A}), '') END"
RESPONSE = r"regexp_replace(regexp_replace(coalesce(content, ''), '^\s*(?:<think>\s*)?</think>', ''), '^[\s\p{Z}]+', '')"
ANSWERED = f"""{G}, {CHOICES},
r AS (SELECT id, sample, {KEY} AS key, coalesce(db_id, report) AS group_key FROM g WHERE correct IS TRUE),
a AS (SELECT r.id, r.sample, r.key, r.group_key, served_model, n_choices IS NULL AS outside, coalesce(finish_reason = 'length', FALSE) AS truncated, {RESPONSE} AS response,
  coalesce({RESPONSE} <> content, FALSE) AS prefixed, contains({RESPONSE}, '<think>') OR contains({RESPONSE}, '</think>') AS markup FROM r LEFT JOIN ch ON r.id = ch.id AND r.sample = ch.sample),
f AS (SELECT *, min(sample) OVER (PARTITION BY id, key) AS first FROM a WHERE NOT outside AND NOT truncated AND NOT markup),
m AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY first) AS place FROM f),
s AS (SELECT *, CASE WHEN place > 2 THEN 'over_cap' WHEN sample > first THEN 'duplicate' ELSE 'kept' END AS status FROM m)"""


# Contamination


def _all_items(spark: SparkSession, d: str) -> DataFrame:
    return audit.all_items(table(spark, d, "sql_items"), table(spark, d, "qa_items"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _all_items(spark, d)
    return rows.filter("split = 'train'"), rows.filter("split in ('dev', 'test')")


ALL_ITEMS = f"""{ITEMS}, {QA}, al AS (SELECT id, split, 'sql' AS kind, db_id AS group_key, question, evidence, gold_sql, NULL::DOUBLE AS gold_num, NULL::VARCHAR AS gold_text FROM items
  UNION ALL SELECT id, split, 'qa', report, question, NULL, NULL, gold_num, gold_text FROM qa),
ev AS (SELECT * FROM al WHERE split IN ('dev', 'test')), tr AS (SELECT * FROM al WHERE split = 'train')"""
_GRAM = "SELECT {keys}, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT {keys}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {keys}, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM {rows} UNION ALL SELECT {keys}, regexp_extract_all(lower(evidence), '[a-z0-9]+') FROM {rows} WHERE evidence IS NOT NULL))"
_PROMPT = "coalesce(list_filter(messages, lambda m: m.role = 'user')[-1].content, '')"
#: The answer of a text, as extract_answer; a comma between thousands becomes chr(1) first, in two passes as a match takes the digits around it.
_CUT = r"regexp_replace({}, '([0-9]),([0-9]{{3}})([^0-9]|$)', '\1' || chr(1) || '\2\3', 'g')"
_MARKS = "replace(" + _CUT.format(_CUT.format("translate({}, '−$', '-')").replace("{{", "{").replace("}}", "}")) + ", chr(1), '')"
_NUM = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def answer_ctes(rows: str, text: str, keys: str) -> str:
    """CTEs that end in xa(keys, answer): the answers of a text column of rows."""
    marks = lambda c: _MARKS.replace("{}", c)
    return rf"""xb AS (SELECT {keys}, string_split({text}, '</think>')[-1] AS body FROM {rows}),
xt AS (SELECT *, regexp_matches(body, '(?i)\banswer\s*:') AS marked, regexp_extract(body, '(?is)^.*\banswer\s*:(.*)$', 1) AS tail FROM xb),
xl AS (SELECT *, regexp_extract(tail, '^([^\n]*)', 1) AS line, regexp_extract(tail, '^[^\n]*\n(?:[ \t*_`:#>\r]*\n)*([^\n]*)', 1) AS later FROM xt),
xc AS (SELECT *, {marks("CASE WHEN regexp_matches(line, '^[ \t*_`:#>\r]*$') THEN later ELSE line END")} AS chosen, {marks("body")} AS whole FROM xl),
xs AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(chosen, '\(\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*%?\s*\)', '-\1', 'g'), '(^|[^\w.)])-\s+(\.?[0-9])', '\1-\2', 'g'), '(^|[^\w.)])-\s+(\.?[0-9])', '\1-\2', 'g') AS signed FROM xc),
xa AS (SELECT {keys}, regexp_replace(regexp_replace(CASE WHEN marked THEN nullif(lower(regexp_extract(signed, '(?i)\b(?:yes|no)\b|{_NUM}', 0)), '') ELSE regexp_extract_all(whole, '{_NUM}')[-1] END, '^\++', ''), '\.$', '') AS answer FROM xs)"""


def score_case(p: str, y: str, gold: str) -> str:
    """Whether an answer p is right, as score."""
    x = f"TRY_CAST({p} AS DOUBLE)"
    return rf"""CASE WHEN {p} IS NULL OR {p} = '' OR ({gold} IS NOT NULL AND {p} NOT IN ('yes', 'no')) THEN FALSE WHEN {gold} IS NOT NULL THEN {p} = {gold} WHEN NOT regexp_matches({p}, {NUMBER}) THEN FALSE WHEN {x} = 0 AND {y} <> 0 THEN FALSE
  ELSE abs({x} - {y}) <= abs({y}) * 0.01 * (1 + 1e-9) OR (abs({y}) < 0.5 AND abs({x} - {y}) <= 0.005 * (1 + 1e-9)) OR abs({x} / 100 - {y}) <= abs({y}) * 0.01 * (1 + 1e-9) OR abs({x} * 100 - {y}) <= abs({y}) * 0.01 * (1 + 1e-9) END"""


RECORD_FLAGS = rf"""{ALL_ITEMS},
rq AS (SELECT DISTINCT id, regexp_replace(id, '#s[0-9]+$', '') AS item_id, CASE WHEN db_id IS NOT NULL THEN 'sql' WHEN report IS NOT NULL THEN 'qa' END AS kind, coalesce(db_id, report) AS group_key, response,
  regexp_extract({_PROMPT}, '{text.QUESTION_PART}', 1) AS question, regexp_extract({_PROMPT}, '{text.EVIDENCE_PART}', 1) AS hint FROM records WHERE id IS NOT NULL),
rj AS (SELECT rq.id, rq.item_id, coalesce(rq.kind, tr.kind) AS kind, rq.group_key, rq.question, CASE WHEN lower({STRIP.format("hint").replace("{{", "{").replace("}}", "}")}) = 'none' THEN '' ELSE hint END AS evidence, response,
  tr.id IS NOT NULL AS known, tr.group_key AS t_group, tr.question AS t_question, tr.gold_num, tr.gold_text FROM rq LEFT JOIN tr ON rq.item_id = tr.id),
eg AS (SELECT DISTINCT kind, gram FROM ({_GRAM.format(keys="kind", rows="ev")})),
rg AS (SELECT DISTINCT id FROM ({_GRAM.format(keys="id, kind", rows="rj")}) JOIN eg USING (kind, gram)),
{answer_ctes("rj", "response", "id, response")},
fl AS (SELECT rj.id, rj.kind, rj.group_key, (NOT known OR t_group IS DISTINCT FROM rj.group_key OR {NORM.format("t_question")} IS DISTINCT FROM {NORM.format("rj.question")}) AS not_a_train_item,
  (rj.kind, rj.group_key) IN (SELECT (kind, group_key) FROM ev WHERE group_key IS NOT NULL) IS TRUE OR (rj.kind = 'qa' AND t_group IN (SELECT group_key FROM ev WHERE kind = 'qa' AND group_key IS NOT NULL) IS TRUE) AS eval_group,
  (rj.kind, {NORM.format("rj.question")}) IN (SELECT (kind, {NORM.format("question")}) FROM ev WHERE question IS NOT NULL) IS TRUE AS exact,
  rj.id IN (SELECT id FROM rg) AS ngram,
  CASE WHEN rj.kind = 'qa' THEN NOT known OR NOT coalesce({score_case("answer", "gold_num", "gold_text")}, FALSE) END AS reverify_failed
  FROM rj LEFT JOIN (SELECT DISTINCT id, response, answer FROM xa) a ON rj.id = a.id AND rj.response IS NOT DISTINCT FROM a.response)"""
_RULES = ("not_a_train_item", "eval_group", "exact", "ngram", "reverify_failed")


@query(f"WITH {RECORD_FLAGS} SELECT group_key, count(*) AS records, count(*) FILTER (exact) AS exact, count(*) FILTER (ngram) AS ngram FROM fl GROUP BY group_key")
def contamination_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.contamination(table(spark, d, "records"), _all_items(spark, d))


@query(f"WITH {RECORD_FLAGS} SELECT count(*) AS records, {', '.join(f'count(*) FILTER ({r}) AS {r}' for r in _RULES)} FROM fl")
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.rule_counts(audit.record_flags(table(spark, d, "records"), _all_items(spark, d)))


@query(f"""WITH {RECORD_FLAGS}, e AS ({' UNION '.join(f"SELECT '{r}' AS rule, id FROM fl WHERE {r}" for r in _RULES)})
SELECT rule, id FROM e QUALIFY row_number() OVER (PARTITION BY rule ORDER BY id) <= 5""")
def audit_examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.rule_examples(audit.record_flags(table(spark, d, "records"), _all_items(spark, d)))


GRAMS = f"""{ALL_ITEMS}, shared AS (SELECT id, count(DISTINCT gram) AS shared FROM ({_GRAM.format(keys="id, kind", rows="tr")}) JOIN (SELECT DISTINCT kind, gram FROM ({_GRAM.format(keys="kind", rows="ev")})) USING (kind, gram) GROUP BY id)"""
EXACT = f"ex AS (SELECT DISTINCT id FROM tr WHERE question IS NOT NULL AND (kind, {NORM.format('question')}) IN (SELECT (kind, {NORM.format('question')}) FROM ev WHERE question IS NOT NULL))"


@query(f"WITH {GRAMS} SELECT id, shared FROM shared")
def overlap_ngram13(spark: SparkSession, d: str) -> DataFrame:
    return audit.sharing(*_sides(spark, d), within=("kind",))


@query(f"WITH {ALL_ITEMS}, {EXACT} SELECT id FROM ex")
def overlap_exact(spark: SparkSession, d: str) -> DataFrame:
    return audit.repeating(*_sides(spark, d), within=("kind",))


@query(f"WITH {GRAMS}, {EXACT} SELECT id, group_key, question FROM tr WHERE id NOT IN (SELECT id FROM ex) AND id NOT IN (SELECT id FROM shared)")
def decontaminated_items(spark: SparkSession, d: str) -> DataFrame:
    return audit.clean_rows(*_sides(spark, d), within=("kind",)).select("id", "group_key", "question")


@query(f"""WITH {GRAMS}, {EXACT}
SELECT count(*) AS rows, count(*) FILTER (id IN (SELECT id FROM ex)) AS exact, count(*) FILTER (id IN (SELECT id FROM shared) AND id NOT IN (SELECT id FROM ex)) AS ngram_only,
  count(*) FILTER (id NOT IN (SELECT id FROM shared) AND id NOT IN (SELECT id FROM ex)) AS kept FROM tr""")
def removed_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.removed_counts(*_sides(spark, d), within=("kind",))


@query(f"""WITH {ALL_ITEMS}, n AS (SELECT DISTINCT kind, split, group_key FROM al WHERE group_key IS NOT NULL AND split IS NOT NULL)
SELECT a.kind, a.split AS split_a, b.split AS split_b, count(*) AS groups FROM n a JOIN n b ON a.kind = b.kind AND a.group_key = b.group_key AND a.split < b.split GROUP BY 1, 2, 3""")
def shared_groups(spark: SparkSession, d: str) -> DataFrame:
    return audit.shared_groups(_all_items(spark, d))


@query("""WITH i AS (SELECT id, split FROM sql_items UNION ALL SELECT id, split FROM qa_items), r AS (SELECT id FROM records UNION ALL SELECT id FROM graded)
SELECT DISTINCT id FROM r WHERE id IN (SELECT id FROM i WHERE split <> 'train') OR regexp_replace(id, '#s[0-9]+$', '') IN (SELECT id FROM i WHERE split <> 'train')""")
def leaked_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the records and of the graded answers (which hold evaluation items) that an evaluation item has."""
    ids = table(spark, d, "records").select("id").unionByName(table(spark, d, "graded").select("id"))
    return audit.leaked_ids(ids, _sides(spark, d)[1])


@query(f"SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY {NORM.format('text')} HAVING count(*) > 1")
def dup_normalized_docs(spark: SparkSession, d: str) -> DataFrame:
    return audit.same_text(table(spark, d, "documents"))


# Accuracy


@query(f"WITH {Q} SELECT count(*) AS questions, sum(n)::BIGINT AS rows, round(avg(first_correct::INT) * 100, 6) AS accuracy_first, round(avg(n_correct / n) * 100, 6) AS accuracy_mean FROM q")
def grade_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_graded(spark, d))


@query(f"""WITH {Q}, i AS (SELECT id, max(difficulty) AS g FROM sql_items GROUP BY id)
SELECT coalesce(nullif(g, ''), 'all') AS difficulty, count(*) AS questions, round(avg(first_correct::INT) * 100, 6) AS accuracy_first FROM q LEFT JOIN i USING (id) GROUP BY 1""")
def by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_group(_graded(spark, d), table(spark, d, "sql_items"), "difficulty")


@query(f"WITH {Q} SELECT coalesce(nullif(split_part(first_error, ':', 1), ''), 'wrong_result') AS kind, count(*) AS questions FROM q WHERE NOT first_correct GROUP BY 1")
def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failures(_graded(spark, d))


@query(f"""WITH {Q} SELECT count(*) AS questions, round(avg(n_correct / n) * 100, 6) AS pass_1, round(avg((n_correct > 0)::INT) * 100, 6) AS pass_k, round(avg((n_correct > 0 AND n_correct < n)::INT) * 100, 6) AS mixed,
  round(avg((n_correct = n)::INT) * 100, 6) AS all_correct, round(avg((n_correct = 0)::INT) * 100, 6) AS all_wrong, list_sort(list(DISTINCT n)) AS sample_counts FROM q""")
def passk(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pass_at_k(_graded(spark, d))


PAIRS = f"{Q}, p AS (SELECT id, first_correct::INT::DOUBLE AS score_a, n_correct / n AS score_b, first_correct::INT::DOUBLE - n_correct / n AS diff FROM q)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _graded(spark, d)
    return metrics.paired(metrics.scores(rows), metrics.scores(rows, mean=True), strict=False)


@query(f"""WITH {PAIRS} SELECT count(*) AS questions, round(avg(score_a) * 100, 6) AS accuracy_a, round(avg(score_b) * 100, 6) AS accuracy_b, round(avg(diff) * 100, 6) AS delta,
  count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses FROM p""")
def paired_compare(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paired_summary(_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT id, score_a, score_b, diff FROM p")
def paired_by_question(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap(_pairs(spark, d))


@query(f"WITH {G} SELECT id, list_sort(list(sample)) AS samples FROM g WHERE gold_error IS NOT NULL AND gold_error <> '' GROUP BY id")
def gold_failed(spark: SparkSession, d: str) -> DataFrame:
    rows = _graded(spark, d).filter("gold_error is not null and gold_error <> ''")
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("sample")).alias("samples"))  # one question's samples


# Selection


@query(f"WITH {ANSWERED} SELECT id, sample, group_key, served_model, response FROM s WHERE status = 'kept'")
def sft_distinct_capped(spark: SparkSession, d: str) -> DataFrame:
    return selection.candidates(_graded(spark, d), _generations(spark, d))


@query(f"""WITH {ANSWERED} SELECT (SELECT count(*) FROM g) AS graded_rows, count(*) AS correct_rows, count(*) FILTER (outside) AS outside_choices, count(*) FILTER (truncated AND NOT outside) AS dropped_truncated,
  count(*) FILTER (prefixed AND NOT truncated AND NOT outside) AS normalized_prefix, count(*) FILTER (markup AND NOT truncated AND NOT outside) AS dropped_markup,
  (SELECT count(*) FROM s WHERE status = 'duplicate') AS dropped_duplicate, (SELECT count(*) FROM s WHERE status = 'over_cap') AS dropped_over_cap, (SELECT count(*) FROM s WHERE status = 'kept') AS candidates FROM a""")
def sft_counters(spark: SparkSession, d: str) -> DataFrame:
    return selection.selection_counts(_graded(spark, d), _generations(spark, d))


@query(f"WITH {ANSWERED} SELECT id, sample, group_key FROM s WHERE status = 'kept' ORDER BY md5('7:' || id || ':' || sample::VARCHAR), id, sample LIMIT 100")
def sft_exact_n(spark: SparkSession, d: str) -> DataFrame:
    return selection.exact_sample(selection.candidates(_graded(spark, d), _generations(spark, d)), 100, seed=7, strict=False).select("id", "sample", "group_key")


@query(f"WITH {ANSWERED} SELECT group_key, count(*) AS rows, count(DISTINCT id) AS questions FROM s WHERE status = 'kept' GROUP BY group_key")
def sft_per_group(spark: SparkSession, d: str) -> DataFrame:
    return selection.per_group(selection.candidates(_graded(spark, d), _generations(spark, d)))


ROLLOUTS = f"""{G}, {CHOICES},
ok AS (SELECT id FROM g GROUP BY id HAVING count(*) = 4 AND min(sample) = 0 AND max(sample) = 3 AND count(DISTINCT sample) = 4),
ro AS (SELECT g.id, g.sample, (g.correct IS TRUE)::INT::DOUBLE AS reward FROM g JOIN ok ON g.id = ok.id JOIN ch ON g.id = ch.id AND g.sample = ch.sample AND n_choices = 4
  WHERE coalesce(finish_reason, '') <> 'length' AND NOT contains({RESPONSE}, '<think>') AND NOT contains({RESPONSE}, '</think>')),
mg AS (SELECT id, count(*) AS members, round(avg(reward), 9) AS reward_mean FROM ro GROUP BY id HAVING count(*) >= 2 AND min(reward) < max(reward))"""


@query(f"WITH {ROLLOUTS} SELECT id, members, reward_mean FROM mg")
def rl_mixed_groups(spark: SparkSession, d: str) -> DataFrame:
    return selection.mixed_groups(_graded(spark, d), _generations(spark, d))


@query(f"WITH {ROLLOUTS} SELECT id, members FROM mg ORDER BY md5('3:' || id), id LIMIT 50")
def rl_seeded_groups(spark: SparkSession, d: str) -> DataFrame:
    return selection.exact_sample(selection.mixed_groups(_graded(spark, d), _generations(spark, d)), 50, seed=3, keys=("id",), strict=False).select("id", "members")


@query(f"""WITH {ROLLOUTS} SELECT (SELECT count(DISTINCT id) FROM g) AS groups, (SELECT count(DISTINCT id) FROM ro) AS groups_sized, count(*) AS groups_mixed, coalesce(sum(members), 0)::BIGINT AS records,
  round(sum(reward_mean * members) / sum(members), 6) AS reward_mean FROM mg""")
def rl_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return selection.group_counts(_graded(spark, d), _generations(spark, d))


@query(f"WITH {G} SELECT id, min(sample) AS sample, arg_min(error, sample) AS error FROM (SELECT id, sample, coalesce(error, '') AS error FROM g WHERE correct IS NOT TRUE AND coalesce(error, '') <> 'gold_failed') GROUP BY id")
def first_failed_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.first_failed(_graded(spark, d)).withColumn("error", F.coalesce("error", F.lit("")))


@query(f"""WITH {G} SELECT id, sample, correct IS TRUE AS correct, error FROM g
UNION ALL SELECT DISTINCT id, 0, FALSE, 'no_sql' FROM sql_items WHERE split = 'dev' AND id IS NOT NULL AND id NOT IN (SELECT id FROM g)
UNION ALL SELECT DISTINCT id, 0, FALSE, 'no_answer' FROM qa_items WHERE split IN ('dev', 'test') AND id IS NOT NULL AND id NOT IN (SELECT id FROM g)""")
def full_coverage_union(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name: table(spark, d, f"{name}_items").filter(F.col("split").isin(*get_task(name).full_coverage)).select("id", "split", F.lit(name).alias("kind"))
    return selection.covered(_graded(spark, d), of("sql").unionByName(of("qa")), ("dev", "test"))


@query("SELECT DISTINCT id FROM (SELECT id FROM sql_items UNION ALL SELECT id FROM qa_items) WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM generations WHERE len(choices) > 0 AND id IS NOT NULL)")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "sql_items").select("id").union(table(spark, d, "qa_items").select("id"))
    return selection.to_do(ids, table(spark, d, "generations"))


@query("SELECT id, count(*) AS rows FROM generations WHERE len(choices) > 0 GROUP BY id HAVING count(*) > 1")
def repeated_generations(spark: SparkSession, d: str) -> DataFrame:
    return selection.repeated_generations(table(spark, d, "generations"))


# Advantages

ADV = f"{G}, rw AS (SELECT id AS group_id, sample, (correct IS TRUE)::INT::DOUBLE AS reward FROM g), mo AS (SELECT group_id, avg(reward) AS mean, stddev_pop(reward) AS std FROM rw GROUP BY group_id HAVING min(reward) < max(reward))"


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    return grading.rewards(_graded(spark, d)).withColumnRenamed("id", "group_id")


@query(f"WITH {ADV} SELECT rw.group_id, sample, reward, round((reward - mean) / std, 9) AS advantage FROM rw JOIN mo USING (group_id)")
def group_advantage_std(spark: SparkSession, d: str) -> DataFrame:
    return advantage.advantages(_rewards(spark, d)).withColumn("advantage", F.round("advantage", 9))


@query(f"WITH {ADV} SELECT rw.group_id, sample, reward, round(reward - mean, 9) AS advantage FROM rw JOIN mo USING (group_id)")
def group_advantage_mean(spark: SparkSession, d: str) -> DataFrame:
    return advantage.advantages(_rewards(spark, d), "mean").withColumn("advantage", F.round("advantage", 9))


@query(f"""WITH {ADV}, ad AS (SELECT (reward - mean) / std AS a FROM rw JOIN mo USING (group_id))
SELECT (SELECT count(*) FROM rw) AS samples, (SELECT round(avg(reward), 6) FROM rw) AS reward_mean, (SELECT round(stddev_pop(reward), 6) FROM rw) AS reward_std, (SELECT count(DISTINCT group_id) FROM rw) AS groups,
  (SELECT count(DISTINCT group_id) FROM rw) - (SELECT count(*) FROM mo) AS groups_equal, count(*) AS used, round(avg(a), 6) + 0.0 AS adv_mean, round(stddev_pop(a), 6) AS adv_std, round(min(a), 6) AS adv_min, round(max(a), 6) AS adv_max FROM ad""")
def advantage_stats(spark: SparkSession, d: str) -> DataFrame:
    return advantage.advantage_stats(_rewards(spark, d)).withColumn("adv_mean", F.col("adv_mean") + 0.0)


@query(f"WITH {G} SELECT size, count(*) AS groups FROM (SELECT id, count(*) AS size FROM g GROUP BY id) GROUP BY size")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return advantage.group_sizes(_rewards(spark, d))


@query("""WITH t AS (SELECT l_returnflag, l_quantity AS w, -l_discount * 10 AS logp, -l_tax * 10 AS old, -(l_discount + l_tax) * 5 AS ref, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.5 END AS a FROM lineitem),
r AS (SELECT *, exp(logp - old) AS ratio, exp(ref - logp) - (ref - logp) - 1 AS kl_raw FROM t),
p AS (SELECT *, -least(ratio * a, greatest(0.8, least(1.2, ratio)) * a) AS pg, least(kl_raw, 10.0) AS kl, ((a > 0 AND ratio > 1.2) OR (a < 0 AND ratio < 0.8))::INT AS clipped FROM r),
c AS (SELECT *, CASE WHEN a < 0 THEN least(pg, -a * 3.0) ELSE pg END AS policy FROM p)
SELECT l_returnflag, sum(w) AS weight, round(sum(ratio * w) / sum(w), 6) AS ratio, round(sum(policy * w) / sum(w), 6) AS policy, round(sum(kl * w) / sum(w), 6) AS kl, round(sum((policy + kl * 0.04) * w) / sum(w), 6) AS loss, round(sum(clipped * w) / sum(w), 6) AS clipped
FROM c GROUP BY l_returnflag""")
def policy_loss_terms(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", -1.0).otherwise(0.5)
    terms = advantage.policy_terms(-F.col("l_discount") * 10, -F.col("l_tax") * 10, -(F.col("l_discount") + F.col("l_tax")) * 5, a)
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("w"), *[terms[k].cast("double").alias(k) for k in ("ratio", "policy", "kl", "loss", "clipped")])
    out = advantage.weighted_metrics(rows, ["l_returnflag"], "w", ["ratio", "policy", "kl", "loss", "clipped"])
    return out.select("l_returnflag", "weight", *[F.round(k, 6).alias(k) for k in ("ratio", "policy", "kl", "loss", "clipped")])


@query(f"WITH {ADV} SELECT group_id FROM rw GROUP BY group_id HAVING min(reward) = max(reward)")
def equal_groups(spark: SparkSession, d: str) -> DataFrame:
    return advantage.equal_groups(_rewards(spark, d))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, vec_id % len(embedding) AS t FROM embeddings), s AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda a: exp(a - list_max(x))))) AS l FROM v)
SELECT vec_id, round(x[t + 1] - l, 6) AS logp, round(l - list_sum(list_transform(x, lambda a: exp(a - l) * a)), 6) AS entropy FROM s""")
def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Log-probability of a position and entropy, with each embedding taken for the logits of a token."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    logp, entropy = advantage.token_stats(F.col("x"), (F.col("vec_id") % F.size("x")).cast("int"))
    return rows.select("vec_id", F.round(logp, 6).alias("logp"), F.round(entropy, 6).alias("entropy"))


_LOGS = "list_transform({0}, lambda a: a::DOUBLE - (list_max({0}) + ln(list_sum(list_transform({0}, lambda b: exp(b::DOUBLE - list_max({0})))))))"


@query(f"""WITH a AS (SELECT vec_id, label, embedding AS x, list_reverse(embedding) AS y FROM embeddings), p AS (SELECT label, list_position(x, list_max(x)) AS ta, list_position(y, list_max(y)) AS tb, {_LOGS.format("x")} AS p, {_LOGS.format("y")} AS q FROM a),
h AS (SELECT label, ta, tb, p[1:8] AS p, q[1:8] AS q FROM p),
k AS (SELECT *, 1.0 - list_sum(list_transform(p, lambda v: exp(v))) AS pr, 1.0 - list_sum(list_transform(q, lambda v: exp(v))) AS qr, list_sum(list_transform(range(1, len(p) + 1), lambda i: exp(p[i]) * (p[i] - q[i]))) AS inside,
  list_max(list_transform(range(1, len(p) + 1), lambda i: abs(p[i] - q[i]))) AS gap, abs(p[1] - q[1]) AS token_gap FROM h),
m AS (SELECT *, inside + CASE WHEN pr > 0 AND qr > 0 THEN pr * (ln(pr) - ln(qr)) ELSE 0 END AS kl FROM k)
SELECT label, count(*) AS positions, round(avg((ta = tb)::INT), 6) AS top1_agreement, round(avg(kl), 6) AS mean_kl, round(max(kl), 6) AS max_kl, round(max(token_gap), 6) AS max_token_gap, round(max(gap), 6) AS max_topk_gap FROM m GROUP BY label""")
def model_parity(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two models, with each embedding and its reverse taken for their logits; the first eight positions are the compared ids."""
    of = lambda c: F.transform(c, lambda a: a - (F.array_max(c) + F.log(F.aggregate(c, F.lit(0.0), lambda s, b: s + F.exp(b - F.array_max(c))))))
    rows = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("x")).withColumn("y", F.reverse("x"))
    logs = rows.select("label", F.array_position("x", F.array_max("x")).alias("top_a"), F.array_position("y", F.array_max("y")).alias("top_b"), of(F.col("x")).alias("p"), of(F.col("y")).alias("q"))
    first = logs.select("label", "top_a", "top_b", F.slice("p", 1, 8).alias("p_logs"), F.slice("q", 1, 8).alias("q_logs"), F.get("p", F.lit(0)).alias("logp_a"), F.get("q", F.lit(0)).alias("logp_b"))
    out = advantage.parity(first, ["label"])
    return out.select("label", "positions", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


# Accounting

UPTIME = """e AS (SELECT epoch_us(ts) AS t, event_type <> 'error' AS ok FROM events WHERE ts IS NOT NULL),
l AS (SELECT *, lag(t) OVER w AS bt, lag(ok) OVER w AS bo FROM e WINDOW w AS (ORDER BY t, ok)),
n AS (SELECT *, sum((ok AND NOT coalesce(bo AND t - bt <= 600000000, FALSE))::INT) OVER (ORDER BY t, ok ROWS UNBOUNDED PRECEDING) AS run FROM l),
u AS (SELECT min(t) AS a, max(t) AS b, count(*) AS pings FROM n WHERE ok GROUP BY run)"""


def _pings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("ts", (F.col("event_type") != "error").alias("ok"))


@query(f"WITH {UPTIME} SELECT a AS started_us, b AS ended_us, pings, round((b - a) / 1e6 + 300, 6) AS seconds FROM u")
def uptime_windows(spark: SparkSession, d: str) -> DataFrame:
    w = accounting.uptime_windows(_pings(spark, d))
    return w.select(F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "pings", F.round("seconds", 6).alias("seconds"))


@query(f"WITH {UPTIME} SELECT count(*) AS windows, round(sum((b - a) / 1e6 + 300), 3) AS seconds FROM u")
def uptime_total(spark: SparkSession, d: str) -> DataFrame:
    return accounting.uptime_total(accounting.uptime_windows(_pings(spark, d)))


@query("""WITH g AS (SELECT DISTINCT * FROM generations WHERE len(choices) > 0) SELECT served_model, count(*) AS rows, sum(len(choices))::BIGINT AS choices,
  sum(coalesce(usage.prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(usage.completion_tokens, 0))::BIGINT AS completion_tokens FROM g GROUP BY served_model""")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return accounting.token_totals(table(spark, d, "generations").distinct(), ["served_model"])


REQUESTS = "rq AS (SELECT DISTINCT id, endpoint, started_at, latency_s, error, usage.prompt_tokens AS prompt_tokens, usage.completion_tokens AS completion_tokens, choices[1].finish_reason AS finish_reason FROM generations)"
LEVELS = f"""{REQUESTS}, ok AS (SELECT endpoint, latency_s, row_number() OVER (PARTITION BY endpoint ORDER BY latency_s) - 1 AS r, count(*) OVER (PARTITION BY endpoint) AS n FROM rq WHERE error IS NULL AND latency_s IS NOT NULL),
qs AS (SELECT endpoint, max(latency_s) FILTER (r = round_even(0.5 * (n - 1), 0)) AS p50, max(latency_s) FILTER (r = round_even(0.9 * (n - 1), 0)) AS p90, max(latency_s) FILTER (r = round_even(0.99 * (n - 1), 0)) AS p99 FROM ok GROUP BY endpoint),
b AS (SELECT endpoint, count(*) AS requests, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS errors, round(max(started_at + latency_s) - min(started_at), 3) AS wall_s,
  coalesce(sum(prompt_tokens) FILTER (error IS NULL), 0) AS ptok, coalesce(sum(completion_tokens) FILTER (error IS NULL), 0) AS tok, count(*) FILTER (error IS NULL AND finish_reason = 'length') AS finish_length FROM rq GROUP BY endpoint),
lv AS (SELECT b.endpoint, requests, ok, errors, wall_s, round(ok / wall_s, 6) AS req_per_s, round(ptok / wall_s, 6) AS prompt_tok_per_s, round(tok / wall_s, 6) AS output_tok_per_s, round(tok / greatest(ok, 1), 6) AS mean_completion, p50, p90, p99, finish_length FROM b LEFT JOIN qs ON b.endpoint IS NOT DISTINCT FROM qs.endpoint)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generations")
    return g.select("id", "endpoint", "started_at", "latency_s", "error", F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("usage.completion_tokens").alias("completion_tokens"), F.get("choices", F.lit(0)).finish_reason.alias("finish_reason")).distinct()


@query(f"WITH {LEVELS} SELECT * FROM lv")
def serving_levels(spark: SparkSession, d: str) -> DataFrame:
    return accounting.serving_levels(_requests(spark, d), "endpoint")


@query(f"WITH {LEVELS.replace('SELECT DISTINCT id, endpoint, ', 'SELECT DISTINCT id, endpoint || chr(64) || floor(started_at / 600)::BIGINT::VARCHAR AS endpoint, ')} SELECT endpoint, req_per_s FROM lv WHERE errors = 0 AND wall_s > 0 ORDER BY req_per_s DESC, endpoint LIMIT 1")
def best_level(spark: SparkSession, d: str) -> DataFrame:
    """The best ten minutes of an endpoint without an error."""
    named = F.concat(F.col("endpoint"), F.lit("@"), F.floor(F.col("started_at") / 600).cast("string"))
    return accounting.best_level(accounting.serving_levels(_requests(spark, d).withColumn("endpoint", named), "endpoint").filter("wall_s > 0"), "endpoint").select("endpoint", "req_per_s")


@query("""WITH o AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
q AS (SELECT unnest([0.5, 0.9, 0.99]) AS quantile) SELECT DISTINCT o_orderpriority, quantile::DOUBLE AS quantile, o_totalprice FROM o JOIN q ON r = round_even(quantile::DOUBLE * (n - 1), 0)""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.5, 0.9, 0.99])


RUNS = """p AS (SELECT p_partkey, p_brand, p_size, CASE p_partkey % 3 WHEN 0 THEN 'recipe' WHEN 1 THEN 'overhead' ELSE 'other' END AS role, p_size * 64 AS hidden, 1 + p_partkey % 48 AS layers, p_size * 256 AS ffn, 32000 AS vocab,
  p_size AS heads, 64 AS head_dim, greatest(1, p_size // 4) AS kv, 16 AS rank, (1000000 + p_partkey * 100)::DOUBLE AS tokens, 1000.0::DOUBLE AS sequences, 1 + p_partkey % 3 AS epochs, p_partkey % 2 AS extra, p_retailprice AS wall_s FROM part),
dm AS (SELECT *, (layers * (hidden * heads * head_dim * 2 + hidden * kv * head_dim * 2 + hidden * ffn * 3))::DOUBLE AS dec, (hidden * vocab)::DOUBLE AS head, (layers * rank * ((hidden + heads * head_dim) * 2 + (hidden + kv * head_dim) * 2 + (hidden + ffn) * 3))::DOUBLE AS ad, heads * head_dim AS width FROM p),
fw AS (SELECT *, (dec + head) * 2 + layers * width * (tokens / sequences) * 2 AS forward FROM dm),
op AS (SELECT *, tokens * epochs * (forward * 2 + ad * 6) + tokens * extra * forward AS model_ops, tokens * epochs * (forward * 3 + ad * 8) + tokens * extra * forward AS hardware_ops, wall_s / 3600 * 8 AS hours FROM fw)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    rows = table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("device"), F.when(key % 3 == 0, "recipe").when(key % 3 == 1, "overhead").otherwise("other").alias("role"),
        (size * 64).alias("hidden"), (1 + key % 48).alias("layers"), (size * 256).alias("ffn"), F.lit(32000).cast("bigint").alias("vocab"), size.alias("heads"), F.lit(64).cast("bigint").alias("head_dim"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(size / 4)).alias("kv_heads"), F.lit(16).cast("bigint").alias("rank"), (1000000 + key * 100).cast("double").alias("tokens"), F.lit(1000.0).alias("sequences"),
        (1 + key % 3).alias("epochs"), (key % 2).alias("extra_passes"), F.col("p_retailprice").alias("wall_s"), F.lit(8).alias("devices"),
    )
    return accounting.run_operations(rows)


@query(f"WITH {RUNS} SELECT p_partkey, round(model_ops / 1e15, 6) AS model_pops, round(hardware_ops / 1e15, 6) AS hardware_pops, round(hours, 6) AS hours, round(model_ops / (hours * 3600 * 1e15), 9) AS utilisation FROM op")
def flops_by_run(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("p_partkey", F.round(F.col("model_ops") / 1e15, 6).alias("model_pops"), F.round(F.col("hardware_ops") / 1e15, 6).alias("hardware_pops"), F.round("hours", 6).alias("hours"), F.round(accounting.utilisation(F.col("model_ops"), F.col("hours"), 1e15), 9).alias("utilisation"))


@query(f"WITH {RUNS} SELECT role, p_brand AS device, count(*) AS runs, round(sum(hours), 4) AS hours, round(sum(model_ops) / 1e18, 4) AS model_eops FROM op WHERE role <> 'other' GROUP BY 1, 2")
def role_rollup(spark: SparkSession, d: str) -> DataFrame:
    return accounting.role_totals(_runs(spark, d)).select("role", "device", "runs", F.round("hours", 4).alias("hours"), F.round(F.col("model_ops") / 1e18, 4).alias("model_eops"))


# Grading

_P = STRIP.format("lower(pred_answer)").replace("{{", "{").replace("}}", "}")
SCORE = rf"""{G}, {QA},
j AS (SELECT g.id, g.sample, g.pred_answer, {_P} AS p, gold_num AS y, gold_text FROM g JOIN qa ON g.id = qa.id),
x AS (SELECT *, CASE WHEN regexp_matches(p, {NUMBER}) THEN TRY_CAST(p AS DOUBLE) END AS x FROM j),
sc AS (SELECT id, sample, pred_answer, CASE
  WHEN p IS NULL OR p = '' OR (gold_text IS NOT NULL AND p NOT IN ('yes', 'no')) THEN FALSE WHEN gold_text IS NOT NULL THEN p = gold_text WHEN x IS NULL THEN FALSE WHEN x = 0 AND y <> 0 THEN FALSE
  ELSE abs(x - y) <= abs(y) * 0.01 * (1 + 1e-9) OR (abs(y) < 0.5 AND abs(x - y) <= 0.005 * (1 + 1e-9)) OR abs(x / 100 - y) <= abs(y) * 0.01 * (1 + 1e-9) OR abs(x * 100 - y) <= abs(y) * 0.01 * (1 + 1e-9) END AS correct,
  CASE WHEN p IS NULL OR p = '' THEN 'no_answer' WHEN gold_text IS NOT NULL AND p NOT IN ('yes', 'no') THEN 'not_yes_no' WHEN gold_text IS NOT NULL THEN '' WHEN x IS NULL THEN 'not_a_number' ELSE '' END AS error FROM x)"""


@query(f"WITH {SCORE} SELECT id, sample, pred_answer, correct, error FROM sc")
def numeric_score(spark: SparkSession, d: str) -> DataFrame:
    return grading.numeric_grades(_graded(spark, d).select("id", "sample", "pred_answer"), _qa(spark, d))


@query(f"""WITH {CHOICES}, xr AS (SELECT ch.id, sample, content FROM ch WHERE ch.id IN (SELECT id FROM qa_items)), {answer_ctes("xr", "content", "id, sample")} SELECT id, sample, answer FROM xa""")
def extract_numeric_answer(spark: SparkSession, d: str) -> DataFrame:
    each = selection.choices(_generations(spark, d)).join(_qa(spark, d).select("id"), "id", "left_semi")
    return each.select("id", "sample", numbers.extract_answer(F.col("content")).alias("answer"))


_C = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(rf"""WITH {CHOICES}, {ITEMS}, b AS (SELECT ch.id, sample, string_split(content, '</think>')[-1] AS t FROM ch JOIN items ON ch.id = items.id),
e AS (SELECT *, list_filter(list_transform(regexp_extract_all(t, '(?is)```\s*sql\s*\n?(.*?)```', 1), lambda x: {_C.format("x")}), lambda x: x <> '')[-1] AS s1,
  list_filter(list_transform(regexp_extract_all(t, '(?s)```[a-zA-Z]*\s*\n?(.*?)```', 1), lambda x: {_C.format("x")}), lambda x: x <> '')[-1] AS s2, nullif(regexp_extract(t, '(?is)\b(?:WITH|SELECT)\b.*', 0), '') AS s3 FROM b)
SELECT id, sample, {_C.format(r"regexp_replace(" + _C.format("coalesce(s1, s2, s3)") + r", '(?:[\s\p{Z}]*;)+$', '')")} AS code FROM e""")
def extract_code_block(spark: SparkSession, d: str) -> DataFrame:
    each = selection.choices(_generations(spark, d)).join(_items(spark, d).select("id"), "id", "left_semi")
    return each.select("id", "sample", text.extract_sql(F.col("content")).alias("code"))


GOLDS = f"""{QA}, go AS (SELECT id, split, gold_num, gold_text, coalesce(gold_text, printf('%.17g', gold_num)) AS gold FROM qa), {score_case("x", "y", "t").join(["gs AS (SELECT id, ", " AS correct FROM (SELECT id, gold AS x, gold_num AS y, gold_text AS t FROM go))"])}"""


@query(f"WITH {GOLDS} SELECT count(*) AS items, count(*) FILTER (correct) AS correct FROM gs")
def gold_control(spark: SparkSession, d: str) -> DataFrame:
    return grading.gold_control(_qa(spark, d)).agg(F.count(F.lit(1)).alias("items"), F.count_if("correct").alias("correct"))


@query(f"""WITH {GOLDS}, n AS (SELECT *, CASE WHEN gold_text IS NOT NULL THEN gold_text ELSE printf('%.9e', gold_num + 0.0) END AS key FROM go),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(key), key) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT coalesce(split, '') AS g, key FROM n)),
j AS (SELECT n.id, n.split, n.key AS gold, o.key AS x, gold_num AS y, gold_text AS t FROM n JOIN k ON coalesce(n.split, '') = k.g AND n.key = k.key JOIN k o ON o.g = k.g AND o.r = (k.r + 1) % k.n WHERE k.n > 1)
SELECT id, split, gold, x AS other, {score_case("x", "y", "t")} AS correct FROM j""")
def numeric_shuffled_control(spark: SparkSession, d: str) -> DataFrame:
    return grading.numeric_shuffled_control(_qa(spark, d))


@query(f"""WITH n AS (SELECT id, min(coalesce(db_id, '')) AS g, min(trim(gold_sql, ' ')) AS gold FROM sql_items WHERE id IS NOT NULL AND gold_sql IS NOT NULL GROUP BY id),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(gold), gold) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT g, gold FROM n))
SELECT n.id, n.gold, o.gold AS other FROM n JOIN k ON n.g = k.g AND n.gold = k.gold JOIN k o ON o.g = k.g AND o.r = (k.r + 1) % k.n WHERE k.n > 1""")
def shuffled_control(spark: SparkSession, d: str) -> DataFrame:
    return grading.shuffled_control(table(spark, d, "sql_items"), "db_id", "gold_sql")


@query("""WITH a AS (SELECT o_custkey::DOUBLE AS k, o_orderstatus AS s FROM orders), b AS (SELECT c_custkey::DOUBLE AS k, 'F' AS s FROM customer)
SELECT (SELECT count(*) FROM (SELECT DISTINCT k, s FROM a EXCEPT SELECT DISTINCT k, s FROM b)) AS only_a, (SELECT count(*) FROM (SELECT DISTINCT k, s FROM b EXCEPT SELECT DISTINCT k, s FROM a)) AS only_b""")
def result_set_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    b = table(spark, d, "customer").select(F.col("c_custkey").cast("double"), F.lit("F"))
    return grading.difference(a, b).agg(F.coalesce(F.sum("in_a"), F.lit(0)).alias("only_a"), F.coalesce(F.sum("in_b"), F.lit(0)).alias("only_b"))


@query(f"WITH {G} SELECT id, sample, CASE WHEN correct IS TRUE THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM g")
def binary_rewards(spark: SparkSession, d: str) -> DataFrame:
    return grading.rewards(_graded(spark, d))


# Prompts

_L = r"list_filter(list_transform({}, lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '')"
_LINES = "coalesce(nullif(array_to_string(" + _L + ", chr(10)), ''), '(none)')"
_TABLE = r"coalesce(nullif(array_to_string(list_transform(table_rows, lambda r: array_to_string(list_transform(r, lambda c: regexp_replace(c, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), ' | ')), chr(10)), ''), '(none)')"
QA_TEXT = f"""'Report page:' || chr(10) || {_LINES.format("pre_text")} || chr(10) || chr(10) || {_TABLE} || chr(10) || chr(10) || {_LINES.format("post_text")} || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || chr(10) || 'Keep it short and end with a line that starts with Answer.'"""
SQL_TEXT = """'Tables of the database:' || chr(10) || chr(10) || chr(10) || 'Hint: ' || coalesce(nullif(evidence, ''), 'none') || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || chr(10) || 'Work in short steps and finish with one SQLite query.'"""


@query(f"WITH {QA} SELECT id, report, {QA_TEXT} AS user_text FROM qa")
def qa_prompts(spark: SparkSession, d: str) -> DataFrame:
    return prompts.qa_prompts(_qa(spark, d)).select("id", "report", F.element_at("messages", -1).content.alias("user_text"))


@query(f"WITH {ITEMS} SELECT id, db_id, {SQL_TEXT} AS user_text FROM items")
def sql_prompts(spark: SparkSession, d: str) -> DataFrame:
    return prompts.sql_prompts(_items(spark, d)).select("id", "db_id", F.element_at("messages", -1).content.alias("user_text"))


@query(f"WITH {QA} SELECT count(*) AS prompts, max(length({QA_TEXT})) AS chars_max, round(avg(length({QA_TEXT})), 1) AS chars_mean FROM qa")
def prompt_sizes(spark: SparkSession, d: str) -> DataFrame:
    return prompts.prompt_sizes(prompts.qa_prompts(_qa(spark, d)))


@query(f"WITH {ITEMS} SELECT id, db_id FROM items WHERE split = 'train' AND db_id IS DISTINCT FROM NULL AND db_id NOT IN (SELECT db_id FROM items WHERE split <> 'train' AND db_id IS NOT NULL) UNION ALL SELECT id, db_id FROM items WHERE split = 'train' AND db_id IS NULL")
def train_only_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d)
    return prompts.without_groups_of(rows.filter("split = 'train'"), rows.filter("split <> 'train'"), "db_id").select("id", "db_id")


@query(rf"""SELECT id, regexp_extract({_PROMPT}, '{text.QUESTION_PART}', 1) AS question, regexp_extract({_PROMPT}, '{text.EVIDENCE_PART}', 1) AS evidence FROM (SELECT DISTINCT id, messages FROM records WHERE id IS NOT NULL)""")
def prompt_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").filter("id is not null").select("id", "messages").distinct()
    return rows.select("id", text.question_of(audit.last_user_text()).alias("question"), F.regexp_extract(audit.last_user_text(), text.EVIDENCE_PART, 1).alias("evidence"))


# Batches

RENDERED = """tx AS (SELECT group_id, reward, id, response, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') AS head FROM records),
tl AS (SELECT *, length(head) + length('<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10)) AS n, length(response || '<|im_end|>') AS trained, length(head) + length('<|im_start|>assistant' || chr(10)) AS low FROM tx),
st AS (SELECT *, CASE WHEN head IS NULL OR coalesce(response, '') = '' THEN 'unmatched' WHEN n > 1024 THEN 'long' ELSE 'kept' END AS status FROM tl)"""


def _characters(text: str) -> list[tuple[int, int, int]]:
    """Each character as a token."""
    return list(zip(map(ord, text), range(len(text)), range(1, len(text) + 1), strict=True))


RULES = """CASE WHEN id IS NULL OR id = '' THEN 'no_id' WHEN response IS NULL THEN 'no_response' WHEN messages IS NULL OR len(messages) = 0 THEN 'no_messages'
  WHEN len(list_filter(messages, lambda m: m.role IS NULL OR m.role NOT IN ('system', 'user') OR m.content IS NULL)) > 0 THEN 'bad_message' WHEN messages[-1].role IS DISTINCT FROM 'user' THEN 'last_not_user' ELSE 'valid' END"""


@query(f"SELECT {RULES} AS rule, count(*) AS records FROM records GROUP BY 1")
def record_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return batching.rule_counts(table(spark, d, "records"))


@query(f"SELECT DISTINCT id FROM records WHERE {RULES} = 'valid' AND reward IS NOT NULL AND group_id IS NOT NULL")
def valid_records(spark: SparkSession, d: str) -> DataFrame:
    return batching.valid_records(table(spark, d, "records"), "required").select("id").distinct()


@query("SELECT id, count(*) AS rows FROM records GROUP BY id HAVING count(*) > 1")
def repeated_record_ids(spark: SparkSession, d: str) -> DataFrame:
    return batching.repeated_ids(table(spark, d, "records"))


@query("""SELECT bucket, count(*) AS records FROM (SELECT CASE WHEN n <= 64 THEN 64 WHEN n <= 128 THEN 128 WHEN n <= 256 THEN 256 WHEN n <= 512 THEN 512 ELSE 1024 END AS bucket FROM (SELECT coalesce(length(response), 0) AS n FROM records)) GROUP BY bucket""")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.length("response"), F.lit(0))
    return table(spark, d, "records").select(batching.bucket(n, [64, 128, 256, 512], 1024).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("records"))


@query(f"""WITH {RENDERED}, w AS (SELECT id, max(trained) AS trained FROM st WHERE status = 'kept' AND id IS NOT NULL GROUP BY id), k AS (SELECT id, row_number() OVER (ORDER BY md5('5:' || id)) - 1 AS rank, count(*) OVER () AS n FROM w),
b AS (SELECT rank // 64 AS g, sum(trained) AS s FROM k JOIN w USING (id) WHERE rank // 64 < n // 64 GROUP BY 1) SELECT 0 AS epoch, count(*) FILTER (s <> 0) AS steps FROM b""")
def training_steps(spark: SparkSession, d: str) -> DataFrame:
    """Optimizer steps of an epoch over the rendered records in batches of 64: those whose next-token weights aren't all 0."""
    done = batching.rendered(table(spark, d, "records").filter("id is not null"), _characters, 1024).filter("status = 'kept'")
    weight = F.aggregate(batching.shifted(F.col("loss_weight")), F.lit(0.0), lambda a, w: a + w)
    rows = cut_lineage(done.groupBy("id").agg(F.max("n_real").alias("n"), F.max(weight).alias("weight")))
    return batching.optimizer_steps(batching.batch_plan(rows, "n", 64, 16, seed=5), rows)


@query("""WITH r AS (SELECT id, max(length(response)) AS length FROM records WHERE id IS NOT NULL AND response IS NOT NULL GROUP BY id), e AS (SELECT *, unnest([0, 1]) AS epoch FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5((epoch + 5)::VARCHAR || ':' || id)) - 1 AS rank, count(*) OVER (PARTITION BY epoch) AS n FROM e),
b AS (SELECT *, rank // 64 AS global_batch FROM k), p AS (SELECT *, row_number() OVER (PARTITION BY epoch, global_batch ORDER BY length, id) - 1 AS place FROM b WHERE global_batch < n // 64),
w AS (SELECT *, place // 16 AS micro_batch, max(length) OVER (PARTITION BY epoch, global_batch, place // 16) AS longest FROM p)
SELECT epoch, global_batch, micro_batch, place, id, length, CASE WHEN longest <= 64 THEN 64 WHEN longest <= 128 THEN 128 WHEN longest <= 256 THEN 256 WHEN longest <= 512 THEN 512 ELSE 1024 END AS width FROM w""")
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").filter("id is not null and response is not null").groupBy("id").agg(F.max(F.length("response")).alias("n"))
    return batching.batch_plan(rows, "n", 64, 16, epochs=2, seed=5, buckets=[64, 128, 256, 512], full=1024)


@query("""WITH s AS (SELECT p_partkey::VARCHAR AS path, p_size::BIGINT AS size, coalesce(sum(p_size) OVER (ORDER BY p_retailprice, md5(p_partkey::VARCHAR), p_partkey::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part WHERE p_partkey::VARCHAR NOT IN ('1', '2'))
SELECT path, size FROM s WHERE 100 + before - 900 < 1000""")
def lru_eviction(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("last_use"))
    return batching.evictions(entries, free=100, need=900, reserve=1000, keep=["1", "2"])


@query("SELECT DISTINCT id, len(messages) + 1 AS parts, length(response) AS trained_chars FROM records WHERE id IS NOT NULL AND response IS NOT NULL AND messages IS NOT NULL")
def weighted_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").filter("id is not null and response is not null and messages is not null")
    weighted = rows.select("id", batching.weighted_messages().alias("m"))
    trained = F.aggregate(F.filter("m", lambda m: m.weight > 0), F.lit(0), lambda a, m: a + F.length(m.content))
    return weighted.select("id", F.size("m").alias("parts"), trained.alias("trained_chars")).distinct()


@query(f"""WITH {RENDERED} SELECT count(*) AS n_input, count(*) FILTER (status = 'kept') AS n_kept, 0 AS n_truncated, count(*) FILTER (status = 'long') AS n_overlong, count(*) FILTER (status = 'unmatched') AS n_unmatched,
  coalesce(sum(n) FILTER (status = 'kept'), 0)::BIGINT AS tokens_real, coalesce(sum(trained) FILTER (status = 'kept'), 0)::BIGINT AS tokens_trained, count(*) FILTER (status = 'unmatched') > count(*) * 0.01 AS template_refused FROM st""")
def record_render_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records rendered with characters as tokens; those of over 1,024 are dropped."""
    return batching.render_counts(batching.rendered(table(spark, d, "records"), _characters, 1024))


@query(f"""WITH {RENDERED}, ro AS (SELECT * FROM st WHERE reward IS NOT NULL), eq AS (SELECT coalesce(group_id, '') AS g, min(v) < max(v) AS mixed FROM (SELECT group_id, CASE WHEN contains(response, '9') THEN 1.0 ELSE 0.0 END AS v FROM ro) GROUP BY 1),
me AS (SELECT ro.*, greatest(0, least(n, 1024, low + trained) - low) AS used FROM ro JOIN eq ON coalesce(group_id, '') = g WHERE mixed)
SELECT (SELECT count(*) FROM ro) AS n_rollouts, (SELECT count(*) FROM ro) - count(*) AS n_equal_rewards, count(*) FILTER (status <> 'unmatched' AND used > 0) AS n_sequences, count(*) FILTER (status = 'long') AS n_truncated, 0 AS n_overlong,
  count(*) FILTER (status <> 'unmatched' AND used = 0) AS n_untrained, count(*) FILTER (status = 'unmatched') AS n_unmatched, coalesce(sum(used) FILTER (status <> 'unmatched'), 0)::BIGINT AS tokens_trained,
  coalesce(sum(least(n, 1024)) FILTER (status <> 'unmatched' AND used > 0), 0)::BIGINT AS tokens_real FROM me""")
def rollout_sequence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of rollouts, cut at 1,024 characters. All rewards of the table are 1, so a response with a 9 takes 1 and another 0; every row is a member of its own."""
    rows = table(spark, d, "records").filter("reward is not null").withColumns({"reward": F.when(F.col("response").contains("9"), 1.0).otherwise(0.0), "group_id": F.coalesce("group_id", F.lit("")), "id": F.monotonically_increasing_id().cast("string")})
    kept = cut_lineage(rows.select("id", "group_id", "reward", "messages", "response"))
    return batching.rollout_counts(kept, batching.rollout_sequences(kept, _characters, 1024, overlong="truncate"))


# Streams


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream: its schema is read from the files, its rows by the stream."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    folder = _is_folder(spark, path)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    streams.run_once(stream, f"{base}/rows", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND (isnan(coalesce(value, 0)) OR isinf(coalesce(value, 0)) OR coalesce(value, 0) > 5)")
def kl_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = _streamed(spark, d, "events").select("event_id", F.col("event_type").alias("event"), F.col("value").alias("kl"))
    return _run(spark, streams.guard(rows, "kl", 5.0, "error").select("event_id", F.col("kl").alias("value")))


@query("SELECT DISTINCT event_id, user_id FROM events")
def streaming_unseen(spark: SparkSession, d: str) -> DataFrame:
    rows = _streamed(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _run(spark, streams.unseen(rows, "event_id", "ts", "1 hour").select("event_id", "user_id"))
