"""Contamination audits: exact and n-gram overlap with evaluation data, id and group checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import extract_answer, score
from ..functions.text import digest128, evidence_of, extract_sql, ngram_digests, normalize_text, question_of, strip_sample
from .grading import execute_grades

NGRAM = 13


def last_user_text(messages: str = "messages") -> Column:
    """The content of the last user message; '' if there is none."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m.role == "user"), F.lit(-1)).content, F.lit(""))


def grams(texts: DataFrame, keys: list[str], columns: list[str], n: int = NGRAM) -> DataFrame:
    """(keys, a, b): the n-gram digests of each row's texts, each text's once; null texts and texts of fewer words have none."""
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    each = F.flatten(F.array(*[F.coalesce(ngram_digests(F.col(c), n), none) for c in columns]))
    return texts.select(*keys, F.explode(each).alias("g")).select(*keys, "g.a", "g.b")


def sharing(rows: DataFrame, evals: DataFrame, key: str = "id", n: int = NGRAM, extra: tuple[str, ...] = ("evidence",), within: tuple[str, ...] = ()) -> DataFrame:
    """(key, shared): rows that share n-grams with the evaluation texts, with how many different ones.

    A semi join on the digests with the distinct evaluation grams, which meets a common gram once for each row and never lists pairs of
    rows; only the grams that meet are made distinct. within: columns that have to be equal as well (the kind of question).
    """
    columns = ["question", *extra]
    wanted = grams(evals, list(within), columns, n).distinct()
    met = grams(rows, [key, *within], columns, n).join(wanted, [*within, "a", "b"], "left_semi")
    return met.select(key, "a", "b").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("shared"))


def repeating(rows: DataFrame, evals: DataFrame, key: str = "id", within: tuple[str, ...] = ()) -> DataFrame:
    """(key) of rows whose normalised question is an evaluation question. Texts without words match each other."""
    normal = normalize_text(F.col("question")).alias("n")
    wanted = evals.filter("question is not null").select(*within, normal).distinct()
    return rows.filter("question is not null").select(key, *within, normal).join(wanted, [*within, "n"], "left_semi").select(key).distinct()


def clean_rows(rows: DataFrame, evals: DataFrame, key: str = "id", n: int = NGRAM, within: tuple[str, ...] = ()) -> DataFrame:
    """rows without those that repeat an evaluation question or share an n-gram with one."""
    bad = repeating(rows, evals, key, within).union(sharing(rows, evals, key, n, within=within).select(key)).distinct()
    return rows.join(bad, key, "left_anti")


def removed_counts(rows: DataFrame, evals: DataFrame, key: str = "id", n: int = NGRAM, within: tuple[str, ...] = ()) -> DataFrame:
    """One row: distinct rows, repeated questions, rows that only share an n-gram, and rows kept."""
    ids = rows.select(key).distinct()
    flagged = ids.join(repeating(rows, evals, key, within).withColumn("exact", F.lit(True)), key, "left").join(sharing(rows, evals, key, n, within=within), key, "left")
    exact, gram = F.col("exact").isNotNull(), F.col("shared").isNotNull()
    return flagged.agg(F.count(F.lit(1)).alias("rows"), F.count_if(exact).alias("exact"), F.count_if(gram & ~exact).alias("ngram_only"), F.count_if(~gram & ~exact).alias("kept"))


def all_items(sql_items: DataFrame, qa_items: DataFrame) -> DataFrame:
    """(id, split, kind, group_key, question, evidence, gold_sql, gold_num, gold_text) of both kinds of items; of an id that comes twice the row loaded last."""
    last = lambda rows, cols: rows.filter("id is not null").groupBy("id").agg(F.max_by(F.struct(*cols), F.coalesce("loaded_at", F.lit(0).cast("timestamp"))).alias("r")).select("id", "r.*")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    sql = last(sql_items, ["split", F.lit("sql").alias("kind"), F.col("db_id").alias("group_key"), "question", "evidence", "gold_sql", none("double", "gold_num"), none("string", "gold_text")])
    qa = last(qa_items, ["split", F.lit("qa").alias("kind"), F.col("report").alias("group_key"), "question", none("string", "evidence"), none("string", "gold_sql"), "gold_num", "gold_text"])
    return sql.unionByName(qa)


def record_questions(records: DataFrame) -> DataFrame:
    """(id, item_id, kind, group_key, question, evidence, response) of training records; one row for each distinct record."""
    prompt = last_user_text()
    kind = F.when(F.col("db_id").isNotNull(), "sql").when(F.col("report").isNotNull(), "qa")
    return records.filter("id is not null").select("id", strip_sample(F.col("id")).alias("item_id"), kind.alias("kind"), F.coalesce("db_id", "report").alias("group_key"), question_of(prompt).alias("question"), evidence_of(prompt).alias("evidence"), "response").distinct()


def record_flags(records: DataFrame, items: DataFrame, n: int = NGRAM, eval_splits: tuple[str, ...] = ("dev", "test"), databases: DataFrame | None = None) -> DataFrame:
    """(id, kind, group_key, not_a_train_item, eval_group, exact, ngram, reverify_failed): the audit rules each training record breaks.

    items: all_items(). A record must come from a train item of the same group with the same normalised question; its group, and for
    financial questions its item's, must be none of the evaluation splits'; its question must be no evaluation question, and question and
    evidence must share no n-gram with those; its answer, read from the response again, must be right. Records without a db_id and a
    report take the kind of their item. Queries are run only where databases (db_id, path) names the file; without it their
    reverify_failed is null.
    """
    train = items.filter("split = 'train'").select(F.col("id").alias("item_id"), F.col("kind").alias("t_kind"), F.col("group_key").alias("t_group"), normalize_text(F.col("question")).alias("t_question"), "gold_sql", "gold_num", "gold_text", F.lit(True).alias("known"))
    rows = record_questions(records).join(train, "item_id", "left").withColumn("kind", F.coalesce("kind", "t_kind"))
    evals = items.filter(F.col("split").isin(*eval_splits))
    groups = evals.select("kind", F.col("group_key").alias("e_group")).dropna().distinct()
    exact = repeating(rows, evals, within=("kind",)).withColumn("x", F.lit(True))
    gram = sharing(rows, evals, n=n, within=("kind",))
    own = groups.select("kind", F.col("e_group").alias("group_key"), F.lit(True).alias("own_eval"))
    of_item = groups.filter("kind = 'qa'").select("kind", F.col("e_group").alias("t_group"), F.lit(True).alias("item_eval"))
    joined = rows.join(own, ["kind", "group_key"], "left").join(of_item, ["kind", "t_group"], "left").join(exact, "id", "left").join(gram, "id", "left")
    # the lambda binds the answer, so that it is read once and the generated code stays small
    value = F.get(F.transform(F.array(extract_answer(F.col("response"))), lambda a: score(a, F.col("gold_num"), F.col("gold_text")).correct), F.lit(0))
    same = F.col("t_question").eqNullSafe(normalize_text(F.col("question"))) & F.col("t_group").eqNullSafe(F.col("group_key"))
    out = joined.select(
        "id",
        "kind",
        "group_key",
        (F.col("known").isNull() | ~same).alias("not_a_train_item"),
        (F.coalesce("own_eval", F.lit(False)) | F.coalesce("item_eval", F.lit(False))).alias("eval_group"),
        F.col("x").isNotNull().alias("exact"),
        F.col("shared").isNotNull().alias("ngram"),
        F.when(F.col("kind") == "qa", F.col("known").isNull() | ~F.coalesce(value, F.lit(False))).alias("reverify_failed"),
    )
    if databases is None:
        return out
    return out.drop("reverify_failed").join(reverified_queries(rows, databases).withColumnRenamed("failed", "sql_failed"), "id", "left").join(out.filter("kind = 'qa'").groupBy("id").agg(F.max("reverify_failed").alias("qa_failed")), "id", "left").withColumn("reverify_failed", F.coalesce("qa_failed", "sql_failed")).drop("qa_failed", "sql_failed")


def reverified_queries(rows: DataFrame, databases: DataFrame) -> DataFrame:
    """(id, failed) of text-to-SQL records of train items: their query, read from the response again, run against the gold on its database."""
    to_run = rows.filter("kind = 'sql' and known").join(databases.select(F.col("db_id").alias("group_key"), "path").distinct(), "group_key", "left")
    ready = to_run.select("id", F.lit(0).alias("sample"), "path", "gold_sql", extract_sql(F.col("response")).alias("pred_sql"))
    return execute_grades(ready).groupBy("id").agg((~F.min("correct")).alias("failed"))


RULES = ("not_a_train_item", "eval_group", "exact", "ngram", "reverify_failed")


def rule_counts(flags: DataFrame) -> DataFrame:
    """One row: records and how many break each rule; an answer that couldn't be verified again breaks none."""
    return flags.agg(F.count(F.lit(1)).alias("records"), *[F.count_if(r).alias(r) for r in RULES])


def rule_examples(flags: DataFrame, n: int = 5) -> DataFrame:
    """(rule, id): the first n ids in order that break each rule. The bound on the row number is taken in each partition first, so a rule that all rows break shuffles n rows a partition."""
    broken = flags.select("id", F.explode(F.array(*[F.when(F.col(r), F.lit(r)) for r in RULES])).alias("rule")).filter("rule is not null").distinct()
    return broken.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("id"))).filter(F.col("r") <= n).select("rule", "id")


def contamination(records: DataFrame, items: DataFrame, n: int = NGRAM) -> DataFrame:
    """(group_key, records, exact, ngram): per group the records, and those that repeat or share an n-gram with an evaluation question."""
    flags = record_flags(records, items, n)
    return flags.groupBy("group_key").agg(F.count(F.lit(1)).alias("records"), F.count_if("exact").alias("exact"), F.count_if("ngram").alias("ngram"))


def shared_groups(items: DataFrame) -> DataFrame:
    """(kind, split_a, split_b, groups): how many groups each pair of splits has in common, by kind of question."""
    named = items.filter("group_key is not null and split is not null").select("kind", "split", "group_key").distinct()
    pairs = named.groupBy("kind", "group_key").agg(F.array_sort(F.collect_set("split")).alias("s"))  # at most one entry for each split
    each = pairs.select("kind", F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))).alias("p"))
    return each.groupBy("kind", "p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("groups"))


def leaked_ids(records: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """(id): records whose id, with or without its sample, is an evaluation id. Empty when the two are disjoint."""
    ids = records.filter("id is not null").select("id").distinct()
    wanted = eval_ids.select(F.col("id").alias("e")).dropna().distinct()
    return ids.withColumn("k", F.explode(F.array_distinct(F.array(F.col("id"), strip_sample(F.col("id")))))).join(wanted, F.col("k") == F.col("e"), "left_semi").select("id").distinct()


def same_text(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(first_id, copies): sets of documents with the same normalised text, more than one; grouped on 128 bits of digest."""
    n = normalize_text(F.col(text))
    grouped = documents.filter(F.col(text).isNotNull()).select(key, *[h.alias(name) for h, name in zip(digest128(n), "ab", strict=True)]).groupBy("a", "b").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return grouped.filter("copies > 1").select("first_id", "copies")
