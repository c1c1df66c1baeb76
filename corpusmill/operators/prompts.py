"""Chat prompts for questions: building, filtering and checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_lines, table_lines

SQL_SYSTEM = "You write correct SQLite queries."
SQL_TEMPLATE = "Tables of the database:\n{schema}\n\nHint: {evidence}\n\nQuestion: {question}\n\nWork in short steps and finish with one SQLite query."
QA_SYSTEM = "You read annual reports and compute figures."
QA_TEMPLATE = "Report page:\n{pre_text}\n\n{table}\n\n{post_text}\n\nQuestion: {question}\n\nKeep it short and end with a line that starts with Answer."


def fill(template: str, **parts: Column) -> Column:
    """A template with its {names} replaced; nulls are empty."""
    out: list[Column] = []
    rest = template
    while rest:
        at = min((i for n in parts if (i := rest.find("{" + n + "}")) >= 0), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        out += [F.lit(rest[:at]), F.coalesce(parts[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)


def chat(system: str, user: Column) -> Column:
    """System and user message as an array of (role, content)."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def sql_prompts(items: DataFrame, schemas: DataFrame | None = None, template: str = SQL_TEMPLATE, system: str = SQL_SYSTEM) -> DataFrame:
    """(id, db_id, split, difficulty, messages). schemas: (db_id, schema_text); a database without one gets an empty schema. No evidence reads 'none'."""
    rows = items.join(schemas, "db_id", "left") if schemas is not None else items.withColumn("schema_text", F.lit(""))
    user = fill(template, schema=F.col("schema_text"), evidence=F.coalesce(F.nullif(F.col("evidence"), F.lit("")), F.lit("none")), question=F.col("question"))
    return rows.select("id", "db_id", "split", "difficulty", chat(system, user).alias("messages"))


def qa_prompts(items: DataFrame, template: str = QA_TEMPLATE, system: str = QA_SYSTEM) -> DataFrame:
    """(id, report, split, source_id, messages): the stripped lines of the page around its table; empty parts read '(none)'."""
    user = fill(template, pre_text=joined_lines(F.col("pre_text")), table=table_lines(F.col("table_rows")), post_text=joined_lines(F.col("post_text")), question=F.col("question"))
    return items.select("id", "report", "split", "source_id", chat(system, user).alias("messages"))


def in_groups(items: DataFrame, group: str, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Items of the groups in only (all if empty) and in none of exclude. Null groups pass only when nothing is asked for."""
    out = items.filter(F.col(group).isin(only)) if only else items
    return out.filter(F.coalesce(~F.col(group).isin(exclude), F.lit(True))) if exclude else out


def without_groups_of(items: DataFrame, other: DataFrame, group: str) -> DataFrame:
    """Items whose group is none of another split's."""
    return items.join(other.select(group).dropna().distinct(), group, "left_anti")


def allowed(items: DataFrame, ids: DataFrame, limit: int | None = None, position: str = "id") -> DataFrame:
    """Items of an id list, the first limit of them in order of position."""
    kept = items.join(ids.select("id").distinct(), "id", "left_semi")
    return kept.orderBy(position).limit(limit) if limit is not None else kept


def prompt_sizes(prompts: DataFrame) -> DataFrame:
    """One row: prompts, the greatest and the mean number of characters of the user messages."""
    size = F.length(F.element_at("messages", -1).content)
    return prompts.agg(F.count(F.lit(1)).alias("prompts"), F.max(size).alias("chars_max"), F.round(F.avg(size), 1).alias("chars_mean"))


def schema_sizes(schemas: DataFrame) -> DataFrame:
    """(db_id, chars) of schema texts."""
    return schemas.groupBy("db_id").agg(F.max(F.length("schema_text")).alias("chars"))


def check_splits(splits: list[str], own: str, known: tuple[str, ...] = ("train", "dev", "test")) -> None:
    """Raise for split names that don't exist or are the split being written."""
    for s in splits:
        if s not in known:
            raise ValueError(f"unknown split {s!r}")
        if s == own:
            raise ValueError(f"{s!r} is the split being written")


def correction_prompts(failed: DataFrame, prompts: DataFrame, answers: DataFrame, template: str = "{original}\n\nYour answer was:\n{answer}\n\n{feedback}\n\nGive a corrected answer.") -> DataFrame:
    """(id, source_sample, student_response, messages) for failed samples; questions without a prompt or answer are skipped.

    answers: (id, sample, content, feedback).
    """
    joined = failed.select("id", "sample").join(prompts.select("id", "messages"), "id").join(answers.select("id", "sample", "content", "feedback"), ["id", "sample"])
    user = fill(template, original=F.element_at("messages", -1).content, answer=F.col("content"), feedback=F.coalesce("feedback", F.lit("The answer is wrong.")))
    head = F.slice("messages", 1, F.size("messages") - 1)
    return joined.select("id", F.col("sample").alias("source_sample"), F.col("content").alias("student_response"), F.concat(head, F.array(F.struct(F.lit("user").alias("role"), user.alias("content")))).alias("messages"))


def gold_leaks(corrections: DataFrame, gold: DataFrame) -> DataFrame:
    """(id) of correction prompts that show the gold answer outside the quoted answer."""
    joined = corrections.join(gold.select("id", F.trim("gold").alias("gold")), "id")
    last = F.replace(F.element_at("messages", -1).content, F.col("student_response"), F.lit(""))
    earlier = F.exists(F.slice("messages", 1, F.size("messages") - 1), lambda m: m.content.contains(F.col("gold")))
    return joined.filter((F.col("gold") != "") & (last.contains(F.col("gold")) | earlier)).select("id")
