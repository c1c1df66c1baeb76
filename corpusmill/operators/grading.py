"""Grading: result sets, executed queries, numeric answers, and the evaluators' controls."""

from __future__ import annotations

import contextlib
import sqlite3
import textwrap
import time
import urllib.parse
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import answer_key, extract_answer, format_gold, score
from .ranking import grouped_rank

MAX_ROWS = 200_000
ERROR_CHARS = 300


def cell_key(c: Column, kind: str) -> Column:
    """One text for equal cells: numbers alike (1 is 1.0), text apart from numbers, null equal to null."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        number = c.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        text = F.concat(F.lit("#"), F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string")))
    elif kind == "boolean":
        text = F.concat(F.lit("#"), c.cast("int").cast("string"))
    else:
        text = F.concat(F.lit("s"), c.cast("string"))
    return F.coalesce(text, F.lit("n"))


def row_keys(df: DataFrame) -> DataFrame:
    """(k): the distinct rows of a result as one text each, by position of the columns. Names don't matter."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    parts = F.array(*[cell_key(F.col(c), kind) for c, kind in named.dtypes]) if named.columns else F.array().cast("array<string>")
    return named.select(F.to_json(parts).alias("k")).distinct()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same set of rows; order, repeats and column names don't matter."""
    if len(a.columns) != len(b.columns):
        return not a.limit(1).count() and not b.limit(1).count()
    return not difference(a, b).limit(1).count()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, in_a, in_b): rows that only one of two results has."""
    both = row_keys(a).withColumn("in_a", F.lit(1)).unionByName(row_keys(b).withColumn("in_b", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("k").agg(F.coalesce(F.max("in_a"), F.lit(0)).alias("in_a"), F.coalesce(F.max("in_b"), F.lit(0)).alias("in_b")).filter("in_a <> in_b")


@dataclass
class Outcome:
    """What a query gave: its columns, the set of its rows, how many there were and the first few of them; or what went wrong."""

    columns: tuple[str, ...] = ()
    rows: frozenset[tuple] = frozenset()
    count: int = 0
    head: tuple[tuple, ...] = ()
    error: str = ""


class SqliteRunner:
    """Runs queries on database files for one task. Connections are read-only and kept by file, most_open at most; rows go into a set as they come."""

    def __init__(self, timeout_s: float = 30.0, max_rows: int = MAX_ROWS, most_open: int = 8, shown: int = 5) -> None:
        self.timeout_s, self.max_rows, self.most_open, self.shown = timeout_s, max_rows, most_open, shown
        self._open: OrderedDict[str, sqlite3.Connection] = OrderedDict()
        self._until = 0.0

    def connection(self, path: str) -> sqlite3.Connection:
        if path in self._open:
            self._open.move_to_end(path)
            return self._open[path]
        while len(self._open) >= self.most_open:
            self._open.popitem(last=False)[1].close()
        made = sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True)
        made.text_factory = partial(str, encoding="utf-8", errors="replace")
        made.set_progress_handler(lambda: time.monotonic() > self._until, 10_000)
        self._open[path] = made
        return made

    def close(self) -> None:
        for connection in self._open.values():
            connection.close()
        self._open.clear()

    def run(self, path: str | None, sql: str) -> Outcome:
        """The outcome of a query; errors have their kind before the first colon."""
        if not path:
            return Outcome(error="no database")
        self._until = time.monotonic() + self.timeout_s
        found: set[tuple] = set()
        head: list[tuple] = []
        count = 0
        try:
            with contextlib.closing(self.connection(path).execute(sql)) as cursor:
                columns = tuple(c[0] for c in cursor.description or ())
                for row in cursor:
                    count += 1
                    if count > self.max_rows:
                        return Outcome(error=f"more than {self.max_rows} rows")
                    found.add(row)
                    if count <= self.shown:
                        head.append(row)
        except Exception as e:
            if not isinstance(e, (sqlite3.Error, sqlite3.Warning, OverflowError, ValueError, MemoryError)):
                raise
            late = isinstance(e, sqlite3.OperationalError) and time.monotonic() > self._until
            return Outcome(error=f"timeout after {self.timeout_s}s" if late else f"{type(e).__name__}: {e}"[:ERROR_CHARS])
        return Outcome(columns, frozenset(found), count, tuple(head))

    def report(self, path: str | None, sql: str | None, cell_chars: int = 60) -> str:
        """What a query did, as a sentence for a correction prompt, with its first rows."""
        if not sql:
            return "There was no query in the answer."
        got = self.run(path, sql)
        if got.error.startswith("timeout"):
            return f"The query was stopped after {self.timeout_s:g} seconds."
        if got.error.startswith("more than"):
            return f"The query gave {got.error}."
        if got.error:
            return f"The query is wrong. SQLite says: {got.error}"
        if not got.count:
            return "The query ran and gave nothing."
        text = lambda value: "NULL" if value is None else " ".join(str(value).splitlines())
        short = lambda value: textwrap.shorten(text(value), cell_chars, placeholder="...") if len(text(value)) > cell_chars else text(value)
        table = pd.DataFrame([[short(v) for v in row] for row in got.head], columns=list(got.columns)).to_csv(sep="\t", index=False).strip("\n")
        return f"The query ran. Rows: {got.count}; the first {len(got.head)}:\n{table}"


def execute_grades(rows: DataFrame, timeout_s: float = 30.0, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, sample, correct, error, gold_error): each answer's rows against the gold's rows on its database, as sets.

    rows: id, sample, path (of the database file), gold_sql, pred_sql. The samples of a question come one after the other in one task, so its
    gold runs once, and questions of a database follow each other, so its file stays open. A failed gold marks all of its question's
    answers gold_failed; an answer without a query is no_sql. A database of any number of questions is spread over the tasks.
    """

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = SqliteRunner(timeout_s, max_rows)
        gold_of, gold = None, Outcome()
        try:
            for batch in batches:
                out = []
                for rid, sample, path, gold_sql, sql in batch.itertuples(index=False, name=None):
                    if gold_of != (rid, path, gold_sql):
                        gold_of, gold = (rid, path, gold_sql), runner.run(path, gold_sql or "")
                    if gold.error or not gold.columns:
                        out.append((rid, sample, False, "gold_failed", gold.error or "no query"))
                    elif not sql:
                        out.append((rid, sample, False, "no_sql", None))
                    else:
                        got = runner.run(path, sql)
                        out.append((rid, sample, not got.error and got.rows == gold.rows, got.error, None))
                yield pd.DataFrame(out, columns=["id", "sample", "correct", "error", "gold_error"])
        finally:
            runner.close()

    placed = rows.select("id", "sample", "path", "gold_sql", "pred_sql").repartition("id").sortWithinPartitions("path", "id", "sample")
    return placed.mapInPandas(grade, "id string, sample int, correct boolean, error string, gold_error string")


def numeric_grades(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(id, sample, pred_answer, correct, error) of answers (id, sample, pred_answer) against items (id, gold_num, gold_text). Answers of unknown items are left out."""
    gold = items.filter("id is not null").groupBy("id").agg(F.max("gold_num").alias("gold_num"), F.max("gold_text").alias("gold_text"))
    joined = answers.join(gold, "id")
    return joined.select("id", "sample", "pred_answer", score(F.col("pred_answer"), F.col("gold_num"), F.col("gold_text")).alias("s")).select("id", "sample", "pred_answer", "s.correct", "s.error")


def gold_response(number: Column, text: Column) -> Column:
    """A gold answer as a response would give it."""
    return F.concat(F.lit("Both values are on the page.\nAnswer: "), F.coalesce(text, format_gold(number)))


def _golds(items: DataFrame, *more: str) -> DataFrame:
    """(id, gold_num, gold_text, more, response): each item's gold and the response that gives it."""
    own = items.filter("id is not null").groupBy("id").agg(F.max("gold_num").alias("gold_num"), F.max("gold_text").alias("gold_text"), *[F.max(c).alias(c) for c in more])
    return own.withColumn("response", F.coalesce(gold_response(F.col("gold_num"), F.col("gold_text")), F.lit("")))


def gold_control(items: DataFrame) -> DataFrame:
    """(id, correct, error): every gold answer written as a response, read from it again and graded against itself; all must be right."""
    read = _golds(items).select("id", "gold_num", "gold_text", extract_answer(F.col("response")).alias("answer"))  # a column of its own keeps the generated code small
    return read.select("id", score(F.col("answer"), F.col("gold_num"), F.col("gold_text")).alias("s")).select("id", "s.correct", "s.error")


def numeric_shuffled_control(items: DataFrame) -> DataFrame:
    """(id, split, gold, other, correct): each item of a split graded with another gold answer of the split that differs when normalised.

    gold and other are normalised answers; few may come out right (numbers within the tolerance or off by 100).
    """
    read = _golds(items, "split").select("id", "split", "gold_num", "gold_text", answer_key(extract_answer(F.col("response"))).alias("gold"))
    others = shuffled_control(read, "split", "gold").select(F.col("id").alias("o_id"), "other")
    joined = read.join(others, F.col("id") == F.col("o_id"))
    return joined.select("id", "split", "gold", "other", score(F.col("other"), F.col("gold_num"), F.col("gold_text")).correct.alias("correct"))


def shuffled_control(items: DataFrame, group: str, gold: str) -> DataFrame:
    """(id, gold, other): for each item another gold answer of its group. Items whose group has one gold only are left out.

    The distinct golds of a group are ranked by md5; each gets the next one, the last the first. That is a join on (group, rank),
    so no pairs are listed and a group may be of any size.
    """
    # the gold's text is the key of the ranking, so equal golds share a rank
    named = items.filter(F.col(gold).isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.min(F.coalesce(F.col(group), F.lit(""))).alias("g"), F.min(F.trim(gold)).alias("gold"))
    golds = grouped_rank(named.select("g", "gold").distinct(), ["g"], F.col("gold"))
    sizes = golds.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    following = golds.join(sizes, "g").select("g", "gold", ((F.col("rank") + 1) % F.col("n")).alias("next"))
    other = golds.select("g", F.col("rank").alias("next"), F.col("gold").alias("other"))
    return named.join(following.join(other, ["g", "next"]).select("g", "gold", "other"), ["g", "gold"]).select("id", "gold", "other")


def executed_gold_control(items: DataFrame) -> DataFrame:
    """(id, correct, error) of items (id, path, gold_sql): every gold query against itself on its database; all must be right."""
    own = items.filter("id is not null").groupBy("id").agg(F.min(F.struct("path", "gold_sql")).alias("g")).select("id", F.lit(0).alias("sample"), "g.path", "g.gold_sql", F.col("g.gold_sql").alias("pred_sql"))
    return execute_grades(own).select("id", "correct", "error")


def executed_shuffled_control(items: DataFrame) -> DataFrame:
    """(id, gold, other, correct) of items (id, db_id, path, gold_sql): each graded with another gold query of its database by execution; few may be right."""
    control = shuffled_control(items, "db_id", "gold_sql")
    paths = items.filter("id is not null").groupBy("id").agg(F.min("path").alias("path"))
    grades = execute_grades(control.join(paths, "id").select("id", F.lit(0).alias("sample"), "path", F.col("gold").alias("gold_sql"), F.col("other").alias("pred_sql")))
    return control.join(grades.select("id", "correct"), "id")


def control_rate(control: DataFrame) -> DataFrame:
    """One row: items of a graded control and how many were right."""
    return control.agg(F.count(F.lit(1)).alias("items"), F.count_if("correct").alias("passed"))


def rewards(graded: DataFrame) -> DataFrame:
    """(id, sample, reward): 1 for a right answer, else 0."""
    return graded.select("id", "sample", F.col("correct").eqNullSafe(F.lit(True)).cast("double").alias("reward"))


def feedback_batches(rows: DataFrame, timeout_s: float = 30.0) -> DataFrame:
    """(id, sample, feedback) of answers (id, sample, path, pred_sql): what each query did when run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = SqliteRunner(timeout_s)
        try:
            for batch in batches:
                yield pd.DataFrame({"id": batch["id"], "sample": batch["sample"], "feedback": [runner.report(p, q) for p, q in zip(batch["path"], batch["pred_sql"], strict=True)]})
        finally:
            runner.close()

    return rows.select("id", "sample", "path", "pred_sql").mapInPandas(run, "id string, sample int, feedback string")
