"""Task plug-ins: what differs between kinds of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..functions import numbers, text
from ..operators import grading, prompts


@dataclass(frozen=True)
class Task:
    """Names and functions of a kind of question."""

    name: str
    group_key: str
    prediction_key: str
    eval_splits: tuple[str, ...]
    full_coverage: tuple[str, ...]
    extract: Callable[[Column], Column]
    normalize: Callable[[Column], Column]
    valid_group: Callable[[Column], Column]
    prompts: Callable[..., DataFrame]
    #: Grades answers against items, and the evaluators' controls: every gold against itself, and against another one.
    grade: Callable[..., DataFrame]
    gold_control: Callable[[DataFrame], DataFrame]
    shuffled_control: Callable[[DataFrame], DataFrame]


TASKS: dict[str, Task] = {}


def register(task: Task) -> Task:
    """Add a task; a name that is taken raises."""
    if task.name in TASKS:
        raise ValueError(f"task {task.name!r} is there already")
    TASKS[task.name] = task
    return task


def get_task(name: str) -> Task:
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}; there are {', '.join(sorted(TASKS))}")
    return TASKS[name]


register(Task("sql", "db_id", "pred_sql", ("dev", "test"), ("dev",), text.extract_sql, text.normalize_sql, text.valid_database, prompts.sql_prompts, grading.execute_grades, grading.executed_gold_control, grading.executed_shuffled_control))
register(Task("qa", "report", "pred_answer", ("dev", "test"), ("dev", "test"), numbers.extract_answer, numbers.answer_key, text.valid_report, prompts.qa_prompts, grading.numeric_grades, grading.gold_control, grading.numeric_shuffled_control))
