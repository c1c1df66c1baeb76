"""Whole flows: grade, select training data, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounting, audit, grading, metrics, selection
from ..sources.writers import write_jsonl, write_manifest, write_report
from ..tasks.registry import Task


def graded_answers(generations: DataFrame, task: Task) -> DataFrame:
    """(id, sample, prediction): the answer of each choice."""
    each = selection.choices(selection.generations_once(generations))
    return each.select("id", "sample", task.extract(F.col("content")).alias(task.prediction_key))


def grade_numeric(generations: DataFrame, items: DataFrame, task: Task) -> DataFrame:
    """Graded rows of numeric answers, with a wrong row for each item of a full-coverage split that has no answer."""
    rows = grading.numeric_grades(graded_answers(generations, task).withColumnRenamed(task.prediction_key, "pred_answer"), items)
    return selection.covered(rows, items.withColumn("kind", F.lit(task.name)), task.full_coverage)


def grade_report(graded: DataFrame, items: DataFrame, path: str, arguments: dict[str, object] | None = None) -> dict:
    """Accuracy, by difficulty where the items have one, pass at k and kinds of failures of graded rows as a JSON and a markdown file."""
    rows = metrics.once(graded.filter("id is not null and sample is not null"))
    sections = {"summary": metrics.summary(rows), "pass_at_k": metrics.pass_at_k(rows), "failures": metrics.failures(rows)}
    if "difficulty" in items.columns:
        sections["difficulty"] = metrics.by_group(rows, items, "difficulty")
    return write_report(path, sections, arguments)


def compute_report(runs: DataFrame, path: str, windows: DataFrame | None = None, arguments: dict[str, object] | None = None) -> dict:
    """Operations and hours by role and device of runs (accounting.run_operations), and the up-time of windows, as a JSON and a markdown file."""
    sections = {"roles": accounting.role_totals(runs)}
    if windows is not None:
        sections["up_time"] = accounting.uptime_total(windows)
    return write_report(path, sections, arguments)


def check_prompts(prompts: DataFrame, forbidden: list[str], group: str) -> None:
    """Raise unless all prompts are unique train prompts of groups that aren't forbidden and end with a user message. An empty forbid list raises too."""
    if not forbidden:
        raise ValueError("the list of forbidden groups is empty")
    last = F.try_element_at("messages", F.lit(-1)).role
    broken = prompts.agg(
        F.count_if(~F.coalesce(F.col("id").startswith("train-"), F.lit(False))).alias("ids that don't start with train-"),
        F.count_if(F.coalesce(F.col("split"), F.lit("train")) != "train").alias("prompts of another split"),
        F.count_if(F.col(group).isNull()).alias("prompts without a group"),
        F.count_if(F.col(group).isin(forbidden)).alias("prompts of forbidden groups"),
        F.count_if(F.coalesce(last != "user", F.lit(True))).alias("prompts that don't end with a user message"),
        (F.count(F.lit(1)) - F.countDistinct("id")).alias("repeated prompts"),
    ).first().asDict()
    found = [f"{n} {what}" for what, n in broken.items() if n]
    if found:
        raise ValueError("; ".join(found))


def check_graded(graded: DataFrame, prompts: DataFrame, generations: DataFrame) -> None:
    """Raise when correct rows repeat, have no prompt or generation, or point outside the choices."""
    right = graded.filter(metrics.is_correct())
    repeated = right.groupBy("id", "sample").count().filter("count > 1").limit(1).count()
    if repeated:
        raise ValueError("graded rows repeat a sample")
    if right.join(prompts, "id", "left_anti").limit(1).count():
        raise ValueError("graded ids without a prompt")
    sizes = generations.filter(F.size("choices") > 0).groupBy("id").agg(F.max(F.size("choices")).alias("n"))
    outside = right.join(sizes, "id", "left").filter(F.col("n").isNull() | (F.col("sample") < 0) | (F.col("sample") >= F.col("n"))).limit(1).count()
    if outside:
        raise ValueError("graded samples without a generated choice")


def check_predictions(graded: DataFrame, generations: DataFrame, task: Task) -> None:
    """Raise when a graded prediction isn't the answer that the choice gives now."""
    again = graded_answers(generations, task).select("id", "sample", F.col(task.prediction_key).alias("again"))
    differ = graded.filter(metrics.is_correct()).join(again, ["id", "sample"]).filter(~F.col(task.prediction_key).eqNullSafe(F.col("again"))).limit(1).count()
    if differ:
        raise ValueError("graded predictions differ from the generated answers")


def check_inputs(graded: DataFrame, generations: DataFrame, prompts: DataFrame, task: Task, forbidden: list[str]) -> None:
    """All checks of a selection's inputs; the first that fails raises. forbidden: the groups of the evaluation splits."""
    check_prompts(prompts, forbidden, task.group_key)
    if selection.repeated_generations(generations).limit(1).count():
        raise ValueError("ids with more than one generation")
    check_graded(graded, prompts, generations)
    check_predictions(graded, generations, task)


def build_supervised(graded: DataFrame, generations: DataFrame, prompts: DataFrame, *, task: Task, forbidden: list[str], cap: int | None = 2, n: int | None = None, seed: int = 0, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, counts): distinct capped correct answers, exactly n of them if given, with their prompts. Broken inputs raise (check_inputs).

    exclude: groups whose answers are left out; counts has how many right answers that dropped and how many records are written.
    """
    check_inputs(graded, generations, prompts, task, forbidden)
    most = cap if cap is not None else 1 << 30
    dropped = F.coalesce(selection.group_name().isin(exclude), F.lit(False)) if exclude else F.lit(False)
    rows = graded.filter(~dropped)
    chosen = selection.candidates(rows, generations, most)
    if n is not None:
        chosen = selection.exact_sample(chosen, n, seed)
    excluded = graded.filter(dropped & metrics.is_correct()).agg(F.count(F.lit(1)).alias("dropped_excluded"))
    counts = metrics.side_by_side(selection.selection_counts(rows, generations, most), excluded, chosen.agg(F.count(F.lit(1)).alias("written")))
    return selection.training_records(chosen, prompts), counts


def build_rollouts(graded: DataFrame, generations: DataFrame, prompts: DataFrame, *, task: Task, forbidden: list[str], samples: int, groups: int | None = None, seed: int = 0) -> DataFrame:
    """(id, messages, response, group_id, reward) of mixed groups, of a seeded number of them if given. Broken inputs raise (check_inputs)."""
    check_inputs(graded, generations, prompts, task, forbidden)
    mixed = selection.mixed_groups(graded, generations, samples).select("id")
    if groups is not None:
        mixed = selection.exact_sample(mixed, groups, seed, keys=("id",), strict=False)
    members = selection.rollouts(graded, generations, samples).join(mixed, "id", "left_semi")
    joined = members.join(prompts.select("id", "messages"), "id")
    return joined.select(F.concat("id", F.lit("#s"), F.col("sample").cast("string")).alias("id"), "messages", "response", F.col("id").alias("group_id"), "reward")


def audit_records(records: DataFrame, items: DataFrame, out: str | None = None, databases: DataFrame | None = None) -> tuple[dict, bool]:
    """(report, clean): counts and first examples of each audit rule; with out they are written as JSON lines and a manifest."""
    flags = audit.record_flags(records, items, databases=databases).persist()
    counts = audit.rule_counts(flags)
    report = counts.first().asDict()
    examples = audit.rule_examples(flags)
    report["examples"] = {r["rule"]: r["ids"] for r in examples.groupBy("rule").agg(F.array_sort(F.collect_list("id")).alias("ids")).collect()}  # five ids a rule
    if out is not None:
        write_jsonl(examples, f"{out}/examples", ["rule", "id"])
        write_manifest(f"{out}/audit.json", counts, {})
    flags.unpersist()
    return report, not any(report[r] for r in audit.RULES)
