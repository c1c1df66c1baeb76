"""Selecting training data from graded answers: distinct answers, caps, exact sizes, mixed groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import answer_key
from ..functions.text import has_reasoning_markup, normalize_response, normalize_sql, strip_sample
from .metrics import is_correct, side_by_side


def generations_once(generations: DataFrame) -> DataFrame:
    """One row with choices for each id: the earliest. Failed rows are left out; different good rows of one id count as one."""
    good = generations.filter((F.size("choices") > 0) & F.col("id").isNotNull())
    keep = [c for c in generations.columns if c != "id"]
    return good.groupBy("id").agg(F.min_by(F.struct(*keep), F.coalesce("started_at", F.lit(0.0))).alias("r")).select("id", "r.*")


def repeated_generations(generations: DataFrame) -> DataFrame:
    """(id, rows) of ids with more than one row with choices, equal rows included: what a strict load refuses."""
    return generations.filter(F.size("choices") > 0).groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def choices(generations: DataFrame) -> DataFrame:
    """(id, sample, content, reasoning_content, finish_reason, served_model, n_choices): each choice with its position."""
    return generations.select("id", "served_model", F.size("choices").alias("n_choices"), F.posexplode("choices").alias("sample", "c")).select("id", "sample", "c.content", "c.reasoning_content", "c.finish_reason", "served_model", "n_choices")


def prediction_key() -> Column:
    """The normalised prediction: SQL text, or the answer with numbers to ten digits."""
    return F.when(F.col("pred_sql").isNotNull(), normalize_sql(F.col("pred_sql"))).otherwise(answer_key(F.col("pred_answer")))


def group_name() -> Column:
    return F.coalesce("db_id", "report")


def answered(graded: DataFrame, generations: DataFrame) -> DataFrame:
    """Correct rows joined to their choice, with flags of what drops them: outside, truncated, prefixed, markup."""
    right = graded.filter(is_correct()).select("id", "sample", prediction_key().alias("key"), group_name().alias("group_key"))
    joined = right.join(choices(generations), ["id", "sample"], "left")
    text = normalize_response(F.col("content"))
    return joined.withColumns(
        {
            "outside": F.col("n_choices").isNull(),
            "truncated": F.coalesce(F.col("finish_reason") == "length", F.lit(False)),
            "response": F.coalesce(text, F.lit("")),
            "prefixed": F.coalesce(text != F.col("content"), F.lit(False)),
            "markup": F.coalesce(has_reasoning_markup(text), F.lit(False)),
        }
    ).drop("content", "reasoning_content")


def usable() -> Column:
    return ~F.col("outside") & ~F.col("truncated") & ~F.col("markup")


def marked(rows: DataFrame, cap: int) -> DataFrame:
    """rows with first (lowest sample of the same answer), place (rank of the answer in its question) and status: kept, duplicate or over_cap.

    A repeat of a kept answer is a duplicate; anything of an answer beyond the cap is over the cap. Both windows are over one
    question's samples, a bounded number.
    """
    first = rows.withColumn("first", F.min("sample").over(Window.partitionBy("id", "key")))
    placed = first.withColumn("place", F.dense_rank().over(Window.partitionBy("id").orderBy("first")))
    status = F.when(F.col("place") > cap, "over_cap").when(F.col("sample") > F.col("first"), "duplicate").otherwise("kept")
    return placed.withColumn("status", status)


def candidates(graded: DataFrame, generations: DataFrame, cap: int = 2) -> DataFrame:
    """The distinct, capped correct answers: id, sample, group_key, served_model, response."""
    return marked(answered(graded, generations).filter(usable()), cap).filter("status = 'kept'").select("id", "sample", "group_key", "served_model", "response")


def selection_counts(graded: DataFrame, generations: DataFrame, cap: int = 2) -> DataFrame:
    """One row of counters along the drops, in the order in which they apply; one pass over the joined answers."""
    rows = answered(graded, generations).withColumn("usable", usable())
    # answers that are dropped before share no window with those that aren't
    status = marked(rows.withColumn("id", F.when(F.col("usable"), F.col("id")).otherwise(F.concat_ws(":", F.lit("-"), "id", "sample"))), cap)
    inside = ~F.col("outside")
    sound = inside & ~F.col("truncated")
    count = lambda condition, name: F.count_if(condition).alias(name)
    counts = status.agg(
        F.count(F.lit(1)).alias("correct_rows"),
        count(F.col("outside"), "outside_choices"),
        count(inside & F.col("truncated"), "dropped_truncated"),
        count(sound & F.col("prefixed"), "normalized_prefix"),
        count(sound & F.col("markup"), "dropped_markup"),
        *[count(F.col("usable") & (F.col("status") == s), n) for s, n in (("duplicate", "dropped_duplicate"), ("over_cap", "dropped_over_cap"), ("kept", "candidates"))],
    )
    return side_by_side(graded.agg(F.count(F.lit(1)).alias("graded_rows")), counts)


def seeded_key(seed: int, *keys: Column) -> Column:
    """A portable random order: md5 of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def exact_sample(rows: DataFrame, n: int, seed: int = 0, keys: tuple[str, ...] = ("id", "sample"), strict: bool = True) -> DataFrame:
    """Exactly n rows in a seeded order that doesn't depend on partitions. Fewer rows raise, or are all returned if not strict.

    The n smallest keys are found by a distributed top-n; n is the size of the sample, not of the table.
    """
    if strict and rows.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows are available")
    return rows.withColumn("_key", seeded_key(seed, *[F.col(k) for k in keys])).orderBy("_key", *keys).limit(n).drop("_key")


def per_group(rows: DataFrame) -> DataFrame:
    """(group_key, rows, questions) of selected rows."""
    return rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(strip_sample(F.col("id"))).alias("questions"))


def training_records(selected: DataFrame, prompts: DataFrame) -> DataFrame:
    """Training records of selected answers: id '<question>#s<k>', messages, response, group_key, sample, served_model. A question without a prompt raises."""
    missing = selected.join(prompts, "id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("selected answers without a prompt")
    joined = selected.join(prompts.select("id", "messages"), "id")
    return joined.select(F.concat(F.col("id"), F.lit("#s"), F.col("sample").cast("string")).alias("id"), "messages", "response", "group_key", "sample", "served_model")


def mixed_groups(graded: DataFrame, generations: DataFrame, samples: int = 4) -> DataFrame:
    """(id, members, reward_mean): questions with samples exactly 0..samples-1, as many choices, and after the drops two members at least with different rewards."""
    members = rollouts(graded, generations, samples)
    return members.groupBy("id").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("reward"), 9).alias("reward_mean"), F.min("reward").alias("low"), F.max("reward").alias("high")).filter("members >= 2 and low < high").select("id", "members", "reward_mean")


def rollouts(graded: DataFrame, generations: DataFrame, samples: int = 4) -> DataFrame:
    """(id, sample, reward, response) of the members of groups of the right size that are neither truncated nor hold reasoning markup."""
    rows = graded.select("id", "sample", is_correct().cast("double").alias("reward"))
    right = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("low"), F.max("sample").alias("high"), F.countDistinct("sample").alias("d")).filter(f"n = {samples} and low = 0 and high = {samples - 1} and d = {samples}").select("id")
    sized = rows.join(right, "id", "left_semi")
    made = choices(generations).filter(F.col("n_choices") == samples)
    text = normalize_response(F.coalesce("content", F.lit("")))
    joined = sized.join(made, ["id", "sample"]).withColumn("response", text)
    return joined.filter(~F.coalesce(F.col("finish_reason") == "length", F.lit(False)) & ~has_reasoning_markup(F.col("response"))).select("id", "sample", "reward", "response")


def group_counts(graded: DataFrame, generations: DataFrame, samples: int = 4) -> DataFrame:
    """One row: groups graded, groups of the right size with members, mixed groups, members of mixed groups, their mean reward."""
    total = graded.agg(F.countDistinct("id").alias("groups"))
    sized = rollouts(graded, generations, samples).agg(F.countDistinct("id").alias("groups_sized"))
    mixed = mixed_groups(graded, generations, samples).agg(F.count(F.lit(1)).alias("groups_mixed"), F.coalesce(F.sum("members"), F.lit(0)).alias("records"), F.round(F.sum(F.col("reward_mean") * F.col("members")) / F.sum("members"), 6).alias("reward_mean"))
    return side_by_side(total, sized, mixed)


def first_failed(graded: DataFrame) -> DataFrame:
    """(id, sample, error): the lowest wrong sample of each question; questions whose gold failed aren't to be corrected."""
    wrong = graded.filter(~is_correct() & (F.coalesce("error", F.lit("")) != "gold_failed"))
    return wrong.groupBy("id").agg(F.min(F.struct("sample", "error")).alias("f")).select("id", "f.sample", "f.error")


#: The error of an item that has no graded row, by kind of question.
ABSENT = {"sql": "no_sql", "qa": "no_answer"}


def covered(graded: DataFrame, items: DataFrame, splits: tuple[str, ...] = ("dev",)) -> DataFrame:
    """(id, sample, correct, error) with a wrong sample 0 for each item (id, split, kind) of the full-coverage splits that has no graded row."""
    error = F.when(F.col("kind") == "sql", ABSENT["sql"]).otherwise(ABSENT["qa"])
    absent = items.filter(F.col("split").isin(*splits) & F.col("id").isNotNull()).groupBy("id").agg(F.max("kind").alias("kind")).join(graded, "id", "left_anti")
    return graded.select("id", "sample", is_correct().alias("correct"), "error").unionByName(absent.select("id", F.lit(0).alias("sample"), F.lit(False).alias("correct"), error.alias("error")))


def to_do(items: DataFrame, generations: DataFrame) -> DataFrame:
    """(id) of items without a row with choices: what a resumed generation still has to do."""
    return items.select("id").filter("id is not null").distinct().join(generations.filter(F.size("choices") > 0), "id", "left_anti")
