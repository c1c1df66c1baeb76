"""Accuracy, pass@k, paired comparison and quantiles over graded answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import failure_kind


def once(graded: DataFrame, order: str = "row_id") -> DataFrame:
    """One row for each (id, sample): the first by order. A grouped minimum, so copies are dropped on the map side."""
    keep = [c for c in graded.columns if c not in ("id", "sample")]
    first = graded.groupBy("id", "sample").agg(F.min_by(F.struct(*keep), order).alias("r"))
    return first.select("id", "sample", "r.*")


def is_correct(c: Column | str = "correct") -> Column:
    """Strictly true: null counts as wrong."""
    return (F.col(c) if isinstance(c, str) else c).eqNullSafe(F.lit(True))


def per_question(graded: DataFrame) -> DataFrame:
    """(id, n, n_correct, first_correct, first_error): sums of each question, and its lowest sample (a wrong one wins a tie)."""
    right = is_correct().cast("int")
    first = F.min(F.struct(F.col("sample"), right.alias("ok"), F.col("error")))
    return graded.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_correct"), first.alias("f")).select("id", "n", "n_correct", (F.col("f.ok") == 1).alias("first_correct"), F.col("f.error").alias("first_error"))


def summary(graded: DataFrame) -> DataFrame:
    """One row: questions, rows, accuracy of the first samples, and the mean over questions of their mean, in percent. No rows give zero counts and nulls."""
    q = per_question(graded)
    return q.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.bround(F.avg(F.col("first_correct").cast("int")) * 100, 6).alias("accuracy_first"), F.bround(F.avg(F.col("n_correct") / F.col("n")) * 100, 6).alias("accuracy_mean"))


def by_group(graded: DataFrame, items: DataFrame, column: str, unnamed: str = "all") -> DataFrame:
    """(column, questions, accuracy_first): null and empty groups, and questions without an item, count as unnamed."""
    groups = items.groupBy("id").agg(F.max(column).alias("g"))
    q = per_question(graded).join(groups, "id", "left")
    return q.groupBy(F.coalesce(F.nullif(F.col("g"), F.lit("")), F.lit(unnamed)).alias(column)).agg(F.count(F.lit(1)).alias("questions"), F.bround(F.avg(F.col("first_correct").cast("int")) * 100, 6).alias("accuracy_first"))


def failures(graded: DataFrame) -> DataFrame:
    """(kind, questions): why first samples are wrong; no error text means wrong_result."""
    wrong = per_question(graded).filter(~F.col("first_correct"))
    kind = F.coalesce(F.nullif(failure_kind(F.col("first_error")), F.lit("")), F.lit("wrong_result"))
    return wrong.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("questions"))


def pass_at_k(graded: DataFrame) -> DataFrame:
    """One row: questions, pass@1 (mean over questions), pass@k of all samples, and the shares of mixed, all right and all wrong questions, in percent."""
    q = per_question(graded)
    share = lambda condition, name: F.bround(F.avg(condition.cast("int")) * 100, 6).alias(name)
    n, c = F.col("n"), F.col("n_correct")
    return q.agg(F.count(F.lit(1)).alias("questions"), F.bround(F.avg(c / n) * 100, 6).alias("pass_1"), share(c > 0, "pass_k"), share((c > 0) & (c < n), "mixed"), share(c == n, "all_correct"), share(c == 0, "all_wrong"), F.array_sort(F.collect_set("n")).alias("sample_counts"))


def scores(graded: DataFrame, mean: bool = False) -> DataFrame:
    """(id, score) of one arm: of the first sample, or the mean of all samples."""
    q = per_question(graded)
    return q.select("id", (F.col("n_correct") / F.col("n") if mean else F.col("first_correct").cast("double")).alias("score"))


def paired(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """(id, score_a, score_b, diff) of two arms. strict: questions that only one arm has raise, else they are left out."""
    both = a.select("id", F.col("score").alias("score_a")).join(b.select("id", F.col("score").alias("score_b")), "id", "full")
    if strict:
        missing = both.agg(F.count_if(F.col("score_a").isNull()).alias("a"), F.count_if(F.col("score_b").isNull()).alias("b")).first()
        if missing["a"] or missing["b"]:
            raise ValueError(f"the arms don't have the same questions: {missing['a']} are missing in the first, {missing['b']} in the second")
    return both.dropna().withColumn("diff", F.col("score_a") - F.col("score_b"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """One row: questions, both accuracies, their difference in points, wins and losses."""
    return pairs.agg(
        F.count(F.lit(1)).alias("questions"),
        F.bround(F.avg("score_a") * 100, 6).alias("accuracy_a"),
        F.bround(F.avg("score_b") * 100, 6).alias("accuracy_b"),
        F.bround(F.avg("diff") * 100, 6).alias("delta"),
        F.count_if(F.col("diff") > 0).alias("wins"),
        F.count_if(F.col("diff") < 0).alias("losses"),
    )


def bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 0, most_values: int = 100_000) -> DataFrame:
    """One row (questions, low, high): the 95 % interval of the mean difference over resamples of the questions, in points.

    Only the histogram of the differences goes to the driver: a difference of two shares of a few samples takes few values,
    and resampling questions is drawing multinomial counts of those values. More than most_values values raise.
    """
    rows = pairs.groupBy("diff").count().limit(most_values + 1).collect()
    if len(rows) > most_values:
        raise ValueError(f"the differences take more than {most_values} values")
    rows.sort(key=lambda r: r[0])
    values, counts = np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows], dtype=np.int64)
    n = int(counts.sum())
    low = high = None
    if n:
        draws = np.random.default_rng(seed).multinomial(n, counts / n, size=resamples)
        means = np.sort(draws @ values / n)
        low, high = float(means[int(0.025 * resamples)] * 100), float(means[int(0.975 * resamples) - 1] * 100)
    return pairs.sparkSession.createDataFrame([(n, low, high)], "questions bigint, low double, high double")


def nearest_rank(df: DataFrame, group: list[str], value: str, quantiles: list[float], buckets: int = 1024) -> DataFrame:
    """(group, quantile, value): sorted[round_half_even(q (n-1))] of each group, exactly.

    The values' range is cut into buckets that are counted; only the rows of the buckets that hold a wanted rank are sorted,
    so no task sorts a whole group. Null values and NaN are left out; groups without values give no rows. Values of one
    bucket that are equal are counted, not sorted: a group of a single value is one row.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    span = rows.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    named = span.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_lo", "_hi", "_n")
    placed = rows.join(named, _all(on)).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets))).otherwise(0).cast("int"))
    sizes = placed.groupBy(*group, "_b").agg(F.sum("_c").alias("_k"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("quantile", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    wanted = wanted.withColumn("_rank", F.bround(F.col("quantile") * (F.col("_n") - 1), 0).cast("bigint")).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_k")))
    targets = wanted.select(*[F.col(g).alias(f"_h_{g}") for g in group], F.col("_b").alias("_hb"), "quantile", (F.col("_rank") - F.col("_before")).alias("_at"))
    inside = Window.partitionBy(*group, "_b", "quantile").orderBy(value)
    candidates = placed.join(targets, _all([F.col(g).eqNullSafe(F.col(f"_h_{g}")) for g in group] + [F.col("_b") == F.col("_hb")]))
    upto = candidates.withColumn("_cum", F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return upto.filter((F.col("_cum") > F.col("_at")) & (F.col("_cum") - F.col("_c") <= F.col("_at"))).select(*group, "quantile", value)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row results with different columns as one row, without a cross join: their union, then the greatest value of each column."""
    names = [c for r in rows for c in r.columns]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in names])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
