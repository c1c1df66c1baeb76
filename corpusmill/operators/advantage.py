"""Group-relative advantages and policy loss terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_moments(rows: DataFrame, group: str = "group_id", reward: str = "reward") -> DataFrame:
    """(group, n, mean, std, low, high) of each group's rewards; population deviation. Partial sums are combined on the map side."""
    return rows.groupBy(group).agg(F.count(reward).alias("n"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.min(reward).alias("low"), F.max(reward).alias("high"))


def advantages(rows: DataFrame, norm: str = "std", group: str = "group_id", reward: str = "reward") -> DataFrame:
    """rows with their advantage: (reward - mean) / std of the group, or reward - mean. Groups of equal rewards are left out.

    A group is left out when its lowest reward is its highest, which doesn't depend on rounding. Null rewards are no members.
    """
    if norm not in ("std", "mean"):
        raise ValueError(f"unknown norm {norm!r}")
    moments = group_moments(rows, group, reward).filter("low < high").select(F.col(group).alias("_g"), "mean", "std")
    joined = rows.filter(F.col(reward).isNotNull()).join(moments, F.col(group) == F.col("_g"))
    value = F.col(reward) - F.col("mean")
    return joined.withColumn("advantage", value / F.col("std") if norm == "std" else value).drop("_g", "mean", "std")


def equal_groups(rows: DataFrame, group: str = "group_id", reward: str = "reward") -> DataFrame:
    """(group) of the groups of equal rewards, which train nothing."""
    return group_moments(rows, group, reward).filter("low = high").select(group)


def advantage_stats(rows: DataFrame, norm: str = "std", group: str = "group_id", reward: str = "reward") -> DataFrame:
    """One row: samples, groups, groups of equal rewards, reward mean and deviation, and the advantages' count, mean, deviation, least and greatest.

    All of it follows from one grouping: the advantages of a group sum to 0 (up to rounding), their squares to n or to n times the variance.
    """
    if norm not in ("std", "mean"):
        raise ValueError(f"unknown norm {norm!r}")
    moments = rows.groupBy(group).agg(F.count(reward).alias("n"), F.sum(reward).alias("s"), F.sum(F.col(reward) * F.col(reward)).alias("q"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.min(reward).alias("low"), F.max(reward).alias("high"))
    used = F.col("low") < F.col("high")
    scale = F.col("std") if norm == "std" else F.lit(1.0)
    n, squares = F.sum(F.when(used, F.col("n"))), F.sum(F.when(used, F.col("n") * F.pow(F.col("std") / scale, 2)))
    total, mean = F.sum("n"), F.sum("s") / F.sum("n")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return moments.agg(
        F.coalesce(total, F.lit(0)).alias("samples"),
        r6(mean, "reward_mean"),
        r6(F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / total - mean * mean)), "reward_std"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("low") == F.col("high")).alias("groups_equal"),
        F.coalesce(n, F.lit(0)).alias("used"),
        F.when(n > 0, F.lit(0.0)).alias("adv_mean"),
        r6(F.sqrt(squares / n), "adv_std"),
        r6(F.min(F.when(used, (F.col("low") - F.col("mean")) / scale)), "adv_min"),
        r6(F.max(F.when(used, (F.col("high") - F.col("mean")) / scale)), "adv_max"),
    )


def group_sizes(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """(size, groups)."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def policy_terms(logp: Column, old: Column, ref: Column, adv: Column, epsilon: float = 0.2, beta: float = 0.04, kl_clamp: float = 10.0, dual_clip: float = 3.0, weight: Column | None = None) -> dict[str, Column]:
    """Terms of the clipped policy loss of a token: ratio, policy, kl_raw, kl, loss, clipped, kl_clamped.

    With weight, a token of no weight has log ratios of 0 and no loss, whatever its log-probabilities, so that an overflow on it can't
    reach a sum.

    The policy term takes the worse of the plain and the clipped ratio; for a negative advantage it is at most -adv x dual_clip.
    kl is exp(d) - d - 1 with d = ref - logp, at most kl_clamp. A bound of 0 or less is off.
    """
    on = F.lit(True) if weight is None else F.coalesce(weight > 0, F.lit(False))
    ratio = F.exp(F.when(on, logp - old).otherwise(F.lit(0.0)))
    policy = -F.least(ratio * adv, F.greatest(F.lit(1 - epsilon), F.least(F.lit(1 + epsilon), ratio)) * adv)
    if dual_clip > 0:
        policy = F.when(adv < 0, F.least(policy, -adv * dual_clip)).otherwise(policy)
    d = F.when(on, ref - logp).otherwise(F.lit(0.0))
    kl_raw = F.exp(d) - d - 1
    kl = F.least(kl_raw, F.lit(kl_clamp)) if kl_clamp > 0 else kl_raw
    clipped = ((adv > 0) & (ratio > 1 + epsilon)) | ((adv < 0) & (ratio < 1 - epsilon))
    return {"ratio": ratio, "policy": policy, "kl_raw": kl_raw, "kl": kl, "loss": F.when(on, policy + kl * beta).otherwise(F.lit(0.0)), "clipped": clipped & on, "kl_clamped": kl_raw > kl}


def weighted_metrics(rows: DataFrame, by: list[str], weight: str, columns: list[str]) -> DataFrame:
    """Means of columns by token weight within by, over the tokens that have one; a group of no weight gives nulls."""
    w = F.sum(weight)
    each = lambda c: F.when(F.col(weight) != 0, F.col(c) * F.col(weight))
    return rows.groupBy(*by).agg(w.alias("weight"), *[F.when(w != 0, F.sum(each(c)) / w).alias(c) for c in columns])


def negative_log_likelihood(target_logit: Column, log_sum: Column, weight: Column) -> Column:
    """Weighted loss of a token from its logit and the logits' log-sum-exp."""
    return weight * (log_sum - target_logit)


def token_stats(logits: Column, target: Column) -> tuple[Column, Column]:
    """(log-probability of the target position, counted from 0, entropy) of an array of logits; stable for large logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    log_sum = F.log(total) + top
    mean = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - log_sum) * x)
    return F.get(logits, target) - log_sum, log_sum - mean


def divergence(p_logs: Column, q_logs: Column) -> Column:
    """KL of two log-probability arrays over the same ids plus a bin for the rest; the bin counts only when both have a rest."""
    p_rest = F.lit(1.0) - F.aggregate(p_logs, F.lit(0.0), lambda a, x: a + F.exp(x))
    q_rest = F.lit(1.0) - F.aggregate(q_logs, F.lit(0.0), lambda a, x: a + F.exp(x))
    inner = F.aggregate(F.zip_with(p_logs, q_logs, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda a, x: a + x)
    return inner + F.when((p_rest > 0) & (q_rest > 0), p_rest * (F.log(p_rest) - F.log(q_rest))).otherwise(0.0)


def parity(positions: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of two models per group: positions, top-1 agreement, mean and greatest KL, greatest difference of log-probabilities.

    positions: top_a, top_b (ids), p_logs, q_logs (arrays over the same ids), logp_a, logp_b (of the token).
    """
    kl = divergence(F.col("p_logs"), F.col("q_logs"))
    gap = F.array_max(F.zip_with("p_logs", "q_logs", lambda p, q: F.abs(p - q)))
    return positions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("positions"),
        F.avg((F.col("top_a") == F.col("top_b")).cast("int")).alias("top1_agreement"),
        F.avg(kl).alias("mean_kl"),
        F.max(kl).alias("max_kl"),
        F.max(F.abs(F.col("logp_a") - F.col("logp_b"))).alias("max_token_gap"),
        F.max(gap).alias("max_topk_gap"),
    )


def top_ranked(logs: Column, k: int) -> Column:
    """The k greatest log-probabilities of a map id -> log-probability as an array of (logp, id), ties by the smaller id."""
    entries = F.transform(F.map_entries(logs), lambda e: F.struct((-e.value).alias("neg"), e.key.alias("id")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct((-e.neg).alias("logp"), e.id.alias("id")))
