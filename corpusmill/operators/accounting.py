"""Up-time, serving levels, token totals and operation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models
from .metrics import nearest_rank

INTERVAL_S = 300


def uptime_windows(pings: DataFrame, group: list[str] | None = None, interval_s: int = INTERVAL_S, slice_s: int = 86_400) -> DataFrame:
    """(group, started, ended, pings, seconds): runs of good pings with gaps of at most two intervals; a failed ping ends a run.

    Each run counts its span and one interval. pings: ts (timestamp) and ok. Equal times put failed pings first; null times are
    left out. Time is cut into slices that tasks handle on their own; the runs at the slices' edges are joined through one
    summary row a slice, so a long series of one group isn't sorted in one task.
    """
    keys = group or []
    rows = pings.filter(F.col("ts").isNotNull()).select(*keys, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.coalesce("ok", F.lit(False)).alias("ok"))
    rows = rows.withColumn("slice", F.floor(F.col("t") / (slice_s * 1_000_000)))
    limit = 2 * interval_s * 1_000_000
    # the last ping of the slices before, one row a slice
    ends = rows.groupBy(*keys, "slice").agg(F.max(F.struct("t", "ok")).alias("last"))
    edge = ends.withColumn("prev", F.lag("last").over(Window.partitionBy(*keys).orderBy("slice"))).select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("slice").alias("e_slice"), "prev")
    on = F.col("slice") == F.col("e_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    inside = Window.partitionBy(*keys, "slice").orderBy("t", "ok")
    led = rows.withColumn("before", F.lag(F.struct("t", "ok")).over(inside)).join(edge, on).withColumn("before", F.coalesce("before", "prev")).drop("e_slice", "prev", *[f"e_{k}" for k in keys])
    goes_on = F.coalesce(F.col("before.ok") & (F.col("t") - F.col("before.t") <= limit), F.lit(False))
    starts = led.withColumn("new", (F.col("ok") & ~goes_on).cast("int")).withColumn("n", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    per_slice = starts.groupBy(*keys, "slice").agg(F.sum("new").alias("k"))
    offset = per_slice.withColumn("o", F.coalesce(F.sum("k").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("slice").alias("e_slice"), "o")
    numbered = starts.join(offset, on).filter("ok").withColumn("run", F.col("n") + F.col("o"))
    runs = numbered.groupBy(*keys, "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("pings"))
    return runs.select(*keys, F.timestamp_micros("a").alias("started"), F.timestamp_micros("b").alias("ended"), "pings", ((F.col("b") - F.col("a")) / 1e6 + interval_s).alias("seconds"))


def uptime_total(windows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, windows, seconds)."""
    return windows.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("windows"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("seconds"))


def token_totals(generations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, rows, choices, prompt_tokens, completion_tokens) of the rows with choices; missing usage counts as 0."""
    good = generations.filter(F.size("choices") > 0)
    return good.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.size("choices")), F.lit(0)).alias("choices"),
        F.coalesce(F.sum(F.coalesce("usage.prompt_tokens", F.lit(0))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.coalesce("usage.completion_tokens", F.lit(0))), F.lit(0)).alias("completion_tokens"),
    )


def serving_levels(requests: DataFrame, level: str) -> DataFrame:
    """(level, requests, ok, errors, wall_s, req_per_s, prompt_tok_per_s, output_tok_per_s, mean_completion, p50, p90, p99, finish_length).

    requests: latency_s, started_at (seconds), error, prompt_tokens, completion_tokens, finish_reason. The wall time runs from the first start to
    the last end. Quantiles are nearest ranks of the good requests.
    """
    ok = F.col("error").isNull()
    wall = F.max(F.col("started_at") + F.col("latency_s")) - F.min("started_at")
    base = requests.groupBy(level).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("errors"),
        F.round(wall, 3).alias("wall_s"),
        F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).alias("output_tokens"),
        F.count_if(ok & (F.col("finish_reason") == "length")).alias("finish_length"),
    )
    q = nearest_rank(requests.filter(ok), [level], "latency_s", [0.5, 0.9, 0.99]).groupBy(F.col(level).alias("_l")).agg(*[F.max(F.when(F.col("quantile") == p, F.col("latency_s"))).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))])
    rate = lambda c: F.round(F.when(F.col("wall_s") > 0, c / F.col("wall_s")), 6)
    return base.join(q, F.col(level).eqNullSafe(F.col("_l")), "left").select(
        level, "requests", "ok", "errors", "wall_s", rate(F.col("ok")).alias("req_per_s"), rate(F.col("prompt_tokens")).alias("prompt_tok_per_s"), rate(F.col("output_tokens")).alias("output_tok_per_s"),
        F.round(F.col("output_tokens") / F.greatest(F.col("ok"), F.lit(1)), 6).alias("mean_completion"), "p50", "p90", "p99", "finish_length",
    )


def best_level(levels: DataFrame, level: str) -> DataFrame:
    """The level without errors and with the most requests a second, the smallest name of equals; no rows if all have errors."""
    return levels.filter("errors = 0 and req_per_s is not null").orderBy(F.desc("req_per_s"), level).limit(1)


def level_records(benchmarks: DataFrame) -> DataFrame:
    """Nested benchmark files as one row a record: hardware, model, concurrency and the record's fields."""
    each = benchmarks.select("hardware", "model", F.explode("levels").alias("l")).select("hardware", "model", "l.concurrency", F.explode("l.records").alias("r"))
    return each.select("hardware", "model", "concurrency", "r.*")


def run_operations(runs: DataFrame) -> DataFrame:
    """runs with forward, model_ops, hardware_ops and hours.

    runs: hidden, layers, ffn, vocab, heads, head_dim, kv_heads, rank, tokens, sequences, epochs, extra_passes, wall_s, devices.
    extra_passes are forward passes besides the update (0 for supervised runs, 1 or 2 for rollouts).
    """
    d = models.dimensions(*[F.col(c) for c in ("hidden", "layers", "ffn", "vocab", "heads", "head_dim", "kv_heads", "rank")])
    length = F.col("tokens") / F.col("sequences")
    forward = models.forward_operations(d["decoder"], d["head"], F.col("layers"), d["width"], length)
    model, hardware = models.update_operations(forward, d["adapter"])
    total = F.col("tokens") * F.col("epochs")
    extra = F.col("tokens") * F.col("extra_passes") * forward
    return runs.withColumns({"forward": forward, "model_ops": total * model + extra, "hardware_ops": total * hardware + extra, "hours": F.col("wall_s") / 3600 * F.col("devices")})


def role_totals(runs: DataFrame, roles: tuple[str, ...] = ("recipe", "overhead")) -> DataFrame:
    """(role, device, runs, hours, model_ops, hardware_ops): sums by role and device; other roles are left out."""
    return runs.filter(F.col("role").isin(*roles)).groupBy("role", "device").agg(F.count(F.lit(1)).alias("runs"), F.sum("hours").alias("hours"), F.sum("model_ops").alias("model_ops"), F.sum("hardware_ops").alias("hardware_ops"))


def utilisation(operations: Column, hours: Column, peak_per_s: float) -> Column:
    """Share of the peak operations of the device hours."""
    return operations / (hours * 3600 * peak_per_s)


def cache_usage(files: DataFrame) -> DataFrame:
    """(entry, size, last_use) of files (entry, length, modified): what each cached folder holds and when it was last used."""
    return files.groupBy("entry").agg(F.sum("length").alias("size"), F.max("modified").alias("last_use"))
