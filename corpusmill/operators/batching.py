"""Training batches: record checks, loss masks, length buckets and seeded batch plans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .advantage import advantages
from .metrics import side_by_side
from .ranking import grouped_rank

ALIGN = 256
#: Rules of a single-turn record, in the order in which they are tested.
RECORD_RULES = ("no_id", "no_response", "no_messages", "bad_message", "last_not_user")


def record_rules() -> dict[str, Column]:
    """Whether a record breaks each rule of a single-turn record."""
    messages = F.col("messages")
    known = lambda m: F.coalesce(m.role.isin("system", "user"), F.lit(False)) & m.content.isNotNull()
    last = F.try_element_at(messages, F.lit(-1)).role
    return {
        "no_id": F.coalesce(F.col("id") == "", F.lit(True)),
        "no_response": F.col("response").isNull(),
        "no_messages": F.coalesce(F.size(messages), F.lit(0)) <= 0,
        "bad_message": F.coalesce(F.exists(messages, lambda m: ~known(m)), F.lit(False)),
        "last_not_user": F.coalesce(last != "user", F.lit(True)),
    }


def valid_records(records: DataFrame, reward: str | None = None) -> DataFrame:
    """Records that break no rule. reward 'required' keeps those with a reward and a group, 'refused' those without a reward."""
    broken = F.lit(False)
    for rule in record_rules().values():
        broken = broken | rule
    out = records.filter(~broken)
    if reward == "required":
        return out.filter("reward is not null and group_id is not null")
    return out.filter("reward is null") if reward == "refused" else out


def rule_counts(records: DataFrame) -> DataFrame:
    """(rule, records): how many records break each rule; a record counts for the first rule that it breaks, 'valid' for none."""
    first = F.lit("valid")
    for name, rule in reversed(record_rules().items()):
        first = F.when(rule, name).otherwise(first)
    return records.groupBy(first.alias("rule")).agg(F.count(F.lit(1)).alias("records"))


def repeated_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def weighted_messages() -> Column:
    """Prompt messages with weight 0 and the response with weight 1."""
    typed = "array<struct<role: string, content: string, weight: double>>"
    prompt = F.transform("messages", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"), F.lit(0.0).alias("weight"))).cast(typed)
    return F.concat(prompt, F.array(F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content"), F.lit(1.0).alias("weight"))).cast(typed))


def chat_text(messages: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Messages in a chat template, each as start role, line end, content, end, line end."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(start), m.role, F.lit("\n"), m.content, F.lit(end + "\n"))), "")


def token_weights(starts: Column, stops: Column, low: Column, high: Column) -> Column:
    """Weight of each token by its characters: 1 only if all of them are in the trained span from low up to high."""
    return F.zip_with(starts, stops, lambda s, e: F.when((s >= low) & (F.greatest(e, s + 1) <= high), F.lit(1.0)).otherwise(F.lit(0.0)))


def trained_span(text: str, response: str, end: str) -> tuple[int, int] | None:
    """Where a response and its end mark stand in a rendered text: as it is, stripped, or with the blanks around its closing think tag changed.

    Templates of reasoning models write 'reasoning</think>answer' anew with their own blanks and an opening tag; the span then begins
    at the reasoning. None if the template changed anything else.
    """
    for form in (response, response.strip()):
        if form and (at := text.rfind(form + end)) >= 0:
            return at, at + len(form) + len(end)
    head, tag, answer = response.rpartition("</think>")
    if not tag:
        return None
    reasoning = head.rpartition("<think>")[2].strip()
    spaced = re.compile(re.escape(reasoning) + r"\s*</think>\s*" + re.escape(answer.strip()) + re.escape(end))
    found = list(spaced.finditer(text))
    return found[-1].span() if found else None


KEPT = ("kept", "truncated")
#: Tokens that a Python worker holds before it hands its rows on.
MOST_TOKENS = 1 << 19


def rendered(records: DataFrame, encode: Callable[[str], list[tuple[int, int, int]]], limit: int, overlong: str = "drop", end: str = "<|im_end|>", render: Callable[[list[dict]], str] | None = None, pad: int | None = None) -> DataFrame:
    """(id, input_ids, loss_weight, n_real, n_trained, status) of records; status is kept, truncated, overlong or unmatched.

    encode gives (token, first character, character behind) of a text, one list entry a token, and runs in the Python workers;
    render makes the text of a list of messages (without it chat_text). The trained span is the response and its end mark; a token has
    weight 0 outside of it. overlong 'truncate' cuts at limit, a multiple of 256. With pad, ids and weights are filled up to limit.
    Records without a response, or whose response the template changed, are unmatched.
    """
    if limit % ALIGN:
        raise ValueError(f"limit must be a multiple of {ALIGN}")
    if overlong not in ("drop", "truncate"):
        raise ValueError(f"overlong is drop or truncate, not {overlong!r}")
    text = [chat_text(weighted_messages(), end=end).alias("text")] if render is None else [weighted_messages().alias("messages"), F.lit(None).cast("string").alias("text")]
    parts = records.select("id", *text, "response")
    nothing = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)

    def one(messages, text: str | None, response: str | None) -> tuple[np.ndarray, np.ndarray, int, int, str]:
        if render is not None and messages is not None:
            text = render([{"role": m["role"], "content": m["content"]} for m in messages])
        span = trained_span(text, response, end) if text is not None and response else None
        if span is None:
            return *nothing, 0, 0, "unmatched"
        tokens = encode(text)
        if len(tokens) > limit and overlong == "drop":
            return *nothing, len(tokens), 0, "overlong"
        status = "truncated" if len(tokens) > limit else "kept"
        tokens = tokens[:limit]
        ids = [t for t, _, _ in tokens]
        inside = [span[0] <= s and (e if e > s else s + 1) <= span[1] for _, s, e in tokens]
        fill = 0 if pad is None else limit - len(ids)
        return np.array(ids + [pad] * fill, dtype=np.int32), np.array(inside + [False] * fill, dtype=np.float32), len(ids), sum(inside), status

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "input_ids", "loss_weight", "n_real", "n_trained", "status"]
        for batch in batches:
            rows, held = [], 0
            for rid, m, t, r in zip(batch["id"], batch["messages"] if "messages" in batch else repeat(None, len(batch)), batch["text"], batch["response"], strict=True):
                rows.append((rid, *one(m, t, r)))
                held += len(rows[-1][1])
                if held >= MOST_TOKENS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return parts.mapInPandas(run, "id string, input_ids array<int>, loss_weight array<float>, n_real int, n_trained int, status string")


def check_masks(rows: DataFrame, padded: bool = False) -> None:
    """Raise when a kept row's weights don't fit its ids, are none of 0 and 1, lie on padding, or a padded length is no multiple of 256."""
    behind = F.slice("loss_weight", F.col("n_real") + 1, F.greatest(F.size("loss_weight") - F.col("n_real"), F.lit(0)))
    faults = (F.size("input_ids") != F.size("loss_weight")) | F.exists("loss_weight", lambda w: ~w.isin(0.0, 1.0)) | F.exists(behind, lambda w: w != 0)
    if padded:
        faults = faults | (F.size("loss_weight") % ALIGN != 0)
    n = rows.filter(F.col("status").isin(*KEPT)).agg(F.count_if(faults)).first()[0]
    if n:
        raise ValueError(f"{n} records with wrong loss weights")


def render_counts(rows: DataFrame, most_unmatched: float = 0.01) -> DataFrame:
    """One row: input, kept, truncated (among the kept), overlong, unmatched, tokens and trained tokens, and whether too many records don't fit the template."""
    kept = F.col("status").isin(*KEPT)
    return rows.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(F.col("status") == "truncated").alias("n_truncated"),
        F.count_if(F.col("status") == "overlong").alias("n_overlong"),
        F.count_if(F.col("status") == "unmatched").alias("n_unmatched"),
        F.coalesce(F.sum(F.when(kept, F.col("n_real"))), F.lit(0)).alias("tokens_real"),
        F.coalesce(F.sum(F.when(kept, F.col("n_trained"))), F.lit(0)).alias("tokens_trained"),
        (F.count_if(F.col("status") == "unmatched") > F.count(F.lit(1)) * most_unmatched).alias("template_refused"),
    )


def shifted(weights: Column) -> Column:
    """Weights moved to the token before (next-token targets), the last one 0."""
    return F.concat(F.slice(weights, 2, F.greatest(F.size(weights), F.lit(1))), F.array(F.lit(0.0).cast("float")))


def row_scale(real: Column, micro: int) -> Column:
    """1 for each real row of a micro-batch, then 0 for the rows that fill it up."""
    return F.transform(F.sequence(F.lit(1), F.lit(micro)), lambda i: F.when(i <= real, 1.0).otherwise(0.0))


def bucket(length: Column, buckets: list[int], full: int | None = None) -> Column:
    """The smallest bucket that holds length. Beyond the largest: full, or an error without it."""
    fit = F.array_min(F.filter(F.array(*[F.lit(b) for b in sorted(buckets)]), lambda b: b >= length))
    over = F.lit(full) if full is not None else F.raise_error(F.concat(F.lit("no bucket holds "), length.cast("string"))).cast("int")
    return F.when(fit.isNotNull(), fit).otherwise(over)


def batch_plan(rows: DataFrame, length: str, global_batch: int, micro_batch: int, epochs: int = 1, seed: int = 0, buckets: list[int] | None = None, full: int | None = None, drop_partial: bool = True, key: str = "id") -> DataFrame:
    """(epoch, global_batch, micro_batch, place, key, length, width): a seeded order for each epoch, cut into global batches.

    Rows of a global batch are ordered by length and cut into micro-batches, each as wide as the smallest bucket that holds its
    longest row (its longest row without buckets). An incomplete last global batch is dropped or kept. The order is the rank of
    md5(seed + epoch, key), found bucket by bucket, so no task sorts an epoch; a window holds one global batch.
    """
    if global_batch % micro_batch:
        raise ValueError("global_batch must be a multiple of micro_batch")
    each = rows.select(F.col(key), F.col(length).cast("bigint").alias("length")).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    ordered = grouped_rank(each.withColumn("_seeded", F.concat_ws(":", (F.col("epoch") + seed).cast("string"), F.col(key))), ["epoch"], F.col("_seeded")).drop("_seeded")
    batched = ordered.withColumn("global_batch", F.floor(F.col("rank") / global_batch))
    if drop_partial:
        whole = F.floor(F.lit(rows.count()) / global_batch)
        batched = batched.filter(F.col("global_batch") < whole)
    inside = Window.partitionBy("epoch", "global_batch").orderBy("length", key)
    placed = batched.withColumn("place", F.row_number().over(inside) - 1).withColumn("micro_batch", F.floor(F.col("place") / micro_batch))
    longest = F.max("length").over(Window.partitionBy("epoch", "global_batch", "micro_batch"))
    width = bucket(longest.cast("int"), buckets, full) if buckets else longest
    return placed.withColumn("width", width.cast("bigint")).select("epoch", "global_batch", "micro_batch", "place", key, "length", "width")


def check_minibatches(sequences: int, mini_batch: int, drop_partial: bool) -> None:
    """Raise when dropping the partial batch would leave no optimizer step."""
    if drop_partial and sequences < mini_batch:
        raise ValueError(f"{sequences} sequences are fewer than a mini-batch of {mini_batch}, and partial batches are dropped")


def rollout_sequences(rollouts: DataFrame, encode: Callable[[str], list[tuple[int, int, int]]], limit: int, norm: str = "std", overlong: str = "drop", pad: int | None = None) -> DataFrame:
    """(id, group_id, advantage, input_ids, loss_weight, n_real, n_trained, status): rendered members of groups with differing rewards; those that train nothing have another status than KEPT or n_trained 0."""
    scored = advantages(rollouts.select("id", "group_id", "reward"), norm).select("id", "group_id", "advantage")
    done = rendered(rollouts.join(scored.select("id"), "id", "left_semi"), encode, limit, overlong, pad=pad)
    return done.join(scored, "id").select("id", "group_id", "advantage", "input_ids", "loss_weight", "n_real", "n_trained", "status")


def trainable(sequences: DataFrame) -> DataFrame:
    """The sequences that are trained on."""
    return sequences.filter(F.col("status").isin(*KEPT) & (F.col("n_trained") > 0))


def rollout_counts(rollouts: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row: sequences trained on; members skipped for equal rewards, truncated, dropped as overlong, without trained tokens, and dropped by the template; tokens."""
    kept = F.col("status").isin(*KEPT)
    used = kept & (F.col("n_trained") > 0)
    counts = sequences.agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(used).alias("n_sequences"),
        F.count_if(F.col("status") == "truncated").alias("n_truncated"),
        F.count_if(F.col("status") == "overlong").alias("n_overlong"),
        F.count_if(kept & (F.col("n_trained") == 0)).alias("n_untrained"),
        F.count_if(F.col("status") == "unmatched").alias("n_unmatched"),
        F.coalesce(F.sum(F.when(used, F.col("n_trained"))), F.lit(0)).alias("tokens_trained"),
        F.coalesce(F.sum(F.when(used, F.col("n_real"))), F.lit(0)).alias("tokens_real"),
    )
    total = side_by_side(rollouts.agg(F.count(F.lit(1)).alias("n_rollouts")), counts)
    return total.select("n_rollouts", (F.col("n_rollouts") - F.col("members")).alias("n_equal_rewards"), *[c for c in counts.columns if c != "members"])


def check_records(records: DataFrame, rollouts: bool = False) -> None:
    """Raise when a record breaks a rule, an id repeats, or, for rollouts, a group or a reward is missing."""
    broken = {r["rule"]: r["records"] for r in rule_counts(records).collect() if r["rule"] != "valid"}
    if broken:
        raise ValueError(f"broken records: {broken}")
    if repeated_ids(records).limit(1).count():
        raise ValueError("record ids repeat")
    if rollouts and records.filter("group_id is null or reward is null").limit(1).count():
        raise ValueError("rollouts without a group or a reward")


def optimizer_steps(plan: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """(epoch, steps): global batches that carry any weight."""
    total = plan.join(weights.select(key, "weight"), key).groupBy("epoch", "global_batch").agg(F.sum("weight").alias("w"))
    return total.groupBy("epoch").agg(F.count_if(F.col("w") != 0).alias("steps"))


def warmup_steps(total: int, ratio: float | None, steps: int | None) -> int:
    """Warm-up steps: as given, else a share of all steps, at most all but one."""
    wanted = steps if steps is not None else round(total * (ratio or 0.0))
    return max(0, min(wanted, total - 1))


def evictions(entries: DataFrame, free: int, need: int, reserve: int, keep: list[str] | None = None, key: str = "path", size: str = "size", used: str = "last_use") -> DataFrame:
    """(key, size): least recently used entries to delete so that free - need is at least reserve; entries in keep stay.

    Running sums in the order of last use, found bucket by bucket. Ties by md5 of the key. Too little room in all raises when the
    result is counted by enough().
    """
    rows = entries.filter(~F.col(key).isin(*(keep or [])))
    low, high = rows.agg(F.min(used).cast("double"), F.max(used).cast("double")).first()
    place = (F.col(used).cast("double") - F.lit(low)) / F.lit(high - low) * 0.999999 if low is not None and high > low else F.lit(0.0)
    placed = rows.withColumn("_place", place)
    summed = grouped_rank(placed, [], F.col(key), weight=size, position=F.col("_place"))
    return summed.filter(F.lit(free) + F.col("before") - need < reserve).select(key, size)


def enough(entries: DataFrame, free: int, need: int, reserve: int, keep: list[str] | None = None, key: str = "path", size: str = "size") -> bool:
    """Whether deleting all entries but those in keep would make room."""
    total = entries.filter(~F.col(key).isin(*(keep or []))).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return free + total - need >= reserve
