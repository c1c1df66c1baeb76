"""Filling fixed-capacity containers with items.

The lengths' histogram (at most capacity rows) goes to the driver. There a configuration program is covered by
multiplicative weights: the lengths carry weights, the best configuration for the weights is priced over all lengths by a
bounded knapsack, is used in whole containers, and the weights of the lengths it covers fall, until all are covered. Where its
configurations waste room, filling largest first takes over if that needs fewer containers. The plan names for each length which ranks go to which containers; documents get
their rank inside their length and look their container up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import buckets_for, grouped_rank
from ..session import cut_lineage, spread
from .tokens import TOKENIZER, count_tokens

CAPACITY = 2048


def best_configuration(sizes: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int, core: int = 192) -> np.ndarray:
    """How many of each size the most valuable container holds (bounded knapsack: no size more often than its limit).

    The program runs over a core of the densest sizes first. A size outside can better its result only if its value and the
    fractional knapsack of the room beside it are worth more; the sizes that pass this bound join and the program runs again,
    so the result is the best over all sizes. Of equally dense sizes the core takes some of each range.
    """
    copies = np.minimum(limits, capacity // sizes)
    some = np.flatnonzero((copies > 0) & (values > 0))
    counts = np.zeros(len(sizes), dtype=np.int64)
    if not len(some):
        return counts
    density = values[some] / sizes[some]
    spread = np.arange(len(some)) * 0x9E3779B1 % (1 << 32)
    order = some[np.lexsort((spread, -np.round(density * capacity / density.max(), 9)))]
    room = np.concatenate(([0], np.cumsum(sizes[order] * copies[order])))
    worth = np.concatenate(([0.0], np.cumsum(values[order] * copies[order])))
    inside = order[:core]
    best, value = _knapsack(sizes, values, copies, inside, capacity)
    if len(order) > len(inside) and value < np.interp(capacity, room, worth) - 1e-9 * value:
        rest = order[core:]
        bound = values[rest] + np.interp(capacity - sizes[rest], room, worth)
        more = rest[bound > value * (1 + 1e-9)]
        if len(more):
            best, value = _knapsack(sizes, values, copies, np.concatenate((inside, more)), capacity)
    return best


def _knapsack(sizes: np.ndarray, values: np.ndarray, copies: np.ndarray, among: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """(how many of each size, value) of the best container of the sizes among; copies are bundled in powers of two, larger sizes first."""
    bundles: list[tuple[int, int]] = []
    for i in among[np.argsort(-sizes[among], kind="stable")].tolist():
        n, k = int(copies[i]), 1
        while n > 0:
            bundles.append((i, min(k, n)))
            n, k = n - k, 2 * k
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(bundles), capacity + 1), dtype=bool)
    for row, (i, k) in zip(taken, bundles, strict=True):
        s = k * int(sizes[i])
        gain = value[:-s] + k * values[i]
        np.greater(gain, value[s:] + 1e-12, out=row[s:])
        value[s:] = np.where(row[s:], gain, value[s:])
    counts = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    for j in range(len(bundles) - 1, -1, -1):
        if taken[j, c]:
            i, k = bundles[j]
            counts[i] += k
            c -= k * int(sizes[i])
    return counts, float(value[capacity])


def multiplicative_weights(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int | None = None, rate: float = 0.5) -> tuple[list[tuple[np.ndarray, int]], int]:
    """(configurations and how many containers of each, lower bound): a cover of the histogram and what its weights prove.

    Each round prices the best configuration of what is left, uses it as often as that allows in whole containers, and lowers the
    weights of what it covered. Rounds end when the histogram is covered; rounds caps them. Weights over the price of the best
    configuration solve the dual program, so their sum over all items is a lower bound of the containers of any plan; it is
    taken at the start (where it is the size bound) and at every 64th round.
    """
    weight = sizes / capacity
    left = counts.copy()
    out: list[tuple[np.ndarray, int]] = []
    bound = -(-int(sizes @ counts) // capacity)
    while left.any() and (rounds is None or len(out) < rounds):
        config = best_configuration(sizes, weight, left, capacity)
        used = config > 0
        times = int((left[used] // config[used]).min())
        left[used] -= times * config[used]
        out.append((config, times))
        weight[used] *= np.exp(-rate * times * config[used] / counts[used])
        if len(out) % 64 == 0:
            price = float(weight @ best_configuration(sizes, weight, counts, capacity))
            bound = max(bound, math.ceil(float(weight @ counts) / price - 1e-6))
    return out, bound


def plan(histogram: list[tuple[int, int]], capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Containers as (sizes, how many of each, how many such containers). histogram: (size, items), sizes from 1 to capacity."""
    return planned(histogram, capacity, rounds)[0]


def planned(histogram: list[tuple[int, int]], capacity: int = CAPACITY, rounds: int | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], dict[str, int]]:
    """(plan, report): report counts the containers of the program and of the filling, and has the lower bound.

    From the first configuration with over 1 % waste on, the rest of the histogram is also filled largest first; so is the
    whole histogram. The plan with the fewest containers is taken, with the most from the program among equals. The work depends on the
    capacity and not on the number of items.
    """
    if not histogram:
        return [], {"program": 0, "filled": 0, "bound": 0}
    sizes, counts = (np.array(x, dtype=np.int64) for x in zip(*sorted(histogram), strict=True))
    cover, bound = multiplicative_weights(sizes, counts, capacity, rounds)
    first = next((i for i, (config, _) in enumerate(cover) if capacity - config @ sizes > capacity * 0.01), len(cover))
    options = []
    for n in sorted({len(cover), first, 0}, reverse=True):
        rest = counts - sum((times * config for config, times in cover[:n]), np.zeros_like(counts))
        filled = fill(sizes, rest, capacity)
        options.append((n, sum(times for _, times in cover[:n]), sum(x[2] for x in filled), filled))
    n, program, more, filled = min(options, key=lambda o: o[1] + o[2])
    return [(sizes[c > 0], c[c > 0], times) for c, times in cover[:n]] + filled, {"program": program, "filled": more, "bound": bound}


def fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The rest of a histogram: the largest size first, then again and again the largest that still fits, as often as it fits.

    The last step looks for the pair of sizes that leaves the least room. Each configuration is used until a size runs out.
    """
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    left = left.copy()
    while left.any():
        config = np.zeros(len(sizes), dtype=np.int64)
        room = capacity
        at = len(sizes)
        while True:
            fits = np.flatnonzero((left[:at] > config[:at]) & (sizes[:at] <= room))
            if not len(fits):
                break
            i = int(fits[-1])
            if config.any() and room < 2 * int(sizes[i]) and len(fits) > 1:
                pair = _best_pair(sizes, left - config, room)
                if pair is not None and sum(int(sizes[j]) for j in pair) > int(sizes[i]):
                    for j in pair:
                        config[j] += 1
                        room -= int(sizes[j])
                    at = len(sizes)
                    continue
            n = min(int(left[i] - config[i]), room // int(sizes[i]))
            config[i] += n
            room -= n * int(sizes[i])
            at = i
        used = config > 0
        times = int((left[used] // config[used]).min())
        left[used] -= times * config[used]
        out.append((sizes[used], config[used], times))
    return out


def _best_pair(sizes: np.ndarray, free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two free sizes (one size twice if it has two) that fill room best."""
    have = np.flatnonzero((free > 0) & (sizes < room))
    if not len(have):
        return None
    own = sizes[have]
    partner = np.searchsorted(own, room - own, side="right") - 1
    twice = (partner == np.arange(len(have))) & (free[have] < 2)
    partner = np.where(twice, partner - 1, partner)
    ok = partner >= 0
    if not ok.any():
        return None
    total = np.where(ok, own + own[np.maximum(partner, 0)], -1)
    best = int(np.argmax(total))
    return int(have[best]), int(have[partner[best]])


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens), written to the checkpoint folder so that texts are read and tokenized once."""
    return cut_lineage(spread(documents.select("doc_id", "text")).select("doc_id", count_tokens(F.col("text"), path).alias("n_tokens")))


def pieces(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, n_tokens): whole documents as one piece; longer ones cut into full containers and a rest. Documents without tokens give none."""
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / capacity)), lambda i: F.struct(i.cast("int").alias("piece"), (i * capacity).cast("bigint").alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - i * capacity).cast("int").alias("size")))
    return counted.filter("n_tokens > 0").select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.piece", "p.start", F.col("p.size").alias("n_tokens"))


def lookup(containers: list[tuple[np.ndarray, np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the (first rank, first container, items in a container) of its ranges, in the order of the ranks."""
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for sizes, config, times in containers:
        for s, n in zip(sizes.tolist(), config.tolist(), strict=True):
            ranges.setdefault(s, []).append((taken.get(s, 0), base, n))
            taken[s] = taken.get(s, 0) + n * times
        base += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for s, r in ranges.items()}  # type: ignore[misc]


def pack(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, counted: DataFrame | None = None) -> DataFrame:
    """(container, doc_id, piece, start, n_tokens): every token of every document in one container of the given capacity.

    Only a document longer than a container is split. Documents without tokens (null or empty text) take no space and aren't
    listed; an empty table gives no rows. Null ids are kept as they are.
    """
    counted = token_counts(documents, path) if counted is None else counted
    parts = pieces(counted, capacity)
    histogram = [(r[0], r[1]) for r in parts.groupBy("n_tokens").count().collect()]  # one row for each length up to the capacity
    table = lookup(plan(histogram, capacity))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    ranked = grouped_rank(parts, ["n_tokens"], key, buckets=buckets_for(max((n for _, n in histogram), default=0)))
    wide = ranked.sparkSession.sparkContext.broadcast(table)  # capacity x ranges of a length: its size doesn't depend on the documents

    @F.pandas_udf("bigint")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = wide.value
        for size, rank in batches:
            out = np.zeros(len(size), dtype=np.int64)
            s, r = size.to_numpy(), rank.to_numpy()
            for value in np.unique(s):
                low, base, n = known[int(value)]
                at = s == value
                i = np.searchsorted(low, r[at], side="right") - 1
                out[at] = base[i] + (r[at] - low[i]) // n[i]
            yield pd.Series(out)

    return ranked.select(container("n_tokens", "rank").alias("container"), "doc_id", "piece", "start", "n_tokens")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, pieces, tokens, fill): how full the containers are."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("fill"))
