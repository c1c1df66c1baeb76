"""Splits that keep related records together.

Sources that links connect form components (distributed min-label propagation). Components are bundled by size and label
profile; a min-cost flow sends the bundles to the splits under the quotas, with a price on each unit beyond a quota; the flow
is rounded to whole components, and the members of a bundle are dealt out by the rank of their hash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import buckets_for, grouped_rank
from ..session import cut_lineage
from .names import company_code, database_name

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Sizes up to this are kept exact in bundles; larger ones share a bundle when within 1/16 of each other.
EXACT_SIZE = 128


def components(edges: DataFrame, left: str = "left_source", right: str = "right_source", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest name by code point that can be reached over the edges.

    Edges with a null end are ignored, self loops name their node; no edges give no rows. Each round takes the least label of
    the neighbours and then the label of the label; both are grouped minima, so a hub is combined on the map side.
    """
    ends = edges.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).dropna()
    both = cut_lineage(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("node"), "component")
    labels = cut_lineage(labels)
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = new.select(F.col("node").alias("j_node"), F.col("component").alias("j_component"))
        new = new.join(jump, new.component == jump.j_node, "left").select("node", "was", F.least("component", F.coalesce("j_component", "component")).alias("component"))
        new = cut_lineage(new)
        changed = new.filter("was <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def items(sql_items: DataFrame, qa_items: DataFrame) -> DataFrame:
    """(id, kind, source) of each distinct item. An id that comes twice gets its smallest source that isn't null. Null ids are left out."""
    sql = sql_items.select("id", F.lit("sql").alias("kind"), database_name(F.col("db_id")).alias("source"))
    qa = qa_items.select("id", F.lit("qa").alias("kind"), company_code(F.col("report")).alias("source"))
    return sql.union(qa).filter("id is not null").groupBy("id").agg(F.min("kind").alias("kind"), F.min("source").alias("source"))


def item_groups(sql_items: DataFrame, qa_items: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kind, source, group_key): group_key is the component's smallest name, the source itself without links, and null without a source."""
    known = links.filter(F.coalesce(F.col("kind"), F.lit("")).isin("copy_of", "renamed", "built_from"))
    found = components(known)
    return items(sql_items, qa_items).join(found, F.col("source") == F.col("node"), "left").select("id", "kind", "source", F.coalesce("component", "source").alias("group_key"))


def solve_flow(supply: list[tuple[int, int]], strata: int, shares: list[float]) -> list[list[float]]:
    """Units of each bundle for each split at the least cost. supply: (stratum, units) of each bundle.

    Nodes: bundle -> (stratum, split) -> split -> sink. Up to its quota a (stratum, split) arc is free and beyond costs 1 a
    unit; a split beyond its quota costs 10 a unit. Successive shortest paths; a path takes as much as its arcs hold.
    """
    k, n = len(shares), len(supply)
    total = sum(u for _, u in supply)
    by_stratum = [sum(u for s, u in supply if s == g) for g in range(strata)]
    node_gk = lambda g, j: 1 + n + g * k + j
    node_split = lambda j: 1 + n + strata * k + j
    sink = 1 + n + strata * k + k
    graph: list[list[list[float]]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: float, cost: float) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0.0, -cost, len(graph[a]) - 1])

    for i, (g, units) in enumerate(supply):
        arc(0, 1 + i, units, 0)
        for j in range(k):
            arc(1 + i, node_gk(g, j), units, 0)
    for g in range(strata):
        for j in range(k):
            arc(node_gk(g, j), node_split(j), by_stratum[g] * shares[j], 0)
            arc(node_gk(g, j), node_split(j), by_stratum[g], 1)
    for j in range(k):
        arc(node_split(j), sink, total * shares[j], 0)
        arc(node_split(j), sink, total, 10)

    potential = [0.0] * (sink + 1)
    sent = 0.0
    while sent < total - 1e-6:
        distance = [float("inf")] * (sink + 1)
        via: list[tuple[int, int] | None] = [None] * (sink + 1)
        distance[0] = 0.0
        heap = [(0.0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a] + 1e-12:
                continue
            for at, (b, capacity, cost, _) in enumerate(graph[a]):
                if capacity > 1e-9 and (new := d + max(0.0, cost + potential[a] - potential[int(b)])) < distance[int(b)] - 1e-12:
                    distance[int(b)], via[int(b)] = new, (a, at)
                    heapq.heappush(heap, (new, int(b)))
        if via[sink] is None:
            break
        potential = [p + min(d, distance[sink]) for p, d in zip(potential, distance, strict=True)]
        push, at_node = total - sent, sink
        while at_node:
            a, at = via[at_node]
            push, at_node = min(push, graph[a][at][1]), a
        at_node = sink
        while at_node:
            a, at = via[at_node]
            graph[a][at][1] -= push
            graph[at_node][int(graph[a][at][3])][1] += push
            at_node = a
        sent += push
    flow = [[0.0] * k for _ in range(n)]
    for i, (g, _) in enumerate(supply):
        for b, _, _, back in graph[1 + i]:
            for j in range(k):
                if int(b) == node_gk(g, j):
                    flow[i][j] = graph[int(b)][int(back)][1]
    return flow


def allocate(bundles: list[tuple[int, int, int, int]], shares: list[float]) -> list[list[int]]:
    """Whole components of each bundle for each split. bundles: (stratum, size, components, items), any order.

    A flow shares out all components. It is rounded in two steps, since a component larger than a quarter of the smallest quota may
    not be cut as the flow would: such components go first, largest first, to the split with the most room for them, the one with most
    of their flow among equals, so that no small split consists of one source. The flow of the others is then solved anew under what is
    left of the quotas and rounded down to whole components; what is left of it goes, largest components first, to the split that
    is furthest below its quota, in the component's stratum when splits tie.
    """
    strata = max((b[0] for b in bundles), default=-1) + 1
    total = sum(b[3] for b in bundles)
    filled = [0.0] * len(shares)
    in_stratum = [[0.0] * len(shares) for _ in range(strata)]
    by_stratum = [sum(b[3] for b in bundles if b[0] == g) for g in range(strata)]
    means = [b[3] / b[2] if b[2] else 0 for b in bundles]
    counts = [[0] * len(shares) for _ in bundles]

    def put(i: int, j: int, n: int) -> None:
        counts[i][j] += n
        filled[j] += n * means[i]
        in_stratum[bundles[i][0]][j] += n * means[i]

    large = [i for i in range(len(bundles)) if means[i] > 0.25 * total * min(shares)]
    everything = solve_flow([(b[0], b[3]) for b in bundles], strata, shares) if large else []
    for i in sorted(large, key=lambda i: (-means[i], bundles[i])):
        for _ in range(bundles[i][2]):
            put(i, max(range(len(shares)), key=lambda j: (round(total * shares[j] - filled[j], 6), everything[i][j], -j)), 1)
    small = [i for i in range(len(bundles)) if means[i] <= 0.25 * total * min(shares)]
    room = [max(0.0, total * s - f) for s, f in zip(shares, filled, strict=True)]
    if small and sum(room):
        flow = solve_flow([(bundles[i][0], bundles[i][3]) for i in small], strata, [r / sum(room) for r in room])
        for i, row in zip(small, flow, strict=True):
            for j, x in enumerate(row):
                put(i, j, min(bundles[i][2] - sum(counts[i]), int(x / means[i] + 1e-9)) if means[i] else 0)
    for i in sorted(range(len(bundles)), key=lambda i: (-bundles[i][1], bundles[i])):
        g, _, number, units = bundles[i]
        mean = units / number if number else 0
        for _ in range(number - sum(counts[i])):
            j = max(range(len(shares)), key=lambda j: (round(min(total * shares[j] - filled[j], mean), 6), round(total * shares[j] - filled[j], 6), by_stratum[g] * shares[j] - in_stratum[g][j], -j))
            put(i, j, 1)
    return repair(bundles, shares, counts)


def repair(bundles: list[tuple[int, int, int, int]], shares: list[float], counts: list[list[int]]) -> list[list[int]]:
    """Move components from splits above their quota to splits below it while that brings both nearer to it, largest first."""
    total = sum(b[3] for b in bundles)
    means = [b[3] / b[2] if b[2] else 0 for b in bundles]
    excess = [sum(c[j] * m for c, m in zip(counts, means, strict=True)) - total * s for j, s in enumerate(shares)]
    for i in sorted(range(len(bundles)), key=lambda i: (-means[i], i)):
        for j in sorted(range(len(shares)), key=lambda j: -excess[j]):
            for k in sorted(range(len(shares)), key=lambda k: excess[k]):
                if excess[j] > 0 > excess[k] and means[i]:
                    n = min(counts[i][j], int(min(excess[j], -excess[k]) / means[i] + 1e-9))
                    counts[i][j] -= n
                    counts[i][k] += n
                    excess[j] -= n * means[i]
                    excess[k] += n * means[i]
    return counts


def split_items(sql_items: DataFrame, qa_items: DataFrame, links: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """(id, kind, group_key, split): every distinct item in one split, items of one component in the same split.

    Items without a source are components of their own. The table of bundles that goes to the driver has at most one row for
    each exact size up to EXACT_SIZE, sixteen a doubling beyond, times 11 label profiles (tenths of SQL items).
    Empty tables give no rows.
    """
    spark = sql_items.sparkSession
    grouped = cut_lineage(item_groups(sql_items, qa_items, links).withColumn("component", F.coalesce(F.concat(F.lit("s:"), "group_key"), F.concat(F.lit("i:"), "id"))))
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("kind") == "sql", 1).otherwise(0)).alias("n_sql"))
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.col("size"))) - 4)
    sizes = cut_lineage(
        sizes.select(
            "component",
            "size",
            F.when(F.col("size") <= EXACT_SIZE, F.col("size")).otherwise((F.floor(F.col("size") / step) * step).cast("bigint")).alias("class"),
            F.floor(F.col("n_sql") * 10 / F.col("size")).cast("int").alias("profile"),
        )
    )
    rows = [tuple(r) for r in sizes.groupBy("profile", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("units")).orderBy("profile", "class").collect()]
    strata = {p: g for g, p in enumerate(sorted({r[0] for r in rows}))}
    counts = allocate([(strata[p], c, n, u) for p, c, n, u in rows], [s for _, s in splits])
    plan = []
    for (p, c, _, _), row in zip(rows, counts, strict=True):
        low = 0
        for (name, _), n in zip(splits, row, strict=True):
            if n:
                plan.append((p, c, low, low + n, name))
            low += n
    ranges = spark.createDataFrame(plan, "p_profile int, p_class bigint, low bigint, high bigint, split string")
    ranked = grouped_rank(sizes, ["profile", "class"], F.col("component"), buckets=buckets_for(max((r[2] for r in rows), default=0)))
    dealt = ranked.join(F.broadcast(ranges), (F.col("profile") == F.col("p_profile")) & (F.col("class") == F.col("p_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("component", "split")
    return grouped.join(dealt, "component").select("id", "kind", "group_key", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """(split, kind, n_items, n_groups) of an assignment."""
    return assigned.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("group_key").alias("n_groups"))
