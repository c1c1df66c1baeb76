"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token sums are raked to the target shares of the sources
and to the natural shares of languages and topics, under the cap of repeats. Each document of a cell is then used
floor(factor) times, and once more with the rest of the factor as its probability: a number between 0 and 1 that a hash gives each
document for ever is held against it. The probabilities of a source's size class are calibrated by one multiplier, so that the
source's tokens meet their target; it is read off histograms, so nothing is ranked or sorted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import topics
from .names import source_name
from .tokens import TOKENIZER

LANGUAGES = ("de", "en", "es", "fr")


def language_code(lang: Column) -> Column:
    """The two letters of a language tag in lower case if it is one of LANGUAGES, else 'other'; null is 'other'."""
    code = F.substring(F.regexp_replace(F.lower(lang), r"(?U)\s+", ""), 1, 2)
    return F.when(code.isin(*LANGUAGES), code).otherwise("other")


def rake(tokens: np.ndarray, sources: np.ndarray, margins: list[np.ndarray], shares: np.ndarray, caps: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Factor of each cell. tokens, sources and each of margins: one entry for each cell; shares and caps: one for each source.

    The total is the largest at which no source needs more than its cap. The other margins keep their natural shares as far
    as the sources allow: each round scales to them, then to the sources, and holds factors at the caps.
    """
    by_source = np.bincount(sources, tokens, len(shares))
    able = (by_source > 0) & (shares > 0)
    if not able.any():
        return np.zeros(len(tokens))
    wanted = np.where(able, shares, 0.0)
    total = float((caps[able] * by_source[able] / wanted[able]).min())
    target = wanted * total
    natural = [np.bincount(m, tokens) / tokens.sum() * target.sum() for m in margins]
    cap = caps[sources].astype(float)
    factor = np.where(able[sources], 1.0, 0.0)

    def to_sources(factor: np.ndarray) -> np.ndarray:
        for _ in range(20):
            reached = np.bincount(sources, factor * tokens, len(shares))
            scale = np.divide(target, reached, out=np.zeros_like(target), where=reached > 0)
            factor = np.minimum(factor * scale[sources], cap)
            if np.allclose(np.bincount(sources, factor * tokens, len(shares)), target, rtol=1e-9):
                break
            # what the caps cut off goes to the cells of the source that have room
        return factor

    for _ in range(rounds):
        before = factor
        for m, goal in zip(margins, natural, strict=True):
            reached = np.bincount(m, factor * tokens, len(goal))
            scale = np.divide(goal, reached, out=np.ones_like(goal), where=reached > 0)
            factor = np.minimum(factor * scale[m], cap)
        factor = to_sources(factor)
        if np.allclose(factor, before, rtol=1e-7):
            break
    return factor


def cells(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of the documents whose source is a target; source names are spelled alike first.

    Topics come from a model fitted to all of these.
    """
    known = targets.select(source_name(F.col("source")).alias("source")).distinct()
    shaped = documents.select("doc_id", source_name(F.col("source")).alias("source"), language_code(F.col("lang")).alias("lang"), "text").join(known, "source", "left_semi")
    return cut_lineage(topics.sized(shaped, path))


#: Bins of the histogram of the documents of a source and size class.
BINS = 4096


def size_class(tokens: Column) -> Column:
    """Documents of one class are within a factor of four of each other; from 4,096 tokens on they are one class."""
    return F.least(F.lit(6), F.floor(F.log2(F.greatest(tokens, F.lit(1))) / 2)).cast("int")


def calibrate(histogram: list[tuple[str, int, int, float]], wanted: dict[tuple[str, int], float]) -> dict[tuple[str, int], float]:
    """The place below which the documents of a source and size class are drawn. histogram: (source, class, bin, tokens); wanted: tokens by source and class.

    The classes of a source go from the largest documents to the smallest; what one class misses its tokens by, up to half of its last bin, is
    made up for by the next, so that a source misses its tokens by half of a small document.
    """
    bins: dict[tuple[str, int], list[tuple[int, float]]] = {}
    for source, size, at, tokens in histogram:
        bins.setdefault((source, size), []).append((at, tokens))
    out = {}
    for source in sorted({s for s, _ in wanted}):
        carry = 0.0
        for size in range(6, -1, -1):
            goal = carry + wanted.get((source, size), 0.0)
            best, reached, level = abs(goal), 0.0, 0.0
            total = 0.0
            for at, tokens in sorted(bins.get((source, size), [])):
                total += tokens
                if abs(goal - total) < best:
                    best, reached, level = abs(goal - total), total, (at + 1) / BINS
            out[source, size] = level
            carry = goal - reached
    return out


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, copies): how often each document of a target source is used; 0 is listed too.

    Targets with a null or no share, and documents of other or null sources, contribute nothing; documents without tokens
    are used as often as the others of their cell with no effect on the shares. Equal doc_ids, and null ones, are drawn alike. To the
    driver go sums over the vocabulary for the topics, one row for each target and each cell (targets x 5 languages x 5 topics), and
    a histogram of seven
    size classes by BINS rows a target.
    """
    spark = documents.sparkSession
    placed = cells(documents, targets, path)
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeat").filter("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share"), F.max("max_repeat")).orderBy("source").collect()
    sums = placed.groupBy("source", "lang", "topic").agg(F.sum("n_tokens")).orderBy("source", "lang", "topic").collect()
    number = {g[0]: i for i, g in enumerate(goals)}
    rows = [r for r in sums if r[0] in number]
    index = lambda values: np.unique(values, return_inverse=True)[1]
    tokens = np.array([float(r[3]) for r in rows])
    factors = rake(tokens, np.array([number[r[0]] for r in rows], dtype=np.int64), [index([r[1] for r in rows]), index([r[2] for r in rows])], np.array([float(g[1]) for g in goals]), np.array([max(1, g[2] or 1) for g in goals], dtype=float)) if rows else []
    table = []
    for r, f in zip(rows, factors, strict=True):
        cap = max(1, goals[number[r[0]]][2] or 1)
        whole = min(cap, int(np.floor(f + 1e-9)))
        part = float(max(0.0, f - whole)) if whole < cap else 0.0
        table.append((r[0], r[1], r[2], whole, part))
    factor = spark.createDataFrame(table, "source string, lang string, topic string, whole int, part double")
    # a number between 0 and 1 for each document, over its probability; v / (1 + v) brings that to 0 up to 1, with the probability itself at 1/2
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id")), 11) / float(1 << 53)
    v = F.when(F.col("part") > 0, u / F.col("part"))
    joined = placed.join(F.broadcast(factor), ["source", "lang", "topic"], "left").withColumns({"place": v / (v + 1), "size": size_class(F.col("n_tokens"))})
    bin_ = F.least(F.lit(BINS - 1), F.floor(F.col("place") * BINS)).cast("int")
    drawn = joined.filter("place is not null")
    wanted = {(r[0], r[1]): float(r[2]) for r in drawn.groupBy("source", "size").agg(F.sum(F.col("part") * F.col("n_tokens"))).collect()}
    counted = [(r[0], r[1], r[2], float(r[3])) for r in drawn.groupBy("source", "size", bin_.alias("bin")).agg(F.sum("n_tokens")).collect()]
    levels = spark.createDataFrame([(s, c, at) for (s, c), at in calibrate(counted, wanted).items()], "source string, size int, level double")
    chosen = joined.withColumn("bin", bin_).join(F.broadcast(levels), ["source", "size"], "left")
    again = F.coalesce(((F.col("bin") + 1) / BINS <= F.col("level")).cast("int"), F.lit(0))
    return chosen.select("doc_id", "source", "lang", "topic", "n_tokens", (F.coalesce("whole", F.lit(0)) + again).cast("int").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies): what each target source contributes to the mixture."""
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeat").filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("documents"), F.max("copies").alias("most_copies"))
    total = F.sum("tokens").over(Window.partitionBy())  # over one row a target
    joined = goals.join(used, "source", "left").withColumn("total", total)
    return joined.select("source", "target_share", F.when(F.col("total") > 0, F.coalesce("tokens", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeat")
