"""Queries of the training-data operators over the driver's tables, with SQL where an independent engine can state the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import side_by_side
from ..session import cut_lineage, table
from . import defects, formatting, mixing, overlap, packing, sampling, spam, splits


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "sql_items"), table(spark, d, "records")).select("eval_id", "train_id")


def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "sql_items"), table(spark, d, "records"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "sql_items"), table(spark, d, "records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.item_groups(table(spark, d, "sql_items"), table(spark, d, "qa_items"), table(spark, d, "source_links")).filter("group_key is not null").select("id", "group_key")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_items(table(spark, d, "sql_items"), table(spark, d, "qa_items"), table(spark, d, "source_links"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.golden_sample(table(spark, d, "records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.first_defects(_labels(spark, d))


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("origin", "id", "sample", "defect", "posterior")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return defects.defect_labels(table(spark, d, "generations"), table(spark, d, "records"), table(spark, d, "sql_items"), table(spark, d, "qa_items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(table(spark, d, "graded"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copy_counts(table(spark, d, "graded"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id")


def _properties(values: DataFrame, *names: str) -> DataFrame:
    """(property, value) of a one-row result."""
    return values.select(F.explode(F.array(*[F.struct(F.lit(n).alias("property"), F.coalesce(F.col(n).cast("bigint"), F.lit(0)).alias("value")) for n in names])).alias("p")).select("p.*")


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: every item once, no group in two splits, every split within a hundredth of its share."""
    got = cut_lineage(p2_splits(spark, d))
    total = got.count()
    off = reduce(lambda a, b: a + b, [(F.abs(F.count_if(F.col("split") == name) - total * share) > 0.01 * total).cast("int") for name, share in splits.SPLITS])
    whole = got.filter("group_key is not null").groupBy("group_key").agg(F.countDistinct("split").alias("n")).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("groups_cut"))
    counts = got.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("items"), F.count_if(F.col("split").isNull()).alias("without_split"), off.alias("splits_off"))
    return _properties(side_by_side(counts, whole), "rows", "items", "without_split", "splits_off", "groups", "groups_cut")


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the sets of equal predictions: all rows in one set, distinct writings added up, no more sets than raw writings."""
    got = p5_counts(spark, d).agg(F.sum("copies").alias("predictions"), F.sum("writings").alias("writings"), F.count_if(F.col("copies") < F.col("writings")).alias("sets_short"), F.countDistinct("id").alias("items"))
    return _properties(got, "predictions", "writings", "sets_short", "items")


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: none over its capacity, every document that has text in them, whole unless longer than a container, no token twice or lost."""
    packed = cut_lineage(p6_containers(spark, d))
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > packing.CAPACITY).alias("over"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    counts = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= packing.CAPACITY)).alias("cut_needlessly"), F.count_if(F.col("end") != F.col("t")).alias("gaps"))
    return _properties(side_by_side(per, counts), "over", "documents", "cut_needlessly", "gaps")


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture: every share within a hundredth of the whole, no document over its source's repeats, every target source there."""
    got = p7_shares(spark, d)
    counts = got.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.abs(F.col("actual_share") - F.col("target_share")) > 0.01).alias("shares_off"), F.count_if(F.col("most_copies") > F.col("max_repeat")).alias("over_repeat"))
    return _properties(counts, "sources", "shares_off", "over_repeat")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_overlaps, p1_report, p2_found, p2_splits, p2_checked, p3_sample, p4_found, p4_labels, p5_found, p5_counts, p5_checked, p6_containers, p6_checked, p7_mixture, p7_shares, p7_checked, p8_found)
}

_DATABASE = r"""nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  db_id, '\\', '/', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '/+$', '', 'g'), '^.*/', ''), '(?i)\.(sqlite3?|db3?)$', '')), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"""

_GROUPS = rf"""
WITH RECURSIVE named AS (
  SELECT id, {_DATABASE} AS source FROM sql_items
  UNION ALL
  SELECT id, nullif(upper(trim(regexp_extract(regexp_replace(regexp_replace(report, '(?i)%2f|%5c|\\', '/', 'g'), '[\s\p{{Z}}]+', '', 'g'), '(?:^|/)([^/]+)/+\d{{4}}(?:/|$)', 1))), '') FROM qa_items),
items AS (SELECT id, min(source) AS source FROM named WHERE id IS NOT NULL GROUP BY id),
edges AS (SELECT left_source AS a, right_source AS b FROM source_links WHERE kind IN ('copy_of', 'renamed', 'built_from')
  UNION SELECT right_source, left_source FROM source_links WHERE kind IN ('copy_of', 'renamed', 'built_from')),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
component AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
grouped AS (SELECT id, coalesce(c, source) AS group_key FROM items LEFT JOIN component ON source = a)
"""

ORACLE: dict[str, str] = {
    "p2_found": f"{_GROUPS} SELECT id, group_key FROM grouped WHERE group_key IS NOT NULL",
    "p2_checked": f"""{_GROUPS} SELECT 'rows' AS property, count(*) AS value FROM grouped UNION ALL SELECT 'items', count(DISTINCT id) FROM grouped UNION ALL SELECT 'groups', count(DISTINCT group_key) FROM grouped
UNION ALL SELECT unnest(['without_split', 'splits_off', 'groups_cut']), 0""",
    "p5_checked": """WITH p AS (SELECT coalesce(id, '') AS id, coalesce(pred_sql, pred_answer) AS pred FROM graded WHERE row_id IS NOT NULL AND coalesce(pred_sql, pred_answer) IS NOT NULL)
SELECT 'predictions' AS property, count(*) AS value FROM p UNION ALL SELECT 'writings', count(DISTINCT (id, pred)) FROM p UNION ALL SELECT 'items', count(DISTINCT id) FROM p UNION ALL SELECT 'sets_short', 0""",
    "p6_checked": """SELECT 'documents' AS property, count(DISTINCT doc_id) AS value FROM documents WHERE text <> '' UNION ALL SELECT unnest(['over', 'cut_needlessly', 'gaps']), 0""",
    "p7_checked": """SELECT 'sources' AS property, count(*) AS value FROM mix_targets UNION ALL SELECT unnest(['shares_off', 'over_repeat']), 0""",
    "p3_sample": rf"""
WITH named AS (SELECT DISTINCT id, regexp_extract(id, '{sampling.NUMBERED}', 1) AS letters, regexp_extract(id, '{sampling.NUMBERED}', 2) AS number, regexp_extract(id, '{sampling.NUMBERED}', 3) AS sample FROM records WHERE id IS NOT NULL),
numbered AS (SELECT id, CASE WHEN number <> '' THEN (('0x' || substr(md5(letters), 1, 3))::BIGINT * 256 + coalesce(nullif(sample, '')::BIGINT, 0) % 256) * {sampling.LANE} + number::BIGINT END AS seq FROM named),
placed AS (SELECT *, CASE WHEN seq IS NOT NULL
    THEN (CAST(seq AS HUGEINT) * {sampling.GOLDEN} % {sampling.UNIT} + {sampling.shift_of("corpusmill")}) % {sampling.UNIT}
    ELSE CAST(('0x' || substr(md5(id), 1, 12))::BIGINT AS HUGEINT) * {sampling.UNIT // (1 << 48)} END AS place FROM numbered)
SELECT id, seq FROM placed WHERE place < {int(0.05 * sampling.UNIT)}
""",
}
