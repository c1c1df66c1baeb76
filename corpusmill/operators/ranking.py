"""Ranks and running sums inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a bucket should hold, so that one task sorts few of them at a time.
BUCKET_ROWS = 20_000


def buckets_for(rows: int) -> int:
    """How many buckets keep each at about BUCKET_ROWS rows when the largest group has so many rows; grows with them, 16 at least."""
    return max(16, min(1 << 24, -(-rows // BUCKET_ROWS)))


def hash_bucket(key: Column, buckets: int) -> Column:
    """Leading bits of md5(key) as a bucket number: the buckets are in the order of the md5 itself."""
    return F.shiftright(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") * buckets, 32).cast("int")


def largest_group(df: DataFrame, group: list[str]) -> int:
    """Rows of the largest group (one row goes to the driver); 0 for no rows."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def grouped_rank(df: DataFrame, group: list[str], key: Column, *, weight: str | None = None, position: Column | None = None, buckets: int = 1024, rank: str = "rank", before: str = "before") -> DataFrame:
    """0-based rank by (md5(key), key) inside each group; with weight also the sum of the weights of the rows before.

    With position, a column from 0 up to 1, the order is (position, md5(key), key).
    A group is cut into hash buckets, the buckets' counts are summed up (groups x buckets rows at most), and only the rows of one
    bucket are sorted together, so a group may hold most of all rows; where the largest group's rows are known, pass
    buckets_for(rows). Null keys rank first. Rows with equal keys get
    different ranks in an arbitrary order: pass a unique key where the result has to be stable.
    """
    keyed = df.withColumn("_key", F.coalesce(key.cast("string"), F.lit(""))).withColumn("_md5", F.md5("_key")).withColumn("_p", F.lit(0.0) if position is None else position)
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_key"), buckets) if position is None else F.least(F.lit(buckets - 1), F.floor(F.col("_p") * buckets)).cast("int"))
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    sizes = keyed.groupBy(*group, "_bucket").agg(*sums)
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n_before"),
        *([F.coalesce(F.sum("_w").over(over), F.lit(0)).alias("_w_before")] if weight else []),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy("_p", "_md5", "_key")
    ranked = keyed.withColumn("_r", F.row_number().over(inside) - 1)
    if weight:
        ranked = ranked.withColumn("_s", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    condition = F.col("_bucket") == F.col("_b")
    for c in group:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = ranked.join(offsets, condition).withColumn(rank, (F.col("_r") + F.col("_n_before")).cast("bigint"))
    if weight:
        out = out.withColumn(before, F.col("_s") + F.col("_w_before"))
    return out.drop("_key", "_p", "_md5", "_bucket", "_r", "_s", "_b", "_n_before", "_w_before", *[f"_g_{c}" for c in group])
