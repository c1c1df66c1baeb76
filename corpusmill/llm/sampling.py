"""A reproducible sample that stays as data grows: golden-ratio selection over persistent sequence numbers.

A sequence number is mapped to the fractional part of its multiple of the golden ratio, shifted by a seed's fixed amount; the keys
whose fraction lies in a fixed interval are chosen. Consecutive numbers spread evenly over the unit interval, so every stretch of
numbers gives its share. A number has to stay for ever: either the key holds it (train-17#s2 was numbered where it was made), or a
ledger, a table that is only appended to, gives it. Nothing is ranked anew, so rows that come late, go away or come twice
change nothing for the others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import buckets_for, grouped_rank

#: Fixed value: the fractional part of the golden ratio in units of 1e-18.
GOLDEN = 618033988749894848
UNIT = 10**18
#: Numbers of one lane (same letters around the number, same sample) lie within a stretch of this length.
LANE = 10**12
#: Fixed value: the form of a key that holds its number: anything without '#', up to 12 digits, and perhaps '#s' and a sample of up to six digits.
NUMBERED = r"^([^#]*?)([0-9]{1,12})(?:#s([0-9]{1,6}))?$"


def shift_of(seed: str) -> int:
    """The fixed random shift of a seed in units of 1e-18."""
    return int(hashlib.md5(seed.encode()).hexdigest(), 16) % UNIT


def position(seq: Column, shift: int) -> Column:
    """frac(seq x golden ratio + shift) in units of 1e-18, exact for sequence numbers up to 1e19 (decimal arithmetic)."""
    product = seq.cast("decimal(19,0)") * F.lit(GOLDEN).cast("decimal(18,0)")
    return (product.cast("decimal(38,0)") % F.lit(UNIT).cast("decimal(19,0)") + F.lit(shift).cast("decimal(18,0)")).cast("decimal(20,0)") % F.lit(UNIT).cast("decimal(19,0)")


def own_number(key: Column) -> Column:
    """The sequence number that a key holds: its number, in the lane of its letters and its sample; null for keys of another form.

    There are 4,096 lanes of letters times 256 of samples; keys that meet in a number are chosen together, which harms nothing but the evenness.
    """
    text = key.cast("string")
    number = F.regexp_extract(text, NUMBERED, 2)
    sample = F.coalesce(F.nullif(F.regexp_extract(text, NUMBERED, 3), F.lit("")).cast("bigint"), F.lit(0))
    letters = F.conv(F.substring(F.md5(F.regexp_extract(text, NUMBERED, 1)), 1, 3), 16, 10).cast("bigint")
    lane = letters * 256 + sample % 256
    return F.when(number != "", lane * F.lit(LANE) + F.nullif(number, F.lit("")).cast("bigint"))


def _generations(spark: SparkSession, ledger: str) -> list[str]:
    """The complete generations of a ledger in order; one that broke off has no _SUCCESS file and doesn't count."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(ledger)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("generation_"))
    return [f"{ledger.rstrip('/')}/{n}" for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{ledger.rstrip('/')}/{n}/_SUCCESS"))]


def ledger_numbers(df: DataFrame, ledger: str, key: str = "id") -> DataFrame:
    """(key, seq) of the distinct keys of df, by a ledger: a folder that all executors can read, of generations that are only added.

    Keys without a number get the next ones, in the order of their md5, written as one more generation; numbers given are never
    changed, also not when their keys are gone from df. A run that breaks off leaves a generation that doesn't count and is
    written anew. One run at a time may add to a ledger. Null keys are left out.
    """
    spark = df.sparkSession
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_k")).distinct()
    done = _generations(spark, ledger)
    if done:
        known = spark.read.schema("_k string, seq bigint").parquet(*done)
        fresh, first = keys.join(known, "_k", "left_anti"), known.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    else:
        fresh, first = keys, 0
    n = fresh.count()
    if n:
        numbered = grouped_rank(fresh, [], F.col("_k"), buckets=buckets_for(n)).select("_k", (F.col("rank") + first).cast("bigint").alias("seq"))
        numbered.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/generation_{len(done):06d}")
        done = _generations(spark, ledger)
    all_numbers = spark.read.schema("_k string, seq bigint").parquet(*done) if done else spark.createDataFrame([], "_k string, seq bigint")
    return keys.join(all_numbers, "_k").select(F.col("_k").alias(key), "seq")


def golden_sample(df: DataFrame, share: float = 0.05, key: str = "id", ledger: str | None = None, seed: str = "corpusmill") -> DataFrame:
    """(key, seq) of about share of the distinct keys, the same in every run, order and partitioning.

    With a ledger each key's number comes from there; without, from the key itself, and keys that hold none are placed by their
    md5 with a null seq (stable, but not as even). A chosen key stays chosen whatever other rows come, go or come twice. Null keys
    are left out; an empty table gives no rows. Without a ledger rows are chosen before anything is shuffled.
    """
    shift, width = shift_of(seed), F.lit(int(share * UNIT)).cast("decimal(19,0)")
    if ledger is not None:
        return ledger_numbers(df, ledger, key).filter(position(F.col("seq"), shift) < width)
    keyed = df.filter(F.col(key).isNotNull()).select(F.col(key), own_number(F.col(key)).alias("seq"))
    hashed = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("decimal(20,0)") * F.lit(UNIT // (1 << 48)).cast("decimal(18,0)")
    place = F.when(F.col("seq").isNotNull(), position(F.col("seq"), shift)).otherwise(hashed)
    return keyed.filter(place < width).distinct()
