"""Exact ranks and running totals within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusflow.session import materialize

HASH_BITS = 60


def md5_position(value: Column) -> Column:
    """A uniform position in [0, 2^60) from the first 15 hex digits of MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def prefix_rank(
    df: DataFrame,
    keys: list[str],
    position: str,
    ties: list[str],
    total: int,
    weight: str | None = None,
    rows_per_bucket: int = 200_000,
    rank: str = "rank",
    before: str = "before",
    span: int = 1 << HASH_BITS,
) -> DataFrame:
    """Rank rows from 0 within ``keys`` by (``position``, ``ties``) without a window that holds a whole group.

    ``position`` is uniform in [0, ``span``). Its range is cut into buckets, as many as ``total`` rows need; counts per
    (keys, bucket) give each bucket's offset, and windows rank inside buckets only, so that a key with most of the
    rows is spread over as many tasks as any other. With ``weight``, ``before`` is the sum of the weights of all
    earlier rows. Keys must not be null.
    """
    buckets = max(1, -(-total // rows_per_bucket))
    width = -(-span // buckets)
    df = df.withColumn("_b", F.floor(F.col(position) / F.lit(width)).cast("int") if buckets > 1 else F.lit(0))
    order = [F.col(position), *[F.col(c).asc_nulls_first() for c in ties]]
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(inside).cast("bigint") - 1)
    if weight:
        run = inside.rowsBetween(W.unboundedPreceding, -1)
        ranked = ranked.withColumn(before, F.coalesce(F.sum(weight).over(run), F.lit(0)).cast("bigint"))
    if buckets == 1:
        return ranked.drop("_b")
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    counts = df.groupBy(*keys, "_b").agg(*sums)
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if weight:
        offsets = offsets.withColumn("_ow", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
    out = ranked.join(offsets.drop("_n", "_w"), [*keys, "_b"]).withColumn(rank, (F.col(rank) + F.col("_o")).cast("bigint"))
    if weight:
        out = out.withColumn(before, (F.col(before) + F.col("_ow")).cast("bigint"))
    return out.drop("_b", "_o", "_ow")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers from 0 in the given order, as a written table; no task holds more than a range of the rows.

    Rows are range-partitioned and sorted, and the counts of the partitions give each its first number.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    rows = materialize(rows, "numbered")
    part = F.shiftright("_place", 33)
    total, first = 0, []
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # one row per partition
        first += [F.lit(r["part"]), F.lit(total)]
        total += r["n"]
    if not first:
        return rows.withColumn(name, F.lit(0).cast("bigint")).drop("_place")
    return rows.withColumn(name, (F.create_map(*first)[part] + F.col("_place").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("_place")
