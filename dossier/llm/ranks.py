"""Running sums in a hashed order, without bringing a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.graph import spread_join


def order_digest(*parts: str | Column) -> Column:
    """32 hex digits that order rows like a shuffle; null parts count as empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", *texts))


def running_sums(df: DataFrame, group: str, digest: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before this one by ``digest``.

    A group of n rows is cut at equal steps of the digest into about sqrt(n) bins, so neither a bin nor the list of
    a group's bins grows faster than sqrt(n), even if one group holds most rows. ``group`` must not be null; rows of
    one group with the same digest are ordered by ``value``.
    """
    n, bin_, before, inside = (f"__{x}" for x in ("n", "bin", "before", "inside"))
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias(n))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    binned = spread_join(df, counts, group, digest).withColumn(bin_, F.floor(share * F.ceil(F.sqrt(F.col(n).cast("double"))))).drop(n)
    earlier = Window.partitionBy(group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy(group, bin_).agg(F.sum(value).alias(inside))
    offsets = offsets.select(group, bin_, F.coalesce(F.sum(inside).over(earlier), F.lit(0)).alias(before))
    local = Window.partitionBy(group, bin_).orderBy(digest, value).rowsBetween(Window.unboundedPreceding, -1)
    joined = binned.join(offsets, [group, bin_])
    return joined.withColumn(out, F.col(before) + F.coalesce(F.sum(value).over(local), F.lit(0))).drop(bin_, before)
