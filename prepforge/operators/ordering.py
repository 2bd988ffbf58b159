"""Global order without a one-task sort: range partitions plus offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepforge.session import settle

_PART = "__part"


def ordered_totals(df: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """Adds ``<name>_before``: the sum of ``name`` over all rows that sort earlier.

    ``df`` must hold one row per sort key (aggregate first), so the range
    partitions are even. Each partition runs its own window; what precedes it
    comes from one total per partition, a table no longer than the number of
    shuffle partitions. Partition numbers are written down before they are
    used twice, so a recomputed task cannot change them.
    """
    parted = settle(
        df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()), "ordered")
    earlier = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy(_PART).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = totals.select(_PART, *[
        F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__off_{s}") for s in sums])
    within = parted.select("*", *[
        F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__in_{s}") for s in sums])
    joined = within.join(F.broadcast(offsets), _PART)
    return joined.select(*df.columns, *[
        (F.col(f"__off_{s}") + F.col(f"__in_{s}")).alias(f"{s}_before") for s in sums])


def last_so_far(df: DataFrame, keys: list[str], place: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Adds ``into``: the last non-null ``value`` of the row's key up to the row, in the order of ``place``.

    Rows are dealt by ranges of (keys, place), so one key may fill all tasks;
    ``order`` begins with ``place`` and decides between rows at one place, which
    stay together. Every partition runs its own window. What reaches it from
    partitions before is a table of the keys that cross its ends, a few rows per
    partition. Keys must not be null.
    """
    parted = settle(df.repartitionByRange(*[F.col(c) for c in [*keys, *place]])
                    .withColumn(_PART, F.spark_partition_id()), "ordered")
    key = F.struct(*keys)
    ends = parted.groupBy(_PART).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    crossing = ends.select("high.*").intersect(ends.select("low.*"))
    held = parted.join(F.broadcast(crossing), keys, "left_semi").groupBy(_PART, *keys).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(_PART, *keys, F.last("__end", ignorenulls=True).over(before).alias("__before"))
    own = Window.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = parted.withColumn(into, F.last(value, ignorenulls=True).over(own))
    return within.join(F.broadcast(carried), [_PART, *keys], "left").select(
        *df.columns, F.coalesce(into, "__before").alias(into))


def highest_so_far(df: DataFrame, keys: list[str], place: str, value: str, into: str, reach: int) -> DataFrame:
    """Adds ``into``: the highest ``value`` of the row's key at places up to ``place + reach``, a whole number.

    As in ``last_so_far``, rows are dealt by ranges of (keys, place), those at
    one place together, and the keys that cross the ends of a range carry over
    what came before it. Keys must not be null.
    """
    parted = settle(df.repartitionByRange(*[F.col(c) for c in [*keys, place]])
                    .withColumn(_PART, F.spark_partition_id()), "ordered")
    key = F.struct(*keys)
    ends = parted.groupBy(_PART).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    crossing = ends.select("high.*").intersect(ends.select("low.*"))
    held = parted.join(F.broadcast(crossing), keys, "left_semi").groupBy(_PART, *keys).agg(F.max(value).alias("__end"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(_PART, *keys, F.max("__end").over(before).alias("__before"))
    own = Window.partitionBy(_PART, *keys).orderBy(place).rangeBetween(Window.unboundedPreceding, reach)
    within = parted.withColumn(into, F.max(value).over(own))
    return within.join(F.broadcast(carried), [_PART, *keys], "left").select(
        *df.columns, F.greatest(into, "__before").alias(into))


def newest_first(df: DataFrame, timestamp: str, tiebreak: str, limit: int | None = None) -> DataFrame:
    """Latest rows on top; with a limit this is a top-k, not a full sort."""
    out = df.orderBy(F.col(timestamp).desc(), F.col(tiebreak))
    return out.limit(limit) if limit else out


def top_features(importances: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features, ties by name."""
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


def background_sample(df: DataFrame, columns: list[str], rows: int = 100) -> DataFrame:
    """At most ``rows`` rows, chosen by value so that every run picks the same."""
    keyed = df.select(*columns).withColumn("__key", F.xxhash64(*columns))
    return keyed.orderBy("__key", *columns).limit(rows).drop("__key")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str],
                   first_of: dict[str, str] | None = None) -> DataFrame:
    """The newest row of each key; ``first_of`` keeps the minimum of a column.

    An aggregate instead of a ranking window: it reduces before the shuffle,
    so a hot key costs nothing extra. ``order`` must be unique within a key.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__row")
    firsts = [F.min(c).alias(name) for name, c in (first_of or {}).items()]
    return df.groupBy(*keys).agg(newest, *firsts).select(
        *keys, "__row.*", *[F.col(name) for name in (first_of or {})])
