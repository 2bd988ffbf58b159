"""Column profile: type, nulls, distinct values and numeric statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.functions.columns import clean, is_stat_numeric
from prepforge.operators.fingerprint import fingerprint_aggregates, fingerprint_from_aggregates
from prepforge.operators.longform import ITEM, MAX_STACKED, named, stacked, value_digest
from prepforge.operators.quantiles import exact_quantiles, sketch_aggregates
from prepforge.session import small_frame

STATS_FIELDS = [
    T.StructField("dtype", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
]
PROFILE_SCHEMA = T.StructType([T.StructField("column", T.StringType())] + STATS_FIELDS)


def column_statistics(df: DataFrame, columns: list[str] | None = None,
                      approximate: bool = False, with_fingerprint: bool = False):
    """Statistics per column, with the row count and (optionally) the fingerprint.

    Returns ``(stats, row_count, fingerprint)``; the state is one small record
    per column. The moments, the fingerprint and the sketches for the median
    share one shuffle-free pass; a second one settles the exact medians.
    Distinct counts shuffle only 128-bit digests, already reduced per task.
    ``approximate`` keeps everything in the first pass by using sketches.
    """
    names = named(df, columns)
    values = {c: clean(df, c) for c in names}
    numeric = [c for c in names if is_stat_numeric(df.schema[c].dataType)]
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        exprs.append(F.count(values[c]).alias(f"present{i}"))
        if approximate:
            first, second = value_digest(df, c)
            exprs.append(F.approx_count_distinct(first).alias(f"unique{i}"))
        if c in numeric:
            x = values[c].cast("double")
            exprs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                      F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
            if approximate:
                exprs.append(F.percentile_approx(x, 0.5, 10_000).alias(f"median{i}"))
    together = not approximate and len(numeric) <= MAX_STACKED
    if together:
        exprs += sketch_aggregates(df, numeric, [0.5])
    if with_fingerprint:
        exprs += fingerprint_aggregates(df)
    totals = df.agg(*exprs)
    if with_fingerprint:
        totals = totals.withColumn("fingerprint", fingerprint_from_aggregates(df))
    row = totals.first().asDict()

    if approximate:
        unique = {i: row[f"unique{i}"] for i in range(len(names))}
        medians = {c: row[f"median{names.index(c)}"] for c in numeric}
    else:
        unique = _distinct_counts(df, names)
        found = exact_quantiles(df, numeric, [0.5], sketched=row if together else None)
        medians = {c: q[0] for c, q in found.items()}

    stats = {}
    for i, c in enumerate(names):
        entry = {
            "dtype": df.schema[c].dataType.simpleString(),
            "null_count": row["rows"] - row[f"present{i}"],
            "unique_count": unique.get(i, 0),
        }
        for key in ("mean", "std", "min", "max"):
            entry[key] = row.get(f"{key}{i}")
        entry["median"] = medians.get(c)
        stats[c] = entry
    return stats, row["rows"], row.get("fingerprint")


def _distinct_counts(df: DataFrame, names: list[str]) -> dict[int, int]:
    found = {}
    for start in range(0, len(names), MAX_STACKED):       # one job for any usual table
        part = names[start:start + MAX_STACKED]
        digests = stacked(df, [list(value_digest(df, c)) for c in part], ["d1", "d2"])
        counted = (
            digests.where(F.col("d1").isNotNull())
            .groupBy(ITEM, "d1", "d2").agg(F.lit(1).alias("one"))
            .groupBy(ITEM).agg(F.count("one").alias("n"))
        )
        found.update({start + r[ITEM]: r["n"] for r in counted.collect()})
    return found


def profile(df: DataFrame, columns: list[str] | None = None,
            approximate: bool = False) -> DataFrame:
    """One row per column: dtype, null_count, unique_count, mean … median."""
    stats, _, _ = column_statistics(df, columns, approximate)
    return small_frame(df.sparkSession, [{"column": c, **s} for c, s in stats.items()], PROFILE_SCHEMA)
