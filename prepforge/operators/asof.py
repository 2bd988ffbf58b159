"""As-of join: the latest right row at or before each left row, per key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.columns import quoted
from prepforge.operators.ordering import last_so_far


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str,
              right_time: str, values: list[str]) -> DataFrame:
    """Left rows with ``values`` of the right row that is current at ``left_time``.

    Both sides are dealt together by ranges of (key, time), however the rows are
    spread over the keys; the right row that is current where a range begins
    comes from the ranges before. Of right rows at one time the one with the
    largest values is current. Left rows without an earlier right row keep
    NULLs; those that lack the key or the time never move.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    carried = F.struct(quoted(right_time).alias("at"), *[quoted(v) for v in values])
    row = F.struct(*[quoted(c) for c in left.columns])
    usable = lambda time: reduce(and_, [quoted(c).isNotNull() for c in [*by, time]])
    of = [quoted(b).alias(k) for b, k in zip(by, keys)]
    lefts = left.where(usable(left_time)).select(
        *of, quoted(left_time).alias("__t"), F.lit(1).alias("__side"), row.alias("__row"))
    rights = right.where(usable(right_time)).select(
        *of, quoted(right_time).alias("__t"), F.lit(0).alias("__side"), carried.alias("__now"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    found = last_so_far(both, keys, ["__t", "__side"], ["__t", "__side", "__now"], "__now", "__cur").where("__side = 1")
    names = {v: f"asof_{v}" for v in [right_time, *values]}
    out = found.select("__row.*", F.col("__cur")["at"].alias(names[right_time]),
                       *[F.col("__cur")[v].alias(names[v]) for v in values])
    rest = left.where(~usable(left_time)).select(*[quoted(c) for c in left.columns], *[
        F.lit(None).cast(out.schema[n].dataType).alias(n) for n in names.values()])
    return out.unionByName(rest)
