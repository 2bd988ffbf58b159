"""Connected components by DataFrame operations: hook every node to its smallest neighbour, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.llm.tables import Scratch, only


def components(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """``node, label``: one row per node of ``edges``; label is the smallest node that can be reached.

    Union-find without a central table: in each round every set's root hooks
    onto the neighbour that comes first in an order hashed anew for the round,
    then the edges are rewritten to the new roots and made distinct. The hashed
    order makes the expected number of rounds logarithmic for chains as well as
    stars. A root with very many edges costs a map-side minimum and joins that
    the engine can split at run time. Every round is a table in the shared
    folder. Null ends and self-loops are ignored; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    left = scratch.write(only(edges, a=source, b=target).where("a <> b").distinct())
    labels, round_ = None, 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b"), F.col("a")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("rank"), c.alias("node"))  # noqa: B023, E731
        hooks = scratch.write(both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("first"))
                              .select("a", F.when(F.col("first") < rank(F.col("a")), F.col("first.node"))
                                      .otherwise(F.col("a")).alias("to")))
        other = hooks.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        following = scratch.write(left.join(hooks, "a").join(other, "b")
                                  .select(F.col("to").alias("a"), F.col("to_b").alias("b"))
                                  .where("a <> b").distinct())
        if labels is None:
            grown = scratch.write(hooks.select(F.col("a").alias("node"), F.col("to").alias("root")))
        else:
            grown = scratch.write(
                labels.join(hooks, labels["root"] == hooks["a"], "left")
                .select("node", F.coalesce("to", "root").alias("root")))
        scratch.drop(left, hooks, *([labels] if labels is not None else []))
        left, labels, round_ = following, grown, round_ + 1
    scratch.drop(left)
    if labels is None:
        return only(edges, node=source, label=source).limit(0)
    smallest = labels.groupBy("root").agg(F.min("node").alias("label"))
    return labels.join(smallest, "root").select("node", "label")
