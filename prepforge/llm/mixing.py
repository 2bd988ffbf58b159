"""Mixing sources to target weights: budgets down a tree, shortages shared among siblings first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepforge.llm.tables import Scratch, fresh

SHARE = 0.8             # tokens of the mixture, as a share of the tokens there are
EPOCHS = 2              # times a document may be used
SEED = 17
DIGITS = 2              # hexadecimal digits per step of the search for a leaf's last document


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]],
            total: Column, epochs: int) -> DataFrame:
    """``leaves`` (levels, ``supply``) with the ``budget`` of each leaf.

    From the root down, a node's budget goes to its children by weight. A child
    cannot use more than its supply times ``epochs``; what it leaves is shared
    by its siblings, by weight, until they are full too. Only what a whole
    family cannot use is left to the family's own siblings, since the family's
    limit is its children's total. Weights are integers per level and value;
    values without one weigh 1, values of weight 0 get nothing. Budgets are
    rounded down to whole tokens.
    """
    def weight(level: str) -> Column:
        given = [x for pair in weights.get(level, {}).items() for x in (F.lit(pair[0]), F.lit(int(pair[1])))]
        own = F.coalesce(F.create_map(*given)[F.col(level)], F.lit(1)) if given else F.lit(1)
        return own.cast("bigint")

    out = leaves.withColumn("cap", F.col("supply") * F.lit(epochs).cast("bigint"))
    for level in levels:
        out = out.withColumn("cap", F.when(weight(level) > 0, F.col("cap")).otherwise(F.lit(0).cast("bigint")))
    plan: DataFrame | None = None
    parents: list[str] = []
    for level in levels:
        path = [*parents, level]
        nodes = out.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", weight(level))
        family = W.partitionBy(*[F.col(p) for p in parents] or [F.lit(0)])
        nodes = (nodes.withColumn("budget", F.least(total, F.sum("cap").over(family))) if plan is None
                 else nodes.join(plan, parents))
        by_need = family.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(-1.0)),
                                 level).rowsBetween(W.unboundedPreceding, W.currentRow)
        nodes = (nodes
                 .withColumn("before", F.sum("cap").over(by_need) - F.col("cap"))
                 .withColumn("open", F.sum("weight").over(family) - F.sum("weight").over(by_need) + F.col("weight"))
                 .withColumn("full", (F.col("weight") <= 0) | (
                     F.col("cap") / F.col("weight") <= (F.col("budget") - F.col("before")) / F.col("open")))
                 .withColumn("full", F.min("full").over(by_need))
                 .withColumn("used", F.sum(F.when(F.col("full"), F.col("cap"))).over(family))
                 .withColumn("heavy", F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)))
        rest = (F.col("budget") - F.coalesce("used", F.lit(0))) / F.col("heavy")
        plan = nodes.select(*path, F.when(F.col("full"), F.col("cap"))
                            .otherwise(F.floor(F.col("weight") * rest)).cast("bigint").alias("budget"))
        parents = path
    return out.drop("cap").join(plan, list(levels))


def mixture(docs: DataFrame, levels: Mapping[str, str], weights: Mapping[str, Mapping[str, int]],
            tokens: Column | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED,
            id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, the levels, ``tokens, epoch``: one row per use of a document in the mixture.

    ``levels`` name the tree from the root's children to the leaves, as SQL over ``docs``. A leaf uses
    all its documents for as many whole epochs as its budget holds, then, in the
    seeded order of the next epoch, the longest run of documents from the start
    whose tokens fit the rest (none if the rest is 0). The order is that of md5(seed|epoch|id). Documents
    with equal ids stand at the same place and are used together or not at all.

    Null level values are a value of their own (the empty text), a null id is
    the empty text in the order, null texts have no tokens. No rows give no rows.

    The end of a leaf's run is found by the tokens per leading digits of the
    order, two digits at a time, so no task ever holds a leaf.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    names = list(levels)
    rows = scratch.write(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        *[F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        (n_words() if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint")).alias("tokens")))
    leaves = scratch.write(rows.groupBy(*names).agg(F.sum("tokens").alias("supply")))
    total = leaves.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) * F.lit(share)).cast("bigint")).first()[0]
    planned = scratch.write(
        budgets(leaves, names, weights, F.lit(total).cast("bigint"), epochs)
        .withColumn("whole", F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply")))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"),
                            F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = scratch.write(rows.join(planned.select(*names, "whole"), names).withColumn("key", key))
    limits = planned.where("rest > 0").select(*names, F.lit("").alias("cut"), F.col("rest").alias("left"))
    for step in range(2):
        head = F.substring("key", 1, DIGITS * (step + 1))
        inside = placed.join(limits, names).where(F.col("key").startswith(F.col("cut")))
        per = inside.groupBy(*names, "left", head.alias("head")).agg(F.sum("tokens").alias("n"))
        order = W.partitionBy(*names).orderBy("head")
        per = per.withColumn("upto", F.sum("n").over(order)).where("upto > left")
        limits = scratch.write(per.groupBy(*names, "left").agg(F.min(F.struct("head", "upto", "n")).alias("at"))
                               .select(*names, F.col("at.head").alias("cut"),
                                       (F.col("left") - F.col("at.upto") + F.col("at.n")).alias("left")))
    width = 2 * DIGITS
    near = placed.join(limits, names)
    head = F.substring("key", 1, width)
    order = W.partitionBy(*names, "cut").orderBy("key")
    last = (near.where(head == F.col("cut")).withColumn("upto", F.sum("tokens").over(order))
            .where("upto <= left").select("doc_id", *names, "tokens", F.col("whole").alias("epoch")))
    early = near.where(head < F.col("cut")).select("doc_id", *names, "tokens", F.col("whole").alias("epoch"))
    whole = placed.where("whole > 0").select(
        "doc_id", *names, "tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    return whole.unionByName(early).unionByName(last)


def used_rows(docs: DataFrame, chosen: DataFrame, levels: Mapping[str, str], id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``mixture`` uses at least once, in the columns of ``docs``.

    A row is found by its leaf and its id, which ``mixture`` uses together or not
    at all; a null id matches a null id. The tokens of what stays are those that
    ``chosen`` has, each use counted once, however often an id is repeated within
    a leaf or across leaves.
    """
    names = {n: fresh(f"of_{n}", docs.columns) for n in ["doc_id", *levels]}
    uses = chosen.select(*[F.col(n).alias(own) for n, own in names.items()]).distinct()
    on = docs[f"`{id_col}`"].eqNullSafe(uses[names["doc_id"]])
    for level, expression in levels.items():
        on = on & (F.coalesce(F.expr(expression).cast("string"), F.lit("")) == uses[names[level]])
    return docs.join(uses, on, "left_semi")
