"""Parent chains followed to the root by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources import stored


def follow(scopes: DataFrame, root, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, depth, ends) of every scope: where its chain of parents ends, and the steps to there.

    ends: root, at the value root, which needn't be a scope; self, at a scope that names itself, a step
    that counts; missing, at a parent that is null or no scope, a step that counts; loop, in a longer
    loop, with a null depth. A scope's pointer is doubled in each round: what it points to becomes what
    that points to, so the rounds are the logarithm of the longest chain, and only scopes whose end
    isn't known yet are joined. Scopes that are listed twice have their least parent; null scopes go.
    """
    named = scopes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("to"))
    known = named.select(F.col("node").alias("to"), F.lit(True).alias("there"))
    end = (
        F.when(F.col("node") == root, "root")
        .when(F.col("to") == root, "root")
        .when(F.col("to") == F.col("node"), "self")
        .when(F.col("there").isNull(), "missing")
    )
    steps = F.when(F.col("node") == root, 0).otherwise(1).cast("long")
    now = stored(named.join(known, "to", "left").select("node", "to", end.alias("ends"), steps.alias("depth")), "chains")
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        waiting = now.where("ends is null")
        if waiting.isEmpty():
            break
        further = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("ends").alias("end"), F.col("depth").alias("more"))
        moved = waiting.join(further, "to").select("node", F.col("next").alias("to"), F.col("end").alias("ends"), (F.col("depth") + F.col("more")).alias("depth"))
        now = stored(now.where("ends is not null").unionByName(moved), "chains")
    # after as many doublings as a chain of all scopes needs, what has no end goes round
    return now.select("node", F.when(F.col("ends").isNotNull(), F.col("depth")).alias("depth"), F.coalesce("ends", F.lit("loop")).alias("ends"))
