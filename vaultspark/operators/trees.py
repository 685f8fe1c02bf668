"""The graph of snapshots: delivered trees, their nearest delivered ancestors, and chains of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.session import cut


def nearest_delivered(trees: DataFrame, delivered: DataFrame) -> DataFrame:
    """(tree_oid, from_oid) of each delivered tree that has a delivered ancestor along parent_oid, with the nearest one.

    trees: tree_oid, parent_oid (a tree built again has several rows; a null parent or one without a row ends the line).
    delivered: tree_oid, distinct. Ancestors that were not delivered are skipped by pointer jumping: each round at
    least doubles the step over them, so the rounds are the logarithm of the longest run of undelivered trees.
    Parents in a circle, which no real history has, end after as many rounds; no tree is its own ancestor.
    """
    there = delivered.select(F.col("tree_oid").alias("d_oid"))
    parents = trees.where("tree_oid is not null").groupBy("tree_oid").agg(F.max("parent_oid").alias("parent_oid"))
    up = cut(parents.join(there, parents.tree_oid == there.d_oid, "left").select("tree_oid", F.col("d_oid").isNotNull().alias("own"), F.col("parent_oid").alias("to")))
    for _ in range(up.count().bit_length() + 1):
        skip = up.where("not own").select(F.col("tree_oid").alias("to"), F.col("to").alias("next"), F.lit(True).alias("hop"))
        up = cut(up.join(skip, "to", "left").select("tree_oid", "own", F.when(F.col("hop"), F.col("next")).otherwise(F.col("to")).alias("to"), F.col("hop").isNotNull().alias("moved")))
        if up.where("moved and to is not null").isEmpty():
            break
    up = up.where("own and to is not null and to <> tree_oid").select("tree_oid", F.col("to").alias("from_oid"))
    return up.join(there, up.from_oid == there.d_oid, "left_semi")


def chains(edges: DataFrame, delivered: DataFrame) -> DataFrame:
    """Lay the delivered trees out in chains: (tree_oid, chain, idx, next_oid), idx from 0 without gaps.

    Of the trees with the same predecessor the least oid continues its chain; every other one starts a chain of its own
    that has the predecessor's snapshot as its number 0. So a tree occurs once per chain that needs it, and two
    neighbours in a chain are always a tree and its nearest delivered ancestor. next_oid is null at the end of a chain.
    Numbers come from pointer doubling (logarithm of the longest chain in rounds).
    """
    w = Window.partitionBy("from_oid").orderBy("tree_oid")
    ranked = edges.withColumn("first", F.row_number().over(w) == 1)
    ranked = cut(delivered.select("tree_oid").join(ranked, "tree_oid", "left"))
    at = ranked.select("tree_oid", F.when(F.col("first"), F.col("from_oid")).alias("to"), F.when(F.col("first"), 1).otherwise(0).cast("long").alias("steps"), F.when(~F.col("first"), F.col("from_oid")).alias("base"))
    head = at.select("tree_oid", F.col("tree_oid").alias("chain"), "to", "steps")
    for _ in range(head.count().bit_length() + 1):
        if head.where("to is not null").isEmpty():
            break
        far = head.select(F.col("tree_oid").alias("to"), F.col("chain").alias("far_chain"), F.col("to").alias("far_to"), F.col("steps").alias("far_steps"))
        head = cut(
            head.join(far, "to", "left").select(
                "tree_oid",
                F.when(F.col("to").isNull(), F.col("chain")).otherwise(F.col("far_chain")).alias("chain"),
                F.col("far_to").alias("to"),
                (F.col("steps") + F.coalesce("far_steps", F.lit(0))).alias("steps"),
            )
        )
    head = head.where("to is null")  # trees in a circle have no number
    based = at.where("base is not null").select(F.col("tree_oid").alias("chain"), "base")
    own = head.join(based.select("chain", F.lit(1).alias("shift")), "chain", "left").select("tree_oid", "chain", (F.col("steps") + F.coalesce("shift", F.lit(0))).alias("idx"))
    placed = own.unionByName(based.select(F.col("base").alias("tree_oid"), "chain", F.lit(0).cast("long").alias("idx")))
    return placed.withColumn("next_oid", F.lead("tree_oid").over(Window.partitionBy("chain").orderBy("idx")))
