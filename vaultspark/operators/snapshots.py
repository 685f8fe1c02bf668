"""What changed between full snapshots (problem 5)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import jsonval
from vaultspark.functions.arrow import arrow_fn
from vaultspark.operators.trees import chains, nearest_delivered


@arrow_fn(pa.string())
def _nfc(paths: pa.Array) -> pa.Array:
    return pa.array([None if p is None else unicodedata.normalize("NFC", p) for p in paths.to_pylist()], pa.string())


def nfc(path: Column) -> Column:
    """The NFC form; only paths outside ASCII travel to Python."""
    plain = path.rlike(r"^\p{ASCII}*$")
    return F.when(plain, path).otherwise(_nfc(F.when(~plain, path)))


def _mark(text: str | None) -> str:
    if text is None:
        return "n"
    value = jsonval.readable(text)
    return "t" + text if value is None else "j" + jsonval.canonical(value)


@arrow_fn(pa.int64())
def content_digest(frontmatter: pa.Array) -> pa.Array:
    """64-bit hash of what a frontmatter says: readable ones by JSON value, others as text, null as itself.

    Only two hashes of the same path are ever compared, so the chance of a wrong match is 2**-64 per comparison.
    """
    return pa.array([jsonval.digest(_mark(t)) for t in frontmatter.to_pylist()], pa.int64())


def snapshot_changes(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(tree_oid, path, change_kind) between neighbouring snapshots of each chain.

    rows: tree_oid, path, mtime, digest; of equal (tree_oid, path) the greatest mtime counts (ties: the greatest digest;
    a null mtime comes last). placed: see trees.chains. One shuffle on (chain, path) and one sort serve all snapshots at
    once: within a key ordered by snapshot number, another digest than the row before is a change, a gap in the numbers
    is a removal followed by an addition. A partition holds one path's snapshots, never a whole tree.
    Null paths identify nothing and are left out; a tree that is in no chain is left out; empty inputs give no rows.
    """
    ends = placed.groupBy("chain").agg(F.max("idx").alias("last"))
    slots = placed.join(ends, "chain").groupBy("tree_oid").agg(F.collect_list(F.struct("chain", "idx", "next_oid", "last")).alias("slots"))
    spread = rows.where("path is not null").join(slots, "tree_oid").select("tree_oid", "path", "mtime", "digest", F.inline("slots"))
    key = Window.partitionBy("chain", "path").orderBy("idx", F.desc_nulls_last("mtime"), F.desc("digest"))
    once = spread.withColumn("same", F.lag("idx").over(key)).where("same is null or same <> idx")
    near = (
        once.withColumn("prev_idx", F.lag("idx").over(key))
        .withColumn("prev_digest", F.lag("digest").over(key))
        .withColumn("next_idx", F.lead("idx").over(key))
    )
    here = F.when((F.col("idx") > 0) & (F.col("prev_idx").isNull() | (F.col("prev_idx") < F.col("idx") - 1)), F.lit("added")).when((F.col("prev_idx") == F.col("idx") - 1) & (F.col("prev_digest") != F.col("digest")), F.lit("changed"))
    gone = F.when((F.col("idx") < F.col("last")) & (F.col("next_idx").isNull() | (F.col("next_idx") > F.col("idx") + 1)), F.lit("removed"))
    found = near.select(
        "path",
        F.explode(F.array(F.struct(F.col("tree_oid"), here.alias("change_kind")), F.struct(F.col("next_oid").alias("tree_oid"), gone.alias("change_kind")))).alias("c"),
    )
    return found.where("c.change_kind is not null").select("c.tree_oid", "path", "c.change_kind")


def catalog_changes(ref_trees: DataFrame, ref_files: DataFrame) -> DataFrame:
    """Changes of every delivered tree against its nearest delivered ancestor; see snapshot_changes.

    Frontmatter is hashed before the shuffle, so whole texts never travel.
    """
    delivered = ref_files.where("tree_oid is not null").select("tree_oid").distinct()
    placed = chains(nearest_delivered(ref_trees, delivered), delivered)
    rows = ref_files.select("tree_oid", nfc(F.col("path")).alias("path"), "mtime", content_digest("frontmatter").alias("digest"))
    return snapshot_changes(rows, placed)
