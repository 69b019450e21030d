"""Merkle manifest of a dataset: digests, inclusion proofs and verification of every row (operator 13).

A row's leaf is the SHA-256 of its encoded columns. Rows of one group stand in order of their id; every
`FAN` consecutive nodes have one parent, the digest of their digests, until one node, the subroot, is left.
Subroots, in order of their group, are the leaves of one more tree, whose top is the root. A row's proof is
the list of its steps from leaf to root: the digests before and after its own in each run.

Places within a group come from a range partitioning over (group, id), a count for each partition and
group, and the counts of the partitions before, so a group of any size is ordered by many tasks. Each level is one
window by group and parent index: the list of a run, collected over its whole frame in order, is both what the parent
is the digest of and what the siblings are taken from; one row of each run goes to the next level. Proofs
come down again: a node's steps are its own and those of its parent, so a level moves a sixteenth of
the one below. Texts are read once and never shuffled. Only the number of levels reaches the driver.

Defined results: a null value is encoded as `-`, an empty text as `0:`; rows without a group form a group of their
own, which is the first; null ids come first, rows with one id stand in order of their leaf, and rows that are equal in all
encoded columns are interchangeable. A group of one row has its leaf as subroot, and one group alone its subroot as root; their steps are
empty. A last run of one node still has a parent, with empty siblings. An empty table gives no rows. Columns
that are not named are ignored; names of any kind are taken literally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

FAN = 16
VALUES = ("doc_id", "source", "lang", "n_chars", "text")
_PART = 33  # monotonically_increasing_id: the partition stands above this bit
_NO_STEPS = "CAST(array() AS array<struct<before:string,after:string>>)"


def encode(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[encode(v) for v in values])


def proof(steps: Column) -> Column:
    """All siblings of a row, level by level, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf leads to along its steps."""
    return F.aggregate(steps, start, lambda node, s: digest(s["before"], node, s["after"]))


def _placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows with `idx`, the place in their group `g` from 0, and `total`, the rows of the group."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), "g", *order).sortWithinPartitions("g", *order)
    dealt = scratch.keep(dealt.withColumn("at", F.monotonically_increasing_id()), f"{name}-ordered").withColumn("part", F.shiftright("at", _PART))
    counts = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # written, so that Spark knows its size and broadcasts it only where it is small
    starts = scratch.keep(counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total")), f"{name}-starts")
    return dealt.join(starts, ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes with `parent` and `run`, the digests of all nodes of their parent in order."""
    whole = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("parent", F.expr(f"idx div {FAN}")).withColumn("run", F.collect_list("digest").over(whole))


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level; the single node of a finished group goes up as it is."""
    first = _runs(nodes).where(F.col("idx") % FAN == 0)
    above = F.when(F.col("total") == 1, F.element_at("run", 1)).otherwise(digest(F.array_join("run", "")))
    return first.select("g", F.col("parent").alias("idx"), above.alias("digest"), F.ceil(F.col("total") / FAN).alias("total"))


def _climb(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels from the leaves to one node a group."""
    levels, most = [nodes.select("g", "idx", "digest", "total")], nodes.agg(F.max("total")).first()[0] or 1
    while most > 1:
        levels.append(scratch.keep(_parents(levels[-1]), f"{name}-{len(levels)}"))
        most = -(-most // FAN)
    return levels


def _descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes with their steps, from those of the level above (g, parent, steps, and what goes along)."""
    at = (F.col("idx") % FAN).cast("int")
    own = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(FAN)), "").alias("after"))
    joined = _runs(nodes).join(above, ["g", "parent"])
    return joined.withColumn("steps", F.when(F.col("total") > 1, F.concat(F.array(own), F.col("steps"))).otherwise(F.col("steps"))).drop("run", "parent")


def _steps(nodes: DataFrame, levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """nodes (the lowest level with further columns) with `steps`; top has g, steps and what goes along for the highest level."""
    above = top.withColumn("parent", F.lit(0).cast("bigint"))
    if len(levels) == 1:
        return nodes.join(top, "g")
    for level in reversed(levels[1:-1]):
        above = _descend(level, above).drop("digest", "total").withColumnRenamed("idx", "parent")
    return _descend(nodes, above)


def manifest(docs: DataFrame, group_col: str = "source", id_col: str = "doc_id", value_cols: Sequence[str] = VALUES, presented: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, group, leaf, presented (the leaf with the columns of `presented` in place of the stored ones), idx, steps, subroot, root.

    `steps` is an array of (before, after): the joined digests that stand before and after the row's own node, from leaf to root."""
    scratch = Scratch(docs.sparkSession, "merkle")
    named = {c: F.col(f"`{c}`") for c in value_cols}
    stored, shown = leaf(list(named.values())), leaf(list((named | (presented or {})).values()))
    group = F.col(f"`{group_col}`").cast("string")
    key = F.coalesce(F.concat(F.lit("1"), group), F.lit("0"))  # rows without a group come first
    rows = docs.select(key.alias("g"), F.col(f"`{id_col}`").alias("id"), group.alias("group"), stored.alias("digest"), F.nullif(shown, stored).alias("other") if presented else F.lit(None).cast("string").alias("other"))
    leaves = _placed(scratch.keep(rows, "leaves"), ["id", "digest"], scratch, "rows")
    levels = _climb(leaves, scratch, "level")
    subroots = (leaves if len(levels) == 1 else levels[-1]).select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    tops = _placed(subroots, ["of"], scratch, "groups")
    upper = _climb(tops, scratch, "upper")
    root = upper[-1].select("g", F.expr(_NO_STEPS).alias("steps"), F.col("digest").alias("root"))
    tops = _steps(tops, upper, root).select(F.col("of").alias("g"), "steps", F.col("digest").alias("subroot"), "root")
    found = _steps(leaves, levels, tops)
    return found.select("id", "group", F.col("digest").alias("leaf"), F.coalesce("other", "digest").alias("presented"), "idx", "steps", "subroot", "root")
