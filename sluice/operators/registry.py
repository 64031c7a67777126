"""Parents and their children (a copy and its members), joined by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHED, CHILDLESS, ORPHAN = "matched", "childless", "orphan"


def rollup_children(
    parents: DataFrame, children: DataFrame, parent_key: str, child_parent: str, child_key: str
) -> DataFrame:
    """``parent, kind, children, members, first_child, last_child`` per parent id.

    Parents without children stay; children of unknown parents are reported as orphans.
    Children are reduced to one row per parent before the join, in two combining steps,
    so one parent with a third of all children costs no more than any other. The sets
    themselves stay in relational form, see :func:`child_members`.
    """
    pairs = children.groupBy(F.col(child_parent).alias("parent"), F.col(child_key).alias("child")).agg(
        F.count("*").alias("n")
    )
    reduced = pairs.groupBy("parent").agg(
        F.sum("n").alias("children"),
        F.count("*").alias("members"),
        F.min("child").alias("first_child"),
        F.max("child").alias("last_child"),
    )
    known = parents.select(F.col(parent_key).alias("parent"), F.lit(True).alias("known"))
    joined = known.join(reduced, "parent", "full_outer")
    return joined.select(
        "parent",
        F.when(F.col("known").isNull(), ORPHAN)
        .when(F.col("children").isNull(), CHILDLESS)
        .otherwise(MATCHED)
        .alias("kind"),
        F.coalesce("children", F.lit(0)).cast("long").alias("children"),
        F.coalesce("members", F.lit(0)).cast("long").alias("members"),
        "first_child",
        "last_child",
    )


def child_members(
    parents: DataFrame, children: DataFrame, parent_key: str, child_parent: str, child_key: str
) -> DataFrame:
    """The set of children per known parent, one ``(parent, child)`` row each.

    Distinct on the pair spreads a large parent over all tasks; an array per parent
    would not fit into one.
    """
    pairs = children.select(
        F.col(child_parent).alias("parent"), F.col(child_key).alias("child")
    ).distinct()
    return pairs.join(parents.select(F.col(parent_key).alias("parent")), "parent", "left_semi")


def orphans(
    parents: DataFrame, children: DataFrame, parent_key: str, child_parent: str
) -> DataFrame:
    """Children whose parent is unknown."""
    known = parents.select(F.col(parent_key).alias(child_parent))
    return children.join(known, child_parent, "left_anti")
