"""Spending views: filters, totals by category, the roll-up of the category tree, side totals, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spending_filter(start, end, account=None, who=None, status=None) -> Column:
    """Rows of a period that aren't ignored, optionally of one account, person or status."""
    found = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & ~F.col("ignored")
    for name, value in (("account_id", account), ("who", who), ("status", status)):
        if value is not None:
            found &= F.col(name) == value
    return found


def closure(categories: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, depth: a category's ancestors are the prefixes of its dotted id.

    The tree is at most eight levels deep, so this is a narrow explode, not a recursion.
    """
    parts = F.split("id", r"\.")
    own = categories.select("id", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts"))
    return own.select(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ".").alias("ancestor_id"), F.col("id").alias("descendant_id"), (F.size("parts") - F.col("k")).alias("depth"))


def in_subtree(column: str, node: str) -> Column:
    return (F.col(column) == node) | F.startswith(F.col(column), F.lit(f"{node}."))


def ancestor_at(category: Column, level: int) -> Column:
    """The ancestor at a level (1 is the top), the category itself at its own; null where it's higher up than that."""
    parts = F.split(category, r"\.")
    return F.when(F.size(parts) >= level, F.array_join(F.slice(parts, 1, level), "."))


def paths(categories: DataFrame) -> DataFrame:
    """id, path (labels from the top down), kind (of the top-level ancestor) and children of every category."""
    up = closure(categories).join(categories.select(F.col("id").alias("ancestor_id"), "label", "kind"), "ancestor_id")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("depth"), "label"))), lambda x: x["label"]), " › ")
    told = up.groupBy(F.col("descendant_id").alias("id")).agg(shown.alias("path"), F.max_by("kind", "depth").alias("kind"))
    below = categories.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return told.join(below, "id", "left").select("id", "path", "kind", F.coalesce("children", F.lit(0)).cast("bigint").alias("children"))


def is_unsorted() -> Column:
    """Money out that is filed nowhere."""
    return F.col("category_id").isNull() & (F.col("amount_pence") < 0)


def category_totals(rows: DataFrame) -> DataFrame:
    """Per category: net pence, rows, and pence out."""
    return rows.groupBy("category_id").agg(F.sum("amount_pence").alias("net_pence"), F.count("*").alias("n"), (-F.sum(F.least(F.col("amount_pence"), F.lit(0)))).cast("bigint").alias("out_pence"))


def breakdown(rows: DataFrame, categories: DataFrame, node: str | None = None) -> DataFrame:
    """Tiles one level under node (the top level without one): spend net of refunds, over zero only.

    At a node, what's filed exactly there is the tile ``direct``; at the root, what's filed nowhere
    and went out is the tile ``unsorted``. Rows are put together by category before the tree is
    joined, so the join sees a row for each category.
    """
    totals = category_totals(rows).join(categories.select(F.col("id").alias("category_id"), "kind"), "category_id", "left")
    level = 1 if node is None else node.count(".") + 2
    spend = totals.where(F.col("kind") == "spend")
    if node is not None:
        spend = spend.where(in_subtree("category_id", node))
    tile = F.when(F.size(F.split("category_id", r"\.")) < level, F.lit("direct")).otherwise(F.substring_index("category_id", ".", level))
    tiles = spend.select(tile.alias("tile"), "net_pence", "n")
    if node is None:
        loose = rows.where(is_unsorted()).agg(F.sum("amount_pence").alias("net_pence"), F.count("*").alias("n")).where("n > 0")
        tiles = tiles.unionByName(loose.select(F.lit("unsorted").alias("tile"), "net_pence", "n"))
    grouped = tiles.groupBy("tile").agg((-F.sum("net_pence")).cast("bigint").alias("amount_pence"), F.sum("n").alias("n")).where("amount_pence > 0")
    return grouped.orderBy(F.desc("amount_pence"), "tile")


def tree_totals(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Net pence and rows of every node of the tree with all that's below it."""
    own = category_totals(rows)
    return own.join(closure(categories), own["category_id"] == F.col("descendant_id")).groupBy("ancestor_id").agg(F.sum("net_pence").alias("net_pence"), F.sum("n").alias("n"))


def side_totals(rows: DataFrame, categories: DataFrame, saved: str) -> DataFrame:
    """Money in (income categories), saved (the subtree of saved) and moved (other transfers)."""
    joined = category_totals(rows).join(categories.select(F.col("id").alias("category_id"), "kind"), "category_id")
    part = lambda when, sign: F.coalesce(F.sum(F.when(when, F.col("net_pence") * sign)), F.lit(0)).cast("bigint")
    is_saved = in_subtree("category_id", saved)
    return joined.agg(part(F.col("kind") == "income", 1).alias("in_pence"), part(is_saved, -1).alias("saved_pence"), part((F.col("kind") == "transfer") & ~is_saved, -1).alias("moved_pence"))


def page(rows: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc("date"), "id").offset(offset).limit(limit)
