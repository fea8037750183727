"""Understanding transactions: authority, staleness, memory, decisions, history, merges of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Usual-category memory: least rows, least share, confidence from which it's used.
MEMORY_ROWS, MEMORY_SHARE, MEMORY_SURE = 3, 0.75, 0.8
DECIDED = ("category_id", "who", "confidence", "decided_by", "authority")


def may_replace(status: Column, current: Column, new_by: Column, new: Column) -> Column:
    """The person always may; no one else may change a confirmed row; else the higher authority (or an equal one)."""
    return (new_by == "human") | ((status != "confirmed") & (new >= F.coalesce(current, F.lit(0))))


def infer_memory(decisions: DataFrame, least_rows: int = MEMORY_ROWS, least_share: float = MEMORY_SHARE) -> DataFrame:
    """Per merchant its usual category: most rows, then most money, then first by id; who likewise, ties first by name.

    decisions: merchant_id, category_id, who, confidence, pence. Two levels of groups, both with partial sums.
    """
    by_category = decisions.groupBy("merchant_id", "category_id").agg(F.count("*").alias("n"), F.sum("pence").alias("pence"), F.sum("confidence").alias("confidence"))
    best = by_category.groupBy("merchant_id").agg(F.min_by(F.struct("category_id", "n", "confidence"), F.struct(-F.col("n"), -F.col("pence"), "category_id")).alias("best"), F.sum("n").alias("all"))
    share = F.col("best.n") / F.col("all")
    kept = best.where((F.col("all") >= least_rows) & (share >= least_share)).select("merchant_id", F.col("best.category_id").alias("category_id"), F.col("best.n").alias("rows"), F.round(share, 3).alias("share"), F.bround(share * (F.col("best.confidence") / F.col("best.n")), 3).alias("confidence"))
    by_who = decisions.where("who IS NOT NULL").groupBy("merchant_id", "category_id", "who").agg(F.count("*").alias("n"))
    who = by_who.groupBy("merchant_id", "category_id").agg(F.min_by("who", F.struct(-F.col("n"), "who")).alias("who"))
    return kept.join(who, ["merchant_id", "category_id"], "left")


def stale(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows that later knowledge of their merchant or category may change.

    versions: version, merchant_id, category_id. The latest version of each key is found first, so the
    two tests are plain left joins.
    """
    by_merchant = versions.where("merchant_id IS NOT NULL").groupBy("merchant_id").agg(F.max("version").alias("merchant_version"))
    by_category = versions.where("category_id IS NOT NULL").groupBy("category_id").agg(F.max("version").alias("category_version"))
    joined = rows.join(by_merchant, "merchant_id", "left").join(by_category, "category_id", "left")
    return joined.where((F.col("merchant_version") > F.col("knowledge_version")) | (F.col("category_version") > F.col("knowledge_version"))).drop("merchant_version", "category_version")


def merged(current: DataFrame, decisions: DataFrame) -> DataFrame:
    """current with permitted decisions put in; a null in a decision keeps what is there."""
    new = decisions.select("id", *[F.col(c).alias(f"new_{c}") for c in DECIDED])
    joined = current.join(new, "id", "left")
    allowed = F.coalesce(F.col("new_decided_by").isNotNull() & may_replace(F.col("status"), F.col("authority"), F.col("new_decided_by"), F.col("new_authority")), F.lit(False))
    status = F.when(~allowed, F.col("status")).when(F.col("new_decided_by") == "human", "confirmed").when(F.col("new_confidence") >= 0.8, "inferred").otherwise("low_confidence")
    changed = {c: F.when(allowed, F.coalesce(F.col(f"new_{c}"), F.col(c))).otherwise(F.col(c)) for c in DECIDED}
    return joined.select(*[changed[c].alias(c) if c in changed else status.alias(c) if c == "status" else F.col(c) for c in current.columns])


def history(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of after that differ from before in any of columns (confidence at three decimals)."""
    same = lambda c: F.round(c, 3)
    value = lambda side, c: same(F.col(f"{side}.{c}")) if c == "confidence" else F.col(f"{side}.{c}")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~value("a", c).eqNullSafe(value("b", c))
    return after.alias("a").join(before.alias("b"), F.col("a.id") == F.col("b.id"), "left").where(changed).select("a.*")


def valid_answers(answers: DataFrame, batch: DataFrame, categories: DataFrame, people: list[str]) -> DataFrame:
    """An external decider's answers that can be used: in the batch, first per row, a usable category,
    income only for money in; confidence is clamped, unknown people become the household."""
    by = Window.partitionBy("id").orderBy("pos")
    first = answers.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")
    joined = first.join(batch.select("id", "amount_pence"), "id").join(categories.select(F.col("id").alias("category_id"), "kind"), "category_id")
    usable = joined.where((F.col("kind") != "income") | (F.col("amount_pence") >= 0))
    return usable.select("id", "category_id", F.when(F.col("who").isin(*people), F.col("who")).otherwise("household").alias("who"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"))


def upserted(stored: DataFrame, new: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """stored with new rows put in: counters add up, other columns take the new value where there is one."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.select(*keys, *rest, F.lit(0).alias("__new")).unionByName(new.select(*keys, *rest, F.lit(1).alias("__new")))
    value = lambda c: F.sum(c).alias(c) if c in counters else F.coalesce(F.max(F.when(F.col("__new") == 1, F.col(c))), F.max(F.when(F.col("__new") == 0, F.col(c)))).alias(c)
    return both.groupBy(*keys).agg(*[value(c) for c in rest]).select(*stored.columns)


def compare_and_set(stored: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """stored after updates (key, expected_version, value); an update that expected another version changes nothing.

    Column conflict tells the rows whose update was refused.
    """
    joined = stored.join(updates.select(key, "expected_version", F.col("value").alias("__value")), key, "left")
    hit = F.col("expected_version") == F.col("version")
    return joined.select(
        *[F.when(hit, F.col("__value")).otherwise(F.col(c)).alias(c) if c == column else (F.col("version") + F.coalesce(hit, F.lit(False)).cast("int")).alias(c) if c == "version" else F.col(c) for c in stored.columns],
        F.coalesce(~hit, F.lit(False)).alias("conflict"),
    )


def released(links: DataFrame, statement_id, statements: DataFrame) -> DataFrame:
    """Transactions of a removed statement: the earliest statement that still covers each, or null (to be deleted)."""
    mine = links.where(F.col("statement_id") == statement_id).select("transaction_id").distinct()
    others = links.where(F.col("statement_id") != statement_id).join(statements.select("statement_id", "created_at"), "statement_id")
    owner = mine.join(others, "transaction_id").groupBy("transaction_id").agg(F.min_by("statement_id", F.struct("created_at", "statement_id")).alias("owner"))
    return mine.join(owner, "transaction_id", "left")


def crowded(rows: DataFrame, least_rows: int = 40, least_merchants: int = 4, deepest: int = 5) -> DataFrame:
    """Categories with so many rows of so many merchants that they're worth splitting."""
    grouped = rows.where("category_id IS NOT NULL").groupBy("category_id").agg(F.count("*").alias("n"), F.countDistinct("merchant_id").alias("merchants"))
    return grouped.where((F.col("n") >= least_rows) & (F.col("merchants") >= least_merchants) & (F.size(F.split("category_id", r"\.")) < deepest))


def refiled(rows: DataFrame, groups: DataFrame, least_groups: int = 2) -> DataFrame:
    """Rows moved to the groups that an answer names for their category's merchants: category_id, merchant_id, group.

    A category is split only if its answer has enough groups; confirmed rows stay. Columns id, category_id, moved_to.
    """
    enough = groups.groupBy("category_id").agg(F.countDistinct("group").alias("k")).where(F.col("k") >= least_groups).select("category_id")
    named = groups.join(enough, "category_id", "left_semi").groupBy("category_id", "merchant_id").agg(F.min("group").alias("group"))
    return rows.where("status <> 'confirmed'").join(named, ["category_id", "merchant_id"]).select("id", "category_id", F.concat_ws(".", "category_id", "group").alias("moved_to"))


def undone(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves that can be taken back: those whose rows are still where they were moved to and aren't confirmed."""
    return moves.join(rows.where("status <> 'confirmed'").select("id", F.col("category_id").alias("now")), "id").where("now = moved_to").select("id", "category_id")


def claimed(jobs: DataFrame, now) -> DataFrame:
    """The job to run next of each kind: the earliest that is due, where none of its kind and scope is running."""
    running = jobs.where("state = 'running'").select("kind", "scope").distinct()
    due = jobs.where((F.col("state") == "queued") & (F.col("run_after") <= F.lit(now))).join(running, ["kind", "scope"], "left_anti")
    return due.groupBy("kind").agg(F.min_by("id", F.struct("run_after", "id")).alias("id"))
