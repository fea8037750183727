"""Rules: optional conditions, the most specific match, previews and their application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrase_in

SCHEMA = (
    "rule_id string, merchant_id bigint, phrase string, min_pence bigint, max_pence bigint, account_id bigint, direction string, "
    "date_from date, date_to date, who string, set_category_id string, source string, created int"
)
# What each condition adds to a rule's specificity.
WEIGHTS = {"merchant_id": 4, "phrase": 3, "account_id": 2, "min_pence": 2, "who": 1, "direction": 1, "date_from": 1}


def specificity(r: str = "") -> Column:
    present = {
        "min_pence": F.col(f"{r}min_pence").isNotNull() | F.col(f"{r}max_pence").isNotNull(),
        "date_from": F.col(f"{r}date_from").isNotNull() | F.col(f"{r}date_to").isNotNull(),
    }
    return sum((present.get(k, F.col(f"{r}{k}").isNotNull()).cast("int") * w for k, w in WEIGHTS.items()), F.lit(0))


def matches(r: str, t: str) -> Column:
    """Whether all conditions that a rule has hold; an absent condition holds, and an unknown value meets none."""
    rule, txn = (lambda c: F.col(f"{r}.{c}")), (lambda c: F.col(f"{t}.{c}"))
    same = lambda c: rule(c).isNull() | (rule(c) == txn(c))
    size = F.abs(txn("amount_pence"))
    found = same("merchant_id") & same("account_id") & same("who")
    found &= rule("min_pence").isNull() | (size >= rule("min_pence"))
    found &= rule("max_pence").isNull() | (size <= rule("max_pence"))
    found &= rule("direction").isNull() | ((rule("direction") == "in") == (txn("amount_pence") > 0))
    found &= rule("date_from").isNull() | (txn("date") >= rule("date_from"))
    found &= rule("date_to").isNull() | (txn("date") <= rule("date_to"))
    found &= rule("phrase").isNull() | phrase_in(rule("phrase"), txn("text"))
    return F.coalesce(found, F.lit(False))


#: Rules that a join may send to every task: some 3 MB. People write rules by the dozen.
MOST_BROADCAST = 10_000


def _keys(phrase: Column, account: Column) -> Column:
    """What a rule without a merchant is joined by: the first word of its phrase, else its account, else nothing."""
    word = F.regexp_extract(F.upper(F.coalesce(phrase, F.lit(""))), "[A-Z0-9]+", 0)
    return F.when(word != "", F.concat(F.lit("w:"), word)).when(phrase.isNull() & account.isNotNull(), F.concat(F.lit("a:"), account.cast("string")))


def best_rules(rows: DataFrame, rules: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """rows with the rule that files them: most specific, then people's own over seeds, then latest, then by id.

    Rules with a merchant meet rows by that merchant. The rest are counted: up to ``most`` are broadcast. Of more, those
    with a phrase meet rows by its first word, and those of an account by it; what has neither (a bare amount, date or
    direction) can meet any row, so the bounds that differ are counted once more, and joined by direction if they're many.
    """
    t = rows.alias("t")
    rank = F.struct(specificity("r.").alias("w"), (F.col("r.source") != "seed").alias("own"), F.col("r.created").alias("created"), F.col("r.rule_id").alias("rule_id"))
    keyed, loose = rules.where("merchant_id IS NOT NULL").alias("r"), rules.where("merchant_id IS NULL")
    joins = [t.join(keyed, (F.col("t.merchant_id") == F.col("r.merchant_id")) & matches("r", "t"))]
    if loose.count() <= most:
        joins.append(t.join(F.broadcast(loose.alias("r")), matches("r", "t")))
    else:
        told = loose.withColumn("key", _keys(F.col("phrase"), F.col("account_id")))
        words = F.transform(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z0-9]+"), F.lit(0))), lambda w: F.concat(F.lit("w:"), w))
        asked = rows.withColumn("key", F.explode(F.concat(F.coalesce(words, F.array().cast("array<string>")), F.array(F.concat(F.lit("a:"), F.col("account_id").cast("string")))))).alias("t")
        joins.append(asked.join(told.where("key IS NOT NULL").alias("r"), (F.col("t.key") == F.col("r.key")) & matches("r", "t")))
        bare = told.where("key IS NULL").drop("key")
        if bare.count() <= most:
            joins.append(t.join(F.broadcast(bare.alias("r")), matches("r", "t")))
        else:
            sides = bare.withColumn("side", F.explode(F.when(F.col("direction").isNull(), F.array(F.lit("in"), F.lit("out"))).otherwise(F.array("direction")))).alias("r")
            joins.append(t.join(sides, (F.col("r.side") == F.when(F.col("t.amount_pence") > 0, "in").otherwise("out")) & matches("r", "t")))
    found = reduce(DataFrame.unionByName, [m.select(F.col("t.id").alias("id"), rank.alias("rank"), F.col("r.set_category_id").alias("set_category_id")) for m in joins])
    return found.groupBy("id").agg(F.max_by(F.struct("rank.rule_id", "set_category_id"), "rank").alias("best")).select("id", "best.*")
