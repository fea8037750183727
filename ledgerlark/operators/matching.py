"""Matching one row to one other: exact and fuzzy de-duplication, transfer pairs, multisets.

Rows of one amount are put together by runs of days: rows further apart than the band can't meet, so a
common amount doesn't meet itself over all time, and a run in which one side is missing goes at once. Who gets
whom is then settled in the exact order that the semantics prescribe, over the run's rows by day; no pairs of
rows are written. Only transfers of one amount with very many rows in a run are settled over candidate pairs, in rounds.
"""

from __future__ import annotations

from functools import reduce
from heapq import merge
from itertools import chain, islice
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import description_tokens, fingerprint, normal_description, similar_tokens
from ..shared import cut, in_parts

#: Days that a transfer's halves, and a soft duplicate's dates, may be apart.
TRANSFER_DAYS, SOFT_DAYS = 3, 2
#: Candidates that a new row looks at in one pass; this is part of the semantics.
MOST_CANDIDATES = 32
#: Rows that Python hands back at once.
MOST_OUT = 10_000
#: Rows of one amount and run of days whose transfers are settled in one list; more are settled in rounds.
MOST_AT_ONCE = 20_000

# Words that tell a transfer, and words that tell against one.
TRANSFER_WORDS = ("TRANSFER", "TFR", "SAVINGS", "SAVER", "POT", "ISA", "OWN ACCOUNT", "INTERNAL", "PAYMENT RECEIVED", "THANK YOU", "CARD REPAYMENT", "MOBILE PAYMENT")
AGAINST_WORDS = ("REFUND", "REVERSAL", "CASHBACK")


def fingerprinted(rows: DataFrame, statement: str = "statement_id", pos: str = "pos") -> DataFrame:
    """rows with occurrence (of identical lines in a statement, from 0) and fingerprint."""
    by = Window.partitionBy(statement, "account_id", "date", "amount_pence", normal_description(F.col("raw_description"))).orderBy(pos)
    numbered = rows.withColumn("occurrence", F.row_number().over(by) - 1)
    return numbered.withColumn("fingerprint", fingerprint(F.col("account_id"), F.col("date"), F.col("amount_pence"), F.col("raw_description"), F.col("occurrence")))


def transfer_words(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(rf"\b{w}\b"), w) for w in TRANSFER_WORDS]))


def transfer_bits(text: Column) -> Column:
    """The transfer words of a text as bits, so that those of two texts are counted without reading either again."""
    return sum((F.when(text.rlike(rf"\b{w}\b"), 1 << i).otherwise(0) for i, w in enumerate(TRANSFER_WORDS)), F.lit(0))


def tells_against(text: Column) -> Column:
    return text.rlike(rf"\b({'|'.join(AGAINST_WORDS)})\b")


def pair_candidates(moves: DataFrame, days: int = TRANSFER_DAYS) -> DataFrame:
    """Opposite movements of one size on two accounts at most days apart, with what ranks them."""
    # all that is told of a text is told before rows meet
    side = lambda name, *more: moves.select(F.col("id").alias(f"{name}_id"), F.col("account_id").alias(f"{name}_account"), (F.col("account_kind") == "credit_card").alias(f"{name}_card"), transfer_bits(F.col("text")).alias(f"{name}_bits"), tells_against(F.col("text")).alias(f"{name}_against"), F.abs("amount_pence").alias("size"), *more)
    out = cut(side("out", F.col("date").alias("out_date"), "amount_pence").where("amount_pence < 0").drop("amount_pence"))
    out = out.withColumn("day", F.explode(F.sequence(F.date_sub("out_date", days), F.date_add("out_date", days))))
    into = cut(side("in", F.col("date").alias("day"), "amount_pence").where("amount_pence > 0").drop("amount_pence"))
    met = out.join(into.hint("merge"), ["size", "day"]).where("out_account <> in_account")
    words = F.bit_count(F.col("out_bits").bitwiseOR(F.col("in_bits")))
    return met.select("size", "out_id", "in_id", "out_date", F.abs(F.datediff("day", "out_date")).alias("gap"), words.alias("words"), (F.col("in_card") & ~F.col("out_card")).alias("card"), (F.col("out_against") | F.col("in_against")).alias("against"))


def pair_confidence() -> Column:
    return F.when(F.col("against"), 0.6).when(F.col("words") > 0, 0.99).when(F.col("card") | (F.col("gap") == 0), 0.75).otherwise(0.7)


def _paired(rows: list[dict], days: int) -> list[dict]:
    """Of one amount's rows, pairs in the order of gap, words, and the row out: each takes the first free row in by id.

    Rows in are kept by day and by the words that they hold, in order; a row out looks at the heads of the kinds that
    make the number of words in turn, so no pair is looked at twice.
    """
    kinds: dict[tuple, list[dict]] = {}
    for r in sorted((r for r in rows if not r["out"]), key=lambda r: r["id"]):
        kinds.setdefault((r["day"], r["words"]), []).append(r)
    by_day: dict[int, list[tuple[int, list[dict]]]] = {}
    for (day, words), own in kinds.items():
        by_day.setdefault(day, []).append((words, own))
    left = sorted((r for r in rows if r["out"]), key=lambda r: (r["day"], r["id"]))
    most = reduce(or_, (r["words"] for r in rows), 0).bit_count()
    pairs = []
    for gap in range(days + 1):
        for n in range(most, -1, -1):
            rest = []
            for r in left:
                best = None
                for day in {r["day"] - gap, r["day"] + gap}:
                    for words, own in by_day.get(day, ()):
                        if (words | r["words"]).bit_count() == n:
                            k = next((k for k, x in enumerate(own) if x["account"] != r["account"]), None)
                            if k is not None and (best is None or own[k]["id"] < best[0][best[1]]["id"]):
                                best = own, k
                if best is None:
                    rest.append(r)
                    continue
                into = best[0].pop(best[1])
                pairs.append({"out_id": r["id"], "in_id": into["id"], "gap": gap, "words": n, "card": into["card"] and not r["card"], "against": into["against"] or r["against"]})
            left = rest
    return pairs


def islands(rows: DataFrame, keys: list[str], day: str, apart: int) -> DataFrame:
    """rows with island: the first day (a number) of the run of days, none more than apart after the one before, that day is in.

    Runs are told from distinct days, so a key with many rows a day weighs no more than a calendar.
    """
    days = rows.select(*keys, day).distinct()
    by = Window.partitionBy(*keys).orderBy(day)
    starts = F.when(F.coalesce(F.col(day) - F.lag(day).over(by) > apart, F.lit(True)), F.col(day))
    return rows.join(days.withColumn("island", F.last(starts, ignorenulls=True).over(by)), [*keys, day])


def settled_in_rounds(edges: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """Edges taken greedily in order, each end once: in rounds, every edge that is the first of both its ends is taken,
    and the edges that share an end with it go. No list of a whole group is made; a round is written when it's done."""
    first = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(*order)) == 1
    taken: list[DataFrame] = []
    while True:
        ranked = edges.withColumn("__l", first(left)).withColumn("__r", first(right))
        taken.append(cut(ranked.where("__l and __r").drop("__l", "__r")))
        if taken[-1].isEmpty():
            return reduce(DataFrame.unionByName, taken)
        edges = cut(edges.join(taken[-1].select(left), left, "left_anti").join(taken[-1].select(right), right, "left_anti"))


def pair_transfers(moves: DataFrame, days: int = TRANSFER_DAYS, most: int = MOST_AT_ONCE) -> DataFrame:
    """Each movement in at most one pair: nearest first, then most words, then earliest, then by id.

    Settled by size of the amount and run of days; runs of up to most rows side by side in Arrow batches, larger ones (a
    round amount of very many accounts) over their candidate pairs, in rounds.
    """
    card, against = F.col("account_kind") == "credit_card", tells_against(F.col("text"))
    rows = moves.where("amount_pence <> 0").select(F.abs("amount_pence").alias("size"), F.unix_date("date").alias("day"), "id", F.col("account_id").alias("account"), card.alias("card"), (F.col("amount_pence") < 0).alias("out"), transfer_bits(F.col("text")).alias("words"), against.alias("against"))
    rows = islands(rows, ["size"], "day", days)
    sizes = cut(rows.groupBy("size", "island").agg(F.count("*").alias("n"), F.bool_or("out").alias("some_out"), F.bool_and("out").alias("all_out")).where("some_out AND NOT all_out").select("size", "island", "n"))
    placed = rows.join(sizes, ["size", "island"])
    shape = T.StructType([T.StructField(n, moves.schema["id"].dataType) for n in ("out_id", "in_id")]).add("gap", T.IntegerType()).add("words", T.IntegerType()).add("card", T.BooleanType()).add("against", T.BooleanType())
    schema = to_arrow_schema(shape)

    def run(batches):
        for batch in batches:  # a batch holds many lists, of which one at a time is made into Python's objects
            for some in in_parts((c for rows in batch.column(0) for c in _paired(rows.as_py(), days)), MOST_OUT):
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    row = F.struct("day", "id", "account", "card", "out", "words", "against")
    told = placed.where(F.col("n") <= most).groupBy("size", "island").agg(F.collect_list(row).alias("rows")).where(~_one_account()).select("rows").mapInArrow(run, shape)
    crowded = sizes.where(F.col("n") > most)
    if not crowded.isEmpty():
        many = moves.join(placed.where(F.col("n") > most).select("id"), "id", "left_semi")
        edges = cut(pair_candidates(many, days))
        told = told.unionByName(settled_in_rounds(edges, "out_id", "in_id", [F.col("gap"), F.col("words").desc(), F.col("out_date"), F.col("out_id"), F.col("in_id")]).select(*shape.names))
    return told.select("out_id", "in_id", "gap", "words", "card", pair_confidence().alias("confidence"))


def _one_account() -> Column:
    """Whether all rows of a list are of one account, so that none can pair."""
    return F.forall("rows", lambda r: r["account"] == F.col("rows")[0]["account"])


def soft_matches(new: DataFrame, stored: DataFrame, days: int = SOFT_DAYS) -> DataFrame:
    """new_id, stored_id, gap of soft duplicates: one amount, close days, similar descriptions, one to one.

    First pass same day, second pass up to days apart, nearest first; rows in their order (pos), stored
    ones in theirs. Candidates count towards MOST_CANDIDATES whether they're similar or not.
    """
    side = lambda df, is_new: df.select("account_id", "amount_pence", F.unix_date("date").alias("day"), F.lit(is_new).alias("is_new"), F.col("pos").cast("bigint").alias("pos"), F.col("id").cast("bigint").alias("id"), description_tokens(F.col("raw_description")).alias("tokens"))
    keys = ["account_id", "amount_pence"]
    rows = islands(side(new, True).unionByName(side(stored, False)), keys, "day", days)
    grouped = rows.groupBy(*keys, "island").agg(F.bool_or("is_new").alias("some"), F.bool_and("is_new").alias("all"), F.collect_list(F.struct("is_new", "day", "pos", "id", "tokens")).alias("rows")).where("some AND NOT all")
    shape = "new_id bigint, stored_id bigint, gap int"
    pick = lambda is_new: F.get(F.filter("rows", lambda r: r["is_new"] == is_new), 0)
    two = grouped.where(F.size("rows") == 2).select(pick(True).alias("n"), pick(False).alias("s"))
    alone = two.where(similar_tokens(F.col("n.tokens"), F.col("s.tokens")) & (F.abs(F.col("n.day") - F.col("s.day")) <= days)).select(F.col("n.id").alias("new_id"), F.col("s.id").alias("stored_id"), F.abs(F.col("n.day") - F.col("s.day")).alias("gap"))

    def run(batches):
        for batch in batches:
            found = [x for rows in batch.column(0) for x in _settle(rows.as_py(), days)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["new_id", "stored_id", "gap"])

    return alone.unionByName(grouped.where(F.size("rows") > 2).select("rows").mapInArrow(run, shape))


def _settle(rows: list[dict], days: int) -> list[tuple[int, int, int]]:
    """Soft matches among one amount's rows: each new row in its order takes its first similar free one of those stored.

    Free stored rows are kept by day, in order, and a row that is taken leaves its day; a new row walks the days around its own.
    """
    free: dict[int, list[tuple]] = {}
    for r in sorted((r for r in rows if not r["is_new"]), key=lambda r: (r["pos"], r["id"])):
        free.setdefault(r["day"], []).append((r["pos"], r["id"], r["day"], frozenset(r["tokens"])))
    waiting = sorted((r for r in rows if r["is_new"]), key=lambda r: (r["pos"], r["id"]))
    out = []
    for most in (0, days):
        left = []
        for r in waiting:
            near = chain.from_iterable(merge(*(free.get(day, ()) for day in {r["day"] - gap, r["day"] + gap})) for gap in range(most + 1))
            mine = frozenset(r["tokens"])
            first = next((s for s in islice(near, MOST_CANDIDATES) if _alike(mine, s[3])), None)
            if first is None:
                left.append(r)
                continue
            free[first[2]].remove(first)
            out.append((r["id"], first[1], abs(first[2] - r["day"])))
        waiting = left
    return out


def _alike(a: frozenset, b: frozenset) -> bool:
    """What similar_tokens() tells of columns."""
    both = len(a & b)
    return bool(a and b) and (both in (len(a), len(b)) or 2 * both >= len(a | b))


def dedupe_plan(new: DataFrame, stored: DataFrame) -> DataFrame:
    """id and match (exact, similar or new) of each new row; both sides have a fingerprint.

    Rows matched by fingerprint leave both sides before soft matching.
    """
    exact = new.join(stored.select("account_id", "fingerprint").distinct(), ["account_id", "fingerprint"], "left_semi").select("id")
    rest = new.join(exact, "id", "left_anti")
    free = stored.join(new.select("account_id", "fingerprint").distinct(), ["account_id", "fingerprint"], "left_anti")
    soft = soft_matches(rest, free)
    told = exact.select("id", F.lit("exact").alias("match")).unionByName(soft.select(F.col("new_id").alias("id"), F.lit("similar").alias("match")))
    return new.select("id").join(told, "id", "left").select("id", F.coalesce("match", F.lit("new")).alias("match"))


def multiset_matches(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that meet one to one: the k-th of a key's rows on one side meets the k-th on the other."""
    numbered = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    return numbered(expected).select(*keys, "k").join(numbered(got).select(*keys, "k"), [*keys, "k"])


def longest_prefixes(values: DataFrame, known: DataFrame, value: str, prefix: str) -> DataFrame:
    """value and the longest of known prefixes that it starts with, one row for each different value that has one.

    Beginnings are made of different values only, and of lengths that a known prefix has. There are many more of them than
    values, which the optimizer doesn't see, so they're joined by a shuffle. The result is written: it may be small.
    """
    lengths = known.agg(F.collect_set(F.length(prefix)).alias("__lengths"))
    own = values.select(value).where(F.col(value).isNotNull()).distinct().join(F.broadcast(lengths))  # one row: as many numbers as lengths
    begun = own.select(value, F.explode(F.filter("__lengths", lambda n: n <= F.length(value))).alias("__n")).withColumn(prefix, F.substring(value, 1, F.col("__n")))
    met = begun.join(known.select(prefix).distinct().hint("merge"), prefix)
    return cut(met.groupBy(value).agg(F.max_by(prefix, F.col("__n")).alias(prefix)))
