"""Operators over the lines of statements: rows, blocks, facts, evidence, stand-ins for names and numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import printed_date
from ..functions.money import figures, printed_pence
from ..functions.text import first_json

MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
DATE = rf"(?i)\b(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH})\b"
MONEY = r"(?<![\d.,])(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}(?![\d.,]?\d)"
SUMMARY = r"(?i)\b(?:balance|limit|payment due|minimum|total|brought forward|carried forward)\b"
#: Rows of a run are at most so many lines apart.
RUN_GAP = 2


def is_row(text: Column) -> Column:
    """A line with a date and an amount that isn't a summary."""
    return text.rlike(DATE) & text.rlike(MONEY) & ~text.rlike(SUMMARY)


def table_starts(lines: DataFrame, key: str, heading: Column) -> DataFrame:
    """Per text the line at which its transactions start: the heading row, else the first of two rows
    RUN_GAP apart, else the first row. Columns pos and text."""
    by = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("__row", is_row(F.col("text"))).withColumn("__head", heading)
    only = rows.where(F.col("__row") | F.col("__head")).withColumn("__next", F.lead(F.when(F.col("__row"), F.col("pos"))).over(by))
    run = F.col("__row") & (F.col("__next") - F.col("pos") <= RUN_GAP)
    return only.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("__head"), F.col("pos"))), F.min(F.when(run, F.col("pos"))), F.min(F.when(F.col("__row"), F.col("pos")))).alias("start"))


def edge_repeats(lines: DataFrame, key: str, page: str, top: int = 4, bottom: int = 3) -> DataFrame:
    """key, line and pages: lines among the first and last of a page, with numbers folded, that stand so on two pages or more.

    lines: key, page, pos, text; blank ones don't count as lines.
    """
    folded = F.regexp_replace(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), r"\d+", "#")
    own = lines.withColumn("line", folded).where("line <> ''")
    by = Window.partitionBy(key, page)
    placed = own.withColumn("__down", F.row_number().over(by.orderBy("pos"))).withColumn("__up", F.row_number().over(by.orderBy(F.desc("pos"))))
    edge = placed.where((F.col("__down") <= top) | (F.col("__up") <= bottom)).select(key, page, "line").distinct()
    return edge.groupBy(key, "line").agg(F.count("*").alias("pages")).where("pages >= 2")


def chunk_plan(lines: DataFrame, key: str, size: int, heading: Column) -> DataFrame:
    """lines (key, pos, text) with chunk (from 0, of size lines) and context: the last heading before the chunk's first line."""
    by = Window.partitionBy(key).orderBy("pos")
    numbered = lines.withColumn("__n", F.row_number().over(by) - 1).withColumn("chunk", F.floor(F.col("__n") / size).cast("int"))
    before = F.last(F.when(heading, F.col("text")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    seen = numbered.withColumn("__before", F.when(F.col("__n") % size == 0, before))
    return seen.withColumn("context", F.max("__before").over(Window.partitionBy(key, "chunk"))).drop("__n", "__before")


def blocks(lines: DataFrame, key: str, member: Column, part: Column, plain: Column) -> DataFrame:
    """Runs of member lines that hold a part, or are three or more plain lines: key, first, last."""
    by = Window.partitionBy(key).orderBy("pos")
    marked = lines.select(key, "pos", member.alias("member"), part.alias("part"), plain.alias("plain")).withColumn("run", F.sum((~F.col("member")).cast("int")).over(by))
    grouped = marked.where("member").groupBy(key, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"), F.bool_or("part").alias("has_part"), F.bool_and("plain").alias("all_plain"))
    return grouped.where("has_part OR (n >= 3 AND all_plain)").select(key, "first", "last")


def header_facts(text: Column) -> Column:
    """last4 (if one number is named), opening and closing pence, whether it reads like a card's or a bank account's
    statement, and the period that it names."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:account|card)\s*(?:number|no\.?|ending(?: in)?)\s*:?\s*([\dxX* -]{4,23}\d)"), F.lit(1)), lambda n: F.right(F.regexp_replace(n, r"\D", ""), F.lit(4))))
    money = lambda label: printed_pence(F.regexp_extract(text, rf"(?i)(?:{label})\s*(?:balance)?\s*:?\s*(-?£?[\d,]+\.\d{{2}}(?:\s*(?:CR|DR))?)", 1))
    day = rf"(\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}\s+\d{{2,4}})"
    period = lambda k: printed_date(F.nullif(F.regexp_extract(text, rf"(?i)\b(?:period|from)\s*:?\s*{day}\s*(?:to|until|-|–)\s*{day}", k), F.lit("")))
    debit = text.rlike(r"(?i)\b(sort code|overdraft|account statement|current account)\b")
    return F.struct(
        F.when(F.size(found) == 1, found[0]).alias("last4"), money("opening|previous").alias("opening_pence"), money("(?:closing|new)").alias("closing_pence"),
        text.rlike(r"(?i)\b(credit limit|minimum payment|card number)\b").alias("card"), debit.alias("debit"), period(1).alias("period_start"), period(2).alias("period_end"),
    )


def evidence(text: Column, pence: Column) -> Column:
    """Whether the row's size is among the figures printed on its line."""
    return F.array_contains(figures(text), F.abs(pence))


def household_sign_wrong(text: Column, pence: Column) -> Column:
    """A printed minus, trailing minus, brackets or DR with an amount that isn't negative."""
    return text.rlike(rf"(?i)(?:[-−–]\s*£?\s*{MONEY}|\(\s*£?{MONEY}\s*\)|{MONEY}\s*(?:[-−–]|DR\b))") & (pence >= 0)


def sort_codes(text: Column) -> Column:
    """2-2-2 groups, but for those that read as a day and month set apart by equal spaces or dots."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{2}[ ./-]\d{2}[ ./-]\d{2})(?!\d)"), F.lit(1))
    same = lambda c: F.substring(c, 3, 1) == F.substring(c, 6, 1)
    day = lambda c: F.substring(c, 1, 2).cast("int").between(1, 31) & F.substring(c, 4, 2).cast("int").between(1, 12)
    return F.filter(found, lambda c: ~(same(c) & F.substring(c, 3, 1).isin(" ", ".") & day(c)))


def look_alikes(text: Column) -> Column:
    """Letters that stand for digits, read as digits within words that are half digits already."""
    half = lambda w: 2 * F.length(F.regexp_replace(w, r"\D", "")) >= F.length(w)
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when((w != "") & half(w), F.translate(w, "OoSslI|BZz", "0055111822")).otherwise(w)), " ")


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """NFKC without invisible and combining marks; quotes and dashes in one form. No built-in does NFKC."""

    def one(t):
        if t is None:
            return None
        kept = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) not in ("Cf", "Mn", "Me"))
        return kept.translate(str.maketrans("‘’ʼ“”‐‑‒–—−", "'''\"\"------"))

    return texts.map(one)


def stand_ins(lines: DataFrame, key: str, pattern: str, kind: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """lines with each value of a pattern replaced by KIND_n, and the mapping (key, value, token).

    n counts a text's distinct values by first occurrence; equal values (spaces and case apart) share one.
    """
    normal = lambda v: F.upper(F.regexp_replace(v, r"\s", ""))
    found = lines.select(key, "pos", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("at", "value")).select(key, "pos", "at", normal(F.col("value")).alias("value"))
    first = found.groupBy(key, "value").agg(F.min(F.struct("pos", "at")).alias("seen"))
    mapping = first.withColumn("token", F.concat(F.lit(f"{kind}_"), F.row_number().over(Window.partitionBy(key).orderBy("seen")).cast("string"))).select(key, "value", "token")
    tokens = mapping.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("value", "token"))).alias("tokens"))
    joined = lines.join(tokens, key, "left")
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    shown = F.array_join(F.zip_with(gaps, F.concat(F.transform(values, lambda v: F.coalesce(F.try_element_at("tokens", normal(v)), v)), F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
    return joined.withColumn(text, F.when(F.size(values) > 0, shown).otherwise(F.col(text))).drop("tokens"), mapping


def restored(text: Column, hidden: Column) -> Column:
    """A text with its placeholders (keys of a map) put back."""
    return F.aggregate(F.map_entries(hidden), text, lambda s, e: F.replace(s, e["key"], e["value"]))


def reply_rows(replies: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows of an external reader's JSON reply with outcome and reason: unreadable rows are told, not dropped."""
    shape = "array<struct<ref:string,date:string,amount:string,description:string>>"
    rows = replies.select(key, F.explode(F.from_json(first_json(F.col(text), ("[",)).cast("string"), shape)).alias("r"))
    pence, day = printed_pence(F.col("r.amount")), F.try_to_timestamp("r.date", F.lit("yyyy-MM-dd")).cast("date")
    reason = F.when(F.col("r.ref").isNull(), "no ref").when(day.isNull(), "no date").when(pence.isNull(), "no amount").when(pence == 0, "zero amount")
    return rows.select(key, F.col("r.ref").alias("ref"), day.alias("date"), pence.alias("amount_pence"), F.col("r.description").alias("description"), reason.alias("reason"))


def rows_from_boxes(boxes: DataFrame, page: str, gap_factor: float = 1.8) -> DataFrame:
    """page, row and text of boxes (left, right, top, bottom, text): a box is on the row of those above it if its centre
    lies within half the row's tallest height of the row's mean centre. Wide gaps become three spaces, others one.

    Which row a box is on depends on all boxes before it, so a page's centres are folded in order; texts, gaps and
    widths are windows over rows. Boxes of one centre, or one left edge, are in order of their other edges and text.
    """
    centre, height = (F.col("top") + F.col("bottom")) / 2, F.col("bottom") - F.col("top")
    own = boxes.select(page, F.struct(centre.alias("centre"), height.alias("height"), "left", "right", "text").alias("box"))
    none = F.array().cast("array<struct<row:int,n:int,total:double,tallest:double>>")

    def put(rows: Column, b: Column) -> Column:
        last = F.try_element_at(rows, F.lit(-1))
        joins = (F.size(rows) > 0) & (F.abs(b["centre"] - last["total"] / last["n"]) <= last["tallest"] / 2)
        state = lambda row, n, total, tallest: F.struct(row.cast("int").alias("row"), n.cast("int").alias("n"), total.cast("double").alias("total"), tallest.cast("double").alias("tallest"))
        grown = state(last["row"], last["n"] + 1, last["total"] + b["centre"], F.greatest(last["tallest"], b["height"]))
        return F.concat(rows, F.array(F.when(joins, grown).otherwise(state(F.coalesce(last["row"], F.lit(-1)) + 1, F.lit(1), b["centre"], b["height"]))))

    pages = own.groupBy(page).agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    placed = pages.select(page, F.explode(F.arrays_zip("boxes", F.aggregate("boxes", none, put).alias("rows"))).alias("p")).select(page, "p.rows.row", "p.boxes.*")
    by = Window.partitionBy(page, "row")
    widths = F.array_sort(F.collect_list((F.col("right") - F.col("left")) / F.greatest(F.length("text"), F.lit(1))).over(by))
    gap = F.col("left") - F.lag("right").over(by.orderBy("left", "right", "text"))
    spaced = placed.withColumn("width", F.element_at(widths, (F.floor(F.size(widths) / 2) + 1).cast("int"))).withColumn("gap", gap)
    space = F.when(F.col("gap").isNull(), "").when(F.col("gap") > gap_factor * 1.5 * F.col("width"), "   ").otherwise(" ")
    joined = spaced.groupBy(page, "row").agg(F.array_sort(F.collect_list(F.struct("left", "right", F.col("text").alias("own"), F.concat(space, "text").alias("shown")))).alias("parts"))
    return joined.select(page, "row", F.trim(F.array_join(F.transform("parts", lambda x: x["shown"]), "")).alias("text"))
