"""Money as integer pence: reading, signs and printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = r"[+\-−–]"
#: One printed figure: brackets, signs before or after, a currency, thousands commas, CR or DR.
PRINTED = (
    rf"(?i)^(?:(\()\s*)?(?:({_SIGN})\s*)?(?:(?:GBP|[£$€])\s*)?(?:({_SIGN})\s*)?"
    rf"(\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.(\d{{1,2}}))?(?:\s*(\)))?(?:\s*({_SIGN}))?(?:\s*(CR|DR))?\.?$"
)
#: Whole pounds of over this many characters are a reference, not money.
LONGEST = 20
MOST_POUNDS = 1_000_000_000


def _group(text: Column, k: int) -> Column:
    return F.regexp_extract(text, PRINTED, k)


def printed_pence(raw: Column) -> Column:
    """Pence of a printed figure, negative for a minus, brackets or DR; null if it isn't one figure."""
    text = F.trim(F.regexp_replace(raw, " ", " "))
    whole = F.regexp_replace(_group(text, 4), ",", "")
    pence = (whole.try_cast("decimal(20,0)") * 100 + F.rpad(_group(text, 5), 2, "0").cast("decimal(2,0)")).cast("bigint")
    minus = lambda k: ~_group(text, k).isin("", "+")
    negative = minus(2) | minus(3) | minus(7) | (_group(text, 1) == "(") | (F.upper(_group(text, 8)) == "DR")
    valid = text.rlike(PRINTED) & ((_group(text, 1) == "") == (_group(text, 6) == "")) & (F.length(_group(text, 4)) <= LONGEST)
    return F.when(valid, F.when(negative, -pence).otherwise(pence))


def direction(raw: Column) -> Column:
    """-1 for a cell that marks money out, 1 for money in, else null."""
    text = F.lower(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"\.+$", ""))
    return F.when(text.isin("dr", "d", "debit"), F.lit(-1)).when(text.isin("cr", "c", "credit"), F.lit(1))


def has_printed_sign(raw: Column) -> Column:
    return F.trim(raw).rlike(r"(?i)[-+−–(]|\b(?:CR|DR)\.?\s*$")


def has_credit_marker(raw: Column) -> Column:
    return F.trim(raw).rlike(r"(?i)\bCR\.?\s*$")


TYPED = r"^(-?)\s*£?\s*([1-9]\d{0,2}(?:,\d{3})+|\d+)(?:\.(\d{1,2}))?$"


def typed_amount(raw: Column, negative: bool = False) -> Column:
    """Strict reading of typed pounds: struct of pence and problem ("not an amount", "negative" unless that is allowed,
    "too large"), of which one is null. Over 32 characters, or a null, is no amount."""
    text = F.trim(raw)
    whole = F.regexp_replace(F.regexp_extract(text, TYPED, 2), ",", "").try_cast("decimal(30,0)")
    pence = whole * 100 + F.rpad(F.regexp_extract(text, TYPED, 3), 2, "0").cast("decimal(2,0)")
    minus = F.regexp_extract(text, TYPED, 1) == "-"
    valid = F.coalesce((F.length(raw) <= 32) & text.rlike(TYPED), F.lit(False))
    problem = F.when(~valid, "not an amount").when(minus & F.lit(not negative), "negative").when(pence > MOST_POUNDS * 100, "too large")
    return F.struct(F.when(problem.isNull(), F.when(minus, -pence).otherwise(pence).cast("bigint")).alias("pence"), problem.alias("problem"))


def typed_pence(raw: Column) -> Column:
    """Pence of typed pounds, with a minus or without; null if they can't be read."""
    return typed_amount(raw, True)["pence"]


def pounds(pence: Column) -> Column:
    """-1205 -> -12.05"""
    size = F.abs(pence)
    return F.concat(F.when(pence < 0, "-").otherwise(""), F.floor(size / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


#: A figure with pence, its sign and brackets, none of it part of a longer number.
FIGURE = r"[-−–(]?[£$€]?(?<![\d.,])(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}(?![\d.,]?\d)(?:\)|[-−](?![A-Za-z0-9]))?"


def printed_figures(text: Column) -> Column:
    """All figures with pence printed in a text: array of (start, end, pence, negative), the sign or brackets outside
    of start and end, which count code points, end exclusive."""
    shown, gaps = F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0)), F.split(text, FIGURE, -1)
    none = F.array().cast("array<struct<start:int,end:int,pence:bigint,negative:boolean>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def put(state: Column, pair: Column) -> Column:
        raw = pair["shown"]
        number = F.regexp_extract(raw, r"[\d,.]*\d", 0)
        lead = F.length(F.regexp_extract(raw, r"^[^\d]*", 0))
        begin = state["at"] + F.length(pair["gap"])
        negative = raw.rlike(r"^[-−–]|^\(.*\)$|[-−]$")
        figure = F.struct((begin + lead).cast("int").alias("start"), (begin + lead + F.length(number)).cast("int").alias("end"), F.regexp_replace(number, "[,.]", "").try_cast("bigint").alias("pence"), negative.alias("negative"))
        return F.struct((begin + F.length(raw)).cast("int").alias("at"), F.concat(state["found"], F.array(figure)).alias("found"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(shown)), shown, lambda g, m: F.struct(g.alias("gap"), m.alias("shown")))
    return F.aggregate(pairs, start, put, lambda s: s["found"])


def figures(text: Column) -> Column:
    """Pence of all figures printed in a text, without their signs."""
    return F.transform(printed_figures(text), lambda f: f["pence"])


def priced(input_tokens: Column, output_tokens: Column, input_price, output_price, rate=1.0) -> Column:
    """Cost of tokens at prices a million, in pounds; a missing price counts as 5 and 15 dollars."""
    p_in, p_out = F.coalesce(input_price, F.lit(5.0)), F.coalesce(output_price, F.lit(15.0))
    return (input_tokens * p_in + output_tokens * p_out) / F.lit(1_000_000) * F.lit(rate)
