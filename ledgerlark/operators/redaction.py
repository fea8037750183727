"""Personal data in the lines of a text: found, replaced by tokens that stay the same through the text, and put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENSITIVE, iban_valid
from ..shared import dealt
from . import names

#: Kinds that are hidden, in the order in which they're tried at a place; cards and IBANs only if their check digits are right.
KINDS = ("card", "iban", "email", "sort_code", "national_insurance", "phone", "account", "postcode")
#: Cards in four groups of four by one dot, slash or underscore; 2-2-2 digits before an account number.
MARKED_CARD = "|".join(rf"(?<!\d)\d{{4}}(?:{mark}\d{{4}}){{3}}(?:{mark}\d{{3}})?(?!\d)" for mark in ("[.]", "/", "_"))
_THEN_ACCOUNT = r"(?=[ ,;/&+|-]{1,3}\d{8}(?!\d))"
PAIRED_CODE = rf"(?<!\d)\d{{2}} \d{{2}} \d{{2}}{_THEN_ACCOUNT}"
PATTERNS = SENSITIVE | {"card": rf"{MARKED_CARD}|(?!\d{{2}}[ -]\d{{2}}[ -]\d{{2}}{_THEN_ACCOUNT}){SENSITIVE['card']}", "sort_code": f"{SENSITIVE['sort_code']}|{PAIRED_CODE}"}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
TOKEN = r"\[(?:(?:" + "|".join(k.upper() for k in KINDS) + r")_\d+|(?:ADULT_[A-Z]|(?:CHILD|DEPENDANT)_\d+)(?:_\d+)?)\]"


def kind_of(value: Column) -> Column:
    """The kind of a found value, or null if its check digits are wrong."""
    bare = F.regexp_replace(value, r"[ -]", "")
    valid = {"card": value.rlike(f"^(?:{MARKED_CARD})$") | F.call_function("luhn_check", bare), "iban": iban_valid(value)}
    # a code that is told by the account number after it no longer has that
    whole = lambda k: value.rlike(f"^(?:{PATTERNS[k]}{r'|[0-9]{2} [0-9]{2} [0-9]{2}' if k == 'sort_code' else ''})$")
    # an account number is told by the words before it, which a found value no longer has
    looks = {k: whole(k) & valid.get(k, F.lit(True)) for k in KINDS if k != "account"}
    return F.coalesce(*[F.when(looks[k], F.lit(k)) for k in looks], F.when(value.rlike(r"^\d{6,10}$"), F.lit("account")))


def redacted(lines: DataFrame, key: str, pos: str = "pos", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """lines with personal data replaced by [KIND_n], and the mapping key, kind, value, token, shown.

    n counts a text's different values of a kind by first occurrence; values that differ in case, spaces or hyphens only
    are one, and shown is how it first stood. One pass finds all kinds; the mapping is joined back once.
    """
    lines = dealt(lines, key)
    normal = lambda v: F.upper(F.regexp_replace(v, r"[\s-]", ""))
    found = lines.select(key, pos, F.posexplode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("at", "shown")).withColumn("kind", kind_of(F.col("shown"))).where("kind is not null")
    first = found.groupBy(key, "kind", normal(F.col("shown")).alias("value")).agg(F.min(F.struct(pos, "at", "shown")).alias("seen"))
    n = F.row_number().over(Window.partitionBy(key, "kind").orderBy("seen"))
    mapping = first.select(key, "kind", "value", F.concat(F.lit("["), F.upper("kind"), F.lit("_"), n.cast("string"), F.lit("]")).alias("token"), F.col("seen.shown").alias("shown"))
    tokens = mapping.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "value"), "token"))).alias("__tokens"))
    values, gaps = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    stand_in = lambda v: F.coalesce(F.try_element_at("__tokens", F.concat_ws(":", kind_of(v), normal(v))), v)
    shown = F.array_join(F.zip_with(gaps, F.concat(F.transform(values, stand_in), F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
    hidden = lines.join(tokens, key, "left").withColumn(text, F.when(F.col("__tokens").isNotNull() & F.col(text).rlike(ANY), shown).otherwise(F.col(text)))
    return hidden.drop("__tokens"), mapping


def put_back(texts: DataFrame, mapping: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts with the tokens of their key replaced by how the value first stood; tokens that weren't given out stay."""
    shown = mapping.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "shown"))).alias("__shown"))
    tokens, gaps = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    own = F.array_join(F.zip_with(gaps, F.concat(F.transform(tokens, lambda t: F.coalesce(F.try_element_at("__shown", t), t)), F.array(F.lit(""))), lambda g, t: F.concat(g, t)), "")
    return texts.join(shown, key, "left").withColumn(text, F.when(F.col("__shown").isNotNull(), own).otherwise(F.col(text))).drop("__shown")


def pseudonymised(lines: DataFrame, people: DataFrame, key: str, pos: str = "pos", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """lines with numbers, then names, replaced, and the mapping of both; put_back() undoes it."""
    hidden, numbers = redacted(lines, key, pos, text)
    hidden, named = names.replaced(hidden, people, key, pos, text)
    return hidden, numbers.unionByName(named)
