"""Personal and account details in statement lines: what kinds a line shows, and what of it may leave.

A line is read in one normal form (compatibility forms folded, invisible marks gone, one kind of dash and
apostrophe, single spaces), and patterns see it with accents folded, position by position. What is found is
a set of spans. Details are hidden but for the money and dates in them; numbers of six or more digits are
hidden however their groups are joined, in the line or over a line's end, unless they are an amount or the
line's own date. Sets of spans are united and taken from one another by a sweep (functions.spans).

It fails closed. A line is withheld (null) if it is a balance or only a holder's name, if a detail can't be told
from the money or date that it runs into, or if anything is still found in what would leave.

A null text has no kinds and leaves as null; an empty one stays. Lines are read in the order of ``pos`` within a
key; rows with equal pos follow one another in the order of their texts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S
from ..shared import dealt
from ..functions.text import squashed

# The patterns of labels and values, of money and dates that stay, and of what joins numbers.
_STREET = r"road|rd|street|st|lane|ln|avenue|ave|close|drive|way|gardens|court|place|terrace|crescent|square|hill|grove|mews|walk"
_BUILDING = r"house|cottage|court|lodge|mansions|building|hall|villas?|tower|heights|apartments|flats|farm|mill|manor|barn|mews"
_BALANCE_WORD = r"(?:your|available|current|account|cleared|running|opening|closing|new|previous|starting|ending|start|end|statement|outstanding|total|spending|actual)"
_BALANCE_LABEL = (
    rf"(?:{_BALANCE_WORD}\s+){{0,2}}(?:balance(?:\s+(?:after|owing|owed|outstanding|remaining|available))?|available(?:\s+(?:to\s+spend|credit|funds))?"
    r"|(?:arranged\s+)?overdraft\s+limit|arranged\s+overdraft|credit\s+limit|minimum\s+(?:payment|amount)(?:\s+due)?|(?:payment|amount)\s+due)"
)
_ON_DATE = r"(?:(?:on|at|as\s+(?:at|of)|of|by|for)\s+)?(?:\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\.?(?:\s+\d{2,4}\b)?|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\d{4}-\d{2}-\d{2}\b)"
_DATED_LABEL = r"(?:statement\s+date|(?:payment\s+)?due\s+date|date\s+due|payment\s+due|payment\s+date)"
_SIGN = r"[-+−–]"
_FIGURE = (
    rf"(?:\(\s*)?(?:{_SIGN}\s*)?(?:(?:[£$€]|GBP\b)\s*)?(?:{_SIGN}\s*)?(?>\d{{1,3}}(?:[,  ]\d{{3}})+|\d+)(?:\.\d{{2}})?(?:\s*\))?(?:\s*GBP\b)?"
    r"(?:\s*[-−](?!\d))?(?:\s*(?:CR|DR|O/D|OD|D|in\s+credit|overdrawn)\b)?(?:\.|\s*\*)?"
)
_BALANCE_ITEM = rf"(?:{_BALANCE_LABEL}(?:\s+{_ON_DATE})?\s*(?::\s*)?{_FIGURE}|{_FIGURE}\s+{_BALANCE_LABEL}|{_DATED_LABEL}\s*(?::\s*)?{_ON_DATE})"
BALANCE_LINE = rf"(?i)^\s*{_BALANCE_ITEM}(?:\s*(?:[|·•,;/:]\s*)?{_BALANCE_ITEM}){{0,2}}\s*$"
LABELS = {
    "account_label": r"(?i)\b(?:account|acct?|a/c)\.?\s*(?:no\.?|num(?:ber)?|name|holders?|type)\b",
    "customer_label": r"(?i)\b(?:customer|membership|roll)\s*(?:no\.?|num(?:ber)?|id|ref(?:erence)?)\b",
    "sort_code_label": r"(?i)\bsort\s*code\b",
    "card_label": r"(?i)\bcard\s+(?:ending|number|no\.?)\b",
    "bank_code_label": r"(?i)\biban\b|\bbic\b",
    "holder_label": r"(?i)^\s*holder\b|\bname\s*:|\bjoint\s+account\s*:",
}
VALUES = {
    "account_number": r"(?i)(?<![\w/])(?:account|acct?|ac|a/c|s/c|s\.c\.|sc)\.?\s*(?::\s*)?(?:#\s*)?(?:[-−–]\s*)?\d[\d -]{3,}\d",
    "sort_code": r"\b\d{2}-\d{2}-\d{2}\b",
    "card_number": r"\b(?:\d[ -]?){12,18}\d\b|\b\d{4}(?:[ -]{1,3}\d{4}){3}\b",
    "card_ending": (
        r"(?i)\bending\s+(?:in\s+)?\d{3,4}\b|(?<!\*)\*{2,}[\s-]*\d{2,4}|(?<![a-z])x{2,}[\s-]*\d{4}\b|\bending(?:\s*in)?\s*\d{4}(?!\d)|(?<![\w*])\*\s?\d{4}(?!\d)"
        r"|(?<![a-z0-9])x\s?\d{4}(?!\d)|\bending(?:\s*in)?\s*[:#\-]\s*\d{3,4}(?!\d)|\bcard\s*[:#]\s*\d{4}(?!\d)"
        r"|(?<![a-z0-9])ending(?:[\s_]{0,3}(?:in|with))?[\s_]{0,3}(?:[:#\-][\s_]{0,3})?\d{3,4}(?!\d)|(?<![a-z0-9])card_{1,3}\d{4}(?!\d)"
        r"|\b\d{4}[\s-]*(?:[*•●·∙◦∗]{2,}|[xX]{4})|(?<![•●·∙◦∗])[•●·∙◦∗]{2,}[\s-]*\d{2,4}(?![.,]?\d)|(?<![.…])(?:…|\.{3,})\s*\d{4}(?![.,]?\d)"
    ),
    "swift_code": r"\b(?i:swift)(?:\s+(?i:code))?\s*(?::\s*)?[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "iban": r"(?i)(?:\b|(?<=iban))[A-Z]{2}\d{2}\s?[A-Z0-9]{4}(?:\s?\d{4}){2,}(?:\s?[A-Z0-9]{1,4})?\b",
    "postcode": r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b",
    "address": rf"(?i)(?<![\d/.-])\d{{1,3}}[a-z]?,?\s+(?:[A-Za-z']+\s+){{1,2}}(?:{_STREET})\b|\b(?:flat|apartment|apt|unit|suite)\.?\s+\d{{1,4}}[a-z]?\b(?![.,]\d)(?:,?\s+(?:[A-Za-z']+\s+){{0,2}}(?:{_BUILDING}|{_STREET})\b)?",
    "email": r"(?i)(?<![\w.+\-])[\w.+\-]++@[\w\-]+(?:\.[\w\-]+)+",
    "holder_name": r"(?i)^\s*(?:mr|mrs|ms|miss|mx|dr|prof)\.?\s+(?:&\s*(?:mr|mrs|ms|miss|mx|dr)\.?\s+)?(?!(?:amount|amt|total|value|balance|debit|credit|cr|dr|ref)\b)[A-Za-z]|(?i)^\s*(?:statement|prepared)\s+for\b",
    "balance_line": BALANCE_LINE,
}
SPELLED_SORT_CODE = r"(?<![\d.,:/£$])\d{2}[ .\-–—·_]\d{2}[ .\-–—·_]\d{2}(?![\d,:/]|\.\d)"
KEEP_MONEY = (
    r"(?<![\w.])(?:(?<!\d,)|(?!\d{3},))[-+−]?[£$€]?\d{1,3}(?:,\d{3})*\.\d{2}(?!\d|\.\d)|(?<![\w.])[-+−]?[£$€]\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?(?![\d,])"
    r"|(?<![\w.,])[-+−]?\d{4,5}\.\d{2}(?!\d|[.,]\d)"
)
WELL_FORMED = r"(?<![\d,])(?<!\d\.)(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}(?!\d|[.,]\d)"
KEEP_DATE = r"(?i)\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b\.?(?:\s+\d{4}\b)?"
GROUP_LABEL = r"(?i)(?<![A-Za-z0-9])(?:ending(?:[\s_]{1,3}(?:in|with))?|card(?:\s+(?:no|number))?|acc(?:t|ount)?(?:\s+(?:no|number))?|a/c(?:\s+no)?|no)(?![A-Za-z0-9])\.?"
MASK_MARKS = "*•●·∙◦∗…"
LOOK_ALIKES, AS_DIGITS = "OoSslI|BZz", "0055111822"
LONG_NUMBER, MOST_JOIN, JOINED_TO_DATE = 6, 3, 4

#: Kinds whose digits a scan may have misread.
NUMBERS = ("account_number", "sort_code", "card_number", "card_ending")
_SEPARATOR = r"[\p{P}\p{S}\p{Z}]"
#: Digits and up to three separators before each of the next ones.
GROUP = rf"\d(?:{_SEPARATOR}{{0,{MOST_JOIN}}}\d)*"
_JOINED = lambda n: rf"{_SEPARATOR}{{1,{MOST_JOIN}}}\d(?:{_SEPARATOR}{{0,{MOST_JOIN}}}\d){{{n - 1}}}"
_DAY, _MONTH_NO = r"(?:3[01]|[12]\d|0?[1-9])", r"(?:1[0-2]|0?[1-9])"
_SHORT_DATE = rf"{_DAY}([/. \-]){_MONTH_NO}\{{g}}\d{{2}}(?!\d)"
_NUMERIC_DATE = rf"{_DAY}([/. \-]){_MONTH_NO}\{{g}}\d{{4}}(?!\d)|(?:19[5-9]\d|20\d\d)-{_MONTH_NO}-{_DAY}(?!\d)"
_NAMED = rf"{_DAY}(?:st|nd|rd|th)?[ \-]?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"


def _dates(group: int, stands: bool) -> str:
    """A date as rows have them; with a year of two digits, only if no number of four or more digits is joined to it, where that's asked."""
    year = rf"(?:[ \-]?(?:\d{{2}}(?!\d)|(?:199\d|20\d\d)(?!\d)(?:(?!{_JOINED(1)})|(?=.{_NAMED}|.{_DAY}[/. \-]{_MONTH_NO}[/. \-]\d\d))))?"
    short = _SHORT_DATE.replace("{g}", str(group + 1)) + (rf"(?!{_JOINED(JOINED_TO_DATE)})" if stands else "")
    return rf"(?:{_NUMERIC_DATE.replace('{g}', str(group))}|{short}|{_NAMED}{year})"


#: The line's own date at its start and a posting date after it.
OWN_DATE = rf"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?\s+)?(?:{_dates(1, False)} {_dates(3, True)}|{_dates(5, False)}(?= {_dates(7, False)})|{_dates(9, True)})"
_FIGURE_END = r"(?: (?:(?i:cr|dr|od)|[(+\-]*(?:[£$€]+\d[\d,]*(?:\.\d{2})?|\d[\d,]*\.\d{2})[)\-]*))+$"
#: A token that gives a value, and one of a name.
_VALUE_TOKENS = rf"((?:[\s:#.]*(?=\S*[\d{MASK_MARKS}])[\p{{L}}\p{{N}}{MASK_MARKS}./,\-]+(?=\s|$))*)"
_NAME_TOKENS = r"(?:[\s:#.]*[A-Za-z&'.\-]+(?=\s|$))*"
#: Stand for characters of money and dates, and for hidden ones: no text in normal form has them.
KEPT, HIDDEN, BREAK = "\x02", "\x01", "\x03"
_RUNS = rf"{HIDDEN}+(?:\s+{HIDDEN}+)*"
MOST_HIDDEN = 26 + 26**2
#: Two-digit years from here on belong to the 1900s.
PIVOT = 69


@F.pandas_udf(T.StructType([T.StructField("normal", T.StringType()), T.StructField("seen", T.StringType())]))
def _folded(texts: pd.Series) -> pd.DataFrame:
    """The normal form of texts beyond ASCII, and the same with accents and digits folded; no built-in does it."""
    unify = str.maketrans("‘’ʼ‛‐‑‒–—―−﹘﹣", "''''---------")

    def base(c: str) -> str:
        if unicodedata.category(c) == "Nd":
            return str(unicodedata.digit(c))
        split = unicodedata.normalize("NFKD", c)
        return split[0] if len(split) > 1 and all(map(unicodedata.combining, split[1:])) else c

    def one(t: str) -> tuple[str, str]:
        kept = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) not in ("Cf", "Mn", "Me"))
        normal = " ".join(kept.translate(unify).split())
        return normal, "".join(map(base, normal))

    rows = [(None, None) if t is None else one(t) for t in texts]
    return pd.DataFrame(rows, columns=["normal", "seen"])


def read(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with normal and seen, the forms in which a text is kept and looked at."""
    plain = F.col(text).rlike(r"^[\x00-\x7F]*$")
    bare = squashed(F.translate(text, "\x00\x01\x02\x03\x1c\x1d\x1e\x1f", "    "))
    own = lines.withColumn("__folded", _folded(F.when(~plain, F.translate(text, "\x00\x01\x02\x03", ""))))
    return own.withColumn("normal", F.when(plain, bare).otherwise(F.col("__folded.normal"))).withColumn("seen", F.when(plain, bare).otherwise(F.col("__folded.seen"))).drop("__folded")


_lit = S.raw


def _found(text: str, pattern: str, tail: bool = False) -> str:
    return S.found(text, _lit(pattern), tail, mark=BREAK)


def look_alikes_read(seen: str) -> str:
    """Letters that a scan reads for digits, as digits, in parts of a word that are at least half digits; as long as before."""
    piece = _lit(rf"(?:\d|(?<![A-Za-z|])(?:[{LOOK_ALIKES}]+|[A-Za-z|])(?![A-Za-z|]))+")
    told = S.each(f"regexp_extract_all({seen}, {piece}, 0)", lambda m: f"IF(2 * length(regexp_replace({m}, {_lit(r'[^0-9]')}, '')) >= length({m}), translate({m}, '{LOOK_ALIKES}', '{AS_DIGITS}'), {m})")
    read = f"array_join(zip_with(split(regexp_replace({seen}, {piece}, '{BREAK}'), '{BREAK}', -1), concat({told}, array('')), (a, b) -> concat(a, b)), '')"
    return f"IF(rlike({seen}, {_lit(rf'[0-9][{LOOK_ALIKES}]|[{LOOK_ALIKES}][0-9]')}), {read}, {seen})"


def without_money_and_own_date(view: str) -> str:
    """A line with its amounts, and the date at its start, painted over."""
    bare = S.painted(view, S.union(_found(view, KEEP_MONEY), _found(view, WELL_FORMED)), KEPT)
    return S.let(bare, lambda t: S.let(f"length(regexp_extract({t}, {_lit(OWN_DATE)}, 0))", lambda n: f"concat(repeat('{KEPT}', {n}), substring({t}, {n} + 1, length({t})))"))


def groups(bare: str) -> str:
    """Numbers whose digits are joined by at most three separators: array of (start, end, digits)."""
    digits = lambda s: f"length(regexp_replace({S.part(bare, s)}, {_lit(r'[^0-9]')}, ''))"
    return S.each(_found(bare, GROUP), lambda s: f"named_struct('start', {s}.start, 'end', {s}.end, 'digits', {digits(s)})")


def numbers(bare: str, own: str) -> str:
    """Spans of long numbers and of the digits after a card or account label. own: groups(bare)."""
    long = S.each(S.each(own, lambda g: f"{g}.digits >= {LONG_NUMBER}", "filter"), lambda g: S.span(f"{g}.start", f"{g}.end"))
    return f"concat({long}, {_found(bare, rf'{GROUP_LABEL}{_SEPARATOR}{{0,{MOST_JOIN}}}({GROUP})', tail=True)})"


def kept(seen: str) -> str:
    """Spans of money and of dates that read as one."""
    y = lambda d, at, n: f"try_cast(substring({d}, {at}, {n}) AS int)"
    # three numbers by one separator, and a real day of 1950 to 2099
    numeric = lambda d: S.let(
        f"IF(rlike({d}, {_lit('^[0-9]{4}-')}), array({y(d, 1, 4)}, {y(d, 6, 2)}, {y(d, 9, 2)}), reverse(transform(split({d}, '[/.-]'), p -> try_cast(p AS int))))",
        lambda p: f"rlike({d}, {_lit(r'^[0-9]+([/.-])[0-9]+' + chr(92) + r'1([0-9]{2}|[0-9]{4})$')}) AND coalesce(try_make_timestamp(get({p}, 0) + IF(get({p}, 0) < {PIVOT}, 2000, IF(get({p}, 0) < 100, 1900, 0)), get({p}, 1), get({p}, 2), 0, 0, 0) BETWEEN TIMESTAMP '1950-01-01' AND TIMESTAMP '2099-12-31', false)",
    )
    real = S.each(_found(seen, KEEP_DATE), lambda s: S.let(S.part(seen, s), lambda d: f"rlike({d}, '[A-Za-z]') OR ({numeric(d)})"), "filter")
    return S.union(_found(seen, KEEP_MONEY), real)


def _spelled(text: str) -> str:
    """2-2-2 groups, but for those set apart by equal spaces or dots that read as a day and month."""
    two = lambda t, at: f"cast(substring({t}, {at}, 2) AS int)"
    date = lambda t: f"substring({t}, 3, 1) = substring({t}, 6, 1) AND substring({t}, 3, 1) IN (' ', '.') AND {two(t, 1)} BETWEEN 1 AND 31 AND {two(t, 4)} BETWEEN 1 AND 12"
    return S.each(_found(text, SPELLED_SORT_CODE), lambda s: S.let(S.part(text, s), lambda t: f"NOT ({date(t)})"), "filter")


_TITLE = r"(?i)^(?:mr|mrs|ms|miss|mx|dr|prof)\.?\s+"


def _name_words(text: Column) -> Column:
    return squashed(F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), _TITLE, ""), "[.,]", " ")))


def name_forms(names: Column) -> Column:
    """How the names of a household (an array) may be printed: whole, by initials, surname first, and in one word."""

    def forms(words: Column) -> Column:
        first, last, front = words[0], F.element_at(words, -1), F.slice(words, 1, F.size(words) - 1)
        initial = F.substring(first, 1, 1)
        initials = F.array_join(F.transform(front, lambda w: F.substring(w, 1, 1)), " ")
        spaced = F.array(
            F.array_join(words, " "), F.concat_ws(" ", first, last), F.concat_ws(" ", initial, last), F.concat_ws(" ", initials, last), F.concat_ws(" ", F.array(initial), F.slice(words, 2, F.size(words))),
            F.concat_ws(" ", last, first), F.concat_ws(" ", last, initial), F.concat_ws(" ", last, initials),
        )
        return F.concat(spaced, F.when(F.length(last) >= 3, F.array(F.concat(initial, last), F.concat(last, initial), F.concat(first, last))).otherwise(F.array().cast("array<string>")))

    words = F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.split(_name_words(n), " "))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.size(w) >= 2), forms)))


def name_pattern(forms: Column) -> Column:
    """A pattern for any of the forms, longest first; one that finds nothing where there are none."""
    quoted = F.transform(forms, lambda f: F.array_join(F.transform(F.split(f, " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))), r"[\s.,_/\-]+"))
    longest = F.transform(F.array_sort(F.transform(quoted, lambda q: F.struct((-F.length(q)).alias("n"), q.alias("q")))), lambda x: x["q"])
    return F.when(F.size(forms) > 0, F.concat(F.lit("(?iu)(?<![A-Za-z'])(?:"), F.array_join(longest, "|"), F.lit(")(?![A-Za-z'])"))).otherwise("$^")


def classes(seen: str, view: str, names: str) -> str:
    """The kinds of detail in a line, labels first; view: look_alikes_read(seen), names: a column of name_pattern()."""
    by_pattern = {k: f"rlike({seen}, {_lit(p)})" for k, p in {**LABELS, **VALUES}.items()}
    for k in NUMBERS:
        by_pattern[k] += f" OR ({view} <> {seen} AND rlike({view}, {_lit(VALUES[k])}))"
    by_pattern["sort_code"] += f" OR size({_spelled(seen)}) > 0 OR ({view} <> {seen} AND size({_spelled(view)}) > 0)"
    by_pattern["holder_name"] += f" OR rlike({seen}, {names})"
    return f"IF({seen} IS NOT NULL, array_compact(array({', '.join(f"IF({found}, '{k}', NULL)" for k, found in by_pattern.items())})), NULL)"


def _from_first(spans: str, text: str, lead: str) -> str:
    """Spans without what lead matches at their start."""
    return S.each(spans, lambda s: S.span(f"{s}.start + length(regexp_extract({S.part(text, s)}, {_lit(lead)}, 0))", f"{s}.end"))


def values(seen: str, view: str, shown: str, names: str) -> str:
    """Spans of values. shown: seen with its money and dates painted over."""
    to_value = rf"^.*?(?=[0-9{MASK_MARKS}]|\.\.\.)"
    all_of = []
    for text, kinds in ((seen, [k for k in VALUES if k != "balance_line"]), (view, NUMBERS)):
        own = []
        for k in kinds:
            found = _found(text, VALUES[k])
            if k == "card_number" or text == view:  # the pattern may have taken the year of a date before it
                found = _from_first(found, shown, rf"^[{KEPT}\s]+")
            if k in ("account_number", "card_ending"):  # the label stays
                found = _from_first(found, text, to_value)
            if k == "holder_name":
                found = _found(shown, rf"(?:{VALUES[k]})[A-Za-z&'.\-]*(?=\s|$){_NAME_TOKENS}")
            own.append(found)
        own.append(_spelled(text))
        all_of.append(f"concat({', '.join(own)})")
    misread = f"IF({view} <> {seen}, {all_of[1]}, {S.NONE})"
    return f"concat({all_of[0]}, {misread}, {S.found(seen, names, mark=BREAK)})"


# labels that give up the whole line after them, and others, which give up the values after them
_WHOLE = r"(?i)(?:\b(?:account|acct?|a/c)\.?\s*(?:name|holders?|type)\b|^\s*holder\b|\bname\s*:|\bjoint\s+account\s*:)"
_VALUED = r"(?i)\b(?:account|acct?|a/c)\.?\s*(?:no\.?|num(?:ber)?)\b", *(LABELS[k] for k in ("customer_label", "sort_code_label", "card_label", "bank_code_label"))


def after_labels(shown: str) -> str:
    """Spans of what stands after labels. shown: seen with its money and dates painted over."""
    return f"concat({_found(shown, _WHOLE + '((?s).*)', tail=True)}, {', '.join(_found(shown, f'(?:{p}){_VALUE_TOKENS}', tail=True) for p in _VALUED)})"


def unmasked_label(shown: str) -> str:
    """A label that still has a value after it."""
    rest = S.each(f"regexp_extract_all({shown}, {_lit(_WHOLE + '((?s).*)')}, 1)", lambda r: f"regexp_replace({r}, {_lit(rf'{_PLACEHOLDER}|[{KEPT}{chr(92)}s:,&]')}, '') <> ''", "exists")
    left = [S.each(f"regexp_extract_all({shown}, {_lit(f'(?:{p}){_VALUE_TOKENS}')}, 1)", lambda r: f"{r} <> ''", "exists") for p in _VALUED]
    return " OR ".join([rest, *left])


def can_be_told(spans: str, keep: str, shown: str) -> str:
    """No span starts inside money or a date, nor has anything of its own after one."""

    def clash(s: str, k: str) -> str:
        own = f"{k}.end < {s}.end AND rlike(substring({shown}, {k}.end + 1, {s}.end - {k}.end), {_lit(rf'[^{chr(92)}s{KEPT}]')})"
        return f"{s}.start < {s}.end AND (({k}.start <= {s}.start AND {s}.start < {k}.end) OR ({s}.start < {k}.start AND {k}.start < {s}.end AND {own}))"

    return "NOT " + S.each(spans, lambda s: S.each(keep, lambda k: clash(s, k), "exists"), "exists")


def placeholder(n: str) -> str:
    """[hidden-a] to [hidden-zz], from 0."""
    return f"concat('[hidden-', IF({n} >= 26, char(96 + cast({n} / 26 AS int)), ''), char(97 + {n} % 26), ']')"


_PLACEHOLDER = r"\[hidden-[a-z]+\]"


def with_placeholders(painted: str, runs: str) -> str:
    """A painted text with a placeholder for each run."""
    marks = f"concat(transform({runs}, (r, i) -> {placeholder('i')}), array(''))"
    return f"array_join(zip_with(split(regexp_replace({painted}, {_lit(_RUNS)}, '{BREAK}'), '{BREAK}', -1), {marks}, (a, b) -> concat(a, b)), '')"


def wrapped(lines: DataFrame, key: str, pos: str) -> DataFrame:
    """lines (with seen and groups) with wrapped: spans of numbers that a line's end cuts in two.

    The group that a line starts with joins the one with which the line above ends its description, and the
    other way round; each line hands on only the number of its digits and whether it ends with a label.
    """
    joins = lambda t: f"(length({t}) <= {MOST_JOIN} AND rlike({t}, {_lit(rf'^{_SEPARATOR}*$')}))"
    edged = lines.withColumn("__end", F.expr(f"length(seen) - length(regexp_extract(seen, {_lit(_FIGURE_END)}, 0))"))
    tails = S.each("groups", lambda g: f"{g}.end <= __end AND {joins(f'substring(seen, {g}.end + 1, __end - {g}.end)')}", "filter")
    label = f"rlike(rtrim(substring(seen, 1, __end)), {_lit(rf'{GROUP_LABEL}{_SEPARATOR}{{0,{MOST_JOIN}}}$')})"
    edges = edged.selectExpr("*", f"IF(coalesce({joins('substring(seen, 1, get(groups, 0).start)')}, false), get(groups, 0), NULL) AS __head", f"try_element_at({tails}, -1) AS __tail", f"{label} AS __label")
    by = Window.partitionBy(key).orderBy(pos, "normal")
    near = edges.withColumn("__above", F.lag(F.struct("__tail.digits", "__label")).over(by)).withColumn("__below", F.lead("__head.digits").over(by))
    takes = f"__head IS NOT NULL AND coalesce(__above.__label OR __above.digits + __head.digits >= {LONG_NUMBER}, false)", f"coalesce(__tail.digits + __below >= {LONG_NUMBER}, false)"
    both = ", ".join(f"IF({take}, {S.span(f'{end}.start', f'{end}.end')}, NULL)" for take, end in zip(takes, ("__head", "__tail")))
    return near.withColumn("wrapped", F.expr(f"array_compact(array({both}))")).drop("__end", "__head", "__tail", "__label", "__above", "__below")


def prepared(lines: DataFrame, key: str, pos: str = "pos", text: str = "text", names: Column | None = None) -> DataFrame:
    """lines with kinds (of detail), outbound (what may leave of text, null if nothing may) and hidden (placeholder to what it stands for).

    names: an array of a household's names, in whatever columns of lines. Lines are dealt out by key once, which is all that moves.
    """
    given = [c for c in lines.columns if c not in ("kinds", "outbound", "hidden")]
    own = read(dealt(lines.select(*given), key), text).withColumn("__forms", name_forms(names) if names is not None else F.array().cast("array<string>")).withColumn("__names", name_pattern(F.col("__forms")))
    own = own.selectExpr("*", f"{look_alikes_read('seen')} AS __view").selectExpr("*", f"{without_money_and_own_date('__view')} AS __bare").selectExpr("*", f"{groups('__bare')} AS groups")
    own = wrapped(own, key, pos).selectExpr("*", f"{classes('seen', '__view', '__names')} AS kinds", f"{kept('seen')} AS __keep", f"concat({numbers('__bare', 'groups')}, wrapped) AS __numbers")
    own = own.selectExpr("*", f"{S.painted('seen', '__keep', KEPT)} AS __shown")
    own = own.selectExpr("*", f"IF(size(kinds) > 0, {values('seen', '__view', '__shown', '__names')}, {S.NONE}) AS __values", f"IF(size(kinds) > 0, {after_labels('__shown')}, {S.NONE}) AS __after")
    gone = S.kept_of(S.pieces(["concat(__values, __after)", "__keep", "__numbers"]), lambda p: f"{p}.n2 > 0 OR ({p}.n0 > 0 AND {p}.n1 = 0)")
    own = own.selectExpr("*", f"{gone} AS __gone").selectExpr("*", f"{S.painted('normal', '__gone', HIDDEN, chr(92) + 'S')} AS __painted", f"{S.painted('seen', '__gone', HIDDEN, chr(92) + 'S')} AS __dark")
    own = own.selectExpr("*", f"{_found('__painted', _RUNS)} AS __runs")
    # what would leave is looked at again
    own = own.selectExpr("*", f"{with_placeholders('__painted', '__runs')} AS __out", f"{with_placeholders('__dark', '__runs')} AS __left")
    own = own.selectExpr("*", f"{look_alikes_read('__left')} AS __left_view", f"{kept('__left')} AS __left_keep").selectExpr("*", f"{without_money_and_own_date('__left_view')} AS __left_bare", f"{S.painted('__left', '__left_keep', KEPT)} AS __left_shown")
    labels = ", ".join(f"'{k}'" for k in LABELS)
    still = f"size(array_except({classes('__left', '__left_view', '__names')}, array({labels}))) > 0 OR size({numbers('__left_bare', groups('__left_bare'))}) > 0 OR {unmasked_label('__left_shown')}"
    balance = f"array_contains(kinds, 'balance_line') OR (size(__runs) > 0 AND rlike(trim(regexp_replace(regexp_replace(__left, {_lit(_PLACEHOLDER)}, ' '), {_lit(chr(92) + 's+')}, ' ')), {_lit(BALANCE_LINE)}))"
    own = own.withColumn("__holder", F.array_contains("__forms", _name_words(F.col("seen"))))
    fine = f"coalesce(NOT ({balance}) AND NOT __holder AND {can_be_told('__values', '__keep', '__shown')} AND NOT ({still}) AND size(__runs) <= {MOST_HIDDEN}, false)"
    own = own.selectExpr("*", "size(kinds) = 0 AND size(__numbers) = 0 AS __untouched").selectExpr("*", f"__untouched OR {fine} AS __leaves")
    hidden = f"map_from_entries(transform(__runs, (r, i) -> named_struct('key', {placeholder('i')}, 'value', {S.part('normal', 'r')})))"
    return own.selectExpr(*[f"`{c}`" for c in given], "kinds", "IF(__leaves, IF(__untouched, normal, __out), NULL) AS outbound", f"IF(__leaves AND NOT __untouched, {hidden}, cast(map() AS map<string, string>)) AS hidden")
