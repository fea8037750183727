"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Payment cards are told first, by the Luhn check over every run of 13 to 19 digits that starts and ends
with a group of digits, so that expiry dates, security codes and other numbers beside a card don't hide
it; common groupings, with one or two spaces, dots, underscores or dashes between the groups, go before others, and a run in which a date, a social security or a phone number
stands is no card. All other values are found by one pattern and validated: payment cards (13 to 19 digits, Luhn), phone numbers
(ten digits, the area code from 001 and in
brackets or set apart), social security numbers, IPv4 addresses, dates from 1900 to
2099 and mail addresses. A valid value is put through a keyed Feistel network over its own format,
so the result is again a valid value of that format, equal values get equal pseudonyms in all
documents, and different ones get different ones. Separators stay where they were.

A value is read as a pair of numbers (x, y) below (a, b); a round adds a keyed hash of one half to
the other, modulo its size, which is a permutation whatever the hash. Mail addresses keep their
domain; letters and digits of the name before it are shifted within their class by hashes of the
other half of the name. Classes are ASCII's digits, small and capital letters, three rows of accented Latin letters, and
Greek, Cyrillic, Hebrew, Arabic, Devanagari, kana, Hangul and Han letters; a name without any of these stays.

Dates with strokes are read day first, or month first where there's no such day; they keep their order.
As a stand-in may be readable both ways, stand-ins of the two orders can look alike.

Not looked for, so left as they are: phone numbers without any separator or of other countries than
the North American ones, bank account numbers, names and postal addresses.

Values that aren't valid stay. A null text stays null, an empty one empty; repeated rows are treated
alike; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import aside

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31 are 319 x 229.
DAYS = (319, 229)

#: A name of any length: it is read from the start of its run only, so in time in proportion.
MAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{M}\p{N}.-]*\.[\p{L}\p{M}\p{N}-]+"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
DAY_DATE = r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)"
#: What may stand between the groups of a card, once or twice: spaces of four kinds, dots, underscores, hyphens and dashes.
_BETWEEN = "[ \u00a0\u2007\u202f._\u2010-\u2015-]"
#: Digits that may be a card: a gate before the closer look, and the common groupings.
DIGITS = rf"\d(?:{_BETWEEN}{{0,2}}\d){{12}}"
GROUPED = [r"\d{13,19}", *(rf"\d{{4}}({_BETWEEN}{{1,2}})" + rest for rest in (r"\d{4}\2\d{4}\2\d{4}\2\d{3}", r"\d{4}\2\d{4}\2\d{4}", r"\d{6}\2\d{4,5}"))]
#: Marks around cards that were told, while other values are looked for.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
CARD = rf"{OPEN}\d(?:{_BETWEEN}{{0,2}}\d){{12,18}}{CLOSE}"
#: Kinds in the order in which they're tried at a place.
KINDS = {"card": CARD, "mail": MAIL, "address": ADDRESS, "iso_date": ISO_DATE, "day_date": DAY_DATE, "social": SOCIAL, "phone": PHONE}
ANY = "|".join(KINDS.values())


def _hash(key: Column, kind: str, turn: Column, value: Column) -> Column:
    """A keyed hash: 60 bits of SHA-256 over key, kind, round and value."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: Column, kind: str, x: Column, y: Column, a: Column, b: Column) -> Column:
    """The permuted pair: struct of x below a and y below b."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))

    def turn(pair: Column, i: Column) -> Column:
        left = F.pmod(pair["x"] + F.pmod(_hash(key, kind, i * 2, pair["y"]), a), a)
        return let(left, lambda x: F.struct(x.cast("bigint").alias("x"), F.pmod(pair["y"] + F.pmod(_hash(key, kind, i * 2 + 1, x), b), b).cast("bigint").alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _padded(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _dressed(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, one after the other."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def put(state: Column, c: Column) -> Column:
        is_digit = c.rlike(r"^\d$")
        return F.struct(F.concat(state["text"], F.when(is_digit, F.substring(digits, state["at"], F.lit(1))).otherwise(c)).alias("text"), (state["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["text"])


def _luhn_digit(body: Column) -> Column:
    """The digit that makes body and itself pass the Luhn check."""
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int")), F.lit(0), lambda s, d: s + d)
    return F.pmod(-total, F.lit(10)).cast("string")


def _card(key: Column, value: Column) -> Column:
    def permuted(digits: Column) -> Column:
        half = F.floor((F.length(digits) - 1) / 2).cast("int")
        rest = (F.length(digits) - 1 - half).cast("int")
        ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
        pair = feistel(key, "card", F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), ten(half), ten(rest))
        return let(let(pair, lambda p: F.concat(_padded(p["x"], half), _padded(p["y"], rest))), lambda body: F.concat(body, _luhn_digit(body)))

    return _dressed(value, let(_digits(value), permuted))


def with_cards_marked(text: Column) -> Column:
    """The text with OPEN and CLOSE around its valid cards."""
    luhn = lambda v: F.call_function("luhn_check", _digits(v))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    # a hyphen before a card is a dash of the text, but one after a digit joins it to that
    free = r"(?<!\d)(?<!\d-)"
    grouped = [found(rf"{free}(?=({p})(?!\d))") for p in GROUPED]
    others = [found(rf"{free}(?<!\d[/.])(?=(\d(?:[ -]?\d){{{n - 1}}})(?!\d|[/.]\d))") for n in range(19, 12, -1)]
    inside = "|".join((ISO_DATE, SOCIAL, PHONE))
    valid = F.concat(F.filter(F.concat(*grouped), luhn), F.filter(F.concat(*others), lambda v: luhn(v) & ~v.rlike(inside)))
    any_of = lambda cards: F.concat(F.lit(rf"{free}(?:\Q"), F.array_join(cards, r"\E|\Q"), F.lit(r"\E)(?!\d)"))
    marked = lambda cards: F.when(F.size(cards) == 0, text).otherwise(F.regexp_replace(text, any_of(cards), F.lit(f"{OPEN}$0{CLOSE}")))
    return F.when(text.rlike(DIGITS), let(F.array_distinct(valid), marked)).otherwise(text)


def _phone(key: Column, value: Column) -> Column:
    def permuted(digits: Column) -> Column:
        part = lambda at, n: F.substring(digits, F.length(digits) - 10 + at, F.lit(n)).cast("bigint")
        pair = feistel(key, "phone", part(1, 3) - 1, part(4, 7), F.lit(999), F.lit(10_000_000))
        lead = F.substring(digits, F.lit(1), F.length(digits) - 10)
        return let(pair, lambda p: F.concat(lead, _padded(p["x"] + 1, 3), _padded(p["y"], 7)))

    return _dressed(value, let(_digits(value), permuted))


def _social(key: Column, value: Column) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    part = lambda k: F.element_at(F.split(value, "-"), k).cast("bigint")
    area = part(1) - F.when(part(1) > 666, 2).otherwise(1)
    pair = feistel(key, "social", area, (part(2) - 1) * 9_999 + part(3) - 1, F.lit(898), F.lit(99 * 9_999))
    shown = lambda p: F.concat_ws("-", _padded(p["x"] + F.when(p["x"] >= 665, 2).otherwise(1), 3), _padded(F.floor(p["y"] / 9_999) + 1, 2), _padded(p["y"] % 9_999 + 1, 4))
    return let(pair, shown)


def _address(key: Column, value: Column) -> Column:
    part = lambda k: F.element_at(F.split(value, r"\."), k).cast("bigint")
    pair = feistel(key, "address", part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65_536), F.lit(65_536))
    byte = lambda v, high: (F.floor(v / 256) if high else v % 256).cast("bigint").cast("string")
    return let(pair, lambda p: F.concat_ws(".", byte(p["x"], True), byte(p["x"], False), byte(p["y"], True), byte(p["y"], False)))


def _parsed(value: Column, pattern: str) -> Column:
    """The date, or null if there's none from 1900 to 2099."""
    day = F.try_to_timestamp(value, F.lit(pattern)).cast("date")
    return F.when(day.between("1900-01-01", "2099-12-31"), day)


def _date(key: Column, value: Column, day: Column, shown) -> Column:
    """All formats share one permutation of days, so a date stays linked however it's written."""
    a, b = DAYS
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    pair = feistel(key, "date", F.floor(n / b), n % b, F.lit(a), F.lit(b))
    return let(F.date_add(F.lit("1900-01-01").cast("date"), let(pair, lambda p: (p["x"] * b + p["y"]).cast("int"))), shown)


def _day_date(key: Column, value: Column) -> Column:
    """d/M/yyyy or, where that's no date, M/d/yyyy; padded if both numbers are."""
    first, two = _parsed(value, "d/M/yyyy"), value.rlike(r"^\d\d/\d\d/")

    def shown(d: Column) -> Column:
        by = lambda padded, plain: F.when(two, F.date_format(d, padded)).otherwise(F.date_format(d, plain))
        return F.when(first.isNotNull(), by("dd/MM/yyyy", "d/M/yyyy")).otherwise(by("MM/dd/yyyy", "M/d/yyyy"))

    return _date(key, value, F.coalesce(first, _parsed(value, "M/d/yyyy")), shown)


#: Classes of characters in the names of mail addresses, by code points: ASCII's digits, capitals and small letters, then
#: blocks of letters without gaps.
CLASSES = [
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x17F), (0x391, 0x3A1), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA), (0x620, 0x63A),
    (0x905, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]


def _mail(key: Column, value: Column) -> Column:
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)

    def shifted(text: Column, other: Column, turn: Column) -> Column:
        # the other half is hashed once, and each place with that hash: time in proportion to the name
        return let(F.sha2(F.concat_ws("|", F.lit(key), turn.cast("string"), other), 256), lambda seed: by_place(text, seed, turn))

    def by_place(text: Column, seed: Column, turn: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            def moved(code: Column) -> Column:
                by = _hash(key, "mail", turn, F.concat_ws("|", i.cast("string"), seed))
                of = lambda low, high: low + F.pmod(code - low + F.pmod(by, F.lit(high - low + 1)), F.lit(high - low + 1))
                new = F.coalesce(*[F.when(code.between(low, high), of(low, high)) for low, high in CLASSES])
                return F.when(new.isNull(), c).when(new < 128, F.chr(new.cast("int"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(new), 4, "0")), "UTF-16BE"))

            return let(F.ascii(c), moved)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    half = F.floor(F.length(name) / 2).cast("int")
    start = F.struct(F.substring(name, F.lit(1), half).alias("x"), F.substring(name, half + 1, F.length(name) - half).alias("y"))

    def turn(pair: Column, i: Column) -> Column:
        return let(F.when(pair["x"] == "", "").otherwise(shifted(pair["x"], pair["y"], i * 2)), lambda x: F.struct(x.alias("x"), shifted(pair["y"], x, i * 2 + 1).alias("y")))

    return F.concat(F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn, lambda p: F.concat(p["x"], p["y"])), F.lit("@"), domain)


def kind_of(value: Column) -> Column:
    """The kind of a found value, or null if it isn't valid."""
    whole = lambda kind: value.rlike(f"^(?:{KINDS[kind]})$")
    day = lambda pattern: _parsed(value, pattern).isNotNull()
    part = lambda k: F.element_at(F.split(value, "-"), k).cast("int")
    social = ~part(1).isin(0, 666) & (part(1) < 900) & (part(2) > 0) & (part(3) > 0)
    octets = F.forall(F.split(value, r"\."), lambda o: (o.cast("int") < 256) & o.rlike("^(0|[1-9][0-9]*)$"))
    return (
        F.when(whole("mail"), F.lit("mail"))
        .when(whole("address"), F.when(octets, F.lit("address")))
        .when(whole("iso_date"), F.when(day("yyyy-MM-dd"), F.lit("iso_date")))
        .when(whole("day_date"), F.when(day("d/M/yyyy") | day("M/d/yyyy"), F.lit("day_date")))
        .when(whole("social"), F.when(social, F.lit("social")))
        .when(whole("card") & F.call_function("luhn_check", _digits(value)), F.lit("card"))
        .when(whole("phone"), F.when(F.substring(_digits(value), F.length(_digits(value)) - 9, F.lit(3)) != "000", F.lit("phone")))
    )


def pseudonym(key: Column, value: Column, kind: Column) -> Column:
    """The value's stand-in; the value itself where kind is null."""
    return (
        F.when(kind == "mail", _mail(key, value))
        .when(kind == "address", _address(key, value))
        .when(kind == "iso_date", _date(key, value, _parsed(value, "yyyy-MM-dd"), lambda d: F.date_format(d, "yyyy-MM-dd")))
        .when(kind == "day_date", _day_date(key, value))
        .when(kind == "social", _social(key, value))
        .when(kind == "card", _card(key, F.translate(value, OPEN + CLOSE, "")))
        .when(kind == "phone", _phone(key, value))
        .otherwise(value)
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text", name: str = "clean_text", kinds: str = "kinds") -> DataFrame:
    """docs with the text in which every valid value is replaced, and the kinds found, in order.

    The two computed columns take the places of columns of their names. The key reaches the executors as the value of
    a subquery, so it stands in no plan and no event log.
    """
    own, names, _ = aside(docs)
    given = F.col(names[text])
    secret = docs.sparkSession.createDataFrame([(key,)], "secret string").scalar()

    def joined(marked: Column) -> Column:
        told = F.transform(F.regexp_extract_all(marked, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
        stands = lambda found: F.transform(found, lambda m: pseudonym(F.col("secret"), m["value"], m["kind"]))
        return let(told, lambda found: F.struct(
            F.array_join(F.zip_with(F.split(marked, ANY, -1), F.concat(stands(found), F.array(F.lit(""))), lambda gap, m: F.concat(gap, m)), "").alias("text"),
            F.filter(F.transform(found, lambda m: m["kind"]), lambda k: k.isNotNull()).alias("kinds"),
        ))

    held = own.withColumn("secret", secret).withColumn("held", F.when(given.rlike(f"{DIGITS}|{ANY}"), let(with_cards_marked(given), joined)))
    none = F.array().cast("array<string>")
    computed = {name: F.coalesce("held.text", given), kinds: F.coalesce("held.kinds", none)}
    kept = [F.col(new).alias(old) for old, new in names.items() if old.lower() not in {c.lower() for c in computed}]
    return held.select(*kept, *[c.alias(n) for n, c in computed.items()])
