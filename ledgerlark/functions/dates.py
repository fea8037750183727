"""Dates: reading printed dates, months, cadence steps, working days, pay dates and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import let

# How statements print dates (day first), as Spark patterns.
FORMATS = (
    "d/M/yyyy", "d/M/yy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d MMM yy", "d-MMM-yy",
    "yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "d/M/yyyy H:m", "d/M/yyyy H:m:s", "yyyyMMdd",
)
#: Two-digit years from here on belong to the 1900s.
PIVOT = 69
STRPTIME = {"%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%H": "H", "%M": "m", "%S": "s"}


def pattern_of(strptime: str) -> str:
    for k, v in STRPTIME.items():
        strptime = strptime.replace(k, v)
    return strptime


def printed_date(raw: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The date of a printed text in any of formats, the first that reads it; else null."""
    text = F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s+", " ")), r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    text = F.initcap(F.lower(F.regexp_replace(text, r"(?i)\bSept\b", "Sep")))
    text = F.regexp_replace(text, r"(?<=\d)t(?=\d)", "T")

    def read(text: Column) -> Column:
        hyphened = F.array_join(F.transform(F.split(text, "-"), F.initcap), "-")  # initcap alone leaves a month after a hyphen in lower case
        reads = []
        for f in formats:
            day = F.try_to_timestamp(hyphened if "-MMM-" in f else text, F.lit(f)).cast("date")
            if "yyyy" not in f:  # Spark reads yy as 2000 to 2099
                day = F.when(F.year(day) >= 2000 + PIVOT, F.add_months(day, -1200)).otherwise(day)
            shape = {"d/M/yyyy": r"^\d+/\d+/\d{4}$", "d/M/yy": r"^\d+/\d+/\d{2}$", "d-M-yyyy": r"^\d+-\d+-\d{4}$", "yyyy-M-d": r"^\d{4}-\d+-\d+$", "yyyyMMdd": r"^\d{8}$"}.get(f)
            reads.append(F.when(text.rlike(shape), day) if shape else day)
        return F.coalesce(*reads)

    return F.when(F.length(text) <= 64, let(text, read))


def month_add(day: Column, months: Column, wanted: Column) -> Column:
    """day moved by months to the wanted day of month: 0 is the last, null keeps day's own, later ones are clamped."""
    first = F.add_months(F.trunc(day, "month"), months)
    last = F.day(F.last_day(first))
    target = F.when(wanted.isNull(), F.day(day)).when(wanted == 0, last).otherwise(wanted)
    return F.date_add(first, (F.least(target, last) - 1).cast("int"))


# Days of a cadence, its tolerance, payments a year, least payments, misses until it lapses.
CADENCES = {
    "weekly": (7.0, 1.5, 52, 4, 3),
    "fortnightly": (14.0, 2.5, 26, 3, 2),
    "four_weekly": (28.0, 2.0, 13, 3, 2),
    "monthly": (30.44, 4.5, 12, 3, 2),
    "quarterly": (91.31, 10.0, 4, 3, 1),
    "annual": (365.25, 21.0, 1, 2, 1),
}


def next_due(day: Column, cadence: Column, wanted: Column, skip: Column) -> Column:
    """The next due date after a payment; months in skip are passed over."""
    fixed = F.when(cadence == "weekly", 7).when(cadence == "fortnightly", 14).when(cadence == "four_weekly", 28)
    months = F.when(cadence == "monthly", 1).when(cadence == "quarterly", 3).when(cadence == "annual", 12)
    hops = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda k: month_add(day, (k * months).cast("int"), wanted))
    open_hops = F.filter(hops, lambda d: ~F.array_contains(F.coalesce(skip, F.array().cast("array<int>")), F.month(d)))
    monthly = F.coalesce(F.try_element_at(open_hops, F.lit(1)), F.element_at(hops, 13))
    return F.when(fixed.isNotNull(), F.date_add(day, fixed)).otherwise(monthly)


def working_days(spark: SparkSession, first: str, last: str, holidays: DataFrame) -> DataFrame:
    """Calendar dimension by division: day, working, previous and next working day (itself if it is one).

    holidays: (division, day). The dimension has a row for each day and division, whatever the data.
    """
    days = spark.sql(f"SELECT explode(sequence(date '{first}', date '{last}')) AS day")
    divisions = holidays.select("division").distinct()
    every = days.withColumn("k", F.lit(1)).join(divisions.withColumn("k", F.lit(1)), "k").drop("k")
    flagged = every.join(holidays.withColumn("holiday", F.lit(True)), ["division", "day"], "left").withColumn("working", (F.weekday("day") < 5) & F.col("holiday").isNull())
    own = F.when(F.col("working"), F.col("day"))
    by = Window.partitionBy("division").orderBy("day")
    return flagged.select("division", "day", "working", F.last(own, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("previous"), F.first(own, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)).alias("next"))


def month_period(day: Column) -> Column:
    return F.struct(F.trunc(day, "month").alias("start"), F.last_day(day).alias("end"))


def month_grid(months: DataFrame, month: str = "month") -> DataFrame:
    """month, week (its Monday), weekday (0 is Monday) and day: whole weeks from the Monday on or before the first of a
    month to the Sunday on or after its last."""
    first = F.trunc(month, "month")
    monday = F.date_sub(first, F.weekday(first))
    last = F.last_day(month)
    days = F.explode(F.sequence(monday, F.date_add(last, 6 - F.weekday(last)), F.expr("interval 1 day"))).alias("day")
    return months.select(month, days).select(month, F.date_sub("day", F.weekday("day")).alias("week"), F.weekday("day").alias("weekday"), "day", (F.trunc("day", "month") == F.trunc(month, "month")).alias("inside"))


def easter(year: Column) -> Column:
    """Easter Sunday, by the Gregorian rule."""
    div = lambda a, b: F.floor(a / b)
    century, golden = div(year, F.lit(100)), year % 19
    epact = (15 + century - div(century, F.lit(4)) - div(8 * century + 13, F.lit(25)) + 19 * golden) % 30
    moon = epact - div(epact, F.lit(28)) * (1 - div(epact, F.lit(28)) * div(F.lit(29), epact + 1) * div(21 - golden, F.lit(11)))
    weekday = (year + div(year, F.lit(4)) + moon + 2 - century + div(century, F.lit(4))) % 7
    return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def bank_holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """division, day and name of the regular bank holidays of years, moved to the next working day where that is the rule.

    Days that were proclaimed once (a jubilee, a moved May day) are no rule; they can be added to the table.
    """
    y = F.col(year).cast("int")
    on = lambda month, day: F.make_date(y, F.lit(month), F.lit(day))
    first_monday = lambda month: F.date_add(on(month, 1), (7 - F.weekday(on(month, 1))) % 7)
    last_monday = lambda month: F.date_sub(F.last_day(on(month, 1)), F.weekday(F.last_day(on(month, 1))))
    past_weekend = lambda d: F.date_add(d, F.when(F.weekday(d) > 4, 7 - F.weekday(d)).otherwise(0).cast("int"))
    second = lambda d: F.date_add(d, F.when(F.weekday(d) > 4, 2).when(F.weekday(d) == 0, 1).otherwise(0))  # noqa: E731  the day after one that may have moved
    sunday = easter(y)
    rules = {
        "New Year": (past_weekend(on(1, 1)), "esn"), "Second of January": (second(on(1, 2)), "s"), "St Patrick": (past_weekend(on(3, 17)), "n"), "Good Friday": (F.date_sub(sunday, 2), "esn"),
        "Easter Monday": (F.date_add(sunday, 1), "en"), "Early May": (first_monday(5), "esn"), "Spring": (last_monday(5), "esn"), "Orangemen": (past_weekend(on(7, 12)), "n"), "Summer": (last_monday(8), "en"),
        "Scottish summer": (first_monday(8), "s"), "St Andrew": (past_weekend(on(11, 30)), "s"), "Christmas": (past_weekend(on(12, 25)), "esn"), "Boxing Day": (second(on(12, 26)), "esn"),
    }
    rows = [F.struct(F.lit(division).alias("division"), day.alias("day"), F.lit(name).alias("name")) for name, (day, where) in rules.items() for letter, division in (("e", "england"), ("s", "scotland"), ("n", "northern-ireland")) if letter in where]
    return years.select(F.explode(F.array(*rows)).alias("h")).select("h.*")
